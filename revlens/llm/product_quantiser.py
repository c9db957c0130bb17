"""Embedding near-duplicates by product quantisation (operator 2).

1. Equal vectors become one class; classes are compared, copies never.
2. Coarse centroids (k-means on a bounded sample) cut the unit sphere into lists. Every class has a home list, a code
   for its residual (one byte per subspace) and the length of the code's error.
3. A class probes its home list and every list whose border lies within half the link distance. Of two vectors within
   the link distance r, the border between their lists is within r / 2 of at least one of them, so one of the two
   probes the other's list: the probes are sufficient, whatever the data.
4. Lists are gathered in blocks of bounded size. A task holds the codes and vectors of one block and reads those of
   another one behind: every two blocks of which one holds a probe of the other meet once, so a class crosses the
   exchange once per block, whatever number of lists it probes.
5. The tables of a vector's distances to the code words give its distance to every coded vector by look-ups (asymmetric
   distance); only pairs of which one probes the other's list are looked up. By the triangle inequality a distance above
   r plus the code's error rules a pair out; the others are decided by the exact cosine in double precision.

Only sums per class and a spanning forest of the links leave a task.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import stored
from .components import Forest, components

MIN_COSINE = 0.9
SAMPLE_ROWS = 20_000      # classes that centroids and code words are fitted on
LIST_ROWS = 4096          # classes per list aimed at
MAX_LISTS = 1024
SUBSPACES = 8
WORDS = 256
SLICE_ROWS = 65_536       # classes of a block at most; larger lists are cut into slices, one per block
BLOCK_BYTES = 32 << 20    # and bytes of their vectors
STEP_ROWS = 1024          # classes that are placed, or looked up, at a time
PROBE_ROWS = 256
EXACT_BYTES = 4 << 20     # vectors that are compared at a time
SLACK = 1e-3              # for single-precision look-up sums


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Number of the row of ``c`` that is nearest to each row of ``x``."""
    size = (c * c).sum(1)[None]
    return np.concatenate([(size - 2 * x[k:k + STEP_ROWS] @ c.T).argmin(1) for k in range(0, len(x), STEP_ROWS)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        lab = _nearest(x, c)
        n = np.bincount(lab, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, lab, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


class Quantiser:
    """Coarse centroids and, per subspace, code words of the residuals."""

    def __init__(self, sample: np.ndarray, n_lists: int, subspaces: int = SUBSPACES, seed: int = 11):
        self.coarse = _kmeans(sample, max(1, n_lists), 8, seed)
        home = _nearest(sample, self.coarse)
        rest = sample - self.coarse[home]
        self.cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        self.words = [_kmeans(np.ascontiguousarray(rest[:, a:b]), WORDS, 6, seed + 1 + i)
                      for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:]))]
        self.between = np.sqrt(np.stack([((self.coarse - c) ** 2).sum(1) for c in self.coarse]))

    def home(self, x: np.ndarray):
        d = (x * x).sum(1)[:, None] + (self.coarse * self.coarse).sum(1)[None] - 2 * x @ self.coarse.T
        return d.argmin(1), d

    def probes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(home list, [row, list]: probed): lists whose border with the home list is within ``reach``."""
        home, d = self.home(x)
        gap = d - d[np.arange(len(x)), home][:, None]
        return home, gap <= 2 * (reach + 1e-6) * self.between[home] + 1e-9

    def encode(self, x: np.ndarray, home: np.ndarray):
        """(codes, error): one byte per subspace; distance of x to its coded form."""
        rest = x - self.coarse[home]
        codes, err = np.empty((len(x), len(self.words)), np.uint8), np.zeros(len(x))
        for i, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            d = (w * w).sum(1)[None] - 2 * rest[:, a:b] @ w.T
            codes[:, i] = d.argmin(1)
            err += ((rest[:, a:b] - w[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(err)

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """Per subspace, what all code words (rows) add to the squared distances of ``x`` besides ``base`` and the
        squared distance of ``x`` to the list's centroid."""
        return [(-2 * w @ x[:, a:b].T).astype(np.float32) for a, b, w in zip(self.cuts, self.cuts[1:], self.words)]

    def base(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """What a coded vector adds to its squared distance to any vector."""
        out = np.zeros(len(codes))
        for i, (a, b, w) in enumerate(zip(self.cuts, self.cuts[1:], self.words)):
            word = w[codes[:, i]]
            out += (word * (word + 2 * self.coarse[home, a:b])).sum(1)
        return out


def _unit(vectors, dim: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), dim)
    x /= np.abs(x).max(1, keepdims=True)          # very small and very large components keep their digits
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _place(q: Quantiser, reach: float, dim: int, kind):
    """Class -> its home list, its vector in ``kind``, its code and the code's error. ``seen`` are the lists it probes, as
    bits."""
    def run(batches):
        for b in batches:
            vectors = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)
            for k in range(0, b.num_rows, STEP_ROWS):
                some = vectors[k:k + STEP_ROWS]
                x = _unit(some, dim)
                home, probed = q.probes(x, reach)
                codes, err = q.encode(x, home)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home.astype(np.int32)), *(b.column(c).slice(k, len(some)) for c in ("rep", "n")),
                     _binary(some.astype(kind)), _binary(codes), pa.array(err), _binary(np.packbits(probed, axis=1))],
                    names=["home", "rep", "n", "x", "code", "err", "seen"])
    return run


PLACED = "home int, rep long, n long, x binary, code binary, err double, seen binary"


class Blocks:
    """Which lists share a block. Neighbours do while it has room; a list of more than ``rows`` classes is dealt to
    blocks of its own by a hash."""

    def __init__(self, q: Quantiser, sizes: dict[int, int], rows: int):
        away, at = q.between.copy(), 0
        self.first, self.cuts = np.zeros(len(away), np.int64), np.ones(len(away), np.int64)
        block, room = -1, 0
        for _ in range(len(away)):
            size = sizes.get(at, 0)
            if size > room:
                self.first[at], self.cuts[at] = block + 1, -(-size // rows)
                block, room = block + int(self.cuts[at]), max(rows - size, 0)
            else:
                self.first[at], room = max(block, 0), room - size
            away[:, at] = np.inf
            at = int(away[at].argmin())
        self.count = max(block, 0) + 1

    def of(self, home: np.ndarray, rep: np.ndarray) -> np.ndarray:
        mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[home] + mixed.astype(np.int64) % self.cuts[home]


def _touching(blocks: Blocks):
    """Placed classes -> the blocks, smaller number first, of which one holds a probe of the other; once per batch."""
    lists = [range(a, a + n) for a, n in zip(blocks.first.tolist(), blocks.cuts.tolist())]

    def run(batches):
        for b in batches:
            own = blocks.of(b.column("home").to_numpy(), b.column("rep").to_numpy())
            probed = np.unpackbits(_matrix(b.column("seen"), np.uint8, -(-len(lists) // 8)), axis=1, count=len(lists))
            pairs = {(min(k, o), max(k, o)) for k in np.unique(own).tolist()
                     for at in np.flatnonzero(probed[own == k].any(0)).tolist() for o in lists[at]}
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int32()) for i in (0, 1)], names=["a", "b"])
    return run


def _deal(blocks: Blocks, task: np.ndarray):
    """Placed class -> a row per task that its block takes part in, ``coded`` where it is the block with the smaller
    number; both where a block meets itself. ``task``: number by blocks, -1 where they do not meet."""
    def run(batches):
        for b in batches:
            own = blocks.of(b.column("home").to_numpy(), b.column("rep").to_numpy())
            for other in range(blocks.count):
                meets = task[np.minimum(own, other), np.maximum(own, other)]
                held, asking = (np.flatnonzero((meets >= 0) & side) for side in (own <= other, own >= other))
                rows = np.concatenate([held, asking])
                if len(rows):
                    some = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(meets[rows].astype(np.int32)), pa.array(np.arange(len(rows)) < len(held)), *some.columns],
                        names=["task", "coded", *some.schema.names])
    return run


def _search(q: Quantiser, min_cosine: float, dim: int, kind, itself: np.ndarray):
    """Sorted tasks, coded rows before probes, both by home list -> per class: copies linked, per link needed: a, b.

    A pair of classes meets in one task, and is looked up if one of them probes the other's list. In the tasks where a
    block meets ``itself`` a pair does so twice, and counts where the class with the smaller id is the probe.
    """
    r = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    n_lists, step = len(q.coarse), max(1, EXACT_BYTES // (8 * dim))

    def read(b):
        return (*(b.column(c).to_numpy() for c in ("rep", "n", "home")), _unit(_matrix(b.column("x"), kind, dim), dim),
                _matrix(b.column("seen"), np.uint8, -(-n_lists // 8)))

    def result(rep, links, pairs=()):
        some, k = np.flatnonzero(links), len(pairs)
        pairs = np.array(pairs, np.int64).reshape(k, 2)
        blank = np.zeros(len(some) + k, bool)
        blank[len(some):] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([rep[some], pairs[:, 0]])),
             pa.array(np.concatenate([links[some], np.zeros(k, np.int64)]), mask=blank),
             pa.array(np.concatenate([np.zeros(len(some), np.int64), pairs[:, 1]]), mask=~blank)],
            names=["rep", "links", "other"])

    class Block:
        def __init__(self, batches):
            parts = [(*read(b), _matrix(b.column("code"), np.uint8, len(q.words)), b.column("err").to_numpy()) for b in batches]
            self.rep, self.n, self.home, self.x, self.seen, code, err = (np.concatenate(p) for p in zip(*parts))
            limit = (r + err + SLACK) ** 2 + SLACK / 100
            for k in range(0, len(code), STEP_ROWS):
                limit[k:k + STEP_ROWS] -= q.base(code[k:k + STEP_ROWS], self.home[k:k + STEP_ROWS])
            self.code, self.limit = np.ascontiguousarray(code.T), limit.astype(np.float32)
            ends = [0, *(np.flatnonzero(np.diff(self.home)) + 1).tolist(), len(self.home)]
            self.lists = [(int(self.home[a]), np.arange(a, z)) for a, z in zip(ends, ends[1:])]
            self.sums, self.forest = np.zeros(len(self.rep), np.int64), Forest()

        def near(self, tables, rows):
            """(probe, row) of the pairs that the codes of ``rows`` do not rule out."""
            for k in range(0, len(rows), STEP_ROWS):
                some = rows[k:k + STEP_ROWS]
                code = self.code[:, some].astype(np.intp)
                # a code word's row of the table is copied whole, for all probes at once
                d = tables[0].take(code[0], axis=0)
                part = np.empty_like(d)
                for t, c in zip(tables[1:], code[1:]):
                    d += t.take(c, axis=0, out=part, mode="clip")
                found = np.flatnonzero((d <= self.limit[some, None]).ravel())
                if len(found):
                    yield found % d.shape[1], some[found // d.shape[1]]

        def looked_up(self, x, home, probed):
            """The same of probes with one home list, for the pairs of which one probes the other's list."""
            tables = q.tables(x)
            for at, rows in self.lists:
                away = ((x - q.coarse[at]) ** 2).sum(1).astype(np.float32)
                back = (self.seen[rows, home >> 3] >> (7 - (home & 7))) & 1
                for cols, some in ((np.flatnonzero(probed[:, at]), rows), (np.flatnonzero(probed[:, at] == 0), rows[back > 0])):
                    if len(cols) and len(some):
                        part = [t.take(cols, axis=1) for t in tables]
                        part[0] += away[cols]
                        for i, j in self.near(part, some):
                            yield cols[i], j

        def probe(self, b, itself):
            rep, n, home, x, seen = read(b)
            links, pairs = np.zeros(len(rep), np.int64), []
            probed = np.unpackbits(seen, axis=1, count=n_lists)
            for run in np.split(np.arange(len(rep)), np.flatnonzero(np.diff(home)) + 1):
                for k in range(0, len(run), PROBE_ROWS):
                    at = run[k:k + PROBE_ROWS]
                    for i, j in self.looked_up(x[at], int(home[at[0]]), probed[at]):
                        self.link(at[i], j, rep, n, x, links, pairs, itself)
            return result(rep, links, pairs)

        def link(self, i, j, rep, n, x, links, pairs, itself):
            if itself:
                use = rep[i] < self.rep[j]
                i, j = i[use], j[use]
            ok = np.empty(len(i), bool)
            for a in range(0, len(i), step):
                ok[a:a + step] = (x[i[a:a + step]] * self.x[j[a:a + step]]).sum(1) >= min_cosine
            i, j = i[ok], j[ok]
            if not len(i):
                return
            np.add.at(links, i, self.n[j])
            np.add.at(self.sums, j, n[i])
            # each probe needs one link into every tree it meets
            own, where = np.unique(j, return_inverse=True)
            trees, tree = np.unique([self.forest.find(v) for v in self.rep[own].tolist()], return_inverse=True)
            _, once = np.unique(i * len(trees) + tree[where], return_index=True)
            for a, b in zip(rep[i[once]].tolist(), self.rep[j[once]].tolist()):
                if self.forest.join(a, b):
                    pairs.append((a, b))

    def run(batches):
        task, held, block = None, [], None
        for b in batches:
            tasks, coded = b.column("task").to_numpy(), b.column("coded").to_numpy(zero_copy_only=False)
            for rows in np.split(np.arange(len(tasks)), np.flatnonzero(np.diff(tasks)) + 1):
                if not len(rows):
                    continue
                if tasks[rows[0]] != task:
                    if block:
                        yield result(block.rep, block.sums)
                    task, held, block = tasks[rows[0]], [], None
                k = int(coded[rows].sum())
                if k:
                    held.append(b.slice(rows[0], k))
                if k < len(rows):
                    if not block:
                        block, held = Block(held), []
                    yield block.probe(b.slice(rows[0] + k, len(rows) - k), bool(itself[task]))
        if block:
            yield result(block.rep, block.sums)
    return run


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows whose vector has finite components only, not all zero."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("v").isNotNull()).where(fine)
            .where(F.exists("v", lambda x: x != 0)))


def _linked_classes(vectors: DataFrame, dim: int, min_cosine: float, kind) -> DataFrame:
    """c_v, n_links, component_id of the distinct ones of ``vectors``, at least one, all of ``dim`` components that
    ``kind`` holds without loss."""
    spark = vectors.sparkSession
    # a key of its own for every class, whatever ids its vectors have
    classes = stored(spark, vectors.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
                     .withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    total = classes.count()
    share = min(1.0, SAMPLE_ROWS / total)
    sample = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v") \
        if share < 1 else classes.select("v")
    rows = sample.orderBy(F.xxhash64("v")).limit(SAMPLE_ROWS).collect() or classes.select("v").limit(1).collect()
    q = Quantiser(_unit([r["v"] for r in rows], dim), min(MAX_LISTS, max(1, -(-total // LIST_ROWS))))
    reach = float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) / 2

    placed = stored(spark, classes.mapInArrow(_place(q, reach, dim, kind), PLACED), "placed-vectors")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = min(SLICE_ROWS, max(1, BLOCK_BYTES // (8 * dim)), -(-total // math.ceil(math.sqrt(2 * n))))
    blocks = Blocks(q, {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}, most)     # a row per list
    touching = placed.select("home", "rep", "seen").mapInArrow(_touching(blocks), "a int, b int").distinct().collect()
    pairs = sorted({(r["a"], r["b"]) for r in touching} | {(k, k) for k in range(blocks.count)})
    task = np.full((blocks.count, blocks.count), -1)
    task[tuple(np.array(pairs).T)] = np.arange(len(pairs))
    found = (placed.mapInArrow(_deal(blocks, task), f"task int, coded boolean, {PLACED}")
             .repartitionById(len(pairs), "task").sortWithinPartitions("task", F.desc("coded"), "home")
             .mapInArrow(_search(q, min_cosine, dim, kind, np.array([a == b for a, b in pairs])),
                         "rep long, links long, other long"))
    found = stored(spark, found, "vector-links")
    sums = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "rep", "other")
    linked = roots.join(classes.select("rep", "least"), F.col("node") == F.col("rep")).select("node", "root", "least")
    lowest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(lowest, "root").select("node", "component_id")
    return (classes.join(sums, "rep", "left").join(named, F.col("rep") == F.col("node"), "left")
            .select(F.col("v").alias("c_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                    F.coalesce("component_id", "least").alias("component_id")))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per row of ``table``: vec_id, n_links, component_id, kept.

    Vectors that are null, zero or hold null or non-finite components link with nothing: no links, a component of
    their own. Vectors link within their dimension; every dimension is searched on its own. Rows that share an id are
    vectors of their own, each with its own links. Null ids are passed over when the smallest of a component is taken;
    a component of null ids only has a null component_id, and ``kept`` is null for rows without an id. An empty table
    stays empty. A class's copies are linked with each other without being compared.
    """
    plain = table.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    vectors = valid_vectors(table, id_col, vector_col)
    dims = sorted(r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().collect())
    if not dims:
        return plain.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                            F.lit(True).alias("kept"))
    kind = np.float32 if isinstance(table.schema[vector_col].dataType.elementType, FloatType) else np.float64
    by_class = reduce(DataFrame.union, [_linked_classes(vectors.where(F.size("v") == d), d, min_cosine, kind) for d in dims])
    joined = plain.join(by_class, F.col("v") == F.col("c_v"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op2_product_quantiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
