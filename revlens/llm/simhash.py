"""SimHash near-duplicates through a segment-popcount embedding (operator 7).

A fingerprint's 64 bits are cut into segments of two; the bit counts of the segments are a point on a grid, and the
Manhattan distance of two points never exceeds the Hamming distance of their fingerprints. The grid is joined within
that distance and every pair found is verified bit by bit. To keep the range small, the segments are cut into
``max_bits // 2 + 1`` parts: fingerprints within ``max_bits`` differ by one bit at most in some part, so their points
are equal there or neighbours in one coordinate. A point is sent to its own cell of each part and to the upper
neighbour cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_slices, row_key, stored
from .components import Forest, components, spanning_links

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SLICE_ROWS = 4096         # points of one cell that are compared in one place
SMALL_GROUP = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the lower-cased (A-Z) words of the whole text; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    if len(words) <= shingle:
        h = [xxhash.xxh64_intdigest(data, SEED)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], stops[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        h = [digest(data[a:b], SEED) for a, b in zip(starts.tolist(), stops[shingle - 1:].tolist())]
    octets = np.array(h, np.uint64).view(np.uint8).reshape(-1, 8)
    if len(h) < 256:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for b in batch_slices(batches, "t"):
            got = np.array([fingerprint(t, shingle) for t in b.column("t").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "k1", "k2")), pa.array(got.view(np.int64))],
                                             names=["doc_id", "k1", "k2", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2 (see ``row_key``), fp (the 64 bits as a signed long) of every row; null texts have fingerprint 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col),
                       F.col(text_col).alias("t")).mapInArrow(
        _fingerprints(shingle), "doc_id long, k1 long, k2 long, fp long")


# ------------------------------------------------------------------ grid

def _parts(max_bits: int) -> list[tuple[int, int]]:
    """(lowest segment, segments) of each part; 32 segments of two bits in all."""
    n = max_bits // 2 + 1
    edges = [32 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def _grid_rows(points: DataFrame, max_bits: int) -> DataFrame:
    """part, cell, query (false: the point's own cell, true: an upper neighbour), fp."""
    # bit counts of all segments at once, each written into the segment's own two bits: bit operations only, as sums
    # of signed longs may overflow
    low_bits, half = F.lit(0x5555555555555555), F.shiftrightunsigned("fp", 1)
    embed = (F.col("fp").bitwiseXOR(half).bitwiseAND(low_bits)).bitwiseOR(
        F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(low_bits), 1))
    points = points.select("fp", embed.alias("e"))
    rows = None
    for p, (low, n) in enumerate(_parts(max_bits)):
        cell = F.col("e").bitwiseAND(F.lit(_signed(((1 << 2 * n) - 1) << 2 * low)))
        up = []
        for s in range(low, low + n):              # one more: 0 to 1 flips the low bit, 1 to 2 both
            count = F.shiftrightunsigned("e", 2 * s).bitwiseAND(F.lit(3))
            up.append(F.when(count == 0, cell.bitwiseXOR(F.lit(_signed(1 << 2 * s))))
                      .when(count == 1, cell.bitwiseXOR(F.lit(_signed(3 << 2 * s)))))
        up = F.array(*up)
        cells = F.concat(F.array(F.struct(cell.alias("cell"), F.lit(False).alias("query"))),
                         F.transform(F.filter(up, lambda c: c.isNotNull()),
                                     lambda c: F.struct(c.alias("cell"), F.lit(True).alias("query"))))
        part = points.select(F.lit(p).alias("part"), F.explode(cells).alias("c"), "fp").select(
            "part", "c.cell", "c.query", "fp")
        rows = part if rows is None else rows.union(part)
    return rows


def _hamming(a, b):
    return np.bitwise_count(a ^ b)


def _link_groups(max_bits: int):
    """Rows sorted by group, own points before queries -> a spanning forest of the verified links of the partition."""

    def group_links(fp, query, forest, out):
        own = int((~query).sum())
        if not own or len(fp) < 2:
            return

        def near(i):
            if i >= own:
                return np.zeros(0, np.int64)      # two queries meet elsewhere
            return i + 1 + np.flatnonzero(_hamming(fp[i + 1:], fp[i]) <= max_bits)

        for i, j in spanning_links(len(fp), near):
            if forest.join(int(fp[i].view(np.int64)), int(fp[j].view(np.int64))):
                out.append((int(fp[i].view(np.int64)), int(fp[j].view(np.int64))))

    def many(part, cell, cut, query, fp, forest, out):
        """All complete groups of a sorted run of rows."""
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (cell[1:] != cell[:-1])
                                               | (cut[1:] != cut[:-1])]))
        size = np.diff(np.append(first, len(fp)))
        big = np.flatnonzero(size > SMALL_GROUP)
        for g in big.tolist():
            a, b = int(first[g]), int(first[g] + size[g])
            group_links(fp[a:b], query[a:b], forest, out)
        left = np.repeat(size, size) - (np.arange(len(fp)) - np.repeat(first, size)) - 1   # rows after it in its group
        left[np.repeat(size > SMALL_GROUP, size)] = 0
        left[query] = 0
        k, rows = 1, np.flatnonzero(left >= 1)
        while len(rows):
            hit = rows[_hamming(fp[rows], fp[rows + k]) <= max_bits]
            for x, y in zip(fp[hit].view(np.int64).tolist(), fp[hit + k].view(np.int64).tolist()):
                if forest.join(x, y):
                    out.append((x, y))
            k += 1
            rows = rows[left[rows] >= k]

    def run(batches):
        forest, rest = Forest(), None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "cell", "cut", "query", "fp")]
            cols[4] = cols[4].view(np.uint64)
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            part, cell, cut = cols[:3]
            same = (part == part[-1]) & (cell == cell[-1]) & (cut == cut[-1])
            last = len(part) - int(np.argmin(same[::-1])) if not same.all() else 0     # the last group may go on
            out: list[tuple[int, int]] = []
            if last:
                many(*[c[:last] for c in cols], forest, out)
            rest = [c[last:].copy() for c in cols]
            if out:
                yield _pairs(out)
        if rest is not None and len(rest[0]):
            out = []
            many(*rest, forest, out)
            if out:
                yield _pairs(out)
    return run


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                       pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``points`` that connect exactly those within
    ``max_bits`` of each other: each task leaves out links that its earlier ones already imply.

    A cell with more than SLICE_ROWS points is cut into slices by hash: every point lives in one, and goes as a query
    to the lower ones; neighbours' points go as queries to all. So no group is unbounded and no pair is lost.
    """
    if not 0 <= max_bits <= 8:
        raise ValueError("max_bits must lie between 0 and 8")
    spark = points.sparkSession
    rows = _grid_rows(points, max_bits)
    crowded = (rows.where("not query").groupBy("part", "cell").agg(F.count("*").alias("n"))
               .where(F.col("n") > SLICE_ROWS)
               .select("part", "cell", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("cuts")))
    rows = rows.join(crowded, ["part", "cell"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    home = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    top = F.when(F.col("query"), F.col("cuts") - 1).otherwise(home)
    rows = rows.select("part", "cell", "query", "fp", home.alias("home"), F.explode(F.sequence(F.lit(0), top)).alias("cut"))
    rows = rows.select("part", "cell", "cut", (F.col("query") | (F.col("cut") != F.col("home"))).alias("query"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "part", "cell", "cut").sortWithinPartitions("part", "cell", "cut", "query")
            .mapInArrow(_link_groups(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, k1, k2 (see ``row_key``), fp, component_id (smallest id reachable by links,
    itself included) and root (the same for all rows of a component, and never null).

    Equal fingerprints are one point, so copies are never compared. Null and empty texts share fingerprint 0. Null ids
    are passed over when the smallest is taken; a component of null ids only has a null component_id. Rows that
    share an id are rows of their own.
    """
    spark = docs.sparkSession
    fps = stored(spark, fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = stored(spark, fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    roots = components(stored(spark, links(classes.select("fp"), max_bits), "fingerprint-links"))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = rooted.join(least, "root").select(F.col("fp").alias("c_fp"), "component_id", "root")
    return fps.join(by_fp, F.col("fp") == F.col("c_fp")).select("doc_id", "k1", "k2", "fp", "component_id", "root")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7 over all of ``documents``."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
