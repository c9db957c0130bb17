"""Statistics of many or continuous columns from mergeable parts of bounded size (§2.6).

* ``gram_corr``: correlations of hundreds of columns from one shifted Gram matrix per task, in blocks;
* ``exact_mode``: the mode without a count of every value, by candidates and a pass that verifies them;
* ``gauss_sums``: Gaussian kernel sums from the moments of boxes as wide as the bandwidth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128                           # columns in a block of the Gram matrix
FLAT = 1e-13                          # a variance below this share of the squares is rounding


def _number(df: DataFrame, c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


# ------------------------------------------------------------------ correlation

def _grams(shift: np.ndarray):
    """Rows (as lists of numbers) -> per pair of blocks the sums over rows where both columns are present: products,
    values, squares, rows. One matrix per task, whatever its rows."""
    c = len(shift)

    def run(batches):
        total = None
        for b in batches:
            flat = b.column("x").flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c) - shift
            mask = ~np.isnan(x)
            x = np.where(mask, x, 0.0)
            m = mask.astype(np.float64)
            part = np.stack([x.T @ x, x.T @ m, (x * x).T @ m, m.T @ m])
            total = part if total is None else total + part
        if total is None:
            return
        edges = range(0, c, BLOCK)
        keys = [(i, j) for i in edges for j in edges]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([total[:, i:i + BLOCK, j:j + BLOCK].tobytes() for i, j in keys], pa.binary())], names=["i", "j", "sums"])
    return run


def _correlations(c: int, constant: np.ndarray):
    """Parts of blocks, all of a block in one task -> (column, column, r)."""
    def run(batches):
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, raw in zip(*(b.column(k).to_pylist() for k in ("i", "j", "sums"))):
                # a block and the one across the diagonal come together: squares of the other column are there
                part = np.frombuffer(raw, np.float64).reshape(4, min(BLOCK, c - i), min(BLOCK, c - j))
                blocks[i, j] = blocks[i, j] + part if (i, j) in blocks else part
        for (i, j), (xy, x, xx, n) in blocks.items():
            _, y, yy, _ = (m.T for m in blocks[j, i])
            with np.errstate(invalid="ignore", divide="ignore"):
                vx, vy = xx - x * x / n, yy - y * y / n
                good = (n > 1) & (vx > FLAT * xx) & (vy > FLAT * yy)
                good &= ~constant[i:i + len(xy), None] & ~constant[None, j:j + xy.shape[1]]
                r = np.where(good, (xy - x * y / n) / np.sqrt(np.where(good, vx * vy, 1.0)), np.nan)
            if i == j:
                at = np.arange(len(r))
                r[at, at] = np.where(good[at, at], 1.0, np.nan)
            p, q = np.meshgrid(np.arange(len(xy)) + i, np.arange(xy.shape[1]) + j, indexing="ij")
            yield pa.RecordBatch.from_arrays(
                [pa.array(p.ravel().astype(np.int32)), pa.array(q.ravel().astype(np.int32)),
                 pa.array(r.ravel(), mask=np.isnan(r).ravel())], names=["p", "q", "r"])
    return run


def gram_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """col1, col2, r for every ordered pair of ``cols``: Pearson's r over the rows where both are present (NULL and NaN
    are not), NULL where one of them does not vary there or fewer than two rows are left.

    Columns are shifted by their means (a first pass, which also finds constant ones), so that sums of squares keep
    their digits. Then every task adds up one matrix for all its rows; blocks of it are summed over the tasks. Work and
    exchange grow with the square of the columns and, beyond the reading, not with the rows."""
    cols = list(cols)
    xs = [_number(df, c) for c in cols]
    st = df.agg(*[F.struct(F.avg(x).alias("m"), F.min(x).eqNullSafe(F.max(x)).alias("c")).alias(f"s{i}")
                  for i, x in enumerate(xs)]).first()
    shift = np.array([s["m"] or 0.0 for s in st], np.float64)
    constant = np.array([bool(s["c"]) for s in st])
    rows = df.select(F.array(*[F.coalesce(x, F.lit(float("nan"))) for x in xs]).alias("x"))
    parts = rows.mapInArrow(_grams(shift), "i int, j int, sums binary")
    # a block and its mirror image meet under the same key
    own = parts.repartition(F.least("i", "j"), F.greatest("i", "j"))
    out = own.mapInArrow(_correlations(len(cols), constant), "p int, q int, r double")
    names = F.array(*[F.lit(c) for c in cols])
    return out.select(F.get(names, F.col("p")).alias("col1"), F.get(names, F.col("q")).alias("col2"), "r")


# ------------------------------------------------------------------ mode

def _heavy(counters: int):
    """Misra and Gries: per column at most ``counters`` values with counts that are too small by at most ``lost``."""
    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for b in batches:
            col, v = b.column("c").to_numpy(), b.column("v").to_numpy()
            for c in np.unique(col).tolist():
                values, n, lost = held.get(c, (np.zeros(0), np.zeros(0, np.int64), 0))
                values, at = np.unique(np.concatenate([values, v[col == c]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones((col == c).sum(), np.int64)]), len(values)).astype(np.int64)
                if len(values) > counters:
                    cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
                    keep = n > cut                   # the counters left lose as much as what goes
                    values, n, lost = values[keep], n[keep] - cut, lost + cut
                held[c] = values, n, lost
        for c, (values, n, lost) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values) + 1, c, np.int32)), pa.array([*values.tolist(), None], pa.float64()),
                 pa.array([*n.tolist(), lost], pa.int64())], names=["c", "v", "n"])
    return run


def exact_mode(df: DataFrame, cols: Sequence[str], counters: int = 1000) -> dict[str, tuple[float, int] | None]:
    """The most frequent value of every column (of several the smallest) and its count; None for a column without values.

    Every task sends at most ``counters`` values per column. A value's true count lies between its summed counter and
    that plus all that tasks cut off; one pass counts exactly the values whose upper end reaches the best lower end. If
    the best of these exceeds what was cut off, no other value can come up to it. Only columns where it does not, which
    have no value that stands out, are counted in full, as a distributed aggregate."""
    out: dict[str, tuple[float, int] | None] = {c: None for c in cols}
    cells = [F.struct(F.lit(i).alias("c"), _number(df, c).alias("v")) for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*cells))).where("v is not null")
    # -0.0 and 0.0 are one value
    long = long.withColumn("v", F.col("v") + F.lit(0.0))
    parts = long.mapInArrow(_heavy(counters), "c int, v double, n long").groupBy("c", "v").agg(F.sum("n").alias("n")).checkpoint()
    lost = {r["c"]: r["n"] for r in parts.where("v is null").collect()}
    best = {r["c"]: r["m"] for r in parts.where("v is not null").groupBy("c").agg(F.max("n").alias("m")).collect()}
    if not lost:
        return out
    spark = df.sparkSession
    bounds = spark.createDataFrame([(c, lost[c], best.get(c, 0)) for c in lost], "c int, lost long, best long")
    near = parts.where("v is not null").join(F.broadcast(bounds), "c").where("n + lost >= best").select("c", "v")
    # at most the counters of all tasks; measured before it is sent to all
    from .shape import join_small
    exact = join_small(long, near, on=["c", "v"]).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by(F.struct("v", "n"), F.struct(-F.col("n"), F.col("v"))).alias("m")
    unsure = []
    found = {r["c"]: r["m"] for r in exact.groupBy("c").agg(first).collect()}
    for c in lost:
        if c in found and found[c]["n"] > lost[c]:
            out[cols[c]] = found[c]["v"], found[c]["n"]
        else:
            unsure.append(c)
    if unsure:
        counts = long.where(F.col("c").isin(unsure)).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        for r in counts.groupBy("c").agg(first).collect():
            out[cols[r["c"]]] = r["m"]["v"], r["m"]["n"]
    return out


# ------------------------------------------------------------------ kernel sums

ORDER = 18                            # terms of the expansion; the rest is below 1e-12 per value in boxes of one bandwidth


def gauss_sums(values: DataFrame, grid_x, bw, mn, step, points: int, reach: float) -> DataFrame:
    """point, _s: the sum of exp(-((y - x) / bw)^2 / 2) over all ``_x`` of ``values`` at each grid point y in reach.

    In a box as wide as the bandwidth, with d = (x - centre) / bw and t = (y - centre) / bw, the kernel is the sum of
    d^n / n! He_n(t) exp(-t^2 / 2): the sums of d^n over the box's values stand for all of them. One aggregate adds
    these up per box (``ORDER`` numbers, merged inside the tasks first); then boxes, not values, meet the grid."""
    box = F.floor((F.col("_x") - mn) / bw)
    d = (F.col("_x") - mn) / bw - F.col("_box") - F.lit(0.5)
    squares = values.where(bw > 0).select("_x", box.alias("_box")).select("_box", d.alias("_d1"))
    for k in (1, 2, 4, 8):                           # d, d^2, d^4, ...: a power is a product of a few of these
        squares = squares.withColumn(f"_d{2 * k}", F.col(f"_d{k}") * F.col(f"_d{k}"))
    powers = [F.sum(reduce(mul, [F.col(f"_d{1 << k}") for k in range(5) if n >> k & 1])).alias(f"_m{n}")
              for n in range(1, ORDER)]
    boxes = squares.groupBy("_box").agg(F.count(F.lit(1)).cast("double").alias("_m0"), *powers)
    centre = mn + (F.col("_box") + F.lit(0.5)) * bw
    first = F.greatest(F.lit(0), F.ceil((centre - F.lit(reach) * bw - mn) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((centre + F.lit(reach) * bw - mn) / step).cast("int"))
    point = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("point")
    scaled = F.array(*[F.col(f"_m{n}") / F.lit(float(math.factorial(n))) for n in range(ORDER)])
    met = boxes.select(centre.alias("_c"), scaled.alias("_m"), point)
    t = (grid_x - F.col("_c")) / bw
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))

    def term(acc, m):
        # He_(n+1) = t He_n - n He_(n-1)
        return F.struct(acc["b"].alias("a"), (F.col("_t") * acc["b"] - acc["n"] * acc["a"]).alias("b"),
                        (acc["n"] + F.lit(1.0)).alias("n"), (acc["s"] + m * acc["b"]).alias("s"))

    terms = F.aggregate("_m", start, term)["s"] * F.exp(F.lit(-0.5) * F.col("_t") * F.col("_t"))
    return met.select("point", t.alias("_t"), "_m").groupBy("point").agg(F.sum(terms).alias("_s"))
