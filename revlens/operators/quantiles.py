"""Exact quantiles in bounded memory per task.

Spark's exact ``percentile`` keeps a value→count map per group and merges it
in one task: right for ratings, unbounded for a continuous column whose hot
group holds a third of all rows. ``exact_quantiles`` gives the same numbers
(linear interpolation between the order statistics at ⌊p·(n−1)⌋ and
⌈p·(n−1)⌉) by refining value ranges instead:

1. one pass counts rows (with exact min and max) per group and log-scale
   bucket — 256 buckets per power of two, a monotone function of the value,
   so no min/max is needed first; n is the sum, and a running sum over the
   occupied buckets (at most ~563,000 per group, in practice a few
   thousand) finds the bucket holding each target rank, whose exact min/max
   become the target's range;
2. each further level splits every open target's value range into ``buckets``
   equal-width buckets and counts rows per bucket (a partial aggregate); a
   running sum over at most ``buckets`` rows per target finds the bucket
   holding the rank, whose exact min/max become the next range;
3. once a target's range holds at most ``small`` rows (or a single value),
   those rows alone are ranked.

No task ever holds more than ``buckets`` bucket rows (level 1: the occupied
log buckets of a group) or ``small`` candidate values per target. Each level is one pass over the data; the target table is
checkpointed to the shared checkpoint folder between levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .shape import join_small


# 256 buckets per power of two: each bucket spans 0.27 % of its values
# magnitude, whatever the column's range. Bucket numbers are offset to stay
# away from zero (the bucket of 0.0); ±infinity get their own end buckets.
LOG_BUCKETS_PER_OCTAVE = 256
_LOG_OFFSET = 1100 * LOG_BUCKETS_PER_OCTAVE  # > |log2| of every finite double, × buckets
_INF_BUCKET = 1 << 40


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: Sequence[str] = (),
                    buckets: int = 1 << 12, small: int = 1 << 16, max_levels: int = 8,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Per group: ``n`` and one double column per probability (``q0``, ``q1``…)."""
    g = list(group)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    checkpoint_root(df.sparkSession)
    key = g if g else ["_k"]
    x = df.select(*[F.col(c) for c in g], F.col(value).cast("double").alias("_x")) \
          .where(F.col("_x").isNotNull() & ~F.isnan(F.col("_x")))
    if not g:
        x = x.withColumn("_k", F.lit(0))
    # Level 0 is fused with the counting pass: a fixed log-scale bucketing
    # (``LOG_BUCKETS_PER_OCTAVE`` buckets per power of two, mirrored for
    # negatives, zero alone) is a monotone function of the value, so it needs no
    # min/max first. One pass gives count, min and max per bucket; n is their sum.
    ax = F.abs(F.col("_x"))
    lg = F.floor(F.log2(ax) * F.lit(float(LOG_BUCKETS_PER_OCTAVE))) + F.lit(_LOG_OFFSET)
    b0 = (F.when(F.col("_x") == 0, F.lit(0).cast("long"))
          .when(ax == float("inf"), F.when(F.col("_x") > 0, F.lit(_INF_BUCKET)).otherwise(F.lit(-_INF_BUCKET)))
          .when(F.col("_x") > 0, lg).otherwise(-lg))
    hist = x.groupBy(*key, b0.alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmn"),
                                                F.max("_x").alias("_bmx")).checkpoint()
    n_t = hist.groupBy(*key).agg(F.sum("_c").alias("_n"))
    ranks = []
    for p in probs:
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        ranks += [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]
    wanted = n_t.select(*key, "_n", F.explode(F.array_distinct(F.array(*ranks))).alias("_r"))
    w0 = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cum = hist.withColumn("_start", F.coalesce(F.sum("_c").over(w0), F.lit(0)).cast("long"))
    targets = wanted.join(cum, on=key).where(
        (F.col("_start") <= F.col("_r")) & (F.col("_r") < F.col("_start") + F.col("_c"))).select(
        *key, "_n", "_r", F.col("_bmn").alias("_lo"), F.col("_bmx").alias("_hi"),
        F.col("_start").alias("_below"), F.col("_c").alias("_cnt"))
    settled = (F.col("_lo") == F.col("_hi")) | (F.col("_cnt") <= small)

    def rows_in(intervals: DataFrame) -> DataFrame:
        # rows inside each distinct interval; the interval table is measured and
        # broadcast when it fits, else shuffled on the group key
        return join_small(x, intervals, on=key).where(
            (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi")))

    # targets derive from the materialised bucket table alone: no checkpoint needed here
    for _ in range(max_levels):
        open_t = targets.where(~settled)
        if open_t.isEmpty():  # reads the small checkpointed table only
            break
        # targets sharing an interval share its bucket counts: count each interval once
        iv = open_t.select(*key, "_lo", "_hi").distinct()
        width = F.col("_hi") - F.col("_lo")
        b = F.least(F.floor((F.col("_x") - F.col("_lo")) / width * F.lit(float(buckets))), F.lit(buckets - 1))
        per_iv = rows_in(iv).groupBy(*key, "_lo", "_hi", b.cast("int").alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_bmn"), F.max("_x").alias("_bmx"))
        per = open_t.select(*key, "_n", "_r", "_lo", "_hi", "_below").join(per_iv, on=[*key, "_lo", "_hi"])
        w = Window.partitionBy(*key, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        per = per.withColumn("_cb", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        start = F.col("_below") + F.col("_cb")
        pick = per.where((start <= F.col("_r")) & (F.col("_r") < start + F.col("_c"))).select(
            *key, "_n", "_r", F.col("_bmn").alias("_lo"), F.col("_bmx").alias("_hi"), start.cast("long").alias("_below"),
            F.col("_c").alias("_cnt"))
        targets = targets.where(settled).unionByName(pick).checkpoint()

    single = targets.where(F.col("_lo") == F.col("_hi")).select(*key, "_n", "_r", F.col("_lo").alias("_v"))
    rest = targets.where(F.col("_lo") != F.col("_hi"))
    # rank the few rows of each remaining interval once, then read each target's rank
    rw = Window.partitionBy(*key, "_lo", "_hi").orderBy("_x")
    ranked_iv = rows_in(rest.select(*key, "_lo", "_hi").distinct()).select(
        *key, "_lo", "_hi", "_x", (F.row_number().over(rw) - 1).alias("_rn"))
    ranked = (rest.select(*key, "_n", "_r", "_lo", "_hi", "_below").join(ranked_iv, on=[*key, "_lo", "_hi"])
              .where(F.col("_rn") == F.col("_r") - F.col("_below")).select(*key, "_n", "_r", F.col("_x").alias("_v")))
    # at most 2·len(probs) entries per group: the collected map is bounded
    out = single.unionByName(ranked).groupBy(*key).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))
    cols = []
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        vlo, vhi = F.element_at("_m", lo), F.element_at("_m", hi)
        q = F.when(lo == hi, vlo).otherwise((hi.cast("double") - pos) * vlo + (pos - lo.cast("double")) * vhi)
        cols.append(q.alias(name))
    return out.select(*g, F.col("_n").alias("n"), *cols)
