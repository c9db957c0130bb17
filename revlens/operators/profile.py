"""Profiles, counts, distributions and correlations (§2.6).

Totals that a result is divided by come from uncorrelated scalar subqueries
(``DataFrame.scalar()``): Spark runs each once and inlines the value, so no
cross join and no unpartitioned window over raw rows is ever needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import assign_bin, CONFIDENCE_EDGES, percent_label, label_name
from .shape import join_small, number_top, top_k_sorted
from .wide import exact_mode, gauss_sums, gram_corr



def _pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


def _is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def _number(df: DataFrame, c: str) -> Column:
    """The column as double; NaN counts as missing in every statistic."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else x


def _counts_of_all(df: DataFrame, key: str, name: str = "count"):
    """(rows per non-NULL key, number of all rows), from one pass: the NULL
    group is counted too and left out afterwards, by a flag that is part of the
    aggregate, so that both uses share one exchange."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name), F.max(F.col(key).isNotNull()).alias("_known"))
    total = counts.agg(F.sum(F.when(F.col("_known").isNotNull(), F.col(name)))).scalar()
    return counts.where("_known").drop("_known"), total


def value_counts(df: DataFrame, col: str, count_name: str = "count") -> DataFrame:
    """Rows per non-NULL value, most frequent first (ties by value)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(count_name))
    return counts.orderBy(F.col(count_name).desc(), F.col(col).asc())


def value_counts_pct(df: DataFrame, col: str, count_name: str = "count", pct_name: str = "pct") -> DataFrame:
    """Count and share (% of non-NULL rows) per value."""
    counts = value_counts(df, col, count_name)
    total = counts.select(F.sum(count_name)).scalar()
    return counts.withColumn(pct_name, _pct(F.col(count_name), total))


def count_distinct(df: DataFrame, cols: Sequence[str], approx_rsd: float | None = None) -> DataFrame:
    """Exact distinct non-NULL values per column (or HyperLogLog++ with ``approx_rsd``)."""
    if approx_rsd is None:
        aggs = [F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in cols]
    else:
        aggs = [F.approx_count_distinct(F.col(c), approx_rsd).alias(f"distinct_{c}") for c in cols]
    return df.agg(*aggs)


def top_k_remainder(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top ``k`` values with rank, plus how many values and rows fall outside them."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    st = _stats(counts, n_values=F.count(F.lit(1)), n_rows=F.sum("count"))
    n_values, n_rows = st["n_values"], st["n_rows"]
    top = top_k_sorted(counts, "count", col, k)
    in_top = top.select(F.sum("count")).scalar()
    return (number_top(top, "count", col)
            .withColumn("other_values", F.greatest(n_values - F.lit(k), F.lit(0)).cast("long"))
            .withColumn("other_rows", (n_rows - in_top).cast("long")))


def top_k_other(df: DataFrame, col: str, k: int = 15, other: str = "Other") -> DataFrame:
    """Top ``k`` values plus one ``Other`` row holding the rest (none when there
    are at most ``k`` values); share of the non-NULL total and a display label;
    rank k+1 for ``Other``. Only the ``k`` top keys are broadcast."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    top = number_top(top_k_sorted(counts, "count", col, k), "count", col)
    tagged = counts.join(F.broadcast(top.select(col, "rank")), on=col, how="left")
    grouped = (tagged.groupBy(F.when(F.col("rank").isNull(), F.lit(other)).otherwise(F.col(col)).alias(col),
                              F.coalesce(F.col("rank"), F.lit(k + 1)).alias("rank"))
               .agg(F.sum("count").cast("long").alias("count")))
    return (grouped.withColumn("pct", _pct(F.col("count"), total))
            .withColumn("label", percent_label(F.col("count"), total))
            .orderBy(F.col("rank").desc()))


def top_k_coverage(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top ``k`` values, each with rank and % of all rows (NULL included in the
    base), plus the share of all rows the top ``k`` cover together."""
    counts, n_all = _counts_of_all(df, col)
    top = top_k_sorted(counts, "count", col, k)
    in_top = top.select(F.sum("count")).scalar()
    return (number_top(top, "count", col)
            .withColumn("pct", _pct(F.col("count"), n_all))
            .withColumn("coverage_pct", _pct(in_top, n_all)))


def missing_profile(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count and % per column, only columns with any."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(_is_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(cols)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("missing"))
                      for i, c in enumerate(cols)])
    long = row.select(F.col("_rows"), F.inline(cells))
    return (long.where(F.col("missing") > 0)
            .select("column", "missing", _pct(F.col("missing"), F.col("_rows")).alias("pct")))


def describe_numeric(df: DataFrame, cols: Sequence[str], approx_accuracy: int | None = None,
                     method: str | None = None) -> DataFrame:
    """count, mean, std (n−1), min, 25/50/75 % (linear interpolation), max per column.

    ``method`` picks the quartiles: ``"map"`` (Spark's exact ``percentile``: a
    value→count map per column, right for ratings and other small domains),
    ``"bucketed"`` (exact in bounded memory, for continuous columns at scale;
    see ``operators.quantiles``) or ``"approx"`` (``percentile_approx`` with
    ``approx_accuracy``).
    """
    method = method or ("approx" if approx_accuracy is not None else "map")
    if method == "bucketed":
        from .quantiles import exact_quantiles
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _number(df, c).alias("v"))
                                              for c in cols])))
        moments = long.groupBy("column").agg(
            F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max"))
        q = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"], names=["p25", "p50", "p75"])
        return moments.join(q.drop("n"), on="column", how="left").select(
            "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    aggs, structs = [], []
    for i, c in enumerate(cols):
        x = _number(df, c)
        if method == "map":
            q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        else:
            q = F.percentile_approx(x, [0.25, 0.5, 0.75], approx_accuracy or 10000).cast("array<double>")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), q.alias(f"q{i}"), F.max(x).alias(f"max{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"),
                                F.col(f"mean{i}").alias("mean"), F.col(f"std{i}").alias("std"),
                                F.col(f"min{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"),
                                F.col(f"q{i}")[1].alias("p50"), F.col(f"q{i}")[2].alias("p75"),
                                F.col(f"max{i}").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def table_info(df: DataFrame) -> DataFrame:
    """Column name, Spark type and non-NULL count for every column (one scan)."""
    row = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"),
                        F.col(f"_n{i}").alias("non_null"))
               for i, (c, t) in enumerate(df.dtypes)]
    return row.select(F.inline(F.array(*structs)))


def head_rows(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)


def location_spread(df: DataFrame, cols: Sequence[str], method: str = "map") -> DataFrame:
    """Median, smallest mode, std (n−1), min and max per column; NaN is missing.

    ``method="map"`` takes median and mode from value→count maps, right for
    ratings; ``"bounded"`` takes the median from ``exact_quantiles`` and the mode
    from ``exact_mode``, the same numbers in bounded memory on any column."""
    xs = [_number(df, c) for c in cols]
    if method == "bounded":
        from .quantiles import exact_quantiles
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), x.alias("v")) for c, x in zip(cols, xs)])))
        spread = long.groupBy("column").agg(F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
        modes = [(c, m[0] if m else None) for c, m in exact_mode(df, cols).items()]
        mode = df.sparkSession.createDataFrame(modes, "column string, mode double")
        med = exact_quantiles(long, "v", [0.5], ["column"], names=["median"]).select("column", "median")
        return mode.join(spread, "column", "left").join(med, "column", "left").select(
            "column", "median", "mode", "std", "min", "max")
    aggs, structs = [], []
    for i, (c, x) in enumerate(zip(cols, xs)):
        aggs += [F.median(x).alias(f"med{i}"), F.mode(x, True).alias(f"mode{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        structs.append(F.struct(F.lit(c).alias("column"), F.col(f"med{i}").alias("median"), F.col(f"mode{i}").alias("mode"),
                                F.col(f"std{i}").alias("std"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def group_means(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(
        *[F.avg(_number(df, c)).alias(f"mean_{c}") for c in cols], F.count(F.lit(1)).alias("count"))


def group_mean_top(df: DataFrame, group: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Means of ``cols`` and the row count for the ``k`` largest groups."""
    return top_k_sorted(group_means(df, group, cols), "count", group, k)


def group_mean_min_count(df: DataFrame, group: str, cols: Sequence[str], min_rows: int = 5, k: int = 15,
                         sort_by: str = "grade") -> DataFrame:
    """Means for groups with at least ``min_rows`` rows, best ``k`` by the mean of ``sort_by``."""
    g = group_means(df, group, cols).where(F.col("count") >= min_rows)
    return top_k_sorted(g, f"mean_{sort_by}", group, k)


def group_multi_agg(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """mean, count (neither NULL nor NaN) and std (n−1) of every column per group."""
    aggs = []
    for c in cols:
        x = _number(df, c)
        aggs += [F.avg(x).alias(f"{c}_mean"), F.count(x).alias(f"{c}_count"), F.stddev_samp(x).alias(f"{c}_std")]
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*aggs)


def mean_scores_by_grade(df: DataFrame, grade: str = "grade",
                         probs: Sequence[str] = ("NEUTRAL", "POSITIVE", "NEGATIVE")) -> DataFrame:
    """Mean class probability per grade over rows complete in grade and all probabilities."""
    return (df.dropna(subset=[grade, *probs]).groupBy(grade)
            .agg(*[F.avg(p).alias(f"mean_{p}") for p in probs]).orderBy(grade))


def grade_distribution(df: DataFrame, grade: str = "grade") -> DataFrame:
    """Count and % of all rows per grade, ascending."""
    counts, n_all = _counts_of_all(df, grade)
    return counts.withColumn("pct", _pct(F.col("count"), n_all)).orderBy(grade)


def satisfaction_levels(df: DataFrame, grade: str = "grade", high: float = 4, low: float = 2) -> DataFrame:
    """Rows and % of all rows with grade ≥ high, strictly between, ≤ low; NULL and NaN grades are in none."""
    g = _number(df, grade)
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 F.count_if(g >= high).alias("_h"),
                 F.count_if((g > low) & (g < high)).alias("_m"),
                 F.count_if(g <= low).alias("_l"))
    levels = F.array(F.struct(F.lit("high").alias("level"), F.col("_h").alias("count")),
                     F.struct(F.lit("medium").alias("level"), F.col("_m").alias("count")),
                     F.struct(F.lit("low").alias("level"), F.col("_l").alias("count")))
    return (row.select("_rows", F.inline(levels))
            .select("level", "count", _pct(F.col("count"), F.col("_rows")).alias("pct")))


def global_kpis(df: DataFrame, grade: str = "grade", cols: Sequence[str] = ("bank", "product", "city")) -> DataFrame:
    g = _number(df, grade)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in cols],
                  F.avg(g).alias("mean_grade"), F.median(g).alias("median_grade"))


def date_bounds(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("min_date"), F.max(ts).alias("max_date"))


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Count and % per class label, with its name."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    n_all = counts.agg(F.sum("count")).scalar()
    return (counts.withColumn("pct", _pct(F.col("count"), n_all))
            .withColumn("label_name", label_name(F.col(label))).orderBy(label))


def confidence_summary(df: DataFrame, conf: Column, hi: float = 0.8, lo: float = 0.75,
                       median_method: str = "map") -> DataFrame:
    """Total rows, rows at or above two confidence cuts (and their % of all
    rows), mean and median confidence."""
    x = df.select(conf.alias("_c"))
    c = F.col("_c")
    if median_method == "bucketed":
        from .quantiles import exact_quantiles
        med = exact_quantiles(x, "_c", [0.5]).select("q0").scalar()
    else:
        med = F.median(c)
    return (x.agg(F.count(F.lit(1)).alias("total_reviews"), F.count_if(c >= hi).alias("confidence_above_08"),
                  F.count_if(c >= lo).alias("confidence_above_075"), F.avg(c).alias("mean_confidence"),
                  med.alias("median_confidence"))
            .withColumn("percent_above_08", _pct(F.col("confidence_above_08"), F.col("total_reviews")))
            .withColumn("percent_above_075", _pct(F.col("confidence_above_075"), F.col("total_reviews"))))


def binned_distribution(df: DataFrame, value: Column, edges: Sequence[float] = CONFIDENCE_EDGES) -> DataFrame:
    """Count per right-closed bin and % of all rows; empty bins kept with 0.

    The bin table comes from the ``edges`` parameter (len(edges)−1 rows), so the
    join that restores empty bins is against a fixed, tiny side.
    """
    spark = df.sparkSession
    counts, n_all = _counts_of_all(df.select(assign_bin(value, edges).alias("bin")), "bin")
    bins = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)],
                                 "bin int, bin_lo double, bin_hi double")
    return (bins.join(counts, on="bin", how="left")
            .select("bin", "bin_lo", "bin_hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
            .withColumn("pct", _pct(F.col("count"), n_all)).orderBy("bin"))


def _stats(df: DataFrame, **aggs):
    """One scalar subquery returning a struct of statistics. Every use of a
    field refers to the same subquery, which Spark plans once and reuses."""
    st = df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_st")).scalar()
    return {k: st.getField(k) for k in aggs}


def _range_bounds(mn, mx):
    lo = F.when(mx == mn, mn - F.lit(0.5)).otherwise(mn)
    hi = F.when(mx == mn, mx + F.lit(0.5)).otherwise(mx)
    return lo, hi


def histogram_equal_width(df: DataFrame, col: str, bins: int = 20, median_method: str = "map") -> DataFrame:
    """``bins`` equal-width bins from min to max (last bin right-closed, a zero
    range widened by ±0.5), every bin listed, with the mean and median marks.

    Bin index = least(floor((x − lo) · (k / (hi − lo))), k − 1).
    """
    s = df.select(_number(df, col).alias("_x")).where(F.col("_x").isNotNull())
    if median_method == "bucketed":
        from .quantiles import exact_quantiles
        st = _stats(s, mn=F.min("_x"), mx=F.max("_x"), mean=F.avg("_x"))
        med = exact_quantiles(s, "_x", [0.5]).select("q0").scalar()
    else:
        st = _stats(s, mn=F.min("_x"), mx=F.max("_x"), mean=F.avg("_x"), med=F.median("_x"))
        med = st["med"]
    lo, hi = _range_bounds(st["mn"], st["mx"])
    mean = st["mean"]
    k = F.lit(bins)
    idx = F.least(F.floor((F.col("_x") - lo) * (k.cast("double") / (hi - lo))), k - 1).cast("int")
    counts = s.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (hi - lo) / k.cast("double")
    return (grid.join(counts, on="bin", how="left")
            .select("bin",
                    (F.col("bin").cast("double") * step + lo).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, hi)
                     .otherwise((F.col("bin") + 1).cast("double") * step + lo).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
                    mean.alias("mean_mark"), med.cast("double").alias("median_mark"))
            .orderBy("bin"))


# Kernel reach in bandwidths: exp(−½·z²) is exactly 0.0 in double for z > 38.6.
KDE_REACH = 39.0


def kde_curve(df: DataFrame, col: str, points: int = 200, bins: int = 5, method: str = "values") -> DataFrame:
    """Gaussian KDE on ``points`` grid points from min to max, scaled to the
    histogram's count axis (× n × bin width), Scott bandwidth std·n^(−1/5).

    ``method="values"`` adds up a term per distinct value and grid point, right
    for ratings and exact to the last digits of the far tails: a kernel term
    beyond ``KDE_REACH`` bandwidths is exactly 0.0 in double precision
    (e^(−½·39²) underflows), so each value only expands the points within that
    reach. ``"moments"`` is for continuous columns: the values of each box of one
    bandwidth go in as their moments (``operators.wide.gauss_sums``, error below
    1e-9 of the rows), and what is exchanged and met with the grid are boxes,
    however many distinct values there are. A column with zero variance has no curve.
    """
    s = df.select(_number(df, col).alias("_x")).where(F.col("_x").isNotNull())
    st = _stats(s, n=F.count(F.lit(1)), mn=F.min("_x"), mx=F.max("_x"), sd=F.stddev_samp("_x"))
    n, mn, mx, sd = st["n"], st["mn"], st["mx"], st["sd"]
    bw = sd * F.pow(n.cast("double"), F.lit(-0.2))
    width = (mx - mn) / F.lit(float(bins))
    step = (mx - mn) / F.lit(float(points - 1))
    grid_x = mn + F.col("point").cast("double") * (mx - mn) / F.lit(float(points - 1))
    if method == "moments":
        sums = gauss_sums(s, grid_x, bw, mn, step, points, KDE_REACH + 1)
    else:
        first = F.greatest(F.lit(0), F.ceil((F.col("_x") - F.lit(KDE_REACH) * bw - mn) / step).cast("int"))
        last = F.least(F.lit(points - 1), F.floor((F.col("_x") + F.lit(KDE_REACH) * bw - mn) / step).cast("int"))
        g = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))).alias("point")
        vc = s.groupBy("_x").agg(F.count(F.lit(1)).alias("_cnt"))
        sums = (vc.where(bw > 0).select("_x", "_cnt", g)
                .select("point", (F.col("_cnt") * F.exp(F.lit(-0.5) * F.pow((grid_x - F.col("_x")) / bw, 2))).alias("_k"))
                .groupBy("point").agg(F.sum("_k").alias("_s")))
    scale = width / (bw * F.lit((2 * 3.141592653589793) ** 0.5))
    # every grid point is reported: points out of every value's reach sum to 0.0
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).where(bw > 0)
    return (grid.join(sums, on="point", how="left")
            .select("point", grid_x.alias("x"), (F.coalesce(F.col("_s"), F.lit(0.0)) * scale).alias("density"))
            .orderBy("point"))


def box_stats(df: DataFrame, group: str, value: str, whis: float = 1.5,
              approx_accuracy: int | None = None, method: str | None = None) -> DataFrame:
    """Per group: quartiles (linear interpolation), whiskers = most extreme data
    within ``whis``·IQR of the box (never inside it), and the outlier count.

    Quartiles are one grouped aggregate; joining them back (one row per group,
    measured and broadcast when small) lets a second aggregate find whiskers
    and outliers, so no group is ever gathered into a single task.
    """
    base = df.select(F.col(group).alias("_g"), _number(df, value).alias("_v")) \
             .where(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    method = method or ("approx" if approx_accuracy is not None else "map")
    if method == "bucketed":
        from .quantiles import exact_quantiles
        quart = exact_quantiles(base, "_v", [0.25, 0.5, 0.75], ["_g"], names=["q1", "median", "q3"])
    else:
        if method == "map":
            q = F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        else:
            q = F.percentile_approx("_v", [0.25, 0.5, 0.75], approx_accuracy or 10000).cast("array<double>")
        quart = base.groupBy("_g").agg(q.alias("_q"), F.count(F.lit(1)).alias("n")).select(
            "_g", "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    lo_lim = F.col("q1") - F.lit(whis) * iqr
    hi_lim = F.col("q3") + F.lit(whis) * iqr
    v = F.col("_v")
    j = join_small(base, quart, on="_g")
    out = j.groupBy("_g", "n", "q1", "median", "q3").agg(
        F.least(F.col("q1"), F.min(F.when(v >= lo_lim, v))).alias("whisker_low"),
        F.greatest(F.col("q3"), F.max(F.when(v <= hi_lim, v))).alias("whisker_high"),
        F.count_if((v < lo_lim) | (v > hi_lim)).alias("outliers"))
    return out.withColumnRenamed("_g", group).orderBy(group)


def _pair_corr(a: Column, b: Column) -> Column:
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_samp(a2, b2), F.stddev_samp(a2) * F.stddev_samp(b2))


# Columns up to which correlations are expressions of one aggregate.
WIDE = 16


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for every ordered column pair, pairwise-complete; NULL where
    undefined (constant column, fewer than two pairs); NaN is missing. One
    aggregate computes each unordered pair once; more than ``WIDE`` columns go
    through one Gram matrix per task instead (``operators.wide``)."""
    cols = list(cols)
    if len(cols) > WIDE:
        return gram_corr(df, cols)
    xs = {c: _number(df, c) for c in cols}
    aggs, names = [], {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            name = f"_r{i}_{j}"
            if i == j:
                aggs.append(F.try_divide(F.var_samp(xs[a]), F.var_samp(xs[a])).alias(name))
            else:
                aggs.append(_pair_corr(xs[a], xs[b]).alias(name))
            names[(a, b)] = names[(b, a)] = name
    structs = [F.struct(F.lit(a).alias("col1"), F.lit(b).alias("col2"), F.col(names[(a, b)]).alias("r"))
               for a in cols for b in cols]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Pairs i < j (in the given column order) with |r| above the threshold."""
    order = {c: i for i, c in enumerate(cols)}
    m = corr_matrix(df, cols)
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    return m.where((pos[F.col("col1")] < pos[F.col("col2")]) & (F.abs(F.col("r")) > threshold))
