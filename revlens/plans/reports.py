"""Report-level entry points: the dashboard's outputs, the hypothesis check and
the confidence report, each over a review table with the canonical columns.

A report computes several results from one filtered table, so that table is
materialised once (``checkpoint`` to the shared checkpoint folder) and every
output reads it instead of re-running the filters and joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import max_confidence, parse_review_date
from ..operators import filters as FL
from ..operators import profile as PR
from ..operators import shape as SH
from ..operators import stats as ST
from ..operators import timeseries as TS
from ..schemas import SUB_RATING_COLS
from ..session import checkpoint_root
from ..functions.text import strip_ws

ALL = FL.ALL


def dashboard(df: DataFrame, bank: str = ALL, product: str = ALL, city: str = ALL, sentiment: str = ALL,
              start: str | None = None, end: str | None = None, top_n: int = 15) -> dict[str, DataFrame]:
    """The six dashboard results plus the table view, for one filter setting.

    ``df`` needs bank, product, city, review, grade, sentiment, the three class
    probabilities, the four sub-ratings and ``date`` (text) or ``ts``.
    """
    if "ts" not in df.columns:
        df = df.withColumn("ts", parse_review_date(F.col("date")))
    f = FL.filter_optional(df, {"bank": bank, "product": product, "city": city, "sentiment": sentiment})
    f = FL.filter_datetime_range(f, "ts", start, end)
    checkpoint_root(df.sparkSession)
    f = f.checkpoint()
    probs = [c for c in ("NEUTRAL", "POSITIVE", "NEGATIVE") if c in f.columns]
    return {
        "reviews_table": FL.project_columns(f, ["bank", "product", "city", "review", "grade", "sentiment"]),
        "reviews_by_bank": PR.top_k_other(f, "bank", top_n),      # Other first, then k..1: the chart's order
        "grade_histogram": PR.histogram_equal_width(f, "grade", 5),
        "grade_kde": PR.kde_curve(f, "grade", 200, 5),
        "reviews_over_time": TS.counts_over_time(f, "ts"),
        "sentiment_grade_relation": PR.mean_scores_by_grade(f, "grade", probs),
        "sentiment_pie": PR.value_counts_pct(f, "sentiment"),
        "ratings_box": PR.box_stats(SH.melt(f, [c for c in SUB_RATING_COLS if c in f.columns]), "variable", "value"),
    }


HYPOTHESES = ("bank_vs_sentiment", "negative_share_first_gt_second", "product_vs_sentiment")


def hypothesis_report(df: DataFrame, banks: list[str], products_pair: tuple[str, str], products: list[str],
                      bank: str = "bank", product: str = "product", sentiment: str = "sentiment",
                      labels: tuple[str, str, str] = HYPOTHESES) -> DataFrame:
    """The three checks: bank × sentiment (χ²), negative share of one product
    above another (z), product × sentiment (χ²) — one row per hypothesis."""
    FL.require_columns(df, [bank, product, sentiment])
    base = FL.drop_missing(df, [bank, product, sentiment]).withColumn(
        sentiment, strip_ws(F.upper(F.col(sentiment))))
    # one pass: counts per (bank, product, sentiment), a partial aggregate whose
    # size is bounded by the label domains; all three tests read it, weighted
    base = (base.where(F.col(sentiment).isin("NEGATIVE", "NEUTRAL", "POSITIVE"))
            .groupBy(bank, product, sentiment).agg(F.count(F.lit(1)).alias("_w")))
    checkpoint_root(df.sparkSession)
    base = base.checkpoint()
    cols = ["hypothesis", "test", "statistic", "p_value", "reject_h0", "expected_low"]
    h1 = ST.chi_square(base.where(F.col(bank).isin(banks)), bank, sentiment, weight="_w").select(
        F.lit(labels[0]).alias("hypothesis"), F.lit("chi_square").alias("test"), "statistic", "p_value",
        "reject_h0", "expected_low")
    a, b = products_pair
    h2 = ST.two_proportion_z(base, product, a, b, sentiment, "NEGATIVE", weight="_w").select(
        F.lit(labels[1]).alias("hypothesis"), F.lit("two_proportion_z").alias("test"),
        F.col("z").alias("statistic"), "p_value", "reject_h0", F.lit(None).cast("boolean").alias("expected_low"))
    h3 = ST.chi_square(base.where(F.col(product).isin(products)), product, sentiment, weight="_w").select(
        F.lit(labels[2]).alias("hypothesis"), F.lit("chi_square").alias("test"), "statistic",
        "p_value", "reject_h0", "expected_low")
    return h1.unionByName(h2).unionByName(h3).select(*cols)


def hypothesis_tables(df: DataFrame, banks: list[str], products: list[str], bank: str = "bank",
                      product: str = "product", sentiment: str = "sentiment", alpha: float = ST.ALPHA) -> dict[str, DataFrame]:
    """What stands behind the two chi-square checks, per check: the cells with
    observed and expected counts, and the residuals of the cells, which are
    empty unless the test rejects at ``alpha``. A check without any row gives
    empty tables. One pass over ``df``; both checks read its counts."""
    FL.require_columns(df, [bank, product, sentiment])
    base = FL.drop_missing(df, [bank, product, sentiment]).withColumn(sentiment, strip_ws(F.upper(F.col(sentiment))))
    base = (base.where(F.col(sentiment).isin("NEGATIVE", "NEUTRAL", "POSITIVE"))
            .groupBy(bank, product, sentiment).agg(F.count(F.lit(1)).alias("_w")))
    checkpoint_root(df.sparkSession)
    base = base.checkpoint()
    out = {}
    for name, key, values in ((HYPOTHESES[0], bank, banks), (HYPOTHESES[2], product, products)):
        part = base.where(F.col(key).isin(values))
        p = ST.chi_square(part, key, sentiment, weight="_w", alpha=alpha).select("p_value").scalar()
        out[f"{name}_cells"] = ST.contingency_cells(part, key, sentiment, weight="_w")
        out[f"{name}_residuals"] = ST.pearson_residuals(part, key, sentiment, weight="_w").where(p < alpha)
    return out


def confidence_report(df: DataFrame, median_method: str = "bucketed") -> dict[str, DataFrame]:
    """Summary, binned distribution and 20-bin histogram of the top class probability."""
    x = df.select(max_confidence().alias("max_confidence"))
    checkpoint_root(df.sparkSession)
    x = x.checkpoint()
    return {
        "summary": PR.confidence_summary(x, F.col("max_confidence"), median_method=median_method),
        "bins": PR.binned_distribution(x, F.col("max_confidence")),
        "histogram": PR.histogram_equal_width(x, "max_confidence", 20, median_method=median_method),
    }


def multi_value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts of several categorical columns in one job: each row is
    expanded to (column, value) pairs and counted by one grouped aggregate
    (partial aggregation first), instead of one scan per column."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                                         for c in cols])))
    return (pairs.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column", F.col("count").desc(), "value"))


def eda_report(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
               group: str = "bank", ts: str = "ts", top: int = 10) -> dict[str, DataFrame]:
    """The exploratory report over one materialised projection: profile,
    missing values, category counts (fused), location and spread,
    correlations, group means, time series and headline figures."""
    from ..schemas import RATING_COLS
    numeric = numeric or [c for c in RATING_COLS if c in df.columns]
    categorical = categorical or [c for c in ("bank", "product", "status", "city") if c in df.columns]
    if ts not in df.columns and "date" in df.columns:
        df = df.withColumn(ts, parse_review_date(F.col("date")))
    keep = list(dict.fromkeys([*categorical, *numeric, group, ts, "review"]))
    checkpoint_root(df.sparkSession)
    x = df.select(*[c for c in keep if c in df.columns]).checkpoint()
    return {
        "first_rows": PR.head_rows(x, ts),
        "table_info": PR.table_info(x),
        "describe": PR.describe_numeric(x, numeric),
        "missing": PR.missing_profile(x),
        "category_counts": multi_value_counts(x, categorical),
        "location_spread": PR.location_spread(x, numeric),
        "corr": PR.corr_matrix(x, numeric),
        "high_corr_pairs": PR.high_corr_pairs(x, numeric, 0.5),
        "top_group_means": PR.group_mean_top(x, group, numeric, top),
        "qualified_group_means": PR.group_mean_min_count(x, group, numeric, 5, 15),
        "product_stats": PR.group_multi_agg(x, "product", numeric) if "product" in x.columns else None,
        "top5_box": PR.box_stats(SH.semi_join_top(x, group, 5), group, numeric[0]),
        "monthly_counts": TS.monthly_counts(x, ts),
        "monthly_mean": TS.monthly_mean(x, ts, numeric[0]),
        "weekday_counts": TS.weekday_counts(x, ts),
        "hour_counts": TS.hour_counts(x, ts),
        "kpis": PR.global_kpis(x, numeric[0], [c for c in ("bank", "product", "city") if c in x.columns]),
        "grade_distribution": PR.grade_distribution(x, numeric[0]),
        "satisfaction": PR.satisfaction_levels(x, numeric[0]),
        "top_products": PR.top_k_coverage(x, "product", 8) if "product" in x.columns else None,
    }
