"""Time series over a parsed ``timestamp_ntz`` column (§2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import DAY_NAMES, trunc_day, trunc_hour, trunc_month, weekday_name
from .shape import left_join_domain



def monthly_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per calendar month; NULL times excluded, empty months not filled."""
    return (df.where(F.col(ts).isNotNull()).groupBy(trunc_month(F.col(ts)).alias("month"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("month"))


def monthly_mean(df: DataFrame, ts: str, value: str) -> DataFrame:
    return (df.where(F.col(ts).isNotNull()).groupBy(trunc_month(F.col(ts)).alias("month"))
            .agg(F.avg(value).alias(f"mean_{value}")).orderBy("month"))


def weekday_counts(df: DataFrame, ts: str) -> DataFrame:
    """Rows per weekday, Monday..Sunday; a weekday without rows has NULL count."""
    counts = (df.where(F.col(ts).isNotNull()).groupBy(weekday_name(F.col(ts)).alias("day_name"))
              .agg(F.count(F.lit(1)).alias("count")))
    return left_join_domain(counts, "day_name", DAY_NAMES, order_col="day_index")


def hour_counts(df: DataFrame, ts: str) -> DataFrame:
    return (df.where(F.col(ts).isNotNull()).groupBy(F.hour(F.col(ts)).alias("hour"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("hour"))


def counts_over_time(df: DataFrame, ts: str, max_hourly_days: int = 7) -> DataFrame:
    """Hourly counts when the whole-day span (max − min) is at most
    ``max_hourly_days`` days, daily counts otherwise."""
    s = df.select(F.col(ts).alias("_t")).where(F.col("_t").isNotNull())
    st = s.agg(F.struct(F.min("_t").alias("mn"), F.max("_t").alias("mx")).alias("_st")).scalar()
    mn, mx = st.getField("mn"), st.getField("mx")
    span = F.floor(F.timestamp_diff("SECOND", mn, mx) / F.lit(86400))
    hourly = span <= max_hourly_days
    period = F.when(hourly, trunc_hour(F.col("_t"))).otherwise(trunc_day(F.col("_t")))
    return (s.groupBy(period.alias("period"), F.when(hourly, F.lit("hour")).otherwise(F.lit("day"))
                      .alias("granularity"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("period"))
