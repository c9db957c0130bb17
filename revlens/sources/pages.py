"""Page id ranges and ingest summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BASE_URL = "https://reviews.example/response/"


def page_url_range(spark: SparkSession, start: int, end: int, base_url: str = DEFAULT_BASE_URL,
                   num_partitions: int | None = None) -> DataFrame:
    """One URL per id in ``[start, end]`` (inclusive); ``start > end`` is an error.

    ``spark.range`` generates the ids inside the tasks, so nothing is built on
    the driver however long the range is.
    """
    if start > end:
        raise ValueError("start must not be greater than end")
    return spark.range(start, end + 1, 1, num_partitions).select(
        F.col("id").alias("page_id"), F.concat(F.lit(base_url), F.col("id").cast("string")).alias("url"))


def page_batches(spark: SparkSession, start: int, end: int, size: int = 10) -> DataFrame:
    """Consecutive batches of ``size`` ids covering ``[start, end]``; the last
    batch is clipped at ``end``; ``is_first`` marks the batch that writes a header."""
    if start > end:
        raise ValueError("start must not be greater than end")
    n = (end - start) // size + 1
    b = F.col("id")
    return spark.range(0, n).select(
        b.alias("batch_id"),
        (F.lit(start) + b * size).alias("batch_start"),
        F.least(F.lit(start) + b * size + (size - 1), F.lit(end)).alias("batch_end"),
        (b == 0).alias("is_first"))


def ingest_summary(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages processed and distinct URLs among them."""
    return pages.agg(F.count(F.lit(1)).alias("pages_total"), F.count_distinct(F.col(url)).alias("unique_urls"))
