"""Parquet tables and the stand-in review table derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import review_date_text
from ..functions.labels import softmax_probs
from ..operators.shape import BROADCAST_BUDGET_BYTES, key_hashes

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a stored table (a parquet count reads file metadata only);
    used to bound broadcast sizes, so it is taken anew for every plan."""
    return load_table(spark, sf_dir, name).count()


# Bytes per row of the (key, city) lookup: a long and a short string.
_CITY_ROW_BYTES = 8 + 48


# Columns with the ``key_hashes`` of a review's text.
TEXT_HASHES = ("review_digest", "review_hash")


def reviews_standin(spark: SparkSession, sf_dir: str, scores: bool = True, text_hashes: bool = False) -> DataFrame:
    """One review per document, with ratings, city and class scores drawn from
    the other tables (FIXTURES §3).

    documents ⋈ events on id (inner), then left joins to embeddings and to the
    city of the event's customer. The wide side (the document text) is
    exchanged at most once, on ``doc_id``: every join of the main plan is on
    that one id, and the city is looked up on a narrow (event id, city) table
    (events ⋈ customer ⋈ nation, where AQE splits a hot user) that is joined
    back on the id, so the text never moves to a ``user_id`` partitioning. When
    the customers' row count (file metadata) bounds the customer → city table
    within the broadcast budget, that table is broadcast onto the rows instead
    and nothing is exchanged for the city.
    ``scores=False`` leaves out the class scores, and with them the scan and
    join of the embeddings (a left join is not pruned with its columns); of an
    embedding only the three values in use are exchanged.
    ``text_hashes=True`` adds ``TEXT_HASHES``, taken before the joins: rows are
    told apart by them where the text itself is not wanted.
    Catalyst prunes every column not used downstream; nation's 25 rows are
    fixed by the TPC-H specification and always broadcast.
    """
    d = load_table(spark, sf_dir, "documents")
    if text_hashes:
        d = d.withColumns(dict(zip(TEXT_HASHES, key_hashes(F.col("text")))))
    d = d.alias("d")
    e = load_table(spark, sf_dir, "events")
    v = load_table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(3)]).alias("v")
    c = load_table(spark, sf_dir, "customer")
    n = load_table(spark, sf_dir, "nation")

    # one row per customer (grouping states it, so Catalyst drops the lookup
    # from plans that never read the city)
    cust_city = (c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey"), "left")
                 .groupBy("c_custkey").agg(F.max("n_name").alias("n_name")))
    j = d.join(e.alias("e"), F.col("e.event_id") == F.col("d.doc_id"), "inner")
    if scores:
        j = j.join(v, F.col("v.vec_id") == F.col("d.doc_id"), "left")
    if table_rows(spark, sf_dir, "customer") * _CITY_ROW_BYTES <= BROADCAST_BUDGET_BYTES:
        # the customers' row count bounds the lookup within the budget: broadcast
        # it onto the rows by user id, and nothing is exchanged for the city
        j = j.join(F.broadcast(cust_city).alias("k"), F.col("k.c_custkey") == F.col("e.user_id"), "left")
    else:
        # narrow (event id, city) table, joined back on the id the rows are
        # already partitioned by; one row per event, so it is removable as well
        city = (e.select(F.col("event_id").alias("city_event_id"), "user_id")
                .join(cust_city, F.col("c_custkey") == F.col("user_id"), "left")
                .groupBy("city_event_id").agg(F.max("n_name").alias("n_name")).alias("k"))
        j = j.join(city, F.col("k.city_event_id") == F.col("d.doc_id"), "left")

    probs = []
    if scores:
        neg, neu, pos = softmax_probs([F.lit(10.0) * F.col(f"v.e{i}").cast("double") for i in range(3)])
        probs = [neg.alias("NEGATIVE"), neu.alias("NEUTRAL"), pos.alias("POSITIVE")]
    value = F.col("e.value")
    return j.select(
        F.col("d.doc_id").alias("review_id"),
        F.col("d.source").alias("bank"),
        F.col("d.lang").alias("product"),
        F.col("k.n_name").alias("city"),
        F.col("d.text").alias("review"),
        review_date_text(F.col("e.ts")).alias("date"),
        F.when(F.col("e.event_type") == "error", F.lit("error")).otherwise(F.lit("good")).alias("status"),
        F.least(F.lit(5), F.floor(value / 25)).cast("int").alias("grade"),
        (F.lit(1) + F.col("d.n_chars") % 5).cast("int").alias("clear_conditions"),
        (F.lit(1) + F.col("e.user_id") % 5).cast("int").alias("polite_employee"),
        (F.lit(1) + F.floor(value) % 5).cast("int").alias("availability"),
        F.when(F.col("e.event_id") % 7 == 0, F.lit(None).cast("int"))
         .otherwise(F.least(F.lit(5), F.lit(1) + F.floor(value / 25)).cast("int")).alias("convenience"),
        *probs, *([F.col(f"d.{c}") for c in TEXT_HASHES] if text_hashes else []),
    )
