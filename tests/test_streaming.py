"""Streams over stored tables and staged ones: results equal the batch answer, whatever the batch size."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from revlens.plans.q_io import _EVENTS
from revlens.session import clear_scratch, is_folder, scratch_path
from revlens.sources.tables import load_table
from revlens.streaming import stage_files, stream_counts, stream_dedup


def test_stage_files_splits_by_rows(spark):
    ev = load_table(spark, SF001, "events")
    n = ev.count()
    src = stage_files(ev, scratch_path(spark, "t-stage"), -(-n // 4))
    assert len(spark.read.parquet(src).inputFiles()) >= 4 and spark.read.parquet(src).count() == n


@pytest.mark.parametrize("staged", [False, True])
def test_stream_counts_and_dedup_equal_batch(spark, staged):
    ev = load_table(spark, SF001, "events")
    src, size = f"{SF001}/events.parquet", 1 << 30
    if staged:                                 # several files, one to a batch
        src, size = stage_files(ev, scratch_path(spark, "t-stream"), -(-ev.count() // 4)), 1
    assert is_folder(spark, src) == staged
    got = {(r.window_start, r["count"]) for r in stream_counts(spark, src, _EVENTS, "ts", "1 day", max_bytes=size).collect()}
    want = {(r.d, r.n) for r in ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"))
            .agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(ts.replace(tzinfo=None), n) for ts, n in got} == want
    d = stream_dedup(spark, src, _EVENTS, ["user_id", "event_type"], "ts", max_bytes=size)
    assert d.count() == ev.select("user_id", "event_type").distinct().count()


def test_exact_dedup_of_events_wider_apart_than_any_delay(spark):
    rows = spark.range(150).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id * 20 as int))").alias("ts"),
        (F.col("id") % 75).alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    src = stage_files(rows.coalesce(1), scratch_path(spark, "t-wide"), 40)
    keys = ["user_id", "event_type"]
    assert stream_dedup(spark, src, _EVENTS, keys, "ts", max_bytes=1).count() == 75
    assert stream_dedup(spark, src, _EVENTS, keys, "ts", "31 days", max_bytes=1).count() > 75


def test_scratch_can_be_cleared(spark):
    path = stage_files(spark.range(3).toDF("id"), scratch_path(spark, "t-clear"), 10)
    assert path.split("/")[-2] == spark.sparkContext.applicationId and is_folder(spark, path)
    assert clear_scratch(spark) and not clear_scratch(spark)
