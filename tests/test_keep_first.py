"""The earliest row per key of a stream: out of order, ties, forgetting, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.streaming.keep_first import stream_keep_first

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("v", T.LongType())])
DAY = dt.datetime(2024, 1, 1)


def files(spark, path, rows, per_file):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def shuffled_rows(n, keys, lateness, seed=1):
    """Rows that come at most ``lateness`` minutes out of order."""
    rng = random.Random(seed)
    rows = [(rng.choice(keys), DAY + dt.timedelta(minutes=i), i) for i in range(n)]
    return sorted(rows, key=lambda r: r[2] + rng.uniform(0, lateness))


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_out_of_order_replay_equals_min_by(spark, tmp_path):
    rows = shuffled_rows(300, [*"abcdefgh", None], 60)
    src = files(spark, f"{tmp_path}/src", rows, 60)
    got = stream_keep_first(spark, src, SCHEMA, ["k"], "ts", "2 days", max_bytes=1)
    want = spark.createDataFrame(rows, SCHEMA).groupBy("k").agg(F.min_by(F.struct("ts", "v"), "ts").alias("r")).select("k", "r.*")
    key = lambda r: str(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_state_is_forgotten(spark, tmp_path):
    # a new key every ten minutes, held for an hour of event time
    rows = [(f"k{i}", DAY + dt.timedelta(minutes=10 * i), i) for i in range(400)]
    src = files(spark, f"{tmp_path}/src", rows, 50)
    got = stream_keep_first(spark, src, SCHEMA, ["k"], "ts", "1 hour", finish=False, max_bytes=1)
    held = got.last_progress["stateOperators"][0]["numRowsTotal"]
    assert held <= 4 * 64                                   # values and timers of a batch and an hour, not of 400 keys
    assert 400 - 64 <= got.count() <= 400


def test_ties_rows_without_time_and_restart(spark, tmp_path):
    src, sink, ckpt = (f"{tmp_path}/{n}" for n in ("src", "sink", "ckpt"))
    files(spark, src, [("a", DAY, 5), ("a", DAY, 3), ("b", None, 1), ("c", DAY + dt.timedelta(hours=1), 2)], 4)
    first = stream_keep_first(spark, src, SCHEMA, ["k"], "ts", "1 day", finish=False, sink=sink, checkpoint=ckpt)
    assert first.count() == 0                               # nothing is certain yet
    files(spark, src, [("c", DAY, 9)], 1)                   # earlier than what is held
    got = stream_keep_first(spark, src, SCHEMA, ["k"], "ts", "1 day", sink=sink, checkpoint=ckpt)
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 3), ("c", 9)]


def test_a_key_that_returns_later_is_new(spark, tmp_path):
    rows = [("a", DAY, 1), ("x", DAY + dt.timedelta(days=3), 2), ("y", DAY + dt.timedelta(days=6), 3),
            ("a", DAY + dt.timedelta(days=7), 4)]
    src = files(spark, f"{tmp_path}/src", rows, 1)
    got = stream_keep_first(spark, src, SCHEMA, ["k"], "ts", "1 day", max_bytes=1)
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("a", 4), ("x", 2), ("y", 3)]
