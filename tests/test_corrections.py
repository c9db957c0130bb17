"""Cases that once gave a wrong result: wall-clock texts, NaN, whiskers, long digits, broadcasts, checkpoint folders."""

import datetime as dt
import re
import types

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from revlens import session
from revlens.functions import grade_to_label, parse_digits, parse_review_date
from revlens.functions.dates import format_datetime_local, review_date_text, weekday_name
from revlens.operators import profile as PR
from revlens.operators import shape as SH
from revlens.plans import q_stats


def test_texts_of_times_that_a_zone_skips(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        t = dt.datetime(2024, 3, 10, 2, 30)       # does not exist there
        r = spark.createDataFrame([(t,)], "t timestamp_ntz").select(
            review_date_text("t").alias("d"), format_datetime_local("t").alias("f"), weekday_name("t").alias("w"),
            parse_review_date(review_date_text("t")).alias("p")).first()
        assert (r.d, r.f, r.w, r.p) == ("10.03.2024 02:30", "2024-03-10T02:30", "Sunday", t)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("method", ["map", "bucketed"])
def test_nan_is_missing_in_every_statistic(spark, method):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 3.0), ("g", float("nan")), ("g", None)], "g string, x double")
    r = PR.describe_numeric(df, ["x"], method=method).first()
    assert (r["count"], r["mean"], r["p25"], r["p50"], r["p75"], r["max"]) == (3, 2.0, 1.5, 2.0, 2.5, 3.0)
    b = PR.box_stats(df, "g", "x", method=method).first()
    assert (b.n, b.q1, b.median, b.q3) == (3, 1.5, 2.0, 2.5)


def test_whiskers_never_end_inside_the_box(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 1.0, 1.0, 10.0)], "g string, x double")
    b = PR.box_stats(df, "g", "x").first()
    assert (b.q3, b.whisker_low, b.whisker_high) == (3.25, 1.0, 3.25)


def test_digits_beyond_32_and_64_bits(spark):
    rows = [("99999999999",), ("9" * 30,), ("3",), ("-7",), ("4.0",), ("x",), (None,)]
    r = spark.createDataFrame(rows, "t string").select(grade_to_label(F.col("t")).alias("l"), parse_digits(F.col("t")).alias("d"))
    assert [tuple(x) for x in r.collect()] == [(2, 99999999999), (2, None), (1, 3), (2, None), (1, None), (1, None), (1, None)]


def test_broadcast_is_measured_in_bytes(spark):
    big = spark.range(20).withColumn("k", (F.col("id") % 4).cast("string"))
    wide = big.groupBy("k").agg(F.repeat(F.lit("x"), 5000).alias("text"))
    for budget, hashed in ((1 << 20, True), (1 << 10, False)):
        j = SH.join_small(big, wide, on="k", budget_bytes=budget)
        assert j.count() == 20
        hinted = "broadcast" in j._jdf.queryExecution().logical().toString().lower()
        assert hinted == hashed


def test_no_private_folder_off_local_masters():
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                               getConf=lambda: types.SimpleNamespace(get=lambda k, d=None: d))
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(fake)


def test_dedup_neither_sorts_nor_shuffles_by_text(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    plan = SH.dedup_keep_first(docs, "text", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "hashpartitioning(text" not in plan
    rows = [(3, "a"), (1, "a"), (2, None), (5, None), (4, "b")]
    kept = SH.dedup_keep_first(spark.createDataFrame(rows, "i int, t string"), "t", "i").collect()
    assert sorted(r.i for r in kept) == [1, 2, 4]


def test_time_series_read_no_embedding(spark):
    for key in (q_stats.q_monthly_counts, q_stats.q_hour_counts, q_stats.q_counts_over_time):
        assert "embedding" not in key(spark, SF001)._jdf.queryExecution().executedPlan().toString()


def test_shares_take_one_pass_and_count_null_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "grade int")
    got = {r.grade: (r["count"], r.pct) for r in PR.grade_distribution(df).collect()}
    assert got == {1: (2, 50.0), 2: (1, 25.0)}


def test_positions_follow_the_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, n int")
    shown = SH.number_shown(SH.reverse_order(df, "n", "k")).collect()
    assert [(r.k, r.position) for r in shown] == [("c", 1), ("a", 2), ("b", 3)]


def test_no_text_crosses_an_exchange_of_the_flagship(spark):
    from revlens.plans.q_ml import flagship
    qe = flagship(spark, SF001)._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(qe, "formatted")
    sent = [b for b in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", b)]
    assert sent and not [b for b in sent if re.search(r"\b(text|review|embedding)#", b)]
