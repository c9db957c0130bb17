"""Rows that share an id, have none, or are equal in all columns: every operator counts them as rows of their own."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from revlens.operators import classifier as CL
from revlens.operators.shape import dedup_keep_first, number_shown


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_one_row_per_text_on_any_ids(spark):
    rows = [("only one", None), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("twice", None), ("twice", None), ("mixed", None),
            ("mixed", 9), ("equal", 5), ("equal", 5), (None, 3), (None, 4), ("", 7), ("-", 8)]
    df = spark.createDataFrame(rows, "text string, id long").repartition(4)
    assert rows_of(dedup_keep_first(df, "text", "id")) == Counter(
        [("only one", None), ("a", 1), ("b", 0), ("twice", None), ("mixed", 9), ("equal", 5), (None, 3), ("", 7), ("-", 8)])


def test_rows_that_share_the_smallest_id(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 1, "y")], "text string, id long, other string")
    got = dedup_keep_first(df, "text", "id").collect()
    assert len(got) == 1
    assert got == dedup_keep_first(df.repartition(3), "text", "id").collect()
    maps = df.withColumn("m", F.create_map(F.lit("k"), "other"))
    assert dedup_keep_first(maps, "text", "id").count() == 1
    assert dedup_keep_first(df.limit(0), "text", "id").count() == 0


@pytest.mark.parametrize("border", [100_000, 3])
def test_split_keeps_every_row(spark, monkeypatch, border):
    monkeypatch.setattr(CL, "BORDER_ROWS", border)
    rows = [(k, k % 2, j) for k in range(40) for j in range(100)]
    df = spark.createDataFrame(rows, "id long, label int, other int").repartition(5)
    got = CL.stratified_split(df, "label", "id")
    assert got.count() == 4000 and rows_of(got.drop("is_validation")) == Counter(rows)
    assert {r.label: r["count"] for r in got.where("is_validation").groupBy("label").count().collect()} == {0: 400, 1: 400}
    again = CL.stratified_split(df.repartition(2), "label", "id")
    assert rows_of(got) == rows_of(again)


@pytest.mark.parametrize("border", [100_000, 2])
def test_split_of_odd_rows(spark, monkeypatch, border):
    monkeypatch.setattr(CL, "BORDER_ROWS", border)
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([0, 1, 1, None]), rng.choice("ab")) for _ in range(500)]
    got = CL.stratified_split(spark.createDataFrame(rows, "id long, label int, t string"), "label", "id")
    assert rows_of(got.drop("is_validation")) == Counter(rows)
    for label in (0, 1):
        n = sum(r[1] == label for r in rows)
        assert got.where((F.col("label") == label) & F.col("is_validation")).count() == -(-n // 5)
    assert got.where("label is null and is_validation").count() == 0
    assert CL.stratified_split(got.select("id", "label").limit(0), "label", "id").count() == 0


def test_places_follow_the_order_shown(spark):
    df = spark.range(3000).repartition(9).orderBy(F.desc("id"))
    got = {r.id: r.position for r in number_shown(df).collect()}
    assert got == {i: 3000 - i for i in range(3000)}
