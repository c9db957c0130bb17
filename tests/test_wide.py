"""Correlations of many columns, modes by candidates, kernel sums by moments: against NumPy and the plain operators."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import profile as P
from revlens.operators import wide as W

NAN = float("nan")


def matrix(df, fn, cols):
    return {(r.col1, r.col2): r.r for r in fn(df, cols).collect()}


def close(a, b, digits=1e-9):
    return a is b is None or a is not None and b is not None and abs(a - b) < digits


# ------------------------------------------------------------------ correlation

def test_three_hundred_columns(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 20))
    x = np.concatenate([base @ rng.normal(size=(20, 150)), rng.normal(size=(400, 150)) * 1e-3 + 1e6], axis=1)
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names).repartition(7)
    got = matrix(df, W.gram_corr, names)
    want = np.corrcoef(x, rowvar=False)
    assert len(got) == 300 * 300
    assert max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(300) for j in range(300)) < 1e-6


def test_wide_equals_the_present_operator_on_five(spark):
    rng = random.Random(1)
    cell = lambda s: rng.choice([None, NAN]) if rng.random() < 0.1 else rng.gauss(s, s)
    rows = [tuple(cell(10.0 ** k) for k in range(4)) + (5.0,) for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(4)
    one, two = matrix(df, P.corr_matrix, list("abcde")), matrix(df, W.gram_corr, list("abcde"))
    assert one.keys() == two.keys() and all(close(one[k], two[k]) for k in one)
    assert one["e", "e"] is None and one["a", "a"] == pytest.approx(1)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (NAN, 1.0), (4.0, 7.0)], "a double, b double")
    want = float(np.corrcoef([1, 2, 4], [2, 4.5, 7])[0, 1])
    for fn in (P.corr_matrix, W.gram_corr):
        got = matrix(df, fn, ["a", "b"])
        assert got["a", "a"] == pytest.approx(1) and got["a", "b"] == pytest.approx(want)
    assert matrix(df, P.high_corr_pairs, ["a", "b"]).keys() == {("a", "b")}
    levels = {r.level: r["count"] for r in P.satisfaction_levels(df.withColumnRenamed("a", "grade")).collect()}
    assert levels == {"high": 1, "medium": 0, "low": 2}
    r = P.group_multi_agg(df.withColumn("g", F.lit("x")), "g", ["a"]).first()
    assert (r.a_count, r.a_mean) == (3, pytest.approx(7 / 3))
    s = P.location_spread(df, ["a"]).first()
    assert (s["median"], s["mode"], s["max"]) == (2.0, 1.0, 4.0)
    assert P.global_kpis(df.withColumnRenamed("a", "grade"), cols=()).first()["mean_grade"] == pytest.approx(7 / 3)


def test_correlation_of_little(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert set(matrix(empty, W.gram_corr, ["a", "b"]).values()) <= {None}
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert set(matrix(one, W.gram_corr, ["a", "b"]).values()) == {None}
    apart = spark.createDataFrame([(1.0, None), (2.0, None), (None, 1.0), (3.0, 1.0), (4.0, 1.0)], "a double, b double")
    got = matrix(apart, W.gram_corr, ["a", "b"])
    assert got["a", "b"] is None and got["a", "a"] == 1.0    # b does not vary where both are present
    odd = spark.createDataFrame([(1, 2), (2, 1), (5, 0)], "`a b` int, `select` long")
    assert matrix(odd, W.gram_corr, ["a b", "select"])["a b", "select"] < -0.8


# ------------------------------------------------------------------ mode

def brute_mode(values):
    n = Counter(v for v in values if v is not None and not math.isnan(v))
    return min(((v, c) for v, c in n.items()), key=lambda x: (-x[1], x[0])) if n else None


@pytest.mark.parametrize("counters", [2, 5, 1000])
def test_mode_equals_brute_force(spark, counters):
    rng = random.Random(counters)
    cols = {"often": [rng.choice([7.0] * 40 + [rng.uniform(0, 9)]) for _ in range(2000)],
            "flat": [float(rng.randint(0, 400)) for _ in range(2000)],
            "tied": [float(i % 500) for i in range(2000)],
            "distinct": [rng.random() for _ in range(2000)],
            "odd": [rng.choice([None, NAN, -0.0, 0.0, 3.0]) for _ in range(2000)],
            "none": [rng.choice([None, NAN]) for _ in range(2000)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(6)
    got = W.exact_mode(df, list(cols), counters)
    for c, values in cols.items():
        assert got[c] == brute_mode(values), c


def test_a_mode_that_stands_out_needs_no_full_count(spark):
    df = spark.range(20_000).selectExpr("cast(case when id % 3 = 0 then 5 else id end as double) as v").repartition(5)
    parts = df.selectExpr("0 as c", "v").mapInArrow(W._heavy(10), "c int, v double, n long")
    assert parts.count() <= 5 * 11
    assert W.exact_mode(df, ["v"], 10)["v"] == (5.0, 6667 + 1)
    bounded = {r["column"]: r for r in P.location_spread(df, ["v"], method="bounded").collect()}
    plain = {r["column"]: r for r in P.location_spread(df, ["v"]).collect()}
    assert tuple(bounded["v"])[:3] == tuple(plain["v"])[:3] and bounded["v"]["max"] == plain["v"]["max"]


# ------------------------------------------------------------------ kernel sums

@pytest.mark.parametrize("make", [
    lambda g: g.normal(size=3000), lambda g: np.concatenate([g.normal(size=500) * 1e-3, g.normal(size=500) + 1e4]),
    lambda g: np.round(g.exponential(size=2000) * 40, 2), lambda g: g.integers(0, 5, size=300).astype(float)])
def test_moments_give_the_kernel_sums(spark, make):
    x = make(np.random.default_rng(8))
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    fast = {r.point: (r.x, r.density) for r in P.kde_curve(df, "v", method="moments").collect()}
    sums = {r.point: (r.x, r.density) for r in P.kde_curve(df, "v", method="values").collect()}
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    scale = (x.max() - x.min()) / 5 / (bw * math.sqrt(2 * math.pi))
    want = np.exp(-0.5 * ((grid[:, None] - x) / bw) ** 2).sum(1) * scale
    assert fast.keys() == sums.keys() == set(range(200))
    for p in range(200):
        assert abs(fast[p][1] - want[p]) < 1e-9 * len(x) * scale and abs(sums[p][1] - want[p]) < 1e-9 * len(x) * scale


def test_curve_of_nothing_and_of_one_value(spark):
    for rows in ([], [(1.0,)], [(2.0,)] * 5, [(None,), (NAN,)]):
        df = spark.createDataFrame(rows, "v double")
        assert P.kde_curve(df, "v").count() == P.kde_curve(df, "v", method="moments").count() == 0


def test_no_shuffle_of_distinct_values(spark):
    df = spark.range(1000).selectExpr("cast(id as double) / 7 as v")
    plan = P.kde_curve(df, "v", method="moments")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_x" not in plan and "hashpartitioning(_box" in plan
