"""Operators on small hand-made frames: NULL logic, ties, empty input, repartitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import profile as PR
from revlens.operators import shape as SH
from revlens.operators import stats as ST
from revlens.operators import timeseries as TS
from revlens.operators import filters as FL


def test_location_spread(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,), (2,)], "x int")
    r = PR.location_spread(df, ["x"]).first()
    assert (r["median"], r["mode"], r["std"], r["min"], r["max"]) == (2.0, 1.0, 1.0, 1.0, 3.0)


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    rows = {(r.col1, r.col2): r.r for r in PR.corr_matrix(df, ["a", "b"]).collect()}
    assert rows[("a", "b")] is None and rows[("b", "a")] is None and rows[("b", "b")] is None
    assert rows[("a", "a")] == 1.0


def test_chi_square_3x3(spark):
    cells = [("r1", "c1", 10), ("r1", "c2", 20), ("r1", "c3", 30), ("r2", "c1", 6), ("r2", "c2", 9), ("r2", "c3", 17),
             ("r3", "c1", 25), ("r3", "c2", 5), ("r3", "c3", 12)]
    rows = [(r, c) for r, c, n in cells for _ in range(n)]
    df = spark.createDataFrame(rows, "r string, c string")
    out = ST.chi_square(df, "r", "c").first()
    assert out.statistic == pytest.approx(24.722217, abs=1e-6)
    assert out.dof == 4 and out.p_value == pytest.approx(5.7e-05, abs=1e-6) and out.reject_h0


def test_chi_square_without_rows_gives_none(spark):
    empty = spark.createDataFrame([("a", None), (None, "b")], "r string, c string")
    assert ST.chi_square(empty, "r", "c").count() == 0
    assert ST.contingency_cells(empty, "r", "c").count() == 0


@pytest.mark.parametrize("table", [[[5, 0], [3, 9]], [[5, 0], [0, 9]], [[4, 0, 2], [0, 7, 1], [3, 3, 0]], [[1, 2, 3, 4]],
                                   [[10, 20, 30], [0, 0, 5]]])
def test_chi_square_with_empty_cells_equals_the_full_grid(spark, table):
    rows = [(f"r{i}", f"c{j}") for i, line in enumerate(table) for j, n in enumerate(line) for _ in range(n)]
    out = ST.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    t = np.array(table, float)
    e = t.sum(1)[:, None] * t.sum(0)[None] / t.sum()
    dof = (t.shape[0] - 1) * (t.shape[1] - 1)
    d = np.abs(t - e) - (np.minimum(0.5, np.abs(t - e)) if dof == 1 else 0)
    assert out.dof == dof and out.expected_low == bool((e < 5).any())
    assert out.statistic == pytest.approx((d ** 2 / e).sum() if dof else 0.0, rel=1e-9)


def test_contingency_grid_of_any_width(spark, monkeypatch):
    monkeypatch.setattr(ST, "LABELS_PER_ARRAY", 3)
    df = spark.range(60).select(F.concat(F.lit("r"), F.col("id") % 4).alias("r"), F.concat(F.lit("c"), F.col("id") % 15).alias("c"))
    cells = ST.contingency_cells(df, "r", "c").collect()
    assert len(cells) == 60 and sum(c.observed for c in cells) == 60


def test_chi_square_single_row_and_yates(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y")], "r string, c string")
    out = ST.chi_square(df, "r", "c").first()
    assert (out.statistic, out.dof, out.p_value) == (0.0, 0, 1.0)
    # 2x2 with Yates: [[12, 5], [3, 10]]
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 10
    out = ST.chi_square(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    # hand computation: expected 8.5 8.5 / 6.5 6.5, |o−e| = 3.5 → (3)^2 (1/8.5·2 + 1/6.5·2)
    assert out.statistic == pytest.approx(9 * (2 / 8.5 + 2 / 6.5), rel=1e-12)
    assert out.dof == 1 and out.expected_low is False


def test_crosstab_zero_cells(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "r string, c string")
    got = [tuple(r) for r in ST.crosstab(df, "r", "c").collect()]
    assert got == [("a", 1, 0), ("b", 0, 2)]


def test_two_proportion_z_empty_group(spark):
    df = spark.createDataFrame([("en", "NEGATIVE"), ("en", "POSITIVE")], "p string, s string")
    assert ST.two_proportion_z(df, "p", "en", "fr", "s", "NEGATIVE").count() == 0


def test_two_proportion_z_value(spark):
    rows = [("a", "N")] * 30 + [("a", "P")] * 70 + [("b", "N")] * 20 + [("b", "P")] * 80
    out = ST.two_proportion_z(spark.createDataFrame(rows, "g string, y string"), "g", "a", "b", "y", "N").first()
    p = 0.25
    z = (0.3 - 0.2) / (p * (1 - p) * (2 / 100)) ** 0.5
    assert out.z == pytest.approx(z) and out.n1 == 100 and out.k2 == 20


def test_top_k_other_and_ties(spark):
    rows = [(f"b{i % 20}",) for i in range(400)] + [(None,)]
    df = spark.createDataFrame(rows, "bank string")
    out = PR.top_k_other(df, "bank", 15).collect()
    assert len(out) == 16
    other = [r for r in out if r.bank == "Other"][0]
    assert other["count"] == 100 and other["rank"] == 16
    top = sorted((r["rank"], r.bank) for r in out if r.bank != "Other")
    assert top[0] == (1, "b0") and top[2] == (3, "b10")  # name order breaks the tie
    assert sum(r.pct for r in out) == pytest.approx(100.0)


def test_top_k_other_few_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "bank string")
    assert sorted(r.bank for r in PR.top_k_other(df, "bank", 15).collect()) == ["a", "b"]


def test_dedup_keep_first_idempotent_and_partition_free(spark):
    rows = [(i, f"t{i % 7}", i * 2) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, v long")
    a = sorted(tuple(r) for r in SH.dedup_keep_first(df.repartition(1), "text", "id").collect())
    b = sorted(tuple(r) for r in SH.dedup_keep_first(df.repartition(17), "text", "id").collect())
    assert a == b and [r[0] for r in a] == list(range(7))
    again = SH.dedup_keep_first(SH.dedup_keep_first(df, "text", "id"), "text", "id")
    assert sorted(tuple(r) for r in again.collect()) == a


def test_binned_distribution_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.55,), (0.95,), (0.95,), (0.0,), (None,)], "x double")
    out = PR.binned_distribution(df, F.col("x")).collect()
    assert [r["count"] for r in out] == [0, 1, 0, 0, 0, 0, 2]
    assert out[1].pct == pytest.approx(20.0)


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    out = PR.histogram_equal_width(df, "x", 5).collect()
    assert [r["count"] for r in out] == [0, 0, 2, 0, 0] and out[0].bin_lo == 2.5 and out[-1].bin_hi == 3.5


def test_kde_zero_variance_has_no_rows(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert PR.kde_curve(df, "x").count() == 0


def test_kde_matches_numpy(spark):
    import numpy as np
    xs = [1.0, 2.0, 2.0, 3.5, 5.0, 4.0]
    out = PR.kde_curve(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 200, 5).collect()
    a = np.array(xs)
    bw = a.std(ddof=1) * len(a) ** -0.2
    g = np.linspace(a.min(), a.max(), 200)
    dens = np.exp(-0.5 * ((g[:, None] - a[None, :]) / bw) ** 2).sum(1) / (len(a) * bw * np.sqrt(2 * np.pi))
    expect = dens * len(a) * (a.max() - a.min()) / 5
    got = np.array([r.density for r in sorted(out, key=lambda r: r.point)])
    assert np.allclose(got, expect, rtol=1e-9)


def test_box_stats_whiskers(spark):
    vals = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([("g", float(v)) for v in vals], "k string, v double")
    r = PR.box_stats(df, "k", "v").first()
    assert (r.q1, r.median, r.q3) == (3.0, 5.0, 7.0)
    assert (r.whisker_low, r.whisker_high, r.outliers) == (1.0, 8.0, 1)


def test_missing_profile_and_satisfaction(spark):
    df = spark.createDataFrame([(1, None), (5, 2.0), (None, float("nan")), (3, 1.0)], "grade int, x double")
    m = {r.column: (r.missing, r.pct) for r in PR.missing_profile(df).collect()}
    assert m == {"grade": (1, 25.0), "x": (2, 50.0)}
    s = {r.level: r["count"] for r in PR.satisfaction_levels(df).collect()}
    assert s == {"high": 1, "medium": 1, "low": 1}


def test_counts_over_time_switches_granularity(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    short = spark.createDataFrame([(base,), (base + dt.timedelta(days=7, hours=23),)], "ts timestamp_ntz")
    long = spark.createDataFrame([(base,), (base + dt.timedelta(days=8),)], "ts timestamp_ntz")
    assert {r.granularity for r in TS.counts_over_time(short, "ts").collect()} == {"hour"}
    assert {r.granularity for r in TS.counts_over_time(long, "ts").collect()} == {"day"}


def test_weekday_domain_has_nulls(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),)], "ts timestamp_ntz")  # a Monday
    out = TS.weekday_counts(df, "ts").collect()
    assert [r.day_name for r in out][0] == "Monday" and out[0]["count"] == 1
    assert all(r["count"] is None for r in out[1:]) and len(out) == 7


def test_require_and_empty(spark):
    df = spark.createDataFrame([(1, "a")], "id long, bank string")
    with pytest.raises(ValueError, match="missing required column: product"):
        FL.require_columns(df, ["bank", "product"])
    e = FL.empty_subset(df, F.col("bank") == "zzz")
    assert e.count() == 0 and e.columns == ["id", "bank"] and FL.is_empty(e)
    assert FL.filter_status(df) is df


def test_filter_datetime_range_needs_both_bounds(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10),), (None,)], "ts timestamp_ntz")
    assert FL.filter_datetime_range(df, "ts", "2024-01-01T00:00", None).count() == 2
    assert FL.filter_datetime_range(df, "ts", "2024-01-01T00:00", "bad").count() == 2
    assert FL.filter_datetime_range(df, "ts", "2024-01-01T00:00", "2024-01-01T10:00").count() == 1


def test_stratified_split_exact_counts(spark):
    from revlens.operators.classifier import stratified_split
    rows = [(i, 0 if i % 10 < 7 else 1) for i in range(203)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = stratified_split(df, "label", "id", bucket_hex=1)  # 16 buckets: the boundary bucket path is exercised
    got = {r.label: r.n for r in out.where("is_validation").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0 = sum(1 for _, l in rows if l == 0)
    n1 = len(rows) - n0
    import math
    assert got == {0: math.ceil(0.2 * n0), 1: math.ceil(0.2 * n1)}
    assert out.count() == 203
    # same validation ids as a direct rank by hash
    import hashlib
    def pick(lbl, n):
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, l in rows if l == lbl)
        return {i for _, i in ids[:math.ceil(0.2 * n)]}
    expect = pick(0, n0) | pick(1, n1)
    assert {r.id for r in out.where("is_validation").collect()} == expect


def test_kde_reach_window_matches_full_grid(spark):
    import math
    import random
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [1e6, 2.5e5]  # far outliers: the reach window is active
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = {r.point: (r.x, r.density) for r in PR.kde_curve(df, "v", 200, 5).collect()}
    n, mn, mx = len(vals), min(vals), max(vals)
    mean = sum(vals) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in vals) / (n - 1))
    bw = sd * n ** -0.2
    width = (mx - mn) / 5
    assert (mx - mn) > 2 * 39 * bw  # the window really skips grid points
    for p in range(200):
        gx = mn + p * (mx - mn) / 199
        dens = sum(math.exp(-0.5 * ((gx - v) / bw) ** 2) for v in vals) * width / (bw * math.sqrt(2 * math.pi))
        assert got[p][1] == pytest.approx(dens, rel=1e-9, abs=1e-300)
    assert len(got) == 200 and any(d == 0.0 for _, d in got.values())


def test_weighted_tests_equal_row_level(spark):
    rows = [("a", "x")] * 12 + [("a", "y")] * 5 + [("b", "x")] * 3 + [("b", "y")] * 10 + [("c", "y")] * 7
    df = spark.createDataFrame(rows, "r string, c string")
    agg = df.groupBy("r", "c").agg(F.count(F.lit(1)).alias("w"))
    for vals in (None, ["x", "y"]):
        a = ST.chi_square(df, "r", "c", vals).first().asDict()
        b = ST.chi_square(agg, "r", "c", vals, weight="w").first().asDict()
        assert a == pytest.approx(b)
    a = ST.two_proportion_z(df, "r", "a", "b", "c", "x").first().asDict()
    b = ST.two_proportion_z(agg, "r", "a", "b", "c", "x", weight="w").first().asDict()
    assert a == pytest.approx(b) and b["n1"] == 17 and b["k2"] == 3
    assert ST.two_proportion_z(agg, "r", "a", "zz", "c", "x", weight="w").count() == 0


def test_number_top_equals_row_number(spark):
    from pyspark.sql import Window
    rows = [("b", 3.0, 1), ("a", 3.0, 2), (None, 3.0, 3), ("c", None, 4), ("d", 1.5, 5), ("a", 9.0, 6),
            ("e", None, 7), (None, 1.5, 8)]
    df = spark.createDataFrame(rows, "k string, v double, id int")
    for asc in (False, True):
        top = SH.top_k_sorted(df, "v", ["k", "id"], 6, ascending=asc)
        got = [(r.id, r.rank) for r in SH.number_top(top, "v", ["k", "id"], ascending=asc).collect()]
        w = Window.orderBy(F.col("v").asc() if asc else F.col("v").desc(),
                           F.col("k").asc_nulls_last(), F.col("id").asc_nulls_last())
        want = [(r.id, r.rank) for r in top.withColumn("rank", F.row_number().over(w)).collect()]
        assert sorted(got) == sorted(want) and len(got) == 6
    empty = SH.top_k_sorted(df.where("false"), "v", "k", 3)
    assert SH.number_top(empty, "v", "k").count() == 0
