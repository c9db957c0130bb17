"""Hand-made edge rows (FIXTURES.md §4): expected values follow the record-at-a-time semantics."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from revlens.functions import (assign_bin, categorise_product, clean_text, extract_between, format_datetime_local,
                               grade_to_label, label_by_confidence, label_name, normalise_bank, parse_digits,
                               parse_review_date, percent_label, upper_strip, softmax_array, max_confidence,
                               argmax_label)
from revlens.functions.dist import chi2_sf, chi2_sf_col, norm_sf, norm_sf_col
from revlens.operators import filters as FL


def col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_normalise_bank(spark):
    rows = [("Unknown", "Отзывы об ипотеке Альфа-Банка"), ("Unknown", "Отзывы Банка Точка"), ("Unknown", "картах"),
            ("Unknown", "Unknown"), ("Unknown", None), ("Тема – отзыв о Почта Банке от Иван", "x"),
            ("X – отзыв о Сбербанке от", "x"), ("X – отзыв о Росбанке клиента", "x"), ("X – отзыв о Котор Банк", "x"),
            ("Просто банк", "x"), (None, "x")]
    got = col(spark, rows, "bank string, product string", normalise_bank(F.col("bank"), F.col("product")))
    assert got == ["Альфа-Банк", "Банк Точк", "", "Unknown", "Unknown", "Почта Банк", "Сбербанк", "РосБанк клиента",
                   "Кор Банк", "Просто банк", None]


def test_categorise_product(spark):
    got = col(spark, [("дебетовых картах Х",), ("РКО",), ("Unknown",), ("прочее",), (None,)], "p string",
              categorise_product(F.col("p")))
    assert got == ["дебетовая карта", "РКО", "все продукты", "прочее", None]


def test_parse_review_date(spark):
    rows = [("05.02.2024 13:07",), ("5.2.2024 3:07",), ("0",), ("31.02.2024 10:00",), ("05.02.2024",), (None,)]
    got = col(spark, rows, "d string", parse_review_date(F.col("d")))
    assert got == [dt.datetime(2024, 2, 5, 13, 7), dt.datetime(2024, 2, 5, 3, 7), None, None, None, None]
    got = col(spark, rows[:3], "d string", format_datetime_local(parse_review_date(F.col("d"))))
    assert got == ["2024-02-05T13:07", "2024-02-05T03:07", ""]


def test_filter_contradiction(spark):
    rows = [(5, "NEGATIVE"), (4, "NEGATIVE"), (None, "NEGATIVE"), (3, "NEGATIVE"), (5, None), (5, "POSITIVE")]
    df = spark.createDataFrame(rows, "grade int, sentiment string")
    kept = [(r.grade, r.sentiment) for r in FL.filter_contradiction(df).collect()]
    assert kept == [(None, "NEGATIVE"), (3, "NEGATIVE"), (5, None), (5, "POSITIVE")]


def test_label_by_confidence(spark):
    rows = [(.1, .1, .8), (.8, .1, .1), (.1, .8, .1), (.5, .3, .2), (.75, .25, 0.0), (None, None, None),
            (0.8, None, 0.1)]
    got = col(spark, rows, "NEGATIVE double, NEUTRAL double, POSITIVE double", label_by_confidence())
    assert got == ["POSITIVE", "NEGATIVE", "NEUTRAL", "untraced", "NEGATIVE", None, "NEGATIVE"]


def test_grade_to_label_and_name(spark):
    rows = [("0",), ("2",), ("3",), ("5",), ("-1",), ("4.0",), ("x",), (None,)]
    got = col(spark, rows, "g string", grade_to_label(F.col("g")))
    assert got == [0, 0, 1, 2, 2, 1, 1, 1]
    assert col(spark, [(0,), (1,), (2,)], "l int", label_name(F.col("l"))) == ["Negative", "Neutral", "Positive"]
    # numbers truncate like int(4.7)
    assert col(spark, [(4.7,), (2.9,)], "g double", grade_to_label(F.col("g"))) == [2, 0]


def test_clean_text(spark):
    rows = [(" См. http://a.b/c  ДА ",), ("a  B",), (None,), ("x y\ny",)]
    assert col(spark, rows, "t string", clean_text(F.col("t"))) == ["см. да", "a b", "", "x y y"]


def test_assign_bin(spark):
    rows = [(0.0,), (0.5,), (0.50001,), (1.0,), (1.0000001,), (None,)]
    assert col(spark, rows, "x double", assign_bin(F.col("x"))) == [None, 0, 1, 6, None, None]


def test_filter_near_value(spark):
    df = spark.createDataFrame([(0.752,), (0.7520075,), (0.75201,), (None,)], "x double")
    assert [r.x for r in FL.filter_near_value(df, "x").collect()] == [0.752, 0.7520075]


def test_percent_label(spark):
    rows = [(3, 40), (1, 8), (5, 400), (1, 3), (0, 7)]
    got = col(spark, rows, "c long, t long", percent_label(F.col("c"), F.col("t")))
    assert got == ["3 (7.5%)", "1 (12.5%)", "5 (1.3%)", "1 (33.3%)", "0 (0.0%)"]


def test_extract_between_and_digits(spark):
    rows = [("a – b от c",), ("no dash",), ("x – y",), ("Отзыв – Банк Х от 1",)]
    assert col(spark, rows, "t string", extract_between(F.col("t"))) == ["b", "Unknown", "Unknown", "Банк Х"]
    rows = [("12",), (" 7 ",), ("1a",), ("",), (None,), ("12\n",)]
    assert col(spark, rows, "t string", parse_digits(F.col("t"))) == [12, 7, None, None, None, 12]


def test_upper_strip(spark):
    assert col(spark, [(" negative ",), ("Neutral",)], "t string", upper_strip(F.col("t"))) == \
        ["NEGATIVE", "NEUTRAL"]


def test_softmax_and_argmax(spark):
    rows = [([1.0, 2.0, 3.0],), ([1000.0, 0.0, -1000.0],)]
    got = col(spark, rows, "a array<double>", softmax_array(F.col("a")))
    assert got[0] == pytest.approx([0.09003057, 0.24472847, 0.66524096], rel=1e-6)
    assert got[1] == pytest.approx([1.0, 0.0, 0.0])
    rows = [(0.2, 0.5, 0.3), (0.4, 0.4, 0.2), (None, None, None)]
    s = "NEGATIVE double, NEUTRAL double, POSITIVE double"
    assert col(spark, rows, s, argmax_label()) == [1, 0, None]
    assert col(spark, rows, s, max_confidence()) == [0.5, 0.4, None]


def test_tail_probabilities():
    assert chi2_sf(24.722217, 4) == pytest.approx(5.7211e-05, rel=1e-4)
    for dof, x in [(1, 3.841458820694124), (2, 5.991464547107979), (3, 7.814727903251178), (5, 11.070497693516351)]:
        assert chi2_sf(x, dof) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(0.0, 0) == 1.0 and chi2_sf(5.0, 0) == 1.0
    assert norm_sf(1.6448536269514722) == pytest.approx(0.05, abs=1e-12)
    assert norm_sf(0.0) == 0.5 and norm_sf(None) is None


def test_native_tails_match_python(spark):
    xs = [None, 0.0, 1e-9, 0.5, 1.0, 3.841458820694124, 7.814727903251178, 24.7222, 50.0, 300.0, 2000.0]
    rows = [(x, k) for k in (0, 1, 2, 3, 4, 5, 6, 7, 12, 101) for x in xs] + [(1.0, None)]
    df = spark.createDataFrame(rows, "x double, k long")
    for r in df.select("x", "k", chi2_sf_col(F.col("x"), F.col("k")).alias("p")).collect():
        want = chi2_sf(r.x, r.k)
        assert (r.p is None and want is None) or r.p == pytest.approx(want, rel=1e-9), (r, want)


def test_tails_keep_their_digits(spark):
    zs = [-30.0, -9.0, -0.3, 0.0, 0.3, 0.99, 1.0, 1.4142, 1.5, 3.0, 9.0, 20.0, 37.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", norm_sf_col(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(norm_sf(r.z), rel=1e-9)
    cases = [(x, k) for k in (1, 2, 3, 4, 9, 10, 21, 50, 200, 999) for x in (0.5, k * 0.9, k * 1.05, k * 1.5, k * 3 + 30.0, 90.0)]
    got = spark.createDataFrame([(float(x), k) for x, k in cases], "x double, k long") \
        .select("x", "k", chi2_sf_col(F.col("x"), F.col("k")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(chi2_sf(r.x, r.k), rel=1e-9), r


def test_very_many_degrees_of_freedom(spark):
    """Where the normal law takes over, the tail goes on smoothly; one step of dof moves it by its derivative."""
    rows = [(2e8 + 1e5, 199_999_998), (2e8 + 1e5, 200_000_000), (2e8 + 1e5, 200_000_002), (6e9, 6_000_000_000)]
    p = [r.p for r in spark.createDataFrame(rows, "x double, k long")
         .select(chi2_sf_col(F.col("x"), F.col("k")).alias("p")).collect()]
    assert p[1] / p[0] == pytest.approx(p[2] / p[1], rel=1e-6) and 0.4999 < p[3] < 0.5
    zs = [None, float("nan"), -9.0, -1.96, -0.3, 0.0, 0.7, 1.6448536269514722, 3.0, 7.5, 40.0]
    dz = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in dz.select("z", norm_sf_col(F.col("z")).alias("p")).collect():
        want = norm_sf(r.z)
        assert (r.p is None and want is None) or r.p == pytest.approx(want, abs=1e-14), (r, want)


def test_clean_text_single_pass_matches_python(spark):
    import random
    import re

    def py_clean(t):
        if not isinstance(t, str):
            return ""
        return re.sub(r"\s+", " ", re.sub(r"http\S+", "", t)).strip().lower()

    rnd = random.Random(3)
    parts = ["http", "https://x.y/z", " ", "\t", "\n", "a", "B", "xhttp", "http:", "Ü", "　", "\xa0", ".", "ttp"]
    rows = [(None,), ("",), ("http",), ("http ",), (" http://a b",), ("ahttp://x",), ("a  http://q\tB  ",)]
    rows += [("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string")
    for r in df.select("t", clean_text(F.col("t")).alias("c")).collect():
        assert r.c == py_clean(r.t), repr(r.t)


def test_ws_chars_are_python_whitespace():
    from revlens.functions.text import WS_CHARS
    assert set(WS_CHARS) == {chr(c) for c in range(0x110000) if chr(c).isspace()}
