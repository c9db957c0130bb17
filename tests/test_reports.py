"""Report entry points agree with the registered single-result plans."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
import __spark_entry__ as E
from revlens.plans.base import labelled, reviews
from revlens.plans.reports import confidence_report, dashboard, hypothesis_report


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_dashboard_all_matches_plans(spark):
    d = dashboard(labelled(spark, SF001))
    q = E.queries()
    shown = d["reviews_by_bank"].collect()
    assert [r["rank"] for r in shown] == list(range(len(shown), 0, -1)) and shown[0].bank == "Other"
    assert _rows(d["reviews_by_bank"]) == _rows(q["top_k_other"](spark, SF001).select(*d["reviews_by_bank"].columns))
    assert _rows(d["grade_histogram"]) == _rows(q["histogram_equal_width"](spark, SF001))
    assert _rows(d["ratings_box"]) == _rows(q["box_stats"](spark, SF001))
    assert d["reviews_table"].count() == reviews(spark, SF001).count()


def test_dashboard_filters(spark):
    d = dashboard(labelled(spark, SF001), product="en", sentiment="NEGATIVE",
                  start="2024-01-01T00:00", end="2024-01-02T00:00")
    t = d["reviews_table"].collect()
    assert all(r["product"] == "en" and r.sentiment == "NEGATIVE" for r in t)
    assert sum(r["count"] for r in d["reviews_over_time"].collect()) == len(t)


def test_hypothesis_report_matches_plan(spark):
    rep = hypothesis_report(labelled(spark, SF001).where(F.col("status") == "good"), ["src0", "src1", "src2"],
                            ("en", "fr"), ["de", "en", "es", "fr"])
    got = {r.hypothesis: (round(r.statistic, 6), round(r.p_value, 6)) for r in rep.collect()}
    ref = {r.hypothesis: (r.statistic, r.p_value) for r in E.queries()["decide_alpha"](spark, SF001).collect()}
    assert got["bank_vs_sentiment"] == ref["bank_vs_sentiment"]
    assert got["product_vs_sentiment"] == ref["product_vs_sentiment"]
    assert got["negative_share_first_gt_second"] == ref["negative_share_en_gt_fr"]


def test_hypothesis_tables(spark):
    from revlens.plans.reports import hypothesis_tables
    df = spark.createDataFrame([("a", "p", "POSITIVE")] * 40 + [("b", "p", "NEGATIVE")] * 40 + [("a", "q", "NEGATIVE")] * 5
                               + [("b", "q", "positive ")] * 5, "bank string, product string, sentiment string")
    t = hypothesis_tables(df, ["a", "b"], ["p", "q"])
    cells = {(r.bank, r.sentiment): r.observed for r in t["bank_vs_sentiment_cells"].collect()}
    assert cells == {("a", "POSITIVE"): 40, ("a", "NEGATIVE"): 5, ("b", "POSITIVE"): 5, ("b", "NEGATIVE"): 40}
    assert t["bank_vs_sentiment_residuals"].count() == 4            # rejected
    assert t["product_vs_sentiment_cells"].count() == 4 and t["product_vs_sentiment_residuals"].count() == 0
    none = hypothesis_tables(df, ["z"], ["z"])
    assert all(v.count() == 0 for v in none.values())


def test_confidence_report(spark):
    r = confidence_report(reviews(spark, SF001))
    s = r["summary"].first()
    ref = E.queries()["confidence_summary"](spark, SF001).first()
    assert s.total_reviews == ref.total_reviews and round(s.median_confidence, 6) == ref.median_confidence
    assert sum(x["count"] for x in r["histogram"].collect()) == reviews(spark, SF001).where("NEGATIVE IS NOT NULL").count()


def test_eda_report_runs_and_fuses_counts(spark):
    from revlens.plans.reports import eda_report
    from revlens.operators import profile as PR
    rep = eda_report(labelled(spark, SF001))
    may_be_empty = {"missing", "high_corr_pairs", "qualified_group_means"}
    for k, v in rep.items():
        assert v is None or v.columns and (v.count() > 0 or k in may_be_empty), k
    fused = {(r.column, r.value): r["count"] for r in rep["category_counts"].collect()}
    single = {("city", r.city): r["count"] for r in PR.value_counts(reviews(spark, SF001), "city").collect()}
    assert {k: v for k, v in fused.items() if k[0] == "city"} == single
