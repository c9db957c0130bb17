"""Invariants on the generated tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from revlens.functions import max_confidence
from revlens.operators import profile as PR
from revlens.operators import shape as SH
from revlens.operators import stats as ST
from revlens.operators.classifier import stratified_split
from revlens.plans.base import hypothesis_base, reviews, table


@pytest.fixture(scope="module")
def rv(spark):
    return reviews(spark, SF001).checkpoint()


def test_bins_sum_to_non_null_rows(rv):
    total = sum(r["count"] for r in PR.binned_distribution(rv, max_confidence()).collect())
    assert total == rv.where(F.col("NEGATIVE").isNotNull()).count()


def test_shares_sum_to_100(rv):
    assert sum(r.pct for r in PR.value_counts_pct(rv, "product").collect()) == pytest.approx(100.0)
    assert sum(r.pct for r in PR.top_k_other(rv, "bank", 15).collect()) == pytest.approx(100.0)


def test_top_k_plus_other_is_total(rv):
    out = PR.top_k_other(rv, "city", 5).collect()
    assert sum(r["count"] for r in out) == rv.where(F.col("city").isNotNull()).count()
    rem = PR.top_k_remainder(rv, "city", 5).collect()
    assert sum(r["count"] for r in rem) + rem[0].other_rows == rv.where(F.col("city").isNotNull()).count()


def test_split_disjoint_and_complete(spark):
    lab = table(spark, SF001, "labels").select("doc_id", F.col("quality").alias("label"))
    s = stratified_split(lab, "label", "doc_id").cache()
    assert s.count() == lab.count() and s.select("doc_id").distinct().count() == lab.count()
    n_valid = {r.label: r.n for r in s.where("is_validation").groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_all = {r.label: r.n for r in s.groupBy("label").agg(F.count("*").alias("n")).collect()}
    import math
    assert n_valid == {k: math.ceil(0.2 * v) for k, v in n_all.items()}


def test_contingency_margins(spark):
    h = hypothesis_base(spark, SF001)
    cells = ST.contingency_cells(h, "product", "sentiment").collect()
    counts = {r["product"]: r["n"] for r in h.groupBy("product").agg(F.count("*").alias("n")).collect()}
    for c in cells:
        assert c.row_total == counts[c["product"]]
    assert sum(c.observed for c in cells) == cells[0].total == h.count()
    assert sum(c.expected for c in cells) == pytest.approx(h.count())


def test_corr_symmetric(rv):
    cols = ["grade", "clear_conditions", "polite_employee", "availability", "convenience"]
    m = {(r.col1, r.col2): r.r for r in PR.corr_matrix(rv, cols).collect()}
    for (a, b), r in m.items():
        assert r == pytest.approx(m[(b, a)]) if r is not None else m[(b, a)] is None


@pytest.mark.parametrize("op", ["value_counts", "box_stats", "describe", "dedup", "quartiles"])
def test_repartition_invariance(rv, op):
    def run(df):
        if op == "value_counts":
            out = PR.value_counts(df, "city")
        elif op == "box_stats":
            out = PR.box_stats(SH.melt(df, ["grade", "availability"]), "variable", "value")
        elif op == "describe":
            out = PR.describe_numeric(df, ["grade", "NEGATIVE"])
        elif op == "quartiles":
            out = PR.box_stats(df, "product", "NEGATIVE", method="bucketed")
        else:
            out = SH.dedup_keep_first(df, "review", "review_id").select("review_id")
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in out.collect())
    assert run(rv.repartition(1)) == run(rv.repartition(17))


def test_review_table_same_rows_with_and_without_city_broadcast(spark, monkeypatch):
    import revlens.sources.tables as T
    a = sorted(map(tuple, T.reviews_standin(spark, SF001).collect()), key=repr)
    monkeypatch.setattr(T, "_CITY_ROW_BYTES", 10 ** 12)  # customer "too large": the join-back branch
    b = T.reviews_standin(spark, SF001)
    assert "city_event_id" in b._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, b.collect()), key=repr) == a
