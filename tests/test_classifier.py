"""Classifier stages, model selection and metrics on a tiny labelled frame."""

import pytest
from pyspark.sql import functions as F

from revlens.operators import classifier as CL
from revlens.operators import score as SC
from revlens.session import scratch_path


@pytest.fixture(scope="module")
def frame(spark):
    pos = ["great service and kind staff", "very good bank great app", "good rates great support"]
    neg = ["awful queue and rude staff", "bad app terrible support", "terrible rates awful bank"]
    rows = [(i, t, 2) for i, t in enumerate(pos * 4)] + [(100 + i, t, 0) for i, t in enumerate(neg * 4)]
    return spark.createDataFrame(rows, "doc_id long, cleaned_review string, label int")


def test_train_and_predict(frame):
    m = CL.train_classifier(frame, max_iter=50)
    p = CL.predict(m, frame, ["doc_id", "label"])
    acc = SC.accuracy(p).first().accuracy
    assert acc == 1.0


def test_select_best_model_first_wins_ties(spark, frame):
    grid = [{"reg_param": 0.0, "max_iter": 30}, {"reg_param": 0.0, "max_iter": 30}, {"reg_param": 10.0, "max_iter": 30}]
    path = scratch_path(spark, "best")
    model, rows = CL.select_best_model(frame, frame, grid, save_path=path)
    assert [r[-1] for r in rows] == [True, False, False] and model is not None
    assert all(loss >= 0 and 0 <= acc <= 1 for _, _, loss, acc, _, _ in rows)
    from pyspark.ml import PipelineModel
    assert PipelineModel.load(path) is not None


def test_probabilities_from_text(frame):
    m = CL.train_classifier(frame, max_iter=50)
    p = CL.predict_proba(m, frame, ["doc_id", "label"], ["a", "b", "c"]).collect()
    for r in p:
        assert r.a + r.b + r.c == pytest.approx(1.0) and (r.a > r.c) == (r.label == 0)


def test_report_zero_division(spark):
    p = spark.createDataFrame([(0, 0), (0, 1), (2, 2)], "label int, prediction int")
    rep = {r["class"]: r for r in SC.classification_report(p).collect()}
    assert rep["Neutral"].precision == 0.0 and rep["Neutral"].recall == 0.0 and rep["Neutral"].support == 0
    assert rep["accuracy"].f1 == pytest.approx(2 / 3)
    assert rep["macro avg"].support == 3
    wf1 = SC.weighted_f1(p).first().weighted_f1
    assert wf1 == pytest.approx((2 * (2 / 3) + 1 * 1.0) / 3)
