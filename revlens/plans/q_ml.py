"""Registered plans: scoring, training data, split, classifier and metrics (§2.11),
plus the flagship end-to-end query."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import argmax_label, grade_to_label, label_by_confidence
from ..operators import batched as BA
from ..operators import classifier as CL
from ..operators import profile as PR
from ..operators import score as SC
from ..session import scratch_path
from .base import (final_reviews, register, reviews, round_doubles, sql_clean, sql_grade_label, sql_softmax, table)

P3 = ("NEGATIVE", "NEUTRAL", "POSITIVE")
_SM = sql_softmax(*[f"10 * CAST(v.embedding[{i}] AS DOUBLE)" for i in (1, 2, 3)])


@register("score_text", f"SELECT d.doc_id AS review_id, {_SM[0]} AS NEGATIVE, {_SM[1]} AS NEUTRAL, {_SM[2]} AS POSITIVE "
          "FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id", doubles=P3)
def q_score_text(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("review_id"), "embedding")
    x = d.join(v, "review_id")
    s = SC.score_text(x, SC.embedding_head_model(), "embedding", input_shape=[64])
    return round_doubles(s.select("review_id", *P3))


def _toy_weights():
    """A fixed weight per token id and class, as SQL can state it."""
    i = np.arange(BA.VOCABULARY)[:, None]
    return (i * np.array([3, 5, 7])) % 997 / 997.0 * 4 - 2


_HEX = " + ".join(f"{16 ** (3 - k)} * (instr('0123456789abcdef', h[{k + 1}]) - 1)" for k in range(4))
_IDS_CTE = f"""hashed AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')[1:{BA.SCORE_TOKENS}],
                                lambda w: md5(lower(w))) AS hs FROM documents),
ids AS (SELECT doc_id, list_transform(hs, lambda h: {_HEX}) AS a FROM hashed),
logits AS (SELECT doc_id, {", ".join(f"coalesce(list_avg(list_transform(a, lambda i: CAST((i * {m}) % 997 AS DOUBLE) / 997 * 4 - 2)), 0) AS z{k}"
                                     for k, m in enumerate((3, 5, 7)))} FROM ids)"""
_SZ = sql_softmax("z0", "z1", "z2")


@register("score_texts", f"SELECT doc_id, {_SZ[0]} AS NEGATIVE, {_SZ[1]} AS NEUTRAL, {_SZ[2]} AS POSITIVE FROM logits",
          doubles=P3, ctes=_IDS_CTE)
def q_score_texts(spark, sf):
    """Every document scored from its text, 512 tokens at most, in padded batches of like length."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    got = BA.score_texts(d, BA.mean_model(_toy_weights(), np.zeros(3)), "text", P3)
    return round_doubles(got.select("doc_id", *P3))


_PREP_SQL = f"""
SELECT review_id, cleaned_review, label FROM (
  SELECT review_id, {sql_clean('review')} AS cleaned_review, {sql_grade_label('grade')} AS label
  FROM reviews WHERE status = 'good' AND review IS NOT NULL AND length(review) > 10) t
WHERE length(cleaned_review) > 5"""


@register("prepare_training", _PREP_SQL)
def q_prepare_training(spark, sf):
    return CL.prepare_training(reviews(spark, sf), keep=["review_id"])


@register("class_balance", f"""
SELECT label, count(*) AS "count", CAST(count(*) AS DOUBLE) * 100.0 / (SELECT count(*) FROM ({_PREP_SQL}) a) AS pct,
       CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS label_name
FROM ({_PREP_SQL}) b GROUP BY label""", doubles=("pct",))
def q_class_balance(spark, sf):
    return round_doubles(PR.class_balance(CL.prepare_training(reviews(spark, sf), keep=["review_id"])))


def _labelled_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id")


@register("stratified_split", """
SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
       <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_validation
FROM (SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id) t""")
def q_stratified_split(spark, sf):
    x = _labelled_docs(spark, sf).select("doc_id", "label")
    return CL.stratified_split(x, "label", "doc_id", seed=42, test_frac=0.2)


def _split_docs(spark, sf):
    """Split once and cut the lineage: training and validation both read the
    checkpointed table (shared checkpoint folder) instead of re-deriving it."""
    x = _labelled_docs(spark, sf).withColumn("cleaned_review", F.col("text"))
    return CL.stratified_split(x, "label", "doc_id", seed=42, test_frac=0.2).checkpoint()


_SPLIT_CTE = """split AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
         <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_validation
  FROM (SELECT d.doc_id, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id) t)"""
# Validation accuracy must reach the share of the larger class, less this much.
ACCURACY_SLACK = 0.02


def _majority(s):
    """Share of the most frequent validation label, as a scalar subquery."""
    n = s.where("is_validation").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n") / F.sum("n")).scalar()


@register("train_classifier", "SELECT doc_id, label, true AS known_class, true AS at_least_majority FROM split "
          "WHERE is_validation", ctes=_SPLIT_CTE, note="which rows are validated, and that the fit is worth having")
def q_train_classifier(spark, sf):
    s = _split_docs(spark, sf)
    model = CL.train_classifier(s.where(~F.col("is_validation")), num_features=1 << 16, reg_param=0.1,
                                max_iter=30)
    p = CL.predict(model, s.where(F.col("is_validation")), ["doc_id", "label"]).checkpoint()
    accuracy = p.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).scalar()
    return p.select("doc_id", "label", F.col("prediction").isin(0, 1).alias("known_class"),
                    (accuracy >= _majority(s) - ACCURACY_SLACK).alias("at_least_majority"))


EPOCHS = 3


@register("train_epochs", f"SELECT CAST(e AS INTEGER) AS epoch, (SELECT count(*) FROM split WHERE NOT is_validation) AS n_train, "
          f"(SELECT count(*) FROM split WHERE is_validation) AS n_valid, CAST(1 AS BIGINT) AS winners, true AS winner_is_best, "
          f"true AS loss_falls, true AS model_predicts_alike FROM range(0, {EPOCHS}) r(e)", ctes=_SPLIT_CTE,
          note="the stored model of the best epoch gives that epoch's accuracy and loss again, from the texts")
def q_train_epochs(spark, sf):
    s = _split_docs(spark, sf)
    got = BA.train_epochs(s, "doc_id", "text", "label", "is_validation", 2, EPOCHS, batch_rows=64)
    rows = got.orderBy("epoch").select("valid_loss", "valid_accuracy", "train_loss", "best").collect()
    best = next(r for r in rows if r["best"])
    p = BA.score_texts(s.where("is_validation"), BA.mean_model(*BA.load_model(got, 2)), "text", ("p0", "p1"), BA.TRAIN_TOKENS)
    own = F.when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p0"))
    again = p.agg(F.avg(-F.log(own)), F.avg(((F.col("p1") > F.col("p0")) == (F.col("label") == 1)).cast("double"))).first()
    alike = max(abs(again[0] - best["valid_loss"]), abs(again[1] - best["valid_accuracy"])) < 1e-9
    return got.select(
        "epoch", "n_train", "n_valid", F.lit(sum(r["best"] for r in rows)).cast("long").alias("winners"),
        F.lit(best["valid_accuracy"] == max(r["valid_accuracy"] for r in rows)).alias("winner_is_best"),
        F.lit(rows[-1]["train_loss"] < rows[0]["train_loss"]).alias("loss_falls"), F.lit(alike).alias("model_predicts_alike"))


@register("select_best_model", "SELECT CAST(c AS INTEGER) AS candidate, (SELECT count(*) FROM split WHERE is_validation) "
          "AS n_validated, CAST(1 AS BIGINT) AS winners, true AS winner_is_best, true AS at_least_majority, "
          "true AS saved_predicts_alike FROM range(0, 3) r(c)", ctes=_SPLIT_CTE,
          note="one winner, and the saved model gives its accuracy again")
def q_select_best_model(spark, sf):
    s = _split_docs(spark, sf)
    valid = s.where(F.col("is_validation"))
    grid = [{"reg_param": r, "max_iter": 20, "num_features": 1 << 16} for r in (0.0, 0.01, 0.1)]
    path = scratch_path(spark, "best-model")
    _, rows = CL.select_best_model(s.where(~F.col("is_validation")), valid, grid, save_path=path)
    table_ = spark.createDataFrame(rows, "candidate int, params string, train_loss double, train_accuracy double, "
                                         "accuracy double, best boolean")
    # the final evaluation reads the saved model back
    p = CL.predict(PipelineModel.load(path), valid, ["label"])
    again = p.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")) \
        .select(F.struct("n", "a").alias("s")).scalar()
    top = table_.agg(F.count_if("best").alias("w"), F.max("accuracy").alias("m"),
                     F.max(F.when(F.col("best"), F.col("accuracy"))).alias("b")).select(F.struct("w", "m", "b").alias("s")) \
        .scalar()
    return table_.select(
        "candidate", again.getField("n").alias("n_validated"), top.getField("w").alias("winners"),
        (top.getField("m") == top.getField("b")).alias("winner_is_best"),
        (top.getField("b") >= _majority(s) - ACCURACY_SLACK).alias("at_least_majority"),
        (F.abs(again.getField("a") - top.getField("b")) < 1e-9).alias("saved_predicts_alike"))


@register("score_documents", "SELECT doc_id, CAST(1 AS DOUBLE) AS total, true AS labelled FROM documents", doubles=("total",),
          note="probabilities of a fitted pipeline on every text; their values depend on the fit")
def q_score_documents(spark, sf):
    """Every document scored from its text by a pipeline fitted on the labelled ones, then labelled by confidence."""
    s = _split_docs(spark, sf)
    model = CL.train_classifier(s.where(~F.col("is_validation")), num_features=1 << 16, reg_param=0.1,
                                max_iter=30)
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("cleaned_review"))
    p = CL.predict_proba(model, docs, ["doc_id"], P3)
    return round_doubles(p.select("doc_id", (F.col(P3[0]) + F.col(P3[1]) + F.col(P3[2])).alias("total"),
                                  label_by_confidence().isin(*P3, "untraced").alias("labelled")))


# Predictions to evaluate: arg-max class of the scores vs the grade-derived label.
def _preds(spark, sf):
    r = reviews(spark, sf).where(F.col("NEGATIVE").isNotNull())
    return r.select("review_id", grade_to_label(F.col("grade")).alias("label"),
                    argmax_label().alias("prediction"), *P3)


_PRED_CTE = f"""preds AS (
  SELECT review_id, {sql_grade_label('grade')} AS label,
         CASE WHEN NEGATIVE = greatest(NEGATIVE, NEUTRAL, POSITIVE) THEN 0
              WHEN NEUTRAL = greatest(NEGATIVE, NEUTRAL, POSITIVE) THEN 1 ELSE 2 END AS prediction,
         NEGATIVE, NEUTRAL, POSITIVE
  FROM reviews WHERE NEGATIVE IS NOT NULL)"""

_PER_CLASS = """per_class AS (
  SELECT c AS class_id, CASE c WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' ELSE 'Positive' END AS class,
         count(*) FILTER (WHERE label = c AND prediction = c) AS tp, count(*) FILTER (WHERE label = c) AS support,
         count(*) FILTER (WHERE prediction = c) AS predicted
  FROM preds, (VALUES (0), (1), (2)) k(c) GROUP BY c),
pr AS (SELECT class_id, class, tp, support,
              CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
              CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall FROM per_class),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END AS f1
      FROM pr)"""


@register("accuracy", "SELECT avg(CAST(label = prediction AS DOUBLE)) AS accuracy, count(*) AS n FROM preds",
          doubles=("accuracy",), ctes=_PRED_CTE)
def q_accuracy(spark, sf):
    return round_doubles(SC.accuracy(_preds(spark, sf)))


@register("mean_log_loss", "SELECT avg(-ln(CASE label WHEN 0 THEN NEGATIVE WHEN 1 THEN NEUTRAL ELSE POSITIVE END)) "
          "AS log_loss, count(*) AS n FROM preds", doubles=("log_loss",), ctes=_PRED_CTE)
def q_mean_log_loss(spark, sf):
    return round_doubles(SC.mean_log_loss(_preds(spark, sf)))


@register("weighted_f1", "SELECT sum(f1 * support) / sum(support) AS weighted_f1 FROM f", doubles=("weighted_f1",),
          ctes=_PRED_CTE + ",\n" + _PER_CLASS)
def q_weighted_f1(spark, sf):
    return round_doubles(SC.weighted_f1(_preds(spark, sf)))


@register("classification_report", """
SELECT class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f""",
          doubles=("precision", "recall", "f1"), ctes=_PRED_CTE + ",\n" + _PER_CLASS)
def q_classification_report(spark, sf):
    return round_doubles(SC.classification_report(_preds(spark, sf)))


# ----------------------------------------------------------------- flagship
def flagship(spark, sf):
    """Clean → dedup → label → filter → top-15 banks with an Other row."""
    return round_doubles(PR.top_k_other(final_reviews(spark, sf), "bank", 15))


def _flagship_sql() -> str:
    from .q_profile import _top_other_sql
    return _top_other_sql("final", "bank", 15)


register("flagship", _flagship_sql(), doubles=("pct",))(flagship)
