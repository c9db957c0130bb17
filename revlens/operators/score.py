"""Batch scoring and classifier evaluation (§2.11).

Scoring goes through ``predict_batch_udf``: the caller's model is loaded once
per Python worker and fed Arrow batches, never one text at a time. Metrics
are aggregates over (label, prediction) pairs: a 3×3 confusion table is all
that ever reaches a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import CLASS_NAMES, LABEL_NAMES



def score_text(df: DataFrame, make_predict_fn: Callable, input_col: str, classes: Sequence[str] = CLASS_NAMES,
               batch_size: int = 256, input_shape: Sequence[int] | None = None) -> DataFrame:
    """Append one probability column per class, computed by the model that
    ``make_predict_fn()`` loads (once per worker). The predict function takes a
    NumPy batch and returns ``{class: probabilities}``."""
    rt = T.StructType([T.StructField(c, T.DoubleType()) for c in classes])
    udf = predict_batch_udf(make_predict_fn, return_type=rt, batch_size=batch_size,
                            input_tensor_shapes=[list(input_shape)] if input_shape else None)
    return df.withColumn("_scores", udf(F.col(input_col))).select(
        *[c for c in df.columns], *[F.col(f"_scores.{c}").alias(c) for c in classes])


def embedding_head_model(classes: Sequence[str] = CLASS_NAMES, scale: float = 10.0):
    """Stand-in model factory: softmax over ``scale ×`` the first len(classes)
    components of an embedding. Real callers pass a factory that loads their
    own model (ONNX, a fitted Spark ML model, …)."""
    k = len(classes)

    def make():
        def predict(x: np.ndarray):
            z = scale * x[:, :k].astype(np.float64)
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            p = e / e.sum(axis=1, keepdims=True)
            return {c: p[:, i] for i, c in enumerate(classes)}
        return predict

    return make


def _prob_of_label(label: Column, prob_cols: Sequence[str]) -> Column:
    out = None
    for i, c in enumerate(prob_cols):
        out = F.when(label == i, F.col(c)) if out is None else out.when(label == i, F.col(c))
    return out


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def mean_log_loss(pred: DataFrame, label: str = "label", prob_cols: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Mean cross-entropy −ln p(true class), a true per-row mean."""
    p = _prob_of_label(F.col(label), prob_cols)
    return pred.agg(F.avg(-F.ln(p)).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def _per_class(pred: DataFrame, label: str, prediction: str, classes: Sequence[int]) -> DataFrame:
    conf = pred.groupBy(F.col(label).alias("_y"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    aggs = []
    for c in classes:
        aggs += [F.sum(F.when((F.col("_y") == c) & (F.col("_p") == c), F.col("_n")).otherwise(0)).alias(f"tp{c}"),
                 F.sum(F.when(F.col("_y") == c, F.col("_n")).otherwise(0)).alias(f"sup{c}"),
                 F.sum(F.when(F.col("_p") == c, F.col("_n")).otherwise(0)).alias(f"prd{c}")]
    row = conf.agg(*aggs)
    structs = []
    for c in classes:
        tp, sup, prd = (F.col(f"{k}{c}").cast("double") for k in ("tp", "sup", "prd"))
        prec = F.coalesce(F.try_divide(tp, prd), F.lit(0.0))
        rec = F.coalesce(F.try_divide(tp, sup), F.lit(0.0))
        structs.append(F.struct(F.lit(c).alias("class_id"), F.lit(LABEL_NAMES.get(c, str(c))).alias("class"),
                                prec.alias("precision"), rec.alias("recall"),
                                F.coalesce(F.try_divide(F.lit(2.0) * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
                                F.col(f"sup{c}").cast("long").alias("support"),
                                F.col(f"tp{c}").cast("long").alias("tp")))
    return row.select(F.inline(F.array(*structs)))


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and
    support-weighted averages (zero division → 0)."""
    pc = _per_class(pred, label, prediction, classes)
    summary = pc.agg(F.sum("tp").alias("_tp"), F.sum("support").alias("_n"),
                     F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
                     F.sum(F.col("precision") * F.col("support")).alias("_wp"),
                     F.sum(F.col("recall") * F.col("support")).alias("_wr"),
                     F.sum(F.col("f1") * F.col("support")).alias("_wf"))
    n = F.col("_n").cast("double")
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.try_divide(F.col("_tp").cast("double"), n).alias("f1"),
                 F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("_mp").alias("precision"), F.col("_mr").alias("recall"),
                 F.col("_mf").alias("f1"), F.col("_n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.try_divide(F.col("_wp"), n).alias("precision"),
                 F.try_divide(F.col("_wr"), n).alias("recall"), F.try_divide(F.col("_wf"), n).alias("f1"),
                 F.col("_n").cast("long").alias("support")))
    per = pc.select("class", "precision", "recall", "f1", "support")
    return per.unionByName(summary.select(F.inline(rows)))


def weighted_f1(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                classes: Sequence[int] = (0, 1, 2)) -> DataFrame:
    pc = _per_class(pred, label, prediction, classes)
    return pc.agg(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double"))
                  .alias("weighted_f1"))
