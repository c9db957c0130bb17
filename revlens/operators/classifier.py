"""Training data, stratified split and a text classifier (§2.11).

The classifier is a chain of Spark ML stages (tokenize → hashed term frequencies →
IDF → multinomial logistic regression): fitting is distributed tree
aggregation over the partitions, and every text is used whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import with_columns_once
from ..functions.labels import grade_to_label
from ..functions.text import clean_text
from .filters import drop_missing, filter_min_length, filter_status
from .shape import join_small, row_hash


def prepare_training(df: DataFrame, text: str = "review", grade: str = "grade", min_raw: int = 10,
                     min_clean: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """status filter → non-NULL text longer than ``min_raw`` → label from grade →
    cleaned text longer than ``min_clean`` → (cleaned_review, label)."""
    x = filter_status(df)
    x = drop_missing(x, [text])
    x = filter_min_length(x, text, min_raw)
    # computed once: the length filter must not re-run the clean-up regexes
    x = with_columns_once(x, {"label": grade_to_label(F.col(grade)), "cleaned_review": clean_text(F.col(text))})
    x = filter_min_length(x, "cleaned_review", min_clean)
    return x.select(*keep, "cleaned_review", "label")


# Rows of a border bucket that are ranked one by one; a larger bucket is counted again by a finer one.
BORDER_ROWS = 100_000


def stratified_split(df: DataFrame, label: str, key: str, seed: int = 42, test_frac: float = 0.2,
                     bucket_hex: int = 5) -> DataFrame:
    """Exact stratified split: in each label, the ``ceil(test_frac · n)`` rows
    with the smallest ``md5('<seed>:<key>')`` (then key, then row hash) are
    validation. Keys may repeat and be NULL: every row is a row of its own and
    comes out once. Rows without a label are never validation.

    No window ever spans a whole label. The hash prefix (``bucket_hex`` hex
    digits, 2^20 buckets) is counted per label; a running sum over those
    bucket counts (≤ 2^20 rows per label) finds the bucket where the cut
    falls, and only that bucket's rows (≈ n / 2^20) are ranked one by one. A
    bucket that many rows of one key fill is counted again, by the whole hash
    and then by prefixes of the row hash, before any row is ranked.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    x = df.withColumns({"_h": h, "_d": row_hash(df)})
    levels = [F.conv(F.substring("_h", 1, bucket_hex), 16, 10).cast("long"), F.col("_h"),
              F.shiftright("_d", 44), F.shiftright("_d", 24)]
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    settled = []
    for i, bucket in enumerate(levels):
        x = x.withColumn("_b", bucket)
        per_bucket = x.where(F.col(label).isNotNull()).groupBy(label, "_b").agg(
            F.count(F.lit(1)).alias("_c"), *([F.max("_need").alias("_k")] if i else []))
        if i == 0:
            sizes = per_bucket.groupBy(label).agg(F.sum("_c").alias("_n")) \
                              .select(label, F.ceil(F.col("_n").cast("double") * F.lit(test_frac)).cast("long").alias("_k"))
            per_bucket = per_bucket.join(sizes, on=label)
        cum = per_bucket.withColumn("_cum", F.sum("_c").over(w))
        cut = cum.where((F.col("_cum") - F.col("_c") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))) \
                 .select(label, F.col("_b").alias("_cut_b"), (F.col("_k") - (F.col("_cum") - F.col("_c"))).alias("_need"),
                         F.col("_c").alias("_in_cut")).checkpoint()
        # one row per label: broadcast, never a shuffle by label
        y = join_small(x.drop("_need"), cut.drop("_in_cut"), on=label, how="left")
        inside = F.coalesce(F.col("_b") == F.col("_cut_b"), F.lit(False))
        settled.append(y.where(~inside).withColumn("is_validation", F.coalesce(F.col("_b") < F.col("_cut_b"), F.lit(False))))
        x = y.where(inside).drop("_cut_b")
        if i == len(levels) - 1 or (cut.agg(F.max("_in_cut")).first()[0] or 0) <= BORDER_ROWS:
            break
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", key, "_d"))
    settled.append(x.withColumn("is_validation", rank <= F.col("_need")))
    cols = [f"`{c}`" for c in df.columns] + ["is_validation"]
    return reduce(DataFrame.unionAll, [p.select(*cols) for p in settled])


def text_classifier_stages(text: str = "cleaned_review", label: str = "label", num_features: int = 1 << 18,
                  reg_param: float = 0.0, max_iter: int = 50) -> Pipeline:
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"(?U)\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, predictionCol="prediction",
                            probabilityCol="probability", family="multinomial", regParam=reg_param,
                            maxIter=max_iter)
    return Pipeline(stages=[tok, tf, idf, lr])


def train_classifier(train: DataFrame, text: str = "cleaned_review", label: str = "label",
                     **params) -> PipelineModel:
    return text_classifier_stages(text, label, **params).fit(train)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    p = model.transform(df)
    return p.select(*keep, F.col("prediction").cast("int").alias("prediction"))


def predict_proba(model: PipelineModel, df: DataFrame, keep: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """``keep`` and one probability column per class name (class i is ``classes[i]``), from the text: the form that
    ``label_by_confidence`` and the metrics read."""
    p = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return p.select(*keep, *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(classes)])


def select_best_model(train: DataFrame, valid: DataFrame, grid: Sequence[dict], save_path: str | None = None,
                      text: str = "cleaned_review", label: str = "label"):
    """Fit each parameter set on the same split; the first strictly best
    validation accuracy wins; the winner is saved to ``save_path``.

    Texts are tokenised, hashed and weighted once per feature size, not once
    per candidate. Returns (model, rows) where rows are (candidate, params,
    train loss, train accuracy, validation accuracy, best).
    """
    features: dict[int, tuple] = {}
    best, best_acc, best_i, rows = None, -1.0, -1, []
    for i, params in enumerate(grid):
        stages = text_classifier_stages(text, label, **params).getStages()
        size = stages[1].getNumFeatures()
        if size not in features:
            fitted = Pipeline(stages=stages[:-1]).fit(train)
            features[size] = fitted, *(fitted.transform(d).select(label, "_features").checkpoint() for d in (train, valid))
        fitted, x_train, x_valid = features[size]
        head = stages[-1].fit(x_train)
        hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
        own = F.get(vector_to_array("probability"), F.col(label).cast("int"))
        loss, train_acc = head.transform(x_train).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-300)))), hit).first()
        acc = head.transform(x_valid).agg(hit).first()[0] or 0.0
        rows.append((i, str(sorted(params.items())), float(loss or 0.0), float(train_acc or 0.0), float(acc)))
        if acc > best_acc:
            best, best_acc, best_i = PipelineModel(stages=[*fitted.stages, head]), acc, i
    if save_path and best is not None:
        best.write().overwrite().save(save_path)
    return best, [(*r, r[0] == best_i) for r in rows]
