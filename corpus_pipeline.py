"""A training corpus from raw documents: five stages over the operators of ``revlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as Parquet below the
shared checkpoint folder and hands the next stage what it reads back. All but the last return the columns of
``documents``. A stage that changes a text also brings ``n_chars`` up to date where the table has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import fresh, row_key, stored
from revlens.llm.packing import pack_documents
from revlens.llm.pii import redact
from revlens.llm.quality_classifier import MIN_SCORE, classify
from revlens.llm.sentence_spans import remove_repeats
from revlens.llm.simhash import near_duplicates


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; so do null and blank texts."""
    score = fresh(docs, "p_good")
    return classify(docs, score_col=score).where(F.col(score) >= MIN_SCORE).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document stays: the one with the smallest id (none comes last), of those
    that share it the one with the smallest hash of its text, and of equal rows one. Null and empty texts are copies of
    each other. An empty table stays empty."""
    k1, k2 = (fresh(docs, n) for n in ("k1", "k2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")).alias("f")
    kept = near_duplicates(docs).groupBy("root").agg(first).select(F.col("f.k1").alias(k1), F.col("f.k2").alias(k2))
    keys = [c.alias(n) for c, n in zip(row_key("doc_id", "text"), (k1, k2))]
    found = docs.select("*", *keys).join(kept, [k1, k2], "left_semi")
    copy = fresh(docs, "copy")
    number = F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.lit(1)))
    return found.withColumn(copy, number).where(F.col(copy) == 1).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences that earlier documents hold go out of the text; the document stays, null and empty texts as they are.
    A copy that is equal in id and text loses every sentence of a span. An empty table stays empty."""
    return _recount(remove_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, in every row by itself; null texts stay null. An empty table
    stays empty."""
    return _recount(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in the packed sequences. Null and empty texts are pieces of one id; equal rows are packed
    each for itself. An empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

# No stage but the last two could be stated in SQL at all, and those read what the others make.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
