"""The whole build of the review table as one plan: pages → records → clean names → one row per text → scores →
label → filters (SURVEY §3A). Only the extraction is stored on the way, as two later steps read it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import categorise_product, label_by_confidence, normalise_bank, softmax_probs, with_columns_once
from ..functions.text import PRODUCT_CATEGORIES
from ..operators.extract import extract_pages
from ..operators.filters import drop_missing, filter_contradiction, filter_status, filter_untraced
from ..operators.shape import dedup_keep_first, join_scores
from ..session import checkpoint_root
from .base import register, sql_label, sql_softmax, table
from .q_clean import LATIN_PATTERN, LATIN_UNKNOWN, _sql_pattern, _sql_unknown
from .q_io import _ARTICLE, _MARKS, _PARAGRAPHS, _sql_between, _sql_element, _sql_title

P3 = ("NEGATIVE", "NEUTRAL", "POSITIVE")


def build_reviews(pages: DataFrame, scores: DataFrame, rules: Mapping | None = None, title_marks: tuple = ("–", "от"),
                  unknown_kw: Mapping | None = None, pattern_kw: Mapping | None = None,
                  categories: Sequence = PRODUCT_CATEGORIES) -> DataFrame:
    """pages(page_id, url, html) and scores(page_id, class probabilities) → the labelled review table.

    Pages that cannot be read and rows without a review or bank go; bank and
    product names are normalised; of equal reviews the one with the smallest
    page id stays; rows without scores keep a NULL label; contradictory and
    untraced rows go. ``scores`` comes from any model: ``score_text``, or
    ``classifier.predict_proba`` over the same texts.
    """
    rec = extract_pages(pages, dict(rules or {}), *title_marks,
                        fields=["review", "grade", "product", "city", "date", "bank"])
    checkpoint_root(pages.sparkSession)
    rec = drop_missing(filter_status(rec), ["review", "bank"]).checkpoint()
    bank = normalise_bank(F.col("bank"), F.col("product"), unknown_kw=unknown_kw, pattern_kw=pattern_kw)
    x = rec.withColumn("bank", bank).withColumn("product", categorise_product(F.col("product"), categories))
    x = join_scores(dedup_keep_first(x, "review", "page_id"), scores, "page_id")
    x = with_columns_once(x, {"sentiment": label_by_confidence()})
    return filter_untraced(filter_contradiction(x))


# The stored pages are not Cyrillic: Latin words in place of the fixed ones, as for the single functions.
CATEGORIES = [("the", "with the"), ("que", "with que"), ("und", "with und"), ("de", "with de")]
_SM = sql_softmax(*[f"10 * CAST(v.embedding[{i}] AS DOUBLE)" for i in (1, 2, 3)])


@register("review_build", """
SELECT page_id, bank, product, n_chars, grade, sentiment FROM labelled_pages WHERE sentiment IS DISTINCT FROM 'untraced'
""", ctes=f"""raw_pages AS (
  SELECT page_id, {_sql_between('title', *_MARKS)} AS bank, h1 AS product, review FROM (
    SELECT page_id, {_sql_title()} AS title, {_sql_element('h1')} AS h1, array_to_string({_PARAGRAPHS}, '') AS review
    FROM pages WHERE {_ARTICLE} <> '') t),
clean_pages AS (
  SELECT page_id, review, CASE WHEN bank = 'Unknown' THEN {_sql_unknown('product', LATIN_UNKNOWN)}
         ELSE {_sql_pattern('bank', LATIN_PATTERN)} END AS bank,
         CASE {' '.join(f"WHEN contains(product, '{k}') THEN '{v}'" for k, v in CATEGORIES)} ELSE product END AS product
  FROM raw_pages QUALIFY row_number() OVER (PARTITION BY review ORDER BY page_id) = 1),
scored_pages AS (
  SELECT c.*, {_SM[0]} AS NEGATIVE, {_SM[1]} AS NEUTRAL, {_SM[2]} AS POSITIVE
  FROM clean_pages c LEFT JOIN embeddings v ON v.vec_id = c.page_id),
labelled_pages AS (
  SELECT page_id, bank, product, length(review) AS n_chars, CAST(0 AS BIGINT) AS grade, {sql_label()} AS sentiment
  FROM scored_pages)""")
def q_review_build(spark, sf):
    v = table(spark, sf, "embeddings")
    probs = softmax_probs([F.lit(10.0) * F.col("embedding")[i].cast("double") for i in range(3)])
    scores = v.select(F.col("vec_id").alias("page_id"), *[p.alias(n) for p, n in zip(probs, P3)])
    x = build_reviews(table(spark, sf, "pages"), scores, title_marks=_MARKS, unknown_kw=LATIN_UNKNOWN,
                      pattern_kw=LATIN_PATTERN, categories=CATEGORIES)
    return x.select("page_id", "bank", "product", F.length("review").alias("n_chars"), "grade", "sentiment")
