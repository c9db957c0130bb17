"""Registered plans: filters, projections (§2.3) and scalar functions (§2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (assign_bin, categorise_product, clean_text, date_parts, format_datetime_local,
                         grade_to_label, label_by_confidence, label_name, max_confidence, normalise_bank_pattern,
                         normalise_bank_unknown, parse_digits, parse_review_date, percent_label, softmax_array,
                         upper_strip)
from ..functions.labels import CONFIDENCE_EDGES
from ..functions.text import WS
from ..operators import filters as FL
from ..schemas import HEADER_NAMES
from .base import (labelled, register, reviews, round_doubles, sql_clean, sql_collapse, sql_grade_label,
                   sql_label, sql_softmax, sql_strip, table)

P3 = ("NEGATIVE", "NEUTRAL", "POSITIVE")
LAB = P3 + ()


# ----------------------------------------------------------------- filters
@register("filter_status", "SELECT * FROM reviews WHERE status = 'good'", doubles=P3)
def q_filter_status(spark, sf):
    return round_doubles(FL.filter_status(reviews(spark, sf)))


@register("drop_missing", "SELECT * FROM reviews WHERE convenience IS NOT NULL AND NEGATIVE IS NOT NULL "
          "AND NOT isnan(NEGATIVE)", doubles=P3)
def q_drop_missing(spark, sf):
    return round_doubles(FL.drop_missing(reviews(spark, sf), ["convenience", "NEGATIVE"]))


@register("filter_min_length", "SELECT review_id, length(review) AS n_chars FROM reviews WHERE length(review) > 10")
def q_filter_min_length(spark, sf):
    r = FL.filter_min_length(reviews(spark, sf), "review", 10)
    return r.select("review_id", F.length("review").alias("n_chars"))


@register("filter_in_set", "SELECT * FROM reviews WHERE bank IN ('src0', 'src1', 'src2')", doubles=P3)
def q_filter_in_set(spark, sf):
    return round_doubles(FL.filter_in_set(reviews(spark, sf), "bank", ["src0", "src1", "src2"]))


@register("filter_equals", "SELECT * FROM reviews WHERE product = 'fr'", doubles=P3)
def q_filter_equals(spark, sf):
    return round_doubles(FL.filter_equals(reviews(spark, sf), "product", "fr"))


@register("filter_optional", "SELECT * FROM labelled WHERE product = 'en' AND sentiment = 'NEGATIVE'", doubles=P3)
def q_filter_optional(spark, sf):
    settings = {"bank": "All", "product": "en", "city": "All", "sentiment": "NEGATIVE"}
    return round_doubles(FL.filter_optional(labelled(spark, sf), settings))


@register("filter_datetime_range",
          "SELECT * FROM labelled WHERE ts >= TIMESTAMP '2024-01-01 12:00:00' AND ts <= TIMESTAMP '2024-01-02 18:30:00'",
          doubles=P3)
def q_filter_datetime_range(spark, sf):
    return round_doubles(FL.filter_datetime_range(labelled(spark, sf), "ts", "2024-01-01T12:00", "2024-01-02T18:30"))


@register("filter_near_value", "SELECT * FROM reviews WHERE abs(NEGATIVE - 0.751) <= 0.001 + 1e-5 * 0.751",
          doubles=P3)
def q_filter_near_value(spark, sf):
    return round_doubles(FL.filter_near_value(reviews(spark, sf), "NEGATIVE", 0.751, 0.001))


@register("filter_contradiction", """
SELECT review_id, grade, sentiment FROM labelled
WHERE NOT (coalesce(grade IN (4, 5), false) AND sentiment IS NOT DISTINCT FROM 'NEGATIVE')""")
def q_filter_contradiction(spark, sf):
    return FL.filter_contradiction(labelled(spark, sf)).select("review_id", "grade", "sentiment")


@register("filter_untraced",
          "SELECT review_id, grade, sentiment FROM labelled WHERE sentiment IS DISTINCT FROM 'untraced'")
def q_filter_untraced(spark, sf):
    return FL.filter_untraced(labelled(spark, sf)).select("review_id", "grade", "sentiment")


@register("exclude_keys", """
SELECT * FROM reviews WHERE review_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)""",
          doubles=P3)
def q_exclude_keys(spark, sf):
    toxic = table(spark, sf, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("review_id"))
    return round_doubles(FL.exclude_keys(reviews(spark, sf), toxic, "review_id"))


@register("drop_columns", "SELECT * EXCLUDE (review) FROM reviews", doubles=P3)
def q_drop_columns(spark, sf):
    return round_doubles(FL.drop_columns(reviews(spark, sf), "review", "no_such_column"))


@register("project_columns", "SELECT bank, product, city, review, grade, sentiment FROM labelled")
def q_project_columns(spark, sf):
    return FL.project_columns(labelled(spark, sf), ["bank", "product", "city", "review", "grade", "sentiment"])


@register("require_columns", "SELECT * FROM reviews", doubles=P3)
def q_require_columns(spark, sf):
    return round_doubles(FL.require_columns(reviews(spark, sf), ["bank", "product", "review", "grade"]))


_DISPLAY = {c: HEADER_NAMES[c] for c in ("bank", "product", "city", "review", "grade")}


@register("rename_columns", "SELECT " + ", ".join(f'{c} AS "{h}"' for c, h in _DISPLAY.items()) + ", sentiment FROM labelled")
def q_rename_columns(spark, sf):
    return FL.rename_columns(labelled(spark, sf).select(*_DISPLAY, "sentiment"), _DISPLAY)


@register("empty_subset", "SELECT * FROM reviews WHERE bank = 'no such bank'", doubles=P3)
def q_empty_subset(spark, sf):
    return round_doubles(FL.empty_subset(reviews(spark, sf), F.col("bank") == "no such bank"))


# ----------------------------------------------------------------- scalars
@register("clean_text", f"SELECT review_id, {sql_clean('review')} AS cleaned_review FROM reviews")
def q_clean_text(spark, sf):
    return reviews(spark, sf).select("review_id", clean_text(F.col("review")).alias("cleaned_review"))


# Latin parameter sets for the name clean-up: the test texts are not Cyrillic,
# the reference's own values are the functions' defaults (tested by hand rows).
LATIN_UNKNOWN = dict(cut_suffix=".", replace=("the", "THE"), stop_words=["and", "de", "la", "und", "y", "the"])
LATIN_PATTERN = dict(marker=" the", delete="th", cut_suffix="s", replace=("ing", "ING"))


def _sql_remove_word(x: str, w: str) -> str:
    """Delete a word at Unicode word boundaries (RE2 has no look-behind, so the
    neighbours are captured and put back; two passes cover adjacent repeats)."""
    pat = "(^|[^\\p{L}\\p{N}_])(?i:" + w + ")([^\\p{L}\\p{N}_]|$)"
    once = lambda t: f"regexp_replace({t}, '{pat}', '\\1\\2', 'g')"
    return once(once(x))


def _sql_unknown(x: str, p: dict) -> str:
    s = sql_strip(x)
    words = f"regexp_split_to_array({s}, '[{WS}]+')"
    n = f"CASE WHEN {s} = '' THEN 0 ELSE len({words}) END"
    r = (f"CASE WHEN {n} >= 2 THEN array_to_string({words}[-2:], ' ') WHEN {n} = 1 THEN {words}[1] "
         f"ELSE 'Unknown' END")
    suf = p["cut_suffix"]
    r = f"(CASE WHEN suffix({r}, '{suf}') THEN left({r}, length({r}) - {len(suf)}) ELSE {r} END)"
    a, b = p["replace"]
    r = f"regexp_replace({r}, '(?i){a}', '{b}', 'g')"
    for w in p["stop_words"]:
        r = _sql_remove_word(r, w)
    return sql_collapse(r)


@register("normalise_bank_unknown",
          f"SELECT review_id, {_sql_unknown('review', LATIN_UNKNOWN)} AS bank_from_product FROM reviews")
def q_normalise_bank_unknown(spark, sf):
    return reviews(spark, sf).select(
        "review_id", normalise_bank_unknown(F.col("review"), **LATIN_UNKNOWN).alias("bank_from_product"))


def _sql_pattern(x: str, p: dict) -> str:
    cap = f"regexp_extract({x}, '{p['marker']}[{WS}]+([^{WS}]+[{WS}]+[^{WS}]+)', 1)"
    r = sql_collapse(f"replace({cap}, '{p['delete']}', '')")
    suf = p["cut_suffix"]
    a, b = p["replace"]
    r = (f"CASE WHEN suffix({r}, '{suf}') THEN left({r}, length({r}) - {len(suf)}) "
         f"ELSE regexp_replace({r}, '(?i){a}', '{b}', 'g') END")
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {cap} = '' THEN {x} ELSE {r} END"


@register("normalise_bank_pattern",
          f"SELECT review_id, CASE WHEN {_sql_pattern('review', LATIN_PATTERN)} = review THEN NULL "
          f"ELSE {_sql_pattern('review', LATIN_PATTERN)} END AS bank_from_title FROM reviews")
def q_normalise_bank_pattern(spark, sf):
    b = normalise_bank_pattern(F.col("review"), **LATIN_PATTERN)
    # an unmatched text comes back unchanged: report it as NULL to keep the result small
    return reviews(spark, sf).select("review_id", F.when(b != F.col("review"), b).alias("bank_from_title"))


CITY_CATEGORIES = [("UNITED", "union"), ("IA", "-ia"), ("AN", "-an"), ("A", "with a")]


@register("categorise_product", "SELECT review_id, CASE " + " ".join(
    f"WHEN contains(city, '{k}') THEN '{v}'" for k, v in CITY_CATEGORIES) + " ELSE city END AS category FROM reviews")
def q_categorise_product(spark, sf):
    return reviews(spark, sf).select("review_id", categorise_product(F.col("city"), CITY_CATEGORIES).alias("category"))


@register("grade_to_label", f"SELECT review_id, {sql_grade_label('CAST(grade AS VARCHAR)')} AS label FROM reviews")
def q_grade_to_label(spark, sf):
    return reviews(spark, sf).select("review_id", grade_to_label(F.col("grade").cast("string")).alias("label"))


@register("label_name", f"""
SELECT review_id, label, CASE label WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' WHEN 2 THEN 'Positive' END AS label_name
FROM (SELECT review_id, {sql_grade_label('grade')} AS label FROM reviews) t""")
def q_label_name(spark, sf):
    x = reviews(spark, sf).select("review_id", grade_to_label(F.col("grade")).alias("label"))
    return x.withColumn("label_name", label_name(F.col("label")))


_SEG_RX = "/([^/?#]*)([?#].*)?$"


@register("parse_digits", f"""
SELECT page_id, seg AS segment,
       CASE WHEN regexp_matches({sql_strip('seg')}, '^[0-9]+$') THEN TRY_CAST({sql_strip('seg')} AS BIGINT) END AS digits
FROM (SELECT page_id, regexp_extract(url, '{_SEG_RX}', 1) AS seg FROM pages) t""")
def q_parse_digits(spark, sf):
    seg = F.regexp_extract(F.col("url"), _SEG_RX, 1)
    return table(spark, sf, "pages").select("page_id", seg.alias("segment"), parse_digits(seg).alias("digits"))


@register("parse_review_date", "SELECT review_id, date, try_strptime(date, '%d.%m.%Y %H:%M') AS ts FROM reviews")
def q_parse_review_date(spark, sf):
    return reviews(spark, sf).select("review_id", "date", parse_review_date(F.col("date")).alias("ts"))


@register("date_parts", """
SELECT review_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, CAST(year(ts) AS INTEGER) AS year,
       dayname(ts) AS day_name, CAST(hour(ts) AS INTEGER) AS hour FROM labelled""")
def q_date_parts(spark, sf):
    p = date_parts(F.col("ts"))
    return labelled(spark, sf).select("review_id", *[c.alias(k) for k, c in p.items()])


@register("format_datetime_local",
          "SELECT review_id, coalesce(strftime(ts, '%Y-%m-%dT%H:%M'), '') AS dt_local FROM labelled")
def q_format_datetime_local(spark, sf):
    return labelled(spark, sf).select("review_id", format_datetime_local(F.col("ts")).alias("dt_local"))


_SM = sql_softmax(*[f"10 * CAST(embedding[{i}] AS DOUBLE)" for i in (1, 2, 3)])


@register("softmax_scores", f"SELECT vec_id, {_SM[0]} AS NEGATIVE, {_SM[1]} AS NEUTRAL, {_SM[2]} AS POSITIVE "
          "FROM embeddings", doubles=P3)
def q_softmax_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    logits = F.transform(F.slice(F.col("embedding"), 1, 3), lambda x: F.lit(10.0) * x.cast("double"))
    p = softmax_array(logits)
    return round_doubles(e.select("vec_id", *[p[i].alias(n) for i, n in enumerate(P3)]))


@register("max_confidence", "SELECT review_id, greatest(NEGATIVE, NEUTRAL, POSITIVE) AS max_confidence FROM reviews",
          doubles=("max_confidence",))
def q_max_confidence(spark, sf):
    return round_doubles(reviews(spark, sf).select("review_id", max_confidence().alias("max_confidence")))


@register("label_by_confidence", f"SELECT review_id, {sql_label()} AS sentiment FROM reviews")
def q_label_by_confidence(spark, sf):
    return reviews(spark, sf).select("review_id", label_by_confidence().alias("sentiment"))


@register("upper_strip", f"SELECT review_id, {sql_strip('upper(product)')} AS product_code FROM reviews")
def q_upper_strip(spark, sf):
    return reviews(spark, sf).select("review_id", upper_strip(F.col("product")).alias("product_code"))


_BIN_SQL = "CASE " + " ".join(
    f"WHEN m > {CONFIDENCE_EDGES[i]} AND m <= {CONFIDENCE_EDGES[i + 1]} THEN {i}"
    for i in range(len(CONFIDENCE_EDGES) - 1)) + " END"


@register("assign_bin", f"SELECT review_id, m AS max_confidence, {_BIN_SQL} AS bin "
          "FROM (SELECT review_id, greatest(NEGATIVE, NEUTRAL, POSITIVE) AS m FROM reviews) t",
          doubles=("max_confidence",))
def q_assign_bin(spark, sf):
    x = reviews(spark, sf).select("review_id", max_confidence().alias("max_confidence"))
    return round_doubles(x.withColumn("bin", assign_bin(F.col("max_confidence"))))


@register("percent_label", """
SELECT product, "count",
       CAST("count" AS VARCHAR) || ' (' || CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%)' AS label
FROM (SELECT product, "count", (2000 * "count" + total) // (2 * total) AS t
      FROM (SELECT product, count(*) AS "count", sum(count(*)) OVER () AS total FROM reviews
            WHERE product IS NOT NULL GROUP BY product) a) b""")
def q_percent_label(spark, sf):
    r = reviews(spark, sf).where(F.col("product").isNotNull())
    counts = r.groupBy("product").agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.select("product", "count", percent_label(F.col("count"), total).alias("label"))
