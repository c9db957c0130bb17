"""Shared inputs of the registered plans, written twice: as Spark DataFrames
and as DuckDB SQL common table expressions over the same parquet tables.

The SQL helpers restate each scalar function independently in DuckDB syntax;
they are the oracle's side and never run on Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import label_by_confidence, parse_review_date, upper_strip, with_columns_once
from ..functions.text import WS
from ..operators.filters import drop_missing, filter_contradiction, filter_status, filter_untraced
from ..operators.shape import dedup_keep_first
from ..sources.tables import TEXT_HASHES, load_table, reviews_standin


# ---------------------------------------------------------------- registry
@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: tuple = ()
    ctes: str = ""
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None = None, doubles=(), ctes: str = "", note: str = ""):
    def deco(fn):
        if key in REGISTRY:
            raise KeyError(f"duplicate key {key}")
        REGISTRY[key] = Entry(fn, sql, tuple(doubles), ctes, note)
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every top-level double column (both engines compare at 6 places)."""
    cols = [F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


# ---------------------------------------------------------------- Spark side
def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return reviews_standin(spark, sf)


def labelled(spark: SparkSession, sf: str, text_hashes: bool = False) -> DataFrame:
    return with_columns_once(reviews_standin(spark, sf, text_hashes=text_hashes), {"sentiment": label_by_confidence(),
                                                   "ts": parse_review_date(F.col("date"))})


def dated(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews with the parsed time and without class scores: time series read no embedding."""
    return with_columns_once(reviews_standin(spark, sf, scores=False), {"ts": parse_review_date(F.col("date"))})


def final_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned, labelled table: good status, text present, one row per
    text (earliest id), no contradiction, no untraced label. Texts are told
    apart by hashes taken before the joins, so a query that shows no text
    sends none through an exchange."""
    x = drop_missing(filter_status(labelled(spark, sf, text_hashes=True)), ["review"])
    x = dedup_keep_first(x, "review", "review_id", hashed=TEXT_HASHES).drop(*TEXT_HASHES)
    return filter_untraced(filter_contradiction(x))


def hypothesis_base(spark: SparkSession, sf: str) -> DataFrame:
    """Good rows with bank, product and a sentiment among the three classes."""
    x = drop_missing(filter_status(labelled(spark, sf)), ["bank", "product", "sentiment"])
    x = x.withColumn("sentiment", upper_strip(F.col("sentiment")))
    return x.where(F.col("sentiment").isin("NEGATIVE", "NEUTRAL", "POSITIVE"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, sf, name)


# ---------------------------------------------------------------- SQL side
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def sql_clean(x: str) -> str:
    return f"coalesce(lower({sql_collapse(f'regexp_replace({x}, {chr(39)}http[^{WS}]+{chr(39)}, {chr(39)}{chr(39)}, {chr(39)}g{chr(39)})')}), '')"


def sql_label(n="NEGATIVE", u="NEUTRAL", p="POSITIVE", cut="0.75") -> str:
    m = f"greatest({n}, {u}, {p})"
    return (f"CASE WHEN {m} IS NULL THEN NULL WHEN {m} < {cut} THEN 'untraced' WHEN {m} = {p} THEN 'POSITIVE' "
            f"WHEN {m} = {n} THEN 'NEGATIVE' ELSE 'NEUTRAL' END")


def sql_grade_label(g: str) -> str:
    gi = f"TRY_CAST({g} AS BIGINT)"
    return (f"CASE WHEN {gi} IS NULL THEN 1 WHEN {gi} IN (0, 1, 2) THEN 0 WHEN {gi} = 3 THEN 1 ELSE 2 END")


def sql_softmax(l0: str, l1: str, l2: str) -> tuple[str, str, str]:
    m = f"greatest({l0}, {l1}, {l2})"
    e = [f"exp({x} - {m})" for x in (l0, l1, l2)]
    den = f"({e[0]} + {e[1]} + {e[2]})"
    return tuple(f"{x} / {den}" for x in e)


def sql_pct(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST({num} AS DOUBLE) * 100.0 / ({den}) END"


_NEG, _NEU, _POS = sql_softmax("l0", "l1", "l2")

REVIEWS_CTE = f"""reviews AS (
  SELECT review_id, bank, product, city, review, date, status, grade, clear_conditions, polite_employee,
         availability, convenience, {_NEG} AS NEGATIVE, {_NEU} AS NEUTRAL, {_POS} AS POSITIVE
  FROM (
    SELECT d.doc_id AS review_id, d.source AS bank, d.lang AS product, n.n_name AS city, d.text AS review,
           strftime(e.ts, '%d.%m.%Y %H:%M') AS date,
           CASE WHEN e.event_type = 'error' THEN 'error' ELSE 'good' END AS status,
           CAST(least(5, floor(e.value / 25)) AS INTEGER) AS grade,
           CAST(1 + d.n_chars % 5 AS INTEGER) AS clear_conditions,
           CAST(1 + e.user_id % 5 AS INTEGER) AS polite_employee,
           CAST(1 + CAST(floor(e.value) AS BIGINT) % 5 AS INTEGER) AS availability,
           CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE CAST(least(5, 1 + floor(e.value / 25)) AS INTEGER) END
             AS convenience,
           10 * CAST(v.embedding[1] AS DOUBLE) AS l0, 10 * CAST(v.embedding[2] AS DOUBLE) AS l1,
           10 * CAST(v.embedding[3] AS DOUBLE) AS l2
    FROM documents d JOIN events e ON e.event_id = d.doc_id
    LEFT JOIN embeddings v ON v.vec_id = d.doc_id
    LEFT JOIN customer c ON c.c_custkey = e.user_id
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  ) x
)"""

LABELLED_CTE = f"""labelled AS (
  SELECT *, {sql_label()} AS sentiment, try_strptime(date, '%d.%m.%Y %H:%M') AS ts FROM reviews
)"""

FINAL_CTE = """final AS (
  SELECT * FROM (
    SELECT * FROM labelled WHERE status = 'good' AND review IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY review ORDER BY review_id) = 1
  ) q
  WHERE NOT (coalesce(grade IN (4, 5), false) AND sentiment IS NOT DISTINCT FROM 'NEGATIVE')
    AND sentiment IS DISTINCT FROM 'untraced'
)"""

HYP_CTE = f"""hyp AS (
  SELECT * REPLACE ({sql_strip('upper(sentiment)')} AS sentiment) FROM labelled
  WHERE status = 'good' AND bank IS NOT NULL AND product IS NOT NULL AND sentiment IS NOT NULL
    AND {sql_strip('upper(sentiment)')} IN ('NEGATIVE', 'NEUTRAL', 'POSITIVE')
)"""

BASE_CTES = ",\n".join([REVIEWS_CTE, LABELLED_CTE, FINAL_CTE, HYP_CTE])


def full_sql(e: Entry) -> str | None:
    if e.sql is None:
        return None
    ctes = BASE_CTES + (",\n" + e.ctes if e.ctes else "")
    body = e.sql.strip().rstrip(";")
    if e.doubles:
        rep = ", ".join(f'round("{c}", 6) AS "{c}"' for c in e.doubles)
        return f"WITH {ctes}\nSELECT * REPLACE ({rep}) FROM (\n{body}\n) _q"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
