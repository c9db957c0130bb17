"""Registered plans: sources and sinks (§2.1), page extraction (§2.2), streaming (§2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.extract import GROUP_FIELDS, extract_pages
from ..operators.filters import filter_unknown_bank, rename_columns
from ..schemas import HEADER_NAMES, REVIEWS
from ..session import scratch_path
from ..sources import (append_once, ingest_summary, page_batches, page_url_range, read_committed, scan_csv,
                       scan_csv_inferred, scan_csv_renamed, scan_csv_split, sink_csv_append, sink_csv_overwrite, sink_json)
from ..sources.files import scan_json
from ..sources.pages import DEFAULT_BASE_URL
from ..streaming import (ingest_exactly_once, ingest_incremental, stage_files, stream_counts, stream_dedup,
                         stream_keep_first)
from .base import register, reviews, round_doubles, sql_strip, table

P3 = ("NEGATIVE", "NEUTRAL", "POSITIVE")


# ----------------------------------------------------------------- files
@register("scan_csv", "SELECT * FROM reviews", doubles=P3)
def q_scan_csv(spark, sf):
    path = sink_csv_overwrite(reviews(spark, sf), scratch_path(spark, "scan-csv"))
    return round_doubles(scan_csv(spark, path, REVIEWS))


@register("scan_csv_split", "SELECT * FROM reviews", doubles=P3)
def q_scan_csv_split(spark, sf):
    """Texts with quotes, commas and line breaks, read back by as many tasks as the files have splits."""
    path = sink_csv_overwrite(reviews(spark, sf), scratch_path(spark, "scan-split"))
    return round_doubles(scan_csv_split(spark, path, REVIEWS))


_INTS = [f.name for f in REVIEWS.fields if isinstance(f.dataType, (T.IntegerType, T.LongType))]


@register("scan_csv_inferred", "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _INTS)
          + ") FROM reviews", doubles=P3, note="no schema is given: types follow from all values")
def q_scan_csv_inferred(spark, sf):
    path = sink_csv_overwrite(reviews(spark, sf), scratch_path(spark, "scan-inferred"))
    return round_doubles(scan_csv_inferred(spark, path))


@register("scan_csv_renamed", "SELECT * FROM reviews", doubles=P3)
def q_scan_csv_renamed(spark, sf):
    header = {c: HEADER_NAMES.get(c, c) for c in REVIEWS.fieldNames()}
    path = sink_csv_overwrite(rename_columns(reviews(spark, sf), header), scratch_path(spark, "scan-csv-renamed"))
    back = {h: c for c, h in header.items()}
    return round_doubles(scan_csv_renamed(spark, path, back, REVIEWS))


@register("sink_csv_append", "SELECT * FROM reviews", doubles=P3)
def q_sink_csv_append(spark, sf):
    path = scratch_path(spark, "csv-append")
    r = reviews(spark, sf)
    sink_csv_append(r.where(F.col("status") == "good"), path)
    sink_csv_append(r.where(~(F.col("status") == "good") | F.col("status").isNull()), path)
    return round_doubles(scan_csv(spark, path, REVIEWS))


@register("sink_csv_overwrite", "SELECT * FROM reviews", doubles=P3)
def q_sink_csv_overwrite(spark, sf):
    path = scratch_path(spark, "csv-overwrite")
    r = reviews(spark, sf)
    sink_csv_overwrite(r.where(F.col("status") == "error"), path)
    sink_csv_overwrite(r, path)
    return round_doubles(scan_csv(spark, path, REVIEWS))


@register("sink_json", "SELECT *, true AS has_timestamp FROM reviews", doubles=P3)
def q_sink_json(spark, sf):
    path = sink_json(reviews(spark, sf), scratch_path(spark, "json"))
    schema = T.StructType(REVIEWS.fields + [T.StructField("timestamp", T.DoubleType())])
    back = scan_json(spark, path, schema)
    return round_doubles(back.withColumn("has_timestamp", F.col("timestamp").isNotNull()).drop("timestamp"))


def _page_bounds(spark, sf):
    b = table(spark, sf, "pages").agg(F.min("page_id").alias("s"), F.max("page_id").alias("e")).first()
    return int(b["s"]), int(b["e"])


@register("page_url_range", f"SELECT page_id, '{DEFAULT_BASE_URL}' || CAST(page_id AS VARCHAR) AS url FROM "
          "(SELECT unnest(range(min(page_id), max(page_id) + 1)) AS page_id FROM pages) t")
def q_page_url_range(spark, sf):
    s, e = _page_bounds(spark, sf)
    return page_url_range(spark, s, e)


@register("page_batches", """
SELECT b AS batch_id, s + b * 10 AS batch_start, least(s + b * 10 + 9, e) AS batch_end, b = 0 AS is_first
FROM (SELECT unnest(range(0, (max(page_id) - min(page_id)) // 10 + 1)) AS b, min(page_id) AS s, max(page_id) AS e
      FROM pages) t""")
def q_page_batches(spark, sf):
    s, e = _page_bounds(spark, sf)
    return page_batches(spark, s, e, 10)


@register("ingest_summary", "SELECT count(*) AS pages_total, count(DISTINCT url) AS unique_urls FROM pages")
def q_ingest_summary(spark, sf):
    return ingest_summary(table(spark, sf, "pages"))


# ----------------------------------------------------------------- extraction
def _pages(spark, sf, *fields):
    return extract_pages(table(spark, sf, "pages"), fields=fields)


_DECODE = [("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"),
           ("&nbsp;", " "), ("&amp;", "&")]


def _sql_decode(t: str) -> str:
    for ent, ch in _DECODE:
        t = f"replace({t}, '{ent}', '{ch}')"
    return t


def _sql_text(inner: str) -> str:
    """Text of an element's inner HTML: line breaks kept, tags dropped, entities decoded, stripped."""
    return sql_strip(_sql_decode(f"regexp_replace(replace({inner}, '<br>', chr(10)), '<[^>]*>', '', 'g')"))


_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"
# a paragraph begins at <p> and ends at the next <p> or </p>
_PARAGRAPHS = (f"list_transform(string_split({_ARTICLE}, '<p>')[2:], "
               f"lambda x: {_sql_text('regexp_replace(x, $$(?s)</p>.*$$, $$$$)')} || ' ')")


def _sql_title(html: str = "html") -> str:
    t = _sql_decode(f"regexp_extract({html}, '(?s)<title[^>]*>(.*?)</title>', 1)")
    return f"CASE WHEN regexp_matches({html}, '(?s)<title[^>]*>.*?</title>') THEN {sql_strip(t)} ELSE 'No title' END"


@register("extract_title", f"SELECT page_id, {_sql_title()} AS title FROM pages")
def q_extract_title(spark, sf):
    return _pages(spark, sf, "title").select("page_id", "title")


@register("extract_paragraphs", f"SELECT page_id, CASE WHEN html LIKE '%<article%' THEN array_to_string({_PARAGRAPHS}, '') "
          "ELSE '' END AS review FROM pages")
def q_extract_paragraphs(spark, sf):
    return _pages(spark, sf, "review").select("page_id", "review")


@register("extract_class_rating", "SELECT page_id, CASE WHEN page_id % 7 < 6 THEN page_id * 1000003 ELSE 0 END AS grade, "
          "page_id % 7 BETWEEN 1 AND 5 AS grade_accepted FROM pages WHERE html LIKE '%<article%'")
def q_extract_class_rating(spark, sf):
    # the stored pages carry no rating mark: one is put into each article, with a step and a value from the page id
    p = F.col("page_id")
    mark = F.concat(F.lit('<div class="x grade-'), (p % 7).cast("string"), F.lit('"> '),
                    (p * 1000003).cast("string"), F.lit(" </div></article>"))
    pages = table(spark, sf, "pages").withColumn("html", F.replace(F.col("html"), F.lit("</article>"), mark))
    rec = extract_pages(pages, {"rating_prefix": "div[class^='x grade-{i}']"}, fields=["grade", "grade_accepted"])
    return rec.where("status = 'good'").select("page_id", "grade", "grade_accepted")


def _sql_element(tag: str) -> str:
    return (f"CASE WHEN html LIKE '%<{tag}%' THEN "
            + _sql_text(f"regexp_extract(html, '(?s)<{tag}[^>]*>(.*?)</{tag}>', 1)") + " ELSE 'Unknown' END")


@register("extract_text_default", f"SELECT page_id, {_sql_element('h1')} AS product, {_sql_element('footer')} AS city, "
          "'0' AS date FROM pages WHERE html LIKE '%<article%'")
def q_extract_text_default(spark, sf):
    rec = _pages(spark, sf, "product", "city", "date").where("status = 'good'")
    return rec.select("page_id", "product", "city", "date")


def _sql_between(t: str, a: str, b: str, default: str = "Unknown") -> str:
    s = f"instr({t}, '{a}')"
    rel = f"instr(substr({t}, {s} + {len(a)}), '{b}')"
    e = f"({s} + {len(a)} + {rel} - 1)"
    inner = sql_strip(f"substr({t}, {s} + {len(a)}, {e} - {s} - {len(a)})")
    return f"CASE WHEN {s} > 0 AND {rel} > 0 THEN {inner} ELSE '{default}' END"


_MARKS = ("***", "###")


@register("extract_between", f"SELECT page_id, {_sql_between('title', *_MARKS)} AS between_marks "
          f"FROM (SELECT page_id, {_sql_title()} AS title FROM pages) t")
def q_extract_between(spark, sf):
    from ..functions import extract_between
    return _pages(spark, sf, "title").select("page_id", extract_between(F.col("title"), *_MARKS).alias("between_marks"))


@register("filter_unknown_bank", f"SELECT page_id, bank FROM (SELECT page_id, {_sql_between('title', *_MARKS)} AS bank "
          f"FROM (SELECT page_id, {_sql_title()} AS title FROM pages) t) u WHERE bank IS DISTINCT FROM 'Unknown'")
def q_filter_unknown_bank(spark, sf):
    recs = extract_pages(table(spark, sf, "pages"), title_start=_MARKS[0], title_end=_MARKS[1],
                         fields=["bank"])
    return filter_unknown_bank(recs).select("page_id", "bank")


@register("extract_group_counts", """
SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<li[ >]')) AS INTEGER)
         AS group_1, 0 AS group_2, 0 AS group_3, 0 AS group_4 FROM pages""")
def q_extract_group_counts(spark, sf):
    return _pages(spark, sf, *GROUP_FIELDS).select("page_id", F.col("clear_conditions").alias("group_1"),
                                    F.col("polite_employee").alias("group_2"), F.col("availability").alias("group_3"),
                                    F.col("convenience").alias("group_4"))


@register("extract_status", """
SELECT CASE WHEN html IS NULL OR html = '' THEN 'Error:No content' WHEN html LIKE '%<article%' THEN 'good'
            ELSE 'Error:no element matches article' END AS status, count(*) AS "count" FROM pages GROUP BY 1""")
def q_extract_status(spark, sf):
    return _pages(spark, sf, "status").groupBy("status").agg(F.count(F.lit(1)).alias("count"))


# ----------------------------------------------------------------- streaming
# Rows per file of a derived table that is replayed as a stream.
ROWS_PER_FILE = 1_000_000


@register("ingest_incremental", "SELECT * FROM reviews", doubles=P3)
def q_ingest_incremental(spark, sf):
    src = stage_files(reviews(spark, sf), scratch_path(spark, "ingest-src"), ROWS_PER_FILE)
    return round_doubles(ingest_incremental(spark, src, REVIEWS))


@register("ingest_exactly_once", "SELECT * FROM reviews", doubles=P3,
          note="every batch is handed out twice, by two streams under one writer")
def q_ingest_exactly_once(spark, sf):
    src = stage_files(reviews(spark, sf), scratch_path(spark, "once-src"), ROWS_PER_FILE)
    table_ = scratch_path(spark, "once-table")
    for _ in range(2):          # the second has lost its checkpoint and hands out all batches again
        got = ingest_exactly_once(spark, src, REVIEWS, table_)
    return round_doubles(got)


@register("append_once", "SELECT * FROM reviews", doubles=P3, note="a job that runs twice appends its CSV parts once")
def q_append_once(spark, sf):
    path, r = scratch_path(spark, "append-once"), reviews(spark, sf)
    good = F.coalesce(F.col("status") == "good", F.lit(False))
    for _ in range(2):
        append_once(r.where(good), path, "job", 0, "csv")
        append_once(r.where(~good), path, "job", 1, "csv")
    return round_doubles(read_committed(spark, path, REVIEWS))


_EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _events_path(sf):
    return f"{sf.rstrip('/')}/events.parquet"


@register("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def q_stream_dedup(spark, sf):
    return stream_dedup(spark, _events_path(sf), _EVENTS, ["user_id", "event_type"], "ts").select("user_id", "event_type")


@register("stream_keep_first", "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER "
          "(PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def q_stream_keep_first(spark, sf):
    """The first event of every (user, type), held until no earlier one can come: here, for the whole span of events."""
    span = table(spark, sf, "events").agg(F.max("ts"), F.min("ts")).first()
    days = (span[0] - span[1]).days + 1 if span[0] else 1
    ids = T.StructType([f for f in _EVENTS.fields if f.name in ("event_id", "ts", "user_id", "event_type")])
    got = stream_keep_first(spark, _events_path(sf), ids, ["user_id", "event_type"], "ts", f"{days} days")
    return got.select("user_id", "event_type", "event_id", "ts")


@register("stream_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, "
          "CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS window_end, count(*) AS \"count\" "
          "FROM events GROUP BY 1, 2")
def q_stream_counts(spark, sf):
    return stream_counts(spark, _events_path(sf), _EVENTS, "ts", "1 day")
