"""Every registered plan against its DuckDB statement on sf0.001 (the oracle layer)."""

import datetime as dt
import math

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E
from revlens.sources.tables import TABLES

SQL = E.oracle_sql()
QUERIES = E.queries()
# keys that any input of SF001 must give rows for are all those without SQL
SPARK_KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if round(v, 6) == 0 else round(v, 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(repr(_norm(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF001)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[key])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, got) == _rows(ocols, cur.fetchall())
    kinds = {d[0]: SPARK_KIND.get(str(d[1])) for d in cur.description}
    got_kinds = dict(df.dtypes)
    assert {c: k for c, k in got_kinds.items() if kinds[c] in ("string", "boolean", "double")} == \
        {c: k for c, k in kinds.items() if k in ("string", "boolean", "double")}


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, key):
    assert QUERIES[key](spark, SF001).count() > 0


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["bank", "rank", "count", "pct", "label"]


@pytest.mark.parametrize("key", ["stream_counts", "filter_datetime_range", "counts_over_time", "date_parts",
                                 "weekday_counts", "parse_review_date", "monthly_counts"])
def test_time_keys_ignore_session_zone(spark, con, key):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = QUERIES[key](spark, SF001)
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    cur = con.execute(SQL[key])
    ocols = [d[0] for d in cur.description]
    assert _rows(df.columns, got) == _rows(ocols, cur.fetchall())
