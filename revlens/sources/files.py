"""CSV and JSON sources and sinks (§2.1).

CSV is read with every column as text and then bound *by header name* to the
requested schema (never by position), with the usual missing-value tokens
turned into NULL. ``multiLine`` keeps quoted newlines inside one record; it
also makes each file one split, so large inputs should be many files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text tokens read as missing (the pandas read_csv defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _reader(spark: SparkSession, multi_line: bool = True):
    r = spark.read
    for k, v in _CSV_OPTS.items():
        r = r.option(k, v)
    return r.option("multiLine", "true" if multi_line else "false")


def _bind(df: DataFrame, schema: T.StructType | None, na_tokens: Sequence[str]) -> DataFrame:
    cols = []
    fields = schema.fields if schema is not None else [T.StructField(c, T.StringType()) for c in df.columns]
    for f in fields:
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        raw = F.col(f"`{f.name}`")
        txt = F.when(~raw.isin(list(na_tokens)), raw) if na_tokens else raw
        cols.append((txt if isinstance(f.dataType, T.StringType) else txt.try_cast(f.dataType)).alias(f.name))
    return df.select(*cols)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_tokens: Sequence[str] = NA_TOKENS, multi_line: bool = True) -> DataFrame:
    """Headered CSV (quoted newlines and doubled quotes allowed; a UTF-8 BOM is
    dropped) → typed DataFrame bound by header name.

    ``multi_line=False`` lets Spark split large files across tasks; use it
    only when no quoted field contains a line break."""
    raw = _reader(spark, multi_line).option("inferSchema", "false").csv(path)
    return _bind(raw, schema, na_tokens)


def scan_csv_renamed(spark: SparkSession, path: str, names: Mapping[str, str],
                     schema: T.StructType | None = None, na_tokens: Sequence[str] = NA_TOKENS,
                     multi_line: bool = True) -> DataFrame:
    """Read by header, then give the columns new names (``{header: name}``)."""
    raw = _reader(spark, multi_line).option("inferSchema", "false").csv(path).withColumnsRenamed(dict(names))
    return _bind(raw, schema, na_tokens)


def _writer(df: DataFrame, mode: str):
    w = df.write.mode(mode)
    for k in ("header", "quote", "escape"):
        w = w.option(k, _CSV_OPTS[k])
    # the writer's defaults would trim blanks off every text
    return w.option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")


def sink_csv_append(df: DataFrame, path: str) -> str:
    """Append to a CSV folder. Each written part carries its own header line,
    which the reader skips, so the folder always reads back as one table."""
    _writer(df, "append").csv(path)
    return path


def sink_csv_overwrite(df: DataFrame, path: str) -> str:
    """Replace a CSV folder (no row index, no byte-order mark)."""
    _writer(df, "overwrite").csv(path)
    return path


def sink_json(df: DataFrame, path: str, ts_col: str = "timestamp", mode: str = "overwrite") -> str:
    """JSON Lines with a write-time ``timestamp`` (epoch seconds, double) per record."""
    stamped = df.withColumn(ts_col, F.unix_micros(F.current_timestamp()).cast("double") / F.lit(1e6))
    stamped.write.mode(mode).json(path)
    return path


def scan_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
