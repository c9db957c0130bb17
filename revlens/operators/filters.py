"""Row filters, projections and schema guards (§2.3). All lazy, all pushed
down by Catalyst where the predicate reaches a parquet scan."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def filter_status(df: DataFrame, col: str = "status", good: str = "good") -> DataFrame:
    """Keep ``status == good``; a frame without the column passes through."""
    return df.where(F.col(col) == good) if col in df.columns else df


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with NULL (or NaN) in any listed column."""
    return df.dropna(subset=list(cols))


def filter_min_length(df: DataFrame, col: str, n: int) -> DataFrame:
    """Keep rows whose text is longer than ``n`` characters (NULL dropped)."""
    return df.where(F.length(F.col(col)) > n)


def filter_in_set(df: DataFrame, col: str, values: Iterable) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_equals(df: DataFrame, col: str, value) -> DataFrame:
    return df.where(F.col(col) == F.lit(value))


def filter_optional(df: DataFrame, settings: Mapping[str, str], all_value: str = ALL) -> DataFrame:
    """Equality filters where the value ``All`` means no filter."""
    for col, value in settings.items():
        if value is not None and value != all_value:
            df = df.where(F.col(col) == F.lit(value))
    return df


def _parse_bound(s: str | None) -> _dt.datetime | None:
    if not s:
        return None
    try:
        return _dt.datetime.fromisoformat(s.strip())
    except ValueError:
        return None


def filter_datetime_range(df: DataFrame, ts_col: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive ``[start, end]`` on a timestamp column, applied only when both
    bounds parse (ISO ``YYYY-MM-DDTHH:MM``); then rows with a NULL time drop out."""
    lo, hi = _parse_bound(start), _parse_bound(end)
    if lo is None or hi is None:
        return df
    c = F.col(ts_col)
    return df.where((c >= _ntz(lo)) & (c <= _ntz(hi)))


def _ntz(t: _dt.datetime) -> Column:
    """A wall-clock literal built from its parts (independent of any time zone)."""
    sec = t.second + t.microsecond / 1e6
    return F.make_timestamp_ntz(F.lit(t.year), F.lit(t.month), F.lit(t.day), F.lit(t.hour), F.lit(t.minute),
                                F.lit(sec).cast("decimal(16,6)"))


def filter_near_value(df: DataFrame, col: str, target: float = 0.751, atol: float = 0.001,
                      rtol: float = 1e-5) -> DataFrame:
    """``|x − target| ≤ atol + rtol·|target|`` (NULL dropped)."""
    return df.where(F.abs(F.col(col) - F.lit(target)) <= F.lit(atol + rtol * abs(target)))


def filter_contradiction(df: DataFrame, grade: str = "grade", sentiment: str = "sentiment",
                         grades: Sequence[int] = (4, 5), label: str = "NEGATIVE") -> DataFrame:
    """Drop high grades labelled negative; rows with a NULL grade or label stay."""
    high = F.coalesce(F.col(grade).isin(list(grades)), F.lit(False))
    return df.where(~(high & F.col(sentiment).eqNullSafe(F.lit(label))))


def filter_untraced(df: DataFrame, sentiment: str = "sentiment", untraced: str = "untraced") -> DataFrame:
    return df.where(~F.col(sentiment).eqNullSafe(F.lit(untraced)))


def filter_unknown_bank(df: DataFrame, bank: str = "bank", unknown: str = "Unknown") -> DataFrame:
    """Drop rows whose bank is still the unknown marker (NULL and '' stay)."""
    return df.where(~F.col(bank).eqNullSafe(F.lit(unknown)))


def exclude_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Anti join: rows whose key appears in ``keys`` are removed."""
    return df.join(keys.select(F.col(key)).where(F.col(key).isNotNull()), on=key, how="left_anti")


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns that exist; missing names are ignored."""
    return df.drop(*cols)


def project_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail before any job runs, naming the first missing column."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"missing required column: {c}")
    return df


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def empty_subset(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that may leave nothing: the result keeps the full schema."""
    return df.where(condition)


def is_empty(df: DataFrame) -> bool:
    """One-row probe (``LIMIT 1``), used to report 'no data' instead of failing."""
    return df.isEmpty()
