"""Scalar functions: every one returns a native ``Column`` (JVM-side, codegen'd),
except the two tail-probability helpers in ``dist`` that run on one-row results."""

from .text import (WS, clean_text, strip_ws, upper_strip, normalise_bank, normalise_bank_unknown,
                   normalise_bank_pattern, categorise_product, extract_between, parse_digits)
from .labels import (grade_to_label, label_name, softmax_probs, softmax_array, max_confidence,
                     label_by_confidence, assign_bin, percent_label, nan_to_null, argmax_label)
from .dates import parse_review_date, date_parts, format_datetime_local, trunc_hour, trunc_day, trunc_month

__all__ = [
    "WS", "clean_text", "strip_ws", "upper_strip", "normalise_bank", "normalise_bank_unknown",
    "normalise_bank_pattern", "categorise_product", "extract_between", "parse_digits",
    "grade_to_label", "label_name", "softmax_probs", "softmax_array", "max_confidence",
    "label_by_confidence", "assign_bin", "percent_label", "nan_to_null", "argmax_label",
    "parse_review_date", "date_parts", "format_datetime_local", "trunc_hour", "trunc_day", "trunc_month",
]

from pyspark.sql import DataFrame as _DataFrame
from pyspark.sql import functions as _F


def with_columns_once(df: _DataFrame, cols: dict) -> _DataFrame:
    """Add columns that are evaluated exactly once per row.

    Catalyst substitutes a column's full definition into every filter pushed
    below it; for wide expressions (a softmax feeding an arg-max label) that
    multiplies generated code past the JVM's 64 KB method limit. Emitting the
    new columns from a one-row ``inline`` generator keeps them as attributes:
    later filters reference the value instead of re-deriving it.
    """
    s = _F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*[_F.col(f"`{c}`") for c in df.columns if c not in cols], _F.inline(_F.array(s)))
