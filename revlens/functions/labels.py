"""Label, probability and binning functions (all native expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names and thresholds of the sentiment stage.
CLASS_NAMES = ["NEGATIVE", "NEUTRAL", "POSITIVE"]
LABEL_NAMES = {0: "Negative", 1: "Neutral", 2: "Positive"}
CONFIDENCE_CUT = 0.75
UNTRACED = "untraced"
CONFIDENCE_EDGES = [0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    x = _col(c)
    return F.when(~F.isnan(x), x)


def grade_to_label(c, is_string: bool = False) -> Column:
    """0–2 → 0, 3 → 1, any other integer → 2; unparsable or NULL → 1.

    Strings parse as Python ``int(text)`` would (so ``'4.0'`` is unparsable);
    numbers truncate toward zero like ``int(4.7)``. Integers of any length
    count: digits beyond 64 bits are some "other integer".
    """
    x = _col(c)
    g = x.try_cast("bigint")
    beyond = g.isNull() & x.cast("string").rlike(r"^\s*[+-]?[0-9]{19,}\s*\z")
    return (F.when(beyond, F.lit(2)).when(g.isNull(), F.lit(1))
            .when(g.isin(0, 1, 2), F.lit(0))
            .when(g == 3, F.lit(1))
            .otherwise(F.lit(2)))


def label_name(c) -> Column:
    x = _col(c)
    out = None
    for k, v in LABEL_NAMES.items():
        out = F.when(x == k, F.lit(v)) if out is None else out.when(x == k, F.lit(v))
    return out


def softmax_probs(logits: Sequence[Column]) -> list[Column]:
    """Max-shifted softmax over a fixed list of logit columns."""
    m = F.greatest(*logits)
    ex = [F.exp(x - m) for x in logits]
    den = ex[0]
    for e in ex[1:]:
        den = den + e
    return [e / den for e in ex]


def softmax_array(arr) -> Column:
    """Max-shifted softmax over an array column (any length)."""
    a = _col(arr)
    shifted = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(shifted, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def max_confidence(cols: Sequence = CLASS_NAMES) -> Column:
    """Row maximum ignoring NULL (NaN must be NULLed at the scan)."""
    return F.greatest(*[_col(c) for c in cols])


def label_by_confidence(neg="NEGATIVE", neu="NEUTRAL", pos="POSITIVE", cut: float = CONFIDENCE_CUT) -> Column:
    """``untraced`` below the cut, else the arg-max; ties prefer POSITIVE, then NEGATIVE."""
    n, u, p = _col(neg), _col(neu), _col(pos)
    mx = F.greatest(n, u, p)
    return (F.when(mx.isNull(), F.lit(None).cast("string"))
            .when(mx < F.lit(cut), F.lit(UNTRACED))
            .when(mx == p, F.lit("POSITIVE"))
            .when(mx == n, F.lit("NEGATIVE"))
            .otherwise(F.lit("NEUTRAL")))


def argmax_label(neg="NEGATIVE", neu="NEUTRAL", pos="POSITIVE") -> Column:
    """Class index 0/1/2 of the largest probability (first index wins ties)."""
    n, u, p = _col(neg), _col(neu), _col(pos)
    mx = F.greatest(n, u, p)
    return (F.when(mx.isNull(), F.lit(None).cast("int"))
            .when(n == mx, F.lit(0)).when(u == mx, F.lit(1)).otherwise(F.lit(2)))


def assign_bin(c, edges: Sequence[float] = CONFIDENCE_EDGES) -> Column:
    """Index of the right-closed bin ``(e[i], e[i+1]]`` holding the value; NULL outside."""
    x = _col(c)
    out = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(float(edges[i]))) & (x <= F.lit(float(edges[i + 1])))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def int_div(a, b) -> Column:
    """Exact integer division of non-negative integers (SQL ``div``)."""
    return F.call_function("div", _col(a).cast("long"), _col(b).cast("long"))


def percent_label(count, total) -> Column:
    """``"{count} ({pct:.1f}%)"`` with tenths rounded half up in exact integer arithmetic:
    tenths = floor((2000·count + total) / (2·total))."""
    c = _col(count).cast("long")
    t = _col(total).cast("long")
    tenths = F.when(t > 0, int_div(F.lit(2000) * c + t, F.lit(2) * t))
    return F.concat(c.cast("string"), F.lit(" ("), int_div(tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%)"))
