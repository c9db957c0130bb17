"""Upper-tail probabilities for test statistics.

Neither Spark nor ANSI SQL has ``erfc`` or the incomplete gamma function, so
both tails are written here as native expressions, accurate to about 1e-10 of
their own size however small they are: series where the tail is large,
continued fractions where it is small. They run on a test's one-row result, so
no Python worker is started; the number of terms grows with the square root of
the degrees of freedom and is bounded. ``chi2_sf`` and ``norm_sf`` are plain
Python closed forms, used to cross-check the expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_OVER_SQRT_PI = 2.0 / math.sqrt(math.pi)
_SQRT_PI = math.sqrt(math.pi)
_LN_2PI = math.log(2.0 * math.pi)
_ERF_TERMS = 60           # series for |x| < 1: terms fall faster than 1/n!
_FRACTION_TERMS = 250     # continued fraction for x >= 1
# Half degrees of freedom above which the tail is taken from the normal law
# with its first correction (relative error of order 1 / dof).
_LARGE_A = 1e8


def chi2_sf(x: float | None, dof: int | None) -> float | None:
    """P(X ≥ x) for a chi-square variable with ``dof`` degrees of freedom."""
    if x is None or dof is None:
        return None
    if dof <= 0 or x <= 0:
        return 1.0
    h = x / 2.0
    lh = math.log(h)
    if dof % 2 == 0:
        s = math.fsum(math.exp(-h + j * lh - math.lgamma(j + 1)) for j in range(dof // 2))
    else:
        s = math.erfc(math.sqrt(h)) + math.fsum(
            math.exp(-h + (j - 0.5) * lh - math.lgamma(j + 0.5)) for j in range(1, (dof - 1) // 2 + 1))
    return min(1.0, s)


def norm_sf(z: float | None) -> float | None:
    """P(Z ≥ z) for a standard normal variable."""
    if z is None or math.isnan(z):
        return None
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _sum_series(first: Column, ratio, terms: Column) -> Column:
    """first · (1 + r(1) + r(1)·r(2) + …), ``terms`` factors ``ratio(n)``."""
    return F.aggregate(
        F.sequence(F.lit(1).cast("long"), terms),
        F.struct(first.alias("t"), first.alias("s")),
        lambda st, n: F.struct((st["t"] * ratio(n)).alias("t"), (st["s"] + st["t"] * ratio(n)).alias("s")),
        lambda st: st["s"])


def erfc_col(x: Column) -> Column:
    """erfc(x) as a native expression.

    |x| < 1: 1 − erf, erf(a) = 2/√π · e^(−a²) · Σ a^(2n+1)·2^n / (1·3·…·(2n+1)).
    |x| ≥ 1: e^(−a²)/√π · 1/(a + ½/(a + 1/(a + 1½/(a + …)))), from the inside
    out, so deep tails keep their digits. erfc(−a) = 2 − erfc(a).
    """
    a = F.abs(x.cast("double"))
    near = F.least(a, F.lit(1.0))
    erf = F.lit(_TWO_OVER_SQRT_PI) * F.exp(-near * near) * _sum_series(
        near, lambda n: F.lit(2.0) * near * near / (F.lit(2.0) * n + F.lit(1.0)), F.lit(_ERF_TERMS).cast("long"))
    far = F.greatest(a, F.lit(1.0))
    inner = F.aggregate(F.sequence(F.lit(_FRACTION_TERMS), F.lit(1)), far,
                        lambda t, n: far + n.cast("double") / F.lit(2.0) / t)
    tail = F.when(a < 1.0, F.lit(1.0) - erf).otherwise(F.exp(-far * far) / F.lit(_SQRT_PI) / inner)
    return F.when(x.isNull(), F.lit(None).cast("double")).when(x < 0, F.lit(2.0) - tail).otherwise(tail)


def norm_sf_col(z: Column) -> Column:
    """P(Z ≥ z) = ½ · erfc(z / √2); NULL or NaN in, NULL out."""
    zz = F.when(~F.isnan(z), z.cast("double"))
    return F.lit(0.5) * erfc_col(zz / F.lit(math.sqrt(2.0)))


def _ln_weight(a: Column, x: Column) -> Column:
    """ln(x^a e^(−x) / Γ(a+1)) without the cancellation of its large parts.

    With b = a + 10 and x = b(1+m): −b(m − ln(1+m)) − ½ ln 2πb − Stirling's
    correction, then Γ(b+1)/Γ(a+1) and x^(a−b) are put back factor by factor.
    """
    b = a + F.lit(10.0)
    m = (x - b) / b
    small = F.abs(m) < 0.01          # m − ln(1+m) by its series where the difference would cancel
    series = m * m * (F.lit(1 / 2) - m * (F.lit(1 / 3) - m * (F.lit(1 / 4) - m * (F.lit(1 / 5) - m * (
        F.lit(1 / 6) - m * (F.lit(1 / 7) - m * F.lit(1 / 8)))))))
    gap = F.when(small, series).otherwise(m - F.log(x / b))
    inv = F.lit(1.0) / b
    stirling = inv * (F.lit(1 / 12) - inv * inv * (F.lit(1 / 360) - inv * inv * F.lit(1 / 1260)))
    out = -b * gap - F.lit(0.5) * (F.log(b) + F.lit(_LN_2PI)) - stirling
    for k in range(1, 11):
        out = out + F.log((a + F.lit(float(k))) / x)
    return out


def chi2_sf_col(x: Column, dof: Column) -> Column:
    """P(X ≥ x) for a chi-square variable, as a native expression.

    With a = dof/2, h = x/2 and w = h^a e^(−h) / Γ(a+1):
    h < a + 1: 1 − w · Σ h^n / ((a+1)…(a+n));
    else w·a / (h+1−a − 1(1−a)/(h+3−a − 2(2−a)/(h+5−a − …))), from the inside
    out. Terms needed grow with √a; beyond ``_LARGE_A`` the normal law of
    the signed root of the deviance with its first correction takes over.
    """
    xd, k = x.cast("double"), dof.cast("long")
    a, h = k.cast("double") / F.lit(2.0), xd / F.lit(2.0)
    a_ = F.least(F.greatest(a, F.lit(0.5)), F.lit(_LARGE_A))      # keeps unused branches finite and short
    h_ = F.greatest(h, F.lit(1e-300))
    terms = (F.lit(250.0) + F.lit(10.0) * F.sqrt(a_)).cast("long")
    w = F.exp(_ln_weight(a_, h_))
    low = F.least(h_, a_ + F.lit(1.0))
    lower = w * _sum_series(F.lit(1.0), lambda n: low / (a_ + n.cast("double")), terms)
    high = F.greatest(h_, a_ + F.lit(1.0))
    inner = F.aggregate(
        F.sequence(terms, F.lit(1).cast("long")), high - a_ + F.lit(2.0) * terms.cast("double") + F.lit(1.0),
        lambda t, n: high - a_ + F.lit(2.0) * n.cast("double") - F.lit(1.0) - n.cast("double") * (n.cast("double") - a_) / t)
    exact = F.when(h_ < a_ + F.lit(1.0), F.lit(1.0) - lower).otherwise(w * a_ / inner)
    m = (h - a) / F.greatest(a, F.lit(1.0))
    small = F.abs(m) < 0.01
    gap = F.when(small, m * m * (F.lit(1 / 2) - m * (F.lit(1 / 3) - m * (F.lit(1 / 4) - m * (F.lit(1 / 5) - m / 6))))) \
        .otherwise(m - F.log(F.lit(1.0) + F.greatest(m, F.lit(-1 + 1e-15))))
    eta = F.signum(m) * F.sqrt(F.lit(2.0) * gap)
    skew = F.when(F.abs(m) < 1e-4, F.lit(-1 / 3) + m / F.lit(12.0)).otherwise(F.lit(1.0) / m - F.lit(1.0) / eta)
    wide = F.lit(0.5) * erfc_col(eta * F.sqrt(a / F.lit(2.0))) + \
        F.exp(-a * gap) / F.sqrt(F.lit(2.0 * math.pi) * F.greatest(a, F.lit(0.5))) * skew
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(a > _LARGE_A, wide).otherwise(exact)))
    return (F.when(xd.isNull() | k.isNull(), F.lit(None).cast("double"))
            .when((k <= 0) | (xd <= 0), F.lit(1.0))
            .otherwise(p))
