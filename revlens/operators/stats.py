"""Contingency tables and hypothesis tests (§2.7).

Counts are Spark aggregates; the final tail probability is a native expression
on the one-row result (``functions.dist``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf_col, norm_sf_col

ALPHA = 0.05
LOW_EXPECTED = 5.0
SIGNIFICANT_RESIDUAL = 1.96


def crosstab(df: DataFrame, row: str, col: str, values: Sequence | None = None, ordered: bool = True) -> DataFrame:
    """Counts of ``row`` × ``col``: one row per row label, one column per column
    label (sorted), absent cells 0. NULL labels are left out.

    The column labels are the result's column names, so without ``values``
    Spark must collect them first, up to ``spark.sql.pivotMaxValues``: pass
    them when they are known, and use ``contingency_cells`` (one row per cell)
    where there may be many.
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    counts = base.groupBy(row, col).agg(F.count(F.lit(1)).alias("_n"))
    pv = counts.groupBy(row)
    pv = pv.pivot(col, list(values)) if values is not None else pv.pivot(col)
    wide = pv.agg(F.sum("_n"))
    labels = [c for c in wide.columns if c != row]
    out = wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in labels])
    return out.orderBy(row) if ordered else out


# Column totals that travel in one array; a table with more column labels has several arrays.
LABELS_PER_ARRAY = 5_000


def _cell_counts(df: DataFrame, row: str, col: str, values: Sequence | None, weight: str | None) -> DataFrame:
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if values is not None:
        base = base.where(F.col(col).isin(list(values)))
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    return base.groupBy(row, col).agg(n.alias("observed"))


def contingency_cells(df: DataFrame, row: str, col: str, values: Sequence | None = None,
                      weight: str | None = None) -> DataFrame:
    """Long form of the table with margins: (row, col, observed, row_total,
    col_total, total, expected), one row for every row label × column label
    present (zero cells included). ``values`` limits the column labels.

    For results that show every cell; tests use the observed cells only
    (``chi_square``). No pivot and no cross join: the column totals are dealt
    into arrays of about ``LABELS_PER_ARRAY`` by hash, every row label is
    joined to each array by its number and the grid is made by ``inline``; the
    counts are then left-joined onto it. Any number of labels works, and no
    distinct labels are collected ahead of the query. ``weight`` names a count
    column when ``df`` is already aggregated.
    """
    counts = _cell_counts(df, row, col, values, weight)
    row_tot = counts.groupBy(row).agg(F.sum("observed").alias("row_total"))
    col_tot = counts.groupBy(col).agg(F.sum("observed").alias("col_total"))
    sums = col_tot.agg(F.sum("col_total").alias("total"), F.count(F.lit(1)).alias("labels"))
    total = sums.select("total").scalar()
    arrays = F.greatest(F.ceil(sums.select("labels").scalar() / F.lit(LABELS_PER_ARRAY)), F.lit(1).cast("long"))
    dealt = (col_tot.withColumn("_array", F.pmod(F.xxhash64(F.col(col)), arrays))
             .groupBy("_array").agg(F.collect_list(F.struct(F.col(col), F.col("col_total"))).alias("_a")))
    rows = row_tot.withColumn("_array", F.explode(F.sequence(F.lit(0).cast("long"), arrays - 1)))
    grid = rows.join(dealt, "_array").select(F.col(row), "row_total", F.inline("_a"))
    return (grid.join(counts, on=[row, col], how="left")
            .select(F.col(row), F.col(col), F.coalesce(F.col("observed"), F.lit(0)).cast("long").alias("observed"),
                    F.col("row_total").cast("long").alias("row_total"),
                    F.col("col_total").cast("long").alias("col_total"), total.cast("long").alias("total"))
            .withColumn("expected", F.col("row_total").cast("double") * F.col("col_total") / F.col("total")))


def chi_square(df: DataFrame, row: str, col: str, values: Sequence | None = None, correction: bool = True,
               alpha: float = ALPHA, weight: str | None = None) -> DataFrame:
    """Pearson chi-square test of independence on ``row`` × ``col``: statistic,
    p, dof, whether any expected count is below 5, and the decision at
    ``alpha``; no row when there is nothing to test. With one degree of
    freedom each observed count first moves toward its expected count by
    min(0.5, |o − e|) (Yates). ``weight``: as in ``contingency_cells``.

    Only observed cells and the two margins are read, never the full grid: an
    empty cell adds its expected count, and those counts add up to N less the
    expected counts of the observed cells. The smallest expected count is the
    smallest row total × the smallest column total / N. In a 2 × 2 table
    |o − e| is the same in every cell and Σ 1/e = N · Σ 1/row · Σ 1/column.
    """
    counts = _cell_counts(df, row, col, values, weight)
    row_tot = counts.groupBy(row).agg(F.sum("observed").alias("_r"))
    col_tot = counts.groupBy(col).agg(F.sum("observed").alias("_c"))

    def margin(t, c):                      # one subquery each
        m = t.agg(F.count(F.lit(1)).alias("n"), F.min(c).cast("double").alias("low"), F.sum(c).cast("double").alias("sum"),
                  F.sum(F.lit(1.0) / F.col(c)).alias("inverse"))
        return m.select(F.struct("n", "low", "sum", "inverse").alias("m")).scalar()

    rows, cols = margin(row_tot, "_r"), margin(col_tot, "_c")
    total = rows.getField("sum")
    cells = counts.join(row_tot, row).join(col_tot, col)
    o = F.col("observed").cast("double")
    e = F.col("_r").cast("double") * F.col("_c") / total
    sums = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.pow(o - e, 2) / e).alias("seen"), F.sum(e).alias("expected"),
                     F.max(F.abs(o - e)).alias("gap"))
    one = sums.select(
        "seen", "expected", "gap", "cells", total.alias("total"), rows.getField("n").alias("n_rows"),
        cols.getField("n").alias("n_cols"),
        (rows.getField("inverse") * cols.getField("inverse")).alias("inverse"),
        (rows.getField("low") * cols.getField("low") / total).alias("least")).where("cells > 0")
    empty = F.when(F.col("cells") < F.col("n_rows") * F.col("n_cols"),
                   F.greatest(F.col("total") - F.col("expected"), F.lit(0.0))).otherwise(F.lit(0.0))
    plain = F.col("seen") + empty
    yates = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), 2) * F.col("total") * F.col("inverse")
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    stat = F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(correction), yates).otherwise(plain)
    out = one.select(stat.alias("statistic"), dof.cast("long").alias("dof"),
                     (F.col("least") < LOW_EXPECTED).alias("expected_low"))
    out = out.withColumn("p_value", chi2_sf_col(F.col("statistic"), F.col("dof")))
    return out.withColumn("reject_h0", decide_alpha(F.col("p_value"), alpha))


def pearson_residuals(df: DataFrame, row: str, col: str, values: Sequence | None = None,
                      threshold: float = SIGNIFICANT_RESIDUAL, weight: str | None = None) -> DataFrame:
    """(o − e) / √e per cell with a flag for |residual| above ``threshold``."""
    cells = contingency_cells(df, row, col, values, weight)
    r = (F.col("observed") - F.col("expected")) / F.sqrt(F.col("expected"))
    return cells.select(row, col, "observed", "expected", r.alias("residual"),
                        (F.abs(r) > threshold).alias("significant"))


def two_proportion_z(df: DataFrame, group: str, first, second, outcome: str, success,
                     alpha: float = ALPHA, weight: str | None = None) -> DataFrame:
    """Pooled two-sample z test of H1: share(first) > share(second).

    One aggregate yields the four counts; no row when either group is empty.
    ``weight`` names a count column when ``df`` is already aggregated.
    """
    g, y = F.col(group), F.col(outcome)

    def n(cond):
        if weight is None:
            return F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0)).cast("long")

    agg = df.agg(n(g == F.lit(first)).alias("n1"),
                 n((g == F.lit(first)) & (y == F.lit(success))).alias("k1"),
                 n(g == F.lit(second)).alias("n2"),
                 n((g == F.lit(second)) & (y == F.lit(success))).alias("k2"))
    n1, k1, n2, k2 = (F.col(c).cast("double") for c in ("n1", "k1", "n2", "k2"))
    p = (k1 + k2) / (n1 + n2)
    se = F.sqrt(p * (F.lit(1.0) - p) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    z = F.try_divide(k1 / n1 - k2 / n2, se)
    out = (agg.where((F.col("n1") > 0) & (F.col("n2") > 0))
           .select("n1", "k1", (k1 / n1).alias("share1"), "n2", "k2", (k2 / n2).alias("share2"), z.alias("z")))
    out = out.withColumn("p_value", norm_sf_col(F.col("z")))
    return out.withColumn("reject_h0", decide_alpha(F.col("p_value"), alpha))


def decide_alpha(p: Column, alpha: float = ALPHA) -> Column:
    """Reject H0 when p < alpha."""
    return p < F.lit(alpha)
