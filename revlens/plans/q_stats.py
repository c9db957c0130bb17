"""Registered plans: contingency tables and tests (§2.7), time series (§2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import DAY_NAMES
from ..operators import stats as ST
from ..operators import timeseries as TS
from .base import dated, hypothesis_base, labelled, register, round_doubles

H1_BANKS = ["src0", "src1", "src2"]
H3_PRODUCTS = ["de", "en", "es", "fr"]


def _lower_gamma_sql(a: str, x: str, terms: int = 1000) -> str:
    """Regularised lower incomplete gamma P(a, x) by its power series."""
    return (f"(SELECT sum(exp(-({x}) + ({a} + n) * ln({x}) - lgamma({a} + n + 1))) "
            f"FROM range(0, {terms}) t(n))")


def _chi2_p_sql(stat: str, dof: str) -> str:
    return (f"CASE WHEN {dof} <= 0 OR {stat} <= 0 THEN 1.0 ELSE "
            f"greatest(0.0, 1.0 - {_lower_gamma_sql(f'({dof}) / 2.0', f'({stat}) / 2.0')}) END")


def _norm_sf_sql(z: str) -> str:
    p = _lower_gamma_sql("0.5", f"pow({z}, 2) / 2.0")
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN greatest(0.0, 0.5 * (1.0 - {p})) "
            f"ELSE 0.5 * (1.0 + {p}) END")


def _chi_sql(row: str, where: str) -> str:
    return f"""
WITH cnt AS (SELECT {row} AS r, sentiment AS c, count(*) AS o FROM hyp WHERE {where} GROUP BY 1, 2),
rows_ AS (SELECT DISTINCT r FROM cnt), cols_ AS (SELECT DISTINCT c FROM cnt),
cells AS (SELECT rows_.r, cols_.c, coalesce(cnt.o, 0) AS o FROM rows_ CROSS JOIN cols_
          LEFT JOIN cnt ON cnt.r = rows_.r AND cnt.c = cols_.c),
m AS (SELECT r, c, o, CAST(sum(o) OVER (PARTITION BY r) AS DOUBLE) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e
      FROM cells),
st AS (SELECT CAST(((SELECT count(*) FROM rows_) - 1) * ((SELECT count(*) FROM cols_) - 1) AS BIGINT) AS dof,
              sum(pow(o - e, 2) / e) AS plain, sum(pow(abs(o - e) - least(0.5, abs(o - e)), 2) / e) AS yates,
              bool_or(e < 5) AS expected_low FROM m),
s2 AS (SELECT CASE WHEN dof = 0 THEN 0.0 WHEN dof = 1 THEN yates ELSE plain END AS statistic, dof, expected_low FROM st),
s3 AS (SELECT *, {_chi2_p_sql('statistic', 'dof')} AS p_value FROM s2)
SELECT statistic, dof, expected_low, p_value, p_value < 0.05 AS reject_h0 FROM s3"""


def _in(vals):
    return "(" + ", ".join(f"'{v}'" for v in vals) + ")"


def _h1(spark, sf):
    return hypothesis_base(spark, sf).where(F.col("bank").isin(H1_BANKS))


def _h3(spark, sf):
    return hypothesis_base(spark, sf).where(F.col("product").isin(H3_PRODUCTS))


@register("crosstab", f"""
SELECT product, count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS NEGATIVE,
       count(*) FILTER (WHERE sentiment = 'NEUTRAL') AS NEUTRAL,
       count(*) FILTER (WHERE sentiment = 'POSITIVE') AS POSITIVE FROM hyp GROUP BY product""")
def q_crosstab(spark, sf):
    return ST.crosstab(hypothesis_base(spark, sf), "product", "sentiment")


@register("chi_square", _chi_sql("product", f"product IN {_in(H3_PRODUCTS)}"), doubles=("statistic", "p_value"))
def q_chi_square(spark, sf):
    return round_doubles(ST.chi_square(_h3(spark, sf), "product", "sentiment"))


@register("expected_low_flag", f"SELECT expected_low, dof FROM ({_chi_sql('bank', f'bank IN {_in(H1_BANKS)}')}) t")
def q_expected_low_flag(spark, sf):
    return ST.chi_square(_h1(spark, sf), "bank", "sentiment").select("expected_low", "dof")


@register("pearson_residuals", """
SELECT r AS product, c AS sentiment, CAST(o AS BIGINT) AS observed, e AS expected, (o - e) / sqrt(e) AS residual,
       abs((o - e) / sqrt(e)) > 1.96 AS significant FROM m""", doubles=("expected", "residual"),
          ctes=f"""cnt AS (SELECT product AS r, sentiment AS c, count(*) AS o FROM hyp WHERE product IN {_in(H3_PRODUCTS)}
  GROUP BY 1, 2),
rows_ AS (SELECT DISTINCT r FROM cnt), cols_ AS (SELECT DISTINCT c FROM cnt),
cells AS (SELECT rows_.r, cols_.c, coalesce(cnt.o, 0) AS o FROM rows_ CROSS JOIN cols_
          LEFT JOIN cnt ON cnt.r = rows_.r AND cnt.c = cols_.c),
m AS (SELECT r, c, o, CAST(sum(o) OVER (PARTITION BY r) AS DOUBLE) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e
      FROM cells)""")
def q_pearson_residuals(spark, sf):
    return round_doubles(ST.pearson_residuals(_h3(spark, sf), "product", "sentiment"))


def _z_sql(first: str, second: str) -> str:
    return f"""
WITH a AS (SELECT count(*) FILTER (WHERE product = '{first}') AS n1,
                  count(*) FILTER (WHERE product = '{first}' AND sentiment = 'NEGATIVE') AS k1,
                  count(*) FILTER (WHERE product = '{second}') AS n2,
                  count(*) FILTER (WHERE product = '{second}' AND sentiment = 'NEGATIVE') AS k2 FROM hyp),
b AS (SELECT n1, k1, CAST(k1 AS DOUBLE) / n1 AS share1, n2, k2, CAST(k2 AS DOUBLE) / n2 AS share2,
             CAST(k1 + k2 AS DOUBLE) / (n1 + n2) AS p FROM a WHERE n1 > 0 AND n2 > 0),
c AS (SELECT *, sqrt(p * (1.0 - p) * (1.0 / n1 + 1.0 / n2)) AS se FROM b),
d AS (SELECT n1, k1, share1, n2, k2, share2, CASE WHEN se = 0 THEN NULL ELSE (share1 - share2) / se END AS z FROM c),
e AS (SELECT *, {_norm_sf_sql('z')} AS p_value FROM d)
SELECT n1, k1, share1, n2, k2, share2, z, p_value, p_value < 0.05 AS reject_h0 FROM e"""


@register("two_proportion_z", _z_sql("en", "fr"), doubles=("share1", "share2", "z", "p_value"))
def q_two_proportion_z(spark, sf):
    return round_doubles(ST.two_proportion_z(hypothesis_base(spark, sf), "product", "en", "fr", "sentiment",
                                             "NEGATIVE"))


@register("decide_alpha", f"""
SELECT 'bank_vs_sentiment' AS hypothesis, 'chi_square' AS test, statistic, p_value, reject_h0
FROM ({_chi_sql('bank', f'bank IN {_in(H1_BANKS)}')}) h1
UNION ALL SELECT 'negative_share_en_gt_fr', 'two_proportion_z', z, p_value, reject_h0 FROM ({_z_sql('en', 'fr')}) h2
UNION ALL SELECT 'product_vs_sentiment', 'chi_square', statistic, p_value, reject_h0
FROM ({_chi_sql('product', f'product IN {_in(H3_PRODUCTS)}')}) h3""", doubles=("statistic", "p_value"))
def q_decide_alpha(spark, sf):
    from ..operators.filters import filter_status
    from .reports import hypothesis_report
    rep = hypothesis_report(filter_status(labelled(spark, sf)), H1_BANKS, ("en", "fr"), H3_PRODUCTS,
                            labels=("bank_vs_sentiment", "negative_share_en_gt_fr", "product_vs_sentiment"))
    return round_doubles(rep.select("hypothesis", "test", "statistic", "p_value", "reject_h0"))


# ----------------------------------------------------------------- time series
@register("monthly_counts", "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, count(*) AS \"count\" "
          "FROM labelled WHERE ts IS NOT NULL GROUP BY 1")
def q_monthly_counts(spark, sf):
    return TS.monthly_counts(dated(spark, sf), "ts")


@register("monthly_mean", "SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, avg(grade) AS mean_grade "
          "FROM labelled WHERE ts IS NOT NULL GROUP BY 1", doubles=("mean_grade",))
def q_monthly_mean(spark, sf):
    return round_doubles(TS.monthly_mean(dated(spark, sf), "ts", "grade"))


@register("weekday_counts", "SELECT CAST(d.i AS INTEGER) AS day_index, d.day_name, c.\"count\" FROM (VALUES "
          + ", ".join(f"({i}, '{n}')" for i, n in enumerate(DAY_NAMES))
          + ") d(i, day_name) LEFT JOIN (SELECT dayname(ts) AS day_name, count(*) AS \"count\" FROM labelled "
          "WHERE ts IS NOT NULL GROUP BY 1) c ON c.day_name = d.day_name")
def q_weekday_counts(spark, sf):
    return TS.weekday_counts(dated(spark, sf), "ts").select("day_index", "day_name", "count")


@register("hour_counts", "SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS \"count\" FROM labelled "
          "WHERE ts IS NOT NULL GROUP BY 1")
def q_hour_counts(spark, sf):
    return TS.hour_counts(dated(spark, sf), "ts")


@register("counts_over_time", """
WITH s AS (SELECT ts FROM labelled WHERE ts IS NOT NULL),
sp AS (SELECT floor(date_diff('second', min(ts), max(ts)) / 86400) AS span FROM s)
SELECT CAST(CASE WHEN span <= 7 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END AS TIMESTAMP) AS period,
       CASE WHEN span <= 7 THEN 'hour' ELSE 'day' END AS granularity, count(*) AS "count" FROM s, sp GROUP BY 1, 2""")
def q_counts_over_time(spark, sf):
    return TS.counts_over_time(dated(spark, sf), "ts")
