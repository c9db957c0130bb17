"""Registered plans on the large tables (lineitem, part, documents): the same
operators as the review plans, at a volume where partitioning matters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from ..operators import shape as SH
from ..operators import stats as ST
from ..operators import timeseries as TS
from .base import register, round_doubles, table
from .q_profile import _corr_sql, _describe_sql, _hist_sql, _kde_sql, _top_other_sql
from .q_stats import _chi2_p_sql

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESC_D = ("mean", "std", "min", "p25", "p50", "p75", "max")


@register("describe_numeric_lineitem", _describe_sql(LI_NUM, "lineitem"), doubles=_DESC_D)
def q_describe_numeric_lineitem(spark, sf):
    return round_doubles(PR.describe_numeric(table(spark, sf, "lineitem"), LI_NUM, method="bucketed"))


@register("corr_matrix_lineitem", _corr_sql(LI_NUM, "lineitem"), doubles=("r",))
def q_corr_matrix_lineitem(spark, sf):
    return round_doubles(PR.corr_matrix(table(spark, sf, "lineitem"), LI_NUM))


@register("box_stats_lineitem", f"""
WITH b AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem
           WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL),
q AS (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b GROUP BY g)
SELECT q.g AS l_returnflag, q.n, q1, median, q3,
       least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
       greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))) AS whisker_high,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM b JOIN q ON q.g = b.g GROUP BY q.g, q.n, q1, median, q3""",
          doubles=("q1", "median", "q3", "whisker_low", "whisker_high"))
def q_box_stats_lineitem(spark, sf):
    return round_doubles(PR.box_stats(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice",
                                      method="bucketed"))


@register("chi_square_lineitem", f"""
WITH cnt AS (SELECT l_returnflag AS r, l_linestatus AS c, count(*) AS o FROM lineitem
             WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2),
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
SELECT statistic, dof, expected_low, p_value, p_value < 0.05 AS reject_h0 FROM s3""", doubles=("statistic", "p_value"))
def q_chi_square_lineitem(spark, sf):
    return round_doubles(ST.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("histogram_lineitem", _hist_sql("lineitem", "l_extendedprice", 20),
          doubles=("bin_lo", "bin_hi", "mean_mark", "median_mark"))
def q_histogram_lineitem(spark, sf):
    return round_doubles(PR.histogram_equal_width(table(spark, sf, "lineitem"), "l_extendedprice", 20,
                                                  median_method="bucketed"))


@register("kde_lineitem", _kde_sql("lineitem", "l_quantity", 200, 20), doubles=("x", "density"))
def q_kde_lineitem(spark, sf):
    return round_doubles(PR.kde_curve(table(spark, sf, "lineitem"), "l_quantity", 200, 20, method="moments"))


@register("kde_price_lineitem", _kde_sql("lineitem", "l_extendedprice", 200, 20), doubles=("x", "density"))
def q_kde_price_lineitem(spark, sf):
    return round_doubles(PR.kde_curve(table(spark, sf, "lineitem"), "l_extendedprice", 200, 20, method="moments"))


@register("location_spread_lineitem", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", median(CAST({c} AS DOUBLE)) AS median, (SELECT CAST({c} AS DOUBLE) FROM lineitem WHERE {c}
       IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in LI_NUM),
    doubles=("median", "mode", "std", "min", "max"))
def q_location_spread_lineitem(spark, sf):
    return round_doubles(PR.location_spread(table(spark, sf, "lineitem"), LI_NUM, method="bounded"))


_DIMS = 64


@register("corr_matrix_embeddings", f"""
WITH cells AS (SELECT vec_id, unnest(range(1, {_DIMS + 1})) AS k, unnest(embedding) AS v FROM embeddings),
st AS (SELECT k, stddev_samp(v) AS s FROM cells GROUP BY k)
SELECT 'e' || a.k AS col1, 'e' || b.k AS col2,
       CASE WHEN any_value(sa.s) > 0 AND any_value(sb.s) > 0 THEN corr(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) END AS r
FROM cells a JOIN cells b ON a.vec_id = b.vec_id JOIN st sa ON sa.k = a.k JOIN st sb ON sb.k = b.k GROUP BY a.k, b.k""",
          doubles=("r",))
def q_corr_matrix_embeddings(spark, sf):
    """All pairs of the embeddings' dimensions, through one Gram matrix per task."""
    v = table(spark, sf, "embeddings").select(*[F.get("embedding", F.lit(i)).alias(f"e{i + 1}") for i in range(_DIMS)])
    return round_doubles(PR.corr_matrix(v, v.columns))


@register("monthly_counts_lineitem", "SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month, "
          "count(*) AS \"count\" FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")
def q_monthly_counts_lineitem(spark, sf):
    return TS.monthly_counts(table(spark, sf, "lineitem"), "l_shipdate")


@register("group_multi_agg_lineitem", "SELECT l_returnflag, " + ", ".join(
    f"avg({c}) AS {c}_mean, count({c}) AS {c}_count, stddev_samp({c}) AS {c}_std" for c in LI_NUM)
          + " FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
          doubles=[f"{c}_{s}" for c in LI_NUM for s in ("mean", "std")])
def q_group_multi_agg_lineitem(spark, sf):
    return round_doubles(PR.group_multi_agg(table(spark, sf, "lineitem"), "l_returnflag", LI_NUM))


@register("top_k_other_part", _top_other_sql("part", "p_brand", 15), doubles=("pct",))
def q_top_k_other_part(spark, sf):
    return round_doubles(PR.top_k_other(table(spark, sf, "part"), "p_brand", 15))


@register("dedup_documents", "SELECT doc_id, lang, source, n_chars FROM documents "
          "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def q_dedup_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return SH.dedup_keep_first(d, "text", "doc_id").select("doc_id", "lang", "source", "n_chars")
