"""Registered plans: joins (§2.5), aggregations (§2.6), ranking and reshaping (§2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import max_confidence, softmax_probs
from ..operators import profile as PR
from ..operators import shape as SH
from ..operators.stats import contingency_cells
from ..schemas import RATING_COLS, REVIEWS, SUB_RATING_COLS
from .base import dated, hypothesis_base, register, reviews, round_doubles, sql_pct, sql_softmax, table

P3 = ("NEGATIVE", "NEUTRAL", "POSITIVE")
RC = RATING_COLS


def _means_sql(cols):
    return ", ".join(f"avg({c}) AS mean_{c}" for c in cols)


# ----------------------------------------------------------------- joins
@register("join_group_count", f'SELECT bank, {_means_sql(RC)}, count(*) AS "count" FROM reviews '
          "WHERE bank IS NOT NULL GROUP BY bank", doubles=[f"mean_{c}" for c in RC])
def q_join_group_count(spark, sf):
    return round_doubles(SH.join_group_count(reviews(spark, sf), "bank", RC))


@register("semi_join_top", """
SELECT review_id, bank, grade FROM reviews WHERE bank IN (
  SELECT bank FROM reviews WHERE bank IS NOT NULL GROUP BY bank ORDER BY count(*) DESC, bank LIMIT 5)""")
def q_semi_join_top(spark, sf):
    return SH.semi_join_top(reviews(spark, sf), "bank", 5).select("review_id", "bank", "grade")


@register("semi_join_qualified", """
SELECT review_id, bank, product FROM reviews r WHERE (bank, product) IN (
  SELECT (bank, product) FROM reviews GROUP BY bank, product HAVING count(*) >= 5)""")
def q_semi_join_qualified(spark, sf):
    return SH.semi_join_qualified(reviews(spark, sf), ["bank", "product"], 5).select("review_id", "bank", "product")


DOMAIN = ["de", "en", "es", "fr", "ru"]


@register("left_join_domain", "SELECT CAST(d.position AS INTEGER) AS position, d.product, c.\"count\" FROM (VALUES "
          + ", ".join(f"({i}, '{v}')" for i, v in enumerate(DOMAIN))
          + ") d(position, product) LEFT JOIN (SELECT product, count(*) AS \"count\" FROM reviews "
          "WHERE product IS NOT NULL GROUP BY product) c ON c.product = d.product")
def q_left_join_domain(spark, sf):
    counts = PR.value_counts(reviews(spark, sf), "product")
    return SH.left_join_domain(counts, "product", DOMAIN).select("position", "product", "count")


_SM = sql_softmax(*[f"10 * CAST(v.embedding[{i}] AS DOUBLE)" for i in (1, 2, 3)])


@register("join_scores", f"SELECT d.doc_id AS review_id, {_SM[0]} AS NEGATIVE, {_SM[1]} AS NEUTRAL, "
          f"{_SM[2]} AS POSITIVE FROM documents d LEFT JOIN embeddings v ON v.vec_id = d.doc_id", doubles=P3)
def q_join_scores(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    e = table(spark, sf, "embeddings")
    probs = softmax_probs([F.lit(10.0) * F.col("embedding")[i].cast("double") for i in range(3)])
    scores = e.select(F.col("vec_id").alias("review_id"), *[p.alias(n) for p, n in zip(probs, P3)])
    return round_doubles(SH.join_scores(docs, scores, "review_id"))


CELLS_CTES = """cnt AS (SELECT product, sentiment, count(*) AS o FROM hyp GROUP BY product, sentiment),
rows_ AS (SELECT DISTINCT product FROM cnt), cols_ AS (SELECT DISTINCT sentiment FROM cnt),
cells AS (
  SELECT r.product, c.sentiment, coalesce(cnt.o, 0) AS observed FROM rows_ r CROSS JOIN cols_ c
  LEFT JOIN cnt ON cnt.product = r.product AND cnt.sentiment = c.sentiment),
marg AS (
  SELECT product, sentiment, observed, sum(observed) OVER (PARTITION BY product) AS row_total,
         sum(observed) OVER (PARTITION BY sentiment) AS col_total, sum(observed) OVER () AS total FROM cells)"""


@register("join_observed_expected", """
SELECT product, sentiment, CAST(observed AS BIGINT) AS observed, CAST(row_total AS BIGINT) AS row_total,
       CAST(col_total AS BIGINT) AS col_total, CAST(total AS BIGINT) AS total,
       CAST(row_total AS DOUBLE) * col_total / total AS expected FROM marg""", doubles=("expected",), ctes=CELLS_CTES)
def q_join_observed_expected(spark, sf):
    c = contingency_cells(hypothesis_base(spark, sf), "product", "sentiment")
    return round_doubles(c.select("product", "sentiment", "observed", "row_total", "col_total", "total", "expected"))


# ----------------------------------------------------------------- aggregations
@register("value_counts", 'SELECT city, count(*) AS "count" FROM reviews WHERE city IS NOT NULL GROUP BY city')
def q_value_counts(spark, sf):
    return PR.value_counts(reviews(spark, sf), "city")


@register("value_counts_pct", f"""
SELECT product, "count", {sql_pct('"count"', 'sum("count") OVER ()')} AS pct
FROM (SELECT product, count(*) AS "count" FROM reviews WHERE product IS NOT NULL GROUP BY product) t""",
          doubles=("pct",))
def q_value_counts_pct(spark, sf):
    return round_doubles(PR.value_counts_pct(reviews(spark, sf), "product"))


@register("count_distinct", "SELECT count(DISTINCT bank) AS distinct_bank, count(DISTINCT product) AS distinct_product, "
          "count(DISTINCT city) AS distinct_city FROM reviews")
def q_count_distinct(spark, sf):
    return PR.count_distinct(reviews(spark, sf), ["bank", "product", "city"])


@register("top_k_remainder", """
WITH c AS (SELECT city, count(*) AS "count" FROM reviews WHERE city IS NOT NULL GROUP BY city),
t AS (SELECT city, "count", CAST(row_number() OVER (ORDER BY "count" DESC, city) AS INTEGER) AS rank FROM c)
SELECT city, "count", rank, CAST(greatest((SELECT count(*) FROM c) - 10, 0) AS BIGINT) AS other_values,
       CAST((SELECT sum("count") FROM c) - (SELECT sum("count") FROM t WHERE rank <= 10) AS BIGINT) AS other_rows
FROM t WHERE rank <= 10""")
def q_top_k_remainder(spark, sf):
    return PR.top_k_remainder(reviews(spark, sf), "city", 10)


def _top_other_sql(src: str, col: str, k: int) -> str:
    return f"""
WITH c AS (SELECT {col}, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}),
r AS (SELECT {col}, n, row_number() OVER (ORDER BY n DESC, {col}) AS rk FROM c),
g AS (SELECT CASE WHEN rk <= {k} THEN {col} ELSE 'Other' END AS {col},
             CAST(CASE WHEN rk <= {k} THEN rk ELSE {k + 1} END AS INTEGER) AS rank, CAST(sum(n) AS BIGINT) AS "count"
      FROM r GROUP BY 1, 2),
tot AS (SELECT sum(n) AS total FROM c)
SELECT {col}, rank, "count", {sql_pct('"count"', 'total')} AS pct,
       CAST("count" AS VARCHAR) || ' (' || CAST(((2000 * "count" + total) // (2 * total)) // 10 AS VARCHAR) || '.'
       || CAST(((2000 * "count" + total) // (2 * total)) % 10 AS VARCHAR) || '%)' AS label
FROM g, tot"""


@register("top_k_other", _top_other_sql("reviews", "bank", 15), doubles=("pct",))
def q_top_k_other(spark, sf):
    return round_doubles(PR.top_k_other(reviews(spark, sf), "bank", 15))


@register("reverse_order", f'SELECT *, CAST(row_number() OVER (ORDER BY "count", bank) AS INTEGER) AS position '
          f'FROM ({_top_other_sql("reviews", "bank", 15)}) t', doubles=("pct",))
def q_reverse_order(spark, sf):
    shown = SH.reverse_order(PR.top_k_other(reviews(spark, sf), "bank", 15), "count", "bank")
    return round_doubles(SH.number_shown(shown))


@register("top_k_coverage", f"""
WITH c AS (SELECT city, count(*) AS "count" FROM reviews WHERE city IS NOT NULL GROUP BY city),
t AS (SELECT city, "count", CAST(row_number() OVER (ORDER BY "count" DESC, city) AS INTEGER) AS rank FROM c),
n AS (SELECT count(*) AS n_all FROM reviews)
SELECT city, "count", rank, {sql_pct('"count"', 'n_all')} AS pct,
       {sql_pct('(SELECT sum("count") FROM t WHERE rank <= 8)', 'n_all')} AS coverage_pct
FROM t, n WHERE rank <= 8""", doubles=("pct", "coverage_pct"))
def q_top_k_coverage(spark, sf):
    return round_doubles(PR.top_k_coverage(reviews(spark, sf), "city", 8))


def _missing_sql() -> str:
    parts = []
    for f in REVIEWS.fields:
        cond = f'"{f.name}" IS NULL' + (f' OR isnan("{f.name}")' if f.dataType.typeName() == "double" else "")
        parts.append(f"SELECT '{f.name}' AS \"column\", count(*) FILTER (WHERE {cond}) AS missing, "
                     f"(SELECT count(*) FROM reviews) AS n FROM reviews")
    u = " UNION ALL ".join(parts)
    return f'SELECT "column", missing, {sql_pct("missing", "n")} AS pct FROM ({u}) t WHERE missing > 0'


@register("missing_profile", _missing_sql(), doubles=("pct",))
def q_missing_profile(spark, sf):
    return round_doubles(PR.missing_profile(reviews(spark, sf)))


def _describe_sql(cols, src="reviews") -> str:
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {src}""" for c in cols]
    return " UNION ALL ".join(parts)


_DESC_D = ("mean", "std", "min", "p25", "p50", "p75", "max")


@register("describe_numeric", _describe_sql(RC), doubles=_DESC_D)
def q_describe_numeric(spark, sf):
    return round_doubles(PR.describe_numeric(reviews(spark, sf), RC))


@register("head_rows", "SELECT * FROM reviews ORDER BY review_id LIMIT 5", doubles=P3)
def q_head_rows(spark, sf):
    return round_doubles(PR.head_rows(reviews(spark, sf), "review_id", 5))


@register("boolean_profile", f"""
SELECT flag, value, "count", {sql_pct('"count"', 'sum("count") OVER (PARTITION BY flag)')} AS pct FROM (
  SELECT 'scored' AS flag, NEGATIVE IS NOT NULL AS value, count(*) AS "count" FROM reviews GROUP BY 2 UNION ALL
  SELECT 'rated', grade > 0, count(*) FROM reviews WHERE grade IS NOT NULL GROUP BY 2) t""", doubles=("pct",))
def q_boolean_profile(spark, sf):
    r = reviews(spark, sf).select(F.col("NEGATIVE").isNotNull().alias("scored"), (F.col("grade") > 0).alias("rated"))
    parts = [PR.value_counts_pct(r, c).select(F.lit(c).alias("flag"), F.col(c).alias("value"), "count", "pct")
             for c in r.columns]
    return round_doubles(parts[0].unionByName(parts[1]))


def _info_sql() -> str:
    dtypes = {"LongType": "bigint", "StringType": "string", "IntegerType": "int", "DoubleType": "double"}
    parts = [f"SELECT {i} AS position, '{f.name}' AS \"column\", '{dtypes[type(f.dataType).__name__]}' AS dtype, "
             f"count(\"{f.name}\") AS non_null FROM reviews" for i, f in enumerate(REVIEWS.fields)]
    return " UNION ALL ".join(parts)


@register("table_info", _info_sql())
def q_table_info(spark, sf):
    return PR.table_info(reviews(spark, sf))


def _spread_sql(cols) -> str:
    parts = [f"""SELECT '{c}' AS "column", CAST(median({c}) AS DOUBLE) AS median,
       CAST((SELECT {c} FROM reviews WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS DOUBLE) AS mode,
       stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM reviews"""
             for c in cols]
    return " UNION ALL ".join(parts)


@register("location_spread", _spread_sql(RC), doubles=("median", "mode", "std", "min", "max"))
def q_location_spread(spark, sf):
    return round_doubles(PR.location_spread(reviews(spark, sf), RC))


@register("group_mean_top", f'SELECT bank, {_means_sql(RC)}, count(*) AS "count" FROM reviews WHERE bank IS NOT NULL '
          'GROUP BY bank ORDER BY "count" DESC, bank LIMIT 10', doubles=[f"mean_{c}" for c in RC])
def q_group_mean_top(spark, sf):
    return round_doubles(PR.group_mean_top(reviews(spark, sf), "bank", RC, 10))


@register("group_mean_min_count", f'SELECT city, {_means_sql(RC)}, count(*) AS "count" FROM reviews '
          'WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 5 ORDER BY mean_grade DESC, city LIMIT 15',
          doubles=[f"mean_{c}" for c in RC])
def q_group_mean_min_count(spark, sf):
    return round_doubles(PR.group_mean_min_count(reviews(spark, sf), "city", RC, 5, 15))


@register("group_multi_agg", "SELECT product, " + ", ".join(
    f"avg({c}) AS {c}_mean, count({c}) AS {c}_count, stddev_samp({c}) AS {c}_std" for c in RC)
          + " FROM reviews WHERE product IS NOT NULL GROUP BY product",
          doubles=[f"{c}_{s}" for c in RC for s in ("mean", "std")])
def q_group_multi_agg(spark, sf):
    return round_doubles(PR.group_multi_agg(reviews(spark, sf), "product", RC))


@register("mean_scores_by_grade", "SELECT grade, avg(NEUTRAL) AS mean_NEUTRAL, avg(POSITIVE) AS mean_POSITIVE, "
          "avg(NEGATIVE) AS mean_NEGATIVE FROM reviews WHERE grade IS NOT NULL AND NEUTRAL IS NOT NULL AND "
          "POSITIVE IS NOT NULL AND NEGATIVE IS NOT NULL GROUP BY grade",
          doubles=("mean_NEUTRAL", "mean_POSITIVE", "mean_NEGATIVE"))
def q_mean_scores_by_grade(spark, sf):
    return round_doubles(PR.mean_scores_by_grade(reviews(spark, sf)))


@register("grade_distribution", f"""
SELECT grade, count(*) AS "count", {sql_pct('count(*)', '(SELECT count(*) FROM reviews)')} AS pct
FROM reviews WHERE grade IS NOT NULL GROUP BY grade""", doubles=("pct",))
def q_grade_distribution(spark, sf):
    return round_doubles(PR.grade_distribution(reviews(spark, sf)))


@register("sort_by_key", 'SELECT grade, count(*) AS "count", CAST(row_number() OVER (ORDER BY grade) AS INTEGER) AS position '
          'FROM reviews WHERE grade IS NOT NULL GROUP BY grade')
def q_sort_by_key(spark, sf):
    r = reviews(spark, sf)
    counts = r.where(F.col("grade").isNotNull()).groupBy("grade").agg(F.count(F.lit(1)).alias("count"))
    return SH.number_shown(SH.sort_by_key(counts, "grade"))


@register("satisfaction_levels", f"""
SELECT level, "count", {sql_pct('"count"', 'n')} AS pct FROM (
  SELECT 'high' AS level, count(*) FILTER (WHERE grade >= 4) AS "count", count(*) AS n FROM reviews UNION ALL
  SELECT 'medium', count(*) FILTER (WHERE grade > 2 AND grade < 4), count(*) FROM reviews UNION ALL
  SELECT 'low', count(*) FILTER (WHERE grade <= 2), count(*) FROM reviews) t""", doubles=("pct",))
def q_satisfaction_levels(spark, sf):
    return round_doubles(PR.satisfaction_levels(reviews(spark, sf)))


@register("global_kpis", "SELECT count(*) AS rows, count(DISTINCT bank) AS distinct_bank, count(DISTINCT product) "
          "AS distinct_product, count(DISTINCT city) AS distinct_city, avg(grade) AS mean_grade, "
          "CAST(median(grade) AS DOUBLE) AS median_grade FROM reviews", doubles=("mean_grade", "median_grade"))
def q_global_kpis(spark, sf):
    return round_doubles(PR.global_kpis(reviews(spark, sf)))


@register("date_bounds", "SELECT min(ts) AS min_date, max(ts) AS max_date FROM labelled")
def q_date_bounds(spark, sf):
    return PR.date_bounds(dated(spark, sf), "ts")


_MX = "greatest(NEGATIVE, NEUTRAL, POSITIVE)"


@register("confidence_summary", f"""
SELECT total_reviews, confidence_above_08, confidence_above_075, mean_confidence, median_confidence,
       {sql_pct('confidence_above_08', 'total_reviews')} AS percent_above_08,
       {sql_pct('confidence_above_075', 'total_reviews')} AS percent_above_075
FROM (SELECT count(*) AS total_reviews, count(*) FILTER (WHERE {_MX} >= 0.8) AS confidence_above_08,
             count(*) FILTER (WHERE {_MX} >= 0.75) AS confidence_above_075, avg({_MX}) AS mean_confidence,
             CAST(median({_MX}) AS DOUBLE) AS median_confidence FROM reviews) t""",
          doubles=("mean_confidence", "median_confidence", "percent_above_08", "percent_above_075"))
def q_confidence_summary(spark, sf):
    return round_doubles(PR.confidence_summary(reviews(spark, sf), max_confidence(), median_method="bucketed"))


_EDGES = [0.0, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0]


@register("binned_distribution", "SELECT CAST(b.bin AS INTEGER) AS bin, b.bin_lo, b.bin_hi, "
          "CAST(coalesce(c.n, 0) AS BIGINT) AS \"count\", "
          f"{sql_pct('coalesce(c.n, 0)', '(SELECT count(*) FROM reviews)')} AS pct FROM (VALUES "
          + ", ".join(f"({i}, {float(_EDGES[i])}::DOUBLE, {float(_EDGES[i + 1])}::DOUBLE)" for i in range(len(_EDGES) - 1))
          + ") b(bin, bin_lo, bin_hi) LEFT JOIN (SELECT bin, count(*) AS n FROM (SELECT CASE "
          + " ".join(f"WHEN m > {_EDGES[i]} AND m <= {_EDGES[i + 1]} THEN {i}" for i in range(len(_EDGES) - 1))
          + f" END AS bin FROM (SELECT {_MX} AS m FROM reviews) x) y WHERE bin IS NOT NULL GROUP BY bin) c "
          "ON c.bin = b.bin", doubles=("bin_lo", "bin_hi", "pct"))
def q_binned_distribution(spark, sf):
    return round_doubles(PR.binned_distribution(reviews(spark, sf), max_confidence(), _EDGES))


def _hist_sql(src: str, col: str, k: int) -> str:
    return f"""
WITH s AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
b AS (SELECT CASE WHEN max(x) = min(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
             CASE WHEN max(x) = min(x) THEN max(x) + 0.5 ELSE max(x) END AS hi,
             avg(x) AS mean_mark, CAST(median(x) AS DOUBLE) AS median_mark FROM s),
c AS (SELECT CAST(least(floor((x - lo) * ({k}.0 / (hi - lo))), {k - 1}) AS INTEGER) AS bin, count(*) AS n FROM s, b GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, CAST(g.bin AS DOUBLE) * ((hi - lo) / {k}.0) + lo AS bin_lo,
       CASE WHEN g.bin = {k - 1} THEN hi ELSE CAST(g.bin + 1 AS DOUBLE) * ((hi - lo) / {k}.0) + lo END AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS "count", mean_mark, median_mark
FROM range(0, {k}) g(bin) CROSS JOIN b LEFT JOIN c ON c.bin = g.bin"""


@register("histogram_equal_width", _hist_sql("reviews", "grade", 5),
          doubles=("bin_lo", "bin_hi", "mean_mark", "median_mark"))
def q_histogram_equal_width(spark, sf):
    return round_doubles(PR.histogram_equal_width(reviews(spark, sf), "grade", 5))


def _kde_sql(src: str, col: str, points: int = 200, bins: int = 5) -> str:
    return f"""
WITH s AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
st AS (SELECT count(*) AS n, min(x) AS mn, max(x) AS mx, stddev_samp(x) AS sd FROM s),
p AS (SELECT n, mn, mx, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, (mx - mn) / {float(bins)} AS width FROM st),
vc AS (SELECT x, count(*) AS cnt FROM s GROUP BY x),
g AS (SELECT CAST(i AS INTEGER) AS point, mn + CAST(i AS DOUBLE) * (mx - mn) / {float(points - 1)} AS gx, bw, width
      FROM range(0, {points}) r(i), p WHERE bw > 0)
SELECT point, gx AS x, sum(cnt * exp(-0.5 * pow((gx - vc.x) / bw, 2))) * (width / (bw * sqrt(2 * pi()))) AS density
FROM g, vc GROUP BY point, gx, bw, width"""


@register("kde_curve", _kde_sql("reviews", "grade"), doubles=("x", "density"))
def q_kde_curve(spark, sf):
    return round_doubles(PR.kde_curve(reviews(spark, sf), "grade", 200, 5))


def _box_sql(src_sql: str) -> str:
    return f"""
WITH b AS ({src_sql}),
q AS (SELECT g, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM b GROUP BY g)
SELECT q.g AS variable, q.n, q1, median, q3,
       least(q1, min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))) AS whisker_low,
       greatest(q3, max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))) AS whisker_high,
       count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM b JOIN q ON q.g = b.g GROUP BY q.g, q.n, q1, median, q3"""


_MELT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS g, CAST({c} AS DOUBLE) AS v FROM reviews WHERE {c} IS NOT NULL"
                               for c in SUB_RATING_COLS)


@register("box_stats", _box_sql(_MELT_SQL), doubles=("q1", "median", "q3", "whisker_low", "whisker_high"))
def q_box_stats(spark, sf):
    m = SH.melt(reviews(spark, sf), SUB_RATING_COLS)
    return round_doubles(PR.box_stats(m, "variable", "value"))


def _corr_sql(cols, src="reviews", only_upper=False, threshold=None) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if only_upper and j <= i:
                continue
            if a == b:
                expr = f"CASE WHEN var_samp({a}) = 0 THEN NULL ELSE var_samp({a}) / var_samp({a}) END"
            else:
                a2 = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
                b2 = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
                den = f"(stddev_samp({a2}) * stddev_samp({b2}))"
                expr = f"CASE WHEN {den} = 0 THEN NULL ELSE covar_samp({a2}, {b2}) / {den} END"
            parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {expr} AS r FROM {src}")
    u = " UNION ALL ".join(parts)
    return u if threshold is None else f"SELECT * FROM ({u}) t WHERE abs(r) > {threshold}"


@register("corr_matrix", _corr_sql(RC), doubles=("r",))
def q_corr_matrix(spark, sf):
    return round_doubles(PR.corr_matrix(reviews(spark, sf), RC))


@register("high_corr_pairs", _corr_sql(RC, only_upper=True, threshold=0.5), doubles=("r",))
def q_high_corr_pairs(spark, sf):
    return round_doubles(PR.high_corr_pairs(reviews(spark, sf), RC, 0.5))


# ----------------------------------------------------------------- ranking / reshaping
@register("rank_rows", 'SELECT bank, "count", CAST(row_number() OVER (ORDER BY "count" DESC, bank) AS INTEGER) AS rank '
          'FROM (SELECT bank, count(*) AS "count" FROM reviews WHERE bank IS NOT NULL GROUP BY bank) t '
          'QUALIFY rank <= 5')
def q_rank_rows(spark, sf):
    counts = PR.value_counts(reviews(spark, sf), "bank")
    return SH.rank_rows(counts, "count", "bank", 5)


@register("top_k_sorted", 'SELECT city, count(*) AS "count", '
          'CAST(row_number() OVER (ORDER BY count(*) DESC, city) AS INTEGER) AS position FROM reviews '
          'WHERE city IS NOT NULL GROUP BY city ORDER BY "count" DESC, city LIMIT 10')
def q_top_k_sorted(spark, sf):
    return SH.number_shown(SH.top_k_sorted(PR.value_counts(reviews(spark, sf), "city"), "count", "city", 10))


@register("dedup_keep_first", "SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY review ORDER BY review_id) = 1",
          doubles=P3)
def q_dedup_keep_first(spark, sf):
    return round_doubles(SH.dedup_keep_first(reviews(spark, sf), "review", "review_id"))


@register("distinct_options", "SELECT 'All' AS option UNION ALL SELECT DISTINCT CAST(bank AS VARCHAR) FROM reviews "
          "WHERE bank IS NOT NULL")
def q_distinct_options(spark, sf):
    return SH.distinct_options(reviews(spark, sf), "bank")


@register("union_rows", 'SELECT product, count(*) AS "count" FROM reviews WHERE product IS NOT NULL GROUP BY product '
          'UNION ALL SELECT \'Total\', count(*) FROM reviews WHERE product IS NOT NULL')
def q_union_rows(spark, sf):
    counts = PR.value_counts(reviews(spark, sf), "product")
    total = counts.agg(F.lit("Total").alias("product"), F.sum("count").cast("long").alias("count"))
    return SH.union_rows(counts, total)


@register("melt", " UNION ALL ".join(f"SELECT review_id, '{c}' AS variable, {c} AS value FROM reviews"
                                     for c in SUB_RATING_COLS))
def q_melt(spark, sf):
    return SH.melt(reviews(spark, sf), SUB_RATING_COLS, ["review_id"])


@register("expand_struct", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def q_expand_struct(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "k int").alias("props"))
    return SH.expand_struct(e, "props")
