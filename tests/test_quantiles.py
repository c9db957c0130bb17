"""exact_quantiles must equal Spark's exact percentile whatever the refinement depth."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _reference(df, value, group):
    q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in PROBS]))
    return {tuple(r[:len(group)]): list(r["q"]) for r in
            df.where(F.col(value).isNotNull()).groupBy(*group).agg(q.alias("q")).collect()}


@pytest.mark.parametrize("buckets,small", [(4096, 65536), (4, 3), (16, 50)])
def test_grouped_with_hot_key_ties_and_nulls(spark, buckets, small):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 else f"g{i % 5}"  # one key holds two thirds of the rows
        v = rnd.choice([rnd.gauss(0, 1e3), float(rnd.randint(0, 5)), None, 1e-9 * rnd.random()])
        rows.append((g, v))
    rows += [("const", 4.0)] * 10 + [("one", -2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = exact_quantiles(df, "v", PROBS, ["g"], buckets=buckets, small=small).collect()
    ref = _reference(df, "v", ["g"])
    assert len(got) == len(ref)
    for r in got:
        assert [r[f"q{i}"] for i in range(len(PROBS))] == ref[(r.g,)], r.g


def test_global_integers(spark):
    df = spark.range(0, 1001).select((F.col("id") * 7 % 101).alias("v"))
    got = exact_quantiles(df, "v", PROBS, buckets=8, small=5).first()
    ref = df.select(F.percentile(F.col("v").cast("double"), F.array(*[F.lit(p) for p in PROBS]))).first()[0]
    assert [got[f"q{i}"] for i in range(len(PROBS))] == list(ref) and got.n == 1001


def test_extreme_magnitudes_signs_and_infinities(spark):
    # n − 1 divisible by 4: every quartile is an exact order statistic
    vals = [float("-inf"), -1e308, -3.5, -5e-324, -0.0, 0.0, 5e-324, 1e-300, 2.0, 2.0, 1e308, float("inf"), 7.25]
    vals += [(-1) ** i * 10.0 ** (i % 40 - 20) for i in range(40)]
    vals = vals[:len(vals) - (len(vals) - 1) % 4]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    s = sorted(vals)
    want = [s[int(p * (len(s) - 1))] for p in probs]
    for buckets, small in [(4096, 65536), (4, 2)]:
        got = exact_quantiles(df, "v", probs, buckets=buckets, small=small).first()
        assert [got[f"q{i}"] for i in range(len(probs))] == want and got.n == len(vals)
