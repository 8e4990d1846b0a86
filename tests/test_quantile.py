import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewise.operators.quantile import exact_quantile


def type7(xs, p):
    return float(np.quantile(np.asarray(xs, dtype=float), p, method="linear"))


def run(spark, data, p):
    df = spark.createDataFrame(data, "g string, v double")
    out = exact_quantile(df, ["g"], "v", p)
    return {r.g: (r.n, r.q) for r in out.collect()}


def test_small_groups(spark):  # T7: 1..37 gives 35.2 at .95
    data = [("a", float(i)) for i in range(1, 38)] + [("b", 5.0), ("b", None)]
    got = run(spark, data, 0.95)
    assert abs(got["a"][1] - 35.2) < 1e-12
    assert got["b"] == (1, 5.0)


def test_many_ranges_and_a_hot_tie(spark):
    rng = np.random.default_rng(3)
    a = rng.lognormal(6, 1.5, 5000).round(2)
    b = np.concatenate([np.zeros(3000), rng.exponential(50, 2000)])  # a hot tie
    data = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    for p in (0.0, 0.5, 0.85, 0.97, 0.995, 1.0):
        got = run(spark, data, p)
        assert abs(got["a"][1] - type7(a, p)) <= 1e-9 * max(1.0, abs(type7(a, p)))
        assert abs(got["b"][1] - type7(b, p)) <= 1e-9 * max(1.0, abs(type7(b, p)))


def test_per_group_probability(spark):
    data = [("Liability", float(i)) for i in range(100)] + [("Other", float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "g string, v double")
    p = F.when(F.col("g") == "Liability", F.lit(0.97)).otherwise(F.lit(0.5))
    got = {r.g: r.q for r in exact_quantile(df, ["g"], "v", p).collect()}
    assert abs(got["Liability"] - 96.03) < 1e-9 and abs(got["Other"] - 49.5) < 1e-9


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.sampled_from([0.1, 0.5, 0.92, 0.97]))
def test_property_matches_numpy(spark, xs, p):
    data = [("g", float(x)) for x in xs]
    got = run(spark, data, p)
    assert abs(got["g"][1] - type7(xs, p)) < 1e-9


def test_one_group_with_most_rows_and_equal_values(spark):
    """A group of 90 % of the rows is spread over several ranges; equal values are one row."""
    rng = np.random.default_rng(5)
    hot = rng.lognormal(6, 1.5, 9000)
    data = [("hot", float(x)) for x in hot] + [("same", 7.5)] * 1000
    saved = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for p in (0.0, 0.85, 0.97, 1.0):
            got = run(spark, data, p)
            assert abs(got["hot"][1] - type7(hot, p)) <= 1e-9 * type7(hot, p)
            assert got["same"] == (1000, 7.5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", saved)
