import math

from pyspark.sql import functions as F

from ratewise.functions import (
    band_distance, band_gpa, clamp_strict, clean_category, greatest_strict, least_strict, mean_strict,
    safe_div, zero_sum)


def test_pmin_pmax_are_null_if_any_null(spark):  # T2
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(least_strict("a", "b"), greatest_strict("a", "b")).collect()]
    assert got == [(None, None), (1.0, 2.0)]
    assert df.select(clamp_strict("b", F.lit(1.5), F.lit(3.0))).collect()[1][0] == 2.0


def test_strict_mean_and_zero_sum(spark):  # T3, T4, T5
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("c", None)], "g string, x double")
    got = {r.g: (r.m, r.s, r.a) for r in df.groupBy("g").agg(
        mean_strict("x").alias("m"), zero_sum("x").alias("s"), F.avg("x").alias("a")).collect()}
    assert got["a"] == (None, 1.0, 1.0)
    assert got["b"] == (2.0, 2.0, 2.0)
    assert got["c"] == (None, 0.0, None)


def test_division_by_zero_is_null(spark):  # T8
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, None, 1.5]


def test_distance_bands(spark):  # T17
    vals = [None, -1.0, 0.0, 1.0, 1.01, 3.0, 3.01]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, distance_to_campus double")
    got = [r.dist_band for r in band_distance(df).orderBy("i").collect()]
    assert got == ["Unknown", "0-1", "0", "0-1", "1-3", "1-3", "3+"]


def test_gpa_bands(spark):
    vals = [None, 1.99, 2.0, 2.99, 3.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, gpa double")
    got = [r.gpa_band for r in band_gpa(df).orderBy("i").collect()]
    assert got == ["Unknown", "<2.0", "2.0-2.99", "2.0-2.99", "3.0+"]


def test_clean_category(spark):
    df = spark.createDataFrame([(None, True), ("Y", None)], "a string, b boolean")
    got = [tuple(r) for r in clean_category(df, ["a", "b"]).collect()]
    assert got == [("Unknown", "true"), ("Y", "Unknown")]
    assert not math.isnan(0.0)


def test_nan_counts_as_null_in_strict_rules(spark):
    from pyspark.sql import functions as F

    from ratewise.functions.nulls import clamp_strict, greatest_strict, least_strict, mean_strict

    df = spark.createDataFrame([(float("nan"), 1.0), (2.0, 3.0)], "a double, b double")
    got = df.select(least_strict("a", "b"), greatest_strict("b", "a"), clamp_strict("a", 0.7, 1.5)).collect()
    assert [tuple(x) for x in got] == [(None, None, None), (2.0, 3.0, 1.5)]
    assert df.agg(mean_strict("a")).first()[0] is None and df.agg(mean_strict("b")).first()[0] == 2.0
    assert df.select(F.lit(1)).count() == 2
