"""Exact type-7 quantiles per group without holding a group in one task.

R's default ``quantile`` (and DuckDB's ``quantile_cont``) interpolates
between the order statistics at 0-based ranks floor(h) and ceil(h), with
h = (n - 1) p. Spark's exact ``percentile`` aggregate keeps every distinct
value of a group in one buffer, which does not scale when one coverage holds
a third of the rows, and ``percentile_approx`` is not exact.

One path serves groups of every size:

1. distinct values carry weights, how often each occurs (partial aggregate; a
   tie of any weight is one row), and are sorted into ranges of (keys, value),
   which are written once;
2. the weights of each (group, range) and their prefix sums show which range
   holds each of the two order statistics;
3. only those ranges are ranked, each in a window partition of its own.

Weights add, so several may be ranked at once over the same sorted values: the
quantiles of "all folds but m" for every m need the values sorted once. A task
holds one range at most, and nothing is collected to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.session import materialize


def _lit_prob(prob):
    return F.lit(float(prob)) if isinstance(prob, (int, float)) else prob


def weighted_quantiles(counted: DataFrame, keys, value: str, weights, prob) -> DataFrame:
    """One row per group: keys and, for each weight ``w``, ``n_w`` (its sum) and ``q_w``.

    ``counted`` holds each (keys, value) once, without nulls or NaN; a weight says how many
    equal values a row stands for. ``prob`` is a number or a Column built from the key
    columns. A group whose weights are all 0 has a null quantile.
    """
    keys, weights = list(keys), list(weights)
    base = counted.select(*keys, F.col(value).cast("double").alias("_v"), *[F.col(w).cast("long").alias(f"_w{i}") for i, w in enumerate(weights)])
    ranged = base.repartitionByRange(*keys, "_v").sortWithinPartitions(*keys, "_v")
    values = materialize(ranged.withColumn("_range", F.spark_partition_id()), "values")

    each = range(len(weights))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = values.groupBy(*keys, "_range").agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in each])
    sums = sums.select("*", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_below{i}") for i in each],
                       *[F.sum(f"_s{i}").over(whole).alias(f"_n{i}") for i in each], _lit_prob(prob).cast("double").alias("_p"))
    sums = sums.select("*", *[((F.col(f"_n{i}") - 1) * F.col("_p")).alias(f"_h{i}") for i in each])

    def rank(i, up):
        return F.ceil(f"_h{i}") if up else F.floor(f"_h{i}")

    def holds(i, up):
        return (F.col(f"_below{i}") <= rank(i, up)) & (rank(i, up) < F.col(f"_below{i}") + F.col(f"_s{i}"))

    wanted = sums.filter(reduce(lambda a, b: a | b, [holds(i, up) for i in each for up in (False, True)]))
    wanted = wanted.drop("_p", *[f"_s{i}" for i in each])
    upto = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(wanted, on=[*keys, "_range"])
    ranked = ranked.select("*", *[(F.col(f"_below{i}") + F.sum(f"_w{i}").over(upto)).alias(f"_end{i}") for i in each])

    def at(i, up):
        end = F.col(f"_end{i}")
        return F.max(F.when((end - F.col(f"_w{i}") <= rank(i, up)) & (rank(i, up) < end), F.col("_v")))

    aggs = []
    for i in each:
        aggs += [F.max(f"_n{i}").alias(f"_n{i}"), F.max(f"_h{i}").alias(f"_h{i}"), at(i, False).alias(f"_lo{i}"), at(i, True).alias(f"_hi{i}")]
    picked = ranked.groupBy(*keys).agg(*aggs)
    out = []
    for i, w in enumerate(weights):
        part = F.col(f"_h{i}") - F.floor(f"_h{i}")
        out += [F.col(f"_n{i}").alias(f"n_{w}"), (F.col(f"_lo{i}") + part * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q_{w}")]
    return picked.select(*keys, *out)


def value_counts(df: DataFrame, keys, value, weight=None) -> DataFrame:
    """(keys, ``_v``, ``w``): each non-null value of a group once, with its rows or its sum of weights."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.lit(1) if weight is None else F.col(weight)
    base = df.select(*keys, v.cast("double").alias("_v"), w.alias("_one"))
    return base.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.sum("_one").alias("w"))


def exact_quantile(df: DataFrame, keys, value, prob, out: str = "q", weight=None) -> DataFrame:
    """One row per group: keys, ``n`` (non-null values) and the quantile ``out``.

    ``prob`` is a number or a Column built from the key columns. Nulls are skipped
    (``na.rm = TRUE``); a group without values has no row. With ``weight`` a row stands
    for that many equal rows.
    """
    keys = list(keys)
    q = weighted_quantiles(value_counts(df, keys, value, weight), keys, "_v", ["w"], prob)
    return q.select(*keys, F.col("n_w").alias("n"), F.col("q_w").alias(out))
