"""Design cells: one row per (variant, coverage, model_id, part, factor levels).

All predictors are categorical, so fits, calibration and prices need only
cells. ``base_cells`` reads the training rows once: counts, claim counts and
amounts by fold and the levels of every factor. These add, so a variant's cells
are sums over the factors that it does not use (set to one level), and a model's
cells sums over its folds. Spread is carried as centred sums of squares, which
merge without the cancellation of raw ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratewise.operators.levels import factor_levels
from ratewise.operators.weighted import ANY

#: frequency response -> its columns in the base cells
FREQUENCY = {"has_claim": ("s_has", "m2_has"), "claim_n": ("s_claims", "m2_claims")}


def base_cells(folds: DataFrame, factors) -> DataFrame:
    """(coverage, fold, factors): n, n_pos, total_paid and the sum and centred squares of both frequency responses."""
    has, claims = F.col("has_claim").cast("double"), F.col("claim_n").cast("double")
    return folds.groupBy("coverage", "fold", *factors).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("total_paid") > 0).alias("n_pos"), F.sum("total_paid").alias("total_paid"),
        F.sum(has).alias("s_has"), (F.var_pop(has) * F.count(has)).alias("m2_has"),
        F.sum(claims).alias("s_claims"), (F.var_pop(claims) * F.count(claims)).alias("m2_claims"))


def spread(cells: DataFrame, variants, factors, **columns) -> DataFrame:
    """``cells`` once for each variant, factors that it does not use at one level.

    ``columns``: further output columns, each a function of the variant.
    """
    parts = []
    for v in variants:
        made = [F.col(f) if f in v.factors else F.lit(ANY).alias(f) for f in factors]
        rest = [c for c in cells.columns if c not in factors]
        parts.append(cells.select(F.lit(v.name).alias("variant"), *rest, *made, *[f(v).alias(c) for c, f in columns.items()]))
    return reduce(DataFrame.unionByName, parts)


def merge_moments(parts: DataFrame, keys) -> DataFrame:
    """(keys, n, sy, m2) of parts (keys, n, sy, m2): centred sums of squares about the merged mean."""
    whole = Window.partitionBy(*keys)
    parts = parts.filter("n > 0").withColumn("_mean", F.sum("sy").over(whole) / F.sum("n").over(whole))
    off = F.col("sy") / F.col("n") - F.col("_mean")
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def design_cells(base: DataFrame, capped: DataFrame, membership: DataFrame, variants, factors) -> DataFrame:
    """All variants' cells: n rows, Σy and centred Σy² of the frequency and the capped severity responses.

    base    ``base_cells``
    capped  ``severity.capped_cells``
    """
    factors = list(factors)
    keys = ["variant", "coverage", "model_id", "part", *factors]
    sums = {"sy": lambda v: F.col(FREQUENCY[v.freq_response][0]), "m2": lambda v: F.col(FREQUENCY[v.freq_response][1])}
    freq = spread(base.select("coverage", "fold", *factors, "n", *[c for x in FREQUENCY.values() for c in x]), variants, factors, **sums)
    freq = freq.join(membership, on="fold").withColumn("part", F.lit("freq")).select(*keys, "n", "sy", "m2")
    own = F.coalesce(*[F.when((F.col("variant") == v.name) & (F.col("response") == v.sev_response), F.lit(True)) for v in variants], F.lit(False))
    sev = spread(capped.select("response", "coverage", "model_id", *factors, "n", "mean", "m2"), variants, factors).filter(own)
    sev = sev.withColumn("part", F.lit("sev")).withColumn("sy", F.col("n") * F.col("mean")).select(*keys, "n", "sy", "m2")
    return merge_moments(freq.unionByName(sev), keys)


def model_levels(cells: DataFrame, factors, by=("coverage", "model_id", "part")) -> DataFrame:
    """Levels each fit has seen; of all training rows for frequency, of claimants for severity."""
    return factor_levels(cells, factors, by=by)
