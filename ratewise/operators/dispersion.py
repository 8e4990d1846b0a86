"""Pearson dispersion χ²/(n − rank) of the final fits, from design cells.

Per cell Σ(y − μ)² = Σ(y − ȳ)² + n(ȳ − μ)², divided by V(μ) (μ Poisson, μ²
gamma): the centred sums of squares that the cells carry don't cancel when the
spread is small against the mean. Computed for Poisson as well, where Spark's GLM summary would report
1.0 by definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.operators.glm import INTERCEPT
from ratewise.operators.scoring import score_cells


def dispersion_table(cells: DataFrame, coefs: DataFrame, params: DataFrame, factors,
                     freq_family: str, model_id: int = 0, lookup: DataFrame | None = None) -> DataFrame:
    factors = list(factors)
    c0 = cells.filter(F.col("model_id") == model_id)
    mu = score_cells(c0.select("coverage", "model_id", *factors).distinct(), coefs, params,
                     factors, freq_family, lookup)
    j = c0.join(mu, on=["coverage", "model_id", *factors], how="left")
    m = F.when(F.col("part") == "freq", F.col("mu_freq")).otherwise(F.col("mu_sev"))
    off = F.col("sy") / F.col("n") - m
    ss = F.col("m2") + F.col("n") * off * off
    v = F.when(F.col("part") == "freq", m).otherwise(m * m)
    chi = j.groupBy("coverage", "part").agg(F.sum(ss / v).alias("chi2"), F.sum("n").alias("n"))
    ranks = coefs.filter((F.col("factor") == INTERCEPT) & (F.col("model_id") == model_id)) \
        .select("coverage", "part", "rank")
    d = chi.join(ranks, on=["coverage", "part"]).withColumn(
        "disp", F.try_divide(F.col("chi2"), F.col("n") - F.col("rank")))
    return d.groupBy("coverage").agg(
        F.max(F.when(F.col("part") == "freq", F.col("disp"))).alias("freq_disp"),
        F.max(F.when(F.col("part") == "sev", F.col("disp"))).alias("sev_disp"))
