"""Severity cap and partial uncapping, per (coverage, model_id).

The cap is a percentile of the claimants' severities in each model's own
training rows (model 0 = all folds, model m = all folds but m). Claimant rows
are counted once: every distinct severity of a coverage carries its count per
fold, and model m's counts are the total less fold m's. The values are sorted
once for the quantiles of all models, and one further pass over the claimants
sums the capped severities under every model's cap side by side, by fold and
factor levels; a model's sums are those of its folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise import config as C
from ratewise.functions.nulls import least_strict, safe_div
from ratewise.operators.quantile import weighted_quantiles
from ratewise.session import materialize, small

#: severity response -> the column whose positive value marks a claimant
CLAIMANT = {"total_paid": "total_paid", "avg_paid": "claim_n"}


def by_coverage(coverage_col, gm, liab, other) -> F.Column:
    c = F.col(coverage_col) if isinstance(coverage_col, str) else coverage_col
    return F.when(c == C.GUEST_MEDICAL, F.lit(gm)).when(c == C.LIABILITY, F.lit(liab)).otherwise(F.lit(other))


def sev_cap_prob(c="coverage"):
    return by_coverage(c, C.GM_SEV_CAP_P, C.LIAB_SEV_CAP_P, C.SEV_CAP_P)


def uncap_alpha(c="coverage"):
    return by_coverage(c, C.GM_UNCAP_ALPHA, C.LIAB_UNCAP_ALPHA, C.UNCAP_ALPHA)


def claimant_rows(folds: DataFrame, responses, factors) -> DataFrame:
    """(response, coverage, fold, factors, y): a claimant once for each severity response asked for."""
    each = [F.when(F.col(CLAIMANT[r]) > 0, F.struct(F.lit(r).alias("response"), F.col(r).cast("double").alias("y"))) for r in responses]
    rows = folds.select("coverage", "fold", *factors, F.explode(F.array(*each)).alias("_r")).filter("_r IS NOT NULL")
    return rows.select("_r.response", "coverage", "fold", *factors, "_r.y")


def severity_caps(claimants: DataFrame, exposures: DataFrame, k: int, min_pos: int = C.MIN_POS_FOR_CAP) -> DataFrame:
    """(response, coverage, n, n_pos, cap): arrays over the models 0 to k; cap is +inf where the model has too few claimants.

    claimants  ``claimant_rows``
    exposures  (coverage, fold, n): exposure rows
    """
    models = range(k + 1)
    in_fold = [F.count_if(F.col("fold") == f).alias(f"_f{f}") for f in range(1, k + 1)]
    whole = sum((F.col(f"_f{f}") for f in range(1, k + 1)), F.lit(0))
    model = [whole.alias("m0"), *[(whole - F.col(f"_f{m}")).alias(f"m{m}") for m in range(1, k + 1)]]
    good = F.col("y").isNotNull() & ~F.isnan("y")
    counted = claimants.filter(good).groupBy("response", "coverage", "y").agg(*in_fold).select("response", "coverage", "y", *model)
    names = [f"m{m}" for m in models]
    q = weighted_quantiles(counted, ["response", "coverage"], "y", names, sev_cap_prob())
    pos = claimants.groupBy("response", "coverage").agg(*in_fold).select("response", "coverage", *[x.alias(f"p{m}") for m, x in enumerate(model)])
    n = exposures.groupBy("coverage").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == f, F.col("n"))), F.lit(0)).alias(f"_f{f}") for f in range(1, k + 1)])
    n = n.select("coverage", *[x.alias(f"e{m}") for m, x in enumerate(model)])
    out = n.join(pos, "coverage", "left").join(q, ["response", "coverage"], "left")
    n_pos = [F.coalesce(F.col(f"p{m}"), F.lit(0)) for m in models]
    cap = [F.when(n_pos[m] >= min_pos, F.col(f"q_m{m}")).otherwise(F.lit(float("inf"))) for m in models]
    return out.select("response", "coverage", F.array(*[F.col(f"e{m}") for m in models]).alias("n"),
                      F.array(*n_pos).alias("n_pos"), F.array(*cap).alias("cap"))


def capped_cells(claimants: DataFrame, caps: DataFrame, factors, k: int) -> DataFrame:
    """(response, coverage, fold, factors, model_id, n, mean, m2, y_all, y_raw, rows) for the models that use the fold.

    n, mean, m2  count, mean and centred sum of squares of the capped severities above 0
    y_all        sum of all capped severities; y_raw: of the uncapped ones; rows: of how many
    """
    rows = claimants.join(small(caps).select("response", "coverage", "cap"), ["response", "coverage"])
    aggs = []
    for m in range(k + 1):
        y = least_strict("y", F.get("cap", F.lit(m)))
        pos = F.when(y > 0, y)
        aggs.append(F.struct(F.lit(m).alias("model_id"), F.count(pos).alias("n"), F.avg(pos).alias("mean"),
                             (F.var_pop(pos) * F.count(pos)).alias("m2"), F.sum(y).alias("y_all")).alias(f"_m{m}"))
    good = F.when(~F.isnan("y"), F.col("y"))
    g = rows.groupBy("response", "coverage", "fold", *factors).agg(*aggs, F.sum(good).alias("y_raw"), F.count(good).alias("rows"))
    g = g.select("response", "coverage", "fold", *factors, "y_raw", "rows", F.explode(F.array(*[f"_m{m}" for m in range(k + 1)])).alias("_m"))
    g = g.filter((F.col("_m.model_id") == 0) | (F.col("_m.model_id") != F.col("fold")))
    return g.select("response", "coverage", "fold", *factors, "_m.*", "y_raw", "rows")


def uncap_params(caps: DataFrame, capped: DataFrame) -> DataFrame:
    """(response, coverage, model_id): n, n_pos, capped, cap (+inf when not capped), uncap_adj."""
    long = caps.select("response", "coverage", F.posexplode(F.arrays_zip("n", "n_pos", "cap")).alias("model_id", "_z"))
    long = long.select("response", "coverage", "model_id", "_z.*").withColumn("capped", F.col("cap") != float("inf"))
    means = capped.groupBy("response", "coverage", "model_id").agg(
        F.try_divide(F.sum("y_raw"), F.sum("rows")).alias("_m"), F.try_divide(F.sum("y_all"), F.sum("rows")).alias("_mc"))
    out = long.join(means, ["response", "coverage", "model_id"], "left")
    full = F.when(F.col("capped") & ~F.isnan("cap"), safe_div("_m", "_mc")).otherwise(F.lit(1.0))
    return out.select("response", "coverage", "model_id", "n", "n_pos", F.coalesce("capped", F.lit(True)).alias("capped"), "cap",
                      F.pow(full, uncap_alpha()).alias("uncap_adj"))


def severity_tables(folds: DataFrame, exposures: DataFrame, responses, factors, k: int,
                    min_pos: int = C.MIN_POS_FOR_CAP) -> tuple[DataFrame, DataFrame]:
    """``capped_cells`` (written) and ``uncap_params`` of every response and model.

    Coverages without claimants have parameters for every response, with no cap.
    """
    rows = claimant_rows(folds, responses, factors)
    caps = severity_caps(rows, exposures, k, min_pos)
    every = F.explode(F.array(*[F.lit(r) for r in responses]))
    none = exposures.select("coverage").distinct().select(every.alias("response"), "coverage")
    bare = caps.select("coverage", "n").groupBy("coverage").agg(F.max("n").alias("_n"))
    caps = none.join(bare, "coverage").join(caps.drop("n"), ["response", "coverage"], "left")
    inf = F.array(*[F.lit(float("inf"))] * (k + 1))
    zero = F.array(*[F.lit(0).cast("long")] * (k + 1))
    caps = materialize(caps.select("response", "coverage", F.col("_n").alias("n"), F.coalesce("n_pos", zero).alias("n_pos"), F.coalesce("cap", inf).alias("cap")), "severity-caps")
    capped = materialize(capped_cells(rows, caps, factors, k), "severity-cells")
    return capped, uncap_params(caps, capped)
