"""From final predicted loss to premiums, with the checks of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise import config as C
from ratewise.functions.nulls import clamp_strict, safe_div, zero_sum
from ratewise.operators import weighted as W
from ratewise.operators.calibrate import by
from ratewise.session import materialize, settled, small


def holdout_check(scored_test: DataFrame, pred: str = "pred_loss_final", weight: str | None = None) -> DataFrame:
    """Per coverage: actual and predicted means (null if any prediction is null), ratio.

    With ``weight`` the input is cells, here and in the other means.
    """
    g = scored_test.groupBy(*by(scored_test, "coverage")).agg(
        W.paid_mean(weight).alias("actual"), W.mean_or_null(pred, weight).alias("pred_c"))
    return g.withColumn("ratio", safe_div("pred_c", "actual"))


def tier_base(scored_train: DataFrame, pred: str = "pred_loss_final", weight: str | None = None) -> DataFrame:
    """Rows and mean final prediction per (coverage, tier); also the tier average."""
    return scored_train.groupBy(*by(scored_train, "coverage", "risk_tier")).agg(
        W.rows(weight).alias("n"), W.mean_or_null(pred, weight).alias("base_loss"))


def coverage_mean(scored_train: DataFrame, pred: str = "pred_loss_final", weight: str | None = None) -> DataFrame:
    return scored_train.groupBy(*by(scored_train, "coverage")).agg(W.mean_or_null(pred, weight).alias("cov_mean"))


def tier_and_coverage_means(scored_train: DataFrame, pred: str = "pred_loss_final", weight: str | None = None):
    """``tier_base`` and ``coverage_mean`` from one pass over grouping sets."""
    extra = by(scored_train)
    sets = [[*extra, "coverage", "risk_tier"], [*extra, "coverage"]]
    g = scored_train.groupingSets([[F.col(c) for c in x] for x in sets], *[F.col(c) for c in sets[0]]).agg(
        W.rows(weight).alias("n"), W.mean_or_null(pred, weight).alias("m"), F.grouping("risk_tier").alias("_all"))
    g = materialize(g, "tier-means")
    tb = g.filter(F.col("_all") == 0).select(*sets[0], "n", F.col("m").alias("base_loss"))
    cm = g.filter(F.col("_all") == 1).select(*sets[1], F.col("m").alias("cov_mean"))
    return settled(tb), settled(cm)


def credibility_smooth(base: DataFrame, cov_mean: DataFrame, k: float = C.CRED_K,
                       on: bool = C.USE_CRED_TIER_SMOOTH) -> DataFrame:
    """w = n/(n+K); base = w · tier mean + (1 - w) · coverage mean (or as is when off)."""
    if not on:
        return base.select(*by(base, "coverage", "risk_tier"), "base_loss")
    j = base.join(small(cov_mean), on=by(base, "coverage"), how="left")
    w = F.col("n") / (F.col("n") + F.lit(k))
    return j.select(*by(base, "coverage", "risk_tier"),
                    (w * F.col("base_loss") + (1 - w) * F.col("cov_mean")).alias("base_loss"))


def gross_premium(loss, fixed, var, profit=C.PROFIT) -> F.Column:
    loss = F.col(loss) if isinstance(loss, str) else loss
    return (loss + F.lit(fixed)) / (F.lit(1.0) - F.lit(var) - F.lit(profit))


def pricing_table(base_loss: DataFrame) -> DataFrame:
    return base_loss.select(
        *by(base_loss, "coverage", "risk_tier"), "base_loss",
        gross_premium("base_loss", C.FIXED_EXP_RENEW, C.VAR_EXP_RENEW).alias("prem_renew"),
        gross_premium("base_loss", C.FIXED_EXP_NEW, C.VAR_EXP_NEW).alias("prem_new"))


def relativity(scored: DataFrame, tier_avg: DataFrame, pred: str = "pred_loss_final") -> DataFrame:
    """(pred / tier average)^alpha, clamped; x/0 → null where R gives Inf/NaN."""
    keys = by(tier_avg, "coverage", "risk_tier")
    ta = small(tier_avg).select(*keys, F.col("base_loss").alias("tier_pred_avg"))
    j = scored.join(ta, on=keys, how="left")
    raw = safe_div(pred, "tier_pred_avg")
    return (j.withColumn("relativity_raw", raw)
            .withColumn("relativity_shrunk", F.pow(F.col("relativity_raw"), F.lit(C.REL_ALPHA)))
            .withColumn("relativity_cap", clamp_strict("relativity_shrunk", F.lit(C.REL_CAP_LOW),
                                                       F.lit(C.REL_CAP_HIGH))))


def row_premiums(rel: DataFrame, pricing: DataFrame) -> DataFrame:
    keys = by(pricing, "coverage", "risk_tier")
    pb = small(pricing).select(*keys, "prem_renew", "prem_new")
    j = rel.join(pb, on=keys, how="left")
    return (j.withColumn("final_prem_renew", F.col("prem_renew") * F.col("relativity_cap"))
            .withColumn("final_prem_new", F.col("prem_new") * F.col("relativity_cap")))


def cap_stats(priced: DataFrame, weight: str | None = None) -> DataFrame:
    s = F.col("relativity_shrunk")
    shares = priced.select("relativity_cap", (s < C.REL_CAP_LOW).cast("double").alias("_low"), (s > C.REL_CAP_HIGH).cast("double").alias("_high"),
                           *([weight] if weight else []))
    return shares.agg(
        W.mean("_low", weight).alias("pct_capped_low"),
        W.mean("_high", weight).alias("pct_capped_high"),
        W.mean("relativity_cap", weight).alias("avg_relativity"))


def student_totals(priced: DataFrame) -> DataFrame:
    return priced.groupBy("student_id", "risk_tier").agg(
        zero_sum("final_prem_renew").alias("total_renew"),
        zero_sum("final_prem_new").alias("total_new"))


def tier_premium_summary(totals: DataFrame) -> DataFrame:
    return totals.groupBy("risk_tier").agg(
        F.avg("total_renew").alias("avg_total_renew"), F.avg("total_new").alias("avg_total_new"))


def quality_gate(totals: DataFrame, priced: DataFrame) -> DataFrame:
    """Null counts as (check, n): the reference's assertion on the totals, plus
    the row premiums feeding them (which ``sum(na.rm = TRUE)`` would hide)."""
    t = totals.agg(F.count(F.lit(1)).alias("n_totals"),
                   F.count_if(F.col("total_renew").isNull()).alias("null_total_renew"),
                   F.count_if(F.col("total_new").isNull()).alias("null_total_new"))
    p = priced.agg(F.count_if(F.col("final_prem_renew").isNull()).alias("null_row_prem_renew"),
                   F.count_if(F.col("final_prem_new").isNull()).alias("null_row_prem_new"))

    def long(df):
        return df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("bigint") for c in df.columns]))).alias("check", "n"))

    return long(t).unionByName(long(p))


def check_quality(gate: DataFrame) -> None:
    r = {row["check"]: row["n"] for row in gate.collect()}  # five rows
    if r.get("null_total_renew") or r.get("null_total_new"):
        raise ValueError(f"null student totals: {r}")
