"""Out-of-fold calibration, prediction caps and the Liability blend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise import config as C
from ratewise.functions.nulls import clamp_strict, greatest_strict, least_strict, zero_sum
from ratewise.operators import weighted as W
from ratewise.operators.quantile import exact_quantile
from ratewise.operators.severity import by_coverage
from ratewise.session import small


def by(df: DataFrame, *names: str) -> list[str]:
    """Grouping and join columns: the names, behind ``variant`` where the table has it."""
    return [*(["variant"] if "variant" in df.columns else []), *names]


def calibration_factor(oof: DataFrame, k: float = C.CAL_CLAIM_K, lo: float = C.CAL_CAP_LOW,
                       hi: float = C.CAL_CAP_HIGH, pred: str = "oof_pred", weight: str | None = None) -> DataFrame:
    """Per coverage: credibility-weighted actual/expected on out-of-fold predictions.

    ``n_claim`` counts rows with total_paid > 0 in every variant. With ``weight``
    the input is cells, as in all functions here.
    """
    g = oof.groupBy(*by(oof, "coverage")).agg(
        W.claimants(weight).alias("n_claim"),
        zero_sum("total_paid").alias("y"),
        W.total(pred, weight).alias("p"))
    raw = F.col("y") / greatest_strict("p", F.lit(1e-9))
    w = F.col("n_claim") / (F.col("n_claim") + F.lit(k))
    return g.select(*by(oof, "coverage"), "n_claim", "y", "p", raw.alias("raw_cal"), w.alias("w"),
                    clamp_strict(F.lit(1.0) + (raw - 1) * w, F.lit(lo), F.lit(hi)).alias("cal_factor"))


def apply_calibration(scored: DataFrame, cal: DataFrame, pred: str = "pred_loss",
                      out: str = "pred_loss_cal") -> DataFrame:
    j = scored.join(small(cal).select(*by(cal, "coverage"), "cal_factor"), on=by(cal, "coverage"), how="left")
    return j.withColumn(out, F.col(pred) * F.col("cal_factor"))


def pred_cap_prob(c="coverage"):
    return by_coverage(c, C.GM_PRED_CAP_P, C.LIAB_PRED_CAP_P, C.PRED_CAP_P)


def prediction_cap(scored_train: DataFrame, min_n_mode: str | dict, min_n: int = C.MIN_N_FOR_PRED_CAP,
                   pred: str = "pred_loss_cal", weight: str | None = None) -> DataFrame:
    """Per coverage: n rows, p_cap, pred_cap.

    min_n_mode 'honoured': no cap (+inf) below ``min_n`` rows; 'ignored'
    (model 1): the percentile is used whatever n, as the reference's
    ``is.finite`` test on Inf/NA always falls through to the quantile.
    """
    keys = by(scored_train, "coverage")
    n = scored_train.groupBy(*keys).agg(W.rows(weight).alias("n"))
    q = exact_quantile(scored_train, keys, pred, pred_cap_prob(), out="_q", weight=weight).drop("n")
    out = n.join(q, on=keys, how="left").withColumn("p_cap", pred_cap_prob())
    honoured = F.when(F.col("n") < min_n, F.lit(float("inf"))).otherwise(F.col("_q"))
    cap = F.col("_q")
    if isinstance(min_n_mode, dict):
        cap = F.when(F.col("variant").isin([v for v, m in min_n_mode.items() if m == "honoured"]), honoured).otherwise(cap)
    elif min_n_mode == "honoured":
        cap = honoured
    return out.select(*keys, "n", "p_cap", cap.alias("pred_cap"))


def apply_prediction_cap(scored: DataFrame, caps: DataFrame, pred: str = "pred_loss_cal",
                         out: str = "pred_loss_cap") -> DataFrame:
    j = scored.join(small(caps).select(*by(caps, "coverage"), "pred_cap"), on=by(caps, "coverage"), how="left")
    return j.withColumn(out, least_strict(pred, "pred_cap"))


def tier_mean(scored_train: DataFrame, pred: str = "pred_loss_cap", weight: str | None = None) -> DataFrame:
    """Mean capped prediction per (coverage, tier), nulls skipped."""
    return scored_train.groupBy(*by(scored_train, "coverage", "risk_tier")).agg(W.mean(pred, weight).alias("tier_mean_cap"))


def blend_to_tier(scored: DataFrame, tier_means: DataFrame, w: float = C.LIAB_BLEND_W,
                  pred: str = "pred_loss_cap", out: str = "pred_loss_final") -> DataFrame:
    """Liability only: w · tier mean + (1 - w) · own capped prediction."""
    j = scored.join(small(tier_means), on=by(tier_means, "coverage", "risk_tier"), how="left")
    cov = F.col("coverage")
    blended = F.lit(w) * F.col("tier_mean_cap") + F.lit(1 - w) * F.col(pred)
    return j.withColumn(out, F.when(cov.isNull(), F.lit(None).cast("double"))
                        .when(cov == C.LIABILITY, blended).otherwise(F.col(pred)))
