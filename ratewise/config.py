"""Pricing configuration: the three model variants and their shared constants.

A variant is a frozen dataclass; every operator takes the pieces it needs
from it, so one code path serves all three variants.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values. These must equal the reference model's settings for the
# results to agree; they are the same in all three variants.
# ---------------------------------------------------------------------------
K_FOLDS = 5
FOLD_SEED = 1

SEV_CAP_P = 0.95
GM_SEV_CAP_P = 0.85
LIAB_SEV_CAP_P = 0.97
MIN_POS_FOR_CAP = 30

UNCAP_ALPHA = 0.20
GM_UNCAP_ALPHA = 0.00
LIAB_UNCAP_ALPHA = 0.95

PRED_CAP_P = 0.97
GM_PRED_CAP_P = 0.92
LIAB_PRED_CAP_P = 0.995
MIN_N_FOR_PRED_CAP = 50

LIAB_BLEND_W = 0.40

CAL_CLAIM_K = 1000
CAL_CAP_LOW = 0.70
CAL_CAP_HIGH = 1.30

FIXED_EXP_RENEW = 25
VAR_EXP_RENEW = 0.30
FIXED_EXP_NEW = 35
VAR_EXP_NEW = 0.35
PROFIT = 0.05

REL_ALPHA = 0.35
REL_CAP_LOW = 0.70
REL_CAP_HIGH = 1.50

USE_CRED_TIER_SMOOTH = True
CRED_K = 800

MIN_CLAIMS_FOR_FREQ_FACTORS = 20
MIN_POS_FOR_SEV_FACTORS = 30

GUEST_MEDICAL = "Guest Medical"
LIABILITY = "Liability"
UNKNOWN = "Unknown"
# ---------------------------------------------------------------------------

FACTORS_M1 = ("risk_tier", "off_campus", "sprinklered", "greek", "dist_band", "gpa_band")
FACTORS_M2 = ("risk_tier", "off_campus", "sprinklered", "greek", "dist_band")
FACTORS_M3 = ("risk_tier", "off_campus", "sprinklered", "dist_band")


@dataclass(frozen=True)
class Variant:
    """One model variant.

    freq_family    'binomial' (has_claim, logit) or 'poisson' (claim_n, log)
    sev_response   'total_paid' (per exposure) or 'avg_paid' (per claim)
    rollup_mode    'total' or 'count' (adds claim_n and avg_paid)
    min_n_mode     'ignored': the prediction-cap quantile is used whatever the
                   row count (model 1); 'honoured': no cap below the minimum
    clean_cols     categorical columns cleaned to 'Unknown'
    align_cols     columns whose test values are aligned to the training levels
    """

    name: str
    freq_family: str
    sev_response: str
    rollup_mode: str
    factors: tuple[str, ...]
    min_n_mode: str
    clean_cols: tuple[str, ...]
    align_cols: tuple[str, ...]
    with_gpa: bool
    with_dispersion: bool
    k_folds: int = K_FOLDS
    fold_seed: int = FOLD_SEED
    cred_smooth: bool = USE_CRED_TIER_SMOOTH

    def with_factors(self, factors) -> "Variant":
        return replace(self, factors=tuple(factors), name=f"{self.name}_" + "_".join(factors))

    @property
    def freq_response(self) -> str:
        return "has_claim" if self.freq_family == "binomial" else "claim_n"

    @property
    def pos_column(self) -> str:
        """Column whose positive value marks a claimant for the severity part."""
        return "total_paid" if self.sev_response == "total_paid" else "claim_n"


M1 = Variant(
    name="m1",
    freq_family="binomial",
    sev_response="total_paid",
    rollup_mode="total",
    factors=FACTORS_M1,
    min_n_mode="ignored",
    clean_cols=("coverage", "risk_tier", "greek", "off_campus", "sprinklered", "gender"),
    align_cols=("coverage", "risk_tier", "greek", "off_campus", "sprinklered", "gender",
                "gpa_band", "dist_band"),
    with_gpa=True,
    with_dispersion=False,
)

M2 = Variant(
    name="m2",
    freq_family="poisson",
    sev_response="avg_paid",
    rollup_mode="count",
    factors=FACTORS_M2,
    min_n_mode="honoured",
    clean_cols=("coverage", "risk_tier", "greek", "off_campus", "sprinklered"),
    align_cols=("coverage", "risk_tier", "greek", "off_campus", "sprinklered", "dist_band"),
    with_gpa=False,
    with_dispersion=True,
)

M3 = replace(
    M2,
    name="m3",
    factors=FACTORS_M3,
    clean_cols=("coverage", "risk_tier", "off_campus", "sprinklered"),
    align_cols=("coverage", "risk_tier", "off_campus", "sprinklered", "dist_band"),
)

VARIANTS = {"m1": M1, "m2": M2, "m3": M3}
