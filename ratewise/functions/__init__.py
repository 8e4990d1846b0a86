"""Column-level functions: null rules, cleaning, banding."""

from ratewise.functions.features import band_distance, band_gpa, clean_category, distance_band, gpa_band
from ratewise.functions.nulls import (
    clamp_strict,
    greatest_strict,
    least_strict,
    mean_strict,
    nan_to_null,
    safe_div,
    zero_sum,
)

__all__ = [
    "band_distance", "band_gpa", "clean_category", "distance_band", "gpa_band",
    "clamp_strict", "greatest_strict", "least_strict", "mean_strict", "nan_to_null",
    "safe_div", "zero_sum",
]
