"""Categorical cleaning and numeric banding (column expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.config import UNKNOWN

# Band labels of the reference.
DIST_BANDS = ("Unknown", "0", "0-1", "1-3", "3+")
GPA_BANDS = ("Unknown", "<2.0", "2.0-2.99", "3.0+")


def clean_category(df: DataFrame, cols) -> DataFrame:
    """Null → 'Unknown', everything else as its text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for c in cols})


def distance_band(x) -> "F.Column":
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(x.isNull(), F.lit("Unknown"))
        .when(x == 0, F.lit("0"))
        .when(x <= 1, F.lit("0-1"))
        .when(x <= 3, F.lit("1-3"))
        .otherwise(F.lit("3+"))
    )


def gpa_band(x) -> "F.Column":
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(x.isNull(), F.lit("Unknown"))
        .when(x < 2.0, F.lit("<2.0"))
        .when(x < 3.0, F.lit("2.0-2.99"))
        .otherwise(F.lit("3.0+"))
    )


def band_distance(df: DataFrame, col: str = "distance_to_campus", out: str = "dist_band") -> DataFrame:
    return df.withColumn(out, distance_band(col))


def band_gpa(df: DataFrame, col: str = "gpa", out: str = "gpa_band") -> DataFrame:
    return df.withColumn(out, gpa_band(col))
