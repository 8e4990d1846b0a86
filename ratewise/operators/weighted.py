"""Statistics that read rows, or weighted cells standing for rows.

All that decides a premium is the same for rows of equal (coverage, factor
levels): the prediction, its caps, its blend, its relativity. The pricing method
after the fits therefore runs on cells, each with its number of rows ``n``, of
claimants ``n_pos`` and its sum of ``total_paid``. Every statistic here takes the
weight's column name, or None for plain rows, and gives the same result for both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratewise.functions.nulls import nan_to_null

#: Level of a factor that a variant does not use.
ANY = "*"


def rows(weight: str | None) -> Column:
    """How many rows."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def total(x: str, weight: str | None) -> Column:
    """``sum(x, na.rm = TRUE)``."""
    v = F.col(x) if weight is None else F.col(x) * F.col(weight)
    return F.coalesce(F.sum(v), F.lit(0.0))


def mean(x: str, weight: str | None) -> Column:
    """Mean of the non-null values."""
    if weight is None:
        return F.avg(x)
    return F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(F.when(F.col(x).isNotNull(), F.col(weight))))


def mean_or_null(x: str, weight: str | None) -> Column:
    """``mean(x)`` that is null as soon as one value is null or NaN."""
    v = nan_to_null(x)
    if weight is None:
        return F.when(F.count(v) == F.count(F.lit(1)), F.avg(v))
    return F.when(F.count(v) == F.count(F.lit(1)), F.try_divide(F.sum(v * F.col(weight)), F.sum(weight)))


def paid_mean(weight: str | None) -> Column:
    """Mean of total_paid, which cells hold as a sum."""
    if weight is None:
        return mean_or_null("total_paid", None)
    return F.when(F.count("total_paid") == F.count(F.lit(1)), F.try_divide(F.sum("total_paid"), F.sum(weight)))


def claimants(weight: str | None) -> Column:
    return F.count_if(F.col("total_paid") > 0) if weight is None else F.coalesce(F.sum("n_pos"), F.lit(0))
