"""Null rules of the reference, as Column expressions.

R's ``pmin``/``pmax`` return NA when either side is NA, ``mean`` without
``na.rm`` is NA when any input is NA, ``sum(na.rm = TRUE)`` of nothing is 0,
and ``x / 0`` is not an error. Spark's ``least``/``greatest`` and ``avg`` skip
nulls, ``sum`` of nothing is null and ANSI division raises, hence these.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else (c if isinstance(c, Column) else F.lit(c))


def _any_null(cols) -> Column:
    """NaN counts as null: R's NA rules hold for both."""
    return reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) for c in cols])


def least_strict(*cols) -> Column:
    """``pmin``: null if any argument is null."""
    cs = [_col(c) for c in cols]
    return F.when(~_any_null(cs), F.least(*cs))


def greatest_strict(*cols) -> Column:
    """``pmax``: null if any argument is null."""
    cs = [_col(c) for c in cols]
    return F.when(~_any_null(cs), F.greatest(*cs))


def clamp_strict(x, lo, hi) -> Column:
    return least_strict(greatest_strict(x, lo), hi)


def mean_strict(x) -> Column:
    """Aggregate: ``mean(x)`` that is null as soon as one input is null or NaN."""
    c = nan_to_null(x)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def zero_sum(x) -> Column:
    """Aggregate: ``sum(x, na.rm = TRUE)``, 0 for no values."""
    return F.coalesce(F.sum(_col(x)), F.lit(0.0))


def safe_div(a, b) -> Column:
    """Division that yields null where R would give Inf/NaN."""
    return F.try_divide(_col(a), _col(b))


def nan_to_null(x) -> Column:
    c = _col(x)
    return F.when(~F.isnan(c), c)
