"""Train/holdout split, factor levels and alignment of new data to them.

An R factor is a string plus its level list; here it is a plain string
column plus a level table ``(factor, level)``, optionally per coverage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.session import small


def split_holdout(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """holdout false → train, true → test; a null flag is in neither."""
    return df.filter(~F.col("holdout")), df.filter(F.col("holdout"))


def _stack(df: DataFrame, factors, keep=()) -> DataFrame:
    """(keep..., factor, level) with one row per input row and factor."""
    pairs = ", ".join(f"'{f}', CAST(`{f}` AS STRING)" for f in factors)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(factors)}, {pairs}) AS (factor, level)")


def factor_levels(df: DataFrame, factors, by=()) -> DataFrame:
    """Distinct (by..., factor, level). The stack runs before the partial
    aggregate inside one stage, so only distinct levels are shuffled."""
    return _stack(df, factors, by).filter(F.col("level").isNotNull()).distinct()


#: Levels that a plan may carry as literals; beyond it each column is joined to its level list.
LITERAL_LEVELS = 10_000


def align_levels(df: DataFrame, levels: DataFrame, cols) -> DataFrame:
    """Values not among the training levels of their column → null.

    One projection: the level lists (checked to be at most ``LITERAL_LEVELS`` in all)
    become literal sets. Longer lists are joined, one left join a column, with a
    size-checked broadcast, so that the big side is not shuffled.
    """
    found = levels.filter(F.col("factor").isin(list(cols))).select("factor", "level").limit(LITERAL_LEVELS + 1).collect()
    if len(found) <= LITERAL_LEVELS:
        known = {c: [r.level for r in found if r.factor == c] for c in cols}
        return df.withColumns({c: F.when(F.col(c).isin(known[c]), F.col(c)) for c in cols})
    lv = small(levels)
    out = df
    for c in cols:
        ok = lv.filter(F.col("factor") == c).select(
            F.col("level").alias(c), F.lit(True).alias(f"_ok_{c}"))
        out = out.join(ok, on=c, how="left").withColumn(
            c, F.when(F.col(f"_ok_{c}"), F.col(c))).drop(f"_ok_{c}")
    return out.select(*df.columns)
