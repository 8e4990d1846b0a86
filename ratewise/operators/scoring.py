"""Scoring: pure premium = frequency × severity × uncap adjustment.

What is scored are cells (variant, coverage, model_id, factor levels), which
stand for any number of rows. Each cell gets its linear predictors from the long coefficient table; a cell
whose level of a factor used by the model is missing from that model's level
list (unseen coverage, unseen or null level) gets a null prediction, as the
reference's scoring gives NA. A table of priced cells is joined to rows at the
very end (null-safe keys, size-checked broadcast), so the big side is never
shuffled for scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.operators.glm import INTERCEPT
from ratewise.operators.weighted import ANY
from ratewise.session import keep, small

SEP = "\u0001"


def _models(df: DataFrame) -> list[str]:
    return [c for c in ("variant", "coverage", "model_id") if c in df.columns]


def coefficient_lookup(coefs: DataFrame) -> DataFrame:
    """One row per model: each part's intercept and factor count, and a map
    'part|factor|level' → beta holding that model's coefficients (the
    coefficient table is size-checked by the caller)."""
    fac, part = F.col("factor"), F.col("part")
    key = F.concat(part, F.lit(SEP), fac, F.lit(SEP), F.col("level"))
    aggs = []
    for p in ("freq", "sev"):
        icpt = (fac == INTERCEPT) & (part == p)
        aggs += [F.max(F.when(icpt, F.col("beta"))).alias(f"_b0_{p}"),
                 F.max(F.when(icpt, F.col("n_factors"))).alias(f"_nf_{p}"),
                 F.max(F.when(icpt, F.lit(1))).alias(f"_has_{p}")]
    aggs.append(F.map_from_entries(F.collect_list(
        F.when(fac != INTERCEPT, F.struct(key.alias("k"), F.col("beta").alias("v"))))).alias("_coef"))
    return coefs.groupBy(*_models(coefs)).agg(*aggs)


def score_cells(cells: DataFrame, coefs: DataFrame, params: DataFrame, factors,
                freq_family, lookup: DataFrame | None = None) -> DataFrame:
    """cells (variant, coverage, model_id, factors...) → + mu_freq, mu_sev, uncap_adj, pure, unseen.

    One left join to the per-model coefficient lookup (broadcast) and map
    lookups per factor, all inside one map-side stage. A coefficient missing
    for a factor the model uses means an unseen or null level → null;
    ``unseen`` lists the levels (not null) that a model has no coefficient for.
    ``freq_family`` is a name, or names by variant; the tables may do without ``variant``.
    """
    factors = list(factors)
    on = _models(cells)
    lk = small(lookup if lookup is not None else keep(coefficient_lookup(coefs)))
    out = cells.join(small(params).select(*on, "uncap_adj"), on=on, how="left").join(lk, on=on, how="left")
    logit = F.lit(freq_family == "binomial")
    if isinstance(freq_family, dict):
        logit = F.col("variant").isin([v for v, family in freq_family.items() if family == "binomial"])
    cols, unseen = {}, []
    for part in ("freq", "sev"):
        eta = F.col(f"_b0_{part}")
        matched = F.lit(0)
        for f in factors:
            beta = F.try_element_at(F.col("_coef"), F.concat(F.lit(part + SEP + f + SEP), F.col(f)))
            eta = eta + F.coalesce(beta, F.lit(0.0))
            matched = matched + beta.isNotNull().cast("int")
            used = (F.col(f"_nf_{part}") > 0) & (F.col(f) != ANY)
            unseen.append(F.when(beta.isNull() & used, F.concat(F.lit(f + "="), F.col(f))))
        eta = F.when(matched == F.col(f"_nf_{part}"), eta)
        cols[f"mu_{part}"] = F.when(logit, F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).otherwise(F.exp(eta)) if part == "freq" else F.exp(eta)
    out = out.withColumns(cols)
    out = out.withColumn("pure", F.col("mu_freq") * F.col("mu_sev") * F.col("uncap_adj"))
    out = out.withColumn("unseen", F.array_distinct(F.array_compact(F.array(*unseen))))
    return out.select(*cells.columns, "mu_freq", "mu_sev", "uncap_adj", "pure", "unseen")


def check_unseen(scored: DataFrame) -> None:
    """Raise with up to 20 (model, level) cases whose level the model hasn't seen."""
    cases = scored.filter(F.size("unseen") > 0).select(*_models(scored), F.explode("unseen").alias("level")).distinct()
    bad = cases.orderBy(*cases.columns).limit(20).collect()
    if bad:
        raise ValueError(f"levels unseen by a model: {[tuple(b) for b in bad]}")


def attach(rows: DataFrame, table: DataFrame, keys, columns) -> DataFrame:
    """Left-join ``columns`` of a cell table onto ``rows`` by null-safe keys.

    ``keys`` are column names, or (row column, table column). The table is
    broadcast behind a check of its size; the big side is not shuffled for it.
    """
    pairs = [(k, k) if isinstance(k, str) else k for k in keys]
    right = small(table).select(*[F.col(t).alias(f"_k{i}") for i, (_, t) in enumerate(pairs)], *columns)
    cond = [rows[r].eqNullSafe(right[f"_k{i}"]) for i, (r, _) in enumerate(pairs)]
    return rows.join(right, on=cond, how="left").select(*[rows[c] for c in rows.columns], *[right[c] for c in columns])
