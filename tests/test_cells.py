"""Weighted cells against the rows that they stand for, additive quantiles, and centred moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.config import M1, M2, M3
from ratewise.operators import calibrate as cal
from ratewise.operators import rating as rt
from ratewise.operators.cells import merge_moments
from ratewise.operators.dispersion import dispersion_table
from ratewise.operators.quantile import exact_quantile, weighted_quantiles
from ratewise.plans.pipeline import open_book, price, price_all
from tests.test_pipeline import build


def same(a, b, keys):
    """Equal rows by key, numbers to 1e-12."""
    cols = [c for c in a.columns if c not in keys]
    x, y = [{tuple(r[k] for k in keys): [r[c] for c in cols] for r in d.collect()} for d in (a, b)]
    assert x.keys() == y.keys() and x
    for k in x:
        for u, v in zip(x[k], y[k]):
            assert u == v or (u is not None and v is not None and u == pytest.approx(v, rel=1e-12, abs=1e-12)), (k, x[k], y[k])


@pytest.fixture(scope="module")
def pair(spark):
    """Rows with null and NaN-free predictions, and the same rows as cells."""
    r = np.random.default_rng(2)
    rows = []
    for _ in range(3000):
        cov, tier, level = r.choice(["Liability", "Guest Medical", "Flood", "Fire"]), r.choice(["A", "B"]), int(r.integers(0, 40))
        pred = None if (cov, level) == ("Flood", 3) else float(level * 13 % 29 + (tier == "A") * 7) ** 1.5
        rows.append((cov, tier, level, pred, float(r.choice([0.0, r.exponential(100)]))))
    df = spark.createDataFrame(rows, "coverage string, risk_tier string, level int, pred double, total_paid double")
    cells = df.groupBy("coverage", "risk_tier", "level", "pred").agg(
        F.count("*").alias("n"), F.count_if(F.col("total_paid") > 0).alias("n_pos"), F.sum("total_paid").alias("total_paid"))
    return df, cells


@pytest.mark.parametrize("mode", ["honoured", "ignored"])
def test_cells_give_what_rows_give(pair, mode):
    rows, cells = pair
    same(cal.calibration_factor(rows, pred="pred"), cal.calibration_factor(cells, pred="pred", weight="n"), ["coverage"])
    same(cal.prediction_cap(rows, mode, 750, "pred"), cal.prediction_cap(cells, mode, 750, "pred", weight="n"), ["coverage"])
    same(cal.tier_mean(rows, "pred"), cal.tier_mean(cells, "pred", "n"), ["coverage", "risk_tier"])
    same(rt.holdout_check(rows, "pred"), rt.holdout_check(cells, "pred", "n"), ["coverage"])
    same(rt.tier_base(rows, "pred"), rt.tier_base(cells, "pred", "n"), ["coverage", "risk_tier"])
    for a, b in zip(rt.tier_and_coverage_means(rows, "pred"), rt.tier_and_coverage_means(cells, "pred", "n")):
        same(a, b, [c for c in ("coverage", "risk_tier") if c in a.columns])
    same(rt.coverage_mean(rows, "pred"), rt.tier_and_coverage_means(cells, "pred", "n")[1], ["coverage"])
    rel = [rt.relativity(d, rt.tier_base(rows, "pred"), "pred") for d in (rows, cells)]
    a, b = rt.cap_stats(rel[0]).first(), rt.cap_stats(rel[1], "n").first()
    assert list(a) == pytest.approx(list(b), rel=1e-12)


def test_quantiles_of_all_folds_but_one(spark):
    """Model m's weights are the total less fold m: each value is held once."""
    r = np.random.default_rng(9)
    data = [(g, float(np.round(r.lognormal(3, 2), 1)), int(f)) for g, n in (("Liability", 900), ("Other", 7)) for f in r.integers(1, 4, n)]
    df = spark.createDataFrame(data, "coverage string, y double, fold int")
    counted = df.groupBy("coverage", "y").agg(*[F.count_if(F.col("fold") != m).alias(f"m{m}") for m in range(4)])
    p = F.when(F.col("coverage") == "Liability", 0.97).otherwise(0.5)
    got = {x.coverage: x for x in weighted_quantiles(counted, ["coverage"], "y", ["m0", "m1", "m2", "m3"], p).collect()}
    for g, at in (("Liability", 0.97), ("Other", 0.5)):
        for m in range(4):
            ys = [y for c, y, f in data if c == g and f != m]
            assert got[g][f"n_m{m}"] == len(ys)
            assert got[g][f"q_m{m}"] == (pytest.approx(np.quantile(ys, at), rel=1e-12) if ys else None)


def test_weighted_quantile_equals_repeated_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("a", None, 9), ("a", float("nan"), 4), ("a", 5.0, 6), ("b", 7.0, 2)], "g string, v double, n int")
    got = {r.g: (r.n, r.q) for r in exact_quantile(df, ["g"], "v", 0.35, weight="n").collect()}
    assert got == {"a": (10, pytest.approx(np.quantile([1.0] * 3 + [2.0] + [5.0] * 6, 0.35))), "b": (2, 7.0)}


def test_moments_merge_without_cancellation(spark):
    """Amounts of 1e8 with noise of 1e-3: Σy² less n·mean² has no right digit left."""
    r = np.random.default_rng(1)
    parts = [("Fire", "A" if k % 2 else "B", 1e8 + 10 * (k % 2) + r.normal(0, 1e-3, 50 + k)) for k in range(6)]
    rows = spark.createDataFrame([(c, t, len(y), float(y.sum()), float(((y - y.mean()) ** 2).sum())) for c, t, y in parts],
                                 "coverage string, tier string, n long, sy double, m2 double")
    got = {x.tier: x for x in merge_moments(rows, ["coverage", "tier"]).collect()}
    for t in "AB":
        y = np.concatenate([y for _, u, y in parts if u == t])
        assert got[t].n == len(y) and got[t].m2 == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-3)


def test_dispersion_against_rows(spark):
    """Pearson's ratio of amounts 1e8 + small noise, as numpy gives it on the rows."""
    r = np.random.default_rng(4)
    data = [(0, "Liability", t, 1e8 * (1 + (t == "A")) + float(r.normal(0, 50.0))) for t in r.choice(["A", "B"], 400)]
    df = spark.createDataFrame(data, "model_id int, coverage string, risk_tier string, y double")
    cells = df.groupBy("coverage", "model_id", "risk_tier").agg(F.count("y").alias("n"), F.sum("y").alias("sy"), (F.var_pop("y") * F.count("y")).alias("m2"))
    cells = cells.select(F.lit("sev").alias("part"), "*").unionByName(cells.select(F.lit("freq").alias("part"), "*"))
    mean = {t: np.mean([y for _, _, u, y in data if u == t]) for t in "AB"}
    b0 = math.log(mean["A"])
    coefs = spark.createDataFrame([("Liability", 0, p, f, lv, b, 1, 1, 2, True, False) for p in ("freq", "sev")
                                   for f, lv, b in (("(Intercept)", None, b0), ("risk_tier", "A", 0.0), ("risk_tier", "B", math.log(mean["B"]) - b0))],
                                  "coverage string, model_id int, part string, factor string, level string, beta double, n_factors int, iterations int, rank int, converged boolean, thin boolean")
    params = spark.createDataFrame([("Liability", 0, 1.0)], "coverage string, model_id int, uncap_adj double")
    got = dispersion_table(cells, coefs, params, ["risk_tier"], "poisson").first()
    fitted = {"A": math.exp(b0), "B": math.exp(b0 + (math.log(mean["B"]) - b0))}
    chi = sum((y - fitted[t]) ** 2 / fitted[t] ** 2 for _, _, t, y in data)
    assert got.sev_disp == pytest.approx(chi / (len(data) - 2), rel=1e-9)


def test_variants_together_give_what_each_gives_alone(spark):
    claims = build(spark)
    book = open_book(claims)
    together = price_all(book, [M1, M2, M3, M2.with_factors(("risk_tier",))])
    for v in (M1, M2, M3):
        alone = price_all(book, [v])[v.name]
        both = together[v.name]
        for name, keys in (("student_totals", ["student_id", "risk_tier"]), ("holdout_check", ["coverage"]), ("pred_caps", ["coverage"]), ("params", ["coverage", "model_id"])):
            same(getattr(both, name), getattr(alone, name), keys)


def test_two_claims_tables_keep_apart(spark):
    claims = build(spark)
    twice = claims.withColumn("amount", F.col("amount") * 2)
    a, b = price(claims, M2).holdout_check.collect(), price(twice, M2).holdout_check.collect()
    x, y = [{r.coverage: r.actual for r in rows} for rows in (a, b)]
    assert y["Guest Medical"] == pytest.approx(2 * x["Guest Medical"])


def test_unseen_levels_can_stop_the_job(spark):  # T11
    claims = build(spark)
    lone = claims.withColumn("risk_tier", F.when((F.col("coverage") == "Liability") & (F.col("student_id") == 3), "Lone").otherwise(F.col("risk_tier")))
    with pytest.raises(ValueError, match=r"unseen.*Liability.*risk_tier=Lone"):
        price(lone, M2, on_unseen="error")
    with pytest.raises(ValueError, match="on_unseen"):
        price(claims, M2, on_unseen="warn")


def test_plans_are_short_and_write_two_wide_tables(spark, monkeypatch):
    """A run writes the exposures and the folds as wide as rows; all else has a cell a row at most."""
    import ratewise.plans.pipeline as P

    wide = []
    real = P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, name: wide.append((name, set(df.columns))) or real(df, name))
    price(build(spark), M2)
    assert [n for n, c in wide if "student_id" in c] == ["exposure", "folds"]
