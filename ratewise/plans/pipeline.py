"""The whole pricing job, for one variant or for several in the same plans.

Rows are read four times: for the rollup, for the folds, for the cells (twice:
all rows, then claimants under the caps), and for the premiums at the end. Two
tables as wide as the rows are written: the exposures and the training rows with
their folds. All else runs on weighted cells (coverage, factor levels), with the
variant as one more key: fits, out-of-fold calibration, prediction caps, blend,
base losses, relativities and premiums. A row meets its cell's premiums in one
join, a broadcast as long as Spark finds the cells' file small. Tables that several
steps use are written: a lost executor reads files instead of running the fits
anew, plans stay short, and nothing stays cached. Small ones with one use
(``settled``) are a part of that step's plan, over files of known size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ratewise.config import FACTORS_M1, M1, M2, M3, Variant
from ratewise.functions.features import band_distance, band_gpa, clean_category
from ratewise.operators import calibrate as cal
from ratewise.operators import rating as rt
from ratewise.operators.cells import base_cells, design_cells, model_levels, spread
from ratewise.operators.dispersion import dispersion_table
from ratewise.operators.exposure import claim_indicator, exposure_rollup
from ratewise.operators.folds import assign_folds, fold_membership
from ratewise.operators.glm import check_fits, fit_models
from ratewise.operators.levels import align_levels, factor_levels, split_holdout
from ratewise.operators.scoring import attach, check_unseen, coefficient_lookup, score_cells
from ratewise.operators.severity import severity_tables
from ratewise.operators.weighted import ANY
from ratewise.session import materialize, settled
from ratewise.sources.sinks import write_premiums

ROW_PRICES = ("pred_loss", "pred_loss_cal", "pred_loss_cap", "pred_loss_final")
RELATIVITIES = ("relativity_raw", "relativity_shrunk", "relativity_cap", "final_prem_renew", "final_prem_new")


def build_exposure(claims: DataFrame, v: Variant | None = None) -> DataFrame:
    """The exposure table. Without a variant it carries every column any
    variant needs (gpa, claim_n, avg_paid, has_claim), so one rollup serves
    all three."""
    if v is None:
        return claim_indicator(exposure_rollup(claims, "count", True))
    return claim_indicator(exposure_rollup(claims, v.rollup_mode, v.with_gpa))


def _columns(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for v in (M1, M2, M3) for c in getattr(v, name)))


def prepare(df: DataFrame) -> DataFrame:
    """Clean categories to 'Unknown' and add the bands, of every column that any variant uses."""
    return band_gpa(band_distance(clean_category(df, _columns("clean_cols"))))


@dataclass
class Book:
    """What all variants share of one claims table: the exposures, the training rows with
    their folds, the levels, and the cells of both sets. Make one with ``open_book``."""

    exposure: DataFrame
    train: DataFrame
    test: DataFrame
    levels: DataFrame
    folds: DataFrame
    base: DataFrame
    test_cells: DataFrame
    k_folds: int
    fold_seed: int
    factors: tuple[str, ...] = FACTORS_M1


def open_book(claims: DataFrame, k_folds: int = M1.k_folds, fold_seed: int = M1.fold_seed) -> Book:
    exposure = materialize(build_exposure(claims), "exposure")
    train, test = [prepare(df) for df in split_holdout(exposure)]
    folds = materialize(assign_folds(train, k_folds, fold_seed), "folds")
    levels = factor_levels(folds, _columns("align_cols"))
    test = align_levels(test, levels, _columns("align_cols"))
    base = materialize(base_cells(folds, FACTORS_M1), "base-cells")
    held = test.groupBy("coverage", *FACTORS_M1).agg(F.count(F.lit(1)).alias("n"), F.sum("total_paid").alias("total_paid"))
    return Book(exposure, train, test, levels, folds, base, materialize(held, "test-cells"), k_folds, fold_seed)


@dataclass
class PricingRun:
    """Tables of one variant: small ones as computed, rows joined to their cells on use."""

    variant: Variant
    book: Book
    params: DataFrame
    cells: DataFrame
    coefs: DataFrame
    lookup: DataFrame
    oof_cells: DataFrame
    train_cells: DataFrame
    held_cells: DataFrame
    calibration: DataFrame
    pred_caps: DataFrame
    tier_means: DataFrame
    holdout_check: DataFrame
    tier_base: DataFrame
    coverage_mean: DataFrame
    base_loss: DataFrame
    pricing_table: DataFrame

    exposure = property(lambda self: self.book.exposure)
    train = property(lambda self: self.book.train)
    test = property(lambda self: self.book.test)
    levels = property(lambda self: self.book.levels.filter(F.col("factor").isin(list(self.variant.align_cols))))
    folds = property(lambda self: self.book.folds)

    def _rows(self, rows: DataFrame, cells: DataFrame, columns, *keys) -> DataFrame:
        return attach(rows, cells, ["coverage", *self.variant.factors, *keys], list(columns))

    @property
    def oof(self) -> DataFrame:
        """Training rows with the prediction of the model that didn't see their fold."""
        return self._rows(self.folds, self.oof_cells, ["oof_pred"], "fold")

    @property
    def scored_parts(self) -> DataFrame:
        return self._rows(self.folds, self.train_cells, ["pred_loss", "mu_freq", "mu_sev"])

    @property
    def scored_train(self) -> DataFrame:
        return self._rows(self.folds, self.train_cells, ROW_PRICES)

    @property
    def scored_test(self) -> DataFrame:
        return self._rows(self.test, self.held_cells, ROW_PRICES)

    @property
    def priced(self) -> DataFrame:
        return self._rows(self.folds, self.train_cells, (*ROW_PRICES, *RELATIVITIES))

    @property
    def student_totals(self) -> DataFrame:
        return rt.student_totals(self.priced)

    @property
    def cap_stats(self) -> DataFrame:
        return rt.cap_stats(self.train_cells, "n")

    @cached_property
    def tier_summary(self) -> DataFrame:
        return rt.tier_premium_summary(self.student_totals)

    @cached_property
    def quality(self) -> DataFrame:
        return rt.quality_gate(self.student_totals, self.priced)

    @cached_property
    def dispersion(self) -> DataFrame | None:
        v = self.variant
        if not v.with_dispersion:
            return None
        return dispersion_table(self.cells, self.coefs, self.params, v.factors, v.freq_family, lookup=self.lookup)

    def write(self, path: str, fmt: str = "csv") -> None:
        """The premium file. Null row premiums (which sums skip) and null totals stop the job; an
        earlier file then stays as it was. The rows are priced once: checks watch that same pass."""
        seen = Observation("row premiums")
        nulls = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in ("final_prem_renew", "final_prem_new")]
        write_premiums(rt.student_totals(self.priced.observe(seen, *nulls)), path, fmt, checks=(seen,))


def price_all(book: Book, variants, on_unseen: str = "null") -> dict[str, PricingRun]:
    """The pricing job of several variants (all with the book's folds) in one set of plans.

    on_unseen  what a level means that one coverage's or fold's model hasn't seen: 'null', no
               prediction; 'error', stop and name the (variant, coverage, model, level) cases
    """
    variants = tuple(variants)
    if len({v.name for v in variants}) < len(variants):
        raise ValueError("variants need different names")
    for v in variants:
        if (v.k_folds, v.fold_seed) != (book.k_folds, book.fold_seed):
            raise ValueError(f"{v.name} has other folds than the book")
    if on_unseen not in ("null", "error"):
        raise ValueError("on_unseen is 'null' or 'error'")
    spark, factors, k = book.base.sparkSession, list(book.factors), book.k_folds
    member = fold_membership(spark, k)
    responses = list(dict.fromkeys(v.sev_response for v in variants))
    families = {v.name: v.freq_family for v in variants}

    capped, by_response = severity_tables(book.folds, book.base.select("coverage", "fold", "n"), responses, factors, k)
    own = F.explode(F.filter(F.array(*[F.struct(F.lit(v.name).alias("variant"), F.lit(v.sev_response).alias("r")) for v in variants]),
                             lambda x: x["r"] == F.col("response")))
    params = settled(by_response.withColumn("_v", own).select("_v.variant", *[c for c in by_response.columns if c != "response"]))
    cells = materialize(design_cells(book.base, capped, member, variants, factors), "design-cells")
    names = {v.name: list(v.factors) for v in variants}
    seen = model_levels(cells, factors, ("variant", "coverage", "model_id", "part")).filter(F.col("level") != ANY)
    coefs = materialize(fit_models(cells, seen, names, families), "coefs")
    check_fits(coefs)
    lookup = settled(coefficient_lookup(coefs))

    # cells to score: training cells by the model without their fold and by model 0, held-out ones by model 0
    train = book.base.select("coverage", "fold", *factors, "n", "n_pos", "total_paid")
    model0 = train.groupBy("coverage", *factors).agg(*[F.sum(c).alias(c) for c in ("n", "n_pos", "total_paid")])
    kinds = [("oof", train, F.col("fold")), ("train", model0, F.lit(0)), ("test", book.test_cells, F.lit(0))]
    todo = None
    for name, table, model in kinds:
        part = table.select(F.lit(name).alias("kind"), "coverage", model.cast("int").alias("model_id"), *factors, "n",
                            F.col("n_pos") if "n_pos" in table.columns else F.lit(None).cast("long").alias("n_pos"), "total_paid")
        todo = part if todo is None else todo.unionByName(part)
    todo = spread(todo, variants, factors)
    group = ["variant", "kind", "coverage", "model_id", *factors]
    todo = todo.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("n", "n_pos", "total_paid")])
    scored = materialize(score_cells(todo, coefs, params, factors, families, lookup), "scored-cells")
    if on_unseen == "error":
        check_unseen(scored)

    drop = ("kind", "model_id", "uncap_adj", "unseen")
    oof = scored.filter("kind = 'oof'").withColumnsRenamed({"model_id": "fold", "pure": "oof_pred"}).drop("kind", "uncap_adj", "unseen")
    calibration = settled(cal.calibration_factor(oof, weight="n"))
    both = scored.filter("kind <> 'oof'").withColumnRenamed("pure", "pred_loss").drop(*drop[1:])
    both = materialize(cal.apply_calibration(both, calibration), "calibrated")
    train, test = both.filter("kind = 'train'"), both.filter("kind = 'test'")
    caps = materialize(cal.prediction_cap(train, {v.name: v.min_n_mode for v in variants}, weight="n"), "prediction-caps")
    both = cal.apply_prediction_cap(both, caps)
    tmeans = settled(cal.tier_mean(both.filter("kind = 'train'"), weight="n"))
    both = materialize(cal.blend_to_tier(both, tmeans), "final-cells")
    train, test = [both.filter(F.col("kind") == x).drop("kind") for x in ("train", "test")]

    hold = rt.holdout_check(test, weight="n")
    tbase, cmean = rt.tier_and_coverage_means(train, weight="n")
    smooth = rt.credibility_smooth(tbase, cmean)
    plain = rt.credibility_smooth(tbase, cmean, on=False)
    on = F.col("variant").isin([v.name for v in variants if v.cred_smooth])
    base = smooth.filter(on).unionByName(plain.filter(~on))
    ptable = settled(rt.pricing_table(base))
    priced = materialize(rt.row_premiums(rt.relativity(train, tbase), ptable), "priced-cells")

    def of(v: Variant, table: DataFrame) -> DataFrame:
        unused = [f for f in factors if f not in v.factors and f in table.columns and f != "risk_tier"]
        return settled(table.filter(F.col("variant") == v.name).drop("variant", *unused))

    return {v.name: PricingRun(
        variant=v, book=book, params=of(v, params), cells=of(v, cells), coefs=of(v, coefs), lookup=of(v, lookup),
        oof_cells=of(v, oof), train_cells=of(v, priced), held_cells=of(v, test), calibration=of(v, calibration), pred_caps=of(v, caps),
        tier_means=of(v, tmeans), holdout_check=of(v, hold), tier_base=of(v, tbase), coverage_mean=of(v, cmean), base_loss=of(v, base),
        pricing_table=of(v, ptable)) for v in variants}


def price(claims: DataFrame, v: Variant, on_unseen: str = "null") -> PricingRun:
    """The whole pricing job for variant ``v``."""
    return price_all(open_book(claims, v.k_folds, v.fold_seed), [v], on_unseen)[v.name]


def compare_variants(claims: DataFrame, variants) -> DataFrame:
    """Holdout check per coverage and variant: one rollup and one set of plans for all of them."""
    variants = list(variants)
    runs = price_all(open_book(claims, variants[0].k_folds, variants[0].fold_seed), variants)
    out = None
    for name, run in runs.items():
        h = run.holdout_check.withColumn("variant", F.lit(name))
        out = h if out is None else out.unionByName(h)
    return out
