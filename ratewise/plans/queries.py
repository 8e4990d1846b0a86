"""Registered queries: one per operator, each paired with its DuckDB oracle SQL.

Every query reads the driver's tables through the claims fixture and runs
over all of them. Pricing runs are memoised per (session, data folder,
variant) so the stage queries of one run share its materialised tables.

Rounding (both sides alike): money 4 places, ratios 6; sums of the raw
amounts (which have 6 decimals) 6 places; averages of raw amounts 9.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewise import config as C
from ratewise.functions.features import band_distance, band_gpa, clean_category
from ratewise.operators import calibrate as cal
from ratewise.operators import rating as rt
from ratewise.operators.cells import model_levels
from ratewise.operators.glm import INTERCEPT, fit_models
from ratewise.operators.levels import _stack, factor_levels, split_holdout
from ratewise.operators.scoring import score_cells
from ratewise.plans import oracle as O
from ratewise.plans.pipeline import Book, PricingRun, build_exposure, open_book, price_all
from ratewise.session import dealt, keep, materialize, scratch_dir, small, tasks_for
from ratewise.sources.claims import NUMBER_PATTERN, fixture_claims, fixture_rows, load_claims, parse_amount_col

ONE = ("risk_tier",)
_RUNS: dict = {}


def variant_of(key: str) -> C.Variant:
    base = C.VARIANTS[key[:2]]
    return base.with_factors(ONE) if key.endswith("_1f") else base


def _sk(spark: SparkSession):
    """Session key: the object id alone may be reused after a session stops."""
    try:
        app = spark.conf.get("spark.app.id", None)
    except Exception:
        app = None
    return (id(spark), app)


def book(spark: SparkSession, sf_dir: str) -> Book:
    """One book (rollup, folds, cells) per (session, data folder), shared by all variants."""
    k = (_sk(spark), os.path.abspath(sf_dir), "book")
    if k not in _RUNS:
        _RUNS[k] = open_book(fixture_claims(spark, sf_dir))
    return _RUNS[k]


def runs(spark: SparkSession, sf_dir: str, keys) -> dict[str, PricingRun]:
    """The runs of several variants; those not made yet are made in one set of plans."""
    at = {key: (_sk(spark), os.path.abspath(sf_dir), key) for key in keys}
    missing = {key: variant_of(key) for key, k in at.items() if k not in _RUNS}
    if missing:
        made = price_all(book(spark, sf_dir), missing.values())
        _RUNS.update({at[key]: made[v.name] for key, v in missing.items()})
    return {key: _RUNS[k] for key, k in at.items()}


def run(spark: SparkSession, sf_dir: str, key: str) -> PricingRun:
    return runs(spark, sf_dir, [key])[key]


# Values built from the 6-decimal amounts can lie exactly on a rounding tie,
# where Spark (exact decimal expansion) and DuckDB (scaled float) may round
# apart. Both sides therefore scale by the same factor first, which moves
# exact ties off the boundary by ~1e-12 relative, far below the kept places.
TIE = 1.000000000001


def r(c, d: int, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col * F.lit(TIE), d).alias(name or (c if isinstance(c, str) else None))


def sr(expr: str, d: int, name: str) -> str:
    return f"round({expr}, {d}) AS {name}"


def tie_safe(sql: str) -> str:
    """Rewrite every ``round(expr, d)`` of the oracle text to ``round(TIE * (expr), d)``."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len(key), 1
        while True:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                break
            k += 1
        inner = tie_safe(sql[j + len(key):k])
        out.append(sql[i:j] + f"round(CAST({TIE!r} AS DOUBLE) * ({inner})")
        i = k


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = tie_safe(sql)
        return fn
    return deco


CLAIM_COLS = ("row_id, student_id, coverage, risk_tier, gpa, greek, off_campus, distance_to_campus, "
              "sprinklered, gender, holdout, amount")

# ------------------------------------------------------------- sources ---


@query("load_claims", O.base_sql(f"SELECT {CLAIM_COLS} FROM claims"))
def q_load_claims(spark, sf):
    """Fixture written as CSV to the scratch folder, read back with the fixed schema."""
    path = os.path.join(scratch_dir(spark), f"claims-csv-{uuid.uuid4().hex[:12]}")
    fixture_claims(spark, sf).write.option("header", True).csv(path)
    return load_claims(spark, path, "csv", numeric_ids=True)


def _csv_copy(spark, claims: DataFrame, numeric_ids: bool = True) -> DataFrame:
    """``claims`` written as CSV to the scratch folder and loaded again."""
    path = os.path.join(scratch_dir(spark), f"claims-csv-{uuid.uuid4().hex[:12]}")
    claims.write.option("header", True).csv(path)
    return load_claims(spark, path, "csv", numeric_ids)


@query("load_claims_reordered", O.base_sql(f"SELECT {CLAIM_COLS} FROM claims"))
def q_load_claims_reordered(spark, sf):
    """Columns in another order, with others between them, are found by name."""
    c = fixture_claims(spark, sf)
    return _csv_copy(spark, c.select(F.lit("x").alias("note"), *reversed(c.columns), F.lit(1).alias("year")))


@query("load_claims_text_ids", O.base_sql(
    "SELECT " + CLAIM_COLS.replace("student_id", "'S' || student_id AS student_id") + " FROM claims"))
def q_load_claims_text_ids(spark, sf):
    """Text student ids stay text."""
    return _csv_copy(spark, fixture_claims(spark, sf).withColumn("student_id", F.concat(F.lit("S"), "student_id")), False)


@query("load_claims_padded_ids", O.base_sql(
    "SELECT " + CLAIM_COLS.replace("student_id", "CASE student_id % 3 WHEN 0 THEN lpad(student_id::VARCHAR, 9, '0') WHEN 1 THEN '+' || student_id "
                                   "ELSE student_id::VARCHAR END AS student_id") + " FROM claims"))
def q_load_claims_padded_ids(spark, sf):
    """Ids that all look like numbers are still what the file says."""
    i = F.col("student_id")
    text = i.cast("string")
    padded = F.when(i % 3 == 0, F.lpad(text, 9, "0")).when(i % 3 == 1, F.concat(F.lit("+"), text)).otherwise(text)
    return _csv_copy(spark, fixture_claims(spark, sf).withColumn("student_id", padded), False)


@query("load_claims_order", O.base_sql("""
SELECT student_id, coverage, amount, row_number() OVER (PARTITION BY student_id, coverage ORDER BY md5(row_id || '|' || line), amount NULLS FIRST) AS nth
FROM claims"""))
def q_load_claims_order(spark, sf):
    """Rows written in the order of a hash, over several files, without row_id: each student's rows come back in that order."""
    c = fixture_claims(spark, sf, with_line=True)
    h = F.md5(F.concat_ws("|", "row_id", "line"))
    rows = fixture_rows(spark, sf)
    written = c.withColumn("h", h).repartitionByRange(max(7, tasks_for(rows)), "h").sortWithinPartitions("h", "amount").drop("row_id", "line", "h")
    got = dealt(_csv_copy(spark, written).select("student_id", "coverage", "amount", "row_id"), rows, "student_id", "coverage")
    nth = F.row_number().over(Window.partitionBy("student_id", "coverage").orderBy("row_id"))
    return got.select("student_id", "coverage", "amount", nth.cast("bigint").alias("nth"))


@query("load_claims_no_row_id", O.base_sql(
    "SELECT " + CLAIM_COLS.removeprefix("row_id, ") + ", count(*) OVER () AS n_row_ids FROM claims"))
def q_load_claims_no_row_id(spark, sf):
    """Without row_id the file order is taken: every row has its own."""
    got = _csv_copy(spark, fixture_claims(spark, sf).drop("row_id"))
    ids = got.agg(F.countDistinct("row_id").alias("n_row_ids"))
    return got.drop("row_id").crossJoin(F.broadcast(ids))  # one row


@query("parse_amount", O.base_sql(
    f"SELECT row_id, amount_text, CASE WHEN regexp_full_match(amount_text, '{NUMBER_PATTERN}') "
    "THEN TRY_CAST(trim(amount_text) AS DOUBLE) END AS amount_num FROM claims"))
def q_parse_amount(spark, sf):
    c = fixture_claims(spark, sf, with_text=True)
    return c.select("row_id", "amount_text", parse_amount_col("amount_text").alias("amount_num"))


# ------------------------------------------------- rollup and features ---

EXPO_COLS = ("student_id, coverage, risk_tier, gpa, greek, off_campus, distance_to_campus, sprinklered, "
             "gender, holdout")


@query("exposure_rollup_total", O.base_sql(
    f"SELECT {EXPO_COLS}, {sr('total_paid', 6, 'total_paid')} FROM exposure"))
def q_rollup_total(spark, sf):
    e = build_exposure(fixture_claims(spark, sf), C.M1)
    return e.select(*[c.strip() for c in EXPO_COLS.split(",")], r("total_paid", 6))


@query("exposure_rollup_count", O.base_sql(
    f"SELECT {EXPO_COLS.replace(' gpa,', '')}, {sr('total_paid', 6, 'total_paid')}, claim_n, "
    f"{sr('avg_paid', 9, 'avg_paid')} FROM ex"))
def q_rollup_count(spark, sf):
    e = build_exposure(fixture_claims(spark, sf), C.M2)
    cols = [c.strip() for c in EXPO_COLS.replace(" gpa,", "").split(",")]
    return e.select(*cols, r("total_paid", 6), "claim_n", r("avg_paid", 9))


@query("claim_indicator", O.base_sql("SELECT student_id, coverage, has_claim FROM ex"))
def q_claim_indicator(spark, sf):
    return build_exposure(fixture_claims(spark, sf), C.M1).select("student_id", "coverage", "has_claim")


CLEAN = ("coverage", "risk_tier", "greek", "off_campus", "sprinklered", "gender")


@query("clean_category", O.base_sql(
    "SELECT student_id, " + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in CLEAN)
    + " FROM exposure"))
def q_clean_category(spark, sf):
    e = build_exposure(fixture_claims(spark, sf), C.M1)
    return clean_category(e, CLEAN).select("student_id", *CLEAN)


@query("band_distance", O.base_sql(
    f"SELECT student_id, coverage, distance_to_campus, {O.DIST_BAND_SQL} AS dist_band FROM exposure"))
def q_band_distance(spark, sf):
    e = build_exposure(fixture_claims(spark, sf), C.M1)
    return band_distance(e).select("student_id", "coverage", "distance_to_campus", "dist_band")


@query("band_gpa", O.base_sql(
    f"SELECT student_id, coverage, gpa, {O.GPA_BAND_SQL} AS gpa_band FROM exposure"))
def q_band_gpa(spark, sf):
    e = build_exposure(fixture_claims(spark, sf), C.M1)
    return band_gpa(e).select("student_id", "coverage", "gpa", "gpa_band")


@query("split_holdout", O.base_sql("""
SELECT CASE WHEN holdout THEN 'test' ELSE 'train' END AS dataset, coverage, count(*) AS n
FROM exposure WHERE holdout IS NOT NULL GROUP BY 1, 2"""))
def q_split_holdout(spark, sf):
    train, test = split_holdout(build_exposure(fixture_claims(spark, sf), C.M1))
    both = train.withColumn("dataset", F.lit("train")).unionByName(test.withColumn("dataset", F.lit("test")))
    return both.groupBy("dataset", "coverage").agg(F.count(F.lit(1)).alias("n"))


ALIGN = C.M1.align_cols


def _unpivot_sql(src: str, cols, keep="") -> str:
    parts = [f"SELECT {keep}'{c}' AS factor, CAST({c} AS VARCHAR) AS level FROM {src}" for c in cols]
    return " UNION ALL ".join(parts)


@query("factor_levels", O.base_sql(
    f"SELECT DISTINCT factor, level FROM ({_unpivot_sql('train', ALIGN)}) WHERE level IS NOT NULL"))
def q_factor_levels(spark, sf):
    return run(spark, sf, "m1").levels


@query("factor_levels_by_coverage", O.base_sql(
    f"SELECT DISTINCT coverage, factor, level FROM ({_unpivot_sql('train', C.FACTORS_M1, 'coverage, ')}) "
    "WHERE level IS NOT NULL"))
def q_factor_levels_cov(spark, sf):
    return factor_levels(run(spark, sf, "m1").train, C.FACTORS_M1, by=("coverage",))


@query("align_levels", O.base_sql(
    "SELECT student_id, " + ", ".join(
        f"CASE WHEN {c} IN (SELECT {c} FROM train) THEN {c} END AS {c}" for c in ALIGN)
    + " FROM prep WHERE holdout = true"))
def q_align_levels(spark, sf):
    return run(spark, sf, "m1").test.select("student_id", *ALIGN)


@query("assign_folds", O.base_sql("SELECT coverage, student_id, fold FROM folds"))
def q_assign_folds(spark, sf):
    return run(spark, sf, "m2").folds.select("coverage", "student_id", "fold")


# ---------------------------------------------------- severity and cells ---

@query("severity_cap", O.pipeline_sql("m2", """
SELECT coverage, model_id, n, n_pos, capped, round(CASE WHEN capped THEN cap END, 4) AS cap FROM sevcap"""))
def q_severity_cap(spark, sf):
    p = run(spark, sf, "m2").params
    return p.select("coverage", "model_id", "n", "n_pos", "capped",
                    r(F.when(F.col("capped"), F.col("cap")), 4, "cap"))


@query("severity_cap_m1", O.pipeline_sql("m1", """
SELECT coverage, model_id, n, n_pos, capped, round(CASE WHEN capped THEN cap END, 4) AS cap FROM sevcap"""))
def q_severity_cap_m1(spark, sf):
    p = run(spark, sf, "m1").params
    return p.select("coverage", "model_id", "n", "n_pos", "capped",
                    r(F.when(F.col("capped"), F.col("cap")), 4, "cap"))


@query("severity_capped", O.pipeline_sql("m2", """
SELECT coverage, model_id, count(*) FILTER (WHERE y_cap > 0) AS n_sev,
  round(coalesce(sum(y_cap) FILTER (WHERE y_cap > 0), 0), 4) AS sum_capped
FROM mrows2 GROUP BY 1, 2"""))
def q_severity_capped(spark, sf):
    rn = run(spark, sf, "m2")
    s = rn.cells.filter(F.col("part") == "sev").groupBy("coverage", "model_id").agg(
        F.sum("n").alias("n_sev"), F.sum("sy").alias("sum_capped"))
    out = rn.params.select("coverage", "model_id").join(s, ["coverage", "model_id"], "left")
    return out.select("coverage", "model_id", F.coalesce("n_sev", F.lit(0)).cast("bigint").alias("n_sev"),
                      r(F.coalesce("sum_capped", F.lit(0.0)), 4, "sum_capped"))


@query("uncap_adjustment", O.pipeline_sql("m2", "SELECT coverage, model_id, round(uncap_adj, 6) AS uncap_adj "
                                                "FROM uncap"))
def q_uncap(spark, sf):
    return run(spark, sf, "m2").params.select("coverage", "model_id", r("uncap_adj", 6))


FM2 = C.FACTORS_M2


@query("design_cells", O.pipeline_sql("m2", f"""
SELECT coverage, model_id, 'freq' AS part, {', '.join(FM2)}, count(*) AS n,
  round(sum(yf), 4) AS sy, round(sum(yf * yf), 2) AS sy2
FROM mrows GROUP BY ALL
UNION ALL
SELECT coverage, model_id, 'sev' AS part, {', '.join(FM2)}, count(*) AS n,
  round(sum(y_cap), 4) AS sy, round(sum(y_cap * y_cap), 2) AS sy2
FROM mrows2 WHERE y_cap > 0 GROUP BY ALL"""))
def q_design_cells(spark, sf):
    c = run(spark, sf, "m2").cells
    sy2 = F.col("m2") + F.col("sy") * F.col("sy") / F.col("n")
    return c.select("coverage", "model_id", "part", *FM2, "n", r("sy", 4), r(sy2, 2, "sy2"))


def _score_sums(rn: PricingRun, part: str) -> DataFrame:
    """Score-equation sums per (coverage, model, factor, level) of the fitted models."""
    v = rn.variant
    fac = list(v.factors)
    cells = rn.cells.filter(F.col("part") == part)
    mu = score_cells(cells.select("coverage", "model_id", *fac).distinct(), rn.coefs, rn.params, fac,
                     v.freq_family, rn.lookup)
    j = cells.join(mu, on=["coverage", "model_id", *fac])
    term = (F.col("n") * F.col("mu_freq")) if part == "freq" else (F.col("sy") / F.col("mu_sev"))
    j = j.withColumn("_t", term)
    thin = rn.coefs.filter((F.col("factor") == INTERCEPT) & (F.col("part") == part)).select(
        "coverage", "model_id", "thin")
    j = j.join(small(thin), ["coverage", "model_id"]).filter(~F.col("thin"))
    long = _stack(j, fac, keep=("coverage", "model_id", "n", "_t"))
    return long.groupBy("coverage", "model_id", "factor", "level").agg(
        F.sum("n").alias("n"), r(F.sum("_t"), 4, "score_sum"))


def _score_sql(variant: str, part: str) -> str:
    fac = C.FACTORS_M1 if variant == "m1" else C.FACTORS_M2
    if part == "freq":
        src = "(SELECT r.* FROM mrows r JOIN fstat s USING (coverage, model_id) WHERE s.sy >= 20)"
        un = " UNION ALL ".join(
            f"SELECT coverage, model_id, '{f}' AS factor, {f} AS level, yf AS t FROM {src}" for f in fac)
    else:
        src = ("(SELECT r.* FROM mrows2 r JOIN sstat s USING (coverage, model_id) "
               "WHERE r.y_cap > 0 AND s.n2 >= 30)")
        un = " UNION ALL ".join(
            f"SELECT coverage, model_id, '{f}' AS factor, {f} AS level, CAST(1 AS DOUBLE) AS t FROM {src}"
            for f in fac)
    return O.pipeline_sql(variant, f"""
SELECT coverage, model_id, factor, level, count(*) AS n, round(sum(t), 4) AS score_sum
FROM ({un}) GROUP BY 1, 2, 3, 4""")


@query("fit_poisson", _score_sql("m2", "freq"))
def q_fit_poisson(spark, sf):
    return _score_sums(run(spark, sf, "m2"), "freq")


@query("fit_gamma", _score_sql("m2", "sev"))
def q_fit_gamma(spark, sf):
    return _score_sums(run(spark, sf, "m2"), "sev")


@query("fit_logistic", _score_sql("m1", "freq"))
def q_fit_logistic(spark, sf):
    return _score_sums(run(spark, sf, "m1"), "freq")


@query("fit_gamma_m1", _score_sql("m1", "sev"))
def q_fit_gamma_m1(spark, sf):
    return _score_sums(run(spark, sf, "m1"), "sev")


def _row_score_sql() -> str:
    un = " UNION ALL ".join(
        f"SELECT coverage, '{f}' AS factor, {f} AS level, yf AS t FROM mrows WHERE model_id = 0" for f in FM2)
    return O.pipeline_sql("m2", f"""
SELECT coverage, factor, level, count(*) AS n, round(sum(t), 4) AS score_sum FROM ({un})
WHERE coverage IN (SELECT coverage FROM fstat WHERE model_id = 0 AND sy >= 20)
GROUP BY 1, 2, 3""")


@query("score_multifactor", _row_score_sql())
def q_score_multifactor(spark, sf):
    """Row-level scoring of the multi-factor model 0: per level, the scored
    frequencies of the training rows add up to the observed claims."""
    rn = run(spark, sf, "m2")
    thin = rn.coefs.filter((F.col("factor") == INTERCEPT) & (F.col("part") == "freq")
                           & (F.col("model_id") == 0)).select("coverage", "thin")
    rows = rn.scored_parts.join(small(thin), "coverage").filter(~F.col("thin"))
    long = _stack(rows, FM2, keep=("coverage", "mu_freq"))
    return long.groupBy("coverage", "factor", "level").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("mu_freq"), 4, "score_sum"))


@query("thin_data_fallback", O.pipeline_sql("m2", """
SELECT coverage, model_id, 'freq' AS part, round(sy / n, 4) AS mu FROM fstat
UNION ALL
SELECT coverage, model_id, 'sev' AS part, round(mean2, 4) AS mu FROM sstat"""))
def q_thin(spark, sf):
    """Thresholds raised above any count: every model falls back to intercept only."""
    rn = run(spark, sf, "m2")
    v = rn.variant
    big = 1e18
    coefs = fit_models(rn.cells, model_levels(rn.cells, v.factors), v.factors, v.freq_family,
                       min_claims=big, min_pos=big)
    b0 = coefs.filter(F.col("factor") == INTERCEPT)
    return b0.select("coverage", "model_id", "part", r(F.exp("beta"), 4, "mu"))


@query("fit_parameters", O.pipeline_sql("m2", """
SELECT coverage, model_id, 'freq' AS part, n AS n_obs, round(sy, 4) AS sum_y, sy < 20 AS thin FROM fstat
UNION ALL
SELECT s.coverage, s.model_id, 'sev' AS part, coalesce(t.n2, 0) AS n_obs, round(coalesce(t.sum2, 0), 4) AS sum_y,
  coalesce(t.n2, 0) < 30 AS thin
FROM sevcap s LEFT JOIN (SELECT coverage, model_id, count(*) AS n2, sum(y_cap) AS sum2 FROM mrows2
                         WHERE y_cap > 0 GROUP BY 1, 2) t USING (coverage, model_id)"""))
def q_fit_parameters(spark, sf):
    rn = run(spark, sf, "m2")
    sums = rn.cells.groupBy("coverage", "model_id", "part").agg(F.sum("n").alias("n_obs"),
                                                                F.sum("sy").alias("sum_y"))
    meta = rn.coefs.filter(F.col("factor") == INTERCEPT).select("coverage", "model_id", "part", "thin")
    j = meta.join(sums, ["coverage", "model_id", "part"], "left")
    return j.select("coverage", "model_id", "part", F.coalesce("n_obs", F.lit(0)).cast("bigint").alias("n_obs"),
                    r(F.coalesce("sum_y", F.lit(0.0)), 4, "sum_y"), "thin")


# -------------------------------------------------- one-factor pipeline ---

def _stage(key: str, attr: str, cols) -> Callable:
    """cols: names, or (name, places) pairs to round."""
    def fn(spark, sf):
        sel = [r(*c) if isinstance(c, tuple) else c for c in cols]
        return getattr(run(spark, sf, key), attr).select(*sel)
    return fn


ROWK = ["student_id", "coverage"]


def _reg_1f(name, key, attr, spark_cols, select_sql, variant="m2"):
    QUERIES[name] = _stage(key, attr, spark_cols)
    SQL[name] = tie_safe(O.pipeline_sql(variant, select_sql))


_reg_1f("score_pure_premium", "m2_1f", "scored_train", ROWK + [("pred_loss", 4)],
        "SELECT student_id, coverage, round(pred_loss, 4) AS pred_loss FROM ptrain")
_reg_1f("score_pure_premium_m1", "m1_1f", "scored_train", ROWK + [("pred_loss", 4)],
        "SELECT student_id, coverage, round(pred_loss, 4) AS pred_loss FROM ptrain", "m1")
_reg_1f("oof_predict", "m2_1f", "oof", ROWK + ["fold", ("oof_pred", 4)],
        "SELECT student_id, coverage, fold, round(pure, 4) AS oof_pred FROM oof")
_reg_1f("calibration_factor", "m2_1f", "calibration",
        ["coverage", "n_claim", ("y", 6), ("p", 4), ("raw_cal", 6), ("w", 9), ("cal_factor", 6)],
        "SELECT coverage, n_claim, round(y, 6) AS y, round(p, 4) AS p, round(raw_cal, 6) AS raw_cal, "
        "round(w, 9) AS w, round(cal_factor, 6) AS cal_factor FROM cal")
_reg_1f("calibration_factor_m1", "m1_1f", "calibration",
        ["coverage", "n_claim", ("y", 6), ("p", 4), ("raw_cal", 6), ("w", 9), ("cal_factor", 6)],
        "SELECT coverage, n_claim, round(y, 6) AS y, round(p, 4) AS p, round(raw_cal, 6) AS raw_cal, "
        "round(w, 9) AS w, round(cal_factor, 6) AS cal_factor FROM cal", "m1")
_reg_1f("apply_calibration", "m2_1f", "scored_train", ROWK + [("pred_loss_cal", 4)],
        "SELECT student_id, coverage, round(pred_loss_cal, 4) AS pred_loss_cal FROM ptrain")
_reg_1f("prediction_cap_m1", "m1_1f", "pred_caps", ["coverage", "n", "p_cap", ("pred_cap", 4)],
        "SELECT coverage, n, p_cap, round(pred_cap, 4) AS pred_cap FROM pcap", "m1")
_reg_1f("prediction_cap_m2", "m2_1f", "pred_caps", ["coverage", "n", "p_cap", ("pred_cap", 4)],
        "SELECT coverage, n, p_cap, round(pred_cap, 4) AS pred_cap FROM pcap")
_reg_1f("apply_prediction_cap", "m2_1f", "scored_train", ROWK + [("pred_loss_cap", 4)],
        "SELECT student_id, coverage, round(pred_loss_cap, 4) AS pred_loss_cap FROM ptrain")
_reg_1f("tier_mean", "m2_1f", "tier_means", ["coverage", "risk_tier", ("tier_mean_cap", 4)],
        "SELECT coverage, risk_tier, round(tier_mean_cap, 4) AS tier_mean_cap FROM tmean")
_reg_1f("blend_to_tier", "m2_1f", "scored_train", ROWK + [("pred_loss_final", 4)],
        "SELECT student_id, coverage, round(pred_loss_final, 4) AS pred_loss_final FROM ptrain")
_reg_1f("blend_to_tier_test", "m2_1f", "scored_test", ROWK + [("pred_loss_final", 4)],
        "SELECT student_id, coverage, round(pred_loss_final, 4) AS pred_loss_final FROM ptest")
_reg_1f("holdout_check", "m2_1f", "holdout_check", ["coverage", ("actual", 6), ("pred_c", 4), ("ratio", 6)],
        "SELECT coverage, round(actual, 6) AS actual, round(pred_c, 4) AS pred_c, round(ratio, 6) AS ratio "
        "FROM hold")
_reg_1f("tier_base", "m2_1f", "tier_base", ["coverage", "risk_tier", "n", ("base_loss", 4)],
        "SELECT coverage, risk_tier, n, round(base_loss, 4) AS base_loss FROM tbase")
_reg_1f("coverage_mean", "m2_1f", "coverage_mean", ["coverage", ("cov_mean", 4)],
        "SELECT coverage, round(cov_mean, 4) AS cov_mean FROM cmean")
_reg_1f("credibility_smooth", "m2_1f", "base_loss", ["coverage", "risk_tier", ("base_loss", 4)],
        "SELECT coverage, risk_tier, round(base_loss, 4) AS base_loss FROM base")
_reg_1f("pricing_table", "m2_1f", "pricing_table",
        ["coverage", "risk_tier", ("base_loss", 4), ("prem_renew", 4), ("prem_new", 4)],
        "SELECT coverage, risk_tier, round(base_loss, 4) AS base_loss, round(prem_renew, 4) AS prem_renew, "
        "round(prem_new, 4) AS prem_new FROM ptable")
_reg_1f("relativity", "m2_1f", "priced",
        ROWK + [("relativity_raw", 6), ("relativity_shrunk", 6), ("relativity_cap", 6)],
        "SELECT student_id, coverage, round(relativity_raw, 6) AS relativity_raw, "
        "round(relativity_shrunk, 6) AS relativity_shrunk, round(relativity_cap, 6) AS relativity_cap "
        "FROM priced2")
_reg_1f("row_premiums", "m2_1f", "priced", ROWK + [("final_prem_renew", 4), ("final_prem_new", 4)],
        "SELECT student_id, coverage, round(final_prem_renew, 4) AS final_prem_renew, "
        "round(final_prem_new, 4) AS final_prem_new FROM priced2")
_reg_1f("cap_stats", "m2_1f", "cap_stats",
        [("pct_capped_low", 6), ("pct_capped_high", 6), ("avg_relativity", 6)],
        "SELECT round(pct_capped_low, 6) AS pct_capped_low, round(pct_capped_high, 6) AS pct_capped_high, "
        "round(avg_relativity, 6) AS avg_relativity FROM cstats")
_reg_1f("student_totals", "m2_1f", "student_totals",
        ["student_id", "risk_tier", ("total_renew", 4), ("total_new", 4)],
        "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new "
        "FROM totals")
_reg_1f("tier_premium_summary", "m2_1f", "tier_summary",
        ["risk_tier", ("avg_total_renew", 4), ("avg_total_new", 4)],
        "SELECT risk_tier, round(avg_total_renew, 4) AS avg_total_renew, round(avg_total_new, 4) AS avg_total_new "
        "FROM tsum")
_reg_1f("price_m1_onefactor", "m1_1f", "student_totals",
        ["student_id", "risk_tier", ("total_renew", 4), ("total_new", 4)],
        "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new "
        "FROM totals", "m1")
_reg_1f("price_m2_onefactor", "m2_1f", "student_totals",
        ["student_id", "risk_tier", ("total_renew", 4), ("total_new", 4)],
        "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new "
        "FROM totals")

_reg_1f("price_m3_onefactor", "m3_1f", "student_totals",
        ["student_id", "risk_tier", ("total_renew", 4), ("total_new", 4)],
        "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new "
        "FROM totals", "m3")


@query("credibility_off", O.pipeline_sql("m2", "SELECT coverage, risk_tier, round(base_loss, 4) AS base_loss "
                                               "FROM base", smooth=False))
def q_cred_off(spark, sf):
    rn = run(spark, sf, "m2_1f")
    return rt.credibility_smooth(rn.tier_base, rn.coverage_mean, on=False).select(
        "coverage", "risk_tier", r("base_loss", 4))


@query("quality_gate", O.pipeline_sql("m2", """
SELECT 'n_totals' AS "check", count(*) AS n FROM totals
UNION ALL SELECT 'null_total_renew', count(*) FILTER (WHERE total_renew IS NULL) FROM totals
UNION ALL SELECT 'null_total_new', count(*) FILTER (WHERE total_new IS NULL) FROM totals
UNION ALL SELECT 'null_row_prem_renew', count(*) FILTER (WHERE final_prem_renew IS NULL) FROM priced2
UNION ALL SELECT 'null_row_prem_new', count(*) FILTER (WHERE final_prem_new IS NULL) FROM priced2"""))
def q_quality(spark, sf):
    return run(spark, sf, "m2_1f").quality


@query("dispersion", O.pipeline_sql("m2", """
SELECT f.coverage, round(f.chi / (f.n - f.rnk), 6) AS freq_disp, round(s.chi / (s.n - s.rnk), 6) AS sev_disp
FROM (
  SELECT r.coverage, sum((r.yf - m.mu) * (r.yf - m.mu) / m.mu) AS chi, count(*) AS n,
    CASE WHEN max(st.sy) < 20 THEN 1 ELSE count(DISTINCT r.risk_tier) END AS rnk
  FROM mrows r
  JOIN fstat st ON st.coverage = r.coverage AND st.model_id = r.model_id
  JOIN (SELECT t.coverage, t.model_id, t.risk_tier,
               CASE WHEN s.sy < 20 THEN s.sy / s.n ELSE t.mu END AS mu
        FROM ftier t JOIN fstat s USING (coverage, model_id)) m
    ON m.coverage = r.coverage AND m.model_id = r.model_id AND m.risk_tier = r.risk_tier
  WHERE r.model_id = 0 GROUP BY r.coverage
) f LEFT JOIN (
  SELECT r.coverage, sum((r.y_cap - m.mu) * (r.y_cap - m.mu) / (m.mu * m.mu)) AS chi, count(*) AS n,
    CASE WHEN count(*) < 30 THEN 1 ELSE count(DISTINCT r.risk_tier) END AS rnk
  FROM mrows2 r
  JOIN (SELECT l.coverage, l.model_id, l.risk_tier,
               CASE WHEN s.n2 < 30 THEN s.mean2 ELSE l.mu END AS mu
        FROM smu l JOIN sstat s USING (coverage, model_id)) m
    ON m.coverage = r.coverage AND m.model_id = r.model_id AND m.risk_tier = r.risk_tier
  WHERE r.model_id = 0 AND r.y_cap > 0 GROUP BY r.coverage
) s ON s.coverage = f.coverage"""))
def q_dispersion(spark, sf):
    d = run(spark, sf, "m2_1f").dispersion
    return d.select("coverage", r("freq_disp", 6), r("sev_disp", 6))


@query("compare_variants_onefactor", (
    "SELECT * FROM ("
    + O.pipeline_sql("m1", "SELECT 'm1_risk_tier' AS variant, coverage, round(ratio, 6) AS ratio FROM hold")
    + ") UNION ALL SELECT * FROM ("
    + O.pipeline_sql("m2", "SELECT 'm2_risk_tier' AS variant, coverage, round(ratio, 6) AS ratio FROM hold")
    + ") UNION ALL SELECT * FROM ("
    + O.pipeline_sql("m3", "SELECT 'm3_risk_tier' AS variant, coverage, round(ratio, 6) AS ratio FROM hold")
    + ")"))
def q_compare_1f(spark, sf):
    out = None
    for rn in runs(spark, sf, ("m1_1f", "m2_1f", "m3_1f")).values():
        h = rn.holdout_check.select(F.lit(rn.variant.name).alias("variant"), "coverage", r("ratio", 6))
        out = h if out is None else out.unionByName(h)
    return out


# ------------------------------------------- full multi-factor runs -------

def _totals(key):
    def fn(spark, sf):
        return run(spark, sf, key).student_totals.select(
            "student_id", "risk_tier", r("total_renew", 4), r("total_new", 4))
    return fn


for _key in C.VARIANTS:
    query(f"price_{_key}", O.full_sql(_key, C.VARIANTS[_key].factors, (
        "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new FROM totals")))(_totals(_key))


@query("write_premiums")
def q_write_premiums(spark, sf):
    """Student totals written as the premium file and read back."""
    path = os.path.join(scratch_dir(spark), f"premiums-{uuid.uuid4().hex[:12]}")
    run(spark, sf, "m2_1f").write(path)
    back = spark.read.schema("student_id bigint, risk_tier string, total_renew double, total_new double").option("header", True).csv(path)
    return back.select("student_id", "risk_tier", r("total_renew", 4), r("total_new", 4))


SQL["write_premiums"] = SQL["student_totals"]


@query("compare_variants", " UNION ALL ".join(
    "SELECT * FROM (" + O.full_sql(k, v.factors, (
        f"SELECT '{k}' AS variant, coverage, round(actual, 6) AS actual, round(pred_c, 4) AS pred_c, round(ratio, 6) AS ratio FROM hold")) + ")"
    for k, v in C.VARIANTS.items()))
def q_compare(spark, sf):
    out = None
    for key, rn in runs(spark, sf, ("m1", "m2", "m3")).items():
        h = rn.holdout_check.select(F.lit(key).alias("variant"), "coverage", r("actual", 6), r("pred_c", 4),
                                    r("ratio", 6))
        out = h if out is None else out.unionByName(h)
    return out


# ---------------------------- relativity path on a non-constant prediction ---
# In a one-factor run every relativity is 1, so capping, blending and the
# relativity clamp are checked again on pred = mean total_paid by
# (coverage, risk_tier, dist_band) over the training rows.

def _cells_chain(spark, sf):
    k = (_sk(spark), os.path.abspath(sf), "cells_chain")
    if k in _RUNS:
        return _RUNS[k]
    train = run(spark, sf, "m2_1f").train
    means = train.groupBy("coverage", "risk_tier", "dist_band").agg(F.avg("total_paid").alias("pred_loss_cal"))
    pred = train.join(keep(means), ["coverage", "risk_tier", "dist_band"])
    caps = cal.prediction_cap(pred, "honoured")
    capped = cal.apply_prediction_cap(pred, caps)
    tm = cal.tier_mean(capped)
    final = cal.blend_to_tier(capped, tm)
    tb = rt.tier_base(final)
    base = rt.credibility_smooth(tb, rt.coverage_mean(final))
    priced = rt.row_premiums(rt.relativity(final, tb), rt.pricing_table(base))
    _RUNS[k] = dict(caps=caps, final=final, priced=priced)
    return _RUNS[k]


CELLS_SQL = [
    ("cellpred", "SELECT t.*, avg(total_paid) OVER (PARTITION BY coverage, risk_tier, dist_band) AS pred_loss_cal "
                 "FROM train t"),
    ("pcap0", f"""
SELECT coverage, count(*) AS n, {O._by_cov(0.92, 0.995, 0.97)} AS p_cap,
  {O._q_by_cov('pred_loss_cal', 0.92, 0.995, 0.97)} AS q
FROM cellpred GROUP BY coverage"""),
    ("pcap", "SELECT coverage, n, p_cap, CASE WHEN n < 50 THEN CAST('inf' AS DOUBLE) ELSE q END AS pred_cap "
             "FROM pcap0"),
    ("ctrain", """
SELECT t.*, c.pred_cap,
  CASE WHEN t.pred_loss_cal IS NULL OR c.pred_cap IS NULL THEN NULL
       ELSE least(t.pred_loss_cal, c.pred_cap) END AS pred_loss_cap
FROM cellpred t LEFT JOIN pcap c ON c.coverage = t.coverage"""),
]


def _cells_sql(select: str) -> str:
    return O.with_ctes(O.base_ctes() + CELLS_SQL + O.blend_ctes("ctrain", "ctrain")
                       + O.pricing_ctes("ptrain", "ptest"), select)


@query("prediction_cap_cells", _cells_sql("SELECT coverage, n, p_cap, round(pred_cap, 4) AS pred_cap FROM pcap"))
def q_pcap_cells(spark, sf):
    return _cells_chain(spark, sf)["caps"].select("coverage", "n", "p_cap", r("pred_cap", 4))


@query("prediction_cap_small_n", _cells_sql("""
SELECT coverage, n, round(CASE WHEN n < ceil(avg(n) OVER ()) THEN CAST('inf' AS DOUBLE) ELSE q END, 4) AS honoured, round(q, 4) AS ignored
FROM pcap0"""))
def q_pcap_small_n(spark, sf):
    """Both modes with the minimum at the mean row count, so that some coverages fall below it."""
    chain = _cells_chain(spark, sf)
    least = chain["caps"].agg(F.ceil(F.avg("n"))).first()[0] or 0
    honoured = cal.prediction_cap(chain["final"], "honoured", least).select("coverage", "n", r("pred_cap", 4, "honoured"))
    ignored = cal.prediction_cap(chain["final"], "ignored", least).select("coverage", r("pred_cap", 4, "ignored"))
    return honoured.join(ignored, "coverage")


@query("blend_cells", _cells_sql(
    "SELECT student_id, coverage, round(pred_loss_cap, 4) AS pred_loss_cap, "
    "round(pred_loss_final, 4) AS pred_loss_final FROM ptrain"))
def q_blend_cells(spark, sf):
    return _cells_chain(spark, sf)["final"].select(*ROWK, r("pred_loss_cap", 4), r("pred_loss_final", 4))


@query("relativity_cells", _cells_sql(
    "SELECT student_id, coverage, round(relativity_raw, 6) AS relativity_raw, "
    "round(relativity_shrunk, 6) AS relativity_shrunk, round(relativity_cap, 6) AS relativity_cap FROM priced2"))
def q_rel_cells(spark, sf):
    return _cells_chain(spark, sf)["priced"].select(
        *ROWK, r("relativity_raw", 6), r("relativity_shrunk", 6), r("relativity_cap", 6))


@query("row_premiums_cells", _cells_sql(
    "SELECT student_id, coverage, round(final_prem_renew, 4) AS final_prem_renew, "
    "round(final_prem_new, 4) AS final_prem_new FROM priced2"))
def q_prem_cells(spark, sf):
    return _cells_chain(spark, sf)["priced"].select(*ROWK, r("final_prem_renew", 4), r("final_prem_new", 4))


@query("cap_stats_cells", _cells_sql(
    "SELECT round(pct_capped_low, 6) AS pct_capped_low, round(pct_capped_high, 6) AS pct_capped_high, "
    "round(avg_relativity, 6) AS avg_relativity FROM cstats"))
def q_cstats_cells(spark, sf):
    return rt.cap_stats(_cells_chain(spark, sf)["priced"]).select(
        r("pct_capped_low", 6), r("pct_capped_high", 6), r("avg_relativity", 6))


@query("student_totals_cells", _cells_sql(
    "SELECT student_id, risk_tier, round(total_renew, 4) AS total_renew, round(total_new, 4) AS total_new "
    "FROM totals"))
def q_totals_cells(spark, sf):
    return rt.student_totals(_cells_chain(spark, sf)["priced"]).select(
        "student_id", "risk_tier", r("total_renew", 4), r("total_new", 4))

