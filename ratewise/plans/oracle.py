"""DuckDB oracle SQL, written independently of the Spark code.

With the single factor ``risk_tier`` every GLM of the pipeline (logit,
Poisson, gamma-log) fits the group mean of its response per level, so the
whole pricing job can be restated in plain SQL: ``avg ... GROUP BY`` for the
fits, ``quantile_cont`` for R's type-7 quantiles, ``nullif`` where R divides
by zero, a strict mean for ``mean`` without ``na.rm``. The stages are one
chain of CTEs; each query selects from the stage it checks.

The full runs have several factors. Their main-effects fits come from sweeps
over the factors on the cells of all levels (``fit_ctes``): a Poisson or gamma
step scales a level's means until its score equation holds, a logit step is
one Newton step of the level's effect.
"""

from __future__ import annotations

from ratewise.sources.claims import FIXTURE_CLAIMS_SQL

K = 5


def _member_values(k: int = K) -> str:
    rows = [(0, f) for f in range(1, k + 1)] + [
        (m, f) for m in range(1, k + 1) for f in range(1, k + 1) if f != m]
    return ", ".join(f"({m}, {f})" for m, f in rows)


def _by_cov(gm, liab, other, col="coverage") -> str:
    return (f"CASE WHEN {col} = 'Guest Medical' THEN CAST({gm} AS DOUBLE) "
            f"WHEN {col} = 'Liability' THEN CAST({liab} AS DOUBLE) ELSE CAST({other} AS DOUBLE) END")


def _q_by_cov(expr, gm, liab, other, filt="") -> str:
    f = f" FILTER (WHERE {filt})" if filt else ""
    return (f"CASE WHEN coverage = 'Guest Medical' THEN quantile_cont({expr}, {gm}){f} "
            f"WHEN coverage = 'Liability' THEN quantile_cont({expr}, {liab}){f} "
            f"ELSE quantile_cont({expr}, {other}){f} END")


def strict_mean(x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN avg({x}) END"


DIST_BAND_SQL = """CASE WHEN distance_to_campus IS NULL THEN 'Unknown' WHEN distance_to_campus = 0 THEN '0'
  WHEN distance_to_campus <= 1 THEN '0-1' WHEN distance_to_campus <= 3 THEN '1-3' ELSE '3+' END"""
GPA_BAND_SQL = """CASE WHEN gpa IS NULL THEN 'Unknown' WHEN gpa < 2.0 THEN '<2.0'
  WHEN gpa < 3.0 THEN '2.0-2.99' ELSE '3.0+' END"""


def base_ctes() -> list[tuple[str, str]]:
    """Stages shared by every variant: claims, exposure, split, folds."""
    return [
        ("claims", FIXTURE_CLAIMS_SQL),
        ("exposure", """
SELECT student_id, coverage,
  first(risk_tier ORDER BY row_id) AS risk_tier, first(gpa ORDER BY row_id) AS gpa,
  first(greek ORDER BY row_id) AS greek, first(off_campus ORDER BY row_id) AS off_campus,
  first(distance_to_campus ORDER BY row_id) AS distance_to_campus,
  first(sprinklered ORDER BY row_id) AS sprinklered, first(gender ORDER BY row_id) AS gender,
  first(holdout ORDER BY row_id) AS holdout,
  coalesce(sum(amount), 0) AS total_paid,
  count(*) FILTER (WHERE amount > 0) AS claim_n
FROM claims GROUP BY student_id, coverage"""),
        ("ex", """
SELECT *, CASE WHEN claim_n > 0 THEN total_paid / claim_n ELSE CAST(0 AS DOUBLE) END AS avg_paid,
  total_paid > 0 AS has_claim
FROM exposure"""),
        ("prep", f"""
SELECT student_id, holdout, coalesce(coverage, 'Unknown') AS coverage,
  coalesce(risk_tier, 'Unknown') AS risk_tier, coalesce(greek, 'Unknown') AS greek,
  coalesce(off_campus, 'Unknown') AS off_campus, coalesce(sprinklered, 'Unknown') AS sprinklered,
  coalesce(gender, 'Unknown') AS gender, distance_to_campus, gpa,
  {DIST_BAND_SQL} AS dist_band, {GPA_BAND_SQL} AS gpa_band,
  total_paid, claim_n, avg_paid, has_claim
FROM ex"""),
        ("train", "SELECT * FROM prep WHERE holdout = false"),
        ("test", """
SELECT student_id,
  CASE WHEN coverage IN (SELECT coverage FROM train) THEN coverage END AS coverage,
  CASE WHEN risk_tier IN (SELECT risk_tier FROM train) THEN risk_tier END AS risk_tier,
  total_paid, claim_n, avg_paid, has_claim
FROM prep WHERE holdout = true"""),
        ("folds", """
SELECT *, CAST((row_number() OVER (PARTITION BY coverage
    ORDER BY md5(CAST(student_id AS VARCHAR) || '|1'), student_id) - 1) % 5 + 1 AS INTEGER) AS fold
FROM train"""),
        ("member", f"SELECT * FROM (VALUES {_member_values()}) AS m(model_id, fold)"),
    ]


#: Sweeps over all factors; the means move by less than 1e-13 long before the last.
SWEEPS = 60


def _cols(factors, alias: str) -> str:
    return ", ".join(f"{alias}.{f}" for f in factors)


def _same(factors, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{f} = {b}.{f}" for f in factors)


def aligned_test(factors) -> tuple[str, str]:
    """Test rows whose coverage and factors are null where the training rows lack the value."""
    aligned = ", ".join(f"CASE WHEN {c} IN (SELECT {c} FROM train) THEN {c} END AS {c}" for c in ("coverage", *factors))
    return ("test", f"SELECT student_id, {aligned}, total_paid, claim_n, avg_paid, has_claim FROM prep WHERE holdout = true")


def fit_ctes(variant: str, factors) -> list[tuple[str, str]]:
    """``ftier`` and ``smu``: fitted means of every cell (coverage, model, factor levels).

    A level that a model's rows lack has no score equation, and its cells no mean.
    """
    turn = "CASE it % {n} {whens} END".format(
        n=len(factors), whens=" ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(factors)))
    if variant == "m1":  # freq is the logit
        p = "(1 / (1 + exp(-freq)))"
        start = "CAST(0 AS DOUBLE)"
        step = f"freq + sum(sy - n * {p}) OVER w / nullif(sum(n * {p} * (1 - {p})) OVER w, 0)"
        mean = p
    else:  # freq is the mean
        start = "CAST(1 AS DOUBLE)"
        step = "freq * coalesce(sum(sy) OVER w / nullif(sum(n * freq) OVER w, 0), CASE WHEN sum(n) OVER w > 0 THEN 1 END)"
        mean = "freq"
    f = ", ".join(factors)
    known = " AND ".join(f"{c} IS NOT NULL" for c in ("coverage", *factors))
    return [
        ("cellkeys", f"SELECT coverage, {f} FROM folds UNION SELECT coverage, {f} FROM test WHERE {known}"),
        ("cellsums", f"""
SELECT coverage, model_id, {f}, sum(yf) AS sy, count(*) AS n, count(*) FILTER (WHERE y_cap > 0) AS n2,
  coalesce(sum(y_cap) FILTER (WHERE y_cap > 0), 0) AS sy2
FROM mrows2 GROUP BY ALL"""),
        ("fit", f"""
SELECT 0 AS it, k.coverage, m.model_id, {_cols(factors, 'k')}, coalesce(c.sy, 0)::DOUBLE AS sy, coalesce(c.n, 0)::DOUBLE AS n,
  coalesce(c.n2, 0)::DOUBLE AS n2, coalesce(c.sy2, 0)::DOUBLE AS sy2, {start} AS freq, CAST(1 AS DOUBLE) AS sev
FROM cellkeys k CROSS JOIN (SELECT DISTINCT model_id FROM member) m
LEFT JOIN cellsums c ON c.coverage = k.coverage AND c.model_id = m.model_id AND {_same(factors, 'c', 'k')}
UNION ALL
SELECT it + 1, coverage, model_id, {f}, sy, n, n2, sy2, {step},
  sev * (sum(sy2 / sev) OVER w / nullif(sum(n2) OVER w, 0))
FROM fit WHERE it < {SWEEPS * len(factors)}
WINDOW w AS (PARTITION BY coverage, model_id, {turn})"""),
        ("ftier", f"SELECT coverage, model_id, {f}, {mean} AS mu FROM fit WHERE it = {SWEEPS * len(factors)}"),
        ("smu", f"SELECT coverage, model_id, {f}, sev AS mu FROM fit WHERE it = {SWEEPS * len(factors)}"),
    ]


def variant_ctes(variant: str, factors=("risk_tier",)) -> list[tuple[str, str]]:
    """Pricing stages for a variant; with risk_tier alone the fits are plain group means."""
    if variant == "m1":
        y, pos, yf = "total_paid", "total_paid > 0", "CAST(has_claim AS DOUBLE)"
    else:
        y, pos, yf = "avg_paid", "claim_n > 0", "CAST(claim_n AS DOUBLE)"
    honoured = variant != "m1"
    pred_cap = ("CASE WHEN n < 50 THEN CAST('inf' AS DOUBLE) ELSE q END" if honoured else "q")

    def score(src: str, mid: str) -> str:
        return f"""
SELECT r.*,
  CASE WHEN fs.sy < 20 THEN fs.sy / fs.n ELSE fm.mu END AS mu_freq,
  CASE WHEN ss.n2 < 30 THEN ss.mean2 ELSE sm.mu END AS mu_sev,
  u.uncap_adj,
  (CASE WHEN fs.sy < 20 THEN fs.sy / fs.n ELSE fm.mu END)
   * (CASE WHEN ss.n2 < 30 THEN ss.mean2 ELSE sm.mu END) * u.uncap_adj AS pure
FROM {src} r
LEFT JOIN fstat fs ON fs.coverage = r.coverage AND fs.model_id = {mid}
LEFT JOIN ftier fm ON fm.coverage = r.coverage AND fm.model_id = {mid} AND {_same(factors, 'fm', 'r')}
LEFT JOIN sstat ss ON ss.coverage = r.coverage AND ss.model_id = {mid}
LEFT JOIN smu sm ON sm.coverage = r.coverage AND sm.model_id = {mid} AND {_same(factors, 'sm', 'r')}
LEFT JOIN uncap u ON u.coverage = r.coverage AND u.model_id = {mid}"""

    one = [
        ("ftier", "SELECT coverage, model_id, risk_tier, avg(yf) AS mu FROM mrows GROUP BY 1, 2, 3"),
        ("stier", """
SELECT coverage, model_id, risk_tier, avg(y_cap) AS mu FROM mrows2 WHERE y_cap > 0 GROUP BY 1, 2, 3"""),
        # a level without claimants is unseen by the severity fit: it has no mean
        ("smu", "SELECT coverage, model_id, risk_tier, mu FROM stier"),
    ]
    return [
        ("mrows", f"""
SELECT f.*, m.model_id, {y} AS y, {pos} AS pos, {yf} AS yf
FROM folds f JOIN member m ON f.fold = m.fold"""),
        ("sevp", f"""
SELECT coverage, model_id, count(*) AS n, count(*) FILTER (WHERE pos) AS n_pos,
  {_q_by_cov('y', 0.85, 0.97, 0.95, 'pos')} AS q
FROM mrows GROUP BY coverage, model_id"""),
        ("sevcap", """
SELECT coverage, model_id, n, n_pos, n_pos >= 30 AS capped,
  CASE WHEN n_pos >= 30 THEN q ELSE CAST('inf' AS DOUBLE) END AS cap
FROM sevp"""),
        ("mrows2", """
SELECT r.*, s.cap, CASE WHEN r.pos THEN least(r.y, s.cap) ELSE CAST(0 AS DOUBLE) END AS y_cap
FROM mrows r JOIN sevcap s ON s.coverage = r.coverage AND s.model_id = r.model_id"""),
        ("uncap", f"""
SELECT s.coverage, s.model_id, s.n, s.n_pos, s.capped, s.cap,
  pow(CASE WHEN s.capped THEN a.m / nullif(a.mc, 0) ELSE CAST(1 AS DOUBLE) END,
      {_by_cov(0.0, 0.95, 0.20, 's.coverage')}) AS uncap_adj
FROM sevcap s LEFT JOIN (
  SELECT coverage, model_id, avg(y) AS m, avg(least(y, cap)) AS mc FROM mrows2 WHERE pos GROUP BY 1, 2
) a ON a.coverage = s.coverage AND a.model_id = s.model_id"""),
        ("fstat", "SELECT coverage, model_id, sum(yf) AS sy, count(*) AS n FROM mrows GROUP BY 1, 2"),
        ("sstat", """
SELECT coverage, model_id, count(*) AS n2, avg(y_cap) AS mean2 FROM mrows2 WHERE y_cap > 0 GROUP BY 1, 2"""),
        *(one if len(factors) == 1 else fit_ctes(variant, factors)),
        ("oof", score("folds", "r.fold")),
        ("cal0", """
SELECT coverage, count(*) FILTER (WHERE total_paid > 0) AS n_claim,
  coalesce(sum(total_paid), 0) AS y, coalesce(sum(pure), 0) AS p
FROM oof GROUP BY coverage"""),
        ("cal", """
SELECT coverage, n_claim, y, p, y / greatest(p, CAST(1e-9 AS DOUBLE)) AS raw_cal,
  n_claim / (n_claim + CAST(1000 AS DOUBLE)) AS w,
  least(greatest(1 + (y / greatest(p, CAST(1e-9 AS DOUBLE)) - 1) * (n_claim / (n_claim + CAST(1000 AS DOUBLE))),
                 CAST(0.70 AS DOUBLE)), CAST(1.30 AS DOUBLE)) AS cal_factor
FROM cal0"""),
        ("ptrain0", f"""
SELECT s.*, s.pure AS pred_loss, c.cal_factor, s.pure * c.cal_factor AS pred_loss_cal
FROM ({score("folds", "0")}) s LEFT JOIN cal c ON c.coverage = s.coverage"""),
        ("ptest0", f"""
SELECT s.*, s.pure AS pred_loss, c.cal_factor, s.pure * c.cal_factor AS pred_loss_cal
FROM ({score("test", "0")}) s LEFT JOIN cal c ON c.coverage = s.coverage"""),
        ("pcap0", f"""
SELECT coverage, count(*) AS n, {_by_cov(0.92, 0.995, 0.97)} AS p_cap,
  {_q_by_cov('pred_loss_cal', 0.92, 0.995, 0.97)} AS q
FROM ptrain0 GROUP BY coverage"""),
        ("pcap", f"SELECT coverage, n, p_cap, {pred_cap} AS pred_cap FROM pcap0"),
        ("ptrain1", """
SELECT t.*, c.pred_cap,
  CASE WHEN t.pred_loss_cal IS NULL OR c.pred_cap IS NULL THEN NULL
       ELSE least(t.pred_loss_cal, c.pred_cap) END AS pred_loss_cap
FROM ptrain0 t LEFT JOIN pcap c ON c.coverage = t.coverage"""),
        ("ptest1", """
SELECT t.*, c.pred_cap,
  CASE WHEN t.pred_loss_cal IS NULL OR c.pred_cap IS NULL THEN NULL
       ELSE least(t.pred_loss_cal, c.pred_cap) END AS pred_loss_cap
FROM ptest0 t LEFT JOIN pcap c ON c.coverage = t.coverage"""),
        *blend_ctes("ptrain1", "ptest1"),
        *pricing_ctes("ptrain", "ptest"),
    ]


def blend_ctes(train_src: str, test_src: str) -> list[tuple[str, str]]:
    final = """CASE WHEN t.coverage IS NULL THEN NULL
       WHEN t.coverage = 'Liability' THEN CAST(0.40 AS DOUBLE) * m.tier_mean_cap + CAST(0.60 AS DOUBLE) * t.pred_loss_cap
       ELSE t.pred_loss_cap END"""
    return [
        ("tmean", f"""
SELECT coverage, risk_tier, avg(pred_loss_cap) AS tier_mean_cap FROM {train_src} GROUP BY 1, 2"""),
        ("ptrain", f"""
SELECT t.*, m.tier_mean_cap, {final} AS pred_loss_final
FROM {train_src} t LEFT JOIN tmean m ON m.coverage = t.coverage AND m.risk_tier = t.risk_tier"""),
        ("ptest", f"""
SELECT t.*, m.tier_mean_cap, {final} AS pred_loss_final
FROM {test_src} t LEFT JOIN tmean m ON m.coverage = t.coverage AND m.risk_tier = t.risk_tier"""),
    ]


def pricing_ctes(train_src: str, test_src: str, smooth: bool = True) -> list[tuple[str, str]]:
    base = ("""
SELECT b.coverage, b.risk_tier,
  (b.n / (b.n + CAST(800 AS DOUBLE))) * b.base_loss + (1 - b.n / (b.n + CAST(800 AS DOUBLE))) * c.cov_mean AS base_loss
FROM tbase b LEFT JOIN cmean c ON c.coverage = b.coverage""" if smooth else
            "SELECT coverage, risk_tier, base_loss FROM tbase")
    d = "(CAST(1 AS DOUBLE) - CAST({v} AS DOUBLE) - CAST(0.05 AS DOUBLE))"
    return [
        ("hold", f"""
SELECT coverage, actual, pred_c, pred_c / nullif(actual, 0) AS ratio FROM (
  SELECT coverage, {strict_mean('total_paid')} AS actual, {strict_mean('pred_loss_final')} AS pred_c
  FROM {test_src} GROUP BY coverage)"""),
        ("tbase", f"""
SELECT coverage, risk_tier, count(*) AS n, {strict_mean('pred_loss_final')} AS base_loss
FROM {train_src} GROUP BY 1, 2"""),
        ("cmean", f"SELECT coverage, {strict_mean('pred_loss_final')} AS cov_mean FROM {train_src} GROUP BY 1"),
        ("base", base),
        ("ptable", f"""
SELECT coverage, risk_tier, base_loss,
  (base_loss + CAST(25 AS DOUBLE)) / {d.format(v=0.30)} AS prem_renew,
  (base_loss + CAST(35 AS DOUBLE)) / {d.format(v=0.35)} AS prem_new
FROM base"""),
        ("rel", f"""
SELECT t.*, b.base_loss AS tier_pred_avg, t.pred_loss_final / nullif(b.base_loss, 0) AS relativity_raw,
  pow(t.pred_loss_final / nullif(b.base_loss, 0), CAST(0.35 AS DOUBLE)) AS relativity_shrunk
FROM {train_src} t LEFT JOIN tbase b ON b.coverage = t.coverage AND b.risk_tier = t.risk_tier"""),
        ("priced", """
SELECT r.*, CASE WHEN r.relativity_shrunk IS NULL THEN NULL
    ELSE least(greatest(r.relativity_shrunk, CAST(0.70 AS DOUBLE)), CAST(1.50 AS DOUBLE)) END AS relativity_cap,
  p.prem_renew, p.prem_new
FROM rel r LEFT JOIN ptable p ON p.coverage = r.coverage AND p.risk_tier = r.risk_tier"""),
        ("priced2", """
SELECT *, prem_renew * relativity_cap AS final_prem_renew, prem_new * relativity_cap AS final_prem_new
FROM priced"""),
        ("cstats", """
SELECT avg(CAST(relativity_shrunk < 0.70 AS DOUBLE)) AS pct_capped_low,
  avg(CAST(relativity_shrunk > 1.50 AS DOUBLE)) AS pct_capped_high,
  avg(relativity_cap) AS avg_relativity
FROM priced2"""),
        ("totals", """
SELECT student_id, risk_tier, coalesce(sum(final_prem_renew), 0) AS total_renew,
  coalesce(sum(final_prem_new), 0) AS total_new
FROM priced2 GROUP BY 1, 2"""),
        ("tsum", """
SELECT risk_tier, avg(total_renew) AS avg_total_renew, avg(total_new) AS avg_total_new
FROM totals GROUP BY 1"""),
    ]


def with_ctes(ctes: list[tuple[str, str]], select: str) -> str:
    body = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH RECURSIVE {body}\n{select}"


def pipeline_sql(variant: str, select: str, smooth: bool = True) -> str:
    ctes = base_ctes() + variant_ctes(variant)
    if not smooth:
        ctes = [(n, s) for n, s in ctes if n != "base"]
        idx = [n for n, _ in ctes].index("ptable")
        ctes.insert(idx, ("base", "SELECT coverage, risk_tier, base_loss FROM tbase"))
    return with_ctes(ctes, select)


def full_sql(variant: str, factors, select: str) -> str:
    """The whole run with all of a variant's factors."""
    ctes = [c for c in base_ctes() if c[0] != "test"]
    ctes.insert([n for n, _ in ctes].index("folds"), aligned_test(factors))
    return with_ctes(ctes + variant_ctes(variant, factors), select)


def base_sql(select: str) -> str:
    return with_ctes(base_ctes(), select)
