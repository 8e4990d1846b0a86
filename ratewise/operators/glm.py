"""GLM fits on sufficient-statistic cells, all models in one grouped job.

Every predictor is categorical, so a fit sees the rows only through the
count ``n``, ``Σy`` (and ``Σy²`` for dispersion) of each combination of
levels: the design cells. Cells are built by a distributed aggregate and are
small (at most the product of the level counts per model), so one Python
worker per (coverage, model_id, part) runs Newton's method on them.

The design matrix is never built: a factor is one level number a cell, a
score is a sum per level, the information a table of sums per pair of levels.
The levels of one factor don't meet each other in a cell, so the block of the
longest factor is diagonal and is eliminated first; only the other factors'
columns form a dense system. Memory is levels of the longest factor times
columns of the others.

Solver: Newton with the observed information and step halving (the three
log-likelihoods are concave in the linear predictor), started at the
intercept-only fit, stopped when the largest score entry is below
``1e-9 · Σn``, then one extra step. Columns are tested for aliasing in
model-matrix order (intercept, then each factor's non-base levels in sorted
order): a column that is a linear combination of the columns before it
gets coefficient 0, as R does for rank-deficient fits. Levels are sorted
bytewise; the first is the base level. A factor with a single level gets no
column (R would refuse the contrast; documented deviation).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewise.config import MIN_CLAIMS_FOR_FREQ_FACTORS, MIN_POS_FOR_SEV_FACTORS

INTERCEPT = "(Intercept)"
ETA_CLIP = 60.0

COEF_SCHEMA = (
    "variant string, coverage string, model_id int, part string, factor string, level string, beta double, "
    "n_factors int, iterations int, rank int, converged boolean, thin boolean"
)


# ---------------------------------------------------------------- numerics ---

def _loglik(family, eta, n, sy):
    if family == "poisson":
        return float(np.sum(sy * eta - n * np.exp(eta)))
    if family == "binomial":
        return float(np.sum(sy * eta - n * np.logaddexp(0.0, eta)))
    return float(np.sum(-sy * np.exp(-eta) - n * eta))  # gamma, log link


def _score_info(family, X, eta, n, sy):
    if family == "poisson":
        mu = np.exp(eta)
        return X.T @ (sy - n * mu), X.T @ (X * (n * mu)[:, None])
    if family == "binomial":
        mu = 1.0 / (1.0 + np.exp(-eta))
        return X.T @ (sy - n * mu), X.T @ (X * (n * mu * (1.0 - mu))[:, None])
    r = sy * np.exp(-eta)  # gamma: d/deta = y/mu - 1, observed information y/mu
    return X.T @ (r - n), X.T @ (X * r[:, None])


def _start(family, n, sy) -> float:
    ybar = sy.sum() / n.sum()
    if family == "binomial":
        ybar = min(max(ybar, 1e-300), 1 - 1e-16)
        return float(np.clip(np.log(ybar / (1 - ybar)), -ETA_CLIP, ETA_CLIP))
    return float(np.clip(np.log(ybar), -ETA_CLIP, ETA_CLIP)) if ybar > 0 else -ETA_CLIP


def kept_columns(X: np.ndarray, tol: float = 1e-7) -> list[int]:
    """Indices of columns not linearly dependent on earlier columns."""
    basis: list[np.ndarray] = []
    kept = []
    for j in range(X.shape[1]):
        x = X[:, j].astype(float)
        norm0 = np.linalg.norm(x)
        if norm0 == 0:
            continue
        r = x.copy()
        for _ in range(2):  # re-orthogonalise once for stability
            for q in basis:
                r -= (q @ r) * q
        nr = np.linalg.norm(r)
        if nr > tol * norm0:
            basis.append(r / nr)
            kept.append(j)
    return kept


def newton_fit(family: str, X: np.ndarray, n: np.ndarray, sy: np.ndarray,
               max_iter: int = 200, tol: float = 1e-9):
    """Returns (beta, iterations, converged) for a full-rank X."""
    p = X.shape[1]
    beta = np.zeros(p)
    beta[0] = _start(family, n, sy)
    total = float(n.sum())

    def eta_of(b):
        return np.clip(X @ b, -ETA_CLIP, ETA_CLIP)

    ll = _loglik(family, eta_of(beta), n, sy)
    converged, extra_done, it = False, False, 0
    for it in range(1, max_iter + 1):
        grad, info = _score_info(family, X, eta_of(beta), n, sy)
        small_grad = np.max(np.abs(grad)) < tol * total
        if small_grad and extra_done:
            converged = True
            break
        try:
            step = np.linalg.solve(info, grad)
        except np.linalg.LinAlgError:
            step = np.linalg.lstsq(info, grad, rcond=None)[0]
        t = 1.0
        for _ in range(40):
            cand = beta + t * step
            ll_c = _loglik(family, eta_of(cand), n, sy)
            if np.isfinite(ll_c) and ll_c >= ll - 1e-12 * abs(ll):
                break
            t *= 0.5
        beta, ll = cand, ll_c
        if small_grad:
            extra_done = True
    return beta, it, converged


# ------------------------------------------------------- level-wise design ---

class LevelDesign:
    """Intercept and factor dummies over cells, as level numbers.

    codes  one integer array a factor: the level of each cell
    sizes  the number of levels of each factor (level 0 is the base)

    Columns are the intercept, then levels 1.. of each factor in turn.
    """

    def __init__(self, codes, sizes, n_cells: int):
        self.codes, self.sizes, self.cells = list(codes), list(sizes), n_cells
        self.starts = np.cumsum([1] + [k - 1 for k in self.sizes])[:-1].astype(int)
        self.columns = 1 + int(sum(k - 1 for k in self.sizes))

    def eta(self, beta):
        out = np.full(self.cells, beta[0])
        for c, k, s in zip(self.codes, self.sizes, self.starts):
            out += np.concatenate(([0.0], beta[s:s + k - 1]))[c]
        return out

    def sums(self, w):
        """X' w."""
        parts = [np.bincount(c, w, k)[1:] for c, k in zip(self.codes, self.sizes)]
        return np.concatenate([[w.sum()], *parts])

    def block(self, f, g, w):
        """X_f' W X_g for factors f and g (None: the intercept)."""
        if f is None and g is None:
            return np.array([[w.sum()]])
        if f is None or g is None:
            one = np.bincount(self.codes[g if f is None else f], w, self.sizes[g if f is None else f])[1:]
            return one[None, :] if f is None else one[:, None]
        if f == g:
            return np.diag(np.bincount(self.codes[f], w, self.sizes[f])[1:])
        kf, kg = self.sizes[f], self.sizes[g]
        return np.bincount(self.codes[f] * kg + self.codes[g], w, kf * kg).reshape(kf, kg)[1:, 1:]

    def cross(self, rows, cols, w):
        """X_rows' W X_cols for lists of factors."""
        return np.block([[self.block(f, g, w) for g in cols] for f in rows])

    def long_factor(self):
        return int(np.argmax(self.sizes)) if self.sizes else None

    def span(self, f):
        return np.arange(self.starts[f], self.starts[f] + self.sizes[f] - 1)

    def kept(self, tol: float = 1e-7) -> np.ndarray:
        """Mask of the columns that are no linear combination of earlier ones.

        The intercept and the first factor's levels are independent as they stand; what
        they explain of the later columns is taken out in closed form (means within the
        first factor's levels), and the rest is eliminated column by column.
        """
        out = np.zeros(self.columns, bool)
        out[0] = True
        if not self.sizes:
            return out
        one = np.ones(self.cells)
        first = np.bincount(self.codes[0], one, self.sizes[0])
        out[self.span(0)] = first[1:] > 0
        rest = list(range(1, len(self.sizes)))
        if not rest or self.columns == 1 + self.sizes[0] - 1:
            return out
        k0 = self.sizes[0]
        c = np.concatenate([np.bincount(self.codes[0] * self.sizes[g] + self.codes[g], one, k0 * self.sizes[g]).reshape(k0, -1)[:, 1:] for g in rest], axis=1)
        norm = np.concatenate([np.bincount(self.codes[g], one, self.sizes[g])[1:] for g in rest])
        gram = self.cross(rest, rest, one) - (c / np.maximum(first, 1)[:, None]).T @ c
        at = int(self.starts[1])
        for j in range(len(norm)):
            left = gram[j, j]
            if norm[j] == 0 or left <= (tol * tol + 1e-12) * norm[j]:
                continue
            out[at + j] = True
            near = j + 1 + np.flatnonzero(np.abs(gram[j, j + 1:]) > 0)
            gram[np.ix_(near, near)] -= np.outer(gram[j, near], gram[j, near] / left)
        return out

    def solve(self, w, grad, kept):
        """The Newton step: (X' W X) step = grad over the kept columns, 0 elsewhere."""
        step = np.zeros(self.columns)
        big = self.long_factor()
        others = [None] + [f for f in range(len(self.sizes)) if f != big]
        at = np.concatenate([[0], *[self.span(f) for f in others[1:]]]).astype(int)
        keep = kept[at]
        small = self.cross(others, others, w)[np.ix_(keep, keep)]
        rhs, at = grad[at[keep]], at[keep]
        if big is None:
            step[at] = _solve(small, rhs)
            return step
        long = self.span(big)
        on = kept[long]
        d = np.bincount(self.codes[big], w, self.sizes[big])[1:][on]
        c = self.cross([big], others, w)[np.ix_(on, keep)]
        per = c / d[:, None]
        x = _solve(small - c.T @ per, rhs - per.T @ grad[long[on]])
        step[at] = x
        step[long[on]] = grad[long[on]] / d - per @ x
        return step


def _solve(a, b):
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _weights(family, eta, n, sy):
    """Score and observed information of a cell with respect to its linear predictor."""
    if family == "gamma":
        r = sy * np.exp(-eta)  # d/deta = y/mu - 1, observed information y/mu
        return r - n, r
    mu = np.exp(eta) if family == "poisson" else 1.0 / (1.0 + np.exp(-eta))
    return sy - n * mu, n * mu * (1.0 if family == "poisson" else 1.0 - mu)


def level_fit(family: str, design: LevelDesign, n: np.ndarray, sy: np.ndarray, max_iter: int = 200, tol: float = 1e-9):
    """(beta over all columns, kept mask, iterations, converged)."""
    kept = design.kept()
    beta = np.zeros(design.columns)
    beta[0] = _start(family, n, sy)
    total = float(n.sum())

    def eta_of(b):
        return np.clip(design.eta(b), -ETA_CLIP, ETA_CLIP)

    ll = _loglik(family, eta_of(beta), n, sy)
    extra_done, it = False, 0
    for it in range(1, max_iter + 1):
        u, w = _weights(family, eta_of(beta), n, sy)
        grad = np.where(kept, design.sums(u), 0.0)
        small_grad = np.max(np.abs(grad)) < tol * total
        if small_grad and extra_done:
            return beta, kept, it, True
        step = design.solve(w, grad, kept)
        t = 1.0
        for _ in range(40):
            cand = beta + t * step
            ll_c = _loglik(family, eta_of(cand), n, sy)
            if np.isfinite(ll_c) and ll_c >= ll - 1e-12 * abs(ll):
                break
            t *= 0.5
        else:  # no step improves on beta
            return beta, kept, it, bool(small_grad)
        beta, ll = cand, ll_c
        extra_done = extra_done or bool(small_grad)
    return beta, kept, it, False


# ------------------------------------------------------------ grouped fit ---

def _fit_group(key, cells: pd.DataFrame, levels: pd.DataFrame, factors, freq_family: str,
               min_claims: float = MIN_CLAIMS_FOR_FREQ_FACTORS,
               min_pos: float = MIN_POS_FOR_SEV_FACTORS) -> pd.DataFrame:
    coverage, model_id, part = key[-3:]
    family = freq_family if part == "freq" else "gamma"
    n = cells["n"].to_numpy(dtype=float) if len(cells) else np.zeros(0)
    sy = cells["sy"].to_numpy(dtype=float) if len(cells) else np.zeros(0)
    if part == "freq":
        thin = float(sy.sum()) < min_claims
    else:
        thin = float(n.sum()) < min_pos
    use = [] if thin else list(factors)

    lv = {f: sorted(levels.loc[levels["factor"] == f, "level"].dropna().unique().tolist()) for f in use}
    cols = [(INTERCEPT, None)]
    for f in use:
        cols += [(f, lvl) for lvl in lv[f][1:]]

    beta_full = np.zeros(len(cols))
    iterations, rank, converged = 0, 0, False
    if len(cells) and n.sum() > 0:
        codes = [pd.Index(lv[f]).get_indexer(cells[f]).astype(np.int64) for f in use]
        design = LevelDesign(codes, [len(lv[f]) for f in use], len(cells))
        beta_full, kept, iterations, converged = level_fit(family, design, n, sy)
        rank = int(kept.sum())
    else:
        beta_full[0] = np.nan

    coef_of = {c: b for c, b in zip(cols, beta_full)}
    out = [(INTERCEPT, None, beta_full[0])]
    for f in use:
        for lvl in lv[f]:
            out.append((f, lvl, coef_of.get((f, lvl), 0.0)))
    df = pd.DataFrame(out, columns=["factor", "level", "beta"])
    df.insert(0, "part", part)
    df.insert(0, "model_id", np.int32(model_id))
    df.insert(0, "coverage", coverage)
    df["n_factors"] = np.int32(len(use))
    df["iterations"] = np.int32(iterations)
    df["rank"] = np.int32(rank)
    df["converged"] = bool(converged)
    df["thin"] = bool(thin)
    df["model_id"] = df["model_id"].astype("int32")
    return df


def fit_models(cells: DataFrame, model_levels: DataFrame, factors, freq_family,
               min_claims: float = MIN_CLAIMS_FOR_FREQ_FACTORS,
               min_pos: float = MIN_POS_FOR_SEV_FACTORS) -> DataFrame:
    """All (variant, coverage, model_id, part) fits as one cogrouped ``applyInPandas``.

    cells         (variant, coverage, model_id, part, factors..., n, sy)
    model_levels  (variant, coverage, model_id, part, factor, level): the levels each fit
                  has seen; a level without claimants is unseen by the severity
                  fit, so its severity (and pure premium) is null.
    factors, freq_family  of each variant by name; or of all, for tables without ``variant``
    min_claims    frequency falls back to intercept only below this many claims
    min_pos       severity falls back to intercept only below this many claimants
    Returns the long coefficient table ``COEF_SCHEMA``, without ``variant`` if the cells have none.
    """
    joint = "variant" in cells.columns
    if not joint:
        cells, model_levels = [d.withColumn("variant", F.lit("")) for d in (cells, model_levels)]
        factors, freq_family = {"": list(factors)}, {"": freq_family}
    factors = {name: list(fs) for name, fs in factors.items()}
    every = list(dict.fromkeys(f for fs in factors.values() for f in fs))
    keys = ["variant", "coverage", "model_id", "part"]
    # fresh column ids on both sides: the levels are derived from the cells
    lv = model_levels.select(*[F.col(c).alias(c) for c in [*keys, "factor", "level"]])
    left = cells.select(*[F.col(c).alias(c) for c in keys + every + ["n", "sy"]])
    # The cell tables are tiny, so AQE would coalesce them into one partition
    # and run every fit in one Python worker; an explicit partition count
    # (not coalesced) spreads the models over the cluster's cores.
    spark = cells.sparkSession
    try:
        parts = max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # Spark Connect
        parts = int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    left = left.repartition(parts, *keys)
    lv = lv.repartition(parts, *keys)

    def fn(key, l_pdf, r_pdf):
        out = _fit_group(key, l_pdf, r_pdf, factors[key[0]], freq_family[key[0]], min_claims, min_pos)
        out.insert(0, "variant", key[0])
        return out

    fits = left.groupBy(*keys).cogroup(lv.groupBy(*keys)).applyInPandas(fn, schema=COEF_SCHEMA)
    return fits if joint else fits.drop("variant")


def check_fits(coefs: DataFrame) -> None:
    """Raise if a model that has data ran out of steps: its prices would be unfinished."""
    bad = (coefs.filter((F.col("factor") == INTERCEPT) & ~F.col("converged") & ~F.isnan("beta"))
           .select(*[c for c in ("variant", "coverage", "model_id", "part") if c in coefs.columns]).limit(20).collect())
    if bad:
        raise ValueError(f"fits that did not converge: {[tuple(b) for b in bad]}")
