"""An independent pandas/numpy restatement of the pricing method, for tests.

Row-level data, Fisher scoring (IRLS) with a least-squares solve per step,
numpy's linear quantile, plain pandas group-bys: none of the Spark code is
used, so agreement checks the cell construction, the fold-model membership,
the scoring joins and the pricing chain of the multi-factor runs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from ratewise import config as C


NA = "\x00NA"


def rollup(claims: pd.DataFrame) -> pd.DataFrame:
    c = claims.sort_values("row_id", kind="stable").copy()
    c["coverage"] = c.coverage.where(c.coverage.notna(), NA)
    keys = ["student_id", "coverage"]
    first = c.drop_duplicates(keys, keep="first").set_index(keys)
    attrs = ["risk_tier", "gpa", "greek", "off_campus", "distance_to_campus", "sprinklered", "gender",
             "holdout"]
    g = c.groupby(keys, dropna=False)
    out = first[attrs].copy()
    out["total_paid"] = g["amount"].sum(min_count=0).reindex(out.index).fillna(0.0)
    out["claim_n"] = g["amount"].apply(lambda s: int((s > 0).sum())).reindex(out.index)
    out = out.reset_index()
    out["coverage"] = out.coverage.where(out.coverage != NA, None)
    out["avg_paid"] = np.where(out.claim_n > 0, out.total_paid / out.claim_n.where(out.claim_n > 0, 1), 0.0)
    return out


def prepare(df: pd.DataFrame, v: C.Variant) -> pd.DataFrame:
    df = df.copy()
    for col in v.clean_cols:
        df[col] = df[col].where(df[col].notna(), "Unknown").astype(object)
    d = df.distance_to_campus
    df["dist_band"] = np.select([d.isna(), d == 0, d <= 1, d <= 3], ["Unknown", "0", "0-1", "1-3"], "3+")
    if v.with_gpa:
        gp = df.gpa
        df["gpa_band"] = np.select([gp.isna(), gp < 2.0, gp < 3.0], ["Unknown", "<2.0", "2.0-2.99"], "3.0+")
    return df


def folds_of(train: pd.DataFrame, k: int, seed: int) -> pd.Series:
    h = train.student_id.map(lambda s: hashlib.md5(f"{s}|{seed}".encode()).hexdigest())
    order = train.assign(_h=h).sort_values(["coverage", "_h", "student_id"])
    rank = order.groupby("coverage").cumcount()
    return (rank % k + 1).reindex(train.index)


def irls(family, X, y, max_iter=200):
    n, p = X.shape
    ybar = y.mean()
    if family == "binomial":
        mu = np.full(n, (y.sum() + 0.5) / (n + 1.0))
    else:
        mu = np.full(n, ybar if ybar > 0 else 1e-8)
    beta = np.zeros(p)
    for _ in range(max_iter):
        if family == "binomial":
            mu = np.clip(mu, 1e-13, 1 - 1e-13)  # separation: the MLE is at infinity
            eta = np.log(mu / (1 - mu))
            w = mu * (1 - mu)
            z = eta + (y - mu) / w
        elif family == "poisson":
            eta = np.log(mu)
            w = mu
            z = eta + (y - mu) / mu
        else:
            eta = np.log(mu)
            w = np.ones(n)
            z = eta + (y - mu) / mu
        sw = np.sqrt(w)
        new = np.linalg.lstsq(X * sw[:, None], z * sw, rcond=None)[0]
        eta = np.clip(X @ new, -60, 60)
        mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
        if np.max(np.abs(new - beta)) < 1e-13:
            beta = new
            break
        beta = new
    return beta


def design(df, factors, levels):
    cols = [np.ones(len(df))]
    names = [("(Intercept)", None)]
    for f in factors:
        for lv in levels[f][1:]:
            cols.append((df[f].to_numpy() == lv).astype(float))
            names.append((f, lv))
    return np.column_stack(cols), names


def fit_part(family, rows, y, factors, levels, thin):
    use = [] if thin else list(factors)
    X, names = design(rows, use, levels)
    if len(rows) == 0:
        return None
    return dict(zip(names, irls(family, X, y))), use, levels


def predict(model, rows, family):
    if model is None:
        return np.full(len(rows), np.nan)
    coef, use, levels = model
    eta = np.full(len(rows), coef[("(Intercept)", None)])
    ok = np.ones(len(rows), dtype=bool)
    for f in use:
        vals = rows[f].to_numpy()
        ok &= np.isin(vals, levels[f])
        eta = eta + np.array([coef.get((f, x), 0.0) for x in vals])
    mu = 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)
    return np.where(ok, mu, np.nan)


def by_cov(cov, gm, liab, other):
    return gm if cov == C.GUEST_MEDICAL else liab if cov == C.LIABILITY else other


def price(claims: pd.DataFrame, v: C.Variant) -> dict:
    expo = rollup(claims)
    expo["has_claim"] = expo.total_paid > 0
    train = prepare(expo[expo.holdout == False], v).reset_index(drop=True)  # noqa: E712
    test = prepare(expo[expo.holdout == True], v).reset_index(drop=True)  # noqa: E712
    for col in v.align_cols:
        test[col] = test[col].where(test[col].isin(set(train[col])), None)
    train["fold"] = folds_of(train, v.k_folds, v.fold_seed)
    y_col = v.sev_response
    pos_col = v.pos_column
    yf_col = v.freq_response
    fam = v.freq_family
    models = {}
    for cov in sorted(train.coverage.unique()):
        for m in range(0, v.k_folds + 1):
            d = train[(train.coverage == cov) & (train.fold != m)]
            pos = d[d[pos_col] > 0]
            capped = len(pos) >= C.MIN_POS_FOR_CAP
            cap = float(np.quantile(pos[y_col], by_cov(cov, .85, .97, .95))) if capped else np.inf
            ycap = np.where(d[pos_col] > 0, np.minimum(d[y_col], cap), 0.0)
            if capped:
                full = pos[y_col].mean() / np.minimum(pos[y_col], cap).mean()
            else:
                full = 1.0
            uncap = full ** by_cov(cov, 0.0, 0.95, 0.20)
            levels = {f: sorted(d[f].unique()) for f in v.factors}
            yf = d[yf_col].astype(float).to_numpy()
            fm = fit_part(fam, d, yf, v.factors, levels, yf.sum() < 20)
            p2 = d[ycap > 0]
            seen = {f: sorted(p2[f].unique()) for f in v.factors}
            sm = fit_part("gamma", p2, ycap[ycap > 0], v.factors, seen, len(p2) < 30)
            models[(cov, m)] = (fm, sm, uncap)

    def score(rows, mids):
        out = np.full(len(rows), np.nan)
        for (cov, m), (fm, sm, uncap) in models.items():
            sel = ((rows.coverage == cov) & (mids == m)).to_numpy()
            if sel.any():
                r = rows[sel]
                out[sel] = predict(fm, r, fam) * predict(sm, r, "gamma") * uncap
        return out

    train["oof"] = score(train, train.fold)
    cal = train.groupby("coverage").apply(
        lambda g: pd.Series({"n_claim": (g.total_paid > 0).sum(), "y": g.total_paid.sum(),
                             "p": g.oof.sum()}), include_groups=False)
    raw = cal.y / np.maximum(cal.p, 1e-9)
    w = cal.n_claim / (cal.n_claim + C.CAL_CLAIM_K)
    cal["cal_factor"] = np.clip(1 + (raw - 1) * w, C.CAL_CAP_LOW, C.CAL_CAP_HIGH)
    for df in (train, test):
        df["pred_loss"] = score(df, pd.Series(0, index=df.index))
        df["pred_loss_cal"] = df.pred_loss * df.coverage.map(cal.cal_factor)
    caps = {}
    for cov, g in train.groupby("coverage"):
        q = float(np.quantile(g.pred_loss_cal.dropna(), by_cov(cov, .92, .995, .97)))
        caps[cov] = np.inf if (v.min_n_mode == "honoured" and len(g) < C.MIN_N_FOR_PRED_CAP) else q
    for df in (train, test):
        df["pred_loss_cap"] = np.minimum(df.pred_loss_cal, df.coverage.map(caps))
    tm = train.groupby(["coverage", "risk_tier"]).pred_loss_cap.mean().rename("tm")
    for df in (train, test):
        j = df.join(tm, on=["coverage", "risk_tier"])
        df["pred_loss_final"] = np.where(j.coverage == C.LIABILITY, 0.4 * j.tm + 0.6 * j.pred_loss_cap,
                                         j.pred_loss_cap)
    def strict(s):
        return s.mean() if s.notna().all() else np.nan

    hold = test.groupby("coverage", dropna=False).agg(actual=("total_paid", strict),
                                                      pred_c=("pred_loss_final", strict))
    hold["ratio"] = hold.pred_c / hold.actual
    tb = train.groupby(["coverage", "risk_tier"]).pred_loss_final.agg(["size", strict])
    tb.columns = ["size", "mean"]
    cm = train.groupby("coverage").pred_loss_final.agg(strict)
    wt = tb["size"] / (tb["size"] + C.CRED_K)
    base = wt * tb["mean"] + (1 - wt) * cm.reindex(tb.index.get_level_values(0)).to_numpy()
    renew = (base + 25) / (1 - 0.30 - 0.05)
    new = (base + 35) / (1 - 0.35 - 0.05)
    j = train.join(tb["mean"].rename("tavg"), on=["coverage", "risk_tier"])
    rel = np.clip((j.pred_loss_final / j.tavg) ** 0.35, 0.7, 1.5)
    idx = pd.MultiIndex.from_frame(j[["coverage", "risk_tier"]])
    j["renew"] = renew.reindex(idx).to_numpy() * rel
    j["new"] = new.reindex(idx).to_numpy() * rel
    totals = j.groupby(["student_id", "risk_tier"]).agg(total_renew=("renew", "sum"), total_new=("new", "sum"))
    return {"totals": totals.reset_index(), "holdout": hold.reset_index(), "cal": cal.reset_index()}
