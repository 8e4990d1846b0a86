import numpy as np
import pandas as pd
import pytest

from ratewise.operators.glm import _fit_group, kept_columns, newton_fit


def make_rows(seed=0, n=4000):
    rng = np.random.default_rng(seed)
    a = rng.choice(["A", "B", "C"], n)
    b = rng.choice(["N", "Y"], n)
    c = rng.choice(["0", "0-1", "1-3", "3+"], n)
    eta = -0.5 + (a == "B") * 0.3 - (a == "C") * 0.4 + (b == "Y") * 0.5 + (c == "3+") * 0.2
    return pd.DataFrame({"a": a, "b": b, "c": c, "eta": eta, "rng": rng.random(n)}), rng


def cells_of(df, y):
    g = df.assign(y=y).groupby(["a", "b", "c"]).agg(n=("y", "size"), sy=("y", "sum")).reset_index()
    return g


def levels_of(df, cols):
    return pd.DataFrame([(f, lv) for f in cols for lv in sorted(df[f].unique())], columns=["factor", "level"])


def fitted(coefs, cells, family):
    b0 = coefs.loc[coefs.factor == "(Intercept)", "beta"].iloc[0]
    eta = np.full(len(cells), b0)
    for f in ["a", "b", "c"]:
        m = coefs[coefs.factor == f].set_index("level")["beta"]
        eta = eta + cells[f].map(m).to_numpy()
    return 1 / (1 + np.exp(-eta)) if family == "binomial" else np.exp(eta)


@pytest.mark.parametrize("family", ["poisson", "binomial", "gamma"])
def test_score_equations_hold(family):  # SCORE oracle rule, per level
    df, rng = make_rows()
    mu = np.exp(df.eta)
    if family == "poisson":
        y = rng.poisson(mu)
    elif family == "binomial":
        y = (rng.random(len(df)) < 1 / (1 + np.exp(-df.eta))).astype(float)
    else:
        y = rng.gamma(2.0, mu * 100 / 2.0)
    cells = cells_of(df, y)
    part = "sev" if family == "gamma" else "freq"
    coefs = _fit_group(("cov", 0, part), cells, levels_of(df, ["a", "b", "c"]), ["a", "b", "c"],
                       "binomial" if family == "binomial" else "poisson")
    assert coefs.converged.all()
    m = fitted(coefs, cells, family)
    for f in ["a", "b", "c"]:
        for lv, grp in cells.assign(m=m).groupby(f):
            if family == "gamma":
                assert abs((grp.sy / grp.m).sum() - grp.n.sum()) < 1e-7 * grp.n.sum()
            else:
                assert abs((grp.n * grp.m).sum() - grp.sy.sum()) < 1e-7 * max(1, grp.sy.sum())


@pytest.mark.parametrize("family,link", [("poisson", "log"), ("gamma", "log"), ("binomial", "logit")])
def test_matches_row_level_glm_of_spark_ml(spark, family, link):  # second implementation
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    df, rng = make_rows(1, 3000)
    if family == "poisson":
        y = rng.poisson(np.exp(df.eta)).astype(float)
    elif family == "gamma":
        y = rng.gamma(2.0, np.exp(df.eta) * 100 / 2.0)
    else:
        y = (rng.random(len(df)) < 1 / (1 + np.exp(-df.eta))).astype(float)
    sdf = spark.createDataFrame(df[["a", "b", "c"]].assign(y=y))
    idx = [StringIndexer(inputCol=f, outputCol=f + "_i", stringOrderType="alphabetAsc") for f in "abc"]
    for s in idx:
        sdf = s.fit(sdf).transform(sdf)
    sdf = OneHotEncoder(inputCols=[f + "_i" for f in "abc"], outputCols=[f + "_v" for f in "abc"],
                        dropLast=False).fit(sdf).transform(sdf)
    # drop the first level of each factor (R's treatment contrasts)
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F
    cols = []
    for f in "abc":
        k = len(df[f].unique())
        arr = vector_to_array(F.col(f + "_v"))
        cols += [arr[i].alias(f"{f}{i}") for i in range(1, k)]
    flat = sdf.select("a", "b", "c", "y", *cols)
    feats = [c for c in flat.columns if c not in ("a", "b", "c", "y")]
    flat = VectorAssembler(inputCols=feats, outputCol="features").transform(flat)
    glr = GeneralizedLinearRegression(family=family, link=link, labelCol="y", tol=1e-12, maxIter=100)
    pred = glr.fit(flat).transform(flat).select("a", "b", "c", "prediction").distinct().toPandas()
    cells = cells_of(df, y)
    part = "sev" if family == "gamma" else "freq"
    coefs = _fit_group(("cov", 0, part), cells, levels_of(df, ["a", "b", "c"]), ["a", "b", "c"],
                       "binomial" if family == "binomial" else "poisson")
    ours = cells.assign(m=fitted(coefs, cells, family)).merge(pred, on=["a", "b", "c"])
    assert np.max(np.abs(ours.m / ours.prediction - 1)) < 1e-8


def test_one_factor_fit_is_group_mean():
    df, rng = make_rows(2, 2000)
    y = rng.gamma(2.0, 50.0, len(df))
    cells = cells_of(df, y)
    coefs = _fit_group(("cov", 0, "sev"), cells, levels_of(df, ["a"]), ["a"], "poisson")
    b0 = coefs.beta.iloc[0]
    for lv, grp in df.assign(y=y).groupby("a"):
        b = coefs[(coefs.factor == "a") & (coefs.level == lv)].beta.iloc[0]
        assert abs(np.exp(b0 + b) / grp.y.mean() - 1) < 1e-12


def test_level_without_claims_converges():  # separation
    cells = pd.DataFrame({"a": ["A", "B", "C"], "n": [40.0, 50.0, 60.0], "sy": [0.0, 10.0, 20.0]})
    lv = pd.DataFrame({"factor": ["a"] * 3, "level": ["A", "B", "C"]})
    for fam in ("poisson", "binomial"):
        coefs = _fit_group(("c", 0, "freq"), cells, lv, ["a"], fam)
        assert coefs.converged.all()
        b0 = coefs.beta.iloc[0]
        assert b0 < -15  # base level A has no claims: frequency near 0


def test_single_level_factor_and_duplicate_factor():  # T12, T13
    rng = np.random.default_rng(5)
    a = rng.choice(["A", "B"], 500)
    df = pd.DataFrame({"a": a, "b": np.where(a == "A", "N", "Y"), "c": "N"})
    y = rng.poisson(np.where(a == "A", 0.5, 1.5))
    cells = df.assign(y=y).groupby(["a", "b", "c"]).agg(n=("y", "size"), sy=("y", "sum")).reset_index()
    lv = levels_of(df, ["a", "b", "c"])
    coefs = _fit_group(("c", 0, "freq"), cells, lv, ["a", "b", "c"], "poisson")
    assert coefs["rank"].iloc[0] == 2  # intercept + a; b duplicates a, c has one level
    assert coefs.converged.all()
    bb = coefs[(coefs.factor == "b")].beta.tolist()
    assert bb == [0.0, 0.0]


def test_kept_columns_zero_and_dependent():
    X = np.array([[1, 0, 1, 0], [1, 1, 0, 0], [1, 0, 1, 0.0]])
    assert kept_columns(X) == [0, 1]


def test_newton_gamma_hard_case_converges():
    rng = np.random.default_rng(9)
    X = np.column_stack([np.ones(30), rng.integers(0, 2, 30), rng.integers(0, 2, 30)]).astype(float)
    n = rng.integers(1, 3, 30).astype(float)
    sy = n * rng.lognormal(7, 2, 30)
    beta, it, conv = newton_fit("gamma", X, n, sy)
    assert conv and it < 60
