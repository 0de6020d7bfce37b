"""Logit and Gamma fits of all segments at once, centred OLS and residual statistics, against numpy."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import glm as G
from cohortlens.operators import models as R


def irls(x, y, family):
    """One fit in numpy: coefficients and standard errors."""
    b = np.zeros(x.shape[1])
    b[0] = np.log(y.mean() / (1 - y.mean())) if family == "logit" else np.log(y.mean())
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ b)) if family == "logit" else np.exp(x @ b)
        w, away = (mu * (1 - mu), y - mu) if family == "logit" else (np.ones_like(mu), y / mu - 1)
        inverse = np.linalg.inv((x * w[:, None]).T @ x)
        b = b + inverse @ x.T @ away
    scale = 1.0 if family == "logit" else ((y / np.exp(x @ b) - 1) ** 2).sum() / (len(y) - len(b))
    return b, np.sqrt(np.diag(inverse) * scale)


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(8)
    rows = []
    for s, n in (("a", 2000), ("b", 150), ("c", 60)):
        x = rng.normal(size=(n, 2)) * [1, 3] + [0, 1000]
        eta = 0.3 + 0.8 * x[:, 0] - 0.2 * (x[:, 1] - 1000) * (s != "b")
        y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
        g = rng.gamma(2.0, np.exp(0.2 * eta) / 2)
        rows += [(s, float(u), float(v), float(t), float(w)) for (u, v), t, w in zip(x, y, g)]
    return rows


SCHEMA = "s string, u double, v double, y double, g double"


@pytest.mark.parametrize("family,target", [("logit", "y"), ("gamma", "g")])
def test_segments_equal_single_fits(spark, panel, family, target, monkeypatch):
    df = spark.createDataFrame(panel, SCHEMA)
    odd = [("a", None, 1.0, 1.0, 1.0), ("b", float("nan"), 1.0, 0.0, 1.0), ("c", 1.0, 1.0, None, None)]  # take no part
    steps = []
    step = G._step
    monkeypatch.setattr(G, "_step", lambda *a: steps.append(1) or step(*a))
    models = {"one": ["u"], "both": ["u", "v"]}
    coefs, stats = G.fit_glms(df.unionByName(spark.createDataFrame(odd, SCHEMA)), target, models, family, by="s")
    got = {(r["segment"], r["model"], r["term"]): r for r in coefs.collect()}
    assert len(got) == 3 * 5 and len(steps) < 25  # steps of the slowest fit, not of all six one after the other
    for s in "abc":
        part = np.array([[u, v, y if target == "y" else g] for t, u, v, y, g in panel if t == s])
        for m, cols in models.items():
            x = np.column_stack([np.ones(len(part)), part[:, :len(cols)]])
            b, se = irls(x, part[:, 2], family)
            for term, want, e in zip(["const", *cols], b, se):
                r = got[s, m, term]
                assert math.isclose(r["estimate"], want, rel_tol=1e-7) and math.isclose(r["se"], e, rel_tol=1e-6)
                assert math.isclose(r["p"], math.erfc(abs(want / e) / math.sqrt(2)), rel_tol=1e-4, abs_tol=1e-12)
                assert r["n"] == len(part) and r["error"] is None
    if family == "logit":
        like = {(r["segment"], r["model"]): r for r in stats.collect()}["a", "both"]
        part = np.array([[u, v, y] for t, u, v, y, g in panel if t == "a"])
        b, _ = irls(np.column_stack([np.ones(len(part)), part[:, :2]]), part[:, 2], "logit")
        mu = 1 / (1 + np.exp(-(b[0] + part[:, :2] @ b[1:])))
        ll = float(np.log(np.where(part[:, 2] == 1, mu, 1 - mu)).sum())
        assert math.isclose(like["loglik"], ll, rel_tol=1e-9) and like["llr_pvalue"] < 1e-9 and 0 < like["pseudo_r2"] < 1


def test_fits_that_cannot_be_made(spark):
    rows = [("few", 1.0, 0.0), ("same", 1.0, 1.0), ("same", 2.0, 1.0), ("same", 3.0, 1.0)]
    rows += [("flat", 5.0, float(i % 2)) for i in range(10)] + [("split", float(i), float(i > 4)) for i in range(10)]
    rows += [("range", float(i), 3.0) for i in range(5)] + [(None, float(i), float(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "s string, u double, y double")
    got = {r["segment"]: (r["term"], r["error"]) for r in G.fit_glms(df, "y", {"m": ["u"]}, by="s")[0].where("term is null or term = 'u'").collect()}
    assert got["few"][1] == "too few rows" and got["same"][1] == "target is constant" and got["range"][1].startswith("target outside")
    assert got["flat"][1] == "singular" and "convergence" in got["split"][1] and got[None] == ("u", None)
    assert G.fit_glms(df.limit(0), "y", {"m": ["u"]}, by="s")[0].count() == 0
    assert R.fit_segments(df.where("s is null or s = 'few'"), "s", "y", ["u"], {"m": ["u"]}).where("error is null").count() == 2


def test_gamma_entry_point(spark, panel):
    df = spark.createDataFrame(panel, SCHEMA).withColumn("id", F.monotonically_increasing_id())
    fit = R.fit_reg(df, "g", ["u"], reg_fn="gamma", key="id")
    b = {r["term"]: r["estimate"] for r in fit.coeffs.collect()}
    row = fit.predictions.join(df, "id").first()
    assert math.isclose(row["y_pred"], math.exp(b["const"] + b["u"] * row["u"]), rel_tol=1e-9)
    with pytest.raises(ValueError):
        R.fit_reg(df, "g", ["u"], reg_fn="poisson")


def test_ols_far_from_zero(spark):
    """Means of 1e6 cost no digits: equal to the fit of the same rows around 0."""
    rng = np.random.default_rng(9)
    x = rng.integers(-1000, 1000, (20_000, 2)) / 64.0
    y = 2 * x[:, 0] - x[:, 1] + rng.integers(-100, 100, 20_000) / 64.0
    rows = [(float(a) + 1e6, float(b) - 3e6, float(c) + 1e7) for (a, b), c in zip(x, y)]
    far, stats = R.ols(spark.createDataFrame(rows, "a double, b double, y double"), "y", ["a", "b"])
    near = R.ols(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), "y", ["a", "b"])
    want = {r["term"]: r for r in near[0].collect()}
    for r in far.collect():
        if r["term"] != "const":
            assert math.isclose(r["estimate"], want[r["term"]]["estimate"], rel_tol=1e-9) and math.isclose(r["se"], want[r["term"]]["se"], rel_tol=1e-9)
    a, b = stats.first(), near[1].first()
    assert math.isclose(a["r2"], b["r2"], rel_tol=1e-9) and math.isclose(a["aic"], b["aic"], rel_tol=1e-9)


def test_residual_statistics(spark):
    rng = np.random.default_rng(10)
    n = 3000
    x = rng.normal(size=(n, 2)) + [50, 0]
    e = np.zeros(n)
    for i in range(1, n):
        e[i] = 0.4 * e[i - 1] + rng.exponential()
    y = 1 + x @ [0.5, -2] + e
    df = spark.createDataFrame([(i, float(a), float(b), float(c), 0) for i, ((a, b), c) in enumerate(zip(x, y))] + [(n, None, 1.0, 1.0, 0)],
                               "i long, a double, b double, y double, part int").repartition(9)
    got = {r["model"]: r for r in R.residual_statistics(df, "y", ["a", "b"], ["i"], models={"one": ["a"], "both": ["a", "b"]}).collect()}
    for m, k in (("one", 1), ("both", 2)):
        d = np.column_stack([np.ones(n), x[:, :k]])
        r = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        c = r - r.mean()
        skew, kurtosis = (c ** 3).mean() / (c ** 2).mean() ** 1.5, (c ** 4).mean() / (c ** 2).mean() ** 2
        assert math.isclose(got[m]["durbin_watson"], (np.diff(r) ** 2).sum() / (r ** 2).sum(), rel_tol=1e-9)
        assert math.isclose(got[m]["skew"], skew, rel_tol=1e-9) and math.isclose(got[m]["kurtosis"], kurtosis, rel_tol=1e-9)
        assert math.isclose(got[m]["jarque_bera"], n / 6 * (skew ** 2 + (kurtosis - 3) ** 2 / 4), rel_tol=1e-9)
        assert math.isclose(got[m]["condition_number"], np.linalg.cond(d), rel_tol=1e-6) and got[m]["n"] == n
        assert got[m]["omnibus"] > 10 and got[m]["omnibus_p"] < 1e-3
    empty = df.limit(0)
    assert R.residual_statistics(empty, "y", ["a"], ["i"]).count() == 0
    bare = R.residual_statistics(df, "y", ["a"], ["i"], intercept=False).first()
    kept = y - x[:, 0] * (x[:, 0] @ y) / (x[:, 0] @ x[:, 0])
    assert math.isclose(bare["durbin_watson"], (np.diff(kept) ** 2).sum() / (kept ** 2).sum(), rel_tol=1e-9)


def test_omnibus_of_known_values():
    """Normal scores of the published example of skew 0.5 and kurtosis 3.8 at n = 100 grow with either."""
    base = R._omnibus(100, 0.0, 3.0)
    assert base < 0.2 and R._omnibus(100, 0.5, 3.0) > 4 and R._omnibus(100, -0.5, 3.0) == pytest.approx(R._omnibus(100, 0.5, 3.0))
    assert R._omnibus(100, 0.0, 5.0) > R._omnibus(100, 0.0, 4.0) > base
