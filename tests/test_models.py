import math

import numpy as np
from pyspark.sql import functions as F

from cohortlens.operators import mixed as MX
from cohortlens.operators import models as R


def _data(spark, n=200, seed=1):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.uniform(size=n)
    y = 1.5 + 2.0 * x1 - 3.0 * x2 + rng.normal(scale=0.5, size=n)
    seg = np.where(rng.uniform(size=n) < 0.5, "a", "b")
    rows = [(float(a), float(b), float(c), str(s)) for a, b, c, s in zip(x1, x2, y, seg)]
    return spark.createDataFrame(rows, "x1 double, x2 double, y double, seg string"), x1, x2, y, seg


def test_ols_matches_numpy(spark):
    df, x1, x2, y, _ = _data(spark)
    coefs, stats = R.ols(df, "y", ["x1", "x2"])
    X = np.column_stack([np.ones_like(x1), x1, x2])
    beta, rss, *_ = np.linalg.lstsq(X, y, rcond=None)
    s2 = float(rss[0]) / (len(y) - 3)
    se = np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X)))
    got = {r.term: r for r in coefs.collect()}
    for t, b, s in zip(["const", "x1", "x2"], beta, se):
        assert math.isclose(got[t].estimate, b, rel_tol=1e-8) and math.isclose(got[t].se, s, rel_tol=1e-8)
    st = stats.first()
    r2 = 1 - float(rss[0]) / float(((y - y.mean()) ** 2).sum())
    assert math.isclose(st.r2, r2, rel_tol=1e-8)


def test_ols_segments_ladder_and_singular(spark):
    df, x1, x2, y, seg = _data(spark)
    coefs, _ = R.ols(df, "y", ["x1", "x2"], by="seg", models={"m1": ["x1"], "m2": ["x1", "x2"]})
    rows = coefs.collect()
    assert {(r.segment, r.model) for r in rows} == {("a", "m1"), ("a", "m2"), ("b", "m1"), ("b", "m2")}
    m = seg == "a"
    X = np.column_stack([np.ones(m.sum()), x1[m]])
    b = np.linalg.lstsq(X, y[m], rcond=None)[0]
    got = [r for r in rows if r.segment == "a" and r.model == "m1" and r.term == "x1"][0]
    assert math.isclose(got.estimate, b[1], rel_tol=1e-8)
    dup = df.withColumn("x3", F.col("x1") * 2)
    c2, _ = R.ols(dup, "y", ["x1", "x3"])
    assert c2.filter(F.col("error").isNotNull()).count() == 1


def test_glm_logit_runs(spark):
    df, x1, x2, y, _ = _data(spark, n=400)
    d = df.withColumn("hi", (F.col("y") > 1.0).cast("double"))
    coefs, stats = R.glm(d, "hi", ["x1", "x2"], "binomial", "logit", odds_ratio=True)
    r = {x.term: x for x in coefs.collect()}
    assert r["x1"].estimate > 0 and math.isclose(r["x1"].odds_ratio, math.exp(r["x1"].estimate))
    assert stats.first().n == 400


def test_formula_design_no_reference_level_in_interactions(spark):
    df = spark.createDataFrame([(1.0, "a", 2.0), (2.0, "b", 3.0), (3.0, "c", 1.0)], "t double, c string, y double")
    d, cols = R.formula_design(df, "y", ["c"], "t")
    assert cols == ["t", "c_b", "c_c", "t:c_b", "t:c_c"]


def _panel(spark, seed=5, groups=25):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        b0, b1 = rng.normal(scale=1.0), rng.normal(scale=0.3)
        for k in range(rng.integers(2, 7)):
            t = float(k)
            x = float(rng.normal())
            y = 2 + b0 + (0.5 + b1) * t + 0.8 * x + float(rng.normal(scale=0.4))
            rows.append((g, t, x, y))
    return rows


def test_reml_objective_equals_dense(spark):
    rows = _panel(spark)
    df = spark.createDataFrame(rows, "g long, t double, x double, y double")
    stats = MX.subject_stats(df, "g", "y", ["t", "x"])
    reml = MX._Reml(stats, 4, 3, [0, 1], "unstructured")
    arr = np.array(rows)
    X = np.column_stack([np.ones(len(arr)), arr[:, 1], arr[:, 2]])
    Z = X[:, :2]
    for th in (np.array([0.1, 0.2, -1.0]), np.array([-0.5, -0.3, -2.0])):
        L = MX._L(th, 2, "unstructured")
        got = reml.evaluate([th])[0][0]
        want = MX.dense_neg2_reml(arr[:, 3], X, Z, arr[:, 0], L)
        assert math.isclose(got, want, rel_tol=1e-9)


def test_fit_mixed_recovers_fixed_effects(spark):
    rows = _panel(spark, groups=60)
    df = spark.createDataFrame(rows, "g long, t double, x double, y double")
    fit = MX.fit_mixed(df, "g", "y", ["x"], "t")
    r = {x.term: x for x in fit.coefs.collect()}
    assert abs(r["x"].estimate - 0.8) < 0.15 and abs(r["t"].estimate - 0.5) < 0.2
    st = fit.stats.first()
    assert st.n_groups == 60 and st.converged
    # the optimum: no neighbour of the fitted theta has a lower objective
    dd, cols = R.formula_design(df, "y", ["x"], "t")
    stats = MX.subject_stats(dd, "g", "y", cols)
    reml = MX._Reml(stats, len(cols) + 2, len(cols) + 1, [0, 1], "unstructured")
    th = np.array(fit.theta)
    f0 = reml.evaluate([th])[0][0]
    pts = [th + d for d in (np.eye(3) * 0.05).tolist() + (-np.eye(3) * 0.05).tolist()]
    assert all(v[0] >= f0 - 1e-6 for v in reml.evaluate(pts))
    d = MX.fit_mixed(df, "g", "y", ["x"], "t", structure="diagonal")
    assert "Group x t Cov" not in {x.term for x in d.coefs.collect()}


def test_fit_segments_ols_and_logit(spark):
    df, x1, x2, y, seg = _data(spark, n=300)
    d = df.withColumn("fa", (F.col("seg") == "a").cast("int")).withColumn("fb", F.lit(1))
    s = R.flag_segments(d, ["fa", "fb"])
    assert s.filter(F.col("segment") == "fb").count() == 300
    out = R.fit_segments(s, "segment", "y", ["x1", "x2"], {"m1": ["x1"], "m2": ["x1", "x2"]})
    assert {(r.segment, r.model) for r in out.collect()} == {("fa", "m1"), ("fa", "m2"), ("fb", "m1"), ("fb", "m2")}
    lg = s.withColumn("hi", (F.col("y") > 1.0).cast("double"))
    out2 = R.fit_segments(lg, "segment", "hi", ["x1"], {"m1": ["x1"]}).collect()
    assert {r.segment for r in out2} == {"fa", "fb"} and all(r.error is None for r in out2)


def test_fit_mixed_segments_reports_failures(spark):
    rows = _panel(spark, groups=30)
    df = spark.createDataFrame([(g, t, x, y, "s1" if g % 2 else "s2") for g, t, x, y in rows] +
                               [(999, 0.0, 0.0, 1.0, "tiny")], "g long, t double, x double, y double, seg string")
    out = MX.fit_mixed_segments(df, "seg", "g", "y", ["x"], "t")
    res = out.collect()
    assert {r.segment for r in res if r.error is None} == {"s1", "s2"}
    assert any(r.segment == "tiny" and r.error for r in res)


def test_fit_reg_entry_point(spark):
    df, x1, x2, y, seg = _data(spark, n=300)
    d = df.withColumn("k", F.monotonically_increasing_id())
    res = R.fit_reg(d, "y", ["x1", "seg"], dummyfy_non_num=True, test_size=0.2, key="k")
    terms = {r.term for r in res.coeffs.collect()}
    assert terms == {"const", "x1", "seg_b"}
    assert res.predictions.count() < 300 and res.report.filter(F.col("class") == "accuracy").count() == 1
    lg = R.fit_reg(d.withColumn("hi", (F.col("y") > 1).cast("double")), "hi", ["x1"], reg_fn="logit")
    p = lg.predictions.agg(F.min("y_pred"), F.max("y_pred")).first()
    assert 0 <= p[0] <= p[1] <= 1


def test_longitudinal_panel_object(spark):
    from cohortlens.operators.panel import LongitudinalPanel
    import datetime as dt
    rows = [(1, dt.datetime(2020, 1, d), 50.0 + d, float(d), "a" if d % 2 else "b", d) for d in range(1, 8)]
    df = spark.createDataFrame(rows, "sid long, ts timestamp, age double, score double, cat string, id long")
    lp = LongitudinalPanel(df, group="sid", timestamp="ts", target="score", covariates=["cat", "age"],
                           to_bucket="age", bucket_min=50, bucket_max=60, interval=2.0, tiebreak=["id"])
    assert set(lp.load_data().columns) == {"cat", "sid", "score", "ts", "age", "id"}
    assert lp.bucket_data().count() == 4
    lp.normalize(["score"])
    assert lp.data.agg(F.max("score")).first()[0] == 1.0
    assert "cat_a" in lp.dummyfy(["cat"]).columns


def test_mixed_statistics_and_a_fit_that_cannot_start(spark):
    from cohortlens.operators.mixed import fit_mixed
    rows = [(g, float(t), 1.0 + 0.5 * t + 0.1 * ((7 * g + 3 * t) % 5)) for g in range(6) for t in range(4)] + [(0, None, 1.0), (1, 2.0, None)]
    df = spark.createDataFrame(rows, "g int, t double, y double")
    st = fit_mixed(df, "g", "y", None, "t", random_slope=False).stats.first()
    assert (st.n_obs, st.dropped, st.n_groups, st.group_min, st.group_mean, st.group_max) == (24, 2, 6, 4, 4.0, 4)
    same = spark.createDataFrame([(g, 1.0, 2.0) for g in range(3) for _ in range(3)], "g int, t double, y double")
    fit = fit_mixed(same, "g", "y", None, "t", random_slope=False)
    assert not fit.stats.first().converged and all(r.estimate is None for r in fit.coefs.collect())


def test_mixed_segments_equal_single_fits(spark, monkeypatch):
    """All segments in the jobs of the slowest; a level or a reference that a segment lacks is left out."""
    rng = np.random.default_rng(11)
    rows = []
    for s, n, kinds in (("s1", 30, "abc"), ("s2", 20, "ab"), (None, 15, "bc")):
        for g in range(n):
            b0, b1 = rng.normal(), rng.normal(scale=0.3)
            for t in range(int(rng.integers(3, 7))):
                c = kinds[int(rng.integers(len(kinds)))]
                rows.append((g, float(t), c, 1 + b0 + (0.5 + b1) * t + (c == "b") + float(rng.normal(scale=0.4)), s))
    schema = "g long, t double, c string, y double, s string"
    df = spark.createDataFrame(rows, schema)
    jobs = []
    run = MX._Remls.evaluate
    monkeypatch.setattr(MX._Remls, "evaluate", lambda self, asked: jobs.append(len(asked)) or run(self, asked))
    got = {(r["segment"], r["term"]): r for r in MX.fit_mixed_segments(df, "s", "g", "y", ["c"], "t").collect()}
    together, jobs[:] = list(jobs), []
    alone = 0
    for s in ("s1", "s2", None):
        fit = MX.fit_mixed(df.where(F.col("s").eqNullSafe(F.lit(s))), "g", "y", ["c"], "t")
        want = {r["term"]: r for r in fit.coefs.collect()}
        assert {t for q, t in got if q == s} == set(want)
        for term, r in want.items():
            assert math.isclose(got[s, term]["estimate"], r["estimate"], rel_tol=1e-4, abs_tol=1e-4)
            assert r["se"] is None or math.isclose(got[s, term]["se"], r["se"], rel_tol=1e-3)
        alone = max(alone, len(jobs))
        jobs[:] = []
    assert together[0] == 3 and len(together) <= alone + 5
    assert MX.fit_mixed_segments(df.limit(0), "s", "g", "y", ["c"], "t").count() == 0
