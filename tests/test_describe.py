import math
import random

import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import distributions as Dist
from cohortlens.operators import describe as D


def test_distribution_constants():
    assert abs(Dist.t_sf2(2.228139, 10) - 0.05) < 1e-6
    assert abs(Dist.chi2_sf(3.841459, 1) - 0.05) < 1e-6
    assert abs(Dist.chi2_sf(5.991465, 2) - 0.05) < 1e-6
    assert abs(2 * Dist.norm_sf(1.959964) - 0.05) < 1e-6
    assert abs(Dist.t_ppf(0.975, 10) - 2.228139) < 1e-5
    assert abs(Dist.norm_ppf(0.975) - 1.959964) < 1e-5


def _two_groups(spark, seed=3):
    rng = random.Random(seed)
    rows = [("a", float(rng.randint(0, 20))) for _ in range(40)] + [("b", float(rng.randint(3, 25))) for _ in range(30)]
    rows += [("c", 1.0)] * 5 + [("a", None)]
    return spark.createDataFrame(rows, "g string, v double"), rows


def test_welch_matches_numpy(spark):
    df, rows = _two_groups(spark)
    a = np.array([v for g, v in rows if g == "a" and v is not None])
    b = np.array([v for g, v in rows if g == "b"])
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va ** 2 / (len(a) - 1) + vb ** 2 / (len(b) - 1))
    r = D.welch_t(df, "v", "g").first()
    assert r.group1 == "a" and r.group2 == "b"
    assert math.isclose(r.t, t, rel_tol=1e-9) and math.isclose(r.dof, dof, rel_tol=1e-9)
    assert math.isclose(r.p, Dist.t_sf2(abs(t), dof), rel_tol=1e-9)
    d = D.cohens_d(df, "v", "g").first().d
    assert math.isclose(d, (a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2), rel_tol=1e-9)


def test_u_matches_brute_force(spark):
    df, rows = _two_groups(spark)
    a = [v for g, v in rows if g == "a" and v is not None]
    b = [v for g, v in rows if g == "b"]
    u1 = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    r = D.u_test(df, "v", "g").first()
    assert r.u == u1 and r.n1 == len(a) and r.n2 == len(b)
    # tie-corrected normal approximation with continuity correction
    n1, n2 = len(a), len(b)
    allv = a + b
    ties = sum(c ** 3 - c for c in [allv.count(x) for x in set(allv)])
    n = n1 + n2
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / s
    assert math.isclose(r.p_u, 2 * Dist.norm_sf(z), rel_tol=1e-9)


def test_u_with_many_buckets_equals_brute_force(spark):
    from cohortlens.operators.ranks import running_sums
    df = spark.range(0, 500).select((F.col("id") % 37).cast("double").alias("v"), F.lit(1).alias("one"))
    per = df.groupBy("v").agg(F.sum("one").alias("c"))
    out = {r.v: r.c_cum for r in running_sums(per, "v", ["c"], n_buckets=7).collect()}
    counts = {float(k): sum(1 for i in range(500) if i % 37 == k) for k in range(37)}
    acc = 0
    for k in sorted(counts):
        acc += counts[k]
        assert out[k] == acc


def test_subgroup_tests(spark):
    rows = [("x", "a", 1.0), ("x", "a", 2.0), ("x", "b", 3.0), ("x", "b", 5.0), ("y", "a", 4.0), ("y", "b", 1.0),
            ("y", "a", 6.0), ("y", "b", 2.0)]
    df = spark.createDataFrame(rows, "s string, g string, v double")
    out = {r.subgroup: r for r in D.subgroup_tests(df, "v", "g", ["a", "b"], "s").collect()}
    assert set(out) == {"x", "y", "all"}
    assert out["x"].u == 0.0 and out["y"].u == 4.0


def test_chi_square_yates_2x2(spark):
    # distinct keys: level L1 -> a: 3 keys, b: 1 key; level L2 -> a: 1, b: 3
    rows = [(i, g, lv) for i, g, lv in [(1, "a", "L1"), (2, "a", "L1"), (3, "a", "L1"), (4, "a", "L2"),
                                         (5, "b", "L1"), (6, "b", "L2"), (7, "b", "L2"), (8, "b", "L2"),
                                         (9, "b", "unknown"), (1, "a", "L1")]]
    df = spark.createDataFrame(rows, "k int, g string, lv string")
    out = D.chi_square(df, "k", "g", ["a", "b"], ["lv"]).collect()
    obs = np.array([[3, 1], [1, 3]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    dev = np.abs(obs - e)
    chi = float((np.maximum(dev - 0.5, 0) ** 2 / e).sum())
    assert len(out) == 2 and out[0].dof == 1
    assert math.isclose(out[0].chi2, chi, rel_tol=1e-9)
    assert math.isclose(out[0].p, Dist.chi2_sf(chi, 1), rel_tol=1e-9)


def test_data_stats_margins(spark):
    rows = [(1, 1.0, "g1", "x"), (1, 2.0, "g1", "x"), (2, 4.0, "g2", "x"), (3, 7.0, "g2", "y")]
    df = spark.createDataFrame(rows, "k int, v double, g string, lv string")
    out = {(r.level, r.group): r for r in D.data_stats(df, "k", "v", "g", ["lv"]).collect()}
    corner = out[("All", "All")]
    assert corner.N == 3 and corner.obs == 4
    assert math.isclose(corner.SD, float(np.std([1, 2, 4, 7], ddof=1)))
    # pct: N / ((sum of level N + N_All) / 2) * 100 for group g2: levels x:1, y:1, All:2 -> 1 / 2 * 100
    assert math.isclose(out[("x", "g2")].pct, 50.0)


def test_pivots(spark):
    rows = [(1, "r1", "A"), (1, "r1", "A"), (2, "r1", "B"), (3, "r2", "A"), (None, "r2", "B")]
    df = spark.createDataFrame(rows, "k int, r string, s string")
    p = {r.r: r for r in D.distinct_pivot(df, "k", "r", "s", ["A", "B"]).collect()}
    assert (p["r1"].A, p["r1"].B, p["r2"].A, p["r2"].B) == (1, 1, 1, 0)
    m = {r.r: r for r in D.distinct_pivot_margins(df, "k", "r", "s", ["A", "B"]).collect()}
    assert m["All"].All == 3 and m["r1"].All == 2 and m["All"].A == 2


def test_pivots_of_another_aggregate(spark):
    rows = [(1, "r1", "A"), (2, "r1", "A"), (6, "r1", "B"), (3, "r2", "A"), (None, "r2", "B")]
    df = spark.createDataFrame(rows, "k int, r string, s string")
    p = {r.r: r for r in D.distinct_pivot(df, "k", "r", "s", ["A", "B"], F.mean, None).collect()}
    assert (p["r1"].A, p["r1"].B, p["r2"].A, p["r2"].B) == (1.5, 6.0, 3.0, None)
    m = {r.r: r for r in D.distinct_pivot_margins(df, "k", "r", "s", ["A", "B"], F.max, -1).collect()}
    assert (m["All"].All, m["All"].A, m["r1"].All, m["r2"].B) == (6, 3, 6, -1)


def test_top_groups_and_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",), (None,), (None,), (None,)], "g string")
    assert [(r.g, r.n, r.rank) for r in D.top_groups(df, "g").collect()] == [("b", 2, 1), ("c", 2, 2)]


def test_data_stats_wide(spark):
    rows = [(1, 1.0, "g1", "x"), (1, 2.0, "g1", "x"), (2, 4.0, "g2", "x"), (3, 7.0, "g2", "y")]
    df = spark.createDataFrame(rows, "k int, v double, g string, lv string")
    wide = D.data_stats_wide(D.data_stats(df, "k", "v", "g", ["lv"]), ["g1", "g2"])
    cols = wide.columns
    assert cols[:2] == ["variable", "level"] and cols[2:] == sorted(cols[2:])
    r = {x.level: x for x in wide.collect()}
    assert r["y"]["g1(1. N)"] == 0 and r["y"]["g1(3. M)"] is None and r["x"]["All(2. obs)"] == 3


def test_f_sf():
    assert abs(Dist.f_sf(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(Dist.f_sf(3.098391, 3, 20) - 0.05) < 1e-6


def test_degenerate_groups_give_nulls_not_errors(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "g string, v double")
    r = D.welch_t(df, "v", "g", with_p=False).first()
    assert r.n2 == 1 and r.t is None
    c = D.chi_square(spark.createDataFrame([(1, "a", "x")], "k int, g string, lv string"), "k", "g", ["a", "b"],
                     ["lv"], with_p=False).first()
    assert c.chi2 is None


def test_exact_u_small_samples(spark):
    import itertools
    a, b = [1.0, 4.0, 6.0], [2.0, 3.0, 5.0, 7.0]
    # brute force over all splits of the pooled ranks
    pooled = sorted(a + b)
    u_obs = sum(1 for x in a for y in b if x > y)
    us = []
    for comb in itertools.combinations(range(7), 3):
        xs = [pooled[i] for i in comb]
        ys = [pooled[i] for i in range(7) if i not in comb]
        us.append(sum(1 for x in xs for y in ys if x > y))
    k = max(u_obs, 12 - u_obs)
    want = min(1.0, 2 * sum(1 for u in us if u >= k) / len(us))
    assert math.isclose(Dist.mwu_exact_p(u_obs, 3, 4), want)
    df = spark.createDataFrame([("a", v) for v in a] + [("a", 9.0)] + [("b", v) for v in b], "g string, v double")
    r = D.u_test(df, "v", "g", groups=["a", "b"], method="exact").first()
    u4 = sum(1 for x in a + [9.0] for y in b if x > y)
    assert r.u == u4 and math.isclose(r.p_u, Dist.mwu_exact_p(u4, 4, 4))


def test_one_method_at_every_size(spark):
    """The default p does not change its method with the sample size."""
    import statistics
    for n1, n2 in ((4, 4), (5, 1000), (9, 9)):
        rows = [("a", 2.0 * i + 0.5) for i in range(n1)] + [("b", float(i)) for i in range(n2)]
        df = spark.createDataFrame(rows, "g string, v double")
        r = D.u_test(df, "v", "g", groups=["a", "b"]).first()
        u = sum((x > y) + 0.5 * (x == y) for g, x in rows if g == "a" for k, y in rows if k == "b")
        n = n1 + n2
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 * (n + 1) / 12)
        want = min(1.0, 2 * (1 - statistics.NormalDist().cdf(z)))
        assert r.u == u and math.isclose(r.p_u, want, rel_tol=1e-9)
    tied = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 2.0)], "g string, v double")
    assert D.u_test(tied, "v", "g", groups=["a", "b"], method="exact").first().p_u is None


def test_large_degrees_of_freedom():
    assert math.isclose(Dist.t_sf2(1.0, 1e12), 0.31731050786, rel_tol=1e-9)
    assert math.isclose(Dist.t_sf2(2.0, 1e12), 0.04550026390, rel_tol=1e-9)
    assert math.isclose(Dist.t_sf2(2.0, 10), 0.07338803477, rel_tol=1e-8)
    assert math.isclose(Dist.t_sf2(1.0, 1), 0.5, rel_tol=1e-12) and math.isclose(Dist.t_sf2(1e-9, 5), 1.0, rel_tol=1e-8)
    assert math.isclose(Dist.f_sf(4.0, 1, 1e12), Dist.t_sf2(2.0, 1e12), rel_tol=1e-9)
    assert math.isclose(Dist.f_sf(3.0, 2, 10), (1 + 2 * 3.0 / 10) ** -5, rel_tol=1e-10)
    assert math.isclose(Dist.t_ppf(0.975, 1e12), 1.95996398454, rel_tol=1e-9)
    assert math.isclose(Dist.t_ppf(0.975, 1), 12.7062047364, rel_tol=1e-9)
    assert Dist.t_ppf(0.975, 0.3) > 1000 and math.isclose(Dist.t_sf2(Dist.t_ppf(0.975, 0.3), 0.3), 0.05, rel_tol=1e-9)
    assert math.isclose(Dist.t_ppf(0.025, 7), -Dist.t_ppf(0.975, 7), rel_tol=1e-12) and Dist.t_ppf(0.5, 7) == 0


def test_levels_named_like_margins(spark):
    rows = [("a", "all", 1.0), ("a", "x", 2.0), ("a", "all", 3.0), ("b", "all", 2.5), ("b", "x", 4.0), ("b", "x", 5.0), ("a", "x", 0.5), ("b", "all", 1.5)]
    df = spark.createDataFrame(rows, "g string, s string, v double")
    got = D.subgroup_tests(df, "v", "g", ["a", "b"], "s", with_p=False).collect()
    assert sorted(r.subgroup for r in got) == ["all", "all", "x"] and len({r.u for r in got if r.subgroup == "all"}) == 2
    keyed = spark.createDataFrame([(i, "All" if i % 2 else "x", "g", float(i)) for i in range(6)], "k long, lv string, grp string, v double")
    tidy = D.data_stats(keyed, "k", "v", "grp", ["lv"]).collect()
    assert {(r.level, r.level_total, r.group_total): r.N for r in tidy if r.group_total == 0} == {("All", 0, 0): 3, ("x", 0, 0): 3, ("All", 1, 0): 6}


def test_data_stats_deals_rows_by_key_alone(spark):
    rows = [(1, 2.0, "a", "x", "p"), (1, 4.0, "b", "x", "q"), (None, 6.0, "a", "y", "q"), (2, None, "a", "x", None), (2, 1.0, None, "x", "p")]
    df = spark.createDataFrame(rows, "kk long, v double, g string, l1 string, l2 string")
    out = D.data_stats(df, "kk", "v", "g", ["l1", "l2"])
    cells = {(r.variable, r.level, r.group): (r.N, r.obs, r.M) for r in out.collect()}
    assert cells["l1", "x", "All"] == (2, 3, 3.0) and cells["l1", "y", "a"] == (0, 0, 6.0)
    assert cells["l1", "All", "All"] == (2, 3, 4.0) and cells["l2", "q", "All"] == (1, 1, 5.0) and len(cells) == 16
    # a key's cells are told apart where its rows lie
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert dealt and not any("variable" in line and "k#" in line.replace("_key#", "k#").replace("kk#", "k#") for line in dealt)
