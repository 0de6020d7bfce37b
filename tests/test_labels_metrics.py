import math

from pyspark.sql import functions as F

from cohortlens.operators import labels as L
from cohortlens.operators import metrics as M


def test_split_is_deterministic_and_near_share(spark):
    df = spark.range(0, 20000).select(F.col("id").alias("k"))
    a = df.select(L.split_flag("k", 0.2, 911).alias("t")).agg(F.avg(F.col("t").cast("double"))).first()[0]
    assert abs(a - 0.2) < 0.02
    b = df.select("k", L.split_flag("k", 0.2, 911).alias("t"))
    assert b.exceptAll(df.select("k", L.split_flag("k", 0.2, 911).alias("t"))).count() == 0


def test_folds_disjoint_and_stratified(spark):
    rows = [(i, "x" if i % 10 < 7 else "y") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, lab string")
    f = L.stratified_folds(df, "k", "lab", k=5).collect()
    assert len(f) == 1000 and len({r.k for r in f}) == 1000
    per = {}
    for r in f:
        per.setdefault((r.lab, r.fold), 0)
        per[(r.lab, r.fold)] += 1
    assert all(per[("x", k)] == 140 for k in range(5)) and all(per[("y", k)] == 60 for k in range(5))
    plain = df.select(L.fold_of("k", 10).alias("f")).groupBy("f").count().collect()
    assert sum(r["count"] for r in plain) == 1000 and len(plain) == 10


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "lab string")
    assert [r.code for r in L.label_codes(df, "lab").orderBy(F.col("lab").asc_nulls_first()).collect()] == \
        [-1, 0, 0, 1, 2]
    assert sorted(r.code for r in L.label_codes(df, "lab", binary=True).collect()) == [0, 0, 1, 1, 1]
    nums = spark.createDataFrame([(3,), (0,)], "lab int")
    assert [r.code for r in L.label_codes(nums, "lab").collect()] == [3, 0]


def _sk_report(y, p):
    classes = sorted({str(x) for x in y} | {str(x) for x in p})
    out = {}
    for c in classes:
        tp = sum(1 for a, b in zip(y, p) if str(a) == c and str(b) == c)
        sup = sum(1 for a in y if str(a) == c)
        pr = sum(1 for b in p if str(b) == c)
        prec = tp / pr if pr else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[c] = (prec, rec, f1, float(sup))
    return out


def test_class_report_never_predicted(spark):
    y = [0, 1, 2, 2, 1, 0, 3]
    p = [0, 2, 2, 2, 0, 0, 2]   # classes 1 and 3 never predicted
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    rep = {r["class"]: r for r in M.class_report(df, "y", "p").collect()}
    ref = _sk_report(y, p)
    for c, (pr, rc, f1, sup) in ref.items():
        r = rep[c]
        assert (math.isclose(r.precision, pr), math.isclose(r.recall, rc), math.isclose(r.f1_score, f1),
                r.support) == (True, True, True, sup)
    acc = sum(a == b for a, b in zip(y, p)) / len(y)
    assert all(math.isclose(v, acc) for v in (rep["accuracy"].precision, rep["accuracy"].support))
    assert math.isclose(rep["macro avg"].f1_score, sum(v[2] for v in ref.values()) / len(ref))
    w = sum(v[2] * v[3] for v in ref.values()) / len(y)
    assert math.isclose(rep["weighted avg"].f1_score, w)
    m = M.perf_metrics(df, "y", "p").first()
    assert math.isclose(m.f1, w) and math.isclose(m.acc, acc)


def test_confusion_total_is_rows(spark):
    df = spark.range(0, 100).select((F.col("id") % 3).alias("y"), (F.col("id") % 4).alias("p"))
    assert M.confusion(df, "y", "p").agg(F.sum("n")).first()[0] == 100


def test_batch_merges_and_best(spark):
    b = spark.createDataFrame([(0, "a", 0.5, 0.5, 0.5, 10), (1, "a", 1.0, 1.0, 1.0, 30), (0, "z", 0.0, 0.0, 0.0, 5),
                               (1, "z", 0.0, 0.0, 0.0, 5)],
                              "batch int, class string, f1 double, precision double, recall double, support long")
    w = {r["class"]: r for r in M.merge_batch_weighted(b).collect()}
    assert math.isclose(w["a"].f1, (0.5 * 10 + 30) / 40) and w["z"].f1 == 0.0 and w["z"].support == 10
    p = {r["class"]: r for r in M.merge_batch_plain(b).collect()}
    assert math.isclose(p["a"].f1, 0.75) and p["z"].f1 is None
    s = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "fold int, f1 double")
    assert M.best_run(s).first().fold == 3


def test_regression_results(spark):
    import numpy as np
    y = np.array([3.0, 5.0, 2.0, 8.0])
    p = np.array([2.5, 5.0, 2.0, 7.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    r = M.regression_results(df, "y", "p").first()
    e = y - p
    assert r.mean_abs_err == round(float(np.abs(e).mean()), 4)
    assert r.r2 == round(1 - float((e ** 2).mean() / y.var()), 4)
    assert r.explained_variance == round(1 - float(e.var() / y.var()), 4)
    assert r.mean_squared_log_error == round(float(((np.log1p(y) - np.log1p(p)) ** 2).mean()), 4)
    assert r.median_abs_err == float(np.median(np.abs(e)))


def test_rounded_report_half_even(spark):
    df = spark.createDataFrame([(2.5, 2.5), (3.5, 3.4)], "y double, p double")
    rep = {r["class"] for r in M.rounded_class_report(df, "y", "p").collect()}
    assert {"2", "4", "3"} <= rep


def test_stratified_folds_order_keys_alone(spark):
    rows = [(i % 40 if i % 7 else None, float(i % 2), "x" * i) for i in range(120)]
    out = L.stratified_folds(spark.createDataFrame(rows, "k int, lab double, wide string"), "k", "lab", k=5)
    assert sorted((r.k is None, r.k or 0, r.lab, r.wide) for r in out.collect()) == sorted((k is None, k or 0, y, w) for k, y, w in rows)
    sizes = {(r.lab, r.fold): r["count"] for r in out.groupBy("lab", "fold").count().collect()}
    assert set(sizes.values()) == {12} and len(sizes) == 10
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and not any("wide" in line for line in windows)
    below = plan[plan.index("Window"):]
    assert "wide" not in below[:below.index("Relation")] if "Relation" in below else "wide" not in below
