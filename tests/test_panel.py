import datetime as dt

from pyspark.sql import functions as F

from cohortlens.operators import panel as P


def panel_df(spark):
    rows = [  # subject, ts, age, score, flag, cat, id
        (1, dt.datetime(2020, 1, 1), 50.2, 1.0, 1, None, 1),
        (1, dt.datetime(2020, 1, 2), 50.4, 3.0, 0, "b", 2),
        (1, dt.datetime(2020, 1, 3), 51.5, 5.0, 1, "a", 3),
        (1, dt.datetime(2020, 1, 4), 52.5, 7.0, 1, "a", 4),
        (2, dt.datetime(2020, 1, 1), 60.0, 2.0, 0, "c", 5),   # 2 buckets only
        (2, dt.datetime(2020, 1, 2), 61.0, 4.0, 0, "c", 6),
        (3, dt.datetime(2020, 1, 1), 49.0, 9.0, 1, "z", 7),   # out of range
    ]
    return spark.createDataFrame(rows, "sid long, ts timestamp, age double, score double, flag int, cat string, id long")


def test_bucket_data(spark):
    p = P.Panel(group="sid", timestamp="ts", target="score", covariates=("flag", "cat"), to_bucket="age",
                bucket_min=50, bucket_max=90, interval=1.0, min_obs=3, tiebreak=("id",))
    out = P.bucket_data(P.load_panel(panel_df(spark), p), p).orderBy("sid", "age_upbound").collect()
    assert [(r.sid, r.age_upbound, r.counter, r.occur) for r in out] == [(1, 51.0, 1, 3), (1, 52.0, 2, 3),
                                                                        (1, 53.0, 3, 3)]
    first = out[0]
    # bucket 51: ages 50.2, 50.4 -> mean score 2, first non-null cat 'b', flag first = 'yes'
    assert first.score == 2.0 and first.cat == "b" and first.flag == "yes"


def test_running_number_baseline_size(spark):
    df = panel_df(spark)
    d = P.with_baseline(P.with_running_number(df, "sid", ["ts", "id"]), "sid", ["ts", "id"], ["cat", "score"])
    d = P.with_group_size(d, "sid")
    r = {x.id: x for x in d.collect()}
    assert r[4].counter == 4 and r[4].cat_baseline is None and r[4].score_baseline == 1.0 and r[4].size == 4
    assert P.keep_min_obs(df, "sid", 3).select("sid").distinct().collect()[0].sid == 1


def test_normalize_constant_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, c double")
    out = P.normalize(df, ["a", "c"]).collect()
    assert [r.a for r in out] == [0.0, 1.0, None] and [r.c for r in out] == [0.0, 0.0, 0.0]


def test_dummies_and_modal(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("b",), ("a",)], "g string")
    d = P.dummyfy(df, ["g"], drop=False).collect()
    assert [(r.g_a, r.g_b) for r in d] == [(1, 0), (0, 1), (0, 0), (0, 1), (1, 0)]
    ref = P.dummyfy(df, ["g"], drop_first=True)
    assert ref.columns == ["g_b"]
    m = P.dummyfy_modal(df, ["g"])       # tie a/b -> smallest 'a'
    assert m.columns[-1] == "g_a"


def test_binary_columns(spark):
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, None)], "a int, b double, c int")
    assert P.binary_columns(df, ["a", "b", "c"]) == ["a", "c"]


def test_join_baseline_rows_takes_one(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 1, 9.0), (1, 2, 12.0), (2, 3, 1.0)], "sid int, t int, v double")
    out = P.join_baseline_rows(df, "sid", F.col("t") == 1, ["v"], ["t", "v"])
    assert sorted((r.sid, r.t, r.v, r.v_baseline) for r in out.collect() if r.sid == 1) == [
        (1, 1, 9.0, 9.0), (1, 1, 10.0, 9.0), (1, 2, 12.0, 9.0)]
    assert [r.v_baseline for r in out.collect() if r.sid == 2] == [None]


def test_hot_subject_running_number_and_baseline(spark):
    # one subject with most rows, tied time stamps broken by id
    rows = [(1, i // 3, float(i), i) for i in range(600)] + [(2, 5, 1.0, 1000), (2, 1, 2.0, 1001)]
    df = spark.createDataFrame(rows, "sid int, t int, v double, id int")
    out = P.with_running_number(df, "sid", ["t", "id"])
    got = {r.id: r.counter for r in out.collect()}
    assert [got[i] for i in range(600)] == list(range(1, 601)) and got[1001] == 1 and got[1000] == 2
    b = {r.id: r.v_baseline for r in P.with_baseline(df, "sid", ["t", "id"], ["v"]).collect()}
    assert b[599] == 0.0 and b[1000] == 2.0
    assert P.with_group_size(df, "sid").filter("sid = 1").first()["size"] == 600
