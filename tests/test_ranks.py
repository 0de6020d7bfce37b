"""Running numbers on scans, in sessions of different partition counts."""
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import panel as P
from cohortlens.operators import ranks as R

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [3, 8, 200])
def test_running_number_of_a_scan(spark, partitions):
    spark = spark.newSession()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    ev = spark.read.parquet(f"{SF}/events.parquet")
    out = P.with_running_number(ev, "user_id", ["ts", "event_id"])
    n = ev.count()
    assert out.count() == n
    biggest = ev.groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert out.agg(F.max("counter")).first()[0] == biggest
    per = {}
    for r in sorted(ev.collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        per[r["event_id"]] = per.setdefault(("n", r["user_id"]), 0) + 1
        per["n", r["user_id"]] += 1
    got = {r["event_id"]: r["counter"] for r in out.select("event_id", "counter").collect()}
    assert got == {k: v for k, v in per.items() if not isinstance(k, tuple)}


def test_ties_nulls_and_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["h", "h", "h", "a", None]), rng.choice([1, 1, 1, 2, None]), i, i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, o long, k long, w long")
    got = {r["k"]: r["w_cum"] for r in R.running_sums(df, "o", ["w"], by=["g"], n_buckets=7, tiebreak=["k"]).collect()}
    total, want = {}, {}
    for g, o, k, w in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        total[g] = total.get(g, 0) + w
        want[k] = total[g]
    assert got == want
    assert R.running_sums(df.limit(0), "o", ["w"], by=["g"]).count() == 0


def test_exact_quantiles(spark):
    rng = random.Random(2)
    for values in ([3.0], [1.0, 4.0], [rng.choice([0.5, 1.5, 9.0, rng.random()]) for _ in range(501)], []):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = R.ranked_value(df, "v", [0.0, 0.25, 0.5, 1.0])
        s = sorted(values)
        for share, g in zip([0.0, 0.25, 0.5, 1.0], got):
            if not s:
                assert g is None
                continue
            at = (len(s) - 1) * share
            lo, hi = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            assert abs(g - (lo + (at - int(at)) * (hi - lo))) < 1e-12


def test_keys_at_places(spark, monkeypatch):
    """Places found by cutting ranges, against the sorted keys; a key that repeats too often has no place of its own."""
    import random
    from cohortlens.operators import ranks
    monkeypatch.setattr(ranks, "FETCH", 50)
    rng = random.Random(12)
    keys = list({int(rng.lognormvariate(5, 3)) - 40 for _ in range(6000)} | {10 ** 12 + i for i in range(500)})
    df = spark.createDataFrame([(k, "x") for k in rng.sample(keys, len(keys))] + [(None, "n")] * 3, "k long, v string").repartition(5)
    want = sorted(keys)
    places = [0, 1, 49, 50, 777, len(want) // 2, len(want) - 1, len(want), len(want) + 9]
    assert ranks.keys_at(df, "k", places) == [want[p] if p < len(want) else None for p in places]
    same = spark.range(200).selectExpr("1L AS k")
    assert ranks.keys_at(same, "k", [3]) is None
    assert ranks.keys_at(df.limit(0), "k", [0]) == [None]


def test_row_slices(spark, monkeypatch):
    from cohortlens.operators import ranks
    from cohortlens.sources.tables import row_slice
    monkeypatch.setattr(ranks, "FETCH", 20)
    keys = [None, None] + [3 * i - 100 for i in range(300)]
    df = spark.createDataFrame([(k, "x") for k in keys], "k long, v string").repartition(4)
    for a, b in ((0, 10), (0, 2), (2, 2), (2, 40), (5, 300), (200, 999), (400, 500), (-4, 3), (0, 999), (7, 3)):
        got = sorted((r["k"] for r in row_slice(df, "k", a, b).collect()), key=lambda k: (k is not None, k))
        assert got == keys[max(a, 0):max(b, 0)] if a < b else got == []
    assert row_slice(df, "k", 1, 5).count() == 4 and row_slice(df, "k", 0, 1).count() == 1  # among null keys
    twice = df.unionByName(df)
    assert row_slice(twice.where("k is not null"), "k", 10, 30).count() == 20
    assert row_slice(df.limit(0), "k", 0, 5).count() == 0
    plan = row_slice(df, "k", 5, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan
