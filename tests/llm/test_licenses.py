import math
import random
import re

import duckdb
import pytest

from cohortlens.llm import licenses as L
from cohortlens.llm.queries import ORACLES, op11

SF = "/root/testdata/sf0.01"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_hand(texts):
    """Every template at every word of every text."""
    words = [words_of(t) for t in texts]
    held = {}
    for w in words:
        for x in set(w):
            held[x] = held.get(x, 0) + 1
    idf = lambda w: math.log((1 + len(texts)) / (1 + held.get(w, 0))) + 1
    out = []
    for ws in words:
        found = []
        for k, t in enumerate(L.TEMPLATES):
            key = t.key.split()
            for start in range(len(ws)):
                if ws[start:start + len(key)] == key:
                    fits = [0 <= (at := start + i - t.key_at) < len(ws) and ws[at] == w for i, w in enumerate(t.words)]
                    found.append((k, t.label, start, sum(idf(w) for w, f in zip(t.words, fits) if f) / sum(map(idf, t.words))))
        base = [f for f in found if f[0] < 3]
        out.append((len(ws), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None),
                    ",".join(sorted({f[1] for f in base})), ",".join(sorted({f[1] for f in found})), max((f[3] for f in found), default=0.0)))
    return out


FIELDS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def check(got, docs):
    want = by_hand([t for _, t in docs])
    rows = sorted((str(r["doc_id"]), *(r[f] for f in FIELDS[:-1]), r["score"]) for r in got)
    for r, w in zip(rows, sorted((str(i), *w) for (i, _), w in zip(docs, want)), strict=True):
        assert r[:-1] == w[:-1] and math.isclose(r[-1], w[-1], abs_tol=1e-6)


@pytest.fixture
def odd_docs():
    rng = random.Random(4)
    notices = [t.notice for t in L.TEMPLATES] + ["Under\nthe MIT-License", "CC BY-NC 4.0", "cc by nc cc by nc-SA", "under the mit the mit license", "APACHE license, version 2",
                                                "état under the mit licenseé", "İK under the mit license", "gnu general public license", "K cc by nc"]
    docs = [(i, " ".join(rng.choice(["the", "licence", "public", "x y", *notices]) for _ in range(rng.randrange(6)))) for i in range(200)]
    return docs + [(1000, None), (1001, ""), (1002, " .\x00;"), (None, "cc by nc"), (7, "cc by nc"), (7, "cc by nc"),
                   (1003, "cc by " * 150_000 + "nc"), (1004, "under the mit license " * 60_000)]


def test_odd_docs(spark, odd_docs, tmp_path):
    schema = "doc_id long, text string, found string, n_words string, base string, w int"
    spark.createDataFrame([(*d, "f", "n", "b", 1) for d in odd_docs], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check(op11(spark, str(tmp_path)).collect(), odd_docs)
    kept = L.scan_licenses(spark.read.parquet(f"{tmp_path}/documents.parquet"), "text")
    assert set(kept.columns) == {"doc_id", "text", "found", "n_words", "base", "w"} and kept.where("base = 'b' and w = 1").count() == len(odd_docs)


def test_query_equals_loops_and_sql(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op11(spark, SF).collect()
    check(got, docs)
    assert sum(r["labels"] != "" for r in got) > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = con.execute(ORACLES["op11_license_scan"]).fetchall()
    assert sorted(tuple(r[f] for f in ("doc_id", *FIELDS)) for r in got) == sorted(sql)


def test_empty_table_and_plan(spark):
    empty = L.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), "text")
    assert empty.count() == 0 and dict(empty.dtypes)["n_words"] == "bigint"
    for t in L.TEMPLATES:
        assert t.notice.count(t.key) == 1 and t.words == words_of(t.notice)


def test_no_python_on_the_main_path(spark, capsys):
    op11(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan and plan.count("split(") == 1
