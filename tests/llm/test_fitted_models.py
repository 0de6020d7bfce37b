import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import quality, suffix_tree, toxicity
from cohortlens.llm import vectext as V
from cohortlens.llm.neighbours import CrossPolytope, cells_for, nearest
from cohortlens.llm.sample import labelled_sample
from cohortlens.llm.suffix_tree import CLASSES, score_texts
from cohortlens.llm.written import Written

SF = "/root/testdata/sf0.01"


def _prose(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "on", "an", "ti"], k=rng.randrange(1, 4))) for _ in range(n))


def test_quality_held_out(spark):
    from cohortlens.llm.queries import op4
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op4(spark, SF).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([p == q for p, q in held]) > 0.97 and all(p for p, q in held if q)


def test_quality_edges():
    rng = random.Random(1)
    texts = [_prose(rng, 40) for _ in range(40)] + [" ".join(["junk"] * 40) for _ in range(40)]
    m = quality.fit(pa.array(texts), np.array([1] * 40 + [0] * 40), bits=12, steps=2000)
    s = m.scores(pa.array([None, "", "x", "é" * 9, texts[0], texts[-1], "zap " * 700_000]))
    assert s[0] == s[1] == 0.5 and s[4] > 0.9 and s[5] < 0.1 and s[6] < 0.5 and ((0 <= s) & (s <= 1)).all()
    assert (quality.fit(pa.array(["a", "b"]), np.array([1, 1])).scores(pa.array(["a"])) == 0.5).all()
    assert (quality.fit(pa.array([], pa.string()), np.array([], int)).scores(pa.array(["a"])) == 0.5).all()


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["awful", "wretch", "vermin", "wretched"]

    def text(n):
        t = _prose(rng, 60).split()
        for _ in range(n):
            t.insert(rng.randrange(len(t)), rng.choice(bad[:3]) + rng.choice(["", "!", "###"]))
        return " ".join(t)
    n = [0] * 150 + [1 + i % 5 for i in range(60)]
    texts = [text(k) for k in n]
    m = toxicity.fit(pa.array(texts), (np.array(n) > 0).astype(int))
    g = m.grades(pa.array([text(0), text(1), text(5), None, "", "AWFUL", "z " * 500_000 + "awful wretch vermin"]))
    assert (g[:, 0] >= g[:, 1]).all() and m.thresholds[0] < m.thresholds[1]
    assert (g[:, 0] >= 0.5).tolist() == [False, True, True, False, False, True, True]
    assert g[2].sum() > g[1].sum() > g[0].sum()
    for y in (0, 1):
        one = toxicity.fit(pa.array(["a", "b"]), np.array([y, y])).grades(pa.array(["a", None]))
        assert ((one[:, 0] >= 0.5) == bool(y)).all()
    assert (toxicity.fit(pa.array([], pa.string()), np.array([], int)).grades(pa.array(["a"]))[:, 0] < 0.5).all()


def test_toxicity_held_out(spark):
    from cohortlens.llm.queries import op7
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in op7(spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    tox = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert np.mean(tox) > 0.85 and np.mean(clean) < 0.01
    assert all(abs(r["grade"] - r["expected_severity"]) <= 1 for r in rows)


@pytest.mark.parametrize("of", [quality.fit_quality, toxicity.fit_toxicity])
def test_models_are_fitted_in_a_task(spark, of, monkeypatch):
    """The driver's Python fits nothing, unless there is no row; the model is the one of the sorted rows."""
    rows = [(i % 2, ("good words here " if i % 2 else "bad stuff there ") * (1 + i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, text string").repartition(3)
    ordered = df.orderBy("y", F.xxhash64("text"), "text").toArrow()
    module = quality if of is quality.fit_quality else toxicity
    want = module.fit(ordered["text"], np.asarray(ordered["y"].to_numpy(), np.int64))
    monkeypatch.setattr(module.V, "flat", None)
    got = of(df)
    assert vars(got).keys() == vars(want).keys() and all(np.allclose(v, vars(want)[k], rtol=1e-4, atol=1e-6) for k, v in vars(got).items())


def test_models_of_no_rows(spark):
    none = spark.createDataFrame([], "y int, text string")
    assert not quality.fit_quality(none).weight.any()
    toxicity.fit_toxicity(none)


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "t" * (i % 7), "e") for i in range(60)] + [(None, "x", "e"), (3, None, "e")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (None, 1), (9, None), (8, 5)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 10, 5).collect()
    assert Counter(r["y"] for r in got) == {0: 10, 1: 10} and all(len(r["text"]) <= 5 for r in got)
    assert labelled_sample(docs.limit(0), labels, "quality", 10, 5).count() == 0


def _reference(rows):
    low = {i: i + 32 for i in range(65, 91)}
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\n"] for _, t, _ in rows]
    c = Counter(w for t, (_, _, train) in zip(tokens, rows) if train for w in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t in tokens]


@pytest.mark.parametrize("chunk", [200, 1 << 24])
def test_scores_by_formula(spark, chunk, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
    rng = random.Random(4)
    rows = [(i, _prose(rng, rng.randrange(0, 50)).title() + " ünï", i % 3 > 0) for i in range(60)]
    rows += [(100, None, True), (101, "", True), (102, " \n", False), (103, "zq zq never", False), (103, "zq zq never", False), (104, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, train boolean")
    got = sorted(score_texts(df, "text", F.col("train"), ["id"]).collect(), key=lambda r: r["id"])
    want = _reference(rows)
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r["base_score"] for r in got], [w[3] for w in want], rtol=0, atol=1e-9)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string")
    got = sorted(score_texts(df, "text", F.lit(False), ["id"]).collect(), key=lambda r: r["id"])
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score_texts(df.limit(0), "text", F.lit(True), ["id"]).count() == 0


def test_tree_distributions_and_states():
    rng = np.random.default_rng(5)
    n = rng.poisson(0.02, (CLASSES,) * 3)
    n[:, 7, 9] += 400      # after class 7, class 9: a state that diverges
    p = 10 ** suffix_tree.suffix_tree(n)
    assert np.allclose(p.sum(-1), 1) and p[3, 7, 9] > 0.5
    assert np.allclose(10 ** suffix_tree.suffix_tree(np.zeros((CLASSES,) * 3)), 1 / CLASSES)


def test_tree_beats_its_base_on_held_out(spark):
    from cohortlens.llm.queries import op5
    held = [r for r in op5(spark, SF).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_words_are_predicted_by_words(spark):
    # all words are of one class: only a state over words knows which follows which
    pairs = [(f"x{i:03d}ab", f"y{i:03d}ab") for i in range(60)]
    rng = random.Random(7)
    rows = [(i, " ".join(w for p in rng.sample(pairs, 20) for w in p), True) for i in range(60)]
    rows += [(100, " ".join(a + " " + b for a, b in pairs), False), (101, " ".join(pairs[i][0] + " " + pairs[i - 7][1] for i in range(60)), False)]
    got = {r["id"]: r for r in score_texts(spark.createDataFrame(rows, "id long, text string, train boolean"), "text", F.col("train"), ["id"]).collect()}
    assert math.isclose(got[100]["base_score"], got[101]["base_score"]) and got[100]["score"] > got[101]["score"] + 60


def _by_hand(rows):
    """Sum over next words of what the states add to a distribution that sums to 1, and their number."""
    tokens = [t.split() + [""] for t in rows]
    n = [Counter(tuple(t[i - k:i + 1]) for t in tokens for i in range(k, len(t))) for k in range(suffix_tree.DEPTH + 1)]
    total, states = sum(n[0].values()), {}
    for k in range(1, suffix_tree.DEPTH + 1):
        after = {}
        for g, m in n[k].items():
            after.setdefault(g[:-1], {})[g] = m
        for c, of in after.items():
            of, seen = {g: m for g, m in of.items() if m > 1}, n[k - 1][c]
            share = lambda g: n[k - 1][g[1:]] / (n[k - 2][g[1:-1]] if k > 1 else total)
            if seen >= suffix_tree.LEAST_SEEN and sum(m * math.log(m / seen / share(g)) for g, m in of.items()) > 0.5 * len(of) * math.log(seen + 1) and of:
                states[c] = ({g[-1]: m / (seen + len(of)) for g, m in of.items()}, 1 - sum(of.values()) / (seen + len(of)))
    return states


@pytest.mark.parametrize("buckets", [1, 5])
def test_word_states_equal_counts_by_hand_and_grow(spark, buckets):
    rng = random.Random(8)
    size = []
    for part in (1, 4):
        texts = []
        for p in range(part):
            texts += [" ".join(w + str(p) for w in rng.choices(["aa", "bb cc", "dd ee ff", "gg"] + [f"w{j}" for j in range(30)], k=60)) for _ in range(40)]
        dictionary = Counter(w for t in texts for w in [*t.split(), ""])
        hashes = {w: int(V.Words(*V.flat(pa.array([w]))).hash[0]) if w else 0 for w in dictionary}
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        known = spark.createDataFrame([(signed(hashes[w]), m) for w, m in dictionary.items()], "h long, n long")
        df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
        top = np.sort(np.array([hashes[w] for w, _ in dictionary.most_common(3)], np.uint64))
        shelf = Written(spark, "states")
        got = suffix_tree.word_states(df, known, sum(dictionary.values()), top, buckets, shelf).collect()
        want = _by_hand(texts)
        values = sorted([left for _, left in want.values()] + [v for of, _ in want.values() for v in of.values()])
        assert {len(c) for c in want} >= {1, 2} and np.allclose(sorted(r["n"] / r["mass"] for r in got), values, rtol=0, atol=1e-12)
        assert all(math.isclose(sum(of.values()) + left, 1) for of, left in want.values())
        size.append(len(got))
    assert size[1] > 3 * size[0]


def test_only_runs_after_states_are_asked():
    """However full the filter of held runs is, a run that is no state is not asked, nor what follows it."""
    words = " ".join(f"w{j}" for j in range(50))
    w = V.Words(*V.flat(pa.array([words, words])))
    none, full = np.zeros(1 << 20, np.uint64), np.full(1 << 20, ~np.uint64(0))
    assert [len(h) for h in suffix_tree._questions(w, none, full)] == [50] + [0, 0] * suffix_tree.DEPTH
    assert [len(h) for h in suffix_tree._questions(w, full, none)] == [50, 50, 0, 49, 0, 48, 0]
    assert [len(h) for h in suffix_tree._questions(w, full, full)] == [50, 50, 50, 49, 49, 48, 48]


@pytest.mark.parametrize("buckets", [suffix_tree.Buckets.of(3000, 4), suffix_tree.Buckets(8, 70), suffix_tree.Buckets.of(1 << 60, 3)])
def test_prefixes_of_hashes_find_the_values_of_whole_ones(buckets):
    """Also where many hashes begin alike, and where buckets are narrow."""
    rng = np.random.default_rng(9)
    h = np.unique(np.concatenate((rng.integers(0, 1 << 64, 2000, dtype=np.uint64), rng.integers(0, 1 << 64, 10, dtype=np.uint64)[:, None].repeat(100, 1).ravel()
                                  + np.tile(np.arange(100, dtype=np.uint64), 10), np.array([0, (1 << 64) - 1], np.uint64))))
    known, other = h[::2], h[1::2]
    n, mass = rng.integers(1, 99, len(known)), rng.integers(100, 999, len(known))
    table = pa.table([pa.array(known.view(np.int64)), pa.array(n), pa.array(mass)], names=["h", "n", "mass"])
    rows = list(suffix_tree._packed_values(buckets)(table.to_batches()))
    for chunk, asked in ((5, h), (6, other), (7, known[:1])):
        prefix = suffix_tree._rising(buckets.prefix(asked))
        rows.append(suffix_tree._pack(prefix.astype(np.uint64), buckets.bounds(prefix), [], chunk))
    rows = pa.Table.from_batches(rows)
    answers = pa.concat_tables([suffix_tree._resolve(buckets)(rows.filter(pc.equal(rows["bucket"], b))) for b in set(rows["bucket"].to_pylist())])
    for chunk, asked in ((5, h), (6, other), (7, known[:1])):
        value, there = suffix_tree._answers(answers.filter(pc.equal(answers["chunk"], chunk))).of(asked)
        want = dict(zip(known.tolist(), (n / mass).tolist()))
        assert there.tolist() == [x in want for x in asked.tolist()] and value.tolist() == [want.get(x, 0.0) for x in asked.tolist()]


def test_questions_are_short_and_found_in_few_steps():
    rng = np.random.default_rng(10)
    h = np.sort(rng.integers(0, 1 << 64, 200_000, dtype=np.uint64))
    buckets = suffix_tree.Buckets.of(len(h), 50)
    prefix = suffix_tree._rising(buckets.prefix(h))
    rows = suffix_tree._pack(prefix.astype(np.uint64), buckets.bounds(prefix), [], 1)
    assert rows.num_rows == 50 and sum(map(len, rows["h"].to_pylist())) < 2 * len(h)      # 5.3 bytes for each whole hash
    assert np.diff(suffix_tree._Found(h[:4000], h[:4000]).first).max() < 20               # a bucket's hashes lie in a narrow range


def test_classes_are_counted_where_no_run_is_frequent(spark):
    rows = [(i + 1, f"w{i}".encode(), 1) for i in range(12)] + [(0, b"", 3)]
    classes, _, _ = suffix_tree.choose_classes(spark.createDataFrame(rows, "h long, word binary, n long"))
    cells, texts = np.zeros(CLASSES ** 3, np.int64), ["w1 w2 w3", "", "w3 w4"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    known, shared = spark.createDataFrame([(7, 1)], "h long, n long"), spark.sparkContext.broadcast(classes)
    for buckets in (1, 5):
        cells[:] = 0
        assert suffix_tree.word_states(df, known, 8, classes.top, buckets, Written(spark, "cells"), shared, cells) is None
        want = np.zeros_like(cells)
        for t in texts:
            w = V.Words(*V.flat(pa.array([t])))
            line = [suffix_tree.START, suffix_tree.START, *classes.of(w).tolist(), suffix_tree.STOP]
            for a, b, c in zip(line, line[1:], line[2:]):
                want[(a * CLASSES + b) * CLASSES + c] += 1
        assert want.sum() == 8 and (cells == want).all()


def test_only_scored_rows_are_left(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "CHUNK", 2000)
    rng = random.Random(11)
    df = spark.createDataFrame([(i, _prose(rng, 40)) for i in range(80)], "id long, text string")
    got = score_texts(df, "text", F.col("id") % 3 > 0, ["id"])
    tables = {file.rsplit("/", 1)[0].removeprefix("file://") for file in got.inputFiles()}
    assert len(tables) == suffix_tree.ROUNDS > 1 and {str(p) for p in Path(min(tables)).parent.iterdir()} == {str(Path(t)) for t in tables}
    assert sorted(r["id"] for r in got.collect()) == list(range(80))


def test_classes_count_words_and_times(spark):
    words = [f"{a}{b}{i}" for i in range(30) for a in "abc" for b in "xyü"] + ["q", "aa"]
    rows = [(i + 1, w.encode(), i % 7) for i, w in enumerate(words)] + [(0, b"", 9)]
    classes, kinds, times = suffix_tree.choose_classes(spark.createDataFrame(rows, "h long, word binary, n long"))
    want = np.zeros((2, CLASSES), int)
    for h, w, n in rows:
        x = V.Words(*V.flat(pa.array([w.decode()])))
        x._hash = np.full(len(x.start), h, np.uint64)
        k = int(classes.of(x)[0]) if w else suffix_tree.STOP
        want[:, k] += (n > 0, n)
    assert kinds.tolist() == want[0].tolist() and times.tolist() == want[1].tolist() and len(classes.top) == suffix_tree.TOP_WORDS


def test_scores_equal_a_direct_computation(spark):
    """Score by score: class tree, share of the class and states, all counted in loops."""
    rng = random.Random(4)
    train = [" ".join(rng.choices(["aa bb", "bb cc dd", "ee", "ff gg", "aa cc"] + [f"x{j}" for j in range(12)], k=50)) for _ in range(80)] + ["", "   "]
    held = ["aa bb cc never seen", "", None, "ee aa bb bb cc dd ff gg ee"]
    rows = [(i, t, True, "k") for i, t in enumerate(train)] + [(100 + i, t, False, "k") for i, t in enumerate(held)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean, score string").repartition(3)
    got = {r["doc_id"]: r for r in suffix_tree.score_texts(df, "text", F.col("train"), ["doc_id", "score"]).collect()}
    assert list(got[0].asDict()) == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and len(got) == len(rows)
    counts = Counter(w for t in train for w in [*t.split(), ""])
    total = sum(counts.values())
    every = set(counts) | {w for t in held for w in (t or "").split()}
    top = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:suffix_tree.TOP_WORDS]
    ends = Counter()
    for w in counts:
        if w:
            ends[w[-2:]] += counts[w]
    ends = sorted(ends, key=lambda e: (-ends[e], e))[:suffix_tree.ENDINGS]
    rest = suffix_tree.CLASSES - 2

    def of(w):
        return 1 if w == "" else 2 + top.index(w) if w in top else 2 + suffix_tree.TOP_WORDS + ends.index(w[-2:]) if w[-2:] in ends else rest

    cells = np.zeros((suffix_tree.CLASSES,) * 3)
    for t in train:
        line = [0, 0, *map(of, t.split()), 1]
        for g in zip(line, line[1:], line[2:]):
            cells[g] += 1
    tree, states = suffix_tree.suffix_tree(cells), _by_hand(train)
    kinds = Counter(of(w) for w in counts)
    room = Counter()
    for w, n in counts.items():
        room[of(w)] += n
    for doc_id, t, _, _ in rows:
        words, score, base = (t or "").split(), 0.0, 0.0
        line = [0, 0, *map(of, words), 1]
        for i, w in enumerate([*words, ""]):
            k = of(w)
            p = 10 ** tree[line[i], line[i + 1], k] * (counts[w] + 0.5) / (room[k] + 0.5 * (kinds[k] + 1))
            for d in range(1, suffix_tree.DEPTH + 1):
                if i >= d and tuple(words[i - d:i]) in states:
                    part, left = states[tuple(words[i - d:i])]
                    p = part.get(w, 0.0) + left * p
            score += math.log10(p)
            base += math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1)))
        r = got[doc_id]
        assert r["n_tokens"] == len(words) + 1 and r["train_tokens"] == total and r["n_known"] == sum(counts[w] > 0 for w in [*words, ""])
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)
    assert every > set(counts)


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(6, 24))
    x = (centre[rng.integers(0, 6, 900)] + 0.6 * rng.normal(size=(900, 24))).astype(np.float32)
    x[100:400] = x[100]    # a third of all rows are one vector
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)]
    rows += [(1000, None, "s"), (1100, [0.0] * 24, "s"), (1200, [float("nan")] * 24, "s"), (1300, [None] * 24, "s"),
             (1400, [1.0, 2.0], "s"), (None, x[0].tolist(), "s"), (7, x[7].tolist(), "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    got = nearest(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    x = x.astype(float)
    hit = 0
    for q in range(0, 900, 100):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(s == d[v] for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hit += len({v for _, v, _ in mine} & set(best.tolist()))
    assert hit >= 0.9 * 90 and {r["query_id"] for r in got} == set(range(0, 900, 100))
    assert nearest(df.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0


def test_nearest_buckets_are_in_order():
    x = np.random.default_rng(2).normal(size=(20, 6))
    hashed = CrossPolytope(6, 2, 64)
    assert hashed.kept == [8, 8, 2] and hashed.buckets == 16 * 16 * 4
    got = hashed.nearest(x, 1, 50)
    cost, code = np.zeros((20, 1)), np.zeros((20, 1), int)
    for nth, kept in enumerate(hashed.kept):
        y = hashed.rotated(x, 1, nth)
        assert np.allclose((y ** 2).sum(1), (x ** 2).sum(1))    # a rotation
        y = np.concatenate((-y[:, :kept], y[:, :kept]), 1)
        cost = (cost[:, :, None] + ((y - y.min(1, keepdims=True)) ** 2)[:, None, :]).reshape(20, -1)
        code = (code[:, :, None] * 2 * kept + np.arange(2 * kept)).reshape(20, -1)
    for i in range(20):
        at = [cost[i, np.flatnonzero(code[i] == c)[0]] for c in got[i]]
        assert len(set(got[i])) == 50 and np.allclose(at, np.sort(cost[i])[:50])


def test_the_share_of_candidates_falls_as_vectors_grow(spark):
    seen = {}
    for n in (2_000, 50_000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 32)).astype(np.float32)
        df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "v": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32()))}))
        got = nearest(df, "vec_id", "v", F.col("vec_id") % (n // 40) == 0).collect()
        hit, wide = 0, x.astype(float)
        for q in range(0, n, n // 40):
            d = ((wide - wide[q]) ** 2).sum(1)
            d[q] = np.inf
            hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
        assert len(got) == 400 and hit >= 0.9 * 400
        cells = cells_for(n)
        hashed, unit = CrossPolytope(32, 16, cells), wide / np.linalg.norm(wide, axis=1, keepdims=True)
        share = 0.0
        for t in range(16):
            held = np.bincount(hashed.nearest(unit, t, 1)[:, 0], minlength=hashed.buckets)
            share += held[hashed.nearest(unit[::n // 40], t, int(8 * cells ** 0.5))].sum() / 40 / n
        seen[n] = share
    assert seen[50_000] < 0.6 * seen[2_000]


@pytest.mark.parametrize("n", [1, 6, 20])
def test_small_tables_give_every_neighbour(spark, n):
    x = np.random.default_rng(12).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, "vec_id", "embedding", F.lit(True)).collect()
    assert len(got) == n * min(10, n - 1)
    for q in range(n):
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in mine] == list(range(1, len(mine) + 1)) and q not in {v for _, v in mine}


def test_neighbours_recall_on_the_table(spark):
    from cohortlens.llm.queries import op6
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows]), np.array([r["vec_id"] for r in rows])
    got = {(r["query_id"], r["vec_id"]) for r in op6(spark, "/root/testdata/sf0.1").collect()}
    hit = n = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit += sum((ids[i], v) in got for v in ids[np.lexsort((ids, d))[:10]])
        n += 10
    assert hit >= 0.9 * n
