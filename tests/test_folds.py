"""All folds in the same passes, against a dense fit of each fold in numpy."""
import math
import random

import numpy as np

from cohortlens.operators.folds import logit_folds

SCHEMA = "doc_id long, label double, fold int, tokens array<string>"


def texts(n=240):
    rng = random.Random(13)
    out = []
    for i in range(n):
        y = i % 3 == 0
        words = rng.choices(["red", "blue", "green", "old"], (5, 1, 2, 2), k=8) if y else rng.choices(["red", "blue", "green", "new"], (2, 4, 2, 2), k=8)
        out.append((i, float(y), i % 4, words + [f"w{rng.randrange(30)}"]))
    return out


def dense(rows, k, reg):
    """Vocabulary, idf, weights and scores of one fold by Newton's steps on dense rows."""
    train = [r for r in rows if r[2] != k]
    vocabulary = sorted({t for r in train for t in r[3]})
    df = {t: sum(t in r[3] for r in train) for t in vocabulary}
    idf = np.array([math.log((1 + len(train)) / (1 + df[t])) + 1 for t in vocabulary])

    def matrix(rs):
        x = np.array([[r[3].count(t) for t in vocabulary] for r in rs]) * idf
        size = np.sqrt((x * x).sum(1, keepdims=True))
        return np.column_stack([np.ones(len(rs)), x / np.where(size > 0, size, 1)])
    x, y = matrix(train), np.array([r[1] for r in train])
    pull = np.diag([0.0] + [reg] * len(vocabulary))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (mu * (1 - mu))[:, None]).T @ x / len(y) + pull, x.T @ (mu - y) / len(y) + pull @ w)
    return dict(zip([None, *vocabulary], w)), 1 / (1 + np.exp(-matrix(rows) @ w))


def test_folds_equal_dense_fits(spark):
    rows = texts()
    odd = [(1000, None, 1, ["red"]), (1001, 2.0, 1, ["red"]), (1002, 1.0, None, ["red"])]
    df = spark.createDataFrame(rows + odd, SCHEMA).repartition(5)
    fit = logit_folds(df, "doc_id", "label", "fold", 4, "tokens", reg=1e-2, tolerance=1e-9)
    coefs = {(r["fold"], r["term"]): r["weight"] for r in fit.coefs.collect()}
    got = {(r["doc_id"], r["fold"]): r for r in fit.predictions.collect()}
    assert len(got) == 4 * len(rows) and fit.passes < 100 and 1 <= fit.best <= 4
    for k in range(4):
        w, scores = dense(rows, k, 1e-2)
        assert {t for f, t in coefs if f == k + 1} == set(w)
        assert max(abs(coefs[k + 1, t] - v) for t, v in w.items()) < 1e-4
        for r, s in zip(rows, scores):
            p = got[r[0], k + 1]
            assert abs(p["score"] - s) < 1e-5 and p["dataset"] == ("test" if r[2] == k else "train") and p["prediction"] == (p["score"] > 0.5)
    support = {(r["fold"], r["dataset"]): r["support"] for r in fit.stats_classes.where("class = '1'").collect()}
    assert support[1, "test"] == sum(r[1] == 1 and r[2] == 0 for r in rows)


def test_rows_without_terms_and_empty_tables(spark):
    rows = texts(40) + [(500, 1.0, 0, []), (501, 0.0, 1, ["unseen"]), (501, 0.0, 1, ["unseen"])]
    fit = logit_folds(spark.createDataFrame(rows, SCHEMA), "doc_id", "label", "fold", 4, "tokens", max_features=3)
    assert fit.predictions.count() == 4 * len(rows) and fit.predictions.where("doc_id = 500 and fold = 2").first()["score"] > 0
    empty = logit_folds(spark.createDataFrame([], SCHEMA), "doc_id", "label", "fold", 3, "tokens")
    assert empty.predictions.count() == 0 and empty.passes == 0
