"""Cross-validated logistic regression over texts, all folds in the same passes (C4).

A pass over the rows answers every fold: a row adds to the loss and the gradient of each fold
but its own, with that fold's TF-IDF weights, and one grouped sum of the tasks' partial gradients
serves all optimisers. The texts are read twice whatever the number of folds, for term
counts and for the table of sparse counts that the passes read. Passes are those of
the fold that converges last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import metrics as M
from cohortlens.operators import text as TXT
from cohortlens.session import ensure_checkpoint_dir, short_batches

MEMORY = 8  # steps that the optimiser remembers


@dataclass
class FoldFits:
    """``coefs``: (fold, term, weight), the constant as a null term; ``predictions``: (id, label, prediction,
    score, fold, dataset); reports by fold and dataset; ``best``: the fold with the best test F1 (the later on ties)."""
    coefs: DataFrame
    predictions: DataFrame
    stats_classes: DataFrame
    stats: DataFrame
    best: int
    passes: int


def _lbfgs(size: int, max_iter: int, tolerance: float):
    """Minimiser that asks: yields weights, is sent (value, gradient), and returns the best weights."""
    w = np.zeros(size)
    value, grad = yield w
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max() <= tolerance * max(1.0, abs(value)):
            break
        d, alphas = -grad, []
        for s, y in reversed(moves):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d = d - a * y
        if moves:
            s, y = moves[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.sqrt(grad @ grad))
        for (s, y), a in zip(moves, reversed(alphas)):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0
        while True:
            new_value, new_grad = yield w + step * d
            if new_value <= value + 1e-4 * step * (grad @ d) or step < 1e-8:
                break
            step /= 2
        if new_value >= value:
            break
        s, y = step * d, new_grad - grad
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves, (s, y)][-MEMORY:]
        w, value, grad = w + s, new_value, new_grad
    return w


def _short(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows: every entry of a part takes several arrays."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def _sparse(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of every entry of the batch's sparse rows."""
    lists = batch.column(2)
    lengths = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(batch)), lengths)
    return row, lists.flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)


def _scaled(row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """TF-IDF of a fold for each entry, rows of length one (rows without a known term: zeros)."""
    x = count * idf[term]
    size = np.sqrt(np.bincount(row, x * x, n))
    return x / np.where(size > 0, size, 1.0)[row]


def _margins(w: np.ndarray, row, term, x, n: int) -> np.ndarray:
    return np.bincount(row, x * w[1:][term], n) + w[0]


def logit_folds(df: DataFrame, id_col: str, label: str, fold_col: str, n_folds: int, tokens_col: str, max_features: int = 1000,
                reg: float = 1e-3, max_iter: int = 100, tolerance: float = 1e-7) -> FoldFits:
    """Binary logistic regression (label 0 or 1) on TF-IDF, refitted for each fold on the other folds' rows.

    The loss is the mean log loss plus ``reg / 2`` times the squared weights (not the constant).
    Rows with another label, or without one, or without a fold take no part; a row without known
    terms is scored by the constant. Ids may repeat; each row counts. An empty table gives empty
    results. The sparse counts are written to the session's checkpoint folder.
    """
    spark = df.sparkSession
    short_batches(spark)
    rows = df.where(F.col(label).isin(0, 1) & F.col(fold_col).isNotNull())
    fitted = TXT.tfidf_fit_folds(rows, tokens_col, fold_col, n_folds, max_features)
    terms = sorted({t for m in fitted for t in m.terms()}) or [""]
    index, p = {t: i for i, t in enumerate(terms)}, len(terms)
    idf = np.zeros((n_folds, p))  # a term outside a fold's vocabulary weighs nothing in it
    for k, m in enumerate(fitted):
        for t, v in zip(m.terms(), m.idf()):
            idf[k, index[t]] = v
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens_col, outputCol="_tf").transform(rows)
    folder = f"{ensure_checkpoint_dir(spark)}/folds-{uuid.uuid4().hex}"
    (counted.select(F.col(label).cast("double").alias("y"), F.col(fold_col).cast("int").alias("fold"), F.unwrap_udt("_tf").alias("v"),
                    F.col(id_col).alias("id")).select("y", "fold", "v.indices", "v.values", "id").write.parquet(folder))
    table = spark.read.parquet(folder)
    sizes = {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    passes = 0

    def gradients(asked: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(p + 2) for k in asked}  # loss, constant, terms
            for batch in _short(batches):
                n, y, fold = len(batch), batch.column(0).to_numpy(), batch.column(1).to_numpy()
                row, term, count = _sparse(batch)
                for k, w in asked.items():
                    x, trains = _scaled(row, term, count, idf[k], n), fold != k
                    z = _margins(w, row, term, x, n)
                    sums[k][0] += (np.logaddexp(0.0, z) - y * z)[trains].sum()
                    r = np.where(trains, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y, 0.0)
                    sums[k][1] += r.sum()
                    sums[k][2:] += np.bincount(term, x * r[row], p)
            at = {k: np.flatnonzero(v) for k, v in sums.items()}
            yield pa.record_batch([pa.array(np.concatenate([np.full(len(i), k, np.int32) for k, i in at.items()])),
                                   pa.array(np.concatenate(list(at.values()))), pa.array(np.concatenate([sums[k][i] for k, i in at.items()]))],
                                  names=["k", "i", "v"])
        return run

    def answer(asked: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        out = {k: np.zeros(p + 2) for k in asked}
        found = (table.select("y", "fold", "indices", "values").mapInArrow(gradients(asked), "k int, i long, v double")
                 .groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow())  # terms x folds at most
        for k, i, v in zip(*(found[c].to_numpy() for c in ("k", "i", "v"))):
            out[k][i] = v
        answers = {}
        for k, w in asked.items():
            n = total - sizes.get(k, 0)
            pull = np.concatenate(([0.0], reg * w[1:]))
            answers[k] = (out[k][0] / n + reg / 2 * float(w[1:] @ w[1:]), out[k][1:] / n + pull)
        return answers

    weights = {k: np.zeros(p + 1) for k in range(n_folds)}
    going = {k: _lbfgs(p + 1, max_iter, tolerance) for k in range(n_folds) if total > sizes.get(k, 0)}
    asked = {k: next(g) for k, g in going.items()}
    while asked:
        passes += 1
        answers, asked = answer(asked), {}
        for k, a in answers.items():
            try:
                asked[k] = going[k].send(a)
            except StopIteration as e:
                weights[k] = e.value

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _short(batches):
            n, fold = len(batch), batch.column(1).to_numpy()
            row, term, count = _sparse(batch)
            for k in range(n_folds):
                z = _margins(weights[k], row, term, _scaled(row, term, count, idf[k], n), n)
                yield pa.record_batch([batch.column(4), pa.array(batch.column(0).to_numpy().astype(np.int64)), pa.array((z > 0).astype(np.int64)),
                                       pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500)))), pa.array(np.full(n, k + 1, np.int32)),
                                       pa.array(np.where(fold == k, "test", "train"))], names=["id", "label", "prediction", "score", "fold", "dataset"])

    kind = dict(table.dtypes)["id"]
    scored = (table.select("y", "fold", "indices", "values", "id")
              .mapInArrow(score, f"id {kind}, label long, prediction long, score double, fold int, dataset string"))
    scored.write.parquet(f"{folder}-scores")
    scored = spark.read.parquet(f"{folder}-scores").withColumnsRenamed({"id": id_col, "label": label})
    report = M.class_report(scored, label, "prediction", by=["fold", "dataset"])
    stats = M.perf_metrics(scored.where(F.col("dataset") == "test"), label, "prediction", by=["fold"])
    f1 = {r["fold"]: r["f1"] for r in stats.collect()}
    best = max((k for k in f1 if f1[k] is not None), key=lambda k: (f1[k], k), default=0)
    rows_out = [(k + 1, t, float(v)) for k in range(n_folds) for t, v in zip([None, *terms], weights[k]) if t is None or idf[k, index[t]] > 0]
    return FoldFits(spark.createDataFrame(rows_out, "fold int, term string, weight double"), scored, report, stats, best, passes)

