"""Text classification (C1-C5, W6) and batch scoring.

Training is Spark ML: features (TF-IDF fitted on the train side only, or
sentence vectors) feed any ``pyspark.ml`` classifier. Folds are columns
(``operators.labels``), each fold a fresh fit; a trained model is one pipeline
from tokens to predictions, saved and loaded as a whole. Reports come from one
confusion-table job over all folds and datasets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizerModel, VectorSlicer
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import metrics as M
from cohortlens.operators import text as TXT
from cohortlens.operators.labels import fold_of, split_flag
from cohortlens.session import ensure_checkpoint_dir


@dataclass
class TrainResult:
    model: object
    predictions: DataFrame     # id, label, prediction, dataset (and fold)
    stats_classes: DataFrame   # class report per dataset (and fold)
    stats: DataFrame           # weighted metrics of the test side


def _fit(train: DataFrame, label: str, classifier: Estimator, tokens_col: str | None, features_col: str | None,
         max_features: int, weight_col: str | None) -> PipelineModel:
    """One model from tokens (or features) to predictions: TF-IDF fitted on
    ``train`` and the classifier in one pipeline, which can be saved as it is."""
    feat = features_col if tokens_col is None else "features"
    stages = [] if tokens_col is None else TXT.tfidf_stages(TXT.tfidf_fit(train, tokens_col, max_features), tokens_col, feat)
    if weight_col is not None:
        train = balanced_weights(train, label, weight_col)
    clf = classifier.copy({classifier.getParam("featuresCol"): feat, classifier.getParam("labelCol"): label})
    return PipelineModel([*stages, clf.fit(PipelineModel(stages).transform(train) if stages else train)])


def _predict(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, F.col("prediction").cast("long").alias("prediction"))


def train_classifier(df: DataFrame, id_col: str, label: str, classifier: Estimator, tokens_col: str | None = None,
                     features_col: str | None = None, test_share: float = 0.2, seed: int = 911,
                     max_features: int = 1000, weight_col: str | None = None) -> TrainResult:
    """C1 + C2: hash split, TF-IDF fitted on the train side (``tokens_col``)
    or given feature vectors (``features_col``), fit, predict both sides,
    per-dataset class reports and the test metrics. With ``weight_col`` (the name
    the classifier reads) balanced class weights come from the train side.

    Predictions (an id and two numbers a row) are written to the checkpoint folder
    once, so reports do not score again."""
    ensure_checkpoint_dir(df.sparkSession)
    d = df.withColumn("dataset", F.when(split_flag(id_col, test_share, seed), "test").otherwise("train"))
    train = d.filter(F.col("dataset") == "train")
    model = _fit(train, label, classifier, tokens_col, features_col, max_features, weight_col)
    pred = _predict(model, d, [id_col, label, "dataset"]).select(id_col, label, "prediction", "dataset").checkpoint()
    rep = M.class_report(pred, label, "prediction", by=["dataset"])
    stats = M.perf_metrics(pred.filter(F.col("dataset") == "test"), label, "prediction")
    return TrainResult(model, pred, rep, stats)


def _written_counts(df: DataFrame, keep: Sequence[str], tokens_col: str, vocab: Sequence[TXT.TfidfModel]) -> tuple[DataFrame, dict[str, int]]:
    """``keep`` and the sparse counts of the terms of all ``vocab`` (``_counts``), written to the
    checkpoint folder, so that texts are not read again for each pass of each fold; and the place of each term."""
    terms = sorted({t for m in vocab for t in m.terms()}) or [""]
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/counts-{uuid.uuid4().hex}"
    counted = CountVectorizerModel.from_vocabulary(terms, inputCol=tokens_col, outputCol="_counts").transform(df)
    counted.select(*dict.fromkeys(keep), "_counts").write.parquet(path)
    return df.sparkSession.read.parquet(path), {t: i for i, t in enumerate(terms)}


def classifier_kfold(df: DataFrame, id_col: str, label: str, fold_col: str, n_folds: int, classifier: Estimator,
                     tokens_col: str | None = None, features_col: str | None = None,
                     max_features: int = 1000, parallelism: int = 1, weight_col: str | None = None) -> TrainResult:
    """C4: for each fold, TF-IDF refitted on the other folds and a fresh model;
    stats per fold, dataset and class; the kept model is the best test F1
    (the later fold on ties).

    Term counts of all folds come from one aggregate by (fold, term); the train
    side of a fold is the total without that fold. The rows' counts of the terms of
    all folds are written once, and each fold takes its own terms from them. Folds are independent: with
    ``parallelism > 1`` they are submitted from a small thread pool."""
    from concurrent.futures import ThreadPoolExecutor

    ensure_checkpoint_dir(df.sparkSession)
    vocab = TXT.tfidf_fit_folds(df, tokens_col, fold_col, n_folds, max_features) if tokens_col is not None else None
    feat = features_col if tokens_col is None else "features"
    rows = df
    if vocab is not None:
        rows, place = _written_counts(df, [id_col, label, fold_col], tokens_col, vocab)

    def run(k: int):
        stages = [] if vocab is None else TXT.tfidf_stages(vocab[k], tokens_col, feat)
        d = rows.withColumn("dataset", F.when(F.col(fold_col) == k, "test").otherwise("train"))
        if stages:
            own = VectorSlicer(inputCol="_counts", outputCol="_tf", indices=[place[t] for t in vocab[k].terms()])
            d = PipelineModel([own, *stages[1:]]).transform(d) if vocab[k].terms() else PipelineModel(stages).transform(d.withColumn(tokens_col, F.array().cast("array<string>")))
        train = d.filter(F.col("dataset") == "train")
        if weight_col is not None:
            train = balanced_weights(train, label, weight_col)
        fitted = classifier.copy({classifier.getParam("featuresCol"): feat, classifier.getParam("labelCol"): label}).fit(train)
        p = _predict(PipelineModel([fitted]), d, [id_col, label, "dataset"]).withColumn("fold", F.lit(k + 1)).checkpoint()
        f1 = M.perf_metrics(p.filter(F.col("dataset") == "test"), label, "prediction").first()["f1"]
        return k, f1, PipelineModel([*stages, fitted]), p

    if parallelism > 1:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            results = list(pool.map(run, range(n_folds)))
    else:
        results = [run(k) for k in range(n_folds)]
    results.sort(key=lambda r: r[0])
    best = (-1.0, None)
    for _, f1, model, _ in results:
        if f1 is not None and f1 >= best[0]:
            best = (f1, model)
    allp = results[0][3]
    for r in results[1:]:
        allp = allp.unionByName(r[3])
    rep = M.class_report(allp, label, "prediction", by=["fold", "dataset"])
    stats = M.perf_metrics(allp.filter(F.col("dataset") == "test"), label, "prediction", by=["fold"])
    return TrainResult(best[1], allp, rep, stats)


def run_kfold(df: DataFrame, key: str, n_folds: int, train_fn: Callable, load_fn: Callable | None = None,
              seed: int = 42) -> list:
    """E3 with callables: for each fold, ``load_fn(train, test)`` (if given)
    prepares the two sides and ``train_fn(train, test, fold)`` trains; its results
    are returned in fold order."""
    d = df.withColumn("_fold", fold_of(key, n_folds, seed))
    out = []
    for k in range(n_folds):
        sides = (d.filter(F.col("_fold") != k).drop("_fold"), d.filter(F.col("_fold") == k).drop("_fold"))
        out.append(train_fn(*(load_fn(*sides) if load_fn else sides), k))
    return out


def balanced_weights(df: DataFrame, label: str, out: str = "weight", max_classes: int = 10_000) -> DataFrame:
    """``n / (k * n_class)`` per row (class_weight='balanced'). The counted
    classes, at most ``max_classes`` (more are refused), are written into the
    plan as a lookup; no row is shuffled."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} classes")
    known = [(r[label], r["n"]) for r in counts if r[label] is not None]
    n = sum(c for _, c in known)
    if not known:
        return df.withColumn(out, F.lit(None).cast("double"))
    look = F.create_map(*[F.lit(x) for v, c in known for x in (v, n / (len(known) * c))])
    return df.withColumn(out, F.element_at(look, F.col(label)))


def svm_balanced(features_col: str = "features", label: str = "label", weight: str = "weight",
                 max_iter: int = 100, reg: float = 0.0, parallelism: int = 4) -> Estimator:
    """One-vs-rest linear SVMs with balanced class weights; the per-class
    fits are submitted ``parallelism`` at a time (each is a distributed job)."""
    svc = LinearSVC(maxIter=max_iter, regParam=reg, weightCol=weight)
    return OneVsRest(classifier=svc, featuresCol=features_col, labelCol=label, weightCol=weight,
                     parallelism=parallelism)


def top_features(importances, terms: Sequence[str], spark, k: int = 10) -> DataFrame:
    """The ``k`` (importance, feature) pairs of largest importance (a
    top-k over the model's feature vector)."""
    arr = importances.toArray() if hasattr(importances, "toArray") else np.asarray(importances)
    df = spark.createDataFrame([(str(t), float(v)) for t, v in zip(terms, arr)], "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def save_model(model: PipelineModel, path: str) -> None:
    """Spark's own model format."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def run_saved(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Apply a saved pipeline; predictions stay aligned by row."""
    return model.transform(df).select(*keep, F.col("prediction").cast("long").alias("preds"))


# ------------------------------------------------------------- C6 ----------

def centroid_predict_fn(centroids: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A user model for ``predict_batch_udf``: logits = x . centroid_k.
    (Any function from a feature batch to logits can be plugged in.)"""
    def make():
        C = np.asarray(centroids, dtype=np.float64)

        def predict(x: np.ndarray) -> np.ndarray:
            return x.astype(np.float64) @ C.T
        return predict
    return make


def batch_scores(df: DataFrame, features_col: str, make_predict_fn, dim: int, batch_size: int = 32
                 ) -> DataFrame:
    """Score a user model in Arrow batches (the model is built once per
    Python worker), then class = argmax of the logits and ``probs`` = the
    largest **sigmoid** (not softmax), as the reference reports."""
    scorer = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
                               input_tensor_shapes=[[dim]])
    d = df.withColumn("logits", scorer(F.col(features_col)))
    return d.withColumn("preds", M.argmax_class("logits")) \
            .withColumn("probs", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.array_max("logits"))))


def pipeline_of(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))

