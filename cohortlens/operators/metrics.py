"""Classification and regression metrics.

Every report starts from one confusion table ``groupBy(by..., label, pred)``
(partial aggregation; its size is classes^2 x groups), so all folds, datasets
and batches are one job. Undefined ratios are 0, as with zero_division=0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ranks import ranked_value

# Names of the summary rows of a class report (fixed values).
ACCURACY, MACRO, WEIGHTED = "accuracy", "macro avg", "weighted avg"


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Cells of the confusion table; ``weight``: a column of row counts, where
    ``df`` is already counted."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*by, F.col(label).cast("string").alias("label"), F.col(pred).cast("string").alias("pred")).agg(n.alias("n"))


def fold_cells(df: DataFrame, label: str, pred: str, fold_col: str, k: int) -> DataFrame:
    """(fold_nb, dataset, label, pred, n) for all folds from one count by (fold,
    label, prediction): the test side of a fold is its own cells, the train side
    everybody else's. Only the counted cells are copied, never the rows."""
    cells = confusion(df, label, pred, [fold_col])
    return (cells.withColumn("fold_nb", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
            .withColumn("dataset", F.when(F.col("fold_nb") == F.col(fold_col), "test").otherwise("train"))
            .groupBy("fold_nb", "dataset", "label", "pred").agg(F.sum("n").alias("n")))


def per_class(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., class, tp, support, predicted, precision, recall, f1); classes =
    union of labels and predictions."""
    by = list(by)
    conf = confusion(df, label, pred, by, weight)
    zero = F.lit(0).cast("long")
    # each confusion cell counts once for its true class and once for its
    # predicted class: one explode of two tagged structs, one aggregate
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(zero).alias("tp"),
                 zero.alias("predicted")),
        F.struct(F.col("pred").alias("class"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("predicted")))
    e = conf.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*")
    s = e.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    p = _div(F.col("tp"), F.col("predicted"))
    r = _div(F.col("tp"), F.col("support"))
    s = s.withColumn("precision", p).withColumn("recall", r)
    return s.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def class_report(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M2: per class precision, recall, f1-score, support, then the
    ``accuracy`` row (accuracy repeated in all four columns, as the original
    table shows it), ``macro avg`` and ``weighted avg``.

    One pass over the per-class table: ``GROUPING SETS ((by, class), (by))``
    gives the class rows and the group totals together, and each group row is
    exploded into its three summary rows (no union of re-computed branches)."""
    by = list(by)
    pc = per_class(df, label, pred, by, weight)
    g = pc.groupingSets([[*by, "class"], by], *by, "class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("sup"), F.sum("predicted").alias("prd"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
        F.grouping("class").alias("_gc"))
    n = F.col("sup").cast("double")
    p, r = _div(F.col("tp"), F.col("prd")), _div(F.col("tp"), F.col("sup"))
    f1 = _div(2 * p * r, p + r)

    def row(name, pr, rc, f, su):
        return F.struct(name.alias("class"), pr.cast("double").alias("precision"), rc.cast("double").alias("recall"),
                        f.cast("double").alias("f1_score"), su.cast("double").alias("support"))

    acc = F.col("tp") / n
    summary = F.array(row(F.lit(ACCURACY), acc, acc, acc, acc),
                      row(F.lit(MACRO), F.col("mp"), F.col("mr"), F.col("mf"), n),
                      row(F.lit(WEIGHTED), F.col("wp") / n, F.col("wr") / n, F.col("wf") / n, n))
    rows = F.when(F.col("_gc") == 0, F.array(row(F.col("class"), p, r, f1, n))).otherwise(summary)
    return g.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def perf_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """M1: accuracy and weighted F1, precision, recall per group."""
    by = list(by)
    pc = per_class(df, label, pred, by, weight)
    return pc.groupBy(*by).agg(
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
        (F.sum("tp") / F.sum("support")).alias("acc"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("p"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("r"))


def argmax_class(logits: Column | str) -> Column:
    """Class = position of the largest logit (first on ties), 0-based."""
    c = F.col(logits) if isinstance(logits, str) else logits
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def merge_batch_weighted(batches: DataFrame, metrics: Sequence[str] = ("f1", "precision", "recall")) -> DataFrame:
    """Per class, each metric weighted by its batch support; support summed.
    Classes whose metric is 0 throughout are kept (the original's Counter
    arithmetic lost them)."""
    return batches.groupBy("class").agg(
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in metrics],
        F.sum("support").alias("support"))


def merge_batch_plain(batches: DataFrame, metrics: Sequence[str] = ("f1", "precision", "recall")) -> DataFrame:
    """Per class, mean of the non-zero batch values (zeros read as
    missing); support summed."""
    return batches.groupBy("class").agg(
        *[F.avg(F.nullif(F.col(m), F.lit(0.0))).alias(m) for m in metrics], F.sum("support").alias("support"))


def best_run(stats: DataFrame, run: str = "fold", score: str = "f1") -> DataFrame:
    """The run with the highest score; the later run wins ties."""
    return stats.agg(F.max_by(F.col(run), F.struct(F.col(score), F.col(run))).alias(run),
                     F.max(score).alias(score))


def regression_results(df: DataFrame, y_true: str, y_pred: str, digits: int = 4) -> DataFrame:
    """Explained variance, mean squared log error, R2, MAE, MSE, RMSE
    (rounded to ``digits``) in one aggregate, and the exact median absolute error
    by distributed ranks of the distinct errors."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    e = y - p
    a = df.agg(F.var_pop(e).alias("ve"), F.var_pop(y).alias("vy"), F.avg(F.abs(e)).alias("mae"),
               F.avg(e * e).alias("mse"), F.avg(F.pow(F.log1p(y) - F.log1p(p), 2)).alias("msle"))
    median = ranked_value(df.select(F.abs(e).alias("_e")), "_e", [0.5])[0]
    r = lambda c: F.round(c, digits)
    return a.select(r(1 - F.try_divide(F.col("ve"), F.col("vy"))).alias("explained_variance"),
                    r(F.col("msle")).alias("mean_squared_log_error"),
                    r(1 - F.try_divide(F.col("mse"), F.col("vy"))).alias("r2"),
                    r(F.col("mae")).alias("mean_abs_err"), r(F.col("mse")).alias("mean_sq_err"),
                    r(F.sqrt("mse")).alias("root_mse"), F.lit(median).cast("double").alias("median_abs_err"))


def rounded_class_report(df: DataFrame, y_true: str, y_pred: str, divisor: float | None = None,
                         by: Sequence[str] = ()) -> DataFrame:
    """Class report of rounded predictions against the rounded target
    (half to even, as numpy), or of values rounded down to a multiple of
    ``divisor``. The truth/prediction order is the right one here; the
    original passed them swapped, which exchanges precision and recall."""
    from cohortlens.functions.columns import round_down
    if divisor is None:
        t, p = F.bround(F.col(y_true), 0).cast("long"), F.bround(F.col(y_pred), 0).cast("long")
    else:
        t, p = round_down(F.col(y_true), divisor), round_down(F.col(y_pred), divisor)
    d = df.select(*by, t.alias("_t"), p.alias("_p"))
    return class_report(d, "_t", "_p", by)

