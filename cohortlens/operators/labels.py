"""Label coding, splits and folds.

Splits and folds are deterministic functions of a row key and a seed (an md5
hash), so they need no shuffle and no driver state, survive recomputation on a
lost executor unchanged, and are reproducible in SQL. Stratified folds rank
rows inside their label with a distributed running count.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.describe import modal_levels
from cohortlens.operators.joins import join_small
from cohortlens.operators.ranks import positions, running_sums
from cohortlens.session import ensure_checkpoint_dir

# Hash resolution of the split: shares are taken in steps of 1/10000.
SPLIT_RESOLUTION = 10000


def key_hash(key: Column | str, seed: int | str, hex_digits: int = 7) -> Column:
    """Non-negative integer from the first ``hex_digits`` hex digits of
    ``md5('<key>:<seed>')`` (at most 15 digits fit a signed 64-bit value)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("long")


def split_flag(key: Column | str, test_share: float = 0.2, seed: int = 911) -> Column:
    """True for the test side: ``hash % 10000 < share * 10000``."""
    return (key_hash(key, seed) % SPLIT_RESOLUTION) < int(round(test_share * SPLIT_RESOLUTION))


def fold_of(key: Column | str, k: int = 10, seed: int = 42) -> Column:
    """Plain k-fold assignment, ``hash % k`` (0-based)."""
    return (key_hash(key, seed) % k).cast("int")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 10, seed: int = 42, out: str = "fold") -> DataFrame:
    """Within each label, rows ordered by (hash, key) are dealt to folds
    0, 1, ..., k-1 in turn, so every fold gets its share of every label (to
    within one row), as stratified k-fold does. The rank inside a label is a
    distributed running count, so a label that holds half of all rows is spread
    over as many tasks as its share of the partitions. The rows are written once to
    the checkpoint folder; only keys and labels are ordered, and the fold numbers
    are joined back to the rows."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.drop(out).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)  # row numbers are fixed from here on
    d = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label"), "_row", key_hash(key, seed, hex_digits=15).alias("_h"), F.lit(1).alias("_one"))
    r = running_sums(d, "_h", ["_one"], by=["_label"], tiebreak=["_key"])
    folds = r.select("_row", ((F.col("_one_cum") - 1) % k).cast("int").alias(out))
    return rows.join(folds.hint("shuffle_hash"), "_row").drop("_row")


def label_codes(df: DataFrame, label: str, out: str = "code", binary: bool = False) -> DataFrame:
    """L1: ``binary``: the modal label (smallest on ties) gives 0, others 1.
    Otherwise codes by sorted order of the distinct labels from 0, null -1
    (numeric non-negative labels are left as they are)."""
    dtype = dict(df.dtypes)[label]
    if binary:
        mode = modal_levels(df, [label])[label]
        return df.withColumn(out, F.when(F.col(label).cast("string") == F.lit(mode), 0).otherwise(1))
    if dtype in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        mn = df.agg(F.min(label).alias("m")).first()["m"]
        if mn is not None and mn >= 0:
            return df.withColumn(out, F.col(label))
    return join_small(df, code_table(df, label, out), label, "left").withColumn(
        out, F.coalesce(F.col(out), F.lit(-1).cast("long")))


def code_table(df: DataFrame, label: str, out: str = "code") -> DataFrame:
    """The ``(label, code)`` correspondence of ``label_codes``."""
    return positions(df.select(label).filter(F.col(label).isNotNull()).distinct(), label, out)


def with_folds_exploded(df: DataFrame, fold_col: str, k: int) -> DataFrame:
    """Each row once per fold number ``0..k-1`` with ``dataset`` = ``'test'``
    in its own fold and ``'train'`` elsewhere: all folds in one job."""
    return df.withColumn("fold_nb", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) \
             .withColumn("dataset", F.when(F.col("fold_nb") == F.col(fold_col), "test").otherwise("train"))


def keys_in(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]
