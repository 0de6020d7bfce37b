"""Bounded labelled samples, and filters on the checksum of an id."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_checksum(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, max_bytes: int) -> DataFrame:
    """At most ``rows_per_class`` labelled documents of each class (0, 1), as
    ``y`` and ``text``, taken in the order of a hash of the id.

    Both bounds are parameters: they limit what a model is fitted on, and so
    what the fitting task holds (``2 * rows_per_class * max_bytes``), never what it
    is applied to. Rows with a null id or label, another class, or a text over
    ``max_bytes`` are not drawn; an id with several labels counts with the
    smallest; of several documents with one id, each may be drawn.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
             .groupBy("doc_id").agg(F.min(label).alias("y")))
    short = (docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= max_bytes))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))

    def drawn(y: int) -> DataFrame:
        # twice the rows are named, since some have no text here or a long one
        named = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(2 * rows_per_class)
        return short.join(F.broadcast(named), "doc_id").orderBy(order, "doc_id", "text").limit(rows_per_class)

    return drawn(0).unionByName(drawn(1)).select("y", F.coalesce("text", F.lit("")).alias("text"))


def fitted(sample: DataFrame, fit: Callable):
    """What ``fit`` makes of a bounded table of ``y`` and ``text``, in the order of its rows. It runs in
    a task: the driver's Python holds neither the texts nor the memory that fitting takes."""
    ordered = sample.select("y", "text", F.xxhash64("text").alias("h")).repartition(1).sortWithinPartitions("y", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held)
            model = fit(rows["text"], np.asarray(rows["y"].to_numpy(), np.int64))
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    row = ordered.mapInArrow(run, "model binary").first()
    return pickle.loads(row["model"]) if row else fit(pa.array([], pa.string()), np.zeros(0, np.int64))
