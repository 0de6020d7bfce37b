"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``docs``, as they came; the last adds ``ids``, ``n_tokens``, ``ids_sha256`` and
``decoded_sha256``, and a column that came with one of these names goes on as ``<name>_before``.
Empty tables stay empty and null texts are empty texts. Rows are known by a hash of id and
text, so rows with a null id, and several texts under one id, are judged each by its own text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.queries import contaminated_ids, quality_score, table, token_digests, toxic_chances


def _keyed(docs: DataFrame) -> tuple[str, DataFrame]:
    """A name that no column has, and ``docs`` with a hash of id and text under it."""
    key = "_row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return key, docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores 0.7 or more."""
    return docs.where(quality_score(docs, table(spark, sf_dir, "labels")) >= 0.7)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no toxicity is likelier than some."""
    return docs.where(F.element_at(toxic_chances(docs, table(spark, sf_dir, "labels")), 1) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id
    (null ids last, then the smallest hash); of rows that repeat an id and text, one."""
    from cohortlens.llm.jaccard import jaccard_components
    key, keyed = _keyed(docs)
    groups = jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key))[key]
    kept = keyed.select("doc_id", key).join(groups, key).groupBy("component_id").agg(first.alias(key)).select(key)
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    key, keyed = _keyed(docs)
    held = contaminated_ids(keyed.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(held.select(F.col("doc_id").alias(key)), key, "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the packed token ids of each text, how many they are, and their digests."""
    made = ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "_decoded")
    return token_digests(docs.withColumnsRenamed({c: f"{c}_before" for c in docs.columns if c.lower() in made}))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("tokens", tokens)]

# Fitted models and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder."""
    from cohortlens.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
