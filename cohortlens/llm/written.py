"""Intermediate tables in the session's checkpoint folder, cleared as they are done with."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """Writes tables as compressed Parquet and reads them back; ``drop`` deletes those
    that nothing unwritten reads any more. Hashes and counts seldom repeat, so no page
    has a dictionary."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(f"{self.folder}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.count}")

    def drop(self, *tables: DataFrame) -> None:
        for path in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_end_with_writes(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that ends in here; what later steps
    need is written before."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)
