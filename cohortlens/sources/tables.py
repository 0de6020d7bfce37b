"""Sources and sinks.

Every reader returns a lazy DataFrame, so column pruning and filters reach the
Parquet scan. Sinks write partitioned output through Spark's own writers.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cohortlens.operators.joins import join_small

TEST_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()


# Tables whose rows carry whole texts: per-row work on them is CPU-heavy.
TEXT_TABLES = frozenset({"documents", "conversations", "pages", "benchmark"})


def read_table(spark: SparkSession, sf_dir: str, name: str, spread: bool | None = None) -> DataFrame:
    """One named table of a study folder (``{dir}/{name}.parquet``).

    ``spread`` (default: on for text tables) spreads a scan that yields fewer
    partitions than the cluster has cores (one large row group) so that
    regex and array work runs on every core. At scale a scan already has
    thousands of partitions and nothing is added.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread is None:
        spread = name in TEXT_TABLES
    return spread_scan(df) if spread else df


def spread_scan(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than
    the default parallelism (decided at planning time, no job)."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def read_study(spark: SparkSession, sf_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Several named tables at once, as a dict of lazy DataFrames."""
    return {n: read_table(spark, sf_dir, n) for n in names}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             header_line: int = 0) -> DataFrame:
    """CSV scan with names on line ``header_line`` (0-based).

    ``header_line=0`` is Spark's own header handling. With ``header_line > 0``
    the lines above the name line are junk: every column is read as text,
    the name line of each file is found by its values, and each file keeps
    only the lines after it (row positions from ``monotonically_increasing_id``,
    which follows file order inside a split; one small row per file decides
    the cut). A file without such a line is an error. Then the columns are cast to
    ``schema``.
    """
    if header_line == 0:
        r = spark.read.option("header", True)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return r.csv(path)
    if schema is None:
        raise ValueError("header_line > 0 needs an explicit schema")
    names = [f.name for f in schema.fields]
    text_schema = StructType([StructField(n, StringType()) for n in names])
    raw = (spark.read.option("header", False).schema(text_schema).csv(path)
                .withColumn("_f", F.col("_metadata.file_path")).withColumn("_i", F.monotonically_increasing_id()))
    is_names = F.lit(True)
    for n in names:
        is_names = is_names & (F.col(n) == F.lit(n))
    cut = raw.filter(is_names).groupBy("_f").agg(F.min("_i").alias("_h"))
    files = raw.select("_f").distinct().join(cut, "_f", "left_anti").limit(1).collect()
    if files:
        raise ValueError(f"no line of {files[0]['_f']} holds the column names {names}")
    body = join_small(raw, cut, "_f").filter(F.col("_i") > F.col("_h"))
    return body.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def select_roles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """S3 core: keep the named columns, de-duplicated in first-seen order.
    If any is missing, keep all columns (the reference reports and keeps all)."""
    cols = list(dict.fromkeys(c for c in columns if c is not None))
    missing = [c for c in cols if c not in df.columns]
    if missing or not cols:
        return df
    return df.select(*cols)


def write_token_lines(df: DataFrame, tokens_col: str, path: str) -> None:
    """One line per row, tokens joined by a tab."""
    (df.select(F.concat_ws("\t", F.col(tokens_col)).alias("value"))
       .write.mode("overwrite").text(path))


def write_stats_csv(df: DataFrame, path: str) -> None:
    """A per-class statistics table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def row_slice(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows at positions ``start <= pos < stop`` in the order of the unique
    numeric ``key``, nulls first (never a bare ``limit``).

    The keys at both ends are found from sketches and counts (``ranks.keys_at``), so the slice is a
    filter on the key: no row is shuffled or written, and the filter reaches the scan. Only where the key
    is not unique, or the slice begins or ends among null keys, are rows numbered by running counts."""
    from cohortlens.operators.ranks import keys_at, running_sums
    start, k = max(start, 0), F.col(f"`{key}`")
    if stop <= start:
        return df.limit(0)
    nulls = df.where(k.isNull()).count()
    among_nulls = 0 < start < nulls or stop < nulls
    ends = None if among_nulls else keys_at(df, key, [max(start - nulls, 0), stop - nulls])
    if ends is None:
        r = running_sums(df.withColumn("_one", F.lit(1)), key, ["_one"])
        return r.filter((F.col("_one_cum") > start) & (F.col("_one_cum") <= stop)).drop("_one", "_one_cum")
    low, high = ends  # the first key inside and the first one after; None: none is
    inside = F.lit(False) if low is None else k >= low
    if high is not None:
        inside = inside & (k < high)
    return df.where(F.coalesce(inside, F.lit(False)) | k.isNull() if start == 0 else inside)
