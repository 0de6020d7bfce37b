"""Sources, sinks and small operators on the test tables: files are written by Spark from a
given table into the session's checkpoint folder and read back (S1, S4, S7, S9, A9, P25, P26, T9, J2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import describe as D
from cohortlens.operators import joins as J
from cohortlens.operators import metrics as M
from cohortlens.operators import text as T
from cohortlens.functions import columns as C
from cohortlens.plans.registry import query
from cohortlens.plans.text_queries import CLEAN_SQL, TOKEN
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import tables as S


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("csv_scan", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer
""")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV files with a header and scanned with a schema."""
    from pyspark.sql.types import StructType
    folder, schema = _folder(spark), StructType.fromDDL(_CUSTOMER)
    S.write_stats_csv(S.read_table(spark, sf_dir, "customer").select(*schema.fieldNames()), folder)
    return S.read_csv(spark, folder, schema)


@query("csv_scan_second_line", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer
""")
def csv_scan_second_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 with the names on the second line: each file begins with a line of another kind."""
    from pyspark.sql.types import StructType
    folder, schema = _folder(spark), StructType.fromDDL(_CUSTOMER)
    rows = S.read_table(spark, sf_dir, "customer").select(*schema.fieldNames()).select(F.to_csv(F.struct(*schema.fieldNames())).alias("value"))
    # each task's first line says what the file is, the second names the columns
    names = ",".join(schema.fieldNames())
    head = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = rows.select(F.explode(F.when(head, F.array(F.lit("export of customers"), F.lit(names), "value")).otherwise(F.array("value"))).alias("value"))
    lines.write.text(folder)
    return S.read_csv(spark, folder, schema, header_line=1)


@query("word_vector_table", """
SELECT CAST(vec_id AS VARCHAR) AS word, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE), 6)) AS vec FROM embeddings
""")
def word_vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word-vector table written and loaded by its column names."""
    folder = _folder(spark)
    S.read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.col("embedding").alias("v")).write.parquet(folder)
    return T.read_word_vectors(spark, folder, "token", "v").select("word", F.transform("vec", lambda v: F.round(v.cast("double"), 6)).alias("vec"))


@query("class_report_csv", """
WITH p AS (SELECT l_returnflag AS truth, CASE WHEN l_quantity > 25 THEN 'R' ELSE l_returnflag END AS guess FROM lineitem),
c AS (SELECT x.label, count(*) FILTER (truth = x.label AND guess = x.label)::DOUBLE AS hit, count(*) FILTER (guess = x.label)::DOUBLE AS said,
  count(*) FILTER (truth = x.label) AS support FROM p, (SELECT DISTINCT truth AS label FROM p) x GROUP BY x.label)
SELECT label AS class, round(coalesce(hit / nullif(said, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall, support FROM c
""")
def class_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-class report written as CSV with a header and read back."""
    folder = _folder(spark)
    p = S.read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"),
                                                       F.when(F.col("l_quantity") > 25, "R").otherwise(F.col("l_returnflag")).alias("guess"))
    S.write_stats_csv(M.class_report(p, "truth", "guess"), folder)
    back = S.read_csv(spark, folder).where(~F.col("class").isin("accuracy", "macro avg", "weighted avg"))
    return back.select(F.col(back.columns[0]).cast("string").alias("class"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                       F.col("support").cast("long").alias("support"))


@query("row_slice", """
SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos >= 100 AND pos < 2600
""")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 100 to 2,599 of the events by id."""
    return S.row_slice(S.read_table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id", 100, 2600)


@query("stacked_counts", """
SELECT event_type AS level, count(*) AS n, NULL::DOUBLE AS mean FROM events GROUP BY event_type
UNION ALL SELECT l_returnflag, count(*), NULL FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'all', NULL, round(avg(value), 6) FROM events
""")
def stacked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three result tables stacked by column name, what one lacks being null."""
    ev, li = S.read_table(spark, sf_dir, "events"), S.read_table(spark, sf_dir, "lineitem")
    return J.stack([D.value_counts(ev, "event_type").select(F.col("event_type").alias("level"), F.col("n").cast("long").alias("n")),
                    D.value_counts(li, "l_returnflag").select(F.col("l_returnflag").alias("level"), F.col("n").cast("long").alias("n")),
                    ev.agg(F.round(F.avg("value"), 6).alias("mean")).select(F.lit("all").alias("level"), "mean")])


@query("stars_and_exponents", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_tax / 2 <= 0.001 THEN '***' WHEN l_tax / 2 <= 0.01 THEN '**' WHEN l_tax / 2 <= 0.05 THEN '*' ELSE '' END AS stars,
  CASE WHEN l_discount = 0 THEN '' WHEN l_discount <= 0.001 THEN '***' WHEN l_discount <= 0.01 THEN '**' WHEN l_discount <= 0.05 THEN '*' ELSE '' END AS stars_of_nulls,
  round(exp(l_discount - l_tax), 9) AS ratio FROM lineitem
""")
def stars_and_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25 on shares as p-values (null and NaN have no star), P26: the inverse of a logarithm."""
    li = S.read_table(spark, sf_dir, "lineitem")
    p = F.when(F.col("l_discount") == 0, F.when(F.col("l_linenumber") % 2 == 0, float("nan"))).otherwise(F.col("l_discount"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", C.p_value_sig(F.col("l_tax") / 2).alias("stars"), C.p_value_sig(p).alias("stars_of_nulls"),
                     F.round(C.log_inverse(F.col("l_discount") - F.col("l_tax")), 9).alias("ratio"))


@query("tokenize_by_name", f"""
SELECT doc_id, 'clean' AS mode, {CLEAN_SQL} AS tokens FROM documents
UNION ALL SELECT doc_id, 'wos', regexp_extract_all(text, '{TOKEN}') FROM documents
UNION ALL SELECT doc_id, 'low_wos', regexp_extract_all(lower(text), '{TOKEN}') FROM documents
""")
def tokenize_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokeniser picked by the name of its mode."""
    docs = S.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return J.stack([T.tokenize_df(docs, "text", mode).select("doc_id", F.lit(mode).alias("mode"), "tokens") for mode in ("clean", "wos", "low_wos")])


@query("unknown_flag_dropped", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS clicked, CASE WHEN event_type <> 'click' THEN 1 ELSE 0 END AS other FROM events
""")
def unknown_flag_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2's last step: a flag of unknowns on which all rows agree is left out."""
    ev = S.read_table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").cast("int").alias("clicked"),
                                                      (F.col("event_type") != "click").cast("int").alias("other"))
    return J.with_unknown_flag(ev, ["clicked", "other"], drop_constant=True)
