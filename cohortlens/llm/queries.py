"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.licenses import BASE, scan_sql
from cohortlens.llm.repair import repair_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


ROWS_A_BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of fewer rows than Spark's 10,000: a
    batch, what is made of it and a worker's own tables share an executor's
    memory outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered("op1_consistent_hash_ring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents on a ring of 16 shards, row counts one apart at most."""
    from cohortlens.llm.sharding import assign_shards
    utf8 = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    return (assign_shards(docs, "doc_id", 16, tiebreak=("text_crc32", "size"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


@registered("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "ids")


def token_digests(docs: DataFrame) -> DataFrame:
    """``docs`` with ``ids`` (packed, binary), ``n_tokens`` and the digests of ids and decoded bytes."""
    import public_tokenizers
    from cohortlens.llm.bpe import with_token_ids
    short_batches(docs.sparkSession)
    coded = with_token_ids(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                           decoded="_decoded")
    return (coded.withColumn("n_tokens", F.expr("octet_length(ids) div 4").cast("long"))
            .withColumn("ids_sha256", F.sha2("ids", 256)).withColumn("decoded_sha256", F.sha2("_decoded", 256)).drop("_decoded"))


# Bounds of the samples that the two classifiers are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16_384


@registered("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return (docs.select("doc_id", held_out(4, 2).alias("held_out"), quality_score(docs, labels).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


def held_out(modulus: int, remainder: int) -> Column:
    from cohortlens.llm.sample import id_checksum
    return F.coalesce(id_checksum(F.col("doc_id"), modulus) == remainder, F.lit(False))


def quality_score(docs: DataFrame, labels: DataFrame) -> Column:
    """The quality, 0 to 1, of ``docs.text``, by a model of the labelled rows that are not held
    out. Being a column, it meets no column of ``docs``. Null and empty texts score alike; without
    labelled texts (an empty table) every score is 0.5."""
    from cohortlens.llm.quality import fit_quality, score_column
    from cohortlens.llm.sample import labelled_sample
    return score_column(F.col("text"), fit_quality(labelled_sample(docs, labels.where(~held_out(4, 2)), "quality", SAMPLE_ROWS, SAMPLE_BYTES)))


@registered("op7_ordinal_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document: the chance of any, the expected grade, the
    likeliest grade, and 1 where some toxicity is likelier than none."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out(4, 2).alias("held_out"), toxic_chances(docs, labels).alias("at_least"))
    some, strong = F.element_at("at_least", 1), F.element_at("at_least", 2)
    chance = F.array(1 - some, some - strong, strong)
    return scored.select("doc_id", "held_out", some.alias("score"), (some + strong).alias("expected_severity"),
                         (F.array_position(chance, F.array_max(chance)) - 1).cast("int").alias("grade"),
                         (some >= 0.5).cast("int").alias("predicted"))


def toxic_chances(docs: DataFrame, labels: DataFrame) -> Column:
    """The chances that ``docs.text`` has grade 1 or more and grade 2, by a model of the labelled
    rows that are not held out. Being a column, it meets no column of ``docs``. Null texts are empty
    ones; without labelled texts (an empty table) the chances are those of no toxicity."""
    from cohortlens.llm.sample import labelled_sample
    from cohortlens.llm.toxicity import fit_toxicity, grade_column
    return grade_column(F.col("text"), fit_toxicity(labelled_sample(docs, labels.where(~held_out(4, 2)), "toxic", SAMPLE_ROWS, SAMPLE_BYTES)))


@registered("op3_jaccard_groups")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    from cohortlens.llm.jaccard import jaccard_components
    return jaccard_components(table(spark, sf_dir, "documents"))


@registered("op5_suffix_tree_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learned from those not held out."""
    from cohortlens.llm.suffix_tree import score_texts
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 1).alias("held_out"))
    return score_texts(docs, "text", ~F.col("held_out"), ["doc_id", "held_out"])


@registered("op6_cross_polytope")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth id."""
    from cohortlens.llm.neighbours import nearest
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@registered("op8_redirect_equivalence")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    from cohortlens.llm.url_filter import html_edges, judge_urls
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), URL_RULES, html_edges(pages))


@registered("op10_template_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with 1 and the benchmark items it holds, or 0 and none."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def contaminated_ids(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    from cohortlens.llm.decontaminate import leaks
    return leaks(docs, benchmark).select("doc_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    from cohortlens.llm.decontaminate import leaks
    held = (leaks(docs, benchmark).groupBy("doc_id")
            .agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"),
                 F.sum((F.col("kind") == "exact").cast("int")).cast("int").alias("n_exact")))
    return (docs.select("doc_id").join(held, "doc_id", "left")
            .select("doc_id", F.col("item_ids").isNotNull().cast("int").alias("contaminated"),
                    F.coalesce("item_ids", F.expr("array()").cast("array<bigint>")).alias("item_ids"),
                    F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_exact", F.lit(0)).alias("n_exact")))


CHAT_TOOLS = {"reply": {"n_chars": ("integer", True), "text": ("string", True)}, "configure": {"instructions": ("string", True)}}

CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id,
        CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text FROM t WHERE role IN ('user', 'system')),
r AS (SELECT conv_id, turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, text FROM t WHERE role = 'assistant'),
f AS (SELECT conv_id, call_id, min(turn) AS turn, min(name) AS name FROM c GROUP BY 1, 2)
SELECT c.conv_id, c.turn AS at_turn, 0 AS step, 'call' AS kind, c.call_id, c.name,
  CASE WHEN c.text IS NULL THEN CASE c.name WHEN 'reply' THEN 'missing n_chars' ELSE 'missing instructions' END
       WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) THEN 'no result' END AS problem,
  '{"arguments":{' || CASE WHEN c.text IS NULL THEN '' WHEN c.name = 'reply'
      THEN '"n_chars":' || length(c.text) || ',"text":' || CAST(to_json(c.text) AS VARCHAR)
      ELSE '"instructions":' || CAST(to_json(c.text) AS VARCHAR) END
    || '},"id":"' || c.call_id || '","name":"' || c.name || '","type":"tool_call"}' AS json
FROM c
UNION ALL
SELECT r.conv_id, greatest(r.turn, f.turn), 1, 'result', r.call_id, f.name,
  CASE WHEN f.call_id IS NULL THEN 'no call' END,
  '{' || CASE WHEN r.text IS NULL THEN '' ELSE '"content":' || CAST(to_json(r.text) AS VARCHAR) || ',' END
    || '"id":"' || r.call_id || '","type":"tool_result"}'
FROM r LEFT JOIN f ON r.conv_id = f.conv_id AND r.call_id = f.call_id
"""


@registered("op9_tool_call_linking", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls and results: a user's turn calls ``reply`` and a
    system turn ``configure``, under ids made of conversation and turn; an assistant's turn
    is the result of the call in the turn before it."""
    from cohortlens.llm.chat import link_tools
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    asks = F.col("role") == "user"
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(asks, "reply").otherwise("configure").alias("name"),
        F.when(asks, F.to_json(F.struct("text", F.length("text").alias("n_chars"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("instructions")))).alias("arguments"))
    results = turns.where(F.col("role") == "assistant").select(
        "conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return link_tools(calls, results, CHAT_TOOLS)


@registered("op12_structure_repair", repair_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a checksum of its rows, with its faults and its cheapest repair."""
    from cohortlens.llm.repair import damaged, repair_conversations, same, text_digests
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = raw.withColumn("role", spaced("role")).withColumn("text", spaced("text"))
    checksum = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8"))
    repair = repair_conversations(damaged(rows, checksum))
    out = same(same(raw.select("conv_id").distinct(), repair.conversations, ["conv_id"]), text_digests(repair.rows), ["conv_id"])
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(count, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@registered("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 directions of largest variance, whitened."""
    from cohortlens.llm.whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 16)


@registered("op11_license_scan", scan_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases of every document, and the licences that its text names."""
    from cohortlens.llm.licenses import label_list, scan_licenses
    scanned = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    base = F.filter("found", lambda f: f["template"] < BASE)
    starts = F.transform(F.col("base"), lambda f: f["start"])
    return (scanned.withColumn("base", base)
            .select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                    F.array_max(starts).alias("last_word"), label_list(F.col("base")).alias("base_labels"), label_list(F.col("found")).alias("labels"),
                    F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["weight"])), F.lit(0.0)), 6).alias("score")))
