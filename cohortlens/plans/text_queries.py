"""Text, label, split and metric queries (section 7.5, text rows).

Text stand-in: ``documents`` (+ ``labels``); word vectors: the k-th word of the
sorted document vocabulary takes ``embeddings`` row ``vec_id = k``;
``conversations`` is the "new text" scored against that vocabulary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import text as TX
from cohortlens.operators import labels as L
from cohortlens.operators import metrics as M
from cohortlens.operators import text as T
from cohortlens.plans.registry import query
from cohortlens.sources.tables import read_table

WS = TX.WS_CLASS
WORD = TX.WORD
TOKEN = TX.TOKEN_PATTERN
SNIPPET_KEYWORDS = ["the", "und", "que", "les", "Der"]
EMB_DIM = 64


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def split_sql(expr: str) -> str:
    """DuckDB form of Python's ``str.split()``."""
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), lambda x: x <> '')"


def round_arr(c: str):
    return F.transform(F.col(c), lambda x: F.round(x, 6)).alias(c)


# ------------------------------------------------------------- T1-T3 -------

@query("clean_text", f"""
SELECT doc_id, substring(lower(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')), 1, 1000) AS clean
FROM documents
""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strip (Unicode blanks), lower, first 1000 characters."""
    return docs(spark, sf_dir).select("doc_id", TX.clean_text("text", 0, 1000).alias("clean"))


# offset of the first 'the'; the start of the text where there is none
KW_POS = "greatest(instr(lower(text), 'the') - 1, 0)"


@query("keyword_context", f"""
WITH d AS (SELECT doc_id, text, {KW_POS} AS pos FROM documents),
s AS (SELECT doc_id, pos, {split_sql("substring(text, 1, pos)")} AS l,
             {split_sql("substring(text, pos + 1)")} AS r FROM d)
SELECT doc_id, pos, list_concat(list_slice(l, greatest(1, len(l) - 15 + 1), len(l)), list_slice(r, 1, 16)) AS window
FROM s
""")
def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 words either side of the first 'the' (character offset from locate);
    a text without it gives its first words."""
    d = docs(spark, sf_dir).withColumn("pos", F.expr(KW_POS))
    return d.select("doc_id", "pos", TX.center_text("text", F.col("pos"), 15).alias("window"))


@query("first_tokens", f"""
SELECT doc_id, list_slice({split_sql("text")}, 1, 50) AS tokens FROM documents
""")
def first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 50 whitespace tokens."""
    return docs(spark, sf_dir).select("doc_id", TX.first_tokens("text", 50).alias("tokens"))


# ------------------------------------------------------------- T4, J9 ------

_KW_VALUES = ", ".join(f"('{k}')" for k in SNIPPET_KEYWORDS)


@query("keyword_snippets", f"""
WITH d AS (SELECT doc_id, lower(text) AS doc FROM documents),
k AS (SELECT * FROM (VALUES {_KW_VALUES}) AS v(keyword)),
h AS (SELECT doc_id, doc, keyword, instr(doc, keyword) - 1 AS i FROM d, k)
SELECT doc_id, keyword, i AS position,
       substring(doc, greatest(0, i - 200) + 1, greatest(0, i + 10 + 200) - greatest(0, i - 200)) AS snippet
FROM h WHERE i >= 0
""")
def keyword_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 + J9: 200-character windows around each keyword's first hit."""
    return T.keyword_snippets(docs(spark, sf_dir), "text", SNIPPET_KEYWORDS, id_col="doc_id", num_chars=200)


@query("keyword_snippets_words", f"""
WITH d AS (SELECT doc_id, lower(text) AS doc FROM documents),
k AS (SELECT * FROM (VALUES {_KW_VALUES}) AS v(keyword)),
h AS (SELECT doc_id, doc, keyword, instr(doc, keyword) - 1 AS i FROM d, k),
s AS (SELECT doc_id, keyword, i, {split_sql("substring(doc, 1, i)")} AS l, {split_sql("substring(doc, i + 1)")} AS r
      FROM h WHERE i >= 0)
SELECT doc_id, keyword, i AS position,
       array_to_string(list_concat(list_slice(l, greatest(1, len(l) - 5 + 1), len(l)), list_slice(r, 1, 6)), ' ')
         AS snippet
FROM s
""")
def keyword_snippets_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 word form: 5 words before each keyword's first hit and 6 from it."""
    return T.keyword_snippets(docs(spark, sf_dir), "text", SNIPPET_KEYWORDS, id_col="doc_id", num_words=5)


# ------------------------------------------------------------- T5, T7, S6 --

CLEAN_SQL = f"regexp_extract_all(lower(text), '{WORD}+')"


@query("tokens_clean", f"SELECT doc_id, {CLEAN_SQL} AS tokens FROM documents")
def tokens_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 'clean': lower-cased word tokens, punctuation dropped."""
    return docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))


@query("tokens_wos", f"SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS tokens FROM documents")
def tokens_wos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 'wos': tokens as written, punctuation kept, no blanks."""
    return docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "wos").alias("tokens"))


@query("tokens_lower_wos", f"SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS tokens FROM documents")
def tokens_lower_wos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 'low_wos': lower-cased tokens, punctuation kept."""
    return docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "low_wos").alias("tokens"))


@query("tokens_lemma", f"""
SELECT doc_id, list_transform({CLEAN_SQL},
         lambda t: CASE WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, length(t) - 1) ELSE t END) AS lemmas
FROM documents
""")
def tokens_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas from a (form, lemma) table joined on the token; the table is
    derived from the corpus vocabulary (plural 's' forms of more than 3
    letters map to the stem)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    forms = d.select(F.explode_outer("tokens").alias("form")).filter(F.col("form").isNotNull()).distinct() \
             .filter(F.col("form").endswith("s") & (F.length("form") > 3))
    lemmas = forms.select("form", F.expr("substring(form, 1, length(form) - 1)").alias("lemma"))
    return T.lemmatize(d, "doc_id", "tokens", lemmas)


@query("tokens_stem")
def tokens_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Porter stems of the clean tokens (stemmer applied to distinct words)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    return T.stem_tokens(d, "doc_id", "tokens")


@query("tokens_bpe")
def tokens_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T8 re-aimed: subword tokens of the clean tokens. The merge table is learned
    round by round over the distinct words (weighted by frequency), so merged pieces merge
    again; it is applied to distinct words and mapped back."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    words = d.select(F.explode_outer("tokens").alias("word")).filter(F.col("word").isNotNull()) \
             .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    merges = T.learn_merges(words, "word", "n")
    return T.bpe_tokens(d, "doc_id", "tokens", merges)


@query("token_lines", f"SELECT doc_id, array_to_string({CLEAN_SQL}, chr(9)) AS line FROM documents")
def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tab-joined token line per document (the sink writes these)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    return d.select("doc_id", F.concat_ws("\t", "tokens").alias("line"))


# ------------------------------------------------------------- T10, T11, T15

VOCAB_SQL = f"""vocab AS (
  SELECT word, row_number() OVER (ORDER BY word) + 1 AS id
  FROM (SELECT DISTINCT unnest({CLEAN_SQL}) AS word FROM documents))"""


def doc_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    return T.vocabulary(d, "doc_id", "tokens")


@query("vocabulary", f"""WITH {VOCAB_SQL}
SELECT word, id FROM vocab UNION ALL SELECT '<PAD>', 0 UNION ALL SELECT '<UNK>', 1
""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word ids over the sorted document vocabulary, <PAD> 0, <UNK> 1."""
    return doc_vocab(spark, sf_dir)


@query("token_ids", f"""WITH {VOCAB_SQL},
c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{WORD}+') AS tokens FROM conversations),
u AS (SELECT conv_id, turn, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM c),
j AS (SELECT conv_id, turn, pos, coalesce(id, 1) AS id FROM u LEFT JOIN vocab ON u.token = vocab.word),
g AS (SELECT conv_id, turn, list(id ORDER BY pos) AS ids FROM j GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(g.ids, []) AS ids, list_transform(coalesce(g.ids, []), lambda x: 1) AS mask,
       len(coalesce(g.ids, [])) AS length
FROM c LEFT JOIN g ON c.conv_id = g.conv_id AND c.turn = g.turn
""")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T11 + J8: conversation turns to ids of the document vocabulary
    (unknown 1), with mask and length."""
    c = read_table(spark, sf_dir, "conversations").select(
        F.struct("conv_id", "turn").alias("key"), TX.tokenize("text", "clean").alias("tokens"))
    out = T.token_ids(c, "key", "tokens", doc_vocab(spark, sf_dir))
    return out.select("key.conv_id", "key.turn", "ids", "mask", F.col("length").cast("long").alias("length"))


@query("oov_words", f"""WITH {VOCAB_SQL}
SELECT DISTINCT t AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '{WORD}+')) AS t FROM conversations)
WHERE t NOT IN (SELECT word FROM vocab)
""")
def oov_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct conversation words missing from the document vocabulary."""
    c = read_table(spark, sf_dir, "conversations").select(TX.tokenize("text", "clean").alias("tokens"))
    d = docs(spark, sf_dir).select(F.explode_outer(TX.tokenize("text", "clean")).alias("word")).distinct()
    return T.oov_words(c, "tokens", d)


# ------------------------------------------------------------- T13 ---------

WEIGHT_KEYWORDS = ["the"]


@query("keyword_weights", f"""
WITH t AS (SELECT doc_id, {CLEAN_SQL} AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM t),
h AS (SELECT *, CASE WHEN contains(token, 'the') THEN pos END AS hit FROM u),
w AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
              min(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt
      FROM h),
d AS (SELECT doc_id, pos, least(pos - prv, nxt - pos) AS dist FROM w),
g AS (SELECT doc_id, list(CASE WHEN dist IS NULL THEN 0.0 WHEN dist = 0 THEN 1.0
                              ELSE greatest(0.0, 1.0 - CAST(dist - 1 AS DOUBLE) / 10.0) END ORDER BY pos) AS weights
      FROM d GROUP BY doc_id)
SELECT t.doc_id, list_transform(coalesce(g.weights, []), lambda x: round(x, 6)) AS weights
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
""")
def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance weights to tokens containing 'the', context 10, whole
    texts (oracle: running windows over exploded tokens in SQL)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    return TX.with_keyword_weights(d, "tokens", WEIGHT_KEYWORDS, 10).select("doc_id", round_arr("weights"))


@query("keyword_weights_short", f"""
WITH d AS (SELECT doc_id, text, {KW_POS} AS pos FROM documents),
s AS (SELECT doc_id, {split_sql("substring(text, 1, pos)")} AS l, {split_sql("substring(text, pos + 1)")} AS r FROM d),
w AS (SELECT doc_id, list_concat(list_slice(l, greatest(1, len(l) - 15 + 1), len(l)), list_slice(r, 1, 16)) AS win
      FROM s),
k AS (SELECT doc_id, win, list_filter(range(len(win)), lambda i: contains(win[i + 1], 'the')) AS hits FROM w)
SELECT doc_id, list_transform(range(len(win)), lambda j: round(CASE WHEN len(hits) = 0 THEN 0.0 ELSE
         list_max(list_transform(hits, lambda i: CASE WHEN abs(j - i) = 0 THEN 1.0
           ELSE greatest(0.0, 1.0 - CAST(abs(j - i) - 1 AS DOUBLE) / 10.0) END)) END, 6)) AS weights
FROM k
""")
def keyword_weights_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T13 as a column expression on keyword windows (array functions, no
    shuffle): weights of the 31-word window around the first 'the'."""
    d = docs(spark, sf_dir).withColumn("pos", F.expr(KW_POS))
    w = d.select("doc_id", TX.center_text("text", F.col("pos"), 15).alias("win"))
    return TX.with_keyword_weights(w, "win", WEIGHT_KEYWORDS, 10).select("doc_id", round_arr("weights"))


# ------------------------------------------------------------- T14 ---------

def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, vec): the k-th word of the sorted vocabulary takes embedding k."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    words = d.select(F.explode_outer("tokens").alias("word")).filter(F.col("word").isNotNull())
    idx = T.sorted_index(words, "word", start=0, name="vec_id")
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return idx.join(emb, "vec_id").select("word", "vec")


WV_SQL = f"""wv AS (
  SELECT v.word, e.embedding AS vec
  FROM (SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
        FROM (SELECT DISTINCT unnest({CLEAN_SQL}) AS word FROM documents)) v
  JOIN embeddings e ON v.vec_id = e.vec_id)"""


@query("sentence_vectors", f"""WITH {WV_SQL},
t AS (SELECT doc_id, {CLEAN_SQL} AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS token FROM t),
j AS (SELECT doc_id, vec FROM u JOIN wv ON u.token = wv.word),
x AS (SELECT doc_id, unnest(range(64)) AS k, unnest(vec) AS v FROM j),
g AS (SELECT doc_id, list(round(a, 6) ORDER BY k) AS emb FROM (SELECT doc_id, k, avg(CAST(v AS DOUBLE)) AS a FROM x
      GROUP BY doc_id, k) GROUP BY doc_id)
SELECT t.doc_id, coalesce(g.emb, list_transform(range(64), lambda i: 0.0)) AS embedding
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
""")
def sentence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector of the known words of each document (zeros if none)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    out = T.sentence_vectors(d, "doc_id", "tokens", word_vectors(spark, sf_dir), EMB_DIM)
    return out.select("doc_id", round_arr("embedding"))


@query("sentence_vectors_weighted", f"""WITH {WV_SQL},
t AS (SELECT doc_id, {CLEAN_SQL} AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM t),
h AS (SELECT *, CASE WHEN contains(token, 'the') THEN pos END AS hit FROM u),
w AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv,
              min(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt
      FROM h),
ww AS (SELECT doc_id, token, CASE WHEN least(pos - prv, nxt - pos) IS NULL THEN 0.0
                                  WHEN least(pos - prv, nxt - pos) = 0 THEN 1.0
                                  ELSE greatest(0.0, 1.0 - CAST(least(pos - prv, nxt - pos) - 1 AS DOUBLE) / 10.0)
                             END AS wt FROM w),
j AS (SELECT doc_id, wt, vec FROM ww JOIN wv ON ww.token = wv.word),
x AS (SELECT doc_id, wt, unnest(range(64)) AS k, unnest(vec) AS v FROM j),
g AS (SELECT doc_id, list(round(a, 6) ORDER BY k) AS emb
      FROM (SELECT doc_id, k, sum(wt * CAST(v AS DOUBLE)) AS a FROM x GROUP BY doc_id, k) GROUP BY doc_id)
SELECT t.doc_id, coalesce(g.emb, list_transform(range(64), lambda i: 0.0)) AS embedding
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
""")
def sentence_vectors_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 weighted form: sum of keyword-distance-weighted vectors."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    d = TX.with_keyword_weights(d, "tokens", WEIGHT_KEYWORDS, 10)
    out = T.sentence_vectors(d, "doc_id", "tokens", word_vectors(spark, sf_dir), EMB_DIM, weights_col="weights")
    return out.select("doc_id", round_arr("embedding"))


@query("sentence_vectors_concat", f"""WITH {WV_SQL},
t AS (SELECT doc_id, {CLEAN_SQL} AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos, len(tokens) AS n_tokens FROM t)
SELECT u.doc_id, u.pos, u.n_tokens, CAST(wv.vec AS DOUBLE[]) AS vec FROM u JOIN wv ON u.token = wv.word
""")
def sentence_vectors_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14 ``do_avg=False`` over whole texts: the vector of every known word with
    its place (the other places are zeros)."""
    d = docs(spark, sf_dir).select("doc_id", TX.tokenize("text", "clean").alias("tokens"))
    out = T.sentence_vector_rows(d, "doc_id", "tokens", word_vectors(spark, sf_dir))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("n_tokens").cast("long").alias("n_tokens"), "vec")


# ------------------------------------------------------------- T16 ---------

@query("tfidf", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g'),
                                             '{TX.TFIDF_PATTERN}') AS tokens FROM documents),
u AS (SELECT doc_id, unnest(tokens) AS term FROM t),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM u GROUP BY term
      ORDER BY tf DESC, term LIMIT 1000),
c AS (SELECT doc_id, u.term, count(*) * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1.0) AS w
      FROM u JOIN v ON u.term = v.term GROUP BY doc_id, u.term, df)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM c
""")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF over the 1000 most frequent terms (ASCII-folded), smooth
    idf, L2-normalised; long form (doc, term, weight)."""
    d = T.tfidf_prepare(docs(spark, sf_dir), "text")
    model = T.tfidf_fit(d, "tfidf_tokens", 1000)
    out = T.tfidf_long(model, d, "doc_id", "tfidf_tokens")
    return out.select("doc_id", "term", F.round("tfidf", 6).alias("tfidf"))


# ------------------------------------------------------------- L1 ----------

@query("label_codes", """
SELECT doc_id, lang, coalesce(c.code, -1) AS code
FROM documents LEFT JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code
                          FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) c USING (lang)
""")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: text labels (language) to codes by sorted order."""
    return L.label_codes(docs(spark, sf_dir).select("doc_id", "lang"), "lang").select("doc_id", "lang", "code")


@query("label_binary", """
WITH m AS (SELECT lang FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT doc_id, lang, CASE WHEN lang = (SELECT lang FROM m) THEN 0 ELSE 1 END AS code FROM documents
""")
def label_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 binary: the modal label 0, every other 1."""
    return L.label_codes(docs(spark, sf_dir).select("doc_id", "lang"), "lang", binary=True) \
            .select("doc_id", "lang", "code")


# ------------------------------------------------------------- E1-E3 -------

def _hash_sql(key: str, seed: int, digits: int = 7) -> str:
    return f"CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}'), 1, {digits})) AS BIGINT)"


@query("split", f"""
SELECT doc_id, {_hash_sql('doc_id', 911)} % 10000 < 2000 AS is_test FROM documents
""")
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic 80/20 train/test split by hashed id."""
    return docs(spark, sf_dir).select("doc_id", L.split_flag("doc_id", 0.2, 911).alias("is_test"))


@query("folds", f"SELECT doc_id, CAST({_hash_sql('doc_id', 42)} % 10 AS INTEGER) AS fold FROM documents")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain 10-fold assignment."""
    return docs(spark, sf_dir).select("doc_id", L.fold_of("doc_id", 10, 42).alias("fold"))


@query("stratified_folds", f"""
SELECT doc_id, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {_hash_sql('doc_id', 42, 15)}, doc_id) - 1) % 10
            AS INTEGER) AS fold
FROM labels
""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 folds stratified on the quality label."""
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return L.stratified_folds(lab, "doc_id", "quality", 10, 42).select("doc_id", "quality", "fold")


# ------------------------------------------------------------- M1-M3 -------

def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: ``2 * quality + toxic`` (4 classes); prediction: a rule on the
    document length that never predicts class 1."""
    lab = read_table(spark, sf_dir, "labels")
    d = docs(spark, sf_dir).select("doc_id", "n_chars")
    j = lab.join(d, "doc_id")
    return j.select("doc_id", (2 * F.col("quality") + F.col("toxic")).alias("label"),
                    F.when(F.col("n_chars") < 1000, 0).when(F.col("n_chars") < 3000, 2).otherwise(3).alias("pred"))


PRED_SQL = """WITH pr AS (
  SELECT doc_id, 2 * quality + toxic AS label,
         CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 2 ELSE 3 END AS pred
  FROM labels JOIN documents USING (doc_id))"""


def _report_sql(by: str = "") -> str:
    """Class report in SQL over ``pr`` (+ optional grouping columns), counting
    each cell with a correlated subquery (a different formulation from the
    Spark plan's single confusion table)."""
    keys = [x.strip() for x in by.split(",") if x.strip()]
    b = "".join(f"{k}, " for k in keys)
    cb = "".join(f"cls.{k}, " for k in keys)
    same = "".join(f" AND pr.{k} = cls.{k}" for k in keys)
    g = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""
cls AS (SELECT DISTINCT {b}CAST(label AS VARCHAR) AS class FROM pr
        UNION SELECT DISTINCT {b}CAST(pred AS VARCHAR) FROM pr),
pc AS (
  SELECT {cb}cls.class,
    (SELECT count(*) FROM pr WHERE CAST(pr.label AS VARCHAR) = cls.class{same}) AS support,
    (SELECT count(*) FROM pr WHERE CAST(pr.pred AS VARCHAR) = cls.class{same}) AS predicted,
    (SELECT count(*) FROM pr WHERE CAST(pr.pred AS VARCHAR) = cls.class AND pr.label = pr.pred{same}) AS tp
  FROM cls),
m AS (
  SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
            CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall FROM pc),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
      FROM m),
rows AS (
  SELECT {b}class, precision, recall, f1 AS f1_score, CAST(support AS DOUBLE) AS support FROM f
  UNION ALL SELECT {b}'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support),
                   sum(tp) / sum(support) FROM f {g}
  UNION ALL SELECT {b}'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS DOUBLE) FROM f {g}
  UNION ALL SELECT {b}'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS DOUBLE) FROM f {g})
SELECT {b}class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(support, 6) AS support FROM rows
"""


def _r6_report(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("precision", "recall", "f1_score", "support") else F.col(c)
                       for c in df.columns])


@query("class_report", PRED_SQL + "," + _report_sql())
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: per class precision/recall/F1/support + accuracy, macro, weighted."""
    return _r6_report(M.class_report(predictions(spark, sf_dir), "label", "pred"))


@query("metrics", PRED_SQL + "," + _report_sql() .split("rows AS")[0].rstrip().rstrip(",") + """
SELECT round(sum(f1 * support) / sum(support), 6) AS f1, round(sum(tp) / sum(support), 6) AS acc,
       round(sum(precision * support) / sum(support), 6) AS p, round(sum(recall * support) / sum(support), 6) AS r
FROM f
""")
def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: accuracy and weighted F1, precision, recall."""
    m = M.perf_metrics(predictions(spark, sf_dir), "label", "pred")
    return m.select(*[F.round(c, 6).alias(c) for c in ("f1", "acc", "p", "r")])


FOLD_PRED_SQL = f"""WITH p0 AS (
  SELECT doc_id, 2 * quality + toxic AS label,
         CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 2 ELSE 3 END AS pred,
         CAST({_hash_sql('doc_id', 42)} % 5 AS INTEGER) AS fold
  FROM labels JOIN documents USING (doc_id)),
pr AS (SELECT doc_id, label, pred, f AS fold_nb, CASE WHEN f = fold THEN 'test' ELSE 'train' END AS dataset
       FROM p0, range(5) AS r(f))"""


@query("fold_report", FOLD_PRED_SQL + "," + _report_sql("fold_nb, dataset"))
def fold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: class reports per fold (5) and dataset (train/test): rows are counted
    once, by (fold, label, prediction)."""
    p = predictions(spark, sf_dir).withColumn("fold", L.fold_of("doc_id", 5, 42))
    cells = M.fold_cells(p, "label", "pred", "fold", 5)
    return _r6_report(M.class_report(cells, "label", "pred", by=["fold_nb", "dataset"], weight="n"))


# ------------------------------------------------------------- A12-A14 -----

BATCH_SQL = """WITH pr AS (
  SELECT doc_id, 2 * quality + toxic AS label,
         CASE WHEN n_chars < 1000 THEN 0 WHEN n_chars < 3000 THEN 2 ELSE 3 END AS pred,
         CAST(doc_id // 32 AS BIGINT) AS batch
  FROM labels JOIN documents USING (doc_id))"""


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-batch (32 ids) class metrics of the rule predictions."""
    p = predictions(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 32).cast("long"))
    pc = M.per_class(p, "label", "pred", by=["batch"])
    return pc.select("batch", "class", "f1", "precision", "recall", "support")


@query("merge_batch_metrics", BATCH_SQL + "," + _report_sql("batch").split("rows AS")[0].rstrip().rstrip(",") + """
SELECT class, round(sum(f1 * support) / sum(support), 6) AS f1,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall, CAST(sum(support) AS BIGINT) AS support
FROM f GROUP BY class
""")
def merge_batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch metrics merged per class, weighted by support."""
    out = M.merge_batch_weighted(batch_metrics(spark, sf_dir))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")],
                      F.col("support").cast("long").alias("support"))


@query("merge_batch_plain", BATCH_SQL + "," + _report_sql("batch").split("rows AS")[0].rstrip().rstrip(",") + """
SELECT class, round(avg(nullif(f1, 0.0)), 6) AS f1, round(avg(nullif(precision, 0.0)), 6) AS precision,
       round(avg(nullif(recall, 0.0)), 6) AS recall, CAST(sum(support) AS BIGINT) AS support
FROM f GROUP BY class
""")
def merge_batch_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of non-zero batch metrics per class; support summed."""
    out = M.merge_batch_plain(batch_metrics(spark, sf_dir))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")],
                      F.col("support").cast("long").alias("support"))


@query("best_run", FOLD_PRED_SQL + "," + _report_sql("fold_nb, dataset").split("rows AS")[0].rstrip().rstrip(",")
       + """,
s AS (SELECT fold_nb, sum(f1 * support) / sum(support) AS f1 FROM f WHERE dataset = 'test' GROUP BY fold_nb)
SELECT arg_max(fold_nb, [f1, fold_nb]) AS fold_nb, round(max(f1), 6) AS f1 FROM s
""")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold with the best test F1 (the later fold on ties)."""
    p = predictions(spark, sf_dir).withColumn("fold", L.fold_of("doc_id", 5, 42))
    stats = M.perf_metrics(p.withColumn("fold_nb", F.col("fold")), "label", "pred", by=["fold_nb"])
    b = M.best_run(stats, "fold_nb", "f1")
    return b.select("fold_nb", F.round("f1", 6).alias("f1"))


# ------------------------------------------------------------- T12 ---------

@query("bert_frame", f"""
SELECT doc_id, list_slice(list_concat(['[CLS]'], regexp_extract_all(text, '{TOKEN}'), ['[SEP]']), 1, 511) AS tokens,
       list_transform(list_slice(list_concat(['[CLS]'], regexp_extract_all(text, '{TOKEN}'), ['[SEP]']), 1, 511),
                      lambda x: 1) AS mask
FROM documents
""")
def bert_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """[CLS] tokens [SEP], cut at 511, attention mask of ones."""
    t = docs(spark, sf_dir).select("doc_id", TX.bert_frame(TX.tokenize("text", "wos"), 511).alias("tokens"))
    return t.select("doc_id", "tokens", F.transform("tokens", lambda x: F.lit(1)).alias("mask"))


# ------------------------------------------------------------- S5 ----------

@query("load_and_clean", f"""
WITH d AS (SELECT doc_id, text, lang, {KW_POS} AS pos FROM documents),
s AS (SELECT doc_id, lang, pos, {split_sql("substring(text, 1, pos)")} AS l,
             {split_sql("substring(text, pos + 1)")} AS r FROM d),
c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code
      FROM (SELECT DISTINCT lang FROM s WHERE lang IS NOT NULL))
SELECT doc_id, pos, list_slice(list_concat(list_slice(l, greatest(1, len(l) - 10 + 1), len(l)), list_slice(r, 1, 11)),
                               1, 12) AS text,
       coalesce(c.code, -1) AS lang
FROM s LEFT JOIN c USING (lang)
""")
def load_and_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10-word windows around the first 'the' (T2), cut to 12 words (T3),
    language labels coded by sorted order (L1)."""
    d = docs(spark, sf_dir).withColumn("pos", F.expr(KW_POS)) \
        .select("doc_id", "text", "lang", "pos")
    out = T.load_and_clean(d, "text", "lang", strip=False, max_len=12, clean_labels=True, pos_col="pos", context=10)
    return out.select("doc_id", "pos", "text", "lang")
