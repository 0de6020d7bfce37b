"""Table-level text operators: keyword snippets (T4, J9), lemmas (T7),
vocabulary and ids (T10, T11, J8), out-of-vocabulary words (T15), sentence
vectors (T14), TF-IDF (T16).

Token work is ``posexplode`` + joins + grouped aggregates. Joins against a
vocabulary shuffle on the token; adaptive execution broadcasts the vocabulary
when its measured size allows and splits hot tokens ("the") otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cohortlens.functions.text import PAD_ID, UNK_ID, split_words, tfidf_tokens
from cohortlens.operators.joins import checkpointed, join_small, measured_bytes
from cohortlens.operators.ranks import positions
from cohortlens.session import ensure_checkpoint_dir, short_batches

# Names of the two reserved vocabulary rows (fixed values).
PAD, UNK = "<PAD>", "<UNK>"
# Words of at most 32 characters that a worker keeps with their stem or pieces.
KNOWN_WORDS = 100_000


# ------------------------------------------------------------- T4, J9 ------

def keyword_snippets(docs: DataFrame, text_col: str, keywords: Sequence[str], id_col: str | None = None,
                     num_chars: int = 200, num_words: int | None = None) -> DataFrame:
    """T4: for every document and keyword, the first hit of the keyword in the
    lower-cased document (the keyword itself is not lower-cased) and a window
    around it: ``num_words`` words before and ``num_words + 1`` from the hit,
    or characters ``[i - num_chars, i + 10 + num_chars)``. One row per hit;
    unlike the reference, the document id and keyword are kept.

    The keyword list is a literal of the call, so the keyword x document
    product is an ``explode`` of that literal per row: no join, no shuffle.
    """
    kws = F.array(*[F.lit(k) for k in keywords])
    keep = [F.col(id_col)] if id_col else []
    d = docs.select(*keep, F.lower(F.col(text_col)).alias("_doc"), F.explode(kws).alias("keyword"))
    d = d.withColumn("_i", F.expr("instr(_doc, keyword)") - 1).filter(F.col("_i") >= 0)
    if num_words is not None:
        left = split_words(F.substring(F.col("_doc"), F.lit(1), F.col("_i")))
        right = split_words(F.substring(F.col("_doc"), F.col("_i") + 1, F.lit(2_147_483_647)))
        left_part = left if num_words == 0 else F.slice(
            left, F.greatest(F.lit(1), F.size(left) - num_words + 1), F.lit(num_words))
        snippet = F.array_join(F.concat(left_part, F.slice(right, 1, num_words + 1)), " ")
    else:
        lo = F.greatest(F.lit(0), F.col("_i") - num_chars)
        hi = F.greatest(F.lit(0), F.col("_i") + 10 + num_chars)
        snippet = F.substring(F.col("_doc"), lo + 1, F.greatest(hi - lo, F.lit(0)))
    return d.select(*keep, "keyword", F.col("_i").alias("position"), snippet.alias("snippet"))


# ------------------------------------------------------------- T7 ----------

def tokens_long(df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """(id, pos, token) rows; empty arrays give no rows."""
    # *_outer: a plain explode makes the optimizer add ``size(tokens) > 0`` and
    # push it below the projections, computing the token array twice
    return df.select(F.col(id_col), F.posexplode_outer(F.col(tokens_col)).alias("pos", "token")) \
             .filter(F.col("pos").isNotNull())


def regroup_tokens(long: DataFrame, id_col: str, value_col: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """Collect ``value_col`` back into an array ordered by ``pos`` per id.
    With ``base`` (the id table), ids without tokens get an empty array."""
    g = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", value_col))).alias("_s")) \
            .select(id_col, F.col(f"_s.{value_col}").alias(out))
    if base is None:
        return g
    empty = F.array().cast(g.schema[out].dataType)
    return base.join(g, id_col, "left").withColumn(out, F.coalesce(F.col(out), empty))


def map_tokens(df: DataFrame, id_col: str, tokens_col: str, table: DataFrame, value: str, default: Column | None,
               out: str, max_bytes: int = 32 << 20) -> DataFrame:
    """``(id, out)``: each token replaced by its ``value`` in the ``table`` of
    distinct ``token``s; a token without one becomes ``default`` (null: itself).

    Under a measured ``max_bytes`` the table is broadcast, and the arrays of a
    whole Arrow batch are looked up at once: no explode and no shuffle of the texts
    (an SQL map is searched entry by entry). A larger table is joined to the
    exploded tokens, which are then put back in order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kind = dict(table.dtypes)[value]
    table = table.select("token", F.col(value).alias("_value")).where(F.col("token").isNotNull()).checkpoint()
    fill = (lambda x, t: F.coalesce(x, t)) if default is None else (lambda x, t: F.coalesce(x, default))
    if measured_bytes(table) <= max_bytes:
        rows = table.toArrow()
        held = spark.sparkContext.broadcast((rows["token"].combine_chunks(), rows["_value"].combine_chunks()))

        @F.arrow_udf(f"array<{kind}>")
        def look(tokens: pa.Array) -> pa.Array:
            keys, values = held.value
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32()))
            starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            return pa.ListArray.from_arrays(starts, values.take(pc.index_in(tokens.flatten(), value_set=keys)))

        d = df.select(id_col, F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("_tokens"))
        return (d.withColumn("_found", look(F.col("_tokens")))
                .select(id_col, F.transform(F.arrays_zip("_found", "_tokens"), lambda z: fill(z["_found"], z["_tokens"])).alias(out)))
    long = tokens_long(df, id_col, tokens_col).join(table, "token", "left")
    return regroup_tokens(long.select(id_col, "pos", fill(F.col("_value"), F.col("token")).alias("_t")), id_col, "_t", out,
                          base=df.select(id_col))


def lemmatize(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame, out: str = "lemmas") -> DataFrame:
    """T7 re-aimed: replace each token by its lemma from a ``(form, lemma)``
    table; unknown forms are kept. A form with several lemmas takes the smallest."""
    table = lemmas.groupBy(F.col("form").alias("token")).agg(F.min("lemma").alias("lemma"))
    return map_tokens(df, id_col, tokens_col, table, "lemma", None, out)


def _by_word(make, kind: str, tokens: Column) -> Column:
    """Each token of an array through ``make()``, a function of the word alone. The distinct
    words of a batch go through it, common ones once a worker: no table of words, no shuffle."""
    @F.arrow_udf(f"array<{kind}>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        word, known = make(), {}
        for lists in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32()))
            starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            coded = lists.flatten().dictionary_encode()
            found = []
            for w in coded.dictionary.to_pylist():
                value = known.get(w)
                if value is None:
                    value = word(w)
                    if len(known) < KNOWN_WORDS and len(w) <= 32:
                        known[w] = value
                found.append(value)
            values = pa.array(found, pa.list_(pa.string()) if kind.startswith("array") else pa.string())
            yield pa.ListArray.from_arrays(starts, values.take(coded.indices))
    return apply(F.coalesce(tokens, F.array().cast("array<string>")))


def _porter():
    from cohortlens.functions.stem import stem
    return stem


def stem_tokens(df: DataFrame, id_col: str, tokens_col: str, out: str = "stems") -> DataFrame:
    """T6 re-aimed: Porter stems of lower-case tokens, where the texts lie: the stemmer
    sees the distinct words of a batch, and no word is shuffled."""
    short_batches(df.sparkSession)
    return df.select(id_col, _by_word(_porter, "string", F.col(tokens_col)).alias(out))


def learn_merges(words: DataFrame, word: str = "word", count: str | None = None, rounds: int = 6,
                 per_round: int = 25) -> DataFrame:
    """A merge table ``(a, b, rank)`` from a word table (weighted by ``count``).

    Each round splits the distinct words by the merges so far, counts adjacent
    pieces, and adds the most frequent pairs that share no piece with a pair
    added before them in the round, so pieces merge again in later rounds. The
    table has ``rounds * per_round`` rows at most; only candidate pairs (four for
    each place) reach the driver."""
    spark = words.sparkSession
    ensure_checkpoint_dir(spark)
    w = words.select(F.col(word).alias("_w"), (F.col(count) if count else F.lit(1)).cast("long").alias("_c")) \
             .filter(F.col("_w").isNotNull()).checkpoint()
    ranks: dict[tuple[str, str], int] = {}
    for _ in range(rounds):
        p = w.select("_c", _pieces(ranks)(F.col("_w")).alias("_p"))
        pairs = p.select("_c", F.explode_outer(F.arrays_zip(F.expr("slice(_p, 1, greatest(size(_p) - 1, 0))").alias("a"),
                                                            F.expr("slice(_p, 2, greatest(size(_p) - 1, 0))").alias("b"))).alias("z")) \
                 .filter(F.col("z").isNotNull())
        top = pairs.groupBy(F.col("z.a").alias("a"), F.col("z.b").alias("b")).agg(F.sum("_c").alias("n")) \
                   .orderBy(F.desc("n"), "a", "b").limit(4 * per_round).collect()
        used: set[str] = set()
        taken = 0
        for r in top:
            if taken < per_round and not {r["a"], r["b"]} & used:
                used |= {r["a"], r["b"]}
                ranks[r["a"], r["b"]] = len(ranks)
                taken += 1
        if not taken:
            break
    return spark.createDataFrame([(a, b, i) for (a, b), i in ranks.items()], "a string, b string, rank int")


def _pieces(ranks: dict[tuple[str, str], int]):
    @pandas_udf("array<string>")
    def _encode(words: pd.Series) -> pd.Series:
        from cohortlens.functions.bpe import encode
        return words.map(lambda w: None if w is None else encode(w, ranks))
    return _encode


def bpe_tokens(df: DataFrame, id_col: str, tokens_col: str, merges: DataFrame, out: str = "subwords",
               max_merges: int = 100_000) -> DataFrame:
    """T8 re-aimed: subword tokens from a given merge table ``(a, b, rank)``.

    The merge table is a fixed, size-checked artefact (at most ``max_merges``
    pairs) handed to the encoder once per task; the **distinct** words of a
    batch are encoded where the texts lie, and their pieces flattened per text
    in order."""
    rows = merges.select("a", "b", "rank").limit(max_merges + 1).collect()
    if len(rows) > max_merges:
        raise ValueError(f"merge table has more than {max_merges} pairs")
    ranks = {(r["a"], r["b"]): int(r["rank"]) for r in rows}

    def encoder():
        from cohortlens.functions.bpe import encode
        return lambda w: encode(w, ranks)

    short_batches(df.sparkSession)
    nested = _by_word(encoder, "array<string>", F.col(tokens_col))
    return (df.select(id_col, nested.alias("_nested"))
            .select(id_col, F.flatten(F.filter("_nested", lambda x: x.isNotNull())).alias(out)))


# ------------------------------------------------------------- ranking -----

def sorted_index(df: DataFrame, col: str, start: int = 0, name: str = "id") -> DataFrame:
    """Position of each distinct value of ``col`` in sorted (binary) order,
    from ``start``, without a single-partition window: the values are range-
    partitioned and numbered inside a partition (``ranks.positions``)."""
    return positions(df.select(F.col(col)).filter(F.col(col).isNotNull()).distinct(), col, name, start)


# ------------------------------------------------------------- T10, T11 ----

def vocabulary(tokens: DataFrame, id_col: str, tokens_col: str, word: str = "word") -> DataFrame:
    """T10 (ids): sorted distinct tokens numbered from 2, after ``<PAD>`` = 0
    and ``<UNK>`` = 1."""
    words = tokens.select(F.explode_outer(F.col(tokens_col)).alias(word)).filter(F.col(word).isNotNull())
    ids = sorted_index(words, word, start=2)
    spark = tokens.sparkSession
    fixed = spark.createDataFrame([(PAD, PAD_ID), (UNK, UNK_ID)], f"{word} string, id long")
    return fixed.unionByName(ids)


def token_ids(df: DataFrame, id_col: str, tokens_col: str, vocab: DataFrame, word: str = "word") -> DataFrame:
    """T11 (on the tokens, the evident intent): ids per token, unknown = 1,
    plus the mask of ones and the length. No padding here: pad at the scoring
    edge, per batch."""
    g = map_tokens(df, id_col, tokens_col, vocab.select(F.col(word).alias("token"), F.col("id").cast("long").alias("_vid")),
                   "_vid", F.lit(UNK_ID).cast("long"), "ids")
    return g.select(id_col, "ids", F.transform("ids", lambda x: F.lit(1)).alias("mask"),
                    F.size("ids").alias("length"))


def pad_ids(df: DataFrame, width: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Ids and mask cut or padded to ``width`` (``<PAD>`` is 0 in both), as a
    model reads them; ``length`` and other columns stay."""
    fit = lambda c: F.concat(F.slice(c, 1, width), F.array_repeat(F.lit(PAD_ID).cast("long"), F.greatest(F.lit(0), width - F.size(c))))
    return df.withColumn(ids, fit(F.col(ids))).withColumn(mask, fit(F.col(mask).cast("array<bigint>")).cast("array<int>"))


def oov_words(df: DataFrame, tokens_col: str, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Distinct tokens not in the vocabulary."""
    t = df.select(F.explode_outer(F.col(tokens_col)).alias(word)).filter(F.col(word).isNotNull()).distinct()
    return t.join(vocab.select(word), word, "left_anti")


# ------------------------------------------------------------- T14 ---------

# Measured size up to which the table of word vectors is broadcast.
VECTOR_BYTES = 32 << 20


def _with_vectors(long: DataFrame, vectors: DataFrame, word: str, vec: str) -> tuple[DataFrame, bool]:
    """The rows of ``long`` whose token has a vector, with it as ``_vec``, and whether they stay
    where they lay. A large table of vectors is hashed a partition at a time and the tokens run
    past it, so the many rows of a frequent token are never sorted or held."""
    vecs, fits = checkpointed(vectors.select(F.col(word).alias("token"), F.col(vec).alias("_vec")), VECTOR_BYTES)
    return long.join(F.broadcast(vecs) if fits else vecs.hint("shuffle_hash"), "token"), fits


def sentence_vectors(df: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, dim: int,
                     word: str = "word", vec: str = "vec", weights_col: str | None = None) -> DataFrame:
    """Mean of the vectors of known tokens (``weights_col`` given: the
    weighted **sum**, not divided, as in the reference); no known token gives
    zeros. Tokens and weights explode together (no join to pair them); the
    vector table is broadcast after a size check. Each document holds ``dim``
    running sums, in a hash table of numbers: its rows are not sorted. Where
    the tokens were shuffled, they go to their document before they are summed,
    so that a task holds the sums of its own documents alone."""
    if weights_col is not None:
        long = df.select(id_col, F.explode_outer(F.arrays_zip(F.col(tokens_col).alias("token"),
                                                              F.col(weights_col).alias("w"))).alias("_z")) \
                 .filter(F.col("_z").isNotNull()) \
                 .select(id_col, F.col("_z.token").alias("token"), F.col("_z.w").alias("_w"))
    else:
        long = df.select(id_col, F.explode_outer(F.col(tokens_col)).alias("token")).filter(F.col("token").isNotNull())
    j, in_place = _with_vectors(long, vectors, word, vec)
    j = j.filter(F.col("_vec").isNotNull())
    if not in_place:
        j = j.repartition(id_col)
    at = [F.get("_vec", F.lit(i)).cast("double") for i in range(dim)]
    if weights_col is not None:
        at = [x * F.col("_w") for x in at]
    g = j.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(x).alias(f"_s{i}") for i, x in enumerate(at)])
    n = F.lit(1.0) if weights_col is not None else F.col("_n")
    zeros = F.array_repeat(F.lit(0.0), dim)
    found = F.array(*[F.col(f"_s{i}") / n for i in range(dim)]).cast("array<double>")
    return df.select(id_col).join(g, id_col, "left") \
             .select(id_col, F.when(F.col("_n").isNull(), zeros).otherwise(found).alias("embedding"))


def sentence_vector_rows(df: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, word: str = "word",
                         vec: str = "vec") -> DataFrame:
    """T14 with ``do_avg=False`` as rows ``(id, pos, n_tokens, vec)``: one for
    each known token; every other position up to ``n_tokens`` is zeros."""
    long = df.select(F.col(id_col), F.size(tokens_col).alias("n_tokens"), F.posexplode_outer(F.col(tokens_col)).alias("pos", "token")) \
             .filter(F.col("token").isNotNull())
    j, _ = _with_vectors(long, vectors, word, vec)
    return j.select(id_col, "pos", "n_tokens", F.transform("_vec", lambda x: x.cast("double")).alias("vec"))


def sentence_vectors_concat(df: DataFrame, id_col: str, tokens_col: str, vectors: DataFrame, dim: int,
                            width: int, word: str = "word", vec: str = "vec") -> DataFrame:
    """The same side by side in one array of ``width`` tokens for each text, zeros
    for unknown tokens and padding. Every row is as wide as ``width`` says: for
    whole texts take ``sentence_vector_rows``."""
    rows = sentence_vector_rows(df, id_col, tokens_col, vectors, word, vec)
    g = rows.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pos", "vec"))).alias("_m"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    size = F.greatest(F.lit(width), F.coalesce(F.size(tokens_col), F.lit(0)))
    at = F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))
    flat = F.flatten(F.transform(at, lambda i: F.coalesce(F.element_at("_m", i), zeros)))
    return (df.select(id_col, tokens_col).join(g, id_col, "left")
            .select(id_col, F.when(size > 0, flat).otherwise(F.array().cast("array<double>")).alias("embedding")))


# ------------------------------------------------------------- T16 ---------

@pandas_udf(StringType())
def _ascii_fold(s: pd.Series) -> pd.Series:
    """``strip_accents='ascii'``: NFKD, then drop every non-ASCII character."""
    return s.map(lambda x: None if x is None else
                 unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


def tfidf_text(c: Column) -> Column:
    """Preprocessing of T16: lower case, then ASCII folding."""
    return _ascii_fold(F.lower(c))


@dataclass
class TfidfModel:
    """Fitted TF-IDF: ``vocab`` rows (term, index, idf), index in term order."""
    vocab: DataFrame
    n_docs: int
    bounded: bool = True

    def _rows(self):
        # the vocabulary is small (a top-k); fetch it once
        if not hasattr(self, "_cache"):
            self._cache = self.vocab.orderBy("index").collect()
        return self._cache

    def terms(self) -> list[str]:
        return [r["term"] for r in self._rows()]

    def idf(self) -> list[float]:
        return [r["idf"] for r in self._rows()]


def tfidf_fit(df: DataFrame, tokens_col: str, max_features: int | None = 1000) -> TfidfModel:
    """T16 fit: keep the ``max_features`` terms of highest corpus frequency
    (ties: term order), ``idf = ln((1 + n) / (1 + df)) + 1`` (smooth).

    Term frequency and document frequency come from one aggregate: every token
    contributes ``(term, 1, 0)`` and every distinct token of a text
    ``(term, 0, 1)`` (``array_distinct`` per row), so document frequency needs
    no ``(term, document)`` distinct shuffle. The vocabulary is a top-k, so its
    size is bounded by ``max_features``."""
    stats = _term_counts(df, tokens_col, []).select("term", "tf", "df")
    if max_features is not None:
        stats = stats.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    ensure_checkpoint_dir(df.sparkSession)
    n = df.count()
    vocab = stats.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    if max_features is not None:
        # at most max_features rows: numbering them in one task is bounded
        vocab = vocab.withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))
    else:
        vocab = vocab.join(sorted_index(vocab, "term", name="index"), "term")
    return TfidfModel(vocab=vocab.select("term", "index", "idf").checkpoint(), n_docs=n,
                      bounded=max_features is not None)


def _term_counts(df: DataFrame, tokens_col: str, by: Sequence[str]) -> DataFrame:
    """(by..., term, tf, df): occurrences tagged (1, 0) and distinct terms of a
    row tagged (0, 1), in one explode and one aggregate."""
    t = F.col(tokens_col)
    tagged = F.concat(F.transform(t, lambda x: F.struct(x.alias("term"), F.lit(1).alias("o"), F.lit(0).alias("d"))),
                      F.transform(F.array_distinct(t),
                                  lambda x: F.struct(x.alias("term"), F.lit(0).alias("o"), F.lit(1).alias("d"))))
    e = df.select(*by, F.explode_outer(tagged).alias("_e")).filter(F.col("_e").isNotNull()).select(*by, "_e.term", "_e.o", "_e.d")
    return e.groupBy(*by, "term").agg(F.sum("o").alias("tf"), F.sum("d").alias("df"))


def tfidf_fit_folds(df: DataFrame, tokens_col: str, fold_col: str, k: int, max_features: int = 1000) -> list[TfidfModel]:
    """``tfidf_fit`` on the train side of every fold (all rows but the fold's):
    the texts are counted once, by (fold, term), and a fold's counts are taken
    from the total."""
    ensure_checkpoint_dir(df.sparkSession)
    per = _term_counts(df, tokens_col, [fold_col]).checkpoint()
    rows = {r[fold_col]: r["n"] for r in df.groupBy(fold_col).agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for f in range(k):
        n = sum(c for key, c in rows.items() if key != f)
        top = (per.where(F.col(fold_col) != f).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
               .orderBy(F.desc("tf"), F.asc("term")).limit(max_features))
        vocab = (top.select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
                 .withColumn("index", (F.row_number().over(Window.orderBy("term")) - 1).cast("long")))
        out.append(TfidfModel(vocab=vocab.select("term", "index", "idf").checkpoint(), n_docs=n))
    return out


def tfidf_long(model: TfidfModel, df: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """T16 transform in long form ``(id, term, tfidf)`` for the terms present.

    With a bounded vocabulary the weights are read off the per-row sparse
    vectors of ``tfidf_vectors`` (counts, idf and L2 norm all computed inside
    the row), exploded to (index, value) and named through the broadcast
    vocabulary: no shuffle. An unbounded vocabulary falls back to counting
    (document, term) pairs with a shuffle."""
    if model.bounded:
        v = tfidf_vectors(model, df.select(id_col, tokens_col), tokens_col, out="_f")
        e = (v.select(id_col, F.unwrap_udt("_f").alias("_p")).select(id_col, F.explode_outer(F.arrays_zip("_p.indices", "_p.values")).alias("_e"))
             .where(F.col("_e").isNotNull()).select(id_col, F.col("_e.indices").cast("long").alias("index"), F.col("_e.values").alias("tfidf"))
             .where(F.col("tfidf") != 0))
        # max_features rows at most
        return join_small(e, model.vocab.select("index", "term"), "index").select(id_col, "term", "tfidf")
    terms = df.select(id_col, F.explode_outer(tokens_col).alias("term")).filter(F.col("term").isNotNull())
    counts = terms.join(model.vocab, "term").groupBy(id_col, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    w = counts.withColumn("_w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("_w") / norm).alias("tfidf"))


def tfidf_stages(model: TfidfModel, tokens_col: str, out: str = "features") -> list:
    """T16 transform as fitted ML stages: term counts over the vocabulary, times
    idf, L2-normalised, to sparse vectors."""
    return [CountVectorizerModel.from_vocabulary(model.terms(), inputCol=tokens_col, outputCol="_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(model.idf()), inputCol="_tf", outputCol="_tfidf"),
            Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)]


def tfidf_vectors(model: TfidfModel, df: DataFrame, tokens_col: str, out: str = "features") -> DataFrame:
    """T16 transform to sparse vectors."""
    for stage in tfidf_stages(model, tokens_col, out):
        df = stage.transform(df)
    return df.drop("_tf", "_tfidf")


def tfidf_prepare(df: DataFrame, text_col: str, out: str = "tfidf_tokens") -> DataFrame:
    short_batches(df.sparkSession)
    return df.withColumn(out, tfidf_tokens(tfidf_text(F.col(text_col))))


# ------------------------------------------------------------- S4, S5, T9 --

def read_word_vectors(spark, path: str, word: str = "word", vec: str = "vec") -> DataFrame:
    """A word-vector table ``(word, vec ARRAY<FLOAT>)`` stored as Parquet."""
    return spark.read.parquet(path).select(F.col(word).alias("word"), F.col(vec).alias("vec"))


def tokenize_df(df: DataFrame, text_col: str, tokenization_type: str = "clean", out: str = "tokens",
                lemmas: DataFrame | None = None, id_col: str | None = None, max_merges: int = 100_000) -> DataFrame:
    """Tokeniser dispatch by mode name ('clean', 'wos', 'low_wos', 'lem',
    'bpe'). 'lem' needs a ``(form, lemma)`` table, 'bpe' a merge table
    (``lemmas`` argument holds it, refused beyond ``max_merges`` rows), both an id column."""
    from cohortlens.functions.text import tokenize
    if "bpe" in tokenization_type:
        if lemmas is None or id_col is None:
            raise ValueError("'bpe' needs a merge table and an id column")
        d = df.withColumn("_words", tokenize(F.col(text_col), "wos"))
        enc = bpe_tokens(d, id_col, "_words", lemmas, out=out, max_merges=max_merges)
        return df.join(enc, id_col)
    d = df.withColumn(out, tokenize(F.col(text_col), tokenization_type))
    if "lem" in tokenization_type:
        if lemmas is None or id_col is None:
            raise ValueError("'lem' needs a lemma table and an id column")
        lem = lemmatize(d, id_col, out, lemmas, out="_lem")
        d = d.drop(out).join(lem.withColumnRenamed("_lem", out), id_col)
    return d


def load_and_clean(df: DataFrame, text_col: str, label_col: str | None = None, strip: bool = False,
                   max_len: int | None = None, clean_labels: bool = False, binary: bool = False,
                   pos_col: str | None = None, context: int = 15) -> DataFrame:
    """Trim (T1), keyword-centred window from a character offset (T2),
    first ``max_len`` words (T3), label coding (L1). With both ``pos_col`` and
    ``max_len`` the window is cut to ``max_len`` words (the original raised)."""
    from cohortlens.functions.text import center_text, first_tokens, strip_text
    from cohortlens.operators.labels import label_codes
    d = df
    if strip:
        d = d.withColumn(text_col, strip_text(F.col(text_col)))
    if pos_col is not None:
        d = d.withColumn(text_col, center_text(F.col(text_col), F.col(pos_col), context))
        if max_len is not None:
            d = d.withColumn(text_col, F.slice(F.col(text_col), 1, max_len))
    elif max_len is not None:
        d = d.withColumn(text_col, first_tokens(F.col(text_col), max_len))
    if clean_labels and label_col is not None:
        d = label_codes(d, label_col, out="_code", binary=binary).drop(label_col).withColumnRenamed("_code", label_col)
    return d
