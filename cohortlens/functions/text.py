"""Text column expressions (T1-T3, T5 tokenising, T12 framing, T13 weights).

All are built-in expressions (regex, ``split``, higher-order array
functions), so they run in the JVM, per row, on whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.isspace`` set as a regex class: ASCII blanks, the four
# information separators, NEL and every Unicode separator (Z*). Java and RE2
# both read this class the same way.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# A word token: letters, marks, digits, underscore (Unicode-aware ``\w``).
WORD = r"[\p{L}\p{M}\p{N}_]"
# Tokens: runs of word characters, or any single other non-blank character.
TOKEN_PATTERN = WORD + r"+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"
# TF-IDF tokens (``\b\w\w+\b``): word runs of two or more.
TFIDF_PATTERN = WORD + "{2,}"
# Frame tokens for BERT-style inputs (fixed values).
CLS, SEP = "[CLS]", "[SEP]"
# Ids reserved in the vocabulary (fixed values): padding 0, unknown 1.
PAD_ID, UNK_ID = 0, 1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_text(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def clean_text(c, start: int = 0, stop: int | None = 1000, strip: bool = True) -> Column:
    """``strip().lower()[start:stop]`` (character slice)."""
    t = F.lower(strip_text(c) if strip else _c(c))
    if stop is None:
        return F.substring(t, start + 1, 2_147_483_647)
    return F.substring(t, start + 1, max(0, stop - start))


def split_words(c) -> Column:
    """Python ``str.split()``: split on runs of whitespace, no empty tokens."""
    return F.filter(F.split(_c(c), WS_CLASS + "+"), lambda t: t != "")


def first_tokens(c, n: int) -> Column:
    """``split()[0:n]``."""
    return F.slice(split_words(c), 1, n)


def center_text(text, pos, context: int = 15) -> Column:
    """The last ``context`` words before character offset ``pos`` (0-based)
    and the first ``1 + context`` from it. ``context = 0`` keeps the whole
    left side, as Python's ``[-0:]`` does."""
    t, p = _c(text), _c(pos)
    left = split_words(F.substring(t, F.lit(1), p))
    right = split_words(F.substring(t, p + 1, F.lit(2_147_483_647)))
    if context == 0:
        left_part = left
    else:
        left_part = F.slice(left, F.greatest(F.lit(1), F.size(left) - context + 1), F.lit(context))
    return F.concat(left_part, F.slice(right, 1, context + 1))


def tokenize(c, mode: str = "clean") -> Column:
    """T5 re-aimed on a native regex tokeniser (words, and single punctuation
    marks as tokens). Modes as in the reference, first match wins:
    ``low``+``wos`` lower-cased tokens; ``wos`` tokens as written; ``lem``,
    ``stem`` and the default ``clean``: lower-cased word tokens, punctuation
    dropped (lemmas and stems are applied by table joins, see ``operators.text``).
    """
    t = _c(c)
    if "low" in mode and "wos" in mode:
        return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_PATTERN), 0)
    if "wos" in mode:
        return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)
    return F.regexp_extract_all(F.lower(t), F.lit(WORD + "+"), 0)


def tfidf_tokens(c) -> Column:
    """T16 tokens of already lower-cased, accent-stripped text."""
    return F.regexp_extract_all(_c(c), F.lit(TFIDF_PATTERN), 0)


def keyword_hits(tokens, keywords: Sequence[str]) -> Column:
    """Per token: does it contain any keyword (substring test)?"""
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.transform(_c(tokens), lambda t: F.exists(kws, lambda k: t.contains(k)))


def weights_from_hits(flags, context: int = 10, fixed: bool = False) -> Column:
    """T13 weights from a per-token hit-flag array (see ``with_keyword_weights``).

    Every weight depends only on the ``context`` tokens either side. The flag
    array is padded and sliced into ``2 * context + 1`` shifted copies, zipped
    so that element ``j`` holds the flags at ``j - context .. j + context``;
    the per-position lambda reads only its own element. Cost O(tokens x
    context) per text, whole texts, no shuffle, and no outer reference inside
    the lambda that the optimizer could inline into a per-element recomputation.
    """
    flags = _c(flags)
    c = int(context)
    n = F.size(flags)
    pad = F.array_repeat(F.lit(False), c)
    padded = F.concat(pad, flags, pad)
    shifts = [F.slice(padded, k + 1, n).alias(f"s{k}") for k in range(2 * c + 1)]
    zipped = F.arrays_zip(*shifts)

    def weight_at(x: Column) -> Column:
        ds = F.array(*[F.when(x[f"s{k}"], F.lit(abs(k - c))) for k in range(2 * c + 1)])
        d = F.array_min(F.filter(ds, lambda y: y.isNotNull()))      # null when no hit in reach
        if fixed:
            return F.coalesce((d <= c).cast("double"), F.lit(0.0))
        # 1 at d = 0 (the bare formula would give 1 + 1/c there), 0 beyond reach
        return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                                         F.lit(1.0) - (d - 1).cast("double") / F.lit(float(c)))),
                          F.lit(0.0))

    return F.when(n == 0, F.array().cast("array<double>")).otherwise(F.transform(zipped, weight_at))


def with_keyword_weights(df, tokens_col: str, keywords: Sequence[str], context: int = 10, fixed: bool = False,
                         out: str = "weights"):
    """Weight per token by distance ``d`` to the nearest token that
    contains a keyword: 1 at ``d = 0``; decreasing ``1 - (d - 1)/context``
    (1 next to the keyword, 0 from ``d = context + 1``); ``fixed``: 1 while
    ``d <= context``. Each repeat of a keyword token counts at its own
    position (the original mapped every repeat to the first one; that
    departure is deliberate)."""
    d = df.withColumn("_kw_hits", keyword_hits(F.col(tokens_col), keywords))
    return d.withColumn(out, weights_from_hits(F.col("_kw_hits"), context, fixed)).drop("_kw_hits")


def bert_frame(tokens, max_len: int = 511) -> Column:
    """``[CLS]`` + tokens + ``[SEP]``, cut to ``max_len`` (which may cut
    the ``[SEP]``, as in the reference)."""
    framed = F.concat(F.array(F.lit(CLS)), _c(tokens), F.array(F.lit(SEP)))
    return F.slice(framed, 1, max_len)
