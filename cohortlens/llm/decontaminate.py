"""Benchmark decontamination by template windows.

Texts become templates: words in lower case without punctuation, numbers, units
after numbers, and names (capitalised words inside a sentence) replaced by typed
placeholders, whose own words are the slots. Windows of ``SIZE`` template words
of a document and of a benchmark item meet in a hash join. Windows that lie on
one diagonal (the same shift between document and item) are one passage; along
it a slot value of the item should stand for one value of the document. Windows in
which a value that stands for several (on either side) takes the place of another one are
dropped, and only those, so a question with other numbers is found, a copy with
one altered value too, and chance meetings of placeholders are not. A document holds an item if consistent passages cover
``COVER`` of the item's windows, or if the windows of one passage hold ``RUN`` of the
item's words (a long verbatim part; a copy with some words replaced).

Items shorter than a window are one window of their own length. An item without a
window of ``PLAIN`` plain words (numbers, a list of names), and one of no more words than a
window, is found by its words as they are, in lower case. A bit filter of
fixed size over the items' windows keeps nearly all document windows out of the
join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm import vectext as V
from cohortlens.llm.bits import bit_filter, passes
from cohortlens.session import ensure_checkpoint_dir

SIZE = 8
PLAIN = 3      # a template window has this many words that are no placeholders (all, if shorter)
COVER = 0.5
RUN = 13

# Units of measure, time and money that count as units after a number.
UNITS = """% mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams
kilogram kilograms ton tons ml cl l liter liters litre litres ms s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years percent usd eur gbp dollar dollars cent cents euro euros pound
pounds km2 m2 m3 mph kmh hz khz mhz ghz w kw v a n j kj cal kcal c f k""".split()

_unit_words = V.Words(*V.flat(pa.array(UNITS)), V.ALNUM)
_UNIT_HASHES = np.sort(_unit_words.hash)
_NUM, _UNIT, _NAME, _AS_IS = (np.uint64(x) for x in (0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547, 0x1B873593CC9E2D51))
_BREAK = np.zeros(256, np.int64)
_BREAK[[ord(c) for c in ".!?:;\n\"("]] = 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[[ord("."), ord(",")]] = True


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[V.Words, np.ndarray, np.ndarray]:
    """The words of a chunk, their template hashes, and which are placeholders."""
    digit = _DIGIT[data]
    inside = V.ALNUM[data]
    if len(data) > 2:
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    small = V.LOWER[data]
    if len(data) > 1:  # capitals of the Latin-1 letters, two bytes each
        small[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] += 32
    w = V.Words(small, offsets, lower=False, mask=inside)
    n = len(w.start)
    if not n:
        return w, np.zeros(0, np.uint64), np.zeros(0, bool)
    digits = np.concatenate(([0], np.cumsum(digit)))
    number = digits[w.end] > digits[w.start]
    first = np.zeros(n, bool)
    first[w.first[:-1][w.first[:-1] < n]] = True
    after_number = np.concatenate(([False], number[:-1])) & ~first
    unit = after_number & ~number & (_UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, w.hash), len(_UNIT_HASHES) - 1)] == w.hash)
    head, second = data[w.start], data[np.minimum(w.start + 1, len(data) - 1)]
    longer = w.end - w.start > 1
    capital = ((head >= 65) & (head <= 90) & longer & (((second >= 97) & (second <= 122)) | (second >= 128))) | \
        ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    opens = first | (breaks[w.start] > breaks[np.concatenate(([0], w.end[:-1]))])
    name = capital & ~opens & ~number
    h = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, w.hash)))
    return w, h, number | unit | name


def _windows(sizes: list[int], whole: bool, bits=None):
    """Mapper from (id, text) to (id, pos, hash, size, slots, of). ``whole``: texts are
    benchmark items, whose windows are of ``SIZE`` or their own shorter length, and ``of`` is
    how many a text has. Otherwise windows of all ``sizes`` that pass the filter, as templates
    and as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = V.flat(batch.column(1))
            for a, b, d, o in V.chunks(data, offsets):
                w, h, slot = template(d, o)
                count = np.diff(w.first)
                held = np.concatenate(([0], np.cumsum(slot)))
                for size in sizes:
                    if len(h) < size:
                        continue
                    at = np.arange(len(h) - size + 1)
                    row = np.searchsorted(w.first, at, "right") - 1
                    fits = at + size <= w.first[row + 1]
                    if whole:
                        fits &= (count[row] == size) | ((size == SIZE) & (count[row] >= size))
                    plain = held[at + size] - held[at] <= max(0, size - PLAIN)
                    templates = np.bincount(row[fits & plain], minlength=b - a)
                    for as_is in (False, True):
                        hashes = V.windows(w.hash if as_is else h, size) ^ np.uint64(size)
                        if as_is:
                            hashes ^= _AS_IS
                        if not whole:
                            ok = fits & passes(bits.value, hashes) & (plain | as_is)
                        else:
                            ok = fits & ((count[row] <= SIZE) | (templates[row] == 0) if as_is else plain)
                        chosen = np.flatnonzero(ok)
                        if not len(chosen):
                            continue
                        rows = row[chosen]
                        slots = [[w.text(i) for i in range(p, p + size) if slot[i]] if not as_is and held[p + size] > held[p] else []
                                 for p in chosen.tolist()]
                        of = np.bincount(rows, minlength=b - a)[rows] if whole else np.zeros(len(chosen), np.int64)
                        yield pa.record_batch([ids.take(pa.array(a + rows)), pa.array(chosen - w.first[rows]),
                                               pa.array(hashes[chosen].view(np.int64)),
                                               pa.array(np.full(len(chosen), size)), pa.array(slots, pa.list_(pa.binary())), pa.array(of)],
                                              names=["id", "pos", "hash", "size", "slots", "of"])
    return run


_WINDOW = "id long, pos long, hash long, size long, slots array<binary>, of long"


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, kind): the items each document holds; ``coverage`` is the
    share of the item's windows, ``kind`` is ``exact``, or ``reparameterised`` if some slot has another value.

    Null and empty texts hold nothing and are held by nothing; items with too few
    plain words for a template are found word for word. Repeated documents or items with one
    id count as one; null ids take no part. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    known = items.mapInArrow(_windows(list(range(1, SIZE + 1)), True), _WINDOW).checkpoint()
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # 1 .. SIZE
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    found = texts.mapInArrow(_windows(sizes, False, bit_filter(known, F.col("hash"))), _WINDOW)
    theirs = known.select("hash", F.col("id").alias("item_id"), F.col("pos").alias("at"), F.col("slots").alias("values"), "size", "of")
    passage = ["doc_id", "item_id", "shift"]
    both = (found.select(F.col("id").alias("doc_id"), "pos", "hash", "slots").join(theirs, "hash")
            .withColumn("shift", F.col("pos") - F.col("at")).checkpoint())
    pair = F.explode(F.arrays_zip("values", "slots")).alias("pair")
    stands_for = both.select(*passage, pair).select(*passage, F.col("pair.values").alias("v"), F.col("pair.slots").alias("s")).distinct()
    values = (stands_for.groupBy(*passage, "v").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("s") == F.col("v")).alias("same"))
              .groupBy(*passage).agg(F.collect_list(F.when(F.col("n") > 1, F.col("v"))).alias("several"), F.bool_and("same").alias("same")))
    clash = F.exists(F.arrays_zip("values", "slots"), lambda p: (p["values"] != p["slots"]) & (
        F.array_contains("several", p["values"]) | F.array_contains("several", p["slots"])))
    along = Window.partitionBy(*passage)
    words = F.least("size", F.coalesce(F.lead("at").over(along.orderBy("at")) - F.col("at"), F.col("size")))
    return (both.join(values, passage, "left").where(~F.coalesce(clash, F.lit(False)))
            .select(*passage, "at", "size", "of", "same").distinct()
            .withColumn("words", words).withColumn("run", F.sum("words").over(along))
            .groupBy("doc_id", "item_id")
            .agg((F.count_distinct("at") / F.max("of")).alias("coverage"), F.max("run").alias("run"),
                 F.bool_and(F.coalesce("same", F.lit(True))).alias("exact"))
            .where((F.col("coverage") >= COVER) | (F.col("run") >= RUN))
            .select("doc_id", "item_id", "coverage", F.when(F.col("exact"), "exact").otherwise("reparameterised").alias("kind")))
