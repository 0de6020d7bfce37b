"""Language-model scoring by a probabilistic suffix tree over words, backed off to classes.

The text is a run of words and an end. A word is predicted by the longest kept
suffix of the words before it, up to ``DEPTH`` words and within its text. A run of
words is a state if it was seen ``LEAST_SEEN`` times and what follows it diverges
from what follows the run one word shorter by more nats than describing it costs.
A state's distribution is smoothed with the next shorter state's (Witten-Bell;
what followed it once counts for the shorter state), so states and what
they hold grow with the corpus.

The shortest state is a tree over 64 word classes: the most frequent words one
each, others one by their last two bytes. The class of the next word is predicted
by the longest kept suffix of the two classes before it (a text starts with a class
of its own), by the same test and smoothing, and the word by its share of its
class, where all words not seen in training are one more word of the class.

How it runs: each task counts the words of its texts; the summed counts are the
dictionary, whose size grows with the corpus and which is never broadcast. Then one pass
for each length counts (run, next word) in each task, for runs that a bit filter of the
frequent ones lets through, the first also runs of three classes (64 ** 3 cells at most);
buckets of those counts are summed, and joins with the counts one word shorter test them.
Texts are dealt into chunks of bounded bytes; each chunk asks for its distinct words,
runs and states by the first bits of their hashes, packed by buckets of hashes; each
bucket of dictionary and states answers with all that a question may mean, and the
answers meet the chunk again, which knows its own by the whole hash. The chunks go
through this in ``ROUNDS`` parts, so that questions and answers of one part only are on
disk. Intermediate tables are written compressed, and go with their shuffle files when
the next is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectext as V
from cohortlens.llm.bits import bit_filter, passes
from cohortlens.llm.written import Written, shuffles_end_with_writes

CLASSES = 64
START, STOP = 0, 1      # before a text, and its end
TOP_WORDS, ENDINGS = 20, 40
CHUNK = 8 << 20         # bytes of text that are scored together
FLUSH = 2_000_000       # words counted at once in a task
DEPTH = 3               # words of the longest state
LEAST_SEEN = 8          # times a run of words was seen to be a state
FLUSH_RUNS = 1_000_000  # runs of words counted at once in a task
BUCKET = 500_000        # values and questions that meet in a task, about
SPARE_BITS = 6          # bits of a question beyond those that tell as many values apart
ROUNDS = 2              # parts of the chunks, scored one after the other
_LONGER, _STATE = np.uint64(0x9FB21C651E98DF25), np.uint64(0x5851F42D4C957F2D)
_COUNTS = pa.schema([("h", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])


def _rising(h: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def _alike(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes together, and where in it each hash begins."""
    order = np.argsort(h)
    h = h[order]
    return order, np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else order


def _texts(w: V.Words, at: np.ndarray) -> pa.Array:
    """The bytes of the words at these places."""
    size = w.end[at] - w.start[at]
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = w.data[np.arange(offsets[-1]) + np.repeat(w.start[at] - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _packed_rows(rows: pa.RecordBatch, bounds: np.ndarray) -> list[bytes]:
    """The rows between each two bounds, compressed together."""
    options, blobs = pa.ipc.IpcWriteOptions(compression="zstd"), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
            out.write_batch(rows.slice(a, b - a))
        blobs.append(sink.getvalue().to_pybytes())
    return blobs


def _unpacked_rows(blobs: pa.ChunkedArray) -> Iterator[pa.Table]:
    for rows in blobs:
        yield pa.ipc.open_stream(pa.py_buffer(rows.as_py())).read_all()


def _count_words(buckets: int):
    """Mapper from texts to rows (hash, word, times in the texts), packed by ranges of hashes;
    the end counts as the empty word."""
    borders = np.array(range((1 << 64) // buckets + 1, 1 << 64, (1 << 64) // buckets + 1), np.uint64)

    def flush(hashes, words, counts):
        h = np.concatenate(hashes)
        order, new = _alike(h)
        n = np.add.reduceat(np.concatenate(counts)[order], new)
        first = order[new]
        h = h[first]
        rows = pa.record_batch([pa.array(h.view(np.int64)), pa.concat_arrays(words).take(pa.array(first)), pa.array(n)], schema=_COUNTS)
        bounds = np.concatenate(([0], np.searchsorted(h, borders), [len(h)]))
        held = np.flatnonzero(np.diff(bounds))
        return pa.record_batch([pa.array(held), pa.array(_packed_rows(rows, np.append(bounds[held], len(h))), pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, counts, size, ends = [], [], [], 0, 0
        for batch in batches:
            ends += batch.num_rows
            data, offsets = V.flat(batch.column(0))
            for _, _, d, o in V.chunks(data, offsets):
                w = V.Words(d, o)
                if not len(w.start):
                    continue
                order, new = _alike(w.hash)
                first = order[new]
                hashes.append(w.hash[first])
                counts.append(np.diff(np.append(new, len(order))))
                words.append(_texts(w, first))
                size += len(new)
                if size > FLUSH:
                    yield flush(hashes, words, counts)
                    hashes, words, counts, size = [], [], [], 0
        yield flush([*hashes, np.zeros(1, np.uint64)], [*words, pa.array([b""], pa.binary())], [*counts, np.array([ends])])
    return run


def _sum_words(group: pa.Table) -> pa.Table:
    """The sums of a bucket's counts."""
    rows = pa.concat_tables(_unpacked_rows(group["rows"])).combine_chunks()
    order, new = _alike(rows["h"].to_numpy())
    n = np.add.reduceat(rows["n"].to_numpy()[order], new)
    first = pa.array(order[new])
    return pa.table([rows["h"].take(first), rows["word"].take(first), pa.array(n)], schema=_COUNTS)


@dataclass
class Classes:
    """Which class a word has: by its hash, else by its last two bytes."""
    top: np.ndarray        # sorted hashes of the frequent words
    top_class: np.ndarray
    ending: np.ndarray     # class of each pair of last bytes

    def of(self, w: V.Words) -> np.ndarray:
        last = w.data[w.end - 1].astype(np.int64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0)
        out = self.ending[(before.astype(np.int64) << 8) | last]
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, w.hash), len(self.top) - 1)
            out = np.where(self.top[at] == w.hash, self.top_class[at], out)
        return out


def choose_classes(dictionary: DataFrame) -> tuple[Classes, np.ndarray, np.ndarray]:
    """Classes from a table (h, word, n), and how many words each has and how often they were seen;
    only the chosen words and the sums of each two last bytes reach the driver."""
    seen = dictionary.where("n > 0")
    top = seen.where("h <> 0").orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()
    ends = (seen.groupBy(F.expr("substring(word, -2, 2)").alias("e")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"))
            .toArrow().sort_by([("n", "descending"), ("e", "ascending")]))
    code = [int.from_bytes(e, "big") if e else -1 for e in ends["e"].to_pylist()]   # the empty word is the end
    ending = np.full(1 << 16, CLASSES - 2)
    ending[(np.arange(1 << 16) & 0x80) > 0] = CLASSES - 1
    for i, e in enumerate([e for e in code if e >= 0][:ENDINGS]):
        ending[e] = 2 + TOP_WORDS + i
    words, times = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    rows = [(STOP if e < 0 else ending[e], m, n) for e, m, n in zip(code, ends["words"].to_pylist(), ends["n"].to_pylist())]
    for i, (word, n) in enumerate(zip(top["word"].to_pylist(), top["n"].to_pylist())):
        rows += [(2 + i, 1, n), (ending[int.from_bytes(word[-2:], "big")], -1, -n)]
    for k, m, n in rows:
        words[k] += m
        times[k] += n
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Classes(h[order], (np.arange(len(h)) + 2)[order], ending), words, times


def _runs(k: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts of word classes ``k``: the number of every run (two classes before,
    class) with the texts' ends put in, and where each text's runs begin."""
    n = len(first) - 1
    size = np.diff(first) + 1
    starts = np.concatenate(([0], np.cumsum(size)))
    line = np.full(int(starts[-1]), STOP, np.int64)
    inner = np.ones(len(line), bool)
    inner[starts[1:] - 1] = False
    line[inner] = k
    one = np.concatenate(([START], line[:-1]))[:len(line)]
    two = np.concatenate(([START, START], line[:-2]))[:len(line)]
    if n:
        one[starts[:-1]] = START
        two[starts[:-1]] = START
        second = starts[:-1][size > 1] + 1
        two[second] = START
    return (two * CLASSES + one) * CLASSES + line, starts


def suffix_tree(counts: np.ndarray) -> np.ndarray:
    """log10 P(class | two classes before) of every run, from counts in that shape."""
    kept_of = lambda n, p: (n * np.log(np.where(n > 0, n, 1) / np.maximum(n.sum(-1, keepdims=True), 1) / p)).sum(-1) \
        > 0.5 * (n > 0).sum(-1) * np.log(n.sum(-1) + 1)
    smooth = lambda n, p: (n + (n > 0).sum(-1, keepdims=True) * p) / np.maximum(1, n.sum(-1) + (n > 0).sum(-1))[..., None]
    counts = counts.astype(float)
    n1, n0 = counts.sum(0), counts.sum((0, 1))
    p0 = (n0 + 0.5) / (n0.sum() + 0.5 * len(n0))
    p1 = np.where(kept_of(n1, p0)[:, None], smooth(n1, p0), p0)
    p2 = np.where(kept_of(counts, p1[None])[..., None], smooth(counts, p1[None]), p1[None])
    return np.log10(p2)


def _line(w: V.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of texts with their ends (0) put in, the place of each in its
    text, and where each text begins."""
    size = np.diff(w.first) + 1
    starts = np.concatenate(([0], np.cumsum(size)))
    line = np.zeros(int(starts[-1]), np.uint64)
    inner = np.ones(len(line), bool)
    inner[starts[1:] - 1] = False
    line[inner] = w.hash
    return line, np.arange(len(line)) - np.repeat(starts[:-1], size), starts


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, x.dtype), x[:-1]))


def _longer(before: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Hash of a run of words, from those of the run without its last and without its first word."""
    return V.mix(before * _LONGER + run)


def _count_followers(depth, frequent, top, buckets, classes=None):
    """Mapper from texts to counts of (run of ``depth`` words, ``low``: the run and the next word
    without its first), in lists a bucket. Runs after a top word are dealt by both, others by the run.
    With ``classes`` also the counts of runs of three classes, in buckets of their own beyond those."""
    def flush(runs, lows, hot):
        c, low, hot = np.concatenate(runs), np.concatenate(lows), np.concatenate(hot)
        h = _longer(c, low)
        order, new = _alike(h)
        first, n = order[new], np.diff(np.append(new, len(h)))
        bucket = np.where(hot[first], h[first], c[first]) % np.uint64(buckets)
        bits = np.uint64(buckets.bit_length())
        order = np.argsort((bucket << (np.uint64(64) - bits)) | (c[first] >> bits))   # by bucket, then by run
        first, n, bucket = first[order], n[order], bucket[order].astype(np.int64)
        c, low = c[first], low[first]
        new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1]))))
        size, of = np.diff(np.append(new, len(c))), bucket[new]
        rows = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        outer = pa.array(np.append(rows, len(new)), pa.int32())
        inner = pa.array(np.append(new[rows], len(c)), pa.int32())
        cut = pa.ListArray.from_arrays
        return pa.record_batch([pa.array(of[rows]), cut(outer, pa.array(c[new].view(np.int64))), cut(outer, pa.array(size, pa.int32())),
                                cut(inner, pa.array(low.view(np.int64))), cut(inner, pa.array(n, pa.int32()))],
                               names=["bucket", "run", "size", "low", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lows, hot, size, cells = [], [], [], 0, np.zeros(CLASSES ** 3, np.int64)
        for batch in batches:
            data, offsets = V.flat(batch.column(0))
            for _, _, d, o in V.chunks(data, offsets):
                w = V.Words(d, o)
                if classes:
                    cells += np.bincount(_runs(classes.value.of(w), w.first)[0], minlength=len(cells))
                line, place, _ = _line(w)
                low = line
                for _ in range(depth - 1):
                    low = _longer(_before(low), low)
                c = _before(low)
                ok = np.flatnonzero((place >= depth) & passes(frequent.value, c))
                runs.append(c[ok])
                lows.append(low[ok])
                hot.append(np.isin(_before(line)[ok], top))
                size += len(ok)
                if size > FLUSH_RUNS:
                    yield flush(runs, lows, hot)
                    runs, lows, hot, size = [], [], [], 0
        if size:
            yield flush(runs, lows, hot)
        seen = np.flatnonzero(cells)
        if len(seen):
            seen = seen[np.argsort(seen % buckets, kind="stable")]
            of, first = np.unique(seen % buckets, return_index=True)
            outer, none = pa.array(np.append(first, len(seen)), pa.int32()), pa.array(np.zeros(len(of) + 1), pa.int32())
            cut = pa.ListArray.from_arrays
            yield pa.record_batch([pa.array(buckets + of), cut(outer, pa.array(seen)), cut(none, pa.array([], pa.int32())),
                                   cut(none, pa.array([], pa.int64())), cut(outer, pa.array(cells[seen], pa.int32()))],
                                  names=["bucket", "run", "size", "low", "n"])
    return run


def _sum_followers(group: pa.Table) -> pa.Table:
    """Sums of a bucket's counts; what followed a run once is left out. Runs of classes have no ``low``."""
    run, size, low, n = (group[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("run", "size", "low", "n"))
    if not len(low):
        order, new = _alike(run)
        none = pa.nulls(len(new), pa.int64())
        return pa.table([pa.array(run[order[new]]), none, none, pa.array(np.add.reduceat(n[order].astype(np.int64), new))],
                        names=["run", "low", "h", "n"])
    run = np.repeat(run, size)
    h = _longer(run.view(np.uint64), low.view(np.uint64))
    order, new = _alike(h)
    n = np.add.reduceat(n[order].astype(np.int64), new)
    kept, n = order[new[n > 1]], n[n > 1]
    return pa.table([pa.array(run[kept]), pa.array(low[kept]), pa.array(h[kept].view(np.int64)), pa.array(n)],
                    names=["run", "low", "h", "n"])


def word_states(texts: DataFrame, dictionary: DataFrame, total: int, top: np.ndarray, buckets: int, shelf: Written,
                classes=None, cells: np.ndarray | None = None) -> DataFrame | None:
    """(h, n, mass, state) of the kept states over words of the one column ``texts``: of each run and
    next word the part n / mass of the state that it holds, and of each state (its hash with
    ``_STATE``, ``state`` true) the part left to the next shorter one. ``dictionary``: (h, n) of all words.
    With broadcast ``classes`` the first pass also counts runs of three classes into ``cells``."""
    below = dictionary.select("h", "n", (F.col("n") * (1 / max(total, 1))).alias("share"))
    found, old = None, None
    for depth in range(1, DEPTH + 1):
        frequent = below.where((F.col("n") >= LEAST_SEEN) & (F.col("h") != 0))
        bits = bit_filter(frequent, F.col("h"))
        of_classes = classes if depth == 1 else None
        if not (bits.value.any() or of_classes):
            break
        counts = shelf.put(texts.mapInArrow(_count_followers(depth, bits, top, buckets, of_classes),
                                            "bucket long, run array<long>, size array<int>, low array<long>, n array<int>")
                           .groupBy("bucket").applyInArrow(_sum_followers, "run long, low long, h long, n long"))
        if of_classes:
            seen = counts.where("low IS NULL").select("run", "n").toArrow()
            cells[seen["run"].to_numpy()] = seen["n"].to_numpy()
            counts = counts.where("low IS NOT NULL")
            if not bits.value.any():
                shelf.drop(counts)
                break
        longer = shelf.put(counts.join(below.select(F.col("h").alias("low"), F.col("share").alias("shorter")), "low").drop("low")
                           .join(frequent.select(F.col("h").alias("run"), F.col("n").alias("seen")), "run"))
        shelf.drop(counts, *([old] if old is not None else []))
        share = F.col("n") / F.col("seen")
        states = shelf.put(longer.groupBy("run").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("kinds"), F.max("seen").alias("seen"),
                                                     F.sum(F.col("n") * F.log(share / F.col("shorter"))).alias("nats"))
                           .where(F.col("nats") > 0.5 * F.col("kinds") * F.log(F.col("seen") + 1))
                           .select("run", "held", (F.col("seen") + F.col("kinds")).alias("mass")))
        held = longer.select("run", "h", "n").join(states.select("run", "mass"), "run").select("h", "n", "mass", F.lit(False).alias("state"))
        left = states.select(F.col("run").bitwiseXOR(F.lit(int(_STATE.view(np.int64)))).alias("h"), (F.col("mass") - F.col("held")).alias("n"), "mass",
                             F.lit(True).alias("state"))
        kept = shelf.put(held.unionByName(left))
        shelf.drop(states)
        found = kept if found is None else found.unionByName(kept)
        below, old = longer.select("h", "n", share.alias("share")), longer
    if old is not None:
        shelf.drop(old)
    return found


class _Found:
    """Values by rising hashes, evenly spread over their range: a table over the first bits in it
    says where to look."""

    def __init__(self, h: np.ndarray, value: np.ndarray):
        self.h, self.value = h, value
        bits = max(1, len(h).bit_length() - 1)
        self.low = h[0] if len(h) else np.uint64(0)
        self.shift = np.uint64(max(0, int(h[-1] - h[0]).bit_length() - bits) if len(h) else 0)
        self.first = np.searchsorted(h - self.low, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        slot = np.minimum((np.maximum(h, self.low) - self.low) >> self.shift, np.uint64(len(self.first) - 1))
        at = np.minimum(self.first[slot.astype(np.int64)], len(self.h) - 1)
        on = np.flatnonzero(self.h[at] < h)
        while len(on):
            at[on] += 1
            on = on[at[on] < len(self.h)]
            on = on[self.h[at[on]] < h[on]]
        at = np.minimum(at, len(self.h) - 1)
        return at, self.h[at] == h

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each hash (0 if unknown), and whether it is known."""
        at, known = self.place(h)
        return np.where(known, self.value[at], 0.0) if len(self.h) else np.zeros(len(h)), known


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, compressed together by their last column, the chunk."""
    for batch in batches:
        chunk = batch.column(batch.num_columns - 1).to_numpy()
        order = np.argsort(chunk, kind="stable")
        sorted_rows = batch.select(batch.schema.names[:-1]).take(pa.array(order))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(chunk[order])) + 1, [len(chunk)])) if len(chunk) else np.zeros(1, np.int64)
        yield pa.record_batch([pa.array(chunk[order][cut[:-1]]), pa.array(_packed_rows(sorted_rows, cut), pa.binary())], names=["chunk", "rows"])


_PACKED = "bucket long, chunk long, h binary, n binary, mass binary"


def _squeezed(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: the first bytes of all, then the second ones, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueezed(x: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(kind).ravel()


def _steps(h: np.ndarray) -> bytes:
    """Rising hashes, by their distances."""
    return _squeezed(np.diff(h, prepend=np.uint64(0)))


def _hashes(x: bytes) -> np.ndarray:
    return np.cumsum(_unsqueezed(x, np.uint64), dtype=np.uint64)


@dataclass
class Buckets:
    """Ranges of hashes for about so many values. Questions are asked by the first bits of a hash,
    enough that a question for an unknown one seldom meets a value; no range parts such a prefix."""
    bits: int
    wide: int      # prefixes of a bucket

    @classmethod
    def of(cls, values: int, buckets: int) -> Buckets:
        bits = min(64, values.bit_length() + SPARE_BITS)
        return cls(bits, (1 << bits) // buckets + 1)

    def prefix(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.uint32 if self.bits <= 32 else np.uint64)

    def bounds(self, prefix: np.ndarray) -> list[int]:
        """Where the part of each bucket begins in rising prefixes, and their end."""
        borders = np.array(range(self.wide, 1 << self.bits, self.wide), prefix.dtype)
        return [0, *np.searchsorted(prefix, borders).tolist(), len(prefix)]


def _pack(h: np.ndarray, bounds: list[int], values: list[np.ndarray], chunk: int | None) -> pa.RecordBatch:
    """Rows (bucket, chunk, hashes, numbers, masses): one for each bucket, a range of the rising hashes."""
    held = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
    rows = [[_squeezed(x[at]) for _, at in held] for x in values] or [[None] * len(held)] * 2
    return pa.record_batch([pa.array([i for i, _ in held], pa.int64()), pa.array([chunk] * len(held), pa.int64()),
                            pa.array([_steps(h[at]) for _, at in held], pa.binary()), *[pa.array(r, pa.binary()) for r in rows]],
                           names=["bucket", "chunk", "h", "n", "mass"])


def _packed_values(buckets: Buckets):
    """Mapper from rows (h, n, mass) to packed ones of no chunk."""
    def flush(columns):
        h, n, mass = (np.concatenate(c) for c in zip(*columns))
        order = np.argsort(h.view(np.uint64))
        h = h.view(np.uint64)[order]
        return _pack(h, buckets.bounds(buckets.prefix(h)), [n[order], mass[order]], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, size = [], 0
        for batch in batches:
            columns.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > FLUSH_RUNS:
                yield flush(columns)
                columns, size = [], 0
        if size:
            yield flush(columns)
    return run


def _resolve(buckets: Buckets):
    """Mapper from a bucket's packed values and questions to the values that each chunk may mean, packed."""
    cut = np.uint64(64 - buckets.bits)

    def run(group: pa.Table) -> pa.Table:
        asked = pc.is_valid(group["chunk"])
        values, asks = group.filter(pc.invert(asked)), group.filter(asked)
        parts = [[f(x) for x in values[c].to_pylist()] for c, f in (("h", _hashes), ("n", _unsqueezed), ("mass", _unsqueezed))]
        h, n, mass = (np.concatenate([np.zeros(0, t), *p]) for p, t in zip(parts, (np.uint64, np.int64, np.int64)))
        order = np.argsort(h)
        h, n, mass, rows = h[order], n[order], mass[order], []
        known, prefix = _Found(h, n), h >> cut
        more = np.append(prefix[1:] == prefix[:-1], False)
        for chunk, packed in zip(asks["chunk"].to_pylist(), asks["h"].to_pylist()):
            question = _hashes(packed)
            at = known.place(question << cut)[0]
            at = at[prefix[at] == question] if len(h) else at[:0]
            found = [at]
            while len(at := at[more[at]] + 1):
                found.append(at)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            rows.append((chunk, int(h[at[0]]) >> 1 if len(at) else 0, _steps(h[at]), _squeezed(n[at]), _squeezed(mass[at])))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["chunk", "at", "h", "n", "mass"])
    return run


def _answers(group: pa.Table) -> _Found:
    """A chunk's answers; each row is of a range of the hashes of its own."""
    group = group.sort_by("at")
    h = np.concatenate([np.zeros(0, np.uint64), *(_hashes(x.as_py()) for x in group["h"])])
    value = [_unsqueezed(n.as_py()) / _unsqueezed(mass.as_py()) for n, mass in zip(group["n"], group["mass"])]
    return _Found(h, np.concatenate([np.zeros(0), *value]))


def _questions(w: V.Words, kept: np.ndarray, held: np.ndarray) -> list[np.ndarray]:
    """The distinct hashes to ask for: the words, the runs that the bit filter of states lets
    through, and of these with their next words those that the filter of held runs lets through.
    States have a filter of their own: they are few, and what follows a run that is none isn't asked."""
    h = [_rising(w.hash)]
    low, place, _ = _line(w)
    for depth in range(1, DEPTH + 1):
        c = _before(low)
        low = _longer(c, low)
        at = np.flatnonzero(place >= depth)
        at = at[passes(kept, c[at] ^ _STATE)]
        h.append(_rising(c[at] ^ _STATE))
        h.append(_rising(low[at[passes(held, low[at])]]))
    return h


NEW_COLUMNS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_texts(docs: DataFrame, text: str, train: Column, keep: list[str]) -> DataFrame:
    """``keep`` columns and n_tokens, n_known, train_tokens (long), base_score,
    score (double, log10) of each row, learned from the rows where ``train``.

    Null and empty texts are an end alone. Without training rows every count is
    0 and each symbol as likely as any other. Repeated rows count and are scored
    each; ``keep`` columns named like the new ones are left out.

    The scored rows are written to the checkpoint folder and stay there until it is
    cleared: the returned table reads them.
    """
    with shuffles_end_with_writes(docs.sparkSession):
        return _score_texts(docs, text, train, [c for c in keep if c not in NEW_COLUMNS])


def _score_texts(docs: DataFrame, text: str, train: Column, keep: list[str]) -> DataFrame:
    spark = docs.sparkSession
    shelf = Written(spark, "suffix-tree")
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)],
                         F.col(f"`{text}`").alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    size = source.agg(F.sum(F.octet_length(F.coalesce("_text", F.lit(""))) + 64)).first()[0] or 0
    learned = source.where("_train").select("_text")
    counted = shelf.put(learned.mapInArrow(_count_words(size // CHUNK + 1), "bucket long, rows binary")
                        .groupBy("bucket").applyInArrow(_sum_words, "h long, word binary, n long"))
    classes, words, times = choose_classes(counted)
    total, kinds = int(times.sum()), int(words.sum())
    floor, room = np.log10(total + 0.5 * (kinds + 1)), np.log10(times + 0.5 * (words + 1))
    classes = spark.sparkContext.broadcast(classes)
    cells = np.zeros(CLASSES ** 3, np.int64)
    rounds = min(ROUNDS, size // CHUNK + 1)
    chunk = F.pmod(F.xxhash64(*[f"_k{i}" for i in range(len(keep))], F.crc32(F.encode("_text", "UTF-8"))), F.lit(size // CHUNK + 1))
    dealt = source.withColumn("chunk", chunk).drop("_train")
    lookup = counted.select("h", "n", F.expr("1L").alias("mass"))
    states = word_states(learned, counted, total, classes.value.top, size // CHUNK + 1, shelf, classes, cells)
    tree = spark.sparkContext.broadcast(suffix_tree(cells.reshape((CLASSES,) * 3)).ravel())
    if states is not None:
        lookup = lookup.unionByName(states.drop("state"))
    kept, held = (bit_filter(states.where(F.col("state") == is_state) if states is not None else counted.limit(0), F.col("h"))
                  for is_state in (True, False))
    known = lookup.count()
    buckets = Buckets.of(known, (known + size // 16) // BUCKET + 1)
    values = shelf.put(lookup.mapInArrow(_packed_values(buckets), _PACKED))
    shelf.drop(lookup)

    def ask(group: pa.Table) -> pa.Table:
        h, size = [buckets.prefix(np.zeros(1, np.uint64))], 0
        for texts in _unpacked_rows(group["rows"]):
            for _, _, d, o in V.chunks(*V.flat(texts["_text"])):
                w = V.Words(d, o)
                h += (asked := [buckets.prefix(x) for x in _questions(w, kept.value, held.value)])
                size += sum(map(len, asked))
                if size > FLUSH_RUNS // 2 + len(h[0]) // 2:
                    h, size = [_rising(np.concatenate(h))], 0
        prefix = _rising(np.concatenate(h))
        return pa.Table.from_batches([_pack(prefix.astype(np.uint64), buckets.bounds(prefix), [], group["chunk"][0].as_py())])

    def answer(group: pa.Table, found: pa.Table) -> pa.Table:
        known = _answers(found)
        ends = known.of(np.zeros(1, np.uint64))[0][0]
        return pa.concat_tables([_scored(texts, known, ends) for texts in _unpacked_rows(group["rows"])])

    def _scored(texts: pa.Table, known: _Found, ends: float) -> pa.Table:
        data, offsets = V.flat(texts["_text"])
        out = np.zeros((4, len(offsets) - 1))
        for a, b, d, o in V.chunks(data, offsets):
            w = V.Words(d, o)
            n = known.of(w.hash)[0]
            share, end = np.log10(n + 0.5), np.log10(ends + 0.5)
            k = classes.value.of(w)
            cell, starts = _runs(k, w.first)
            out[0, a:b] = np.diff(w.first) + 1
            for i, v, last in ((1, n > 0, ends > 0), (2, share - floor, end - floor)):
                run = np.concatenate(([0.0], np.cumsum(v, dtype=np.float64)))
                out[i, a:b] = run[w.first[1:]] - run[w.first[:-1]] + last
            low, place, _ = _line(w)
            chance = np.full(len(low), end - room[STOP])
            chance[np.delete(np.arange(len(low)), starts[1:] - 1)] = share - room[k]
            chance = 10 ** (chance + tree.value[cell])
            for depth in range(1, DEPTH + 1):
                c = _before(low)
                low = _longer(c, low)
                inside = np.flatnonzero(place >= depth)
                inside = inside[passes(kept.value, c[inside] ^ _STATE)]
                left, state = known.of(c[inside] ^ _STATE)
                at = inside[state]
                chance[at] = known.of(low[at])[0] + left[state] * chance[at]
            run = np.concatenate(([0.0], np.cumsum(np.log10(chance))))
            out[3, a:b] = run[starts[1:]] - run[starts[:-1]]
        cols = [texts[k] for k in keys]
        cols += [pa.array(out[0].astype(np.int64)), pa.array(np.rint(out[1]).astype(np.int64)),
                 pa.array(np.full(len(offsets) - 1, total, np.int64)), pa.array(out[2]), pa.array(out[3])]
        return pa.table(cols, names=[*keys, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    keys = [f"_k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{k} {kind}" for k, (_, kind) in zip(keys, source.dtypes)) + \
        ", n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = None
    for part in range(rounds):
        texts = dealt.where(F.col("chunk") % rounds == part).mapInArrow(_pack_texts, "chunk long, rows binary")
        answers = (texts.groupBy("chunk").applyInArrow(ask, _PACKED).unionByName(values)
                   .groupBy("bucket").applyInArrow(_resolve(buckets), "chunk long, at long, h binary, n binary, mass binary"))
        rows = shelf.put(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(answer, schema))
        scored = rows if scored is None else scored.unionByName(rows)
    shelf.drop(values)
    return scored.select(*[F.col(k).alias(c) for k, c in zip(keys, keep)], *NEW_COLUMNS)
