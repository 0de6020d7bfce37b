"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and character
3- and 4-grams, and of one vector for each way a word can stand again beside
itself (so repetition shows whatever the word); a softmax layer over that average gives the class. Fitting is
stochastic gradient descent in numpy on a bounded labelled sample. For scoring,
the softmax layer is folded into the vectors: each bucket is one number, so a
batch of texts takes a table look-up and running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectext as V
from cohortlens.llm.sample import fitted

GRAMS = (3, 4)


@dataclass
class Model:
    weight: np.ndarray  # for each bucket, what it adds to the log-odds of class 1
    bits: int

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of class 1; a text without features scores 0.5."""
        data, offsets = V.flat(texts)
        out = np.full(len(offsets) - 1, 0.5)
        for a, b, d, o in V.chunks(data, offsets):
            total, count = np.zeros(b - a), np.zeros(b - a)
            for buckets, first, last in features(d, o, self.bits):
                run = np.concatenate(([0.0], np.cumsum(self.weight[buckets], dtype=np.float64)))
                total += run[last] - run[first]
                count += last - first
            out[a:b] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1), -500, 500)))
        return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, repeated words, then each gram size: the bucket of every feature of a chunk,
    and where each text's features begin and end."""
    size = np.uint64(64 - bits)
    w = V.Words(data, offsets, lower=False)
    buckets = (w.hash >> size).astype(np.int64)
    yield buckets, w.first[:-1], w.first[1:]
    again = np.zeros(len(buckets), np.int64)
    for k in (2, 1):  # a word that stands again one or two words on is a pair feature of its own
        again[k:][w.hash[k:] == w.hash[:-k]] = k
    again[w.first[:-1][w.first[:-1] < len(again)]] = 0
    yield again + ((1 + len(GRAMS)) << bits), w.first[:-1], w.first[1:]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    for k, n in enumerate(GRAMS, 1):
        m = max(0, len(points) - n + 1)
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h = (h ^ points[j:j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        last = np.minimum(np.maximum(starts[1:] - n + 1, starts[:-1]), m)
        yield (h >> np.uint32(32 - bits)).astype(np.int64) + (k << bits), np.minimum(starts[:-1], last), last


def fit(texts: pa.Array, y: np.ndarray, bits: int = 17, dim: int = 8, rate: float = 0.5, steps: int = 30_000, seed: int = 7) -> Model:
    """Stochastic gradient descent over the sample, at least five times through,
    the rate falling to zero. Without both classes, every text scores 0.5."""
    size = ((1 + len(GRAMS)) << bits) + 3
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.float32), bits)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    data, offsets = V.flat(texts)
    for a, b, d, o in V.chunks(data, offsets):
        parts = list(features(d, o, bits))
        for i in range(b - a):
            ids, n = np.unique(np.concatenate([f[s[i]:e[i]] for f, s, e in parts]), return_counts=True)
            docs.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer = np.zeros((2, dim), np.float32)
    epochs = max(5, -(-steps // len(docs)))
    done, whole = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)).tolist():
            ids, share = docs[i]
            lr = np.float32(rate * (1 - done / whole))
            done += 1
            mean = share @ vectors[ids]
            z = layer @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            step = p @ layer
            layer -= lr * np.outer(p, mean)
            vectors[ids] -= lr * np.outer(share, step)
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), bits)


def fit_quality(sample: DataFrame) -> Model:
    """``sample``: a bounded table of ``y`` (0, 1) and ``text``."""
    return fitted(sample, fit)


def score_column(text: Column, model: Model) -> Column:
    """Probability of class 1 for each whole text; null and empty texts 0.5."""
    weight, bits = model.weight, model.bits

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(Model(weight, bits).scores(texts), pa.float64())
    return score(text)
