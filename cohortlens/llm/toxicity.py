"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades: 0 for documents not marked toxic; marked ones get 1, or 2 when they
hold at least ``strong`` different telling features (features that nearly only
marked documents of the sample have). One weight vector is shared by all
thresholds: P(grade >= k) = sigmoid(w.x - t_k). Features are the distinct words
(runs of letters and digits, A-Z lower-cased) of a text and their beginnings of
4 to 8 bytes, so other endings of a word are found too. Weights are fitted by
accelerated proximal gradient with an L1 penalty on a bounded sample; only
features with a weight remain, known by their 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import vectext as V
from cohortlens.llm.sample import fitted

BEGINNINGS = (4, 5, 6, 7, 8)
_SIEVE = 1 << 22
_TAG = np.uint64(0xA5A5A5A55A5A5A5A)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, where each text's begin) of the words and of their beginnings."""
    w = V.Words(data, offsets, V.ALNUM)
    out = [(w.hash, w.first)]
    for n in BEGINNINGS:
        longer = w.end - w.start > n
        at = np.concatenate(([0], np.cumsum(longer)))
        out.append((w.span_hash(w.start[longer], w.start[longer] + n) ^ _TAG, at[w.first]))
    return out


@dataclass
class Model:
    known: np.ndarray      # sorted feature hashes
    weight: np.ndarray
    thresholds: np.ndarray

    def grades(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 .. of each text, as rows."""
        data, offsets = V.flat(texts)
        x = np.zeros(len(offsets) - 1)
        sieve = np.zeros(_SIEVE, bool)
        sieve[(self.known % np.uint64(_SIEVE)).astype(np.int64)] = True
        for a, b, d, o in V.chunks(data, offsets):
            for h, first in features(d, o):
                hit = np.flatnonzero(sieve[(h & np.uint64(_SIEVE - 1)).astype(np.int64)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.known, h[hit]), len(self.known) - 1)
                same = self.known[at] == h[hit]
                row = np.searchsorted(first, hit[same], "right") - 1
                pair = np.unique(row * len(self.known) + at[same])
                np.add.at(x, a + pair // len(self.known), self.weight[pair % len(self.known)])
        return _sigmoid(x[:, None] - self.thresholds[None, :])


def _sparse(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hashes in ``least`` texts or more, row and feature number of each entry)."""
    rows, hashes = [], []
    data, offsets = V.flat(texts)
    for a, b, d, o in V.chunks(data, offsets):
        parts = features(d, o)
        for i in range(b - a):
            u = np.unique(np.concatenate([h[f[i]:f[i + 1]] for h, f in parts]))
            hashes.append(u)
            rows.append(np.full(len(u), a + i, np.int32))
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    r = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    known, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
    keep = n >= least
    number = np.cumsum(keep) - 1
    mask = keep[inverse]
    return known[keep], r[mask], number[inverse[mask]].astype(np.int32)


def fit(texts: pa.Array, toxic: np.ndarray, strong: int = 3, least: int = 3, telling: float = 0.9,
        penalty: float = 1e-4, rounds: int = 300) -> Model:
    known, row, col = _sparse(texts, least)
    n, m = len(toxic), len(known)
    seen = np.bincount(col, minlength=m)
    share = np.bincount(col, weights=toxic[row], minlength=m) / np.maximum(1, seen)
    hits = np.bincount(row, weights=(share >= telling)[col], minlength=n)
    grade = np.where(toxic > 0, np.where(hits >= strong, 2, 1), 0)
    least_grade = [(grade >= k).astype(float) for k in (1, 2)]
    if not n or toxic.min() == toxic.max():
        # nothing to tell apart: everything has the only grade there is
        top = 30.0 if not n or toxic.max() == 0 else -30.0
        return Model(np.zeros(1, np.uint64), np.zeros(1), np.array([top, max(top, 0.0)]))
    # features that say little either way only slow the fit
    base = toxic.mean()
    z = (share - base) * np.sqrt(seen / (base * (1 - base)))
    use = np.abs(z) > 3
    number = np.cumsum(use) - 1
    mask = use[col]
    known, row, col = known[use], row[mask], number[col[mask]]
    m = len(known)
    w, t = np.zeros(m), np.array([1.0, 2.0])
    yw, yt, a = w.copy(), t.copy(), 1.0
    # the slope's steepness is at most the texts' mean feature count times 1/2
    rate = 1.0 / (0.5 * (len(row) / n + 1) + 1e-9)

    def slope(w, t):
        x = np.bincount(row, weights=w[col], minlength=n)
        g = [_sigmoid(x - t[k]) - least_grade[k] for k in (0, 1)]
        both = (g[0] + g[1]) / n
        return np.bincount(col, weights=both[row], minlength=m), -np.array([g[0].mean(), g[1].mean()])

    for _ in range(rounds):
        gw, gt = slope(yw, yt)
        nw = yw - rate * gw
        nw = np.sign(nw) * np.maximum(0, np.abs(nw) - rate * penalty)
        nt = yt - rate * gt
        nt[1] = max(nt[1], nt[0] + 1e-3)
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        yw, yt = nw + (a - 1) / b * (nw - w), nt + (a - 1) / b * (nt - t)
        w, t, a = nw, nt, b
    kept = w != 0
    if not kept.any():
        return Model(np.zeros(1, np.uint64), np.zeros(1), t)
    return Model(known[kept], w[kept], t)


def fit_toxicity(sample: DataFrame) -> Model:
    """``sample``: a bounded table of ``y`` (0, 1) and ``text``."""
    return fitted(sample, fit)


def grade_column(text: Column, model: Model) -> Column:
    """Array of P(grade >= 1), P(grade >= 2) for each whole text (null: as empty)."""
    known, weight, thresholds = model.known, model.weight, model.thresholds

    @F.arrow_udf("array<double>")
    def grade(texts: pa.Array) -> pa.Array:
        p = Model(known, weight, thresholds).grades(texts)
        return pa.array(list(p), pa.list_(pa.float64()))
    return grade(text)
