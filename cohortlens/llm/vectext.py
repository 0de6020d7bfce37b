"""Whole Arrow batches of texts as flat numpy arrays.

A batch is cut into chunks of bounded bytes (a longer text is a chunk of its
own); a chunk's texts lie end to end in one byte array, so cutting and hashing
its words takes a few vector operations and no loop over words. Word hashes
are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
# Bytes that separate words (space, and 0x09 to 0x0D).
_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[_SPACES] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240817)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POSITION = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        a = np.full(max(n, CHUNK_BYTES + 1, 1), base, np.uint64)
        a[0] = 1
        _powers[name] = have = np.multiply.accumulate(a)
    return have[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: empty) and the n + 1 offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return flat_binary(pc.fill_null(texts.cast(pa.large_string()), ""))


def flat_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for a column of bytes."""
    a = values.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1 + a.offset)[a.offset:] if len(a) else np.zeros(1, np.int64)
    data = a.buffers()[2] if len(a) else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of ``limit`` bytes at most."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        a = b


class Words:
    """The words of a chunk: ``start``/``end`` byte positions, ``hash``, and
    ``first``, the n + 1 places where each text's words begin. Words are runs of
    bytes of one ``kind``, or that ``mask`` marks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD, lower: bool = True,
                 mask: np.ndarray | None = None):
        self.data = LOWER[data] if lower else data
        inside = kind[data] if mask is None else mask
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | cut[1:n]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:] | cut[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._total: np.ndarray | None = None
        self._hash: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each start to its end."""
        n = len(self.data)
        if self._total is None:
            self._total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _power("p", _BASE, n), out=self._total[1:])
        h = (self._total[end] - self._total[start]) * _power("q", _BASE_INV, n + 1)[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes (over text borders too)."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += h[k:k + n] * _POSITION[k]
    return mix(out)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct ``size``-word shingle hashes; a text of fewer
    words is one shingle, a text without words none."""
    all_windows, out, h = windows(w.hash, size), [], w.hash
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= size:
            s = np.sort(all_windows[a:b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = np.append(h[a:b] * _POSITION[:b - a], _POSITION[32 + b - a])
            out.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
