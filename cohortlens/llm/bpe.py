"""Byte-level BPE: encode by backtracking over longest matches, and decode.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the
vocabulary finds, in one pass over a piece, every token at every place. Tokens
are then taken greedily, the longest first; a token is kept only if it may
stand next to the one before. Two tokens may if merging their joined bytes by
rank gives back just those two, which the parts along their border tell
(memoised). A place where nothing fits is marked
dead, and the token that led there is given up for a shorter one, so each place
is visited a bounded number of times. A sequence whose neighbours all fit is
the one that merging by rank makes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 64  # bytes of a piece whose longest matches are asked for place by place
PIECES, PAIRS = 300_000, 500_000  # entries of the memos; what a full one forgets costs time only


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pieces(dict):
    """Packed ids of the pieces seen lately: when ``PIECES`` have come in, those not
    asked for since the last time are let go."""

    def __init__(self, encoder: Encoder):
        self.encoder, self.before = encoder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", self.encoder.encode_bytes(piece.encode())).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > PIECES:
            self.before = dict(self)
            self.clear()


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.edges: dict[int, tuple | None] = {}
        self.beginning: dict[int, int | None] = {}
        self.size = {i: len(t) for i, t in self.token.items()}

    def merged(self, b: bytes, down_to: int = 1) -> list[bytes]:
        """Parts after merging the lowest-ranked neighbours again and again, until
        nothing merges or ``down_to`` parts are left."""
        parts = [b[i:i + 1] for i in range(len(b))]
        while len(parts) > down_to:
            rank, i = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, i: int) -> tuple | None:
        """For a token that merging makes: what stands at its right and at its left
        end while it is being made, from a byte up to itself, each with its rank.
        None for a token that merging never makes."""
        if i not in self.edges:
            right, left = [self.token[i]], [self.token[i]]
            whole = len(self.token[i]) == 1 or len(self.merged(self.token[i])) == 1
            for side, k in ((right, -1), (left, 0)):
                while whole and len(side[-1]) > 1:
                    side.append(self.merged(side[-1], 2)[k])
            # single bytes are there from the start, whatever their rank
            steps = lambda side: tuple((t, self.ranks[t] if len(t) > 1 else -1) for t in reversed(side))
            self.edges[i] = (steps(right), steps(left)) if whole else None
        return self.edges[i]

    def may_follow(self, a: int | None, b: int) -> bool:
        """Whether merging the two tokens' joined bytes never merges across their border
        (first token of a piece: whether merging makes it)."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            left, right = None if a is None else self.edge(a), self.edge(b)
            self.fits[a, b] = known = right is not None and (left is None or self._apart(left[0], right[1]))
        return known

    def _apart(self, x: tuple, y: tuple) -> bool:
        i = j = 0
        while True:
            across = self.ranks.get(x[i][0] + y[j][0], 1 << 62)
            own = x[i + 1][1] if i + 1 < len(x) else 1 << 61
            other = y[j + 1][1] if j + 1 < len(y) else 1 << 61
            if across < own and across <= other:  # of equal ranks the leftmost merges first
                return False
            if own == other == 1 << 61:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def encode_bytes(self, b: bytes) -> list[int]:
        """Ids of one piece."""
        if not b:
            return []
        if (whole := self.ranks.get(b)) is not None:
            return [whole]
        text, fits, size, ids, at, last = b.decode("latin-1"), self.fits, self.size, [], 0, None
        for _, token in self.automaton.iter_long(text):  # every byte is a token, so matches join up
            fit = fits.get((last, token))
            if not (self.may_follow(last, token) if fit is None else fit):
                break
            ids.append(token)
            at += size[token]
            last = token
        else:
            return ids
        dead = bytearray(len(b) + 1)
        longest = self.longest(text) if len(b) > SHORT else None
        while True:
            while token is not None:
                end = at + size[token]
                if not dead[end]:
                    fit = fits.get((last, token))
                    if self.may_follow(last, token) if fit is None else fit:
                        break
                token = self.shorter(token)
            if token is not None:
                ids.append(token)
                if end == len(b):
                    return ids
                at, last = end, token
                token = longest[at] if longest else next(self.automaton.iter_long(text, at))[1]  # the longest that begins here
            elif ids:
                dead[at] = 1
                token = ids.pop()
                at -= size[token]
                token, last = self.shorter(token), ids[-1] if ids else None
            else:
                raise ValueError("the vocabulary lacks a byte")

    def longest(self, text: str) -> list[int]:
        """The longest token that begins at each place, in one pass."""
        found = [0] * len(text)
        for end, i in self.automaton.iter(text):
            found[end + 1 - self.size[i]] = i  # ends come in order, so the longest match of a place stays
        return found

    def shorter(self, i: int) -> int | None:
        """The longest token that is a beginning of this one."""
        if i not in self.beginning:
            t = self.token[i]
            self.beginning[i] = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), None)
        return self.beginning[i]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        self.pieces.trim()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return decoded(ids, self.token)


def decoded(ids: bytes, token: dict[int, bytes]) -> bytes:
    """The bytes of packed ids."""
    return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """The ids of each text, packed as little-endian unsigned 32-bit integers
    (binary, four bytes an id). Null and empty texts have none."""
    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(load_ranks(path), pattern)  # with its memos it ends with the partition
        for texts in batches:
            yield pa.array((e.encode(t.as_py() or "") for t in texts), pa.binary(), size=len(texts))
    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The bytes that packed ids stand for (null: none)."""
    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {i: t for t, i in load_ranks(path).items()}
        for packed in batches:
            yield pa.array((decoded(p.as_py() or b"", tokens) for p in packed), pa.binary(), size=len(packed))
    return decode(ids)


def _round_trip(text: Column, path: str, pattern: str) -> Column:
    """(ids, decoded) of each text, by one worker: the packed ids, and the bytes that they decode to."""
    @F.arrow_udf("struct<ids binary, decoded binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = Encoder(load_ranks(path), pattern)
        for texts in batches:
            ids = pa.array((e.encode(t.as_py() or "") for t in texts), pa.binary(), size=len(texts))
            back = pa.array((decoded(p.as_py(), e.token) for p in ids), pa.binary(), size=len(texts))
            yield pa.StructArray.from_arrays([ids, back], names=["ids", "decoded"])
    return both(text)


def with_token_ids(df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the packed ids of ``text`` in column ``ids`` (binary), and, if
    ``decoded`` names a column, the bytes that they decode to. Columns of those
    names are replaced; whole texts of any length; an empty table stays empty."""
    if not decoded:
        return df.withColumn(ids, encode_column(F.col(f"`{text}`"), path, pattern))
    kept = [c for c in df.columns if c not in (ids, decoded)]
    both = df.select(*[F.col(f"`{c}`") for c in df.columns], _round_trip(F.col(f"`{text}`"), path, pattern).alias("_round_trip"))
    return both.select(*[F.col(f"`{c}`") for c in kept], F.col("_round_trip.ids").alias(ids), F.col("_round_trip.decoded").alias(decoded))
