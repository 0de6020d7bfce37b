"""Nearest neighbours by cross-polytope hashing with multiprobe.

In each of ``tables`` tables a vector, scaled to length 1, is turned by fast
pseudo-rotations (three rounds of random signs and a Hadamard transform) and
falls to the nearest signed axis of each, its largest coordinate. The first
rotation has all axes; further ones, the last with part of its axes, split each
bucket into ``cells``, a number that grows with the square root of the table, as
their share of the table falls. A query looks at the buckets whose axes are nearest
together, more of them as there are more cells, but fewer vectors in all: the
share of the table that it sees falls with the fourth root of the table's size.
What it finds is ranked by the exact Euclidean distance of the original vectors
in double precision. Queries that find too few look again at more buckets, at last at
all axes of one table, where every vector is.

From one count of all buckets (``tables`` x axes x cells numbers), small buckets
share a bin of bounded size and large ones are cut into blocks of bounded
numbers of vectors and of queries, so a bucket that holds a third of all vectors is
spread over many tasks; each block returns its best few for each query. Nothing but
those counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

VECTORS_A_BLOCK = 4096
QUERIES_A_BLOCK = 2048
VECTORS_A_CELL = 250    # cells are the square root of so many times fewer than the vectors


class CrossPolytope:
    """``tables`` hashes of ``axes * cells`` buckets each; ``cells`` is a power of two."""

    def __init__(self, dim: int, tables: int, cells: int = 1, seed: int = 11):
        self.dim, self.tables = dim, tables
        self.width = 1 << max(0, dim - 1).bit_length()
        self.axes = 2 * self.width
        self.kept = [self.width]    # coordinates that each rotation's axes are taken from
        while cells > 1:
            self.kept.append(min(self.width, cells // 2))
            cells //= 2 * self.kept[-1]
        self.buckets = int(np.prod([2 * d for d in self.kept]))
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.kept), 3, self.width))

    def rotated(self, x: np.ndarray, table: int, nth: int = 0) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, :self.dim] = x
        for signs in self.signs[table, nth]:
            y *= signs
            half = 1
            while half < self.width:
                z = y.reshape(len(y), self.width // (2 * half), 2, half)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), 2).reshape(len(y), self.width)
                half *= 2
        return y / np.sqrt(self.width) ** 3

    def nearest(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest buckets of each vector, nearest first: by the sum over the
        rotations of how much smaller than the largest the axis' coordinate is, squared."""
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        if not len(x):
            return code
        for nth, kept in enumerate(self.kept):
            y = self.rotated(x, table, nth)[:, :kept]
            y = np.concatenate((-y, y), 1)
            axis = np.argsort(y, 1, kind="stable")[:, :n]
            y = np.take_along_axis(y, axis, 1)
            both = (cost[:, :, None] + ((y - y[:, :1]) ** 2)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * kept) + axis[:, None, :]).reshape(len(x), -1)
            first = np.argsort(both, 1, kind="stable")[:, :n]
            code, cost = np.take_along_axis(code, first, 1), np.take_along_axis(both, first, 1)
        return code


def cells_for(n: int) -> int:
    """Into how many cells each of the first axes' buckets is split for ``n`` vectors."""
    return 1 << max(0, int(np.log2(max(1, n / VECTORS_A_CELL)) / 2))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(wide, lambda v: v != 0), F.lit(False))


def nearest(df: DataFrame, vec_id: str, vector: str, is_query: Column, k: int = 10, tables: int = 16,
            probes: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among
    all other ids, nearest first, ties to the smaller id; all other ids if they are fewer.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than the commonest (ties: the smaller),
    nor null ids. Of repeated ids the nearest row counts. An empty table, or one
    without queries, gives no rows.
    """
    good = (df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("vector"),
                      F.coalesce(is_query, F.lit(False)).alias("asks"))
            .where(F.col("vec_id").isNotNull() & usable(F.col("vector"))))
    common = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], out)
    dim = common["d"]
    good = good.where(F.size("vector") == dim)
    axes, cells, looked = CrossPolytope(dim, 1).axes, 1, probes
    if probes < axes:
        cells = cells_for(common["n"])
        looked = int(probes * np.sqrt(cells))
    polytope = CrossPolytope(dim, tables, cells)
    size = polytope.buckets

    def buckets(x: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        x = _unit(x)
        for t in range(tables):
            yield t, t * size + polytope.nearest(x, t, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = np.zeros(tables * size, np.int64), np.zeros(tables * size, np.int64)
        for batch in batches:
            x, asks = _vectors(batch.column(1), dim), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for _, b in buckets(x, 1):
                held += np.bincount(b[:, 0], minlength=len(held))
            for _, b in buckets(x[asks], looked):
                asked += np.bincount(b.ravel(), minlength=len(asked))
        at = np.flatnonzero(held + asked)
        yield pa.record_batch([pa.array(at), pa.array(held[at]), pa.array(asked[at])], names=["bucket", "held", "asked"])

    sizes = (good.mapInArrow(count, "bucket long, held long, asked long").groupBy("bucket")
             .agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).orderBy("bucket").toArrow())
    held_in, asked_in = np.zeros(tables * size, np.int64), np.zeros(tables * size, np.int64)
    held_in[sizes["bucket"].to_numpy()] = sizes["held"].to_numpy()
    asked_in[sizes["bucket"].to_numpy()] = sizes["asked"].to_numpy()
    shelves, desks = np.maximum(1, -(-held_in // VECTORS_A_BLOCK)), np.maximum(1, -(-asked_in // QUERIES_A_BLOCK))
    large = (shelves > 1) | (desks > 1)
    load = np.where(large, 0, np.maximum(held_in / VECTORS_A_BLOCK, asked_in / QUERIES_A_BLOCK))
    bins = np.where(large, -1 - np.arange(len(load)), np.cumsum(load).astype(np.int64))
    layout = df.sparkSession.sparkContext.broadcast((bins, shelves, desks, held_in > 0, asked_in > 0))

    def spread(rows: np.ndarray, bucket: np.ndarray, ids: np.ndarray, mine: np.ndarray, other: np.ndarray):
        """Rows once for each block of the other side: (row, bucket, own block, other block)."""
        times = other[bucket]
        row = np.repeat(rows, times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        bucket = np.repeat(bucket, times)
        return row, bucket, ids[row] % mine[bucket], nth

    def shelve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            bins, shelves, desks, _, wanted = layout.value
            for _, b in buckets(_vectors(column, dim), 1):
                rows = np.flatnonzero(wanted[b[:, 0]])
                row, bucket, shelf, desk = spread(rows, b[rows, 0], ids, shelves, desks)
                yield pa.record_batch([pa.array(bins[bucket]), pa.array(shelf), pa.array(desk), pa.array(bucket), pa.array(ids[row]),
                                       column.take(pa.array(row))], names=["bin", "shelf", "desk", "bucket", "vec_id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            bins, shelves, desks, filled, _ = layout.value
            for _, b in buckets(_vectors(column, dim), looked):
                rows, found = np.repeat(np.arange(len(ids)), b.shape[1]), b.ravel()
                rows, found = rows[filled[found]], found[filled[found]]
                row, bucket, desk, shelf = spread(rows, found, ids // 100, desks, shelves)
                # one row for the buckets of a query that are in one bin
                order = np.lexsort((bucket, shelf, bins[bucket], row))
                row, bucket, desk, shelf = row[order], bucket[order], desk[order], shelf[order]
                key = np.stack((row, bins[bucket], shelf, desk))
                new = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0)))) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(bucket))
                row, shelf, desk, bucket = row[new], shelf[new], desk[new], bucket[new]
                yield pa.record_batch([pa.array(bins[bucket]), pa.array(shelf), pa.array(desk), lists, pa.array(ids[row]),
                                       column.take(pa.array(row))], names=["bin", "shelf", "desk", "buckets", "query_id", "vector"])

    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if held.num_rows and asked.num_rows:
            bucket = held["bucket"].to_numpy()
            order = np.argsort(bucket, kind="stable")
            bucket, all_ids, all_x = bucket[order], held["vec_id"].to_numpy()[order], _vectors(held["vector"].combine_chunks(), dim)[order]
            for q, mine, y in zip(asked["query_id"].to_pylist(), asked["buckets"].to_pylist(), _vectors(asked["vector"].combine_chunks(), dim)):
                a, b = np.searchsorted(bucket, mine, "left"), np.searchsorted(bucket, mine, "right")
                at = np.concatenate([np.arange(i, j) for i, j in zip(a, b)])
                ids = all_ids[at]
                diff = all_x[at] - y
                score = np.sqrt((diff * diff).sum(1))
                own = ids != q
                near, score = ids[own], score[own]
                if len(near) > k:
                    close = score <= np.partition(score, k - 1)[k - 1]
                    near, score = near[close], score[close]
                    first = np.lexsort((near, score))[:k]
                    near, score = near[first], score[first]
                found.append((np.full(len(near), q, np.int64), near, score))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    kind = dict(good.dtypes)["vector"]
    keys = ["bin", "shelf", "desk"]
    shelved = good.select("vec_id", "vector").mapInArrow(shelve, f"bin long, shelf long, desk long, bucket long, vec_id long, vector {kind}")
    asked = good.where("asks").select("vec_id", "vector").mapInArrow(ask, f"bin long, shelf long, desk long, buckets array<long>, query_id long, vector {kind}")
    found = shelved.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ensure_checkpoint_dir(df.sparkSession)
    few = (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
           .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
           .select("query_id", "rank", "vec_id", "score"))
    if probes >= axes:
        return few
    few = few.checkpoint()
    short = (good.where("asks").select(F.col("vec_id").alias("query_id")).distinct()
             .join(few.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
             .where(F.coalesce("n", F.lit(0)) < k).select("query_id").checkpoint())
    if short.isEmpty():
        return few
    again = (good.join(short, good["vec_id"] == short["query_id"], "left")
             .select("vec_id", "vector", (F.col("asks") & F.col("query_id").isNotNull()).alias("asks")))
    more = nearest(again, "vec_id", "vector", F.col("asks"), k, *((1, axes) if 4 * probes >= axes else (tables, 4 * probes)))
    return few.join(short, "query_id", "left_anti").select(few.columns).unionByName(more)
