"""Whitening by the singular values of the centred rows, through a bidiagonal matrix.

Rows are centred with exact sums of whole numbers; each task reduces its rows block by
block to the triangle R of a QR factorisation, and triangles are merged by groups until
one is left (as wide and as high as the vectors are long). Householder reflections
make R bidiagonal, differential quotient-difference steps with shifts (dqds) find its
singular values to high relative accuracy, and a twisted factorisation of each
shifted matrix gives the direction: the product of the squares is never
formed, so a small direction is as good as a large one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir

EPS = float(np.finfo(float).eps)
ROWS = 4096   # rows of a block that is factorised at once
FAN = 32      # triangles that are merged at once
CLOSE = 1e-3  # relative gap of eigenvalues below which directions are made orthogonal to each other


def triangle(blocks: Iterator[np.ndarray], dim: int) -> np.ndarray:
    """R of all rows, of which only one block and one triangle are held."""
    r = np.zeros((0, dim))
    for block in blocks:
        r = np.linalg.qr(np.concatenate((r, block)), mode="r")
    return r


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal, and the orthogonal W with ``r = U B W^T``, by Householder reflections."""
    a = np.zeros((max(r.shape), r.shape[1]))
    a[:len(r)] = r
    d = a.shape[1]
    w = np.eye(d)

    def reflection(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if size == 0:
            return None
        v = x / size
        v[0] += math.copysign(np.sqrt(v @ v), v[0])
        return v / np.sqrt(v @ v)

    for k in range(d):
        if (v := reflection(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < d and (v := reflection(a[k, k + 1:])) is not None:
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
            w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _qd(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential quotient-difference transform with a shift, and its smallest
    quantity on the way (below 0: the shift was over the smallest eigenvalue)."""
    new_q, new_e, d = [0.0] * len(q), [0.0] * len(e), q[0] - shift
    least = d
    for i in range(len(e)):
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift if new_q[i] else q[i + 1] - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling."""
    found, todo = [], [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above], 0.0)]
    small = (10 * EPS) ** 2
    while todo:
        q, e, paid = todo.pop()
        while q:
            n = len(q)
            split = next((i for i in range(n - 1) if e[i] <= small * (paid + q[i + 1]) or e[i] <= small * (paid + q[i])), None)
            if n == 1:
                found.append(paid + q.pop())
            elif split == n - 2:  # the last one has come off
                found.append(paid + q.pop())
                e.pop()
            elif split is not None:
                todo.append((q[split + 1:], e[split + 1:], paid))
                q, e = q[:split + 1], e[:split]
            else:
                # the smaller eigenvalue of the last two rows, less what couples them to the rest
                x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), math.sqrt(q[-2]) * math.sqrt(e[-1]), q[-1] + e[-1]
                mean, half = (x + z) / 2, math.hypot((x - z) / 2, y)
                low = max(0.0, (x * z - y * y) / (mean + half)) if mean + half else 0.0
                share = abs(y) / math.hypot(y, x - low) if y or x != low else 1.0
                coupled = math.sqrt(q[-3] * e[-2]) * share if n > 2 else 0.0
                shift = max(0.0, low * (1 - 4 * EPS) - coupled)
                while True:
                    new_q, new_e, least = _qd(q, e, shift)
                    if least >= 0 and math.isfinite(new_q[-1]):
                        break
                    shift = shift / 4 if shift > EPS * (paid + q[-1]) else 0.0
                q, e, paid = new_q, new_e, paid + shift
    return np.sort(np.array(found))[::-1]


def twisted(diagonal: np.ndarray, above: np.ndarray, square: float) -> np.ndarray:
    """Right singular vector of the bidiagonal matrix for one squared singular value.

    B^T B = L D L^T less the square is factorised from the top and from the bottom; where
    both meet with the smallest pivot, the vector is one there and follows both ways.
    """
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0))
    a = np.where(np.abs(diagonal) < EPS * EPS * scale, EPS * EPS * scale, diagonal)
    d, l = (a * a).tolist(), (above / a[:-1]).tolist()
    tiny = EPS * EPS * max(square, scale * scale)
    top, bottom, s, p = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    s[0] = -square
    for i in range(n - 1):
        pivot = s[i] + d[i] or tiny
        top[i] = d[i] * l[i] / pivot
        s[i + 1] = top[i] * l[i] * s[i] - square
    p[n - 1] = d[n - 1] - square
    for i in range(n - 2, -1, -1):
        pivot = d[i] * l[i] * l[i] + p[i + 1] or tiny
        ratio = d[i] / pivot
        bottom[i] = l[i] * ratio
        p[i] = p[i + 1] * ratio - square
    k = min(range(n), key=lambda i: abs(s[i] + p[i] + square))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -top[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -bottom[i] * z[i]
    size = np.abs(z).max()
    z /= size if np.isfinite(size) else 1.0
    return z / np.sqrt(z @ z)


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, directions as columns) of ``r``, falling, ``most`` at most
    and only those that stand out from rounding."""
    diagonal, above, w = bidiagonal(r)
    squares = dqds(diagonal, above)
    if not len(squares) or squares[0] == 0:
        return squares[:0], w[:, :0]
    keep = squares > squares[0] * (len(diagonal) * EPS) ** 2
    squares, columns, start = squares[keep][:most], [], 0
    rng = np.random.default_rng(0)
    for i, square in enumerate(squares):
        z = twisted(diagonal, above, square)
        if i and squares[i - 1] - square > CLOSE * squares[i - 1]:
            start = i
        for round_ in range(4):  # of a cluster, each is made orthogonal to those before
            before = z
            for other in columns[start:]:
                z = z - other * (other @ z)
            size = np.sqrt(z @ z)
            if size > 0.5:
                z = z / size
                for other in columns[start:]:
                    z = z - other * (other @ z)
                z /= np.sqrt(z @ z)
                break
            # the same direction again: another of the cluster's space, by inverse iteration
            z = rng.standard_normal(len(before))
            t = np.diag(diagonal) + np.diag(above, 1)
            t = t.T @ t - square * (1 + 8 * EPS) * np.eye(len(z))
            for _ in range(3):
                for other in columns[start:]:
                    z = z - other * (other @ z)
                z = np.linalg.solve(t + EPS * squares[0] * np.eye(len(z)), z)
                z /= np.sqrt(z @ z)
        columns.append(z)
    return squares, w @ np.array(columns).T


@dataclass
class Whitening:
    """What was fitted: ``n`` rows, their exact ``sums``, eigenvalues (falling), directions as
    columns, the trace of the covariance, and the largest error of the whitened covariance."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _whole(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n * x - sums) / n, the whole numbers exact: in 64 bits where they fit, else as Python's."""
    most = max(int(np.abs(x).max(initial=0)) * n, int(max(abs(int(s)) for s in sums)))
    if most < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(float)


def _pieces(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    for at in range(0, len(column), ROWS):
        yield _whole(column.slice(at, ROWS), dim)


def merged(df: DataFrame, folder: str, join) -> list[bytes]:
    """Rows (part, block) merged in groups of ``FAN`` by ``join``, again and again, until
    no more than ``FAN`` are left; these reach the driver."""
    level = 0
    while True:
        df.write.parquet(f"{folder}/{level}")
        df = df.sparkSession.read.parquet(f"{folder}/{level}")
        if df.count() <= FAN:
            return [r["block"] for r in df.orderBy("part").collect()]

        def together(group: pa.Table) -> pa.Table:
            blocks = [b for _, b in sorted(zip(group["part"].to_pylist(), group["block"].to_pylist()))]
            return pa.table({"part": pa.array([group["part"][0].as_py() // FAN], pa.int64()), "block": pa.array([join(blocks)], pa.binary())})
        df = df.groupBy(F.expr(f"part div {FAN}")).applyInArrow(together, "part long, block binary")
        level += 1


def fit_whitening(x: DataFrame, vector: str, dim: int, components: int = 16) -> Whitening:
    """Whitening of the distinct vectors of whole numbers in ``vector``, each of length ``dim``.

    Repeated rows count once. No rows, or rows that are all equal, have no direction.
    Directions whose variance is lost in rounding are left out. The distinct vectors and the triangles
    are written to the session's checkpoint folder.
    """
    spark = x.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/whitening-{uuid.uuid4().hex}"
    x.select(F.col(vector).alias("x")).distinct().write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, object)
        for batch in batches:
            for piece in _pieces(batch.column(0), dim):
                n += len(piece)
                high, low = piece >> 32, piece & 0xFFFFFFFF  # sums of either half fit
                total = total + high.sum(0).astype(object) * (1 << 32) + low.sum(0).astype(object)
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([[str(t) for t in total]])], names=["n", "total"])

    # partial sums: one row a task, added up by dimension before they reach the driver
    parts = rows.mapInArrow(totals, "n long, total array<string>")
    n = parts.agg(F.sum("n").alias("n")).first()["n"] or 0
    by_dim = {r["pos"]: r["s"] for r in parts.select(F.posexplode("total")).groupBy("pos").agg(
        F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()}
    sums = [int(by_dim.get(i, 0)) for i in range(dim)]
    total = np.array(sums, object)
    if n < 2:
        return Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle((_centred(p, n, total) for b in batches for p in _pieces(b.column(0), dim)), dim)
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())],
                                  names=["part", "block"])

    def stacked(blocks: list[bytes]) -> bytes:
        return triangle((np.frombuffer(b).reshape(-1, dim) for b in blocks), dim).tobytes()

    r = np.frombuffer(stacked(merged(rows.mapInArrow(reduced, "part long, block binary"), f"{folder}/triangles", stacked))).reshape(-1, dim)
    squares, vectors = directions(r, components)
    values, k = squares / n, len(squares)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [_moments(_centred(p, n, total) @ vectors / np.sqrt(values)) for b in batches for p in _pieces(b.column(0), dim)]
        if blocks:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pooled(blocks)], pa.binary())],
                                  names=["part", "block"])

    def pooled(blocks: list[bytes]) -> bytes:
        """Count, mean and centred products of all rows, from those of each block."""
        count, mean, products = 0.0, np.zeros(k), np.zeros((k, k))
        for b in blocks:
            m = np.frombuffer(b)
            c, away = m[0], m[1:k + 1] - mean
            products = products + m[k + 1:].reshape(k, k) + np.outer(away, away) * (count * c / (count + c))
            mean, count = mean + away * (c / (count + c)), count + c
        return np.concatenate(([count], mean, products.ravel())).tobytes()

    error = 0.0
    if k:
        m = np.frombuffer(pooled(merged(rows.mapInArrow(moments, "part long, block binary"), f"{folder}/moments", pooled)))
        error = float(np.abs(m[k + 1:].reshape(k, k) / n - np.eye(k)).max())
    return Whitening(n, sums, values, vectors, float((r * r).sum()) / n, error)


def _moments(w: np.ndarray) -> bytes:
    mean = w.mean(0)
    away = w - mean
    return np.concatenate(([float(len(w))], mean, (away.T @ away).ravel())).tobytes()


def whole_numbers(vector: Column) -> Column:
    """64 times each entry, as a double, rounded down, plus 1,000,000; null where the
    vector is null, empty, or holds an entry that is null, not finite, or too large for that."""
    wide = F.transform(vector, lambda v: F.floor(F.when(F.abs(v.cast("double")) < 1 << 40, v.cast("double")) * 64) + 1_000_000)
    fine = F.forall(wide, lambda v: v.isNotNull()) & (F.size(vector) > 0)
    return F.when(vector.isNotNull() & fine, wide)


def whiten(df: DataFrame, vec_id: str, vector: str, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row for
    each usable row of ``df`` and component, numbered from 1.

    ``vector`` becomes whole numbers (:func:`whole_numbers`); rows without them drop out, as do
    those of another length than the commonest (of equally common ones the smallest). Repeated ids and
    vectors each give their rows; a null id stays null. ``deviation`` is null where it
    passes 64 bits. An empty table, and one in which all vectors are equal, gives no rows.
    """
    kind = dict(df.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = df.select(F.col(f"`{vec_id}`").alias("vec_id"), whole_numbers(F.col(f"`{vector}`")).alias("x")).where(F.col("x").isNotNull())
    common = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    dim = common["d"]
    x = x.where(F.size("x") == dim)
    fitted = fit_whitening(x, "x", dim, components)
    n, total, k = fitted.n, np.array(fitted.sums, object), len(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace else fitted.values
    vectors, scale, error = fitted.vectors, np.sqrt(fitted.values), fitted.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch) if k else 0, ROWS):
                rows = batch.slice(at, ROWS)
                whole = _whole(rows.column(1), dim)
                m = len(whole)
                white = _centred(whole, n, total) @ vectors / scale
                each = np.repeat(np.arange(m), k)
                yield pa.record_batch(
                    [rows.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), _deviations(whole, n, total).take(pa.array(each)), pa.array(white.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Exact squares of n * x - sums, summed over the dimensions; null beyond 64 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in sums)
    if most < 1 << 62:
        away = n * x - sums.astype(np.int64)
        if x.shape[1] * int(np.abs(away).max(initial=0)) ** 2 < 1 << 63:
            return pa.array((away * away).sum(1))
        away = away.astype(object)
    else:
        away = n * x.astype(object) - sums
    return pa.array([int(v) if v < 1 << 63 else None for v in (away * away).sum(1)], pa.int64())
