import math

import numpy as np
import pytest

from cohortlens.llm import whitening as W
from cohortlens.llm.queries import op13

SF = "/root/testdata/sf0.01"


def test_bidiagonal_and_singular_values():
    rng = np.random.default_rng(1)
    for n, d in ((1, 1), (3, 1), (2, 2), (5, 3), (40, 24), (70, 64), (10, 20)):
        a = rng.standard_normal((n, d)) * np.logspace(0, -8, d)
        diagonal, above, w = W.bidiagonal(a)
        b = np.diag(diagonal) + np.diag(above, 1)
        assert np.allclose(w.T @ w, np.eye(d), atol=1e-13) and np.allclose(b.T @ b, w.T @ a.T @ a @ w, atol=1e-12)
        want = np.zeros(d)
        want[:min(n, d)] = np.linalg.svd(a, compute_uv=False)
        got = np.sqrt(W.dqds(diagonal, above))
        assert len(got) == d and np.abs(got - want).max() < 1e-13 * want[0]


def test_small_singular_values_are_accurate():
    """The product of the diagonal is the product of the singular values, however small they are."""
    diagonal, above = np.logspace(0, -60, 20), np.logspace(-1, -61, 19)
    got = W.dqds(diagonal, above)
    assert math.isclose(np.log(got).sum(), 2 * np.log(diagonal).sum(), rel_tol=1e-13) and (np.diff(got) < 0).all()
    assert W.dqds(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]
    assert W.dqds(np.array([1.0, 0.0, 2.0]), np.array([0.5, 0.0])).min() == 0


def test_directions():
    rng = np.random.default_rng(2)
    for a in (rng.standard_normal((200, 30)), rng.standard_normal((200, 30)) * np.logspace(0, -6, 30), np.eye(12)[[0, 1, 2, 3] * 3],
              np.repeat(rng.standard_normal((50, 5)), 2, 1), np.eye(9) + 1e-14 * rng.standard_normal((9, 9))):
        squares, v = W.directions(np.linalg.qr(a, mode="r"), 16)
        want = np.linalg.svd(a, compute_uv=False) ** 2
        assert len(squares) == min(16, np.linalg.matrix_rank(a)) and np.allclose(squares, want[:len(squares)], rtol=1e-11)
        assert np.abs(v.T @ v - np.eye(len(squares))).max() < 1e-10
        assert np.abs(a.T @ (a @ v) - v * squares).max() < 1e-11 * want[0]
    assert W.directions(np.zeros((3, 3)), 16)[1].shape == (3, 0)


def by_hand(rows):
    """The contract in numpy and Python's whole numbers, from rows (id, vector)."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in kept], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(0)
    away = ((n * fit - s) / n).astype(float)
    e, v = np.linalg.eigh(away.T @ away / n)
    return kept, n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n).astype(float) @ v[:, ::-1] / np.sqrt(np.abs(e[::-1])), e[::-1] / e.sum()


def held_against(got, rows):
    kept, n, deviation, white, explained = by_hand(rows)
    k = min(16, white.shape[1])
    ids = sorted((i, j) for i, _ in kept for j in range(1, k + 1))
    assert sorted((r["vec_id"], r["component"]) for r in got) == ids
    want = {(i, j + 1): (int(d), w[j]) for (i, _), d, w in zip(kept, deviation, white) for j in range(k)}
    sign = {}
    for r in got:
        d, w = want[r["vec_id"], r["component"]]
        assert r["n"] == n and r["deviation"] == d and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        if abs(w) > 1e-3:
            sign.setdefault(r["component"], math.copysign(1, w * r["whitened"]))
        assert abs(r["whitened"] - sign.get(r["component"], 1) * w) < 1e-6
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held_against(op13(spark, SF).collect(), rows)


def test_many_triangles_and_odd_rows(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * np.arange(1, 7)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies fit once, and each has its rows
    odd = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, []), (2005, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x", None) for i, v in rows + odd], "vec_id long, embedding array<double>, n int, x string, part int")
    monkeypatch.setattr(W, "FAN", 2)
    df.repartition(9).write.parquet(f"{tmp_path}/embeddings.parquet")
    held_against(op13(spark, str(tmp_path)).collect(), rows)


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whiten(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    assert W.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 3, schema), "vec_id", "embedding").count() == 0
    two = W.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])], schema), "vec_id", "embedding").collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), r["explained"]) for r in two) == [
        (0, 1, 2, 4096, 1.0, 1.0), (1, 1, 2, 4096, 1.0, 1.0), (2, 1, 2, 4096, 1.0, 1.0)]


def test_sums_beyond_64_bits():
    x, sums = np.array([[1 << 40, 5]]), np.array([3 << 70, 1], object)
    assert W._deviations(x, 1 << 40, sums).to_pylist() == [None]
    assert W._centred(x, 1 << 40, sums)[0, 1] == 5 - 1 / (1 << 40)
    assert W._deviations(np.array([[2, 5]]), 3, np.array([5, 12], object)).to_pylist() == [1 + 9]
    with pytest.raises(ValueError):
        W._whole(__import__("pyarrow").array([[1, 2, 3]]), 2)
