"""Linear mixed model by REML from per-subject sufficient statistics.

Model: ``y_g = X_g b + Z_g u_g + e_g`` with ``Z = [1, t]`` (or ``[1]``),
``u_g ~ N(0, s2 * Psi)``, ``e ~ N(0, s2 I)`` and ``Psi = L L'``.

1. One grouped aggregate gives, per subject, the Gram matrix ``W_g`` of
   ``[X, y]`` (partial sums, so a subject with a third of all rows is reduced
   map-side). The table is checkpointed to the cluster's checkpoint folder:
   the optimiser reads it many times and a lost executor must not recompute
   the whole lineage.
2. For a candidate ``L``: ``M_g = I + L' Z'Z_g L``, ``K_g = L M_g^-1 L'`` and
   ``S = sum_g W_g[:, z] K_g W_g[z, :]``, ``D = sum_g log det M_g``; then with
   ``W* = sum W_g - S``: ``A = W*[X, X]``, ``c = W*[X, y]``, ``q = W*[y, y]``,
   ``b = A^-1 c``, ``s2 = (q - c'b) / (N - p)`` and
   ``-2 l_REML = (N - p)(log(2 pi s2) + 1) + D + log det A``.
   Each optimiser step evaluates all its candidates (finite-difference points
   or line-search steps) in **one** Spark job: ``mapInPandas`` computes the
   partial ``S``, ``D`` of its partition for every candidate with batched numpy,
   and a grouped sum adds them up. Only k x k numbers per candidate reach the
   driver.
3. BFGS over the free entries of ``L`` (log-diagonal). Segments have one table, by
   (segment, subject), and an optimiser each; the candidates of all optimisers that
   are still going share the job of a step, so the jobs are those of the slowest fit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.distributions import norm_ppf, norm_sf
from cohortlens.operators.models import formula_design, gram, unpack
from cohortlens.operators.panel import levels, text_columns
from cohortlens.session import ensure_checkpoint_dir

INTERCEPT = "Intercept"


@dataclass
class MixedFit:
    coefs: DataFrame
    stats: DataFrame
    theta: list[float] = field(default_factory=list)


def _L(theta: np.ndarray, q: int, structure: str) -> np.ndarray:
    if q == 1:
        return np.array([[math.exp(theta[0])]])
    if structure == "diagonal":
        return np.array([[math.exp(theta[0]), 0.0], [0.0, math.exp(theta[1])]])
    return np.array([[math.exp(theta[0]), 0.0], [theta[1], math.exp(theta[2])]])


def _partial_fn(asked: dict[int, list[np.ndarray]], k: int, zidx: list[int]):
    """Mapper from (_seg, _gram) to sums of ``S`` and ``D`` for each segment's candidates ``L``."""
    iu = np.triu_indices(k)
    q = len(zidx)

    def fn(batches):
        S = {s: np.zeros((len(Ls), k, k)) for s, Ls in asked.items()}
        D = {s: np.zeros(len(Ls)) for s, Ls in asked.items()}
        for pdf in batches:
            seg = pdf["_seg"].to_numpy()
            for s in np.unique(seg):
                if s not in asked:
                    continue
                packed = np.stack([np.asarray(v, dtype=float) for v in pdf["_gram"][seg == s]])
                W = np.zeros((len(packed), k, k))
                W[:, iu[0], iu[1]] = packed
                W[:, iu[1], iu[0]] = packed
                WZ = W[:, :, zidx]                      # (m, k, q)
                ZZ = W[:, zidx][:, :, zidx]             # (m, q, q)
                for c, L in enumerate(asked[s]):
                    M = np.eye(q) + np.einsum("ji,mjk,kl->mil", L, ZZ, L)
                    Minv = np.linalg.inv(M)
                    K = np.einsum("ij,mjk,lk->mil", L, Minv, L)
                    S[s][c] += np.einsum("maq,mqr,mbr->ab", WZ, K, WZ)
                    D[s][c] += float(np.linalg.slogdet(M)[1].sum())
        rows = []
        for s in asked:
            for c in range(len(asked[s])):
                rows += [(s, c, int(i), float(v)) for i, v in enumerate(S[s][c][iu])]
                rows.append((s, c, -1, float(D[s][c])))
        yield pd.DataFrame(rows, columns=["seg", "cand", "idx", "val"])
    return fn


class _Remls:
    """Likelihoods of all segments over a table (_seg, _n, _gram), one row a subject. ``keep``
    names, for a segment, the columns of the design that it uses (none named: all)."""

    def __init__(self, stats: DataFrame, k: int, zidx: list[int], structure: str):
        self.stats, self.k, self.zidx, self.structure = stats, k, zidx, structure
        m = k * (k + 1) // 2
        self.N, self.Wsum, self.sizes, self.keep = {}, {}, {}, {}
        for r in stats.groupBy("_seg").agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("g"), F.min("_n").alias("lo"), F.avg("_n").alias("mean"),
                                           F.max("_n").alias("hi"), F.array(*[F.sum(F.col("_gram")[i]) for i in range(m)]).alias("w")).collect():
            s = r["_seg"]
            self.N[s], self.Wsum[s], self.sizes[s] = int(r["n"]), unpack(r["w"], k), (r["g"], r["lo"], r["mean"], r["hi"])
            self.keep[s] = list(range(k - 1))
        self.jobs = 0

    def evaluate(self, asked: dict[int, list[np.ndarray]]) -> dict[int, list[tuple[float, dict]]]:
        """-2 log likelihood of each segment's candidates, in one job."""
        q = len(self.zidx)
        Ls = {s: [_L(np.asarray(t), q, self.structure) for t in thetas] for s, thetas in asked.items()}
        part = self.stats.select("_seg", "_gram").mapInPandas(_partial_fn(Ls, self.k, self.zidx), "seg int, cand int, idx int, val double")
        vals: dict[tuple, dict] = {}
        for r in part.groupBy("seg", "cand", "idx").agg(F.sum("val").alias("val")).collect():
            vals.setdefault((r["seg"], r["cand"]), {})[r["idx"]] = r["val"]
        self.jobs += 1
        iu = np.triu_indices(self.k)
        out = {}
        for s in asked:
            out[s] = []
            for c, L in enumerate(Ls[s]):
                got = vals.get((s, c), {})
                S = np.zeros((self.k, self.k))
                S[iu] = packed = np.array([got.get(i, 0.0) for i in range(len(iu[0]))])
                S[(iu[1], iu[0])] = packed
                out[s].append(self._likelihood(s, L, self.Wsum[s] - S, got.get(-1, 0.0)))
        return out

    def _likelihood(self, s: int, L: np.ndarray, Wst: np.ndarray, D: float) -> tuple[float, dict]:
        keep, N, p, y = self.keep[s], self.N[s], len(self.keep[s]), self.k - 1
        A, cvec, qv = Wst[np.ix_(keep, keep)], Wst[keep, y], Wst[y, y]
        try:
            beta = np.linalg.solve(A, cvec)
            s2 = (qv - cvec @ beta) / (N - p)
            sign, logdetA = np.linalg.slogdet(A)
            if not (s2 > 0 and sign > 0):
                raise np.linalg.LinAlgError("not positive")
            return (N - p) * (math.log(2 * math.pi * s2) + 1) + D + logdetA, {"beta": beta, "s2": s2, "A": A, "L": L}
        except (np.linalg.LinAlgError, ZeroDivisionError):
            return float("inf"), {}


class _Reml(_Remls):
    """The likelihood of one segment, over a table with a row a subject."""

    def __init__(self, stats: DataFrame, k: int, p: int, zidx: list[int], structure: str):
        super().__init__(stats.select(F.lit(0).alias("_seg"), "_n", "_gram"), k, zidx, structure)

    def evaluate(self, asked):
        return super().evaluate(asked) if isinstance(asked, dict) else super().evaluate({0: asked})[0]


def _bfgs(theta0: np.ndarray, max_iter: int = 60, h: float = 1e-5, gtol: float = 1e-5):
    """An optimiser that asks: yields candidates, is sent their values, and returns
    (theta, value, what came with it, converged, iterations)."""
    n = len(theta0)
    theta = np.asarray(theta0, dtype=float)
    H = np.eye(n)
    lo = -15.0

    def grad_eval(th):
        pts = [th]
        for i in range(n):
            e = np.zeros(n)
            e[i] = h
            pts += [th + e, th - e]
        res = yield pts
        f0, info0 = res[0]
        g = np.array([(res[1 + 2 * i][0] - res[2 + 2 * i][0]) / (2 * h) for i in range(n)])
        return f0, info0, g

    f, info, g = yield from grad_eval(theta)
    converged = False
    it = 0
    for it in range(1, max_iter + 1):
        if not np.all(np.isfinite(g)):
            break
        if np.max(np.abs(g)) < gtol:
            converged = True
            break
        d = -H @ g
        if g @ d >= 0:  # not a descent direction: reset
            H = np.eye(n)
            d = -g
        steps = [1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001]
        cands = [np.maximum(theta + a * d, lo) for a in steps]
        res = yield cands
        best = None
        for a, th, (fv, inf) in zip(steps, cands, res):
            if fv <= f + 1e-4 * a * (g @ d):
                best = (th, fv)
                break
        if best is None:
            i = int(np.argmin([r[0] for r in res]))
            if res[i][0] >= f:
                converged = np.max(np.abs(g)) < 1e-3
                break
            best = (cands[i], res[i][0])
        new_theta = best[0]
        f_new, info_new, g_new = yield from grad_eval(new_theta)
        s, y = new_theta - theta, g_new - g
        if abs(f - f_new) < 1e-10 * (1 + abs(f)):
            theta, f, info, g = new_theta, f_new, info_new, g_new
            converged = True
            break
        sy = s @ y
        if sy > 1e-12:
            rho = 1.0 / sy
            I = np.eye(n)
            H = (I - rho * np.outer(s, y)) @ H @ (I - rho * np.outer(y, s)) + rho * np.outer(s, s)
        theta, f, info, g = new_theta, f_new, info_new, g_new
    return theta, f, info, converged, it


def _together(reml: _Remls, asking: dict) -> dict:
    """What each optimiser returns; those still going are answered by one job a step."""
    done, asked = {}, {s: next(g) for s, g in asking.items()}
    while asked:
        answers, asked = reml.evaluate(asked), {}
        for s, values in answers.items():
            try:
                asked[s] = asking[s].send(values)
            except StopIteration as e:
                done[s] = e.value
    return done


def subject_stats(df: DataFrame, group: str, target: str, design: Sequence[str]) -> DataFrame:
    """Per-subject ``n`` and packed Gram of ``[1, design..., y]``, checkpointed."""
    ensure_checkpoint_dir(df.sparkSession)
    return gram(df, design, target, [group], intercept=True).checkpoint()


def fit_mixed(df: DataFrame, group: str, target: str, covariates: Sequence[str] | None, timestamp: str | None,
              random_slope: bool = True, structure: str = "unstructured", level_map: dict | None = None,
              max_iter: int = 60) -> MixedFit:
    """R7 (``structure='unstructured'``) / R8 (``'diagonal'``: uncorrelated
    random intercept and slope). Random intercept only when ``random_slope``
    is False or there is no time column. Rows with a null in any model column
    are dropped (the count is in the statistics). A fit that cannot start (its
    likelihood is not finite) gives a row of nulls for each term, not converged."""
    d, design = formula_design(df, target, covariates, timestamp, level_map)
    n_in = df.count()
    stats_tbl = subject_stats(d, group, target, design)
    k = len(design) + 2                     # const + design + y
    p = k - 1
    zidx = [0] + ([1 + design.index(timestamp)] if (random_slope and timestamp) else [])
    q = len(zidx)
    reml = _Reml(stats_tbl, k, p, zidx, structure)
    theta0 = np.zeros(1 if q == 1 else (2 if structure == "diagonal" else 3))
    theta, f, info, converged, iters = _together(reml, {0: _bfgs(theta0, max_iter)})[0] if reml.N else (theta0, None, {}, False, 0)
    terms = [INTERCEPT, *design]
    spark = df.sparkSession
    coef_schema = "term string, estimate double, se double, z double, p double, ci_low double, ci_high double"
    stat_schema = ("n_obs long, n_groups long, scale double, reml_loglik double, method string, converged boolean, "
                   "iterations long, spark_jobs long, dropped long, group_min long, group_mean double, group_max long")
    sizes = [None if v is None else float(v) for v in reml.sizes.get(0, (0, None, None, None))]
    whole = lambda v: None if v is None else int(v)

    def statistics(scale: float | None, loglik: float | None, converged: bool) -> DataFrame:
        n = reml.N.get(0, 0)
        return spark.createDataFrame([(n, whole(sizes[0]), scale, loglik, "REML", converged, int(iters), int(reml.jobs),
                                       n_in - n, whole(sizes[1]), sizes[2], whole(sizes[3]))], stat_schema)

    if "beta" not in info:
        return MixedFit(spark.createDataFrame([(t, *[None] * 6) for t in terms], coef_schema), statistics(None, None, False), [])
    rows = _table(info, terms, timestamp, structure)
    s2 = info["s2"]
    coefs = spark.createDataFrame(rows, coef_schema)
    return MixedFit(coefs, statistics(float(s2), float(-0.5 * f), bool(converged)), [float(x) for x in theta])


def _table(info: dict, terms: list[str], timestamp: str | None, structure: str) -> list[tuple]:
    """Coefficient rows of a fit, then its variance rows."""
    beta, s2, A, L = info["beta"], info["s2"], info["A"], info["L"]
    cov = s2 * np.linalg.inv(A)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    z = beta / se
    zq = norm_ppf(0.975)
    rows = [(t, float(b), float(s), float(zz), float(2 * norm_sf(abs(zz))), float(b - zq * s), float(b + zq * s))
            for t, b, s, zz in zip(terms, beta, se, z)]
    psi = s2 * (L @ L.T)
    rows.append(("Group Var", float(psi[0, 0]), None, None, None, None, None))
    if len(L) == 2:
        if structure != "diagonal":
            rows.append((f"Group x {timestamp} Cov", float(psi[0, 1]), None, None, None, None, None))
        rows.append((f"{timestamp} Var", float(psi[1, 1]), None, None, None, None, None))
    return rows


def dense_neg2_reml(y: np.ndarray, X: np.ndarray, Z: np.ndarray, groups: np.ndarray, L: np.ndarray) -> float:
    """Reference value of ``-2 l_REML`` from dense per-subject covariance
    matrices (for tests on small fixtures)."""
    N, p = X.shape
    A = np.zeros((p, p))
    c = np.zeros(p)
    qv = 0.0
    D = 0.0
    for g in np.unique(groups):
        m = groups == g
        Xg, Zg, yg = X[m], Z[m], y[m]
        V = np.eye(m.sum()) + Zg @ L @ L.T @ Zg.T
        Vi = np.linalg.inv(V)
        A += Xg.T @ Vi @ Xg
        c += Xg.T @ Vi @ yg
        qv += yg @ Vi @ yg
        D += np.linalg.slogdet(V)[1]
    beta = np.linalg.solve(A, c)
    s2 = (qv - c @ beta) / (N - p)
    return (N - p) * (math.log(2 * math.pi * s2) + 1) + D + np.linalg.slogdet(A)[1]


def fit_mixed_segments(df: DataFrame, segment: str, group: str, target: str, covariates: Sequence[str] | None,
                       timestamp: str | None, random_slope: bool = True, level_map: dict | None = None, max_iter: int = 60) -> DataFrame:
    """R9 trajectory form: one mixed model per segment (a subject may be in
    several), coefficient tables stacked with the segment and its row count;
    a segment whose fit fails gives an ``error`` row (the original skipped it
    silently).

    One aggregate by (segment, subject) serves all fits, and one job a step answers all
    optimisers. Levels of text covariates are those of the whole table; a level that a segment
    lacks is left out of its design, and if it is the reference, the segment's first level stands in for it.
    A null segment is one; rows with a null in a model column are dropped; an empty table gives no row.
    """
    spark = df.sparkSession
    schema = ("term string, estimate double, se double, z double, p double, ci_low double, ci_high double, "
              "segment string, n long, error string")
    covariates = list(covariates or [])
    text = [c for c in covariates if c in text_columns(df)]
    level_map = level_map or levels(df, text)
    d, design = formula_design(df, target, covariates, timestamp, level_map)
    names = [r[0] for r in d.select(F.col(segment).cast("string")).distinct().collect()]  # segment names: a bounded list
    number = {s: i for i, s in enumerate(sorted(names, key=lambda v: (v is None, v)))}
    by = F.col(segment).cast("string")
    known = F.coalesce(F.create_map(*[v for s, i in number.items() if s is not None for v in (F.lit(s), F.lit(i))])[by], F.lit(number.get(None, -1))) \
        if any(s is not None for s in number) else F.lit(number.get(None, -1))
    ensure_checkpoint_dir(spark)
    stats = gram(d.withColumn("_seg", known.cast("int")), design, target, ["_seg", group], intercept=True).checkpoint()
    k = len(design) + 2
    zidx = [0] + ([1 + design.index(timestamp)] if (random_slope and timestamp) else [])
    reml = _Remls(stats, k, zidx, "unstructured")
    for s, W in reml.Wsum.items():
        left_out = set()
        for c in text:
            held = [f"{c}_{v}" for v in level_map[c][1:]]
            lacking = [h for h in held if W[1 + design.index(h), 1 + design.index(h)] == 0]
            left_out.update(lacking)
            there = [h for h in held if h not in lacking]
            if there and reml.N[s] - sum(W[0, 1 + design.index(h)] for h in there) < 0.5:
                left_out.add(there[0])  # no row of the reference level
        left_out |= {f"{timestamp}:{h}" for h in left_out}
        reml.keep[s] = [0] + [1 + i for i, name in enumerate(design) if name not in left_out]
    theta0 = np.zeros(1 if len(zidx) == 1 else 3)
    fits = _together(reml, {s: _bfgs(theta0, max_iter) for s in reml.N})
    rows, terms = [], [INTERCEPT, *design]
    for name, s in number.items():
        n = reml.N.get(s, 0)
        info = fits[s][2] if s in fits else {}
        if "beta" not in info:
            rows.append((*[None] * 7, name, n, "the likelihood is not finite at the start" if n else "no complete rows"))
        else:
            rows += [(*r, name, n, None) for r in _table(info, [terms[i] for i in reml.keep[s]], timestamp, "unstructured")]
    return spark.createDataFrame(rows, schema)
