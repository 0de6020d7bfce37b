"""Logit and Gamma models of every segment at once.

Iteratively reweighted least squares, all segments and models together: a step is one
aggregate by (segment, model) of the weighted cross-products, with partial sums
before the shuffle, in which each row meets the current coefficients of its segment through a
join with a small table. How many jobs run depends on the steps of the slowest fit,
not on how many segments or models there are, and a segment that holds a third of
all rows is only partial sums like the others. The driver sees p x p numbers a fit.

Covariates are centred and scaled by their overall mean and deviation before the steps
(with a constant; else only scaled) and the coefficients are turned back, so a
covariate far from 0 does no harm.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.distributions import chi2_sf, norm_ppf, norm_sf

CONST = "const"
COEFS = ("model string, segment string, term string, estimate double, se double, statistic double, p double, "
         "ci_low double, ci_high double, n long, error string")
STATS = ("model string, segment string, n long, df_model double, df_resid double, loglik double, null_loglik double, pseudo_r2 double, "
         "llr double, llr_pvalue double, aic double, bic double, deviance double, dispersion double, iterations int")
# Steps until a fit counts as not converging, and the largest change of a converged one (in deviations of its covariate).
STEPS, CLOSE = 50, 1e-9
BROADCAST_BYTES = 16 << 20  # of coefficients; a larger table meets the rows over a shuffle


@dataclass
class _Fit:
    """One (segment, model) on its way: ``beta`` on scaled covariates, ``inverse`` of the last cross-products."""
    n: int
    uses: list[int]
    mean_y: float
    beta: np.ndarray
    inverse: np.ndarray | None = None
    sums: dict = field(default_factory=dict)
    steps: int = 0
    error: str | None = None
    done: bool = False


def _number(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def fit_glms(df: DataFrame, target: str, models: dict[str, Sequence[str]], family: str = "logit", by: str | None = None,
             intercept: bool = True) -> tuple[DataFrame, DataFrame]:
    """Coefficient and statistics tables of all ``models`` (name to covariates) in all segments
    of column ``by`` (None: one segment, null).

    ``family``: ``logit`` (target 0 to 1), or ``gamma`` with a log link (target over 0, dispersion by
    Pearson's residuals). Rows with a null or NaN in a column of a model take no part in it. P-values are
    normal. A fit that cannot be made (too few rows, singular, separated, a target outside
    its range) is a row with ``error``. An empty table gives none.
    """
    if family not in ("logit", "gamma"):
        raise ValueError("family must be 'logit' or 'gamma'")
    names = list(dict.fromkeys(c for cols in models.values() for c in cols))
    p, first = len(names) + intercept, int(intercept)
    values = df.select((F.col(f"`{by}`") if by else F.lit(None)).cast("string").alias("segment"),
                       _number(F.col(f"`{target}`")).alias("y"), *[_number(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(names)]
                       ).where("y is not null")
    scale = values.agg(*[f(f"v{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if names else {}
    centre = [(scale[f"m{i}"] or 0.0) if intercept else 0.0 for i in range(len(names))]
    width = [w if (w := scale[f"s{i}"]) and math.isfinite(w) else 1.0 for i in range(len(names))]
    uses = {m: list(range(first)) + [first + names.index(c) for c in cols] for m, cols in models.items()}

    def taking_part(m: str) -> Column:
        """The row's (model, x), null if the row lacks one of the model's covariates."""
        x = [F.lit(1.0)] * first + [((F.col(f"v{i}") - centre[i]) / width[i]) if first + i in uses[m] else F.lit(0.0) for i in range(len(names))]
        there = F.lit(True)
        for i in uses[m][first:]:
            there = there & F.col(f"v{i - first}").isNotNull()
        return F.when(there, F.struct(F.lit(m).alias("model"), F.array(*x).alias("x")))

    rows = (values.select("segment", "y", F.explode(F.array(*[taking_part(m) for m in models])).alias("in"))
            .where(F.col("in").isNotNull()).select("segment", "in.model", "y", *[F.col("in.x")[i].alias(f"x{i}") for i in range(p)]))
    begun = rows.groupBy("segment", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))
    fits: dict[tuple, _Fit] = {}
    for r in begun.collect():  # one row a segment and model
        beta = np.zeros(p)
        fit = fits[r["segment"], r["model"]] = _Fit(r["n"], uses[r["model"]], r["mean"], beta)
        if family == "logit" and not 0 <= r["low"] <= r["high"] <= 1 or family == "gamma" and r["low"] <= 0:
            fit.error = "target outside the range of the family"
        elif r["n"] <= len(fit.uses):
            fit.error = "too few rows"
        elif family == "logit" and r["mean"] in (0.0, 1.0):
            fit.error = "target is constant"
        if first:
            beta[0] = 0.0 if fit.error else math.log(r["mean"] / (1 - r["mean"])) if family == "logit" else math.log(r["mean"])

    spark = df.sparkSession
    going = {k: f for k, f in fits.items() if not f.error}
    while going:
        now = [{"segment": s, "model": m, "b": f.beta.tolist()} for (s, m), f in going.items()]
        table = spark.createDataFrame([json.dumps(r) for r in now], "string").select(
            F.from_json("value", "struct<segment string, model string, b array<double>>").alias("r")).select("r.*")
        small = sum(8 * p + 100 + len(s or "") for s, _ in going) < BROADCAST_BYTES
        for r in _step(rows, table, family, p, small).collect():
            _advance(going[r["segment"], r["model"]], r, family, p)
        going = {k: f for k, f in going.items() if not f.done and not f.error}
    turn = np.diag([1.0] * first + [1 / w for w in width])
    if intercept:
        turn[0, first:] = [-c / w for c, w in zip(centre, width)]
    terms = [CONST] * first + names
    coefs, stats = [], []
    for (s, m), f in sorted(fits.items(), key=str):
        if f.error:
            coefs.append((m, s, None, None, None, None, None, None, None, f.n, f.error))
            continue
        coefs += _coefs(f, turn, terms, family, m, s)
        stats.append(_stats(f, family, intercept, m, s))
    return spark.createDataFrame(coefs, COEFS), spark.createDataFrame(stats, STATS)


def _step(rows: DataFrame, table: DataFrame, family: str, p: int, small: bool) -> DataFrame:
    """(segment, model): cross-products, scores and likelihood of every fit at its coefficients."""
    keyed = table.select(F.col("segment").alias("s"), F.col("model").alias("m"), "b")
    if small:
        keyed = F.broadcast(keyed)
    met = rows.join(keyed, F.col("segment").eqNullSafe(F.col("s")) & (F.col("model") == F.col("m")))
    eta = sum((F.col("b")[i] * F.col(f"x{i}") for i in range(1, p)), F.col("b")[0] * F.col("x0"))
    d = met.withColumn("eta", F.greatest(F.least(eta, F.lit(500.0)), F.lit(-500.0)))
    if family == "logit":
        d = d.withColumn("mu", 1 / (1 + F.exp(-F.col("eta")))).withColumn("away", F.col("y") - F.col("mu"))
        weight = F.col("mu") * (1 - F.col("mu"))
        like = F.col("y") * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta")))
    else:
        d = d.withColumn("away", F.col("y") * F.exp(-F.col("eta")) - 1)
        weight = F.lit(1.0)
        like = -2 * (F.log1p("away") - F.col("away"))  # deviance
    x = [F.col(f"x{i}") for i in range(p)]
    return d.groupBy("segment", "model").agg(
        F.array(*[F.sum(weight * x[i] * x[j]) for i in range(p) for j in range(i, p)]).alias("gram"),
        F.array(*[F.sum(x[i] * F.col("away")) for i in range(p)]).alias("score"), F.sum(like).alias("like"),
        F.sum(F.col("away") * F.col("away")).alias("pearson"))


def _advance(f: _Fit, r, family: str, p: int) -> None:
    gram, it = np.zeros((p, p)), iter(r["gram"])
    for i in range(p):
        for j in range(i, p):
            gram[i, j] = gram[j, i] = next(it)
    block, at = gram[np.ix_(f.uses, f.uses)], np.ix_(f.uses)
    try:
        if not np.isfinite(block).all() or np.linalg.cond(block) > 1e13:
            raise np.linalg.LinAlgError("singular" if f.steps == 0 else "no convergence: the covariates separate the target")
        f.inverse = np.linalg.inv(block)
    except np.linalg.LinAlgError as e:
        f.error = str(e)
        return
    move = f.inverse @ np.array(r["score"])[at]
    f.sums = {"like": r["like"], "pearson": r["pearson"]}
    if np.abs(move).max() < CLOSE:
        f.done = True
        return
    f.steps += 1
    if f.steps > STEPS:
        f.error = "no convergence"
        return
    largest = np.abs(move).max()
    f.beta[at] += move * min(1.0, 5.0 / largest)  # a first step may go too far


def _coefs(f: _Fit, turn: np.ndarray, terms: list[str], family: str, m: str, s: str | None) -> list[tuple]:
    at = np.ix_(f.uses, f.uses)
    dispersion = 1.0 if family == "logit" else f.sums["pearson"] / (f.n - len(f.uses))
    beta = turn[at] @ f.beta[f.uses]
    se = np.sqrt(np.diag(turn[at] @ f.inverse @ turn[at].T) * dispersion)
    q, out = norm_ppf(0.975), []
    for i, b, e in zip(f.uses, beta.tolist(), se.tolist()):
        z = b / e if e else float("nan")
        out.append((m, s, terms[i], b, e, z, 2 * norm_sf(abs(z)), b - q * e, b + q * e, f.n, None))
    return out


def _stats(f: _Fit, family: str, intercept: bool, m: str, s: str | None) -> tuple:
    n, k = f.n, len(f.uses)
    df_model = float(k - intercept)
    if family == "logit":
        ll, y = f.sums["like"], f.mean_y
        null = n * (y * math.log(y) + (1 - y) * math.log(1 - y))
        llr = 2 * (ll - null)
        return (m, s, n, df_model, float(n - k), ll, null, 1 - ll / null, llr, chi2_sf(llr, df_model) if df_model and llr > 0 else None,
                -2 * ll + 2 * k, -2 * ll + k * math.log(n), -2 * ll, 1.0, f.steps)
    return (m, s, n, df_model, float(n - k), None, None, None, None, None, None, None, f.sums["like"], f.sums["pearson"] / (n - k), f.steps)
