"""Regression, mixed-model, classification and scoring queries (section 7.5,
model rows). ``lineitem`` carries the OLS/GLM examples (price on quantity,
discount, tax), ``events`` the panel for the mixed model, ``documents`` +
``labels`` and ``embeddings`` the classifiers.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import classify as C
from cohortlens.operators import labels as L
from cohortlens.operators import metrics as M
from cohortlens.operators import models as R
from cohortlens.operators import text as T
from cohortlens.operators.glm import fit_glms
from cohortlens.operators.mixed import fit_mixed
from cohortlens.plans import stat_sql as Q
from cohortlens.plans.registry import query
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources.tables import read_table

COVS = ["l_quantity", "l_discount", "l_tax"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem")


def r4(c: str):
    return F.round(F.col(c), 4).alias(c)


def _coef_out(coefs: DataFrame, extra=()) -> DataFrame:
    return coefs.select(*extra, "term", r4("estimate"), r4("se"), r4("statistic"))


def _simple_sql(y: str, x: str, src: str, group: str | None = None) -> str:
    """OLS of ``y`` on const + ``x`` in SQL with DuckDB's regression aggregates."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""s AS (
  SELECT {g}regr_slope({y}, {x}) AS b, regr_intercept({y}, {x}) AS a, regr_count({y}, {x}) AS n,
         regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS xbar
  FROM {src} {gb}),
e AS (SELECT *, (syy - b * sxy) / (n - 2) AS s2 FROM s),
c AS (
  SELECT {g}'const' AS term, a AS estimate, sqrt(s2 * (1.0 / n + xbar * xbar / sxx)) AS se, n FROM e
  UNION ALL SELECT {g}'{x}', b, sqrt(s2 / sxx), n FROM e)"""


# ------------------------------------------------------------- R1, R9, R11 -

@query("ols_simple", "WITH " + _simple_sql("l_extendedprice", "l_quantity", "lineitem") + """
SELECT term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 4) AS statistic FROM c
""")
def ols_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with one covariate: price on quantity with a constant."""
    coefs, _ = R.ols(lineitem(spark, sf_dir), "l_extendedprice", ["l_quantity"], intercept=True)
    return _coef_out(coefs)


SEG_SRC = """(SELECT l_extendedprice, l_quantity, 'flag_' || l_returnflag AS segment FROM lineitem
  UNION ALL SELECT l_extendedprice, l_quantity, 'status_' || l_linestatus FROM lineitem)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = lineitem(spark, sf_dir)
    return li.withColumn("segment", F.explode(F.array(F.concat(F.lit("flag_"), "l_returnflag"),
                                                     F.concat(F.lit("status_"), "l_linestatus"))))


@query("ols_segments", "WITH " + _simple_sql("l_extendedprice", "l_quantity", SEG_SRC, "segment") + """
SELECT segment, term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 4) AS statistic, n
FROM c
""")
def ols_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit per segment (return flag and line status; each row is in two
    segments), all from one grouped Gram aggregate."""
    coefs, _ = R.ols(_segments(spark, sf_dir), "l_extendedprice", ["l_quantity"], by="segment")
    return _coef_out(coefs, ["segment"]).join(coefs.select("segment", "term", "n"), ["segment", "term"])


@query("univariate_screen", "WITH " + ",\n".join(
    _simple_sql("l_extendedprice", x, "lineitem").replace("s AS (", f"s_{x} AS (", 1)
    .replace("FROM s)", f"FROM s_{x})").replace("e AS (", f"e_{x} AS (").replace("FROM e\n", f"FROM e_{x}\n")
    .replace("FROM e)", f"FROM e_{x})").replace("c AS (", f"c_{x} AS (").replace("SELECT 'const'", f"SELECT '{x}' AS model, 'const'")
    .replace(f"UNION ALL SELECT '{x}'", f"UNION ALL SELECT '{x}', '{x}'")
    for x in COVS) + "\n" + "\nUNION ALL\n".join(
    f"SELECT model, term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 4) AS statistic "
    f"FROM c_{x}" for x in COVS))
def univariate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on each covariate alone (with constant), one Gram pass."""
    coefs, _ = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS, models={c: [c] for c in COVS})
    return _coef_out(coefs, ["model"])


def _olsk_sql(y: str, xs: list[str], src: str, intercept: bool, model: str | None = None) -> str:
    """OLS with one to three covariates in SQL: explicit inverse (cofactors)
    of the cross-product matrix, centred when there is a constant (the
    constant then follows from the means). Returns a SELECT of
    ``[model,] term, estimate, se, statistic`` (rounded to 4 decimals)."""
    k = len(xs)
    assert 1 <= k <= 3
    agg = ["count(*) AS n", f"sum({y}) AS sy", f"sum({y} * {y}) AS syy"]
    for i, xi in enumerate(xs):
        agg += [f"sum({xi}) AS s{i}", f"sum({xi} * {y}) AS c{i}"]
        for j in range(i, k):
            agg.append(f"sum({xi} * {xs[j]}) AS p{i}{j}")
    a = {}
    for i in range(k):
        for j in range(i, k):
            a[(i, j)] = a[(j, i)] = f"(p{i}{j} - s{i} * s{j} / n)" if intercept else f"p{i}{j}"
    c = [f"(c{i} - s{i} * sy / n)" if intercept else f"c{i}" for i in range(k)]
    yy = "(syy - sy * sy / n)" if intercept else "syy"
    A = lambda i, j: a[(i, j)]
    if k == 1:
        det = A(0, 0)
        inv = {(0, 0): "1.0"}
    elif k == 2:
        det = f"({A(0,0)} * {A(1,1)} - {A(0,1)} * {A(0,1)})"
        inv = {(0, 0): A(1, 1), (1, 1): A(0, 0), (0, 1): f"(-{A(0,1)})"}
    else:
        det = (f"({A(0,0)} * ({A(1,1)} * {A(2,2)} - {A(1,2)} * {A(1,2)}) - {A(0,1)} * ({A(0,1)} * {A(2,2)} - "
               f"{A(1,2)} * {A(0,2)}) + {A(0,2)} * ({A(0,1)} * {A(1,2)} - {A(1,1)} * {A(0,2)}))")
        inv = {(0, 0): f"({A(1,1)} * {A(2,2)} - {A(1,2)} * {A(1,2)})",
               (1, 1): f"({A(0,0)} * {A(2,2)} - {A(0,2)} * {A(0,2)})",
               (2, 2): f"({A(0,0)} * {A(1,1)} - {A(0,1)} * {A(0,1)})",
               (0, 1): f"(-({A(0,1)} * {A(2,2)} - {A(0,2)} * {A(1,2)}))",
               (0, 2): f"({A(0,1)} * {A(1,2)} - {A(0,2)} * {A(1,1)})",
               (1, 2): f"(-({A(0,0)} * {A(1,2)} - {A(0,1)} * {A(0,2)}))"}
    for (i, j) in list(inv):
        inv[(j, i)] = inv[(i, j)]
    inv_cols = ", ".join(f"{inv[(i, j)]} / det AS i{i}{j}" for i in range(k) for j in range(k))
    beta = ", ".join(f"{' + '.join(f'i{i}{j} * {c[j]}' for j in range(k))} AS b{i}" for i in range(k))
    p = k + (1 if intercept else 0)
    m = f"'{model}' AS model, " if model else ""
    rows = [f"SELECT {m}'{x}' AS term, b{i} AS estimate, sqrt(sigma2 * i{i}{i}) AS se FROM f"
            for i, x in enumerate(xs)]
    if intercept:
        xbar = [f"s{i} / n" for i in range(k)]
        quad = " + ".join(f"({xbar[i]}) * ({xbar[j]}) * i{i}{j}" for i in range(k) for j in range(k))
        rows.append(f"SELECT {m}'const', sy / n - ({' + '.join(f'b{i} * {xbar[i]}' for i in range(k))}), "
                    f"sqrt(sigma2 * (1.0 / n + {quad})) FROM f")
    mcol = "model, " if model else ""
    return f"""SELECT {mcol}term, round(estimate, 4) AS estimate, round(se, 4) AS se,
       round(estimate / se, 4) AS statistic FROM (
  WITH s AS (SELECT {', '.join(agg)} FROM {src}),
  d AS (SELECT *, {det} AS det FROM s),
  i AS (SELECT *, {inv_cols} FROM d),
  b AS (SELECT *, {beta} FROM i),
  f AS (SELECT *, ({yy} - ({' + '.join(f'b{i} * {c[i]}' for i in range(k))})) / (n - {p}) AS sigma2 FROM b)
  {' UNION ALL '.join(rows)})"""


def _ols3_sql(y: str, xs: list[str], src: str, intercept: bool) -> str:
    return _olsk_sql(y, xs, src, intercept)


LADDER = {"m1_unadjusted": ["l_quantity"], "m2_discount": ["l_quantity", "l_discount"],
          "m3_full": ["l_quantity", "l_discount", "l_tax"]}


@query("ladder_coefficients", "\nUNION ALL\n".join(
    _olsk_sql("l_extendedprice", cols, "lineitem", True, model=name) for name, cols in LADDER.items()))
def ladder_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested models (unadjusted, + discount, + tax), estimates,
    SE and t of each, all from one Gram pass."""
    coefs, _ = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS, models=LADDER)
    return _coef_out(coefs, ["model"])


@query("ols_multi", _ols3_sql("l_extendedprice", COVS, "lineitem", True))
def ols_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with three covariates and a constant: estimates, SE, t."""
    coefs, _ = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS)
    return _coef_out(coefs)


@query("ols_multi_no_intercept", _ols3_sql("l_extendedprice", COVS, "lineitem", False))
def ols_multi_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 with three covariates and no constant (the reference's usual call)."""
    coefs, _ = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS, intercept=False)
    return _coef_out(coefs)


_RESIDUALS = """WITH """ + _simple_sql("l_extendedprice", "l_quantity", "lineitem") + """,
r AS (SELECT l_extendedprice - (SELECT a + b * l_quantity FROM s) AS e, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem),
d AS (SELECT e, e - lag(e) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS away FROM r),
m AS (SELECT count(*)::DOUBLE AS n, avg(e) AS mean, sum(away * away) / sum(e * e) AS durbin_watson FROM d),
sh AS (SELECT any_value(n) AS n, any_value(durbin_watson) AS durbin_watson, avg(pow(e - mean, 3)) / pow(avg(pow(e - mean, 2)), 1.5) AS skew,
  avg(pow(e - mean, 4)) / pow(avg(pow(e - mean, 2)), 2) AS kurtosis FROM d, m),
x AS (SELECT count(*)::DOUBLE AS xn, sum(l_quantity)::DOUBLE AS x1, sum(l_quantity * l_quantity)::DOUBLE AS x2 FROM lineitem),
o AS (SELECT *, n / 6 * (skew * skew + pow(kurtosis - 3, 2) / 4) AS jarque_bera,
  skew * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS sy,
  3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) AS b2,
  (kurtosis - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS kx,
  6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM sh),
w AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6.0 + 8.0 / b1 * (2.0 / b1 + sqrt(1 + 4.0 / (b1 * b1))) AS big FROM o),
z AS (SELECT *, asinh(sy / sqrt(2.0 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
  ((1 - 2.0 / (9 * big)) - cbrt((1 - 2.0 / big) / (1 + kx * sqrt(2.0 / (big - 4))))) / sqrt(2.0 / (9 * big)) AS zk FROM w)
SELECT 'full' AS model, round(durbin_watson, 6) AS durbin_watson, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(jarque_bera, 4) AS jarque_bera,
  round(exp(-jarque_bera / 2), 6) AS jarque_bera_p, round(zs * zs + zk * zk, 4) AS omnibus, round(exp(-(zs * zs + zk * zk) / 2), 6) AS omnibus_p,
  round(sqrt((xn + x2 + sqrt(pow(xn - x2, 2) + 4 * x1 * x1)) / 2 / ((xn * x2 - x1 * x1) / ((xn + x2 + sqrt(pow(xn - x2, 2) + 4 * x1 * x1)) / 2))), 4)
  AS condition_number FROM z, x
"""


@query("residual_statistics", _RESIDUALS)
def residual_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durbin-Watson, skew, kurtosis, Jarque-Bera, omnibus test and condition number of price on quantity."""
    stats = R.residual_statistics(lineitem(spark, sf_dir), "l_extendedprice", ["l_quantity"],
                                  order=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    digits = {"durbin_watson": 6, "skew": 6, "kurtosis": 6, "jarque_bera": 4, "jarque_bera_p": 6, "omnibus": 4, "omnibus_p": 6, "condition_number": 4}
    return stats.select("model", *[F.round(c, d).alias(c) for c, d in digits.items()])


_FIT = ("estimate", "se", "statistic", "ci_low", "ci_high")
_FIT_SQL = ", ".join(f"round({c}, 4) AS {c}" for c in _FIT) + ", round(p, 6) AS p"
_WHOLE = "(SELECT *, '' AS segment FROM lineitem)"


def _fit_out(coefs: DataFrame, stats: DataFrame | None = None, extra=(), **digits) -> DataFrame:
    out = coefs.select(*extra, "model", "segment", "term", *[r4(c) for c in _FIT], F.round("p", 6).alias("p"), "n") if stats is not None else \
        coefs.select(*extra, "term", *[r4(c) for c in _FIT], F.round("p", 6).alias("p"), "n")
    if stats is None:
        return out
    side = stats.select(F.col("model").alias("_m"), F.col("segment").alias("_s"), *[F.round(c, d).alias(c) for c, d in digits.items()])
    return out.join(F.broadcast(side), (F.col("model") == F.col("_m")) & F.col("segment").eqNullSafe(F.col("_s"))).drop("_m", "_s")


@query("ols_full", "WITH " + Q.ols(_WHOLE, "l_extendedprice", COVS) + f"""
SELECT 'full' AS model, term, {_FIT_SQL}, CAST(terms.n AS BIGINT) AS n, round(r2, 6) AS r2, round(adj_r2, 6) AS adj_r2, round(f_stat, 3) AS f_stat,
  round(aic, 3) AS aic, round(bic, 3) AS bic, round(loglik, 3) AS loglik FROM terms, stats
""")
def ols_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 full table: price on quantity, discount, tax, constant: estimate,
    SE, t, p, 95% CI, plus the fit statistics on each row."""
    coefs, stats = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS)
    return _fit_out(coefs, stats, r2=6, adj_r2=6, f_stat=3, aic=3, bic=3, loglik=3).drop("segment")


@query("ols_no_intercept", "WITH " + Q.ols(_WHOLE, "l_extendedprice", COVS, intercept=False) + f"""
SELECT 'full' AS model, term, {_FIT_SQL}, CAST(terms.n AS BIGINT) AS n, round(r2, 6) AS r2, round(f_stat, 3) AS f_stat FROM terms, stats
""")
def ols_no_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 without constant (the reference's usual call), uncentred R2."""
    coefs, stats = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS, intercept=False)
    return _fit_out(coefs, stats, r2=6, f_stat=3).drop("segment")


@query("model_ladder", "WITH " + ",\n".join(Q.ols(_WHOLE, "l_extendedprice", xs, f"{m}_") for m, xs in LADDER.items()) + "\n"
       + "\nUNION ALL\n".join(f"SELECT '{m}' AS model, term, {_FIT_SQL}, CAST({m}_terms.n AS BIGINT) AS n, round(r2, 6) AS r2, round(aic, 3) AS aic "
                               f"FROM {m}_terms, {m}_stats" for m in LADDER))
def model_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested models (unadjusted, + discount, + tax) from one pass, with p-values and fit statistics."""
    coefs, stats = R.ols(lineitem(spark, sf_dir), "l_extendedprice", COVS, models=LADDER)
    return _fit_out(coefs, stats, r2=6, aic=3).drop("segment")


@query("significant_terms", "WITH " + Q.ols(SEG_SRC.replace("l_quantity", "l_quantity, l_discount, l_tax"), "l_extendedprice", COVS) + f"""
SELECT segment, term, {_FIT_SQL}, CAST(n AS BIGINT) AS n FROM terms WHERE p <= 0.05
""")
def significant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with p <= 0.05 of the per-segment fits."""
    coefs, _ = R.ols(_segments(spark, sf_dir), "l_extendedprice", COVS, by="segment")
    return _fit_out(R.significant(coefs), extra=["segment"])


_SEG_LADDER = {"m1": ["l_quantity"], "m2": ["l_quantity", "l_discount"], "m3": COVS}
_SEG_LADDER_SRC = """(SELECT *, unnest(list_filter([CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus = 'O' THEN 'open' END],
  lambda s: s IS NOT NULL)) AS segment FROM lineitem)"""


@query("segment_ladder", "WITH " + ",\n".join(Q.ols(_SEG_LADDER_SRC, "l_extendedprice", xs, f"{m}_") for m, xs in _SEG_LADDER.items()) + "\n"
       + "\nUNION ALL\n".join(f"SELECT segment, '{m}' AS model, term, {_FIT_SQL}, CAST(n AS BIGINT) AS n FROM {m}_terms" for m in _SEG_LADDER))
def segment_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + R10: per return-flag / line-status segment, three nested models
    (OLS since the target exceeds 1), all from one pass."""
    li = lineitem(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("int")) \
        .withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    seg = R.flag_segments(li, ["returned", "open"])
    return _fit_out(R.fit_segments(seg, "segment", "l_extendedprice", COVS, _SEG_LADDER), extra=["segment", "model"])


SEG_LADDER_SRC = {
    "returned": "(SELECT * FROM lineitem WHERE l_returnflag = 'R')",
    "open": "(SELECT * FROM lineitem WHERE l_linestatus = 'O')"}


@query("segment_ladder_coefficients", "\nUNION ALL\n".join(
    f"SELECT '{seg}' AS segment, * FROM ("
    + _olsk_sql("l_extendedprice", cols, src, True, model=name) + ")"
    for seg, src in SEG_LADDER_SRC.items() for name, cols in
    {"m1": ["l_quantity"], "m2": ["l_quantity", "l_discount"], "m3": COVS}.items()))
def segment_ladder_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 + R10: per segment (returned lines, open lines; a line can be in
    both), three nested OLS models from one grouped Gram pass: estimates, SE, t."""
    li = lineitem(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("int")) \
        .withColumn("open", (F.col("l_linestatus") == "O").cast("int"))
    seg = R.flag_segments(li, ["returned", "open"])
    ladder = {"m1": ["l_quantity"], "m2": ["l_quantity", "l_discount"], "m3": COVS}
    coefs = R.fit_segments(seg, "segment", "l_extendedprice", COVS, ladder)
    return _coef_out(coefs, ["segment", "model"])


SEG_LOGIT_SRC = """(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, unnest(list_filter([
  CASE WHEN l_linestatus = 'O' THEN 'open' END, CASE WHEN l_linenumber = 1 THEN 'urgent_part' END], lambda s: s IS NOT NULL)) AS segment FROM lineitem)"""
SEG_LOGIT = {"m1": ["l_quantity", "l_discount"], "m2": ["l_quantity", "l_discount", "l_tax"]}
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in ("estimate", "se", "statistic", "p", "ci_low", "ci_high"))


def _glm_out(coefs: DataFrame, *extra) -> DataFrame:
    return coefs.select(*extra, "term", *[F.round(c, 5).alias(c) for c in ("estimate", "se", "statistic", "p", "ci_low", "ci_high")], "n")


@query("segment_logit", "WITH " + ",\n".join(
    Q.glm(SEG_LOGIT_SRC, "returned", cols, "logit", 9, f"{m}_") for m, cols in SEG_LOGIT.items()) + "\n" + "\nUNION ALL\n".join(
    f"SELECT segment, '{m}' AS model, term, {_ROUNDED}, n FROM {m}_terms" for m in SEG_LOGIT))
def segment_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 with a 0/1 target (max(target) <= 1): two nested logits in each segment (a line
    can be in both), all stepping together."""
    li = lineitem(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("double")) \
        .withColumn("open", (F.col("l_linestatus") == "O").cast("int")) \
        .withColumn("urgent_part", (F.col("l_linenumber") == 1).cast("int"))
    seg = R.flag_segments(li, ["open", "urgent_part"])
    return _glm_out(R.fit_segments(seg, "segment", "returned", COVS, SEG_LOGIT), "segment", "model")


# ------------------------------------------------------------- R2, R3 ------

@query("logit_odds", "WITH " + Q.glm("(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, '' AS segment FROM lineitem)",
                                     "returned", COVS, "logit", 9) + f"\nSELECT term, {_ROUNDED}, n, round(exp(estimate), 5) AS odds_ratio FROM terms")
def logit_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: returned (flag R) on quantity, discount, tax: logit with odds ratios."""
    li = lineitem(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    coefs, _ = fit_glms(li, "returned", {"full": COVS}, "logit")
    odds = coefs.select("term", F.round(F.exp("estimate"), 5).alias("odds_ratio"))
    return _glm_out(coefs).join(odds, "term")


@query("logit_fit_statistics", "WITH " + Q.glm("(SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, '' AS segment FROM lineitem)",
                                               "returned", COVS, "logit", 9) + """,
fitted AS (SELECT count(*) AS n, sum(y * eta - greatest(eta, 0) - ln(1 + exp(-abs(eta)))) AS loglik, avg(y) AS m
  FROM (SELECT y, b0 + b1 * x1 + b2 * x2 + b3 * x3 AS eta FROM data, b_9)),
against_null AS (SELECT *, n * (m * ln(m) + (1 - m) * ln(1 - m)) AS null_loglik FROM fitted)
SELECT n, 3.0 AS df_model, n - 4.0 AS df_resid, round(loglik, 4) AS loglik, round(null_loglik, 4) AS null_loglik, round(1 - loglik / null_loglik, 8) AS pseudo_r2,
  round(2 * (loglik - null_loglik), 4) AS llr, round(""" + Q.chi2_tail("(2 * (loglik - null_loglik))", "3") + """, 6) AS llr_pvalue,
  round(8 - 2 * loglik, 4) AS aic, round(4 * ln(n) - 2 * loglik, 4) AS bic FROM against_null
""")
def logit_fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: likelihoods, pseudo-R2, likelihood-ratio test and information criteria of the logit."""
    li = lineitem(spark, sf_dir).withColumn("returned", (F.col("l_returnflag") == "R").cast("double"))
    _, stats = fit_glms(li, "returned", {"full": COVS}, "logit")
    rounded = {"loglik": 4, "null_loglik": 4, "pseudo_r2": 8, "llr": 4, "llr_pvalue": 6, "aic": 4, "bic": 4}
    return stats.select("n", "df_model", "df_resid", *[F.round(c, d).alias(c) for c, d in rounded.items()])


@query("gamma_glm", "WITH " + Q.glm("(SELECT *, '' AS segment FROM lineitem)", "l_extendedprice", ["l_quantity", "l_discount"], "gamma", 25)
       + f"\nSELECT term, {_ROUNDED}, n FROM terms")
def gamma_glm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gamma GLM with log link of price on quantity and discount; z p-values."""
    coefs, _ = fit_glms(lineitem(spark, sf_dir), "l_extendedprice", {"full": ["l_quantity", "l_discount"]}, "gamma")
    return _glm_out(coefs)


# ------------------------------------------------------------- R6 ----------

EVENT_LEVELS = {"event_type": ["click", "error", "purchase", "signup", "view"]}


def events_design_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.plans.panel_queries import events_with_day
    return events_with_day(spark, sf_dir).withColumn("hour", F.hour("ts").cast("double"))


_DUMMIES = ["error", "purchase", "signup", "view"]


@query("design_matrix", """
WITH ev AS (
  SELECT event_id, CAST(hour(ts) AS DOUBLE) AS hour,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0 AS day, event_type
  FROM events)
SELECT event_id, round(day, 6) AS day, """ + ", ".join(
    f"CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END AS event_type_{v}" for v in _DUMMIES) + """, hour, """
    + ", ".join(f"round(day * CASE WHEN event_type = '{v}' THEN 1.0 ELSE 0.0 END, 6) AS \"day:event_type_{v}\""
                for v in _DUMMIES) + """, round(day * hour, 6) AS "day:hour"
FROM ev
""")
def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design of ``value ~ day + event_type + hour + day*event_type +
    day*hour`` (treatment coding, reference level 'click')."""
    d, cols = R.formula_design(events_design_input(spark, sf_dir), "value", ["event_type", "hour"], "day",
                               EVENT_LEVELS)
    return d.select("event_id", *[F.round(F.col(f"`{c}`"), 6).alias(c) if (c == "day" or ":" in c)
                                  else F.col(f"`{c}`") for c in cols])


# ------------------------------------------------------------- R4, R5 ------

@query("regression_metrics", "WITH " + _simple_sql("l_extendedprice", "l_quantity", "lineitem") + """,
p AS (SELECT l_extendedprice AS y, (SELECT a FROM s) + (SELECT b FROM s) * l_quantity AS yp FROM lineitem),
m AS (SELECT var_pop(y - yp) AS ve, var_pop(y) AS vy, avg(abs(y - yp)) AS mae, avg((y - yp) * (y - yp)) AS mse,
             avg(pow(ln(1 + y) - ln(1 + yp), 2)) AS msle, median(abs(y - yp)) AS medae FROM p)
SELECT round(1 - ve / vy, 4) AS explained_variance, round(msle, 4) AS mean_squared_log_error,
       round(1 - mse / vy, 4) AS r2, round(mae, 4) AS mean_abs_err, round(mse, 4) AS mean_sq_err,
       round(sqrt(mse), 4) AS root_mse, round(medae, 4) AS median_abs_err
FROM m
""")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explained variance, MSLE, R2, MAE, MSE, RMSE, median AE of the
    price-on-quantity fit."""
    li = lineitem(spark, sf_dir)
    coefs, _ = R.ols(li, "l_extendedprice", ["l_quantity"])
    p = R.predict_linear(li, coefs)
    out = M.regression_results(p, "l_extendedprice", "y_pred")
    return out.withColumn("median_abs_err", F.round("median_abs_err", 4))


@query("rounded_report", "WITH " + _simple_sql("l_quantity", "l_extendedprice", "lineitem") + """,
pr AS (SELECT floor(l_quantity / 5.0) * 5.0 AS label,
              floor(((SELECT a FROM s) + (SELECT b FROM s) * l_extendedprice) / 5.0) * 5.0 AS pred FROM lineitem),
""" + "__REPORT__")
def rounded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class report of quantity predicted from price, both rounded down to
    multiples of 5 (truth and prediction in the right order)."""
    li = lineitem(spark, sf_dir)
    coefs, _ = R.ols(li, "l_quantity", ["l_extendedprice"])
    p = R.predict_linear(li, coefs)
    rep = M.rounded_class_report(p, "l_quantity", "y_pred", divisor=5)
    return rep.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score", "support")])


# ------------------------------------------------------------- R7, R8 ------

def _mixed_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_design_input(spark, sf_dir).select("user_id", "value", "day", "event_type", "hour")


@query("mixed_model")
def mixed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REML linear mixed model of value on day, event type and hour with
    their day interactions; random intercept and slope on day per user."""
    fit = fit_mixed(_mixed_input(spark, sf_dir), "user_id", "value", ["event_type", "hour"], "day",
                    level_map=EVENT_LEVELS)
    return fit.coefs


@query("mixed_model_uncorrelated")
def mixed_model_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with uncorrelated random intercept and slope."""
    fit = fit_mixed(_mixed_input(spark, sf_dir), "user_id", "value", ["event_type", "hour"], "day",
                    structure="diagonal", level_map=EVENT_LEVELS)
    return fit.coefs


@query("mixed_model_segments")
def mixed_model_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9 trajectory form: one mixed model per segment of users, a segment
    being the users with a high-value (> 250) event of a type (users may be in
    several segments)."""
    from cohortlens.operators.mixed import fit_mixed_segments
    from cohortlens.operators.panel import subject_aggregate
    d = _mixed_input(spark, sf_dir)
    flags = [F.max(((F.col("event_type") == t) & (F.col("value") > 250)).cast("int")).alias(f"has_{t}")
             for t in ("purchase", "error")]
    d = subject_aggregate(d, "user_id", flags)
    seg = R.flag_segments(d, ["has_purchase", "has_error"])
    return fit_mixed_segments(seg, "segment", "user_id", "value", ["hour"], "day")


@query("mixed_model_intercept")
def mixed_model_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7 with a random intercept only."""
    fit = fit_mixed(_mixed_input(spark, sf_dir), "user_id", "value", ["event_type"], "day", random_slope=False,
                    level_map=EVENT_LEVELS)
    return fit.coefs


# ------------------------------------------------------------- C1-C5, W6 ---

def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return T.tfidf_prepare(d.join(lab, "doc_id"), "text").drop("text")


@query("classify_tfidf")
def classify_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + C2: TF-IDF (fitted on train) + logistic regression; class reports
    of train and test."""
    d = labelled_docs(spark, sf_dir)
    res = C.train_classifier(d, "doc_id", "label", LogisticRegression(maxIter=50), tokens_col="tfidf_tokens")
    return res.stats_classes


@query("classify_folds")
def classify_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + E2: 5 stratified folds, TF-IDF refitted per fold, per-fold reports."""
    d = L.stratified_folds(labelled_docs(spark, sf_dir), "doc_id", "label", 5, 42)
    res = C.classifier_kfold(d, "doc_id", "label", "fold", 5, LogisticRegression(maxIter=30),
                             tokens_col="tfidf_tokens")
    return res.stats_classes


@query("classify_folds_together")
def classify_folds_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4 + E2: 5 stratified folds, logistic regression on TF-IDF refitted per fold, all folds in the same passes."""
    from cohortlens.operators.folds import logit_folds
    d = L.stratified_folds(labelled_docs(spark, sf_dir), "doc_id", "label", 5, 42)
    return logit_folds(d, "doc_id", "label", "fold", 5, "tfidf_tokens").stats_classes


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label"),
                    array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


@query("svm_balanced")
def svm_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest linear SVM with balanced class weights on the 64-d
    embeddings (10 classes); class reports of train and test."""
    d = embedding_features(spark, sf_dir)
    res = C.train_classifier(d, "vec_id", "label", C.svm_balanced(max_iter=50), features_col="features", weight_col="weight")
    return res.stats_classes


@query("feature_top10")
def feature_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most important TF-IDF terms of a random forest."""
    d = labelled_docs(spark, sf_dir)
    res = C.train_classifier(d, "doc_id", "label", RandomForestClassifier(numTrees=20, seed=7),
                             tokens_col="tfidf_tokens")
    return C.top_features(res.model.stages[-1].featureImportances, res.model.stages[0].vocabulary, spark, 10)


@query("saved_model_scores")
def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + S8 + C5: train on TF-IDF, save the whole pipeline to the shared
    checkpoint folder, load it and score every labelled document with it."""
    d = labelled_docs(spark, sf_dir)
    res = C.train_classifier(d, "doc_id", "label", LogisticRegression(maxIter=20), tokens_col="tfidf_tokens")
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    C.save_model(res.model, path)
    return C.run_saved(C.load_model(path), d, ["doc_id"])


# ------------------------------------------------------------- C6 ----------

def _centroids(spark: SparkSession, sf_dir: str):
    """Per-label mean embedding of the train side (10 x 64: the fitted model)."""
    e = embedding_features(spark, sf_dir).filter(~L.split_flag("vec_id", 0.2, 911))
    rows = e.groupBy("label").agg(Summarizer.mean(F.col("features")).alias("c")).orderBy("label").collect()
    import numpy as np
    return np.stack([r["c"].toArray() for r in rows])


@query("batch_scores", """
WITH e AS (SELECT vec_id, label, embedding,
                  CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR) || ':911'), 1, 7)) AS BIGINT) % 10000 < 2000 AS t
           FROM embeddings),
x AS (SELECT label, unnest(range(64)) AS k, unnest(embedding) AS v FROM e WHERE NOT t),
c AS (SELECT label, list(a ORDER BY k) AS cen FROM (SELECT label, k, avg(CAST(v AS DOUBLE)) AS a FROM x GROUP BY label, k)
      GROUP BY label),
s AS (SELECT e.vec_id, list(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.cen) ORDER BY c.label) AS logits
      FROM e, c GROUP BY e.vec_id)
SELECT vec_id, list_position(logits, list_max(logits)) - 1 AS preds, round(1 / (1 + exp(-list_max(logits))), 6) AS probs
FROM s
""")
def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 + C5: a user model (class centroids fitted on the train side) scored
    in Arrow batches of 32; class = argmax, probs = max sigmoid."""
    cen = _centroids(spark, sf_dir)
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = C.batch_scores(e, "x", C.centroid_predict_fn(cen), dim=cen.shape[1])
    return out.select("vec_id", "preds", F.round("probs", 6).alias("probs"))


# the report SQL of rounded_report reuses the class-report template
def _finish_rounded_report_sql() -> None:
    from cohortlens.plans import registry
    from cohortlens.plans.text_queries import _report_sql
    sql = registry._ORACLES["rounded_report"]
    registry._ORACLES["rounded_report"] = sql.replace("__REPORT__", _report_sql().lstrip())


_finish_rounded_report_sql()
