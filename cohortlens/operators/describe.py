"""Descriptive tables and group tests.

Every O(rows) step is one Spark aggregate (partial + final, so a hot group is
reduced map-side); statistics are then computed on the few aggregated rows
with column arithmetic, and p-values with an Arrow-batched UDF on those rows.
The many per-variable loops of the original become one ``unpivot`` (an
``explode`` of ``(variable, level)`` structs) and one grouped job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.columns import p_value_sig
from cohortlens.functions.distributions import chi2_pvalue, normal_pvalue, t_pvalue, u_exact_pvalue
from cohortlens.operators.ranks import running_sums

# Levels dropped from contingency tables in complete-case mode (fixed values).
UNKNOWN_LEVELS = ("not known", "unknown")
ALL = "All"


# ------------------------------------------------------------- A1, A2 ------

def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A1: rows per value, largest first (name breaks ties); null keys dropped
    as pandas does."""
    return (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
              .orderBy(F.desc(name), F.col(col)))


def top_groups(df: DataFrame, col: str, k: int = 2) -> DataFrame:
    """A2: the ``k`` largest groups with their rank (a top-k: ``limit`` is the
    feature). The result has at most ``k`` rows, a proven bound for broadcast."""
    vc = value_counts(df, col).limit(k)
    return vc.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.col(col))))


def modal_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """The most frequent non-null value of each column as text, the smallest on
    ties. Values are counted (with partial sums) before any of them meet; one row
    a column reaches the driver."""
    cols = list(cols)
    counted = (unpivot_levels(df, cols, []).where(F.col("level").isNotNull()).groupBy("variable", "level")
               .agg(F.count(F.lit(1)).alias("n")))
    top = counted.groupBy("variable").agg(F.min(F.struct((-F.col("n")).alias("n"), "level")).alias("top"))
    found = {r["variable"]: r["top"]["level"] for r in top.collect()}
    return {c: found.get(c) for c in cols}


def _two_groups(df: DataFrame, group_col: str, groups: Sequence[str] | None) -> DataFrame:
    """(group, rank) for the two compared groups: given, or the two largest."""
    if groups is not None:
        spark = df.sparkSession
        return spark.createDataFrame([(g, i + 1) for i, g in enumerate(groups[:2])],
                                     f"{group_col} string, rank int")
    return top_groups(df, group_col, 2).select(group_col, "rank")


def _tag_two(df: DataFrame, value: str, group_col: str, groups: Sequence[str] | None) -> DataFrame:
    """Rows of the two groups with ``_g`` = 1 or 2; the 2-row side is broadcast."""
    two = _two_groups(df, group_col, groups)
    return (df.join(F.broadcast(two), on=group_col, how="inner")
              .select(F.col("rank").alias("_g"), F.col(value).cast("double").alias("_v"), F.col(group_col)))


# ------------------------------------------------------------- moments -----

def _moments(tagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, sample variance of group 1 and 2 per ``by``: one aggregate."""
    v = F.col("_v")
    aggs = []
    for g in (1, 2):
        x = F.when((F.col("_g") == g) & v.isNotNull(), v)
        aggs += [F.count(x).alias(f"n{g}"), F.avg(x).alias(f"m{g}"), F.var_samp(x).alias(f"v{g}"),
                 F.max(F.when(F.col("_g") == g, F.col("_name"))).alias(f"group{g}")]
    return tagged.groupBy(*by).agg(*aggs)


def _with_names(tagged: DataFrame, group_col: str) -> DataFrame:
    return tagged.withColumn("_name", F.col(group_col).cast("string"))


def cohens_d(df: DataFrame, value: str, group_col: str, groups: Sequence[str] | None = None) -> DataFrame:
    """H1: ``(m1 - m2) / sqrt((s1^2 + s2^2) / 2)`` with sample SDs, groups = the
    two largest unless given. One row: group1, group2, n1, n2, m1, m2, d."""
    m = _moments(_with_names(_tag_two(df, value, group_col, groups), group_col), [])
    d = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2))
    return m.select("group1", "group2", "n1", "n2", "m1", "m2", d.alias("d"))


def _welch(m: DataFrame, equal_var: bool) -> DataFrame:
    n1, n2, v1, v2 = (F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("v1"), F.col("v2"))
    # empty or one-row groups give null statistics, not a division error
    div = F.try_divide
    if equal_var:
        dof = n1 + n2 - 2
        sp = div((n1 - 1) * v1 + (n2 - 1) * v2, dof)
        se = F.sqrt(sp * (div(F.lit(1.0), n1) + div(F.lit(1.0), n2)))
    else:
        a, b = div(v1, n1), div(v2, n2)
        se = F.sqrt(a + b)
        dof = div((a + b) * (a + b), div(a * a, n1 - 1) + div(b * b, n2 - 1))
    return m.withColumn("t", div(F.col("m1") - F.col("m2"), se)).withColumn("dof", dof)


def welch_t(df: DataFrame, value: str, group_col: str, groups: Sequence[str] | None = None,
            equal_var: bool = False, with_p: bool = True) -> DataFrame:
    """H2: independent two-sample t-test (Welch by default, pooled with
    ``equal_var``) between the two largest groups (or the given two)."""
    m = _moments(_with_names(_tag_two(df, value, group_col, groups), group_col), [])
    out = _welch(m, equal_var).select("group1", "group2", "n1", "n2", "m1", "m2", "t", "dof")
    if with_p:
        out = out.withColumn("p", t_pvalue(F.col("t"), F.col("dof")))
    return out


# ------------------------------------------------------------- U test ------

def _u_stats(tagged: DataFrame, by: Sequence[str]) -> DataFrame:
    """U1 of group 1 against group 2 per ``by``, with the tie term.

    Rows are first reduced to distinct values with counts ``a`` (group 1) and
    ``b`` (group 2) per value, which bounds every later step by the number of
    distinct values and makes a hot value one row. ``U1 = sum a * (B_before +
    b/2)`` where ``B_before`` is the count of group-2 values below.
    """
    by = list(by)
    per = (tagged.filter(F.col("_v").isNotNull())
                 .groupBy(*by, "_v")
                 .agg(F.sum(F.when(F.col("_g") == 1, 1).otherwise(0)).cast("double").alias("a"),
                      F.sum(F.when(F.col("_g") == 2, 1).otherwise(0)).cast("double").alias("b"),
                      F.max(F.when(F.col("_g") == 1, F.col("_name"))).alias("_n1"),
                      F.max(F.when(F.col("_g") == 2, F.col("_name"))).alias("_n2")))
    cum = running_sums(per, "_v", ["b"], by=by)
    t = F.col("a") + F.col("b")
    return cum.groupBy(*by).agg(
        F.sum(F.col("a") * (F.col("b_cum") - F.col("b") + F.col("b") / 2)).alias("u1"),
        F.sum(F.col("a")).alias("na"), F.sum(F.col("b")).alias("nb"),
        F.sum(t * t * t - t).alias("ties"),
        F.max("_n1").alias("group1"), F.max("_n2").alias("group2"))


def _u_finish(u: DataFrame, alternative: str, with_p: bool, use_continuity: bool = True,
              method: str = "asymptotic") -> DataFrame:
    if method not in ("asymptotic", "exact"):
        raise ValueError("method must be 'asymptotic' or 'exact'")
    n1, n2 = F.col("na"), F.col("nb")
    n = n1 + n2
    mu = n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    u2 = n1 * n2 - F.col("u1")
    if alternative == "two-sided":
        stat = F.col("u1")
        z = F.try_divide(F.greatest(F.col("u1"), u2) - mu - (0.5 if use_continuity else 0.0), sigma)
        out = u.withColumn("u", stat)
        if with_p:
            if method == "exact":
                # ties have no exact distribution here: null
                p = F.when(F.col("ties") == 0, u_exact_pvalue(F.col("u1"), n1, n2))
            else:
                p = F.least(F.lit(1.0), normal_pvalue(z))
            out = out.withColumn("p_u", p)
    elif alternative == "legacy":
        # old default: the smaller U with a one-sided p
        small = F.least(F.col("u1"), u2)
        z = F.try_divide(mu - small - (0.5 if use_continuity else 0.0), sigma)
        out = u.withColumn("u", small)
        if with_p:
            out = out.withColumn("p_u", normal_pvalue(z) / 2)
    else:
        raise ValueError("alternative must be 'two-sided' or 'legacy'")
    return out


def u_test(df: DataFrame, value: str, group_col: str, groups: Sequence[str] | None = None,
           alternative: str = "two-sided", with_p: bool = True, method: str = "asymptotic") -> DataFrame:
    """H3: Mann-Whitney U of the two largest groups (or the given two).

    Default is the current convention: U of the first group, two-sided p by the
    tie-corrected normal approximation with continuity 0.5, at every sample size.
    ``method='exact'`` asks for the exact null distribution instead (null with
    ties; its work grows with the product of the sample sizes). ``'legacy'``
    gives the smaller U with a one-sided normal p.
    """
    tagged = _with_names(_tag_two(df, value, group_col, groups), group_col)
    u = _u_finish(_u_stats(tagged, []), alternative, with_p, method=method)
    cols = ["group1", "group2", F.col("na").cast("long").alias("n1"), F.col("nb").cast("long").alias("n2"), "u"]
    if with_p:
        cols.append("p_u")
    return u.select(*cols)


# ------------------------------------------------------------- H4 ----------

def subgroup_tests(df: DataFrame, value: str, group_col: str, groups: Sequence[str], subgroup_col: str | None,
                   with_p: bool = True) -> DataFrame:
    """H4: for every level of ``subgroup_col`` and for ``'all'``: Welch t and U
    between the two named groups. Each row is exploded to (its level, 'all'),
    so all levels are one grouped job, not one job per level."""
    two = df.filter(F.col(group_col).isin(list(groups[:2])))
    subs = [F.col(subgroup_col).cast("string"), F.lit("all")] if subgroup_col else [F.lit("all")]
    tagged = two.select(F.when(F.col(group_col) == groups[0], 1).otherwise(2).alias("_g"),
                        F.col(value).cast("double").alias("_v"),
                        F.col(group_col).cast("string").alias("_name"),
                        F.posexplode(F.array(*subs)).alias("_total", "subgroup"))
    # a real level may be called 'all': the total has a key of its own
    tagged = tagged.filter(F.col("subgroup").isNotNull())
    by = ["_total", "subgroup"]
    m = _welch(_moments(tagged, by), equal_var=False).select(*by, "t", "dof")
    u = _u_finish(_u_stats(tagged, by), "two-sided", with_p).select(*by, "u", *(["p_u"] if with_p else []))
    out = m.join(u, by, "full").drop("_total")
    if with_p:
        out = (out.withColumn("p_t", t_pvalue(F.col("t"), F.col("dof")))
                  .withColumn("sig_t", p_value_sig(F.col("p_t")))
                  .withColumn("sig_u", p_value_sig(F.col("p_u"))))
    return out


# ------------------------------------------------------------- unpivot -----

def unpivot_levels(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep..., variable, level)``: one row per input row and column, level
    as text. Streams row by row (an ``explode``), no shuffle."""
    structs = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]
    return df.select(*[F.col(k) for k in keep], F.explode(F.array(*structs)).alias("_vl")) \
             .select(*keep, "_vl.variable", "_vl.level")


# ------------------------------------------------------------- H5 ----------

def chi_square(df: DataFrame, key: str, group_col: str, groups: Sequence[str], subgroup_cols: Sequence[str],
               complete_case: bool = True, with_p: bool = True) -> DataFrame:
    """H5: per variable, the table of distinct ``key`` counts by level x group
    (one column per group, zero-filled), Pearson chi-square with Yates'
    correction when dof = 1, dof, p and stars. One grouped job for all
    variables."""
    groups = list(groups)
    d = df.filter(F.col(group_col).isin(groups))
    long = unpivot_levels(d, subgroup_cols, [key, group_col]).filter(F.col("level").isNotNull())
    if complete_case:
        long = long.filter(~F.col("level").isin(list(UNKNOWN_LEVELS)))
    cells = long.groupBy("variable", "level", group_col).agg(F.countDistinct(key).alias("n"))
    wide = cells.groupBy("variable", "level").agg(
        *[F.coalesce(F.sum(F.when(F.col(group_col) == g, F.col("n"))), F.lit(0)).cast("long").alias(g)
          for g in groups])
    wv = Window.partitionBy("variable")
    row_tot = sum((F.col(g) for g in groups), F.lit(0)).cast("double")
    t = wide.withColumn("_r", row_tot).withColumn("_T", F.sum("_r").over(wv))
    for g in groups:
        t = t.withColumn(f"_c_{g}", F.sum(F.col(g)).over(wv).cast("double"))
    t = t.withColumn("_nl", F.count(F.lit(1)).over(wv))
    dof = (F.col("_nl") - 1) * (len(groups) - 1)
    t = t.withColumn("dof", dof.cast("long"))
    cell_terms = []
    for g in groups:
        e = F.try_divide(F.col("_r") * F.col(f"_c_{g}"), F.col("_T"))
        o = F.col(g).cast("double")
        dev = F.abs(o - e)
        dev = F.when(F.col("dof") == 1, dev - F.least(F.lit(0.5), dev)).otherwise(dev)
        # a zero expected count (a group with no rows) gives a null statistic
        cell_terms.append(F.try_divide(dev * dev, e))
    t = t.withColumn("_cell", sum(cell_terms[1:], cell_terms[0]))
    t = t.withColumn("chi2", F.sum("_cell").over(wv))
    out = t.select("variable", "level", *groups, "chi2", "dof")
    if with_p:
        out = out.withColumn("p", chi2_pvalue(F.col("chi2"), F.col("dof"))) \
                 .withColumn("p_significance", p_value_sig(F.col("p")))
    return out


# ------------------------------------------------------------- A5-A7 -------

def distinct_pivot(df: DataFrame, key: str, index: str, columns: str, levels: Sequence[str] | None = None,
                   aggregate: Callable[[str], Column] = F.countDistinct, fill: float | None = 0) -> DataFrame:
    """A5: distinct ``key`` count, or another ``aggregate`` of ``key``, by ``index`` x
    ``columns`` level; cells without rows hold ``fill`` (None: null).
    Give ``levels`` to spare the job that discovers them."""
    d = df.filter(F.col(index).isNotNull() & F.col(columns).isNotNull())
    p = d.groupBy(index).pivot(columns, list(levels) if levels is not None else None).agg(aggregate(key))
    return p if fill is None else p.fillna(fill, [c for c in p.columns if c != index])


def distinct_pivot_margins(df: DataFrame, key: str, index: str, columns: str,
                           levels: Sequence[str], aggregate: Callable[[str], Column] = F.countDistinct,
                           fill: float | None = 0) -> DataFrame:
    """A5 with ``All`` row and column, computed on raw rows (so the
    margins count distinct keys, not sums). ``cube`` gives all four groupings
    in one job."""
    d = df.filter(F.col(key).isNotNull() & F.col(index).isNotNull() & F.col(columns).isNotNull())
    c = (d.cube(index, columns)
           .agg(aggregate(key).alias("n"), F.grouping(index).alias("_gi"), F.grouping(columns).alias("_gc")))
    c = c.select(F.when(F.col("_gi") == 1, F.lit(ALL)).otherwise(F.col(index).cast("string")).alias(index),
                 F.when(F.col("_gc") == 1, F.lit(ALL)).otherwise(F.col(columns).cast("string")).alias("_col"),
                 "n", "_gi", "_gc")
    if ALL in levels:
        raise ValueError(f"a level of {columns} is called {ALL}, as the margin column")
    # a real row called All keeps apart from the margin row by its grouping flag
    p = (c.where((F.col("_gc") == 1) | (F.col("_col") != ALL)).groupBy(index, "_gi").pivot("_col", [*levels, ALL])
         .agg(F.first("n")).drop("_gi"))
    return p if fill is None else p.fillna(fill, [c for c in p.columns if c != index])


def max_pivot_flags(df: DataFrame, index: str, columns: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Latest ``value`` per ``index`` x level, then 0/1 flags (1 = any row)."""
    p = df.groupBy(index).pivot(columns, list(levels)).agg(F.max(value))
    return p.select(index, *[F.when(F.col(lv).isNotNull(), 1).otherwise(0).alias(lv) for lv in levels])


# ------------------------------------------------------------- A8 ----------

def _distinct_keys(df: DataFrame, key: str, group_col: str, subgroup_cols: Sequence[str]) -> DataFrame:
    """Distinct non-null keys of every cell of ``data_stats`` and of its margins.

    The distinct rows of key, group and levels are dealt by key; a key's cells are then
    told apart where its rows lie, so neither variables nor margins are shuffled, only
    one count a cell and task."""
    rows = (df.where(F.col(key).isNotNull() & F.col(group_col).isNotNull())
            .select(*[F.col(c) for c in dict.fromkeys([key, group_col, *subgroup_cols])]).distinct().repartition(F.col(key)))
    long = unpivot_levels(rows, subgroup_cols, [key, group_col]).where(F.col("level").isNotNull())
    margins = F.array(*[F.struct(F.lit(kl).cast("byte").alias("_kl"), F.lit(kg).cast("byte").alias("_kg")) for kl in (0, 1) for kg in (0, 1)])
    cells = long.select(F.col(key).alias("_key"), F.col("variable").alias("_variable"), "level", F.col(group_col).alias("_g"), F.explode(margins).alias("_m"))
    cells = cells.select("_key", "_variable", "_m._kl", "_m._kg", F.when(F.col("_m._kl") == 0, F.col("level")).alias("_level"),
                         F.when(F.col("_m._kg") == 0, F.col("_g")).alias("_group"))
    by = ["_variable", "_kl", "_kg", "_level", "_group"]
    return cells.groupBy("_key", *by).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count("_key").alias("_n"))


def data_stats(df: DataFrame, key: str, value: str, group_col: str, subgroup_cols: Sequence[str]) -> DataFrame:
    """Per variable, level and group (with ``All`` margins on both):
    ``N`` distinct keys, ``pct``, ``obs`` (non-null keys), ``M`` mean and
    ``SD`` sample SD of ``value``. Tidy output: one row per cell.

    ``pct = N / ((sum of level N + N_All) / 2) * 100`` per variable and group,
    the reference's formula (not N / N_All when a key has several levels). SD is
    the sample SD in every cell, the corner included. Rows with a null level
    or group are left out, as pandas' pivot does. ``level_total`` and
    ``group_total`` (0, 1) tell the margins from real levels called ``All``.
    """
    long = unpivot_levels(df.filter(F.col(group_col).isNotNull()), subgroup_cols, [key, value, group_col]) \
        .filter(F.col("level").isNotNull())
    g = long.groupingSets([["variable", "level", group_col], ["variable", "level"], ["variable", group_col],
                           ["variable"]], "variable", "level", group_col).agg(
        F.count(key).alias("obs"),
        F.avg(F.col(value).cast("double")).alias("M"), F.stddev_samp(F.col(value).cast("double")).alias("SD"),
        F.grouping("level").alias("_gl"), F.grouping(group_col).alias("_gg"))
    keys = _distinct_keys(df, key, group_col, subgroup_cols)
    same = (F.col("variable") == F.col("_variable")) & (F.col("_gl") == F.col("_kl")) & (F.col("_gg") == F.col("_kg"))
    same = same & F.col("level").eqNullSafe(F.col("_level")) & F.col(group_col).eqNullSafe(F.col("_group"))
    g = g.join(keys, same, "left").withColumn("N", F.coalesce("_n", F.lit(0).cast("long")))
    g = g.select("variable",
                 F.when(F.col("_gl") == 1, F.lit(ALL)).otherwise(F.col("level")).alias("level"),
                 F.when(F.col("_gg") == 1, F.lit(ALL)).otherwise(F.col(group_col).cast("string")).alias("group"),
                 "N", "obs", "M", "SD", F.col("_gl").alias("level_total"), F.col("_gg").alias("group_total"))
    denom = F.sum("N").over(Window.partitionBy("variable", "group", "group_total")) / 2
    return g.withColumn("pct", F.col("N") / denom * 100)


# Column-name parts of the wide description (fixed values of the layout).
WIDE_PARTS = (("N", "(1. N)"), ("pct", "(1. %)"), ("obs", "(2. obs)"), ("M", "(3. M)"), ("SD", "(4. SD)"))


def data_stats_wide(tidy: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A8 in the original wide layout: one row per (variable, level) and, per
    group (and ``All``), the columns ``<g>(1. N)``, ``<g>(1. %)``,
    ``<g>(2. obs)``, ``<g>(3. M)``, ``<g>(4. SD)``, sorted by name; N, % and
    obs are zero-filled, M and SD are not. Names are built, not string-replaced,
    so a capital N in a group name stays. Pivots the small tidy table."""
    gs = [*groups, ALL]
    aggs = []
    for g in gs:
        for col, suffix in WIDE_PARTS:
            v = F.first(F.when(F.col("group") == g, F.col(col)), ignorenulls=True)
            if col in ("N", "pct", "obs"):
                v = F.coalesce(v, F.lit(0))
            aggs.append((f"{g}{suffix}", v))
    aggs.sort(key=lambda t: t[0])
    return tidy.groupBy("variable", "level").agg(*[e.alias(n) for n, e in aggs])
