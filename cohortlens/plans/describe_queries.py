"""Descriptive-table and group-test queries (section 7.5, describe rows).

Population stand-in: ``orders`` + ``customer`` + ``nation`` (key
``c_custkey``, group ``c_mktsegment``, levels ``n_regionkey``,
``o_orderstatus``, ``o_orderpriority``, value ``o_totalprice``). Group tests
run on ``events`` (value ``value``, group ``event_type``, key ``user_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import describe as D
from cohortlens.plans import stat_sql as Q
from cohortlens.plans.registry import query
from cohortlens.sources.tables import read_table

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
TEST_GROUPS = ["click", "purchase"]


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
             .select("c_custkey", "c_mktsegment", "n_regionkey", "o_orderstatus", "o_orderpriority",
                     "o_totalprice", "o_orderkey", (F.col("o_totalprice") / 1000).alias("price_k")))


POP_SQL = """WITH pop AS (
  SELECT c_custkey, c_mktsegment, n_regionkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey,
         o_totalprice / 1000 AS price_k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""


def banded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events plus two level columns: quarter of the day and a value band
    (values under 1 are 'unknown', to exercise complete-case filtering)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.withColumn("hour_band", F.concat(F.lit("h"), F.floor(F.hour("ts") / 6).cast("int").cast("string"))) \
             .withColumn("value_band", F.when(F.col("value") < 1, "unknown").when(F.col("value") < 20, "low")
                         .when(F.col("value") < 80, "mid").otherwise("high"))


BANDED_SQL = """WITH ev AS (
  SELECT *, 'h' || CAST(CAST(floor(hour(ts) / 6) AS INTEGER) AS VARCHAR) AS hour_band,
         CASE WHEN value < 1 THEN 'unknown' WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid'
              ELSE 'high' END AS value_band
  FROM events)
"""


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


# ------------------------------------------------------------- A1, A2 ------

@query("top_groups", """
SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rank
FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 2
""")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A2: rows per event type, the two largest."""
    return D.top_groups(read_table(spark, sf_dir, "events"), "event_type", 2).withColumn(
        "rank", F.col("rank").cast("long"))


@query("value_counts", """
SELECT event_type, count(*) AS n FROM events GROUP BY event_type
""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: rows per value, largest first."""
    return D.value_counts(read_table(spark, sf_dir, "events"), "event_type")


# ------------------------------------------------------------- A5-A7 -------

@query("flag_pivot", """
SELECT user_id, """ + ", ".join(
    f"CASE WHEN max(CASE WHEN event_type = '{t}' THEN ts END) IS NOT NULL THEN 1 ELSE 0 END AS {t}"
    for t in ["click", "error", "purchase", "signup", "view"]) + """
FROM events GROUP BY user_id
""")
def flag_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest date per subject and event type (pivot with given levels),
    then 0/1 flags."""
    return D.max_pivot_flags(read_table(spark, sf_dir, "events"), "user_id", "event_type", "ts", ["click", "error", "purchase", "signup", "view"])


@query("distinct_pivot", POP_SQL + "SELECT n_regionkey, " + ", ".join(
    f"count(DISTINCT CASE WHEN c_mktsegment = '{s}' THEN c_custkey END) AS {s}" for s in SEGMENTS)
    + " FROM pop GROUP BY n_regionkey")
def distinct_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: distinct customers by region x segment, zero-filled."""
    return D.distinct_pivot(population(spark, sf_dir), "c_custkey", "n_regionkey", "c_mktsegment", SEGMENTS)


@query("distinct_pivot_margins", POP_SQL + """,
c AS (
  SELECT CASE WHEN grouping(n_regionkey) = 1 THEN 'All' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey,
         CASE WHEN grouping(c_mktsegment) = 1 THEN 'All' ELSE c_mktsegment END AS seg,
         count(DISTINCT c_custkey) AS n
  FROM pop GROUP BY CUBE (n_regionkey, c_mktsegment))
SELECT n_regionkey, """ + ", ".join(
    f"coalesce(max(CASE WHEN seg = '{s}' THEN n END), 0) AS {s}" for s in SEGMENTS + ["All"]) + """
FROM c GROUP BY n_regionkey
""")
def distinct_pivot_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 with 'All' row and column (distinct counts on raw rows)."""
    return D.distinct_pivot_margins(population(spark, sf_dir), "c_custkey", "n_regionkey", "c_mktsegment",
                                    SEGMENTS)


@query("mean_pivot_margins", POP_SQL + """,
c AS (
  SELECT CASE WHEN grouping(n_regionkey) = 1 THEN 'All' ELSE CAST(n_regionkey AS VARCHAR) END AS n_regionkey,
         CASE WHEN grouping(c_mktsegment) = 1 THEN 'All' ELSE c_mktsegment END AS seg,
         avg(price_k) AS m
  FROM pop WHERE price_k IS NOT NULL GROUP BY CUBE (n_regionkey, c_mktsegment))
SELECT n_regionkey, """ + ", ".join(
    f"round(max(CASE WHEN seg = '{s}' THEN m END), 4) AS {s}" for s in SEGMENTS + ["All"]) + """
FROM c GROUP BY n_regionkey
""")
def mean_pivot_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 with another aggregate: mean order value by region x segment with margins."""
    p = D.distinct_pivot_margins(population(spark, sf_dir), "price_k", "n_regionkey", "c_mktsegment", SEGMENTS, F.mean, None)
    return p.select("n_regionkey", *[F.round(c, 4).alias(c) for c in [*SEGMENTS, "All"]])


# ------------------------------------------------------------- A8 ----------

@query("group_description", POP_SQL + """,
long AS (
  SELECT c_custkey, price_k, c_mktsegment, 'n_regionkey' AS variable, CAST(n_regionkey AS VARCHAR) AS level FROM pop
  UNION ALL SELECT c_custkey, price_k, c_mktsegment, 'o_orderstatus', o_orderstatus FROM pop
  UNION ALL SELECT c_custkey, price_k, c_mktsegment, 'o_orderpriority', o_orderpriority FROM pop),
g AS (
  SELECT variable,
         CASE WHEN grouping(level) = 1 THEN 'All' ELSE level END AS level,
         CASE WHEN grouping(c_mktsegment) = 1 THEN 'All' ELSE c_mktsegment END AS "group",
         count(DISTINCT c_custkey) AS N, count(c_custkey) AS obs,
         avg(price_k) AS M, stddev_samp(price_k) AS SD
  FROM long
  GROUP BY GROUPING SETS ((variable, level, c_mktsegment), (variable, level), (variable, c_mktsegment), (variable)))
SELECT variable, level, "group", N, obs, round(M, 4) AS M, round(SD, 4) AS SD,
       round(N / (sum(N) OVER (PARTITION BY variable, "group") / 2) * 100, 6) AS pct
FROM g
""")
def group_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N, %, obs, mean, SD of order value (in thousands) per level x
    segment with margins, for three level columns in one grouped job."""
    out = D.data_stats(population(spark, sf_dir), "c_custkey", "price_k", "c_mktsegment",
                       ["n_regionkey", "o_orderstatus", "o_orderpriority"])
    return out.select("variable", "level", "group", "N", "obs", F.round("M", 4).alias("M"),
                      F.round("SD", 4).alias("SD"), r6("pct"))


# ------------------------------------------------------------- H1-H3 -------

TOP2_SQL = """WITH top AS (
  SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk
  FROM events GROUP BY event_type QUALIFY rk <= 2),
s AS (
  SELECT rk, event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v
  FROM events JOIN top USING (event_type) GROUP BY rk, event_type),
w AS (
  SELECT max(CASE WHEN rk = 1 THEN event_type END) AS group1, max(CASE WHEN rk = 2 THEN event_type END) AS group2,
         max(CASE WHEN rk = 1 THEN n END) AS n1, max(CASE WHEN rk = 2 THEN n END) AS n2,
         max(CASE WHEN rk = 1 THEN m END) AS m1, max(CASE WHEN rk = 2 THEN m END) AS m2,
         max(CASE WHEN rk = 1 THEN v END) AS v1, max(CASE WHEN rk = 2 THEN v END) AS v2
  FROM s)
"""


@query("cohens_d", TOP2_SQL + """
SELECT group1, group2, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2,
       round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS d FROM w
""")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: effect size between the two largest event types."""
    out = D.cohens_d(read_table(spark, sf_dir, "events"), "value", "event_type")
    return out.select("group1", "group2", "n1", "n2", r6("m1"), r6("m2"), r6("d"))


@query("welch_t", TOP2_SQL + """
SELECT group1, group2, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2,
       round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2)
             / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS dof
FROM w
""")
def welch_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: Welch t and its degrees of freedom (p in ``welch_t_p``)."""
    out = D.welch_t(read_table(spark, sf_dir, "events"), "value", "event_type", with_p=False)
    return out.select("group1", "group2", "n1", "n2", r6("m1"), r6("m2"), r6("t"), r6("dof"))


_SIG = "CASE WHEN {0} <= 0.001 THEN '***' WHEN {0} <= 0.01 THEN '**' WHEN {0} <= 0.05 THEN '*' ELSE '' END"


@query("welch_t_p", TOP2_SQL + """,
q AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b, ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) AS pooled FROM w),
t AS (SELECT *, (m1 - m2) / sqrt(a + b) AS t, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS dof, false AS equal_var FROM q
      UNION ALL SELECT *, (m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2)), n1 + n2 - 2, true FROM q)
SELECT group1, group2, n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(t, 6) AS t, round(dof, 6) AS dof, round(""" + Q.t_tails("t", "dof") + """, 6) AS p, equal_var FROM t
""")
def welch_t_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 with the two-sided p-value (and a pooled-variance row)."""
    ev = read_table(spark, sf_dir, "events")
    w = D.welch_t(ev, "value", "event_type").withColumn("equal_var", F.lit(False))
    p = D.welch_t(ev, "value", "event_type", equal_var=True).withColumn("equal_var", F.lit(True))
    return w.unionByName(p).select("group1", "group2", "n1", "n2", *map(r6, ("m1", "m2", "t", "dof", "p")), "equal_var")


@query("u_test", """WITH top AS (
  SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk
  FROM events GROUP BY event_type QUALIFY rk <= 2),
x AS (SELECT value FROM events JOIN top USING (event_type) WHERE rk = 1 AND value IS NOT NULL),
y AS (SELECT value FROM events JOIN top USING (event_type) WHERE rk = 2 AND value IS NOT NULL)
SELECT (SELECT event_type FROM top WHERE rk = 1) AS group1, (SELECT event_type FROM top WHERE rk = 2) AS group2,
       (SELECT count(*) FROM x) AS n1, (SELECT count(*) FROM y) AS n2,
       CAST((SELECT sum(CASE WHEN x.value > y.value THEN 2 WHEN x.value = y.value THEN 1 ELSE 0 END)
             FROM x, y) AS DOUBLE) / 2 AS u
""")
def u_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: U of the largest group against the second (oracle: all pairs)."""
    return D.u_test(read_table(spark, sf_dir, "events"), "value", "event_type", with_p=False)


@query("u_test_p", """WITH top AS (
  SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rk
  FROM events GROUP BY event_type QUALIFY rk <= 2),
v AS (SELECT value, count(*) FILTER (rk = 1)::DOUBLE AS a, count(*) FILTER (rk = 2)::DOUBLE AS b FROM events JOIN top USING (event_type)
      WHERE value IS NOT NULL GROUP BY value),
c AS (SELECT *, sum(b) OVER (ORDER BY value) - b AS below FROM v),
u AS (SELECT sum(a * (below + b / 2)) AS u1, sum(a) AS n1, sum(b) AS n2, sum(pow(a + b, 3) - (a + b)) AS ties FROM c),
z AS (SELECT *, least(u1, n1 * n2 - u1) AS small,
  (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u),
p AS (SELECT *, least(1.0, """ + Q.normal_tails("z") + """) AS p FROM z)
SELECT (SELECT event_type FROM top WHERE rk = 1) AS group1, (SELECT event_type FROM top WHERE rk = 2) AS group2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2,
  CASE alternative WHEN 'legacy' THEN small ELSE u1 END AS u, round(CASE alternative WHEN 'legacy' THEN p / 2 ELSE p END, 6) AS p_u, alternative
FROM p, (VALUES ('two-sided'), ('legacy')) AS x(alternative)
""")
def u_test_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 with p-values: current two-sided form and the legacy smaller-U form."""
    ev = read_table(spark, sf_dir, "events")
    a = D.u_test(ev, "value", "event_type").withColumn("alternative", F.lit("two-sided"))
    b = D.u_test(ev, "value", "event_type", alternative="legacy").withColumn("alternative", F.lit("legacy"))
    return a.unionByName(b).withColumn("p_u", F.round("p_u", 6))


# ------------------------------------------------------------- H4 ----------

SUBGROUP_SQL = BANDED_SQL + """,
t AS (SELECT value, event_type, hour_band AS subgroup FROM ev WHERE event_type IN ('click', 'purchase')
      UNION ALL SELECT value, event_type, 'all' FROM ev WHERE event_type IN ('click', 'purchase')),
m AS (
  SELECT subgroup,
    count(value) FILTER (WHERE event_type = 'click') AS n1, count(value) FILTER (WHERE event_type = 'purchase') AS n2,
    avg(value) FILTER (WHERE event_type = 'click') AS m1, avg(value) FILTER (WHERE event_type = 'purchase') AS m2,
    var_samp(value) FILTER (WHERE event_type = 'click') AS v1,
    var_samp(value) FILTER (WHERE event_type = 'purchase') AS v2
  FROM t GROUP BY subgroup),
u AS (
  SELECT x.subgroup, CAST(sum(CASE WHEN x.value > y.value THEN 2 WHEN x.value = y.value THEN 1 ELSE 0 END)
                          AS DOUBLE) / 2 AS u
  FROM (SELECT * FROM t WHERE event_type = 'click') x JOIN (SELECT * FROM t WHERE event_type = 'purchase') y
    ON x.subgroup = y.subgroup
  GROUP BY x.subgroup)
SELECT m.subgroup, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
       round((v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2)
             / ((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)), 6) AS dof,
       u.u
FROM m JOIN u ON m.subgroup = u.subgroup
"""


@query("subgroup_tests", SUBGROUP_SQL)
def subgroup_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: Welch t and U of click vs purchase per quarter of the day and overall."""
    out = D.subgroup_tests(banded_events(spark, sf_dir), "value", "event_type", TEST_GROUPS, "hour_band",
                           with_p=False)
    return out.select("subgroup", r6("t"), r6("dof"), "u")


@query("subgroup_tests_p", SUBGROUP_SQL.split("SELECT m.subgroup,")[0] + """,
ties AS (SELECT subgroup, sum(pow(k, 3) - k) AS ties FROM (SELECT subgroup, value, count(*) AS k FROM t WHERE value IS NOT NULL GROUP BY subgroup, value) GROUP BY subgroup),
z AS (SELECT m.subgroup, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
  pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof, u.u,
  (greatest(u.u, n1 * n2 - u.u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))) AS z
  FROM m JOIN u ON m.subgroup = u.subgroup JOIN ties ON m.subgroup = ties.subgroup),
p AS (SELECT *, """ + Q.t_tails("t", "dof") + " AS p_t, least(1.0, " + Q.normal_tails("z") + """) AS p_u FROM z)
SELECT subgroup, round(t, 6) AS t, round(dof, 6) AS dof, u, round(p_t, 6) AS p_t, round(p_u, 6) AS p_u, """
       + _SIG.format("p_t") + " AS sig_t, " + _SIG.format("p_u") + " AS sig_u FROM p")
def subgroup_tests_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4 with p-values and stars."""
    out = D.subgroup_tests(banded_events(spark, sf_dir), "value", "event_type", TEST_GROUPS, "hour_band")
    return out.select("subgroup", r6("t"), r6("dof"), "u", r6("p_t"), r6("p_u"), "sig_t", "sig_u")


# ------------------------------------------------------------- H5 ----------

CHI_SQL = BANDED_SQL + """,
d AS (SELECT * FROM ev WHERE event_type IN ('click', 'purchase')),
long AS (SELECT user_id, event_type, 'hour_band' AS variable, hour_band AS level FROM d
         UNION ALL SELECT user_id, event_type, 'value_band', value_band FROM d),
cells AS (
  SELECT variable, level,
         count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS click,
         count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchase
  FROM long WHERE level IS NOT NULL AND level NOT IN ('not known', 'unknown') GROUP BY variable, level),
t AS (
  SELECT *, CAST(click + purchase AS DOUBLE) AS r,
         sum(click + purchase) OVER (PARTITION BY variable) AS tot,
         sum(click) OVER (PARTITION BY variable) AS c1, sum(purchase) OVER (PARTITION BY variable) AS c2,
         count(*) OVER (PARTITION BY variable) - 1 AS dof
  FROM cells),
e AS (SELECT *, r * c1 / tot AS e1, r * c2 / tot AS e2 FROM t),
dev AS (SELECT *, abs(click - e1) AS d1, abs(purchase - e2) AS d2 FROM e),
adj AS (SELECT *, CASE WHEN dof = 1 THEN d1 - least(0.5, d1) ELSE d1 END AS a1,
                  CASE WHEN dof = 1 THEN d2 - least(0.5, d2) ELSE d2 END AS a2 FROM dev)
SELECT variable, level, click, purchase,
       round(sum(a1 * a1 / e1 + a2 * a2 / e2) OVER (PARTITION BY variable), 6) AS chi2, dof
FROM adj
"""


@query("chi_square", CHI_SQL)
def chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: distinct users by level x event type and chi-square per variable
    (Yates when dof = 1), 'unknown' levels dropped."""
    out = D.chi_square(banded_events(spark, sf_dir), "user_id", "event_type", TEST_GROUPS,
                       ["hour_band", "value_band"], with_p=False)
    return out.select("variable", "level", "click", "purchase", r6("chi2"), "dof")


@query("chi_square_p", CHI_SQL.replace("round(sum(a1", "sum(a1").replace("(PARTITION BY variable), 6) AS chi2", "(PARTITION BY variable) AS chi2").replace(
    "SELECT variable, level, click, purchase,\n", ", x AS (SELECT variable, level, click, purchase,\n") + "), p AS (SELECT *, " + Q.chi2_tail("chi2", "dof") + """ AS p FROM x)
SELECT variable, level, click, purchase, round(chi2, 6) AS chi2, dof, round(p, 6) AS p, """ + _SIG.format("p") + " AS p_significance FROM p")
def chi_square_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5 with p-values and stars."""
    out = D.chi_square(banded_events(spark, sf_dir), "user_id", "event_type", TEST_GROUPS, ["hour_band", "value_band"])
    return out.select("variable", "level", "click", "purchase", r6("chi2"), "dof", r6("p"), "p_significance")


def _wide_sql() -> str:
    tidy = registry_sql("group_description")
    parts = []
    for g in sorted([*SEGMENTS, "All"]):
        for col, suffix in D.WIDE_PARTS:
            v = f"max(CASE WHEN \"group\" = '{g}' THEN {col} END)"
            if col in ("N", "pct", "obs"):
                v = f"coalesce({v}, 0)"
            parts.append((f"{g}{suffix}", v))
    parts.sort(key=lambda t: t[0])
    cols = ", ".join(f'{v} AS "{n}"' for n, v in parts)
    return f"WITH t AS ({tidy}) SELECT variable, level, {cols} FROM t GROUP BY variable, level"


def registry_sql(name: str) -> str:
    from cohortlens.plans import registry
    return registry._ORACLES[name]


@query("group_description_wide", _wide_sql())
def group_description_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 in the original wide layout (per segment and All: N, %, obs, M, SD)."""
    return D.data_stats_wide(group_description(spark, sf_dir), SEGMENTS)
