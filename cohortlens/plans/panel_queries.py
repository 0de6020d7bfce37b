"""Panel queries on the test tables (section 7.5, panel rows).

``events`` stands for the panel: subject ``user_id``, time ``ts`` (tie-break
``event_id``), target ``value``, category ``event_type``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.panel import Panel, bucket_data, load_panel
from cohortlens.plans.registry import query
from cohortlens.sources.tables import read_table

EVENTS_PANEL = Panel(group="user_id", timestamp="ts", target="value", covariates=("event_type",),
                     to_bucket="day", bucket_min=0.0, bucket_max=30.0, interval=5.0, min_obs=3,
                     tiebreak=("event_id",))

US_PER_DAY = 86_400_000_000.0


def events_with_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events plus ``day``: days since the subject's first event (fractional)."""
    from cohortlens.operators.panel import subject_aggregate
    ev = read_table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = subject_aggregate(ev, "user_id", [F.min(us).alias("_first_us")])
    return ev.withColumn("day", (us - F.col("_first_us")) / F.lit(US_PER_DAY)).drop("_first_us")


def r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


PANEL_BUCKETS_SQL = """
WITH base AS (
  SELECT user_id, event_id, ts, event_type, value,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 86400000000.0 AS day
  FROM events),
g AS (
  SELECT user_id, CAST(ceil(day / 5.0) AS DOUBLE) * 5.0 AS day_upbound,
         arg_min(event_type, [epoch_us(ts), event_id]) FILTER (WHERE event_type IS NOT NULL) AS event_type,
         avg(value) AS value, avg(day) AS day
  FROM base WHERE day >= 0 AND day <= 30 GROUP BY 1, 2),
o AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS occur FROM g)
SELECT user_id, day_upbound, event_type, round(value, 6) AS value, round(day, 6) AS day, occur,
       row_number() OVER (PARTITION BY user_id ORDER BY day_upbound) AS counter
FROM o WHERE occur >= 3
"""


@query("panel_buckets", PANEL_BUCKETS_SQL)
def panel_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 (+P2, P6, A3, W1, W3): 5-day buckets of days since first event."""
    df = load_panel(events_with_day(spark, sf_dir), EVENTS_PANEL)
    out = bucket_data(df, EVENTS_PANEL)
    return out.select("user_id", "day_upbound", "event_type", r6("value"), r6("day"), "occur", "counter")


# ----------------------------------------------------------------- S3, P1 --

@query("panel_select", """
SELECT event_type, user_id, value, ts, event_id FROM events
""")
def panel_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 + P1: keep only the panel's role columns (pruned at the scan)."""
    panel = Panel(group="user_id", timestamp="ts", target="value", covariates=("event_type",),
                  tiebreak=("event_id",))
    return load_panel(read_table(spark, sf_dir, "events"), panel)


# ---------------------------------------------------------- W1, W2, P23 --

@query("baseline_join", """
WITH w AS (
  SELECT event_id, user_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS counter,
         first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS value_baseline
  FROM events)
SELECT event_id, user_id, counter, value_baseline,
       round(1 + value - value_baseline, 6) AS value_centered,
       CASE WHEN value_baseline >= 50 THEN 1 ELSE 0 END AS high_baseline,
       1 - CASE WHEN value_baseline >= 50 THEN 1 ELSE 0 END AS low_baseline
FROM w
""")
def baseline_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 + W2 + P23 + P18 + P17: running number, baseline value, centred value,
    baseline threshold flag and its complement, in one window pass."""
    from cohortlens.functions.columns import centred_time, complement, threshold_flag
    from cohortlens.operators.panel import with_baseline, with_running_number
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    order = ["ts", "event_id"]
    df = with_baseline(with_running_number(ev, "user_id", order), "user_id", order, ["value"])
    return df.select("event_id", "user_id", "counter", "value_baseline",
                     F.round(centred_time("value", "value_baseline"), 6).alias("value_centered"),
                     threshold_flag("value_baseline", 50, inclusive=True).alias("high_baseline"),
                     complement(threshold_flag("value_baseline", 50, inclusive=True)).alias("low_baseline"))


@query("baseline_filter_join", """
WITH d AS (
  SELECT event_id, user_id, value, event_type,
         date_diff('day', CAST(min(ts) OVER (PARTITION BY user_id) AS DATE), CAST(ts AS DATE)) + 1 AS day_index
  FROM events)
SELECT a.event_id, a.user_id, a.value, a.day_index, b.value AS value_baseline, b.event_type AS event_type_baseline
FROM d a LEFT JOIN (SELECT user_id, value, event_type FROM d WHERE day_index = 1
                    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) b ON a.user_id = b.user_id
""")
def baseline_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 join form + J5: the baseline is the first row (by id) of the subject's
    first calendar day (``day_index = 1``), joined back with ``_baseline`` names;
    every row comes out once."""
    from cohortlens.operators.panel import join_baseline_rows
    from cohortlens.operators.panel import subject_aggregate
    ev = subject_aggregate(read_table(spark, sf_dir, "events"), "user_id", [F.min("ts").alias("_first_ts")])
    d = ev.withColumn("day_index", F.datediff(F.to_date("ts"), F.to_date("_first_ts")) + 1)
    out = join_baseline_rows(d.select("event_id", "user_id", "value", "event_type", "day_index"), "user_id",
                             F.col("day_index") == 1, ["value", "event_type"], ["event_id"])
    return out.select("event_id", "user_id", "value", "day_index", "value_baseline", "event_type_baseline")


@query("min_obs_subjects", """
SELECT user_id, count(*) AS size FROM events
GROUP BY user_id HAVING count(*) >= 60
""")
def min_obs_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 + A1: subjects with at least 60 rows and their row count (``size``,
    largest first)."""
    from cohortlens.operators.panel import keep_min_obs
    kept = keep_min_obs(read_table(spark, sf_dir, "events"), "user_id", 60)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "user_id")


@query("normalized_panel", """
SELECT event_id, user_id,
       round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value,
       round((CAST(event_id AS DOUBLE) - min(event_id) OVER ()) / (max(event_id) OVER () - min(event_id) OVER ()), 6)
         AS event_rank
FROM events
""")
def normalized_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min-max scaling of the numeric covariates."""
    from cohortlens.operators.panel import normalize
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value",
                                                    F.col("event_id").alias("event_rank"))
    out = normalize(ev, ["value", "event_rank"])
    return out.select("event_id", "user_id", r6("value"), r6("event_rank"))


# ----------------------------------------------------------- P9-P12 --------

@query("clinical_categories", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity <= 18.5 THEN 'underweight' WHEN l_quantity <= 25 THEN 'normal'
       WHEN l_quantity <= 30 THEN 'preobese' WHEN l_quantity IS NOT NULL THEN 'obese' ELSE 'not known' END AS bmi,
  CASE WHEN l_tax = 0 AND l_discount > 0 THEN 'hypertension'
       WHEN l_tax = 0 THEN 'not known'
       WHEN l_discount / l_tax <= 120.0 / 80.0 THEN 'normal'
       WHEN l_discount / l_tax <= 140.0 / 90.0 THEN 'prehypertension'
       ELSE 'hypertension' END AS blood_pressure,
  CASE WHEN l_discount * 100 <= 5.5 THEN 'normal' WHEN l_discount * 100 <= 7 THEN 'prediabetic'
       ELSE 'diabetic' END AS glucose,
  CASE WHEN TRY_CAST(l_returnflag AS DOUBLE) IS NULL THEN 'not known'
       WHEN TRY_CAST(l_returnflag AS DOUBLE) <= 18.5 THEN 'underweight' ELSE 'normal' END AS bmi_text
FROM lineitem
""")
def clinical_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BMI, blood-pressure ratio (zero diastolic included) and glucose
    categories; a text column coerces to "not known"."""
    from cohortlens.functions.columns import blood_pressure, bmi_category, diabetes
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     bmi_category("l_quantity").alias("bmi"),
                     blood_pressure("l_discount", "l_tax").alias("blood_pressure"),
                     diabetes(F.col("l_discount") * 100).alias("glucose"),
                     bmi_category("l_returnflag").alias("bmi_text"))


# ----------------------------------------------------------- P13-P20 -------

FLAGS_SQL = """
WITH o AS (
  SELECT o_orderkey, o_totalprice, o_orderpriority,
         CASE o_orderstatus WHEN 'F' THEN 'No' WHEN 'O' THEN 'yes' ELSE NULL END AS answer,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE (o_totalprice - 150000) / 100000 END AS score
  FROM orders)
SELECT o_orderkey,
  CASE WHEN lower(answer) IN ('no','null','na','#n/a','n/a') OR answer IS NULL THEN 0 ELSE 1 END AS answer_bool,
  CASE WHEN lower(answer) IN ('no','null','na','#n/a','n/a') OR answer IS NULL THEN 1 ELSE 0 END AS answer_bool_legacy,
  CASE WHEN answer IS NULL OR lower(answer) IN ('no','null','#n/a','0') THEN 0 ELSE 1 END AS answer_flag,
  CASE WHEN score > 0 THEN 1 ELSE 0 END AS score_positive,
  CASE WHEN score IS NULL THEN 0.0 ELSE least(score, 1.0) END AS score_capped,
  CASE WHEN coalesce(score, 0) > 1 THEN 0 ELSE 1 END AS score_absent,
  1 - CASE WHEN score > 0 THEN 1 ELSE 0 END AS score_not_positive,
  coalesce(CAST(score > 0.5 AS INTEGER), 0) AS score_high,
  least(coalesce(score, 0.0), 1.0) + least(coalesce(o_totalprice / 100000, 0.0), 1.0) AS capped_total,
  coalesce(score, 0.0) + coalesce(o_totalprice / 100000, 0.0) AS row_total,
  CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 0 ELSE NULL END AS urgent
FROM o
"""


@query("flags", FLAGS_SQL)
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13-P20 + P5 + P29: yes/no text to 0/1 (both polarities), text flag,
    score flags, absent flag, complement, threshold, capped and row sums."""
    from cohortlens.functions import columns as C
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "No").when(F.col("o_orderstatus") == "O", "yes").alias("answer"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
         .otherwise((F.col("o_totalprice") - 150000) / 100000).alias("score"))
    price = F.col("o_totalprice") / 100000
    return o.select(
        "o_orderkey",
        C.boolify_text("answer").alias("answer_bool"),
        C.boolify_text("answer", legacy_polarity=True).alias("answer_bool_legacy"),
        C.text_flag("answer").alias("answer_flag"),
        C.positive_flag("score").alias("score_positive"),
        C.capped_flag("score").alias("score_capped"),
        C.absent_flag("score").alias("score_absent"),
        C.complement(C.positive_flag("score")).alias("score_not_positive"),
        C.threshold_flag("score", 0.5).alias("score_high"),
        C.capped_sum([F.col("score"), price]).alias("capped_total"),
        C.row_sum([F.col("score"), price]).alias("row_total"),
        F.when(F.col("o_orderpriority").startswith("1"), 1)
         .when(F.col("o_orderpriority").startswith("2"), 0).alias("urgent"))


@query("flags_by_name", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN coalesce(l_quantity, 0) > 1 THEN 0 ELSE 1 END AS l_quantity_absent,
       CASE WHEN coalesce(l_discount, 0) > 1 THEN 0 ELSE 1 END AS l_discount_absent,
       CASE WHEN coalesce(l_tax, 0) > 1 THEN 0 ELSE 1 END AS l_tax_absent
FROM lineitem
""")
def flags_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 + P29: an absent flag beside every column chosen by its name, in one projection."""
    from cohortlens.functions import columns as C
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return lines.withColumns(C.by_name(lines.columns, "l_", ["key", "line", "price"], "_absent", C.absent_flag))


# ----------------------------------------------------------- P6-P8, P22 ----

@query("rounding", """
SELECT l_orderkey, l_linenumber,
  CAST(floor(l_extendedprice / 1000 / 0.5) AS DOUBLE) * 0.5 AS price_down,
  CAST(ceil(l_extendedprice / 1000 / 0.5) AS DOUBLE) * 0.5 AS price_up,
  CAST(floor((l_quantity - 25) / 7.0) AS DOUBLE) * 7.0 AS qty_round_down,
  '[' || CAST(CAST(ceil(l_discount * 100 / 0.5) AS DOUBLE) * 0.5 - 0.5 AS VARCHAR) || ', '
      || CAST(CAST(ceil(l_discount * 100 / 0.5) AS DOUBLE) * 0.5 AS VARCHAR) || ']' AS discount_bucket,
  CAST(floor(l_quantity / 10.0) AS DOUBLE) * 10.0 AS qty_decade
FROM lineitem
""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (both directions), P7 (Python modulo on negatives), P8 (text bucket),
    P22 (decade)."""
    from cohortlens.functions import columns as C
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     C.round_nearest(F.col("l_extendedprice") / 1000, 0.5, "down").alias("price_down"),
                     C.round_nearest(F.col("l_extendedprice") / 1000, 0.5, "up").alias("price_up"),
                     C.round_down(F.col("l_quantity") - 25, 7).alias("qty_round_down"),
                     C.num_to_bucket(F.col("l_discount") * 100, 0.5).alias("discount_bucket"),
                     C.decade("l_quantity").alias("qty_decade"))


# ----------------------------------------------------------- P21, P4, D4 ---

@query("age_clean", """
WITH o AS (
  SELECT o_orderkey, year(o_orderdate) AS score_year,
         CASE WHEN o_custkey % 7 = 0 THEN NULL
              ELSE make_date(CAST(1940 + o_custkey % 70 AS BIGINT), CAST(1 + o_custkey % 12 AS BIGINT), 1) END AS dob
  FROM orders)
SELECT o_orderkey, score_year, greatest(10.0, CAST(score_year - coalesce(year(dob), 1900) AS DOUBLE)) AS age_at_score
FROM o WHERE score_year >= 1996 AND score_year < 2001
""")
def age_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21 + D4 + P2 + P4: age at score floored at 10 (unknown birth year 1900),
    year range filter, rows without age dropped."""
    from cohortlens.functions.columns import age_at
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("score_year"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("date"))
         .otherwise(F.make_date((1940 + F.col("o_custkey") % 70).cast("int"),
                                (1 + F.col("o_custkey") % 12).cast("int"), F.lit(1))).alias("dob"))
    o = o.withColumn("age_at_score", age_at("score_year", "dob"))
    o = o.filter((F.col("score_year") >= 1996) & (F.col("score_year") < 2001)).dropna(subset=["age_at_score"])
    return o.select("o_orderkey", "score_year", "age_at_score")


# ----------------------------------------------------------- D1-D3 ---------

HALF_SQL_CTE = """
WITH st AS (
  SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, o.o_orderdate AS s, l.l_shipdate AS e
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE l.l_shipdate >= o.o_orderdate),
h AS (
  SELECT *, year(s) * 2 + CASE WHEN month(s) > 6 THEN 1 ELSE 0 END AS h0,
            year(e) * 2 + CASE WHEN month(e) > 6 THEN 1 ELSE 0 END AS h1 FROM st),
x AS (SELECT *, unnest(range(h0, h1 + 1)) AS h FROM h),
d AS (
  SELECT l_orderkey, l_linenumber, o_custkey,
         CAST(h // 2 AS DOUBLE) + (h % 2) * 0.5 AS dates,
         CASE WHEN h0 = h1 THEN CAST(floor((epoch_us(e) - epoch_us(s)) / 86400000000) AS DOUBLE)
              WHEN h = h0 THEN CAST(floor((epoch_us(CASE WHEN month(s) <= 6 THEN make_timestamp(year(s), 6, 30, 0, 0, 0)
                                                        ELSE make_timestamp(year(s), 12, 31, 0, 0, 0) END)
                                           - epoch_us(s)) / 86400000000) AS DOUBLE)
              WHEN h = h1 THEN CAST(floor((epoch_us(e) - epoch_us(CASE WHEN month(e) <= 6
                                                        THEN make_timestamp(year(e) - 1, 12, 31, 0, 0, 0)
                                                        ELSE make_timestamp(year(e), 6, 30, 0, 0, 0) END))
                                          / 86400000000) AS DOUBLE)
              ELSE 182.5 END AS days
  FROM x)
"""


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    st = li.join(o, li.l_orderkey == o.o_orderkey)
    return st.filter(F.col("l_shipdate") >= F.col("o_orderdate"))


@query("half_year_days", HALF_SQL_CTE + "SELECT l_orderkey, l_linenumber, dates, days FROM d")
def half_year_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 + D2: stays (order date to ship date) split into half-years."""
    from cohortlens.operators.periods import half_years
    return half_years(_stays(spark, sf_dir), "o_orderdate", "l_shipdate", ["l_orderkey", "l_linenumber"])


@query("half_year_by_subject", HALF_SQL_CTE + """
SELECT o_custkey, dates, sum(days) AS days FROM d GROUP BY o_custkey, dates
""")
def half_year_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: stay days per customer and half-year."""
    from cohortlens.operators.periods import days_by_period, half_years
    h = half_years(_stays(spark, sf_dir), "o_orderdate", "l_shipdate", ["o_custkey"])
    return days_by_period(h, "o_custkey")


# ----------------------------------------------------------- J1-J4 ---------

@query("left_join_fill", """
WITH d AS (
  SELECT o_custkey AS cust, CAST(year(l_shipdate) AS BIGINT) AS year, count(*) AS num_docs
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS BIGINT) AS score_year,
       coalesce(d.year, 0) AS year, coalesce(d.num_docs, 0) AS num_docs
FROM orders LEFT JOIN d ON o_custkey = d.cust AND CAST(year(o_orderdate) AS BIGINT) = d.year
""")
def left_join_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 + J5 + P5: orders left-joined on (customer, year) = (customer, ship
    year) to per-customer yearly line counts; misses filled with 0."""
    from cohortlens.operators.joins import merge
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = read_table(spark, sf_dir, "orders")
    docs = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
              .groupBy("o_custkey", F.year("l_shipdate").cast("long").alias("year"))
              .agg(F.count(F.lit(1)).alias("num_docs")))
    left = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("score_year"))
    out = merge(left, docs, "left", left_on=["o_custkey", "score_year"], right_on=["o_custkey", "year"], fill=0)
    return out.select("o_orderkey", "o_custkey", "score_year", "year", "num_docs")


@query("right_join_composite", """
WITH n AS (SELECT l_orderkey AS orderkey, CAST(year(l_shipdate) AS BIGINT) AS score_year,
                  sum(l_quantity) AS qty, count(*) AS lines
           FROM lineitem GROUP BY 1, 2)
SELECT o.o_orderkey AS orderkey, CAST(year(o.o_orderdate) AS BIGINT) AS score_year, n.qty, n.lines, o.o_totalprice
FROM n RIGHT JOIN orders o ON n.orderkey = o.o_orderkey AND n.score_year = CAST(year(o.o_orderdate) AS BIGINT)
""")
def right_join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order yearly line aggregates right-joined to every order on the
    composite key (order, year)."""
    from cohortlens.operators.joins import merge
    n = (read_table(spark, sf_dir, "lineitem")
         .groupBy(F.col("l_orderkey").alias("orderkey"), F.year("l_shipdate").cast("long").alias("score_year"))
         .agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("lines")))
    h = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.year("o_orderdate").cast("long").alias("score_year"), "o_totalprice")
    return merge(n, h, "right", on=["orderkey", "score_year"]).select(
        "orderkey", "score_year", "qty", "lines", "o_totalprice")


@query("population_inner", """
SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey
""")
def population_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population inner-joined with its orders."""
    from cohortlens.operators.joins import merge
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return merge(c, o, "inner", on=["c_custkey"])


STATUS_LEVELS = ["F", "O", "P"]


@query("population_unknown", """
WITH p AS (
  SELECT o_custkey, """ + ", ".join(
    f"max(CASE WHEN o_orderstatus = '{s}' THEN o_orderdate END) AS d_{s}" for s in STATUS_LEVELS) + """
  FROM orders GROUP BY o_custkey),
f AS (
  SELECT c_custkey, """ + ", ".join(
    f"CASE WHEN d_{s} IS NOT NULL THEN 1 ELSE 0 END AS diag_{s}" for s in STATUS_LEVELS) + """
  FROM customer LEFT JOIN p ON c_custkey = o_custkey)
SELECT *, 1 - least(1, """ + " + ".join(f"diag_{s}" for s in STATUS_LEVELS) + """) AS diag_unknown FROM f
""")
def population_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 + A7: customers left-joined to their pivoted 'diagnoses' (orders by
    status, latest date, then 0/1); ``diag_unknown`` marks those without any."""
    from cohortlens.operators.describe import max_pivot_flags
    from cohortlens.operators.joins import merge
    from cohortlens.operators.joins import with_unknown_flag
    o = read_table(spark, sf_dir, "orders")
    flags = max_pivot_flags(o.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderstatus",
                            "o_orderdate", STATUS_LEVELS)
    flags = flags.select("c_custkey", *[F.col(s).alias(f"diag_{s}") for s in STATUS_LEVELS])
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    out = merge(c, flags, "left", on=["c_custkey"], fill=0)
    return with_unknown_flag(out, [f"diag_{s}" for s in STATUS_LEVELS], "diag_unknown")


# ----------------------------------------------------------- P27, P28, A11 -

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("dummies", "SELECT c_custkey, c_mktsegment, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS) + " FROM customer")
def dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 0/1 column per segment (levels discovered in one job), source kept."""
    from cohortlens.operators.panel import dummyfy
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return dummyfy(c, ["c_mktsegment"], drop=False)


@query("dummies_reference", "SELECT c_custkey, " + ", ".join(
    f"CASE WHEN c_mktsegment = '{s}' THEN 1 ELSE 0 END AS c_mktsegment_{s}" for s in SEGMENTS[1:]) + " FROM customer")
def dummies_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Treatment coding, first sorted level left out, source dropped."""
    from cohortlens.operators.panel import dummyfy
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return dummyfy(c, ["c_mktsegment"], drop=True, drop_first=True)


@query("dummies_modal", """
WITH m AS (SELECT c_mktsegment AS lvl FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, c_mktsegment, (SELECT lvl FROM m) AS modal_level,
       CASE WHEN c_mktsegment = (SELECT lvl FROM m) THEN 1 ELSE 0 END AS is_modal
FROM customer
""")
def dummies_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P27 ``force_bool`` + A11: a single flag for the modal segment (smallest
    on ties); the generated column is ``c_mktsegment_<mode>``, reported here as
    (modal_level, is_modal)."""
    from cohortlens.operators.panel import dummyfy_modal
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    out = dummyfy_modal(c, ["c_mktsegment"])
    name = out.columns[-1]
    return out.select("c_custkey", "c_mktsegment", F.lit(name[len("c_mktsegment_"):]).alias("modal_level"),
                      F.col(name).alias("is_modal"))
