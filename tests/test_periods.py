import datetime as dt

from cohortlens.operators.periods import days_by_period, half_years


def run(spark, rows):
    df = spark.createDataFrame(rows, "ix int, s timestamp, e timestamp")
    return sorted((r.ix, r.dates, r.days) for r in half_years(df, "s", "e", "ix").collect())


def test_same_half(spark):
    out = run(spark, [(1, dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 1))])
    assert out == [(1, 2020.0, 29.0)]


def test_spanning_stay(spark):
    out = run(spark, [(1, dt.datetime(2019, 5, 1), dt.datetime(2020, 8, 10))])
    # first half: Jun 30 2019 - May 1 2019 = 60 days; middle halves 182.5; last: Aug 10 - Jun 30 2020 = 41
    assert out == [(1, 2019.0, 60.0), (1, 2019.5, 182.5), (1, 2020.0, 182.5), (1, 2020.5, 41.0)]


def test_second_half_start_and_time_of_day(spark):
    out = run(spark, [(2, dt.datetime(2019, 12, 30, 18, 0), dt.datetime(2020, 1, 2, 6, 0))])
    # (Dec 31 00:00 - Dec 30 18:00).days = 0; (Jan 2 06:00 - Dec 31 00:00).days = 2
    assert out == [(2, 2019.5, 0.0), (2, 2020.0, 2.0)]


def test_reversed_dropped_and_same_half_negative(spark):
    out = run(spark, [(3, dt.datetime(2020, 8, 1), dt.datetime(2020, 1, 1)),
                      (4, dt.datetime(2020, 3, 10), dt.datetime(2020, 3, 1))])
    assert out == [(4, 2020.0, -9.0)]


def test_open_stay_as_of(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), None)], "ix int, s timestamp, e timestamp")
    out = half_years(df, "s", "e", "ix", as_of=F.lit(dt.datetime(2020, 2, 1))).collect()
    assert [(r.dates, r.days) for r in out] == [(2020.0, 31.0)]
    assert half_years(df, "s", "e", "ix").count() == 0


def test_days_by_period(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 11)),
                                (1, dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 6))], "ix int, s timestamp, e timestamp")
    out = days_by_period(half_years(df, "s", "e", "ix"), "ix").collect()
    assert [(r.ix, r.dates, r.days) for r in out] == [(1, 2020.0, 15.0)]
