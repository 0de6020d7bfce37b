import math

from pyspark.sql import functions as F

from cohortlens.functions import columns as C


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_round_nearest_and_round_down(spark):
    df = spark.createDataFrame([(7.0,), (-7.0,), (2.25,), (None,)], "x double")
    out = df.select(C.round_nearest("x", 0.5, "down").alias("d"), C.round_nearest("x", 0.5, "up").alias("u"),
                    C.round_down("x", 3).alias("r"), C.round_down("x", -3).alias("rn")).collect()
    assert [r.d for r in out] == [7.0, -7.0, 2.0, None]
    assert [r.u for r in out] == [7.0, -7.0, 2.5, None]
    # Python: num - num % divisor
    assert [r.r for r in out[:3]] == [7.0 - 7.0 % 3, -7.0 - (-7.0) % 3, 2.25 - 2.25 % 3]
    assert [r.rn for r in out[:3]] == [7.0 - 7.0 % -3, -7.0 - (-7.0) % -3, 2.25 - 2.25 % -3]


def test_num_to_bucket(spark):
    out = one(spark, [(0.7,), (1.0,), (0.0,)], "x double", C.num_to_bucket("x", 0.5))
    assert out == ["[0.5, 1.0]", "[0.5, 1.0]", "[-0.5, 0.0]"]
    arr = one(spark, [(0.7,)], "x double", C.num_to_bucket("x", 0.5, as_text=False))
    assert arr == [[0.5, 1.0]]


def test_cut_edges_and_text(spark):
    rows = [(18.5,), (18.6,), (30.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)]
    out = one(spark, rows, "x double", C.bmi_category("x"))
    assert out == ["underweight", "normal", "preobese", "obese", "not known", "not known", "not known"]
    txt = one(spark, [("25",), ("abc",), ("",)], "x string", C.bmi_category("x"))
    assert txt == ["normal", "not known", "not known"]


def test_blood_pressure_zero_diastolic(spark):
    rows = [(120.0, 80.0), (123.0, 80.0), (150.0, 90.0), (120.0, 0.0), (0.0, 0.0), (None, 80.0), (-5.0, 0.0)]
    out = one(spark, rows, "s double, d double", C.blood_pressure("s", "d"))
    assert out == ["normal", "prehypertension", "hypertension", "hypertension", "not known", "not known",
                   "not known"]


def test_diabetes(spark):
    assert one(spark, [(5.5,), (6.0,), (7.1,)], "x double", C.diabetes("x")) == ["normal", "prediabetic", "diabetic"]


def test_boolify_both_polarities(spark):
    rows = [("No",), ("yes",), (None,), ("N/A",), ("null",), ("maybe",)]
    assert one(spark, rows, "x string", C.boolify_text("x")) == [0, 1, 0, 0, 0, 1]
    assert one(spark, rows, "x string", C.boolify_text("x", legacy_polarity=True)) == [1, 0, 1, 1, 1, 0]
    assert one(spark, [(2.0,), (0.0,), (-1.0,), (None,)], "x double", C.boolify_numeric("x")) == [1, 0, 0, 0]


def test_text_flag(spark):
    rows = [("no",), (None,), ("#N/A",), ("0",), ("yes",), ("1",)]
    assert one(spark, rows, "x string", C.text_flag("x")) == [0, 0, 0, 0, 1, 1]


def test_score_flags(spark):
    rows = [(None,), (0.5,), (-2.0,), (3.0,), (1.5,)]
    assert one(spark, rows, "x double", C.capped_flag("x")) == [0.0, 0.5, -2.0, 1.0, 1.0]
    assert one(spark, rows, "x double", C.positive_flag("x")) == [0, 1, 0, 1, 1]
    assert one(spark, rows, "x double", C.absent_flag("x")) == [1, 1, 1, 0, 0]
    assert one(spark, rows, "x double", C.threshold_flag("x", 1)) == [0, 0, 0, 1, 1]


def test_capped_and_row_sums(spark):
    df = spark.createDataFrame([(2.0, 0.5, None), (None, None, None)], "a double, b double, c double")
    out = df.select(C.capped_sum(["a", "b", "c"]).alias("cs"), C.capped_sum(["a", "b"], fill_null=False).alias("cn"),
                    C.row_sum(["a", "b", "c"]).alias("rs"), C.cap("c").alias("cp")).collect()
    assert out[0].cs == 1.5 and out[0].cn == 1.5 and out[0].rs == 2.5 and out[0].cp is None
    assert out[1].cs == 0.0 and out[1].cn is None and out[1].rs == 0.0


def test_age_floor_and_unknown_birth(spark):
    import datetime as dt
    df = spark.createDataFrame([(2010, dt.date(2005, 1, 1)), (2010, dt.date(1950, 6, 1)), (2010, None), (None, None)],
                               "y int, dob date")
    out = [r[0] for r in df.select(C.age_at("y", "dob")).collect()]
    assert out == [10.0, 60.0, 110.0, None]


def test_p_value_sig(spark):
    rows = [(0.0005,), (0.001,), (0.005,), (0.05,), (0.051,), (float("nan"),), (None,)]
    assert one(spark, rows, "p double", C.p_value_sig("p")) == ["***", "***", "**", "*", "", "", ""]


def test_decade_centred_exp(spark):
    df = spark.createDataFrame([(57.0, 50.0)], "a double, b double")
    r = df.select(C.decade("a"), C.centred_time("a", "b"), C.log_inverse(F.lit(0.0))).first()
    assert r[0] == 50.0 and r[1] == 8.0 and math.isclose(r[2], 1.0)


def test_flags_of_columns_by_name(spark):
    df = spark.createDataFrame([(2.0, None, 0.5, 3.0)], "a_Score_ID double, `b.Score_ID` double, c_Score_ID_bool double, other double")
    made = C.by_name(df.columns, "Score_ID", ["bool"], "_absent", C.absent_flag)
    assert list(made) == ["a_Score_ID_absent", "b.Score_ID_absent"] and C.by_name(df.columns, "none", [], "", C.absent_flag) == {}
    assert list(df.withColumns(made).collect()[0])[4:] == [0, 1]
