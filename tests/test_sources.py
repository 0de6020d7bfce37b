import os
import tempfile

from pyspark.sql import functions as F

from cohortlens.sources import tables as S


def test_csv_header_on_second_line(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    p = os.path.join(d, "r.csv")
    with open(p, "w") as f:
        f.write("some title line\nreview,sentiment\ngreat film,1\nbad film,0\n")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    schema = StructType([StructField("review", StringType()), StructField("sentiment", IntegerType())])
    df = S.read_csv(spark, p, schema=schema, header_line=1)
    assert sorted((r.review, r.sentiment) for r in df.collect()) == [("bad film", 0), ("great film", 1)]
    plain = os.path.join(d, "p.csv")
    with open(plain, "w") as f:
        f.write("a,b\n1,x\n")
    assert S.read_csv(spark, plain).first().a == 1


def test_select_roles(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert S.select_roles(df, ["b", "a", "b"]).columns == ["b", "a"]
    assert S.select_roles(df, ["a", "zz"]).columns == ["a", "b", "c"]


def test_token_and_stats_sinks(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    S.write_token_lines(df, "t", os.path.join(d, "tok"))
    lines = sorted(r.value for r in spark.read.text(os.path.join(d, "tok")).collect())
    assert lines == ["", "a\tb"]
    st = spark.createDataFrame([("0", 0.5)], "class string, f1 double")
    S.write_stats_csv(st, os.path.join(d, "st"))
    back = spark.read.option("header", True).csv(os.path.join(d, "st")).first()
    assert back["class"] == "0" and back["f1"] == "0.5"


def test_row_slice(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = sorted(r.k for r in S.row_slice(df, "k", 10, 20).collect())
    assert out == list(range(10, 20))


def test_read_table_spreads_text(spark):
    df = S.read_table(spark, "/root/testdata/sf0.001", "documents")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert S.read_table(spark, "/root/testdata/sf0.001", "region").count() == 5


def test_model_save_load(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from cohortlens.operators import classify as C
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(20)], "x double, label double")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression(maxIter=5)])
    m = pipe.fit(df)
    d = tempfile.mkdtemp(prefix="model-")
    C.save_model(m, os.path.join(d, "m"))
    back = C.load_model(os.path.join(d, "m"))
    assert C.run_saved(back, df, ["x"]).count() == 20


def test_not_equal_keep_null_and_stack(spark):
    from cohortlens.operators.joins import not_equal_keep_null, stack
    df = spark.createDataFrame([("a",), ("unknown",), (None,)], "v string")
    assert [r.v for r in df.filter(not_equal_keep_null("v", "unknown")).collect()] == ["a", None]
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "k")], "x int, y string")
    assert sorted((r.x, r.y) for r in stack([a, b]).collect()) == [(1, None), (2, "k")]


def test_load_and_clean_and_dispatch(spark):
    from cohortlens.operators import text as T
    df = spark.createDataFrame([(1, "  one two three four ", 0, "b"), (2, "x y", 2, "a")],
                               "id int, t string, pos int, lab string")
    out = {r.id: r for r in T.load_and_clean(df, "t", "lab", strip=True, max_len=2, clean_labels=True).collect()}
    assert out[1].t == ["one", "two"] and out[1].lab == 1 and out[2].lab == 0
    lem = spark.createDataFrame([("two", "2")], "form string, lemma string")
    d = T.tokenize_df(df, "t", "lem", lemmas=lem, id_col="id")
    assert {r.id: r.tokens for r in d.collect()}[1] == ["one", "2", "three", "four"]
