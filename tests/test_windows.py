"""Skew-proof window helpers against single-window brute force (tiny chunks force carries)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.operators.windows import exact_row_number, forward_fill, running_max


def _data(spark, n=400, seed=3):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(3), i, rnd.choice([None, None, None, rnd.randrange(100)])) for i in range(n)]
    return spark.createDataFrame(rows, "p int, o long, v int")


def test_forward_fill_matches_window(spark):
    df = _data(spark)
    got = forward_fill(df, ["p"], "o", F.col("v"), "ff", F.floor(F.col("o") / 7))
    w = Window.partitionBy("p").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("ff", F.last("v", ignorenulls=True).over(w))
    assert sorted(got.select("p", "o", "ff").collect()) == sorted(exp.select("p", "o", "ff").collect())


def test_exact_row_number_matches_window(spark):
    df = _data(spark).withColumn("k", F.md5(F.col("o").cast("string")))
    got = exact_row_number(df, ["p"], [F.col("k"), F.col("o")], F.conv(F.substring("k", 1, 1), 16, 10).cast("int"), "rn")
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("k", "o")))
    assert sorted(got.select("p", "o", "rn").collect()) == sorted(exp.select("p", "o", F.col("rn").cast("long")).collect())


def test_running_max_exclusive(spark):
    df = _data(spark).fillna(0, ["v"])
    got = running_max(df, ["p"], "o", "v", "rm", F.floor(F.col("o") / 11), inclusive=False).toPandas()
    pdf = df.toPandas().sort_values(["p", "o"])
    pdf["rm"] = pdf.groupby("p")["v"].transform(lambda s: s.cummax().shift(1))
    m = got.merge(pdf, on=["p", "o"], suffixes=("", "_e"))
    assert ((m["rm"].isna() & m["rm_e"].isna()) | (m["rm"] == m["rm_e"])).all()
    assert len(m) == len(pdf)


def test_null_keys_keep_their_carries(spark):
    rows = [(None if i % 3 == 0 else i % 3, i, None if i % 5 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "p int, o long, v int")
    w = Window.partitionBy("p").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("ff", F.last("v", ignorenulls=True).over(w)).withColumn("rn", F.row_number().over(Window.partitionBy("p").orderBy("o")).cast("long"))
    got = forward_fill(df, ["p"], "o", F.col("v"), "ff", F.floor(F.col("o") / 7))
    got = exact_row_number(got, ["p"], [F.col("o")], F.floor(F.col("o") / 9), "rn")
    assert sorted(got.select("p", "o", "ff", "rn").collect(), key=key1) == sorted(exp.select("p", "o", "ff", "rn").collect(), key=key1)


def key1(r):
    return r["o"]
