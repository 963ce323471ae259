"""Faults that were found by review: each has its case here."""

from pyspark.sql import functions as F

from tallyspark.operators.metrics import run_summary
from tallyspark.operators.prep import ensure_index
from tallyspark.sources.readers import load_posts


def test_ensure_index_after_an_aggregation(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(50_000).groupBy((F.col("id") * 7 % 49_999).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        got = [r["index"] for r in ensure_index(df).select("index").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sorted(got) == list(range(49_999))


def test_run_summary_of_no_rows_counts_zero(spark):
    row = run_summary(spark.createDataFrame([], "label string, predicted_label string")).collect()[0].asDict()
    assert all(v == 0 for v in row.values())


def test_csv_is_read_by_header_name(spark, tmpdir_path):
    with open(f"{tmpdir_path}/posts_with_labels.csv", "w") as f:
        f.write("label,extra,post,index\nindicator,x,\"a post, long\",7\n")
    row = load_posts(spark, "validation", tmpdir_path).collect()[0]
    assert (row["index"], row["post"], row["label"]) == (7, "a post, long", "indicator")
