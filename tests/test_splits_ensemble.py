"""Splits, votes, grid search and pseudo-labels: properties and hand cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.operators import ensemble as EN
from tallyspark.operators import pseudolabel as PS
from tallyspark.operators import splits as SP


def _labels(spark, n=257):
    return spark.createDataFrame([(i, "abcd"[(i * 7) % 4] if i % 5 else "a") for i in range(n)], "index long, label string")


def test_kfold_properties(spark):
    df = _labels(spark)
    f = SP.stratified_kfold(df, 5, 42, classes=["a", "b", "c", "d"]).toPandas()
    assert len(f) == 257 and f["index"].is_unique
    per = f.groupby(["label", "fold"]).size().unstack(fill_value=0)
    assert ((per.max(axis=1) - per.min(axis=1)) <= 1).all()
    tot = f.groupby("fold").size()
    assert tot.max() - tot.min() <= 1


def test_sample_exact_and_split(spark):
    df = _labels(spark)
    assert SP.sample_exact(df, 0.5, 42).count() == round(0.5 * 257)
    sp = SP.stratified_split(df, 0.2, 42).toPandas()
    for lab, g in sp.groupby("label"):
        assert (g["split"] == "test").sum() == round(0.2 * len(g))


def _long(spark):
    rows = []
    preds = {1: ["a", "b", "b"], 2: ["c", "c", "a"], 3: ["b", "a", "b"], 4: ["a", "a", "a"]}
    for i, ps in preds.items():
        for m, p in enumerate(ps):
            rows.append(Row(model=m, index=i, label="a", predicted_label=p))
    return spark.createDataFrame(rows)


def test_single_nonzero_weight_equals_model(spark):
    wide = EN.align(_long(spark), [0, 1, 2], carry=["label"])
    out = {r["index"]: r.predicted_label for r in EN.weighted_vote(wide, [0.0, 1.0, 0.0], ["a", "b", "c"]).collect()}
    assert out == {1: "b", 2: "c", 3: "a", 4: "a"}


def test_ties_go_to_lowest_class(spark):
    wide = EN.align(_long(spark), [0, 1, 2])
    out = {r["index"]: r.predicted_label for r in EN.weighted_vote(wide, [1.0, 1.0, 1.0], ["a", "b", "c"]).collect()}
    assert out[2] == "c" and out[1] == "b" and out[3] == "b"
    w2 = {r["index"]: r.predicted_label for r in EN.weighted_vote(wide, [1.0, 1.0, 0.0], ["a", "b", "c"]).collect()}
    assert w2[1] == "a"  # a and b tie at 1.0 -> first class


def test_strict_vote_raises_on_unknown(spark):
    df = _long(spark).withColumn("predicted_label", F.when(F.col("index") == 4, "zzz").otherwise(F.col("predicted_label")))
    wide = EN.align(df, [0, 1, 2])
    with pytest.raises(Exception):
        EN.weighted_vote(wide, [1.0, 1.0, 1.0], ["a", "b", "c"]).collect()
    lenient = {r["index"]: r.skipped_votes for r in EN.weighted_vote(wide, [1.0, 1.0, 1.0], ["a", "b", "c"], strict=False).collect()}
    assert lenient[4] == 3


def test_grid_and_best_weight(spark):
    wide = EN.align(_long(spark), [0, 1, 2], carry=["label"]).withColumn("fold", F.lit(0))
    grid = EN.grid_search(wide, [1.0, 1.0], 5, 1.0, ["a", "b", "c"], "label", ["fold"])
    assert grid.count() == 5
    best = EN.best_weight(grid).first()
    assert best.best_f1 == max(r.weighted_f1 for r in grid.collect())


def test_unanimous(spark):
    rows = [Row(model=m, index=i, post=f"p{i}", predicted_label=l) for i, ls in enumerate(
        [["a", "a", "a"], ["a", "b", "a"], ["c", "c", None]]) for m, l in enumerate(ls)]
    df = spark.createDataFrame(rows)
    got = [r["index"] for r in PS.unanimous(df, 3, "post").collect()]
    assert got == [0]


def test_write_fold_tables(spark, tmpdir_path):
    import os
    df = SP.stratified_kfold(_labels(spark), 5, 42, classes=["a", "b", "c", "d"])
    path = os.path.join(tmpdir_path, "folds")
    SP.write_fold_tables(df, path, 5)
    back = spark.read.parquet(path)
    assert back.where("fold_id = 2 AND part = 'validation'").count() == df.where("fold = 2").count()
    assert back.where("fold_id = 2 AND part = 'train'").count() == df.where("fold != 2").count()
