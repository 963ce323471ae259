"""Attempt log, readers by header and section, sheets, unanimity, source positions, training rounds."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.operators import ensemble as EN
from tallyspark.operators import prep as P
from tallyspark.operators import pseudolabel as PS
from tallyspark.operators import scoring as S
from tallyspark.operators import training as TR
from tallyspark.sources import readers as RD
from tallyspark.sources.attempts import AttemptLog

CL = ["a", "b", "c"]


def _scored(spark, rows):
    return spark.createDataFrame(rows, "index long, predicted_label string, success boolean")


def test_attempt_log_reads_only_its_buckets_and_compacts(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "log")
    log = AttemptLog(spark, path, buckets=16)
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "index int, post string")
    assert log.attempts() is None and log.latest() is None and log.unseen(todo).count() == 50
    log.compact()  # nothing there: nothing done
    log.append(_scored(spark, [(i, "a", i % 3 > 0) for i in range(30)]), "1")  # a name that looks like a number
    log.append(_scored(spark, [(i, "b", True) for i in range(0, 30, 6)]), "2e5")
    assert AttemptLog(spark, path, buckets=999).buckets == 16  # the first batch fixed it
    assert sorted(r["index"] for r in log.unseen(todo).collect()) == list(range(30, 50))
    assert sorted(r["index"] for r in log.unseen(todo, retry_errors=True).collect()) == [3, 9, 15, 21, 27, *range(30, 50)]
    assert log.unseen(todo, batch="1").count() == 45  # a repeated batch meets the other ones only
    latest = {r["index"]: r for r in log.latest().collect()}
    assert len(latest) == 30 and latest[0].predicted_label == "b" and latest[0].attempts == 2 and not latest[3].success
    one = todo.where("index = 7")
    plan = log.unseen(one)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    for k in range(2):
        log.compact()
        rows = log.latest().collect()
        assert sorted(r["index"] for r in rows) == list(range(30)) and {r["attempts"] for r in rows} == {1}
        assert log._generation().endswith(f"gen={k + 1}")
    log.append(_scored(spark, [(i, "c", True) for i in range(30, 50)]))
    assert log.unseen(todo).count() == 0 and log.latest().count() == 50


def test_a_repeated_batch_replaces_its_rows(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "log")
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(60)], "index long, post string")
    first = S.resume_score_to(df.where("index < 40"), path, S.failing_scorer_factory(3), CL, batch="one").collect()
    again = S.resume_score_to(df.where("index < 40"), path, S.failing_scorer_factory(3), CL, batch="one").collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again)) and {r.attempts for r in first} == {1}
    out = {r["index"]: r for r in S.resume_score_to(df, path, S.failing_scorer_factory(3), CL, batch="two").collect()}
    assert len(out) == 60 and out[49].predicted_label == "API_ERROR" and not out[49].success and "no answer" in out[49].error
    out = {r["index"]: r for r in S.resume_score_to(df, path, S.length_scorer_factory(3), CL, retry_errors=True).collect()}
    assert out[49].success and out[49].attempts == 2 and out[48].attempts == 1


def test_run_logs_of_mixed_layouts(spark, tmpdir_path):
    files = {"m one/r1_log.csv": "epoch,step,eval_loss\n1,10,0.5\n2,20,0.4\n", "m one/r2_log.csv": "step,eval_loss,epoch\n30,0.7,3\n",
             "b/r3_log.csv": '"epoch","note, x",step\n4,"a, ""b""",40\n', "b/r4_log.csv": "", "b/r5_log.csv": "﻿step,epoch\r\n50,5\r\n"}
    for name, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(tmpdir_path, name)), exist_ok=True)
        with open(os.path.join(tmpdir_path, name), "w", newline="") as f:
            f.write(text)
    rows = RD.load_run_logs(spark, os.path.join(tmpdir_path, "*", "*.csv")).collect()
    assert sorted((r.run, r.epoch, r.step, r.eval_loss) for r in rows if r.eval_loss) == [("r1", 1, 10, 0.5), ("r1", 2, 20, 0.4), ("r2", 3, 30, 0.7)]
    assert sorted((r.run, r.epoch, r.step) for r in rows if r.eval_loss is None) == [("r3", 4, 40), ("r5", 5, 50)]
    os.makedirs(os.path.join(tmpdir_path, "none"))
    open(os.path.join(tmpdir_path, "none", "x_y.csv"), "w").close()
    assert RD.load_run_logs(spark, os.path.join(tmpdir_path, "none", "*.csv")).collect() == []


def test_posts_with_another_header_fail_loudly(spark, tmpdir_path):
    folder = os.path.join(tmpdir_path, "test_set.csv")
    os.makedirs(folder)
    for name, text in (("a.csv", "index,post,label\n1,x,l\n"), ("b.csv", "post,index,label\ny,2,l\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    for multi_line in (True, False):
        with pytest.raises(Exception):
            RD.load_posts(spark, "test", tmpdir_path, multi_line=multi_line).collect()
    os.remove(os.path.join(folder, "b.csv"))
    assert [tuple(r) for r in RD.load_posts(spark, "test", tmpdir_path, multi_line=False).collect()] == [(1, "x", "l")]


REPORT = """accuracy,f1_weighted
0.75,0.7

--- Per-Class Metrics ---
,class,precision,recall,f1_score,support
0,a,0.5,1.0,0.66,4
1,b b,1,0,0,2

--- Classification Report ---
              precision    recall  f1-score   support

           a       0.50      1.00      0.66         4
         b b       1.00      0.00      0.00         2

    accuracy                           0.75         6
weighted avg       0.66      0.66      0.44         6

--- Confusion Matrix ---
[[4 0]
 [ 2 10]]
"""


def test_report_sections(spark, tmpdir_path):
    for model, text in (("m1", REPORT), ("m2", REPORT.split("--- Classification")[0]), ("m3", "accuracy\n1\n")):
        os.makedirs(os.path.join(tmpdir_path, f"model={model}"))
        with open(os.path.join(tmpdir_path, f"model={model}", "r.txt"), "w", newline="") as f:
            f.write(text.replace("\n", "\r\n") if model == "m1" else text)
    t = {k: sorted(map(tuple, v.select("model", *[c for c in v.columns if c != "model"]).collect())) for k, v in RD.read_report_sections(spark, tmpdir_path, ["a", "b b"]).items()}
    assert t["per_class"] == [(m, *r) for m in ("m1", "m2") for r in (("a", 0.66, 0.5, 1.0, 4), ("b b", 0.0, 1.0, 0.0, 2))]
    assert sorted(t["report"]) == [("m1", "a", 0.5, 1.0, 0.66, 4), ("m1", "accuracy", None, None, 0.75, 6), ("m1", "b b", 1.0, 0.0, 0.0, 2),
                                   ("m1", "weighted avg", 0.66, 0.66, 0.44, 6)]
    assert t["matrix"] == [("m1", "a", "a", 4), ("m1", "a", "b b", 0), ("m1", "b b", "a", 2), ("m1", "b b", "b b", 10)]
    one = RD.read_report_sections(spark, os.path.join(tmpdir_path, "model=m1", "r.txt"), ["a", "b b"])
    assert one["per_class"].count() == 2 and one["matrix"].count() == 4


def test_sheets_do_not_leak_into_each_other(spark):
    rows = [("s1", 0, None, "stray", "z"), ("s1", 1, 7, "one", "a"), ("s1", 2, None, "two", "ignored"), ("s1", 9, 8, "three", "b"),
            ("s2", 0, None, "lost", "z"), ("s2", 5, None, "lost too", "z"), ("s2", 6, 7, "other seven", "c"), (None, 0, None, "x", "y"), (None, 3, 1, "null sheet", "d")]
    sheet = spark.createDataFrame(rows, "sheet string, row_pos long, idx long, title string, label string")
    for chunk in (1, 2, 1000):
        filled = P.forward_fill_blocks(sheet, chunk_rows=chunk, sheet_col="sheet")
        got = {(r.sheet, r["index"]): (r.post, r.label) for r in P.concat_blocks(filled, chunk_rows=chunk, sheet_col="sheet").collect()}
        assert got == {("s1", 7): ("one two", "a"), ("s1", 8): ("three", "b"), ("s2", 7): ("other seven", "c"), (None, 1): ("null sheet", "d")}
    parts = P.block_parts(P.forward_fill_blocks(sheet, chunk_rows=2, sheet_col="sheet"), chunk_rows=2, sheet_col="sheet")
    assert sorted((r.part, r.text) for r in parts.where("sheet = 's1' and block_id = 7").collect()) == [(0, "one"), (1, "two")]


def test_unanimity_in_one_aggregation(spark):
    rows = [Row(model=m, index=i, predicted_label=x) for i, labels in enumerate(
        [["a", "a", "a"], ["a", "b", "a"], ["c", "c", None], ["b", "b", "-"]]) for m, x in enumerate(labels) if x != "-"]
    rows += [Row(model=9, index=3, predicted_label="b"), Row(model=0, index=0, predicted_label="a")]
    df = spark.createDataFrame(rows)
    for models in ([0, 1, 2], 3):
        got = {r["index"] for r in PS.unanimous(df, models, "index", key_is_digest=True).collect()}
        assert got == ({0} if models != 3 else {0, 3})  # by number alone any three models do
    plan = PS.unanimous(df, [0, 1, 2], "index", key_is_digest=True)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Expand" not in plan


def test_first_of_several_rows_wins(spark, tmpdir_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema = StructType([StructField("index", LongType()), StructField("predicted_label", StringType())])
    for fmt in ("csv", "parquet"):
        for m in ("x", "y"):
            rows = [(i % 20, f"{m}{i // 20}") for i in range(60)]
            one = spark.createDataFrame(rows, schema).coalesce(1)
            folder = os.path.join(tmpdir_path, fmt, m)
            (one.write.option("header", True).csv(folder) if fmt == "csv" else one.write.parquet(folder))
        paths = {m: os.path.join(tmpdir_path, fmt, m) for m in ("x", "y")}
        long = RD.load_predictions(spark, paths, schema, fmt, with_position=True)
        got = EN.align(long.repartition(5), ["x", "y"], order_col="source_pos").collect()
        assert len(got) == 20 and {(r.p0, r.p1) for r in got} == {("x0", "y0")}


def test_rounds_go_on_after_the_last_complete_one(spark, tmpdir_path):
    posts = [(i, "w" * (i % 13), "abc"[i % 13 % 3]) for i in range(80)]
    labeled = spark.createDataFrame(posts[:40], "index long, post string, label string")
    unlabeled = spark.createDataFrame([p[:2] for p in posts[40:]], "index long, post string")
    calls = []

    def counted(k):
        inner = TR.length_majority_trainer(k)

        def train(rows):
            calls.append(k)
            return inner(rows)
        return train
    trainers = {f"m{k}": counted(k) for k in (13, 26, 39)}
    path = os.path.join(tmpdir_path, "rounds")
    one = TR.run_rounds(labeled, unlabeled, trainers, path, 1).collect()
    assert len(one) == 1 and len(calls) == 3 and one[0].n_labeled == 40 and one[0].n_pseudo == 40 and one[0].n_train == 80
    three = TR.run_rounds(labeled, unlabeled, trainers, path, 3).orderBy("round").collect()
    assert [r["round"] for r in three] == [1, 2, 3] and len(calls) == 9
    os.remove(os.path.join(path, "sizes", "round=3", "_SUCCESS"))  # as if the third round hadn't ended
    assert TR.run_rounds(labeled, unlabeled, trainers, path, 3).count() == 3 and len(calls) == 12
    disagree = {"m": TR.length_majority_trainer(13), "n": lambda rows: lambda df: df.select("index", F.lit("zz").alias("predicted_label"))}
    assert TR.run_rounds(labeled, unlabeled, disagree, os.path.join(tmpdir_path, "none"), 1).first().n_pseudo == 0


def test_training_protocol(spark):
    rows = [(i, ("good fine " if i % 2 else "bad awful ") + f"w{i % 7} " * (i % 5), "ab"[i % 2], i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "index long, post string, label string, fold int")
    log = TR.kfold_log(df, (1, 8), 4, "fold", ["a", "b"])
    assert sorted((r.run, r.epoch) for r in log.collect()) == [(f, float(n)) for f in range(4) for n in (1, 8)]
    assert TR.best_iterations(log) in (1, 8)
    oof = TR.kfold_fit_predict(df, 4, "fold", ["a", "b"], "label", 8)
    assert sorted(r["index"] for r in oof.collect()) == list(range(120))
    m = TR.fold_metrics(oof, ["a", "b"]).collect()
    assert len(m) == 4 and all(r.n == 30 and r.f1_weighted > 0.95 for r in m)
    out = TR.fit_eval(df.where("fold > 0"), df.where("fold = 0"), ["a", "b", "never seen"], max_iter=8).collect()
    assert len(out) == 30 and all(len(r.probs) == 3 and abs(sum(r.probs) - 1) < 1e-9 and r.probs[2] == 0 for r in out)


def test_fits_send_no_more_gradients_than_there_are_cores(spark, monkeypatch):
    rows = [(i, "good fine" if i % 2 else "bad awful", "ab"[i % 2], i % 4) for i in range(400)]
    feats = TR.term_frequencies(spark.createDataFrame(rows, "index long, post string, label string, fold int").repartition(64), ["index", "fold", "label"])
    fitted, fit = [], TR.Pipeline.fit

    def spy(self, rows, *a):
        fitted.append(rows.rdd.getNumPartitions())
        return fit(self, rows, *a)
    monkeypatch.setattr(TR.Pipeline, "fit", spy)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        model = TR.fit_features(feats, ["a", "b"], max_iter=3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(fitted) == 1 and fitted[0] <= spark.sparkContext.defaultParallelism
    out = TR.predict_features(model, feats, ["a", "b"], keep=("index", "label")).collect()
    assert len(out) == 400 and all(r.predicted_label == r.label for r in out)
