"""Metric operators: golden confusion matrix, label sets, sentinels, zero-valid runs."""

import pytest
from pyspark.sql import Row

from tallyspark.functions.labels import DEFAULT_CLASSES as CL
from tallyspark.operators import metrics as M

# A published confusion matrix and the metrics it implies.
GOLDEN = [[79, 33, 7, 10], [12, 170, 14, 4], [3, 32, 88, 9], [0, 1, 1, 37]]


def _rows_from_matrix(spark, matrix, classes=CL):
    rows = []
    for i, r in enumerate(matrix):
        for j, n in enumerate(r):
            rows += [Row(label=classes[i], predicted_label=classes[j])] * n
    return spark.createDataFrame(rows)


def test_golden_matrix(spark):
    df = _rows_from_matrix(spark, GOLDEN)
    s = M.summary(df, CL).collect()[0]
    assert s.n == 500
    assert s.accuracy == pytest.approx(0.748, abs=1e-12)
    assert s.f1_macro == pytest.approx(0.740771041970285, abs=1e-12)
    assert s.f1_weighted == pytest.approx(0.7450278420856443, abs=1e-12)
    assert s.precision_weighted == pytest.approx(0.7642653804543815, abs=1e-12)
    assert s.recall_weighted == pytest.approx(0.748, abs=1e-12)


def test_confusion_dense(spark):
    df = _rows_from_matrix(spark, GOLDEN)
    conf = {(r.true_label, r.predicted_label): r.n for r in M.confusion(df, CL).collect()}
    assert len(conf) == 16
    for i, t in enumerate(CL):
        for j, p in enumerate(CL):
            assert conf[(t, p)] == GOLDEN[i][j]


def test_per_class_absent_class_and_outside_labels(spark):
    rows = [Row(label="a", predicted_label="a"), Row(label="a", predicted_label="b"),
            Row(label="b", predicted_label="x"), Row(label="b", predicted_label="b")]
    df = spark.createDataFrame(rows)
    per = {r.label: r for r in M.per_class(df, ["a", "b", "c"]).collect()}
    assert per["c"].support == 0 and per["c"].f1 == 0.0
    assert per["a"].precision == 1.0 and per["a"].recall == 0.5
    # pred 'x' is outside the list but still counts in support of 'b'
    assert per["b"].support == 2 and per["b"].recall == 0.5 and per["b"].precision == 0.5


def test_label_sets(spark):
    rows = [Row(label="a", predicted_label="a"), Row(label="a", predicted_label="z"),
            Row(label="b", predicted_label="b"), Row(label="b", predicted_label="a")]
    df = spark.createDataFrame(rows)
    cells = M.confusion_cells(df)
    gm = M.group_metrics(M.label_stats(cells), ["a", "b", "c"], [],
                         {"_f": "fixed", "_t": "true", "_u": "union"}).collect()[0]
    f1_a, f1_b, f1_z = 2 * 1 / (2 + 2), 2 * 1 / (2 + 1), 0.0
    assert gm.f1_macro_f == pytest.approx((f1_a + f1_b + 0.0) / 3)
    assert gm.f1_macro_t == pytest.approx((f1_a + f1_b) / 2)
    assert gm.f1_macro_u == pytest.approx((f1_a + f1_b + f1_z) / 3)
    assert gm.f1_weighted_u == pytest.approx((f1_a * 2 + f1_b * 2) / 4)


def test_run_summary_counters_and_zero_valid(spark):
    rows = [Row(m=0, label="a", predicted_label="LABEL_NOT_FOUND"), Row(m=0, label="a", predicted_label="API_ERROR"),
            Row(m=1, label="a", predicted_label="a"), Row(m=1, label="b", predicted_label="CONTENT_BLOCKED")]
    df = spark.createDataFrame(rows)
    out = {r.m: r for r in M.run_summary(df, ["a", "b"], group_cols=["m"]).collect()}
    z = out[0]
    assert (z.total_posts, z.api_errors_count, z.labels_not_found_in_response, z.valid_predictions_for_metrics) == (2, 1, 1, 0)
    assert z.api_calls_succeeded == 1
    assert z.accuracy == 0.0 and z.f1_weighted == 0.0 and z.f1_macro == 0.0
    o = out[1]
    assert o.content_blocked_count == 1 and o.valid_predictions_for_metrics == 1 and o.accuracy == 1.0


def test_classification_report_rows(spark):
    df = _rows_from_matrix(spark, GOLDEN)
    rep = {r.row_label: r for r in M.classification_report(df, CL).collect()}
    assert set(rep) == set(CL) | {"accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"].f1_score == pytest.approx(0.748)
    assert rep["accuracy"].support == 500
    assert rep["weighted avg"].f1_score == pytest.approx(0.7450278420856443, abs=1e-12)


def test_class_distribution(spark):
    df = spark.createDataFrame([Row(label="a"), Row(label="a"), Row(label="b"), Row(label=None)])
    d = {r.label: r for r in M.class_distribution(df).collect()}
    assert d["a"].n == 2 and d["a"].proportion == pytest.approx(2 / 3)
    assert None not in d


def test_soft_metrics(spark):
    import math
    df = spark.createDataFrame([Row(p=[0.7, 0.3], y=0), Row(p=[0.2, 0.8], y=1)])
    ll = M.log_loss(df, "p", "y").collect()[0].log_loss
    assert ll == pytest.approx((-math.log(0.7) - math.log(0.8)) / 2)
    sf = M.soft_f1_cost(df, "p", "y", 2).collect()[0].soft_f1_cost
    tp0, fp0, fn0 = 0.7, 0.2, 0.3
    tp1, fp1, fn1 = 0.8, 0.3, 0.2
    exp = 1 - ((2 * tp0) / (2 * tp0 + fp0 + fn0 + 1e-7) + (2 * tp1) / (2 * tp1 + fp1 + fn1 + 1e-7)) / 2
    assert sf == pytest.approx(exp)
    ob = spark.createDataFrame([Row(z=[0.0, 2.0], t=[1.0, 0.0])])
    v = M.ordinal_bce(ob, "z", "t").collect()[0].ordinal_bce
    bce = lambda z, y: max(z, 0) - z * y + math.log1p(math.exp(-abs(z)))
    assert v == pytest.approx((bce(0.0, 1.0) + bce(2.0, 0.0)) / 2)


def test_report_and_matrix_text(spark):
    from tallyspark.sources import sinks as SK
    df = _rows_from_matrix(spark, GOLDEN).withColumn("m", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(0))
    mt = SK.matrix_text(M.confusion(df, CL, group_cols=["m"]), "m", CL).first().matrix_text
    assert mt == "[[ 79,  33,   7,  10],\n [ 12, 170,  14,   4],\n [  3,  32,  88,   9],\n [  0,   1,   1,  37]]"
    rt = SK.report_text(M.classification_report(df, CL, group_cols=["m"]), "m", 2).first().report_text
    assert "weighted avg      0.76      0.75      0.75       500" in rt
    assert "   indicator      0.84      0.61      0.71       129" in rt


def test_evaluation_rows(spark):
    """Order and numbers of the printed bundle; nulls count in the size only; no rows give the size alone."""
    from tallyspark.operators.metrics import evaluate_rows
    schema = "label string, predicted_label string"
    rows = [("b", "b")] * 3 + [("b", "a")] + [("a", "a")] * 2 + [("a", "zz"), (None, "a"), ("a", None)]
    got = evaluate_rows(spark.createDataFrame(rows, schema)).orderBy("place").collect()
    assert [(r.section, r["name"]) for r in got] == [("size", "rows"), ("class", "a"), ("class", "b"), ("metric", "accuracy"), ("metric", "weighted_f1"),
                                                  ("metric", "macro_f1"), ("report", "a"), ("report", "b"), ("report", "zz"), ("report", "macro avg"), ("report", "weighted avg")]
    by = {(r.section, r["name"]): r for r in got}
    assert by["size", "rows"].n == 9 and by["class", "a"].n == 4 and by["class", "a"].value == 0.5
    a, b = 2 * 2 / (4 + 4), 2 * 3 / (4 + 3)
    assert abs(by["metric", "weighted_f1"].value - (4 * a + 4 * b) / 8) < 1e-12 and abs(by["metric", "macro_f1"].value - (a + b) / 3) < 1e-12
    assert abs(by["metric", "accuracy"].value - 5 / 9) < 1e-12 and by["report", "zz"].value == 0
    assert [tuple(r) for r in evaluate_rows(spark.createDataFrame([], schema)).collect()] == [(0, "size", "rows", None, None, None, 0)]
