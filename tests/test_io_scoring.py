"""Sources/sinks, scoring (failure isolation, resume), streaming, prep, leakage and bootstrap."""

import collections
import os
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyspark.operators import bloom
from tallyspark.operators import bootstrap as B
from tallyspark.operators import contamination as C
from tallyspark.operators import metrics as M
from tallyspark.operators import prep as P
from tallyspark.operators import scoring as S
from tallyspark.sources import readers as RD
from tallyspark.sources import sinks as SK


def test_posts_csv_roundtrip(spark, tmpdir_path):
    rows = [Row(index=1, post='say "hi",\nthen  go ', label="a"), Row(index=2, post="  lead", label="b")]
    df = spark.createDataFrame(rows)
    out = os.path.join(tmpdir_path, "posts")
    SK.write_posts_csv(df, out, ["post"])
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert '1,"say ""hi"", then  go ",a\n' in text
    back = RD._csv(spark, RD.POSTS_LABELED, out).orderBy("index").collect()
    assert back[0].post == 'say "hi", then  go ' and back[1].post == "  lead"


def test_load_posts_unknown_kind(spark):
    with pytest.raises(ValueError):
        RD.load_posts(spark, "train", "/nowhere")


def test_scoring_failure_isolation(spark):
    class Flaky:
        def __call__(self, texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("bad text")
            return np.array([[len(t), 0.0] for t in texts], dtype=float)

    df = spark.createDataFrame([(i, "boom" if i == 3 else "x" * i) for i in range(6)], "index long, post string")
    res = S.score_table(df, lambda: Flaky(), ["a", "b"], batch_size=4).collect()
    print(res)
    out = {r["index"]: r for r in res}
    assert not out[3].success and out[3].predicted_label == "API_ERROR" and out[3].error.startswith("ERROR:")
    assert all(out[i].success for i in (0, 1, 2, 4, 5))
    assert out[5].predicted_label == "a" and out[0].predicted_label == "a"


def test_resume_is_idempotent(spark):
    df = spark.createDataFrame([(i, "t" * i) for i in range(10)], "index long, post string")
    f = S.length_scorer_factory(4)
    first = S.score_table(df.where("index < 4"), f)
    full = S.resume_score(df, first, f)
    again = S.resume_score(df, full, f)
    assert full.count() == 10 and again.count() == 10
    assert sorted(r["index"] for r in again.collect()) == list(range(10))


def test_ffill_concat_hand_sheet(spark):
    rows = [(0, 7, "a", "x"), (1, None, "b", "IGNORED"), (2, 3, "c", "y"), (3, None, "d", None), (4, 7, "e", "z")]
    sheet = spark.createDataFrame(rows, "row_pos long, idx long, title string, label string")
    out = {r["index"]: r for r in P.concat_blocks(P.forward_fill_blocks(sheet, chunk_rows=2), chunk_rows=2).collect()}
    assert out[7].post == "a b e" and out[7].label == "z"
    assert out[3].post == "c d" and out[3].label == "y"


def test_ensure_index_and_shift(spark):
    df = spark.range(0, 50, numPartitions=4).select((F.col("id") * 3).alias("v"))
    idx = P.ensure_index(df).orderBy("v").collect()
    assert [r["index"] for r in idx] == list(range(50))
    sh = P.shift_index_if_below(spark.createDataFrame([(1,), (600,)], "index long"))
    assert sorted(r["index"] for r in sh.collect()) == [501, 1100]
    assert sorted(r["index"] for r in P.shift_index_if_below(sh).collect()) == [501, 1100]


def test_ngram_overlap_bruteforce(spark):
    docs = ["one two three four five six seven eight", "alpha beta", "x one two three four five six seven",
            "Ünïcode wörds ärë here too and more words", "a b c d e f g h"]
    ref = ["zero one two three four five six seven", "wörds ärë here too and more words now"]
    tok = lambda s: re.findall(r"[^\W_]{2,}|_{2,}|\w{2,}", s.lower())

    def grams(s, n=7):
        t = tok(s)
        return {" ".join(t[i:i + n]) for i in range(len(t) - n + 1)}

    rg = set().union(*[grams(r) for r in ref])
    exp = {i: bool(grams(d) & rg) for i, d in enumerate(docs)}
    ddf = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "index long, post string")
    rdf = spark.createDataFrame([(r,) for r in ref], "text string")
    got = {r["index"]: r.duplicate for r in C.flag_overlap(ddf, rdf, 7).collect()}
    assert got == exp


def test_bootstrap_properties(spark):
    th = B.poisson1_thresholds()
    assert th[-1] == pytest.approx(1.0) and th[0] == pytest.approx(np.exp(-1))
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", "a" if i % 4 else "b") for i in range(300)],
                               "index long, label string, predicted_label string")
    w = B.poisson_weights(df, 20, 42).agg(F.avg("weight").alias("m")).first().m
    assert 0.9 < w < 1.1
    b = B.metrics(df, 400, 7, replicates_per_task=100).first()
    from tallyspark.operators import metrics as M
    point = M.summary(df, ["a", "b"], label_set="union").first()
    assert b.replicates == 400
    assert b.accuracy_mean == pytest.approx(point.accuracy, abs=0.01)
    assert b.f1_weighted_mean == pytest.approx(point.f1_weighted, abs=0.02)


def test_report_roundtrip(spark, tmpdir_path):
    from tallyspark.operators import metrics as M
    df = spark.createDataFrame([(m, "a", "a" if (i + m) % 3 else "b") for m in (0, 1) for i in range(30)],
                               "model int, label string, predicted_label string")
    summ = M.run_summary(df, ["a", "b"], group_cols=["model"])
    rep = SK.render_report(summ, M.per_class(df, ["a", "b"], group_cols=["model"]),
                           M.confusion(df, ["a", "b"], group_cols=["model"]), "model", list(RD.SUMMARY_FIELDS))
    path = os.path.join(tmpdir_path, "reports")
    SK.write_metrics_report(rep, "model", path)
    back = {r.model: r for r in RD.read_metrics_reports(spark, path).collect()}
    for r in summ.collect():
        assert back[r.model].f1_weighted == pytest.approx(r.f1_weighted, abs=1e-15)
        assert back[r.model].total_posts == r.total_posts


def test_resume_score_to_sink(spark, tmpdir_path):
    calls = []

    class Counting:
        def __call__(self, texts):
            calls.append(len(texts))
            return np.array([[len(t) % 3, 1.0] for t in texts], dtype=float)

    df = spark.createDataFrame([(i, "y" * i) for i in range(12)], "index long, post string")
    sink = os.path.join(tmpdir_path, "sink")
    S.resume_score_to(df.where("index < 5"), sink, lambda: Counting(), ["a", "b"])
    out = S.resume_score_to(df, sink, lambda: Counting(), ["a", "b"])
    assert sorted(r["index"] for r in out.collect()) == list(range(12))
    again = S.resume_score_to(df, sink, lambda: Counting(), ["a", "b"])
    assert again.count() == 12
    assert spark.read.parquet(sink).count() == 12  # nothing re-appended


def test_write_text_and_run_ts(spark, tmpdir_path):
    from tallyspark.operators import examples as X
    from tallyspark.operators import metrics as M
    df = spark.createDataFrame([(1, "p", "a", "b")], "index long, post string, label string, predicted_label string")
    path = os.path.join(tmpdir_path, "ex")
    SK.write_text(X.render(df), "text", path)
    txt = spark.read.text(path, wholetext=True).first().value
    assert "True label: a" in txt and "Predicted label: b" in txt
    s = M.run_summary(df, ["a", "b"], run_ts="2025-01-02 03:04:05").first()
    assert s.timestamp == "2025-01-02 03:04:05"


def test_encode_strict_and_lenient(spark):
    from tallyspark.functions import labels as L
    df = spark.createDataFrame([("a",), ("zz",), (None,)], "l string")
    got = [r.c for r in df.select(L.encode("l", ["a", "b"], strict=False).alias("c")).collect()]
    assert got == [0, -1, -1]
    with pytest.raises(Exception):
        df.select(L.encode("l", ["a", "b"], strict=True)).collect()
    assert [r.d for r in spark.createDataFrame([(1,), (5,)], "i int").select(
        L.decode("i", ["a", "b"]).alias("d")).collect()] == ["b", None]


def _grams_of(text, n):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_ngram_overlap_equals_pairs(spark):
    docs = [f"w{i} w{i+1} w{i+2} w{i+3} w{i+4} w{i+5} w{i+6} w{i+7}" for i in range(0, 60, 3)] + ["short text", None, "", "w9 " * 30]
    ref = [f"w{i} w{i+1} w{i+2} w{i+3} w{i+4} w{i+5} w{i+6}" for i in (9, 30, 100)] + ["w9 " * 9, None, "too short"]
    ddf = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(3, docs[0])], "index long, post string")
    rdf = spark.createDataFrame([(r,) for r in ref], "text string")
    known = set().union(*(_grams_of(r, 7) for r in ref))
    want = {i: bool(_grams_of(d, 7) & known) for i, d in enumerate(docs)}
    rows = C.flag_overlap(ddf, rdf, 7).collect()
    assert len(rows) == len(docs) and {r["index"]: r.duplicate for r in rows} == want and sum(want.values()) >= 3
    kept = sorted(r["index"] for r in C.drop_overlap(ddf, rdf, 7).collect())
    assert kept == sorted([i for i in want if not want[i]] + ([3] if not want[3] else []))
    none = spark.createDataFrame([], "text string")
    assert not any(r.duplicate for r in C.flag_overlap(ddf, none, 7).collect()) and C.drop_overlap(ddf, none, 7).count() == len(docs) + 1
    assert C.flag_overlap(ddf.limit(0), rdf, 7).collect() == []


def test_leakage_is_one_plan_that_shuffles_hits_only(spark):
    docs = spark.createDataFrame([(1, "a b")], "index long, post string")
    plan = C.overlapping_ids(docs, docs.withColumnRenamed("post", "text"), 3)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastHashJoin [_block" in plan and "ShuffledHashJoin [gram" in plan and "Cartesian" not in plan
    assert plan.index("ShuffledHashJoin [gram") < plan.index("BroadcastHashJoin [_block")  # the filter lies below the shuffle


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("k"))
    known = bloom.build(keys.where("k NOT LIKE '%7'"), F.col("k"))
    size = known.agg(F.sum(F.size("_words")), F.count("*")).first()
    assert size[1] <= bloom.BLOCKS and size[0] == 512 * size[1]
    found = bloom.may_hold(keys, known, "k")
    assert found.columns == ["k"] and found.where("k NOT LIKE '%7'").count() == 18_000
    assert found.where("k LIKE '%7'").count() < 5
    assert bloom.may_hold(keys, bloom.build(keys.limit(0), F.col("k")), "k").count() == 0


def _sample(spark):
    rows = [("m1", "a", "a")] * 50 + [("m1", "a", "b")] * 10 + [("m1", "b", "b")] * 25 + [("m1", "b", "c")] * 9 + [("m1", None, "a")] * 4 + [
        ("m2", "a", "a")] * 3 + [("m2", "b", "a")] * 2 + [(None, "c", "c")] * 5 + [(None, "c", None)] * 5
    return spark.createDataFrame(rows, "model string, label string, predicted_label string")


def test_bootstrap_draws_do_not_depend_on_the_cut(spark):
    cells = M.confusion_cells(_sample(spark), "label", "predicted_label", ["model"])
    runs = [sorted(B.replicate_metrics(cells.repartition(k), 130, 5, ["model"], replicates_per_task=t).collect(), key=repr) for k, t in ((1, 250), (5, 20), (3, 70))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 390
    other = sorted(B.replicate_metrics(cells, 130, 6, ["model"]).collect(), key=repr)
    assert other != runs[0]


def test_bootstrap_label_counts_are_multinomial(spark):
    """Sums, means and deviations of every label's counts against the closed forms; no groups."""
    x = _sample(spark).where("model = 'm1'")
    reps = 2000
    rows = B.replicate_labels(M.confusion_cells(x), reps, 3, cell_blocks=4).collect()
    n, n_null = 98, 4
    by = collections.defaultdict(lambda: np.zeros((reps, 3)))
    for r in rows:
        assert r.n == n
        by[r.label][r.replicate] = (r.tp, r.support, r.pred_n)
    assert abs(np.mean(sum(by.values())[:, 1]) - (n - n_null)) < 0.4 and (sum(by.values())[:, 2] == n).all()
    exact = {"a": (50, 60, 54), "b": (25, 34, 35), "c": (0, 0, 9)}
    for label, counts in exact.items():
        for k, c in enumerate(counts):
            p = c / n
            got = by[label][:, k]
            dev = (n * p * (1 - p)) ** 0.5
            assert abs(got.mean() - n * p) <= 5 * dev / reps ** 0.5
            assert abs(got.std() - dev) <= 5 * dev / (2 * reps) ** 0.5


def test_bootstrap_metrics_equal_plain_ones_per_replicate(spark):
    x = _sample(spark).where("model = 'm1' and label is not null")
    cells = M.confusion_cells(x)
    counts = collections.defaultdict(dict)
    for r in B.replicate_labels(cells, 40, 9).collect():
        counts[r.replicate][r.label] = (r.tp, r.support, r.pred_n)
    for label_set in ("true", "union", "fixed"):
        for r in B.replicate_metrics(cells, 40, 9, label_set=label_set, classes=["a", "b", "z"]).collect():
            c = counts[r.replicate]
            f1 = {k: 2 * t / (s + p) for k, (t, s, p) in c.items()}
            inside = [k for k in c if label_set == "union" or label_set == "true" and c[k][1] or label_set == "fixed" and k in "abz"]
            weight = [k for k in c if label_set != "fixed" or k in "abz"]
            assert r.accuracy == pytest.approx(sum(t for t, _, _ in c.values()) / 94)
            assert r.f1_weighted == pytest.approx(sum(f1[k] * c[k][1] for k in weight) / sum(c[k][1] for k in weight))
            assert r.f1_macro == pytest.approx(sum(f1[k] for k in inside) / (3 if label_set == "fixed" else len(inside)))
