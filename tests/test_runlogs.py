"""Run-log operators vs brute force on random monotone logs."""

import math
import random

import pandas as pd
import pytest

from tallyspark.operators import runlogs as RL
from tallyspark.operators.windows import sorted_chunks


def _log(spark, n=600, seed=5):
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        run = rnd.randrange(3)
        kind = "eval" if rnd.random() < 0.25 else "train"
        step = pos
        epoch = pos / 37.0
        rows.append((run, pos, kind, epoch, step, rnd.random() if kind == "train" else None,
                     rnd.random() / 100 if kind == "train" else None, rnd.random() if kind == "eval" else None))
    return spark.createDataFrame(rows, "run int, pos long, kind string, epoch double, step long, loss double, "
                                       "learning_rate double, eval_loss double")


def test_asof_matches_bruteforce(spark):
    df = _log(spark)
    got = RL.asof_train_eval(df).toPandas().set_index("pos")
    pdf = df.toPandas()
    tr, ev = pdf[pdf.kind == "train"], pdf[pdf.kind == "eval"]
    for _, e in ev.iterrows():
        c = tr[(tr.run == e.run) & (tr.epoch > e.epoch - 1.0 + 1e-5) & (tr.epoch <= e.epoch + 1e-5) & (tr.step <= e.step)]
        exp = c.sort_values(["step", "pos"], ascending=[False, True]).iloc[0].loss if len(c) else None
        g = got.loc[e.pos, "train_loss"]
        assert (exp is None and pd.isna(g)) or g == pytest.approx(exp)


def test_carry_last_loss(spark):
    df = _log(spark)
    got = RL.carry_last_loss(df, chunk_rows=16).toPandas().set_index("pos")["last_train_loss"]
    pdf = df.toPandas().sort_values("pos")
    pdf["exp"] = pdf.groupby("run")["loss"].transform(lambda s: s.ffill())
    for pos, v in got.items():
        e = pdf.set_index("pos").loc[pos, "exp"]
        assert (pd.isna(e) and pd.isna(v)) or v == pytest.approx(e)


def _metrics(spark):
    rows = []
    rnd = random.Random(9)
    for run in (1, 2, 3):
        for ep in range(1, 41):
            f1 = rnd.random()
            rows.append((run, float(ep), ep * 10, f1, f1 * 0.9, 0.5, 0.5, 0.5, 0.1, 0.001))
    return spark.createDataFrame(rows, "run int, epoch double, step long, eval_f1_weighted double, eval_accuracy double, "
                                       "eval_loss double, eval_precision_weighted double, eval_recall_weighted double, "
                                       "train_loss double, learning_rate double")


def test_early_stop_bruteforce(spark):
    m = _metrics(spark)
    got = {r.run: r for r in RL.early_stop(m, 5).collect()}
    pdf = m.toPandas().sort_values(["run", "epoch"])
    for run, g in pdf.groupby("run"):
        best, best_e, wait, stop = None, None, 0, None
        for _, r in g.iterrows():
            if best is None or r.eval_f1_weighted > best:
                best, best_e, wait = r.eval_f1_weighted, r.epoch, 0
            else:
                wait += 1
            if wait >= 5:
                stop = r.epoch
                break
        assert got[run].stop_epoch == stop
        assert got[run].best_epoch == best_e


def test_best_per_fold_and_summary(spark):
    m = _metrics(spark)
    b = {r.fold: r for r in RL.best_per_fold(m).collect()}
    pdf = m.toPandas()
    for run, g in pdf.groupby("run"):
        g = g.sort_values(["epoch", "step"])
        assert b[run].best_eval_f1_for_fold == g.eval_f1_weighted.max()
        assert b[run].best_epoch_for_fold == g.loc[g.eval_f1_weighted.idxmax(), "epoch"]
    s = RL.kfold_summary(m).toPandas()
    assert set(s.metric_type) == {"averaged_per_epoch", "epoch_for_best_average_f1", "best_f1_per_fold",
                                  "average_of_best_f1s_from_folds"}
    assert list(s.columns) == list(RL.SUMMARY_COLS)


def _plain_asof(rows):
    """{pos of eval row: loss} by looking at every train row; rows are LOG tuples."""
    out = {}
    number = lambda x: x is not None and math.isfinite(x)
    for run, pos, kind, epoch, step, *_ in rows:
        if kind == "train":
            continue
        fit = [(r[4], -r[1], r[5]) for r in rows if r[0] == run and r[2] == "train" and step is not None and r[4] is not None and number(epoch) and number(r[3])
               and epoch - 1.0 + 1e-5 < r[3] <= epoch + 1e-5 and r[4] <= step]
        out[pos] = max(fit)[2] if fit else None
    return out


def _odd_log(n, seed, epochs, hot=False):
    """Epochs that jump, equal steps, null runs, epochs and steps, epochs on the edges of the window."""
    rnd = random.Random(seed)
    rows = []
    for pos in range(n):
        run = 7 if hot and rnd.random() < 0.8 else rnd.choice([1, 2, None])
        kind = "eval" if rnd.random() < 0.4 else "train"
        epoch = rnd.choice([None, float("nan"), float("inf"), -float("inf"), 1e300]) if rnd.random() < 0.03 else epochs(rnd)
        step = None if rnd.random() < 0.02 else rnd.randrange(n // 3)
        rows.append((run, pos, kind, epoch, step, float(pos) if kind == "train" else None, 0.01, None))
    return rows


@pytest.mark.parametrize("name,epochs", [
    ("jumping", lambda r: r.random() * 6 - 2), ("edges", lambda r: r.randrange(-2, 4) + r.choice([0.0, 1e-5, -1e-5, 0.5, 1e-5 + 1e-12])),
    ("inside one epoch", lambda r: 3 + r.random() / 2)])
def test_asof_equals_brute_force(spark, name, epochs):
    """Small chunks, so that cells span many of them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for chunks, hot in ((3, False), (23, True)):
            spark.conf.set("spark.sql.shuffle.partitions", chunks)
            rows = _odd_log(500, chunks, epochs, hot)
            got = {r.pos: r.train_loss for r in RL.asof_train_eval(spark.createDataFrame(rows, LOG)).collect()}
            assert got == _plain_asof(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_asof_questions_that_go_far_back(spark):
    """All train rows come first; the evals of a hot run then ask for chunks long before their own."""
    rows = [(1, p, "train", 5 + (p * 37 % 100) / 100, p, float(p), 0.1, None) for p in range(100)]
    rows += [(1, 100 + p, "eval", 5 + (p * 53 % 120) / 100, 100 + p, None, None, 1.0) for p in range(400)]
    got = {r.pos: r.train_loss for r in RL.asof_train_eval(spark.createDataFrame(rows, LOG).repartition(5)).collect()}
    assert got == _plain_asof(rows) and sum(v is not None for v in got.values()) > 300


def test_asof_keeps_other_columns_and_empty_logs(spark):
    df = spark.createDataFrame([(1, 0, "eval", 1.0, 1, None, None, 2.5, "x", "y")], LOG + ", row string, _row string")
    assert [r.asDict() for r in RL.asof_train_eval(df.drop("_row")).collect()] == [
        {"run": 1, "pos": 0, "epoch": 1.0, "step": 1, "eval_loss": 2.5, "row": "x", "train_loss": None, "learning_rate": None}]
    assert RL.asof_train_eval(spark.createDataFrame([], LOG)).collect() == []


def test_positions_inside_one_epoch(spark):
    """A run whose rows all lie inside one epoch is dealt evenly, nulls first."""
    rows = [(1, 3.0 + (i * 7919 % 3000) / 3000, i) for i in range(3000)] + [(2, None, 5), (2, 1.0, 4), (None, 1.0, 1), (None, 0.5, 2)]
    df = spark.createDataFrame(rows, "run int, epoch double, step long")
    got = {(r.run, r.step): r.position for r in RL.with_position(df.repartition(6)).collect()}
    order = sorted(range(3000), key=lambda i: rows[i][1:])
    assert [got[1, i] for i in order] == list(range(3000))
    assert (got[2, 5], got[2, 4], got[None, 2], got[None, 1]) == (0, 1, 0, 1)
    sizes = [r["count"] for r in sorted_chunks(df, ["run"], ["epoch", "step"]).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 1000


LOG = "run int, pos long, kind string, epoch double, step long, loss double, learning_rate double, eval_loss double"


def test_asof_backward_null_epochs_and_positions_per_run(spark):
    back = spark.createDataFrame([(1, 0, "train", 5.0, 1, 0.5, 0.1, None), (1, 1, "train", 1.0, 2, 0.7, 0.1, None),
                                  (1, 2, "train", None, 2, 0.9, 0.1, None), (1, 3, "eval", 5.2, 3, None, None, 1.0)], LOG)
    assert [r.train_loss for r in RL.asof_train_eval(back).collect()] == [0.5]
    rows = []
    for run in (1, 2):  # positions start at 0 in each run; epochs go backwards, so the range form is used
        rows += [(run, 0, "train", 2.0, 1, 10.0 * run, 0.1, None), (run, 1, "train", 1.0, 2, 11.0 * run, 0.1, None),
                 (run, 2, "eval", 2.1, 3, None, None, 1.0)]
    got = {r.run: r.train_loss for r in RL.asof_train_eval(spark.createDataFrame(rows, LOG)).collect()}
    assert got == {1: 10.0, 2: 20.0}
