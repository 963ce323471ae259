"""Registered queries: run-log analytics (JN6-JN8, JN11, AGG14-AGG21, AGG29, WIN3, WIN4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.functions.text import display_name
from tallyspark.operators import metrics as M
from tallyspark.operators import runlogs as RL
from tallyspark.plans import views as V
from tallyspark.plans.sqlkit import SENTINEL_SQL, metric_chain
from tallyspark.plans.sqlviews import with_views

RUNS = (1, 2, 3, 4, 5)


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def asof_train_eval(spark: SparkSession, d: str) -> DataFrame:
    out = RL.asof_train_eval(V.run_log(spark, d))
    return _r(out.select("run", "pos", "epoch", "step", "eval_loss", "train_loss", "learning_rate"))


def join_train_eval(spark: SparkSession, d: str) -> DataFrame:
    m = V.run_metrics(spark, d)
    tr = m.select("run", "epoch", "step", "train_loss", "learning_rate")
    ev = m.select("run", "epoch", "step", "eval_loss", "eval_f1_weighted")
    out = RL.join_train_eval(tr, ev)
    return _r(out.select("run", "epoch_train", "step_train", "train_loss_train", "learning_rate_train",
                         "step_eval", "eval_loss_eval", "eval_f1_weighted_eval"))


def carry_last_loss(spark: SparkSession, d: str) -> DataFrame:
    out = RL.carry_last_loss(V.run_log(spark, d))
    return _r(out.select("run", "pos", "epoch", "eval_loss", "last_train_loss"))


def average_per_epoch(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.average_per_epoch(V.run_metrics(spark, d)))


def kfold_summary(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.kfold_summary(V.run_metrics(spark, d)))


def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.best_epoch(RL.average_per_epoch(V.run_metrics(spark, d))))


def best_per_fold(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.best_per_fold(V.run_metrics(spark, d)))


def fold_metrics_at_best(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.fold_metrics_at_best(V.run_metrics(spark, d)))


def average_by_position(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.average_by_position(V.run_metrics(spark, d, fractional=True)))


def block_means(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.block_means(V.run_metrics(spark, d), 10))


def block_means_wide(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.block_means_wide(RL.block_means(V.run_metrics(spark, d), 10), RUNS))


def range_stats(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.range_stats(V.run_metrics(spark, d), 10, 90))


def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return _r(RL.early_stop(V.run_metrics(spark, d), 10))


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    s = M.run_summary(p, DEFAULT_CLASSES, "label", "predicted_label", ["model"])
    s = s.withColumn("model_name", display_name(F.concat(F.lit("model-"), F.col("model").cast("string"), F.lit("-preview"))))
    return _r(RL.compare_models(s, ["model_name"], "f1_weighted"))


QUERIES = {
    "asof_train_eval": asof_train_eval, "join_train_eval": join_train_eval, "carry_last_loss": carry_last_loss,
    "average_per_epoch": average_per_epoch, "kfold_summary": kfold_summary, "best_epoch": best_epoch,
    "best_per_fold": best_per_fold, "fold_metrics_at_best": fold_metrics_at_best,
    "average_by_position": average_by_position, "block_means": block_means, "block_means_wide": block_means_wide,
    "range_stats": range_stats, "early_stop": early_stop, "compare_models": compare_models,
}

_AVG = """,
        avgp AS (SELECT epoch, avg(eval_loss) AS avg_eval_loss, avg(eval_accuracy) AS avg_eval_accuracy,
                        avg(eval_f1_weighted) AS avg_eval_f1_weighted, avg(eval_precision_weighted) AS avg_eval_precision_weighted,
                        avg(eval_recall_weighted) AS avg_eval_recall_weighted, avg(train_loss) AS avg_train_loss,
                        stddev_samp(eval_f1_weighted) AS std_eval_f1_weighted
                 FROM run_metrics WHERE epoch IS NOT NULL GROUP BY epoch),
        bpf AS (SELECT run AS fold, epoch AS best_epoch_for_fold, eval_f1_weighted AS best_eval_f1_for_fold FROM (
                  SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_f1_weighted DESC, epoch, step) AS rn
                  FROM run_metrics WHERE eval_f1_weighted IS NOT NULL) WHERE rn = 1),
        bavg AS (SELECT epoch AS best_epoch, avg_eval_f1_weighted AS best_f1, avg_eval_accuracy, std_eval_f1_weighted FROM (
                  SELECT *, row_number() OVER (ORDER BY avg_eval_f1_weighted DESC, epoch) AS rn FROM avgp) WHERE rn = 1)"""


def _round_all(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split(", "))


SQL = {
    "asof_train_eval": with_views("run_log") + """,
        ev AS (SELECT * FROM run_log WHERE kind = 'eval'),
        tr AS (SELECT * FROM run_log WHERE kind = 'train'),
        cand AS (SELECT e.pos AS epos, t.loss, t.learning_rate,
                        row_number() OVER (PARTITION BY e.pos ORDER BY t.step DESC, t.pos) AS rn
                 FROM ev e JOIN tr t ON t.run = e.run AND t.epoch > e.epoch - 1.0 + 1e-5 AND t.epoch <= e.epoch + 1e-5
                                     AND t.step <= e.step)
        SELECT e.run, e.pos, round(e.epoch, 6) AS epoch, e.step, round(e.eval_loss, 6) AS eval_loss,
               round(c.loss, 6) AS train_loss, round(c.learning_rate, 6) AS learning_rate
        FROM ev e LEFT JOIN (SELECT * FROM cand WHERE rn = 1) c ON c.epos = e.pos""",
    "join_train_eval": with_views("run_metrics") + """
        SELECT t.run, round(t.epoch, 6) AS epoch_train, t.step AS step_train, round(t.train_loss, 6) AS train_loss_train,
               round(t.learning_rate, 6) AS learning_rate_train, e.step AS step_eval,
               round(e.eval_loss, 6) AS eval_loss_eval, round(e.eval_f1_weighted, 6) AS eval_f1_weighted_eval
        FROM run_metrics t LEFT JOIN run_metrics e ON e.run = t.run AND round(e.epoch, 6) = round(t.epoch, 6)""",
    "carry_last_loss": with_views("run_log") + """
        SELECT run, pos, round(epoch, 6) AS epoch, round(eval_loss, 6) AS eval_loss, round(ltl, 6) AS last_train_loss FROM (
          SELECT *, last_value(loss IGNORE NULLS) OVER (PARTITION BY run ORDER BY pos
                                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ltl
          FROM run_log) WHERE kind = 'eval'""",
    "average_per_epoch": with_views("run_metrics") + _AVG + " SELECT " + _round_all(
        "epoch, avg_eval_loss, avg_eval_accuracy, avg_eval_f1_weighted, avg_eval_precision_weighted, "
        "avg_eval_recall_weighted, avg_train_loss, std_eval_f1_weighted") + " FROM avgp",
    "kfold_summary": with_views("run_metrics") + _AVG + """,
        s AS (
          SELECT 'averaged_per_epoch' AS metric_type, epoch, NULL::VARCHAR AS fold_number, NULL::DOUBLE AS fold_specific_value,
                 avg_train_loss, avg_eval_loss, avg_eval_accuracy, avg_eval_f1_weighted, std_eval_f1_weighted,
                 avg_eval_precision_weighted, avg_eval_recall_weighted FROM avgp
          UNION ALL SELECT 'epoch_for_best_average_f1', best_epoch, 'overall', NULL, NULL, NULL, NULL, best_f1, NULL, NULL, NULL FROM bavg
          UNION ALL SELECT 'best_f1_per_fold', best_epoch_for_fold, CAST(fold AS VARCHAR), best_eval_f1_for_fold,
                           NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM bpf
          UNION ALL SELECT 'average_of_best_f1s_from_folds', avg(best_epoch_for_fold), 'average_of_bests', NULL,
                           NULL, NULL, NULL, avg(best_eval_f1_for_fold), NULL, NULL, NULL FROM bpf)
        SELECT metric_type, fold_number, """ + _round_all(
        "epoch, fold_specific_value, avg_train_loss, avg_eval_loss, avg_eval_accuracy, avg_eval_f1_weighted, "
        "std_eval_f1_weighted, avg_eval_precision_weighted, avg_eval_recall_weighted") + " FROM s",
    "best_epoch": with_views("run_metrics") + _AVG + " SELECT " + _round_all(
        "best_epoch, best_f1, avg_eval_accuracy, std_eval_f1_weighted") + " FROM bavg",
    "best_per_fold": with_views("run_metrics") + _AVG + " SELECT fold, " + _round_all(
        "best_epoch_for_fold, best_eval_f1_for_fold") + " FROM bpf",
    "fold_metrics_at_best": with_views("run_metrics") + _AVG + """,
        ap AS (SELECT *, row_number() OVER (ORDER BY epoch) - 1 AS p FROM avgp),
        bp AS (SELECT p, epoch FROM (SELECT *, row_number() OVER (ORDER BY avg_eval_f1_weighted DESC, p) AS rn FROM ap) WHERE rn = 1),
        rp AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch, step) - 1 AS position FROM run_metrics)
        SELECT round((SELECT epoch FROM bp), 6) AS best_epoch, CAST((SELECT p FROM bp) AS BIGINT) AS best_position,
               count(*) AS n_folds, round(avg(eval_accuracy), 6) AS accuracy_mean, round(stddev_samp(eval_accuracy), 6) AS accuracy_std,
               round(avg(eval_f1_weighted), 6) AS f1_mean, round(stddev_samp(eval_f1_weighted), 6) AS f1_std
        FROM rp WHERE position = (SELECT p FROM bp)""",
    "average_by_position": with_views("run_metrics_frac") + """
        SELECT position, count(*) AS n_runs, round(avg(epoch), 6) AS avg_epoch,
               round(avg(eval_accuracy), 6) AS avg_eval_accuracy, round(stddev_samp(eval_accuracy), 6) AS std_eval_accuracy,
               round(avg(eval_f1_weighted), 6) AS avg_eval_f1_weighted, round(stddev_samp(eval_f1_weighted), 6) AS std_eval_f1_weighted
        FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch, step) - 1 AS position FROM run_metrics_frac)
        GROUP BY position""",
    "block_means": with_views("run_metrics") + """
        SELECT run, CAST(floor(epoch / 10) AS BIGINT) AS block, round(avg(eval_f1_weighted), 6) AS mean_f1
        FROM run_metrics GROUP BY ALL""",
    "block_means_wide": with_views("run_metrics") + """,
        b AS (SELECT run, CAST(floor(epoch / 10) AS BIGINT) AS block, avg(eval_f1_weighted) AS mean_f1 FROM run_metrics GROUP BY ALL)
        SELECT block, """ + ", ".join(f"round(max(CASE WHEN run = {r} THEN mean_f1 END), 6) AS run_{r}" for r in RUNS) + """
        FROM b GROUP BY block""",
    "range_stats": with_views("run_metrics") + """
        SELECT run, count(*) AS n, round(avg(eval_f1_weighted), 6) AS mean_f1, round(stddev_samp(eval_f1_weighted), 6) AS std_f1,
               round(max(eval_f1_weighted), 6) AS max_f1
        FROM run_metrics WHERE epoch > 10 AND epoch < 90 GROUP BY run""",
    "early_stop": with_views("run_metrics") + """,
        p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch, step) - 1 AS position FROM run_metrics),
        q AS (SELECT *, max(eval_f1_weighted) OVER (PARTITION BY run ORDER BY position
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM p),
        r AS (SELECT *, last_value(CASE WHEN prev_best IS NULL OR eval_f1_weighted > prev_best
                                        THEN {'p': position, 'e': epoch, 'v': eval_f1_weighted} END IGNORE NULLS)
                          OVER (PARTITION BY run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS imp FROM q),
        s AS (SELECT *, position - imp.p AS wait FROM r),
        st AS (SELECT run, epoch AS stop_epoch, imp.e AS be, imp.v AS bv FROM (
                 SELECT *, row_number() OVER (PARTITION BY run ORDER BY position) AS rn FROM s WHERE wait >= 10) WHERE rn = 1),
        la AS (SELECT run, imp.e AS le, imp.v AS lv FROM (
                 SELECT *, row_number() OVER (PARTITION BY run ORDER BY position DESC) AS rn FROM s) WHERE rn = 1)
        SELECT la.run, round(st.stop_epoch, 6) AS stop_epoch, round(coalesce(st.be, la.le), 6) AS best_epoch,
               round(coalesce(st.bv, la.lv), 6) AS best_f1
        FROM la LEFT JOIN st USING (run)""",
    "compare_models": with_views("predictions") + ",\n" + metric_chain(
        "predictions", "model", DEFAULT_CLASSES, where=f"predicted_label NOT IN {SENTINEL_SQL}") + """
        SELECT replace(replace('model-' || CAST(model AS VARCHAR) || '-preview', '-preview', ''), '-latest', '') AS model_name,
               round(avg(f1_weighted), 6) AS mean_f1_weighted, count(*) AS n_runs
        FROM avg GROUP BY ALL""",
}
