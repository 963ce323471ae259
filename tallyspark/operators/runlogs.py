"""Training-run log analytics (JN6-JN8, JN11, AGG14-AGG21, AGG29, WIN3, WIN4, MTH1).

Every operator keeps all runs / folds in one plan keyed by ``run``. Ordered
scans per run (positions, carries, running maxima) go through the skew-proof
helpers in ``operators.windows``: the heavy windows are partitioned by
(run, chunk), only per-chunk summaries are ordered per run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import asof
from tallyspark.operators.windows import exact_row_number, forward_fill, running_max, sorted_chunks

EPS = 1e-5
METRICS = ("eval_loss", "eval_accuracy", "eval_f1_weighted", "eval_precision_weighted", "eval_recall_weighted")
STEP_CHUNK = 1 << 20


def with_position(df: DataFrame, run_col: str = "run", order: Sequence[str] = ("epoch", "step"),
                  out_col: str = "position") -> DataFrame:
    """0-based row position inside each run in (epoch, step) order (WIN3).

    Nulls come first; rows equal in all of ``order`` come in any order, the same for every reader.
    Runs of any shape are dealt evenly (``sorted_chunks``).
    """
    x = sorted_chunks(df, [run_col], list(order))
    out = exact_row_number(x, [run_col], ["_at"], F.col("_chunk"), "_pos1")
    return out.withColumn(out_col, F.col("_pos1") - 1).drop("_pos1", "_at", "_chunk")


def asof_train_eval(log: DataFrame, run_col: str = "run", kind_col: str = "kind",
                    carry: Sequence[str] = ("loss", "learning_rate"), eps: float = EPS) -> DataFrame:
    """Each eval row + the last train row (max step, first in log order on ties) with
    epoch in (e - 1 + eps, e + eps] and step <= eval step; none -> NULLs (JN6).

    One method for any log (``operators.asof``): epochs may go backwards, a run may hold most rows.
    Null runs are one run; rows with a null, NaN or infinite epoch or a null step match nothing.
    """
    found = asof.last_in_window(log, run_col, F.col(kind_col) == "train", "epoch", "step", "pos", carry, eps)
    cols = [F.col(f"_t.{k}").alias("train_loss" if k == "loss" else k) for k in carry]
    return found.select(*[k for k in log.columns if k not in carry and k != kind_col], *cols)


def join_train_eval(train: DataFrame, evals: DataFrame, run_col: str = "run", digits: int = 6) -> DataFrame:
    """Left join train rows to eval rows on (run, round(epoch, digits)), suffixes _train/_eval (JN7)."""
    t = train.select(*[F.col(c).alias(c if c in (run_col,) else f"{c}_train") for c in train.columns]).withColumn(
        "_ek", F.round(F.col("epoch_train"), digits))
    e = evals.select(*[F.col(c).alias(c if c in (run_col,) else f"{c}_eval") for c in evals.columns]).withColumn(
        "_ek", F.round(F.col("epoch_eval"), digits))
    return t.join(e, [run_col, "_ek"], "left").drop("_ek")


def carry_last_loss(log: DataFrame, run_col: str = "run", pos_col: str = "pos", loss_col: str = "loss",
                    kind_col: str = "kind", chunk_rows: int = STEP_CHUNK) -> DataFrame:
    """At every eval row, the latest train loss at or before it in log order (JN8)."""
    f = forward_fill(log, [run_col], pos_col, F.col(loss_col), "last_train_loss", F.floor(F.col(pos_col) / chunk_rows))
    return f.where(F.col(kind_col) == "eval")


def coerce_numeric(df: DataFrame, cols: Sequence[str], drop_null: Sequence[str] = ()) -> DataFrame:
    """``to_numeric(errors='coerce')`` + ``dropna(subset)`` (FLT4): ``try_cast`` never throws
    under ANSI mode, unparsable values become NULL and can be dropped."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.col(c).try_cast("double"))
    return out.dropna(subset=list(drop_null)) if drop_null else out


def average_per_epoch(m: DataFrame, epoch_col: str = "epoch") -> DataFrame:
    """Cross-fold mean of each metric + sample std of F1 per epoch value (AGG15)."""
    return m.groupBy(epoch_col).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in METRICS], F.avg("train_loss").alias("avg_train_loss"),
        F.stddev_samp("eval_f1_weighted").alias("std_eval_f1_weighted"))


def average_by_position(m: DataFrame, run_col: str = "run",
                        metrics: Sequence[str] = ("eval_accuracy", "eval_f1_weighted")) -> DataFrame:
    """Cross-run mean / sample std by row position (AGG16) — for runs whose epochs differ slightly."""
    p = with_position(m, run_col)
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.avg("epoch").alias("avg_epoch")]
    for c in metrics:
        aggs += [F.avg(c).alias(f"avg_{c}"), F.stddev_samp(c).alias(f"std_{c}")]
    return p.groupBy("position").agg(*aggs)


def block_means(m: DataFrame, size: int = 10, run_col: str = "run", epoch_col: str = "epoch",
                metric: str = "eval_f1_weighted") -> DataFrame:
    """Mean metric per floor(epoch / size) block per run (AGG17)."""
    return m.groupBy(run_col, F.floor(F.col(epoch_col) / size).alias("block")).agg(F.avg(metric).alias("mean_f1"))


def block_means_wide(blocks: DataFrame, runs: Sequence[int], run_col: str = "run") -> DataFrame:
    """Blocks x runs with NULL where a run has no block (JN11), pivot on known run ids."""
    w = blocks.groupBy("block").pivot(run_col, list(runs)).agg(F.first("mean_f1"))
    return w.select("block", *[F.col(f"`{r}`").alias(f"run_{r}") for r in runs])


def range_stats(m: DataFrame, lo: float = 10, hi: float = 90, run_col: str = "run",
                metric: str = "eval_f1_weighted") -> DataFrame:
    """mean / sample std / max of a metric for lo < epoch < hi, per run (AGG14, FLT3)."""
    return (m.where((F.col("epoch") > lo) & (F.col("epoch") < hi)).groupBy(run_col)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean_f1"), F.stddev_samp(metric).alias("std_f1"),
                 F.max(metric).alias("max_f1")))


def best_epoch(avg: DataFrame, metric: str = "avg_eval_f1_weighted", epoch_col: str = "epoch",
               extra: Sequence[str] = ("avg_eval_accuracy", "std_eval_f1_weighted"), group_cols: Sequence[str] = ()) -> DataFrame:
    """First row (lowest epoch) with the highest metric, with companion columns (AGG18)."""
    best = F.max_by(F.struct(F.col(epoch_col).alias("best_epoch"), F.col(metric).alias("best_f1"), *extra),
                    F.struct(F.col(metric), -F.col(epoch_col)))
    return avg.groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, "b.*")


def best_per_fold(m: DataFrame, run_col: str = "run", metric: str = "eval_f1_weighted") -> DataFrame:
    """Per fold: first row in (epoch, step) order with the best F1 (AGG19)."""
    b = F.max_by(F.struct(F.col("epoch").alias("best_epoch_for_fold"), F.col(metric).alias("best_eval_f1_for_fold")),
                 F.struct(F.col(metric), -F.col("epoch"), -F.col("step")))
    return (m.where(F.col(metric).isNotNull()).groupBy(F.col(run_col).alias("fold")).agg(b.alias("b"))
            .select("fold", "b.*"))


SUMMARY_COLS = ("metric_type", "epoch", "fold_number", "fold_specific_value", "avg_train_loss", "avg_eval_loss",
                "avg_eval_accuracy", "avg_eval_f1_weighted", "std_eval_f1_weighted", "avg_eval_precision_weighted",
                "avg_eval_recall_weighted")


def kfold_summary(m: DataFrame, run_col: str = "run") -> DataFrame:
    """Long summary with four row kinds and sparse columns in a fixed order (AGG20, SET2)."""
    m = coerce_numeric(m, ["epoch", "eval_f1_weighted"])
    avg = average_per_epoch(m.where(F.col("epoch").isNotNull()))
    a = avg.withColumn("metric_type", F.lit("averaged_per_epoch"))
    be = best_epoch(avg, extra=()).select(F.lit("epoch_for_best_average_f1").alias("metric_type"),
                                          F.col("best_epoch").alias("epoch"),
                                          F.col("best_f1").alias("avg_eval_f1_weighted"),
                                          F.lit("overall").alias("fold_number"))
    bpf = best_per_fold(m, run_col)
    b = bpf.select(F.lit("best_f1_per_fold").alias("metric_type"), F.col("best_epoch_for_fold").alias("epoch"),
                   F.col("best_eval_f1_for_fold").alias("fold_specific_value"),
                   F.col("fold").cast("string").alias("fold_number"))
    c = bpf.agg(F.avg("best_epoch_for_fold").alias("epoch"), F.avg("best_eval_f1_for_fold").alias("avg_eval_f1_weighted")
                ).select(F.lit("average_of_best_f1s_from_folds").alias("metric_type"), "epoch", "avg_eval_f1_weighted",
                         F.lit("average_of_bests").alias("fold_number"))
    out = a.unionByName(be, allowMissingColumns=True).unionByName(b, allowMissingColumns=True).unionByName(
        c, allowMissingColumns=True)
    return out.select(*[F.col(x).cast("string") if x in ("metric_type", "fold_number") else F.col(x).cast("double")
                        for x in SUMMARY_COLS])


def fold_metrics_at_best(m: DataFrame, run_col: str = "run") -> DataFrame:
    """Metrics of every fold at the *row position* of the best averaged epoch; mean and
    sample std over folds (AGG21, position mode)."""
    avg = average_per_epoch(m)
    avg_pos = exact_row_number(sorted_chunks(avg, [], ["epoch"]), [], ["_at"], F.col("_chunk"), "_p")
    best = avg_pos.agg(F.max_by(F.struct(F.col("_p").alias("p"), F.col("epoch").alias("e")),
                                F.struct(F.col("avg_eval_f1_weighted"), -F.col("_p"))).alias("b"))
    b = best.select("b").scalar()  # one scalar subquery returning (position, epoch)
    bp, be = b["p"], b["e"]
    rows = with_position(m, run_col).where(F.col("position") == bp - 1)
    return rows.agg(be.alias("best_epoch"), (bp - 1).alias("best_position"), F.count(F.lit(1)).alias("n_folds"),
                    F.avg("eval_accuracy").alias("accuracy_mean"), F.stddev_samp("eval_accuracy").alias("accuracy_std"),
                    F.avg("eval_f1_weighted").alias("f1_mean"), F.stddev_samp("eval_f1_weighted").alias("f1_std"))


def early_stop(m: DataFrame, patience: int = 10, run_col: str = "run", metric: str = "eval_f1_weighted") -> DataFrame:
    """Early stopping on a greater-is-better metric (WIN4): the counter resets on a strict
    improvement over all earlier evaluations, otherwise grows by one; training stops at the
    first evaluation where it reaches ``patience``. Returns the stop and best checkpoint per run."""
    p = with_position(m, run_col)
    chunk = F.floor(F.col("position") / STEP_CHUNK)
    p = running_max(p, [run_col], "position", metric, "_prev_best", chunk, inclusive=False)
    improved = F.col("_prev_best").isNull() | (F.col(metric) > F.col("_prev_best"))
    p = forward_fill(p, [run_col], "position", F.when(improved, F.struct(F.col("position").alias("p"),
                                                                         F.col("epoch").alias("e"),
                                                                         F.col(metric).alias("v"))), "_imp", chunk)
    p = p.withColumn("_wait", F.col("position") - F.col("_imp.p"))
    stop = F.min_by(F.struct(F.col("epoch").alias("stop_epoch"), F.col("_imp.e").alias("be"), F.col("_imp.v").alias("bv")),
                    F.when(F.col("_wait") >= patience, F.col("position")))
    last = F.max_by(F.struct(F.col("_imp.e").alias("e"), F.col("_imp.v").alias("v")), F.col("position"))
    g = p.groupBy(run_col).agg(stop.alias("s"), last.alias("l"))
    return g.select(run_col, F.col("s.stop_epoch").alias("stop_epoch"),
                    F.coalesce(F.col("s.be"), F.col("l.e")).alias("best_epoch"),
                    F.coalesce(F.col("s.bv"), F.col("l.v")).alias("best_f1"))


def pct_change(value: str | Column, baseline: str | Column, digits: int = 2) -> Column:
    """Relative change in percent, rounded (MTH1); zero baseline -> NULL."""
    v = F.col(value) if isinstance(value, str) else value
    b = F.col(baseline) if isinstance(baseline, str) else baseline
    return F.round(F.try_divide(v - b, b) * 100, digits)


def compare_models(summary: DataFrame, keys: Sequence[str], metric: str = "f1_weighted") -> DataFrame:
    """One row per model configuration with the mean of a metric (AGG29)."""
    return summary.groupBy(*keys).agg(F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_runs"))
