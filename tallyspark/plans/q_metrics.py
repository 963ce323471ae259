"""Registered queries: classification metrics (AGG1-AGG10, FLT2, LBL10/11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.operators import metrics as M
from tallyspark.plans import sqlkit as K
from tallyspark.plans import views as V
from tallyspark.plans.common import round_doubles
from tallyspark.plans.sqlviews import with_views

CL = DEFAULT_CLASSES


def class_distribution(spark: SparkSession, d: str) -> DataFrame:
    return round_doubles(M.class_distribution(V.posts_labeled(spark, d), "label"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    return M.confusion(p, CL, "label", "predicted_label", ["model"])


def per_class(spark: SparkSession, d: str) -> DataFrame:
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    out = M.per_class(p, CL, "label", "predicted_label", ["model"], "fixed")
    return round_doubles(out.select("model", "label", "precision", "recall", "f1", "support"))


def classification_report(spark: SparkSession, d: str) -> DataFrame:
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    return round_doubles(M.classification_report(p, CL, "label", "predicted_label", ["model"]))


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    return round_doubles(M.run_summary(p, CL, "label", "predicted_label", ["model"]))


RUN_TS = "2025-01-01 12:30:00"


def run_summary_stamped(spark: SparkSession, d: str) -> DataFrame:
    """Run summary with an injected run timestamp rendered as yyyy-MM-dd HH:mm:ss (AGG8 + DTE1)."""
    p = V.predictions(spark, d, with_post=False)
    out = M.run_summary(p, CL, "label", "predicted_label", ["model"], run_ts=RUN_TS)
    return round_doubles(out.select("model", "timestamp", "total_posts", "valid_predictions_for_metrics", "f1_weighted"))


def macro_label_sets(spark: SparkSession, d: str) -> DataFrame:
    """Macro / weighted F1 under the three label-set conventions, sentinels kept (AGG5, AGG9, LBL11).

    All three come out of one aggregation over the per-label stats.
    """
    p = V.predictions(spark, d, with_post=False)
    stats = M.label_stats(M.confusion_cells(p, "label", "predicted_label", ["model"]), ["model"])
    gm = M.group_metrics(stats, CL, ["model"], {"_fixed": "fixed", "_true": "true", "_union": "union"})
    return round_doubles(gm.select("model", "n", "accuracy", *[f"{m}_{s}" for s in ("fixed", "true", "union")
                                                              for m in ("f1_macro", "f1_weighted")]))


def metrics_large(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions_large(spark, d)
    return round_doubles(M.summary(p, V.LARGE_CLASSES, "label", "predicted_label", ["l_linestatus"]))


QUERIES = {
    "class_distribution": class_distribution,
    "confusion": confusion,
    "per_class": per_class,
    "classification_report": classification_report,
    "run_summary": run_summary,
    "run_summary_stamped": run_summary_stamped,
    "macro_label_sets": macro_label_sets,
    "metrics_large": metrics_large,
}

_NOT_SENT = f"predicted_label NOT IN {K.SENTINEL_SQL}"

SQL = {
    "class_distribution": with_views("posts_labeled") + """
        SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proportion
        FROM posts_labeled WHERE label IS NOT NULL GROUP BY label""",
    "confusion": with_views("predictions") + f""",
        cells AS ({K.cells('predictions', 'model')}),
        grid AS (SELECT g.model, t.label AS true_label, p.label AS predicted_label
                 FROM (SELECT DISTINCT model FROM cells) g CROSS JOIN (SELECT * FROM {K.values_list(CL)}) t
                 CROSS JOIN (SELECT * FROM {K.values_list(CL)}) p)
        SELECT grid.model, grid.true_label, grid.predicted_label, CAST(coalesce(cells.n, 0) AS BIGINT) AS n
        FROM grid LEFT JOIN cells USING (model, true_label, predicted_label)""",
    "per_class": with_views("predictions") + ",\n" + K.metric_chain("predictions", "model", CL, where=_NOT_SENT) + """
        SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
        FROM per""",
    "classification_report": with_views("predictions") + ",\n" + K.metric_chain("predictions", "model", CL, where=_NOT_SENT) + f"""
        SELECT model, label AS row_label, class_pos AS row_order, round(precision, 6) AS precision,
               round(recall, 6) AS recall, round(f1, 6) AS f1_score, support FROM per
        UNION ALL
        SELECT t.model, r.row_label, r.row_order, round(r.precision, 6), round(r.recall, 6), round(r.f1_score, 6), r.support
        FROM (SELECT model, CAST(sum(support) AS BIGINT) AS support, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
                     coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0) AS wp,
                     coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0) AS wr,
                     coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0) AS wf
              FROM per GROUP BY model) t
        JOIN acc ON acc.model = t.model,
        LATERAL (VALUES ('accuracy', {len(CL)}, NULL::DOUBLE, NULL::DOUBLE, acc.accuracy, acc.n),
                        ('macro avg', {len(CL) + 1}, t.mp, t.mr, t.mf, t.support),
                        ('weighted avg', {len(CL) + 2}, t.wp, t.wr, t.wf, t.support))
             r(row_label, row_order, precision, recall, f1_score, support)""",
    "run_summary": with_views("predictions") + ",\n" + K.metric_chain("predictions", "model", CL, where=_NOT_SENT) + f""",
        counters AS (
            SELECT model, count(*) AS total_posts,
                   count(*) FILTER (WHERE predicted_label = 'API_ERROR') AS api_errors_count,
                   count(*) FILTER (WHERE predicted_label = 'CONTENT_BLOCKED') AS content_blocked_count,
                   count(*) FILTER (WHERE predicted_label = 'NO_CONTENT') AS no_content_count,
                   count(*) FILTER (WHERE predicted_label = 'NO_CANDIDATES') AS no_candidates_count,
                   count(*) FILTER (WHERE predicted_label = 'LABEL_NOT_FOUND') AS labels_not_found_in_response,
                   count(*) FILTER (WHERE predicted_label IS NULL OR {_NOT_SENT}) AS valid_predictions_for_metrics
            FROM predictions GROUP BY model)
        SELECT c.model, c.total_posts, c.total_posts AS api_calls_attempted,
               c.total_posts - c.api_errors_count AS api_calls_succeeded,
               c.api_errors_count, c.content_blocked_count, c.no_content_count, c.no_candidates_count,
               c.labels_not_found_in_response, c.valid_predictions_for_metrics,
               round(CASE WHEN c.valid_predictions_for_metrics > 0 THEN coalesce(acc.accuracy, 0.0) ELSE 0.0 END, 6) AS accuracy,
               round(CASE WHEN c.valid_predictions_for_metrics > 0 THEN coalesce(avg.f1_macro, 0.0) ELSE 0.0 END, 6) AS f1_macro,
               round(CASE WHEN c.valid_predictions_for_metrics > 0 THEN coalesce(avg.f1_weighted, 0.0) ELSE 0.0 END, 6) AS f1_weighted,
               round(CASE WHEN c.valid_predictions_for_metrics > 0 THEN coalesce(avg.precision_weighted, 0.0) ELSE 0.0 END, 6) AS precision_weighted,
               round(CASE WHEN c.valid_predictions_for_metrics > 0 THEN coalesce(avg.recall_weighted, 0.0) ELSE 0.0 END, 6) AS recall_weighted
        FROM counters c LEFT JOIN acc USING (model) LEFT JOIN avg USING (model)""",
    "run_summary_stamped": with_views("predictions") + ",\n" + K.metric_chain("predictions", "model", CL, where=_NOT_SENT) + f"""
        SELECT c.model, strftime(TIMESTAMP '{RUN_TS}', '%Y-%m-%d %H:%M:%S') AS timestamp, c.total_posts,
               c.valid AS valid_predictions_for_metrics,
               round(CASE WHEN c.valid > 0 THEN coalesce(avg.f1_weighted, 0.0) ELSE 0.0 END, 6) AS f1_weighted
        FROM (SELECT model, count(*) AS total_posts,
                     count(*) FILTER (WHERE predicted_label IS NULL OR {_NOT_SENT}) AS valid
              FROM predictions GROUP BY model) c LEFT JOIN avg USING (model)""",
    "macro_label_sets": with_views("predictions") + ",\n"
        + K.metric_chain("predictions", "model", CL, "fixed", prefix="fx_") + ",\n"
        + K.metric_chain("predictions", "model", CL, "true", prefix="tr_") + ",\n"
        + K.metric_chain("predictions", "model", CL, "union", prefix="un_") + """
        SELECT a.model, a.n, round(a.accuracy, 6) AS accuracy,
               round(f.f1_macro, 6) AS f1_macro_fixed, round(f.f1_weighted, 6) AS f1_weighted_fixed,
               round(t.f1_macro, 6) AS f1_macro_true, round(t.f1_weighted, 6) AS f1_weighted_true,
               round(u.f1_macro, 6) AS f1_macro_union, round(u.f1_weighted, 6) AS f1_weighted_union
        FROM fx_acc a JOIN fx_avg f USING (model) JOIN tr_avg t USING (model) JOIN un_avg u USING (model)""",
    "metrics_large": with_views("predictions_large") + ",\n"
        + K.metric_chain("predictions_large", "l_linestatus", ("A", "N", "R")) + """
        SELECT a.l_linestatus, a.n, round(a.accuracy, 6) AS accuracy,
               round(v.f1_macro, 6) AS f1_macro, round(v.precision_macro, 6) AS precision_macro,
               round(v.recall_macro, 6) AS recall_macro, round(v.f1_weighted, 6) AS f1_weighted,
               round(v.precision_weighted, 6) AS precision_weighted, round(v.recall_weighted, 6) AS recall_weighted
        FROM acc a LEFT JOIN avg v USING (l_linestatus)""",
}
