"""Registered queries: scoring, streaming, sinks and report round trips
(SCR1-SCR4, STR1, STR2, SNK1-SNK4, SRC4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.operators import metrics as M
from tallyspark.operators import scoring as S
from tallyspark.plans import views as V
from tallyspark.plans.q_text import TEMPLATES
from tallyspark.plans.q_metrics import SQL as QM_SQL
from tallyspark.plans.sqlkit import SENTINEL_SQL, cells, metric_chain
from tallyspark.plans.sqlviews import CLS, with_views
from tallyspark.session import is_folder, materialise, scratch_path
from tallyspark.sources import readers as RD
from tallyspark.sources import sinks as SK
from tallyspark.sources.attempts import AttemptLog
from tallyspark.streaming import budget as BG
from tallyspark.streaming import jobs as ST

CL = DEFAULT_CLASSES
RATE_LIMIT = 2
BUDGET_SECONDS = 3600  # of the registered budget: events are minutes apart


def _docs(spark, d) -> DataFrame:
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("post"))


def _flat(scored: DataFrame) -> DataFrame:
    return scored.select("index", "predicted_label",
                         *[F.round(F.element_at("probs", i + 1), 6).alias(f"prob_{c}") for i, c in enumerate(CL)],
                         "success")


def score_table(spark: SparkSession, d: str) -> DataFrame:
    return _flat(S.score_table(_docs(spark, d), S.length_scorer_factory(len(CL)), CL, "post", "index", 16))


def resume_score(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    first = docs.join(V.table(spark, d, "labels").select(F.col("doc_id").alias("index")), "index", "left_semi")
    existing = materialise(S.score_table(first, S.length_scorer_factory(len(CL)), CL), "scored")
    return _flat(S.resume_score(docs, existing, S.length_scorer_factory(len(CL)), CL))


def _resumed(spark: SparkSession, d: str, path: str) -> DataFrame:
    """The labelled half is scored first, then the whole table is resumed; some rows fail."""
    docs, scorer = _docs(spark, d), S.failing_scorer_factory(len(CL))
    first = docs.join(V.table(spark, d, "labels").select(F.col("doc_id").alias("index")), "index", "left_semi")
    S.resume_score_to(first, path, scorer, CL, batch="first")
    return S.resume_score_to(docs, path, scorer, CL, batch="second")


def _attempts(latest: DataFrame) -> DataFrame:
    return latest.select("index", "predicted_label", F.round(F.element_at("probs", 1), 6).alias("prob_first"), "success",
                         F.col("error").isNotNull().alias("has_error"), "attempts")


def resume_score_to(spark: SparkSession, d: str) -> DataFrame:
    """Durable resume over an attempt log: every id is tried once, failed rows stay failed."""
    return _attempts(_resumed(spark, d, _scratch(spark, "attempts")))


def resume_score_retry(spark: SparkSession, d: str) -> DataFrame:
    """The same log compacted, then its failed ids tried again by a scorer that doesn't fail."""
    path = _scratch(spark, "attempts")
    _resumed(spark, d, path)
    AttemptLog(spark, path).compact()
    return _attempts(S.resume_score_to(_docs(spark, d), path, S.length_scorer_factory(len(CL)), CL, retry_errors=True))


def append_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions appended in two parts, one model a second time, read back one row per (model, id)."""
    path = _scratch(spark, "appended")
    p = V.predictions(spark, d, with_post=False).withColumn("success", ~F.col("predicted_label").startswith("LABEL"))
    for part in ("model < 2", "model >= 1"):
        SK.append_predictions(p.where(part).select(F.col("index") * 10 + F.col("model"), "label", "predicted_label", "success").toDF(
            "index", "label", "predicted_label", "success"), path)
    return S.read_latest(spark, path)


def evaluate_responder(spark: SparkSession, d: str) -> DataFrame:
    posts = V.posts_labeled(spark, d).select("index", "post", "label", F.lit("plain").alias("style"),
                                             (F.col("index") % 2 == 1).alias("thinking"))
    schema = StructType([StructField("style", StringType()), StructField("thinking", BooleanType()),
                         StructField("template", StringType())])
    prompts = spark.createDataFrame(list(TEMPLATES), schema)
    preds = S.evaluate_responder(posts, prompts, lambda: S.LengthResponder(CL), CL)
    out = M.run_summary(preds, CL, "label", "predicted_label", [])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _stream_of(spark: SparkSession, d: str, name: str) -> tuple[str, str | None]:
    """Folder and file name of a table's file stream: a table of many files is a folder, one of a single file a name in ``d``."""
    path = f"{d.rstrip('/')}/{name}.parquet"
    return (path, None) if is_folder(spark, path) else (d, f"{name}.parquet")


def score_stream(spark: SparkSession, d: str) -> DataFrame:
    """documents.parquet as a file stream -> incremental scoring (availableNow) -> read the sink."""
    base = scratch_path(spark, f"score_stream/{uuid.uuid4().hex}")
    schema = StructType([StructField("doc_id", V.table(spark, d, "documents").schema["doc_id"].dataType),
                         StructField("text", StringType())])
    source, glob = _stream_of(spark, d, "documents")
    q = ST.score_stream(spark, source, schema, f"{base}/sink", f"{base}/checkpoint", S.length_scorer_factory(len(CL)), CL,
                        glob=glob, rename={"doc_id": "index", "text": "post"})
    q.awaitTermination()
    return _flat(AttemptLog(spark, f"{base}/sink").latest())


def rate_audit(spark: SparkSession, d: str) -> DataFrame:
    return ST.rate_windows(V.request_log(spark, d), RATE_LIMIT, "ts", "key")


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


def _request_schema(spark: SparkSession, d: str) -> StructType:
    schema = V.table(spark, d, "events").schema
    return StructType([schema["ts"], schema["event_type"]])


def rate_audit_stream(spark: SparkSession, d: str) -> DataFrame:
    """events.parquet as a file stream -> aligned windows that the watermark closed, from the Parquet sink."""
    base = _scratch(spark, "rate_audit")
    source, glob = _stream_of(spark, d, "events")
    ST.rate_audit(spark, source, _request_schema(spark, d), RATE_LIMIT, f"{base}/sink", f"{base}/checkpoint", "2 minutes",
                  glob, rename={"event_type": "key"}).awaitTermination()
    return spark.read.parquet(f"{base}/sink")


def _times_as_text(windows: DataFrame) -> DataFrame:
    return windows.select("key", "window_no", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("opened", "first_request", "last_request")],
                          "n", F.round("waited", 6).alias("waited"), "over_limit")


def rate_budget(spark: SparkSession, d: str) -> DataFrame:
    """Budget windows of each event type, opened by its own requests (batch)."""
    return _times_as_text(BG.budget_windows(V.request_log(spark, d), RATE_LIMIT, BUDGET_SECONDS))


def rate_budget_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same windows from a stream of events.parquet with keyed state, read from its Parquet sink."""
    base = _scratch(spark, "rate_budget")
    source, glob = _stream_of(spark, d, "events")
    BG.budget_stream(spark, source, _request_schema(spark, d), RATE_LIMIT, f"{base}/sink", f"{base}/checkpoint", BUDGET_SECONDS, "2 minutes",
                     glob, key_col="event_type").awaitTermination()
    return _times_as_text(spark.read.parquet(f"{base}/sink"))


def _written_reports(spark: SparkSession, d: str) -> str:
    """Reports of all models, from one scan: the confusion cells are materialised once
    (a groups x labels^2 table) and every section reads them."""
    allp = V.predictions(spark, d, with_post=False)
    counted = materialise(M.confusion_cells(allp, "label", "predicted_label", ["model"]), "cells")
    t, p, w = "true_label", "predicted_label", "n"
    summ = M.run_summary(counted, CL, t, p, ["model"], weight_col=w)
    valid = M.exclude_status(counted)
    per = M.per_class(valid, CL, t, p, ["model"], weight_col=w)
    conf = M.confusion(valid, CL, t, p, ["model"], weight_col=w)
    crep = M.classification_report(valid, CL, t, p, ["model"], weight_col=w)
    rep = SK.render_report(summ, per, conf, "model", ["total_posts", "valid_predictions_for_metrics", "accuracy",
                                                      "f1_macro", "f1_weighted", "precision_weighted", "recall_weighted"],
                           report=crep, classes=CL, digits=6)
    path = _scratch(spark, "reports")
    SK.write_metrics_report(rep, "model", path)
    return path


def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The summary section of written reports."""
    back = RD.read_metrics_reports(spark, _written_reports(spark, d))
    return back.select(F.col("model").cast("int").alias("model"),
                       *[F.round(c, 6).alias(c) if c not in ("total_posts", "valid_predictions_for_metrics")
                         else F.col(c).cast("long").alias(c) for c in RD.SUMMARY_FIELDS])


def _back(df: DataFrame) -> DataFrame:
    return df.select(*[F.col("model").cast("int").alias("model") if c == "model" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def report_tables(spark: SparkSession, d: str) -> DataFrame:
    """The report's sections written as tables, read back and joined: each class's metrics, hits and the run's accuracy."""
    path = _scratch(spark, "report-tables")
    valid = M.exclude_status(V.predictions(spark, d, with_post=False))
    cells_ = materialise(M.confusion_cells(valid, "label", "predicted_label", ["model"]), "cells")
    args = {"true_col": "true_label", "pred_col": "predicted_label", "group_cols": ["model"], "weight_col": "n"}
    SK.write_metrics_tables({"summary": M.summary(cells_, CL, **args), "per_class": M.per_class(cells_, CL, **args), "matrix": M.confusion(cells_, CL, **args)}, path)
    t = SK.read_metrics_tables(spark, path)
    hits = t["matrix"].where("true_label = predicted_label").select("model", F.col("true_label").alias("label"), F.col("n").alias("hits"))
    out = t["per_class"].join(hits, ["model", "label"]).join(t["summary"].select("model", "accuracy"), "model")
    return out.select("model", "label", F.round("f1", 6).alias("f1"), "support", "hits", F.round("accuracy", 6).alias("accuracy"))


def report_per_class(spark: SparkSession, d: str) -> DataFrame:
    """The per-class section of written reports."""
    return _back(RD.read_report_sections(spark, _written_reports(spark, d), CL)["per_class"])


def report_text(spark: SparkSession, d: str) -> DataFrame:
    """The classification report of written reports, its text read back as numbers."""
    return _back(RD.read_report_sections(spark, _written_reports(spark, d), CL)["report"])


def report_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The confusion matrix of written reports."""
    return _back(RD.read_report_sections(spark, _written_reports(spark, d), CL)["matrix"])


QUERIES = {
    "score_table": score_table, "resume_score": resume_score, "evaluate_responder": evaluate_responder,
    "score_stream": score_stream, "rate_audit": rate_audit, "report_roundtrip": report_roundtrip,
    "resume_score_to": resume_score_to, "resume_score_retry": resume_score_retry, "append_predictions": append_predictions,
    "rate_audit_stream": rate_audit_stream, "rate_budget": rate_budget, "rate_budget_stream": rate_budget_stream,
    "report_tables": report_tables, "report_per_class": report_per_class, "report_text": report_text, "report_matrix": report_matrix,
}


def _budget_sql(seen: str) -> str:
    step = BUDGET_SECONDS * 1_000_000
    time = lambda us: f"strftime(make_timestamp({us}::BIGINT), '%Y-%m-%d %H:%M:%S.%f')"
    return f"""
        WITH r AS (
            SELECT event_type AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1 AS i FROM events WHERE {seen}),
        w AS (SELECT key, i // {RATE_LIMIT} AS window_no, min(us) AS f, max(us) AS l, count(*) AS n FROM r GROUP BY ALL HAVING count(*) = {RATE_LIMIT}),
        o AS (SELECT *, max(f - {step} * window_no) OVER (PARTITION BY key ORDER BY window_no) + {step} * window_no AS opened FROM w)
        SELECT key, window_no, {time('opened')} AS opened, {time('f')} AS first_request, {time('l')} AS last_request, n,
               round((opened - f) / 1e6, 6) AS waited, opened > f AS over_limit FROM o"""


_Z = ", ".join(f"((length(text) + {31 * k}) % 97) / 10.0" for k in range(len(CL)))
_SCORED = f"""WITH z AS (SELECT doc_id AS "index", [{_Z}] AS z FROM documents),
        zm AS (SELECT *, list_max(z) AS m FROM z),
        ze AS (SELECT *, [exp(z[1] - m), exp(z[2] - m), exp(z[3] - m), exp(z[4] - m)] AS e FROM zm),
        zp AS (SELECT "index", list_transform(e, lambda x: x / (e[1] + e[2] + e[3] + e[4])) AS p FROM ze)
        SELECT "index", {CLS}[list_position(p, list_max(p))] AS predicted_label,
               {", ".join(f"round(p[{i + 1}], 6) AS prob_{c}" for i, c in enumerate(CL))}, true AS success FROM zp"""

_T0 = "'Classify the post into one category.' || chr(10) || 'Post: ' || post || chr(10) || 'Category:'"
_T1 = "'Reason inside <thinking> tags, then answer ''Final Classification: <category>''.' || chr(10) || 'Post: ' || post"

SQL = {
    "score_table": _SCORED,
    "resume_score": _SCORED,
    "resume_score_to": f"""
        WITH s AS ({_SCORED})
        SELECT s."index", CASE WHEN length(text) % 50 = 0 THEN 'API_ERROR' ELSE predicted_label END AS predicted_label,
               CASE WHEN length(text) % 50 > 0 THEN prob_{CL[0]} END AS prob_first, length(text) % 50 > 0 AS success,
               length(text) % 50 = 0 AS has_error, 1::BIGINT AS attempts
        FROM s JOIN documents ON doc_id = s."index" """,
    "resume_score_retry": f"""
        WITH s AS ({_SCORED})
        SELECT s."index", predicted_label, prob_{CL[0]} AS prob_first, true AS success, false AS has_error,
               CASE WHEN length(text) % 50 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts
        FROM s JOIN documents ON doc_id = s."index" """,
    "append_predictions": with_views("predictions") + """
        SELECT "index" * 10 + model AS "index", label, predicted_label, NOT starts_with(predicted_label, 'LABEL') AS success FROM predictions""",
    "score_stream": _SCORED,
    "evaluate_responder": with_views("posts_labeled") + f""",
        pr AS (SELECT "index", label, CASE WHEN "index" % 2 = 1 THEN {_T1} ELSE {_T0} END AS prompt FROM posts_labeled),
        sp AS (SELECT 1 AS grp, "index", label, {CLS}[length(prompt) % 4 + 1] AS predicted_label FROM pr),
        {metric_chain('sp', 'grp', CL, where=f"predicted_label NOT IN {SENTINEL_SQL}")}
        SELECT (SELECT count(*) FROM sp) AS total_posts, (SELECT count(*) FROM sp) AS api_calls_attempted,
               (SELECT count(*) FROM sp) AS api_calls_succeeded, 0::BIGINT AS api_errors_count,
               0::BIGINT AS content_blocked_count, 0::BIGINT AS no_content_count, 0::BIGINT AS no_candidates_count,
               0::BIGINT AS labels_not_found_in_response, (SELECT count(*) FROM sp) AS valid_predictions_for_metrics,
               round(acc.accuracy, 6) AS accuracy, round(avg.f1_macro, 6) AS f1_macro, round(avg.f1_weighted, 6) AS f1_weighted,
               round(avg.precision_weighted, 6) AS precision_weighted, round(avg.recall_weighted, 6) AS recall_weighted
        FROM acc JOIN avg USING (grp)""",
    "rate_audit": f"""
        SELECT strftime(time_bucket(INTERVAL 60 SECONDS, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS key,
               count(*) AS n, count(*) > {RATE_LIMIT} AS over_limit
        FROM events GROUP BY ALL""",
    "rate_audit_stream": f"""
        SELECT strftime(time_bucket(INTERVAL 60 SECONDS, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS key,
               count(*) AS n, count(*) > {RATE_LIMIT} AS over_limit
        FROM events WHERE epoch_ms(time_bucket(INTERVAL 60 SECONDS, ts)) + 60000 <= (SELECT max(epoch_ms(ts)) - 120000 FROM events)
        GROUP BY ALL""",
    "rate_budget": _budget_sql("true"),
    "rate_budget_stream": _budget_sql("epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - 120000 FROM events)"),
    "report_tables": with_views("predictions") + ",\n" + metric_chain("predictions", "model", CL, where=f"predicted_label NOT IN {SENTINEL_SQL}") + """
        SELECT per.model, per.label, round(per.f1, 6) AS f1, per.support, coalesce(cells.n, 0)::BIGINT AS hits, round(acc.accuracy, 6) AS accuracy
        FROM per JOIN acc ON acc.model = per.model
        LEFT JOIN cells ON cells.model = per.model AND cells.true_label = per.label AND cells.predicted_label = per.label""",
    "report_per_class": with_views("predictions") + ",\n" + metric_chain("predictions", "model", CL, where=f"predicted_label NOT IN {SENTINEL_SQL}") + """
        SELECT model, label AS class, round(f1, 6) AS f1_score, round(precision, 6) AS precision, round(recall, 6) AS recall, support FROM per""",
    "report_text": f"""
        SELECT model, row_label, precision, recall, f1_score, support FROM ({QM_SQL["classification_report"]})""",
    "report_matrix": with_views("predictions") + f""",
        c AS ({cells('predictions', 'model', where=f"predicted_label NOT IN {SENTINEL_SQL}")})
        SELECT m.model, t.label AS true_label, p.label AS predicted_label, coalesce(c.n, 0)::BIGINT AS n
        FROM (SELECT DISTINCT model FROM c) m CROSS JOIN (SELECT unnest({CLS}) AS label) t CROSS JOIN (SELECT unnest({CLS}) AS label) p
        LEFT JOIN c ON c.model = m.model AND c.true_label = t.label AND c.predicted_label = p.label""",
    "report_roundtrip": with_views("predictions") + ",\n" + metric_chain(
        "predictions", "model", CL, where=f"predicted_label NOT IN {SENTINEL_SQL}") + f""",
        counters AS (SELECT model, count(*) AS total_posts,
                            count(*) FILTER (WHERE predicted_label IS NULL OR predicted_label NOT IN {SENTINEL_SQL}) AS valid
                     FROM predictions GROUP BY model)
        SELECT c.model, c.total_posts, c.valid AS valid_predictions_for_metrics,
               round(coalesce(acc.accuracy, 0.0), 6) AS accuracy, round(coalesce(avg.f1_macro, 0.0), 6) AS f1_macro,
               round(coalesce(avg.f1_weighted, 0.0), 6) AS f1_weighted,
               round(coalesce(avg.precision_weighted, 0.0), 6) AS precision_weighted,
               round(coalesce(avg.recall_weighted, 0.0), 6) AS recall_weighted
        FROM counters c LEFT JOIN acc USING (model) LEFT JOIN avg USING (model)""",
}
