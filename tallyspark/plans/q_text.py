"""Registered queries: response parsing, prompts and n-gram leakage (TXT1-TXT7, JN4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tallyspark.functions import prompts as PR
from tallyspark.functions import responses as R
from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.operators import contamination as C
from tallyspark.operators import metrics as M
from tallyspark.plans import views as V
from tallyspark.plans.sqlkit import SENTINEL_SQL, metric_chain
from tallyspark.plans.sqlviews import with_views

CL = DEFAULT_CLASSES
MARKER = "### Response:"
# Example templates (user data in real use), one '{}' hole each.
TEMPLATES = (
    ("plain", False, "Classify the post into one category.\nPost: {}\nCategory:"),
    ("plain", True, "Reason inside <thinking> tags, then answer 'Final Classification: <category>'.\nPost: {}"),
)
TRAIN_TEMPLATE = "Post: {}\nCategory: {}"
EOS = "</s>"


def extract_label(spark: SparkSession, d: str) -> DataFrame:
    r = V.responses(spark, d)
    r = R.with_extracted_label(r, "response", "label_thinking", CL, thinking=True)
    r = R.with_extracted_label(r, "response", "label_plain", CL, thinking=False)
    return r.select("index", "label_thinking", "label_plain")


def _marked(r: DataFrame) -> DataFrame:
    gen = F.when(F.col("index") % 3 == 0, F.col("response")).otherwise(
        F.concat(F.lit("Q " + MARKER + " <think>attempt</think>"), F.col("response")))
    return r.select("index", gen.alias("generated"))


def extract_after_marker(spark: SparkSession, d: str) -> DataFrame:
    g = _marked(V.responses(spark, d))
    return g.select("index", R.extract_label_after_marker("generated", MARKER, CL).alias("predicted_label"),
                    R.marker_found("generated", MARKER).alias("marker_found"))


def _status_predictions(spark: SparkSession, d: str) -> DataFrame:
    r = R.with_extracted_label(V.responses(spark, d), "response", "_parsed", CL, thinking=True)
    return r.select("index", "label",
                    R.classify_status("finish_reason", "has_parts", "error", F.col("_parsed")).alias("predicted_label"))


def finish_status(spark: SparkSession, d: str) -> DataFrame:
    return _status_predictions(spark, d)


def response_summary(spark: SparkSession, d: str) -> DataFrame:
    p = _status_predictions(spark, d)
    out = M.run_summary(p, CL, "label", "predicted_label", [])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def _prompts(spark: SparkSession) -> DataFrame:
    schema = StructType([StructField("style", StringType()), StructField("thinking", BooleanType()),
                         StructField("template", StringType())])
    return spark.createDataFrame(list(TEMPLATES), schema)


def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    posts = V.posts_labeled(spark, d).select("index", "post", F.lit("plain").alias("style"),
                                             (F.col("index") % 2 == 1).alias("thinking"))
    return PR.render(posts, _prompts(spark)).select("index", "thinking", "prompt")


def render_training(spark: SparkSession, d: str) -> DataFrame:
    posts = V.posts_labeled(spark, d)
    return posts.select("index", PR.render_training(TRAIN_TEMPLATE, "post", "label", EOS).alias("text"))


def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("post"))
    return C.flag_overlap(docs, V.table(spark, d, "benchmark"), 7)


def ngram_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.overlap_counts(ngram_overlap(spark, d))


def ngram_unique(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("post"), "n_chars")
    return C.drop_overlap(docs, V.table(spark, d, "benchmark"), 7).select("index", "n_chars")


QUERIES = {
    "extract_label": extract_label,
    "extract_after_marker": extract_after_marker,
    "finish_status": finish_status,
    "response_summary": response_summary,
    "render_prompt": render_prompt,
    "render_training": render_training,
    "ngram_overlap": ngram_overlap,
    "ngram_counts": ngram_counts,
    "ngram_unique": ngram_unique,
}


def _sql_word(col: str, w: str) -> str:
    return f"regexp_matches({col}, '\\b{w}\\b')"


def _sql_extract(thinking: bool) -> str:
    steps = []
    if thinking:
        inlist = ", ".join(f"'{c}'" for c in CL)
        steps.append(f"CASE WHEN g IN ({inlist}) THEN g END")
        whens = " ".join(f"WHEN {_sql_word('after', c)} THEN '{c}'" for c in CL)
        steps.append(f"CASE WHEN tpos > 0 THEN CASE {whens} END END")
    whens = " ".join(f"WHEN {_sql_word('t', c)} OR starts_with(ts, '{c}') THEN '{c}'" for c in CL)
    steps.append(f"CASE {whens} END")
    kw = " ".join("WHEN " + " OR ".join(f"contains(t, '{s}')" for s in subs) + f" THEN '{c}'"
                  for c, subs in R.DEFAULT_SYNONYMS)
    steps.append(f"CASE {kw} END")
    return "coalesce(" + ", ".join(steps) + ", 'LABEL_NOT_FOUND')"


_PARSE_CTE = r""",
        r0 AS (SELECT *, regexp_replace(response, '^\s+|\s+$', '', 'g') AS s FROM responses),
        r1 AS (SELECT *, lower(regexp_extract(s, '(?i)final classification:\s*([a-zA-Z]+)', 1)) AS g,
                         strpos(s, '</thinking>') AS tpos,
                         regexp_replace(lower(s), '^(the|this|post|is|classified|as|category|:|\s)+', '') AS t
               FROM r0),
        parsed AS (SELECT *, lower(substr(s, tpos + 11)) AS after, regexp_replace(t, '^\s+|\s+$', '', 'g') AS ts FROM r1)"""

_STATUS = ("CASE WHEN error IS NOT NULL THEN 'API_ERROR' "
           "WHEN finish_reason IS NULL AND has_parts IS NULL THEN 'NO_CANDIDATES' "
           "WHEN finish_reason IN (2, 3) THEN 'CONTENT_BLOCKED' "
           f"WHEN finish_reason IS NULL OR finish_reason = 1 THEN CASE WHEN coalesce(has_parts, false) THEN {_sql_extract(True)} ELSE 'NO_CONTENT' END "
           "ELSE 'UNKNOWN_ERROR' END")

_GRAMS = r"""list_transform(range(0, len(toks) - 6), lambda i: array_to_string(toks[i + 1:i + 7], ' '))"""
_TOKS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_NGRAM_CTE = f""",
        dt AS (SELECT doc_id, {_TOKS} AS toks FROM documents),
        dg AS (SELECT doc_id, unnest(CASE WHEN len(toks) >= 7 THEN {_GRAMS} ELSE []::VARCHAR[] END) AS gram FROM dt),
        rt AS (SELECT {_TOKS} AS toks FROM benchmark),
        rg AS (SELECT DISTINCT unnest(CASE WHEN len(toks) >= 7 THEN {_GRAMS} ELSE []::VARCHAR[] END) AS gram FROM rt),
        flagged AS (SELECT DISTINCT doc_id FROM dg WHERE gram IN (SELECT gram FROM rg)),
        flags AS (SELECT d.doc_id AS "index", d.doc_id IN (SELECT doc_id FROM flagged) AS duplicate, d.n_chars
                  FROM documents d)"""

SQL = {
    "extract_label": with_views("responses") + _PARSE_CTE + f"""
        SELECT "index", {_sql_extract(True)} AS label_thinking, {_sql_extract(False)} AS label_plain FROM parsed""",
    "extract_after_marker": with_views("responses") + rf""",
        gen AS (SELECT "index", CASE WHEN "index" % 3 = 0 THEN response
                                     ELSE 'Q {MARKER} <think>attempt</think>' || response END AS generated FROM responses),
        seg AS (SELECT *, CASE WHEN len(string_split(generated, '{MARKER}')) >= 2
                               THEN string_split(generated, '{MARKER}')[2] END AS sg FROM gen),
        body AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(sg, '^\s+|\s+$', '', 'g'),
                   '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') AS b FROM seg)
        SELECT "index", coalesce(CASE {" ".join(f"WHEN contains(b, '{c}') THEN '{c}'" for c in CL)} END, 'LABEL_NOT_FOUND')
                 AS predicted_label,
               contains(generated, '{MARKER}') AS marker_found
        FROM body""",
    "finish_status": with_views("responses") + _PARSE_CTE + f"""
        SELECT "index", label, {_STATUS} AS predicted_label FROM parsed""",
    "response_summary": with_views("responses") + _PARSE_CTE + f""",
        sp AS (SELECT 1 AS grp, "index", label, {_STATUS} AS predicted_label FROM parsed),
        {metric_chain('sp', 'grp', CL, where=f"predicted_label NOT IN {SENTINEL_SQL}")},
        counters AS (
            SELECT 1 AS grp, count(*) AS total_posts,
                   count(*) FILTER (WHERE predicted_label = 'API_ERROR') AS api_errors_count,
                   count(*) FILTER (WHERE predicted_label = 'CONTENT_BLOCKED') AS content_blocked_count,
                   count(*) FILTER (WHERE predicted_label = 'NO_CONTENT') AS no_content_count,
                   count(*) FILTER (WHERE predicted_label = 'NO_CANDIDATES') AS no_candidates_count,
                   count(*) FILTER (WHERE predicted_label = 'LABEL_NOT_FOUND') AS labels_not_found_in_response,
                   count(*) FILTER (WHERE predicted_label NOT IN {SENTINEL_SQL}) AS valid_predictions_for_metrics
            FROM sp)
        SELECT c.total_posts, c.total_posts AS api_calls_attempted, c.total_posts - c.api_errors_count AS api_calls_succeeded,
               c.api_errors_count, c.content_blocked_count, c.no_content_count, c.no_candidates_count,
               c.labels_not_found_in_response, c.valid_predictions_for_metrics,
               round(coalesce(acc.accuracy, 0.0), 6) AS accuracy, round(coalesce(avg.f1_macro, 0.0), 6) AS f1_macro,
               round(coalesce(avg.f1_weighted, 0.0), 6) AS f1_weighted,
               round(coalesce(avg.precision_weighted, 0.0), 6) AS precision_weighted,
               round(coalesce(avg.recall_weighted, 0.0), 6) AS recall_weighted
        FROM counters c LEFT JOIN acc USING (grp) LEFT JOIN avg USING (grp)""",
    "render_prompt": with_views("posts_labeled") + r"""
        SELECT "index", "index" % 2 = 1 AS thinking,
               CASE WHEN "index" % 2 = 1
                    THEN 'Reason inside <thinking> tags, then answer ''Final Classification: <category>''.' || chr(10) || 'Post: ' || post
                    ELSE 'Classify the post into one category.' || chr(10) || 'Post: ' || post || chr(10) || 'Category:' END AS prompt
        FROM posts_labeled""",
    "render_training": with_views("posts_labeled") + f"""
        SELECT "index", CASE WHEN suffix(t, '{EOS}') THEN t ELSE t || '{EOS}' END AS text
        FROM (SELECT "index", 'Post: ' || post || chr(10) || 'Category: ' || label AS t FROM posts_labeled)""",
    "ngram_overlap": "WITH x AS (SELECT 1)" + _NGRAM_CTE + """
        SELECT "index", duplicate FROM flags""",
    "ngram_counts": "WITH x AS (SELECT 1)" + _NGRAM_CTE + """
        SELECT duplicate, count(*) AS n FROM flags GROUP BY duplicate""",
    "ngram_unique": "WITH x AS (SELECT 1)" + _NGRAM_CTE + """
        SELECT "index", n_chars FROM flags WHERE NOT duplicate""",
}
