"""Registered queries: label codecs, probabilistic metrics, bootstrap and examples
(LBL1-LBL9, AGG23-AGG27, SPL5, WIN2, PRJ6, TXT9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import labels as L
from tallyspark.operators import bootstrap as B
from tallyspark.operators import examples as X
from tallyspark.operators import metrics as M
from tallyspark.plans import sqlkit as K
from tallyspark.plans import views as V
from tallyspark.plans.sqlviews import CLS, with_views

CL = L.DEFAULT_CLASSES
POISSON_REPLICATES = 1000
MULTINOMIAL_REPLICATES = 1000
EDGE = 1e-9  # moves numbers off the edge of rounding, in both engines


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ordinal_encode(spark: SparkSession, d: str) -> DataFrame:
    p = V.posts_labeled(spark, d).select("index", "label", L.encode("label", CL).alias("code"))
    p = p.withColumn("ord", L.ordinal_encode("code", len(CL)))
    return p.select("index", "label", "code", *[F.element_at("ord", i + 1).alias(f"o{i + 1}") for i in range(len(CL) - 1)],
                    L.ordinal_decode("ord").alias("back"))


def ordinal_predict(spark: SparkSession, d: str) -> DataFrame:
    lg = V.logits(spark, d)
    c = L.ordinal_predict("ord_logits")
    return lg.select("index", "true_idx", c.alias("ordinal_class"), L.decode(c, CL).alias("predicted_label"))


def _probs(spark, d) -> DataFrame:
    return L.with_softmax(V.logits(spark, d).select("index", "true_idx", "logits", "ord_logits"), "logits", "probs")


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    p = _probs(spark, d)
    i = L.argmax("probs")
    return _r(p.select("index", i.alias("predicted_idx"), L.decode(i, CL).alias("predicted_label"),
                       F.array_max("probs").alias("max_prob")))


def expand_probs(spark: SparkSession, d: str) -> DataFrame:
    return _r(L.expand_probs(_probs(spark, d), "probs", CL).drop("true_idx", "logits", "ord_logits", "probs"))


def soft_f1_cost(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.soft_f1_cost(_probs(spark, d), "probs", "true_idx", len(CL)))


def log_loss(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.log_loss(_probs(spark, d), "probs", "true_idx"))


def ordinal_bce(spark: SparkSession, d: str) -> DataFrame:
    p = _probs(spark, d).withColumn("target", L.ordinal_encode("true_idx", len(CL)))
    return _r(M.ordinal_bce(p, "ord_logits", "target"))


def _valid(spark, d, with_post=False) -> DataFrame:
    return M.exclude_status(V.predictions(spark, d, with_post=with_post))


def bootstrap_poisson(spark: SparkSession, d: str) -> DataFrame:
    """Every model under the same row weights: a row's weight hangs on its id and the replicate.

    The models' outcomes of an id are one pattern, so ids are weighted once and summed per
    pattern; each pattern then counts for all its models.
    """
    p = _valid(spark, d)
    outcome = F.struct("model", "label", "predicted_label")
    patterns = p.groupBy("index").agg(F.sort_array(F.collect_list(outcome)).alias("pattern"))  # one entry a model
    w = B.poisson_weights(patterns, POISSON_REPLICATES, 42, "index").groupBy("replicate", "pattern").agg(F.sum("weight").alias("weight"))
    rows = w.select("replicate", "weight", F.inline("pattern"))
    s = M.summary(rows, CL, "label", "predicted_label", ["model", "replicate"], "union", weight_col="weight")
    # 15,000 numbers: some lie on the edge of rounding, where the order of sums would decide
    return s.select("model", "replicate", "n", *[F.round(F.col(c) + EDGE, 6).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")])


def bootstrap_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of the multinomial replicates against what theory says of them.

    A replicate's accuracy is binomial: mean p, deviation sqrt(p (1 - p) / n). The flags allow
    six standard errors of either estimate.
    """
    p = _valid(spark, d)
    got = B.metrics(p, MULTINOMIAL_REPLICATES, 42, "label", "predicted_label", ["model"], "union")
    exact = p.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("predicted_label")).cast("int")).alias("accuracy"))
    dev, b = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")), F.col("replicates")
    x = got.join(exact, "model")
    return x.select("model", "n", "replicates", F.round("accuracy", 6).alias("accuracy"),
                    (F.abs(F.col("accuracy_mean") - F.col("accuracy")) <= 6 * dev / F.sqrt(b)).alias("mean_agrees"),
                    (F.abs(F.col("accuracy_std") - dev) <= 6 * dev / F.sqrt(2 * b)).alias("deviation_agrees"))


def bootstrap_multinomial(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    return B.metrics(M.exclude_status(p), MULTINOMIAL_REPLICATES, 42, "label", "predicted_label", ["model"], "union")


def examples_top_n(spark: SparkSession, d: str) -> DataFrame:
    return X.top_n(_valid(spark, d), 2, "label", "index", group_cols=["model"]).select("model", "label", "correct", "rank", "index", "predicted_label")


def examples_text(spark: SparkSession, d: str) -> DataFrame:
    top = X.top_n(_valid(spark, d, with_post=True), 2, "label", "index", group_cols=["model"])
    return X.render(top).select("model", "index", "text")


QUERIES = {
    "ordinal_encode": ordinal_encode, "ordinal_predict": ordinal_predict, "softmax_argmax": softmax_argmax,
    "expand_probs": expand_probs, "soft_f1_cost": soft_f1_cost, "log_loss": log_loss, "ordinal_bce": ordinal_bce,
    "bootstrap_poisson": bootstrap_poisson, "bootstrap_moments": bootstrap_moments, "bootstrap_multinomial": bootstrap_multinomial,
    "examples_top_n": examples_top_n, "examples_text": examples_text,
}

_PROBS = """,
        pm AS (SELECT "index", true_idx, logits, ord_logits, list_max(logits) AS m FROM logits),
        pe AS (SELECT *, [exp(logits[1] - m), exp(logits[2] - m), exp(logits[3] - m), exp(logits[4] - m)] AS ex FROM pm),
        probs AS (SELECT "index", true_idx, logits, ord_logits,
                         list_transform(ex, lambda x: x / (ex[1] + ex[2] + ex[3] + ex[4])) AS probs FROM pe)"""

_THRESH = " + ".join(f"(CASE WHEN u >= '{c!r}'::DOUBLE THEN 1 ELSE 0 END)" for c in B.poisson1_thresholds())
_SENT = f"predicted_label NOT IN {K.SENTINEL_SQL}"
_EX = f""",
        ex AS (SELECT *, label = predicted_label AS correct,
                      row_number() OVER (PARTITION BY model, label, label = predicted_label ORDER BY "index") AS rank
               FROM predictions WHERE {_SENT})"""

_soft_terms = []
for _i in range(len(CL)):
    _p = f"probs[{_i + 1}]"
    _y = f"(CASE WHEN true_idx = {_i} THEN 1.0 ELSE 0.0 END)"
    _soft_terms.append(f"sum({_p} * {_y}) AS tp{_i}, sum({_p} * (1 - {_y})) AS fp{_i}, sum((1 - {_p}) * {_y}) AS fn{_i}")
_soft_f1 = " + ".join(f"(2 * tp{i}) / (2 * tp{i} + fp{i} + fn{i} + 1e-7)" for i in range(len(CL)))

SQL = {
    "ordinal_encode": with_views("posts_labeled") + f""",
        c AS (SELECT "index", label, CAST(list_position({CLS}, label) - 1 AS INTEGER) AS code FROM posts_labeled)
        SELECT "index", label, code, CASE WHEN 0 < code THEN 1.0 ELSE 0.0 END::DOUBLE AS o1,
               CASE WHEN 1 < code THEN 1.0 ELSE 0.0 END::DOUBLE AS o2, CASE WHEN 2 < code THEN 1.0 ELSE 0.0 END::DOUBLE AS o3,
               (CASE WHEN 0 < code THEN 1.0 ELSE 0.0 END + CASE WHEN 1 < code THEN 1.0 ELSE 0.0 END
                + CASE WHEN 2 < code THEN 1.0 ELSE 0.0 END)::DOUBLE AS back
        FROM c""",
    "ordinal_predict": with_views("logits") + f""",
        c AS (SELECT "index", true_idx, CAST((ord_logits[1] > 0)::INT + (ord_logits[2] > 0)::INT + (ord_logits[3] > 0)::INT AS INTEGER) AS k
              FROM logits)
        SELECT "index", true_idx, k AS ordinal_class, {CLS}[k + 1] AS predicted_label FROM c""",
    "softmax_argmax": with_views("logits") + _PROBS + f"""
        SELECT "index", CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS predicted_idx,
               {CLS}[list_position(probs, list_max(probs))] AS predicted_label, round(list_max(probs), 6) AS max_prob
        FROM probs""",
    "expand_probs": with_views("logits") + _PROBS + """
        SELECT "index", """ + ", ".join(f"round(probs[{i + 1}], 6) AS prob_{c}" for i, c in enumerate(CL)) + " FROM probs",
    "soft_f1_cost": with_views("logits") + _PROBS + f""",
        s AS (SELECT {", ".join(_soft_terms)} FROM probs)
        SELECT round(1.0 - ({_soft_f1}) / {len(CL)}, 6) AS soft_f1_cost FROM s""",
    "log_loss": with_views("logits") + _PROBS + """
        SELECT round(avg(-ln(greatest(probs[true_idx + 1], 1e-15))), 6) AS log_loss FROM probs""",
    "ordinal_bce": with_views("logits") + _PROBS + """,
        t AS (SELECT ord_logits AS z, [CASE WHEN 0 < true_idx THEN 1.0 ELSE 0.0 END, CASE WHEN 1 < true_idx THEN 1.0 ELSE 0.0 END,
                                       CASE WHEN 2 < true_idx THEN 1.0 ELSE 0.0 END] AS y FROM probs)
        SELECT round(sum(""" + " + ".join(f"(greatest(z[{j}], 0.0) - z[{j}] * y[{j}] + ln(1 + exp(-abs(z[{j}]))))" for j in (1, 2, 3))
        + ") / sum(len(z)), 6) AS ordinal_bce FROM t",
    "bootstrap_poisson": with_views("predictions") + f""",
        src AS (SELECT model, "index", label, predicted_label FROM predictions WHERE {_SENT}),
        rw AS (SELECT "index", r.range AS replicate,
                      CAST('0x' || substr(md5('42-' || CAST(r.range AS VARCHAR) || '-' || CAST("index" AS VARCHAR)), 1, 13) AS BIGINT)
                        / 4503599627370496.0 AS u
               FROM (SELECT DISTINCT "index" FROM src) CROSS JOIN range(0, {POISSON_REPLICATES}) r),
        ww AS (SELECT "index", replicate, {_THRESH} AS w FROM rw WHERE u >= '{B.poisson1_thresholds()[0]!r}'::DOUBLE),
        cells AS (SELECT model * 1000000 + replicate AS grp, label AS true_label, predicted_label, sum(w) AS n
                  FROM ww JOIN src USING ("index") GROUP BY ALL HAVING sum(w) > 0),
        stats AS ({K.stats('cells', 'grp')}),
        per AS ({K.per_class('cells', 'stats', 'grp', CL, 'union')}),
        av AS ({K.averages('per', 'grp')}),
        acc AS ({K.accuracy('cells', 'grp')})
        SELECT CAST(acc.grp // 1000000 AS INTEGER) AS model, CAST(acc.grp % 1000000 AS INTEGER) AS replicate, acc.n, round(acc.accuracy + {EDGE}, 6) AS accuracy,
               round(av.f1_weighted + {EDGE}, 6) AS f1_weighted, round(av.f1_macro + {EDGE}, 6) AS f1_macro
        FROM acc JOIN av USING (grp)""",
    "bootstrap_moments": with_views("predictions") + f"""
        SELECT model, count(*) AS n, {MULTINOMIAL_REPLICATES}::BIGINT AS replicates,
               round(avg(CASE WHEN label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, true AS mean_agrees, true AS deviation_agrees
        FROM predictions WHERE {_SENT} GROUP BY model""",
    "examples_top_n": with_views("predictions") + _EX + """
        SELECT model, label, correct, CAST(rank AS INTEGER) AS rank, "index", predicted_label FROM ex WHERE rank <= 2""",
    "examples_text": with_views("predictions") + _EX + """
        SELECT model, "index", 'Post: ' || coalesce(post, '') || chr(10) || 'True label: ' || label || chr(10) || 'Predicted label: '
               || predicted_label || chr(10) AS text FROM ex WHERE rank <= 2""",
}
