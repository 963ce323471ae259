"""Registered queries: splits, ensembles and pseudo-labels (SPL1-4, JN5, JN10, ENS1-5, PSL1-3, AGG11, AGG13, FLT1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES, with_softmax
from tallyspark.operators import ensemble as EN
from tallyspark.operators import metrics as M
from tallyspark.operators import pseudolabel as PS
from tallyspark.operators import splits as SP
from tallyspark.plans import views as V
from tallyspark.plans.sqlkit import SENTINEL_SQL
from tallyspark.plans.sqlviews import CLS, with_views
from tallyspark.session import materialise

CL = DEFAULT_CLASSES
N_MODELS = 5
MODELS = [m for m, _ in V.MODEL_MULTS]
# Vote weights of the source study (model 0 first) and the model-0 weight grid.
VOTE_WEIGHTS = (0.7026, 0.750, 0.745, 0.774, 0.743)
LENIENT_WEIGHTS = (1.75, 0.750, 0.745, 0.774, 0.743)
FIXED_WEIGHTS = (0.750, 0.745, 0.774, 0.743)
GRID_STEPS, GRID_STEP = 250, 0.02
CONF_THRESHOLD = 0.3


def _folds(spark: SparkSession, d: str) -> DataFrame:
    return SP.stratified_kfold(V.posts_labeled(spark, d).drop("post"), 5, 42, "label", "index", CL)


def stratified_kfold(spark: SparkSession, d: str) -> DataFrame:
    return _folds(spark, d).select("index", "label", "fold")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return SP.stratified_split(V.posts_labeled(spark, d).drop("post"), 0.2, 42).select("index", "label", "split")


def sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return SP.sample_exact(V.posts_labeled(spark, d).drop("post"), 0.5, 42).select("index", "label")


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    return SP.fold_distribution(_folds(spark, d), 5, "label", "fold")


def _wide_valid(spark, d) -> DataFrame:
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    return EN.align(p, MODELS, carry=["label"], require_all=True)


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    w = EN.weighted_vote(_wide_valid(spark, d), VOTE_WEIGHTS, CL, strict=True)
    return w.select("index", "label", "predicted_label")


def vote_lenient(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    wide = EN.align(p, MODELS, require_all=True)
    return EN.weighted_vote(wide, LENIENT_WEIGHTS, CL, strict=False).select("index", "predicted_label", "skipped_votes")


def _grid(spark, d) -> DataFrame:
    wide = _wide_valid(spark, d).join(_folds(spark, d).select("index", "fold"), "index")
    return EN.grid_search(wide, FIXED_WEIGHTS, GRID_STEPS, GRID_STEP, CL, "label", ["fold"])


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    return _r(_grid(spark, d))


def best_weight(spark: SparkSession, d: str) -> DataFrame:
    return _r(EN.best_weight(_grid(spark, d), ["fold"]))


def average_grid(spark: SparkSession, d: str) -> DataFrame:
    return _r(EN.average_grid(_grid(spark, d)))


def _unanimous(spark, d) -> DataFrame:
    p = V.predictions(spark, d, with_post=False, with_digest=True)
    return PS.unanimous(p, MODELS, "post_key", key_is_digest=True).select("index", "label", "predicted_label")


def unanimous(spark: SparkSession, d: str) -> DataFrame:
    return _unanimous(spark, d)


def agreement_rate(spark: SparkSession, d: str) -> DataFrame:
    total = V.predictions(spark, d, with_post=False).where(F.col("model") == 0)
    return _r(PS.agreement_rate(_unanimous(spark, d), total))


def _train(spark, d) -> DataFrame:
    return _folds(spark, d).where(F.col("fold") != 0).select("index", "label")


def assemble(spark: SparkSession, d: str) -> DataFrame:
    return PS.assemble(_train(spark, d), _unanimous(spark, d), cols=("index",))


def assemble_half(spark: SparkSession, d: str) -> DataFrame:
    return PS.assemble(_train(spark, d), _unanimous(spark, d), fraction=0.5, seed=42, cols=("index",))


def size_report(spark: SparkSession, d: str) -> DataFrame:
    # the unanimous subset feeds four stages: it is written once
    tr, un = _train(spark, d), materialise(_unanimous(spark, d), "unanimous")
    half = SP.sample_exact(un, 0.5, 42)
    return PS.size_report({"train": tr, "pseudo": un, "pseudo_half": half},
                          combined={"combined": ("train", "pseudo"), "combined_half": ("train", "pseudo_half")})


def size_report_folds(spark: SparkSession, d: str) -> DataFrame:
    """Per fold: train / validation sizes, train + pseudo-labels, and the mean over folds (AGG13)."""
    folds = _folds(spark, d)
    n_un = _unanimous(spark, d).select(F.count(F.lit(1))).scalar()
    per = SP.fold_tables(folds.select("fold"), 5, "fold").groupBy("fold_id").agg(
        F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "validation").alias("n_validation"))
    per = per.withColumn("n_combined", F.col("n_train") + n_un)
    avg = per.agg(F.lit(-1).alias("fold_id"), *[F.avg(c).alias(c) for c in ("n_train", "n_validation", "n_combined")])
    return _r(per.select("fold_id", *[F.col(c).cast("double") for c in ("n_train", "n_validation", "n_combined")])
              .unionByName(avg))


def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    sc = with_softmax(V.logits(spark, d).select("index", "logits"), "logits", "probs")
    return _r(PS.confidence_filter(sc, CONF_THRESHOLD, "probs").select("index", "max_prob"))


QUERIES = {
    "stratified_kfold": stratified_kfold, "stratified_split": stratified_split, "sample_exact": sample_exact,
    "fold_sizes": fold_sizes, "weighted_vote": weighted_vote, "vote_lenient": vote_lenient,
    "grid_search": grid_search, "best_weight": best_weight, "average_grid": average_grid,
    "unanimous": unanimous, "agreement_rate": agreement_rate, "assemble": assemble,
    "assemble_half": assemble_half, "size_report": size_report, "size_report_folds": size_report_folds, "confidence_filter": confidence_filter,
}

_KEY = "md5('42-' || CAST(\"index\" AS VARCHAR))"
_FOLDS = f""",
        rk AS (SELECT "index", label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, "index") AS rn FROM posts_labeled),
        cc AS (SELECT label, count(*) AS n, coalesce(list_position({CLS}, label), 5) AS cpos FROM posts_labeled GROUP BY label),
        co AS (SELECT label, coalesce(sum(n) OVER (ORDER BY cpos, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cc),
        folds AS (SELECT rk."index", rk.label, CAST((co.off + rk.rn - 1) % 5 AS INTEGER) AS fold FROM rk JOIN co USING (label))"""


def _score(c: str, weights) -> str:
    terms = " + ".join(f"(CASE WHEN p{i} = '{c}' THEN CAST({w} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)"
                       if not isinstance(w, str) else f"(CASE WHEN p{i} = '{c}' THEN {w} ELSE CAST(0.0 AS DOUBLE) END)"
                       for i, w in enumerate(weights))
    return f"(CAST(0.0 AS DOUBLE) + {terms})"


def _vote(weights) -> str:
    sc = "[" + ", ".join(_score(c, weights) for c in CL) + "]"
    return f"{CLS}[list_position({sc}, list_max({sc}))]"


def _wide(src: str) -> str:
    ps = ", ".join(f"max(CASE WHEN model = {m} THEN predicted_label END) AS p{i}" for i, m in enumerate(MODELS))
    return (f"SELECT \"index\", max(CASE WHEN model = 0 THEN label END) AS label, {ps} FROM {src} "
            f"WHERE \"index\" IN (SELECT \"index\" FROM {src} GROUP BY \"index\" HAVING count(DISTINCT model) = {N_MODELS}) "
            f"GROUP BY \"index\"")


_VALID = f""",
        valid AS (SELECT * FROM predictions WHERE predicted_label NOT IN {SENTINEL_SQL}),
        wide AS ({_wide('valid')})"""

_f1 = " + ".join(f"coalesce(2.0 * tp{i} / nullif(sup{i} + pn{i}, 0), 0.0) * sup{i}" for i in range(len(CL)))
_sups = " + ".join(f"sup{i}" for i in range(len(CL)))
_sums = ", ".join(f"sum(CASE WHEN label = '{c}' AND pred = '{c}' THEN cnt ELSE 0 END) AS tp{i}, "
                  f"sum(CASE WHEN label = '{c}' THEN cnt ELSE 0 END) AS sup{i}, "
                  f"sum(CASE WHEN pred = '{c}' THEN cnt ELSE 0 END) AS pn{i}" for i, c in enumerate(CL))
_GRID = _FOLDS + _VALID + f""",
        pat AS (SELECT f.fold, w.label, w.p0, w.p1, w.p2, w.p3, w.p4, count(*) AS cnt
                FROM wide w JOIN folds f USING ("index") GROUP BY ALL),
        gx AS (SELECT pat.*, CAST(g.range AS INTEGER) AS gi, CAST(g.range AS DOUBLE) * CAST({GRID_STEP} AS DOUBLE) AS weight_0
               FROM pat CROSS JOIN range(0, {GRID_STEPS}) g),
        gy AS (SELECT *, {_vote(['weight_0', *FIXED_WEIGHTS])} AS pred FROM gx),
        gper AS (SELECT fold, gi, weight_0, {_sums} FROM gy GROUP BY fold, gi, weight_0),
        grid AS (SELECT fold, gi, weight_0, coalesce((CAST(0.0 AS DOUBLE) + {_f1}) / nullif({_sups}, 0), 0.0) AS wf FROM gper)"""

_UNAN = """,
        ug AS (SELECT post, count(DISTINCT model) AS nm, count(DISTINCT predicted_label) AS nl,
                      count(predicted_label) AS nn, count(*) AS nr FROM predictions GROUP BY post),
        unan AS (SELECT "index", label, predicted_label FROM predictions
                 WHERE model = 0 AND post IN (SELECT post FROM ug WHERE nm = 5 AND nl = 1 AND nn = nr))"""
_HALF = f""",
        half AS (SELECT "index", label, predicted_label FROM (
                   SELECT *, row_number() OVER (ORDER BY {_KEY}, "index") AS rn FROM unan)
                 WHERE rn <= round_even((SELECT count(*) FROM unan) * CAST(0.5 AS DOUBLE), 0)),
        train AS (SELECT "index", label FROM folds WHERE fold <> 0)"""

SQL = {
    "stratified_kfold": with_views("posts_labeled") + _FOLDS + " SELECT \"index\", label, fold FROM folds",
    "stratified_split": with_views("posts_labeled") + f""",
        rk AS (SELECT "index", label, row_number() OVER (PARTITION BY label ORDER BY {_KEY}, "index") AS rn FROM posts_labeled),
        cc AS (SELECT label, round(count(*) * CAST(0.2 AS DOUBLE)) AS nt FROM posts_labeled GROUP BY label)
        SELECT "index", label, CASE WHEN rn <= nt THEN 'test' ELSE 'train' END AS split FROM rk JOIN cc USING (label)""",
    "sample_exact": with_views("posts_labeled") + f"""
        SELECT "index", label FROM (SELECT *, row_number() OVER (ORDER BY {_KEY}, "index") AS rn FROM posts_labeled)
        WHERE rn <= round_even((SELECT count(*) FROM posts_labeled) * CAST(0.5 AS DOUBLE), 0)""",
    "fold_sizes": with_views("posts_labeled") + _FOLDS + """
        SELECT CAST(f.fold_id AS INTEGER) AS fold_id, CASE WHEN folds.fold = f.fold_id THEN 'validation' ELSE 'train' END AS part,
               label, count(*) AS n
        FROM folds CROSS JOIN (SELECT range AS fold_id FROM range(0, 5)) f GROUP BY ALL""",
    "weighted_vote": with_views("predictions") + _VALID + f"""
        SELECT "index", label, {_vote(VOTE_WEIGHTS)} AS predicted_label FROM wide""",
    "vote_lenient": with_views("predictions") + f""",
        wide AS ({_wide('predictions')})
        SELECT "index", {_vote(LENIENT_WEIGHTS)} AS predicted_label,
               CAST({" + ".join(f"(CASE WHEN p{i} IS NOT NULL AND p{i} NOT IN ({', '.join(repr(c) for c in CL)}) THEN 1 ELSE 0 END)" for i in range(N_MODELS))} AS INTEGER) AS skipped_votes
        FROM wide""",
    "grid_search": with_views("predictions") + _GRID + """
        SELECT fold, gi, round(weight_0, 6) AS weight_0, round(wf, 6) AS weighted_f1 FROM grid""",
    "best_weight": with_views("predictions") + _GRID + """
        SELECT fold, round(weight_0, 6) AS best_weight, round(wf, 6) AS best_f1 FROM (
          SELECT *, row_number() OVER (PARTITION BY fold ORDER BY wf DESC, gi) AS rn FROM grid) WHERE rn = 1""",
    "average_grid": with_views("predictions") + _GRID + """
        SELECT gi, round(weight_0, 6) AS weight_0, round(avg(wf), 6) AS weighted_f1, count(*) AS n_folds
        FROM grid GROUP BY gi, weight_0""",
    "unanimous": with_views("predictions") + _UNAN + " SELECT * FROM unan",
    "agreement_rate": with_views("predictions") + _UNAN + """
        SELECT (SELECT count(*) FROM unan) AS n_unanimous,
               (SELECT count(*) FROM predictions WHERE model = 0) AS n_total,
               round((SELECT count(*) FROM unan) / (SELECT count(*) FROM predictions WHERE model = 0), 6) AS agreement""",
    "assemble": with_views("predictions") + _FOLDS + _UNAN + _HALF + """
        SELECT "index", label, 'labeled' AS source FROM train
        UNION ALL SELECT "index", predicted_label, 'pseudo' FROM unan""",
    "assemble_half": with_views("predictions") + _FOLDS + _UNAN + _HALF + """
        SELECT "index", label, 'labeled' AS source FROM train
        UNION ALL SELECT "index", predicted_label, 'pseudo' FROM half""",
    "size_report": with_views("predictions") + _FOLDS + _UNAN + _HALF + """
        SELECT 'train' AS stage, count(*) AS n FROM train
        UNION ALL SELECT 'pseudo', count(*) FROM unan
        UNION ALL SELECT 'pseudo_half', count(*) FROM half
        UNION ALL SELECT 'combined', (SELECT count(*) FROM train) + (SELECT count(*) FROM unan)
        UNION ALL SELECT 'combined_half', (SELECT count(*) FROM train) + (SELECT count(*) FROM half)""",
    "size_report_folds": with_views("predictions") + _FOLDS + _UNAN + """,
        per AS (SELECT CAST(f.fold_id AS INTEGER) AS fold_id, count(*) FILTER (WHERE folds.fold <> f.fold_id) AS n_train,
                       count(*) FILTER (WHERE folds.fold = f.fold_id) AS n_validation
                FROM folds CROSS JOIN (SELECT range AS fold_id FROM range(0, 5)) f GROUP BY f.fold_id),
        pc AS (SELECT fold_id, CAST(n_train AS DOUBLE) AS n_train, CAST(n_validation AS DOUBLE) AS n_validation,
                      CAST(n_train + (SELECT count(*) FROM unan) AS DOUBLE) AS n_combined FROM per)
        SELECT fold_id, round(n_train, 6) AS n_train, round(n_validation, 6) AS n_validation, round(n_combined, 6) AS n_combined FROM pc
        UNION ALL SELECT -1, round(avg(n_train), 6), round(avg(n_validation), 6), round(avg(n_combined), 6) FROM pc""",
    "confidence_filter": with_views("logits") + """,
        p AS (SELECT "index", logits, list_max(logits) AS m FROM logits),
        e AS (SELECT "index", [exp(logits[1] - m), exp(logits[2] - m), exp(logits[3] - m), exp(logits[4] - m)] AS ex FROM p),
        pr AS (SELECT "index", list_max(list_transform(ex, lambda x: x / (ex[1] + ex[2] + ex[3] + ex[4]))) AS mp FROM e)
        SELECT "index", round(mp, 6) AS max_prob FROM pr WHERE mp >= 0.3""",
}
