"""Registered queries: remaining inventory items (AGG10, AGG12/JN9, AGG24, ENS6, LBL10/11, MTH1, WIN2
failures-only, SRC1-SRC3 / SNK1, SNK2, SNK6 round trips)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyspark.functions.labels import DEFAULT_CLASSES, encode, normalize, vocabulary
from tallyspark.operators import bootstrap as B
from tallyspark.operators import ensemble as EN
from tallyspark.operators import examples as X
from tallyspark.operators import metrics as M
from tallyspark.operators import runlogs as RL
from tallyspark.operators import splits as SPL
from tallyspark.plans import views as V
from tallyspark.plans.q_ensemble import _FOLDS, _VALID, _vote, _folds, _wide_valid
from tallyspark.plans.sqlkit import SENTINEL_SQL, metric_chain
from tallyspark.plans.sqlviews import with_views
from tallyspark.session import scratch_path
from tallyspark.sources import readers as RD
from tallyspark.sources import sinks as SK

CL = DEFAULT_CLASSES
# Per-model weight axes of the full (all-model) weight search.
AXES = ((0.0, 0.3, 0.75),) * 5


def _r(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def agreement_count(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    return M.agreement_count(p.where("model = 0"), p.where("model = 1"), "index", "predicted_label")


def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False).select(normalize("label").alias("t"), normalize("predicted_label").alias("p"))
    return vocabulary(p, "t", "p")


def evaluate_bundle(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d, with_post=False)
    return _r(M.summary(p, CL, "label", "predicted_label", ["model"], "union"))


def evaluate_rows(spark: SparkSession, d: str) -> DataFrame:
    """The whole bundle of every model: counts, shares, metrics and report."""
    return _r(M.evaluate_rows(V.predictions(spark, d, with_post=False), group_cols=["model"]).drop("place"))


def fold_tables_written(spark: SparkSession, d: str) -> DataFrame:
    """The train and validation tables of each fold, written with class numbers as names and read back."""
    path = scratch_path(spark, f"folds/{uuid.uuid4().hex}")
    folds = _folds(spark, d).select("index", "fold", encode("label", CL).alias("label"))
    SPL.write_fold_tables(folds, path, 5, "fold", CL)
    back = spark.read.parquet(path)
    return back.groupBy("fold_id", "part", "label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("index").alias("n_ids"),
                                                        F.min("index").alias("first_index"))


def common_ids_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Ids that every model labelled, of an allow-list (toxic posts)."""
    allow = V.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("index"))
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    return EN.common_ids(p, len(V.MODEL_MULTS), allow=allow)


def text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Example blocks of all models through the text sink, read back line by line."""
    path = scratch_path(spark, f"text/{uuid.uuid4().hex}")
    p = M.exclude_status(V.predictions(spark, d))
    SK.write_text(X.render(X.top_n(p, 2, "label", "index", group_cols=["model"])), "text", path)
    lines = spark.read.text(path, lineSep="\n").where("value != ''")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def encode_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Codes under a vocabulary that lacks labels: -1 for these and for null (LBL2)."""
    p = V.predictions(spark, d, with_post=False)
    return p.select("model", "index", encode("predicted_label", CL[:2], strict=False).alias("code"))


def posts_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The three kinds of post tables, written and loaded by name (SRC1, SNK1); large files may be split."""
    root = scratch_path(spark, f"kinds/{uuid.uuid4().hex}")
    labeled = V.posts_labeled(spark, d)
    for kind, rows in (("validation", labeled), ("test", labeled.where("index % 3 = 0")), ("unlabeled", V.posts_unlabeled(spark, d))):
        SK.write_posts_csv(rows, f"{root}/{RD.KIND_FILES[kind]}.csv", ["post"])
    out = None
    for kind in RD.KIND_FILES:
        one = RD.load_posts(spark, kind, root, multi_line=False)
        one = one.select(F.lit(kind).alias("kind"), "index", F.length("post").alias("n_chars"), (F.col("label") if "label" in one.columns else F.lit(None).cast("string")).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def pct_change(spark: SparkSession, d: str) -> DataFrame:
    rs = RL.range_stats(V.run_metrics(spark, d), 10, 90)
    base = rs.where(F.col("run") == 1).select(F.first("mean_f1")).scalar()
    return _r(rs.select("run", "mean_f1", RL.pct_change(F.col("mean_f1"), base, 4).alias("pct_vs_run1")))


def examples_failures(spark: SparkSession, d: str) -> DataFrame:
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    return X.top_n(p, 5, "label", "index", failures_only=True, group_cols=["model"]).select("model", "label", "rank", "index", "predicted_label")


def grid_search_full(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide_valid(spark, d).join(_folds(spark, d).select("index", "fold"), "index")
    return _r(EN.grid_search_axes(wide, AXES, CL, "label", ["fold"]))


def bootstrap_evaluate(spark: SparkSession, d: str) -> DataFrame:
    p = M.exclude_status(V.predictions(spark, d, with_post=False))
    return B.evaluate(p, 1000, 42, "label", "predicted_label", ["model"], "true", 100.0)


def posts_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    SK.write_posts_csv(V.posts_labeled(spark, d), f"{root}/posts_with_labels.csv", ["post"])
    return RD.load_posts(spark, "validation", root, "csv")


def predictions_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, f"preds/{uuid.uuid4().hex}")
    p = V.predictions(spark, d, with_post=False).withColumnRenamed("label", "true_label_str")
    SK.write_table(p, root, partition_by=["model"])
    schema = StructType([StructField("index", LongType()), StructField("true_label_str", StringType()),
                         StructField("predicted_label", StringType())])
    long = RD.load_predictions(spark, {str(m): f"{root}/model={m}" for m, _ in V.MODEL_MULTS}, schema, "parquet")
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                     F.count_if(F.col("true_label_str") == F.col("predicted_label")).alias("n_correct"))


def run_logs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = scratch_path(spark, f"runlogs/{uuid.uuid4().hex}")
    m = V.run_metrics(spark, d)
    cols = [f.name for f in RD.RUN_METRICS.fields]
    SK.write_table(m.select("run", *[F.col(c).cast("double") for c in cols]), root, ["run"], "csv")
    logs = RD.load_run_logs(spark, f"{root}/*/*.csv", name_pattern=r"run=([0-9]+)/")
    return _r(logs.groupBy(F.col("run").cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("eval_f1_weighted").alias("mean_f1"), F.max("step").alias("max_step")))


def run_logs_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Logs of three layouts in one call: columns in another order, one more, one missing."""
    root = scratch_path(spark, f"runlogs/{uuid.uuid4().hex}")
    m = V.run_metrics(spark, d)
    cols = [F.col(f.name).cast("double").alias(f.name) for f in RD.RUN_METRICS.fields]
    layouts = {"run < 3": cols, "run = 3": [*cols[::-1], F.lit("x, \"y\"").alias("note")], "run > 3": cols[1:]}
    for k, (which, own) in enumerate(layouts.items()):
        SK.write_table(m.where(which).select("run", *own), f"{root}/layout{k}", ["run"], "csv")
    logs = RD.load_run_logs(spark, f"{root}/*/*/*.csv", name_pattern=[r"nothing=([0-9]+)/", r"run=([0-9]+)/"])
    return _r(logs.groupBy(F.col("run").cast("int").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("epoch").alias("mean_epoch"), F.avg("eval_f1_weighted").alias("mean_f1"), F.max("step").alias("max_step"),
        F.avg("train_loss").alias("mean_loss")))


def align_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Predictions whose ids come twice a model, in files and rows: the first one is taken (JN10)."""
    root = scratch_path(spark, f"twice/{uuid.uuid4().hex}")
    p = V.predictions(spark, d, with_post=False)
    late = p.withColumn("predicted_label", F.lit("late"))
    for k, part in enumerate((p.where("index % 3 > 0"), p.where("index % 3 < 2").withColumn("predicted_label", F.concat(F.lit("again "), "predicted_label")), late)):
        for m, _ in V.MODEL_MULTS:
            SK.write_table(part.where(F.col("model") == m).select("index", "predicted_label"), f"{root}/{m}/part{k}")
    schema = StructType([StructField("index", LongType()), StructField("predicted_label", StringType())])
    long = RD.load_predictions(spark, {str(m): f"{root}/{m}/*" for m, _ in V.MODEL_MULTS}, schema, "parquet", with_position=True)
    return EN.align(long, [str(m) for m, _ in V.MODEL_MULTS], order_col="source_pos")


def head_predictions(spark: SparkSession, d: str) -> DataFrame:
    """First rows by id (LIM1): a top-k report, planned as TakeOrderedAndProject."""
    p = V.predictions(spark, d, with_post=False).where("model = 0")
    return p.orderBy("index").limit(5).select("index", "label", "predicted_label")


def sorted_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics log in (run, epoch, step) order (SRT1/SRT2): a range-partitioned sort."""
    return _r(V.run_metrics(spark, d).orderBy("run", "epoch", "step").select("run", "epoch", "step", "eval_f1_weighted"))


def fit_eval(spark: SparkSession, d: str) -> DataFrame:
    """Refit on labelled train folds + unanimous pseudo-labels, evaluate on fold 0 (ML3)."""
    from tallyspark.operators import pseudolabel as PS
    from tallyspark.operators import training as TR
    from tallyspark.operators.splits import stratified_kfold
    pl = V.posts_labeled(spark, d)
    folds = stratified_kfold(pl, 5, 42, "label", "index", CL)
    un = PS.unanimous(V.predictions(spark, d), [m for m, _ in V.MODEL_MULTS], "post")
    train = PS.assemble(folds.where("fold != 0"), un, cols=("index", "post")).select("index", "post", "label")
    pred = TR.fit_eval(train, folds.where("fold = 0"), CL, "label")
    return _r(M.summary(pred, CL, "label", "predicted_label"))


QUERIES = {
    "head_predictions": head_predictions, "sorted_metrics": sorted_metrics, "fit_eval": fit_eval,
    "agreement_count": agreement_count, "label_vocabulary": label_vocabulary, "evaluate_bundle": evaluate_bundle,
    "pct_change": pct_change, "examples_failures": examples_failures, "grid_search_full": grid_search_full,
    "bootstrap_evaluate": bootstrap_evaluate, "posts_csv_roundtrip": posts_csv_roundtrip,
    "predictions_roundtrip": predictions_roundtrip, "run_logs_roundtrip": run_logs_roundtrip,
    "evaluate_rows": evaluate_rows, "fold_tables_written": fold_tables_written, "common_ids_allowed": common_ids_allowed,
    "text_roundtrip": text_roundtrip, "encode_lenient": encode_lenient, "posts_kinds": posts_kinds,
    "run_logs_mixed": run_logs_mixed, "align_first_wins": align_first_wins,
}

_AX = " CROSS JOIN ".join(f"(VALUES {', '.join(f'(CAST({v} AS DOUBLE))' for v in ax)}) a{i}(w{i})" for i, ax in enumerate(AXES))
_f1 = " + ".join(f"coalesce(2.0 * tp{i} / nullif(sup{i} + pn{i}, 0), 0.0) * sup{i}" for i in range(len(CL)))
_sups = " + ".join(f"sup{i}" for i in range(len(CL)))
_sums = ", ".join(f"sum(CASE WHEN label = '{c}' AND pred = '{c}' THEN cnt ELSE 0 END) AS tp{i}, "
                  f"sum(CASE WHEN label = '{c}' THEN cnt ELSE 0 END) AS sup{i}, "
                  f"sum(CASE WHEN pred = '{c}' THEN cnt ELSE 0 END) AS pn{i}" for i, c in enumerate(CL))
_W = [f"w{i}" for i in range(5)]

SQL = {
    "head_predictions": with_views("predictions") + """
        SELECT "index", label, predicted_label FROM predictions WHERE model = 0 ORDER BY "index" LIMIT 5""",
    "sorted_metrics": with_views("run_metrics") + """
        SELECT run, round(epoch, 6) AS epoch, step, round(eval_f1_weighted, 6) AS eval_f1_weighted
        FROM run_metrics ORDER BY run, epoch, step""",
    "agreement_count": with_views("predictions") + """
        SELECT count(*) AS n_common, count(*) FILTER (WHERE a.predicted_label = b.predicted_label) AS n_same
        FROM (SELECT * FROM predictions WHERE model = 0) a JOIN (SELECT * FROM predictions WHERE model = 1) b USING ("index")""",
    "label_vocabulary": with_views("predictions") + """
        SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM (
          SELECT DISTINCT lower(coalesce(x, 'nan')) AS label FROM (
            SELECT label AS x FROM predictions UNION ALL SELECT predicted_label FROM predictions))""",
    "evaluate_bundle": with_views("predictions") + ",\n" + metric_chain("predictions", "model", CL, "union") + """
        SELECT a.model, a.n, round(a.accuracy, 6) AS accuracy, round(v.f1_macro, 6) AS f1_macro,
               round(v.precision_macro, 6) AS precision_macro, round(v.recall_macro, 6) AS recall_macro,
               round(v.f1_weighted, 6) AS f1_weighted, round(v.precision_weighted, 6) AS precision_weighted,
               round(v.recall_weighted, 6) AS recall_weighted
        FROM acc a JOIN avg v USING (model)""",
    "evaluate_rows": with_views("predictions") + ",\n" + metric_chain("predictions", "model", CL, "union") + """,
        t AS (SELECT model, sum(support)::BIGINT AS s FROM per GROUP BY model)
        SELECT model, 'size' AS section, 'rows' AS name, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS value, count(*) AS n
        FROM predictions GROUP BY model
        UNION ALL SELECT model, 'class', label, NULL, NULL, round(support / s, 6), support FROM per JOIN t USING (model) WHERE support > 0
        UNION ALL SELECT model, 'metric', 'accuracy', NULL, NULL, round(accuracy, 6), n FROM acc
        UNION ALL SELECT model, 'metric', 'weighted_f1', NULL, NULL, round(f1_weighted, 6), s FROM avg JOIN t USING (model)
        UNION ALL SELECT model, 'metric', 'macro_f1', NULL, NULL, round(f1_macro, 6), s FROM avg JOIN t USING (model)
        UNION ALL SELECT model, 'report', label, round(precision, 6), round(recall, 6), round(f1, 6), support FROM per
        UNION ALL SELECT model, 'report', 'macro avg', round(precision_macro, 6), round(recall_macro, 6), round(f1_macro, 6), s FROM avg JOIN t USING (model)
        UNION ALL SELECT model, 'report', 'weighted avg', round(precision_weighted, 6), round(recall_weighted, 6), round(f1_weighted, 6), s FROM avg JOIN t USING (model)""",
    "fold_tables_written": with_views("posts_labeled") + _FOLDS + """
        SELECT f.k::INTEGER AS fold_id, CASE WHEN fold = f.k THEN 'validation' ELSE 'train' END AS part, label, count(*) AS n,
               count(DISTINCT "index") AS n_ids, min("index") AS first_index
        FROM folds CROSS JOIN (SELECT unnest(range(5)) AS k) f GROUP BY ALL""",
    "common_ids_allowed": with_views("predictions") + f"""
        SELECT "index" FROM predictions WHERE predicted_label NOT IN {SENTINEL_SQL} AND "index" IN (SELECT doc_id FROM labels WHERE toxic = 1)
        GROUP BY "index" HAVING count(DISTINCT model) = {len(V.MODEL_MULTS)}""",
    "text_roundtrip": with_views("predictions") + f""",
        ex AS (SELECT *, row_number() OVER (PARTITION BY model, label, label = predicted_label ORDER BY "index") AS rank
               FROM predictions WHERE predicted_label NOT IN {SENTINEL_SQL}),
        l AS (SELECT unnest(string_split('Post: ' || coalesce(post, '') || chr(10) || 'True label: ' || label || chr(10) || 'Predicted label: '
                     || predicted_label, chr(10))) AS line FROM ex WHERE rank <= 2)
        SELECT line, count(*) AS n FROM l WHERE line <> '' GROUP BY line""",
    "encode_lenient": with_views("predictions") + f"""
        SELECT model, "index", CAST(CASE predicted_label WHEN '{CL[0]}' THEN 0 WHEN '{CL[1]}' THEN 1 ELSE -1 END AS INTEGER) AS code FROM predictions""",
    "posts_kinds": with_views("posts_labeled", "posts_unlabeled") + """
        SELECT 'validation' AS kind, "index", CAST(length(post) AS INTEGER) AS n_chars, label FROM posts_labeled
        UNION ALL SELECT 'test', "index", CAST(length(post) AS INTEGER), label FROM posts_labeled WHERE "index" % 3 = 0
        UNION ALL SELECT 'unlabeled', "index", CAST(length(post) AS INTEGER), NULL FROM posts_unlabeled""",
    "pct_change": with_views("run_metrics") + """,
        rs AS (SELECT run, avg(eval_f1_weighted) AS mean_f1 FROM run_metrics WHERE epoch > 10 AND epoch < 90 GROUP BY run)
        SELECT run, round(mean_f1, 6) AS mean_f1,
               round(round((mean_f1 - (SELECT mean_f1 FROM rs WHERE run = 1)) / (SELECT mean_f1 FROM rs WHERE run = 1) * 100, 4), 6)
                 AS pct_vs_run1
        FROM rs""",
    "examples_failures": with_views("predictions") + f"""
        SELECT model, label, CAST(rank AS INTEGER) AS rank, "index", predicted_label FROM (
          SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY "index") AS rank
          FROM predictions WHERE predicted_label NOT IN {SENTINEL_SQL} AND label <> predicted_label)
        WHERE rank <= 5""",
    "grid_search_full": with_views("predictions") + _FOLDS + _VALID + f""",
        pat AS (SELECT f.fold, w.label, w.p0, w.p1, w.p2, w.p3, w.p4, count(*) AS cnt
                FROM wide w JOIN folds f USING ("index") GROUP BY ALL),
        gx AS (SELECT * FROM pat CROSS JOIN {_AX}),
        gy AS (SELECT *, {_vote(_W)} AS pred FROM gx),
        gper AS (SELECT fold, {", ".join(_W)}, {_sums} FROM gy GROUP BY ALL)
        SELECT fold, {", ".join(f"round({w}, 6) AS {w}" for w in _W)},
               round(coalesce((CAST(0.0 AS DOUBLE) + {_f1}) / nullif({_sups}, 0), 0.0), 6) AS weighted_f1 FROM gper""",
    "posts_csv_roundtrip": with_views("posts_labeled") + r"""
        SELECT "index", regexp_replace(post, '[\n\r]', ' ', 'g') AS post, label FROM posts_labeled""",
    "predictions_roundtrip": with_views("predictions") + """
        SELECT CAST(model AS VARCHAR) AS model, count(*) AS n, count(*) FILTER (WHERE label = predicted_label) AS n_correct
        FROM predictions GROUP BY model""",
    "run_logs_mixed": with_views("run_metrics") + """
        SELECT run, count(*) AS n, round(avg(CASE WHEN run <= 3 THEN epoch END), 6) AS mean_epoch, round(avg(eval_f1_weighted), 6) AS mean_f1,
               round(max(CAST(step AS DOUBLE)), 6) AS max_step, round(avg(train_loss), 6) AS mean_loss
        FROM run_metrics GROUP BY run""",
    "align_first_wins": with_views("predictions") + """,
        t AS (SELECT model, "index", CASE WHEN "index" % 3 > 0 THEN predicted_label ELSE 'again ' || predicted_label END AS p FROM predictions)
        SELECT "index", """ + ", ".join(f"max(p) FILTER (WHERE model = {m}) AS p{i}" for i, (m, _) in enumerate(V.MODEL_MULTS)) + """
        FROM t GROUP BY "index\"""",
    "run_logs_roundtrip": with_views("run_metrics") + """
        SELECT run, count(*) AS n, round(avg(eval_f1_weighted), 6) AS mean_f1, round(max(CAST(step AS DOUBLE)), 6) AS max_step
        FROM run_metrics GROUP BY run""",
}
