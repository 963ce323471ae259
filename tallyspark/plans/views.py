"""Driver tables -> the logical tables the operators consume (FIXTURES part B).

All derivations are integer arithmetic, ``md5`` or plain projections, so the
DuckDB oracle in ``plans.oracle`` can rebuild exactly the same rows. Every
view reads the driver's parquet files, so its size grows with the scale factor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES, classes_array

# Pseudo-model ids and their multipliers for the synthetic predictions.
MODEL_MULTS = ((0, 3), (1, 7), (2, 9), (3, 11), (4, 13))
# Classes of the large benchmark table (lineitem return flags).
LARGE_CLASSES = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def label_of(quality, toxic, classes: Sequence[str] = DEFAULT_CLASSES):
    return (F.when((toxic == 1) & (quality == 0), F.lit(classes[3]))
            .when(toxic == 1, F.lit(classes[2]))
            .when(quality == 0, F.lit(classes[1]))
            .otherwise(F.lit(classes[0])))


def posts_labeled(spark: SparkSession, sf_dir: str, classes: Sequence[str] = DEFAULT_CLASSES) -> DataFrame:
    """documents JOIN labels -> (index, post, label)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labs, "doc_id")
    return j.select(F.col("doc_id").alias("index"), F.col("text").alias("post"),
                    label_of(F.col("quality"), F.col("toxic"), classes).alias("label"))


def posts_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = table(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labs, "doc_id", "left_anti").select(F.col("doc_id").alias("index"), F.col("text").alias("post"))


def predictions(spark: SparkSession, sf_dir: str, classes: Sequence[str] = DEFAULT_CLASSES,
                with_post: bool = True, with_digest: bool = False) -> DataFrame:
    """Five pseudo-models over the labelled posts -> (model, index, [post,] [post_key,] label, predicted_label).

    The model axis is generated with ``explode`` of a literal array: no join.
    ``post_key`` = sha2(post) is computed once per post, before the model explode.
    """
    pl = posts_labeled(spark, sf_dir, classes)
    if with_digest:
        pl = pl.withColumn("post_key", F.sha2(F.col("post"), 256))
    if not with_post:
        pl = pl.drop("post")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("mult")) for m, k in MODEL_MULTS])
    x = pl.select("*", F.explode(models).alias("m")).select("*", "m.model", "m.mult").drop("m")
    idx, model, mult = F.col("index"), F.col("model"), F.col("mult")
    other = F.element_at(classes_array(classes), ((idx + model) % len(classes) + 1).cast("int"))
    pred = (F.when((idx * 7 + model * 13) % 97 == 0, F.lit("LABEL_NOT_FOUND"))
            .when((idx * mult + model) % 10 < 7, F.col("label"))
            .otherwise(other))
    cols = ["model", "index"] + (["post"] if with_post else []) + (["post_key"] if with_digest else []) + ["label"]
    return x.select(*cols, pred.alias("predicted_label"))


def predictions_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a large prediction table: true = l_returnflag, ~80% accurate."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    other = F.element_at(classes_array(LARGE_CLASSES), (F.col("l_partkey") % 3 + 1).cast("int"))
    pred = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 10 < 7, F.col("l_returnflag")).otherwise(other)
    return li.select("l_linestatus", F.col("l_returnflag").alias("label"), pred.alias("predicted_label"))


def raw_sheet(spark: SparkSession, sf_dir: str, classes: Sequence[str] = DEFAULT_CLASSES) -> DataFrame:
    """conversations as a block-structured sheet: id and label only on each block's first row.

    Positions leave room for 4096 turns a conversation.
    """
    cv = table(spark, sf_dir, "conversations")
    first = F.col("turn") == 0
    lab = F.element_at(classes_array(classes), (F.col("conv_id") % len(classes) + 1).cast("int"))
    return cv.select((F.col("conv_id") * 4096 + F.col("turn")).alias("row_pos"),
                     F.when(first, F.col("conv_id")).alias("idx"),
                     F.col("text").alias("title"),
                     F.when(first, lab).otherwise(F.lit("ignored")).alias("label"))


def raw_sheets(spark: SparkSession, sf_dir: str, classes: Sequence[str] = DEFAULT_CLASSES) -> DataFrame:
    """The same as two sheets (odd and even conversations), each with positions of its own.

    The first conversation of each sheet has no id: its rows belong to no block.
    """
    conv = F.floor(F.col("row_pos") / 4096)
    return raw_sheet(spark, sf_dir, classes).select("*", (conv % 2).cast("int").alias("sheet")).withColumn("idx", F.when(conv >= 2, F.col("idx")))


def logits(spark: SparkSession, sf_dir: str, k: int = 4) -> DataFrame:
    """embeddings -> (index, logits[k] DOUBLE, ord_logits[3], true_idx = label % 4)."""
    em = table(spark, sf_dir, "embeddings")
    def sums(n: int) -> Column:
        """n numbers from the whole vector: sums of the values whose position mod n is 0 to n - 1."""
        def one(r: int) -> Column:
            own = F.filter("embedding", lambda x, i: i % n == r)
            return F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double"))
        return F.array(*[one(r) for r in range(n)])
    return em.select(F.col("vec_id").alias("index"),
                     sums(k).alias("logits"),
                     sums(k - 1).alias("ord_logits"),
                     (F.col("label") % k).cast("int").alias("true_idx"))


def run_metrics(spark: SparkSession, sf_dir: str, fractional: bool = False) -> DataFrame:
    """events -> per (run, epoch) evaluation metrics, as closed forms of avg(value)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    g = ev.groupBy((F.col("user_id") % 5 + 1).cast("int").alias("run"),
                   (F.floor(F.col("event_id") / 100) + 1).alias("ep")).agg(
        F.max("event_id").alias("step"), F.avg("value").alias("v"))
    v = F.col("v")
    epoch = F.col("ep").cast("double")
    if fractional:
        epoch = epoch - F.lit(0.0093) * F.col("run")
    return g.select(
        "run", epoch.alias("epoch"), F.col("step").cast("long").alias("step"),
        (F.lit(10.0) / (v + 10)).alias("eval_loss"),
        (v / (v + 9)).alias("eval_accuracy"),
        (v / (v + 10)).alias("eval_f1_weighted"),
        (v / (v + 11)).alias("eval_precision_weighted"),
        (v / (v + 9)).alias("eval_recall_weighted"),
        (F.lit(12.0) / (v + 12)).alias("train_loss"),
        (F.lit(0.00005) / F.col("ep")).alias("learning_rate"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> heterogeneous trainer log rows: purchase and error are eval, the others train."""
    ev = table(spark, sf_dir, "events")
    is_eval = F.coalesce(F.col("event_type").isin("purchase", "error"), F.lit(False))
    return ev.select(
        (F.col("user_id") % 5).cast("int").alias("run"),
        F.col("event_id").alias("pos"),
        F.when(is_eval, F.lit("eval")).otherwise(F.lit("train")).alias("kind"),
        (F.col("event_id") / F.lit(50.0)).alias("epoch"),
        F.col("event_id").alias("step"),
        F.when(~is_eval, F.col("value")).alias("loss"),
        F.when(~is_eval, F.col("value") / 1000.0).alias("learning_rate"),
        F.when(is_eval, F.col("value")).alias("eval_loss"),
        F.when(is_eval, F.col("value") / (F.col("value") + 10)).alias("eval_f1_weighted"),
    )


# The eight response shapes used to exercise the label-extraction cascade.
RESPONSE_SHAPES = (
    "Final Classification: {L}",
    "<thinking>attempt?</thinking> {L}",
    "The post is classified as: {L}",
    "{L}s",
    "no explicit mention",
    "none of these",
    "not attempt but ideation",
    "\n  {L} \t",
)


def responses(spark: SparkSession, sf_dir: str, classes: Sequence[str] = DEFAULT_CLASSES) -> DataFrame:
    """Predictions of all models -> free-text responses + provider finish state.

    ``index`` tells the models' rows apart: 5 x post + model. Some rows have an error, some
    neither finish reason nor parts.
    """
    p = predictions(spark, sf_dir, classes, with_post=False).withColumn("index", F.col("index") * len(MODEL_MULTS) + F.col("model"))
    silent = F.col("index") % 17 == 0
    shapes = F.array(*[F.lit(s) for s in RESPONSE_SHAPES])
    shape = F.element_at(shapes, (F.col("index") % 8 + 1).cast("int"))
    return p.select(
        "index", "label",
        F.replace(shape, F.lit("{L}"), F.col("label")).alias("response"),
        F.when(~silent, (F.floor(F.col("index") / 3) % 5).cast("int")).alias("finish_reason"),
        F.when(~silent, F.col("index") % 11 != 0).alias("has_parts"),
        F.when(F.col("index") % 13 == 0, F.lit("timeout")).alias("error"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key"))
