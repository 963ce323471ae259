"""Registered queries: Spark ML fits (ML1-ML3, PSL4).

What a model predicts can't be computed in SQL. The ``_checks`` queries hold what can: which rows a
fit must give, each once and in its own fold, with probabilities of all classes that sum to 1.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.operators import pseudolabel as PS
from tallyspark.operators import splits as SP
from tallyspark.operators import training as TR
from tallyspark.plans import views as V
from tallyspark.plans.common import round_doubles
from tallyspark.plans.q_ensemble import _FOLDS
from tallyspark.plans.sqlviews import with_views
from tallyspark.session import scratch_path

CL = DEFAULT_CLASSES
MODULI = (5, 6, 7)  # of the SQL-computable models of the unanimity rounds
ROUNDS = 3


def _with_folds(spark: SparkSession, d: str) -> DataFrame:
    return SP.stratified_kfold(V.posts_labeled(spark, d), 5, 42, "label", "index", CL)


def _checked(pred: DataFrame, *keep: str) -> DataFrame:
    """Per row: how often its id was predicted, and whether the prediction is a whole distribution."""
    probs = F.col("probs")
    total = F.aggregate(probs, F.lit(0.0), lambda a, x: a + x)
    best = F.element_at(F.array(*[F.lit(c) for c in CL]), F.array_position(probs, F.array_max(probs)).cast("int"))
    ok = (F.abs(total - 1) < 1e-9) & (F.size(probs) == len(CL)) & F.forall(probs, lambda x: x >= 0)
    return pred.groupBy("index", *keep).agg(F.count(F.lit(1)).alias("n_predictions"), F.bool_and(ok).alias("is_distribution"),
                                            F.bool_and(best == F.col("predicted_label")).alias("label_is_likeliest"))


def kfold_fit_predict(spark: SparkSession, d: str) -> DataFrame:
    out = TR.kfold_fit_predict(_with_folds(spark, d), 5, "fold", CL, "label")
    return out.select("index", "fold", "label", "predicted_label")


def kfold_checks(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions: each id once, in its own fold."""
    return _checked(TR.kfold_fit_predict(_with_folds(spark, d), 5, "fold", CL, "label"), "fold", "label")


def kfold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Weighted metrics of each fold."""
    return round_doubles(TR.fold_metrics(TR.kfold_fit_predict(_with_folds(spark, d), 5, "fold", CL, "label"), CL))


def final_fit(spark: SparkSession, d: str) -> DataFrame:
    """The number of iterations that is best over the folds, then the final fit with it (ML1, ML2)."""
    n = TR.best_iterations(TR.kfold_log(_with_folds(spark, d), (5, 20), 5, "fold", CL))
    out = TR.fit_all(V.posts_labeled(spark, d), V.posts_unlabeled(spark, d), CL, max_iter=n)
    return out.select("index", "predicted_label", F.lit(n).alias("iterations"))


def fit_all(spark: SparkSession, d: str) -> DataFrame:
    return TR.fit_all(V.posts_labeled(spark, d), V.posts_unlabeled(spark, d), CL).select("index", "predicted_label")


def fit_all_checks(spark: SparkSession, d: str) -> DataFrame:
    """The final fit scores every unlabelled id once."""
    return _checked(TR.fit_all(V.posts_labeled(spark, d), V.posts_unlabeled(spark, d), CL))


def fit_eval_checks(spark: SparkSession, d: str) -> DataFrame:
    """A refit on the other folds and unanimous pseudo-labels predicts each id of fold 0 once."""
    folds = _with_folds(spark, d)
    un = PS.unanimous(V.predictions(spark, d), [m for m, _ in V.MODEL_MULTS], "post")
    train = PS.assemble(folds.where("fold != 0"), un, cols=("index", "post")).select("index", "post", "label")
    return _checked(TR.fit_eval(train, folds.where("fold = 0"), CL, "label"), "label")


def pseudo_rounds(spark: SparkSession, d: str) -> DataFrame:
    return TR.pseudo_rounds(V.posts_labeled(spark, d), V.posts_unlabeled(spark, d), 2, 0.9, CL)


def pseudo_rounds_unanimous(spark: SparkSession, d: str) -> DataFrame:
    """Rounds by unanimity of three models, stopped after the first and gone on with."""
    path = scratch_path(spark, f"rounds/{uuid.uuid4().hex}")
    trainers = {f"mod{k}": TR.length_majority_trainer(k) for k in MODULI}
    for rounds in (1, ROUNDS):
        out = TR.run_rounds(V.posts_labeled(spark, d), V.posts_unlabeled(spark, d), trainers, path, rounds)
    return out.select(F.col("round").cast("int").alias("round"), "n_labeled", "n_pseudo", "n_train")


QUERIES = {"kfold_fit_predict": kfold_fit_predict, "kfold_checks": kfold_checks, "kfold_metrics": kfold_metrics, "final_fit": final_fit,
           "fit_all": fit_all, "fit_all_checks": fit_all_checks, "fit_eval_checks": fit_eval_checks,
           "pseudo_rounds": pseudo_rounds, "pseudo_rounds_unanimous": pseudo_rounds_unanimous}


def _round_sql(r: int) -> str:
    """CTEs of one round: each model's majority labels over t<r>, the agreed rows u<r>, the next t<r + 1>."""
    majority = ", ".join(f"""
        m{r}_{k} AS (SELECT b, arg_min(label, (-n, label)) AS p FROM (
            SELECT length(post) % {k} AS b, label, count(*) AS n FROM t{r} GROUP BY ALL) GROUP BY b)""" for k in MODULI)
    joins = " ".join(f"JOIN m{r}_{k} ON m{r}_{k}.b = length(post) % {k}" for k in MODULI)
    same = " AND ".join(f"m{r}_{k}.p = m{r}_{MODULI[0]}.p" for k in MODULI[1:])
    return f"""{majority},
        u{r} AS (SELECT "index", post, m{r}_{MODULI[0]}.p AS label FROM posts_unlabeled {joins} WHERE {same}),
        t{r + 1} AS (SELECT "index", post, label FROM posts_labeled UNION ALL SELECT * FROM u{r})"""


_ONCE = "1::BIGINT AS n_predictions, true AS is_distribution, true AS label_is_likeliest"
SQL: dict[str, str] = {
    "kfold_checks": with_views("posts_labeled") + _FOLDS + f' SELECT "index", fold, label, {_ONCE} FROM folds',
    "fit_all_checks": with_views("posts_unlabeled") + f' SELECT "index", {_ONCE} FROM posts_unlabeled',
    "fit_eval_checks": with_views("posts_labeled") + _FOLDS + f' SELECT "index", label, {_ONCE} FROM folds WHERE fold = 0',
    "pseudo_rounds_unanimous": with_views("posts_labeled", "posts_unlabeled") + """,
        t1 AS (SELECT "index", post, label FROM posts_labeled),""" + ",".join(_round_sql(r) for r in range(1, ROUNDS + 1)) + " " + " UNION ALL ".join(
        f"SELECT {r} AS round, (SELECT count(*) FROM posts_labeled) AS n_labeled, (SELECT count(*) FROM u{r}) AS n_pseudo, (SELECT count(*) FROM t{r + 1}) AS n_train"
        for r in range(1, ROUNDS + 1)),
}
