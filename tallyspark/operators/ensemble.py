"""Multi-model ensembles (JN1, JN5, JN10, ENS1-ENS6).

Predictions arrive in *long* form ``(model, id, label)`` instead of N tables
joined pairwise. One ``groupBy(id).pivot(model)`` aligns all models (one
shuffle), and the vote is a fixed-order expression per class, so float sums
are bit-identical on every run (Spark's ``sum`` order is not fixed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.labels import DEFAULT_CLASSES, classes_array


def common_ids(long_df: DataFrame, n_models: int, id_col: str = "index", model_col: str = "model",
               allow: DataFrame | None = None) -> DataFrame:
    """Ids present in all ``n_models`` models, optionally intersected with an allow-list (JN5/SET3)."""
    ids = long_df.groupBy(id_col).agg(F.count_distinct(model_col).alias("_m")).where(F.col("_m") == n_models).select(id_col)
    return ids.join(allow.select(id_col), id_col, "left_semi") if allow is not None else ids


def align(long_df: DataFrame, models: Sequence, id_col: str = "index", model_col: str = "model",
          pred_col: str = "predicted_label", order_col: str | None = None,
          carry: Sequence[str] = (), require_all: bool = False) -> DataFrame:
    """One row per id with ``p0..p{M-1}`` (JN1), in one aggregation (one shuffle).

    Duplicate rows of a model: the first in ``order_col`` wins (JN10). ``carry``
    columns are taken from the first model's row. ``require_all`` keeps only ids
    seen by every model (JN5), decided in the same aggregation.
    """
    order = F.col(order_col) if order_col else F.col(id_col)
    aggs = [F.min_by(F.when(F.col(model_col) == m, F.col(pred_col)), F.when(F.col(model_col) == m, order)).alias(f"p{i}")
            for i, m in enumerate(models)]
    first = models[0]
    aggs += [F.min_by(F.when(F.col(model_col) == first, F.col(c)), F.when(F.col(model_col) == first, order)).alias(c)
             for c in carry]
    if require_all:
        aggs += [F.max(F.when(F.col(model_col) == m, F.lit(1))).alias(f"_has{i}") for i, m in enumerate(models)]
    out = long_df.groupBy(id_col).agg(*aggs)
    if require_all:
        present = F.lit(True)
        for i in range(len(models)):
            present = present & F.col(f"_has{i}").isNotNull()
        out = out.where(present).drop(*[f"_has{i}" for i in range(len(models))])
    return out


def vote_scores(weights: Sequence[float | Column], classes: Sequence[str] = DEFAULT_CLASSES) -> Column:
    """Array of per-class weighted votes over columns ``p0..``, summed in model order."""
    scores = []
    for c in classes:
        s: Column = F.lit(0.0)
        for i, w in enumerate(weights):
            wc = w if isinstance(w, Column) else F.lit(float(w))
            s = s + F.when(F.col(f"p{i}") == c, wc).otherwise(F.lit(0.0))
        scores.append(s)
    return F.array(*scores)


def vote_label(weights: Sequence[float | Column], classes: Sequence[str] = DEFAULT_CLASSES) -> Column:
    """argmax of the weighted votes, ties -> lowest class index (ENS1)."""
    sc = vote_scores(weights, classes)
    return F.element_at(classes_array(classes), F.array_position(sc, F.array_max(sc)).cast("int"))


def _unknown(n_models: int, classes: Sequence[str]) -> Column:
    bad = F.lit(False)
    for i in range(n_models):
        p = F.col(f"p{i}")
        bad = bad | (p.isNotNull() & ~p.isin(list(classes)))
    return bad


def weighted_vote(wide: DataFrame, weights: Sequence[float], classes: Sequence[str] = DEFAULT_CLASSES,
                  strict: bool = True) -> DataFrame:
    """Adds ``predicted_label`` (ENS1). strict: an unknown label fails the job;
    lenient (ENS2): unknown labels add no weight and ``skipped_votes`` counts them."""
    n = len(weights)
    pred = vote_label(weights, classes)
    if strict:
        pred = F.when(_unknown(n, classes), F.raise_error(F.lit("label not in class list"))).otherwise(pred)
        return wide.withColumn("predicted_label", pred)
    skipped = sum((F.when(F.col(f"p{i}").isNotNull() & ~F.col(f"p{i}").isin(list(classes)), 1).otherwise(0)
                   for i in range(n)), F.lit(0))
    return wide.withColumn("predicted_label", pred).withColumn("skipped_votes", skipped.cast("int"))


def _weighted_f1_fixed_order(classes: Sequence[str], tag: str = "") -> Column:
    """Support-weighted F1 from per-class integer sums, summed in class order."""
    num = F.lit(0.0)
    den = F.lit(0)
    for i in range(len(classes)):
        tp, sup, pn = F.col(f"tp{i}{tag}"), F.col(f"sup{i}{tag}"), F.col(f"pn{i}{tag}")
        f1 = F.coalesce(F.try_divide((2 * tp).cast("double"), (sup + pn).cast("double")), F.lit(0.0))
        num = num + f1 * sup
        den = den + sup
    return F.coalesce(F.try_divide(num, den.cast("double")), F.lit(0.0))


def grid_search(wide: DataFrame, fixed_weights: Sequence[float], n_steps: int, step: float,
                classes: Sequence[str] = DEFAULT_CLASSES, true_col: str = "label",
                group_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """Weighted F1 for model-0 weight ``w0 = i * step``, i < n_steps (ENS3), per group.

    Rows are first collapsed to distinct (group, true, p0..pM) patterns with a
    count; the grid is generated per pattern with ``explode(sequence)`` (no join),
    so the work is bounded by #patterns x #grid, independent of the row count.
    """
    g = list(group_cols)
    n = len(fixed_weights) + 1
    pcols = [f"p{i}" for i in range(n)]
    patterns = wide.groupBy(*g, true_col, *pcols).agg(F.count(F.lit(1)).alias("_cnt"))
    x = patterns.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("gi"))
    x = x.withColumn("weight_0", F.col("gi") * F.lit(float(step)))
    pred = vote_label([F.col("weight_0"), *fixed_weights], classes)
    x = x.withColumn("_pred", pred)
    aggs = []
    t, p, c = F.col(true_col), F.col("_pred"), F.col("_cnt")
    for i, cl in enumerate(classes):
        aggs += [F.sum(F.when((t == cl) & (p == cl), c).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(t == cl, c).otherwise(0)).alias(f"sup{i}"),
                 F.sum(F.when(p == cl, c).otherwise(0)).alias(f"pn{i}")]
    per = x.groupBy(*g, "gi", "weight_0").agg(*aggs)
    return per.select(*g, "gi", "weight_0", _weighted_f1_fixed_order(classes).alias("weighted_f1"))


def best_weight(grid: DataFrame, group_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """First grid point with the highest weighted F1 per group (ENS4)."""
    best = F.max_by(F.struct("weight_0", "weighted_f1"), F.struct(F.col("weighted_f1"), -F.col("gi")))
    return grid.groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, F.col("b.weight_0").alias("best_weight"),
                                                               F.col("b.weighted_f1").alias("best_f1"))


def average_grid(grid: DataFrame) -> DataFrame:
    """Mean curve over groups (folds) per grid point (ENS5); divides by the groups present."""
    return grid.groupBy("gi", "weight_0").agg(F.avg("weighted_f1").alias("weighted_f1"),
                                              F.count(F.lit(1)).alias("n_folds"))


def grid_search_axes(wide: DataFrame, axes: Sequence[Sequence[float]], classes: Sequence[str] = DEFAULT_CLASSES,
                     true_col: str = "label", group_cols: Sequence[str] = ("fold",)) -> DataFrame:
    """Weighted F1 for every combination of per-model weights (ENS6), per group.

    Same pattern collapse as ``grid_search``; the weight combinations are the
    product of the (parameter) axes, generated per pattern with nested explode.
    """
    g = list(group_cols)
    n = len(axes)
    pcols = [f"p{i}" for i in range(n)]
    x = wide.groupBy(*g, true_col, *pcols).agg(F.count(F.lit(1)).alias("_cnt"))
    for i, vals in enumerate(axes):
        x = x.select("*", F.explode(F.array(*[F.lit(float(v)) for v in vals])).alias(f"w{i}"))
    wcols = [f"w{i}" for i in range(n)]
    x = x.withColumn("_pred", vote_label([F.col(w) for w in wcols], classes))
    t, p, c = F.col(true_col), F.col("_pred"), F.col("_cnt")
    aggs = []
    for i, cl in enumerate(classes):
        aggs += [F.sum(F.when((t == cl) & (p == cl), c).otherwise(0)).alias(f"tp{i}"),
                 F.sum(F.when(t == cl, c).otherwise(0)).alias(f"sup{i}"),
                 F.sum(F.when(p == cl, c).otherwise(0)).alias(f"pn{i}")]
    per = x.groupBy(*g, *wcols).agg(*aggs)
    return per.select(*g, *wcols, _weighted_f1_fixed_order(classes).alias("weighted_f1"))


def grid_axes(spark, axes: Sequence[Sequence[float]]) -> DataFrame:
    """Full multi-weight search space (ENS6): the product of per-model weight axes,
    generated with nested ``explode`` (the axes are parameters, not data)."""
    df = spark.range(1).select()
    for i, vals in enumerate(axes):
        df = df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in vals])).alias(f"w{i}"))
    return df
