"""Pseudo-labelling (PSL1-PSL4, FLT1, AGG11, AGG13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.splits import sample_exact


def unanimous(long_df: DataFrame, models: Sequence | int, key_col: str = "post", model_col: str = "model",
              label_col: str = "predicted_label", first_model=0, key_is_digest: bool = False) -> DataFrame:
    """Rows of the first model whose key got the same label from every model (PSL1).

    Grouping is on ``sha2(key, 256)`` (or on ``key_col`` itself when it already is
    a digest) so long texts are not shuffled; a key must be seen by all models with one
    non-null label. One mergeable aggregate a key: the least and the greatest label and a bit
    for each model of ``models``; if only their number is given, the set of models seen.
    """
    from tallyspark.operators.metrics import require_columns
    require_columns(long_df, [key_col, model_col, label_col])
    dig = F.col(key_col) if key_is_digest else F.sha2(F.col(key_col), 256)
    if isinstance(models, int) or len(models) > 63:
        n = models if isinstance(models, int) else len(models)
        all_seen = F.size(F.collect_set(model_col)) == n
    else:
        place = F.array_position(F.array(*[F.lit(m) for m in models]), F.col(model_col))
        bit = F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int")))
        all_seen = F.bit_or(bit) == (1 << len(models)) - 1
    one_label = (F.min(label_col) == F.max(label_col)) & (F.count(label_col) == F.count(F.lit(1)))
    ok = long_df.groupBy(dig.alias("_k")).agg((all_seen & one_label).alias("_ok")).where("_ok").select("_k")
    first = long_df.where(F.col(model_col) == first_model).withColumn("_k", dig)
    return first.join(ok, "_k", "left_semi").drop("_k")


def agreement_rate(subset: DataFrame, total: DataFrame) -> DataFrame:
    """Surviving rows / evaluated rows (AGG11), both counted as scalar subqueries."""
    n = subset.select(F.count(F.lit(1))).scalar()
    t = total.select(F.count(F.lit(1))).scalar()
    return subset.sparkSession.range(1).select(n.alias("n_unanimous"), t.alias("n_total"),
                                               F.coalesce(F.try_divide(n.cast("double"), t.cast("double")),
                                                          F.lit(0.0)).alias("agreement"))


def confidence_filter(df: DataFrame, threshold: float, probs_col: str | None = "probs",
                      prob_cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose top class probability is >= threshold (PRJ7 + FLT1)."""
    top = F.greatest(*[F.col(c) for c in prob_cols]) if prob_cols else F.array_max(F.col(probs_col))
    return df.withColumn("max_prob", top).where(F.col("max_prob") >= threshold)


def assemble(labeled: DataFrame, pseudo: DataFrame, fraction: float | None = None, seed: int = 42,
             label_col: str = "label", pseudo_label_col: str = "predicted_label",
             cols: Sequence[str] = ("index", "post")) -> DataFrame:
    """Labelled rows + (optionally an exact seeded sample of) pseudo-labelled rows (PSL2/PSL3)."""
    if fraction is not None:
        pseudo = sample_exact(pseudo, fraction, seed, cols[0])
    a = labeled.select(*cols, F.col(label_col).alias("label"), F.lit("labeled").alias("source"))
    b = pseudo.select(*cols, F.col(pseudo_label_col).alias("label"), F.lit("pseudo").alias("source"))
    return a.unionByName(b)


def size_report(tagged: dict[str, DataFrame], group_cols: Sequence[str] = (),
                combined: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Row counts per stage (and group), from one tagged union (AGG13).

    ``combined`` names unions of stages: their sizes are sums of the counts, nothing is read again.
    """
    parts = [df.select(*group_cols, F.lit(stage).alias("stage")) for stage, df in tagged.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    n = u.groupBy("stage", *group_cols).agg(F.count(F.lit(1)).alias("n"))
    if not combined:
        return n
    of = {stage: [stage, *[name for name, members in combined.items() if stage in members]] for stage in tagged}
    names = F.create_map(*[x for stage, all_ in of.items() for x in (F.lit(stage), F.array(*[F.lit(a) for a in all_]))])
    each = n.select(*group_cols, "n", F.explode(F.element_at(names, F.col("stage"))).alias("stage"))
    return each.groupBy("stage", *group_cols).agg(F.sum("n").alias("n"))
