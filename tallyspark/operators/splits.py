"""Deterministic splits and samples (SPL1-SPL4).

Randomness is a pure function of ``md5('<seed>-<id>')`` so every engine and
every rerun agrees. Ranks are exact but never ordered per whole class: rows are
ranked inside (class, md5-prefix bucket) and shifted by the bucket's offset
(``operators.windows.exact_row_number``), so a class holding a third of the data
is spread over 4096 buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.windows import exact_row_number, hash_bucket

BUCKET_BITS = 20  # up to ~1M rank buckets per class: bounded window partitions at 1e12 rows


def seeded_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def _class_offsets(counts: DataFrame, label_col: str, classes: Sequence[str] | None) -> DataFrame:
    """Per-class size and start offset in class order, from the bucket count table
    (one row per class: tiny and bounded by the vocabulary)."""
    per = counts.groupBy(label_col).agg(F.sum("_rk_n").alias("_n"))
    if classes:
        pos = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label_col)),
                         F.lit(len(classes) + 1))
        per = per.withColumn("_cpos", pos)
    else:
        per = per.withColumn("_cpos", F.lit(0))
    w = Window.orderBy("_cpos", label_col).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("_coff", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def class_ranks(df: DataFrame, label_col: str = "label", id_col: str = "index", seed: int = 42):
    """(ranked, counts): ``_rn`` = 1-based rank inside the class by md5(seed-id), ties by id."""
    x = df.withColumn("_key", seeded_key(id_col, seed))
    return exact_row_number(x, [label_col], [F.col("_key"), F.col(id_col)], hash_bucket(F.col("_key"), BUCKET_BITS),
                            "_rn", return_counts=True)


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label_col: str = "label", id_col: str = "index",
                     classes: Sequence[str] | None = None) -> DataFrame:
    """Adds ``fold`` in [0, k): per-class fold sizes differ by <= 1 and fold totals are balanced (SPL1).

    position = (rows of earlier classes) + rank in class - 1; fold = position mod k,
    i.e. one round-robin deal over the class-ordered, hash-shuffled rows.
    """
    ranked, counts = class_ranks(df, label_col, id_col, seed)
    ct = _class_offsets(counts, label_col, classes).select(label_col, "_coff")  # one row per class
    r = ranked.join(F.broadcast(ct) if classes else ct, label_col, "left")  # a vocabulary that isn't given has no bound
    return r.withColumn("fold", ((F.col("_coff") + F.col("_rn") - 1) % k).cast("int")).drop("_key", "_rn", "_coff")


def stratified_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, label_col: str = "label",
                     id_col: str = "index") -> DataFrame:
    """Adds ``split`` = 'test' for the first round(fraction * n_class) rows of each class (SPL2)."""
    x = df.withColumn("_key", seeded_key(id_col, seed))
    r = exact_row_number(x, [label_col], [F.col("_key"), F.col(id_col)], hash_bucket(F.col("_key"), BUCKET_BITS),
                         "_rn", total_col="_n")
    test = F.col("_rn") <= F.round(F.col("_n") * F.lit(test_fraction))
    return r.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop("_key", "_rn", "_n")


def sample_exact(df: DataFrame, fraction: float, seed: int = 42, id_col: str = "index") -> DataFrame:
    """Exactly round(fraction * n) rows without replacement, chosen by md5(seed-id) (SPL4).

    round() is half-to-even like the source's sampler. The global rank is
    bucketed by hash prefix, so no single task sorts the table; n is summed over
    the small bucket-count table that the rank already builds (no second scan).
    """
    x = df.withColumn("_key", seeded_key(id_col, seed))
    r = exact_row_number(x, [], [F.col("_key"), F.col(id_col)], hash_bucket(F.col("_key"), BUCKET_BITS),
                         "_rn", total_col="_n")
    return r.where(F.col("_rn") <= F.bround(F.col("_n") * F.lit(fraction))).drop("_key", "_rn", "_n")


def sample_approx(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample (``DataFrame.sample``) when an exact count is not required."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def fold_tables(df: DataFrame, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Every row tagged for each fold f as 'validation' (fold == f) or 'train' (SPL3).

    Returns the long (fold_id, part, row...) table; write it with
    ``partitionBy('fold_id', 'part')`` to materialise the k train/validation pairs.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold_id")
    x = df.select("*", parts)
    return x.withColumn("part", F.when(F.col(fold_col) == F.col("fold_id"), F.lit("validation")).otherwise(F.lit("train")))


def write_fold_tables(df: DataFrame, path: str, k: int = 5, fold_col: str = "fold",
                      classes: Sequence[str] | None = None, label_col: str = "label") -> None:
    """Materialise the k train/validation pairs as ``fold_id=<f>/part=<train|validation>``
    folders (SPL3); integer labels are decoded to names when ``classes`` is given."""
    t = fold_tables(df, k, fold_col)
    if classes is not None and dict(df.dtypes).get(label_col) in ("int", "bigint"):
        t = t.withColumn(label_col, F.element_at(F.array(*[F.lit(c) for c in classes]), F.col(label_col).cast("int") + 1))
    t.write.mode("overwrite").partitionBy("fold_id", "part").parquet(path)


def fold_distribution(df: DataFrame, k: int = 5, label_col: str = "label", fold_col: str = "fold") -> DataFrame:
    """Class counts of every fold's train and validation part (SPL3 print-out as a table)."""
    base = df.groupBy(fold_col, label_col).agg(F.count(F.lit(1)).alias("_n"))
    t = fold_tables(base, k, fold_col)
    return t.groupBy("fold_id", "part", label_col).agg(F.sum("_n").cast("long").alias("n"))
