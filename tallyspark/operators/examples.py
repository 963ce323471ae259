"""Example extraction (WIN2, PRJ6, TXT9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_correct(df: DataFrame, true_col: str = "label", pred_col: str = "predicted_label") -> DataFrame:
    """``correct`` = (true == predicted) (PRJ6)."""
    return df.withColumn("correct", F.coalesce(F.col(true_col) == F.col(pred_col), F.lit(False)))


def top_n(df: DataFrame, n: int = 2, class_col: str = "label", order_col: str = "index",
          failures_only: bool = False, group_cols: Sequence[str] = ()) -> DataFrame:
    """First ``n`` correct and ``n`` incorrect rows per true class in ``order_col`` order (WIN2),
    of each group (e.g. each model).

    ``row_number() <= n`` is planned with a window group limit: each task keeps
    at most n rows per (class, correct) before the shuffle, so a huge class
    costs one bounded partial sort per task, not one giant sorted group.
    """
    x = with_correct(df, class_col) if "correct" not in df.columns else df
    if failures_only:
        x = x.where(~F.col("correct"))
    w = Window.partitionBy(*group_cols, class_col, "correct").orderBy(order_col)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def render(df: DataFrame, text_col: str = "post", true_col: str = "label", pred_col: str = "predicted_label",
           reasoning_col: str | None = None) -> DataFrame:
    """One text block per example (TXT9)."""
    parts = [F.lit("Post: "), F.coalesce(F.col(text_col), F.lit("")), F.lit("\nTrue label: "), F.col(true_col),
             F.lit("\nPredicted label: "), F.col(pred_col)]
    if reasoning_col:
        parts += [F.lit("\nReasoning: "), F.coalesce(F.col(reasoning_col), F.lit(""))]
    return df.withColumn("text", F.concat(*parts, F.lit("\n")))
