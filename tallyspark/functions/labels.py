"""Label codecs and array math over probability / logit columns (LBL1-LBL11).

Every function returns a Column built from Catalyst expressions, so it stays in
whole-stage codegen. ``classes`` is always an ordered sequence of strings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default class vocabulary, in its natural (ordinal) order.
DEFAULT_CLASSES = ("indicator", "ideation", "behavior", "attempt")

# Sentinel labels that share the label column with real classes.
LABEL_NOT_FOUND = "LABEL_NOT_FOUND"
API_ERROR = "API_ERROR"
CONTENT_BLOCKED = "CONTENT_BLOCKED"
NO_CONTENT = "NO_CONTENT"
NO_CANDIDATES = "NO_CANDIDATES"
UNKNOWN_ERROR = "UNKNOWN_ERROR"
API_ERROR_OR_EXTRACTION_FAILED = "API_ERROR_OR_EXTRACTION_FAILED"
SENTINELS = (LABEL_NOT_FOUND, API_ERROR, CONTENT_BLOCKED, NO_CONTENT, NO_CANDIDATES,
             UNKNOWN_ERROR, API_ERROR_OR_EXTRACTION_FAILED)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classes_array(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def encode(col: str | Column, classes: Sequence[str] = DEFAULT_CLASSES, strict: bool = True) -> Column:
    """label -> 0-based class index (LBL1/LBL2). Unknown: error when strict, else -1."""
    pos = F.array_position(classes_array(classes), _c(col)).cast("int") - 1
    if not strict:
        return F.when(_c(col).isNull(), F.lit(-1)).otherwise(pos)
    return F.when(pos >= 0, pos).otherwise(
        F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(_c(col).cast("string"), F.lit("NULL")))))


def decode(col: str | Column, classes: Sequence[str] = DEFAULT_CLASSES) -> Column:
    """0-based class index -> label (LBL3); out of range -> NULL."""
    i = _c(col).cast("int")
    return F.when((i >= 0) & (i < len(classes)), F.element_at(classes_array(classes), i + 1))


def ordinal_encode(index_col: str | Column, n_classes: int) -> Column:
    """Cumulative encoding (LBL4): class k of K -> K-1 doubles whose first k are 1.0."""
    k = _c(index_col)
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 2)),
                       lambda i: F.when(i < k, F.lit(1.0)).otherwise(F.lit(0.0)))


def ordinal_decode(vec_col: str | Column) -> Column:
    """Ordinal vector -> scalar class (LBL5): the sum of the vector."""
    return F.aggregate(_c(vec_col), F.lit(0.0), lambda acc, x: acc + x)


def ordinal_predict(logits_col: str | Column) -> Column:
    """Ordinal logits -> class (LBL6): number of thresholds with sigmoid(z) > 0.5, i.e. z > 0."""
    return F.size(F.filter(_c(logits_col), lambda z: z > 0)).cast("int")


def softmax(logits_col: str | Column) -> Column:
    """Max-shifted softmax over an array column (LBL7)."""
    z = _c(logits_col)
    m = F.array_max(z)
    ex = F.transform(z, lambda x: F.exp(x - m))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def with_softmax(df: DataFrame, logits_col: str, out_col: str = "probs") -> DataFrame:
    """``df`` + ``out_col`` = softmax(logits), with the row max and the exponentials
    projected once as columns (the lambdas then read columns, not recomputed
    sub-expressions), which matters for wide class vocabularies."""
    x = df.withColumn("_sm_m", F.array_max(F.col(logits_col)))
    x = x.withColumn("_sm_e", F.transform(F.col(logits_col), lambda v: F.exp(v - F.col("_sm_m"))))
    x = x.withColumn("_sm_t", F.aggregate(F.col("_sm_e"), F.lit(0.0), lambda acc, v: acc + v))
    return x.withColumn(out_col, F.transform(F.col("_sm_e"), lambda v: v / F.col("_sm_t"))).drop(
        "_sm_m", "_sm_e", "_sm_t")


def argmax(arr_col: str | Column) -> Column:
    """0-based position of the first maximum (LBL8)."""
    a = _c(arr_col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def expand_probs(df: DataFrame, probs_col: str, classes: Sequence[str] = DEFAULT_CLASSES,
                 prefix: str = "prob_") -> DataFrame:
    """Probability array -> one ``prob_<class>`` column per class (LBL9)."""
    cols = [F.element_at(F.col(probs_col), i + 1).alias(f"{prefix}{c}") for i, c in enumerate(classes)]
    return df.select("*", *cols)


def normalize(col: str | Column) -> Column:
    """Lower-case string label; NULL becomes 'nan' like a pandas str-cast (LBL10)."""
    return F.lower(F.coalesce(_c(col).cast("string"), F.lit("nan")))


def is_sentinel(col: str | Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    return _c(col).isin(list(sentinels))


def status(col: str | Column) -> Column:
    """Outcome status of a predicted label: 'ok' or the lower-cased sentinel."""
    c = _c(col)
    expr = F.when(c.isNull(), F.lit("missing"))
    for s in SENTINELS:
        expr = expr.when(c == s, F.lit(s.lower()))
    return expr.otherwise(F.lit("ok"))


def vocabulary(df: DataFrame, true_col: str, pred_col: str) -> DataFrame:
    """Sorted label vocabulary = distinct(true ∪ pred) with a 0-based code (LBL11).

    The distinct set is small (labels), so a rank over it is cheap.
    """
    from pyspark.sql import Window
    labels = (df.select(F.explode(F.array(F.col(true_col).cast("string"), F.col(pred_col).cast("string"))).alias("label"))
              .where(F.col("label").isNotNull()).distinct())
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))
