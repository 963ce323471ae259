"""Writers (SNK1-SNK6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.operators.prep import flatten_text


def _flat_checked(col: str) -> Column:
    """Text with newlines flattened; NULL fails the job (as in the source writer)."""
    c = F.col(col)
    return F.when(c.isNull(), F.raise_error(F.lit(f"NULL in quoted column {col}"))).otherwise(
        flatten_text(c.cast("string")))


def write_posts_csv(df: DataFrame, path: str, quote_columns: Sequence[str] = ("post",), mode: str = "overwrite") -> None:
    """Post CSV (SNK1): text columns flattened to one line, quotes doubled by the writer.

    Spark's CSV writer quotes a field when it needs it (delimiter, quote), so
    the file parses to exactly the values of an always-quoted text column;
    leading/trailing whitespace is kept.
    """
    cols = [_flat_checked(c).alias(c) if c in quote_columns else F.col(c) for c in df.columns]
    (df.select(*cols).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Overwrite sink (SNK2); ``partition_by`` names the output folders (SNK6)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    else:
        w.format(fmt).save(path)


def append_predictions(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Incremental append sink (SNK3); readers de-duplicate on the key (see ``read_latest``)."""
    write_table(df, path, partition_by, "parquet", "append")


def write_text(df: DataFrame, col: str, path: str, mode: str = "overwrite") -> None:
    """One text line (block) per row (SNK5)."""
    df.select(F.col(col).cast("string")).write.mode(mode).text(path)


def report_text(report: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """Classification-report table as aligned text, one block per ``key`` (AGG7 display).

    ``report`` is ``metrics.classification_report`` output (row_label, row_order,
    precision, recall, f1_score, support); rows are ordered by ``row_order``.
    """
    w = F.greatest(F.max(F.length("row_label")).over(Window.partitionBy(key)), F.lit(len("weighted avg")))
    fnum = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", F.col(c)))
    x = report.withColumn("_w", w).withColumn(
        "_line", F.concat(F.when(F.col("row_label") == "accuracy", F.lit("\n")).otherwise(F.lit("")),
                          F.lpad("row_label", F.col("_w"), " "), F.lpad(fnum("precision"), 10, " "),
                          F.lpad(fnum("recall"), 10, " "), F.lpad(fnum("f1_score"), 10, " "),
                          F.lpad(F.col("support").cast("string"), 10, " ")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_order", "row_label", "_line"))), lambda r: r["_line"])
    g = x.groupBy(key).agg(lines.alias("_l"), F.first("_w").alias("_w"))
    header = F.concat(F.repeat(F.lit(" "), F.col("_w")), F.lpad(F.lit("precision"), 10, " "), F.lpad(F.lit("recall"), 10, " "),
                      F.lpad(F.lit("f1-score"), 10, " "), F.lpad(F.lit("support"), 10, " "))
    return g.select(key, F.concat_ws("\n", header, F.lit(""), F.array_join(F.col("_l"), "\n")).alias("report_text"))


def matrix_text(confusion: DataFrame, key: str, classes: Sequence[str]) -> DataFrame:
    """Dense confusion matrix as ``[[a, b], [c, d]]`` text with equal-width cells."""
    cls = F.array(*[F.lit(c) for c in classes])
    x = confusion.withColumn("_r", F.array_position(cls, F.col("true_label"))).withColumn(
        "_c", F.array_position(cls, F.col("predicted_label")))
    g = x.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_r", "_c", F.col("n").cast("string").alias("v")))).alias("_cells"),
                           F.max(F.length(F.col("n").cast("string"))).alias("_w"))
    k = len(classes)
    rows = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(
        F.lit("["), F.array_join(F.transform(F.slice(F.col("_cells"), i * k + 1, k), lambda c: F.lpad(c["v"], F.col("_w"), " ")), ", "),
        F.lit("]")))
    return g.select(key, F.concat(F.lit("["), F.array_join(rows, ",\n "), F.lit("]")).alias("matrix_text"))


def render_report(summary: DataFrame, per_class: DataFrame, confusion: DataFrame, key: str,
                  summary_cols: Sequence[str], report: DataFrame | None = None,
                  classes: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """One multi-section text report per ``key`` (SNK4): summary CSV (header + values),
    per-class CSV, optional classification-report text and the confusion matrix
    (as text when ``classes`` is given, else as cell lines)."""
    head = ",".join(summary_cols)
    vals = F.concat_ws(",", *[F.col(c).cast("string") for c in summary_cols])
    s = summary.select(key, F.concat_ws("\n", F.lit(head), vals).alias("_s"))
    pc_line = F.concat_ws(",", "label", F.col("f1").cast("string"), F.col("precision").cast("string"),
                          F.col("recall").cast("string"), F.col("support").cast("string"))
    pc = per_class.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("class_pos", pc_line.alias("l")))), lambda x: x["l"]), "\n").alias("_p"))
    if classes is not None:
        cm = matrix_text(confusion, key, classes).withColumnRenamed("matrix_text", "_c")
    else:
        cm_line = F.concat_ws(",", "true_label", "predicted_label", F.col("n").cast("string"))
        cm = confusion.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(cm_line)), "\n").alias("_c"))
    j = s.join(pc, key, "left").join(cm, key, "left")
    sections = ["_s", F.lit(""), F.lit("--- Per-Class Metrics ---"), F.lit("class,f1_score,precision,recall,support"), "_p"]
    if report is not None:
        j = j.join(report_text(report, key, digits).withColumnRenamed("report_text", "_t"), key, "left")
        sections += [F.lit(""), F.lit("--- Classification Report ---"), "_t"]
    sections += [F.lit(""), F.lit("--- Confusion Matrix ---"), "_c"]
    return j.select(key, F.concat_ws("\n", *sections).alias("report"))


def write_metrics_report(report: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    report.select(key, "report").write.mode(mode).partitionBy(key).text(path)


def write_metrics_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """The sections of a metrics report as tables (SNK4): ``<path>/<section>`` for each of them."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def read_metrics_tables(spark: SparkSession, path: str, sections: Sequence[str] = ("summary", "per_class", "matrix")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in sections}
