"""Prompt rendering (TXT4, TXT5). Templates are user data with one ``{}`` hole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOLE = "{}"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fill_first_hole(template: Column, value: Column) -> Column:
    """Replace the first ``{}`` of a per-row template (exact even if ``value`` contains braces)."""
    pos = F.instr(template, HOLE)
    return F.when(pos > 0, F.concat(template.substr(F.lit(1), pos - 1), value,
                                    template.substr(pos + len(HOLE), F.lit(1 << 30)))).otherwise(template)


def render(df: DataFrame, prompts: DataFrame, text_col: str = "post", style_col: str = "style",
           thinking_col: str = "thinking", out_col: str = "prompt") -> DataFrame:
    """Render a prompt per row from a (style, thinking) -> template table (TXT4).

    A plain join: Spark brings the template table (styles x flag) to the posts. A row whose (style, thinking) pair has no
    template fails the job, like the source's KeyError.
    """
    right = prompts.select(F.col("style").alias(style_col), F.col("thinking").alias(thinking_col), "template")
    j = df.join(right, [style_col, thinking_col], "left")
    missing = F.raise_error(F.concat(F.lit("no prompt template for style="), F.col(style_col).cast("string"),
                                     F.lit(", thinking="), F.col(thinking_col).cast("string")))
    rendered = F.when(F.col("template").isNull(), missing).otherwise(fill_first_hole(F.col("template"), _c(text_col)))
    return j.withColumn(out_col, rendered).drop("template")


def render_training(template: str, text: str | Column, label: str | Column, eos: str = "") -> Column:
    """``template.format(text, label)`` plus ``eos`` unless already suffixed (TXT5)."""
    parts = template.split(HOLE)
    if len(parts) != 3:
        raise ValueError("training template needs exactly two '{}' holes")
    body = F.concat(F.lit(parts[0]), _c(text), F.lit(parts[1]), _c(label), F.lit(parts[2]))
    if not eos:
        return body
    return F.when(body.endswith(F.lit(eos)), body).otherwise(F.concat(body, F.lit(eos)))
