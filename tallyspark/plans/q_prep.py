"""Registered queries: ingestion and preparation (SRC5, WIN1, AGG22, PRJ2, PRJ3, PRJ5, JN2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import prep as P
from tallyspark.plans import views as V
from tallyspark.plans.sqlviews import with_views


def ffill_concat(spark: SparkSession, d: str) -> DataFrame:
    return P.ingest_sheet(V.raw_sheet(spark, d), "train_labeled")


def ffill_concat_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets read together, filled and assembled apart; rows before a sheet's first id have no block."""
    return P.ingest_sheet(V.raw_sheets(spark, d), "train_labeled", sheet_col="sheet")


def block_parts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as parts of at most four row positions."""
    return P.block_parts(P.forward_fill_blocks(V.raw_sheet(spark, d), chunk_rows=4), chunk_rows=4)


def shift_index(spark: SparkSession, d: str) -> DataFrame:
    labs = V.table(spark, d, "labels").withColumnRenamed("doc_id", "index")
    return P.shift_index_if_below(labs, "index", 500, 500)


def ensure_index(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    return P.ensure_index(docs, "index")


def keep_matching(spark: SparkSession, d: str) -> DataFrame:
    docs = V.table(spark, d, "documents").select(F.col("doc_id").alias("index"), "n_chars")
    return P.keep_matching(docs, V.table(spark, d, "labels"), "index", "doc_id")


def ingest_test(spark: SparkSession, d: str) -> DataFrame:
    """One post per row with an id on every row (test-sheet shape), id column normalised (SRC5, PRJ1, PRJ2)."""
    cv = V.table(spark, d, "conversations")
    sheet = cv.select((F.col("conv_id") * 4096 + F.col("turn")).alias("idx"), F.col("text").alias("title"),
                      F.col("role").alias("label"))
    return P.ingest_sheet(sheet, "test_labeled")


def ingest_unlabeled(spark: SparkSession, d: str) -> DataFrame:
    cv = V.table(spark, d, "conversations")
    sheet = cv.select((F.col("conv_id") * 4096 + F.col("turn")).alias("idx"), F.col("text").alias("title"))
    return P.normalize_posts(P.ingest_sheet(sheet, "unlabeled"), {"post": "text"}, {"index": "long"}, ["index", "text"])


QUERIES = {
    "ingest_test": ingest_test,
    "ingest_unlabeled": ingest_unlabeled,
    "ffill_concat": ffill_concat,
    "ffill_concat_sheets": ffill_concat_sheets,
    "block_parts": block_parts,
    "shift_index": shift_index,
    "ensure_index": ensure_index,
    "keep_matching": keep_matching,
}

SQL = {
    "ingest_test": r"""
        SELECT conv_id * 4096 + turn AS "index", regexp_replace(text, '[\n\r]', ' ', 'g') AS post, role AS label
        FROM conversations""",
    "ingest_unlabeled": r"""
        SELECT conv_id * 4096 + turn AS "index", regexp_replace(text, '[\n\r]', ' ', 'g') AS text FROM conversations""",
    "ffill_concat": with_views("raw_sheet") + r""",
        filled AS (
            SELECT row_pos, title,
                   last_value(CASE WHEN idx IS NOT NULL THEN {'i': idx, 'l': label} END IGNORE NULLS)
                     OVER (ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
            FROM raw_sheet)
        SELECT blk.i AS "index",
               regexp_replace(string_agg(title, ' ' ORDER BY row_pos), '[\n\r]', ' ', 'g') AS post,
               arg_max(blk.l, row_pos) AS label
        FROM filled WHERE blk.i IS NOT NULL GROUP BY blk.i""",
    "ffill_concat_sheets": with_views("raw_sheet") + r""",
        sheets AS (SELECT row_pos, title, label, row_pos // 4096 % 2 AS sheet, CASE WHEN row_pos >= 2 * 4096 THEN idx END AS idx FROM raw_sheet),
        filled AS (
            SELECT sheet, row_pos, title,
                   last_value(CASE WHEN idx IS NOT NULL THEN {'i': idx, 'l': label} END IGNORE NULLS)
                     OVER (PARTITION BY sheet ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
            FROM sheets)
        SELECT CAST(sheet AS INTEGER) AS sheet, blk.i AS "index",
               regexp_replace(string_agg(title, ' ' ORDER BY row_pos), '[\n\r]', ' ', 'g') AS post,
               arg_max(blk.l, row_pos) AS label
        FROM filled WHERE blk.i IS NOT NULL GROUP BY sheet, blk.i""",
    "block_parts": with_views("raw_sheet") + """,
        filled AS (
            SELECT row_pos, title, last_value(CASE WHEN idx IS NOT NULL THEN {'i': idx, 'l': label} END IGNORE NULLS)
                     OVER (ORDER BY row_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
            FROM raw_sheet)
        SELECT blk.i AS block_id, row_pos // 4 AS part, string_agg(title, ' ' ORDER BY row_pos) AS text, arg_max(blk.l, row_pos) AS label,
               max(row_pos) AS last_pos
        FROM filled WHERE blk.i IS NOT NULL GROUP BY blk.i, row_pos // 4""",
    "shift_index": """
        SELECT CASE WHEN (SELECT min(doc_id) FROM labels) < 500 THEN doc_id + 500 ELSE doc_id END AS "index",
               quality, toxic
        FROM labels""",
    "ensure_index": """
        SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS "index" FROM documents""",
    "keep_matching": """
        SELECT doc_id AS "index", n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
}
