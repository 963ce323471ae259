"""Train/test leakage by word n-gram overlap (JN4, TXT6).

The source compares each test post with every reference post (O(N*M) with re-vectorisation).
Here both sides are exploded to (id, n-gram), in one plan at every size: a Bloom filter of set
size is aggregated from the reference's grams and probed before anything is shuffled, so only
the few grams that may be in a reference text travel; they meet the reference's grams as exact
strings. Ids alone carry the flags; rows with fewer than n tokens, or null texts, come out False.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import ngrams, tokens
from tallyspark.operators import bloom


def _grams(df: DataFrame, text_col: str, n: int, *keep: str) -> DataFrame:
    """(kept columns, gram): the distinct n-grams of each row."""
    toks = df.select(*keep, tokens(text_col).alias("_tok"))
    # the outer form: Spark would filter by the array's size otherwise, and make tokens and grams once more for that
    return toks.select(*keep, F.explode_outer(F.array_distinct(ngrams(F.col("_tok"), n))).alias("gram")).where("gram IS NOT NULL")


def reference_grams(ref: DataFrame, text_col: str = "text", n: int = 7) -> DataFrame:
    return _grams(ref, text_col, n).distinct()


def overlapping_ids(df: DataFrame, ref: DataFrame, n: int = 7, id_col: str = "index", text_col: str = "post",
                    ref_text_col: str = "text") -> DataFrame:
    """The distinct ids of rows that share an n-gram with some reference text.

    A gram that very many rows share makes a hot key of the last join, which Spark's skew
    handling splits; each row has it once.
    """
    known = bloom.build(_grams(ref, ref_text_col, n), F.col("gram"))
    maybe = bloom.may_hold(_grams(df, text_col, n, id_col), known, "gram")
    # an inner join, as the reference's grams are distinct: Spark would push a semi join below the filter
    return maybe.join(reference_grams(ref, ref_text_col, n).hint("shuffle_hash"), "gram").select(id_col).distinct()


def flag_overlap(df: DataFrame, ref: DataFrame, n: int = 7, id_col: str = "index", text_col: str = "post",
                 ref_text_col: str = "text") -> DataFrame:
    """(id, duplicate), one row per id: True iff some n-gram of its rows also occurs in a reference text."""
    hit = overlapping_ids(df, ref, n, id_col, text_col, ref_text_col).select(id_col, F.lit(True).alias("duplicate"))
    return df.select(id_col, F.lit(False).alias("duplicate")).unionByName(hit).groupBy(id_col).agg(F.max("duplicate").alias("duplicate"))


def overlap_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("duplicate").agg(F.count(F.lit(1)).alias("n"))


def drop_overlap(df: DataFrame, ref: DataFrame, n: int = 7, id_col: str = "index", text_col: str = "post",
                 ref_text_col: str = "text") -> DataFrame:
    """Rows of ``df`` with no n-gram in common with the reference texts: an anti join of the flagged ids.

    Rows with a null id are kept if nothing flagged has a null id (SQL's anti join keeps them).
    """
    return df.join(overlapping_ids(df, ref, n, id_col, text_col, ref_text_col), id_col, "left_anti")
