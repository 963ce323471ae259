"""Text helpers: word tokens and contiguous word n-grams (TXT6), display names (TXT8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of at least two letters / digits / underscores,
# lower-cased first (the usual word-vectoriser rule).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(col: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def ngrams(tok: Column, n: int) -> Column:
    """Contiguous n-grams joined by one space; fewer than n tokens -> empty array.

    Pass a *column reference* (tokens already projected): the lambda reads
    ``tok`` once per gram, and an inlined tokenizer would run once per gram.
    """
    k = F.size(tok)
    grams = F.transform(F.sequence(F.lit(0), k - n), lambda i: F.array_join(F.slice(tok, i + 1, n), " "))
    return F.when(k >= n, grams).otherwise(F.array().cast("array<string>"))


def display_name(col: str | Column, replacements: Sequence[tuple[str, str]] = (("-preview", ""), ("-latest", ""))) -> Column:
    """Chained literal replacements (TXT8)."""
    out = _c(col)
    for a, b in replacements:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
