"""Quality rules in DataFrame functions only: word statistics and an n-gram likelihood ratio.

Every document gets its base statistics (words, symbols, repeated lines, repeated 3-word
windows) and the length-normalised log-likelihood ratio of its hashed word 1- and 2-grams
between two multinomials: that of all trusted target documents (label quality = 1, outside
the held-out fold) and that of the raw corpus (every document). The target is smoothed
towards the corpus by a fixed share of its own mass, so that the weight doesn't depend on the
table's size. A document is kept when it passes the base rule and its ratio reaches a fixed
threshold.

Nothing here leaves the JVM and no text moves: to meet the trusted ids, a document is shuffled
as its n-grams' bucket numbers (two bytes each), in the same plan at every size. Counting then
shuffles one row per bucket and task, scoring nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import fsum, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    buckets: int = 8192         #: of hashed n-grams
    smoothing: float = 1.0      #: added to each bucket's count in the corpus
    share: float = 0.75        #: n-grams that the target has as the corpus has them, to one of its own
    threshold: float = -0.045   #: least log-likelihood ratio per n-gram
    min_words: int = 50
    max_repeat_percent: int = 50


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; null text: none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def with_repeat_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Add the number of words inside 3-word windows that occur twice or more in the row.

    Windows are sorted with their places (n log n, whatever the text looks like); equal
    neighbours give the places of repeated windows, whose union is then measured.
    """
    h = F.col(hashes)
    df = df.withColumn("_win", F.when(F.size(h) >= 4, F.transform(
        F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))))
    w = F.col("_win")
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(
        F.transform(w, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    s = F.col("_sorted")
    df = df.withColumn("_at", F.sort_array(F.transform(
        F.filter(s, lambda e, i: F.coalesce(e["g"] == F.get(s, i + 1)["g"], F.lit(False))
                 | ((i > 0) & F.coalesce(e["g"] == F.get(s, F.greatest(i - 1, F.lit(0)))["g"], F.lit(False)))),
        lambda e: e["i"])))
    at = F.col("_at")
    covered = F.aggregate(
        F.transform(at, lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(at, F.greatest(k - 1, F.lit(0)))))),
        F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop("_win", "_sorted", "_at")


def _bucket(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def _buckets(hashes: Column, buckets: int) -> Column:
    """Bucket numbers of a text's word 1- and 2-grams, from the hashes of its words."""
    one = F.transform(hashes, lambda x: _bucket(x, buckets=buckets))
    two = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))), lambda x, i: _bucket(x, F.get(hashes, i + 1), buckets=buckets))
    return F.concat(one, two).cast("array<smallint>" if buckets <= 1 << 15 else "array<int>")


def ngram_counts(docs: DataFrame, trusted: DataFrame, s: Settings) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of the trusted ones.

    Rows with a null doc_id are spread over the join's tasks; they are in no trusted set.
    """
    ids = trusted.select(F.col("doc_id").alias("_id"), F.lit(0).alias("_salt"), F.lit(1).alias("_t"))
    key, text = F.col("doc_id"), F.col("text")
    rows = docs.select(F.coalesce(key, F.lit(0)).alias("_key"), F.when(key.isNull(), 1 + F.pmod(F.xxhash64(text), F.lit(1 << 16))).otherwise(0).cast("int").alias("_spread"),
                       F.transform(words(text), lambda x: F.xxhash64(x)).alias("_h")).select("_key", "_spread", _buckets(F.col("_h"), s.buckets).alias("g"))
    joined = rows.join(ids.hint("shuffle_hash"), (F.col("_key") == F.col("_id")) & (F.col("_spread") == F.col("_salt")), "left")
    # the outer form: Spark would filter by the array's size otherwise, and copy its making down the plan
    grams = joined.select(F.coalesce("_t", F.lit(0)).alias("t"), F.explode_outer("g").alias("bucket")).where("bucket IS NOT NULL")
    return (grams.groupBy(F.col("bucket").cast("int").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")))


def ratio_table(counts: DataFrame, s: Settings) -> list[float]:
    """log p_target - log p_raw of each bucket: one list of ``buckets`` numbers (a set size)."""
    spark = counts.sparkSession
    full = (spark.range(s.buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
            .select("bucket", (F.coalesce("raw", F.lit(0)) + s.smoothing).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))
    rows = sorted(full.collect())
    of_raw, of_target = fsum(r["raw"] for r in rows), fsum(r["target"] for r in rows)
    shares = [r["raw"] / of_raw for r in rows]
    prior = s.share * of_target
    if not of_target:
        return [0.0] * len(rows)
    return [round(log((r["target"] + prior * p) / (of_target + prior) / p), 4) for r, p in zip(rows, shares, strict=True)]


def quality_rules(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept).

    One row per row of ``docs``, repeated rows included. Null and empty texts have no words,
    fail the base rule and have the ratio 0. A null doc_id stays. Without trusted
    documents every ratio is 0 and only the base rule decides. Columns besides doc_id and text are ignored; an empty
    table gives no rows.
    """
    return _judged(docs, labels, settings or Settings(), whole=False)


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept (see quality_rules); an empty table gives none."""
    return _judged(docs, labels, settings or Settings(), whole=True).where("kept").select("_row.*")


def trusted_ids(labels: DataFrame, s: Settings) -> DataFrame:
    """The doc_id of every trusted document outside the held-out fold, once."""
    good = labels.where(F.col("quality") == 1)
    return good.where(F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id"))).select("doc_id").distinct()


def _judged(docs: DataFrame, labels: DataFrame, s: Settings, whole: bool) -> DataFrame:
    return apply_rules(docs, ratio_table(ngram_counts(docs, trusted_ids(labels, s), s), s), s, whole)


def apply_rules(docs: DataFrame, table: list[float], s: Settings, whole: bool = False) -> DataFrame:
    """The judged rows; with ``whole`` each has its input row in the struct ``_row``.

    The result comes out of a generator (one row in, one row out). Filters on its columns stay
    above that; pushed down, they would copy the nested array expressions once a use.
    """
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folded to one literal
    row = F.struct("*") if whole else F.lit(None)
    df = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), words(F.col("text")).alias("_w"),
                     lines(F.col("text")).alias("_l"))
    df = df.select(
        "_row", "doc_id", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    df = with_repeat_words(df, "_h", "n_repeat_words")
    h = F.col("_h")
    total = F.aggregate(
        F.transform(h, lambda x, i: F.get(ratios, _bucket(x, buckets=s.buckets))
                    + F.when(i + 1 < F.size(h), F.get(ratios, _bucket(x, F.get(h, i + 1), buckets=s.buckets))).otherwise(0.0)),
        F.lit(0.0), lambda a, x: a + x)
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    df = df.withColumn("llr", F.round(total / grams, 9)).drop("_h")
    failed = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words"))
    judged = [F.col(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
        failed.alias("base_failed"), F.col("llr"), (~failed & (F.col("llr") >= s.threshold)).alias("kept")]
    return df.select(F.inline(F.array(F.struct(*([F.col("_row")] if whole else []), *judged))))
