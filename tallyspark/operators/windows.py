"""Skew-proof building blocks for ordered computations.

A window partitioned only by a coarse key (a run, a class, a whole sheet) puts
every row of that key into one task. With one key holding a third of the data
that task is the job. These helpers keep the exact semantics of such windows
while partitioning the heavy work by ``(key, chunk)`` where ``chunk`` is a
monotone bucketing of the ordering column; only a per-chunk summary table
(``rows / chunk_rows`` rows) is ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.session import materialise


def forward_fill(df: DataFrame, partition_cols: Sequence[str], order_col: str, value: Column,
                 out_col: str, chunk: Column) -> DataFrame:
    """``out_col`` = last non-null ``value`` at or before each row (per partition, by ``order_col``).

    Exact equivalent of ``last(value, ignorenulls).over(partitionBy(p).orderBy(o)
    .rowsBetween(unboundedPreceding, currentRow))`` computed as:
      1. the same window inside each (p, chunk);
      2. per (p, chunk) the in-chunk fill of its last row — aggregated on the data
         already hash-partitioned by (p, chunk), so no second scan or shuffle;
      3. carry = last non-null summary value of *earlier* chunks (window over the
         small summary table);
      4. coalesce(in-chunk, carry).
    ``chunk`` must be non-decreasing in ``order_col`` within a partition.
    """
    p = list(partition_cols)
    x = df.withColumn("_ff_chunk", chunk).withColumn("_ff_v", value)
    w_in = (Window.partitionBy(*p, "_ff_chunk").orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_ff_in", F.last("_ff_v", ignorenulls=True).over(w_in))
    summ = x.groupBy(*p, "_ff_chunk").agg(F.max_by("_ff_in", F.col(order_col)).alias("_ff_last"))
    w_carry = Window.partitionBy(*p).orderBy("_ff_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*p, "_ff_chunk", F.last("_ff_last", ignorenulls=True).over(w_carry).alias("_ff_carry"))
    out = _left_null_safe(x, summ, p + ["_ff_chunk"])
    return out.withColumn(out_col, F.coalesce(F.col("_ff_in"), F.col("_ff_carry"))).drop(
        "_ff_chunk", "_ff_v", "_ff_in", "_ff_carry")


def _left_null_safe(x: DataFrame, summ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a summary on ``keys``, where a NULL key meets the NULL key's summary."""
    right = summ.withColumnsRenamed({k: f"_ns_{k}" for k in keys})
    cond = None
    for k in keys:
        c = x[k].eqNullSafe(right[f"_ns_{k}"])
        cond = c if cond is None else cond & c
    return x.join(right, cond, "left").drop(*[f"_ns_{k}" for k in keys])


def exact_row_number(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column | str],
                     bucket: Column, out_col: str = "rn", return_counts: bool = False,
                     total_col: str | None = None):
    """1-based ``row_number()`` per partition in ``order_cols`` order, computed per (p, bucket).

    ``bucket`` must be non-decreasing in the ordering (e.g. a hash prefix when
    ordering by that hash, or ``floor(epoch / w)`` when ordering by epoch).
    Bucket sizes are read off the local row numbers (same partitioning, no
    second scan); offsets are a running sum over a table of ``#buckets`` rows per p.
    With ``return_counts`` also returns the per-(p, bucket) count table
    (columns ``p..., _rk_b, _rk_n``); ``total_col`` adds the partition's row count
    (summed over the same small table, so no extra scan or scalar subquery).
    """
    p = list(partition_cols)
    x = df.withColumn("_rk_b", bucket)
    w_local = Window.partitionBy(*p, "_rk_b").orderBy(*order_cols)
    x = x.withColumn("_rk_local", F.row_number().over(w_local))
    counts = x.groupBy(*p, "_rk_b").agg(F.max("_rk_local").cast("long").alias("_rk_n"))
    w_off = Window.partitionBy(*p).orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_rk_n").over(Window.partitionBy(*p)).alias(total_col)] if total_col else []
    offsets = counts.select(*p, "_rk_b", F.coalesce(F.sum("_rk_n").over(w_off), F.lit(0)).alias("_rk_off"), *extra)
    out = _left_null_safe(x, offsets, p + ["_rk_b"])
    out = out.withColumn(out_col, (F.col("_rk_off") + F.col("_rk_local")).cast("long")).drop(
        "_rk_b", "_rk_off", "_rk_local")
    return (out, counts) if return_counts else out


def running_max(df: DataFrame, partition_cols: Sequence[str], order_col: str, value: str,
                out_col: str, chunk: Column, inclusive: bool = True) -> DataFrame:
    """Running maximum of ``value`` per partition (inclusive or strictly before the row).

    Chunk maxima are aggregated on the (p, chunk)-partitioned window output.
    """
    p = list(partition_cols)
    x = df.withColumn("_rm_chunk", chunk)
    end = Window.currentRow if inclusive else -1
    w_in = Window.partitionBy(*p, "_rm_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    x = x.withColumn("_rm_in", F.max(value).over(w_in))
    summ = x.groupBy(*p, "_rm_chunk").agg(F.max(value).alias("_rm_cmax"))
    w_carry = Window.partitionBy(*p).orderBy("_rm_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(*p, "_rm_chunk", F.max("_rm_cmax").over(w_carry).alias("_rm_carry"))
    out = _left_null_safe(x, summ, p + ["_rm_chunk"])
    both = F.greatest(F.col("_rm_in"), F.col("_rm_carry"))  # greatest skips NULLs
    return out.withColumn(out_col, both).drop("_rm_chunk", "_rm_in", "_rm_carry")


def sorted_chunks(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[Column | str],
                  partitions: int | None = None) -> DataFrame:
    """The rows sorted by (partition, order), with ``_at`` (place in that order) and ``_chunk``.

    One range shuffle whose boundaries Spark samples over all sort columns, so rows are dealt evenly
    whatever their shape: a run with most rows, or with most rows at one epoch, still falls into
    many chunks. ``_at`` ascends over the whole table, ``_chunk`` with it. The table is written to
    the shared scratch folder, which fixes both. The other helpers take ``F.col("_chunk")`` and
    ``"_at"`` as chunk and order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*partition_cols, *order_cols]
    x = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    x = x.withColumn("_at", F.monotonically_increasing_id())
    return materialise(x.withColumn("_chunk", F.shiftright("_at", 33).cast("int")), "chunks")


def hash_bucket(key: Column, bits: int = 12) -> Column:
    """Top ``bits`` of an md5-style hex key as an int bucket (monotone in the key's order)."""
    hex_digits = (bits + 3) // 4
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")
