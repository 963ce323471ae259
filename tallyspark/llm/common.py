"""Shared helpers: vectorised words over Arrow text columns, folds, blob sums, scratch tables.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. In UTF-8 those six bytes
never occur inside a longer character, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import ensure_checkpoint_dir, scratch_path

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BATCH_BYTES = 1 << 21  # of the rows that a Python task gets at once
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Let Spark send rows to Python tasks about ``BATCH_BYTES`` at a time, unless the session names another size.

    By default a batch holds up to 64 MB, once in the executor's JVM and once in the worker.
    The size stays set, since the tables that operators return are computed later.
    """
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label may be learned from: crc32(doc_id as text) mod 5 = 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train_sample(labels: DataFrame, target: str, max_rows: int) -> DataFrame:
    """(doc_id, y): at most ``max_rows`` labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of the id, so the sample is the same for any
    layout of the table. Repeated labels of a document count once (1 wins); null ids and
    null labels are left out.
    """
    one = (labels.select(F.col("doc_id"), F.col(target).cast("int").alias("y"))
           .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def text_batches(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of whole rows: (first row, end row, bytes, offsets).

    Null texts are empty. A run holds at most ``max_bytes``, unless one text is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def slices(batch: pa.RecordBatch, max_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts of a few rows, so that a task holds few texts twice."""
    for at in range(0, batch.num_rows, max_rows):
        yield batch.slice(at, max_rows)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero class inside each row: (starts, ends, row of each run)."""
    n = len(kind)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row: (starts, ends, row of each word)."""
    return runs((~WHITE[buf]).view(np.uint8), offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 21) + 1
        up, down = np.full(size, _MULT, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > (1 << 22):  # one very long text: don't keep its tables
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def byte_codes(seed: int, fold_case: bool = False) -> np.ndarray:
    """A random 64-bit code per byte; with ``fold_case`` A-Z share the codes of a-z."""
    codes = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by one polynomial prefix sum over the buffer."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes[buf] * up[:len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each row, and their rows."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = h[:m].copy()
    for k in range(1, n):
        g = g * np.uint64(_MULT) + h[k:k + m]
    inside = rows[:m] == rows[n - 1:]
    return mix(g[inside]), rows[:m][inside]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table, under the cluster's shared folder."""
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: short lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns of an input that may carry any others."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def sum_blobs(blobs: DataFrame) -> dict[int, np.ndarray]:
    """Add up equally long 32-bit integer arrays by block id into 64-bit ones: rows (block int, blob binary) of all tasks."""
    def add(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in part:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), "<i4")
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["block", "blob"])
    summed = blobs.repartition("block").mapInArrow(add, "block int, blob binary")
    return {r["block"]: np.frombuffer(bytes(r["blob"]), np.int64) for r in summed.collect()}


def few_tasks(docs: DataFrame, most: int = 4096) -> DataFrame:
    """The rows in at most ``most`` tasks, for tasks that each send a table of set size; nothing is shuffled."""
    return docs.coalesce(most)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: str, share: int = 1 << 16) -> DataFrame:
    """Every row with the columns of its group; ``groups`` has one row per key and its number of rows ``n``.

    Keys with more than 1 / ``share`` of all rows, of which there can't be ``share``, come to the
    rows by broadcast. The rows of the others are shuffled, and none of these keys is a hot one.
    Null keys are one group.
    """
    groups = groups.withColumnRenamed(key, "_key")
    total = groups.agg(F.sum(n)).first()[0] or 0
    often = groups.where(F.col(n) > total / share)
    same = rows[key].eqNullSafe(F.col("_key"))
    near = rows.join(F.broadcast(often), same)
    far = rows.join(F.broadcast(often.select("_key")), same, "left_anti").join(groups.where(F.col(n) <= total / share).hint("merge"), same)
    return near.unionByName(far).drop("_key")
