"""Short codes of vectors: one byte per consecutive part, from a codebook of 64 entries per part.

Components become integers (floor of 256 x). Each part position has a codebook, at first that
part of the 64 vectors with the smallest ids; each round assigns every part to its nearest
entry and moves the entries to the floored mean of their parts.

The nearest entry is found by slicing and intersecting. Per dimension the entries' coordinates
are sorted, and a prefix mask holds, for each length, which of the 64 entries come first. The
distance to a near entry is an initial radius; no nearer entry, and no equally near one, lies
outside that radius in any dimension. Two binary searches a dimension give a range, two prefix
masks its entries as one 64-bit mask, and the masks of all dimensions ANDed are the
candidates, among which exact distances decide. All numbers are integers, so no result
depends on the layout of the table.

Vectors never move: tasks send sums per (part, entry, component), a table of set size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package

LARGEST = float(1 << 20)  #: components from here on would overflow 64-bit distances


@dataclass(frozen=True)
class Settings:
    parts: int = 16
    entries: int = 64           #: at most 64, the bits of a mask
    rounds: int = 2
    scale: int = 256


class Book:
    """The codebook of one part position, with sorted coordinates and prefix masks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0).T.copy()
        bits = np.left_shift(np.uint64(1), order.T.astype(np.uint64))
        self.prefix = np.concatenate([np.zeros((entries.shape[1], 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)], axis=1)
        self.order = order.T.copy()

    def distances(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        d = x - self.entries[entry]
        return (d * d).sum(axis=1)

    def radius(self, x: np.ndarray) -> np.ndarray:
        """A distance within which each row of ``x`` has an entry: that to a neighbour along some dimension."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        for k in range(x.shape[1]):
            at = np.searchsorted(self.sorted[k], x[:, k])
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(self.entries) - 1)):
                np.minimum(best, self.distances(x, self.order[k][near]), out=best)
        return np.sqrt(best).astype(np.int64) + 1

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries within the radius in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for k in range(x.shape[1]):
            lo = np.searchsorted(self.sorted[k], x[:, k] - radius)
            hi = np.searchsorted(self.sorted[k], x[:, k] + radius, side="right")
            mask &= self.prefix[k][hi] ^ self.prefix[k][lo]
        return mask

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``x``; ties go to the lower entry."""
        mask = self.candidates(x, self.radius(x))
        entry, best = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        rows = np.arange(len(x))
        while len(rows):
            lowest = mask & (~mask + np.uint64(1))
            e = np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
            d = self.distances(x[rows], e)
            nearer = d < best[rows]
            best[rows[nearer]], entry[rows[nearer]] = d[nearer], e[nearer]
            mask ^= lowest
            on = mask != 0
            rows, mask = rows[on], mask[on]
        return entry, best


def _parts(column: pa.Array, dim: int, s: Settings) -> np.ndarray:
    """Integer components: (vectors, parts, components of a part)."""
    x = np.floor(s.scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return x.astype(np.int64).reshape(-1, s.parts, dim // s.parts)


def _assign(x: np.ndarray, books: list[Book]) -> tuple[np.ndarray, np.ndarray]:
    found = [b.nearest(x[:, j]) for j, b in enumerate(books)]
    return np.stack([e for e, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def sums(vectors: DataFrame, dim: int, books: np.ndarray, s: Settings) -> DataFrame:
    """(part, entry, component, total, n): sums of the parts that each entry is nearest to."""
    parts, m, d = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in books]
        total, n = np.zeros((parts * m, d), np.int64), np.zeros(parts * m, np.int64)
        for batch in batches:
            x = _parts(batch.column(0), dim, s)
            at = (_assign(x, own)[0] + m * np.arange(parts)).ravel()
            n += np.bincount(at, minlength=parts * m)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            if len(first):
                total[at[order][first]] += np.add.reduceat(x.reshape(-1, d)[order], first, axis=0)
        used = np.flatnonzero(n)
        e, c = np.repeat(used, d), np.tile(np.arange(d), len(used))
        yield pa.RecordBatch.from_arrays(
            [pa.array(e // m, pa.int32()), pa.array(e % m, pa.int32()), pa.array(c, pa.int32()), pa.array(total[used].ravel()), pa.array(n[e])],
            names=["part", "entry", "component", "total", "n"])
    each = vectors.select("embedding").mapInArrow(task, "part int, entry int, component int, total long, n long")
    return each.groupBy("part", "entry", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def codes(vectors: DataFrame, dim: int, books: np.ndarray, s: Settings) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Book(b) for b in books]
        for batch in batches:
            entry, d = _assign(_parts(batch.column(2), dim, s), own)
            text = [r.tobytes().hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(d.sum(axis=1))], names=["vec_id", "label", "code", "error"])
    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(task, f"vec_id long, label {kind}, code string, error long")


def usable(embeddings: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, label, embedding): vectors without null, non-finite or overlarge components."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % s.parts == 0) & ~bad)


def first_books(vectors: DataFrame, s: Settings) -> tuple[DataFrame, int, np.ndarray] | None:
    """(vectors of the common length, that length, the first codebooks)."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    least = vectors.orderBy(*order).first()
    if least is None:
        return None
    dim = len(least["embedding"])
    same = vectors.where(F.size("embedding") == dim)
    rows = same.orderBy(*order).select("embedding").limit(s.entries).collect()
    x = np.floor(s.scale * np.array([r["embedding"] for r in rows])).astype(np.int64)
    return same, dim, x.reshape(len(rows), s.parts, dim // s.parts).swapaxes(0, 1).copy()


def moved(books: np.ndarray, table: DataFrame) -> np.ndarray:
    """The codebooks with each used entry at the floored mean of its parts."""
    out = books.copy()
    for r in table.collect():
        out[r["part"], r["entry"], r["component"]] = r["total"] // r["n"]
    return out


def checksum(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row per usable vector.

    ``code`` has two hex digits a part, ``error`` sums the squared distances of the parts,
    ``label_error`` sums the errors of all vectors of the label, nulls being one label.
    Left out are vectors that are null, empty, or hold a null or non-finite component (or one
    of 2^20 or more, whose distances need over 64 bits), and those of another length than
    the vector with the smallest id among those whose length the parts divide. Repeated rows
    are coded each; null ids come last; of equal ids the smaller vector comes first. With fewer than 64 vectors
    the codebooks are shorter. An empty table gives no rows; other columns are ignored.
    """
    s = settings or Settings()
    spark = embeddings.sparkSession
    ship_package(spark)
    start = first_books(usable(embeddings, s), s)
    if start is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    vectors, dim, books = start
    for _ in range(s.rounds):
        books = moved(books, sums(vectors, dim, books, s))
    done = C.materialise(codes(vectors, dim, books, s), "codes")
    of_label = C.materialise(done.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    return C.join_groups(done, of_label, "label", "_n").select("vec_id", "code", "error", "label_error", F.lit(checksum(books)).alias("codebooks_sha256"))
