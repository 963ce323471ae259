"""Packing whole documents into few sequences: large-item matching, then best fit.

A document becomes its token ids plus an end id; only one longer than ``capacity`` is cut, its
first piece taking the remainder. Pieces are dealt by a keyed hash into groups of about
``group_pieces`` (a long document's pieces and repeated documents spread), and each group is
packed on its own:

1. Pieces above one third of the capacity go at most two to a sequence. From the longest
   down, each is matched with the longest other one that fits beside it; an exchange argument
   shows that no matching has more pairs.
2. The others, longest first, go to the sequence with the least room that takes them.

Lengths are small integers, so what is left of each length, and the sequences of each room,
are sets in a bit mask: the next fitting length or room is one shift away. Only lengths and
checksums are shuffled, never texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm.bytebpe import tokenizer
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    tokenizer: str              #: path of a ``tokenizers`` file, the same on all machines
    capacity: int = 2048
    end_id: int = 0
    group_pieces: int = 32_768  #: mean number of pieces of a group
    seed: int = 13


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(lo, capacity) for lo in range(first, n, capacity)]


def pieces(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the cut documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(s.tokenizer).ids
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(2)):
                ids = np.array([*encode(text.as_py() or ""), s.end_id], "<u4")
                for k, (lo, n) in enumerate(cut(len(ids), s.capacity)):
                    at.append(i)
                    out.append((k, lo, n, zlib.crc32(ids[lo:lo + n].tobytes())))
            own = pa.array(at, pa.int64())
            cols = np.array(out, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), pa.array(cols[0], pa.int32()), *[pa.array(c) for c in cols[1:]]],
                names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))
    return rows.mapInArrow(task, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


class ByLength:
    """Things filed under an integer: finds the nearest filed number below or above a bound."""

    def __init__(self, top: int) -> None:
        self.at: list[list[int]] = [[] for _ in range(top + 1)]
        self.mask = 0

    def add(self, number: int, thing: int) -> None:
        self.at[number].append(thing)
        self.mask |= 1 << number

    def take(self, number: int) -> int:
        thing = self.at[number].pop()
        if not self.at[number]:
            self.mask &= ~(1 << number)
        return thing

    def most(self, bound: int) -> int:
        """The largest filed number up to ``bound``; -1: none."""
        return (self.mask & ((1 << bound + 1) - 1)).bit_length() - 1 if bound >= 0 else -1

    def least(self, bound: int) -> int:
        """The smallest filed number from ``bound`` on; -1: none."""
        above = self.mask >> bound
        return bound + (above & -above).bit_length() - 1 if above else -1


def match_large(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(item, partner or -1) over items above a third of the capacity, longest first."""
    left, out = ByLength(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (sizes[k], -k)):
        left.add(sizes[k], k)
    while (size := left.most(capacity)) >= 0:
        k = left.take(size)
        partner = left.most(capacity - size)
        out.append((k, left.take(partner) if partner >= 0 else -1))
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size; bins are numbered from 0, equal sizes keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    large = np.flatnonzero(3 * sizes > capacity)
    room, used = ByLength(capacity), 0
    for a, b in match_large(sizes[large].tolist(), capacity):
        free = capacity - int(sizes[large[a]])
        bins[large[a]] = used
        if b >= 0:
            bins[large[b]], offsets[large[b]] = used, capacity - free
            free -= int(sizes[large[b]])
        if free:
            room.add(free, used)
        used += 1
    small = np.flatnonzero(3 * sizes <= capacity)
    small = small[np.argsort(-sizes[small], kind="stable")]
    for k, size in zip(small.tolist(), sizes[small].tolist(), strict=True):
        free = room.least(size)
        if free < 0:
            free, to = capacity, used
            used += 1
        else:
            to = room.take(free)
        bins[k], offsets[k] = to, capacity - free
        if free > size:
            room.add(free - size, to)
    return bins, offsets


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    Null and empty texts are one piece of the end id. Rows with the same or a null doc_id are
    packed each. Special tokens named in a text count as these tokens. Sequence ids are unique,
    not dense. An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    s = settings
    ship_package(docs.sparkSession)
    done = C.materialise(pieces(docs, s), "whole-pieces")
    groups = max(1, -(-done.count() // s.group_pieces))
    dealt = done.withColumn("group", F.pmod(F.xxhash64(F.lit(s.seed), "doc_id", "row", "piece"), F.lit(groups)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            bins, offsets = pack_sizes(t.column(4).to_numpy(), s.capacity)
            return pa.RecordBatch.from_arrays([*t.columns[1:], pa.array((t.column(0)[0].as_py() << 24) + bins), pa.array(offsets)], names=NAMES)
        for b in batches:
            g = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and held[-1].column(0)[0].as_py() != g[lo]:
                    yield packed()
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield packed()
    return (dealt.select("group", *NAMES[:5]).repartition("group").sortWithinPartitions("group", "doc_id", "start", "ids_crc32")
            .mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"))
