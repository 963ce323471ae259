"""Packing documents into fixed-length sequences: first-fit decreasing over a tournament tree.

A document becomes its token ids plus an end id, cut every ``capacity`` ids. The pieces are
dealt by a keyed hash into groups of about ``group_pieces`` (never one key: a long document's
pieces and repeated documents spread). Each group is packed on its own: pieces in falling
length go to the first sequence with room, found in log time by walking a tree whose inner
nodes hold the largest room below them.

Only (ids' checksum, lengths) are shuffled, never texts or ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    tokenizer: str              #: path of a ``tokenizers`` file, the same on all machines
    capacity: int = 2048
    end_id: int = 1
    group_pieces: int = 16_384  #: mean number of pieces of a group
    seed: int = 5
    memo_words: int = 400_000   #: words whose ids a worker remembers


class Encoder:
    """Ids of a text, as little-endian 32-bit bytes, equal to the tokenizer's own ``encode``.

    Where the file is of the kind that ``KIND`` describes, the pre-tokenizer's pieces of texts of common
    Latin characters are found here and each piece's ids are remembered. Any other text, one that
    may name a special token, and any text under another file, goes through the tokenizer whole.
    """

    # fixed values: the normaliser and pre-tokenizer that the pattern below stands for
    KIND = {
        "normalizer": {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}

    # fixed values: the pre-tokenizer's pattern over the characters that COMMON admits
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-į]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-į²³¹¼-¾]+")
    RARE = re.compile(r"[^\x09-\x0d\x20-\x7e\xa0-į]|<\|")

    def __init__(self, path: str, memo_words: int) -> None:
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.usual = all(spec.get(k) == v for k, v in self.KIND.items()) and all("<|" in t["content"] for t in spec["added_tokens"])
        self.memo: dict[str, bytes] = {}
        self.memo_words = memo_words
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain}
        for k, b in enumerate(b for b in range(256) if b not in shown):
            shown[b] = chr(256 + k)
        self.shown = {b: shown[b] for b in range(256)}  # byte-level alphabet

    def _piece(self, word: str) -> bytes:
        found = self.whole.model.tokenize(word.encode().decode("latin-1").translate(self.shown))
        out = np.array([x.id for x in found], "<u4").tobytes()
        if len(word) <= 48:
            if len(self.memo) >= self.memo_words:
                self.memo.clear()
            self.memo[word] = out
        return out

    def ids(self, text: str) -> bytes:
        if not self.usual or self.RARE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        get, miss = self.memo.get, self._piece
        return b"".join([get(w) or miss(w) for w in self.PIECES.findall(text.lower())])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, memo_words: int) -> Encoder:
    key = (path, memo_words)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, memo_words)
    return _ENCODERS[key]


def pieces(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens): the cut documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(s.tokenizer, s.memo_words)
        end, step = np.array([s.end_id], "<u4").tobytes(), 4 * s.capacity
        for b in batches:
            at, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column(2)):
                ids = enc.ids(text.as_py() or "") + end
                for lo in range(0, len(ids), step):
                    part = ids[lo:lo + step]
                    at.append(i)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(own), b.column(1).take(own), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]],
                names=["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))
    return rows.mapInArrow(task, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long")


class Tournament:
    """Rooms of up to ``n`` bins; finds the first bin with at least a given room."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room: (bin, room it had). Room must exist."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        had = room[k]
        room[k] = had - size
        leaf = k - self.leaves
        k >>= 1
        while k:
            best = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
            k >>= 1
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, in the order given; equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = Tournament(len(sizes) - full, capacity)
    for k in order[full:].tolist():
        leaf, had = tree.place(int(sizes[k]))
        bins[k], offsets[k] = full + leaf, capacity - had
    return bins, offsets


def pack(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece.

    Null and empty texts are one piece of the end id. Rows with the same or a null doc_id are
    packed each. Ties in length go by (doc_id, start). Sequence ids are unique, not dense. An
    empty table gives no rows; columns besides doc_id and text are ignored.
    """
    s = settings
    ship_package(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    cut = C.materialise(pieces(docs, s), "pieces")
    groups = max(1, -(-cut.count() // s.group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(s.seed), "doc_id", "row", "start"), F.lit(groups)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = t.column(0)[0].as_py()
            bins, offsets = first_fit_decreasing(t.column(3).to_numpy(), s.capacity)
            return pa.RecordBatch.from_arrays(
                [*t.columns[1:], pa.array((group << 24) + bins, pa.int64()), pa.array(offsets, pa.int64())], names=names)
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
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return (dealt.select("group", *names[:5]).repartition("group").sortWithinPartitions("group", "doc_id", "start", "ids_crc32")
            .mapInArrow(task, ", ".join(f"{n} long" for n in names)))
