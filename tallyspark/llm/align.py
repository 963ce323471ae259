"""Alignment of two tokenizers: the smallest groups of tokens that cover the same bytes.

Both tokenizers cut the same bytes (a space and the text), A byte-level merges, B pieces. Every
token points to its farthest-right overlapping token of the other side: the one that covers
its last byte; a B token that ends where an A token ends points to itself. Doubling the
pointers (successor of successor) for all tokens of a batch at once brings each to the
terminal token of its component in log many steps, and the terminal labels the group.

Two tokens whose ranges end together are linked. How often each pair of ids is linked is
counted over the corpus. Pairs with more than 1 / ``often`` of all links, of which there can't
be ``often``, come to the documents by broadcast; the links of the others are shuffled to their
counts, and none of these pairs is a hot key. Texts are read once; documents then move as one
short row each.
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
from tallyspark.llm.bytebpe import tokenizer
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    bytes_file: str             #: path of a byte-level ``tokenizers`` file (A), the same on all machines
    pieces_file: str            #: path of a sentencepiece model with byte pieces (B)
    often: int = 1 << 21        #: bound of the broadcast pairs (24 bytes each)
    chunk: int = 1 << 19        #: characters aligned at once (or one longer text)


class Pair:
    """Both tokenizers and what each id stands for."""

    def __init__(self, s: Settings) -> None:
        import sentencepiece
        self.a = tokenizer(s.bytes_file, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=s.pieces_file)
        n = self.b.get_piece_size()
        self.raw_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else b"" if self.b.is_control(k) or self.b.is_unknown(k) else p.replace("▁", " ").encode()
                      for k, p in ((k, self.b.id_to_piece(k)) for k in range(n))]
        self.size_a = np.array([len(x) for x in self.a.raw], np.int64)
        self.size_b = np.array([len(x) for x in self.raw_b], np.int64)
        self.n_b = n

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """A and B ids of each text; none where the text is null or empty or either side changes its bytes."""
        a = [self.a.ids(" " + t) if t else [] for t in texts]
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            whole = (" " + t).encode() if t else b""
            if not t or b"".join([self.a.raw[k] for k in a[i]]) != whole or b"".join([self.raw_b[k] for k in b[i]]) != whole:
                a[i], b[i] = [], []
        return a, b


_PAIRS: dict[Settings, Pair] = {}


def pair_of(s: Settings) -> Pair:
    if s not in _PAIRS:
        _PAIRS[s] = Pair(s)
    return _PAIRS[s]


def terminals(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terminal B token of each A and each B token; both sides cover the same bytes without gaps.

    Tokens are numbered A first, then B; ends ascend and may run over many documents.
    """
    n = len(end_a)
    to_b = n + np.searchsorted(end_b, end_a)
    at = np.searchsorted(end_a, end_b)
    to_a = np.where(end_a[at] == end_b, n + np.arange(len(end_b)), at) if n else at
    after = np.concatenate([to_b, to_a])
    while True:
        farther = after[after]
        if np.array_equal(farther, after):
            return after[:n] - n, after[n:] - n
        after = farther


class Digits:
    """Decimal digits of small numbers as byte columns."""

    def __init__(self, most: int) -> None:
        text = [str(k).encode() for k in range(most)]
        self.size = np.array([len(t) for t in text])
        self.text = np.array(text, f"S{int(self.size.max())}").view(np.uint8).reshape(most, -1)


_DIGITS: dict[int, Digits] = {}


def written(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts of A tokens) of ``a1,a2|b1;a3|b2,b3;``, groups in order."""
    d = _DIGITS.get(most) or _DIGITS.setdefault(most, Digits(most))
    place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
    ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    for place, own, group, last in ((place_a, ids_a, group_a, b"|"), (place_b, ids_b, group_b, b";")):
        ids[place] = own
        sign[place] = np.where(np.append(group[1:] == group[:-1], False), ord(","), ord(last))
    size = d.size[ids]
    start = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), np.uint8)
    out[start + size] = sign
    for k in range(d.text.shape[1]):
        some = size > k
        out[start[some] + k] = d.text[ids[some], k]
    return out, start[place_a]


@dataclass
class Aligned:
    """What a run of documents comes to, one number per document, and its distinct links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray    #: as many as links: ends ascend on both sides
    groups: list[bytes]     #: each document's groups as text
    links: list[np.ndarray]  #: distinct A id * B's size + B id
    times: list[np.ndarray]


def align(texts: list[str | None], pair: Pair) -> Aligned:
    list_a, list_b = pair.tokens(texts)
    n_a, n_b = (np.array([len(x) for x in lists], np.int64) for lists in (list_a, list_b))
    a, b = (np.fromiter((k for x in lists for k in x), np.int64, int(n.sum())) for lists, n in ((list_a, n_a), (list_b, n_b)))
    of_b = np.repeat(np.arange(len(texts)), n_b)
    end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    group_a, group_b = terminals(end_a, end_b)
    last = np.flatnonzero(group_b == np.arange(len(b)))  # the terminals; each ends where one A token ends
    text, start = written(group_a, a, group_b, b, max(len(pair.size_a), pair.n_b))
    cuts = np.append(start, len(text))[np.concatenate([[0], np.cumsum(n_a)])]
    code = a[np.searchsorted(end_a, end_b[last])] * pair.n_b + b[last]
    order = np.lexsort((code, of_b[last]))
    doc, code = of_b[last][order], code[order]
    new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    times = np.diff(np.append(new, len(code)))
    at = np.searchsorted(doc[new], np.arange(1, len(texts)))
    n = np.bincount(of_b[last], minlength=len(texts))
    return Aligned(n_a, n_b, n, [text[lo:hi - 1].tobytes() if hi > lo else b"" for lo, hi in zip(cuts, cuts[1:], strict=False)],
                   np.split(code[new], at), np.split(times, at))


def aligned(docs: DataFrame, s: Settings, digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups, links, times): distinct links as 8-byte and their times as 4-byte numbers.

    ``groups`` is their text, some four times as long as the document's, or only its SHA-256 in hex.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(s)
        for b in batches:
            texts, size, lo = [], 0, 0
            for i, t in enumerate(b.column(2)):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size >= s.chunk or i + 1 == b.num_rows:
                    x = align(texts, pair)
                    if digest:
                        x.groups = [hashlib.sha256(g).hexdigest().encode() if g else b"" for g in x.groups]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(lo, len(texts)), b.column(1).slice(lo, len(texts)), *[pa.array(c, pa.int64()) for c in (x.n_a, x.n_b, x.n_groups)],
                         pa.array(x.groups, pa.binary()), pa.array([c.astype("<i8").tobytes() for c in x.links], pa.binary()),
                         pa.array([c.astype("<u4").tobytes() for c in x.times], pa.binary())], names=names)
                    texts, size, lo = [], 0, i + 1
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups", "links", "times"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(task, "row long, doc_id long, n_a long, n_b long, n_groups long, groups binary, links binary, times binary")


def _flat(b: pa.RecordBatch, links: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, times, number of distinct links of each row) of a batch."""
    parts = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(links)]
    many = [np.frombuffer(x.as_buffer(), "<u4") for x in b.column(times)]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.concatenate([np.zeros(0, np.int64), *many]).astype(np.int64), np.array([len(p) for p in parts], np.int64)


def _merged(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(code, return_inverse=True)
    out = np.zeros(len(code), np.int64)
    np.add.at(out, at, n)
    return code, out


def pair_counts(rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """(code, n): how many links of the corpus have each pair of ids. A task holds some ``most`` pairs before it sends them on."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            held.append(_flat(b, 0, 1)[:2])
            if sum(len(c) for c, _ in held) >= most:
                code, n = _merged(np.concatenate([code, *[c for c, _ in held]]), np.concatenate([n, *[k for _, k in held]]))
                held = []
                if len(code) >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])
                    code, n = code[:0], n[:0]
        code, n = _merged(np.concatenate([code, *[c for c, _ in held]]), np.concatenate([n, *[k for _, k in held]]))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])
    return rows.select("links", "times").mapInArrow(task, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def scored(rows: DataFrame, counts: DataFrame, n_b: int, s: Settings) -> DataFrame:
    """(row, n_best, count_sum) of every row, from the corpus counts."""
    best = counts.groupBy((F.col("code") % n_b).alias("_b")).agg(F.max("n").alias("_best"))  # at most one row per B id
    judged = C.materialise(counts.join(F.broadcast(best), F.col("code") % n_b == F.col("_b")).select("code", "n", (F.col("n") == F.col("_best")).alias("best")), "pairs")
    total = judged.agg(F.sum("n")).first()[0] or 0
    often = judged.where(F.col("n") > total / s.often).toArrow()
    order = np.argsort(often["code"].to_numpy(), kind="stable")
    shared = rows.sparkSession.sparkContext.broadcast((often["code"].to_numpy()[order], often["n"].to_numpy()[order], often["best"].to_numpy()[order]))

    def look_up(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each code among the frequent ones, whether it is one)."""
        known = shared.value[0]
        at = np.searchsorted(known, code)
        return at, (np.append(known, -1)[at] == code)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, times, each = _flat(b, 1, 2)
            at, ok = look_up(code)
            times = np.where(ok, times, 0)
            ends = np.concatenate([[0], np.cumsum(each)])
            sums = []
            for weight in (shared.value[2], shared.value[1]):
                run = np.concatenate([[0], np.cumsum(times * np.append(weight, 0).astype(np.int64)[at])])
                sums.append(pa.array(run[ends[1:]] - run[ends[:-1]]))
            yield pa.RecordBatch.from_arrays([b.column(0), *sums], names=["row", "n_best", "count_sum"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, times, each = _flat(b, 1, 2)
            rare = ~look_up(code)[1]
            row = np.repeat(b.column(0).to_numpy(), each)
            yield pa.RecordBatch.from_arrays([pa.array(row[rare]), pa.array(code[rare]), pa.array(times[rare])], names=["row", "code", "times"])
    links = rows.select("row", "links", "times")
    rest = links.mapInArrow(far, "row long, code long, times long").join(judged.where(F.col("n") <= total / s.often).hint("merge"), "code")
    each = links.mapInArrow(near, "row long, n_best long, count_sum long").unionByName(
        rest.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("n") * F.col("times")).alias("count_sum")))
    return each.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, settings: Settings) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) for every row of ``docs``.

    ``groups`` is the text ``a1,a2|b1;a3|b2,b3`` of ids in order, as bytes. ``n_best`` counts the
    links whose pair is the corpus' most frequent one of its B id (ties too), ``count_sum`` sums
    the corpus counts of all links' pairs. Texts that are null or empty, or that either
    tokenizer does not give back byte by byte behind a space, have no tokens: zeros and empty
    groups. Special tokens named in a text are plain text. Repeated rows and rows with the same
    or a null doc_id are aligned, and counted, each. An empty table gives no rows; columns
    besides doc_id and text are ignored.
    """
    return _with_scores(docs, settings, digest=False)


def _with_scores(docs: DataFrame, s: Settings, digest: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    rows = C.materialise(aligned(docs, s, digest), "aligned")
    n_b = pair_of(s).n_b
    found = scored(rows, C.materialise(pair_counts(rows), "pair-counts"), n_b, s)
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups").join(found.hint("merge"), "row")


def digests(docs: DataFrame, settings: Settings) -> DataFrame:
    """``alignment`` with the SHA-256 of the groups (empty without tokens) in place of their text."""
    return _with_scores(docs, settings, digest=True).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").cast("string").alias("groups_sha256"))
