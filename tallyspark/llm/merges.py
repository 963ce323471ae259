"""SentencePiece merge segmentation with seeded merge-dropout, and its lossless decoding.

Candidate merges of neighbouring symbols wait in an agenda, best score first, then leftmost.
When one comes up, a keyed hash of (seed, document, place of the chunk in the text, place in
the chunk, piece) skips it with probability ``dropout``; what stays unmerged may still merge
otherwise later. Without dropout the result equals the model's own encoding. So every
occurrence of a word in every document has draws of its own.

What doesn't depend on the key is remembered: for a chunk, the candidates that come up and the
ids if none of them is skipped. The draws of many occurrences are then made at once, and only
those that skip something are merged anew, thousands in step: each round takes the next
candidate of every chunk that still has one. Very long chunks are merged one by one.

No piece holds a space mark after another character, and none a line break or tab, so texts
fall into independent chunks there, and before signs that no piece holds behind a letter. Characters outside the vocabulary, and a literal space
mark, are written as byte pieces; so decoding gives back every text exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package

MARK = "▁"


@dataclass(frozen=True)
class Settings:
    model: str                  #: path of a sentencepiece merge model with byte pieces
    dropout: float = 0.1
    seed: int = 41
    memo_chunks: int = 300_000  #: half the bound of the chunks that a worker remembers
    memo_length: int = 48       #: of remembered chunks (characters)


NONE = (1 << 31) - 1   # above every candidate that waits
STEP = 1 << 13         # chunks merged in step
LONGEST = 60           # of their characters: places take 6 bits
GOLD = 0x9E3779B97F4A7C15
WORD = (1 << 64) - 1


def _mix_one(h: int) -> int:
    """common.mix of one number."""
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & WORD
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & WORD
    return h ^ h >> 33


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Pool:
    """Arrays of different lengths in one, by number."""

    def __init__(self, dtype: str) -> None:
        self.data, self.n = np.zeros(1 << 12, dtype), 0
        self.start, self.size, self.rows = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """More arrays, given one after the other, and their lengths."""
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.rows + len(sizes) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.data[self.n:self.n + len(values)] = values
        self.start[self.rows:self.rows + len(sizes)] = self.n + np.cumsum(sizes) - sizes
        self.size[self.rows:self.rows + len(sizes)] = sizes
        self.n, self.rows = self.n + len(values), self.rows + len(sizes)

    def get(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of these numbers, one after the other, and their lengths."""
        sizes = self.size[rows]
        return self.data[_spans(self.start[rows], sizes)], sizes


class Memo:
    """By chunk: its characters, the candidates that come up if none is skipped, and the ids then."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.chars, self.draws, self.ids = Pool("i4"), Pool("u8"), Pool("i4")

    def room(self) -> None:
        if self.ids.rows > 2 * self.most or self.chars.n + self.ids.n + self.draws.n > 40 * self.most:
            self.clear()

    def add(self, chars: np.ndarray, sizes: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, draws: np.ndarray, n_draws: np.ndarray) -> None:
        self.chars.add(chars, sizes)
        self.ids.add(ids, n_ids)
        self.draws.add(draws, n_draws)

    def add_ids(self, ids: list[int]) -> int:
        """Ids without candidates; their number."""
        none, zero = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.add(none, zero, np.array(ids), np.array([len(ids)]), none, zero)
        return self.ids.rows - 1


class Pairs:
    """Which piece two neighbouring symbols make: a hash table of (left, right), asked for many at once."""

    def __init__(self, made: dict[tuple[int, int], int], symbols: int) -> None:
        self.symbols, self.shift = symbols, np.uint64(64 - max(8, (8 * len(made)).bit_length()))
        self.table = np.full(1 << 64 - int(self.shift), -1, np.int64)   # (left, right) << 24 | piece
        pairs = np.array(list(made), np.int64).reshape(-1, 2)
        key = pairs[:, 0] * symbols + pairs[:, 1]
        value, at = key << 24 | np.array(list(made.values()), np.int64), self._place(key)
        while len(at):  # of those that want one free place, one gets it and the others look at the next
            free = self.table[at] < 0
            self.table[at[free]] = value[free]
            left = self.table[at] != value
            value, at = value[left], at[left] + 1 & len(self.table) - 1

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(GOLD) >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = left * self.symbols + right
        at = self._place(key)
        found = self.table[at]
        other = np.flatnonzero((found >> 24 != key) & (found >= 0))
        while len(other):
            at[other] = at[other] + 1 & len(self.table) - 1
            found[other] = some = self.table[at[other]]
            other = other[(some >> 24 != key[other]) & (some >= 0)]
        return np.where(found < 0, -1, found & 0xFFFFFF)


class Codec:
    def __init__(self, path: str) -> None:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(k) for k in range(n)]
        self.rank = [-sp.get_score(k) for k in range(n)]
        self.order = np.append(np.unique(self.rank, return_inverse=True)[1].astype(np.int32), NONE >> 6)
        rng = np.random.default_rng(7)
        self.spice = rng.integers(0, 1 << 63, n).tolist()
        usual = [k for k in range(n) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))]
        self.id = {self.piece[k]: k for k in usual}
        self.byte = {int(self.piece[k][3:5], 16): k for k in range(n) if sp.is_byte(k)}
        self.of_byte = {k: bytes([b]) for b, k in self.byte.items()}
        if len(self.byte) != 256 or any(re.search(f"[^{MARK}]{MARK}|[\n\t]", p) for p in self.id):
            raise ValueError("the model needs byte pieces and pieces that don't go over spaces")
        # a chunk ends between a character that is no sign and a sign that no piece has behind such a one
        signs = {c for c in map(chr, range(33, 127)) if not c.isalnum()}
        glue = {b for p in self.id for a, b in zip(p, p[1:], strict=False) if b in signs and a not in signs and a != MARK}
        q, g = ("".join(map(re.escape, sorted(x))) for x in (signs, glue))
        glued = f"(?:[{g}][{q}]*[^ \\n\\t{MARK}{q}]*)*" if glue else ""
        self.chunks = re.compile(f" *[{q}]*[^ \\n\\t{MARK}{q}]+{glued}| *[{q}]+| +|[\\n\\t]|{MARK}")
        # symbols: the pieces, characters that only longer pieces hold, and at last all that no piece holds
        symbol = self.id | {c: n + k for k, c in enumerate(sorted({c for p in self.id for c in p} - self.id.keys()))}
        self.pieces, self.other = n, n + len(symbol) - len(self.id)
        self.symbol = np.full(0x110000, self.other, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        self.pairs = Pairs({(symbol[p[:m]], symbol[p[m:]]): k for p, k in self.id.items() for m in range(1, len(p))
                            if p[:m] in symbol and p[m:] in symbol}, self.other + 1)
        self.spices = np.array(self.spice, np.uint64)
        self.raw = [self.of_byte.get(k) or (p.replace(MARK, " ").encode() if p in self.id else b"") for k, p in enumerate(self.piece)]

    def draw(self, a: int, k: int) -> int:
        """What a candidate adds to the key: its place in the chunk and its piece."""
        return self.spice[k] + (a + 1) * GOLD & WORD

    def merge(self, chunk: str, skip: Callable[[int, int], bool]) -> list[int]:
        """Ids of a chunk of text (spaces as marks); ``skip`` is asked once about each candidate (place, piece)."""
        ids, rank = self.id, self.rank
        n = len(chunk)
        sym, prev, nxt = list(chunk), list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(rank[k], a, a + 1, k, 2) for a in range(n - 1) if (k := ids.get(chunk[a:a + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, k, size = heappop(agenda)
            left = sym[a]
            if not left or nxt[a] != b or len(left) + len(sym[b]) != size:
                continue  # one of the two has merged meanwhile
            if skip(a, k):
                continue
            sym[a], sym[b] = self.piece[k], ""
            c, p = nxt[b], prev[a]
            nxt[a] = c
            if c >= 0:
                prev[c] = a
                end = c + len(sym[c])
                if (k := ids.get(chunk[a:end])) is not None:
                    heappush(agenda, (rank[k], a, c, k, end - a))
            if p >= 0 and (k := ids.get(chunk[p:a + size])) is not None:
                heappush(agenda, (rank[k], p, a, k, a + size - p))
        out = []
        for x in sym:
            if x:
                k = ids.get(x)
                out += [k] if k is not None else [self.byte[c] for c in x.encode()]
        return out

    def keyed(self, chunk: str, key: int, limit: int) -> list[int]:
        """Ids of a chunk whose occurrence has that key."""
        if chunk == MARK:
            return [self.byte[c] for c in chunk.encode()]
        return self.merge(chunk.replace(" ", MARK), lambda a, k: _mix_one(key ^ self.draw(a, k)) >> 44 < limit)

    def _merge_some(self, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None, limit: int) -> tuple[np.ndarray, ...]:
        """``merge`` of many chunks in step; ``chars`` are code points, spaces as marks.

        Ids of all chunks and how many each has; without keys none is skipped, and what the
        candidates add to a key comes too, with how many each has.
        """
        rows, wide = len(sizes), int(sizes.max()) + 2
        # a column for each chunk, places 1 to size; places are numbered through, and the first and last are no symbols
        at = np.repeat(np.arange(rows), sizes) + _spans(np.ones_like(sizes), sizes) * rows
        code, sym = np.full(wide * rows, -1, np.int32), np.full(wide * rows, self.other, np.int64)
        code[at], sym[at] = chars, self.symbol[chars]
        prev = np.arange(wide * rows) - rows
        nxt = prev + 2 * rows
        made = np.full(wide * rows, -1, np.int64)   # the piece of the symbol there and the next one
        pair = at[(self.symbol[chars] < self.other) & (sym[at + rows] < self.other)]
        made[pair] = self.pairs.get(sym[pair], sym[pair + rows])
        wait = self.order[made] << 6 | np.repeat(np.arange(wide, dtype=np.int32), rows)
        table, owners, draws = wait.reshape(wide, rows), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while True:
            best = table.min(axis=0)
            row = np.flatnonzero(best < NONE >> 6 << 6)
            if not len(row):
                break
            place = (best[row] & 63).astype(np.int64)
            a = place * rows + row
            k = made[a]
            wait[a] = NONE
            draw = self.spices[k] + place.view(np.uint64) * np.uint64(GOLD)
            if keys is None:
                owners.append(row)
                draws.append(draw)
            else:
                go = np.flatnonzero(C.mix(keys[row] ^ draw) >> np.uint64(44) >= limit)
                a, k, row, place = a[go], k[go], row[go], place[go]
            b, p = nxt[a], prev[a]
            c = nxt[b]
            sym[a], code[b], nxt[a], prev[c], wait[b] = k, -1, c, a, NONE
            made[a] = piece = self.pairs.get(k, sym[c])
            wait[a] = self.order[piece] << 6 | place
            made[p] = piece = self.pairs.get(sym[p], k)
            wait[p] = self.order[piece] << 6 | p // rows
        left = np.flatnonzero(code.reshape(wide, rows).T.ravel() >= 0)   # chunk by chunk
        row = left // wide
        sym, code = (x.reshape(wide, rows).T.ravel()[left] for x in (sym, code))
        ids, n = self._ids(sym.astype(np.int32), code)
        count = np.bincount(row, n, rows).astype(np.int64)
        if keys is not None:
            return ids, count
        owner = np.concatenate(owners)
        return ids, count, np.concatenate(draws)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=rows)

    def _ids(self, sym: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters that are no piece as bytes, and how many each has."""
        n, odd = np.ones(len(sym), np.int64), np.flatnonzero(sym >= self.pieces)
        if not len(odd):
            return sym, n
        chars, which = np.unique(code[odd], return_inverse=True)
        lists = [[self.byte[b] for b in chr(c).encode()] for c in chars.tolist()]
        n[odd] = np.array([len(x) for x in lists])[which]
        ids = np.repeat(sym, n)
        ids[_spans((np.cumsum(n) - n)[odd], n[odd])] = list(chain.from_iterable(lists[k] for k in which.tolist()))
        return ids, n

    def merge_all(self, chars: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None = None, limit: int = 0) -> list[np.ndarray]:
        """``_merge_some`` of any number of chunks, those of like length together."""
        order, start, out = np.argsort(sizes, kind="stable"), np.cumsum(sizes) - sizes, []
        for lo in range(0, len(order), STEP):
            some = order[lo:lo + STEP]
            out.append(self._merge_some(chars[_spans(start[some], sizes[some])], sizes[some], None if keys is None else keys[some], limit))
        back, done = np.argsort(order), [np.concatenate(x) for x in zip(*out, strict=True)]
        for k in range(0, len(done), 2):  # back from the order of lengths
            values, n = done[k:k + 2]
            done[k:k + 2] = values[_spans((np.cumsum(n) - n)[back], n[back])], n[back]
        return done

    def _learn(self, new: list[str], memo: Memo) -> None:
        """Remember these chunks."""
        for k, chunk in enumerate(new):
            memo.of[chunk] = memo.ids.rows + k
        sizes = np.array([len(c) for c in new], np.int64)
        chars = np.frombuffer("".join(new).encode("utf-32-le"), "<i4")
        chars = np.where(chars == ord(" "), ord(MARK), chars)
        memo.add(chars, sizes, *self.merge_all(chars, sizes))

    def _chunk_ids(self, chunks: list[str], keys: np.ndarray, limit: int, s: Settings, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        memo.room()
        get = memo.of.get
        at = np.array([get(c, -1) for c in chunks], np.int64)
        new = np.flatnonzero(at < 0).tolist()
        unknown = dict.fromkeys(chunks[i] for i in new)
        if MARK in unknown:  # no space
            memo.of[MARK] = memo.add_ids([self.byte[c] for c in MARK.encode()])
        if short := [c for c in unknown if c != MARK and len(c) <= min(s.memo_length, LONGEST)]:
            self._learn(short, memo)
        for i in new:
            found = get(chunks[i], -1)
            at[i] = found if found >= 0 else memo.add_ids(self.keyed(chunks[i], int(keys[i]), limit))
        ids, n = memo.ids.get(at)
        if not limit:
            return ids, n
        draws, n_draws = memo.draws.get(at)
        skips = np.repeat(np.arange(len(at)), n_draws)[C.mix(np.repeat(keys, n_draws) ^ draws) >> np.uint64(44) < limit]
        skips = skips[np.diff(skips, prepend=-1) > 0]
        if not len(skips):
            return ids, n
        start = np.cumsum(n) - n
        other, n[skips] = self.merge_all(*memo.chars.get(at[skips]), keys[skips], limit)
        start[skips] = len(ids) + np.cumsum(n[skips]) - n[skips]
        return np.concatenate([ids, other])[_spans(start, n)], n

    def _group(self, texts: list[str], keys: list[int], s: Settings, memo: Memo) -> list[np.ndarray]:
        lists = [self.chunks.findall(" " + t) if t else [] for t in texts]
        count = np.array([len(x) for x in lists], np.int64)
        flat, first = list(chain.from_iterable(lists)), np.cumsum(count) - count
        place = np.arange(len(flat)) - np.repeat(first, count)
        of = C.mix(np.repeat(np.array([k & WORD for k in keys], np.uint64), count) + place.astype(np.uint64) * np.uint64(GOLD))
        limit, ids, sizes = int(s.dropout * (1 << 20)), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(flat), 1 << 16):
            some, n = self._chunk_ids(flat[lo:lo + (1 << 16)], of[lo:lo + (1 << 16)], limit, s, memo)
            ids.append(some)
            sizes.append(n)
        end = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.split(np.concatenate(ids), end[first + count][:-1])

    def encode_all(self, texts: Iterable[str], keys: Iterable[int], s: Settings, memo: Memo) -> Iterator[np.ndarray]:
        """Ids of each text under its key."""
        some, theirs, size = [], [], 0
        for text, key in zip(texts, keys, strict=True):
            some.append(text)
            theirs.append(key)
            size += len(text)
            if size > 1 << 19 or len(some) >= 1000:
                yield from self._group(some, theirs, s, memo)
                some, theirs, size = [], [], 0
        if some:
            yield from self._group(some, theirs, s, memo)

    def encode(self, text: str, key: int, s: Settings, memo: Memo) -> list[int]:
        return next(self.encode_all([text], [key], s, memo)).tolist()

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[k] for k in ids]).decode()[1:]


_CODECS: dict[str, Codec] = {}
_MEMOS: dict[Settings, Memo] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def memo_of(s: Settings) -> Memo:
    """The worker's memory, kept from task to task."""
    if s not in _MEMOS:
        _MEMOS[s] = Memo(s.memo_chunks)
    return _MEMOS[s]


def _keyed(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, key, text): a key for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.select("doc_id", F.xxhash64(F.lit(s.seed), "doc_id").alias("key"), "text")


def encode(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, ids) for every row of ``docs``; null and empty texts have no ids.

    Repeated rows are encoded alike, and so are rows with a null doc_id and the same text.
    An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    s = settings
    ship_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = codec(s.model), memo_of(s)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = list(c.encode_all((t.as_py() or "" for t in part.column(2)), part.column(1).to_pylist(), s, memo))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return _keyed(docs, s).mapInArrow(task, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text, no ids the empty text.

    Every row stays, repeated ones and ones with a null doc_id too; an empty table gives no rows.
    """
    s = settings
    ship_package(encoded.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(s.model)
        for b in batches:
            texts = [None if ids is None else c.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def digests(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, text_crc32): encoded, and the decoded text's checksum.

    ``ids_crc32`` is over little-endian unsigned 32-bit ids, ``text_crc32`` over the UTF-8
    bytes of the text decoded from the ids. The ids are as ``encode`` gives them, also for odd
    rows; an empty table gives no rows.
    """
    s = settings
    ship_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, memo = codec(s.model), memo_of(s)
        for b in batches:
            out = []
            for ids in c.encode_all((t.as_py() or "" for t in b.column(2)), b.column(1).to_pylist(), s, memo):
                out.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(c.decode(ids.tolist()).encode())))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)]], names=["doc_id", "n_tokens", "ids_crc32", "text_crc32"])
    return _keyed(docs, s).mapInArrow(task, "doc_id long, n_tokens long, ids_crc32 long, text_crc32 long")
