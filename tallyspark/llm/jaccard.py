"""Exact n-gram Jaccard join: blocked sparse products of the document by n-gram incidence.

A document's set is its distinct word shingles (case-folded A-Z), as 64-bit hashes. With a
global order of shingles, two sets with Jaccard >= t share one of the first
``n - ceil(t n) + 1`` shingles of each. So:

   It shares l of them if each prefix is l - 1 longer; here l is a tenth of the set.

1. Shingle frequencies are counted over all documents in a table of fixed size (hashed); the
   order puts frequent ones last, so that common passages don't gather unlike documents.
2. Every distinct set emits its prefix; shingles of two or more sets give the blocks of the
   incidence matrix that can hold linked pairs. Sets with fewer than l shared shingles go;
   then the plain prefixes are enough, and of blocks with the same sets one stays. Histograms
   of the sets by hash bound the overlap of each pair in a block; pairs below the need are
   out, and the block falls into the groups that the others form.
3. A block's product is accumulated over slices of its columns. Pairs whose overlap can no
   longer reach ``t / (1 + t) * (n_a + n_b)`` are discarded; what stays is decided on the
   exact integers. A block returns a spanning forest of its links, never all pairs.
   Blocks over a set size are cut into tiles of two chunks each.
4. Blocks that share sets form a family. The sets of a family of up to ``family_parts`` chunks
   are multiplied with one another at once, so each moves as often as there are chunks. In
   larger families every set first joins its two largest blocks only (the largest, and the
   largest of at most ``small_block`` sets); other blocks are multiplied only if they have
   sets in different components that haven't met in those.

Equal sets are one vertex throughout. Vertices are 64-bit fingerprints of the sets: for
10^6 distinct sets the chance that any two agree is about 3e-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm.components import components
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    shingle: int = 4
    percent: int = 85                   #: least Jaccard similarity in hundredths
    frequency_bits: int = 20            #: log2 of the size of the hashed frequency table
    block_sets: int = 1024              #: sets of a chunk of a block
    block_bytes: int = 16 << 20         #: bytes of the sets of a chunk
    family_parts: int = 4               #: chunks of a family that is multiplied as one block
    small_block: int = 32
    slice_columns: int = 2048           #: columns multiplied at once
    broadcast_ids: int = 1_000_000      #: up to so many ids (8 MB) are broadcast; more are shuffled


_CODES = C.byte_codes(211, fold_case=True)
_G48 = np.uint64((1 << 48) - 1)
_FLAT = np.zeros(1, np.uint8)  # an order without frequencies
_ROWS = 4000  # rows of a chunk of text: their number is put above 4 + 48 bits


def shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each k-word shingle; a row with 1 to k-1 words has one of all of them."""
    starts, ends, rows = C.words(buf, offs)
    h = C.span_hashes(buf, starts, ends, _CODES)
    g, at = C.ngram_hashes(h, rows, k)
    n = np.bincount(rows, minlength=len(offs) - 1)
    for size in range(1, k):
        if len(short := np.flatnonzero(n == size)):
            first = np.searchsorted(rows, short)
            x = np.full(len(short), size, np.uint64)
            for j in range(size):
                x = C.mix(x * np.uint64(31) + h[first + j])
            g, at = np.concatenate((g, x)), np.concatenate((at, short))
    return g, at


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at in range(0, len(column), _ROWS):
        for lo, hi, buf, offs in C.text_batches(column.slice(at, _ROWS)):
            yield at + lo, at + hi, buf, offs


def frequency_levels(docs: DataFrame, s: Settings) -> np.ndarray:
    """Level 0 to 15 of each hash slot: 0 for ordinary counts, more with each doubling."""
    size, parts = 1 << s.frequency_bits, 64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for _, _, buf, offs in _chunks(b.column(0)):
                g, _ = shingles(buf, offs, s.shingle)
                np.add.at(total, (g & np.uint64(size - 1)).astype(np.int64), 1)
        blocks = np.split(total.astype(np.int32), parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "blob"])

    counts = C.sum_blobs(C.few_tasks(C.only(docs, "text")).mapInArrow(task, "block int, blob binary"))
    total = np.concatenate([counts.get(k, np.zeros(size // parts, np.int64)) for k in range(parts)])
    usual = total.mean() + 6 * np.sqrt(total.mean()) + 8
    return np.clip(np.ceil(np.log2(np.maximum(total, 1) / usual)), 0, 15).astype(np.uint8)


def _sorted_sets(buf: np.ndarray, offs: np.ndarray, s: Settings, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (level, 48-bit shingle) keys in order, row after row; and where each row begins."""
    g, rows = shingles(buf, offs, s.shingle)
    level = levels[(g & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64)
    key = (rows.astype(np.uint64) << np.uint64(52)) | (level << np.uint64(48)) | (g >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    cuts = np.searchsorted(key, np.arange(len(offs), dtype=np.uint64) << np.uint64(52))
    return key & np.uint64((1 << 52) - 1), cuts


def _prints(key: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each row's set; 0 only for the empty set."""
    n = np.diff(cuts)
    out = np.zeros(len(n), np.uint64)
    if have := np.flatnonzero(n).tolist():
        x = C.mix((key & _G48) + np.uint64(0x632BE59BD9B4E019))
        out[have] = C.mix(np.add.reduceat(x, cuts[:-1][have]) + n[have].astype(np.uint64)) | np.uint64(1)
    return out.view(np.int64)


def size_steps(n: np.ndarray, percent: int) -> np.ndarray:
    """Log size in 1/256 of the widest ratio of linked sets: linked ones differ by 257 at most."""
    return (np.log(np.maximum(n, 1)) / np.log(100 / percent) * 256).astype(np.int64) if percent < 100 else n * 300


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1 + n // 10


def least_shared(n: str, percent: int) -> Column:
    """How many prefix shingles a set of n shares with any set linked to it: l of the smaller one."""
    return F.expr(f"1 + (({n} * {percent} + 99) div 100) div 10")


def documents(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, fp) of each row: the size and the fingerprint of its set."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in _chunks(b.column(1)):
                key, cuts = _sorted_sets(buf, offs, s, _FLAT)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(_prints(key, cuts), pa.int64())],
                    names=["doc_id", "n", "fp"])
    return C.only(docs, "doc_id", "text").mapInArrow(task, "doc_id long, n long, fp long")


def prefixes(docs: DataFrame, levels: np.ndarray, s: Settings) -> DataFrame:
    """(gram, fp): the prefix shingles of each distinct set, at least once.

    ``gram`` has the 48-bit shingle, 15 bits of the set's log size, and 0 in the last bit
    where the shingle is in the plain prefix (l = 1).
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo, hi, buf, offs in _chunks(b.column(1)):
                key, cuts = _sorted_sets(buf, offs, s, shared.value)
                n, fp = np.diff(cuts), _prints(key, cuts)
                new = np.zeros(hi - lo, bool)
                for i, (x, known) in enumerate(zip(fp.tolist(), b.column(0).slice(lo, hi - lo).is_valid().to_pylist(), strict=True)):
                    if known and x not in seen:
                        seen.add(x)
                        new[i] = True
                take = np.where(new & (n > 0), prefix_length(n, s.percent), 0)
                rows = np.repeat(np.arange(hi - lo), take)
                rank = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                beyond = rank >= (prefix_length(n, s.percent) - n // 10)[rows]
                size = np.minimum(size_steps(n, s.percent), 32767).astype(np.uint64) << np.uint64(1)
                gram = ((key[rank + cuts[:-1][rows]] & _G48) << np.uint64(16)) | size[rows] | beyond
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64), pa.int64()), pa.array(fp[rows], pa.int64())], names=["gram", "fp"])
    return C.only(docs, "doc_id", "text").mapInArrow(task, "gram long, fp long")


def shared_grams(rows: DataFrame) -> DataFrame:
    """(gram, fp, plain): prefix rows whose shingle another set of a size within the bound has too."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, prints = [], []
        for b in batches:
            grams.append(b.column(0).to_numpy(zero_copy_only=False))
            prints.append(b.column(1).to_numpy(zero_copy_only=False))
        if not grams:
            return
        x, f = np.concatenate(grams).view(np.uint64), np.concatenate(prints)
        order = np.argsort(x, kind="stable")
        x, f = x[order], f[order]

        def near(x: np.ndarray) -> np.ndarray:  # to the next row: same shingle, size within the bound
            return ((x[1:] >> np.uint64(16)) == (x[:-1] >> np.uint64(16))) & ((x[1:] >> np.uint64(1)) - (x[:-1] >> np.uint64(1)) <= np.uint64(257))
        n = near(x)
        some = np.concatenate((n, [False])) | np.concatenate(([False], n))
        x, f = x[some], f[some]
        order = np.lexsort((f, x))
        x, f = x[order], f[order]
        first = np.ones(len(x), bool)  # a set may come from several tasks: once is enough
        first[1:] = (x[1:] != x[:-1]) | (f[1:] != f[:-1])
        x, f = x[first], f[first]
        if not len(x):
            return
        n = near(x)
        some = np.concatenate((n, [False])) | np.concatenate(([False], n))
        yield pa.RecordBatch.from_arrays(
            [pa.array((x[some] >> np.uint64(16)).view(np.int64), pa.int64()), pa.array(f[some], pa.int64()), pa.array((x[some] & np.uint64(1)) == 0)],
            names=["gram", "fp", "plain"])
    return rows.repartition(F.shiftrightunsigned("gram", 16)).mapInArrow(task, "gram long, fp long, plain boolean")


def pruned(shared: DataFrame, sizes: DataFrame, s: Settings, rounds: int = 2) -> DataFrame:
    """(gram, fp) of plain prefixes, without sets that share too little, equal blocks once."""
    def in_two(rows: DataFrame) -> DataFrame:
        two = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
        return rows.join(two, "gram").select("gram", "fp", "plain")
    for _ in range(rounds):
        enough = (shared.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).join(sizes, "fp")
                  .where(F.col("k") >= least_shared("n", s.percent)).select("fp"))
        shared = C.materialise(in_two(shared.join(enough, "fp")), "shared")
    plain = C.materialise(in_two(shared.where("plain")), "plain")
    return _distinct_blocks(plain.select("gram", "fp"))


def _pack(keys: np.ndarray) -> bytes:
    """48-bit shingles as 6 bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def set_table(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """(fp, n, grams binary): the whole sets of the documents in ``ids`` (doc_id, fp).

    One row per fp and task: rows that repeat a document come once from a task.
    """
    if ids.count() <= s.broadcast_ids:
        ids = F.broadcast(ids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo, hi, buf, offs in _chunks(b.column(1)):
                key, cuts = _sorted_sets(buf, offs, s, _FLAT)
                want = b.column(0).slice(lo, hi - lo).to_pylist()
                keep = []
                for i, (f, w) in enumerate(zip(_prints(key, cuts).tolist(), want, strict=True)):
                    if f == w and f not in seen:
                        seen.add(f)
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([
                    pa.array([want[i] for i in keep], pa.int64()), pa.array(np.diff(cuts)[keep], pa.int64()),
                    pa.array([_pack(key[cuts[i]:cuts[i + 1]]) for i in keep], pa.binary())], names=["fp", "n", "grams"])
    rows = C.only(docs, "doc_id", "text").join(ids, "doc_id").select("fp", "text")
    return rows.mapInArrow(task, "fp long, n long, grams binary")


def linked_pairs(sets: list[np.ndarray], apart: np.ndarray, left: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of linked sets, a below ``left``; not those with equal ``apart``."""
    n = np.array([len(x) for x in sets], np.int64)
    need = ((n[:left, None] + n[None, :]) * s.percent + 99 + s.percent) // (100 + s.percent)  # ceil(t / (1 + t) * sum)
    alive = (np.minimum(n[:left, None], n[None, :]) >= need) & (apart[:left, None] != apart[None, :])
    return overlapping(sets, alive, need, s)


BINS = 256


def histogram(grams: np.ndarray) -> bytes:
    """Shingles by the low bits of their hash, a byte a bin; nothing where a bin overflows."""
    count = np.bincount((grams & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    return count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else b""


def hopeful_pairs(bins: list[bytes], n: np.ndarray, left: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b, a below ``left``) whose histograms allow the overlap of linked sets.

    The sum of the lesser counts bounds the overlap; sets without a histogram aren't bounded.
    """
    own = np.array([len(h) > 0 for h in bins])
    table = np.frombuffer(b"".join(h or bytes(BINS) for h in bins), np.uint8).reshape(-1, BINS)
    out_a, out_b = [], []
    for k in range(left):
        need = ((n[k] + n) * s.percent + 99 + s.percent) // (100 + s.percent)
        at = np.flatnonzero((np.arange(len(n)) > k) & (np.minimum(n[k], n) >= need))
        if len(at):
            most = np.minimum(table[k], table[at]).sum(axis=1, dtype=np.int64)
            at = at[(most >= need[at]) | ~own[at] | ~own[k]]
            out_a.append(np.full(len(at), k))
            out_b.append(at)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def overlapping(sets: list[np.ndarray], alive: np.ndarray, need: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) with ``alive[a, b]`` that have ``need[a, b]`` shingles in common.

    The sparse product of the rows of ``alive`` with all sets, over slices of the columns.
    Pairs whose count can't reach the need with what is still to come drop out.
    """
    m, left = len(sets), len(alive)
    n = np.array([len(x) for x in sets], np.int64)
    alive = alive & (np.arange(left)[:, None] < np.arange(m)[None, :])
    if not alive.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows_on, cols_on = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
    used = np.union1d(rows_on, cols_on)
    grams = np.concatenate([sets[i] for i in used])
    own = np.repeat(used, n[used])
    _, col = np.unique(grams, return_inverse=True)
    twice = np.bincount(col)[col] > 1  # a shingle of one set adds to no overlap
    _, col = np.unique(col[twice], return_inverse=True)
    own = own[twice]
    order = np.argsort(col, kind="stable")
    own, col = own[order], col[order]
    width = int(col[-1]) + 1 if len(col) else 0
    count = np.zeros((len(rows_on), len(cols_on)), np.float32)
    r_at, c_at = np.full(m, -1), np.full(m, -1)
    r_at[rows_on], c_at[cols_on] = np.arange(len(rows_on)), np.arange(len(cols_on))
    later = np.bincount(own, minlength=m).astype(np.int64)  # shingles of each set in the slices to come
    live, need = alive[np.ix_(rows_on, cols_on)], need[np.ix_(rows_on, cols_on)]
    for at in range(0, width, s.slice_columns):
        lo, hi = np.searchsorted(col, (at, at + s.slice_columns))
        o, c = own[lo:hi], col[lo:hi] - at
        w = min(s.slice_columns, width - at)
        a, b = np.zeros((len(rows_on), w), np.float32), np.zeros((len(cols_on), w), np.float32)
        a[r_at[o[r_at[o] >= 0]], c[r_at[o] >= 0]] = 1
        b[c_at[o[c_at[o] >= 0]], c[c_at[o] >= 0]] = 1
        count += a @ b.T
        later -= np.bincount(o, minlength=m)
        if at + w < width:
            live &= count + np.minimum(later[rows_on][:, None], later[cols_on][None, :]) >= need
            if not live.any():
                return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.nonzero(live & (count >= need))
    return rows_on[a], cols_on[b]


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _forest(a: np.ndarray, b: np.ndarray, m: int) -> list[tuple[int, int]]:
    up = list(range(m))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = _root(up, x), _root(up, y)
        if p != q:
            up[p] = q
            out.append((x, y))
    return out


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first ``keys`` columns, of sorted batches: (key, columns)."""
    now, held = None, None
    for b in batches:
        cols = [c.to_pylist() for c in b.columns]
        heads = list(zip(*cols[:keys], strict=True))
        lo = 0
        for i in range(1, len(heads) + 1):
            if i == len(heads) or heads[i] != heads[lo]:
                part = [c[lo:i] for c in cols[keys:]]
                if heads[lo] == now:
                    for x, y in zip(held, part, strict=True):
                        x.extend(y)
                else:
                    if now is not None:
                        yield now, held
                    now, held = heads[lo], part
                lo = i
    if now is not None:
        yield now, held


def _tiles(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The rows (gram, i, j, side, fp, apart, n, grams) of each tile of each block, in order.

    Blocks over ``block_sets`` sets or ``block_bytes`` are cut into chunks by a hash; each
    pair of chunks is one tile.
    """
    rows = members.join(sets.select("fp", "n").dropDuplicates(["fp"]), "fp")
    size = rows.groupBy("gram").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / s.block_sets), F.ceil(F.sum("n") * 6 / s.block_bytes), F.lit(1)).cast("int").alias("parts"))
    rows = rows.join(size, "gram").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = rows.select("gram", "fp", "apart", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "gram", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "fp", "apart")
    full = tiles.join(sets.select("fp", "n", "grams"), "fp").select("gram", "i", "j", "side", "fp", "apart", "n", "grams")
    return full.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")


def _sides(i: int, j: int, side: list[int], fp: list[int]) -> tuple[list[int], int]:
    """A tile's rows, each set once, those of the first chunk first; and how many are multiplied with all."""
    order = sorted({f: k for k, f in enumerate(fp)}.values(), key=side.__getitem__)
    return order, len(order) if i == j else sum(side[k] == 0 for k in order)


def block_links(members: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(u, v): a spanning forest of the links inside each tile of ``members`` (gram, fp, apart)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (side, fp, apart, _, grams) in by_group(batches, 3):
            order, left = _sides(i, j, side, fp)
            a, b = linked_pairs([_unpack(grams[k]) for k in order], np.array([apart[k] for k in order]), left, s)
            if edges := _forest(a, b, len(order)):
                yield pa.RecordBatch.from_arrays([
                    pa.array([fp[order[x]] for x, _ in edges], pa.int64()), pa.array([fp[order[y]] for _, y in edges], pa.int64())], names=["u", "v"])
    return _tiles(members, sets, s).mapInArrow(task, "u long, v long")


def hopeful(blocks: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """``blocks`` (gram, fp) cut into groups of sets that histograms leave as possible links.

    In a block over ``block_sets`` sets each tile is cut on its own.
    """
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([histogram(_unpack(x.as_py())) for x in b.column(2)], pa.binary())], names=["fp", "n", "grams"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (gram, i, j), (side, fp, _, n, hist) in by_group(batches, 3):
            order, left = _sides(i, j, side, fp)
            a, b = hopeful_pairs([hist[k] for k in order], np.array([n[k] for k in order], np.int64), left, s)
            if not len(a):
                continue
            up = list(range(len(order)))
            for x, y in _forest(a, b, len(order)):
                p, q = _root(up, x), _root(up, y)
                up[max(p, q)] = min(p, q)
            kept = np.union1d(a, b).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.array([gram] * len(kept), pa.int64()), pa.array([fp[order[_root(up, k)]] for k in kept], pa.int64()),
                pa.array([i] * len(kept), pa.int32()), pa.array([j] * len(kept), pa.int32()),
                pa.array([fp[order[k]] for k in kept], pa.int64())], names=["gram", "head", "i", "j", "fp"])
    table = C.materialise(sets.mapInArrow(bins, "fp long, n long, grams binary"), "bins")
    rows = blocks.select("gram", "fp", F.col("fp").alias("apart"))
    found = _tiles(rows, table, s).mapInArrow(task, "gram long, head long, i int, j int, fp long")
    groups = found.select(F.xxhash64("gram", "head", "i", "j").alias("gram"), "fp")
    return _distinct_blocks(C.materialise(groups, "groups"))


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    """Of blocks with the same sets, one."""
    members = blocks.groupBy("gram").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("fp")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("b"))
    return blocks.join(members.groupBy("k", "a", "b").agg(F.min("gram").alias("gram")).select("gram"), "gram").select("gram", "fp")


def candidate_links(shared: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """(u, v): edges with the components of all links between sets that share a block (gram, fp)."""
    stars = shared.join(shared.groupBy("gram").agg(F.min("fp").alias("v")), "gram").select(F.col("fp").alias("u"), "v")
    family = C.materialise(components(stars).select(F.col("u").alias("fp"), F.col("component").alias("family")), "families")
    size = family.join(sets.select("fp", "n").dropDuplicates(["fp"]), "fp").groupBy("family").agg(
        (F.greatest(F.ceil(F.count(F.lit(1)) / s.block_sets), F.ceil(F.sum("n") * 6 / s.block_bytes)) > s.family_parts).alias("large"))
    family = C.materialise(family.join(size, "family"), "families")
    small = family.where("not large").select(F.col("family").alias("gram"), "fp", F.col("fp").alias("apart"))
    shared = C.materialise(shared.join(family.where("large").select("fp"), "fp").select("gram", "fp"), "large")

    if shared.isEmpty():  # no large family: nothing is left to do
        return C.materialise(block_links(small, sets, s), "links")
    sized = shared.join(shared.groupBy("gram").agg(F.count(F.lit(1)).alias("k")), "gram")
    order = F.struct("k", "gram")
    first = C.materialise(sized.groupBy("fp").agg(
        F.max_by("gram", order).alias("a"), F.max_by("gram", F.when(F.col("k") <= s.small_block, order)).alias("b")).withColumn("b", F.coalesce("b", "a")), "first")
    two = first.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("gram"), "fp", F.col("fp").alias("apart"))
    edges = C.materialise(block_links(small.union(two), sets, s), "links")
    near = C.materialise(components(edges), "near")
    where = shared.join(first, "fp").join(near.withColumnRenamed("u", "fp"), "fp", "left").select(
        "gram", "fp", "a", "b", F.coalesce("component", "fp").alias("apart"))
    several = [F.min(c) != F.max(c) for c in ("apart", "a", "b")]
    open_ = where.groupBy("gram").agg((several[0] & several[1] & several[2]).alias("open")).where("open").select("gram")
    return edges.union(block_links(where.join(open_, "gram").select("gram", "fp", "apart"), sets, s))


def jaccard_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links. Null and empty texts, and
    texts of white space only, have 0 shingles and their own id. Equal texts under several
    ids, repeated rows and ties are linked like any other pair; a row with a null doc_id gets
    its count and a null component. An empty table gives no rows; columns besides doc_id and
    text are ignored.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    levels = frequency_levels(docs, s)
    per_doc = C.materialise(documents(docs, s), "documents")
    known = per_doc.where("doc_id is not null and n > 0")
    first = C.materialise(known.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "distinct")
    shared = C.materialise(shared_grams(prefixes(docs, levels, s)), "shared")
    shared = C.materialise(pruned(shared, first.select("fp", "n"), s), "blocks")
    sets = C.materialise(set_table(docs, first.select("fp", "doc_id").join(shared.select("fp").distinct(), "fp"), s), "sets")

    shared = C.materialise(hopeful(shared, sets, s), "hopeful")
    edges = candidate_links(shared, sets, s)
    final = components(edges)

    # the smallest id of each component of sets, then of each set
    of_set = first.join(final.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("component", "fp").alias("c"))
    least = of_set.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_set = of_set.join(least, "c").select("fp", "component_id")
    linked = known.join(of_set, "fp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = per_doc.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def representatives(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component (see jaccard_components).

    The document with the component's smallest id stays; of several rows with that id, the
    first by text. Documents without words and rows with a null doc_id all stay. An empty table
    gives no rows.
    """
    s = settings or Settings()
    found = C.materialise(jaccard_components(docs, s), "components")
    gone = found.where("component_id != doc_id").select("doc_id")
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k"), F.max("n_shingles").alias("m")).where("k > 1 and m > 0").select("doc_id")
    lists = []
    for ids in (gone.union(again), again.join(gone, "doc_id", "left_anti")):
        ids = C.materialise(ids.distinct(), "ids")
        lists.append(F.broadcast(ids) if ids.count() <= s.broadcast_ids else ids)
    once = docs.join(lists[0], "doc_id", "left_anti").select(docs.columns)
    rank = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    place = "_rank" + "_" * max(len(c) for c in docs.columns)  # longer than any of the columns
    more = docs.join(lists[1], "doc_id", "left_semi").select("*", F.row_number().over(rank).alias(place)).where(F.col(place) == 1).select(docs.columns)
    return once.union(more)
