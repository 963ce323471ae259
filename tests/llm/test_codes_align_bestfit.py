"""Vector codes, cross-tokenizer alignment and best-fit packing against brute force and odd input."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import align, bestfit, bytebpe, codes
from tallyspark.llm import common as C
from tallyspark.llm.queries import tokenizer_file
from test_operators import LONG, SF, frame, odd_rows

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows] + [
        (9001, "Hello World 123 It's <|endoftext|> \t\n  x"), (9002, "é ñ ﬁ 😀 ́ 中文"), (9003, "▁ not lossless"), (9004, ""), (9005, None)]


def library(special):
    t = Tokenizer.from_file(tokenizer_file(BYTES))
    t.encode_special_tokens = not special
    return t


# ---- tokenizer -----------------------------------------------------------------------------

@pytest.mark.parametrize("special", [True, False])
def test_byte_ids_equal_the_library(texts, special):
    own, whole = bytebpe.ByteBpe(tokenizer_file(BYTES), special), library(special)
    assert own.fast is not None
    for text in [t or "" for _, t in texts] + [" " * 5000 + "x", "ab" * 4000]:
        ids = own.ids(text)
        assert ids == whole.encode(text, add_special_tokens=False).ids
        assert b"".join(own.raw[k] for k in ids) == text.encode()
    assert len(own.ids(" " * 400_000)) > 0  # too long a run for the pattern's stack


def test_other_files_go_to_the_library():
    own, whole = bytebpe.ByteBpe.__new__(bytebpe.ByteBpe), Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    own.fast, own.slow, own.special, own.path = None, None, True, tokenizer_file("word_bpe_49k.json")
    assert own.ids("Hello World 123") == whole.encode("Hello World 123", add_special_tokens=False).ids
    spec = {"normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE", "merges": []}, "added_tokens": []}
    assert not bytebpe._plain(spec, {}, bytebpe.byte_of_letter())


# ---- 11: codes -----------------------------------------------------------------------------

def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(code, error) by position in ``rows`` = (vec_id, vector) and the checksum, entry by entry."""
    x = [[int(np.floor(256 * float(v))) for v in vec] for _, vec in rows]
    d = len(x[0]) // parts
    cut = [[v[j * d:(j + 1) * d] for j in range(parts)] for v in x]
    first = sorted(range(len(rows)), key=lambda i: rows[i][0])[:entries]
    books = [[cut[i][j] for i in first] for j in range(parts)]

    def nearest(j, p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(books[j]))
    for _ in range(rounds):
        for j in range(parts):
            of = collections.defaultdict(list)
            for v in cut:
                of[nearest(j, v[j])[1]].append(v[j])
            new = [[sum(c) // len(ps) for c in zip(*ps)] if (ps := of[k]) else books[j][k] for k in range(len(books[j]))]
            books[j] = new
    final = [[nearest(j, v[j]) for j in range(parts)] for v in cut]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [("".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f)) for f in final], sha


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, _key string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "c", "e", "k", 1) for i, v, k in rows], VECTORS)


@pytest.mark.parametrize("n", [5, 64, 150])
def test_codes_against_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 32)) * 0.02, 2 if n == 150 else 6).astype(np.float32)  # rounded: many ties
    x[n // 2] = x[0]
    rows = [(int(i) * 3 - 7, x[i].tolist(), None if i % 5 == 0 else i % 3) for i in rng.permutation(n).tolist()]
    want, sha = plain_codes([(i, v) for i, v, _ in rows])
    by_label = collections.Counter()
    for (_, _, k), (_, e) in zip(rows, want):
        by_label[k] += e
    got = {r["vec_id"]: tuple(r)[1:] for r in codes.compress(vectors(spark, rows).repartition(3)).collect()}
    assert got == {i: (c, e, by_label[k], sha) for (i, _, k), (c, e) in zip(rows, want)}


def test_codes_of_the_table(spark):
    rows = C.table(spark, SF, "embeddings").collect()
    want, sha = plain_codes([(r["vec_id"], r["embedding"]) for r in rows])
    got = {r["vec_id"]: r for r in codes.compress(C.table(spark, SF, "embeddings")).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == {r["vec_id"]: w for r, w in zip(rows, want)}
    assert {r["codebooks_sha256"] for r in got.values()} == {sha}


def test_candidates_hold_every_nearest_entry():
    rng = np.random.default_rng(3)
    for m in (1, 2, 17, 64):
        entries = rng.integers(-9, 9, (m, 4))
        book, x = codes.Book(entries), rng.integers(-12, 12, (500, 4))
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        radius = book.radius(x)
        mask = book.candidates(x, radius)
        box = (np.abs(x[:, None] - entries) <= radius[:, None, None]).all(axis=2)
        assert np.array_equal(box, (mask[:, None] >> np.arange(m, dtype=np.uint64) & np.uint64(1)).astype(bool))
        assert (box | (d > d.min(axis=1, keepdims=True))).all()
        entry, best = book.nearest(x)
        assert np.array_equal(entry, d.argmin(axis=1)) and np.array_equal(best, d.min(axis=1))


def test_codes_odd_tables(spark):
    v = [0.5] * 32
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [], 1), (4, [None] + v[1:], 1), (5, [float("nan")] + v[1:], None), (6, [float("inf")] + v[1:], 2),
            (7, [1e30] + v[1:], 2), (8, v[:16], 2), (9, v[:7], 2), (None, [-0.001] * 32, None), (10, [0.0] * 32, 2)]
    got = codes.compress(vectors(spark, rows)).collect()
    assert sorted((str(r["vec_id"]), r["error"]) for r in got) == [("1", 0), ("1", 0), ("10", 0), ("None", 0)]
    assert all(len(r["code"]) == 32 for r in got)
    assert codes.compress(vectors(spark, [])).collect() == [] and codes.compress(vectors(spark, [(1, None, 1)])).collect() == []
    text_label = spark.createDataFrame([(1, v, "a"), (2, [0.1] * 32, "a"), (3, v, None)], "vec_id int, embedding array<double>, label string")
    assert {r["vec_id"] for r in codes.compress(text_label).collect()} == {1, 2, 3}


def test_groups_join_whatever_their_frequency(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else i % 10 if i % 2 else 100 + i) for i in range(400)], "i long, k int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    want = {r["i"]: r["n"] for r in rows.join(groups, rows["k"].eqNullSafe(groups["k"])).collect()}
    for share in (1, 8, 1000):
        got = C.join_groups(rows, groups, "k", "n", share).collect()
        assert len(got) == 400 and {r["i"]: r["n"] for r in got} == want


# ---- 12: alignment -------------------------------------------------------------------------

def plain_alignment(texts, pair, a_library):
    """Per text (n_a, n_b, groups, links) from the libraries' own encodings, by walking both sides."""
    out = []
    for t in texts:
        a = a_library.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        raw_a, raw_b = [pair.a.raw[k] for k in a], [pair.raw_b[k] for k in b]
        if not t or not b"".join(raw_a) == b"".join(raw_b) == (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        end_a, end_b = (list(itertools.accumulate(map(len, r))) for r in (raw_a, raw_b))
        both, groups, links = sorted(set(end_a) & set(end_b)), [], []
        for lo, hi in zip([0, *both], both):
            groups.append(([k for k, e in zip(a, end_a) if lo < e <= hi], [k for k, e in zip(b, end_b) if lo < e <= hi])
                          if len(a) < 3000 else (a[_at(end_a, lo):_at(end_a, hi)], b[_at(end_b, lo):_at(end_b, hi)]))
            links.append((groups[-1][0][-1], groups[-1][1][-1]))
        out.append((len(a), len(b), groups, links))
    return out


def _at(ends, bound):
    import bisect
    return bisect.bisect_right(ends, bound)


def _written(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def settings(**more):
    return align.Settings(tokenizer_file(BYTES), tokenizer_file(PIECES), **more)


@pytest.mark.parametrize("often,chunk", [(1 << 21, 1 << 19), (50, 1000), (1, 1)])
def test_alignment_against_brute_force(spark, texts, often, chunk):
    s = settings(often=often, chunk=chunk)
    want = plain_alignment([t for _, t in texts], align.pair_of(s), library(special=False))
    count = collections.Counter(link for *_, links in want for link in links)
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.digests(frame(spark, texts).repartition(3), s).collect()}
    assert len(got) == len(texts)
    for (i, _), (n_a, n_b, groups, links) in zip(texts, want):
        sha = hashlib.sha256(_written(groups).encode()).hexdigest() if groups else ""
        assert got[i] == (n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha), i


def test_alignment_groups_and_odd_tables(spark):
    s = settings()
    rows = align.alignment(frame(spark, odd_rows()), s).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in odd_rows())
    want = {t: _written(g[2]) for (_, t), g in zip(odd_rows(), plain_alignment([t for _, t in odd_rows()], align.pair_of(s), library(special=False)))}
    assert sorted(bytes(r["groups"]).decode() for r in rows) == sorted(want[t] for _, t in odd_rows())
    zero = [r for r in rows if r["doc_id"] in (2, 3, 9)]
    assert len(zero) == 3 and all(tuple(r)[2:6] == (0, 0, 0, 0) and (r["n_best"], r["count_sum"], bytes(r["groups"])) == (0, 0, b"") for r in zero)
    assert align.alignment(frame(spark, []), s).collect() == [] and align.digests(frame(spark, [(1, None)]), s).count() == 1


def test_pointer_jumping_on_random_cuts():
    r = random.Random(5)
    for _ in range(200):
        n = r.randint(1, 60)
        end_a, end_b = (np.array(sorted({n, *r.sample(range(1, n + 1), r.randint(0, n))})) for _ in range(2))
        group_a, group_b = align.terminals(end_a, end_b)
        both = np.array(sorted(set(end_a.tolist()) & set(end_b.tolist())))
        assert np.array_equal(np.searchsorted(both, end_a), np.searchsorted(both, end_b[group_a]))
        assert np.array_equal(np.searchsorted(both, end_b), np.searchsorted(both, end_b[group_b]))
        assert set(end_b[group_b].tolist()) == set(both.tolist())
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in align.terminals(none, none))


# ---- 13: best fit --------------------------------------------------------------------------

def check_bins(sizes, bins, offsets, capacity):
    for b in set(bins.tolist()):
        end = 0
        for at, size in sorted((int(offsets[k]), int(sizes[k])) for k in np.flatnonzero(bins == b)):
            assert at == end
            end += size
        assert end <= capacity
    assert set(bins.tolist()) == set(range(len(set(bins.tolist()))))


def test_most_pairs_of_large_items():
    """Against every matching: no other one has more pairs."""
    r = random.Random(8)

    def most(left):
        if not left:
            return 0
        x, rest = left[0], left[1:]
        return max([most(rest)] + [1 + most(rest[:k] + rest[k + 1:]) for k in range(len(rest)) if x + rest[k] <= 30])
    for _ in range(300):
        sizes = [r.randint(11, 30) for _ in range(r.randint(0, 8))]
        pairs = bestfit.match_large(sizes, 30)
        assert sorted(k for p in pairs for k in p if k >= 0) == list(range(len(sizes)))
        assert all(b < 0 or sizes[a] + sizes[b] <= 30 for a, b in pairs)
        assert sum(b >= 0 for _, b in pairs) == most(sizes)


def test_small_items_take_the_tightest_gap():
    """Against a plain list of rooms."""
    r = random.Random(9)
    for _ in range(300):
        capacity = r.choice([9, 30, 100])
        sizes = np.array([r.randint(1, capacity) for _ in range(r.randint(0, 60))], np.int64)
        bins, offsets = bestfit.pack_sizes(sizes, capacity)
        check_bins(sizes, bins, offsets, capacity)
        large = np.flatnonzero(3 * sizes > capacity).tolist()
        rooms = [capacity - sum(int(sizes[k]) for k in large if bins[k] == b) for b in range(len({int(bins[k]) for k in large}))]
        for size in sorted((int(x) for x in sizes if 3 * x <= capacity), reverse=True):
            fits = [x for x in rooms if x >= size]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - size)
        assert len(rooms) == (bins.max() + 1 if len(sizes) else 0)
        assert sorted(rooms) == sorted(capacity - int(sizes[bins == b].sum()) for b in range(len(rooms)))


@pytest.mark.parametrize("group_pieces", [1 << 15, 40])
def test_best_fit_round_trip(spark, texts, group_pieces):
    t = library(special=True)
    docs = texts + [(1, texts[0][1]), (None, "x"), (77, LONG)]
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for _, x in docs]
    want = collections.Counter()
    for (i, _), x in zip(docs, ids):
        cuts = bestfit.cut(len(x), 2048)
        assert all(n == 2048 for _, n in cuts[1:]) and (len(x) > 2048 or len(cuts) == 1)
        for k, (lo, n) in enumerate(cuts):
            want[i, k, lo, n, zlib.crc32(x[lo:lo + n].tobytes())] += 1
    rows = bestfit.pack(frame(spark, docs).repartition(4), bestfit.Settings(tokenizer_file(BYTES), group_pieces=group_pieces)).collect()
    assert collections.Counter(tuple(r)[:5] for r in rows) == want
    sizes = np.array([r["length"] for r in rows])
    place = {b: k for k, b in enumerate(sorted({r["sequence_id"] for r in rows}))}
    check_bins(sizes, np.array([place[r["sequence_id"]] for r in rows]), np.array([r["offset"] for r in rows]), 2048)
    if group_pieces > len(rows):
        assert len(place) <= -(-int(sizes.sum()) // 2048) + 2


def test_best_fit_odd_tables(spark):
    s = bestfit.Settings(tokenizer_file(BYTES))
    assert bestfit.pack(frame(spark, []), s).collect() == []
    rows = bestfit.pack(frame(spark, [(1, None), (2, ""), (None, None), (2, "")]), s).collect()
    assert sorted(repr(r["doc_id"]) for r in rows) == ["1", "2", "2", "None"]
    assert {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == {(0, 0, 1, zlib.crc32(bytes(4)))}
    assert len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == [0, 1, 2, 3]
