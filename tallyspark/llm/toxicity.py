"""Toxicity by compression distance: two zstandard dictionaries, toxic and ordinary text.

A window is a word with its separators (words over ``long_word`` bytes give overlapping
windows), lower-cased. A window's distance is its compressed length under the ordinary
dictionary less that under the toxic one: windows that share segments with toxic text, whole
words or only stems, come out positive.

Fitting, on a bounded sample of labelled rows outside the held-out fold:

1. Words are counted by document in toxic and in ordinary texts, near copies (equal least
   hash of their word 4-grams, under either of two hashes) counting once. A word's weight in the
   toxic texts is 1 where it is found there so much oftener that chance is excluded (a
   log-likelihood ratio test of the two shares, whatever the word's share is), otherwise 0; if
   no word passes, all words of toxic texts weigh 1. Ordinary text is the other words of ordinary texts.
2. One dictionary is trained on each, on every word as often as texts hold it. A constant pad ends both dictionaries and every window,
   so that windows of few bytes are compressed as well and the constant costs cancel.
3. The window threshold is the distance that best parts toxic from ordinary documents of the
   sample; a logistic fit of the largest distance and of the number of windows over the
   threshold gives the calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    max_train: int = 12_000         #: bound of the labelled sample
    times_oftener: float = 8.0      #: of words that count as toxic text
    significance: float = 19.5      #: least log-likelihood ratio of such a word (a chance of 1 in 100,000)
    toxic_bytes: int = 8192         #: size of the toxic dictionary
    ordinary_bytes: int = 32768
    long_word: int = 64
    memo_words: int = 400_000       #: windows whose distance a worker remembers
    threshold: float = 0.5


PAD = bytes(range(1, 25))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(content + PAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=16, chain_log=16, search_log=6, min_match=4, target_length=64,
            strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0))


def train_dictionary(words: list[tuple[str, int]], size: int, together: int) -> bytes:
    """A zstandard dictionary trained on words as often as they count (scaled to 200,000).

    Training keeps what repeats most; words that it left out fill the rest of ``size``, the most
    frequent first.
    """
    total = sum(n for _, n in words)
    scale = max(1.0, total / 200_000)
    windows = [f" {w} ".encode() for w, n in words for _ in range(max(1, round(n / scale)))]
    order = np.random.default_rng(3).permutation(len(windows))
    samples = [b"".join(windows[k] for k in order[i:i + together]) for i in range(0, len(order), together)]
    try:
        made = zstandard.train_dictionary(size, samples, k=24 if size > 8192 else 16, d=6, level=3).as_bytes()
        out = [made]
        left = size - len(made)
        for w, _ in sorted(words, key=lambda x: (-x[1], x[0])):
            window = f" {w} ".encode()
            if len(window) <= left and window not in made:
                out.append(window)
                left -= len(window)
        return b"".join(reversed(out))
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(sorted(set(windows)))[-size:]


class Distances:
    """Window distances of texts under the two dictionaries."""

    def __init__(self, toxic: bytes, ordinary: bytes, s: Settings) -> None:
        self.toxic, self.ordinary, self.s = _compressor(toxic), _compressor(ordinary), s
        self.memo: dict[bytes, int] = {}

    def _window(self, piece: bytes) -> int:
        w = b" " + piece + b" " + PAD
        return len(self.ordinary.compress(w)) - len(self.toxic.compress(w))

    def _word(self, word: bytes) -> int:
        n = self.s.long_word
        if len(word) > n:
            return max(self._window(word[k:k + n]) for k in range(0, len(word) - n // 2, n // 2))
        if len(self.memo) >= self.s.memo_words:
            self.memo.clear()
        self.memo[word] = d = self._window(word)
        return d

    def text(self, text: str) -> list[int]:
        """The distance of each distinct word of a text."""
        memo, miss = self.memo, self._word
        return [memo[w] if w in memo else miss(w) for w in set(text.lower().encode().split())]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    settings: Settings
    cut: int = 3                    #: the window threshold
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def features(self, distances: list[int]) -> tuple[int, int]:
        return (max(distances, default=0), sum(d >= self.cut for d in distances))

    def score(self, top: np.ndarray, over: np.ndarray) -> np.ndarray:
        z = _design(top, over) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _design(top: np.ndarray, over: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(top)), np.clip(top, -4, 12) / 4, over > 0, np.log1p(over)])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps of an L2-penalised logistic fit."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _histograms(sample: DataFrame, model: Model) -> list:
    """(y, largest distance, counts of windows by distance 0 to 12) of the sample's texts."""
    shared = sample.sparkSession.sparkContext.broadcast((model.toxic, model.ordinary, model.settings))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dist = Distances(*shared.value)
        for b in batches:
            all_d = [np.array(dist.text(t.as_py() or ""), np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([int(d.max()) if len(d) else 0 for d in all_d], pa.int32()),
                pa.array([np.bincount(np.clip(d, 0, 12), minlength=13).tolist() for d in all_d], pa.list_(pa.int64()))], names=["y", "top", "hist"])
    return sample.select("y", "text").mapInArrow(task, "y int, top int, hist array<long>").collect()


def _without_copies(sample: DataFrame) -> DataFrame:
    """(y, text): the sample (bounded) with one text of each group of near copies."""
    def least(seed: int) -> Column:
        w = F.col("w")
        return F.coalesce(F.array_min(F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - 3, F.lit(1))),
            lambda x, i: F.xxhash64(F.lit(seed), x, F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3)))), F.lit(0))
    texts = sample.withColumn("w", F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
    texts = texts.select("y", least(1).alias("a"), least(2).alias("b"), F.struct(F.xxhash64("doc_id"), "doc_id", "text").alias("row"))
    for key in ("a", "b"):  # of each group the row with the least hash of its id, whatever the layout
        texts = texts.groupBy("y", key).agg(F.min_by(F.struct("b", "row"), "row").alias("t")).select("y", *(["t.b", "t.row"] if key == "a" else ["t.row"]))
    return texts.select("y", "row.text")


def _significance(t: Column, o: Column, toxic: int, ordinary: int) -> Column:
    """Twice the log-likelihood ratio of a word's document counts: two shares against one."""
    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    share = (t + o) / (toxic + ordinary)
    return 2 * (term(t, share * toxic) + term(o, share * ordinary) + term(toxic - t, (1 - share) * toxic) + term(ordinary - o, (1 - share) * ordinary))


def train(docs: DataFrame, labels: DataFrame, s: Settings) -> Model:
    ids = F.broadcast(C.train_sample(labels, "toxic", s.max_train))  # at most max_train rows
    sample = C.materialise(C.only(docs, "doc_id", "text").join(ids, "doc_id").select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")), "toxic")
    texts = _without_copies(sample)
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, ordinary = size.get(1, 0), size.get(0, 0)
    if not toxic or not ordinary:
        p = (toxic + 1) / (toxic + ordinary + 2)
        return Model(b"", b"", s, weights=(float(np.log(p / (1 - p))), 0.0, 0.0, 0.0))
    counts = (texts.select("y", F.explode(F.array_distinct(F.split(F.btrim(F.lower("text"), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))).alias("w"))
              .where((F.col("w") != "") & (F.length("w") <= s.long_word)).groupBy("w")
              .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")))
    counts = C.materialise(counts, "words")
    t, o = F.col("t"), F.col("o")
    often = (_significance(t, o, toxic, ordinary) >= s.significance) & (t / toxic > s.times_oftener * (o + 1) / ordinary)
    words = lambda df, by: [(r["w"], r[by]) for r in df.orderBy(F.desc(by), "w").collect()]  # noqa: E731 - of the bounded sample
    marks = words(counts.where(often), "t") or words(counts.where("t > 0"), "t")
    usual = words(counts.where(~often & (o > 0)), "o")
    model = Model(train_dictionary(marks, s.toxic_bytes, 4), train_dictionary(usual, s.ordinary_bytes, 8), s)
    rows = sorted(_histograms(sample, model), key=lambda r: (r["y"], r["top"], r["hist"]))
    y = np.array([r["y"] for r in rows], float)
    tops, hist = np.array([r["top"] for r in rows], float), np.array([r["hist"] for r in rows], float)
    gain = [(tops[y == 1] >= k).mean() - (tops[y == 0] >= k).mean() for k in range(1, 12)]
    model.cut = 1 + int(np.argmax(gain))
    model.weights = tuple(float(v) for v in _logistic(_design(tops, hist[:, model.cut:].sum(axis=1)), y))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, top_distance, windows_over) for every row of ``docs``.

    Null and empty texts have no window: distance 0, none over. Repeated rows get a row each;
    a null doc_id stays null. With labels of one class or none every text gets the smoothed
    share of label 1. An empty table gives no rows; other columns are ignored.
    """
    s = settings or Settings()
    ship_package(docs.sparkSession)
    model = train(docs, labels, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dist = Distances(model.toxic, model.ordinary, model.settings)
        for b in batches:
            found = [model.features(dist.text(t.as_py() or "")) for t in b.column(2)]
            top, over = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(model.score(top.astype(float), over.astype(float))), pa.array(top), pa.array(over)],
                names=["doc_id", "held_out", "score", "top_distance", "windows_over"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    out = rows.mapInArrow(task, "doc_id long, held_out boolean, score double, top_distance long, windows_over long")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"), "top_distance", "windows_over")
