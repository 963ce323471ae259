"""Quality classifier: random-indexing word vectors, pooled, then a two-layer numpy network.

1. *Random indexing.* Each token has a sparse ternary index vector made from its hash. The
   vector of a token is the sum of the index vectors of the tokens up to ``window`` places
   away, over the whole corpus. Tokens are hashed to ``buckets`` rows, so the table has a
   fixed size; every task adds up its own table and the tables are summed by block.
2. *Pooling.* A document is the mean and the spread of its tokens' vectors and its length.
3. *Network.* One hidden layer, trained in numpy on a bounded sample of labelled rows outside
   the held-out fold. One slice of that sample is kept back to fit the temperature that
   divides the logit, so that scores are calibrated probabilities.

Tokens are maximal runs of letters, digits or other signs; signs count with their run length
and words with their letter case, since junk differs in both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 14      #: rows of the vector table (tokens are hashed to them)
    dim: int = 32               #: length of a vector
    nonzero: int = 2            #: entries of an index vector that are not 0
    window: int = 2             #: neighbours on each side
    max_train: int = 20_000     #: bound of the labelled sample
    hidden: int = 32
    epochs: int = 40
    threshold: float = 0.3
    seed: int = 17


_KIND = np.full(256, 3, np.uint8)  # other signs
_KIND[C.WHITE] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
_CODES = C.byte_codes(101, fold_case=True)
_BLOCK = 256
POOL_BYTES = 1 << 19  # of text at once: a token's vector takes many times the token's bytes


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each token. A token in capitals is another token than in small letters."""
    starts, ends, rows = C.runs(_KIND[buf], offs)
    h = C.span_hashes(buf, starts, ends, _CODES)
    upper = np.zeros(len(buf) + 1, np.int32)
    np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
    caps = (upper[ends] - upper[starts] >= 2) & (ends - starts == upper[ends] - upper[starts])
    glued = np.zeros(len(buf) + 1, bool)  # signs that follow a letter directly, as in "word%%%"
    glued[1:len(buf)] = _KIND[buf[:-1]] == 1
    h = h ^ (caps.astype(np.uint64) << np.uint64(7)) ^ ((glued[starts] & (_KIND[buf[starts]] == 3)).astype(np.uint64) << np.uint64(9))
    return C.mix(h), rows


def _add_contexts(into: np.ndarray, h: np.ndarray, rows: np.ndarray, s: Settings) -> None:
    b = (h % np.uint64(s.buckets)).astype(np.int64)
    for j in range(s.nonzero):
        x = C.mix(h + np.uint64((j + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        dim = (x % np.uint64(s.dim)).astype(np.int64)
        sign = np.where(x >> np.uint64(63), 1.0, -1.0)
        for off in range(1, s.window + 1):
            if len(h) <= off:
                break
            near = rows[off:] == rows[:-off]
            for at, of in ((slice(None, -off), slice(off, None)), (slice(off, None), slice(None, -off))):
                into += np.bincount(b[at] * s.dim + dim[of], weights=sign[of] * near, minlength=into.size)


def word_vectors(docs: DataFrame, s: Settings) -> np.ndarray:
    """The table of token vectors over all texts: (buckets, dim), rows of length 1 (0: unseen)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(s.buckets * s.dim)
        for batch in batches:
            for _, _, buf, offs in C.text_batches(batch.column(0)):
                _add_contexts(total, *_tokens(buf, offs), s)
        parts = np.split(total.astype(np.int32), s.buckets // _BLOCK)  # signs are added: whole numbers
        found = [k for k, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int32()), pa.array([parts[k].tobytes() for k in found], pa.binary())],
            names=["block", "blob"])
    summed = C.sum_blobs(C.few_tasks(C.only(docs, "text")).mapInArrow(task, "block int, blob binary"))
    table = np.zeros((s.buckets // _BLOCK, _BLOCK * s.dim))
    for k, x in summed.items():
        table[k] = x
    table = table.reshape(s.buckets, s.dim)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """One feature row per text: mean and spread of the token vectors, and the length."""
    d = table.shape[1]
    out = np.zeros((len(column), 2 * d + 2), np.float32)
    for lo, hi, buf, offs in C.text_batches(column, POOL_BYTES):
        h, rows = _tokens(buf, offs)
        n = np.bincount(rows, minlength=hi - lo)
        have = np.flatnonzero(n)
        if len(have):
            v = table[(h % np.uint64(len(table))).astype(np.int64)]
            at = np.concatenate(([0], np.cumsum(n[have])[:-1]))
            mean = np.add.reduceat(v, at, axis=0) / n[have, None]
            out[lo + have, :d] = mean
            np.square(v, out=v)
            out[lo + have, d:2 * d] = np.sqrt(np.maximum(np.add.reduceat(v, at, axis=0) / n[have, None] - mean ** 2, 0))
        out[lo:hi, 2 * d] = np.log1p(n)
        out[lo:hi, 2 * d + 1] = np.log1p(np.diff(offs)) - np.log1p(n)
    return out


@dataclass
class Network:
    """Two layers: tanh hidden units, one logit; features are standardised first."""
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0
    history: list[float] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logit with the least log loss, by a search over a fine grid."""
    grid = np.exp(np.linspace(np.log(0.2), np.log(10), 118))
    z = logit[None, :] / grid[:, None]
    loss = np.mean(np.logaddexp(0, z) - z * y[None, :], axis=1)
    return float(grid[int(np.argmin(loss))])


def fit(x: np.ndarray, y: np.ndarray, s: Settings) -> Network:
    """Train on four fifths of the rows, fit the temperature on the rest."""
    rng = np.random.default_rng(s.seed)
    y = y.astype(np.float64)
    d = x.shape[1]
    if len(y) < 20 or y.min() == y.max():  # nothing to tell apart: the smoothed share of 1
        p = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))))
    order = rng.permutation(len(y))
    keep = max(10, len(y) // 5)
    aside, own = order[:keep], order[keep:]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-3,
                  rng.normal(0, d ** -0.5, (d, s.hidden)), np.zeros(s.hidden),
                  rng.normal(0, s.hidden ** -0.5, s.hidden), 0.0)
    z = np.clip((x - net.center) / net.scale, -8, 8).astype(np.float64)
    par = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m1, m2, t = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(s.epochs):
        own = rng.permutation(own)
        for at in range(0, len(own), 128):
            k = own[at:at + 128]
            a = np.tanh(z[k] @ par[0] + par[1])
            p = 1 / (1 + np.exp(-np.clip(a @ par[2] + par[3][0], -30, 30)))
            g = (p - y[k]) / len(k)
            back = g[:, None] * par[2][None, :] * (1 - a * a)
            grads = [z[k].T @ back + 1e-4 * par[0], back.sum(0), a.T @ g + 1e-4 * par[2], np.array([g.sum()])]
            t += 1
            for p_, g_, u, v in zip(par, grads, m1, m2, strict=True):
                u *= 0.9
                u += 0.1 * g_
                v *= 0.999
                v += 0.001 * g_ * g_
                p_ -= 3e-3 * (u / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = par[0], par[1], par[2], float(par[3][0])
    net.temperature = _temperature(net.logit(x[aside]), y[aside])
    return net


def train(docs: DataFrame, labels: DataFrame, table: np.ndarray, s: Settings) -> Network:
    """Fit on the labelled sample; at most ``max_train`` feature rows come to the driver."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)
    sample = C.train_sample(labels, "quality", s.max_train)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])
    chosen = C.only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInArrow(features, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).reshape(len(rows), 2 * table.shape[1] + 2)
    return fit(x, np.array([r["y"] for r in rows], np.float64), s)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    "predicted" is 1 where the score reaches ``threshold``.

    Empty and null texts get the score of an all-zero feature row. Repeated rows each get
    their row; a null doc_id stays null with held_out null. Without labels (or with one
    class only) every text gets the smoothed share of label 1. An empty table gives no rows.
    Columns besides doc_id and text are ignored.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    ship_package(spark)
    C.small_batches(spark)
    table = word_vectors(docs, s)
    net = train(docs, labels, table, s)
    shared = spark.sparkContext.broadcast((table, net))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(net.probability(pooled(b.column(2), table)), pa.float64())],
                names=["doc_id", "held_out", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.held_out(F.col("doc_id")).alias("held_out"), F.col("text"))
    return (rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= s.threshold).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold (see quality_scores); an empty table gives none."""
    s = settings or Settings()
    ship_package(docs.sparkSession)
    C.small_batches(docs.sparkSession)
    table = word_vectors(docs, s)
    shared = docs.sparkSession.sparkContext.broadcast((table, train(docs, labels, table, s)))
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for b in batches:
            good = pa.array(net.probability(pooled(b.column(place), table)) >= s.threshold)
            yield from C.slices(b.filter(good))
    return docs.mapInArrow(keep, docs.schema)
