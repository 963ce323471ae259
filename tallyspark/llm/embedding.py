"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of one label are turned by a seeded rotation, which spreads their energy evenly,
and split into blocks of few dimensions. Cosine >= c means a squared distance of at most
2 - 2c, so in at least one block the squared distance is at most that block's share
(its dimensions / all). Each block is range-joined under its share: a grid over the block's
first coordinate brings pairs together, the block's distance makes them candidates, and the
candidates of all blocks are decided exactly on the cosine of the given vectors.

A pair that several blocks find counts in the first of them only, which each block can tell
by itself. So a tile returns counts and a spanning forest of its links, never pairs, and no
step gathers pairs to make them distinct. Equal vectors are one row with a multiplicity.
Grid cells over ``tile`` vectors are cut into chunks, each pair of chunks a tile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import common as C
from tallyspark.llm.components import components
from tallyspark.llm.jaccard import _forest, by_group
from tallyspark.session import ship_package


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.93
    blocks: int = 4
    tile: int = 2048
    seed: int = 29


_ROTATIONS: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    if (dim, seed) not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
        _ROTATIONS[dim, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[dim, seed]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shares(dim: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(first dimension of each block and the end, each block's largest squared distance)."""
    cuts = np.linspace(0, dim, min(s.blocks, dim) + 1).astype(int)
    return cuts, (2 - 2 * s.cosine) * np.diff(cuts) / dim * (1 + 1e-9) + 1e-12


def _rows(vectors: DataFrame, s: Settings) -> DataFrame:
    """(label, dim, block, cell, side, vec_id, times, raw): each vector in its cell and in the one before."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, vec, times, emb = batch.columns
            data = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = np.diff(emb.offsets.to_numpy())
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = data[(ends[at] - dim)[:, None] + np.arange(dim)]
                turned = _unit(x) @ rotation(int(dim), s.seed)
                cuts, most = shares(int(dim), s)
                narrow = (x.astype(np.float32) == x).all(axis=1)  # nothing is lost in 4 bytes
                raw = [r.astype("<f4").tobytes() if k else r.tobytes() for r, k in zip(x, narrow.tolist(), strict=True)]
                cols = [c.take(pa.array(at)) for c in (label, vec, times)]
                for b, first in enumerate(cuts[:-1]):
                    cell = np.floor(turned[:, first] / np.sqrt(most[b])).astype(np.int64)
                    for side in (0, 1):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays([
                            cols[0], pa.array(np.full(n, dim), pa.int32()), pa.array(np.full(n, b), pa.int32()), pa.array(cell - side),
                            pa.array(np.full(n, side), pa.int32()), cols[1], cols[2], pa.array(raw, pa.binary())], names=names)
    names = ["label", "dim", "block", "cell", "side", "vec_id", "times", "raw"]
    return vectors.select("label", "vec_id", "times", "embedding").mapInArrow(
        task, "label string, dim int, block int, cell long, side int, vec_id long, times long, raw binary")


def tile_links(block: int, x: np.ndarray, side: np.ndarray, chunk: np.ndarray, same_chunk: bool, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Linked index pairs of a tile that this block is the first to find."""
    dim = x.shape[1]
    cuts, most = shares(dim, s)
    unit = _unit(x)
    turned = unit @ rotation(dim, s.seed)
    part = turned[:, cuts[block]:cuts[block + 1]]
    size = (part * part).sum(axis=1)
    found_a, found_b = [], []
    for lo in range(0, len(x), 512):
        rows = slice(lo, lo + 512)
        near = size[rows, None] + size[None, :] - 2 * part[rows] @ part.T <= most[block] + 1e-7
        a, b = np.nonzero(near)
        a += lo
        ok = (a < b) & ~((side[a] == 1) & (side[b] == 1))
        if not same_chunk:
            ok &= chunk[a] != chunk[b]
        found_a.append(a[ok])
        found_b.append(b[ok])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep_a, keep_b = [], []
    for lo in range(0, len(a), 65536):
        p, q = a[lo:lo + 65536], b[lo:lo + 65536]
        ok = (unit[p] * unit[q]).sum(axis=1) >= s.cosine
        p, q = p[ok], q[ok]
        d = np.add.reduceat((turned[p] - turned[q]) ** 2, cuts[:-1], axis=1) if len(p) else np.zeros((0, len(most)))
        ok = (d[:, block] <= most[block]) & ~(d[:, :block] <= most[:block]).any(axis=1)
        keep_a.append(p[ok])
        keep_b.append(q[ok])
    return (np.concatenate(keep_a), np.concatenate(keep_b)) if keep_a else (a[:0], b[:0])


def links(vectors: DataFrame, s: Settings) -> DataFrame:
    """(u, v, n): link counts (u, null, n) and forest edges (u, v, 0) of all tiles.

    ``vectors`` has distinct vectors: label, vec_id, times, embedding.
    """
    rows = C.materialise(_rows(vectors, s), "blocks")
    key = ["label", "dim", "block", "cell"]
    parts = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / s.tile).cast("int").alias("parts"))
    split = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    tiles = split.select(*key, "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"), "side", "vec_id", "times", "raw").select(
        *key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "side", "vec_id", "times", "raw")
    keys = [*key, "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, block, _, i, j), (part, side, vec, times, raw) in by_group(batches, 6):
            if len(vec) < 2:
                continue
            x = np.array([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in raw], np.float64)
            a, b = tile_links(block, x, np.array(side), np.array(part), i == j, s)
            if not len(a):
                continue
            many = np.array(times, np.int64)
            n = np.zeros(len(vec), np.int64)
            np.add.at(n, a, many[b])
            np.add.at(n, b, many[a])
            some, edges = np.flatnonzero(n).tolist(), _forest(a, b, len(vec))
            yield pa.RecordBatch.from_arrays([
                pa.array([vec[k] for k in some] + [vec[p] for p, _ in edges], pa.int64()),
                pa.array([None] * len(some) + [vec[q] for _, q in edges], pa.int64()),
                pa.array(n[some].tolist() + [0] * len(edges), pa.int64())], names=["u", "v", "n"])
    ordered = tiles.select(*keys, "part", "side", "vec_id", "times", "raw").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(task, "u long, v long, n long")


def near_duplicates(embeddings: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``embeddings``.

    Vectors link when their labels are equal and not null and their cosine reaches the bound.
    Vectors that are null, empty, zero or hold a null, NaN or infinite component, and rows
    with a null vec_id, link with nothing; labels of any type are equal when they read alike; vectors of different lengths don't either. Rows
    that repeat a vector are linked copies, each counted. An empty table gives no rows; other
    columns are ignored.
    """
    s = settings or Settings()
    ship_package(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    ok = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
          & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists("embedding", lambda x: x != 0))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = rows.where("ok").select("vec_id", "label", "embedding")
    distinct = C.materialise(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times")), "vectors")
    found = C.materialise(links(distinct, s), "links")
    degree = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n"))
    parts = components(found.where("v is not null").select("u", "v"))
    each = (distinct.join(degree.withColumnRenamed("u", "vec_id"), "vec_id", "left")
            .join(parts.withColumnRenamed("u", "vec_id"), "vec_id", "left")
            .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    linked = good.join(each, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
