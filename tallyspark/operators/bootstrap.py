"""Bootstrap intervals for classification metrics (AGG23, AGG24, SPL5).

Two exact resampling schemes:

* ``metrics`` (multinomial, scalable): an n-of-n resample with replacement only changes how
  many times each (true, pred) cell is drawn, so a replicate is one multinomial draw over the
  confusion cells, whatever the number of rows. Cells are dealt into blocks by a hash. A
  replicate's size is split over the blocks by a binary tree of binomial draws, each of which
  depends only on (seed, group, replicate, node); so every block draws its own share apart from
  the others, and the numbers are the same however the work is cut. Blocks send (label, hits,
  support, predictions) per replicate, and Spark sums these: no dense label matrix anywhere.
* ``poisson_weights`` (row-level): each row gets a Poisson(1) weight per replicate
  from ``md5(seed-b-id)``, reproducible in any engine; used when rows must be kept.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.metrics import confusion_cells
from tallyspark.session import ship_package

POISSON_K = 18  # P(Poisson(1) >= 18) < 2**-52: below the resolution of the 52-bit uniforms


def poisson1_thresholds(k_max: int = POISSON_K) -> list[float]:
    """CDF of Poisson(1) at 0..k_max-1."""
    out, term, acc = [], math.exp(-1.0), 0.0
    for k in range(k_max):
        if k > 0:
            term = term / k
        acc += term
        out.append(acc)
    return out


def uniform52(seed: int, rep: Column, id_col: str) -> Column:
    """Uniform [0, 1) from the first 13 hex digits of md5('<seed>-<rep>-<id>')."""
    h = F.md5(F.concat(F.lit(f"{seed}-"), rep.cast("string"), F.lit("-"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def poisson_weights(df: DataFrame, replicates: int, seed: int = 42, id_col: str = "index") -> DataFrame:
    """Adds ``replicate`` (explode 0..B-1) and ``weight`` ~ Poisson(1) per row and replicate (SPL5)."""
    x = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    # the uniform is projected once; the 18 threshold tests read the column, not the md5
    x = x.withColumn("_u", uniform52(seed, F.col("replicate"), id_col))
    w = sum((F.when(F.col("_u") >= F.lit(c), 1).otherwise(0) for c in poisson1_thresholds()), F.lit(0))
    return x.withColumn("weight", w.cast("long")).drop("_u")


TOGETHER = 20  # replicates that one stream of random numbers serves; fixed, so that results are


def _random(*key: object) -> np.random.Generator:
    """A stream of its own for each key (Philox, a counter-based generator)."""
    digest = hashlib.blake2b(json.dumps(key).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=int.from_bytes(digest, "little")))


def block_sizes(masses: Sequence[int], block: int, seed: int, group: str, draw: int) -> np.ndarray:
    """How many of each replicate's rows fall into a block, for the ``TOGETHER`` replicates of a draw.

    Node 1 of the tree has all rows; node k's children are 2k and 2k + 1, the leaves the blocks.
    A node's rows are split by a binomial draw of the node's own.
    """
    leaves = len(masses)
    below = np.zeros(2 * leaves, np.int64)
    below[leaves:] = masses
    for k in range(leaves - 1, 0, -1):
        below[k] = below[2 * k] + below[2 * k + 1]
    size, leaf = np.full(TOGETHER, below[1]), leaves + block
    for depth in range(leaf.bit_length() - 1, 0, -1):
        k = leaf >> depth
        left = _random(seed, group, draw, k).binomial(size, below[2 * k] / below[k] if below[k] else 0.0)
        size = size - left if leaf >> (depth - 1) & 1 else left
    return size


def draw_block(cells: Sequence[tuple], masses: Sequence[int], block: int, seed: int, group: str, draw: int) -> dict[str, np.ndarray]:
    """(replicate, label, tp, support, pred_n) of one block's (true, predicted, n) cells, without rows of zeros."""
    size = block_sizes(masses, block, seed, group, draw)
    n = np.array([c[2] for c in cells], np.float64)
    counts = _random(seed, group, draw, "block", block).multinomial(size, n / n.sum())
    labels = sorted({x for c in cells for x in c[:2] if x is not None})
    code = {x: k for k, x in enumerate(labels)}
    out = {}
    for name, own in (("tp", [c[0] if c[0] == c[1] else None for c in cells]), ("support", [c[0] for c in cells]), ("pred_n", [c[1] for c in cells])):
        at = np.array([code.get(x, len(labels)) for x in own])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        total = np.zeros((TOGETHER, len(labels) + 1), np.int64)
        total[:, at[order][first]] = np.add.reduceat(counts[:, order], first, axis=1)
        out[name] = total[:, :-1]
    replicate, label = np.nonzero(out["support"] + out["pred_n"])
    return {"replicate": draw * TOGETHER + replicate, "label": np.array(labels, object)[label],
            **{k: v[replicate, label] for k, v in out.items()}}


def replicate_labels(cells: DataFrame, replicates: int = 1000, seed: int = 42, group_cols: Sequence[str] = (),
                     replicates_per_task: int = 250, cell_blocks: int = 16) -> DataFrame:
    """(group, replicate, label, tp, support, pred_n, n): label counts of each replicate (AGG23).

    ``n`` is the group's number of rows. ``cell_blocks``, a power of two, bounds what a task
    holds to that share of a group's cells; another number of blocks gives other draws, while
    ``replicates_per_task`` only deals out the work. Null labels count in ``n`` alone.
    """
    if cell_blocks & (cell_blocks - 1):
        raise ValueError("cell_blocks must be a power of two")
    ship_package(cells.sparkSession)
    g = list(group_cols)
    cell = F.struct("true_label", "predicted_label", F.col("n").cast("long").alias("n"))
    block = F.pmod(F.xxhash64("true_label", "predicted_label"), F.lit(cell_blocks)).cast("int")
    blocks = (cells.where("n > 0").groupBy(*g, block.alias("_block")).agg(F.sort_array(F.collect_list(cell)).alias("_cells"), F.sum("n").alias("_mass")))
    mass = F.map_from_entries(F.collect_list(F.struct("_block", "_mass")))
    masses = blocks.groupBy(*g).agg(mass.alias("_m")).select(
        *[F.col(c).alias(f"_g_{c}") for c in g], F.transform(F.sequence(F.lit(0), F.lit(cell_blocks - 1)), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0))).alias("_masses"))
    same = F.lit(True)
    for c in g:
        same = same & blocks[c].eqNullSafe(F.col(f"_g_{c}"))
    joined = blocks.join(masses, same) if g else blocks.withColumn("_masses", masses.select("_masses").scalar())
    draws, a_task = -(-replicates // TOGETHER), max(1, replicates_per_task // TOGETHER)
    name = F.to_json(F.struct(*g)) if g else F.lit("")
    work = joined.select(*g, name.alias("_name"), "_block", "_cells", "_masses", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(a_task))).alias("_draw"))
    names = [*g, "replicate", "label", "tp", "support", "pred_n", "n"]
    types = dict(cells.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = b.columns
            for i in range(b.num_rows):
                group, block_, cells_, masses_, first = (columns[len(g) + k][i].as_py() for k in range(5))
                rows = [(c["true_label"], c["predicted_label"], c["n"]) for c in cells_]
                for draw in range(first, min(first + a_task, draws)):
                    x = draw_block(rows, masses_, block_, seed, group, draw)
                    keep = x["replicate"] < replicates
                    n = int(keep.sum())
                    if not n:
                        continue
                    same_group = [columns[k].slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for k in range(len(g))]
                    yield pa.RecordBatch.from_arrays(
                        [*same_group, pa.array(x["replicate"][keep], pa.int64()), pa.array(x["label"][keep], pa.string()),
                         *[pa.array(x[k][keep], pa.int64()) for k in ("tp", "support", "pred_n")], pa.array(np.full(n, sum(masses_)), pa.int64())], names=names)
    schema = ", ".join([f"`{c}` {types[c]}" for c in g] + ["replicate long", "label string", "tp long", "support long", "pred_n long", "n long"])
    drawn = work.repartition(*g, "_block", "_draw").mapInArrow(task, schema)
    return drawn.groupBy(*g, "replicate", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "pred_n")], F.max("n").alias("n"))


def replicate_metrics(cells: DataFrame, replicates: int = 1000, seed: int = 42, group_cols: Sequence[str] = (),
                      label_set: str = "union", classes: Sequence[str] | None = None,
                      replicates_per_task: int = 250, cell_blocks: int = 16) -> DataFrame:
    """One row per (group, replicate) with accuracy, weighted F1 and macro F1 (AGG23).

    ``label_set`` names the labels of the macro average: ``true`` (in the replicate's true labels),
    ``union`` (true or predicted) or ``fixed`` (``classes``). A replicate that draws no label at all
    has no row.
    """
    g = list(group_cols)
    x = replicate_labels(cells, replicates, seed, g, replicates_per_task, cell_blocks)
    own = F.col("label").isin(list(classes or [])) if label_set == "fixed" else F.lit(True)
    f1 = F.when(own, 2 * F.col("tp") / (F.col("support") + F.col("pred_n")))
    support = F.when(own, F.col("support"))
    counted = {"true": F.col("support") > 0, "union": F.lit(True), "fixed": own}[label_set]
    of = F.lit(len(classes or [])) if label_set == "fixed" else F.count_if(counted)
    out = x.groupBy(*g, "replicate").agg(
        (F.sum("tp") / F.max("n")).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum(f1 * support), F.sum(support)), F.lit(0.0)).alias("f1_weighted"),
        F.coalesce(F.try_divide(F.sum(F.when(counted, f1)), of), F.lit(0.0)).alias("f1_macro"))
    return out.select(*g, "replicate", "accuracy", "f1_weighted", "f1_macro")


def metrics(df: DataFrame, replicates: int = 1000, seed: int = 42, true_col: str = "label",
            pred_col: str = "predicted_label", group_cols: Sequence[str] = (), label_set: str = "union",
            classes: Sequence[str] | None = None, scale: float = 1.0, replicates_per_task: int = 250) -> DataFrame:
    """Bootstrap mean and population std of accuracy / weighted F1 / macro F1 per group (AGG23, AGG24)."""
    g = list(group_cols)
    reps = replicate_metrics(confusion_cells(df, true_col, pred_col, g), replicates, seed, g, label_set, classes,
                             replicates_per_task)
    aggs = [F.count(F.lit(1)).alias("replicates")]
    for c in ("accuracy", "f1_weighted", "f1_macro"):
        aggs += [(F.avg(c) * scale).alias(f"{c}_mean"), (F.stddev_pop(c) * scale).alias(f"{c}_std")]
    return reps.groupBy(*g).agg(*aggs)


def evaluate(df: DataFrame, replicates: int = 1000, seed: int = 42, true_col: str = "label",
             pred_col: str = "predicted_label", group_cols: Sequence[str] = (), label_set: str = "true",
             scale: float = 100.0) -> DataFrame:
    """Point estimates (accuracy, weighted F1, macro F1 over ``label_set``) plus bootstrap
    population std, both x ``scale`` (AGG24)."""
    from tallyspark.operators.metrics import summary_from_cells
    g = list(group_cols)
    cells = confusion_cells(df, true_col, pred_col, g)
    point = summary_from_cells(cells, (), g, label_set)
    reps = replicate_metrics(cells, replicates, seed, g, label_set)
    spread_ = reps.groupBy(*g).agg(*[(F.stddev_pop(c) * scale).alias(f"{c}_std") for c in ("accuracy", "f1_weighted", "f1_macro")])
    pt = point.select(*g, "n", *[(F.col(c) * scale).alias(c) for c in ("accuracy", "f1_weighted", "f1_macro")])
    if g:
        return pt.join(spread_, g)
    return pt.withColumn("_k", F.lit(1)).join(spread_.withColumn("_k", F.lit(1)), "_k").drop("_k")
