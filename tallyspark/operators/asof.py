"""As-of join of log rows over a moving epoch window, without pairs (JN6).

For an eval row (epoch e, step s) the last train row in step order with epoch in
(e - 1 + eps, e + eps] and step <= s is wanted. Epochs are cut into unit cells (n, n + 1].
The window covers the end of one cell and the beginning of the next, so each train row is
filed twice (from either end of its cell) and each eval row asks twice: in one cell for epochs
above its lower bound, in the next for epochs up to its upper bound. Signs are turned so that
both ask the same: the last train row so far whose number is at most a bound.

That is one sweep along the steps of each (run, cell). It keeps the train rows that no later one
undercuts: their numbers ascend, so a question is one binary search. Rows are range-sorted, so a
cell with most of the log spans many chunks, swept apart. What crosses a chunk's end is the kept
list of its last cell: a question that finds nothing in its own chunk goes to the last earlier
chunk of its cell whose least number is under the bound, and there to the kept list, by one
ordered scan. Nothing is asked of more than two chunks, and no eval row meets a train row that it
doesn't take.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.windows import forward_fill, sorted_chunks
from tallyspark.session import materialise, ship_package

LARGEST_EPOCH = 1e12  #: from here on 1e-5 vanishes beside an epoch
TRAIN, EVAL, KEPT = 0, 1, 2


def _questions(log: DataFrame, is_train: Column, epoch: str, step: str, pos: str, payload: Column, eps: float) -> DataFrame:
    """(run, cell, side, step, kind, back, k, row, payload): train rows and questions of both sides."""
    e = F.col(epoch).cast("double")
    ok = F.col(step).isNotNull() & e.isNotNull() & (F.abs(e) < LARGEST_EPOCH)  # NaN isn't below anything
    low, high = e - 1.0 + F.lit(eps), e + F.lit(eps)
    first, last = F.floor(low), F.ceil(high) - 1
    below = F.struct(last.cast("long").alias("cell"), F.lit(0).alias("side"), high.alias("k"))
    above = F.struct(first.cast("long").alias("cell"), F.lit(1).alias("side"), (-low).alias("k"))
    asked = F.when(first < last, F.array(below, above)).when(low == first, F.array(below)).otherwise(F.array(above))
    cell = (F.ceil(e) - 1).cast("long")
    filed = F.array(F.struct(cell.alias("cell"), F.lit(0).alias("side"), e.alias("k")), F.struct(cell.alias("cell"), F.lit(1).alias("side"), (-e).alias("k")))
    common = ["_run", F.col(step).cast("double").alias("step")]
    train = log.where(is_train & ok).select(*common, F.lit(TRAIN).alias("kind"), (-F.col(pos)).cast("double").alias("back"), F.lit(None).cast("long").alias("row"),
                                            payload.alias("payload"), F.inline(filed))
    evals = log.where(~F.coalesce(is_train, F.lit(False)) & ok).select(
        *common, F.lit(EVAL).alias("kind"), F.lit(None).cast("double").alias("back"), F.col("_row").alias("row"), F.lit(None).cast(_type(log, payload)).alias("payload"), F.inline(asked))
    return train.unionByName(evals)


def _type(log: DataFrame, c: Column) -> str:
    return log.select(c.alias("c")).schema["c"].dataType.simpleString()


def _sweep(sides: DataFrame) -> DataFrame:
    """Answers of each chunk: rows of kind EVAL (``step``, ``back`` and ``payload`` of the answer or
    nulls) and of kind KEPT (what the chunk's last cell leaves)."""
    names = ["_run", "cell", "side", "kind", "chunk", "k", "row", "step", "back", "payload"]
    types = dict(sides.dtypes)
    schema = ", ".join(f"`{n}` {types.get(n, 'int')}" for n in names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        group: tuple | None = None
        ks: list[float] = []
        kept: list[tuple] = []
        fields: pa.Schema | None = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, fields, strict=True)], names=names)
        for b in batches:
            s = b.schema
            fields = [s.field(n).type if n in types else pa.int32() for n in names]
            out: list[tuple] = []
            columns = [b.column(s.get_field_index(n)).to_pylist() for n in ("_run", "cell", "side", "kind", "k", "row", "step", "back", "payload")]
            for run, cell, side, kind, k, row, step, back, payload in zip(*columns, strict=True):
                if (run, cell, side) != group:
                    group, ks, kept = (run, cell, side), [], []
                if kind == TRAIN:
                    while ks and ks[-1] >= k:
                        ks.pop()
                        kept.pop()
                    ks.append(k)
                    kept.append((step, back, payload))
                else:
                    at = (bisect_right if side == 0 else bisect_left)(ks, k) - 1
                    out.append((*group, EVAL, chunk, k, row, *(kept[at] if at >= 0 else (None, None, None))))
            if out:
                yield batch(out)
        if kept:
            yield batch([(*group, KEPT, chunk, k, None, *x) for k, x in zip(ks, kept, strict=True)])
    return sides.mapInArrow(task, schema)


def _from_earlier_chunks(swept: DataFrame) -> DataFrame:
    """(row, step, back, payload): answers that lie in an earlier chunk of the question's cell."""
    key = ["_run", "cell", "side"]
    kept = swept.where(F.col("kind") == KEPT)
    least = kept.groupBy(*key, "chunk").agg(F.min("k").alias("least"))  # one row a chunk at most
    ends = least.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("chunk", "least"))).alias("ends")).withColumnsRenamed({c: f"_{c}" for c in key})
    open_ = swept.where((F.col("kind") == EVAL) & F.col("step").isNull())
    same = F.lit(True)
    for c in key:
        same = same & open_[c].eqNullSafe(F.col(f"_{c}"))
    under = lambda x: F.when(F.col("side") == 0, x["least"] <= F.col("k")).otherwise(x["least"] < F.col("k"))
    earlier = F.filter("ends", lambda x: (x["chunk"] < F.col("chunk")) & under(x))
    asked = open_.join(F.broadcast(ends), same).withColumn("target", F.try_element_at(earlier, F.lit(-1))["chunk"])
    asked = asked.where(F.col("target").isNotNull()).select(*key, "kind", F.col("target").alias("chunk"), "k", "row", "step", "back", "payload")
    # numbers ascend in a kept list, and later ones are later in step order: the last at most k answers
    first = F.when((F.col("side") == 0) == (F.col("kind") == KEPT), 0).otherwise(1)
    x = sorted_chunks(kept.select(*asked.columns).unionByName(asked).withColumn("_first", first), [*key, "chunk"], ["k", "_first"])
    last = F.when(F.col("kind") == KEPT, F.struct("step", "back", "payload"))
    filled = forward_fill(x.withColumnRenamed("_chunk", "_sub"), [*key, "chunk"], "_at", last, "_answer", F.col("_sub"))
    return filled.where(F.col("kind") == EVAL).select("row", "_answer.*")


def last_in_window(log: DataFrame, run_col: str, is_train: Column, epoch: str, step: str, pos: str, carry: Sequence[str], eps: float) -> DataFrame:
    """The log's rows that aren't train rows, with ``_t``: the carried columns of each one's train row, or null."""
    ship_package(log.sparkSession)
    base = materialise(log.withColumn("_row", F.monotonically_increasing_id()).withColumn("_run", F.col(run_col)), "log")
    sides = _questions(base, is_train, epoch, step, pos, F.struct(*carry), eps)
    order = ["_run", "cell", "side", "step", "kind", "back"]
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    swept = materialise(_sweep(sides.repartitionByRange(n, *order).sortWithinPartitions(*order)), "swept")
    near = swept.where((F.col("kind") == EVAL) & F.col("step").isNotNull()).select("row", "step", "back", "payload")
    answers = near.unionByName(_from_earlier_chunks(swept)).groupBy(F.col("row").alias("_asked")).agg(
        F.max_by("payload", F.struct("step", "back")).alias("_t"))
    evals = base.where(~F.coalesce(is_train, F.lit(False)))
    return evals.join(answers, F.col("_row") == F.col("_asked"), "left").drop("_asked", "_row", "_run")
