"""A keyed log of scoring attempts (SCR2, SNK3, STR1): durable progress that batches append to.

Layout: ``<path>/buckets=<n>/gen=<k>/batch=<name>/bucket=<b>/*.parquet``. A row lies in the bucket of
its id's hash. A batch reads the ids of its own buckets only (folders, so the rest is never
listed for reading), which makes a small batch cheap however much is there. Each batch has a
folder of its own and overwrites it, so a repeated batch counts once. ``compact`` rewrites the
log into the next generation, one attempt an id, and switches over by a rename; readers take the
highest generation. One writer at a time; readers at any time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import path_exists


def _children(spark: SparkSession, path: str, key: str) -> list[str]:
    """The values of the sub-folders ``key=value``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{key}=")]


def _folder(batch: str) -> str:
    """The folder value of a batch; never one that reads as a number."""
    return f"b-{batch}"


class AttemptLog:
    """Rows (id, predicted_label, probs, success, error, ...) by id; ``buckets`` is fixed by the first batch."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "index", buckets: int = 64) -> None:
        self.spark, self.root, self.id_col = spark, path.rstrip("/"), id_col
        found = _children(spark, self.root, "buckets")
        self.buckets = int(found[0]) if found else buckets
        self.path = f"{self.root}/buckets={self.buckets}"

    def _generation(self) -> str:
        return f"{self.path}/gen={max((int(k) for k in _children(self.spark, self.path, 'gen')), default=0)}"

    def bucket(self, id_: Column) -> Column:
        """The bucket of an id, the same for all integer types."""
        return F.pmod(F.xxhash64(id_.cast("string")), F.lit(self.buckets)).cast("int")

    def attempts(self) -> DataFrame | None:
        """All rows with their ``batch`` and ``bucket``; none before the first batch."""
        gen = self._generation()
        if not _children(self.spark, gen, "batch"):
            return None
        return self.spark.read.option("mergeSchema", False).option("basePath", gen).parquet(gen)

    def latest(self) -> DataFrame | None:
        """One row per id: a successful attempt if there is one, otherwise a failed one."""
        rows = self.attempts()
        if rows is None:
            return None
        cols = [c for c in rows.columns if c not in (self.id_col, "batch", "bucket")]
        best = F.max_by(F.struct(*cols), F.struct(F.col("success").cast("int"), F.col("predicted_label"), F.col("batch")))
        return rows.groupBy(self.id_col).agg(best.alias("_r"), F.count(F.lit(1)).alias("attempts")).select(self.id_col, "_r.*", "attempts")

    def unseen(self, todo: DataFrame, retry_errors: bool = False, batch: str | None = None) -> DataFrame:
        """The rows of ``todo`` whose id has no attempt yet (with ``retry_errors``: no successful one).

        Attempts of ``batch`` itself don't count: a repeated batch gives the same rows again.
        Only the buckets of ``todo``'s ids are read, of these only ids.
        """
        rows = self.attempts()
        if rows is None:
            return todo
        mine = [r[0] for r in todo.select(self.bucket(F.col(self.id_col))).distinct().collect()]  # at most ``buckets``
        done = rows.where(F.col("bucket").isin(mine))
        if batch is not None:
            done = done.where(F.col("batch") != _folder(batch))
        if retry_errors:
            done = done.where("success")
        kind = todo.schema[self.id_col].dataType
        return todo.join(done.select(F.col(self.id_col).cast(kind).alias(self.id_col)), self.id_col, "left_anti")

    def append(self, scored: DataFrame, batch: str | None = None) -> None:
        """Write a batch's rows into its own folder, replacing what an earlier try of it left there."""
        rows = scored.withColumn("bucket", self.bucket(F.col(self.id_col)))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self._generation()}/batch={_folder(batch or uuid.uuid4().hex)}")

    def compact(self) -> None:
        """One batch folder with one attempt an id, as the next generation."""
        rows, gen = self.latest(), self._generation()
        if rows is None:
            return
        to = f"{self.path}/gen={int(gen.rsplit('=', 1)[1]) + 1}"
        part = f"{self.path}/_part-{uuid.uuid4().hex}"
        kept = rows.drop("attempts").withColumn("bucket", self.bucket(F.col(self.id_col)))
        kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{part}/batch={_folder(uuid.uuid4().hex)}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(part).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if path_exists(self.spark, to) or not fs.rename(path(part), path(to)):
            raise RuntimeError(f"{to} was written meanwhile: only one writer may compact")
