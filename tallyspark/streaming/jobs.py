"""Structured Streaming re-aims of the source's incremental behaviours (STR1, STR2)."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.functions.labels import DEFAULT_CLASSES
from tallyspark.operators.scoring import ScorerFactory, score_table
from tallyspark.sources.attempts import AttemptLog


def score_stream(spark: SparkSession, source_dir: str, schema: StructType, sink_path: str, checkpoint_path: str,
                 scorer_factory: ScorerFactory, classes: Sequence[str] = DEFAULT_CLASSES, id_col: str = "index",
                 text_col: str = "post", glob: str | None = None, available_now: bool = True,
                 rename: dict[str, str] | None = None):
    """Incremental scoring with durable progress (STR1).

    The file source + checkpoint and an attempt log (``sources.attempts``) replace the
    processed-id set of the source: each micro-batch is de-duplicated on the id, anti-joined with
    the ids in its own buckets of the log (so a re-landed file is not scored twice) and written
    over the log's folder of this query and epoch. A replayed epoch gives its folder the same rows
    again, and a restart with a new checkpoint writes beside what is there. What a batch costs
    depends on its own ids, not on how much has been scored.
    """
    query = hashlib.sha1(checkpoint_path.encode()).hexdigest()[:12]
    stream = _files(spark, source_dir, schema, glob, rename)

    def batch(df: DataFrame, epoch_id: int) -> None:
        log, name = AttemptLog(df.sparkSession, sink_path, id_col), f"{query}-{epoch_id}"
        todo = log.unseen(df.dropDuplicates([id_col]), batch=name)
        log.append(score_table(todo, scorer_factory, classes, text_col, id_col), name)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def rate_windows(df: DataFrame, limit: int, ts_col: str = "ts", key_col: str = "key",
                 window: str = "60 seconds") -> DataFrame:
    """Requests per aligned window and key with an over-limit flag (STR2, batch or stream)."""
    g = df.groupBy(F.window(F.col(ts_col), window).alias("w"), F.col(key_col)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), key_col, "n",
                    (F.col("n") > limit).alias("over_limit"))


def rate_audit(spark: SparkSession, source_dir: str, schema: StructType, limit: int, sink_path: str, checkpoint_path: str,
               watermark: str = "2 minutes", glob: str | None = None, ts_col: str = "ts", key_col: str = "key",
               rename: dict[str, str] | None = None):
    """Streaming request-rate audit of aligned windows into a Parquet table (append mode).

    A window is written once, when the watermark closes it; the file sink's own log makes replayed
    batches count once.
    """
    s = _files(spark, source_dir, schema, glob, rename)
    s = s.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)
    out = rate_windows(s, limit, ts_col, key_col)
    return (out.writeStream.outputMode("append").format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())


def _files(spark: SparkSession, source_dir: str, schema: StructType, glob: str | None, rename: dict[str, str] | None,
           max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(source_dir)
    return stream.withColumnsRenamed(rename) if rename else stream
