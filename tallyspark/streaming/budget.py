"""Request budget per key (STR2): ``limit`` requests a window of ``seconds``, as a batch job and as a stream.

The window isn't aligned to the clock. It opens with a key's first request and takes ``limit``
requests, however long that lasts. The next request opens the next window, but not before
``seconds`` have passed since the last one opened; until then it waits, and so do the requests
behind it. So a window takes the requests ``k * limit`` to ``k * limit + limit - 1`` of its key, and
opens at ``max(its first request, opening of the one before + seconds)``.

The batch job finds places in the log by range-sorted chunks and the openings by a running maximum,
so a hot key is dealt over many tasks. The stream keeps four numbers and the requests that the
watermark hasn't passed yet per key, in Spark's state store; an event-time timer brings a key back
when the watermark has passed its first waiting request. Requests are counted in the order of
their time, whatever order they arrive in within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tallyspark.operators.windows import exact_row_number, running_max, sorted_chunks
from tallyspark.session import ship_package
from tallyspark.streaming.jobs import _files

CHUNK = 1 << 20


def _result(windows: DataFrame) -> DataFrame:
    """Windows with times and the wait of their first request, from microseconds."""
    waited = (F.col("opened") - F.col("first")) / 1e6
    return windows.select("key", "window_no", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("first").alias("first_request"),
                          F.timestamp_micros("last").alias("last_request"), "n", waited.alias("waited"), (waited > 0).alias("over_limit"))


def budget_windows(log: DataFrame, limit: int, seconds: int = 60, ts_col: str = "ts", key_col: str = "key") -> DataFrame:
    """(key, window_no, opened, first_request, last_request, n, waited, over_limit): the full windows of a log.

    A window that has fewer than ``limit`` requests at the end of the log isn't full and not
    returned. Rows with a null time are left out; null keys are one key.
    """
    step = seconds * 1_000_000
    x = log.select(F.col(key_col).alias("key"), F.unix_micros(F.col(ts_col).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    x = exact_row_number(sorted_chunks(x, ["key"], ["us"]), ["key"], ["_at"], F.col("_chunk"), "_rn")
    w = (x.groupBy("key", F.floor((F.col("_rn") - 1) / limit).alias("window_no"))
         .agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") == limit))
    w = w.withColumn("_free", F.col("first") - step * F.col("window_no"))
    w = running_max(w, ["key"], "window_no", "_free", "_top", F.floor(F.col("window_no") / CHUNK))
    return _result(w.withColumn("opened", F.col("_top") + step * F.col("window_no")))


def advance(ready: np.ndarray, total: int, opened: int, first: int, limit: int, step: int) -> tuple[dict[str, np.ndarray], int, int, int]:
    """Count sorted requests on: the windows that become full, and (total, opened, first) afterwards.

    ``total`` requests were counted before; ``opened`` and ``first`` are of the last window.
    """
    place = total + np.arange(len(ready))
    starts = np.flatnonzero(place % limit == 0)
    at, no = ready[starts], place[starts] // limit
    if total:
        no0 = (total - 1) // limit
        at, no, firsts = np.concatenate([[opened], at]), np.concatenate([[no0], no]), np.concatenate([[first], at])
    else:
        firsts = at
    opens = np.maximum.accumulate(at - step * no) + step * no if len(at) else at
    ends = np.flatnonzero(place % limit == limit - 1)
    of = place[ends] // limit - (no[0] if len(no) else 0)
    full = {"window_no": place[ends] // limit, "opened": opens[of], "first": firsts[of], "last": ready[ends], "n": np.full(len(ends), limit, np.int64)}
    return full, total + len(ready), int(opens[-1]) if len(opens) else opened, int(firsts[-1]) if len(firsts) else first


def budget_stream(spark: SparkSession, source_dir: str, schema: StructType, limit: int, sink_path: str, checkpoint_path: str,
                  seconds: int = 60, watermark: str = "2 minutes", glob: str | None = None, ts_col: str = "ts", key_col: str = "key",
                  max_files: int | None = None):
    """Stream a request log's files into a Parquet table of full windows (as ``budget_windows`` gives them).

    Runs until all files that are there have been read. Requests at or after the last watermark
    (latest request less ``watermark``) stay in the state and are counted by a later run with the
    same checkpoint; ones that come after the watermark has passed them are left out. A restart
    repeats an unfinished batch from the state before it, and the file sink lists each batch once.
    """
    ship_package(spark)
    step = seconds * 1_000_000
    kind = _files(spark, source_dir, schema, glob, None).schema[key_col].dataType.simpleString()
    requests = _files(spark, source_dir, schema, glob, None, max_files).where(F.col(ts_col).isNotNull())
    requests = requests.withColumn(ts_col, F.col(ts_col).cast("timestamp")).withWatermark(ts_col, watermark)

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, opened, first, waiting = state.get if state.exists else (0, 0, 0, [])
        parts = [np.array(waiting, np.int64)]
        if not state.hasTimedOut:
            parts += [b["us"].to_numpy(np.int64) for b in batches]
        times = np.sort(np.concatenate(parts))
        passed = state.getCurrentWatermarkMs()
        n = int(np.searchsorted(times // 1000, passed))
        full, total, opened, first = advance(times[:n], int(total), int(opened), int(first), limit, step)
        rest = times[n:].tolist()
        state.update((total, opened, first, rest))
        if rest:
            state.setTimeoutTimestamp(max(rest[0] // 1000, passed))
        if len(full["n"]):
            yield pd.DataFrame({"key": [key[0]] * len(full["n"]), **full})

    rows = requests.select(F.col(ts_col), F.col(key_col).alias("key"), F.unix_micros(F.col(ts_col)).alias("us"))
    windows = rows.groupBy("key").applyInPandasWithState(
        count, f"key {kind}, window_no long, opened long, first long, last long, n long", "total long, opened long, first long, waiting array<long>",
        "append", GroupStateTimeout.EventTimeTimeout)
    return (_result(windows).writeStream.outputMode("append").format("parquet").option("path", sink_path)
            .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
