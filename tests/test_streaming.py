"""Structured Streaming jobs on a landing folder (availableNow triggers)."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.operators import scoring as S
from tallyspark.streaming import budget as B
from tallyspark.streaming import jobs as ST


def test_score_stream_is_incremental_and_idempotent(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "land")
    schema = "index long, post string"
    spark.createDataFrame([(i, "x" * i) for i in range(10)], schema).write.parquet(os.path.join(land, "a"))
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    st = StructType([StructField("index", LongType()), StructField("post", StringType())])
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    q = ST.score_stream(spark, os.path.join(land, "*"), st, sink, ck, S.length_scorer_factory(4))
    q.awaitTermination()
    # a second landing file repeats ids 5..9 and adds 10..14
    spark.createDataFrame([(i, "x" * i) for i in range(5, 15)], schema).write.parquet(os.path.join(land, "b"))
    q = ST.score_stream(spark, os.path.join(land, "*"), st, sink, ck, S.length_scorer_factory(4))
    q.awaitTermination()
    out = spark.read.parquet(sink)
    assert out.count() == 15
    assert out.select("index").distinct().count() == 15


def test_score_stream_restart_and_replay_keep_every_id(spark, tmpdir_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    land, sink = os.path.join(tmpdir_path, "land"), os.path.join(tmpdir_path, "sink")
    st = StructType([StructField("index", LongType()), StructField("post", StringType())])
    spark.createDataFrame([(i, "x" * i) for i in range(20)], st).write.parquet(os.path.join(land, "a"))

    def run(ck):
        ST.score_stream(spark, os.path.join(land, "*"), st, sink, os.path.join(tmpdir_path, ck), S.length_scorer_factory(4)).awaitTermination()
        ids = sorted(r["index"] for r in spark.read.parquet(sink).select("index").collect())
        assert ids == list(range(20))
    run("ck")
    run("other")  # a new checkpoint starts with epoch 0 again
    commits = os.path.join(tmpdir_path, "ck", "commits")
    for f in os.listdir(commits):  # as if the run had died before it committed: the epoch is replayed
        os.remove(os.path.join(commits, f))
    run("ck")


def test_rate_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:01", "k"), ("2024-01-01 00:00:30", "k"), ("2024-01-01 00:00:59", "k"),
                                ("2024-01-01 00:01:00", "k")], "ts string, key string").withColumn("ts", F.to_timestamp("ts"))
    out = {r.window_start: r for r in ST.rate_windows(df, 2).collect()}
    assert out["2024-01-01 00:00:00"].n == 3 and out["2024-01-01 00:00:00"].over_limit
    assert out["2024-01-01 00:01:00"].n == 1 and not out["2024-01-01 00:01:00"].over_limit


def test_rate_audit_stream(spark, tmpdir_path):
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType
    land = os.path.join(tmpdir_path, "req")
    df = spark.createDataFrame([("2024-01-01 00:00:01", "k")] * 3 + [("2024-01-01 00:10:00", "k")], "ts string, key string")
    df.withColumn("ts", F.to_timestamp("ts")).write.parquet(land)
    schema = StructType([StructField("ts", TimestampType()), StructField("key", StringType())])
    sink, ck = os.path.join(tmpdir_path, "windows"), os.path.join(tmpdir_path, "windows-ck")
    for _ in range(2):  # a second run finds nothing new and writes nothing twice
        ST.rate_audit(spark, land, schema, 2, sink, ck, watermark="1 minute").awaitTermination()
        rows = spark.read.parquet(sink).collect()
        assert [(r.window_start, r.n, r.over_limit) for r in rows] == [("2024-01-01 00:00:00", 3, True)]


def _plain_budget(requests, limit, seconds):
    """The sequential rule, request by request: {(key, window): (opened, first, last)} of full windows, in microseconds."""
    out = {}
    for key in {k for k, _ in requests}:
        opened = first = None
        for i, us in enumerate(sorted(t for k, t in requests if k == key)):
            if i % limit == 0:
                opened = us if opened is None else max(us, opened + seconds * 1_000_000)
                first = us
            if i % limit == limit - 1:
                out[key, i // limit] = (opened, first, us)
    return out


def _requests(n, seed=4):
    rnd = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rnd.choice(keys), 1_700_000_000_000_000 + rnd.randrange(n * 1_500_000) // 500 * 500) for _ in range(n)]


SCHEMA = "key string, us long"


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("key", F.timestamp_micros("us").alias("ts"))


def _got(df):
    rows = df.select("key", "window_no", *[F.unix_micros(c).alias(c) for c in ("opened", "first_request", "last_request")], "n", "waited", "over_limit").collect()
    assert all(r.over_limit == (r.waited > 0) and abs(r.waited - (r.opened - r.first_request) / 1e6) < 1e-9 for r in rows)
    out = {(r.key, r.window_no): (r.opened, r.first_request, r.last_request) for r in rows}
    assert len(out) == len(rows)
    return out


def test_budget_windows_against_the_sequential_rule(spark):
    rows = _requests(900)
    for limit, seconds in ((1, 3), (4, 10), (7, 60)):
        want = _plain_budget(rows, limit, seconds)
        assert _got(B.budget_windows(_frame(spark, rows), limit, seconds)) == want
        assert any(o > f for o, f, _ in want.values())
    assert B.budget_windows(_frame(spark, []), 2).collect() == []


def test_advance_equals_one_pass():
    rnd = random.Random(6)
    for limit in (1, 2, 5):
        times = np.array(sorted(rnd.randrange(1000) for _ in range(120)))
        whole, *_ = B.advance(times, 0, 0, 0, limit, 30)
        at, state, parts = 0, (0, 0, 0), []
        while at < len(times):
            n = rnd.randrange(0, 9)
            full, *state = B.advance(times[at:at + n], *state, limit, 30)
            parts.append(full)
            at += n
        for name, values in whole.items():
            assert np.concatenate([p[name] for p in parts]).tolist() == values.tolist(), (limit, name)


def test_budget_stream_over_files_and_restarts(spark, tmpdir_path):
    """Files come in any order within the watermark and are read in two runs; a batch that wasn't committed is repeated."""
    from pyspark.sql.types import StringType, StructField, StructType, TimestampType
    schema = StructType([StructField("key", StringType()), StructField("ts", TimestampType())])
    land, sink, ck = (os.path.join(tmpdir_path, x) for x in ("land", "full", "state"))
    rows = sorted(_requests(600), key=lambda r: r[1])
    limit, seconds, delay = 4, 20, 120_000
    cut = [rows[lo:lo + 150] for lo in range(0, 600, 150)]
    rnd = random.Random(3)
    for lo, hi in zip(cut, cut[1:]):  # some requests arrive a file late, but before the watermark passes them
        late = [r for r in lo if r[1] > max(x[1] for x in lo) - 60_000_000 and rnd.random() < 0.5]
        for r in late:
            lo.remove(r)
            hi.append(r)

    def run():
        B.budget_stream(spark, os.path.join(land, "*"), schema, limit, sink, ck, seconds, "2 minutes", max_files=1).awaitTermination()
        return _got(spark.read.parquet(sink))

    def want(files):
        seen = [r for f in files for r in f]
        passed = max(t for _, t in seen) // 1000 - delay
        return _plain_budget([r for r in seen if r[1] // 1000 < passed], limit, seconds)
    for k in (0, 1):
        _frame(spark, cut[k]).coalesce(1).write.parquet(os.path.join(land, f"f{k}"))
    assert run() == want(cut[:2])
    for k in (2, 3):
        _frame(spark, cut[k]).coalesce(1).write.parquet(os.path.join(land, f"f{k}"))
    assert run() == want(cut)
    commits = sorted((f for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit()), key=int)
    for f in (commits[-1], f".{commits[-1]}.crc"):  # as if the run had died before it committed
        os.remove(os.path.join(ck, "commits", f))
    assert run() == want(cut)


def test_streams_read_tables_of_one_file_and_of_many(spark, tmpdir_path):
    from tallyspark.plans import q_io
    docs = spark.createDataFrame([(i, "x" * i) for i in range(40)], "doc_id long, text string")
    events = spark.createDataFrame([(f"2024-01-01 00:{i:02d}:00", "k") for i in range(40)], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    counts = []
    for name in ("many", "one"):
        d = os.path.join(tmpdir_path, name)
        for table, rows in (("documents", docs), ("events", events)):
            folder = os.path.join(d, f"{table}.parquet")
            if name == "many":
                rows.repartition(3).write.parquet(folder)
            else:
                rows.coalesce(1).write.parquet(os.path.join(d, "written", table))
                part = next(f for f in os.listdir(os.path.join(d, "written", table)) if f.endswith(".parquet"))
                os.link(os.path.join(d, "written", table, part), folder)
        scored = sorted(r["index"] for r in q_io.score_stream(spark, d).collect())
        counts.append((scored, q_io.rate_audit_stream(spark, d).count(), q_io.rate_budget_stream(spark, d).count()))
    assert counts[0] == counts[1] and counts[0][0] == list(range(40)) and counts[0][1] > 0 and counts[0][2] > 0
