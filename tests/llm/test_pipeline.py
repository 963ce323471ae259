"""The pipeline's stages on their own inputs, against the operators and brute force."""

import __spark_entry__ as E
import corpus_pipeline as P
from test_operators import _components, _plain_spans, _sets

from tallyspark.llm import pii, quality, rules
from tallyspark.llm.common import materialise, table

SF = "/root/testdata/sf0.001"


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "PII", "packing"]


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    columns = docs.columns
    out = []
    for name, stage in P.STAGES:
        docs_in = docs
        docs = materialise(stage(spark, docs, SF), "test")
        out.append((name, docs_in, docs))
        if name != "packing":
            assert docs.columns == columns
    (_, a, b), (_, b2, c), (_, c2, d), (_, d2, e), (_, e2, f) = out
    ids = lambda x: sorted(r["doc_id"] for r in x.select("doc_id").collect())
    assert ids(b) == ids(quality.quality_scores(a, labels).where("predicted = 1"))
    assert ids(c) == ids(rules.quality_rules(b2, labels).where("kept"))
    texts = [(r["doc_id"], r["text"]) for r in c2.collect()]
    of = _components(_sets(texts))
    assert ids(d) == sorted(i for i in of if of[i] == i)
    before = {r["doc_id"]: r["text"] for r in d2.collect()}
    for r in e.collect():
        assert r["n_chars"] == len(r["text"])
        if not pii._SOME.search(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
        assert not _plain_spans(r["text"])
    assert sorted(set(r["doc_id"] for r in f.collect())) == ids(e2)


def test_stages_on_odd_and_empty_tables(spark):
    """Nulls in any column, empty and repeated rows, a long text, no rows: no stage fails, all but the last keep the columns."""
    schema = table(spark, SF, "documents").schema
    plain = "The quick brown fox jumps over the lazy dog near the old mill by the river while it rains all day long and nobody cares"
    rows = [(1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, None, None, None, None), (3, "", "en", "a", 0), (None, plain, "en", "a", 1), (None, None, None, None, None),
            (4, (plain + " mail a.b@c.org ") * 300, "en", "a", 9), (5, "x" * 50_000, "en", "a", 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            n = out.count()
            assert n <= len(data) * 40 and (data or n == 0), name
            if name == "PII":
                assert n == len(data) and not any("a.b@c.org" in (r["text"] or "") for r in out.collect())
            if name == "n-gram Jaccard join" and data:
                assert sorted(repr(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "4", "5", "None", "None"]


def test_stages_send_few_texts_at_once(spark, monkeypatch):
    """However large the batches that a task reads, the ones that it sends hold few rows; all rows come, in order."""
    from tallyspark.llm import common as C
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(1234)), pa.array([f"mail a{i}@b.org" for i in range(1234)])], names=["doc_id", "text"])
    parts = list(C.slices(batch))
    assert max(p.num_rows for p in parts) <= 500 and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sent, docs = [], spark.createDataFrame([(i, f"mail a{i}@b.org") for i in range(1234)], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: sent.extend(task(iter([batch]))) or self)
    monkeypatch.setattr(pii, "train", lambda docs, s: pii.Field(*(pii.np.zeros((n, pii.LABELS)) for n in (pii._AT[-1], pii.LABELS, pii.LABELS, pii.LABELS))))
    pii.masked(docs)
    assert [p.num_rows for p in sent] == [500, 500, 234]
    assert [x for p in sent for x in p.column(1).to_pylist()] == ["mail [EMAIL]"] * 1234


def test_stages_read_few_texts_at_once(spark):
    """A task gets a few MB of rows at once, also when the stage's table is computed later; a size that the session names stays."""
    import pyarrow as pa

    from tallyspark.llm import common as C

    def sizes(batches):
        found = [b.nbytes for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["n"])
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text").coalesce(1)
    empty = spark.createDataFrame([], table(spark, SF, "documents").schema)
    key, before = C._BATCH_KEY, spark.conf.getAll.get(C._BATCH_KEY)
    try:
        for name, stage in P.STAGES:
            if name == "quality rules":  # has no Python task
                continue
            spark.conf.unset(key)
            stage(spark, empty, SF)
            found = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
            assert max(found) <= 2 * C.BATCH_BYTES and sum(found) >= 15_000_000, name
        spark.conf.set(key, "12345")
        C.small_batches(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
