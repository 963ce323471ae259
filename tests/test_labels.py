"""Label codecs and array math against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import labels as L


def test_softmax_argmax_ordinal(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 4)) * 3
    z[0] = [1.0, 1.0, 0.5, 1.0]  # ties: first max wins
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(z)], "i int, z array<double>")
    out = {r.i: r for r in df.select("i", L.softmax("z").alias("p"), L.argmax("z").alias("a"),
                                     L.ordinal_predict(F.slice("z", 1, 3)).alias("o")).collect()}
    for i, row in enumerate(z):
        e = np.exp(row - row.max())
        np.testing.assert_allclose(out[i].p, e / e.sum(), rtol=1e-12)
        assert out[i].a == int(np.argmax(row))
        assert out[i].o == int((row[:3] > 0).sum())


def test_ordinal_roundtrip_and_expand(spark):
    df = spark.createDataFrame([(k,) for k in range(4)], "k int")
    rows = df.select("k", L.ordinal_encode("k", 4).alias("v")).select("k", "v", L.ordinal_decode("v").alias("b")).collect()
    for r in rows:
        assert r.v == [1.0] * r.k + [0.0] * (3 - r.k) and r.b == float(r.k)
    p = spark.createDataFrame([([0.1, 0.2, 0.3, 0.4],)], "probs array<double>")
    e = L.expand_probs(p, "probs", L.DEFAULT_CLASSES).first()
    assert e.prob_attempt == pytest.approx(0.4) and e.prob_indicator == pytest.approx(0.1)


def test_normalize_and_vocabulary(spark):
    df = spark.createDataFrame([("Behavior", "behavior"), (None, "Ideation")], "t string, p string")
    n = df.select(L.normalize("t").alias("t"), L.normalize("p").alias("p"))
    vocab = {r.label: r.code for r in L.vocabulary(n, "t", "p").collect()}
    assert vocab == {"behavior": 0, "ideation": 1, "nan": 2}
    assert [r.s for r in spark.createDataFrame([("LABEL_NOT_FOUND",), ("a",)], "x string").select(
        L.status("x").alias("s")).collect()] == ["label_not_found", "ok"]


def test_with_softmax_equals_expression(spark):
    df = spark.createDataFrame([([1.0, 2.0, -3.0],), ([0.0, 0.0, 0.0],)], "z array<double>")
    a = [r.p for r in df.select(L.softmax("z").alias("p")).collect()]
    b = [r.p for r in L.with_softmax(df, "z", "p").select("p").collect()]
    assert a == b
