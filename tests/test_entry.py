"""Driver contract: entry smoke, registry shape, and every query vs its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(repr(_norm(x)) for x in r) for r in pdf[cols].itertuples(index=False, name=None)))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "f1_weighted" in df.columns


def test_registry_shape():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    spdf = E.queries()[name](spark, SF_SMALL).toPandas()
    opdf = con.execute(E.oracle_sql()[name]).df()
    sc, sr = _rows(spdf)
    oc, orr = _rows(opdf)
    assert sc == oc
    assert len(sr) == len(orr)
    assert sr == orr


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_rows_only_queries_give_rows(spark, name):
    rows = E.queries()[name](spark, SF_SMALL)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)
