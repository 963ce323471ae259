"""Query registry: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans import q_ensemble, q_eval, q_extra, q_io, q_metrics, q_prep, q_runlogs, q_text, q_train

_MODULES = [q_metrics, q_prep, q_text, q_ensemble, q_runlogs, q_eval, q_io, q_extra, q_train]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out.update(m.SQL)
    return out
