"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one grouped minimum and one equi-join; a vertex with very many neighbours is
pre-aggregated for the minimum, and its rows of the join can be split (they meet a unique
key). The edge table is checkpointed after each round, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import ensure_checkpoint_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, component): the smallest vertex reachable from each vertex of ``edges`` (u, v: long).

    Loops, repeated edges and both directions are fine; rows with a null end are left out.
    Vertices without an edge to another one don't appear.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        edges = _small_star(_large_star(edges).where("u != v").distinct()).where("u != v").distinct().checkpoint()
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("connected components did not settle")
    stars = edges.groupBy("u").agg(F.min("v").alias("component"))
    return stars.union(edges.select("v").distinct().select(F.col("v").alias("u"), F.col("v").alias("component")))
