"""Connected components of an edge table, by alternating large-star and small-star steps.

Nodes get the least id that they reach. Each step is one aggregation and one join, salted because the centre of
a star may have any share of all edges; the edges between steps are written tables, so nothing is collected and a
lost executor costs a re-read. The number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, salted_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return salted_join(both.filter("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(edges, least, "u", "v").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` (bigint) edges to a written table ``id, component`` of the nodes of edges between different nodes."""
    now = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = materialize(_large_star(now), "edges")
        small = materialize(_small_star(large), "edges")
        discard(now, large)
        now = small
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    out = materialize(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    discard(now)
    return out
