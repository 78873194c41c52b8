"""Queries of kernels that look at one sheet at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sheets
from .carriers import CTE, placements
from .matching_queries import words
from .registry import query


def _edges(spark, sf):
    a = F.col("inst").cast("bigint")
    return placements(spark, sf).select((F.col("project")).alias("plan"), a.alias("a"), (a + 1 + F.col("qty") % 3).alias("b"), F.col("qty").alias("value"))


@query("g1_axis_components", f"with recursive {CTE}, e as (select project plan, inst::bigint a, inst + 1 + qty % 3 b from placements), u as (select plan, a, b from e union select plan, b, a from e), r as (select plan, a node, a seen from u union select r.plan, r.node, u.b from r join u on u.plan = r.plan and u.a = r.seen) select plan, node::bigint node, min(seen)::bigint component from r group by plan, node")
def g1_axis_components(spark, sf):
    """The graph of a plan's dimensions: its nodes with their component."""
    return sheets.axis_graph(_edges(spark, sf), "plan", solved=False)


@query("g2_axis_positions")
def g2_axis_positions(spark, sf):
    """Positions of the nodes by least squares, the first of each component at 0; no SQL solves linear systems."""
    return sheets.axis_graph(_edges(spark, sf), "plan")


def _marks(spark, sf):
    w = words(spark, sf).withColumn("sheet", F.concat("page", F.lit("/"), (F.col("ref") % 7).cast("string")))
    return w.select("sheet", "id", "x", "y", (F.col("x") + 900).alias("x1"), (F.col("y") + 9000).alias("y1"), (F.col("id") * 7919 % 1_000_003).alias("rank")).withColumnsRenamed({"x": "x0", "y": "y0"})


@query("g22_suppress_boxes")
def g22_suppress_boxes(spark, sf):
    """Boxes of a sheet without those that mostly lie on a surer one: each choice depends on those before it."""
    return sheets.suppress(_marks(spark, sf), "sheet", "rank", 7)


@query("u4_merge_readings")
def u4_merge_readings(spark, sf):
    """Two readings of a sheet: of marks that share 40 % of the smaller the surer one."""
    return sheets.suppress(_marks(spark, sf), "sheet", "rank", 4, of_smaller=True)
