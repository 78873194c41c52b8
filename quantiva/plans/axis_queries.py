"""Queries of dimension graphs: an order's lines are the dimensions of one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import axes
from .carriers import read
from .registry import query

TOLERANCE = 2


def cotes(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions between axes some 100 apart, their ends off by one at most; each has an id of its own in its plan."""
    n, q = F.col("l_linenumber").cast("bigint"), F.col("l_quantity").cast("bigint")
    ident = n * 1_000_000_000 + F.col("l_partkey") * 100 + q
    start = n * 100 + F.col("l_partkey") % 3 - 1
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("plan"), ident.alias("id"), start.alias("start"), ((n + 1 + q % 3) * 100 + F.col("l_suppkey") % 3 - 1).alias("stop"), q.alias("value"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return axes.snapped(cotes(spark, sf), TOLERANCE)


_EDGES = """with recursive c as (select l_orderkey plan, l_linenumber::bigint * 1000000000 + l_partkey * 100 + l_quantity::bigint id, l_linenumber::bigint * 100 + l_partkey % 3 - 1 start, (l_linenumber + 1 + l_quantity::bigint % 3) * 100 + l_suppkey % 3 - 1 stop, l_quantity::bigint as value from lineitem),
p as (select plan, start pos from c union select plan, stop from c), heads as (select plan, pos, min(pos) over (partition by plan, (pos + 50) // 100) head from p),
e as (select c.plan, id, a.head lo, b.head hi, value from c join heads a on a.plan = c.plan and a.pos = start join heads b on b.plan = c.plan and b.pos = stop) """


@query("g1_snapped_components", _EDGES + ", u as (select plan, lo a, hi b from e union select plan, hi, lo from e), r as (select plan, a node, a seen from u union select r.plan, r.node, u.b from r join u on u.plan = r.plan and u.a = r.seen) select plan, node::bigint node, min(seen)::bigint component from r group by plan, node")
def g1_snapped_components(spark, sf):
    """Ends of dimensions snapped to nodes, and the components of the graph that they make."""
    return axes.solve(_edges(spark, sf)).select("plan", "node", "component")


@query("g2_axis_solution")
def g2_axis_solution(spark, sf):
    """Positions with rank and status: least squares where anchored, a tree where not; no SQL solves linear systems."""
    return axes.solve(_edges(spark, sf))


@query("g2_residuals")
def g2_residuals(spark, sf):
    return axes.residuals(_edges(spark, sf))


@query("g3_shortest_chain", _EDGES + ", ends as (select plan, max(hi) b from e group by plan), asked as (select distinct plan, lo a, ends.b from e join ends using (plan)), w as (select plan, a, a at_, 0 steps, 0::bigint total, []::bigint[] chain from asked union all select w.plan, w.a, e.hi, steps + 1, total + value, list_append(chain, id) from w join e on e.plan = w.plan and e.lo = w.at_), best as (select plan, a, at_, min(row(steps, total, chain)) m from w group by plan, a, at_) select asked.plan, asked.a, asked.b, m[1] steps, m[2] total, array_to_string(m[3], '+') chain from asked left join best on best.plan = asked.plan and best.a = asked.a and best.at_ = asked.b")
def g3_shortest_chain(spark, sf):
    """The fewest dimensions from each node where one begins to the plan's last node."""
    edges = _edges(spark, sf)
    last = edges.groupBy("plan").agg(F.max("hi").alias("b"))
    asked = edges.select("plan", F.col("lo").alias("a")).distinct().join(last, "plan")
    found = axes.shortest_chains(edges, asked)
    return found.select("plan", "a", "b", "steps", "total", F.array_join("chain", "+").alias("chain"))
