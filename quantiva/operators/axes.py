"""Dimensions of a plan as a graph: ends snapped to nodes, positions of the nodes, and chains between them.

A plan has some tens of dimensions. They are gathered once by plan, snapped where they are, and stay there: the systems of
a batch of plans are solved together, and chains are searched plan by plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sheets import _graphs


def snapped(cotes: DataFrame, tolerance: int) -> DataFrame:
    """``plan, id, lo, hi, value`` of dimensions ``plan, id, start, stop, value`` between different nodes.

    A node is the least of ends that lie within the tolerance of it; an end goes to the nearest node, the first of two as
    near. A dimension whose ends fall together is left out.
    """
    held = cotes.dropna(subset=["plan", "start", "stop"]).groupBy("plan").agg(F.collect_list(F.struct("id", "start", "stop", "value")).alias("cotes"))
    ends = F.array_sort(F.array_distinct(F.concat("cotes.start", "cotes.stop")))
    heads = F.aggregate("ends", F.slice("ends", 1, 1), lambda acc, p: F.when(p - F.element_at(acc, -1) > tolerance, F.concat(acc, F.array(p))).otherwise(acc))
    near = lambda end: F.array_min(F.transform("heads", lambda h: F.struct(F.abs(h - end).alias("gap"), h.alias("head"))))["head"]
    both = held.withColumn("ends", ends).withColumn("heads", heads).select("plan", F.explode(F.transform("cotes", lambda c: F.struct(c["id"].alias("id"), near(c["start"]).alias("lo"), near(c["stop"]).alias("hi"), c["value"].alias("value")))).alias("c"))
    turned = F.when(F.col("c.lo") <= F.col("c.hi"), F.col("c.value")).otherwise(-F.col("c.value"))
    return both.filter("c.lo <> c.hi").select("plan", "c.id", F.least("c.lo", "c.hi").alias("lo"), F.greatest("c.lo", "c.hi").alias("hi"), turned.alias("value"))


def positions(graph: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the nodes of several graphs, and whether a node's component is its graph's anchored one.

    ``graph`` names each node's graph (in order), ``least`` the place of the least node reachable; edges go from place
    ``a`` to ``b``. The component of the least node is anchored there at 0 and solved by least squares: its edges connect
    it, so its rank allows. Any other gets the positions that a breadth-first tree from its least node gives, which are
    relative. Graphs with as many nodes are solved together.
    """
    begin = np.searchsorted(graph, np.arange(graph[-1] + 1 if len(graph) else 0))
    anchored, at = least == begin[graph], np.zeros(len(graph))
    size, own = np.diff(np.r_[begin, len(graph)]), anchored[a]
    for n in np.unique(size).tolist():
        alike, most = np.flatnonzero(size == n), max(1, 2_000_000 // (n * n))
        slot = np.full(len(size), -1)
        for some in (alike[i : i + most] for i in range(0, len(alike), most)):
            slot[some] = np.arange(len(some))
            e = np.flatnonzero(own & (slot[graph[a]] >= 0))
            k, x, y = slot[graph[a[e]]], a[e] - begin[graph[a[e]]], b[e] - begin[graph[a[e]]]
            slot[some] = -1
            system, right = np.zeros((len(some), n, n)), np.zeros((len(some), n))
            for i, j, v in ((x, x, 1), (y, y, 1), (x, y, -1), (y, x, -1)):
                np.add.at(system, (k, i, j), v)
            np.add.at(right, (k, y), value[e])
            np.add.at(right, (k, x), -value[e])
            free = anchored[begin[some][:, None] + np.arange(n)]
            free[:, 0] = False  # the least node is at 0
            system *= free[:, :, None] & free[:, None, :]
            system[:, np.arange(n), np.arange(n)] += ~free
            at[begin[some][:, None] + np.arange(n)] = np.linalg.solve(system, (right * free)[:, :, None])[:, :, 0]
    # trees: a round for each step from the roots; a node is reached from the first that is beside it
    seen, turn = anchored | (least == np.arange(len(least))), np.arange(len(least))
    front = np.flatnonzero(seen & ~anchored)
    e = np.flatnonzero(~own)
    from_, to, v, edge = np.r_[a[e], b[e]], np.r_[b[e], a[e]], np.r_[value[e], -value[e]], np.r_[e, e]
    while len(front):
        now = np.zeros(len(least), bool)
        now[front] = True
        k = np.flatnonzero(now[from_] & ~seen[to])
        k = k[np.lexsort((edge[k], turn[from_[k]], to[k]))]
        k = k[np.r_[True, to[k][1:] != to[k][:-1]][: len(k)]]
        at[to[k]], seen[to[k]] = at[from_[k]] + v[k], True
        front = to[k][np.lexsort((to[k], turn[from_[k]]))]
        turn[front] = np.arange(len(front))
    return np.round(at, 6) + 0.0, anchored


def _gathered(edges: DataFrame) -> DataFrame:
    return edges.groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("id", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), F.col("value").cast("double").alias("value")))).alias("edges"))


def _solved(batch: pa.RecordBatch) -> tuple:
    """Ends of a batch's plans in their edges, the edges, and of the nodes: plan, name, least place, position, anchored."""
    held = batch.column(1)
    ends = held.offsets.to_numpy()
    ids, lo, hi, value = (held.values.field(c).slice(ends[0], ends[-1] - ends[0]) for c in ("id", "lo", "hi", "value"))
    value = value.to_numpy(zero_copy_only=False)
    graph, name, least, a, b = _graphs(ends, lo.to_numpy(zero_copy_only=False), hi.to_numpy(zero_copy_only=False))
    return ends - ends[0], ids, a, b, value, graph, name, least, *positions(graph, least, a, b, value)


def solve(edges: DataFrame) -> DataFrame:
    """``plan, node, component, position, status, rank, unknowns, determined`` of the nodes of ``snapped`` edges."""
    kind, node = (edges.schema[c].dataType.simpleString() for c in ("plan", "lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, graph, name, least, at, anchored = _solved(batch)
            rank = np.bincount(graph, anchored, batch.num_rows).astype(np.int64) - 1
            unknowns = np.bincount(graph, minlength=batch.num_rows) - 1
            status = pa.array(["ESTIME", "OK"]).take(pa.array(anchored.astype(np.int64)))
            columns = [pa.array(name), pa.array(name[least]), pa.array(at), status, pa.array(rank[graph]), pa.array(unknowns[graph]), pa.array((rank == unknowns)[graph])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(graph)), *columns], ["plan", "node", "component", "position", "status", "rank", "unknowns", "determined"])

    out = _gathered(edges).mapInArrow(run, f"plan {kind}, node bigint, component bigint, position double, status string, rank bigint, unknowns bigint, determined boolean")
    return out.withColumns({"node": F.col("node").cast(node), "component": F.col("component").cast(node)})


def residuals(edges: DataFrame) -> DataFrame:
    """``plan, id, residual, most``: what a dimension's nodes are apart less its value, and the plan's greatest."""
    kind, ident = (edges.schema[c].dataType.simpleString() for c in ("plan", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids, a, b, value, *_, at, _ = _solved(batch)
            plan, off = np.repeat(np.arange(batch.num_rows), np.diff(ends)), np.round(at[b] - at[a] - value, 6) + 0.0
            most = np.zeros(batch.num_rows)
            np.maximum.at(most, plan, np.abs(off))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(plan)), ids, pa.array(off), pa.array(most[plan])], ["plan", "id", "residual", "most"])

    return _gathered(edges).mapInArrow(run, f"plan {kind}, id {ident}, residual double, most double")


def chains_from(asked: list[tuple[int, int]], edges: list[tuple]) -> list[tuple]:
    """steps, total and places of the edges of the best chain for each ``a, b`` asked, None where none leads there.

    ``edges`` (lo, hi, value, id) lead upwards, so the best chains to b are found from the last node down.
    """
    down = sorted(range(len(edges)), key=lambda k: -edges[k][0])
    found: dict[int, dict[int, tuple]] = {}
    for b in {b for _, b in asked}:
        best: dict[int, tuple] = {b: (0, True, 0, (), ())}  # a sum that isn't known is the least
        for k in down:
            lo, hi, value, ident = edges[k]
            on = best.get(hi)
            if on is not None and lo < b:
                known = on[1] and value is not None
                new = (on[0] + 1, known, on[2] + value if known else 0, (ident, *on[3]), (k, *on[4]))
                if lo not in best or new < best[lo]:
                    best[lo] = new
        found[b] = best
    return [found[b].get(a) for a, b in asked]


def shortest_chains(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """``plan, a, b, steps, total, chain`` for each pair of nodes asked: the fewest dimensions that lead from a to b.

    Of chains with as few steps the one with the least sum, then the one with the least ids. Null where no chain leads
    there; a pair of one node is a chain of no steps. A plan's edges and what is asked of it meet as one row.
    """
    plan, node, ident, value = (f.dataType.simpleString() for f in (asked.schema["plan"], asked.schema["a"], edges.schema["id"], edges.schema["value"]))
    own = edges.groupBy("plan").agg(F.collect_list(F.struct("lo", "hi", "value", "id")).alias("edges"))
    pairs = asked.groupBy("plan").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    held = pairs.join(own.hint("merge"), "plan", "left").select("plan", "asked", F.coalesce("edges", F.array()).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs_, edges_ = batch.column(1), batch.column(2)
            p, e = pairs_.offsets.to_pylist(), edges_.offsets.to_pylist()
            ask = list(zip(*(pairs_.values.field(c).to_pylist() for c in ("a", "b")), strict=True))
            edge = list(zip(*(edges_.values.field(c).to_pylist() for c in ("lo", "hi", "value", "id")), strict=True))
            steps, total, places, ends = [], [], [], [0]
            for i in range(batch.num_rows):
                for best in chains_from(ask[p[i] : p[i + 1]], edge[e[i] : e[i + 1]]):
                    steps.append(None if best is None else best[0])
                    total.append(best[2] if best is not None and best[1] else None)
                    places += () if best is None else (e[i] + k for k in best[4])
                    ends.append(len(places))
            missing = pa.array(ends[:-1] + [ends[-1]], pa.int32(), mask=np.array([s is None for s in steps] + [False]))
            chain = pa.ListArray.from_arrays(missing, edges_.values.field("id").take(pa.array(places, pa.int64())))
            of = np.repeat(np.arange(batch.num_rows), np.diff(p))
            columns = [pairs_.values.field(c).slice(p[0], p[-1] - p[0]) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns, pa.array(steps, pa.int32()), pa.array(total, edges_.values.field("value").type), chain], ["plan", "a", "b", "steps", "total", "chain"])

    return held.mapInArrow(run, f"plan {plan}, a {node}, b {node}, steps int, total {value}, chain array<{ident}>")
