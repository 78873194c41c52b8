"""Dimension graphs against exact arithmetic and plain searches."""

import random
from fractions import Fraction

from quantiva.operators import axes
from quantiva.plans import axis_queries, registry

SMALL = "/root/testdata/sf0.001"


def exact(edges):
    """Positions of one plan: normal equations in fractions where anchored, a breadth-first tree elsewhere."""
    beside = {}
    for _, a, b, v in edges:
        beside.setdefault(a, []).append((b, v))
        beside.setdefault(b, []).append((a, -v))
    part = {}
    for n in sorted(beside):
        if n not in part:
            queue = [n]
            for x in queue:
                if x not in part:
                    part[x] = n
                    queue += [y for y, _ in beside[x]]
    anchor = min(part)
    free = sorted(n for n in part if part[n] == anchor and n != anchor)
    m = [[Fraction(0)] * (len(free) + 1) for _ in free]
    for _, a, b, v in edges:
        if part[a] == anchor:
            row = {x: s for x, s in ((a, -1), (b, 1)) if x != anchor}
            for x, s in row.items():
                m[free.index(x)][-1] += s * Fraction(v)
                for y, u in row.items():
                    m[free.index(x)][free.index(y)] += s * u
    for k in range(len(free)):
        pivot = next(r for r in range(k, len(free)) if m[r][k])
        m[k], m[pivot] = m[pivot], m[k]
        m[k] = [x / m[k][k] for x in m[k]]
        for r in range(len(free)):
            if r != k:
                m[r] = [x - m[r][k] * y for x, y in zip(m[r], m[k])]
    at = {anchor: Fraction(0), **{n: m[k][-1] for k, n in enumerate(free)}}
    for root in sorted(set(part.values()) - {anchor}):
        at[root], queue = 0, [root]
        for x in queue:
            for y, v in sorted(beside[x], key=lambda e: e[0]):
                if y not in at:
                    at[y] = at[x] + v
                    queue.append(y)
    return at, part, len(free)


def test_positions_are_exact(spark):
    edges = axis_queries._edges(spark, SMALL)
    by = {}
    for r in edges.collect():
        by.setdefault(r["plan"], []).append((r["id"], r["lo"], r["hi"], r["value"]))
    got = {(r["plan"], r["node"]): r for r in axes.solve(edges).collect()}
    off = {(r["plan"], r["id"]): r for r in registry.QUERIES["g2_residuals"](spark, SMALL).collect()}
    kinds = set()
    for plan, own in by.items():
        at, part, rank = exact(sorted(own))
        for n, p in at.items():
            r = got[plan, n]
            sure = rank == len(at) - 1
            kinds.add((sure, r["status"]))
            assert abs(r["position"] - p) < 1e-5 and r["component"] == part[n] and (r["rank"], r["unknowns"], r["determined"]) == (rank, len(at) - 1, sure)
            assert r["status"] == ("OK" if part[n] == min(part) else "ESTIME")
        left = {i: float(at[b] - at[a] - v) for i, a, b, v in own}
        assert all(abs(off[plan, i]["residual"] - x) < 1e-5 and abs(off[plan, i]["most"] - max(map(abs, left.values()))) < 1e-5 for i, x in left.items())
    assert kinds == {(True, "OK"), (False, "OK"), (False, "ESTIME")}


def test_ends_snap_to_the_nearest_node(spark):
    rows = [(1, 1, 0, 100, 5), (1, 2, 102, 1, 9), (1, 3, 2, 1, 4), (1, 4, 101, 103, 2), (2, 1, 7, 7, 1)]
    got = axes.snapped(spark.createDataFrame(rows, "plan bigint, id bigint, start bigint, stop bigint, value bigint"), 2)
    assert sorted(map(tuple, got.select("plan", "id", "lo", "hi", "value").collect())) == [(1, 1, 0, 100, 5), (1, 2, 0, 103, -9), (1, 4, 100, 103, 2)]


def test_shortest_chains_are_breadth_first(spark):
    rng = random.Random(9)
    rows = [(p, i, *sorted(rng.sample(range(14), 2)), rng.randrange(1, 9)) for p in range(25) for i in range(rng.randrange(1, 30))]
    asked = [(p, a, b) for p in range(25) for a in range(0, 14, 3) for b in range(a, 14, 2)]
    frame = lambda r, k: spark.createDataFrame(r, k)
    got = axes.shortest_chains(frame(rows, "plan bigint, id bigint, lo bigint, hi bigint, value bigint"), frame(asked, "plan bigint, a bigint, b bigint")).collect()

    def search(p, a, b):
        best = {a: (0, 0, [])}
        for n in range(a, b):
            for _, i, lo, hi, v in (r for r in rows if r[0] == p and r[2] == n and n in best):
                new = best[n][0] + 1, best[n][1] + v, [*best[n][2], i]
                best[hi] = min(best.get(hi, new), new)
        return best.get(b, (None, None, None))

    assert {(r["plan"], r["a"], r["b"]): (r["steps"], r["total"], r["chain"]) for r in got} == {x: search(*x) for x in asked}
    assert {r["steps"] for r in got} >= {None, 0, 1, 2, 3}
