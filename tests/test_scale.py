"""Steps whose work must not outgrow their input, against plain ways to the same result."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_for_walls_are_not_broadcast(spark):
    from quantiva.operators import walls
    from quantiva.plans.room_queries import dotted_marks

    assert "Broadcast" not in plan(walls.dotted_walls(dotted_marks(spark, SMALL)))


def test_votes_for_walls_stay_in_the_task_of_their_sheet(spark, monkeypatch):
    """Votes are no rows where sheets fit in a task; there and where they are rows the walls are the same."""
    from quantiva.operators import walls
    from quantiva.plans.room_queries import dotted_marks

    marks = dotted_marks(spark, SMALL).withColumn("id", F.concat(F.lit("m"), F.format_string("%09d", "id"))).localCheckpoint()
    odd = spark.createDataFrame([(10**6, f"o{i}", x, 5.0, 2.0, 3.0, None) for i, x in enumerate([float("inf"), float("nan"), 1e300, None, *(8.0 * i for i in range(9)), 64.0])], "sheet bigint, id string, x double, y double, w double, h double, t double")
    rows = lambda at: monkeypatch.setattr(walls, "ONE_PIECE", at) or walls.dotted_walls(marks.unionByName(odd))
    held = rows(2048)
    assert "Generate" not in plan(held) and plan(held).count("Exchange hashpartitioning(sheet") == 3  # marks, what is on lines, walls
    want = sorted(held.collect())
    assert [({r["first"], r["last"]}, r["support"]) for r in want if r["sheet"] == 10**6] == [({"o4", "o12"}, 10)]  # o13 lies on o12
    monkeypatch.setattr(walls, "AT_ONCE", 1000)
    assert sorted(rows(2048).collect()) == want
    assert sorted(rows(150).collect()) == want and {n > 150 for n, in marks.groupBy("sheet").count().select("count").collect()} == {True, False}


def test_long_lists_are_numbered_in_parts(spark):
    from quantiva.operators import ordered
    from quantiva.plans import registry

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-40, 40)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "list string, at bigint, id bigint")
    got = ordered.numbered(df, "list", "at", ["id"], "k", size=7)
    want, n = {}, {}
    for name, at, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = n[name] = n.get(name, 0) + 1
    assert {r["id"]: r["k"] for r in got.collect()} == want and got.columns == ["list", "at", "id", "k"]
    assert ordered.numbered(df.limit(0), "list", "at", ["id"], "k").collect() == []
    # no task numbers all rows of a family: each window over placements is cut by parts too
    windows = [x for x in plan(registry.QUERIES["h11_flat_lists"](spark, SMALL)).splitlines() if "Window" in x and "row_number" in x]
    assert windows and all("__part" in x.split("specifiedwindowframe")[0] for x in windows)


def test_words_are_told_apart_once(spark):
    from quantiva.operators import room_names
    from quantiva.plans import room_queries

    words, sheets = room_queries.room_words(spark, SMALL), room_queries.plan_sheets(spark, SMALL)
    assert plan(room_names.candidates(words, sheets)).count("chambre") == 1


def test_names_of_a_batch_are_read_sheet_by_sheet(spark, monkeypatch):
    import inspect

    from quantiva.operators import room_names

    assert "to_pylist" not in inspect.getsource(room_names.room_names)


def test_rays_look_at_walls_in_pieces(spark, monkeypatch):
    from quantiva.operators import rays
    from quantiva.plans import registry

    rng = np.random.default_rng(4)
    probe, start, lo, first = (rng.integers(0, 60, n) for n in (90, 90, 40, 40))
    hi, last = lo + rng.integers(0, 20, 40), first + rng.integers(0, 20, 40)
    monkeypatch.setattr(rays, "AT_ONCE", 100)
    before, after = rays.nearest_walls(probe, start, lo, hi, first, last)
    for p, s, b, a in zip(probe, start, before, after):
        met = [(f, e) for u, v, f, e in zip(lo, hi, first, last) if u <= p <= v]
        assert b == min((s - min(e, s - 1) for f, e in met if f < s), default=rays._FAR)
        assert a == min((max(f, s + 1) - s for f, e in met if e > s), default=rays._FAR)
    # no row for a ray and a wall: rays and walls of a sheet meet as one row
    assert "band" not in plan(registry.QUERIES["h25_room_boxes"](spark, SMALL))


def test_boxes_are_compared_with_those_near_them_only(spark):
    from quantiva.operators import sheets

    rng = random.Random(6)
    for tenths, smaller in ((7, False), (4, True), (1, False), (10, True), (0, False)):
        x0, y0 = (np.array([rng.randrange(-40, 60) for _ in range(200)]) for _ in range(2))
        x1, y1 = x0 + np.array([rng.randrange(0, 25) for _ in x0]), y0 + np.array([rng.randrange(0, 25) for _ in x0])
        kept = []
        for i in range(200):
            for k in kept:
                shared = max(0, min(x1[i], x1[k]) - max(x0[i], x0[k])) * max(0, min(y1[i], y1[k]) - max(y0[i], y0[k]))
                a, b = ((x1[j] - x0[j]) * (y1[j] - y0[j]) for j in (i, k))
                if 10 * shared >= tenths * (min(a, b) if smaller else a + b - shared):
                    break
            else:
                kept.append(i)
        assert sheets.kept_boxes(x0, y0, x1, y1, np.arange(200), tenths, smaller).tolist() == kept
    side = np.arange(250) * 10
    x, y = (v.ravel() for v in np.meshgrid(side, side))
    began = time.time()
    assert len(sheets.kept_boxes(x, y, x + 10, y + 10, np.arange(len(x)), 7, False)) == len(x) == 62_500
    assert time.time() - began < 20  # each against all kept before it takes minutes


def test_plans_of_dimensions_are_shuffled_once(spark):
    from quantiva.plans import registry

    for name, most in (("g1_snapped_components", 1), ("g2_axis_solution", 1), ("g2_residuals", 1), ("g3_shortest_chain", 3)):
        found = plan(registry.QUERIES[name](spark, SMALL))
        assert found.count("Exchange hashpartitioning") <= most and "chains-" not in found  # no rounds are written


def test_chains_with_sums_that_are_not_known(spark):
    from quantiva.operators import axes

    edges = spark.createDataFrame([(1, 1, 0, 5, 4), (1, 2, 0, 5, None), (1, 3, 5, 9, 1), (1, 4, 2, 9, 7)], "plan bigint, id bigint, lo bigint, hi bigint, value bigint")
    asked = spark.createDataFrame([(1, 0, 9), (1, 2, 9), (1, 2, 5), (1, 3, 3), (2, 7, 8), (1, 0, 9)], "plan bigint, a bigint, b bigint")
    got = sorted(map(tuple, axes.shortest_chains(edges, asked).collect()))
    assert got == [(1, 0, 9, 2, None, [2, 3]), (1, 0, 9, 2, None, [2, 3]), (1, 2, 5, None, None, None), (1, 2, 9, 1, 7, [4]), (1, 3, 3, 0, 0, []), (2, 7, 8, None, None, None)]


def test_assignment_in_small_radii_first_is_one_by_one(spark, monkeypatch):
    from quantiva.operators import matching, spatial

    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, rng.choice([0, 1]), float(rng.randrange(30)), float(rng.randrange(30))) for i in range(700)]  # many at one place, many as near
    df = spark.createDataFrame(rows, "page string, id bigint, side int, x double, y double")
    for enough in (1e9, 0.5):
        monkeypatch.setattr(spatial, "ENOUGH", enough)
        got = matching.assign_near(df.filter("side = 0"), df.filter("side = 1"), "page", 6.0)
        pairs = sorted(((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2, a[1], b[1], a[0]) for a in rows for b in rows if a[0] == b[0] and (a[2], b[2]) == (0, 1))
        used, want = set(), []
        for d2, a, b, page in pairs:
            if d2 <= 36 and a not in used and b not in used:
                used |= {a, b}
                want.append((page, a, b, d2))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(spatial.radii(df.filter("side = 0"), df.filter("side = 1"), ["page"], 6.0)) > 2


def test_nearest_in_small_radii_first(spark, monkeypatch):
    from quantiva.operators import spatial

    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([0, 1]), rng.randrange(40), rng.randrange(40)) for i in range(500)]
    df = spark.createDataFrame(rows, "page string, id bigint, side int, x bigint, y bigint")
    left, right = df.filter("side = 0"), df.filter("side = 1")
    pairs = [(a, b) for a in rows for b in rows if a[0] == b[0] and (a[2], b[2]) == (0, 1)]
    near = [((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2, a[1], b[1]) for a, b in pairs]
    first, back = {}, {}
    for d2, a, b in near:
        if d2 <= 81:
            first[a], back[b] = min(first.get(a, (d2, b)), (d2, b)), min(back.get(b, (d2, a)), (d2, a))
    beside = {}
    for a, b in pairs:
        if abs(a[4] - b[4]) <= 3 and -2 <= b[3] - a[3] <= 30:
            beside[a[1]] = min(beside.get(a[1], (99, 0)), (b[3] - a[3], b[1]))
    for enough in (1e9, 0.5):
        monkeypatch.setattr(spatial, "ENOUGH", enough)
        got = spatial.mutual_nearest(left, right, ["page"], 9.0)
        assert {tuple(r) for r in got.select("id", "r_id").collect()} == {(a, b) for a, (_, b) in first.items() if back[b][1] == a}
        found = {r["id"]: (r["dx"], r["r_id"]) for r in spatial.first_beside(left, right, ["page"], 3, (-2, 30)).collect()}
        places = {}
        for _, i, side, x, y in (r for r in rows if r[2] == 0):
            places.setdefault((_, x, y), []).append(i)
        assert found == {min(p): beside[min(p)] for p in places.values() if min(p) in beside}


def test_fragments_fused_in_place_and_in_rounds_are_the_same(spark, monkeypatch):
    from quantiva.operators import regions

    rng = random.Random(5)
    at = lambda n: rng.randrange(n) if rng.random() > 0.03 else None
    rows = [(rng.choice([1, 2, 3, None]), rng.randrange(150), x, y, x and x + rng.randrange(30), y and y + 8) for _ in range(220) for x, y in [(at(700), at(500))]]
    df = spark.createDataFrame(rows, "sheet bigint, id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    want = sorted(map(repr, regions._fused_in_rounds(df, 4, 256).collect()))
    for size in (2048, 50, 0):
        monkeypatch.setattr(regions, "ONE_PIECE", size)
        assert sorted(map(repr, regions.fuse(df).collect())) == want
    assert len({r["g"] for r in regions.fuse(df).collect()}) > 3
    monkeypatch.setattr(regions, "ONE_PIECE", 2048)
    monkeypatch.setattr(regions, "_fused_in_rounds", None)  # small sheets don't need it
    assert regions.fused(df.filter("sheet is not null").withColumns({"text": F.lit("a"), "confidence": F.lit(1.0)})).count() > 3
