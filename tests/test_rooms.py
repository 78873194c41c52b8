"""Walls, rooms and regions against doing it one by one."""

import heapq
import math
import random
import re

import numpy as np
import pytest

from quantiva.operators import geodesic, regions, room_names, walls
from quantiva.plans import registry, room_queries

SMALL = "/root/testdata/sf0.001"


def plain_line(points, t):
    """Random pairs one by one, then a fit within 2.5 sigma."""
    n, rng, best = len(points), np.random.default_rng(42), (0, math.inf, None)
    for _ in range(250):
        i, j = rng.choice(n, size=2, replace=False)
        step = points[j] - points[i]
        if np.hypot(*step) < 1e-6:
            continue
        u = step / np.hypot(*step)
        off = [abs((p[1] - points[i][1]) * u[0] - (p[0] - points[i][0]) * u[1]) for p in points]
        near = [k for k in range(n) if off[k] <= max(1.5, 1.25 * t)]
        total = round(sum(off[k] for k in near), 9)
        if (-len(near), total) < (-best[0], best[1]):
            best = len(near), total, near
    if best[0] < 4:
        return None

    def fit(on):
        c = points[on].mean(axis=0)
        cov = np.cov((points[on] - c).T)
        u = np.linalg.eigh(cov)[1][:, 1]
        return c, u

    c, u = fit(best[2])
    off = [(p[1] - c[1]) * u[0] - (p[0] - c[0]) * u[1] for p in points]
    own = [off[k] for k in best[2]]
    tau = min(max(1.0, 2.5 * 1.4826 * np.median(np.abs(own - np.median(own)))), 2 * t)
    on = [k for k in range(n) if abs(off[k]) <= tau]
    on = on if len(on) >= 4 else best[2]
    return *fit(on), on


def plain_walls(marks):
    """One sheet: votes in a dictionary, then each proposal by itself."""
    t, votes = 2.0, {}
    for m in marks:
        for d in [d for d in range(180) if min(d % 90, 90 - d % 90) <= 6]:
            a = math.radians(d)
            rho = m["x"] * math.cos(a) + m["y"] * math.sin(a)
            votes.setdefault((d, math.floor(rho / 4)), []).append((m["id"], rho, m["y"] * math.cos(a) - m["x"] * math.sin(a)))
    best = {}
    for (d, c), v in votes.items():
        for i, rho, along in v:
            if len(v) >= 4:
                best[i] = max(best.get(i, (0,)), (len(v), -d, -c, rho, along))
    lines = {}
    for n, d, c, rho, along in best.values():
        lines.setdefault((-d, -c), []).append((rho, along))
    out = {}
    for (d, c), own in sorted(lines.items()):
        if len(own) < 4:
            continue
        a, rho = math.radians(d), round(sum(r for r, _ in own) / len(own), 6)
        lo, hi = min(s for _, s in own) - 8, max(s for _, s in own) + 8
        band = sorted((m for m in marks if abs(m["x"] * math.cos(a) + m["y"] * math.sin(a) - rho) <= 5 and lo <= m["y"] * math.cos(a) - m["x"] * math.sin(a) <= hi), key=lambda m: m["id"])
        points = np.array([[m["x"], m["y"]] for m in band])
        got = plain_line(points, t)
        if got is None:
            continue
        centre, u, on = got
        want = np.array([-math.sin(a), math.cos(a)])
        u = u if u @ want >= 0 else -u
        if math.degrees(math.acos(min(1, u @ want))) > 12:
            continue
        placed = sorted((float((points[k] - centre) @ u), band[k]["id"], max(1.0, abs(u[0]) * 2 + abs(u[1]) * 3)) for k in on)
        steps = [(b[0] - a[0], max(0, b[0] - a[0] - (a[2] + b[2]) / 2)) for a, b in zip(placed, placed[1:])]
        motif = [(p, g) for p, g in steps if 0.5 < g <= 50]
        if not motif:
            continue
        limit = max(3 * np.median([g for _, g in motif]) + 4, 2.2 * np.median([p for p, _ in motif]))
        runs = [[placed[0]]]
        for x, (_, g) in zip(placed[1:], steps):
            runs = [*runs, [x]] if g > limit else [*runs[:-1], [*runs[-1], x]]
        for r in runs:
            if len(r) < 4:
                continue
            pitch = np.diff([x[0] for x in r])
            spread = (np.quantile(pitch, 0.75) - np.quantile(pitch, 0.25)) / max(1, np.median(pitch))
            length = r[-1][0] + r[-1][2] / 2 - r[0][0] + r[0][2] / 2
            turn = math.degrees(math.atan2(abs(u[1]), abs(u[0])))
            if spread <= 0.65 and length >= max(40, 3 * np.median(pitch)) and min(turn, 90 - turn) <= 6:
                out.setdefault((r[0][1], r[-1][1], len(r)), (length, np.median(pitch), spread, centre + (r[0][0] - r[0][2] / 2) * u))
    return out


def test_dotted_walls_are_those_of_plain_numpy(spark):
    marks = room_queries.dotted_marks(spark, SMALL)
    by, want = {}, {}
    for m in marks.collect():
        by.setdefault(m["sheet"], []).append(m)
    for s, own in by.items():
        want.update({(s, *k): v for k, v in (plain_walls(own) if len(own) >= 6 else {}).items()})
    got = registry.QUERIES["g16_dotted_walls"](spark, SMALL).collect()
    assert {(r["sheet"], r["first"], r["last"], r["support"]) for r in got} == set(want) and len(got) == len(want) > 1000
    for r in got:
        length, pitch, spread, start = want[r["sheet"], r["first"], r["last"], r["support"]]
        assert (r["length"], r["pitch"], r["dispersion"]) == pytest.approx((length, pitch, spread), abs=2e-3)
        assert (r["x1"], r["y1"]) == pytest.approx(tuple(start), abs=2e-3)


def test_dotted_walls_of_hand_made_sheets(spark):
    dots = [(1, i, 10.0 + 7 * i + 60 * (i > 9), 50.0 + 0.2 * (i % 2)) for i in range(20)]  # a door after the tenth
    dots += [(2, i, float(i * 97 % 211), float(i * 61 % 173)) for i in range(12)] + [(3, 0, 1.0, 1.0), (4, 0, None, 1.0)]
    dots += [(5, i, 20.0 + 4 * i, 20.0 + 4 * i) for i in range(30)]  # oblique
    df = spark.createDataFrame([(*d, 2.0, 2.0, 2.0) for d in dots], "sheet bigint, id bigint, x double, y double, w double, h double, t double")
    got = walls.dotted_walls(df).collect()
    assert sorted((r["sheet"], *sorted((r["first"], r["last"])), r["support"], r["confidence"]) for r in got) == [(1, 0, 9, 10, "high"), (1, 10, 19, 10, "high")]
    assert {(r["sheet"], r["support"]) for r in walls.dotted_walls(df, None).collect()} >= {(1, 10), (5, 30)}
    assert walls.dotted_walls(df.limit(0)).collect() == []


def walked(width, height, walls, seeds):
    """Dijkstra from all seeds at once, cell by cell: the best (distance, number) of each free cell."""
    shut = {(x, y) for x0, y0, x1, y1 in walls for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)}
    heap = [(0, k, x, y) for k, x, y in seeds if (x, y) not in shut]
    heapq.heapify(heap)
    best = {}
    while heap:
        d, k, x, y = heapq.heappop(heap)
        if (x, y) in best:
            continue
        best[x, y] = d, k
        for dx, dy in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            to = x + dx, y + dy
            if 0 <= to[0] < width and 0 <= to[1] < height and to not in shut and to not in best:
                heapq.heappush(heap, (d + (1_414_214 if dx and dy else 1_000_000), k, *to))
    return best, width * height - len({(x, y) for x, y in shut if 0 <= x < width and 0 <= y < height})


def by_label(sheets, walls, seeds):
    out = {}
    for s, width, height in sheets:
        own = sorted((y, x, n) for t, n, x, y in seeds if t == s and 0 <= x < width and 0 <= y < height)
        best, free = walked(width, height, [w[1:] for w in walls if w[0] == s], [(k, x, y) for k, (y, x, _) in enumerate(own, 1)])
        for d, k in best.values():
            cells, far, total = out.get((s, own[k - 1][2]), (0, 0, 0))
            out[s, own[k - 1][2]] = cells + 1, max(far, d), total + d
        if free > len(best):
            out[s, None] = free - len(best), 0, 0
    return out


def test_geodesic_shares_are_dijkstra(spark):
    got = registry.QUERIES["g14_geodesic_shares"](spark, SMALL).collect()
    want = by_label(*([tuple(r) for r in d.collect()] for d in room_queries.floor(spark, SMALL)))
    assert {(r["sheet"], r["label"]): (r["cells"], r["farthest"], r["walked"]) for r in got} == want and len(got) == len(want) > 100


def test_geodesic_spans_tiles(spark):
    """A corridor that winds through many tiles, a closed room, seeds on walls, in one cell and off the plan."""
    wide, high = 150, 70
    walls = [(1, x, 0 if k % 2 else 1, x, high - 2 if k % 2 else high) for k, x in enumerate(range(5, wide, 6))] + [(3, 4, 4, 8, 4), (3, 4, 8, 8, 8), (3, 4, 4, 4, 8), (3, 8, 4, 8, 8), (3, -5, 9, 2, 9)]
    seeds = [(1, 7, 0, 0), (3, 1, 4, 4), (3, 2, 0, 0), (3, 3, 0, 0), (3, 4, 40, 0), (3, 5, 0, 20)]
    sheets = [(1, wide, high), (2, 33, 1), (3, 12, 12)]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = frame(sheets, "sheet bigint, width int, height int"), frame(walls, "sheet bigint, x0 int, y0 int, x1 int, y1 int"), frame(seeds, "sheet bigint, label int, x int, y int")
    got = geodesic.shares(*geodesic.partition(*tables)).collect()
    assert {(r["sheet"], r["label"]): (r["cells"], r["farthest"], r["walked"]) for r in got} == by_label(sheets, walls, seeds)
    assert geodesic.shares(*geodesic.partition(*(t.limit(0) for t in tables))).collect() == []


def fused_one_by_one(boxes, distance=4):
    """Groups of ids: any two groups whose boxes are near are put together, until none are."""
    groups = [([i], list(b)) for i, *b in boxes]
    at = 0
    while at < len(groups):
        ids, a = groups[at]
        for k, (more, b) in enumerate(groups):
            if k != at and a[0] <= b[2] + distance and b[0] <= a[2] + distance and a[1] <= b[3] + distance and b[1] <= a[3] + distance:
                groups = [g for j, g in enumerate(groups) if j not in (at, k)] + [(ids + more, [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])]
                at = -1
                break
        at += 1
    return sorted((min(i), sorted(i), b) for i, b in groups)


def test_fragments_fuse_to_a_fixpoint(spark):
    rng = random.Random(4)
    rows = []
    for s in range(30):
        for i in rng.sample(range(1000), 60 if s else 0):
            x, y = rng.randrange(-50, 400), rng.randrange(300)
            rows.append((s, i, f"t{i}" if i % 5 else None, x, y, x + rng.randrange(25), y + rng.randrange(9), float(i % 7)))
    rows += [(90, k, str(k), 9 * k, 0, 9 * k + 5, 5, 1.0) for k in range(40)] + [(91, 5, "alone", None, None, None, None, 0.5)]  # a chain at the very distance
    df = spark.createDataFrame(rows, "sheet bigint, id bigint, text string, x0 bigint, y0 bigint, x1 bigint, y1 bigint, confidence double")
    got = {(r["sheet"], r["g"]): r for r in regions.fused(df).collect()}
    n = 0
    for s in {r[0] for r in rows} - {91}:
        own = {r[1]: r for r in rows if r[0] == s}
        for g, ids, box in fused_one_by_one([(r[1], *r[3:7]) for r in own.values()]):
            r, n = got[s, g], n + 1
            assert [r[c] for c in ("x0", "y0", "x1", "y1")] == box and r["fragments"] == len(ids) and r["confidence"] == min(own[i][7] for i in ids)
            assert r["text"] == " ".join(own[i][2] for i in ids if own[i][2])
    assert len(got) == n + 1 and got[90, 0]["fragments"] == 40 and got[91, 5]["x0"] is None
    assert regions.fuse(df.limit(0)).collect() == []


def test_fused_fragments_of_the_tables(spark):
    rows = room_queries.fragments(spark, SMALL).collect()
    want = {}
    for s in {r["sheet"] for r in rows}:
        want.update({(s, g): (len(ids), *box) for g, ids, box in fused_one_by_one([(r["id"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows if r["sheet"] == s])})
    got = registry.QUERIES["g21_fused_fragments"](spark, SMALL).collect()
    assert {(r["sheet"], r["g"]): (r["fragments"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in got} == want


def test_regions_of_sheets(spark):
    a = lambda i, kind, x, y: (1, i, kind, f"t{i}", x, y, x + 60, y + 12)
    rows = [a(1, "plan", 100, 100), a(2, "detail", 130, 130), a(3, "tableau", 300, 200), a(4, "detail", 1500, 1500), (2, 1, "plan", None, 10, 10, 20, 20)]
    anchors = spark.createDataFrame(rows, "sheet bigint, id bigint, kind string, label string, x0 bigint, y0 bigint, x1 bigint, y1 bigint")
    sheets = spark.createDataFrame([(1, 2000, 1684), (2, 500, 400), (3, 1000, 800)], "sheet bigint, width int, height int")
    got = {(r["sheet"], r["part"]): tuple(r)[2:] for r in regions.regions(sheets, anchors).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 1001), (2, 0), (3, 0), (3, 1), (3, 2), (3, 3)}
    # the second is too near the first; the third's box shares over 30 % with the first's
    assert got[1, 0] == ("tableau", "t1", 0.0, 0.0, 660.0, pytest.approx(212 + 336.8)) and got[1, 1][0] == "detail"
    assert got[1, 1001][2:] == (0.0, pytest.approx(548.8), 2000.0, pytest.approx(1500 - 101.04)) and got[3, 1] == ("tableau", "quadrant HD", 500.0, 0.0, 1000.0, 400.0)
    rows = registry.QUERIES["g19_sheet_regions"](spark, SMALL)
    held = {(r["sheet"], r["part"]): r for r in rows.collect()}
    with_titles = {r["sheet"] for r in room_queries.region_anchors(spark, SMALL).select("sheet").distinct().collect()}
    assert len(held) == rows.count() and {s for s, k in held if k == 3 and (s, 3) in held and held[s, 3]["label"] == "quadrant BD"}.isdisjoint(with_titles)
    assert {s for s, _ in held} == {r["o_orderkey"] for r in spark.read.parquet(f"{SMALL}/orders.parquet").select("o_orderkey").collect()}


def named_one_by_one(words):
    """Plain boxes in a list: lines under the first name that fits, then numbers to the nearest; words by id."""
    merged = []
    for w in sorted((w for w in words if w["kind"] != "number"), key=lambda w: (w["y"] + w["h"] / 2, w["x"] + w["w"] / 2)):
        for m in merged:
            x, y, r, b = m["box"]
            gap = w["y"] - b
            if abs((x + r) / 2 - w["x"] - w["w"] / 2) < 0.6 * max(r - x, w["w"]) and -0.6 * min(w["h"], b - y) <= gap <= 1.2 * max(w["h"], b - y):
                m["text"] += " " + w["text"]
                m["box"] = [min(x, w["x"]), min(y, w["y"]), max(r, w["x"] + w["w"]), max(b, w["y"] + w["h"])]
                m["conf"], m["known"], m["n"] = min(m["conf"], w["conf"]), m["known"] or w["kind"] == "known", m["n"] + 1
                break
        else:
            merged.append({"text": w["text"], "box": [w["x"], w["y"], w["x"] + w["w"], w["y"] + w["h"]], "conf": w["conf"], "known": w["kind"] == "known", "n": 1})
    merged.sort(key=lambda m: m["box"][3])
    for w in (w for w in words if w["kind"] == "number"):
        cx, cy, best = w["x"] + w["w"] / 2, w["y"] + w["h"] / 2, None
        for m in merged:
            x, y, r, b = m["box"]
            under = -0.6 * min(w["h"], b - y) <= w["y"] - b <= 1.2 * (b - y) and abs((x + r) / 2 - cx) < 0.8 * max(r - x, w["w"])
            if under or (abs((y + b) / 2 - cy) < 0.5 * (b - y) and 0 <= w["x"] - r <= 1.2 * (b - y)):
                far = abs(cy - (y + b) / 2) + abs(cx - (x + r) / 2)
                best = (far, m) if best is None or far < best[0] else best
        if best:
            m = best[1]
            x, y, r, b = m["box"]
            m["text"] += " " + w["text"]
            m["box"], m["conf"], m["n"] = [min(x, w["x"]), min(y, w["y"]), max(r, w["x"] + w["w"]), max(b, w["y"] + w["h"])], min(m["conf"], w["conf"]), m["n"] + 1
    return [(k, re.sub(r"\s*\d{3,}$", "", m["text"]).strip() or m["text"], *m["box"], m["conf"], m["known"], m["n"]) for k, m in enumerate(merged)]


def test_room_names_are_folded_one_by_one(spark):
    by = {}
    for r in sorted(room_names.candidates(room_queries.room_words(spark, SMALL), room_queries.plan_sheets(spark, SMALL)).collect(), key=lambda r: r["id"]):
        by.setdefault(r["sheet"], []).append(r)
    want = {(s, *row) for s, own in by.items() for row in named_one_by_one(own)}
    got = registry.QUERIES["g23_room_names"](spark, SMALL).collect()
    assert {(r["sheet"], r["k"], r["text"], r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"], r["conf"], r["known"], r["words"]) for r in got} == want and any(r["words"] > 2 for r in got)


def test_room_names_of_a_sheet(spark):
    rows = [(1, 1, "MASTER", 100.0, 100.0, 60.0, 10.0), (1, 2, "BATH", 105.0, 109.0, 40.0, 10.0), (1, 3, "2", 160.0, 104.0, 8.0, 10.0), (1, 4, "WALK-IN", 300.0, 300.0, 60.0, 10.0), (1, 5, "CLOSET 111", 300.0, 312.0, 60.0, 10.0), (1, 6, "7", 900.0, 900.0, 8.0, 10.0), (1, 7, None, 1.0, 1.0, 1.0, 1.0), (2, 1, "SALON", -500.0, 0.0, 10.0, 10.0)]
    words = spark.createDataFrame(rows, "sheet int, id int, text string, x double, y double, w double, h double").selectExpr("*", "cast(null as double) conf")
    sheets = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0), (2, 0.0, 0.0, 100.0, 100.0)], "sheet int, bx double, by double, bw double, bh double")
    got = {r["text"]: r for r in room_names.room_names(words, sheets).collect()}
    assert set(got) == {"MASTER BATH 2", "WALK-IN CLOSET"} and got["MASTER BATH 2"]["w"] == 68.0 and got["MASTER BATH 2"]["conf"] == 0.8
    assert [r["sheet"] for r in room_names.room_names(words, sheets.filter("sheet = 1")).filter("text = 'SALON'").collect()] == [2]  # without an envelope: anywhere


def test_overlaps_are_those_of_the_join_and_rooms_are_read_once(spark):
    import random

    from quantiva.operators import boxes, surfaces

    rng = random.Random(12)
    rows = [(rng.choice([1, 2, None]), i, x, y, x + rng.randrange(40), y + rng.randrange(40)) for i in range(150) for x, y in [(rng.randrange(-60, 90), rng.randrange(90))]]
    df = spark.createDataFrame(rows, "sheet int, id int, x0 int, y0 int, x1 int, y1 int")
    pairs = lambda d: sorted(map(tuple, d.filter("id <> r_id").select("sheet", "id", "r_id", "shared").collect()))
    assert pairs(boxes.overlaps(df, ["sheet"], 16)) == pairs(boxes.overlap_join(df, df, ["sheet"], 16)) != []
    # names, boxes and zones read one written table, not what the rooms are made of
    rooms = spark.createDataFrame([(1, 1, "a", None, None, 0, 0, 20, 20), (1, 2, "b", None, None, 15, 0, 40, 20)], "sheet int, room int, name string, region int, explicit double, x0 int, y0 int, x1 int, y1 int")
    found = surfaces.room_surfaces(rooms, spark.createDataFrame([], "sheet int, region int, area_px double"), spark.createDataFrame([(1, 2.0)], "sheet int, scale double"))
    assert "LocalTableScan" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Scan ExistingRDD" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 1, "a", "box", 75.0, 25.0), (1, 2, "b", "box", 125.0, 0.0)]
