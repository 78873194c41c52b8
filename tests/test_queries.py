"""Each registered query against its DuckDB SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from quantiva.plans import axis_queries, document_queries, geometry_queries, label_queries, matching_queries, more_queries, ordered_queries, page_queries, quantity_queries, registry, relational_queries, room_queries, scalar_queries, sheet_queries, whole_queries  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SMALL}/{t}'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, (float, Decimal)) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    found = duck.sql(registry.SQL[name])
    at = [found.columns.index(c) for c in cols]
    assert len(found.columns) == len(cols)
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert got == want


def one_by_one(lengths, bar=12_000, least=50):
    """First fit of single pieces, longest first."""
    cut = []
    for n in lengths:
        while n > bar:
            cut.append(bar)
            n -= bar
        if n > least:
            cut.append(n)
    free = []
    for n in sorted(cut, reverse=True):
        for i, room in enumerate(free):
            if room >= n:
                free[i] -= n
                break
        else:
            free.append(bar - n)
    return len(free), sum(cut)


def greedy_bars(lengths, bar=12_000):
    left, used = sorted((x for x in lengths if x <= bar + 1), reverse=True), 0
    useful = sum(left)
    while left:
        room, rest = bar, []
        for x in left:
            if x <= room + 1:
                room -= x
            else:
                rest.append(x)
        left, used = rest, used + 1
    return used, useful


def test_packing_by_counts_is_packing_one_by_one():
    import random
    from collections import Counter

    from quantiva.operators.packing import bar_by_bar, first_fit_decreasing

    assert first_fit_decreasing([(5000, 4), (7000, 2)]) == (3, 34_000)
    assert first_fit_decreasing([(25_000, 1)]) == (3, 25_000) and first_fit_decreasing([(40, 1)]) == (0, 0) == first_fit_decreasing([])
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.choice([rng.randrange(1, 30_000), rng.randrange(40, 60), 6000, 4000, 3001]) for _ in range(rng.randrange(60))]
        runs = list(Counter(lengths).items())
        assert first_fit_decreasing(runs) == one_by_one(lengths)
        assert bar_by_bar(runs) == greedy_bars(lengths)


def test_packing_queries(spark):
    for name in ("m1_ffd", "m2_bar_by_bar"):
        rows = registry.QUERIES[name](spark, SMALL)
        assert rows.filter("useful_mm + waste_mm <> bars * 12000 or waste_mm < 0").isEmpty() and rows.count() == 11


def test_greedy_assignment(spark):
    """Each page's pairs taken as by looking at them in order of distance."""
    from quantiva.plans.matching_queries import _beside

    pairs = sorted((r["page"], r["d2"], r["id"], r["r_id"]) for r in _beside(spark, SMALL).collect())
    left, right, want = set(), set(), []
    for page, d2, a, b in pairs:
        if (page, a) not in left and (page, b) not in right:
            left.add((page, a))
            right.add((page, b))
            want.append((a, b))
    got = registry.QUERIES["j12_greedy_assign"](spark, SMALL)
    assert sorted((r["id"], r["r_id"]) for r in got.collect()) == sorted(want) and want
    merged = registry.QUERIES["j13_merge_elements"](spark, SMALL)
    assert merged.filter("origin = 'drawing' and text_id is not null").count() == len(want)


def test_sheet_kernels(spark):
    import numpy as np

    from quantiva.operators import sheets

    a, b, v = np.array([1, 2, 1, 7]), np.array([2, 3, 3, 8]), np.array([4.0, 5.0, 9.3, 2.0])
    at = sheets.solve(a, b, v)
    assert sheets.component_of(a, b) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert at[1] == at[7] == 0 and at[8] == pytest.approx(2) and at[2] == pytest.approx(4.1) and at[3] == pytest.approx(9.2)
    rows = registry.QUERIES["g2_axis_positions"](spark, SMALL)
    assert rows.filter("node = component and position <> 0").isEmpty() and rows.count() > 0
    from quantiva.plans.sheet_queries import _marks

    for name, tenths, smaller in (("g22_suppress_boxes", 7, False), ("u4_merge_readings", 4, True)):
        kept = {}
        for r in sorted(_marks(spark, SMALL).collect(), key=lambda r: r["rank"]):
            own = kept.setdefault(r["sheet"], [])
            area = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
            clash = False
            for k in own:
                shared = max(0, min(r["x1"], k["x1"]) - max(r["x0"], k["x0"])) * max(0, min(r["y1"], k["y1"]) - max(r["y0"], k["y0"]))
                clash |= 10 * shared >= tenths * (area if smaller else 2 * area - shared)
            if not clash:
                own.append(r)
        got = registry.QUERIES[name](spark, SMALL).collect()
        assert {(r["sheet"], r["id"]) for r in got} == {(s, r["id"]) for s, own in kept.items() for r in own} and len(got) < 1000
