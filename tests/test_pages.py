"""Words of hand-made pages to placements and tables."""

from quantiva.operators import placing


def words(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc int, page int, id int, text string, x double, y double").selectExpr("*", "x + 8 x1", "y + 8 y1", "10.0 eps")


def test_axes_are_runs(spark):
    rows = [(1, 1, "A", 100.0, 50.0), (1, 2, "B", 200.0, 52.0), (1, 3, "D", 300.0, 50.0), (1, 4, "C", 250.0, 120.0), (1, 5, "Z", 10.0, 50.0), (1, 6, "B", 205.0, 300.0), (1, 7, "01", 505.0, 10.0), (1, 8, "2", 510.0, 90.0), (1, 9, "21", 500.0, 99.0), (1, 10, "3", 300.0, 90.0)]
    rows += [(2, 1, "T", 5.0, 5.0), (2, 2, "7", 900.0, 400.0), (3, 1, "5", 500.0, 1.0), (3, 2, "9", 500.0, 2.0)]
    got = sorted(tuple(r)[1:] for r in placing.axes(words(spark, rows)).collect())
    assert got == sorted([(1, "letter", "A", 100.0), (1, "letter", "B", 200.0), (1, "number", "01", 10.0), (1, "number", "2", 90.0), (2, "letter", "T", 5.0), (2, "number", "7", 400.0)])


def test_placements_of_a_page(spark):
    rows = [(1, 1, "A", 100.0, 50.0), (1, 2, "B", 200.0, 50.0), (1, 3, "1", 500.0, 300.0), (1, 4, "2", 500.0, 400.0), (1, 5, "S1(90x90x25)", 149.0, 349.0), (1, 6, "( s1 , 0q )", 150.0, 350.0), (1, 7, "(S1,O2)", 190.0, 390.0), (1, 8, "s1", 90.0, 310.0), (1, 9, "M3", 95.0, 305.0), (1, 10, "Massifs", 1.0, 1.0)]
    rows += [(1, 11, "P9", 600.0, 600.0), (1, 12, "N1bis-(25X40)", 101.0, 301.0), (1, 13, "S1(90x90)", 1.0, 9.0), (1, 14, "P", 1.0, 9.0), (1, 15, "LG", 1.0, 399.0), (2, 1, "M3", 5.0, 5.0), (2, 2, None, 1.0, 1.0)]
    zones = spark.createDataFrame([(1, 1, 590.0, 590.0, 650.0, 650.0)], "doc int, page int, zx0 double, zy0 double, zx1 double, zy1 double")
    got = {(r["page"], r["id"], r["k"]): r for r in placing.placements(words(spark, rows), zones).collect()}
    assert {(k[1], r["ref"], r["number_in_doc"], r["letter"], r["number"]) for k, r in got.items() if k[0] == 1} == {
        (5, "S1", 1, "A", "1"), (8, "S1", 2, "A", "1"), (7, "S1", 3, "B", "2"), (7, "Q2", 1, "B", "2"), (9, "M3", 1, "A", "1"), (12, "N1BIS", 1, "A", "1"), (15, "LG", 1, "A", "2"),
    }
    assert got[1, 9, 0]["family"] == "massifs" and got[2, 1, 0]["family"] == "murs" and got[2, 1, 0]["letter"] is None and got[2, 1, 0]["number_in_doc"] == 2
    assert got[1, 5, 0]["sides"] == "90x90x25" and got[1, 12, 0]["family"] == "poutres"


def test_tables_of_a_page(spark):
    rows = [(1, 1, "S4", 100.0, 100.0), (1, 2, "s3", 150.0, 104.0), (1, 3, "S2", 200.0, 112.0), (1, 4, "90x100", 108.0, 130.0), (1, 5, "80x80", 101.0, 140.0), (1, 6, "H", 400.0, 240.0), (1, 7, "9", 152.0, 241.0), (1, 8, "120x80", 175.0, 140.0)]
    rows += [(2, 1, "S1", 100.0, 100.0), (2, 2, "90x90", 100.0, 130.0), (3, 1, "S1", 100.0, 100.0), (3, 2, "S2", 200.0, 100.0)]
    got = {(r["page"], r["ref"]): tuple(r)[3:] for r in placing.borderless_tables(words(spark, rows)).collect()}
    # S2 is off the header's line, 120x80 between two columns, one reference makes no header, columns without cells give no row
    assert got == {(1, "S4"): (0.9, 1.0, None, None, None), (1, "S3"): (None, None, 9.0, None, None)}
    assert placing.borderless_tables(words(spark, rows).limit(0)).collect() == []


def test_words_stand_once_in_the_cells(spark):
    # a word is one row of a cell join, a label at most four; numbers beyond an int are read as none
    from quantiva.operators import detail_pages

    w = words(spark, [(1, i, "w", 37.0 * i, -53.0 * i) for i in range(200)])
    assert detail_pages._placed(w, 960).count() == 200
    assert detail_pages._reaching(w, 960, (-240, 240, -240, 240)).groupBy("id").count().filter("count > 4").count() == 0


def test_columns_of_a_page(spark):
    from quantiva.operators import detail_pages

    rows = [(1, 1, "P7", 0.0, 0.0), (1, 2, "(30x40)", 144.0, 79.0), (1, 3, "Cad. T99999999999", 3.0, 10.0), (1, 4, "Cad T8", 4.0, 12.0), (1, 5, "e=15", 5.0, 14.0), (1, 6, "4HA12+2t10", -5.0, -14.0), (1, 7, "P8", 5000.0, 0.0), (1, 8, "(20x20)", 5145.0, 0.0)]
    got = [tuple(r)[2:] for r in detail_pages.column_pages(words(spark, rows)).collect()]
    assert got == [("P7", 0.3, 0.4, "label", "4T12+2T10", 8, 0.15)]


def test_beams_of_a_page(spark):
    from quantiva.operators import detail_pages

    rows = [(1, 1, "N1", 0.0, 0.0), (1, 2, "(30x50)", 0.0, -20.0), (1, 3, "4HA12", 0.0, 240.0), (1, 4, "Cad T99999999999", 0.0, 99.0), (1, 5, "Cad T6", 0.0, 100.0), (1, 6, "e=(12x9)", 50.0, 130.0), (1, 7, "chap 3T8", 0.0, 60.0), (1, 8, "2T10", 0.0, 241.0)]
    got = [tuple(r)[2:] for r in detail_pages.beam_pages(words(spark, rows)).collect()]
    assert got == [("N1", 0.3, 0.5, "heuristic", "4T12", "3T8", 6, 0.12)]


def test_beams_of_random_pages_are_those_one_by_one(spark):
    """Words are told apart and shuffled once, no two tables of them are joined; the rules are those of all pairs."""
    import random

    from quantiva.operators import detail_pages

    rng, rows, want = random.Random(11), [], {}
    for page in range(25):
        labels, notes, boats, steps = [], [], [], []
        for i in range(rng.choice([3, 40, 90])):
            x, y = (None if rng.random() < 0.03 else float(rng.randrange(-900, top)) for top in (600, -300))
            a, b = rng.randrange(6, 60), rng.randrange(1, 9)
            kind, text, *said = rng.choice([("label", f"n{b}", [f"N{b}"], None), ("label", f"bn{b}/LG{a}", [f"BN{b}", f"LG{a}"], None), ("label", f"N{b}-({a}x40)", [f"N{b}"], (a, 40)), ("section", f"({a + 10}x50)", a + 10, 50), ("bars", f"{b}ha{a}", b, a), ("top", f"CHAP. {b}T{a}", b, a), ("ring", f"Cad T{a}", a, None), ("boat", "Bateau"), ("step", f"esp = {a},5", (a + 0.5) / 100), ("step", f"e=({a}x9)", a / 100), ("none", rng.choice([None, "x", "e=", "9"]))])
            rows.append((7, page, i, text, x, y))
            if kind == "label":
                labels += [(i, k, ref, x, y, said[1]) for k, ref in enumerate(said[0])]
            elif None not in (x, y):
                {"boat": boats, "step": steps}.get(kind, notes).append((i, kind, x, y, *said))
        placed = [v for v in labels if None not in v[3:5]]
        near, ring, bars = {}, {}, {}
        for i, kind, x, y, *nm in (v for v in notes if v[1] != "none"):
            wet = any(-20 < y - v[3] < 60 and -60 < x - v[2] < 320 for v in boats)
            d = {v[:3]: (x - v[3]) ** 2 + (y - v[4]) ** 2 for v in placed}
            if kind == "section":
                for v in placed:
                    if y < v[4] and abs(x - v[3]) < 160 and v[4] - y < 80:
                        near.setdefault(v[2], []).append((*v[:2], d[v[:3]], i, *nm))
            elif not wet and kind == "ring":
                for v, far in d.items():
                    if far <= 240**2:
                        ring.setdefault(v[2], []).append((*v[:2], far, i, nm[0], x, y))
            elif not wet and d and min(d.values()) <= 240**2:
                far, v = min((far, v) for v, far in d.items())
                bars.setdefault(v[2], []).append((i, f"{nm[0]}T{nm[1]}", y if kind == "bars" else None))
        for ref in {v[2] for v in labels}:
            own = sorted((v for v in labels if v[2] == ref), key=lambda v: v[:2])
            stated = next((v[5] for v in own if v[5]), None)
            b, h = stated or (min(near[ref])[4:] if ref in near else (None, None))
            metres = lambda v: None if v is None else round(v / 100, 4) if v > 10 else float(v)
            lower = lambda v: v[2] is not None and own[0][4] is not None and v[2] > own[0][4]  # noqa: B023, E731
            text = lambda keep: "+".join(dict.fromkeys(v[1] for v in sorted(bars.get(ref, [])) if lower(v) == keep))  # noqa: B023, E731
            phi = spacing = None
            if ref in ring:
                *_, phi, x, y = min(ring[ref])
                spacing = min(((v[0], round(v[4], 6)) for v in steps if abs(v[2] - x) < 100 and abs(v[3] - y) < 60), default=(0, 0.0))[1]
            want[page, ref] = (metres(b), metres(h), "label" if stated else "heuristic" if ref in near else None, text(True), text(False), phi, spacing)
    df = spark.createDataFrame(rows, "doc int, page int, id int, text string, x double, y double")
    pages = detail_pages.beam_pages(df)
    got = {(r["page"], r["ref"]): tuple(r)[3:] for r in pages.collect()}
    assert got == want and len(want) > 150 and pages.count() == len(want) and sum(v[6] not in (None, 0) for v in want.values()) > 3
    plan = pages._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[2] or pages._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    nowhere = [tuple(r)[2:] for r in detail_pages.beam_pages(spark.createDataFrame([(None, 1, "N1", 0.0, 0.0), (None, 2, "4HA12", 0.0, 9.0)], "page int, id int, text string, x double, y double").selectExpr("1 doc", "*")).collect()]
    assert nowhere == [("N1", None, None, None, "", "", None, None)]  # words of no page are not near each other


def test_labels_are_those_of_the_plain_rules(spark):
    # one pattern tells labels apart, as the pattern of all prefixes and the rules of each did one after the other
    import itertools
    import re

    names = sorted([*placing.SIDES, *placing.BARE], key=lambda p: (-len(p), p))
    plain = re.compile("(" + "|".join(names) + r")([0-9]*)(BIS)?[\s-]*(?:\(?([0-9]+(?:X[0-9]+){1,2})\)?)?", re.IGNORECASE | re.ASCII)

    def label(text):
        m = plain.fullmatch(text.replace(" ", "").upper())
        if not m:
            return None
        prefix, number, again, sides = m[1], m[2], m[3] or "", [int(v) for v in m[4].split("X")] if m[4] else None
        fits = (number or prefix in ("LG", "CH", "BN")) and (not again or prefix in ("N", "BN")) and (sides is None or len(sides) == placing.SIDES.get(prefix))
        return (prefix + number + again, prefix, sides) if fits else None

    texts = ["".join(v) for v in itertools.product([*names, "s", "Lg", "X", ""], ["", "7", " 12"], ["", "bis", "BIS "], ["", "-", " - "], ["", "(25x35)", "25X35", "(9x8x7", "190x90x20)", "1x2x3x4"])]
    words = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "A", "07"])], "id int, text string")
    got = {r["id"]: r for r in placing.elements(words).collect()}
    want = {i: label(t) for i, t in enumerate(texts) if label(t)}
    assert {i: tuple(r["label"])[:3] for i, r in got.items()} == want and len(want) > 300
    # a page's words are sorted once for letters and once for numbers, and shuffled once for both
    zones = spark.createDataFrame([], "doc int, page int, zx0 double, zy0 double, zx1 double, zy1 double")
    placed = spark.createDataFrame([(1, 1, 1, "A", 1.0, 1.0, 9.0, 9.0)], "doc int, page int, id int, text string, x double, y double, x1 double, y1 double")
    plan = placing.placements(placed, zones)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("last(") == 2


def test_nearest_anchors_are_those_of_all_pairs(spark):
    import random

    from quantiva.operators import boxes

    rng = random.Random(7)
    rows = [(rng.randrange(4), i, rng.randrange(60), rng.randrange(60)) for i in range(300)]
    anchors = sorted({(rng.choice([0, 1, 3]), kind, rng.randrange(60)) for kind in ("letter", "number") for _ in range(25)} - {(3, "number", v) for v in range(60)})
    named = [(*a, rng.choice("abc") + str(i)) for i, a in enumerate(anchors)]
    got = boxes.nearest_anchors(spark.createDataFrame(rows, "page int, id int, x bigint, y bigint"), spark.createDataFrame(named, "page int, kind string, at bigint, name string"), ["page"], {"letter": "x", "number": "y"})
    near = lambda page, kind, c: min(((abs(at - c), at, name) for p, k, at, name in named if (p, k) == (page, kind)), default=(0, 0, None))[2]
    assert {r["id"]: (r["letter"], r["number"]) for r in got.collect()} == {i: (near(p, "letter", x), near(p, "number", y)) for p, i, x, y in rows}


def test_words_of_tables_are_shuffled_once(spark):
    found = placing.borderless_tables(words(spark, [(1, 1, "S1", 1.0, 1.0), (1, 2, "S2", 90.0, 1.0), (1, 3, "90x90", 1.0, 31.0)]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    # bars: of several lines for one axis the last counts, of several notes on it the first; axes are read beside the line
    rows = [(1, 1, "S1", 100.0, 100.0), (1, 2, "S2", 200.0, 100.0), (1, 3, "FERRAILLAGE", 9.0, 300.0), (1, 4, "Selon", 20.0, 305.0), (1, 5, "Y", 40.0, 310.0), (1, 6, "x", 45.0, 320.0), (1, 7, "ferraillages", 9.0, 400.0), (1, 8, "selon", 20.0, 405.0), (1, 9, "y", 40.0, 415.0)]
    rows += [(1, 10, "3ha10", 101.0, 301.0), (1, 11, "4T12", 99.0, 402.0), (1, 12, "5T14", 99.0, 401.0), (1, 13, "6T8", 200.0, 290.0), (1, 14, "7T8", 200.0, 450.0), (1, 15, "8T8", 205.0, 296.0)]
    got = [tuple(r)[2:] for r in placing.borderless_tables(words(spark, rows)).collect()]
    assert sorted(got) == [("S1", None, None, None, None, "4T12"), ("S2", None, None, None, None, "8T8")]
    assert placing.borderless_tables(words(spark, rows).selectExpr("doc", "null page", "id", "text", "x", "y", "x1", "y1", "eps")).collect() == []
