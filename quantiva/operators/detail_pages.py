"""Pages of beams and of columns: labels with the sections, bars and stirrups that are written near them.

Words are rows (doc, page, id, text, x, y; ``id`` is the reading order). What is near a label is found on grid cells, in
which each note stands once and each label once for every cell it reaches: for columns by a join, for beams by windows
over the cells, after one shuffle by pages. The nearest is found by an aggregate; a reference that stands on a page several
times takes what its labels find, the first in reading order before the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L

# fixed values: what is written how, and how far it may be, in px
BEAM = r"B?N[0-9]+(?:BIS)?|PN[0-9]+|PC[0-9]*|LG[0-9]*|CH[0-9]*|BN[0-9]*|PR[0-9]*"
BEAM_SECTION = rf"(?i)^({BEAM})\s*(?:[-–]\s*\(([0-9]+)\s*[x*]\s*([0-9]+)\)|\(([0-9]+)\s*[x*]\s*([0-9]+)\)\s*$)"
ANY_BEAM = rf"(?i)(?:^|/)(?:{BEAM})[\s\u0085\u2028\u2029]*(?:/|$)"
# what is written at a beam: the sides of a section, bars (upper ones by name), stirrups; one pattern, read once a word
NOTE = r"(?i)^(?:\(?\s*([0-9]{2,3})\s*x\s*([0-9]{2,3})\s*\)?|(CHAP\.?\s*)?([0-9]+)(?:HA|T)([0-9]+)|Cad\.?\s*T([0-9]+))$[\s\S]*"
BARS = r"(?i)([0-9]+)\s*(?:HA|T)\s*([0-9]+)"
STIRRUP, PINS = r"(?i)^Cad\.?\s*T([0-9]+)$", r"(?i)^T([0-9]+)\+?Ep$"
SPACING, STEPS = r"(?i)(?<![A-Za-z])(?:e|esp)\s*=\s*([0-9]+[.,]?[0-9]*)", r"(?i)^e=\(([0-9]+)x[0-9]+"
COLUMN, COLUMN_SECTION = "(?i)^([PQ][0-9]+)$", r"^\(([0-9]+)x([0-9]+)\)$"
AT_COLUMN = rf"^[0-9]+$|{BARS}|{STIRRUP}|{PINS}|{SPACING}|{COLUMN_SECTION}"
SECTION_REACH, BARS_REACH, SPACING_REACH = (160, 80), 240, (100, 60)
BOAT = (-60, 320, -20, 60)  # what a drop of the beam shows around its word: left, right, above, below
COLUMN_REACH, TABLE_COLUMN, TABLE_BELOW, ROW, LEAST_COLUMNS = (145, 80), 60, 120, 15, 3
TABLE_BARS, TABLE_A, TABLE_B, TABLE_STIRRUP = (0, 30), (30, 50), (50, 80), (65, 95)
A_CM, B_CM = (15, 80), (15, 100)
CELL = 4  # side of a cell, in reaches
PAGE = ["doc", "page"]


def _metres(cm: Column) -> Column:
    v = cm.try_cast("int")
    return F.when(v > 10, F.round(v / 100, 4)).otherwise(v.cast("double"))


def _placed(words: DataFrame, size: int) -> DataFrame:
    """Words with the cell they are in; all columns but the page's get the prefix ``w_``."""
    cell = lambda c: F.floor(F.col(c) / size)
    return words.select(*PAGE, *(F.col(c).alias(f"w_{c}") for c in words.columns if c not in PAGE), cell("x").alias("cx"), cell("y").alias("cy"))


def _reaching(places: DataFrame, size: int, zone: tuple[int, int, int, int]) -> DataFrame:
    """A row for every cell that the zone (left, right, above, below) around a place touches; these are the fewer rows."""
    span = lambda c, a, b: F.explode(F.sequence(F.floor((F.col(c) + a - 1) / size), F.floor((F.col(c) + b + 1) / size)))
    left, right, above, below = zone
    return places.withColumn("cx", span("x", left, right)).withColumn("cy", span("y", above, below))


def _group(text: str, pattern: str, i: int = 1) -> Column:
    return F.regexp_extract(text, pattern, i)


def _spacing() -> Column:
    """The spacing that a word ``t`` states, in centimetres as written; of a stepped one the first step."""
    return F.when(F.col("t").rlike(STEPS), _group("t", STEPS)).when(F.col("t").rlike(SPACING), F.regexp_replace(_group("t", SPACING), ",", "."))


def beam_pages(words: DataFrame) -> DataFrame:
    """``doc, page, ref, b, h, source, lower, upper, phi, spacing`` of each beam named on a page; metres.

    The section of a label that carries one wins (source ``label``); else the nearest above a label (``heuristic``).
    A note of bars belongs to the nearest label: to the lower bars if it is below the reference's first label, to the
    upper ones if above or marked as such. Stirrups are the nearest to a label; their spacing is the first note near them.
    Bars and stirrups at a drop of the beam don't count. What isn't found is null; bars empty.
    """
    # what a word says is told once, as texts: a generator's result isn't worked out again by what follows it
    t = F.col("t")
    carried = F.when(t.rlike(BEAM_SECTION), F.regexp_replace("t", BEAM_SECTION + r"[\s\S]*", "$1;$2$4;$3$5"))
    plain = F.when(~t.rlike(BEAM_SECTION) & t.rlike(ANY_BEAM), t)
    note = F.when(t.rlike(NOTE) & F.col("doc").isNotNull() & F.col("page").isNotNull(), F.regexp_replace("t", NOTE, "$1;$2;$3;$4;$5;$6"))
    boat = F.when(F.lower("t") == "bateau", t)
    w = words.withColumn("t", F.coalesce(F.col("text"), F.lit(""))).select(*PAGE, "id", "x", "y", F.explode(F.array(F.array(carried, plain, note, boat, _spacing()))).alias("said"))
    said = {c: F.col("said")[i] for i, c in enumerate(("carried", "plain", "note", "boat", "e"))}
    w = w.filter(F.coalesce(*said.values()).isNotNull()).select(*PAGE, "id", "x", "y", F.split(said["carried"], ";").alias("carried"), said["plain"].alias("plain"), F.split(said["note"], ";").alias("note"), said["boat"].isNotNull().alias("boat"), said["e"].alias("e"))
    has = lambda i: F.col("note")[i] != ""
    number = lambda i: F.nullif(F.col("note")[i], F.lit("")).try_cast("int")  # noqa: E731; a cast that fails is slow
    kind = F.when(has(0), "section").when(has(5), "ring").when(has(2), "top").when(has(3), "bars")
    names = F.when(F.col("carried").isNotNull(), F.array(F.upper(F.col("carried")[0]))).when(F.col("plain").isNotNull(), F.split(F.upper("plain"), "/"))
    side = lambda i: F.nullif(F.col("carried")[i], F.lit(""))
    metres = F.round(F.col("e").try_cast("double") / 100, 6)
    # pages are dealt out once, by a number of their own, and stay where they are
    at = ["deal", *PAGE]
    w = w.select(F.xxhash64(*PAGE).alias("deal"), *PAGE, "id", "x", "y", names.alias("names"), side(1).alias("b0"), side(2).alias("h0"), kind.alias("kind"), F.coalesce(number(0), number(3), number(5)).alias("n"), F.coalesce(number(1), number(4)).alias("m"), "boat", metres.alias("e")).repartition("deal")

    # a note is in one cell, what may reach it is brought there
    size, (rx, ry) = CELL * BARS_REACH, SPACING_REACH
    zones = ((F.col("names").isNotNull(), (-BARS_REACH, BARS_REACH, -BARS_REACH, BARS_REACH)), (F.col("boat"), BOAT), (F.col("e").isNotNull(), (-rx, rx, -ry, ry)))
    left, right, above, below = (F.when(zones[0][0], zones[0][1][i]).when(zones[1][0], zones[1][1][i]).when(zones[2][0], zones[2][1][i]).otherwise(0) for i in range(4))
    span = lambda c, a, b: F.explode_outer(F.sequence(F.floor((F.col(c) + a - 1) / size), F.floor((F.col(c) + b + 1) / size)))
    w = w.withColumn("cx", span("x", left, right)).withColumn("cy", span("y", above, below))
    w = w.select("*", F.posexplode_outer("names").alias("k", "name")).withColumn("ref", F.when(F.col("name").rlike(f"(?i)^(?:{BEAM})$"), F.col("name")))
    told = {"labels": (F.col("ref").isNotNull(), ("id", "k", "ref", "x", "y")), "boats": (F.col("boat"), ("x", "y")), "spacings": (F.col("e").isNotNull(), ("id", "x", "y", "e"))}
    w = w.withColumns({c: F.when(when, F.struct(*cs)) for c, (when, cs) in told.items()})
    cell = Window.partitionBy(*at, "cx", "cy")
    w = w.withColumns({c: F.collect_list(c).over(cell) for c in told})
    home = F.coalesce((F.col("cx") == F.floor(F.col("x") / size)) & (F.col("cy") == F.floor(F.col("y") / size)), F.lit(True))
    w = w.filter(home & F.expr("ref is not null or n is not null and (m is not null or kind = 'ring')"))

    # notes with the labels in reach: of bars the nearest, of sections and stirrups all; a label finds itself
    wide, high = SECTION_REACH
    dx, dy, is_ = (lambda o: F.col("x") - o["x"]), (lambda o: F.col("y") - o["y"]), (lambda *k: F.col("kind").isin(*k))
    d2 = lambda o: dx(o) ** 2 + dy(o) ** 2
    left, right, above, below = BOAT
    wet = F.when(is_("bars", "top", "ring") & (F.size("boats") > 0), F.exists("boats", lambda o: (dy(o) > above) & (dy(o) < below) & (dx(o) > left) & (dx(o) < right)))
    nearest = F.when(is_("bars", "top") & (F.size("labels") > 1), F.array_min(F.transform("labels", lambda o: F.struct(d2(o).alias("d"), o["id"].alias("id"), o["k"].alias("k"), o["ref"].alias("ref")))))
    spaced = F.when(is_("ring"), F.array_min(F.transform(F.filter("spacings", lambda o: (F.abs(dx(o)) < rx) & (F.abs(dy(o)) < ry)), lambda o: F.struct(o["id"], o["e"].alias("e"))))["e"])
    note = [c for c in w.columns if c in (*at, "id", "k", "ref", "x", "y", "kind", "n", "m", "b0", "h0")]
    met = w.select(*note, F.coalesce(wet, F.lit(False)).alias("wet"), nearest.alias("nearest"), spaced.alias("spacing"), "labels").select(*note, "wet", "nearest", "spacing", F.explode("labels").alias("o"))
    o, itself = F.col("o"), F.col("ref").isNotNull() & (F.col("o.id") == F.col("id")) & (F.col("o.k") == F.col("k")) & (F.col("o.ref") == F.col("ref"))
    over = (dy(o) < 0) & (F.abs(dx(o)) < wide) & (F.abs(dy(o)) < high)
    within = ~F.col("wet") & (d2(o) <= BARS_REACH**2)
    best = F.col("nearest").isNull() | (F.col("nearest.id") == F.col("o.id")) & (F.col("nearest.k") == F.col("o.k")) & (F.col("nearest.ref") == F.col("o.ref"))
    finds = F.when(itself, "itself").when(is_("section"), F.when(over, "section")).when(is_("ring"), F.when(within, "ring")).when(is_("bars", "top"), F.when(within & best, "bars"))
    met = met.withColumns({"finds": finds, "d": d2(o)}).filter("finds is not null")

    # the first label that finds something, with the nearest it finds
    found = lambda kind, *v: F.when(F.col("finds") == kind, F.struct(F.col("o.id").alias("o_id"), F.col("o.k").alias("o_k"), *v))
    bar = F.struct("id", "n", "m", F.when(is_("bars"), F.col("y")).alias("y"), F.concat(F.col("n").cast("string"), F.lit("T"), F.col("m").cast("string")).alias("said"))
    met = met.select(*at, F.col("o.ref").alias("ref"), found("itself", "y").alias("own"), F.when(F.col("b0").isNotNull(), found("itself", "b0", "h0")).alias("stated"), found("section", "d", "id", "n", "m").alias("near"), found("ring", "d", "id", "n", "x", "y", "spacing").alias("ring"), F.when(F.col("finds") == "bars", bar).alias("bar"))
    out = met.groupBy(*at, "ref").agg(*(F.min(c).alias(c) for c in ("own", "stated", "near", "ring")), F.sort_array(F.collect_list("bar")).alias("bars"))
    below_first = lambda b: F.coalesce(b["y"] > F.col("own.y"), F.lit(False))
    listed = lambda keep: F.array_join(F.array_distinct(F.transform(F.filter("bars", keep), lambda b: b["said"])), "+")
    b, h = (F.coalesce(f"stated.{own_}", F.col(f"near.{near_}").cast("string")) for own_, near_ in (("b0", "n"), ("h0", "m")))
    source = F.when(F.col("stated").isNotNull(), "label").when(F.col("near").isNotNull(), "heuristic")
    phi = F.col("ring.n")
    lower, upper = (F.when(F.size("bars") > 0, listed(keep)).otherwise("") for keep in (below_first, lambda b: ~below_first(b)))
    return out.select(*PAGE, "ref", _metres(b).alias("b"), _metres(h).alias("h"), source.alias("source"), lower.alias("lower"), upper.alias("upper"), phi.alias("phi"), F.when(phi.isNotNull(), F.coalesce("ring.spacing", F.lit(0.0))).alias("spacing"))


def column_pages(words: DataFrame) -> DataFrame:
    """``doc, page, ref, a, b, source, bars, phi, spacing`` of each column named on a page that has a section; metres.

    Columns that stand side by side (LEAST_COLUMNS different ones on a line) head a table: bars, the two sides and the
    stirrups are read below them at fixed distances (source ``heuristic``). A reference without a first side from
    there takes the first section in brackets near one of its labels (``label``), with the bars and stirrups near it.
    """
    w = words.withColumn("t", L.strip(F.coalesce(F.col("text"), F.lit("")))).select(*PAGE, "id", "t", "x", "y")
    labels = w.filter(F.col("t").rlike(COLUMN)).select(*PAGE, "id", F.upper("t").alias("ref"), "x", "y", (F.rint(F.col("y") / ROW) * ROW).alias("row"))
    key, row = [*PAGE, "ref"], [*PAGE, "row"]
    # a label heads a column of a table if enough different ones stand on its line, and it is its own first one there
    labels = labels.withColumn("nth", F.row_number().over(Window.partitionBy(*row, "ref").orderBy("x", "id"))).withColumn("n", F.dense_rank().over(Window.partitionBy(*row).orderBy("ref")))
    labels = labels.withColumn("n", F.max("n").over(Window.partitionBy(*row))).select(*key, "id", "x", "y", "row", ((F.col("nth") == 1) & (F.col("n") >= LEAST_COLUMNS)).alias("head"))

    # what a word says is worked out once, before it meets labels
    number = F.when(F.col("t").rlike("^[0-9]+$"), F.col("t").try_cast("int"))
    all_bars = F.regexp_extract_all("t", F.lit(BARS), F.lit(0))
    said = F.array_join(F.array_distinct(F.transform(all_bars, lambda b: F.upper(F.regexp_replace(F.regexp_replace(b, "\\s", ""), "(?i)HA", "T")))), "+")
    ring = F.coalesce(F.nullif(_group("t", STIRRUP), F.lit("")), F.nullif(_group("t", PINS), F.lit(""))).try_cast("int")
    e = F.round(F.regexp_replace(F.nullif(_group("t", SPACING), F.lit("")), ",", ".").try_cast("double") / 100, 6)
    cut = lambda i: _group("t", COLUMN_SECTION, i).try_cast("int")
    section = F.when(F.col("t").rlike(COLUMN_SECTION), F.struct(cut(1).alias("a"), cut(2).alias("b")))
    told = w.filter(F.col("t").rlike(AT_COLUMN)).select(*PAGE, "id", "x", "y", number.alias("number"), F.when(F.col("t").rlike(BARS), said).alias("bars"), ring.alias("ring"), e.alias("e"), section.alias("section"))

    rx, ry = COLUMN_REACH
    size, zone = CELL * rx, (-rx, rx, -ry, max(ry, TABLE_BELOW))
    dx, dy = F.abs(F.col("w_x") - F.col("x")), F.col("w_y") - F.col("y")
    below = F.col("head") & (dx < TABLE_COLUMN) & (dy > 0) & (dy < TABLE_BELOW)
    beside = (dx < rx) & (F.abs(dy) < ry)
    near = _placed(told, size).join(_reaching(labels, size, zone), [*PAGE, "cx", "cy"]).filter(below | beside).withColumns({"dy": dy, "below": below, "beside": beside})
    within = lambda r: F.col("below") & (F.col("dy") > r[0]) & (F.col("dy") < r[1])
    pick = lambda when, c: F.min(F.when(when & F.col(c).isNotNull(), F.struct("dy", "w_id", F.col(c).alias("v"))))
    first = lambda c: F.min(F.when(F.col("beside") & F.col(c).isNotNull(), F.struct("w_id", F.col(c).alias("v"))))
    each = near.groupBy(*key, "id", "row").agg(
        pick(within(TABLE_BARS), "w_bars")["v"].alias("bars"), pick(within(TABLE_A) & F.col("w_number").between(*A_CM), "w_number")["v"].alias("a"), pick(within(TABLE_B) & F.col("w_number").between(*B_CM), "w_number")["v"].alias("b"), pick(within(TABLE_STIRRUP), "w_ring").alias("ring"),
        F.collect_list(F.when(within(TABLE_STIRRUP) & F.col("w_e").isNotNull(), F.struct("dy", "w_id", F.col("w_e").alias("v")))).alias("es"),
        first("w_section")["v"].alias("section"), first("w_bars")["v"].alias("own_bars"), first("w_ring").alias("own_ring"), F.collect_list(F.when(F.col("beside") & F.col("w_e").isNotNull(), F.struct("w_id", F.col("w_e").alias("v")))).alias("own_es"),
    ).filter("a is not null or b is not null or section is not null")
    place = lambda s: F.struct(s["dy"], s["w_id"])
    after = F.array_min(F.filter("es", lambda s: place(s) >= place(F.col("ring"))))["v"]
    own_after = F.array_min(F.filter("own_es", lambda s: s["w_id"] >= F.col("own_ring.w_id")))["v"]
    of = lambda a, b, bars, phi, e, source: (F.col(a).alias("a"), F.col(b).alias("b"), F.col(bars).alias("bars"), F.col(phi).alias("phi"), F.col(e).alias("e"), F.lit(source).alias("source"))
    from_table = F.when(F.coalesce("a", "b").isNotNull(), F.struct(F.col("a").isNull().alias("no"), "row", "id", *of("a", "b", "bars", "ring.v", "after", "heuristic")))
    # what the tables don't give: each label by itself, in reading order of the words
    from_label = F.when(F.col("section").isNotNull(), F.struct("id", *of("section.a", "section.b", "own_bars", "own_ring.v", "own_after", "label")))
    best = each.withColumns({"after": after, "own_after": own_after}).groupBy(*key).agg(F.min(from_table).alias("t"), F.min(from_label).alias("l"))
    result = lambda s: F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("a", "b", "bars", "phi", "e", "source")))
    kept = best.select(*key, F.when(F.col("l").isNotNull() & F.col("t.a").isNull(), result("l")).otherwise(result("t")).alias("m")).select(*key, "m.*")
    spacing = F.when(F.col("phi").isNotNull(), F.coalesce("e", F.lit(0.0)))
    return kept.select(*key, _metres(F.col("a").cast("string")).alias("a"), _metres(F.col("b").cast("string")).alias("b"), "source", F.coalesce("bars", F.lit("")).alias("bars"), "phi", spacing.alias("spacing"))
