"""From the words of a page to placed elements: labels outside tables, on the nearest axes, and tables without borders.

Words are rows (doc, page, id, text, x, y, x1, y1; ``id`` is the reading order). All of it is joins, windows and
aggregates by page; a page's words are never gathered in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.parsing import let
from .boxes import nearest_anchors

# fixed values: where axes are written, what a coupled label is, and which labels may carry how many dimensions
LETTER, NUMBER = "^[A-T]$", "^(0[1-9]|[1-9]|1[0-9]|20)$"
LETTERS_ABOVE, NUMBERS_RIGHT_OF, AXIS_BAND = 200, 400, 40
COUPLED = r"(?i)\(\s*(S[0-9]+)\s*,\s*([PQ0O][0-9]+)\s*\)"
SIDES = {"S": 3, "P": 2, "Q": 2, "N": 2, "BN": 2, "PN": 2, "LG": 2, "CH": 2, "D": 2, "V": 2}
BARE = ["ESC", "M", "R", "RD", "MS", "LT", "SF", "SB", "CV", "PA", "TR", "CF", "F", "PIE"]
UNNUMBERED, AGAIN = ["LG", "CH", "BN"], ["N", "BN"]
FAMILIES = {
    "SF": "semelles_filantes", "S": "semelles", "PN": "poutres", "PA": "poutres", "TR": "poutres", "P": "poteaux", "Q": "poteaux", "BN": "poutres", "LG": "longrines", "CH": "chainages", "N": "poutres", "D": "dalles", "V": "voiles",
    "ESC": "escaliers", "M": "murs", "R": "radiers", "RD": "redresseurs", "MS": "massifs", "LT": "linteaux", "SB": "sablieres", "CV": "couvertines", "CF": "contre_forts", "F": "futs", "PIE": "pieux",
}
CELL = 200


def axes(words: DataFrame) -> DataFrame:
    """``doc, page, kind, name, at``: the letters (by x) and numbers (by y) that are axes.

    A page's letters or numbers are axes in runs of at least two consecutive ones within a band (a line of letters, a
    column of numbers); where the page has one letter or one number only, that is an axis without a neighbour.
    """
    t = L.strip(F.col("text"))
    letter = F.when(t.rlike(LETTER) & (F.col("y") < LETTERS_ABOVE), "letter").when(t.rlike(NUMBER) & (F.col("x") > NUMBERS_RIGHT_OF), "number")
    key = F.when(F.col("kind") == "letter", F.ascii("name") - 64).otherwise(F.col("name").try_cast("int"))
    seen = words.select("doc", "page", letter.alias("kind"), t.alias("name"), "x", "y").filter("kind is not null").withColumn("key", key)
    seen = seen.select("doc", "page", "kind", "name", "key", F.when(F.col("kind") == "letter", F.col("x")).otherwise(F.col("y")).alias("at"), F.rint(F.when(F.col("kind") == "letter", F.col("y")).otherwise(F.col("x")) / AXIS_BAND).alias("band"))
    page, band = ["doc", "page", "kind"], ["doc", "page", "kind", "band"]
    runs = seen.withColumn("run", F.col("key") - F.dense_rank().over(Window.partitionBy(*band).orderBy("key")))
    ends = Window.partitionBy(*band, "run")
    kept = runs.withColumns({"long": F.max("key").over(ends) > F.min("key").over(ends), "only": F.max("key").over(Window.partitionBy(*page)) == F.min("key").over(Window.partitionBy(*page))})
    return kept.filter("long or only").select("doc", "page", "kind", "name", "at").distinct()


def outside(words: DataFrame, zones: DataFrame, reach: float) -> DataFrame:
    """``words`` whose centre is in none of the ``zones`` (doc, page, zx0, zy0, zx1, zy1), widened by ``reach``."""
    cell = lambda c: F.floor(c / CELL)
    cx, cy = (F.col("x") + F.coalesce("x1", "x")) / 2, (F.col("y") + F.coalesce("y1", "y")) / 2
    spread = zones.withColumn("zc", F.explode(F.sequence(cell(F.col("zx0") - reach), cell(F.col("zx1") + reach))))
    z = spread.select(F.col("doc").alias("zd"), F.col("page").alias("zp"), "zc", "zx0", "zy0", "zx1", "zy1")
    inside = (F.col("doc") == F.col("zd")) & (F.col("page") == F.col("zp")) & (cell(cx) == F.col("zc")) & cx.between(F.col("zx0") - reach, F.col("zx1") + reach) & cy.between(F.col("zy0") - reach, F.col("zy1") + reach)
    return words.join(z, inside, "left_anti")


def _pattern() -> str:
    """Labels of elements without blanks: prefix, number, BIS and sides, as each prefix may have them."""
    sides = lambda n: r"[\s-]*(?:\(?([0-9]+(?:x[0-9]+){" + str(n - 1) + r"})\)?)?"
    kinds = {}
    for prefix in [*SIDES, *BARE]:
        number = "([0-9]*)" if prefix in UNNUMBERED else "([0-9]+)"
        again = "(BIS)?" if prefix in AGAIN else "()"
        kinds.setdefault(number + again + (sides(SIDES[prefix]) if prefix in SIDES else r"[\s-]*()"), []).append(prefix)
    return "(?i)^(?:" + "|".join(f"({'|'.join(prefixes)}){rest}" for rest, prefixes in kinds.items()) + ")$"


def elements(words: DataFrame) -> DataFrame:
    """``words`` that are labels: ``k`` and ``label``, a struct<ref, prefix, sides, coupled>, for each element they name."""
    pattern = _pattern()
    groups = re.compile(pattern).groups
    of = lambda i: "".join(f"${g}" for g in range(i, groups + 1, 4))  # noqa: E731  # all but the matching kind's are empty
    one = lambda ref, prefix, sides, coupled: F.struct(ref.alias("ref"), prefix.alias("prefix"), sides.alias("sides"), F.lit(coupled).alias("coupled"))
    coupled = F.col("t").contains("(") & F.col("t").rlike(COUPLED)
    # a generator's output isn't worked out again by what filters it
    spelled = words.withColumn("t", F.explode(F.array(L.strip(F.col("text"))))).withColumn("close", F.explode(F.array(F.replace("t", F.lit(" "), F.lit(""))))).filter(coupled | F.col("close").rlike(pattern))
    single = F.regexp_replace("close", pattern, ",".join(map(of, (1, 2, 3, 4))))
    double = F.concat(F.regexp_extract("t", COUPLED, 1), F.lit(","), F.regexp_extract("t", COUPLED, 2))
    parted = spelled.withColumn("part", F.split(F.upper(F.when(coupled, double).otherwise(single)), ","))
    part, none = lambda i: F.col("part")[i], F.lit(None).cast("array<int>")
    second = F.when(part(1).rlike("^[0O]"), F.concat(F.lit("Q"), F.substring(part(1), 2, 1 << 30))).otherwise(part(1))
    pair = F.array(one(part(0), F.lit("S"), none, True), one(second, F.substring(second, 1, 1), none, True))
    own = F.array(one(F.concat(part(0), part(1), part(2)), part(0), F.when(part(3) != "", F.split(part(3), "X").cast("array<int>")), False))
    return parted.select(*words.columns, F.posexplode_outer(F.when(F.size("part") == 2, pair).otherwise(own)).alias("k", "label"))


def placements(words: DataFrame, zones: DataFrame, reach: float = 10.0) -> DataFrame:
    """``doc, page, id, ref, family, number_in_doc, letter, number, x, y, sides``: one row for each element on its axes.

    Labels in a table's zone don't count; names of axes are found everywhere. A coupled label such as (S1, Q2) is two
    elements at one place, a footing and a column, whose first letter may be misread as a nought. Elements of a
    reference are numbered over the document, coupled ones after the others of their page. ``letter`` and ``number`` are
    the nearest axes (the lesser of two as near), null on pages without. M is a block of
    concrete on pages that speak of them, a wall elsewhere.
    """
    hits = outside(elements(words.select("doc", "page", "id", "text", "x", "y", "x1", "y1")).drop("text"), zones, reach).withColumn("coupled", F.col("label.coupled"))
    order = Window.partitionBy("doc", "label.ref").orderBy("page", "coupled", "id", "k")
    numbered = hits.withColumn("number_in_doc", F.row_number().over(order)).drop("x1", "y1", "coupled")
    by = axes(words).groupBy("doc", "page", "kind", "at").agg(F.min("name").alias("name"))
    placed = nearest_anchors(numbered, by, ["doc", "page"], {"letter": "x", "number": "y"})
    listed = F.element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), F.col("label.prefix"))
    blocks = words.filter(F.lower("text").contains("massif")).select("doc", "page", F.lit("massifs").alias("blocks")).distinct()
    placed = placed.join(blocks, ["doc", "page"], "left")
    family = F.when(F.col("label.prefix") == "M", F.coalesce("blocks", listed)).otherwise(listed)
    return placed.select("doc", "page", "id", "k", "label.ref", family.alias("family"), "number_in_doc", "letter", "number", "x", "y", F.array_join(F.col("label.sides").cast("array<string>"), "x").alias("sides"))


# fixed values in units of the page's tolerance, but the two distances in px: where a column's cells lie below its header
COLUMN, SIZE_FROM, SIZE_TO, DEPTH_AT, DEPTH_REACH, BARS_FROM, BARS_TO = 1.2, 2, 7, 14, 6, 0.5, 4
ALONG, ASIDE = 60, 40


def _named(**fields: Column) -> Column:
    """A struct whose fields keep their names beside lambdas and generators, where aliases may be lost."""
    return F.named_struct(*(v for name, c in fields.items() for v in (F.lit(name), c)))


def _turned(rows: Column, says: Column, xy: Column) -> Column:
    """array of struct<row, ry, axis>: lines of bars beside which an axis is written; of several the first in reading order."""
    beside = lambda s: F.filter(xy, lambda a: (F.abs(a["x"] - s["x"]) < ASIDE) & (a["y"] > s["y"]) & (a["y"] - s["y"] < ASIDE))
    named = F.flatten(F.transform(says, lambda s: F.transform(beside(s), lambda a: _named(sid=s["id"], aid=a["id"], axis=F.lower(a["t"]), sy=s["y"]))))
    own = lambda n, r: F.array_min(F.filter(n, lambda v: F.abs(r["y"] - v["sy"]) < ALONG))["axis"]
    return let(named, lambda n: F.filter(F.transform(rows, lambda r: _named(row=r["id"], ry=r["y"], axis=own(n, r))), lambda v: v["axis"].isNotNull()))


def borderless_tables(words: DataFrame) -> DataFrame:
    """``doc, page, ref, a, b, h, bars_x, bars_y`` of footings in tables without borders; words also have ``eps``.

    The header is the uppermost line of references (two at least on the page). Each column takes the first word that is a
    size below its header, the depth on the line that begins with H, and on each line of bars (which says along which
    axis they lie) the first note of bars. Cells are looked up by the part of the page that a column stands in. A column
    without any of these gives no row; of lines for one axis the last counts.

    Words are told apart once and shuffled by pages once: what a header needs of its page's legends are windows over the
    page, what a cell needs of the headers near it is a window over their part of the page.
    """
    page, t, eps, x, y = ["doc", "page"], F.col("t"), F.col("eps"), F.col("x"), F.col("y")
    kind = F.when(t.rlike("^[0-9]+$"), "depth").when(t.rlike("^[0-9]{2,3}x[0-9]{2,3}$"), "size").when(t.rlike("(?i)^[0-9]+(HA|T)[0-9]+$"), "bars").when(t.rlike("(?i)^S[0-9]+$"), "head")
    kind = kind.when(t == "H", "deep").when(t.isin("x", "X", "y", "Y"), "axis").when(t.rlike("(?i)^selon$"), "says").when(t.rlike("(?i)^ferraillage"), "row")
    # a generator's output isn't worked out again by what filters it
    told = words.dropna(subset=page).select(*page, "id", "x", "y", "eps", F.explode(F.array(L.strip(F.col("text")))).alias("t")).select("*", F.explode(F.array(kind)).alias("kind")).filter("kind is not null")
    whole, is_ = Window.partitionBy(*page), lambda k: F.col("kind") == k
    legends = {k: F.collect_list(F.when(is_(k), F.struct(*cs))).over(whole) for k, cs in {"deep": ("id", "x", "y"), "row": ("id", "y"), "says": ("id", "x", "y"), "axis": ("id", "x", "y", "t")}.items()}
    w = told.withColumns({"top": F.min(F.when(is_("head"), y)).over(whole), "n": F.count(F.when(is_("head"), 1)).over(whole), **legends})
    deep = F.filter("deep", lambda v: (v["x"] > x) & (F.abs(v["y"] - y - DEPTH_AT * eps) < DEPTH_REACH * eps))
    head = _named(ref=F.upper(t), head=F.col("id"), hx=x, hy=y, eps=eps, wy=F.array_min(F.transform(deep, lambda v: _named(id=v["id"], y=v["y"])))["y"], turned=_turned(F.col("row"), F.col("says"), F.col("axis")))
    part = lambda c: F.floor(c / (4 * eps)).cast("bigint")
    parts = F.when(is_("head"), F.sequence(part(x - COLUMN * eps), part(x + COLUMN * eps))).otherwise(F.array(part(x)))
    headed = is_("head") & (F.col("n") > 1) & (y - F.col("top") < eps)
    near = w.filter(headed | F.col("kind").isin("depth", "size", "bars")).select(*page, "id", "x", "y", "t", "kind", F.when(is_("head"), head).alias("own"), F.explode(parts).alias("part"))
    near = near.withColumn("heads", F.collect_list("own").over(Window.partitionBy(*page, "part"))).filter("own is null")
    under = near.select(*page, "id", "x", "y", "t", "kind", F.explode("heads").alias("h")).select("*", *(F.col("h")[c].alias(c) for c in ("ref", "head", "hx", "hy", "eps", "wy", "turned"))).filter(F.abs(x - F.col("hx")) < COLUMN * eps)
    size = is_("size") & (y > F.col("hy") + SIZE_FROM * eps) & (y < F.col("hy") + SIZE_TO * eps)
    depth = is_("depth") & (F.abs(y - F.col("wy")) < COLUMN * eps)
    lines = F.when(is_("bars"), F.filter("turned", lambda r: (y > r["ry"] - BARS_FROM * eps) & (y < r["ry"] + BARS_TO * eps)))
    found = under.select(*page, "ref", "head", "id", "t", size.alias("is_size"), depth.alias("is_depth"), lines.alias("lines"))
    last = lambda a: F.array_max(F.transform(F.filter("lines", lambda r: r["axis"] == a), lambda r: r["row"]))
    cell, row = F.struct("id", "t"), lambda c: F.when(F.col(c).isNotNull(), F.struct(-F.col(c), "id", "t"))
    found = found.withColumns({"x": last("x"), "y": last("y")}).groupBy(*page, "ref", "head")
    out = found.agg(F.min(F.when(F.col("is_size"), cell))["t"].alias("size"), F.min(F.when(F.col("is_depth"), cell))["t"].alias("depth"), F.min(row("x"))["t"].alias("bars_x"), F.min(row("y"))["t"].alias("bars_y"))
    metres = lambda v: F.when(v.cast("int") > 10, F.round(v.cast("int") / 100, 4)).otherwise(v.cast("double"))
    side = lambda i: metres(F.get(F.split("size", "x"), F.lit(i)))
    return out.filter("size is not null or depth is not null or bars_x is not null or bars_y is not null").select(*page, "ref", side(0).alias("a"), side(1).alias("b"), metres(F.col("depth")).alias("h"), F.upper("bars_x").alias("bars_x"), F.upper("bars_y").alias("bars_y"))
