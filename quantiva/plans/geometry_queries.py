"""Queries of dimension chains, scales, polygons, shapes, walls, document profiles and sheets."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions.constants import FALLBACK_LEGEND
from ..operators import boxes
from ..sources import files
from .carriers import CTE, catalogue, gated, placements, read
from .matching_queries import _BOXES, _WORDS, label_boxes, words
from .quantity_queries import _LINES as _QLINES
from .quantity_queries import records
from .registry import query

W = f"with recursive {CTE} "

# -- dimension chains -----------------------------------------------------------------------------------------------------

_GAPS = W + ", c as (select project, lo, hi, row_number() over (partition by project order by lo, hi) k from (select project, type * 37 % 900 lo, type * 37 % 900 + qty * 12 hi from placements) where hi <= 1005), f as (select project, k, case when hi > 5 and lo >= -5 and lo <= 5 then hi when hi > 5 and lo > 5 then hi else 0 end cur, case when hi > 5 and lo > 5 then 1 else 0 end gaps, case when hi > 5 and lo > 5 then lo else 0 end size from c where k = 1 "
_GAPS += "union all select c.project, c.k, case when c.hi <= f.cur + 5 then f.cur when c.lo >= f.cur - 5 then greatest(f.cur, c.hi) else f.cur end, f.gaps + case when c.hi > f.cur + 5 and c.lo > f.cur + 5 then 1 else 0 end, f.size + case when c.hi > f.cur + 5 and c.lo > f.cur + 5 then c.lo - f.cur else 0 end from f join c on c.project = f.project and c.k = f.k + 1), e as (select project, arg_max(cur, k) cur, arg_max(gaps, k) gaps, arg_max(size, k) size from f group by project) "


@query("g4_missing_dimension", _GAPS + "select project, (size + case when 1000 - cur > 5 then 1000 - cur else 0 end)::bigint missing from e where gaps + (1000 - cur > 5)::int = 1")
def g4_missing_dimension(spark, sf):
    """The dimension that a chain lacks within its total of 1000, where exactly one gap is left."""
    inner = placements(spark, sf).select("project", (F.col("type") * 37 % 900).alias("lo"), (F.col("type") * 37 % 900 + F.col("qty") * 12).alias("hi")).filter("hi <= 1005")
    chain = inner.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("c"))
    start = F.struct(*(F.lit(0).cast("bigint").alias(n) for n in ("cur", "gaps", "size")))

    def step(acc: Column, c: Column) -> Column:
        new, gap = c["hi"] > acc["cur"] + 5, c["lo"] > acc["cur"] + 5
        cur = F.when(new & (c["lo"] >= acc["cur"] - 5), F.greatest(acc["cur"], c["hi"])).otherwise(acc["cur"])
        return F.struct(cur.alias("cur"), (acc["gaps"] + (new & gap).cast("bigint")).alias("gaps"), (acc["size"] + F.when(new & gap, c["lo"] - acc["cur"]).otherwise(0)).alias("size"))

    end = chain.select("project", F.aggregate("c", start, step).alias("e"))
    last = F.when(1000 - F.col("e.cur") > 5, 1000 - F.col("e.cur")).otherwise(0)
    return end.filter(F.col("e.gaps") + (last > 0).cast("int") == 1).select("project", (F.col("e.size") + last).alias("missing"))


@query("g5_net_length", W + "select type, cast(hm * 10 - case when type % 3 > 0 and type % 4 > 0 then am / 2 + bm / 2 else 0 end as decimal(18,4))::double net, case when type % 3 > 0 and type % 4 > 0 then 'OK' else 'A_VERIFIER' end status from catalogue")
def g5_net_length(spark, sf):
    """Between axes less half of each support; the raw length, to be checked, where a support's width is missing."""
    half = F.lit("0.5").cast("decimal(2,1)")
    known = (F.col("type") % 3 > 0) & (F.col("type") % 4 > 0)
    net = F.col("hm") * 10 - F.when(known, F.col("am") * half + F.col("bm") * half).otherwise(F.lit(0))
    return gated(spark, sf).select("type", net.cast("decimal(18,4)").cast("double").alias("net"), F.when(known, "OK").otherwise("A_VERIFIER").alias("status"))


_ROUND = "r{0} as (select level, x, y, n from (select *, median_of, greatest(0.05 * median_of, 3 * 1.4826 * mad) band from r{1} join (select level, median_of, quantile_cont(abs(ratio - median_of), 0.5) mad from (select level, median_of, y / x::double ratio from r{1} join (select level, quantile_cont(y / x::double, 0.5) median_of from r{1} group by level) using (level)) group by level, median_of) using (level)) where abs(y / x::double - median_of) <= band)"


@query("g6_scale_regression", W + ", r0 as (select level, qty x, qty * 25 + type % 7 + case when type % 20 = 0 then qty * 35 else 0 end y, 1 n from placements), " + ", ".join(_ROUND.format(i, i - 1) for i in (1, 2, 3)) + " select level, round(sum(x * y)::double / sum(x * x), 6) factor, count(*) used from r3 group by level")
def g6_scale_regression(spark, sf):
    """Scale through the origin, after three rounds that drop pairs far from the median ratio. Equal pairs are counted
    once, so the exact medians are those of some thousand weighted ratios a level."""
    x = F.col("qty").cast("bigint")
    pairs = placements(spark, sf).select("level", x.alias("x"), (x * 25 + F.col("type") % 7 + F.when(F.col("type") % 20 == 0, x * 35).otherwise(0)).alias("y")).groupBy("level", "x", "y").agg(F.count("*").alias("n"))
    ratio = F.col("y") / F.col("x")
    for _ in range(3):
        middle = pairs.groupBy("level").agg(F.percentile(ratio, 0.5, F.col("n")).alias("m"))
        off = pairs.join(middle, "level")
        spread = off.groupBy("level", "m").agg(F.percentile(F.abs(ratio - F.col("m")), 0.5, F.col("n")).alias("mad"))
        band = F.greatest(0.05 * F.col("m"), F.lit(3.0) * 1.4826 * F.col("mad"))
        pairs = pairs.join(spread, "level").filter(F.abs(ratio - F.col("m")) <= band).select("level", "x", "y", "n")
    return pairs.groupBy("level").agg(F.round(F.sum(F.col("x") * F.col("y") * F.col("n")) / F.sum(F.col("x") * F.col("x") * F.col("n")), 6).alias("factor"), F.sum("n").alias("used"))


@query("g8_closure", W + ", s as (select project, sum(qty)::bigint computed, count(*) * 25 declared, greatest(2, 0.02 * max(qty)) tol from placements group by project) select project, computed, declared::bigint declared, abs(computed - declared) <= tol closed from s")
def g8_closure(spark, sf):
    """Whether a chain's sum meets the declared total within the tolerance."""
    s = placements(spark, sf).groupBy("project").agg(F.sum("qty").alias("computed"), (F.count("*") * 25).alias("declared"), F.greatest(F.lit(2.0), 0.02 * F.max("qty")).alias("tol"))
    return s.select("project", "computed", "declared", (F.abs(F.col("computed") - F.col("declared")) <= F.col("tol")).alias("closed"))


@query("g10_cotes_from_centers", _WORDS + ", t as (select id, page, y // 2000 as row, x, lag(x) over w px, lead(x) over w nx from words window w as (partition by page, y // 2000 order by x, id)) select id, (case when px is null then x - (nx - x) / 2.0 else (px + x) / 2.0 end)::double start, (case when nx is null then x + (x - px) / 2.0 else (x + nx) / 2.0 end)::double stop from t where (px is not null or nx is not null) and (case when px is null then x - (nx - x) / 2.0 else (px + x) / 2.0 end) <> (case when nx is null then x + (x - px) / 2.0 else (x + nx) / 2.0 end)")
def g10_cotes_from_centers(spark, sf):
    """Dimensions of a row of numbers: ticks half-way between neighbours, the outer ones as far out as in."""
    w = Window.partitionBy("page", "row").orderBy("x", "id")
    t = words(spark, sf).withColumn("row", F.floor(F.col("y") / 2000)).withColumns({"px": F.lag("x").over(w), "nx": F.lead("x").over(w)})
    start = F.when(F.col("px").isNull(), F.col("x") - (F.col("nx") - F.col("x")) / 2).otherwise((F.col("px") + F.col("x")) / 2)
    stop = F.when(F.col("nx").isNull(), F.col("x") + (F.col("x") - F.col("px")) / 2).otherwise((F.col("x") + F.col("nx")) / 2)
    return t.filter("px is not null or nx is not null").select("id", start.alias("start"), stop.alias("stop")).filter("start <> stop")


_RESOLVE = W + ", m as (select type, case when type % 3 = 0 then am * 10 end a, case when type % 4 = 0 then bm * 10 end b, case when type % 5 > 0 then hm * 20 end c from catalogue), r as (select type, coalesce(a, b, c)::double val, case when a is not null then 'COTE' when b is not null then 'SOMME' when c is not null then 'ECHELLE' end how, case when a is not null then coalesce(b, c) when b is not null then c end::double other from m), s as (select *, least(val, other) / greatest(val, other) ratio, abs(val - other) <= greatest(0.02, 0.02 * val) agrees from r) "


@query("g7_resolve_status", _RESOLVE + "select type, how, round(least(case how when 'COTE' then 1.0 when 'SOMME' then 0.95 when 'ECHELLE' then 0.6 else 0.0 end, coalesce(ratio, 1.0)), 2)::double confidence, case when val is null then 'NON_RESOLU' when how = 'ECHELLE' and other is null then 'ESTIME' when other is not null and not agrees then 'A_VERIFIER' else 'OK' end status from s")
def g7_resolve_status(spark, sf):
    """A dimension from the first method that has one, checked against the next; four statuses."""
    d = lambda c: c.cast("double")
    a, b, c = F.when(F.col("type") % 3 == 0, d(F.col("am") * 10)), F.when(F.col("type") % 4 == 0, d(F.col("bm") * 10)), F.when(F.col("type") % 5 > 0, d(F.col("hm") * 20))
    m = gated(spark, sf).select("type", a.alias("a"), b.alias("b"), c.alias("c"))
    how = F.when(F.col("a").isNotNull(), "COTE").when(F.col("b").isNotNull(), "SOMME").when(F.col("c").isNotNull(), "ECHELLE")
    other = F.when(F.col("a").isNotNull(), F.coalesce("b", "c")).when(F.col("b").isNotNull(), F.col("c"))
    r = m.select("type", F.coalesce("a", "b", "c").alias("val"), how.alias("how"), other.alias("other"))
    base = F.when(F.col("how") == "COTE", 1.0).when(F.col("how") == "SOMME", 0.95).when(F.col("how") == "ECHELLE", 0.6).otherwise(0.0)
    ratio = F.when(F.col("other").isNotNull(), F.least("val", "other") / F.greatest("val", "other"))
    agrees = F.abs(F.col("val") - F.col("other")) <= F.greatest(F.lit(0.02), 0.02 * F.col("val"))
    status = F.when(F.col("val").isNull(), "NON_RESOLU").when((F.col("how") == "ECHELLE") & F.col("other").isNull(), "ESTIME").when(F.col("other").isNotNull() & ~agrees, "A_VERIFIER").otherwise("OK")
    return r.select("type", "how", F.round(F.least(base, F.coalesce(ratio, F.lit(1.0))), 2).alias("confidence"), status.alias("status"))


# -- polygons, shapes and walls --------------------------------------------------------------------------------------------

_RINGS = _WORDS + ", v as (select ref, family, x, y, case when ref % 3 = 0 and family = 'view' then 0.2 else 0 end bulge, coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny from words where family in ('view', 'click') window w as (partition by ref, family order by id)), a as (select ref, family, sum(x * ny - nx * y)::double / 2 plain, sum(case when bulge > 0 then {seg} * ((nx - x) * (nx - x) + (ny - y) * (ny - y)) else 0 end) arcs from v group by ref, family having count(*) >= 3) "


def _segment(bulge: float) -> float:
    """Area between chord and arc for a chord of 1: the bulge is the tangent of a quarter of the angle."""
    angle = 4 * math.atan(bulge)
    radius = (1 + bulge * bulge) / (4 * bulge)
    return round(radius * radius / 2 * (angle - math.sin(angle)), 6)


@query("g9_rings_and_arcs", _RINGS.replace("{seg}", str(_segment(0.2))) + "select ref, round(greatest(coalesce(sum(abs(plain + case when plain >= 0 then arcs else -arcs end)) filter (family = 'view'), 0) - coalesce(sum(abs(plain)) filter (family = 'click'), 0), 0), 1) area from a group by ref")
def g9_rings_and_arcs(spark, sf):
    """Outer ring, with arcs that bulge outwards, less its holes; not below 0."""
    w = Window.partitionBy("ref", "family").orderBy("id")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    v = words(spark, sf).filter("family in ('view', 'click')").withColumns({"nx": nxt("x"), "ny": nxt("y")})
    chord2 = (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))
    bulged = (F.col("ref") % 3 == 0) & (F.col("family") == "view")
    seg = F.lit(str(_segment(0.2))).cast("decimal(7,6)")
    a = v.groupBy("ref", "family").agg((F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y")).cast("double") / 2).alias("plain"), F.sum(F.when(bulged, seg * chord2).otherwise(F.lit(0).cast("decimal(38,6)"))).cast("double").alias("arcs"), F.count("*").alias("n")).filter("n >= 3")
    outer = F.sum(F.when(F.col("family") == "view", F.abs(F.col("plain") + F.when(F.col("plain") >= 0, F.col("arcs")).otherwise(-F.col("arcs")))))
    holes = F.sum(F.when(F.col("family") == "click", F.abs("plain")))
    return a.groupBy("ref").agg(F.round(F.greatest(F.coalesce(outer, F.lit(0.0)) - F.coalesce(holes, F.lit(0.0)), F.lit(0.0)), 1).alias("area"))


@query("g11_classify_shapes", W + ", s as (select p_partkey id, p_size * 30 w, p_partkey % 100 * 15 + 10 h, p_partkey % 3 = 0 line, p_partkey * 13 % 2380 y from part), k as (select *, least(w, h) a, greatest(w, h) b from s) select id, case when line then case when b <= 200 then null when a < 150 and b > 400 and y > 1666 then 'LONGRINE' else 'POUTRE' end when w * h < 2500 then null when a * 10 > 7 * b and w * h < 160000 then 'POTEAU' when w * h > 1000000 then 'DALLE' when w * h > 160000 then 'SEMELLE' end family from k")
def g11_classify_shapes(spark, sf):
    """Families of drawn shapes by squareness, area and length; lines in a sheet's lower part are ground beams."""
    k = F.col("p_partkey")
    s = read(spark, sf, "part").select(k.alias("id"), (F.col("p_size") * 30).alias("w"), (k % 100 * 15 + 10).alias("h"), (k % 3 == 0).alias("line"), (k * 13 % 2380).alias("y"))
    a, b, area = F.least("w", "h"), F.greatest("w", "h"), F.col("w") * F.col("h")
    line = F.when(b <= 200, F.lit(None).cast("string")).when((a < 150) & (b > 400) & (F.col("y") > 1666), "LONGRINE").otherwise("POUTRE")
    box = F.when(area < 2500, F.lit(None).cast("string")).when((a * 10 > b * 7) & (area < 160_000), "POTEAU").when(area > 1_000_000, "DALLE").when(area > 160_000, "SEMELLE")
    return s.select("id", F.when(F.col("line"), line).otherwise(box).alias("family"))


@query("g13_prorata", W + ", r as (select project region, inst, qty v, sum(qty) over (partition by project) total, max(qty) over (partition by project) * 3 seg from placements) select region, inst, v, case when abs(total - seg) * 50 <= seg then v::double else (v * seg * 200 + total) // (2 * total) / 100.0 end share from r")
def g13_prorata(spark, sf):
    """Rooms of a shared region at their part of its area, unless they already fill it within 2 %."""
    totals = placements(spark, sf).groupBy("project").agg(F.sum("qty").alias("total"), (F.max("qty") * 3).alias("seg"))
    r = placements(spark, sf).select(F.col("project"), "inst", F.col("qty").alias("v")).join(totals, "project")
    share = F.when(F.abs(F.col("total") - F.col("seg")) * 50 <= F.col("seg"), F.col("v").cast("double")).otherwise(F.expr("(v * seg * 200 + total) div (2 * total)") / 100)
    return r.select(F.col("project").alias("region"), "inst", "v", share.alias("share"))


_FACES = _BOXES + ", s as (select id, id % 2 = 0 flat, case when id % 2 = 0 then x0 else y0 end lo, case when id % 2 = 0 then x1 else y1 end hi, case when id % 2 = 0 then y0 else x0 end pos from box) "


@query("g17_face_pairs", _FACES + "select a.id, b.id other, abs(a.pos - b.pos) apart from s a join s b on a.id < b.id and a.flat = b.flat and abs(a.pos - b.pos) between 8 and 40 and 2 * (least(a.hi, b.hi) - greatest(a.lo, b.lo)) >= least(a.hi - a.lo, b.hi - b.lo)")
def g17_face_pairs(spark, sf):
    """Parallel faces of a wall: apart by its possible thickness, and beside each other along half of the shorter."""
    flat = F.col("id") % 2 == 0
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    s = label_boxes(spark, sf).select("id", flat.alias("flat"), pick("x0", "y0").alias("lo"), pick("x1", "y1").alias("hi"), pick("y0", "x0").alias("at"))
    return boxes.beside_join(s, ["flat"], 8, 40)


# fixed values: kinds of zones by keyword, the first that is found
ZONE_KINDS = [("legende", r"legende|nomenclature|abreviation"), ("tableau", r"tableau|ferraillage|section"), ("cartouche", r"echelle|indice|maitre|projet"), ("titre_vue", r"fondation|rdc|etage|plan\s+(?:type|coupe|detail)")]


@query("g20_zone_type", "select p_partkey as type, ['tableau', 'legende', 'cartouche', 'titre_vue', 'inconnue'][p_partkey % 5 + 1] zone from part")
def g20_zone_type(spark, sf):
    """A block's kind by the first list of keywords that it has."""
    texts = ["Tableau des poteaux", "LEGENDE du tableau", "Projet - indice B", "Plan coupe R+1", "A-A"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 5 + 1).cast("int"))
    zone = F.lit("inconnue")
    for kind, pattern in reversed(ZONE_KINDS):
        zone = F.when(text.rlike(f"(?i){pattern}"), kind).otherwise(zone)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("type"), zone.alias("zone"))


# -- documents and sheets -----------------------------------------------------------------------------------------------------


@query("s3_signature", "select p_partkey as type, ['PDF', 'PNG', 'JPEG', 'DXF', 'IFC', 'DWG', 'ZIP', 'TEXT', 'EMPTY'][p_partkey % 9 + 1] kind from part")
def s3_signature(spark, sf):
    heads = [b"%PDF-1.7\n", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"  0\r\nSECTION\r\n", b"ISO-10303-21;\n", b"AC1027\x00", b"PK\x03\x04", b"plain words", b""]
    content = F.element_at(F.array(*(F.unhex(F.lit(h.hex())) for h in heads)), (F.col("p_partkey") % 9 + 1).cast("int"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("type"), files.signature(content).alias("kind"))


@query("s20_split_inventory", W + ", f as (select project % 300 ds, case inst % 4 when 0 then 'train' when 1 then 'validation' when 2 then 'test' else 'other' end split from placements) select ds, count(*) filter (split = 'train') train, count(*) filter (split = 'validation') validation, count(*) filter (split = 'test') test, case when count(*) filter (split <> 'other') > 0 then 'valid' else 'incomplete' end status from f group by ds")
def s20_split_inventory(spark, sf):
    """Files of each data set by split, and whether it has any."""
    names = F.array(*map(F.lit, ("train", "validation", "test", "other")))
    path = F.concat(F.lit("/data/"), (F.col("project") % 300).cast("string"), F.lit("/"), F.element_at(names, (F.col("inst") % 4 + 1).cast("int")), F.lit("/a.png"))
    return files.split_inventory(placements(spark, sf).select(path.alias("path"))).select(F.col("dataset").cast("bigint").alias("ds"), "train", "validation", "test", "status")


@query("s22_preflight_score", W + ", s as (select type, a_cm * 10 w, b_cm * 10 h, type % 120 drawings, type % 4 + 1 pages, type % 9 keywords, type % 2 = 0 bars from catalogue), p as (select *, (w > h)::int * 15 + (w > 800 or h > 800)::int * 10 + bars::int * 20 + least(keywords * 8, 45) + (drawings > 50)::int * 15 raw from s) select type, case when drawings > 0 or pages > 1 then greatest(raw, 50) else raw end::int score, case when drawings > 0 or pages > 1 then greatest(raw, 50) else raw end >= 40 validated from p")
def s22_preflight_score(spark, sf):
    c = catalogue(spark, sf)
    w, h, drawings, pages = F.col("a_cm") * 10, F.col("b_cm") * 10, F.col("type") % 120, F.col("type") % 4 + 1
    score = files.preflight_score(w, h, F.col("type") % 2 == 0, F.col("type") % 9, drawings, pages).cast("int")
    return c.select("type", score.alias("score"), (score >= 40).alias("validated"))


@query("s24_doc_profile", W + ", p as (select project doc, inst, qty > 15 vector, row_number() over (partition by project order by inst, type, qty) k from placements) select doc, count(*) pages, case when avg(vector::int) filter (k <= 10) > 0.7 then 'vectoriel' when avg((not vector)::int) filter (k <= 10) > 0.7 then 'scanne' else 'mixte' end kind, ['A0', 'A1', 'A2', 'A3', 'custom_large', 'unknown'][doc % 6 + 1] size from p group by doc")
def s24_doc_profile(spark, sf):
    """Vector, scanned or mixed by a 70 % vote of the first ten pages, and the sheet's format within 10 %."""
    k = F.row_number().over(Window.partitionBy("project").orderBy("inst", "type", "qty"))
    p = placements(spark, sf).select("project", (F.col("qty") > 15).alias("vector"), k.alias("k"))
    vote = F.avg(F.when(F.col("k") <= 10, F.col("vector").cast("int")))
    sides = F.array(*(F.struct(F.lit(float(a)).alias("w"), F.lit(float(b)).alias("h")) for a, b in ((1200, 850), (594, 841), (600, 400), (300, 430), (900, 300), (100, 100))))
    side = F.element_at(sides, (F.col("project") % 6 + 1).cast("int"))
    voted = p.groupBy("project").agg(F.count("*").alias("pages"), vote.alias("v"))
    kind = F.when(F.col("v") > 0.7, "vectoriel").when(1 - F.col("v") > 0.7, "scanne").otherwise("mixte")
    return voted.select(F.col("project").alias("doc"), "pages", kind.alias("kind"), files.sheet_size(side["w"], side["h"]).alias("size"))


@query("k1_certified_sheets", _QLINES + "select '1_avant_metre' sheet, count(*) n from lines union all select '2_nomenclature', 3 * count(*) from rec union all select '3_dqe', 8 union all select '4_controle', 7 union all select '5_audit', (select count(*) from (select id, unnest([case when category = 'autre' then 1 when category = 'semelle' and h1 is null or category in ('poteau', 'voile') and rise is null then 1 end, case when category in ('poutre', 'longrine', 'chainage') and span <= 300 then 1 end, case when category = 'semelle' and h1 is not null and (la not between 150 and 6000 or lb not between 150 and 6000 or h1 + h2 not between 150 and 6000) or category in ('poutre', 'longrine', 'chainage') and (bw not between 100 and 2500 or bh not between 100 and 2500) or category in ('poteau', 'voile') and rise is not null and (bw not between 100 and 3000 or bh not between 100 and 3000 or rise not between 500 and 12000) then 1 end]) c from rec) where c is not null)")
def k1_certified_sheets(spark, sf):
    """Rows of each of the five sheets; sources.sheets writes the sheets themselves."""
    return files.sheet_sizes(certified_sheets(spark, sf))


def certified_sheets(spark, sf):
    from .quantity_queries import a7_ratio_control_all, rebar, x10_priced_bill

    r = records(spark, sf)
    return {"1_avant_metre": Q.quantity_lines(r), "2_nomenclature": rebar(spark, sf), "3_dqe": x10_priced_bill(spark, sf), "4_controle": a7_ratio_control_all(spark, sf), "5_audit": Q.anomalies(r)}


@query("k8_json_dump", W + "select type, to_json({'type': type, 'family': family, 'dims': {'a': a_cm::int, 'b': b_cm::int}, 'spec': [spec]}) as document from catalogue")
def k8_json_dump(spark, sf):
    """One JSON document a type."""
    dims = F.struct(F.col("a_cm").alias("a"), F.col("b_cm").alias("b"))
    return catalogue(spark, sf).select("type", F.to_json(F.struct("type", "family", dims.alias("dims"), F.array("spec").alias("spec"))).alias("document"))


@query("k12_manifest", W + "select family, count(*) n, sha256('{\"family\":\"' || family || '\",\"types\":[' || string_agg(type::varchar, ',' order by type) || ']}') digest from catalogue group by family")
def k12_manifest(spark, sf):
    """The SHA-256 of each family's JSON with sorted keys and types."""
    listed = catalogue(spark, sf).groupBy("family").agg(F.array_sort(F.collect_list("type")).alias("types"))
    return listed.select("family", F.size("types").cast("bigint").alias("n"), F.sha2(F.to_json(F.struct("family", "types")), 256).alias("digest"))


@query("r4_upsert_chunks", W + ", old as (select type id, a_cm::int v from catalogue where type % 3 > 0), new as (select type id, b_cm::int v from catalogue where type % 2 = 0) select coalesce(new.id, old.id) id, coalesce(new.v, old.v) v from old full join new on new.id = old.id")
def r4_upsert_chunks(spark, sf):
    """Chunks put into an index by id, new ones in place of old ones."""
    c = catalogue(spark, sf)
    old, new = c.filter("type % 3 > 0").select(F.col("type").alias("id"), F.col("a_cm").alias("v")), c.filter("type % 2 = 0").select(F.col("type").alias("id"), F.col("b_cm").alias("v"))
    return files.upsert(old, new, ["id"])


_RULES = {p: f"Règle générale : {m}" for p, m in FALLBACK_LEGEND.items()}


@query("r5_rule_fallback", W + ", hits as (select prefix, string_agg(type::varchar, ' | ' order by k) said from (select prefix, type, row_number() over (partition by prefix order by a_cm desc, type) k from catalogue where prefix <> 'V') where k <= 3 group by prefix) select p prefix, coalesce(said, static) answer from (values " + ", ".join(f"('{p}', '{t}')" for p, t in _RULES.items()) + ") v(p, static) left join hits on prefix = p")
def r5_rule_fallback(spark, sf):
    """The best three hits put together, else the static rule of the type."""
    asked = spark.createDataFrame(list(_RULES.items()), "prefix string, static string")
    k = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("a_cm"), "type"))
    best = catalogue(spark, sf).filter("prefix <> 'V'").select("prefix", "type", k.alias("k")).filter("k <= 3")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "type"))), lambda s: s["type"].cast("string")), " | ")
    return asked.join(best.groupBy("prefix").agg(said.alias("said")), "prefix", "left").select("prefix", F.coalesce("said", "static").alias("answer"))
