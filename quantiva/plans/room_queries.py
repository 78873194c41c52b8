"""Queries of walls, rooms and regions of plans; a supplier's or a customer's rows are one sheet of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import geodesic, rays, regions, room_names, surfaces, walls
from .carriers import read
from .registry import query


def dotted_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a dotted wall on its customer's sheet: marks in steps of 6 to 9 px with some scatter, a door in some."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    upright = F.col("o_orderpriority") < "3"
    j = F.explode(F.sequence(F.lit(0), (5 + k % 15).cast("int")))
    along = F.col("j") * (6 + k % 4) + F.when((F.col("o_orderstatus") == "F") & (F.col("j") > 6), 60).otherwise(0)
    across = ((k * 31 + F.col("j") * 17) % 9 - 4) / 10
    dots = o.withColumn("j", j).withColumns({"along": along, "across": across})
    x = k * 37 % 500 + F.when(upright, F.col("across")).otherwise(F.col("along"))
    y = k * 53 % 300 + F.when(upright, F.col("along")).otherwise(F.col("across"))
    return dots.select(F.col("o_custkey").alias("sheet"), (k * 32 + F.col("j")).alias("id"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(2.0).alias("w"), F.lit(3.0).alias("h"), F.lit(2.0).alias("t"))


@query("g16_dotted_walls")
def g16_dotted_walls(spark, sf):
    """Walls fitted to dots by random samples (seed 42) and singular values, which SQL can't express."""
    return walls.dotted_walls(dotted_marks(spark, sf))


_ROOMS = """with recursive walls as (select l_suppkey sheet, l_partkey * 37 % 400 x0, l_orderkey * 53 % 300 y0, case when l_linenumber % 2 = 1 then l_partkey * 37 % 400 + 2 else least(399, l_partkey * 37 % 400 + 20 + l_quantity::bigint * 3) end x1, case when l_linenumber % 2 = 1 then least(299, l_orderkey * 53 % 300 + 20 + l_quantity::bigint * 2) else l_orderkey * 53 % 300 + 2 end y1 from lineitem where l_returnflag = 'N'),
names as (select l_suppkey sheet, l_orderkey * 10000000 + l_partkey * 8 + l_linenumber as label, l_orderkey * 31 % 370 x, l_partkey * 17 % 280 y, 10 + l_quantity::bigint % 20 w, 6 + l_quantity::bigint % 6 h from lineitem where l_returnflag = 'R') """


def plan_walls(spark: SparkSession, sf: str) -> DataFrame:
    """Walls of a supplier's sheet of 400 x 300: upright for odd line numbers, level for even ones."""
    p, o, q, odd = F.col("l_partkey") * 37 % 400, F.col("l_orderkey") * 53 % 300, F.col("l_quantity").cast("bigint"), F.col("l_linenumber") % 2 == 1
    x1 = F.when(odd, p + 2).otherwise(F.least(F.lit(399), p + 20 + q * 3))
    y1 = F.when(odd, F.least(F.lit(299), o + 20 + q * 2)).otherwise(o + 2)
    return read(spark, sf, "lineitem").filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("sheet"), p.alias("x0"), o.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def label_boxes(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    name = (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("label")
    return read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("sheet"), name, (F.col("l_orderkey") * 31 % 370).alias("x"), (F.col("l_partkey") * 17 % 280).alias("y"), (10 + q % 20).alias("w"), (6 + q % 6).alias("h"))


def plan_sheets(spark: SparkSession, sf: str) -> DataFrame:
    size = {"width": 400, "height": 300, "bx": 10, "by": 10, "bw": 380, "bh": 280}
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), *(F.lit(v).alias(k) for k, v in size.items()))


_SIDES = {"left": ("flat", "before"), "right": ("flat", "after"), "up": ("not flat", "before"), "down": ("not flat", "after")}
_OPEN = {"left": ("cx - 10", 228.0), "right": ("390 - cx", 228.0), "up": ("cy - 10", 168.0), "down": ("290 - cy", 168.0)}
_BOXES = _ROOMS + """, pos as (select *, least(greatest(x + w // 2, 1), 398) cx, least(greatest(y + h // 2, 1), 298) cy from names where sheet in (select s_suppkey from supplier)),
rays as (select sheet, label, true flat, cx start, least(greatest(cy + unnest([-h, -((h + 1) // 2), 0, h // 2, h]), 1), 298) probe from pos union all select sheet, label, false, cy, least(greatest(cx + unnest([-w, -((w + 1) // 2), 0, w // 2, w]), 1), 398) from pos),
hits as (select r.sheet, label, flat, probe, min(case when flat and x0 < start then start - least(x1, start - 1) when not flat and y0 < start then start - least(y1, start - 1) end) as before, min(case when flat and x1 > start then greatest(x0, start + 1) - start when not flat and y1 > start then greatest(y0, start + 1) - start end) as after
  from (select *, row_number() over () rn from rays) r join walls v on v.sheet = r.sheet and case when flat then probe between y0 and y1 else probe between x0 and x1 end group by r.sheet, label, flat, probe, rn),
mid as (select sheet, label, """ + ", ".join(f"floor(quantile_cont({c}, 0.5) filter ({w} and {c} > 2))::bigint \"{s}\"" for s, (w, c) in _SIDES.items()) + """ from hits group by sheet, label),
got as (select pos.*, mid."left", mid."right", mid.up, mid.down, """ + ", ".join(f"(\"{s}\" is null or \"{s}\" > {m}) {s}_open, case when \"{s}\" is null or \"{s}\" > {m} then {e} else \"{s}\" end {s}_to" for s, (e, m) in _OPEN.items()) + """ from pos left join mid using (sheet, label)),
sound as (select *, left_to > 2 and right_to > 2 and up_to > 2 and down_to > 2 ok from got) """


@query("h25_room_boxes", _BOXES + "select sheet, label, cx, cy, \"left\", \"right\", up, down, concat_ws(',', case when left_open then 'left' end, case when right_open then 'right' end, case when up_open then 'up' end, case when down_open then 'down' end) open_sides, not (left_open or right_open or up_open or down_open) closed, case when ok then cx - left_to end box_x, case when ok then cy - up_to end box_y, case when ok then left_to + right_to end box_w, case when ok then up_to + down_to end box_h from sound")
def h25_room_boxes(spark, sf):
    """Rooms around their names by five rays a side; open sides are named, and bounded by the envelope."""
    return rays.room_boxes(label_boxes(spark, sf), plan_walls(spark, sf), plan_sheets(spark, sf))


def floor(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A supplier's floor of 160 x 120 cells: its sheets, walls one cell thick, and seeds at the rooms' names."""
    p, o, q, odd = F.col("l_partkey") * 37 % 160, F.col("l_orderkey") * 53 % 120, F.col("l_quantity").cast("bigint"), F.col("l_linenumber") % 2 == 1
    line, far = read(spark, sf, "lineitem").withColumn("sheet", F.col("l_suppkey")), 3 + q % 12
    walls = line.filter("l_returnflag = 'N'").select("sheet", p.alias("x0"), o.alias("y0"), F.when(odd, p).otherwise(p + far).alias("x1"), F.when(odd, o + far).otherwise(o).alias("y1"))
    name = (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("label")
    seeds = line.filter("l_returnflag = 'R'").select("sheet", name, (F.col("l_orderkey") * 31 % 160).alias("x"), (F.col("l_partkey") * 17 % 120).alias("y"))
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("sheet"), F.lit(160).alias("width"), F.lit(120).alias("height")), walls, seeds


@query("g14_geodesic_shares")
def g14_geodesic_shares(spark, sf):
    """Floor space by the name that is nearest by walking around walls; SQL has no shortest paths over grids of this size."""
    return geodesic.partition_shares(*floor(spark, sf))


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments of text on a supplier's sheet of 3000 x 2000; those without a tax have no confidence of their own."""
    line, q = read(spark, sf, "lineitem"), F.col("l_quantity").cast("bigint")
    x, y = F.col("l_orderkey") * 131 % 3000, F.col("l_partkey") * 71 % 2000
    ident = F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 8 + F.col("l_linenumber")
    cent = (100 - F.round(F.col("l_tax") * 100).cast("bigint")) / 100
    return line.select(F.col("l_suppkey").alias("sheet"), ident.alias("id"), F.concat("l_returnflag", "l_partkey").alias("text"), x.alias("x0"), y.alias("y0"), (x + 10 + q).alias("x1"), (y + 8).alias("y1"), cent.alias("confidence"))



@query("g21_fused_fragments")
def g21_fused_fragments(spark, sf):
    """Fragments fused until no two are within 4 of each other; no SQL repeats an aggregate until it is at rest."""
    return regions.fused(fragments(spark, sf))


def region_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Titles on an order's sheet: one for each of its returned lines."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "tableau").when(F.col("l_linenumber") % 3 == 1, "plan").otherwise("detail")
    x, y = F.col("l_partkey") * 37 % 1500, F.col("l_suppkey") * 53 % 1000 + F.col("l_linenumber") * 90
    ident = F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_partkey")
    return read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sheet"), ident.alias("id"), kind.alias("kind"), F.concat(F.lit("titre "), "l_partkey").alias("label"), x.alias("x0"), y.alias("y0"), (x + 60).alias("x1"), (y + 12).alias("y1"))


@query("g19_sheet_regions")
def g19_sheet_regions(spark, sf):
    """Regions around the titles of a sheet, taken one after the other, with the bands between them."""
    sheets = read(spark, sf, "orders").select(F.col("o_orderkey").alias("sheet"), (1700 + F.col("o_custkey") % 3 * 300).alias("width"), F.lit(1684).alias("height"))
    return regions.regions(sheets, region_anchors(spark, sf))


#: words of a sheet with what they are: a room's name (known, or only written like one), a number, or neither
ROOM_WORDS = [
    ("SALON", "known"), ("Chambre 2", "known"), ("MASTER", "known"), ("BATH", "known"), ("2", "number"), (" 13", "number"), ("111", None), ("Échelle 1", None), ("3.50 m", None), ("CUISINE", "known"), ("WC", "known"),
    ("TOTO", "likely"), ("TOTO1", "likely"), ("Toto", None), ("plan salle", None), ("SALLE 4x5", None), ("séjour", "known"), ("A", None), ("ÉTÉ-B", "likely"), ("WALK-IN", "known"), ("--", None), ("CLOSET 111", "known"),
]


def room_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words read on a supplier's sheet of 400 x 300."""
    q, texts = F.col("l_quantity").cast("bigint"), F.array(*(F.lit(t) for t, _ in ROOM_WORDS))
    k = (F.col("l_orderkey") * 7 + F.col("l_partkey") + q) % len(ROOM_WORDS)
    name = F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 8 + F.col("l_linenumber")
    conf = (100 - F.round(F.col("l_tax") * 100).cast("bigint")) / 100
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sheet"), name.alias("id"), F.get(texts, k.cast("int")).alias("text"), (F.col("l_partkey") * 37 % 400).alias("x"), (F.col("l_orderkey") * 53 % 300).alias("y"), (20 + q).alias("w"), (6 + q % 5).alias("h"), conf.alias("conf"))


_KINDS = ", ".join(f"({i}, {repr(t.strip())}, {repr(k) if k else 'null'})" for i, (t, k) in enumerate(ROOM_WORDS))


@query("f2_room_labels", f"with w as (select l_suppkey sheet, l_orderkey * 10000000 + l_partkey * 8 + l_linenumber id, (l_orderkey * 7 + l_partkey + l_quantity::bigint) % {len(ROOM_WORDS)} i, l_partkey * 37 % 400 + (20 + l_quantity::bigint) / 2.0 cx, l_orderkey * 53 % 300 + (6 + l_quantity::bigint % 5) / 2.0 cy from lineitem) select sheet, id, t as text, kind from w join (values {_KINDS}) v(j, t, kind) on i = j where kind is not null and case when kind = 'number' then cx between 10 and 390 and cy between 10 and 290 else cx between 2.4 and 397.6 and cy between 2.4 and 297.6 end")
def f2_room_labels(spark, sf):
    """Words that name a room or number one, within the building and its margin."""
    return room_names.candidates(room_words(spark, sf), plan_sheets(spark, sf)).select("sheet", "id", "text", "kind")


@query("g23_room_names")
def g23_room_names(spark, sf):
    """Stacked lines and numbers put together; each choice depends on those before it, which SQL doesn't express."""
    return room_names.room_names(room_words(spark, sf), plan_sheets(spark, sf))


_STRIP = """with recursive s as (select l_orderkey sheet, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) room, 'r' || l_partkey as name, l_returnflag = 'R' open, l_linestatus = 'O' boxed, 20 + l_quantity::bigint * 4 w, l_quantity::bigint % 2 = 0 stated from lineitem),
p as (select *, sum(w) over (partition by sheet order by room) - w x0, count(*) filter (open) over (partition by sheet) n_open from s),
a as (select *, x0 + w + case when boxed and not open then 15 else 0 end x1, case when open then case when n_open = 1 then round(w / 4.0, 2) end when boxed then round((w + 15) / 4.0, 2) else round(w / 4.0, 2) end::double seg from p),
f as (select sheet, room, open, boxed, w, x1 - x0 wide, seg, seg cur, 0.0::double prev_cut from a where room = 1
  union all select a.sheet, a.room, a.open, a.boxed, a.w, a.x1 - a.x0, a.seg, case when hit and not left_small then round(greatest(0, a.seg - 3.75), 2) else a.seg end, case when hit and left_small then f.cur - round(greatest(0, f.cur - 3.75), 2) else 0 end
  from f join a on a.sheet = f.sheet and a.room = f.room + 1, lateral (select f.cur <= a.seg left_small) l, lateral (select f.boxed and not f.open and f.cur > 0 and a.seg > 0 and 1500 >= 0.15 * 100 * case when left_small then f.wide else a.x1 - a.x0 end hit) h),
g as (select sheet, room, round(seg - cur + coalesce(lead(prev_cut) over (partition by sheet order by room), 0), 2) removed from f) """


def strip_rooms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order's rooms in a row, 100 px high at 20 px a metre: some in one open region, some boxes that reach 15 px too far."""
    at = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    q, open_, boxed = F.col("l_quantity").cast("bigint"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    s = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.row_number().over(at).cast("bigint").alias("room"), F.concat(F.lit("r"), "l_partkey").alias("name"), open_.alias("open"), boxed.alias("boxed"), (20 + q * 4).alias("w"), (q % 2 == 0).alias("stated"))
    s = s.withColumn("x0", F.sum("w").over(Window.partitionBy("sheet").orderBy("room")) - F.col("w"))
    region = F.when(F.col("open"), F.lit(0).cast("bigint")).when(~F.col("boxed"), F.col("room"))
    explicit = F.when(F.col("open") & F.col("stated"), F.col("w") / 4)
    x1 = F.col("x0") + F.col("w") + F.when(F.col("boxed") & ~F.col("open"), 15).otherwise(0)
    rooms = s.select("sheet", "room", "name", region.alias("region"), explicit.alias("explicit"), "x0", F.lit(0).alias("y0"), x1.alias("x1"), F.lit(100).alias("y1"), "w")
    regions_ = rooms.filter("region is not null").groupBy("sheet", "region").agg((F.sum("w") * 100).alias("area_px"))
    return rooms.drop("w"), regions_, read(spark, sf, "orders").select(F.col("o_orderkey").alias("sheet"), F.lit(20.0).alias("scale")).distinct()


@query("g13_room_surfaces", _STRIP + "select sheet, room, name, case when open and stated then 'dimensions' when open and n_open = 1 then 'region' when open then 'none' when boxed then 'box' else 'region' end source, case when open and stated then (w / 4.0)::double else seg - removed end area, removed::double removed from (select a.*, coalesce(g.removed, 0) removed from a join g using (sheet, room)) where sheet in (select o_orderkey from orders) union all select sheet, null, 'ZONE OUVERTE (' || string_agg(upper(name), ' + ' order by room) || ')', 'zone', (sum(w) - sum(case when stated then w else 0 end)) / 4.0, 0 from a where open and n_open > 1 and sheet in (select o_orderkey from orders) group by sheet having count(*) filter (not stated) > 0 and sum(w) - sum(case when stated then w else 0 end) >= 2")
def g13_room_surfaces(spark, sf):
    """Areas of rooms with overlaps given up by the smaller and the rest of shared regions as open zones."""
    return surfaces.room_surfaces(*strip_rooms(spark, sf))
