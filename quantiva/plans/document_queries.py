"""Queries of document sources, inventories, routing and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import parsing as P
from ..sources.files import entries, source_kind
from .carriers import CTE, catalogue, gated, placements, points, read
from .registry import query

W = f"with {CTE} "
_EXTENSIONS = [".dxf", ".DWG", ".pdf", ".png", ".ifc", ""]
_KINDS = ["DXF", "DWG", "PDF_VECTORIEL", "IMAGE", "UNKNOWN", "UNKNOWN"]
SLAB = "0.200"  # metres, of a solid slab


@query("s2_source_kind", f"select p_partkey as type, {_KINDS}[p_partkey % 6 + 1] kind from part")
def s2_source_kind(spark, sf):
    path = F.concat(F.lit("/plans/v1.2/plan_"), F.col("type").cast("string"), F.element_at(F.array(*map(F.lit, _EXTENSIONS)), (F.col("type") % 6 + 1).cast("int")))
    return catalogue(spark, sf).select("type", source_kind(path).alias("kind"))


@query("s15_catalogue_explode", "select event_id, key, cast(json_extract(props, '$.' || key) as int) as value from (select event_id, props, unnest(json_keys(props)) key from events)")
def s15_catalogue_explode(spark, sf):
    e = read(spark, sf, "events").select("event_id", entries(F.from_json("props", "map<string,int>")).alias("e"))
    return e.select("event_id", "e.key", "e.value")


@query("s23_page_route", W + "select type, a_cm % 40 < 15 or (type * 37 % 3000 > 1500 and type * 37 % 3000 > 25 * (a_cm % 40)) vision from catalogue")
def s23_page_route(spark, sf):
    words, vectors = F.col("a_cm") % 40, F.col("type") * 37 % 3000
    return catalogue(spark, sf).select("type", ((words < 15) | (vectors > 1500) & (vectors > 25 * words)).alias("vision"))


@query("p15_explicit_length", W + "select type, case when type % 2 = 1 then nb + 0.5 when a_cm > 25 then a_cm / 100.0 else a_cm end::double metres from catalogue")
def p15_explicit_length(spark, sf):
    text = F.when(F.col("type") % 2 == 1, F.concat(F.lit("3HA12 L="), F.col("nb").cast("string"), F.lit(",50"))).otherwise(F.concat(F.lit("L = "), F.col("a_cm").cast("string")))
    return catalogue(spark, sf).select("type", P.explicit_length(text).alias("metres"))


@query("p18_room_dims", W + "select type, case when ok then l end long_m, case when ok then w end wide_m from (select *, l between 0.5 and 40 and w between 0.5 and 40 ok from (select type, round(case when phi >= 30 then phi / 100.0 else phi end, 3)::double l, round(case when a_cm / 10.0 >= 30 then a_cm / 1000.0 else a_cm / 10.0 end, 3)::double w from catalogue))")
def p18_room_dims(spark, sf):
    text = F.concat(F.col("phi").cast("string"), F.lit(" x "), (F.col("a_cm") / 10).cast("decimal(9,1)").cast("string"))
    dims = P.room_dims(text)
    return catalogue(spark, sf).select("type", F.get(dims, 0).alias("long_m"), F.get(dims, 1).alias("wide_m"))


@query("j3_legend_lookup", W + "select project, inst, coalesce(meaning, 'inconnu') meaning from placements p join catalogue c using (type) left join (values ('S', 'Semelle'), ('P', 'Poteau'), ('N', 'Poutre')) l(prefix, meaning) using (prefix)")
def j3_legend_lookup(spark, sf):
    legend = spark.createDataFrame([("S", "Semelle"), ("P", "Poteau"), ("N", "Poutre")], "prefix string, meaning string")
    known = catalogue(spark, sf).select("type", "prefix").join(legend, "prefix", "left")  # per type, before the placements
    return placements(spark, sf).join(known, "type").select("project", "inst", F.coalesce("meaning", F.lit("inconnu")).alias("meaning"))


_GROUPED = W + ", g as (select a_cm, b_cm, level, count(*) n, arg_min(family, struct_pack(project, inst, family)) family from placements p join catalogue c using (type) group by a_cm, b_cm, level) "


@query("a9_linear_by_type", _GROUPED + "select a_cm::int a_cm, b_cm::int b_cm, level, n, family from g")
def a9_linear_by_type(spark, sf):
    placed = placements(spark, sf).join(catalogue(spark, sf).select("type", "a_cm", "b_cm", "family"), "type")
    return placed.groupBy("a_cm", "b_cm", "level").agg(F.count("*").alias("n"), F.min_by("family", F.struct("project", "inst", "family")).alias("family"))


_VOLUMES = W + ", n as (select type, count(*) n from placements group by type), v as (select type, cast(coalesce(vol * cast(n as decimal(9,0)), 0) as decimal(28,9)) v from catalogue left join n using (type)) "


@query("a10_concrete_volumes", _VOLUMES + "select type, cast(v as decimal(24,4))::double vol_m3 from v union all select null, cast(sum(v) as decimal(24,2))::double from v")
def a10_concrete_volumes(spark, sf):
    n = placements(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    v = gated(spark, sf).join(n, "type", "left").select("type", F.coalesce(K.dec(F.col("vol") * K.dec(F.col("n"), 0, 9), 9, 28), F.lit(0)).alias("v"))
    total = v.agg(K.dec(F.sum("v"), 2, 24).cast("double").alias("vol_m3")).select(F.lit(None).cast("bigint").alias("type"), "vol_m3")
    return v.select("type", K.dec(F.col("v"), 4, 24).cast("double").alias("vol_m3")).unionByName(total)


@query("a12_inventory", W + "select prefix, level, count(*) occurrences, count(distinct type) refs from placements join catalogue using (type) group by prefix, level")
def a12_inventory(spark, sf):
    per = placements(spark, sf).groupBy("type", "level").agg(F.count("*").alias("n"))  # one row per reference and level from here on
    placed = per.join(catalogue(spark, sf).select("type", "prefix"), "type")
    return placed.groupBy("prefix", "level").agg(F.sum("n").alias("occurrences"), F.count("*").alias("refs"))


@query("a26_dedupe_bars", W + "select type, spec || case when nb = 4 and phi = 12 then '' else '+4HA12' end bars from catalogue")
def a26_dedupe_bars(spark, sf):
    groups = F.array_distinct(P.rebar_groups(F.concat("spec", F.lit("+4T12+"), "spec")))
    text = F.transform(groups, lambda g: F.concat(g["nb"].cast("string"), F.lit("HA"), g["phi"].cast("string")))
    return catalogue(spark, sf).select("type", F.array_join(text, "+").alias("bars"))


_SPAN = "cast(hm - am / 2 - bm / 2 as decimal(18,4))"


@query("c4_beam", W + f"select type, greatest({_SPAN}, 0)::double clear_m, {_SPAN} <= 0 anomaly, cast(hm - {SLAB} as decimal(18,3))::double drop_m from catalogue")
def c4_beam(spark, sf):
    span = _span()
    return gated(spark, sf).select("type", F.greatest(span, F.lit(0).cast("decimal(18,4)")).cast("double").alias("clear_m"), (span <= 0).alias("anomaly"), K.dec(F.col("hm") - F.lit(SLAB).cast("decimal(4,3)")).cast("double").alias("drop_m"))


def _span():
    half = F.lit("0.5").cast("decimal(2,1)")
    return K.dec(F.col("hm") - F.col("am") * half - F.col("bm") * half, 4)


@query("q3_anomalies", W + f"select type, 'DIMENSION_NON_LUE' code from catalogue where type % 4 = 0 union all select type, 'GEOM_SPAN_NEGATIVE' from catalogue where {_SPAN} <= 0")
def q3_anomalies(spark, sf):
    codes = F.array_compact(F.array(F.when(F.col("type") % 4 == 0, "DIMENSION_NON_LUE"), F.when(_span() <= 0, "GEOM_SPAN_NEGATIVE")))
    return gated(spark, sf).select("type", F.explode(codes).alias("code"))


@query("j24_missing_rebar", W + "select a_cm::int a_cm, b_cm::int b_cm, min(type) sample from catalogue group by a_cm, b_cm having count(*) filter (phi not in (15, 18)) = 0")
def j24_missing_rebar(spark, sf):
    known = F.count(F.when(K.bar_mass(F.col("phi")).isNotNull(), 1))  # the anti join and the first row of each section in one aggregation
    return catalogue(spark, sf).groupBy("a_cm", "b_cm").agg(F.min("type").alias("sample"), known.alias("k")).filter("k = 0").drop("k")


@query("h9_document_to_records", W + "select family, type, count(*) qty, string_agg(distinct level, ',' order by level) levels from placements join catalogue using (type) group by family, type")
def h9_document_to_records(spark, sf):
    placed = placements(spark, sf).groupBy("type").agg(F.count("*").alias("qty"), F.array_join(F.array_sort(F.collect_set("level")), ",").alias("levels"))
    return placed.join(catalogue(spark, sf).select("type", "family"), "type").select("family", "type", "qty", "levels")


@query("h12_qty_routing", W + "select project, inst, case when src = 'F' then qty end qty_plan, case when src <> 'F' then qty end qty_table from placements")
def h12_qty_routing(spark, sf):
    plan = F.col("src") == "F"
    return placements(spark, sf).select("project", "inst", F.when(plan, F.col("qty")).alias("qty_plan"), F.when(~plan, F.col("qty")).alias("qty_table"))


@query("w8_truncate_repeat", W + ", f as (select ref, page, min(id) i, arg_min(family, id) first from points group by ref, page), c as (select p.ref, p.page, min(p.id) stop from points p join f on f.ref = p.ref and f.page = p.page and family = first and id > i group by p.ref, p.page) select id from points p left join c on c.ref = p.ref and c.page = p.page where stop is null or id < stop")
def w8_truncate_repeat(spark, sf):
    p = points(spark, sf).select("id", "ref", "page", "family")
    # Per group and value the two least ids: enough to know where the first value comes again, whatever the group's size.
    per = p.groupBy("ref", "page", "family").agg(F.min("id").alias("i"))
    first = per.groupBy("ref", "page").agg(F.min(F.struct("i", "family")).alias("f"))
    again = p.join(first, ["ref", "page"]).filter("family = f.family and id > f.i").groupBy("ref", "page").agg(F.min("id").alias("stop"))
    return p.join(again, ["ref", "page"], "left").filter("stop is null or id < stop").select("id")


@query("t3_topk", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 12")
def t3_topk(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)
