"""Queries of document tests, table layouts, flat lists, reports of the alternative engine, and merged scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import labels as L
from ..functions import parsing as P
from ..functions.constants import BAR_MASS_ALT
from ..operators import ordered
from .carriers import CTE, catalogue, gated, placements
from .cases import cases
from .matching_queries import _WORDS, words
from .registry import query

W = f"with {CTE} "


@query("f7_placeholder", W + "select project, count(*) filter (qty % 5 > 0 and type % 3 > 0) = 0 placeholder from placements group by project")
def f7_placeholder(spark, sf):
    """Documents whose catalogue has nothing but default geometry."""
    real = (F.col("qty") % 5 > 0) & (F.col("type") % 3 > 0)
    return placements(spark, sf).groupBy("project").agg((F.count_if(real) == 0).alias("placeholder"))


@query("f8_empty_catalogue", W + "select f family, count(type) n, count(type) = 0 refused from (values ('semelle'), ('poteau'), ('poutre'), ('longrine'), ('chainage'), ('voile'), ('radier')) v(f) left join catalogue on family = f and hm > 0 group by f")
def f8_empty_catalogue(spark, sf):
    """Families without a usable entry, which are refused rather than taken as empty."""
    asked = spark.createDataFrame([(f,) for f in ("semelle", "poteau", "poutre", "longrine", "chainage", "voile", "radier")], "family string")
    n = gated(spark, sf).filter("hm > 0").groupBy("family").agg(F.count("*").alias("n"))
    return asked.join(n, "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("refused"))


_FLAGS = _WORDS + ", near as (select distinct a.id from words a join words b on a.page = b.page and a.family <> b.family and abs(a.x - b.x) < 300 and abs(a.y - b.y) < 100) "


@query("f10_ambiguous", _FLAGS + "select w.id, concat_ws(',', case when ref % 4 = 0 then 'sans_dimensions' end, case when x > 7500 and y > 69120 then 'cartouche' end, case when ref % 10 = 0 then 'suffixe_all' end, case when near.id is not null then 'proche_autre_prefixe' end) flags from words w left join near on near.id = w.id")
def f10_ambiguous(spark, sf):
    """All reasons for which a label is ambiguous; the last one needs a word of another family nearby."""
    w = words(spark, sf)
    cell = w.withColumns({"cx": F.floor(F.col("x") / 300), "cy": F.floor(F.col("y") / 100)})
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    other = cell.select("page", F.col("family").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"), around("cx").alias("cx"), "cy").withColumn("cy", around("cy"))
    met = cell.join(other, ["page", "cx", "cy"]).filter("family <> f2 and abs(x - x2) < 300 and abs(y - y2) < 100").select("id").distinct().withColumn("near", F.lit(True))
    said = F.array(F.when(F.col("ref") % 4 == 0, "sans_dimensions"), F.when((F.col("x") > 7500) & (F.col("y") > 69_120), "cartouche"), F.when(F.col("ref") % 10 == 0, "suffixe_all"), F.when(F.col("near"), "proche_autre_prefixe"))
    return w.join(met, "id", "left").select("id", F.array_join(F.array_compact(said), ",").alias("flags"))


_K = "decimal(9,3)"
_ALT_MASS = "(values " + ", ".join(f"({d}, {m}::{_K})" for d, m in BAR_MASS_ALT.items()) + ") alt(d, kg)"


@query("c13_alt_project", W + f", m as (select family, cast(am * 4 as {_K}) a, cast(bm * 4 as {_K}) b, cast(hm as {_K}) h, cast(am as {_K}) s, cast(bm as {_K}) t from catalogue where family in ('semelle', 'poteau')), "
    f"e as (select family, case family when 'semelle' then cast(a * b * h as decimal(18,6)) else cast(s * t * 3 as decimal(18,6)) end v, case family when 'semelle' then cast(0.888 * 8 * (a - 0.05 + 0.840) + 0.888 * 8 * (b - 0.05 + 0.840) as decimal(18,6)) else cast(1.210 * 8 * (3 + 0.952) + 0.222 * 22 * (2 * (s + t) - 0.05 + 0.123) as decimal(18,6)) end kg from m) select family, cast(sum(v) as decimal(24,3))::double volume, cast(sum(kg) as decimal(24,2))::double kg from e group by rollup(family)")
def c13_alt_project(spark, sf):
    """Footings with two layers of 8HA12 and columns of 3 m with 8HA14 and stirrups of 6 at 15 cm: volumes and steel by
    family and in all. Anchorage is 34, lap 36 and stirrup hooks are 20.5 diameters, the cover is 5 cm."""
    d = lambda v: F.lit(v).cast(_K)
    a, b, h, s, t = (c.cast(_K) for c in (F.col("am") * 4, F.col("bm") * 4, F.col("hm"), F.col("am"), F.col("bm")))
    footing = d("0.888") * 8 * (a - d("0.05") + d("0.840")) + d("0.888") * 8 * (b - d("0.05") + d("0.840"))
    column = d("1.210") * 8 * (3 + d("0.952")) + d("0.222") * 22 * (2 * (s + t) - d("0.05") + d("0.123"))
    base = F.col("family") == "semelle"
    six = lambda c: c.cast("decimal(18,6)")
    e = gated(spark, sf).filter("family in ('semelle', 'poteau')").select("family", F.when(base, six(a * b * h)).otherwise(six(s * t * 3)).alias("v"), F.when(base, six(footing)).otherwise(six(column)).alias("kg"))
    return e.rollup("family").agg(F.sum("v").cast("decimal(24,3)").cast("double").alias("volume"), F.sum("kg").cast("decimal(24,2)").cast("double").alias("kg"))


@query("c16_pipeline_steel", W + f", b as (select type, unnest([nb, 4]) n, unnest([phi, 12]) p, hm from catalogue) select type, cast(sum(n * kg * hm * 10) as decimal(18,2))::double kg from b join {_ALT_MASS} on d = p group by type")
def c16_pipeline_steel(spark, sf):
    """kg of the groups of a note such as 8HA12+4T12 over the length; unknown diameters weigh nothing."""
    mass = F.element_at(F.create_map(*(F.lit(x) for kv in BAR_MASS_ALT.items() for x in kv)), F.col("g.phi")).cast(_K)
    rows = gated(spark, sf).select("type", "hm", F.explode(P.rebar_groups(F.concat("spec", F.lit("+4T12")))).alias("g")).filter(mass.isNotNull())
    return rows.groupBy("type").agg(F.sum((F.col("g.nb") * mass * F.col("hm") * 10).cast("decimal(18,6)")).cast("decimal(18,2)").cast("double").alias("kg"))


@query("c17_grid_extent", W + "select project, max(pos) - min(pos) extent from (select project, sum(qty) over (partition by project order by inst, type, qty rows unbounded preceding)::bigint pos from placements) group by project")
def c17_grid_extent(spark, sf):
    """The extent of a plan's axes, which that pipeline takes for the length of each beam."""
    w = Window.partitionBy("project").orderBy("inst", "type", "qty").rowsBetween(Window.unboundedPreceding, 0)
    return placements(spark, sf).select("project", F.sum("qty").over(w).alias("pos")).groupBy("project").agg((F.max("pos") - F.min("pos")).alias("extent"))


@query("h4_table_layouts", W + "select type, level, a_cm || 'x' || b_cm section, nb || 'HA' || phi bars from catalogue, (values ('RDC'), ('R+1')) v(level)")
def h4_table_layouts(spark, sf):
    """Column tables with references across or down, cells of several lines: the same rows from either."""
    cell = F.concat("a_cm", F.lit("x"), "b_cm", F.lit("\n"), "spec")
    across = catalogue(spark, sf).filter("type % 2 = 0").select("type", cell.alias("RDC"), cell.alias("R+1")).unpivot("type", ["RDC", "R+1"], "level", "cell")
    down = catalogue(spark, sf).filter("type % 2 = 1").select("type", F.explode(F.map_from_arrays(F.array(F.lit("RDC"), F.lit("R+1")), F.array(cell, cell))).alias("level", "cell"))
    lines = F.split("cell", "\n")
    return across.unionByName(down).select("type", "level", F.get(lines, 0).alias("section"), F.get(lines, 1).alias("bars"))


cases("h5_footing_rows", [("S1 110x110x25 8HA12 8HA12", "S1", "1.1x1.1x0.25", 2), ("S2 | 90x90 | 6T10", "S2", "0.9x0.9", 1), ("S3 1.2x1.4x0.3", "S3", "1.2x1.4x0.3", 0), ("SF4 45x20 3HA10", "SF4", "0.45x0.2", 1), ("total", None, None, 0), ("", None, None, 0)], {"reference": "varchar", "sides": "varchar", "layers": "int"},
    lambda t: {"reference": L.parse_reference(F.get(F.split(t, r"[\s|]+"), 0))["reference"], "sides": F.array_join(F.transform(C.sides_metres(t, F.lit("auto")), lambda v: v.cast("string")), "x"), "layers": F.size(C.bar_layers(t))})


@query("h11_flat_lists", W + "select family || 's' list, row_number() over (partition by family order by project, inst, type, qty)::bigint k, type, hm::double h from placements join catalogue using (type)")
def h11_flat_lists(spark, sf):
    """A document as flat lists, one a family: numbered placements with their type's height."""
    j = placements(spark, sf).join(gated(spark, sf).select("type", "family", F.col("hm").cast("double").alias("h")), "type")
    numbered = ordered.numbered(j, "family", "project", ["inst", "type", "qty"], "k")
    return numbered.select(F.concat("family", F.lit("s")).alias("list"), "k", "type", "h")


@query("h24_multipass_merge", W + ", n as (select type, count(*) n from placements group by type) select type, coalesce(meaning, 'inconnu') meaning, coalesce(n, 0) n, case when n is null then 'table' when n > 30 then 'table+plan' else 'plan' end source, hm::double span from catalogue left join n using (type) left join (values ('S', 'Semelle'), ('P', 'Poteau'), ('N', 'Poutre')) l(prefix, meaning) using (prefix)")
def h24_multipass_merge(spark, sf):
    """Table rows with their occurrences, the legend's meaning and a span: typed elements."""
    legend = spark.createDataFrame([("S", "Semelle"), ("P", "Poteau"), ("N", "Poutre")], "prefix string, meaning string")
    n = placements(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    j = gated(spark, sf).join(n, "type", "left").join(legend, "prefix", "left")
    source = F.when(F.col("n").isNull(), "table").when(F.col("n") > 30, "table+plan").otherwise("plan")
    return j.select("type", F.coalesce("meaning", F.lit("inconnu")).alias("meaning"), F.coalesce("n", F.lit(0)).alias("n"), source.alias("source"), F.col("hm").cast("double").alias("span"))


@query("s19_dual_scan", _WORDS + ", u as (select *, 1 backend from words where id % 3 < 2 union all select *, 2 from words where id % 3 > 0) select page, x // 100 cx, y // 10 cy, ref, min(id) id, count(distinct backend) backends from u group by 1, 2, 3, 4")
def s19_dual_scan(spark, sf):
    """The words of two text scans, those at one place only once."""
    w = words(spark, sf)
    both = w.filter("id % 3 < 2").withColumn("backend", F.lit(1)).unionByName(w.filter("id % 3 > 0").withColumn("backend", F.lit(2)))
    seen = both.groupBy("page", F.floor(F.col("x") / 100).alias("cx"), F.floor(F.col("y") / 10).alias("cy"), "ref").agg(F.min("id").alias("id"), (F.max("backend") - F.min("backend") + 1).cast("bigint").alias("backends"))
    return seen


cases("s14_schedule_fallback", [("P1: 25x35, 6T12, cad 6 e=15", "P1", "0.25x0.35", "6T12", 0.15), ("N2 - 20x40 - 3HA14+2T12", "N2", "0.2x0.4", "3T14|2T12", None), ("S1 90x90x25 8T10 e=20", "S1", "0.9x0.9x0.25", "8T10", None), ("note", None, None, "", None), ("", None, None, "", None)], {"reference": "varchar", "sides": "varchar", "bars": "varchar", "spacing": "double"},
    lambda t: {"reference": L.parse_reference(F.regexp_extract(t, r"^([A-Za-z]+[0-9]+)", 1))["reference"], "sides": F.array_join(F.transform(C.sides_metres(t, F.lit("auto")), lambda v: v.cast("string")), "x"), "bars": F.array_join(F.transform(C.bar_layers(t), lambda g: F.concat(g["nb"].cast("string"), F.lit("T"), g["phi"].cast("string"))), "|"), "spacing": C.stirrup_cell(t)[1]})


@query("p36_standard_dict", W + "select type, to_json({'family': upper(family), 'reference': prefix || '-DXF-' || type, 'source': 'dxf', 'page': 1}) as element from catalogue")
def p36_standard_dict(spark, sf):
    """An element of a drawing file in the form that all sources share."""
    ref = F.concat("prefix", F.lit("-DXF-"), "type")
    return catalogue(spark, sf).select("type", F.to_json(F.struct(F.upper("family").alias("family"), ref.alias("reference"), F.lit("dxf").alias("source"), F.lit(1).alias("page"))).alias("element"))


@query("g12_scale_decision", _WORDS + ", e as (select ref, y * 1.0 - lag(y) over w dy, x - lag(x) over w dx, page = lag(page) over w same from words window w as (partition by ref order by page, id)), r as (select ref, dy / dx::double est from e where same and dx > 5 and dy > 0) select ref, count(*) n, round(median(est), 3) scale, case when count(*) < 2 then 'insuffisant' when max(est) - min(est) <= 0.15 * median(est) then 'fiable' else 'disperse' end decision from r group by ref")
def g12_scale_decision(spark, sf):
    """The scale of each chain as the median of its steps, and whether they agree within 15 %."""
    w = Window.partitionBy("ref").orderBy("page", "id")
    e = words(spark, sf).select("ref", (F.col("y") - F.lag("y").over(w)).alias("dy"), (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("page") == F.lag("page").over(w)).alias("same"))
    r = e.filter("same and dx > 5 and dy > 0").select("ref", (F.col("dy") / F.col("dx")).alias("est"))
    g = r.groupBy("ref").agg(F.count("*").alias("n"), F.percentile("est", 0.5).alias("m"), (F.max("est") - F.min("est")).alias("wide"))
    decision = F.when(F.col("n") < 2, "insuffisant").when(F.col("wide") <= 0.15 * F.col("m"), "fiable").otherwise("disperse")
    return g.select("ref", "n", F.round("m", 3).alias("scale"), decision.alias("decision"))
