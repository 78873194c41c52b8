"""Queries of quantity lines, reinforcement, totals and their controls, over records made of the catalogue's types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import kernels as K
from ..functions import quantities as Q
from ..functions.constants import BAR_MASS, BAR_MASS_ALT, CEILING_HEIGHT, FINISH_LOTS, PRICE_CODES, RATIO_BOUNDS, UNIT_PRICES, VAT_PERCENT
from .carriers import CTE, catalogue, gated, placements, read
from .registry import query

W = f"with {CTE} "
_D = lambda c, scale=3: K.dec(c, scale, 24).cast("double")
CATEGORIES = ["semelle", "poutre", "poteau", "voile", "dalle_pleine", "longrine", "chainage", "autre"]


def records(spark, sf):
    """One record a type: its category, quantity and dimensions in metres; some lack a height, some spans are short."""
    g, t = gated(spark, sf), F.col("type")
    m = lambda c: K.dec(c, 3, 9)
    span = F.when(t % 13 == 0, F.lit("0.250").cast("decimal(9,3)")).otherwise(m(F.col("hm") * 10))
    return g.select(
        t.alias("id"), F.element_at(F.array(*map(F.lit, CATEGORIES)), (t % 8 + 1).cast("int")).alias("category"), F.col("nb").alias("qty"),
        m(F.col("am") * 4).alias("la"), m(F.col("bm") * 4).alias("lb"), F.when(t % 11 != 0, m(F.col("hm"))).alias("h1"),
        F.when(t % 16 == 8, F.lit("0.300").cast("decimal(9,3)")).otherwise(F.lit("0").cast("decimal(9,3)")).alias("h2"), m(F.col("am")).alias("sa"), m(F.col("bm")).alias("sb"),
        span.alias("span"), F.lit("0.300").cast("decimal(9,3)").alias("left"), F.lit("0.300").cast("decimal(9,3)").alias("right"), m(F.col("am")).alias("bw"), m(F.col("hm")).alias("bh"),
        F.when(t % 3 == 0, F.lit("0.200").cast("decimal(9,3)")).alias("slab"), F.when(t % 7 != 0, m(F.col("hm") * 8)).alias("rise"), F.lit("0.150").cast("decimal(9,3)").alias("depth"), F.col("phi"), F.col("nb"),
    )


#: the same records in SQL, in whole millimetres
_MM = (
    W + ", g as (select *, cast(am * 1000 as bigint) ai, cast(bm * 1000 as bigint) bi, cast(hm * 1000 as bigint) hi from catalogue), rec as (select type id, "
    f"{CATEGORIES}[type % 8 + 1] category, nb::bigint qty, nb, phi, ai * 4 la, bi * 4 lb, case when type % 11 <> 0 then hi end h1, case when type % 16 = 8 then 300 else 0 end h2, ai sa, bi sb, "
    "case when type % 13 = 0 then 250 else hi * 10 end span, ai bw, hi bh, case when type % 3 = 0 then 200 else 0 end slab, case when type % 7 <> 0 then hi * 8 end rise from g) "
)
_ROUND = lambda v, unit: f"(({v}) * 2 + {unit}) // (2 * {unit})"  # noqa: E731  (half up, of whole numbers)
_V6 = "(6 * la * lb * h1 + h2 * (la * lb + sa * sb + (la + sa) * (lb + sb)))"
_LINES = (
    _MM + ", lines as (select id, 'B.01' code, 'beton_proprete' category, qty, la + 200 l, lb + 200 w, 100 h, " + _ROUND("qty * (la + 200) * (lb + 200) * 100", "1000000") + " v from rec where category = 'semelle' and h1 is not null "
    f"union all select id, 'B.02', category, qty, la, lb, {_ROUND(_V6, '(6 * la * lb)')}, {_ROUND('qty * ' + _V6, '6000000')} from rec where category = 'semelle' and h1 is not null "
    "union all select id, case category when 'poutre' then 'B.06' else 'B.04' end, category, qty, greatest(span - 300, 0), bw, greatest(bh - slab, 0), " + _ROUND("qty * greatest(span - 300, 0) * bw * greatest(bh - slab, 0)", "1000000") + " from rec where category in ('poutre', 'longrine', 'chainage') "
    "union all select id, case category when 'poteau' then 'B.05' else 'B.07' end, category, qty, rise, bw, bh, " + _ROUND("qty * rise * bw * bh", "1000000") + " from rec where category in ('poteau', 'voile') and rise is not null "
    "union all select id, 'B.08', category, qty, la, lb, 150, " + _ROUND("qty * la * lb * 150", "1000000") + " from rec where category = 'dalle_pleine') "
)


@query("c11_quantity_lines", _LINES + "select id, code, category, qty::int number, l / 1000.0 as length, w / 1000.0 as width, h / 1000.0 as height, v / 1000.0 volume from lines")
def c11_quantity_lines(spark, sf):
    metres = [F.col(c).cast("double").alias(c) for c in ("length", "width", "height", "volume")]
    return Q.quantity_lines(records(spark, sf)).select("id", "code", "category", "number", *metres)


@query("c3_footing", _LINES + "select id, code, l / 1000.0 as length, h / 1000.0 as height, v / 1000.0 volume from lines where code in ('B.01', 'B.02')")
def c3_footing(spark, sf):
    r = records(spark, sf).filter("category = 'semelle' and h1 is not null")
    lines = Q.footing_lines(*(F.col(c) for c in ("qty", "la", "lb", "h1", "h2", "sa", "sb")))
    return r.select("id", F.explode(lines).alias("x")).select("id", "x.code", *(F.col(f"x.{c}").cast("double").alias(c) for c in ("length", "height", "volume")))


@query("c6_slab", _LINES + "select id, v / 1000.0 volume from lines where code = 'B.08'")
def c6_slab(spark, sf):
    r = records(spark, sf).filter("category = 'dalle_pleine'")
    return r.select("id", Q.prism_line("dalle_pleine", F.col("qty"), F.col("la"), F.col("lb"), F.col("depth"))["volume"].cast("double").alias("volume"))


@query("x1_line_volume", _LINES + ", f as (select *, " + _ROUND("qty * l * w * h", "1000000") + " j from lines) select id, code, j / 1000.0 cube, v / 1000.0 witness, (j - v) / 1000.0 gap from f")
def x1_line_volume(spark, sf):
    lines = Q.quantity_lines(records(spark, sf))
    cube = K.dec(F.col("number") * K.dec(K.dec(F.col("length"), 3, 9) * K.dec(F.col("width"), 3, 9) * K.dec(F.col("height"), 3, 9), 9, 27), 3, 24)
    return lines.select("id", "code", cube.cast("double").alias("cube"), F.col("volume").cast("double").alias("witness"), K.dec(cube - F.col("volume"), 3, 24).cast("double").alias("gap"))


@query("q3_anomalies_all", _MM + """, a as (select id, case when category = 'autre' then 'CATEGORY_NOT_ROUTED' when category = 'semelle' and h1 is null or category in ('poteau', 'voile') and rise is null then 'DIMENSION_NON_LUE' end c1,
case when category in ('poutre', 'longrine', 'chainage') and span <= 300 then 'GEOM_SPAN_NEGATIVE' end c2,
case when category = 'semelle' and h1 is not null and (la not between 150 and 6000 or lb not between 150 and 6000 or h1 + h2 not between 150 and 6000) or category in ('poutre', 'longrine', 'chainage') and (bw not between 100 and 2500 or bh not between 100 and 2500)
  or category in ('poteau', 'voile') and rise is not null and (bw not between 100 and 3000 or bh not between 100 and 3000 or rise not between 500 and 12000) then 'DIMENSION_UNIT_ERROR' end c3 from rec)
select id, rule_code from (select id, unnest([c1, c2, c3]) rule_code from a) where rule_code is not null""")
def q3_anomalies_all(spark, sf):
    """All four rules, over records of every category."""
    return Q.anomalies(records(spark, sf))


_STEEL = (
    _LINES.rstrip() + ", near as (select *, case phi when 15 then 14 when 18 then 16 else phi end p from rec), "
    "bars as (select id, category, 1 pos, p d, qty, nb::bigint n, span + phi * 30 base, phi from near union all select id, category, 2, 12, qty, 4, span + 360, 12 from near), "
    "dev as (select *, base + greatest((base + 11999) // 12000 - 1, 0) * phi * 50 len from bars), "
    "stir as (select id, category, 3 pos, p d, qty, (span + 149) // 150 + 1 n, 2 * greatest(bw - 50, 50) + 2 * greatest(bh - 50, 50) + 2 * greatest(phi * 10, 80) len, phi from near), "
    f"kgs as (select id, category, pos, d, n, len, cast(qty * n * len * (select kg * 1000 from (values {', '.join(f'({d}, {m})' for d, m in BAR_MASS.items())}) mass(k, kg) where k = d) as bigint) ug from (select id, category, pos, d, qty, n, len from dev union all select id, category, pos, d, qty, n, len from stir)) "
)


def rebar(spark, sf):
    """Three bar rows a record: those of its note, four of 12 mm, and stirrups 15 cm apart."""
    r = records(spark, sf)
    c, twelve, four = F.col, F.lit(12), F.lit(4)
    row = lambda pos, phi, n, length: F.struct(F.lit(pos).alias("pos"), K.nearest_diameter(phi).alias("phi"), n.cast("bigint").alias("bars"), length.alias("length"))
    rows = F.array(
        row(1, c("phi"), c("nb"), K.developed_length(c("phi"), c("span"))),
        row(2, twelve, four, K.developed_length(twelve, c("span"))),
        row(3, c("phi"), K.stirrup_count(c("span"), F.lit("0.15").cast("decimal(3,2)")), K.stirrup_length(c("bw"), c("bh"), c("phi"))),
    )
    flat = r.select("id", "category", "qty", F.explode(rows).alias("x")).select("id", "category", "qty", "x.*")
    return flat.withColumn("kg", Q.bar_weight(c("qty"), c("bars"), c("length"), c("phi")))


@query("c9_rebar_rows", _STEEL + "select id, pos, d::int phi, n::bigint bars, len / 1000.0 as length, ((ug * 2 + 1000) // 2000 / 1000.0)::double kg from kgs")
def c9_rebar_rows(spark, sf):
    return rebar(spark, sf).select("id", "pos", "phi", "bars", F.col("length").cast("double").alias("length"), _D(F.col("kg")).alias("kg"))


@query("c10_weights", _STEEL + "select id, ((sum(ug) filter (pos < 3) * 2 + 10000) // 20000 / 100.0)::double along_kg, ((sum(ug) filter (pos = 3) * 2 + 10000) // 20000 / 100.0)::double stirrups_kg from kgs group by id")
def c10_weights(spark, sf):
    kg = lambda which: _D(F.sum(F.when(which, F.col("kg"))), 2)
    return rebar(spark, sf).groupBy("id").agg(kg(F.col("pos") < 3).alias("along_kg"), kg(F.col("pos") == 3).alias("stirrups_kg"))


_TOTALS = _STEEL + ", v as (select sum(v) b, sum(v) filter (category = 'beton_proprete') p, count(*) n from lines), s as (select sum(ug)::hugeint k from kgs where id in (select id from lines)) "


@query("a4_project_totals", _TOTALS + "select b / 1000.0 concrete, (b - p) / 1000.0 reinforced, p / 1000.0 blinding, ((k * 2 + 100000) // 200000 / 10.0)::double steel, case when b > p then round(k / 1000000.0 / ((b - p) / 1000.0), 1) else 0.0 end::double ratio, n n_lines from v, s")
def a4_project_totals(spark, sf):
    lines, blinding = Q.quantity_lines(records(spark, sf)), F.col("category") == "beton_proprete"
    v = lines.agg(F.sum("volume").alias("b"), F.coalesce(F.sum(F.when(blinding, F.col("volume"))), F.lit(0)).alias("p"), F.count("*").alias("n"))
    k = rebar(spark, sf).join(lines.select("id").distinct(), "id", "left_semi").agg(F.sum("kg").alias("k"))
    firm = F.col("b") - F.col("p")
    ratio = F.when(firm > 0, F.round(F.col("k").cast("double") / firm.cast("double"), 1)).otherwise(0.0)
    return v.join(F.broadcast(k)).select(_D(F.col("b")).alias("concrete"), _D(firm).alias("reinforced"), _D(F.col("p")).alias("blinding"), _D(F.col("k"), 1).alias("steel"), ratio.alias("ratio"), F.col("n").alias("n_lines"))


_CONTROL = _STEEL + ", v as (select category, sum(v) v from lines group by category), s as (select category, sum(ug)::hugeint k from kgs group by category), b as (select * from (values " + ", ".join(f"('{k}', {lo}::double, {hi}::double)" for k, (lo, hi) in RATIO_BOUNDS.items()) + ") x(category, lo, hi)), r as (select category, lo, hi, coalesce(v, 0) v, case when coalesce(v, 0) = 0 then 0.0 else round((coalesce(k, 0) / 1000000.0)::double / (v / 1000.0)::double, 1) end ratio from b left join v using (category) left join s using (category)) "


@query("a7_ratio_control_all", _CONTROL + "select category, v / 1000.0 volume, ratio::double ratio, case when v = 0 then 'NON APPLICABLE' when ratio between lo and hi then 'CONFORME BET MAROC' else 'ALERTE HORS PLAGE RPS 2011' end status from r")
def a7_ratio_control_all(spark, sf):
    """Every control category, those without lines as not applicable."""
    c = control(spark, sf)
    return c.select("category", _D(F.col("v")).alias("volume"), "ratio", Q.ratio_status(F.col("ratio"), F.col("v"), F.col("lo"), F.col("hi"))[0].alias("status"))


@query("x3_ratio_texts", _CONTROL + "select category, case when v = 0 then '-' when ratio < lo then 'Sous-ferraillage ou oubli de barres à vérifier' when ratio > hi then 'Sur-ferraillage ou confusion d''unité (cm/m) à vérifier' else 'Ratio validé' end observation from r")
def x3_ratio_texts(spark, sf):
    c = control(spark, sf)
    return c.select("category", Q.ratio_status(F.col("ratio"), F.col("v"), F.col("lo"), F.col("hi"))[1].alias("observation"))


def control(spark, sf):
    v = Q.quantity_lines(records(spark, sf)).groupBy("category").agg(F.sum("volume").alias("v"))
    k = rebar(spark, sf).groupBy("category").agg(F.sum("kg").alias("k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(24,3)"))
    known = Q.bounds(spark).join(v, "category", "left").join(k, "category", "left").withColumns({"v": zero("v"), "k": zero("k")})
    return known.withColumn("ratio", Q.steel_ratio(F.col("k"), F.col("v")))


_PRICES = "(values " + ", ".join(f"('{k}', {int(v * 100)})" for k, v in UNIT_PRICES.items()) + ") bpu(code, cents)"


@query("x10_priced_bill", _LINES + f"select code, coalesce(sum(v), 0) / 1000.0 volume, cast(coalesce(sum(v), 0) * cents / 100000.0 as decimal(24,2))::double ht from {_PRICES} left join lines using (code) group by code, cents")
def x10_priced_bill(spark, sf):
    """The price list linked to the lines' sheet by price code."""
    prices = spark.createDataFrame([(k, str(v)) for k, v in UNIT_PRICES.items()], "code string, price string").withColumn("price", F.col("price").cast("decimal(10,2)"))
    v = Q.quantity_lines(records(spark, sf)).groupBy("code").agg(F.sum("volume").alias("v"))
    out = prices.join(v, "code", "left").withColumn("v", K.dec(F.coalesce("v", F.lit(0)), 3, 24))
    return out.select("code", _D(F.col("v")).alias("volume"), _D(F.col("v") * F.col("price"), 2).alias("ht"))


@query("c2_unit_variants", W + "select type, case when x > 10 then x / 100.0 else x end::double over10, case when x >= 15 then x / 100.0 else x end::double from15, case when x > 5 then x / 100.0 else x end::double over5, case when x < 3 then x * 100.0 else x end::double cm, x / 1000.0 mm from (select type, type % 40 x from catalogue)")
def c2_unit_variants(spark, sf):
    x = (F.col("type") % 40).cast("double")
    return catalogue(spark, sf).select("type", C.metres_above(x, 10).alias("over10"), F.when(x >= 15, x / 100).otherwise(x).alias("from15"), C.metres_above(x, 5).alias("over5"), F.when(x < 3, x * 100).otherwise(x).alias("cm"), (x / 1000).alias("mm"))


_ROOMS = W + ", rooms as (select p.project, p.inst, p.level, case when p.type % 3 > 0 then am * 10 end d, case when p.type % 3 > 1 then bm * 10 end e, case when p.qty % 4 > 0 then hm * 20 end g, 2 * (am + bm) * 10 peri from placements p join catalogue using (type)), areas as (select *, round(d * e, 2) f from rooms), chosen as (select *, cast(coalesce(f, g, 0) as decimal(18,2)) area from areas) "


def rooms(spark, sf):
    """Rooms with both sides, a segmented area, either or neither; perimeters in metres."""
    types = gated(spark, sf).select("type", "am", "bm", "hm")
    d, e, g = F.when(F.col("type") % 3 > 0, F.col("am") * 10), F.when(F.col("type") % 3 > 1, F.col("bm") * 10), F.when(F.col("qty") % 4 > 0, F.col("hm") * 20)
    area = K.dec(F.coalesce(K.dec(F.round(d * e, 2), 2), K.dec(g, 2), F.lit(0)), 2)
    return placements(spark, sf).join(types, "type").select("project", "inst", "level", area.alias("area"), K.dec(2 * (F.col("am") + F.col("bm")) * 10, 3).alias("perimeter"))


@query("x6_area_choice", _ROOMS + "select level, area::double area, count(*) n from chosen group by level, area")
def x6_area_choice(spark, sf):
    return rooms(spark, sf).groupBy("level", F.col("area").cast("double").alias("area")).agg(F.count("*").alias("n"))


_LOTS = "(values " + ", ".join(f"('{c}', '{base}', {price})" for c, _, base, price in FINISH_LOTS) + ") lots(code, base, price)"


@query("x7_finish_lots", _ROOMS + f", t as (select sum(area) s, sum(cast(peri as decimal(18,3))) p from chosen), q as (select code, price, cast(case base when 'surface' then s when 'perimetre' then p else p * {CEILING_HEIGHT} end as decimal(24,2)) qty from t, {_LOTS}), ht as (select code, qty, cast(qty * price as decimal(28,2)) ht from q) select code, qty::double qty, ht::double ht from ht union all select 'HT', null, sum(ht)::double from ht union all select 'TVA', null, cast(sum(ht) * 0.{VAT_PERCENT} as decimal(28,2))::double from ht union all select 'TTC', null, (sum(ht) + cast(sum(ht) * 0.{VAT_PERCENT} as decimal(28,2)))::double from ht")
def x7_finish_lots(spark, sf):
    total = rooms(spark, sf).agg(F.sum("area").alias("s"), F.sum("perimeter").alias("p"))
    lots = spark.createDataFrame([(c, base, price) for c, _, base, price in FINISH_LOTS], "code string, base string, price int")
    height, rate = F.lit(str(CEILING_HEIGHT)).cast("decimal(4,2)"), F.lit(f"0.{VAT_PERCENT}").cast("decimal(3,2)")
    qty = F.when(F.col("base") == "surface", K.dec(F.col("s"), 3, 24)).when(F.col("base") == "perimetre", K.dec(F.col("p"), 3, 24)).otherwise(K.dec(K.dec(F.col("p"), 3, 24) * height, 3, 24))
    priced = lots.join(F.broadcast(total)).select("code", K.dec(qty, 2, 24).alias("qty"), "price").withColumn("ht", K.dec(F.col("qty") * F.col("price"), 2, 28))
    sums = priced.agg(F.sum("ht").alias("ht")).withColumn("tva", K.dec(K.dec(F.col("ht"), 2, 28) * rate, 2, 28))
    rows = F.array(*(F.struct(F.lit(c).alias("code"), v.cast("double").alias("ht")) for c, v in (("HT", F.col("ht")), ("TVA", F.col("tva")), ("TTC", F.col("ht") + F.col("tva")))))
    ends = sums.select(F.explode(rows).alias("x")).select("x.code", F.lit(None).cast("double").alias("qty"), "x.ht")
    return priced.select("code", F.col("qty").cast("double").alias("qty"), F.col("ht").cast("double").alias("ht")).unionByName(ends)


@query("x8_legacy_bar_length", W + "select type, cast(am * 10 - 0.05 + 34 * phi / 1000.0 as decimal(18,3))::double length from catalogue")
def x8_legacy_bar_length(spark, sf):
    """A footing's bar: the side less the cover, and an anchorage of 34 diameters."""
    thousandth = F.lit("0.001").cast("decimal(4,3)")
    return gated(spark, sf).select("type", _D(F.col("am") * 10 - F.lit("0.05").cast("decimal(3,2)") + K.dec(F.col("phi") * 34, 0) * thousandth).alias("length"))


_ALT = "(values " + ", ".join(f"({d}, {m}::decimal(6,3))" for d, m in BAR_MASS_ALT.items()) + ") alt(d, kg)"


@query("a5_material_balance", W + f", l as (select family, phi, nb, qty, am, coalesce(kg, cast(phi * phi / 162.0 as decimal(9,6))) kg from placements join catalogue using (type) left join {_ALT} on d = phi), w as (select family, phi, sum(cast(kg * nb * (am * 10 + 0.20) as decimal(28,6))) kg from l group by family, phi) select family, phi, cast(sum(kg) as decimal(28,2))::double kg from w group by grouping sets ((family), (phi), ())")
def a5_material_balance(spark, sf):
    """kg by family, by diameter and in all; a diameter without a listed mass has d squared / 162."""
    mass = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in BAR_MASS_ALT.items() for x in kv)), F.col("phi")).cast("decimal(9,6)"), (F.col("phi") * F.col("phi") / 162).cast("decimal(9,6)"))
    per = gated(spark, sf).select("type", "family", "phi", K.dec(mass * F.col("nb") * (F.col("am") * 10 + F.lit("0.20").cast("decimal(3,2)")), 6, 28).alias("kg"))
    n = placements(spark, sf).groupBy("type").count()
    weighed = per.join(n, "type").select("family", "phi", K.dec(F.col("kg") * F.col("count"), 6, 28).alias("kg"))
    return weighed.groupingSets([["family"], ["phi"], []], "family", "phi").agg(_D(F.sum("kg"), 2).alias("kg"))


@query("a11_steel_by_family", W + f", m as (select * from {_ALT}), b as (select family, unnest([phi, 12]) p, unnest([nb, 4]) n from catalogue) select family, cast(sum(n * 6 * kg) as decimal(18,2))::double kg from b join m on d = p group by family")
def a11_steel_by_family(spark, sf):
    """Bars of two layers at a default length of 6 m, known diameters only."""
    layer = lambda n, p: F.struct(n.alias("n"), p.alias("p"))
    bars = catalogue(spark, sf).select("family", F.explode(F.array(layer(F.col("nb"), F.col("phi")), layer(F.lit(4), F.lit(12)))).alias("b")).select("family", "b.*")
    mass = F.element_at(F.create_map(*(F.lit(x) for kv in BAR_MASS_ALT.items() for x in kv)), F.col("p")).cast("decimal(6,3)")
    return bars.filter(mass.isNotNull()).groupBy("family").agg(_D(F.sum(F.col("n") * 6 * mass), 2).alias("kg"))


@query("c21_earthworks", W + "select type, cast((am * 4 + 0.40) * (bm * 4 + 0.40) * 1.50 as decimal(18,3))::double dug, cast((am * 4 + 0.40) * (bm * 4 + 0.40) * 1.50 - am * 4 * bm * 4 * hm as decimal(18,3))::double filled from catalogue")
def c21_earthworks(spark, sf):
    """A footing's pit, 20 cm wider on each side and 1.50 m deep, and what is filled in again."""
    wide, deep = F.lit("0.40").cast("decimal(3,2)"), F.lit("1.50").cast("decimal(3,2)")
    side = lambda c: K.dec(F.col(c) * 4, 3, 9)
    pit = K.dec((side("am") + wide) * (side("bm") + wide) * deep, 9, 27)
    return gated(spark, sf).select("type", _D(pit).alias("dug"), _D(pit - K.dec(side("am") * side("bm") * K.dec(F.col("hm"), 3, 9), 9, 27)).alias("filled"))


@query("c15_pipeline_quantities", W + f""", q as (select type, family, cast(am * 1000 as bigint) a, cast(bm * 1000 as bigint) b, case when type % 9 <> 0 then cast(hm * 1000 as bigint) end l from catalogue)
select type, case when family in ('poutre', 'longrine', 'chainage') then case when l is null then 'manquant_longueur' else 'complet' end when l is null then 'manquant' else 'complet' end status,
{_ROUND('a * b * l', '100000')} / 10000.0 volume, case when family <> 'voile' then {_ROUND('2 * (a + b) * l', '100')} / 10000.0 end formwork from q""")
def c15_pipeline_quantities(spark, sf):
    """Volume, formwork 2(a+b)l and status by family; a beam without a length says so, a wall has no such formwork."""
    g = gated(spark, sf).withColumn("l", F.when(F.col("type") % 9 != 0, F.col("hm")))
    beam, wall = F.col("family").rlike("poutre|longrine|chainage|linteau"), F.col("family").rlike("voile|mur")
    status = F.when(F.col("l").isNotNull(), "complet").when(beam, "manquant_longueur").otherwise("manquant")
    formwork = F.when(~wall, K.dec(2 * K.dec((K.dec(F.col("am"), 3, 9) + K.dec(F.col("bm"), 3, 9)) * K.dec(F.col("l"), 3, 9), 6, 20), 4))
    return g.select("type", status.alias("status"), K.dec(K.volume(F.col("am"), F.col("bm"), F.col("l")), 4).cast("double").alias("volume"), formwork.cast("double").alias("formwork"))
