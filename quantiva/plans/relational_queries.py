"""Queries of joins, aggregations, pivots, set operations and rules on placements, catalogue and records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.constants import BAR_MASS, PRICE_CODES, RATIO_BOUNDS, UNIT_PRICES, VAT_PERCENT
from ..operators import packing, records
from .carriers import CTE, catalogue, gated, placements, read
from .registry import query

W = f"with {CTE} "
_D = lambda c, scale=3: K.dec(c, scale, 24).cast("double")
_CODES = {k: v for k, v in PRICE_CODES.items() if k in ("semelle", "longrine", "chainage", "poteau", "poutre", "voile")}
_SQL_CODE = "case family " + " ".join(f"when '{k}' then '{v}'" for k, v in _CODES.items()) + " end"
_SQL_PRICE = "(values " + ", ".join(f"('{k}', {v}::decimal(10,2))" for k, v in UNIT_PRICES.items()) + ") bpu(code, price)"
_SQL_MASS = "(values " + ", ".join(f"({d}, {m}::decimal(6,3))" for d, m in BAR_MASS.items()) + ") mass(d, kg)"
_SQL_BOUNDS = "(values " + ", ".join(f"('{k}', {lo}::double, {hi}::double)" for k, (lo, hi) in RATIO_BOUNDS.items()) + ") bounds(family, lo, hi)"


def code_of(family):
    return F.element_at(F.create_map(*(F.lit(x) for kv in _CODES.items() for x in kv)), family)


def lines(spark, sf):
    """Placements with their type's volume and bars: a hash join on the type; AQE broadcasts small catalogues."""
    return placements(spark, sf).join(gated(spark, sf).select("type", "family", "vol", "phi", "nb", "am", "bm", "hm"), "type")


def typed(spark, sf):
    """Types with their number of placements ``n`` and summed ``qty``: placements are combined before the join."""
    by_type = placements(spark, sf).groupBy("type").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))
    return by_type.join(gated(spark, sf).select("type", "family", "vol", "phi", "nb", "am", "bm", "hm"), "type")


_LINES = W + ", l as (select p.*, c.family, c.vol, c.phi, c.nb, c.am, c.bm, c.hm from placements p join catalogue c using (type)) "


def bill(spark, sf):
    """Volumes by price code with unit prices, before tax: the priced bill."""
    prices = spark.createDataFrame([(k, v) for k, v in UNIT_PRICES.items()], "code string, price double")
    by_type = placements(spark, sf).groupBy("type").agg(F.sum("qty").alias("qty"))  # combined before the join
    sums = by_type.join(gated(spark, sf), "type").groupBy(code_of(F.col("family")).alias("code")).agg(F.sum(K.dec(F.col("vol") * K.dec(F.col("qty"), 0, 15), 9, 28)).alias("vol"))
    return prices.join(sums, "code", "left").select("code", K.dec(F.coalesce("vol", F.lit(0)), 3, 18).alias("vol"), K.dec(F.col("price"), 2, 10).alias("price"))


_BILL = _LINES + f", b as (select code, cast(coalesce(v, 0) as decimal(18,3)) vol, price from {_SQL_PRICE} left join (select {_SQL_CODE} code, sum(cast(vol * cast(qty as decimal(9,0)) as decimal(28,9))) v from l group by 1) using (code)), a as (select code, vol, cast(vol * price as decimal(24,2)) ht from b) "


@query("a6_dqe", _BILL + f"select code, vol::double vol, ht::double ht from a union all select 'HT', sum(vol)::double, sum(ht)::double from a union all select 'TTC', sum(vol)::double, cast(sum(ht) * 1.{VAT_PERCENT} as decimal(24,2))::double from a")
def a6_dqe(spark, sf):
    priced = bill(spark, sf).select("code", "vol", K.dec(F.col("vol") * F.col("price"), 2, 24).alias("ht"))
    total = priced.agg(F.sum("vol").alias("vol"), F.sum("ht").alias("ht"))
    rate = F.lit(1 + VAT_PERCENT / 100).cast("decimal(4,2)")
    out = lambda d, code, ht: d.select(code.alias("code"), F.col("vol").cast("double").alias("vol"), ht.cast("double").alias("ht"))
    return out(priced, F.col("code"), F.col("ht")).unionByName(out(total, F.lit("HT"), F.col("ht"))).unionByName(out(total, F.lit("TTC"), K.dec(K.dec(F.col("ht"), 2, 24) * rate, 2, 24)))


query("flagship", _BILL + "select code, vol::double vol, ht::double ht from a")(lambda spark, sf: bill(spark, sf).select("code", F.col("vol").cast("double").alias("vol"), K.dec(F.col("vol") * F.col("price"), 2, 24).cast("double").alias("ht")))


@query("j1_placement_catalogue", W + "select project, inst, p.type, coalesce(family, 'inconnu') family, vol::double vol from placements p left join catalogue c on c.type = p.type and p.type % 10 <> 0")
def j1_placement_catalogue(spark, sf):
    known = gated(spark, sf).filter("type % 10 <> 0").select("type", "family", F.col("vol").cast("double").alias("vol"))
    return placements(spark, sf).select("project", "inst", "type").join(known, "type", "left").select("project", "inst", "type", F.coalesce("family", F.lit("inconnu")).alias("family"), "vol")


@query("a3_by_family", _LINES + "select family, cast(sum(cast(vol * cast(qty as decimal(9,0)) as decimal(28,9))) as decimal(24,3))::double vol, sum(qty)::bigint qty from l group by family")
def a3_by_family(spark, sf):
    return typed(spark, sf).groupBy("family").agg(_D(F.sum(K.dec(F.col("vol") * K.dec(F.col("qty"), 0, 15), 9, 28))).alias("vol"), F.sum("qty").alias("qty"))


@query("a3_by_diameter", _LINES + f", m as (select * from {_SQL_MASS}) select phi, sum(nb * qty)::bigint bars, cast(sum(cast(nb * qty * kg as decimal(28,3))) as decimal(24,3))::double kg_per_m from l left join m on m.d = phi group by phi")
def a3_by_diameter(spark, sf):
    kg = K.bar_mass(F.col("phi"))
    return typed(spark, sf).groupBy("phi").agg(F.sum(F.col("nb").cast("bigint") * F.col("qty")).alias("bars"), _D(F.sum(K.dec(F.col("nb") * F.col("qty") * kg, 3, 28))).alias("kg_per_m"))


@query("c9_rebar_schedule", W + f", m as (select * from {_SQL_MASS}) select type, k as pos, n as nb_bars, cast(n * kg * am as decimal(18,3))::double kg from catalogue, (values (0), (1)) v(k), lateral (select case k when 0 then nb else 4 end n, case k when 0 then phi else 12 end d) x join m on m.d = x.d")
def c9_rebar_schedule(spark, sf):
    from ..functions.parsing import rebar_groups

    rows = gated(spark, sf).select("type", "am", F.posexplode(rebar_groups(F.concat("spec", F.lit("+4T12")))).alias("pos", "g"))
    kg = K.bar_mass(F.col("g.phi"))
    return rows.filter(kg.isNotNull()).select("type", "pos", F.col("g.nb").alias("nb_bars"), _D(F.col("g.nb") * kg * F.col("am")).alias("kg"))


@query("a7_ratio_control", _LINES + f", s as (select family, sum(cast(vol * cast(qty as decimal(9,0)) as decimal(28,9))) v, sum(cast(nb * qty * coalesce(kg, 0) * am as decimal(28,6))) k from l left join (select * from {_SQL_MASS}) on d = phi group by family) select family, cast(round(k::double / v::double, 1) as double) ratio, case when k::double / v::double < lo then 'BAS' when k::double / v::double > hi then 'HAUT' else 'OK' end status from s join (select * from {_SQL_BOUNDS}) using (family)")
def a7_ratio_control(spark, sf):
    bounds = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in RATIO_BOUNDS.items()], "family string, lo double, hi double")
    kg = F.coalesce(K.bar_mass(F.col("phi")), F.lit(0).cast("decimal(6,3)"))
    sums = typed(spark, sf).groupBy("family").agg(F.sum(K.dec(F.col("vol") * K.dec(F.col("qty"), 0, 15), 9, 28)).alias("v"), F.sum(K.dec(F.col("nb") * F.col("qty") * kg * F.col("am"), 6, 28)).alias("k"))
    ratio = F.col("k").cast("double") / F.col("v").cast("double")
    return sums.join(bounds, "family").select("family", F.round(ratio, 1).alias("ratio"), F.when(ratio < F.col("lo"), "BAS").when(ratio > F.col("hi"), "HAUT").otherwise("OK").alias("status"))


@query("a8_surface_rollup", _LINES + "select coalesce(level, 'TOTAL') as level, cast(sum(cast(am * bm as decimal(18,6))) as decimal(24,6))::double area, count(*) n from l group by rollup(level)")
def a8_surface_rollup(spark, sf):
    return lines(spark, sf).rollup("level").agg(_D(F.sum(K.dec(F.col("am") * F.col("bm"), 6)), 6).alias("area"), F.count("*").alias("n")).withColumn("level", F.coalesce("level", F.lit("TOTAL")))


_REC = ", rec as (select lpad(cast(p.type % 50 as varchar), 2, '0') as label, p.level, case when engine % 2 = 0 then 'autre' else family end category, engine % 26 axis, case when src = 'F' then qty end qty_plan, case when src = 'O' then qty end qty_table, case when p.project % 3 = 0 then 0 else am end dim, engine % 10 confidence, cast(p.project as bigint) * 10 + inst seq from placements p join catalogue c using (type)) "


def rec(spark, sf):
    base = lines(spark, sf)
    return base.select(
        F.lpad((F.col("type") % 50).cast("string"), 2, "0").alias("label"), "level", F.when(F.col("engine") % 2 == 0, "autre").otherwise(F.col("family")).alias("category"), (F.col("engine") % 26).alias("axis"),
        F.when(F.col("src") == "F", F.col("qty")).alias("qty_plan"), F.when(F.col("src") == "O", F.col("qty")).alias("qty_table"), F.when(F.col("project") % 3 == 0, F.lit(0).cast("decimal(18,3)")).otherwise(F.col("am")).alias("dim"), (F.col("engine") % 10).alias("confidence"), (F.col("project") * 10 + F.col("inst")).alias("seq"),
    )


@query("a1_merge_records", W + _REC + "select upper(level) as level, upper(label) as label, count(distinct axis) n_axes, sum(qty_plan)::bigint qty_plan, arg_min(qty_table, (seq, qty_table)) filter (qty_table is not null) qty_table, max(confidence) confidence from rec group by 1, 2")
def a1_merge_records(spark, sf):
    r = rec(spark, sf)
    merged = records.merge_records(r.withColumn("o", F.struct("seq", F.coalesce("qty_table", F.lit(0)))), "o")
    return merged.select("level", "label", F.size("axes").cast("bigint").alias("n_axes"), "qty_plan", "qty_table", "confidence")


@query("a2_effective_qty", W + _REC + ", m as (select upper(level) as level, upper(label) as label, count(distinct axis) ax, sum(qty_plan) p, max(qty_table) t from rec group by 1, 2) select level, label, case when ax > 0 or coalesce(p, 0) > 0 then greatest(ax, coalesce(p, 0), 1) else coalesce(nullif(t, 0), 1) end::bigint qty from m")
def a2_effective_qty(spark, sf):
    m = rec(spark, sf).groupBy(F.upper("level").alias("level"), F.upper("label").alias("label")).agg(F.count_distinct("axis").alias("ax"), F.sum("qty_plan").alias("p"), F.max("qty_table").alias("t"))
    return m.select("level", "label", records.effective_qty(F.col("ax"), F.col("p"), F.col("t")).cast("bigint").alias("qty"))


@query("j22_plan_table_discrepancy", W + "select coalesce(a.type, b.type) as type, case when b.type is null then 'plan_only' when a.type is null then 'table_only' else 'both' end side from (select distinct type from placements where src = 'F' and qty > 25) a full join (select distinct type from placements where src = 'O' and qty > 25) b on a.type = b.type")
def j22_plan_table_discrepancy(spark, sf):
    p = placements(spark, sf).filter("qty > 25")
    return records.discrepancies(p.filter("src = 'F'"), p.filter("src = 'O'"), ["type"])


@query("j23_orphans", W + "select type from catalogue where not exists (select 1 from placements p where p.type = catalogue.type and qty = 50 and src = 'F')")
def j23_orphans(spark, sf):
    return catalogue(spark, sf).select("type").join(placements(spark, sf).filter("qty = 50 and src = 'F'"), "type", "left_anti")


@query("j25_reconcile_count", W + "select c.type, c.nb::bigint expected, coalesce(n, 0) found, coalesce(n, 0) - c.nb::bigint gap from catalogue c left join (select type, count(*) n from placements group by type) p on p.type = c.type")
def j25_reconcile_count(spark, sf):
    found = placements(spark, sf).groupBy("type").agg(F.count("*").alias("found"))
    return catalogue(spark, sf).select("type", F.col("nb").cast("bigint").alias("expected")).join(found, "type", "left").select("type", "expected", F.coalesce("found", F.lit(0)).alias("found"), (F.coalesce("found", F.lit(0)) - F.col("expected")).alias("gap"))


@query("j26_unanimous_value", W + "select project, min(level) as level from placements group by project having count(distinct level) = 1")
def j26_unanimous_value(spark, sf):
    return placements(spark, sf).groupBy("project").agg(F.min("level").alias("level"), F.max("level").alias("hi")).filter("level = hi").drop("hi")


@query("j11_costing", W + "select project, cast(sum(cast(price * qty as decimal(18,2))) as decimal(18,2))::double total from placements join catalogue using (type) where type % 7 <> 0 group by project")
def j11_costing(spark, sf):
    priced = placements(spark, sf).join(catalogue(spark, sf).filter("type % 7 <> 0").select("type", "price"), "type")
    return priced.groupBy("project").agg(_D(F.sum(K.dec(F.col("price") * F.col("qty"), 2)), 2).alias("total"))


@query("a14_count_by_prefix", W + "select prefix, count(*) n from placements join catalogue using (type) group by prefix")
def a14_count_by_prefix(spark, sf):
    by_type = placements(spark, sf).groupBy("type").count()
    return by_type.join(catalogue(spark, sf).select("type", "prefix"), "type").groupBy("prefix").agg(F.sum("count").alias("n"))


@query("a13_level_summary", _LINES + "select level, family, count(*) n, count(distinct type) refs from l group by level, family")
def a13_level_summary(spark, sf):
    per = lines(spark, sf).groupBy("level", "family", "type").count()
    return per.groupBy("level", "family").agg(F.sum("count").alias("n"), F.count("*").alias("refs"))


@query("a15_coverage", W + "select count(distinct case when qty > 48 then type end) hit, count(distinct type) of, round(count(distinct case when qty > 48 then type end) * 100.0 / greatest(count(distinct type), 1), 2)::double pct from placements")
def a15_coverage(spark, sf):
    per = placements(spark, sf).groupBy("type").agg(F.max("qty").alias("q")).agg(F.count_if(F.col("q") > 48).alias("hit"), F.count("*").alias("of"))
    return per.select("hit", "of", F.round(F.col("hit") * 100.0 / F.greatest("of", F.lit(1)), 2).alias("pct"))


@query("a16_status_counts", W + "select count(*) filter (qty > 25) complete, count(*) filter (qty <= 25) missing, count(*) filter (qty % 10 = 0) ambiguous from placements")
def a16_status_counts(spark, sf):
    return placements(spark, sf).agg(F.count_if(F.col("qty") > 25).alias("complete"), F.count_if(F.col("qty") <= 25).alias("missing"), F.count_if(F.col("qty") % 10 == 0).alias("ambiguous"))


@query("a18_multi_view", W + "select project, count(distinct level) n_levels, string_agg(distinct level, ',' order by level) as levels from placements group by project having count(distinct level) > 1")
def a18_multi_view(spark, sf):
    seen = placements(spark, sf).groupBy("project").agg(F.array_sort(F.collect_set("level")).alias("s")).filter(F.size("s") > 1)
    return seen.select("project", F.size("s").cast("bigint").alias("n_levels"), F.array_join("s", ",").alias("levels"))


@query("a19_mode", W + "select level, qty as mode_qty from (select level, qty, row_number() over (partition by level order by count(*) desc, min(project * 10 + inst)) r from placements group by level, qty) where r = 1")
def a19_mode(spark, sf):
    per = placements(spark, sf).groupBy("level", "qty").agg(F.count("*").alias("n"), F.min(F.col("project") * 10 + F.col("inst")).alias("first"))
    return per.groupBy("level").agg(F.max_by("qty", F.struct("n", -F.col("first"))).alias("mode_qty"))


@query("a20_majority_vote", W + ", v as (select project, src, count(*) n from placements group by 1, 2) select project, case when count(*) filter (n = m) > 1 then 'INCONNU' else max(case when n = m then src end) end vote from (select *, max(n) over (partition by project) m from v) group by project")
def a20_majority_vote(spark, sf):
    n = placements(spark, sf).groupBy("project").agg(F.count_if(F.col("src") == "F").alias("f"), F.count_if(F.col("src") == "O").alias("o"))
    return n.select("project", F.when(F.col("f") == F.col("o"), "INCONNU").when(F.col("f") > F.col("o"), "F").otherwise("O").alias("vote"))


@query("a21_median_mad", _LINES + ", m as (select family, median(qty) md from l group by family) select family, md::double md, median(abs(qty - md))::double mad from l join m using (family) group by family, md")
def a21_median_mad(spark, sf):
    # by counts of each value, so the hot families shrink before the percentiles
    c = lines(spark, sf).groupBy("family", "qty").count()
    m = c.groupBy("family").agg(F.percentile("qty", 0.5, F.col("count")).alias("md"))
    return c.join(m, "family").groupBy("family", "md").agg(F.percentile(F.abs(F.col("qty") - F.col("md")), 0.5, F.col("count")).alias("mad"))


@query("a22_confusion", "select count(*) filter (p and q) tp, count(*) filter (p and not q) fp, count(*) filter (not p and q) fn from (select length(text) > 2000 p, quality = 1 q from documents join labels using (doc_id))")
def a22_confusion(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.length("text") > 2000).alias("p")).join(read(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("q")), "doc_id")
    return d.agg(F.count_if(F.expr("p and q")).alias("tp"), F.count_if(F.expr("p and not q")).alias("fp"), F.count_if(F.expr("not p and q")).alias("fn"))


@query("a24_bars_needed", _LINES + "select phi, ceil(sum(cast(nb * am * qty as decimal(28,3)))::double / 12)::bigint bars from l group by phi")
def a24_bars_needed(spark, sf):
    return typed(spark, sf).groupBy("phi").agg(F.sum(K.dec(F.col("nb") * F.col("am") * F.col("qty"), 3, 28)).alias("t")).select("phi", F.ceil(F.col("t").cast("double") / 12).alias("bars"))


@query("a31_source_conflict", W + "select type, max(qty) - min(qty) gap from placements group by type having max(qty) - min(qty) >= 1 and count(distinct src) > 1")
def a31_source_conflict(spark, sf):
    g = placements(spark, sf).groupBy("type").agg((F.max("qty") - F.min("qty")).alias("gap"), F.min("src").alias("a"), F.max("src").alias("b"))
    return g.filter("gap >= 1 and a < b").select("type", "gap")


@query("a32_diameters", W + "select string_agg(distinct cast(phi as varchar), ',' order by cast(phi as varchar)) used from catalogue where phi not in (15, 18)")
def a32_diameters(spark, sf):
    return catalogue(spark, sf).filter(K.bar_mass(F.col("phi")).isNotNull()).agg(F.array_join(F.array_sort(F.collect_set(F.col("phi").cast("string"))), ",").alias("used"))


@query("x2_diameter_pivot", _LINES + "select family, " + ", ".join(f"coalesce(sum(nb * qty) filter (phi = {d}), 0)::bigint d{d}" for d in BAR_MASS) + " from l group by family")
def x2_diameter_pivot(spark, sf):
    n = F.col("nb").cast("bigint") * F.col("qty")
    return typed(spark, sf).groupBy("family").agg(*(F.coalesce(F.sum(F.when(F.col("phi") == d, n)), F.lit(0)).alias(f"d{d}") for d in BAR_MASS))


@query("x5_incomplete_total", W + ", v as (select project, level, case when type % 97 = 0 then null else qty end q from placements) select level, project % 100 as lot, case when count(*) filter (q is null) > 0 then null else sum(q)::bigint end total, case when count(*) filter (q is null) > 0 then 'INCOMPLET' else 'OK' end status from v group by 1, 2")
def x5_incomplete_total(spark, sf):
    v = placements(spark, sf).select("level", (F.col("project") % 100).alias("lot"), F.when(F.col("type") % 97 != 0, F.col("qty")).alias("q"))
    total, status = records.poisoned_sum("q")
    return v.groupBy("level", "lot").agg(total.alias("total"), status.alias("status"))


@query("h3_cells_pivot", W + "select project, " + ", ".join(f"max(type) filter (inst = {i}) c{i}" for i in range(1, 5)) + " from placements group by project")
def h3_cells_pivot(spark, sf):
    return placements(spark, sf).groupBy("project").pivot("inst", [1, 2, 3, 4]).agg(F.max("type")).withColumnsRenamed({str(i): f"c{i}" for i in range(1, 5)})


@query("h3_cells_pivot_all", W + "select project, " + ", ".join(f"max(type) filter (inst = {i}) c{i}" for i in range(1, 8)) + ", count(*) - count(distinct inst) filter (inst between 1 and 7) left_out from placements group by project")
def h3_cells_pivot_all(spark, sf):
    """All seven columns; ``left_out`` counts cells that share a row and column with another, of which one has room."""
    cells = placements(spark, sf).groupBy("project", "inst").agg(F.max("type").alias("v"), F.count("*").alias("n"))
    at = [F.max(F.when(F.col("inst") == i, F.col("v"))).alias(f"c{i}") for i in range(1, 8)]
    return cells.groupBy("project").agg(*at, (F.sum("n") - F.count_if(F.col("inst").between(1, 7))).alias("left_out"))


@query("h1_unpivot_transposed", W + "select type, k as dim, v::double val from (select type, am a, bm b, hm h from catalogue) unpivot (v for k in (a, b, h))")
def h1_unpivot_transposed(spark, sf):
    g = gated(spark, sf).select("type", F.col("am").cast("double").alias("a"), F.col("bm").cast("double").alias("b"), F.col("hm").cast("double").alias("h"))
    return g.unpivot("type", ["a", "b", "h"], "dim", "val")


@query("h10_records_to_placements", W + "select type, unnest(range(1, nb + 1))::int inst from catalogue")
def h10_records_to_placements(spark, sf):
    return catalogue(spark, sf).select("type", F.explode(F.sequence(F.lit(1), "nb")).alias("inst"))


@query("u1_set_difference", W + "select type from (select distinct type from placements where src = 'F' and qty < 3) except select type from placements where src = 'O' and qty < 3")
def u1_set_difference(spark, sf):
    p = placements(spark, sf).filter("qty < 3")
    return p.filter("src = 'F'").select("type").subtract(p.filter("src = 'O'").select("type"))


@query("u2_intersect", W + "select type from placements where src = 'F' and qty < 3 intersect select type from placements where src = 'O' and qty < 3")
def u2_intersect(spark, sf):
    p = placements(spark, sf).filter("qty < 3")
    return p.filter("src = 'F'").select("type").intersect(p.filter("src = 'O'").select("type"))


@query("u3_union", W + "select type, 'plan' origin from placements where src = 'F' and qty = 1 union select type, 'table' from placements where src = 'O' and qty = 1")
def u3_union(spark, sf):
    p = placements(spark, sf).filter("qty = 1")
    return p.select("type", F.when(F.col("src") == "F", "plan").otherwise("table").alias("origin")).distinct()


# References of plan and table in their project, over all placements: the data has refs of one side and of both.
_REFS = W + ", f as (select distinct project, type from placements where src = 'F'), o as (select distinct project, type from placements where src = 'O') "


def refs(spark, sf):
    p = placements(spark, sf)
    return tuple(p.filter(F.col("src") == s).select("project", "type") for s in ("F", "O"))


@query("u1_set_difference_all", _REFS + "select *, 'plan_only' side from (select * from f except select * from o) union all select *, 'table_only' from (select * from o except select * from f)")
def u1_set_difference_all(spark, sf):
    plan, table = refs(spark, sf)
    return plan.subtract(table).withColumn("side", F.lit("plan_only")).unionByName(table.subtract(plan).withColumn("side", F.lit("table_only")))


@query("u2_intersect_all", _REFS + "select * from f intersect select * from o")
def u2_intersect_all(spark, sf):
    plan, table = refs(spark, sf)
    return plan.intersect(table)


@query("u3_union_all", _REFS + "select *, 'plan' origin from f union select *, 'table' from o")
def u3_union_all(spark, sf):
    plan, table = refs(spark, sf)
    return plan.withColumn("origin", F.lit("plan")).unionByName(table.withColumn("origin", F.lit("table"))).distinct()


@query("j22_plan_table_discrepancy_all", _REFS + "select project, type, case when b.t is null then 'plan_only' when a.t is null then 'table_only' else 'both' end side from (select *, type t from f) a full join (select *, type t from o) b using (project, type)")
def j22_plan_table_discrepancy_all(spark, sf):
    return records.discrepancies(*refs(spark, sf), ["project", "type"])


@query("j23_orphans_all", W + "select type, 'unplaced' side from catalogue where type not in (select type from placements where type is not null) union all select distinct type, 'unknown' from placements where type not in (select type from catalogue where type is not null)")
def j23_orphans_all(spark, sf):
    """Types of the catalogue that nothing places, and placed types that it lacks."""
    c, p = catalogue(spark, sf).select("type"), placements(spark, sf).select("type").distinct()
    return c.join(p, "type", "left_anti").withColumn("side", F.lit("unplaced")).unionByName(p.join(c, "type", "left_anti").withColumn("side", F.lit("unknown")))


@query("j11_costing_all", W + "select project, cast(sum(cast(price * qty as decimal(18,2))) as decimal(18,2))::double total from placements join catalogue using (type) group by project")
def j11_costing_all(spark, sf):
    priced = placements(spark, sf).join(catalogue(spark, sf).select("type", "price"), "type")
    return priced.groupBy("project").agg(_D(F.sum(K.dec(F.col("price") * F.col("qty"), 2)), 2).alias("total"))


@query("j1_placement_catalogue_all", W + "select project, inst, p.type, coalesce(family, 'inconnu') family, vol::double vol from placements p left join catalogue c on c.type = p.type")
def j1_placement_catalogue_all(spark, sf):
    known = gated(spark, sf).select("type", "family", F.col("vol").cast("double").alias("vol"))
    return placements(spark, sf).select("project", "inst", "type").join(known, "type", "left").select("project", "inst", "type", F.coalesce("family", F.lit("inconnu")).alias("family"), "vol")


@query("t1_family_rank", _LINES + "select family, sum(qty)::bigint qty, row_number() over (order by sum(qty) desc, family)::int pos from l group by family having sum(qty) > 0")
def t1_family_rank(spark, sf):
    # six rows at most reach the window
    s = typed(spark, sf).groupBy("family").agg(F.sum("qty").alias("qty")).filter("qty > 0")
    return s.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("qty"), "family")))


@query("q1_cross_check", W + _REC + "select upper(label) as label, 'CROSS_CHECK_QTY_MISMATCH' rule_code from rec group by 1 having sum(qty_plan) <> sum(qty_table)")
def q1_cross_check(spark, sf):
    g = rec(spark, sf).groupBy(F.upper("label").alias("label")).agg(F.sum("qty_plan").alias("p"), F.sum("qty_table").alias("t"))
    return g.filter("p <> t").select("label", F.lit("CROSS_CHECK_QTY_MISMATCH").alias("rule_code"))


@query("q5_gate", W + "select case when c < 50 then 'BLOQUE' when c < 80 then 'PROVISOIRE' else 'VALIDE' end gate from (select count(distinct type) filter (qty > 25) * 100.0 / greatest(count(distinct type), 1) c from placements)")
def q5_gate(spark, sf):
    per = placements(spark, sf).groupBy("type").agg(F.max("qty").alias("q")).agg((F.count_if(F.col("q") > 25) * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("c"))
    return per.select(F.when(F.col("c") < 50, "BLOQUE").when(F.col("c") < 80, "PROVISOIRE").otherwise("VALIDE").alias("gate"))


@query("q6_uniform_values", W + "select project from placements group by project having count(*) > 3 and count(distinct level) = 1")
def q6_uniform_values(spark, sf):
    g = placements(spark, sf).groupBy("project").agg(F.count("*").alias("n"), F.min("level").alias("a"), F.max("level").alias("b"))
    return g.filter("n > 3 and a = b").select("project")


@query("q8_unused_prefix", W + "select prefix from (values ('S'), ('P'), ('N'), ('LG'), ('CH'), ('V'), ('ZZ')) v(prefix) where prefix not in (select prefix from catalogue)")
def q8_unused_prefix(spark, sf):
    legend = spark.createDataFrame([(p,) for p in ("S", "P", "N", "LG", "CH", "V", "ZZ")], "prefix string")
    return legend.join(catalogue(spark, sf).select("prefix").distinct(), "prefix", "left_anti")


@query("m1_ffd_inputs", _LINES + "select phi, count(*) pieces, sum(cast(hm * 1000 as int))::bigint useful_mm from l group by phi")
def m1_ffd_inputs(spark, sf):
    return typed(spark, sf).groupBy("phi").agg(F.sum("n").alias("pieces"), F.sum((F.col("hm") * 1000).cast("int") * F.col("n")).alias("useful_mm"))


@query("m1_ffd")
def m1_ffd(spark, sf):
    """First-fit decreasing of all pieces of a diameter: bars, useful and waste length, waste share and weight bought."""
    by_type = placements(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    pieces = gated(spark, sf).select("type", "phi", (F.col("hm") * 10_000).cast("int").alias("mm")).join(by_type, "type")
    packed = packing.pack(pieces, ["phi"], "mm", "n")
    metres, bought = lambda c: _D(F.col(c) / 1000, 2), F.col("bars") * 12
    weight = _D(bought * F.coalesce(K.bar_mass(F.col("phi")), F.lit(0).cast("decimal(6,3)")), 2)
    return packed.select("phi", "bars", "useful_mm", "waste_mm", metres("useful_mm").alias("useful_m"), F.round(F.col("waste_mm") / (bought * 1000) * 100, 2).alias("waste_pct"), weight.alias("weight_kg"))


@query("m2_bar_by_bar")
def m2_bar_by_bar(spark, sf):
    """Bars filled one at a time from the longest piece down."""
    by_type = placements(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    pieces = gated(spark, sf).select("type", "phi", (F.col("hm") * 10_000).cast("int").alias("mm")).join(by_type, "type")
    return packing.pack(pieces, ["phi"], "mm", "n", packing.bar_by_bar)


@query("m2_bar_demand", _LINES + "select phi, cast(hm * 10000 as int) mm, count(*) pieces from l where type % 17 > 0 group by 1, 2")
def m2_bar_demand(spark, sf):
    """Pieces asked for by length; types without a known span are left out."""
    by_type = placements(spark, sf).groupBy("type").agg(F.count("*").alias("n"))
    known = gated(spark, sf).filter("type % 17 > 0").select("type", "phi", (F.col("hm") * 10_000).cast("int").alias("mm"))
    return known.join(by_type, "type").groupBy("phi", "mm").agg(F.sum("n").alias("pieces"))
