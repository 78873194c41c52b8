"""Queries that do the whole job of operators of which other queries do a part."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ordered, records, spatial
from .carriers import CTE, catalogue, gated, placements
from .matching_queries import _WORDS, words
from .registry import query

W = f"with {CTE} "


@query("w9_anchor_zones_all", _WORDS + "select id, (lag(y) over w + y) / 2.0 zone_lo, (y + lead(y) over w) / 2.0 zone_hi from words window w as (partition by page, family order by y, id)")
def w9_anchor_zones_all(spark, sf):
    """Zones between the anchors of every family of a page."""
    w = Window.partitionBy("page", "family").orderBy("y", "id")
    z = words(spark, sf).select("id", (F.lag("y").over(w) + F.col("y")).alias("lo"), (F.col("y") + F.lead("y").over(w)).alias("hi"))
    return z.select("id", (F.col("lo") / 2).alias("zone_lo"), (F.col("hi") / 2).alias("zone_hi"))


@query("j10_pair_labels", _WORDS + ", p as (select a.id, b.id dim, b.x - a.x dx from words a join words b on a.page = b.page and a.family = 'view' and b.family = 'click' and abs(a.y - b.y) <= 600 and b.x - a.x between -600 and 14000), f as (select id, arg_min(dim, (dx, dim)) dim, min(dx) dx from p group by id) select id, dim from (select *, row_number() over (partition by dim order by dx, id) k from f) where k = 1")
def j10_pair_labels(spark, sf):
    """A reference and the dimensions beside it on the same line, each the other's best; contested ones go to the nearer."""
    w = words(spark, sf).select("id", "page", "family", "x", "y")
    best = spatial.first_beside(w.filter("family = 'view'"), w.filter("family = 'click'"), ["page"], 600, (-600, 14_000)).withColumnRenamed("r_id", "dim")
    return best.groupBy("dim").agg(F.min(F.struct("dx", "id")).alias("b")).select("b.id", "dim")


_MERGED = (
    W + ", rec as (select p.project * 10 + inst seq, p.level || ' ' as level, ' s' || p.type % 50 || ' ' as label, case when engine % 2 = 0 then 'autre' else family end category, engine % 26 axis, case when src = 'F' then qty end qty_plan, case when src = 'O' then qty end qty_table, case when p.project % 3 > 0 then am end dim, engine % 10 confidence, "
    "[spec, case when inst % 2 = 0 then 'Cad HA8' else spec end] specs, p.type, qty from placements p join catalogue c using (type)), r as (select upper(trim(level)) as level, upper(trim(label)) as label, *  exclude (level, label), (seq, type, qty, engine_) o from (select *, axis engine_ from rec)), "
    "f as (select level, label, arg_min(specs, o) first from r group by 1, 2), e as (select level, label, unnest(specs) s, o from r), later as (select e.level, e.label, count(distinct s) n from e join f on f.level = e.level and f.label = e.label where not list_contains(first, s) group by 1, 2) "
)


@query("a1_merge_records_all", _MERGED + "select r.level, r.label, count(distinct axis) n_axes, sum(qty_plan)::bigint qty_plan, arg_min(qty_table, o) filter (qty_table is not null) qty_table, arg_min(dim, o) filter (dim is not null)::double dim, max(confidence) confidence, coalesce(arg_min(category, o) filter (category <> 'autre'), 'autre') category, (max(len(first)) + coalesce(max(n), 0))::bigint n_specs from r join f on f.level = r.level and f.label = r.label left join later on later.level = r.level and later.label = r.label group by 1, 2")
def a1_merge_records_all(spark, sf):
    """Records of one level and label, trimmed and in any case: all fields merged, and the first record's reinforcement
    notes with those of others that it lacks. Notes are reduced to different ones before they meet."""
    types = gated(spark, sf).select("type", "family", "am", "spec")
    p = placements(spark, sf).join(types, "type")
    note = F.array("spec", F.when(F.col("inst") % 2 == 0, "Cad HA8").otherwise(F.col("spec")))
    r = p.select(
        F.upper(F.trim("level")).alias("level"), F.upper(F.trim(F.concat(F.lit(" s"), (F.col("type") % 50).cast("string"), F.lit(" ")))).alias("label"), F.when(F.col("engine") % 2 == 0, "autre").otherwise(F.col("family")).alias("category"), (F.col("engine") % 26).alias("axis"),
        F.when(F.col("src") == "F", F.col("qty")).alias("qty_plan"), F.when(F.col("src") == "O", F.col("qty")).alias("qty_table"), F.when(F.col("project") % 3 > 0, F.col("am")).alias("dim"), (F.col("engine") % 10).alias("confidence"), note.alias("specs"),
        F.struct((F.col("project") * 10 + F.col("inst")).alias("seq"), "type", "qty", (F.col("engine") % 26).alias("e")).alias("o"),
    )
    merged = records.merge_records(r, "o")
    first = r.groupBy("level", "label").agg(F.min_by("specs", "o").alias("first"))
    notes = r.select("level", "label", F.explode("specs").alias("s")).distinct().groupBy("level", "label").agg(F.collect_set("s").alias("all"))
    n = first.join(notes, ["level", "label"]).select("level", "label", (F.size("first") + F.size(F.array_except("all", "first"))).cast("bigint").alias("n_specs"))
    return merged.join(n, ["level", "label"]).select("level", "label", F.size("axes").cast("bigint").alias("n_axes"), "qty_plan", "qty_table", F.col("dim").cast("double").alias("dim"), "confidence", "category", "n_specs")


@query("a12_inventory_all", W + ", s as (select prefix, level, a_cm || 'x' || b_cm sec, count(*) n, count(distinct type) t from placements join catalogue using (type) group by 1, 2, 3) select prefix, level, sum(n)::bigint occurrences, sum(t)::bigint refs, string_agg(sec || '=' || n, ',' order by sec) sections from s group by prefix, level")
def a12_inventory_all(spark, sf):
    """Occurrences, references and the histogram of sections of each prefix and level."""
    per = placements(spark, sf).groupBy("type", "level").agg(F.count("*").alias("n"))
    placed = per.join(catalogue(spark, sf).select("type", "prefix", F.concat("a_cm", F.lit("x"), "b_cm").alias("sec")), "type")
    sections = placed.groupBy("prefix", "level", "sec").agg(F.sum("n").alias("n"), F.count("*").alias("t"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec", "n"))), lambda x: F.concat(x["sec"], F.lit("="), x["n"].cast("string"))), ",")
    return sections.groupBy("prefix", "level").agg(F.sum("n").alias("occurrences"), F.sum("t").alias("refs"), said.alias("sections"))


_SCORES = W + ", g as (select distinct project, type from placements where qty % 3 > 0), e as (select distinct project, type from placements where qty % 4 > 0), m as (select project, type, family, g.t is not null truth, e.t is not null found from (select *, type t from g) g full join (select *, type t from e) e using (project, type) join catalogue using (type)), "
_SCORES += "c as (select project, family, grouping(project) gp, count(*) filter (truth and found) tp, count(*) filter (found and not truth) fp, count(*) filter (truth and not found) fn from m group by grouping sets ((project), (family), ())), s as (select *, case when tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end::double f1 from c) "


@query("a22_scores", _SCORES + "select coalesce(family, 'ALL') scope, tp, fp, fn, round(case when tp + fn = 0 then 0 else tp / (tp + fn)::double end, 4) recall, round(case when tp + fp = 0 then 0 else tp / (tp + fp)::double end, 4) as precision, round(f1, 4) f1, (select round(avg(f1), 4) from s where gp = 0) plan_mean, (select round(min(f1), 4) from s where gp = 0) plan_min, (select round(max(f1), 4) from s where gp = 0) plan_max, (select round(stddev_pop(f1), 4) from s where gp = 0) plan_std from s where gp = 1")
def a22_scores(spark, sf):
    """Recall, precision and F1 in all and by family, and the F1 of plans: mean, least, most and deviation."""
    p = placements(spark, sf)
    g = p.filter("qty % 3 > 0").select("project", "type").distinct().withColumn("truth", F.lit(True))
    e = p.filter("qty % 4 > 0").select("project", "type").distinct().withColumn("found", F.lit(True))
    m = g.join(e, ["project", "type"], "full").join(catalogue(spark, sf).select("type", "family"), "type")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = [F.count_if(yes("truth") & yes("found")).alias("tp"), F.count_if(yes("found") & ~yes("truth")).alias("fp"), F.count_if(yes("truth") & ~yes("found")).alias("fn")]
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    f1 = share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    plan = m.groupBy("project").agg(*counts).select(f1.alias("f1"))
    plans = plan.agg(*(F.round(f("f1"), 4).alias(f"plan_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))))
    by = m.groupingSets([["family"], []], "family").agg(*counts)
    scored = by.select(F.coalesce("family", F.lit("ALL")).alias("scope"), "tp", "fp", "fn", F.round(share(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("recall"), F.round(share(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), F.round(f1, 4).alias("f1"))
    return scored.join(F.broadcast(plans))  # one row


@query("h9_records_with_axes", W + ", a as (select distinct type, chr(65 + (engine % 26)::int) || '-' || inst axis from placements) select family, a.type, (select count(*) from placements p where p.type = a.type) qty, string_agg(axis, ',' order by axis) axes from a join catalogue using (type) group by family, a.type")
def h9_records_with_axes(spark, sf):
    """A document's types as records: quantity, and the axes of their placements."""
    axis = F.concat(F.char((65 + F.col("engine") % 26).cast("int")), F.lit("-"), F.col("inst").cast("string"))
    per = placements(spark, sf).groupBy("type", axis.alias("axis")).agg(F.count("*").alias("n"))
    placed = per.groupBy("type").agg(F.sum("n").alias("qty"), F.array_join(F.array_sort(F.collect_list("axis")), ",").alias("axes"))
    return placed.join(catalogue(spark, sf).select("type", "family"), "type").select("family", "type", "qty", "axes")


@query("w2_bands_by_reference", _WORDS + ", f as (select *, case when lag(y) over w is null or y - lag(y) over w > 1000 then 1 else 0 end flag from words window w as (partition by ref, page order by y, id)), b as (select *, sum(flag) over (partition by ref, page order by y, id) band from f) select ref, page, band::bigint band, min(y) lo, max(y) hi, count(*) n from b group by 1, 2, 3")
def w2_bands_by_reference(spark, sf):
    """Bands of each reference's words, so that no page of any size is one task."""
    c = ordered.gap_clusters(words(spark, sf), ["ref", "page"], ["y", "id"], F.col("y") - F.col("lag_y") > 1000, "band")
    return c.groupBy("ref", "page", "band").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n"))


@query("k13_view_model", W + ", v as (select family, sum(cast(vol * cast(qty as decimal(9,0)) as decimal(28,9))) v, count(*) n from placements join catalogue using (type) group by family) select family, cast(v as decimal(24,2))::double volume, n, round(100.0 * n / (select sum(n) from v), 1)::double pct, row_number() over (order by v desc, family)::int pos from v")
def k13_view_model(spark, sf):
    """Totals by family as a screen shows them: volume, number, share and rank."""
    by_type = placements(spark, sf).groupBy("type").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))
    v = by_type.join(gated(spark, sf).select("type", "family", "vol"), "type").groupBy("family").agg(F.sum((F.col("vol") * F.col("qty").cast("decimal(15,0)")).cast("decimal(28,9)")).alias("v"), F.sum("n").alias("n"))
    total = v.agg(F.sum("n").alias("all"))
    rank = F.row_number().over(Window.orderBy(F.desc("v"), "family"))  # six rows
    return v.join(F.broadcast(total)).select("family", F.col("v").cast("decimal(24,2)").cast("double").alias("volume"), "n", F.round(100.0 * F.col("n") / F.col("all"), 1).alias("pct"), rank.alias("pos"))


_ALT = "cast(34 * phi / 1000.0 as decimal(9,3))"


@query("c12_alt_lengths", W + f"select type, cast(am * 4 - 0.05 + {_ALT} as decimal(18,3))::double layer, cast(2 * (am + bm) - 0.05 + cast(20.5 * phi / 1000 as decimal(18,4)) as decimal(18,4))::double stirrup, cast(am - 0.05 + 22 * phi / 1000.0 as decimal(18,3))::double pin, ((hm * 10000)::bigint + 149) // 150 + 2 stirrups, ((am * 4000)::bigint + 149) // 150 + 1 bars from catalogue")
def c12_alt_lengths(spark, sf):
    """The alternative engine: layer, stirrup and pin lengths with 34, 20.5 and 22 diameters, and numbers at 15 cm."""
    d = lambda v, s=3: F.lit(v).cast(f"decimal(9,{s})")
    phi = F.col("phi").cast("decimal(9,0)") * d("0.001")
    up = lambda mm: F.floor((mm + 149) / 150).cast("bigint")
    mm = lambda c: c.cast("bigint")
    return gated(spark, sf).select("type", (F.col("am") * 4 - d("0.05") + 34 * phi).cast("decimal(18,3)").cast("double").alias("layer"), (2 * (F.col("am") + F.col("bm")) - d("0.05") + d("20.5", 1) * phi).cast("decimal(18,4)").cast("double").alias("stirrup"), (F.col("am") - d("0.05") + 22 * phi).cast("decimal(18,3)").cast("double").alias("pin"), (up(mm(F.col("hm") * 10_000)) + 2).alias("stirrups"), (up(mm(F.col("am") * 4000)) + 1).alias("bars"))


_BAEL = W + ", m as (select type, 12 d, cast(144 / 162.0 as decimal(9,6)) kg, cast(am * 4 as decimal(9,3)) a, cast(bm * 4 as decimal(9,3)) b, nb from catalogue) "


@query("c14_bael", _BAEL + "select type, cast(a - 0.1 + 0.816 as decimal(9,3))::double lx, cast(b - 0.1 + 0.816 as decimal(9,3))::double ly, cast(kg * nb * (a - 0.1 + 0.816) + kg * nb * (b - 0.1 + 0.816) as decimal(18,2))::double kg, case type % 6 when 0 then 20 when 1 then 20 when 2 then 20 when 3 then 25 when 4 then 30 else 35 end + 10 as cover_mm from m")
def c14_bael(spark, sf):
    """A footing's bars of 12 mm with anchorages of 34 diameters, and the nominal cover of an exposure class."""
    d = lambda v, s=3: F.lit(v).cast(f"decimal(9,{s})")
    length = lambda c: (F.col(c) * 4).cast("decimal(9,3)") - d("0.1") + d("0.816")
    kg = F.lit("0.888889").cast("decimal(9,6)")
    weight = (kg * F.col("nb") * length("am")).cast("decimal(28,9)") + (kg * F.col("nb") * length("bm")).cast("decimal(28,9)")
    durable = F.element_at(F.array(*map(F.lit, (10, 15, 20, 25, 30, 35))), (F.col("type") % 6 + 1).cast("int"))
    return gated(spark, sf).select("type", length("am").cast("decimal(9,3)").cast("double").alias("lx"), length("bm").cast("decimal(9,3)").cast("double").alias("ly"), weight.cast("decimal(18,2)").cast("double").alias("kg"), (F.greatest(durable, F.lit(20)) + 10).alias("cover_mm"))


@query("c18_beam_span", W + ", o as (select project, min(inst) lo, max(inst) hi, count(distinct inst) n, min(type % 9 + 3) cote from placements group by project) select project, round((hi - lo) * cote * 1.0, 2)::double length from o where n >= 2")
def c18_beam_span(spark, sf):
    """A beam's length between the outermost axes that its occurrences touch, where they touch two or more."""
    o = placements(spark, sf).groupBy("project").agg(F.min("inst").alias("lo"), F.max("inst").alias("hi"), F.min(F.col("type") % 9 + 3).alias("cote")).filter("hi > lo")
    return o.select("project", ((F.col("hi") - F.col("lo")) * F.col("cote")).cast("double").alias("length"))


_POWERS = "(values " + ", ".join(f"({i}, {b}, {h})" for i, (b, h) in enumerate((b, h) for b in (0, -1, -2, 1) for h in (0, -1, -2, 1))) + ") e(k, eb, eh)"


@query("c20_decimal_repair", W + f", d as (select type, am::double b, (bm * (case when type % 3 = 0 then 10 else 1 end))::double h, a_cm w, b_cm g from catalogue), c as (select type, k, round(b * power(10, eb), 6) cb, round(h * power(10, eh), 6) ch, w, g from d, {_POWERS}), s as (select *, round(least(abs(ln((cb / ch) / (w / g::double))), abs(ln((cb / ch) * (w / g::double)))) + case when cb between 0.10 and 2.0 and ch between 0.10 and 2.0 then 0 else 5 end, 6) dev from c) select type, arg_min(cb, (dev, k)) b, arg_min(ch, (dev, k)) h from s group by type")
def c20_decimal_repair(spark, sf):
    """Of sixteen placings of the decimal point the one whose ratio is nearest to the drawn contour's, plausible ones first."""
    g = gated(spark, sf).select("type", F.col("am").cast("double").alias("b"), (F.col("bm") * F.when(F.col("type") % 3 == 0, 10).otherwise(1)).cast("double").alias("h"), "a_cm", "b_cm")
    px = F.col("a_cm") / F.col("b_cm")
    tries = []
    for k, (eb, eh) in enumerate((b, h) for b in (0, -1, -2, 1) for h in (0, -1, -2, 1)):
        cb, ch = F.round(F.col("b") * 10.0**eb, 6), F.round(F.col("h") * 10.0**eh, 6)
        off = F.least(F.abs(F.log((cb / ch) / px)), F.abs(F.log((cb / ch) * px))) + F.when(cb.between(0.10, 2.0) & ch.between(0.10, 2.0), 0).otherwise(5)
        tries.append(F.struct(F.round(off, 6).alias("dev"), F.lit(k).alias("k"), cb.alias("b"), ch.alias("h")))
    return g.select("type", F.array_min(F.array(*tries)).alias("best")).select("type", "best.b", "best.h")


@query("x9_cell_formulas", W + "select type, '=F' || (type + 5) || '*G' || (type + 5) || case when type % 2 = 0 then '-H' || (type + 5) || '/2' else '' end formula from catalogue")
def x9_cell_formulas(spark, sf):
    """Formulas with cell references from a row's terms."""
    row = (F.col("type") + 5).cast("string")
    tail = F.when(F.col("type") % 2 == 0, F.concat(F.lit("-H"), row, F.lit("/2"))).otherwise("")
    return catalogue(spark, sf).select("type", F.concat(F.lit("=F"), row, F.lit("*G"), row, tail).alias("formula"))


@query("a25_keyword_class", W + ", k as (select type, a_cm % 7 * 3 s, b_cm % 5 * 2 p, nb n from catalogue) select type, case when s >= p and s >= n then 'SEMELLE' when p >= n then 'POTEAU' else 'POUTRE' end as cls, greatest(s, p, n)::bigint score from k")
def a25_keyword_class(spark, sf):
    """The class of most weighted keywords, the first of several."""
    c = catalogue(spark, sf)
    votes = [("SEMELLE", F.col("a_cm") % 7 * 3), ("POTEAU", F.col("b_cm") % 5 * 2), ("POUTRE", F.col("nb"))]
    best = F.array_max(F.array(*(F.struct(v.cast("bigint").alias("score"), F.lit(-i).alias("k"), F.lit(n).alias("cls")) for i, (n, v) in enumerate(votes))))
    return c.select("type", best["cls"].alias("cls"), best["score"].alias("score"))


@query("a27_catalogue_dedupe", W + ", n as (select family, a_cm, b_cm, min(type) filter (type % 4 > 0) named from catalogue group by 1, 2, 3) select c.type, case when c.type % 4 > 0 then c.type when named is not null then named else c.type end as kept from catalogue c join n on n.family = c.family and n.a_cm = c.a_cm and n.b_cm = c.b_cm")
def a27_catalogue_dedupe(spark, sf):
    """Entries that are artefacts folded into the first named entry of the same signature."""
    c = catalogue(spark, sf).select("type", "family", "a_cm", "b_cm")
    named = c.filter("type % 4 > 0").groupBy("family", "a_cm", "b_cm").agg(F.min("type").alias("named"))
    return c.join(named, ["family", "a_cm", "b_cm"], "left").select("type", F.when(F.col("type") % 4 > 0, F.col("type")).otherwise(F.coalesce("named", "type")).alias("kept"))


_CHAIN = W + ", e as (select project, inst lo, inst + qty % 3 + 1 hi, qty val from placements), r as (select project, lo, hi, val, row_number() over (partition by project, lo order by hi desc, val) k from e) "


@query("g3_longest_steps", _CHAIN + "select project, lo, hi, val from r where k = 1")
def g3_longest_steps(spark, sf):
    """From each position of a chain the longest step, of equal ones that of the least value."""
    step = F.struct((-(F.col("inst") + F.col("qty") % 3 + 1)).alias("back"), "qty")
    best = placements(spark, sf).groupBy("project", F.col("inst").alias("lo")).agg(F.min(step).alias("s"))
    return best.select("project", "lo", (-F.col("s.back")).alias("hi"), F.col("s.qty").alias("val"))


@query("q11_report", W + "select level, count(*) n, sum(qty)::bigint qty, count(distinct p.type) refs, count(*) filter (phi in (15, 18)) flagged from placements p join catalogue using (type) group by level")
def q11_report(spark, sf):
    """A report's section for each level: lines, quantities, references and what is flagged."""
    per = placements(spark, sf).groupBy("level", "type").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))
    j = per.join(catalogue(spark, sf).select("type", "phi"), "type")
    return j.groupBy("level").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"), F.count("*").alias("refs"), F.coalesce(F.sum(F.when(F.col("phi").isin(15, 18), F.col("n"))), F.lit(0)).alias("flagged"))
