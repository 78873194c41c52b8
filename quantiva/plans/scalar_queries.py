"""Queries of the parsing functions, filters and quantity formulas (projections without a shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import parsing as P
from .carriers import CTE, catalogue, gated, read
from .registry import query

_CAT = f"with {CTE} select {{0}} from catalogue"


def _projection(name: str, columns: Callable[[], dict], sql: str, source=catalogue):
    """Register a projection; its columns are only made once there is a session."""
    query(name, _CAT.format("type, " + sql))(lambda spark, sf: source(spark, sf).select("type", *(c.alias(n) for n, c in columns().items())))


_MESSY = lambda: F.concat(F.lit(" "), "label", F.lit("  \t x  "))
_projection("p1_clean_text", lambda: {"cleaned": P.clean_text(_MESSY())}, "label || ' x' cleaned")
_projection("p2_category_from_label", lambda: {"prefix": P.label_prefix(F.col("label")), "number": P.label_number(F.col("label")), "category": P.family_of(F.col("label"))}, "prefix, cast(type as int) number, family category")
_projection("p3_family_of_ref", lambda: {"fam": P.family_of(F.concat(F.lower("prefix"), F.lit("-"), "type"))}, "family fam")
_section = lambda: P.section_values(F.col("label"))
_projection("p5_section_values", lambda: {"v1": F.get(_section(), 0), "v2": F.get(_section(), 1)}, "case when a_cm between 8 and 700 and b_cm between 8 and 700 then cast(a_cm as double) end v1, case when a_cm between 8 and 700 and b_cm between 8 and 700 then cast(b_cm as double) end v2")
_projection("p6_dims_to_metres", lambda: {"m1": F.round(F.get(_section(), 0) / 100, 4), "m2": F.round(F.get(_section(), 1) / 100, 4)}, "round(a_cm / 100.0, 4)::double m1, round(b_cm / 100.0, 4)::double m2")
_projection("p7_section_text", lambda: {"section": P.section_text(_section())}, "a_cm || 'x' || b_cm section")
_groups = lambda: P.rebar_groups(F.concat("spec", F.lit("+4T12")))
_projection("p13_rebar_groups", lambda: {"n_groups": F.size(_groups()), "nb1": F.get(_groups(), 0)["nb"], "phi1": F.get(_groups(), 0)["phi"], "nb2": F.get(_groups(), 1)["nb"]}, "2 n_groups, cast(nb as int) nb1, phi phi1, 4 nb2")
_projection("p14_stirrup", lambda: {"phi_s": P.stirrup(F.col("stirrup"))[0], "spacing": P.stirrup(F.col("stirrup"))[1]}, "phi phi_s, 0.15::double spacing")
_text = lambda: F.concat(F.col("a_cm").cast("string"), F.element_at(F.array(F.lit(" cm"), F.lit(""), F.lit("0 mm")), (F.col("type") % 3 + 1).cast("int")))
_projection("p17_parse_length", lambda: {"metres": F.round(P.length_metres(_text()), 4)}, "case when type % 3 = 1 and a_cm < 30 then a_cm::double else round(a_cm / 100.0, 4)::double end metres")
_projection("p26_reverse_text", lambda: {"read": P.reverse_text(F.reverse(F.translate("label", "()", ")(")))}, "label as read")
_projection("p32_ref_root", lambda: {"root": P.ref_root(F.concat("prefix", "type", F.lit("_25x40")))}, "prefix || type root")
_projection("p33_norm_text", lambda: {"norm": P.norm_text(F.concat(F.lit(" Étage  "), "label"))}, "'etage ' || lower(label) norm")
_projection("p29_level", lambda: {"level": P.level_name(F.concat(F.lit("Plan haut R + "), (F.col("type") % 5).cast("string")))}, "case type % 5 when 0 then 'RDC' else 'R+' || (type % 5) end as level")
_projection("p16_specs_from_bars", lambda: {"spec_text": F.concat(F.col("nb").cast("string"), F.lit("HA"), F.col("phi").cast("string"))}, "spec spec_text")

_d = lambda c: c.cast("double")
_projection("c1_unit_gate", lambda: {"a_m": _d(F.col("am")), "b_m": _d(F.col("bm")), "h_m": _d(F.col("hm"))}, "am::double a_m, bm::double b_m, hm::double h_m", gated)
_projection("c5_column", lambda: {"vol_m3": _d(K.dec(F.col("vol"), 6))}, "cast(vol as decimal(18,6))::double vol_m3", gated)
_projection("c7_developed_length", lambda: {"dev": _d(K.developed_length(F.col("phi"), F.col("am") * 10)), "dev_explicit": _d(K.developed_length(F.col("phi"), F.col("am") * 10, F.lit(True)))},
    "cast(am * 10 + phi * 30 * 0.001 + greatest(ceil((am * 10 + phi * 30 * 0.001) / 12) - 1, 0)::int * phi * 50 * 0.001 as decimal(18,3))::double dev, cast(am * 10 + greatest(ceil(am * 10 / 12) - 1, 0)::int * phi * 50 * 0.001 as decimal(18,3))::double dev_explicit", gated)
_projection("c8_stirrups", lambda: {"len": _d(K.stirrup_length(F.col("am"), F.col("bm"), F.col("phi"))), "n": K.stirrup_count(F.col("hm") * 10, F.lit(0.15))},
    "cast(2 * greatest(am - 0.05, 0.05) + 2 * greatest(bm - 0.05, 0.05) + 2 * greatest(phi * 10 * 0.001, 0.08) as decimal(18,3))::double len, (ceil(hm * 10 / 0.15) + 1)::int n", gated)
_projection("j5_nearest_diameter", lambda: {"near_phi": K.nearest_diameter(F.col("phi"))}, "case phi when 15 then 14 when 18 then 16 else phi end near_phi")
_projection("q2_invalid_diameter", lambda: {"invalid": K.bar_mass(F.col("phi")).isNull(), "fix": F.when(K.bar_mass(F.col("phi")).isNull(), K.nearest_diameter(F.col("phi")))}, "phi in (15, 18) invalid, case phi when 15 then 14 when 18 then 16 end fix")
_projection("f4_out_of_bounds", lambda: {"oob": ~F.col("hm").between(0.3, 0.5)}, "hm < 0.3 or hm > 0.5 oob", gated)
_zero = lambda: F.when(F.col("type") % 5 == 0, 0.0).otherwise(F.col("price"))
_projection("f5_valeur_lue", lambda: {"val": F.coalesce(F.when(_zero() > 0, _zero()), F.when(F.col("a") > 0, F.col("a")))}, "case when type % 5 = 0 then a else price end val")
_missing = lambda: F.array_compact(F.array(F.when(F.col("type") % 4 == 0, "a"), F.when(F.col("type") % 6 == 0, "h")))
_projection("f6_missing_dims", lambda: {"missing": F.array_join(_missing(), ","), "refused": F.size(_missing()) > 0}, "concat_ws(',', case when type % 4 = 0 then 'a' end, case when type % 6 = 0 then 'h' end) missing, type % 4 = 0 or type % 6 = 0 refused")
_projection("f9_cote_range", lambda: {"plausible": (F.col("a_cm") * 10).between(100, 800)}, "a_cm * 10 between 100 and 800 plausible")
_projection("c19_bars_from_spacing", lambda: {"bars": (F.floor((F.col("a_cm") * 10 - 100) / 150) + 1).cast("int")}, "((a_cm * 10 - 100) // 150 + 1)::int bars")
_projection("x4_stock_table", lambda: {"purchased": F.col("nb") * 12, "waste": F.col("nb") * 12 - F.col("nb") * 11}, "(nb * 12)::int purchased, nb::int waste")


@query("s13_json_elements", "select event_id, cast(json_extract(props, '$.k') as int) k from events")
def s13_json_elements(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("s21_sha16", "select doc_id, substr(sha256(text), 1, 16) sha16 from documents")
def s21_sha16(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("sha16"))


@query("r2_categories", "select doc_id, case when contains(lower(text), 'license') then 'LICENCE' when contains(text, '@') then 'CONTACT' else 'GENERAL' end as primary_category from documents")
def r2_categories(spark, sf):
    low = F.lower("text")
    found = F.array_compact(F.array(F.when(F.contains(low, F.lit("license")), "LICENCE"), F.when(F.contains(F.col("text"), F.lit("@")), "CONTACT")))
    return read(spark, sf, "documents").select("doc_id", F.coalesce(F.get(found, 0), F.lit("GENERAL")).alias("primary_category"))


@query("s11_tiles", "with p as (select p_partkey as type, 300 + p_size * 100 h, 500 + p_size * 50 w from part), ys as (select *, unnest(range(0, h + 1, 1000)) y from p) select type, cast(y as int) y, cast(unnest(range(0, w + 1, 1000)) as int) x from ys")
def s11_tiles(spark, sf):
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("type"), (300 + F.col("p_size") * 100).alias("h"), (500 + F.col("p_size") * 50).alias("w"))
    ys = p.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h"), F.lit(1000))))
    return ys.select("type", "y", F.explode(F.sequence(F.lit(0), F.col("w"), F.lit(1000))).alias("x"))
