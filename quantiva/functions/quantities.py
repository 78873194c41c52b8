"""Quantity lines, reinforcement and totals of plan records as column expressions in DECIMAL metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .constants import BLINDING_DEPTH, BLINDING_OVERHANG, PRICE_CODES, RATIO_BOUNDS

BEAMS, COLUMNS = ("poutre", "longrine", "chainage"), ("poteau", "voile")


def _m(c: Column) -> Column:
    return K.dec(c, 3, 9)


def _exact(v: float) -> Column:
    return F.lit(str(v)).cast("decimal(9,3)")


def line(category: Column | str, number: Column, length: Column, width: Column, height: Column, volume: Column) -> Column:
    cat = F.lit(category) if isinstance(category, str) else category
    code = F.element_at(F.create_map(*(F.lit(x) for kv in PRICE_CODES.items() for x in kv)), cat)
    return F.struct(code.alias("code"), cat.alias("category"), number.cast("int").alias("number"), K.dec(length).alias("length"), K.dec(width).alias("width"), K.dec(height).alias("height"), K.dec(volume, 3, 24).alias("volume"))


def footing_volume(a: Column, b: Column, h1: Column, h2: Column, sa: Column, sb: Column) -> Column:
    """A·B·h1 and, with a splay of height h2 up to a shaft of sa by sb, h2/6·[AB + ab + (A+a)(B+b)]; 9 decimals."""
    block = _m(a) * _m(b) * _m(h1)
    splay = K.dec(_m(h2) * (_m(a) * _m(b) + _m(sa) * _m(sb) + (_m(a) + _m(sa)) * (_m(b) + _m(sb))), 9, 27) / 6
    return K.dec(block + F.when(h2 > 0, K.dec(splay, 10, 28)).otherwise(F.lit(0)), 10, 28)


def footing_lines(qty: Column, a: Column, b: Column, h1: Column, h2: Column, sa: Column, sb: Column) -> Column:
    """Two lines: blinding with its overhang, and reinforced concrete with the height that a block of A·B would have."""
    over = _exact(2 * BLINDING_OVERHANG)
    la, lb, e = _m(a) + over, _m(b) + over, _exact(BLINDING_DEPTH)
    v = footing_volume(a, b, h1, h2, sa, sb)
    return F.array(line("beton_proprete", qty, la, lb, e, qty * K.dec(la * lb * e, 9, 27)), line("semelle", qty, a, b, v / K.dec(_m(a) * _m(b), 6, 18), qty * v))


def clear_span(axis: Column, left: Column, right: Column) -> Column:
    """Between the faces of both supports; 3 decimals, not below 0 or equal to it where that is an anomaly."""
    half = F.lit("0.5").cast("decimal(2,1)")
    return K.dec(_m(axis) - _m(left) * half - _m(right) * half)


def beam_line(category: Column, qty: Column, axis: Column, left: Column, right: Column, b: Column, h: Column, slab: Column) -> Column:
    """Concrete between supports; under a solid slab (slab > 0) only the drop below it counts."""
    span = F.greatest(clear_span(axis, left, right), F.lit(0).cast("decimal(18,3)"))
    height = F.greatest(K.dec(_m(h) - _m(F.coalesce(slab, F.lit(0)))), F.lit(0).cast("decimal(18,3)"))
    return line(category, qty, span, b, height, qty * K.dec(_m(span) * _m(b) * _m(height), 9, 27))


def prism_line(category: Column | str, qty: Column, length: Column, width: Column, height: Column) -> Column:
    return line(category, qty, length, width, height, qty * K.dec(_m(length) * _m(width) * _m(height), 9, 27))


def quantity_lines(records: DataFrame) -> DataFrame:
    """``records`` (id, category, qty, la, lb, h1, h2, sa, sb, span, left, right, bw, bh, slab, rise, depth) with one row
    for each of their lines. A record that lacks a dimension, or whose category has no lines, has none."""
    c = F.col
    footing = F.when(F.forall(F.array("la", "lb", "h1"), lambda v: v.isNotNull()) & ((F.coalesce(c("h2"), F.lit(0)) <= 0) | (c("sa").isNotNull() & c("sb").isNotNull())), footing_lines(c("qty"), c("la"), c("lb"), c("h1"), F.coalesce(c("h2"), F.lit(0)), F.coalesce(c("sa"), F.lit(0)), F.coalesce(c("sb"), F.lit(0))))
    beam = F.when(F.forall(F.array("span", "bw", "bh"), lambda v: v.isNotNull()), F.array(beam_line(c("category"), c("qty"), c("span"), c("left"), c("right"), c("bw"), c("bh"), c("slab"))))
    column = F.when(F.forall(F.array("rise", "bw", "bh"), lambda v: v.isNotNull()), F.array(prism_line(c("category"), c("qty"), c("rise"), c("bw"), c("bh"))))
    slab = F.when(F.forall(F.array("la", "lb", "depth"), lambda v: v.isNotNull()), F.array(prism_line("dalle_pleine", c("qty"), c("la"), c("lb"), c("depth"))))
    routed = F.when(c("category") == "semelle", footing).when(c("category").isin(*BEAMS), beam).when(c("category").isin(*COLUMNS), column).when(c("category") == "dalle_pleine", slab)
    return records.select("id", F.explode(routed).alias("line")).select("id", "line.*")


def anomalies(records: DataFrame) -> DataFrame:
    """``id, rule_code`` of records that can't be measured or look misread: four rules."""
    c = F.col
    need = F.when(c("category") == "semelle", F.array("la", "lb", "h1")).when(c("category").isin(*BEAMS), F.array("span", "bw", "bh")).when(c("category").isin(*COLUMNS), F.array("rise", "bw", "bh")).when(c("category") == "dalle_pleine", F.array("la", "lb", "depth"))
    missing = F.exists(need, lambda v: v.isNull())
    out = lambda v, lo, hi: v.isNotNull() & ~v.between(lo, hi)
    unit = F.when(c("category") == "semelle", out(c("la"), 0.15, 6.0) | out(c("lb"), 0.15, 6.0) | out(c("h1") + F.coalesce(c("h2"), F.lit(0)), 0.15, 6.0))
    unit = unit.when(c("category").isin(*BEAMS), out(c("bw"), 0.10, 2.50) | out(c("bh"), 0.10, 2.50)).when(c("category").isin(*COLUMNS), out(c("bw"), 0.10, 3.00) | out(c("bh"), 0.10, 3.00) | out(c("rise"), 0.50, 12.0)).otherwise(F.lit(False))
    negative = c("category").isin(*BEAMS) & (clear_span(c("span"), c("left"), c("right")) <= 0)
    codes = F.array(F.when(missing, "DIMENSION_NON_LUE"), F.when(~F.coalesce(missing, F.lit(True)) & negative, "GEOM_SPAN_NEGATIVE"), F.when(~F.coalesce(missing, F.lit(True)) & unit, "DIMENSION_UNIT_ERROR"), F.when(need.isNull(), "CATEGORY_NOT_ROUTED"))
    return records.select("id", F.explode(F.array_compact(codes)).alias("rule_code"))


def bar_weight(elements: Column, bars: Column, developed: Column, phi: Column) -> Column:
    """kg of equal bars, the mass of an unknown diameter being that of the nearest known one; 6 decimals."""
    return K.dec(elements * bars * K.dec(developed, 3, 9) * K.bar_mass(K.nearest_diameter(phi)), 6, 28)


def steel_ratio(kg: Column, volume: Column) -> Column:
    """kg/m3 to one decimal, 0 without a volume."""
    return F.when(volume == 0, F.lit(0.0)).otherwise(F.round(kg.cast("double") / volume.cast("double"), 1))


def ratio_status(ratio: Column, volume: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Status and observation texts of a ratio."""
    none = volume == 0
    status = F.when(none, "NON APPLICABLE").when(ratio.between(low, high), "CONFORME BET MAROC").otherwise("ALERTE HORS PLAGE RPS 2011")
    said = F.when(none, "-").when(ratio < low, "Sous-ferraillage ou oubli de barres à vérifier").when(ratio > high, "Sur-ferraillage ou confusion d'unité (cm/m) à vérifier").otherwise("Ratio validé")
    return status, said


def bounds(spark) -> DataFrame:
    return spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in RATIO_BOUNDS.items()], "category string, lo double, hi double")
