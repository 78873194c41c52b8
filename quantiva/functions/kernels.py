"""Quantity formulas as column expressions in DECIMAL, so that sums do not depend on order or engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import BAR_MASS, COVER, HOOKS, LAP, STOCK_BAR


def dec(c: Column, scale: int = 3, width: int = 18) -> Column:
    return c.cast(f"decimal({width},{scale})")


def unit_gate(raw: Column, large: bool = False) -> Column:
    """Metres (3 decimals) of a value in m, cm or mm, told apart by size; large dimensions have higher limits."""
    mm, cm = (500, 25) if large else (100, 3.5)
    v = dec(raw, 6)
    return dec(F.when(raw >= mm, v * F.lit(0.001).cast("decimal(4,3)")).when(raw > cm, v * F.lit(0.01).cast("decimal(3,2)")).otherwise(v))


def volume(*sides: Column) -> Column:
    """Product of sides in metres, 9 decimals."""
    return dec(reduce(lambda a, b: a * b, (dec(s, 3, 9) for s in sides)), 9)


def nearest_diameter(phi: Column) -> Column:
    """The nearest diameter of the catalogue; the smaller of two as near."""
    known = F.array(*(F.struct(F.abs(phi - F.lit(d)).alias("gap"), F.lit(d).alias("d")) for d in sorted(BAR_MASS)))
    return F.array_min(known)["d"]


def bar_mass(phi: Column) -> Column:
    """kg/m as DECIMAL, NULL for a diameter outside the catalogue."""
    return F.element_at(F.create_map(*(F.lit(x) for d, m in BAR_MASS.items() for x in (d, m))), phi).cast("decimal(6,3)")


def developed_length(phi: Column, clear: Column, explicit: Column | None = None) -> Column:
    """Clear length and hooks (unless explicit), with a lap for each stock bar beyond the first; 3 decimals."""
    hooks = dec(phi * HOOKS, 0) * F.lit(0.001).cast("decimal(4,3)")
    base = dec(clear) + (hooks if explicit is None else F.when(explicit, F.lit(0).cast("decimal(18,3)")).otherwise(hooks))
    laps = F.greatest(F.ceil(base / STOCK_BAR) - 1, F.lit(0))
    return dec(base + dec(laps, 0) * dec(phi * LAP, 0) * F.lit(0.001).cast("decimal(4,3)"))


def stirrup_length(b: Column, h: Column, phi: Column, cover: float = COVER) -> Column:
    """2(b-2c) + 2(h-2c) + hooks of 10 diameters or 8 cm; sides of 5 cm at least."""
    side = lambda x: F.greatest(dec(x) - dec(F.lit(2 * cover)), dec(F.lit(0.05)))
    return dec(2 * side(b) + 2 * side(h) + 2 * F.greatest(dec(phi * 10, 0) * F.lit(0.001).cast("decimal(4,3)"), dec(F.lit(0.08))))


def stirrup_count(span: Column, spacing: Column) -> Column:
    """ceil(span / spacing) + 1, spacing of 5 cm at least."""
    return (F.ceil(dec(span) / F.greatest(dec(spacing), dec(F.lit(0.05)))) + 1).cast("int")
