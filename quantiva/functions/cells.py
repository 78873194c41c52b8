"""Column functions for cells of schedules, headers, notes and title blocks. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COLUMN_ROLES, REGULATIONS
from .labels import _group
from .parsing import clean_text, number

_SIDES = r"([0-9]+(?:[.,][0-9]+)?)\s*[xX×]\s*([0-9]+(?:[.,][0-9]+)?)(?:\s*[xX×]\s*([0-9]+(?:[.,][0-9]+)?))?"
_STIRRUPS = r"(?i)(?:CAD|ETR|cadre|etrier)\s*T?([0-9]+)\s*(?:e[@=\s]+)([0-9]+(?:[.,][0-9]+)?)"


def metres_above(value: Column, limit: float) -> Column:
    """Values over ``limit`` are centimetres, others metres."""
    return F.when(value > limit, value / 100).otherwise(value)


def unit_of_values(values: Column) -> Column:
    """cm if the mean of the numbers among texts is over 5 or there is none, else m."""
    known = F.array_compact(F.transform(values, lambda v: F.regexp_replace(F.trim(v), ",", ".").try_cast("double")))
    mean = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v) / F.size(known)
    return F.when((F.size(known) == 0) | (mean > 5), "cm").otherwise("m")


def unit_of_header(cells: Column) -> Column:
    """The unit that the first telling header cell names: cm, m, or auto."""
    told = F.transform(cells, lambda c: F.when(F.contains(F.lower(F.trim(c)), F.lit("cm")), "cm").when(F.lower(F.trim(c)).rlike("^m | m$|^m$"), "m"))
    return F.coalesce(F.get(F.array_compact(told), 0), F.lit("auto"))


def sides_metres(text: Column, unit: Column) -> Column:
    """array<double> of a, b, h in metres (3 decimals) of a cell; with unit auto the values decide. NULL without a section."""
    raw = F.array_compact(F.array(*(_group(text, _SIDES, i) for i in (1, 2, 3))))
    used = F.when(unit == "auto", unit_of_values(raw)).otherwise(unit)
    metres = F.transform(raw, lambda v: F.round(F.when(used == "cm", number(v) / 100).otherwise(number(v)), 3))
    return F.when(F.size(raw) >= 2, metres)


def bar_layers(text: Column) -> Column:
    """array of at most three struct<nb, phi>: lower x, lower y and upper layer in the order written."""
    pattern = r"(?i)([0-9]+)\s*(?:TOR|T|HA)\s*([0-9]+)"
    nb, phi = (F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)), lambda x: x.cast("int")) for i in (1, 2))
    return F.slice(F.zip_with(nb, phi, lambda n, p: F.struct(n.alias("nb"), p.alias("phi"))), 1, 3)


def stirrup_cell(text: Column) -> tuple[Column, Column]:
    """Diameter and spacing in metres (3 decimals) of a cell; spacings over 5 are cm."""
    spacing = number(_group(text, _STIRRUPS, 2))
    return _group(text, _STIRRUPS, 1).cast("int"), F.round(metres_above(spacing, 5), 3)


def quantity_cell(text: Column) -> Column:
    """A whole number, NULL for marks of none and for anything else."""
    t = F.trim(text)
    return F.when(~t.isin("", "--", "-", "var", "suiv plan", "s/p", "sp") & t.rlike("^[+-]?[0-9]+$"), t.try_cast("int"))


def column_role(header: Column) -> Column:
    """The role of a table column by the first pattern that its header has, else unknown."""
    out = F.lit("unknown")
    for role, pattern in reversed(COLUMN_ROLES):
        out = F.when(F.lower(F.trim(header)).rlike(f"(?i){pattern}"), role).otherwise(out)
    return out


def section_cell(text: Column) -> Column:
    """array<double> of a and b in metres of a section cell, each in cm if over 10; NULL without one."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)"
    return F.when(text.rlike(pattern), F.array(*(metres_above(_group(text, pattern, i).cast("double"), 10) for i in (1, 2))))


def free_dimensions(text: Column, defaults: tuple[float, float, float]) -> Column:
    """array<double> of a, b, h in metres from the first three numbers of a text, over 10 in cm; without two numbers, or
    where a number is 0, the defaults."""
    found = F.transform(F.regexp_extract_all(clean_text(text), F.lit(r"([0-9]+(?:[.,][0-9]+)?)"), F.lit(1)), number)
    n = F.coalesce(F.size(found), F.lit(0))
    value = lambda i: F.when(n >= max(2, i + 1), F.when(F.get(found, i) > 0, metres_above(F.get(found, i), 10)))
    return F.array(*(F.round(F.coalesce(value(i), F.lit(d)), 6) for i, d in enumerate(defaults)))


def free_spacing(text: Column, default: float = 15.0) -> Column:
    """The spacing noted as E, ESP or @, else the default."""
    v = number(F.regexp_extract(F.upper(clean_text(text)), r"(?:E|ESP|@)\s*[=:]?\s*([0-9]+(?:[.,][0-9]+)?)", 1))
    return F.coalesce(F.when(v > 0, v), F.lit(default))


def first_filled(*fields: Column) -> Column:
    """The first text that is there and not empty, cleaned."""
    return clean_text(F.coalesce(*(F.nullif(f, F.lit("")) for f in fields)))


def regulations(text: Column) -> Column:
    """array<struct<category, rule>>: each listed design rule that a title block's text states, in the list's order."""
    t = F.upper(text)
    out = []
    for category, pattern, said in REGULATIONS:
        pieces = [F.lit(x) if x not in ("{0}", "{1}") else F.regexp_extract(t, pattern, 1 + int(x[1])) for x in _pieces(said)]
        out.append(F.when(t.rlike(pattern), F.struct(F.lit(category).alias("category"), F.concat(*pieces).alias("rule"))))
    return F.array_compact(F.array(*out))


def _pieces(said: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\{[01]\})", said) if x]


def revision(text: Column) -> Column:
    """struct<indice, date, label> of a title block's text, empty where it states none."""
    t = F.upper(text)
    issue = F.regexp_extract(t, r"([0-9]+)\s*EMISSION", 1)
    return F.struct(F.regexp_extract(t, r"INDICE\s*[:.]?\s*([A-Z])\b", 1).alias("indice"), F.regexp_extract(t, r"([0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4})", 1).alias("date"), F.when(issue != "", F.concat(issue, F.lit("eme EMISSION"))).otherwise("").alias("label"))


def spacing_note(text: Column) -> Column:
    """cm of a note such as Esp=15."""
    return number(_group(text, r"(?i)(?:Esp|e)\s*=\s*([0-9]+(?:[.,][0-9]+)?)", 1))


def load_note(text: Column) -> Column:
    """struct<load, unit> of a note such as 250 daN/m2, NULL without one."""
    pattern = r"(?i)([0-9]+)\s*(daN/m[sup2²]|kg/m[sup2²]|kN/m2)"
    return F.when(text.rlike(pattern), F.struct(F.regexp_extract(text, pattern, 1).cast("double").alias("load"), F.regexp_extract(text, pattern, 2).alias("unit")))


def short_number(value: Column) -> Column:
    """A number for a formula: whole without point, else at most three decimals."""
    whole = F.abs(value - F.round(value)) < 1e-9
    return F.when(whole, F.round(value).cast("bigint").cast("string")).otherwise(F.rtrim(F.rtrim(F.format_string("%.3f", value), F.lit("0")), F.lit(".")))


def french_number(value: Column, decimals: int = 2) -> Column:
    """4,25; a dash for NULL."""
    return F.coalesce(F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"\.", ","), F.lit("-"))


def formula_text(terms: Column) -> Column:
    """``=725+238-120/2`` from array<struct<sign, number, divisor>>; empty without terms."""
    said = F.transform(terms, lambda t, i: F.concat(F.when(t["sign"] < 0, "-").when(i > 0, "+").otherwise(""), short_number(t["number"]), F.when(t["divisor"] != 1, F.concat(F.lit("/"), short_number(t["divisor"]))).otherwise("")))
    return F.when(F.size(terms) > 0, F.concat(F.lit("="), F.array_join(said, ""))).otherwise("")
