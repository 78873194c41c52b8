"""Column functions that parse labels, sections, reinforcement notes and lengths. All but nfkc stay in the JVM; NULL stays NULL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import LEVELS, PREFIXES

LABEL = r"^\s*([A-Za-z]+)\s*[-_.]?\s*([0-9]+)"
SECTION = r"([0-9]+(?:[.,][0-9]+)?)\s*[xX]\s*([0-9]+(?:[.,][0-9]+)?)(?:\s*[xX]\s*([0-9]+(?:[.,][0-9]+)?))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def number(text: Column) -> Column:
    """A decimal number with comma or point, NULL if it is none."""
    return F.regexp_replace(text, ",", ".").try_cast("double")


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility forms of characters, composed, an Arrow batch at once; the JVM's functions have none."""
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def clean_text(text: Column) -> Column:
    """Compatibility forms; control characters but line breaks to blanks, runs of blanks and tabs to one; stripped."""
    plain = F.regexp_replace(nfkc(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u00A0]", " ")
    return F.regexp_replace(F.regexp_replace(plain, "[ \\t]+", " "), r"(?U)^\s+|\s+$", "")


def label_prefix(label: Column) -> Column:
    return F.upper(F.regexp_extract(label, LABEL, 1))


def label_number(label: Column) -> Column:
    return F.regexp_extract(label, LABEL, 2).try_cast("int")


def family_of(label: Column, prefixes: dict[str, str] = PREFIXES, default: str = "autre") -> Column:
    """The family of the longest listed prefix that is followed by a digit, a separator or nothing."""
    out = F.lit(default)
    for p, family in sorted(prefixes.items(), key=lambda x: len(x[0])):  # longer ones are asked first
        out = F.when(F.upper(F.trim(label)).rlike(f"^{p}([0-9 _.(/-]|$)"), F.lit(family)).otherwise(out)
    return out


def section_values(text: Column, low: float = 8, high: float = 700) -> Column:
    """array<double> of an AxB or AxBxH section in cm, NULL without one or outside the plausible range."""
    values = F.array_compact(F.array(*(number(F.regexp_extract(text, SECTION, i)) for i in (1, 2, 3))))
    return F.when((F.size(values) >= 2) & F.forall(values, lambda v: v.between(low, high)), values)


def section_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")), "x")


def rebar_groups(spec: Column) -> Column:
    """array<struct<nb, phi>> of notes such as 6HA14+4T12."""
    pattern = r"([0-9]+)\s*(?:HA|T)\s*([0-9]+)"
    nb, phi = (F.transform(F.regexp_extract_all(spec, F.lit(pattern), F.lit(i)), lambda x: x.cast("int")) for i in (1, 2))
    return F.zip_with(nb, phi, lambda n, p: F.struct(n.alias("nb"), p.alias("phi")))


def stirrup(spec: Column) -> tuple[Column, Column]:
    """Diameter and spacing in metres of Cad HA8 e=15; 15 cm where no spacing is given, values from 1 are cm."""
    phi = F.regexp_extract(spec, r"(?i)cad\w*\s*(?:HA|T)\s*([0-9]+)", 1).try_cast("int")
    raw = F.coalesce(number(F.regexp_extract(spec, r"(?i)e\s*=\s*([0-9]+(?:[.,][0-9]+)?)", 1)), F.lit(15.0))
    return phi, F.when(phi.isNotNull(), F.when(raw >= 1, raw / 100).otherwise(raw))


_NUM = r"([0-9]+(?:[.,][0-9]+)?)"
_PAIR = r"^(.+?)\s*[x×X*]\s*(.+?)$"


def length_metres(text: Column) -> Column:
    """Metres (3 decimals) from feet and inches, feet-inches, inches, m, cm, mm, or a bare number (from 1000: mm, from
    30: cm, else m); brackets about it don't count, a point in front is a decimal one."""
    at = lambda t, pattern, i: number(F.regexp_extract(t, pattern, i))
    foot_inch, foot_dash, inch, metric = rf"^{_NUM}\s*'\s*[-–]?\s*(?:([0-9]{{1,2}}(?:[.,][0-9]+)?)\s*\"?)?$", r"^([0-9]+)\s*[-–]\s*([0-9]{1,2})\s*\"?$", rf"^{_NUM}\s*\"$", rf"(?i)^{_NUM}\s*(m|cm|mm)?\.?$"
    feet = lambda t, pattern: at(t, pattern, 1) * 0.3048 + F.coalesce(at(t, pattern, 2), F.lit(0.0)) * 0.0254

    def metres(m: Column) -> Column:
        v, u = m["value"], m["unit"]
        return F.when(u == "mm", v / 1000).when(u == "cm", v / 100).when(u == "m", v).when(v >= 1000, v / 1000).when(v >= 30, v / 100).otherwise(v)

    def read(t: Column) -> Column:
        plain = let(F.struct(at(t, metric, 1).alias("value"), F.lower(F.regexp_extract(t, metric, 2)).alias("unit")), metres)
        return F.round(F.coalesce(feet(t, foot_inch), feet(t, foot_dash), at(t, inch, 1) * 0.0254, plain), 3)

    bare = F.btrim(F.translate(F.trim(text), "′’″”", "''\"\""), F.lit("()[] "))
    return let(let(bare, lambda t: F.when(t.startswith("."), F.concat(F.lit("0"), t)).otherwise(t)), read)


def is_dimension(text: Column) -> Column:
    """Whether a token is one length: with a unit, a whole number of 3 or 4 digits, or a decimal such as 3.50."""
    t = F.trim(F.coalesce(text, F.lit("")))
    shaped = t.rlike(r"(?i)['′’\"″”]|\bm\b|\bcm\b|\bmm\b|[0-9]-[0-9]") | t.rlike(r"^[0-9]{3,4}$") | t.rlike(r"^[0-9]{1,2}[.,][0-9]{1,2}$")
    return (t != "") & ~t.rlike(_PAIR) & length_metres(t).isNotNull() & shaped


def ref_root(label: Column) -> Column:
    """N1_25x40 to N1."""
    return F.upper(F.element_at(F.split(F.trim(label), r"[_\s]"), 1))


def norm_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "àâäéèêëîïôöùûüçñáíóú", "aaaeeeeiioouuucnaiou"), r"\s+", " "))


def reverse_text(text: Column) -> Column:
    """Text drawn upside down, read the right way round, with brackets swapped."""
    return F.translate(F.reverse(text), "()[]{}", ")(][}{")


def level_name(text: Column) -> Column:
    """The level of the first pattern found, accents not regarded; NULL without any."""
    plain, out = F.upper(norm_text(text)), F.lit(None).cast("string")
    for pattern, level in reversed(LEVELS):
        out = F.when(plain.rlike(pattern), level).otherwise(out)
    return out


def explicit_length(spec: Column) -> Column:
    """Metres of a bar noted L=4.20; above 25 the note is in cm."""
    v = number(F.regexp_extract(spec, r"(?i)\bL\s*=\s*([0-9]+(?:[.,][0-9]+)?)", 1))
    return F.when(v > 25, v / 100).otherwise(v)


def room_dims(text: Column, low: float = 0.5, high: float = 40) -> Column:
    """array<double> of both sides in metres of a room noted L x l, each any length, NULL unless both are plausible."""
    sides = F.array(*(length_metres(F.regexp_extract(F.trim(text), _PAIR, i)) for i in (1, 2)))
    return let(sides, lambda found: F.when(F.forall(found, lambda v: F.coalesce(v.between(low, high), F.lit(False))), found))
