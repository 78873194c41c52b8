"""Column functions for references, dimensioned labels, composite tokens and legends. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ELEMENT_FAMILIES, LEGEND_IGNORE, PREFIX_RULES, REFERENCE_FAMILIES, SECTION_RULES, TOKEN_FAMILIES
from .parsing import let, number

#: parts of the grammar; all are read without regard to case and with Unicode blanks
_NUM, _TIMES, _UNIT = r"([0-9]{1,4}(?:[.,][0-9]{1,3})?)", r"\s*[x×*]\s*", r"\s*(cm|mm|m)?"
_DIMS = r"(?iU)^\(?\s*" + _NUM + _TIMES + _NUM + "(?:" + _TIMES + _NUM + r")?\s*\)?" + _UNIT + "$"
_DEPTH = r"(?iU)^[eé](?:p\.?)?\s*[=:]?\s*" + _NUM + _UNIT + "$"
_NAME, _NUMBER, _AGAIN = "([A-Z]{1,4})", "([0-9]{0,4})", "(BIS)?"
_LABEL = "(?isU)^" + _NAME + _NUMBER + _AGAIN + "(.*)$"
_REFERENCE = "(?iU)^" + _NAME + r"\s*[-_ ]?\s*" + _NUMBER + r"\s*" + _AGAIN + "$"
LEAST_CM, MOST_CM = 8.0, 700.0


def strip(text: Column) -> Column:
    """Without any kind of blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _group(text: Column, pattern: str, at: int) -> Column:
    """A pattern's group, NULL where the pattern or the group isn't found."""
    return F.nullif(F.regexp_extract(text, pattern, at), F.lit(""))


def centimetres(value: Column, unit: Column) -> Column:
    """cm of a value and its unit (NULL: below 3 metres, else cm); NULL unless positive."""

    def read(v: Column) -> Column:
        x, u = v["value"], v["unit"]
        cm = F.when(u == "m", x * 100).when(u == "mm", x / 10).when(u == "cm", x).otherwise(F.when(x < 3, x * 100).otherwise(x))
        return F.when(x > 0, F.round(cm, 6))

    return let(F.struct(value.alias("value"), unit.alias("unit")), read)


def section_cm(text: Column) -> Column:
    """array<double> in cm of AxB, AxBxH or a depth such as e=20, NULL if any value is implausible."""

    def sides(t: Column) -> Column:
        written = F.array_compact(F.array(*(_group(t, _DIMS, i) for i in (1, 2, 3))))
        cm = lambda w: F.array_compact(F.transform(w["sides"], lambda v: centimetres(number(v), w["unit"])))
        whole = lambda w: let(cm(w), lambda v: F.when((F.size(w["sides"]) >= 2) & (F.size(v) == F.size(w["sides"])), v))
        return let(F.struct(written.alias("sides"), _group(t, _DIMS, 4).alias("unit")), whole)

    depth = lambda t: centimetres(number(_group(t, _DEPTH, 1)), F.lower(_group(t, _DEPTH, 2)))
    read = lambda t: let(depth(t), lambda d: F.when(d.isNotNull(), F.array(d)).otherwise(sides(t)))
    values = let(strip(F.btrim(strip(F.regexp_replace(text, ",", ".")), F.lit("()"))), read)
    return let(values, lambda found: F.when(F.forall(found, lambda v: v.between(LEAST_CM, MOST_CM)), found))


def family_of_reference(ref: Column) -> Column:
    """The family of the first listed prefix that is followed by a digit, a separator or nothing; NULL without one."""

    def named(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for prefix, family in reversed(REFERENCE_FAMILIES):
            out = F.when(t.rlike(f"^{prefix}([0-9_ .(-]|$)"), family).otherwise(out)
        return out

    return let(F.upper(strip(ref)), named)


def _rule_size(prefix: Column, family: Column) -> Column:
    by_family = F.element_at(F.create_map(*(F.lit(x) for k, v in SECTION_RULES.items() for x in (k, len(v)))), family)
    by_prefix = F.element_at(F.create_map(*(F.lit(x) for k, v in PREFIX_RULES.items() for x in (k, len(v)))), prefix)
    return F.coalesce(by_prefix, by_family, F.lit(0))


def parse_label(text: Column) -> Column:
    """struct<family, reference, values> of a reference with dimensions in one token, NULL for anything else.

    Reinforcement and spacing notes are no labels; values beyond those that the family has are dropped.
    """

    def cut(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _LABEL, i)
        return F.struct(F.upper(part(1)).alias("prefix"), part(2).alias("num"), F.upper(part(3)).alias("again"), strip(part(4)).alias("rest"))

    def named(c: Column) -> Column:
        joined = c["rest"].rlike("^[xX×*]")  # BN25x30: the number is part of the section
        reference = F.concat(c["prefix"], F.when(joined, "").otherwise(c["num"]), c["again"])
        dims = strip(F.regexp_replace(F.when(joined, F.concat(c["num"], c["rest"])).otherwise(c["rest"]), r"(?U)^[-_:=\s(]+", ""))
        return F.struct(c["prefix"].alias("prefix"), reference.alias("reference"), family_of_reference(reference).alias("family"), dims.alias("dims"))

    def valued(n: Column) -> Column:
        single = centimetres(number(_group(n["dims"], rf"^{_NUM}\)?$", 1)), F.lit(None).cast("string"))
        by_size = lambda size: F.slice(F.coalesce(section_cm(n["dims"]), let(single, lambda v: F.when((size == 1) & v.between(LEAST_CM, MOST_CM), F.array(v)))), F.lit(1), F.greatest(size, F.lit(1)))
        return F.struct(n["family"].alias("family"), n["reference"].alias("reference"), let(_rule_size(n["prefix"], n["family"]), by_size).alias("values"))

    def read(t: Column) -> Column:
        fits = t.rlike(_LABEL) & (F.length(t) <= 40) & ~t.rlike(r"(?iU)(?<![A-Z])[0-9]+\s*(?:HA|T)\s*[0-9]+") & ~t.rlike(r"(?iU)\be\s*=\s*\(")
        found = let(let(let(t, cut), named), valued)
        return F.when(fits, let(found, lambda v: F.when(v["family"].isNotNull() & v["values"].isNotNull(), v)))

    return let(strip(text), read)


def parse_reference(text: Column, digits: int = 4) -> Column:
    """struct<family, reference> of a reference alone, of as many ``digits`` at most; NULL for anything else."""
    pattern = _REFERENCE.replace("{0,4}", f"{{0,{digits}}}")

    def named(reference: Column) -> Column:
        return let(family_of_reference(reference), lambda f: F.when(f.isNotNull(), F.struct(f.alias("family"), reference.alias("reference"))))

    def read(t: Column) -> Column:
        reference = F.upper(F.concat(*(F.regexp_extract(t, pattern, i) for i in (1, 2, 3))))
        return F.when(t.rlike(pattern) & (F.length(t) <= 8 + digits), let(reference, named))

    return let(strip(text), read)


#: any label of a composite token
_TOKEN = r"(?:B?N[0-9]+(?:BIS)?|(?:" + "|".join(sorted((k for k in TOKEN_FAMILIES if k not in ("N", "BN")), key=lambda k: (-len(k), k))) + r")[0-9]+)"
_BARS = r"[0-9]+\s*(?:HA|TOR|T|Ø|PHI)\s*[0-9]+(?:\+[0-9]+\s*(?:HA|TOR|T|Ø|PHI)\s*[0-9]+)*"
_SIDES = r"[0-9.]{2,3}\s*[xX*]\s*[0-9.]{2,3}"
_TWO = rf"(?i)^({_TOKEN})[/-]({_TOKEN})$"
_COMPOSITE = rf"(?i)^({_TOKEN})(\({_SIDES}(?:\s*[xX*]\s*[0-9.]{{2,3}})?\))?({_BARS})?$"


def tokenize(text: Column) -> Column:
    """array<string> of the parts of a composite token: two labels, or a label with its section and bars."""
    plain = F.translate(F.trim(text), "×*", "xx")
    close = F.regexp_replace(plain, " ", "")
    whole = close.rlike(r"(?i)^S[0-9]+\([0-9]+x[0-9]+x[0-9]+\)$") | plain.rlike(rf"^\(?{_SIDES}\)?$") | plain.rlike(rf"(?i)^{_BARS}$")
    parts = F.array_compact(F.array(*(_group(close, _COMPOSITE, i) for i in (1, 2, 3))))
    one = F.when(close.rlike(r"(?i)^S[0-9]+\([0-9]+x[0-9]+x[0-9]+\)$"), close).otherwise(plain)
    return F.when(plain.isNull(), F.lit(None).cast("array<string>")).when(plain == "", F.array().cast("array<string>")).when(close.rlike(_TWO), F.array(_group(close, _TWO, 1), _group(close, _TWO, 2))).when(~whole & (F.size(parts) > 1), parts).otherwise(F.array(one))


def token_family(label: Column) -> Column:
    """The family of a token's longest listed prefix, INCONNU without one; FS is not a shaft."""
    t, out = F.upper(label), F.lit("INCONNU")
    for prefix, family in sorted(TOKEN_FAMILIES.items(), key=lambda x: len(x[0])):  # longer ones are asked first
        fits = t.startswith(prefix) & ~t.startswith("FS") if prefix == "F" else t.startswith(prefix)
        out = F.when(fits, family).otherwise(out)
    return out


_PREFIX = r"(BN|LG|CH|LT|PR|RD|ESC|SF|[PQSNVDRM])"
_ELEMENT = [rf"(?i)^{_PREFIX}([0-9]*)[-–]\s*\(([0-9]+[xX×][0-9]+(?:[xX×][0-9]+)?)\)(BIS|ALL)?$", rf"(?i)^{_PREFIX}([0-9]+)(?:[-–]\s*\(([0-9]+[xX×][0-9]+(?:[xX×][0-9]+)?)\))?(BIS|ALL)?$"]


def parse_element(text: Column) -> Column:
    """struct<prefix, reference, family, suffix, sides> of labels such as N1-(25x40)BIS; NULL for anything else."""
    t = F.trim(text)
    part = lambda i: F.coalesce(*(_group(t, p, i) for p in _ELEMENT))
    prefix, num, suffix = F.upper(part(1)), F.coalesce(part(2), F.lit("")), F.coalesce(part(4), F.lit(""))
    family = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ELEMENT_FAMILIES.items() for x in kv)), prefix), F.lit("INCONNU"))
    sides = F.transform(F.split(part(3), "[xX×]"), lambda v: v.cast("int"))
    bare = (num == "") & prefix.isin("F", "D", "S", "V", "R", "M", "P", "N")
    return F.when(prefix.isNotNull() & ~bare, F.struct(prefix.alias("prefix"), F.concat(prefix, num, suffix).alias("reference"), family.alias("family"), suffix.alias("suffix"), sides.alias("sides")))


_LEGEND = [r"^\s*([A-Za-z]{1,5})\s*[=:–-]\s*(.+?)\s*$", r"^\s*-?\s*([A-Za-z]{1,5})\s*=\s*(.+?)\s*$", r"^\s*([A-Za-z]{2,5})\s+([A-Z][A-Za-z\s]{2,30})\s*$"]


def legend_entry(line: Column) -> Column:
    """struct<prefix, meaning> of a legend's line: N = Poutre, -N=POUTRE or BN BANDE NOYEE; NULL for anything else."""
    out = F.lit(None).cast("struct<prefix:string,meaning:string>")
    for pattern in reversed(_LEGEND):
        prefix = F.upper(F.regexp_extract(line, pattern, 1))
        entry = F.struct(prefix.alias("prefix"), F.trim(F.regexp_extract(line, pattern, 2)).alias("meaning"))
        out = F.when(line.rlike(pattern) & ~prefix.isin(*LEGEND_IGNORE), entry).otherwise(out)
    return out
