"""Free text of labels to family, reference, dimensions and bars: notations of several countries, and of datasets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import strip
from .parsing import number

# fixed values, in order of priority: family, names written out, short forms, and families by beginnings of short forms
FORMS = [
    ("SEMELLE", "SEMELLE|SEML?", r"SF?[0-9]+", {"SF": "SEMELLE_FILANTE"}),
    ("POTEAU", "POTEAU|POT|COL(?:ONNE)?", r"[PQ][0-9]+", {}),
    ("POUTRE", "POUTRE|POUT|BEAM", r"B?N[0-9]+(?:BIS)?|PN[0-9]+|PA[0-9]+|TR[0-9]*", {"PA": "POUTRE_APPUI", "TR": "TRAVERS"}),
    ("DALLE", "DALLE|SLAB", r"DS?[0-9]+", {"DS": "DALLE_SOLIVE"}),
    ("VOILE", "VOILE|WALL|SHEAR", r"V[DT]?[0-9]+", {"VD": "VOILE_RINAGE", "VT": "VOILE_TERRAIN"}),
    ("ESCALIER", "ESCALIER|STAIR", "ESC[0-9]+", {}),
    ("REDRESSEUR", "REDRESSEUR|RELEVEL", "RD[0-9]+", {}),
    ("MASSIF", "MASSIF|MASS", "MS[0-9]+", {}),
    ("LINTEAU", "LINTEAU|LINTEL", "LT[0-9]+", {}),
    ("SABLIERE", "SABLIERE|SILL", "SB[0-9]+", {}),
    ("COUVERTINE", "COUVERTINE|COPING", "CV[0-9]+", {}),
    ("CONTRE_FORT", r"CONTRE\s*FORT|CF", "CF[0-9]+", {}),
    ("FUT", "FUT|SHAFT", "F[0-9]+", {}),
    ("PIEU", "PIEU|PILE", "PIE[0-9]+", {}),
    ("POUTRE", None, "LG[0-9]+|CH[0-9]+|BT[0-9]+|DB[0-9]*", {}),
    ("RADIER", None, "R[0-9]+", {}),
    ("MUR", None, "M[0-9]+", {}),
]
BARE = {"LG": "LONGRINE", "BN": "BANDE_NOYEE", "CH": "CHAINAGE", "PR": "POUTRE_REDOUBLANTE", "LT": "LINTEAU", "PA": "POUTRE_APPUI"}
LONG_FIRST = ["POTEAU", "POUTRE"]  # where one of these is written out, a short footing is not looked for
LEAST_PHI, MOST_PHI = 5, 40
_SIDE = r"([0-9]+(?:[.,][0-9]+)?)"
_SIDES = rf"{_SIDE}\s*[xX*]\s*{_SIDE}(?:\s*[xX*]\s*{_SIDE})?"
_BARS = r"(?iu)([0-9]+)\s*(?:HA|T|TOR|Ø|PHI)\s*([0-9]{1,2})"


def _found(text: Column, pattern: str, i: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def metres(value: Column, parts: int = 100) -> Column:
    """Above 10 in centimetres (or other ``parts`` of a metre), else in metres."""
    v = number(value)
    return F.when(v > 10, F.round(v / parts, 6)).otherwise(v)


def decompose(text: Column) -> Column:
    """struct<family, reference, a, b, h, nb, phi>; fields are null where the text says nothing of them.

    The finer families hold (a strip footing stays one), and a name that is written out keeps its digits alone.
    """
    t = strip(text)
    long = {family: _found(t, rf"(?i)(?:{names})\s*([0-9]+)") for family, names, _, _ in FORMS if names}
    family, reference = F.lit(None).cast("string"), F.lit(None).cast("string")
    bare = F.upper(_found(t, rf"(?i)\b({'|'.join(BARE)})\s*[-–]\s*(?:\(|[0-9]+\s*[x*]\s*[0-9]+)"))
    lone = t.rlike(r"(?i)\bN\s*[-–]\s*\(")
    ways = []
    for name, names, short, finer in FORMS:
        written = long[name] if names else F.lit(None).cast("string")
        brief = F.upper(_found(t, rf"(?i)\b({short})\b"))
        if name == "SEMELLE":
            brief = F.when(F.coalesce(*(long[f] for f in LONG_FIRST)).isNull(), brief)
        ref = F.coalesce(written, brief)
        kind = F.lit(name)
        for start, fine in finer.items():
            kind = F.when(ref.startswith(start), fine).otherwise(kind)
        ways.append((ref, kind))
    ways[-2:-2] = [(F.when(lone, F.lit("N")), F.lit("POUTRE"))]  # before rafts and walls
    ways.append((bare, F.element_at(F.create_map(*(F.lit(x) for kv in BARE.items() for x in kv)), bare)))
    for ref, kind in reversed(ways):
        family, reference = F.when(ref.isNotNull(), kind).otherwise(family), F.when(ref.isNotNull(), ref).otherwise(reference)
    phi = _found(t, _BARS, 2).try_cast("int")
    fits = phi.between(LEAST_PHI, MOST_PHI)
    side = lambda i: metres(_found(t, _SIDES, i))
    nb = _found(t, _BARS, 1).try_cast("int")
    return F.struct(family.alias("family"), reference.alias("reference"), side(1).alias("a"), side(2).alias("b"), side(3).alias("h"), F.when(fits, nb).alias("nb"), F.when(fits, phi).alias("phi"))


# fixed values: how drawings of datasets name beams and walls
_KIND, _NAME = "POUTRE|BEAM|VOILE|WALL", "[A-Z]{0,3}[0-9]+[A-Z]?"
BEAMS = ["POUTRE", "BEAM"]


def dataset_element(text: Column, hint: Column) -> Column:
    """struct<family, reference, axis, grid, a, b, h, role, bars, confidence, warnings> of a dataset's annotation.

    NULL where the text names neither a beam nor a wall and ``hint`` isn't POUTRE or VOILE. Bars are text such as
    4x12+2x10; lengths above 10 are millimetres, others metres.
    """
    forward, back = rf"(?i)\b({_KIND})\s*[-_:]?\s*({_NAME})\b", rf"(?i)\b({_NAME})\s*[-_:]?\s*({_KIND})\b"
    kind = F.upper(F.coalesce(_found(text, forward, 1), _found(text, back, 2)))
    named = F.upper(F.coalesce(_found(text, forward, 2), _found(text, back, 1)))
    family = F.when(kind.isNotNull(), F.when(kind.isin(*BEAMS), "POUTRE").otherwise("VOILE")).when(hint.isin("POUTRE", "VOILE"), hint)
    side = lambda i: metres(_found(text, _SIDES, i), 1000)
    pattern = r"(?i)([0-9]+)\s*(?:HA|T|TOR)\s*([0-9]+)"
    count, phi = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    bars = F.array_join(F.zip_with(count, phi, lambda n, p: F.concat(n.cast("int").cast("string"), F.lit("x"), p.cast("int").cast("string"))), "+")
    said = lambda words: F.coalesce(_found(text, rf"(?i)\b(?:{words})\s*[:=-]?\s*([A-Z0-9-]+)"), F.lit(""))
    warnings = F.array_join(F.array_compact(F.array(F.when(side(1).isNull(), "dimensions absentes de l'annotation"), F.when(bars == "", "armatures absentes de l'annotation"))), "; ")
    return F.when(
        family.isNotNull(),
        F.struct(
            family.alias("family"), F.coalesce(named, F.lit("INCONNU")).alias("reference"), said("axe|axis").alias("axis"), said("file|grid").alias("grid"), side(1).alias("a"), side(2).alias("b"), side(3).alias("h"),
            F.when(family == "POUTRE", "longitudinal").otherwise("vertical").alias("role"), bars.alias("bars"), F.when(side(1).isNotNull(), "high").otherwise("low").alias("confidence"), warnings.alias("warnings"),
        ),
    )
