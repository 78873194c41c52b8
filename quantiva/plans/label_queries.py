"""Queries of the parsers of labels, lengths, cells, legends and title blocks, over lists of spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import decompose as D
from ..functions import labels as L
from ..functions import parsing as P
from .carriers import read
from .cases import cases
from .registry import query

_sides = lambda values: F.array_join(F.transform(values, lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")), "x")

# fixed golden cases: labels with what they are read as
LABELS = [
    ("S2(110x110x25)", "semelles", "S2", "110x110x25"), ("S2 : 110 x 110 x 25", "semelles", "S2", "110x110x25"), ("S2(1.10x1.10x0.25)", "semelles", "S2", "110x110x25"),
    ("S2(1100x1100x250mm)", "semelles", "S2", "110x110x25"), ("P1 25x35", "poteaux", "P1", "25x35"), ("P1 0.25x0.35", "poteaux", "P1", "25x35"), ("POT3(30x30)", "poteaux", "POT3", "30x30"),
    ("PD2 30x30", "poteaux", "PD2", "30x30"), ("Q1(25x30)", "poteaux", "Q1", "25x30"), ("N1-(25X40)", "poutres", "N1", "25x40"), ("N1_25x40", "poutres", "N1", "25x40"), ("n1bis 25×40", "poutres", "N1BIS", "25x40"),
    ("BN25x30", "poutres", "BN", "25x30"), ("BN_25x30", "poutres", "BN", "25x30"), ("LG 25x35", "longrines", "LG", "25x35"), ("CH1(20x15)", "chainages", "CH1", "20x15"), ("M1(20x250)", "murs", "M1", "20x250"),
    ("V2(15x250)", "voiles", "V2", "15x250"), ("ESC1 20x30", "escaliers", "ESC1", "20x30"), ("D1 e=20", "dalles", "D1", "20"), ("D1 20", "dalles", "D1", "20"), ("SF 45x20", "semelles", "SF", "45x20"), ("P1(25x35x300)", "poteaux", "P1", "25x35"),
    ("\tP1 25x35", "poteaux", "P1", "25x35"), ("P1\u00a025\u00a0x\u00a035\n", "poteaux", "P1", "25x35"), ("D1 ÉP. 20", "dalles", "D1", "20"),
    *((t, None, None, None) for t in ("8T12", "4HA10", "e=15", "e=(10x9 symet)", "25x30", "(25x35)", "PLAN N3", "S2", "Escalier", "CAD+ETR", "1500", "R+2", "P1 5x5", "P1 900x900", "", None, "S2 110x110x25 " + "x" * 40)),
]
cases("p4_parse_label", LABELS, {"family": "varchar", "reference": "varchar", "sides": "varchar"}, lambda t: {"family": L.parse_label(t)["family"], "reference": L.parse_label(t)["reference"], "sides": _sides(L.parse_label(t)["values"])})

SECTIONS = [("25x30", "25x30"), ("0.25x0.35", "25x35"), ("1,10 x 1,10 x 0,25", "110x110x25"), ("(110x110x25)", "110x110x25"), ("250x300mm", "25x30"), ("ép. 20", "20"), ("e=15", "15"), ("ep : 0.20", "20"), ("ÉP. 20", "20"), ("EP 15 cm", "15"), ("25\u00a0x\u00a030", "25x30"), ("\t25x30 ", "25x30"), ("5x5", None), ("900x900", None), ("25", None), ("abc", None), ("", None), (None, None)]
cases("p5_section_spellings", SECTIONS, {"sides": "varchar"}, lambda t: {"sides": _sides(L.section_cm(t))})

REFERENCES = [("S2", "semelles", "S2"), ("\tp2\u00a0", "poteaux", "P2"), ("BN1", "poutres", "BN1"), ("POT12", "poteaux", "POT12"), ("M3", "murs", "M3"), ("LG", "longrines", "LG"), ("n - 3 bis", "poutres", "N3BIS"), ("PIE4", "pieux", "PIE4"), ("CF_2", "contre_forts", "CF2"), *((t, None, None) for t in ("25x30", "8T12", "PLAN", "", "SB1", "S2 110x110", "R12345", None))]
cases("p8_parse_reference", REFERENCES, {"family": "varchar", "reference": "varchar"}, lambda t: {"family": L.parse_reference(t)["family"], "reference": L.parse_reference(t)["reference"]})

TOKENS = [
    ("S1/P1", "S1|P1"), ("D1-V1", "D1|V1"), ("S1(90x90x25)", "S1(90x90x25)"), ("S1(90x90x25)8HA12", "S1|(90x90x25)|8HA12"), ("P1(25x35)", "P1|(25x35)"), ("P2 (25×35) 4HA14+2T12", "P2|(25x35)|4HA14+2T12"), ("N1BIS(25*40)", "N1BIS|(25x40)"),
    ("25x40", "25x40"), ("4HA14+2T12", "4HA14+2T12"), ("6 TOR 12", "6 TOR 12"), ("N3", "N3"), ("ESC1/PIE2", "ESC1|PIE2"), ("SF1-SB2", "SF1|SB2"), ("plan masse", "plan masse"), ("", ""), ("S1/P1/N1", "S1/P1/N1"), (None, None),
]
CLEANED = [("ﬁche m²", "fiche m2"), ("a\u00a0\u00a0b", "a b"), (" x\ty ", "x y"), ("un\ndeux\r\n", "un\ndeux"), ("e\u0301p", "ép"), ("\u0007bip\u007f", "bip"), ("２５×３０", "25×30"), ("", ""), (None, None)]
cases("p1_clean_spellings", CLEANED, {"cleaned": "varchar"}, lambda t: {"cleaned": P.clean_text(t)})
cases("p9_tokenize", TOKENS, {"tokens": "varchar"}, lambda t: {"tokens": F.array_join(L.tokenize(t), "|")})

FAMILIES = [("SF1", "SEMELLE_FILANTE"), ("S1", "SEMELLE"), ("SB2", "SABLIERE"), ("P1", "POTEAU"), ("q2", "POTEAU"), ("PA1", "POUTRE_APPUI"), ("PN3", "POUTRE"), ("PIE1", "PIEU"), ("BN1", "POUTRE"), ("N4", "POUTRE"), ("D1", "DALLE"), ("DS1", "DALLE_SOLIVE"), ("VD1", "VOILE_RINAGE"), ("VT2", "VOILE_TERRAIN"), ("V1", "VOILE"), ("MS1", "MASSIF"), ("M1", "MUR"), ("RD1", "REDRESSEUR"), ("R1", "RADIER"), ("FS1", "INCONNU"), ("F1", "FUT"), ("TR2", "TRAVERS"), ("X1", "INCONNU"), ("", "INCONNU")]
cases("p11_classify_family", FAMILIES, {"family": "varchar"}, lambda t: {"family": L.token_family(t)})

LENGTHS = [
    ("57-0\"", 17.374), ("16'-0\"", 4.877), ("18'", 5.486), ("13’ 6”", 4.115), ("12\"", 0.305), ("10″", 0.254), ("5'–6\"", 1.676), ("3.50", 3.5), ("3,50 m", 3.5), ("350", 3.5), ("350 cm", 3.5), ("3500 mm", 3.5), ("4200", 4.2), ("0.90", 0.9), (".12m", 0.12), ("(3.50)", 3.5), ("[29]", 29.0), ("30", 0.3), ("KITCHEN", None), ("", None), ("P12", None), (None, None),
]
cases("p17_length_spellings", LENGTHS, {"metres": "double"}, lambda t: {"metres": P.length_metres(t)})

ROOMS = [("18'x10\"", None, None), ("13'x10\"", None, None), ("12'x.12m", None, None), ("13'×10'", 3.962, 3.048), ("4.20x3.50", 4.2, 3.5), ("420 x 350", 4.2, 3.5), ("12'x12'", 3.658, 3.658), ("5000*4000", 5.0, 4.0), ("0.2x0.3", None, None), ("P1", None, None), ("41x5", None, None), (None, None, None)]
_room = lambda t, i: F.when(P.room_dims(t).isNotNull(), F.get(P.room_dims(t), i))
cases("p18_room_spellings", ROOMS, {"long_m": "double", "wide_m": "double"}, lambda t: {"long_m": _room(t, 0), "wide_m": _room(t, 1)})

cases("p19_is_dimension", [("57-0\"", True), ("3.50 m", True), ("4200", True), ("350", True), ("3,5", True), ("18'x10'", False), ("KITCHEN", False), ("12", False), ("12.345", False), ("", False), (None, False), ("10″", True)], {"is_length": "boolean"}, lambda t: {"is_length": P.is_dimension(t)})

FREE = [("25x30x2.5", "0.25,0.3,2.5", 15.0), ("Poteau 25 X 30", "0.25,0.3,0.5", 15.0), ("a=1,2 b=110 h=300 e=20", "1.2,1.1,3.0", 20.0), ("ESP : 12,5", "0.4,0.4,0.5", 12.5), ("0x30", "0.4,0.3,0.5", 15.0), ("rien", "0.4,0.4,0.5", 15.0), ("@ 0", "0.4,0.4,0.5", 15.0), ("", "0.4,0.4,0.5", 15.0)]
cases("p20_sanitize", FREE, {"sides": "varchar", "spacing": "double"}, lambda t: {"sides": F.array_join(F.transform(C.free_dimensions(t, (0.4, 0.4, 0.5)), lambda v: v.cast("string")), ","), "spacing": C.free_spacing(t)})

CELLS = [
    ("25x30x25 3T12 4HA10+2T8 cad 6 e=15", "0.25x0.3x0.25", "3T12|4T10|2T8", 6, 0.15), ("0.25x0.30", "0.25x0.3", "", None, None), ("4.5 x 5", "4.5x5.0", "", None, None), ("ETR T8 e@12,5", None, "", 8, 0.125), ("8TOR16", None, "8T16", None, None), ("cadre 8 e=0.2", None, "", 8, 0.2), ("1T8 2T8 3T8 4T8", None, "1T8|2T8|3T8", None, None), ("", None, "", None, None),
]
_text = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), "x")
cases("p22_schedule_cells", CELLS, {"sides": "varchar", "layers": "varchar", "phi_s": "int", "spacing": "double"}, lambda t: {"sides": _text(C.sides_metres(t, F.lit("auto"))), "layers": F.array_join(F.transform(C.bar_layers(t), lambda g: F.concat(g["nb"].cast("string"), F.lit("T"), g["phi"].cast("string"))), "|"), "phi_s": C.stirrup_cell(t)[0], "spacing": C.stirrup_cell(t)[1]})
cases("p22_quantity_cells", [("12", 12), (" 7 ", 7), ("--", None), ("var", None), ("s/p", None), ("3.5", None), ("", None), ("-4", -4), (None, None)], {"qty": "int"}, lambda t: {"qty": C.quantity_cell(t)})
cases("p23_unit_infer", [("25;30;40", "cm", "auto"), ("0.25;0,30", "m", "auto"), ("abc;x", "cm", "auto"), ("5;5", "m", "auto"), ("5;6", "cm", "auto"), ("L (cm);h", "cm", "cm"), ("L m;h", "cm", "m"), ("m", "cm", "m"), ("hauteur m ", "cm", "m"), ("", "cm", "auto")], {"by_values": "varchar", "by_header": "varchar"}, lambda t: {"by_values": C.unit_of_values(F.split(t, ";")), "by_header": C.unit_of_header(F.split(t, ";"))})
cases("p24_column_role", [("Repère", "repere"), ("Section b x h", "section"), ("Armatures", "ferraillage"), ("Longueur", "longueur"), ("Largeur", "largeur"), ("Hauteur", "hauteur"), ("Nbre", "nbre"), ("Type", "type"), ("Niveau", "niveau"), ("Poids", "poids"), ("Remarque", "observation"), ("Observation", "observation"), ("xyz", "unknown"), ("", "unknown")], {"role": "varchar"}, lambda t: {"role": C.column_role(t)})
cases("p25_section_cell", [("25x40", "0.25x0.4", "8T12"), ("0.25 X 0.40", "0.25x0.4", "8T12"), ("10×10.5", "10.0x0.105", "8T12"), ("rien", None, "8T12"), ("", None, "8T12")], {"sides": "varchar", "bars": "varchar"}, lambda t: {"sides": _text(C.section_cell(t)), "bars": F.transform(P.rebar_groups(F.concat(F.lit("8T12 "), t)), lambda g: F.concat(g["nb"].cast("string"), F.lit("T"), g["phi"].cast("string")))[0]})
cases("p27_parse_element", [("N1", "N1", "POUTRE", "", None), ("N1-(25x40)", "N1", "POUTRE", "", "25x40"), ("n3–(25×40)bis", "N3bis", "POUTRE", "bis", "25x40"), ("BN-(60x20)", "BN", "BANDE_NOYEE", "", "60x20"), ("S2ALL", "S2ALL", "SEMELLE", "ALL", None), ("S2-(110x110x25)", "S2", "SEMELLE", "", "110x110x25"), ("ESC1", "ESC1", "INCONNU", "", None), ("N-(25x40)", None, None, None, None), ("N", None, None, None, None), ("XY1", None, None, None, None), (None, None, None, None, None)],
    {"reference": "varchar", "family": "varchar", "suffix": "varchar", "sides": "varchar"}, lambda t: {"reference": L.parse_element(t)["reference"], "family": L.parse_element(t)["family"], "suffix": L.parse_element(t)["suffix"], "sides": _text(L.parse_element(t)["sides"])})
cases("p28_legend_entry", [("N = Poutre", "N", "Poutre"), ("BN : Bande noyée", "BN", "Bande noyée"), ("-S=SEMELLE", "S", "SEMELLE"), ("CH CHAINAGE", "CH", "CHAINAGE"), ("LT - Linteau ", "LT", "Linteau"), ("EMAIL: x@y", None, None), ("NOTA Bene", None, None), ("N poutre", None, None), ("TOOLONGS = x", None, None), ("", None, None)], {"prefix": "varchar", "meaning": "varchar"}, lambda t: {"prefix": L.legend_entry(t)["prefix"], "meaning": L.legend_entry(t)["meaning"]})
cases("p29_level_spellings", [("PLAN DE FONDATION", "FONDATION"), ("Rez-de-chaussée", "RDC"), ("Plan RDC", "RDC"), ("R+0", "RDC"), ("R + 1", "R+1"), ("1er étage", "R+1"), ("premier etage", "R+1"), ("2EME ETAGE", "R+2"), ("troisième étage", "R+3"), ("R+4", "R+4"), ("Toiture", "TOIT"), ("Terrasse  accessible", "TOIT"), ("sous-sol", "SOUS_SOL"), ("SS 1", "SOUS_SOL"), ("PL.HT R+2", "R+2"), ("coupe A", None), ("", None)], {"level": "varchar"}, lambda t: {"level": P.level_name(t)})
TITLES = [
    ("BAEL 91 modifiés 99 - Béton B25 - Aciers HA500 - Enrobage minimum = 3 cm", "BAEL 91 modifiees 99|B25|HA500|HA500|3 cm", "", "", ""), ("RPS 2000 fc=25 MPa", "RPS 2000|fc=25 MPa", "", "", ""), ("Indice : C 12/05/2023 2 emission", "", "C", "12/05/2023", "2eme EMISSION"), ("Regles de calcul 250 daN/m2", "Regles de calcul (non specifiees)|250 daN/m2", "", "", ""), ("INDICE B 1-2-24", "", "B", "1-2-24", ""), ("", "", "", "", ""),
    ("Fisuration peu préjudiciable", "Classe d'exposition: peu prejudiciable", "", "", ""), ("Sol : Contrainte = 2 Bars", "Contrainte sol: 2 Bars", "", "", ""),
]
cases("p30_regulatory", TITLES, {"rules": "varchar", "indice": "varchar", "issued": "varchar", "label": "varchar"}, lambda t: {"rules": F.array_join(F.transform(C.regulations(t), lambda r: r["rule"]), "|"), "indice": C.revision(t)["indice"], "issued": C.revision(t)["date"], "label": C.revision(t)["label"]})
cases("p31_spacing_load", [("Esp=15", 15.0, None, None), ("cad e = 12,5", 12.5, None, None), ("250 daN/m2", None, 250.0, "daN/m2"), ("350 kg/m²", None, 350.0, "kg/m²"), ("5 kN/m2 e=20", 20.0, 5.0, "kN/m2"), ("rien", None, None, None), ("", None, None, None)], {"spacing": "double", "load": "double", "unit": "varchar"}, lambda t: {"spacing": C.spacing_note(t), "load": C.load_note(t)["load"], "unit": C.load_note(t)["unit"]})


@query("p10_expand_words", "select p_partkey as type, unnest(case p_partkey % 4 when 0 then ['S' || p_partkey, 'P1'] when 1 then ['P' || p_partkey, '(25x35)', '4HA14'] when 2 then ['N' || p_partkey] else ['25x40'] end) token from part")
def p10_expand_words(spark, sf):
    key = F.col("p_partkey").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("S"), key, F.lit("/P1")), F.concat(F.lit("P"), key, F.lit("(25x35)4HA14")), F.concat(F.lit("N"), key), F.lit("25x40")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("type"), F.explode(L.tokenize(text)).alias("token"))


@query("p21_alias_coalesce", "select p_partkey as type, case p_partkey % 4 when 0 then 'SEM ' || p_partkey when 1 then 'nat' when 2 then 'desc' end as said from part")
def p21_alias_coalesce(spark, sf):
    k = F.col("p_partkey") % 4
    fields = (F.when(k == 0, F.concat(F.lit(" SEM \t"), F.col("p_partkey").cast("string"))).when(k == 1, ""), F.when(k == 1, "nat"), F.when(k == 2, "desc"))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("type"), C.first_filled(*fields).alias("said"))


@query("p34_formula_text", "select p_partkey as type, '=' || p_size || '+' || (p_partkey % 7) || '.' || (p_partkey % 9 + 1) || '-120/2' formula, p_size || ',' || lpad((p_partkey % 100)::varchar, 2, '0') french from part")
def p34_formula_text(spark, sf):
    number = lambda c: c.cast("double")
    term = lambda sign, value, divisor: F.struct(F.lit(sign).alias("sign"), number(value).alias("number"), F.lit(float(divisor)).alias("divisor"))
    key = F.col("p_partkey")
    terms = F.array(term(1, F.col("p_size"), 1), term(1, key % 7 + (key % 9 + 1) / 10, 1), term(-1, F.lit(120), 2))
    return read(spark, sf, "part").select(key.alias("type"), C.formula_text(terms).alias("formula"), C.french_number(number(F.col("p_size")) + key % 100 / 100).alias("french"))


_TEXTS = [
    ("S1(90x90x25)8HA12", "SEMELLE", "S1", 0.9, 0.9, 0.25, 8, 12), ("SF2", "SEMELLE_FILANTE", "SF2", None, None, None, None, None), ("Semelle 3", "SEMELLE", "3", None, None, None, None, None), ("Poteau 5 S1", "POTEAU", "5", None, None, None, None, None),
    ("P1 S1", "SEMELLE", "S1", None, None, None, None, None), ("pa3", "POUTRE_APPUI", "PA3", None, None, None, None, None), ("N2BIS(25x40)", "POUTRE", "N2BIS", 0.25, 0.4, None, None, None), ("DS2 4 Ø 10", "DALLE_SOLIVE", "DS2", None, None, None, 4, 10),
    ("VD1 20x300", "VOILE_RINAGE", "VD1", 0.2, 3.0, None, None, None), ("SHEAR WALL 7", "VOILE", "7", None, None, None, None, None), ("LG-(25X35)", "LONGRINE", "LG", 0.25, 0.35, None, None, None), ("BN-25x20-", "BANDE_NOYEE", "BN", 0.25, 0.2, None, None, None),
    ("N-(25X45)ALL", "POUTRE", "N", 0.25, 0.45, None, None, None), ("R1", "RADIER", "R1", None, None, None, None, None), ("M2", "MUR", "M2", None, None, None, None, None), ("LG1 4T50", "POUTRE", "LG1", None, None, None, None, None), ("COL3 0,3*0.4", "POTEAU", "3", 0.3, 0.4, None, None, None),
    ("RD1", "REDRESSEUR", "RD1", None, None, None, None, None), ("ESC1", "ESCALIER", "ESC1", None, None, None, None, None), ("PIE4", "PIEU", "PIE4", None, None, None, None, None), ("C1(25x25)", None, None, 0.25, 0.25, None, None, None), ("", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None),
]
_PARTS = {"family": "varchar", "reference": "varchar", "a": "double", "b": "double", "h": "double", "nb": "int", "phi": "int"}
cases("p12_decompose_label", _TEXTS, _PARTS, lambda t: {k: D.decompose(t)[k] for k in _PARTS})


def _joined(prefix, key):
    """A label composed of a part's own columns: its reference, section and bars."""
    return F.concat(F.lit(prefix), key, F.lit("("), (20 + F.col("p_size")).cast("string"), F.lit("x"), (30 + F.col("p_size")).cast("string"), F.lit(") "), (2 + F.col("p_size") % 9).cast("string"), F.lit("HA"), (8 + F.col("p_size") % 5).cast("string"))


_DATASET = [
    ("POUTRE B12 0.25x0.40 4HA12 + 2T10 axe: A-3 file B", "POUTRE", "B12", "A-3", "B", 0.25, 0.4, "longitudinal", "4x12+2x10", "high", ""),
    ("w7 wall 200*3000", "VOILE", "200", "", "", 0.2, 3.0, "vertical", "", "high", "armatures absentes de l'annotation"),
    ("V3 : VOILE", "VOILE", "V3", "", "", None, None, "vertical", "", "low", "dimensions absentes de l'annotation; armatures absentes de l'annotation"),
    ("beam-C4 grid=7 3 TOR 16", "POUTRE", "C4", "", "7", None, None, "longitudinal", "3x16", "low", "dimensions absentes de l'annotation"),
    ("25x40", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None),
]
_FIELDS = {"family": "varchar", "reference": "varchar", "axis": "varchar", "grid": "varchar", "a": "double", "b": "double", "role": "varchar", "bars": "varchar", "confidence": "varchar", "warnings": "varchar"}
cases("p35_dataset_elements", _DATASET, _FIELDS, lambda t: {k: D.dataset_element(t, F.lit(None).cast("string"))[k] for k in _FIELDS})


@query("p12_decompose_parts", "with t as (select p_partkey as type, p_size s, ['SF', 'P', 'PA', 'DS', 'VT', 'RD', 'LG'][p_partkey % 7 + 1] p, ['SEMELLE_FILANTE', 'POTEAU', 'POUTRE_APPUI', 'DALLE_SOLIVE', 'VOILE_TERRAIN', 'REDRESSEUR', 'POUTRE'][p_partkey % 7 + 1] family from part) select type, family, p || type as reference, (20 + s) / 100.0 a, (30 + s) / 100.0 b, (2 + s % 9)::int nb, (8 + s % 5)::int phi from t")
def p12_decompose_parts(spark, sf):
    """Labels composed of every part's own columns, taken apart again."""
    key = F.col("p_partkey").cast("string")
    names = F.array(*(_joined(p, key) for p in ("SF", "P", "PA", "DS", "VT", "RD", "LG")))
    made = read(spark, sf, "part").select(F.col("p_partkey").alias("type"), F.get(names, (F.col("p_partkey") % 7).cast("int")).alias("text"))
    d = made.withColumn("d", D.decompose(F.col("text")))
    return d.select("type", *(F.col(f"d.{k}").alias(k) for k in ("family", "reference", "a", "b", "nb", "phi")))
