"""Fixed values of the domain: reference tables that results depend on."""

# kg per metre of bar by nominal diameter in mm
BAR_MASS = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 14: 1.208, 16: 1.578, 20: 2.466, 25: 3.853, 32: 6.313, 40: 9.864}
# admissible steel ratios in kg/m3 by category
RATIO_BOUNDS = {"semelle": (40.0, 95.0), "poteau": (100.0, 210.0), "poutre": (95.0, 185.0), "longrine": (75.0, 140.0), "chainage": (65.0, 125.0), "voile": (65.0, 140.0), "dalle_pleine": (75.0, 145.0)}
# price codes by category
PRICE_CODES = {"beton_proprete": "B.01", "semelle": "B.02", "longrine": "B.04", "chainage": "B.04", "poteau": "B.05", "poutre": "B.06", "voile": "B.07", "dalle_pleine": "B.08", "acier": "A.01"}
# unit prices by price code, before tax, and the tax rate in percent
UNIT_PRICES = {"B.01": 650.0, "B.02": 1150.0, "B.04": 1200.0, "B.05": 1300.0, "B.06": 1300.0, "B.07": 1350.0, "B.08": 1300.0, "A.01": 13.50}
VAT_PERCENT = 20
# lengths in metres of a stock bar; hook and lap lengths in diameters; concrete covers in metres, foundations and above
STOCK_BAR, HOOKS, LAP, COVER_FOUNDATION, COVER = 12, 30, 50, 0.05, 0.025
# blinding below footings: overhang and thickness in metres
BLINDING_OVERHANG, BLINDING_DEPTH = 0.10, 0.10
# family of a label by its prefix, longest prefix first when matched
PREFIXES = {"SF": "semelle", "S": "semelle", "PT": "poteau", "P": "poteau", "LG": "longrine", "L": "longrine", "CH": "chainage", "N": "poutre", "V": "voile"}

# prefix of a reference and its family, in order of priority
REFERENCE_FAMILIES = [
    ("ESC", "escaliers"), ("SEM", "semelles"), ("SF", "semelles"), ("POT", "poteaux"), ("PIE", "pieux"), ("PD", "poteaux"), ("PO", "poteaux"),
    ("BN", "poutres"), ("PN", "poutres"), ("PC", "poutres"), ("PR", "poutres"), ("LG", "longrines"), ("CH", "chainages"), ("LT", "linteaux"),
    ("MS", "massifs"), ("RD", "redresseurs"), ("CF", "contre_forts"), ("S", "semelles"), ("P", "poteaux"), ("Q", "poteaux"), ("N", "poutres"),
    ("M", "murs"), ("V", "voiles"), ("D", "dalles"), ("R", "radiers"), ("F", "futs"),
]
# dimensions of a family in the order in which they are written; that of a prefix takes its place
SECTION_RULES = {
    "semelles": ["a", "b", "h"], "massifs": ["a", "b", "h"], "radiers": ["a", "b", "h"], "poteaux": ["a", "b"], "poutres": ["b", "h"],
    "longrines": ["b", "h"], "chainages": ["b", "h"], "linteaux": ["b", "h"], "consoles": ["b", "h"], "poutrelles": ["b", "h"], "murs": ["a", "h"],
    "voiles": ["a", "h"], "dalles": ["h"], "escaliers": ["a", "b", "h"], "contre_forts": ["a", "b"], "futs": ["a", "b"], "pieux": ["a"], "redresseurs": ["a", "b"],
}
PREFIX_RULES = {"SF": ["a", "h"]}
# level by pattern, the first that is found
# fixed values: patterns that decide results
LEVELS = [
    (r"FONDATION|FOND\b|SE FONDATION", "FONDATION"), (r"REZ.?DE.?CHAUSS|REZ.?CHAUS|RDC", "RDC"), (r"R\s*\+\s*0|R\s*0\b", "RDC"),
    (r"R\s*\+\s*1|PREMIER?\s*ETAGE|1ER?\s*ETAGE", "R+1"), (r"R\s*\+\s*2|DEUXIEME?\s*ETAGE|2EME?\s*ETAGE", "R+2"),
    (r"R\s*\+\s*3|TROISIEME?\s*ETAGE|3EME?\s*ETAGE", "R+3"), (r"R\s*\+\s*4|QUATRIEME?\s*ETAGE|4EME?\s*ETAGE", "R+4"),
    (r"TOIT|TERRASSE\s+ACCESSIBLE|TOITURE|PLEIN\s*DE\s*CHARGE", "TOIT"), (r"SOUS.?SOL|SS\b|SSOL", "SOUS_SOL"),
]
# family of each of the label prefixes of composite tokens
TOKEN_FAMILIES = {
    "S": "SEMELLE", "SF": "SEMELLE_FILANTE", "P": "POTEAU", "Q": "POTEAU", "N": "POUTRE", "BN": "POUTRE", "PN": "POUTRE", "D": "DALLE", "DS": "DALLE_SOLIVE",
    "V": "VOILE", "VD": "VOILE_RINAGE", "VT": "VOILE_TERRAIN", "ESC": "ESCALIER", "LG": "LONGRINE", "CH": "CHAINAGE", "M": "MUR", "R": "RADIER", "RD": "REDRESSEUR",
    "MS": "MASSIF", "LT": "LINTEAU", "SB": "SABLIERE", "CV": "COUVERTINE", "PA": "POUTRE_APPUI", "TR": "TRAVERS", "CF": "CONTRE_FORT", "F": "FUT", "PIE": "PIEU",
}
# family of the prefixes of elements with a BIS or ALL suffix
ELEMENT_FAMILIES = {
    "N": "POUTRE", "BN": "BANDE_NOYEE", "LG": "LONGRINE", "CH": "CHAINAGE", "P": "POTEAU", "Q": "POTEAU", "S": "SEMELLE", "V": "VOILE", "D": "DALLE",
    "LT": "LINTEAU", "PR": "POUTRE_REDOUBLANTE", "M": "MASSIF", "R": "RADIER", "RD": "REDRESSEUR",
}
# words that are no prefix of a legend
LEGEND_IGNORE = ["AXIAL", "BIM", "EMAIL", "TEL", "FAX", "LES", "DES", "TYP", "PROJET", "CLASSE", "ROYAUME", "MAROC", "AGENCE", "NOTA"]
# role of a table column by pattern of its header, the first that is found
# fixed values: patterns that decide results
COLUMN_ROLES = [
    ("repere", r"rep[eè]re|designation|nom|element|code|ref"), ("section", r"section|dimension|b\s*[xX×]\s*h|epaisseur"), ("ferraillage", r"ferraillage|armature|acier|fer|arm|ha\s*[0-9]"),
    ("longueur", r"long(?:ueur)?|portee|porte|lg|l\b"), ("largeur", r"larg(?:ueur)?|l\b"), ("hauteur", r"haut(?:eur)?|h\b|ep(?:aisseur)?"), ("nbre", r"nb|nombre|quantit|qty"),
    ("type", r"type|famille|classe|categorie"), ("niveau", r"niveau|etage|rdc|plan|phase"), ("poids", r"poids|mass|weight"), ("observation", r"observ|remarque|note|comment"),
]
# design rules of a title block: category, pattern and text, {0} and {1} being the pattern's groups
# fixed values: patterns that decide results
REGULATIONS = [
    ("regles_calcul", r"BAEL\s*([0-9]{2})\s*MODIFI[EÉ]S?\s*([0-9]{2})", "BAEL {0} modifiees {1}"), ("regles_calcul", r"R\.?P\.?S\.?\s*([0-9]{4})", "RPS {0}"),
    ("regles_calcul", r"REGLES?\s+DE\s+CALCUL", "Regles de calcul (non specifiees)"), ("classe_beton", r"[BÉE]TON\s+B([0-9]+)", "B{0}"), ("resistance_beton", r"FC\s*=\s*([0-9]+)\s*MPA", "fc={0} MPa"),
    ("classe_acier", r"ACIERS?\s+HA\s*([0-9]+)", "HA{0}"), ("classe_acier", r"HA\s*([0-9]+)", "HA{0}"), ("enrobage_min", r"[EÉ]NROBAGE\s+MINIMUM\s*=\s*([0-9]+)\s*CM", "{0} cm"),
    ("charge", r"([0-9]+)\s*DAN/M[SUP2²]", "{0} daN/m2"),
    ("fissuration", r"FISURATION\s+PEU\s+PR[EÉ]JUDICIABLE", "Classe d'exposition: peu prejudiciable"), ("sol", r"SOL\s*:\s*CONTRAINTE\s*=\s*([0-9]+)\s*BARS?", "Contrainte sol: {0} Bars"),
]
# finish lots: code, unit, base of the quantity, unit price before tax
FINISH_LOTS = [("SO.01", "m2", "surface", 220), ("SO.02", "ml", "perimetre", 35), ("SO.03", "m2", "perimetre_hsp", 60), ("SO.04", "m2", "perimetre_hsp", 45), ("SO.05", "m2", "surface", 80)]
CEILING_HEIGHT = 2.80
# fields that a family needs, with their physical bounds in metres
REQUIRED = {
    "semelles": {"a": (0.30, 6.00), "b": (0.30, 6.00), "h": (0.15, 2.00)}, "poteaux": {"a": (0.10, 2.00), "b": (0.10, 2.00)}, "poutres": {"b": (0.08, 1.00), "h": (0.10, 2.50)},
    "longrines": {"b": (0.10, 1.00), "h": (0.15, 1.50)}, "chainages": {"b": (0.07, 0.80), "h": (0.07, 0.80)}, "massifs": {"a": (0.20, 4.00), "b": (0.20, 4.00), "h": (0.20, 4.00)},
}
# kg per metre of the alternative engine
BAR_MASS_ALT = {6: 0.222, 8: 0.395, 10: 0.617, 12: 0.888, 14: 1.210, 16: 1.580, 20: 2.470, 25: 3.850, 32: 6.310}
# subjects of a text of rules by pattern, case ignored; a text without any is GENERAL
# fixed values: patterns that decide results
SUBJECTS = [
    ("SEMELLE", r"semelles?|fondations?\s*(basses?|isolées?)"), ("POTEAU", r"poteaux?|fûts?\s*de\s*poteau"), ("POUTRE", r"poutres?|poutrelles?|linteaux?"), ("LONGRINE", r"longrines?"), ("CHAINAGE", r"chainages?|chainage\s*d'angle"),
    ("MUR", r"murs?|cloisons?|refends?|bandes?\s*noyées?"), ("VOILE", r"voiles?|voile\s*(porteur|de\s*fachade)"), ("DALLE", r"dalles?|planchers?|hourdis"), ("ESCALIER", r"escaliers?|marches?|paliers?"), ("TERRASSEMENT", r"terrassements?|fouilles?|déblais?|remblais?|décapage|rigoles?"),
    ("MACONNERIE", r"maçonnerie|pierres?|briques?"), ("COFFRAGE", r"coffrages?|coffrage"), ("BETON", r"béton|dosage|confection"), ("FERRAILLAGE", r"ferraillage|acier|armatures?|tor|ha[0-9]|cadres?|étriers?"), ("ETANCHEITE", r"étanchéité|membrane|couvertine"),
    ("ENDUIT", r"enduits?|ragréage|plâtre"), ("PEINTURE", r"peinture|peintures?"), ("MENUISERIE", r"menuiserie|portes?|fenêtres?|volets?"), ("CHARPENTE", r"charpente|fer|bois"),
]
# general meaning of prefixes that a plan's own legend lacks
FALLBACK_LEGEND = {"N": "Poutre", "BN": "Bande noyée", "P": "Poteau", "S": "Semelle", "LG": "Longrine", "CH": "Chaînage", "V": "Voile", "D": "Dalle"}
