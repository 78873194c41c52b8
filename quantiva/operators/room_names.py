"""Names of rooms among the words read on a sheet: which words are names, and which lines and numbers make one name.

Words are told apart by built-in functions. Stacked lines and room numbers are put together in reading order, each
choice seeing the boxes as they have grown by then, so the names of a sheet are gathered and folded where they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import parsing as P

# fixed values: parts of words that name rooms, and of words that never do
ROOMS = [
    "chambre", "ch", "salon", "sejour", "séjour", "cuisine", "sdb", "salle", "bain", "douche", "wc", "toilette", "hall", "entree", "entrée",
    "couloir", "degagement", "dégagement", "bureau", "terrasse", "balcon", "garage", "buanderie", "patio", "cellier", "placard", "dressing",
    "rangement", "cage", "escalier", "local", "loggia", "veranda", "bibliotheque", "atelier", "cave", "jardin", "cour", "porche",
    "bedroom", "kitchen", "living", "dining", "bath", "bathroom", "closet", "foyer", "laundry", "office", "room", "master", "walk-in", "pantry",
    "porch", "storage", "study", "den", "nook", "mudroom", "powder", "utility", "lobby", "corridor",
]
NEVER = [
    "scale", "echelle", "échelle", "plan", "floorplan", "residential", "niveau", "etage", "étage", "rdc", "coupe", "facade", "façade", "nord",
    "north", "detail", "détail", "legende", "légende", "date", "dessin", "projet", "client", "architecte", "ingenieur", "ingénieur", "titre",
    "notes", "note", "sheet", "drawn", "checked",
]
MARGIN = 0.02  # of the envelope's longer side
ASIDE, OVER, UNDER = 0.6, 0.6, 1.2  # of widths and heights: lines of one name
NUMBER_ASIDE, NUMBER_LINE = 0.8, 0.5


def kind(text: Column) -> Column:
    """``number`` for one or two digits, ``known`` or ``likely`` for a room's name, NULL for any other word."""
    return F.transform(F.array(L.strip(text)), lambda t: F.transform(F.array(F.regexp_replace(t, r"(?U)[0-9\s\-_.]+$", "")), lambda core: _kind(t, core))[0])[0]


def _kind(t: Column, core: Column) -> Column:
    has = lambda words: F.lower(core).rlike("|".join(map(re.escape, words)))
    worded = (F.length(core) >= 2) & core.rlike("[A-Za-zÀ-ÿ]{2,}") & ~t.rlike(r"(?U)[0-9]\s*[x×X*]\s*[0-9]") & ~F.coalesce(P.is_dimension(t), F.lit(False)) & ~has(NEVER)
    likely = t.rlike(r"^[A-ZÀ-Ý][A-ZÀ-Ý\-]{2,}[0-9]?$")
    return F.when(t.rlike("^[0-9]{1,2}$"), "number").when(worded, F.when(has(ROOMS), "known").when(likely, "likely"))


def candidates(words: DataFrame, sheets: DataFrame) -> DataFrame:
    """Words (sheet, id, text, x, y, w, h, conf) that are names or numbers, with their kind, within the building's
    envelope (``sheets``: sheet, bx, by, bw, bh; null: anywhere). Names may stick out by a margin, numbers not."""
    # exploded, so that what a word is gets worked out once
    told = words.withColumn("told", F.explode(F.array(F.struct(L.strip(F.col("text")).alias("text"), kind(F.col("text")).alias("kind")))))
    found = told.filter("told.kind is not null").withColumns({"text": F.col("told.text"), "kind": F.col("told.kind")}).drop("told").join(sheets.select("sheet", "bx", "by", "bw", "bh"), "sheet", "left")
    out = F.when(F.col("kind") == "number", 0.0).otherwise(MARGIN * F.greatest("bw", "bh"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = cx.between(F.col("bx") - out, F.col("bx") + F.col("bw") + out) & cy.between(F.col("by") - out, F.col("by") + F.col("bh") + out)
    return found.filter(F.coalesce(inside, F.lit(True))).drop("bx", "by", "bw", "bh")


class _Name:
    __slots__ = ("text", "x", "y", "w", "h", "conf", "known", "words")

    def __init__(self, text: str, x: float, y: float, w: float, h: float, conf: float, known: bool) -> None:
        self.text, self.x, self.y, self.w, self.h, self.conf, self.known = text, x, y, w, h, conf, known
        self.words = 1

    @property
    def cx(self) -> float:
        return self.x + self.w / 2

    @property
    def cy(self) -> float:
        return self.y + self.h / 2

    def below(self, other: _Name, aside: float, height: float) -> bool:
        """Whether this one is a line under the other: centred under it within ``aside`` of the wider, and not far."""
        gap = self.y - (other.y + other.h)
        return abs(self.cx - other.cx) < aside * max(self.w, other.w) and -OVER * min(self.h, other.h) <= gap <= UNDER * height

    def take(self, other: _Name) -> None:
        right, bottom = max(self.x + self.w, other.x + other.w), max(self.y + self.h, other.y + other.h)
        self.x, self.y = min(self.x, other.x), min(self.y, other.y)
        self.w, self.h = right - self.x, bottom - self.y
        self.text, self.conf, self.known = f"{self.text} {other.text}", min(self.conf, other.conf), self.known or other.known
        self.words += other.words


def fold(names: list[_Name], numbers: list[_Name]) -> list[_Name]:
    """Names from top to bottom, each line put to the first name that it is under, then each number to the nearest."""
    made: list[_Name] = []
    for n in sorted(names, key=lambda n: (n.cy, n.cx)):
        over = next((m for m in made if n.below(m, ASIDE, max(n.h, m.h))), None)
        made.append(n) if over is None else over.take(n)
    made.sort(key=lambda m: m.y + m.h)
    for n in numbers:
        beside = [m for m in made if n.below(m, NUMBER_ASIDE, m.h) or (abs(m.cy - n.cy) < NUMBER_LINE * m.h and 0 <= n.x - (m.x + m.w) <= UNDER * m.h)]
        if beside:
            min(beside, key=lambda m: abs(n.cy - m.cy) + abs(n.cx - m.cx)).take(n)
    for m in made:
        m.text = re.sub(r"\s*\d{3,}$", "", m.text).strip() or m.text
    return made


def room_names(words: DataFrame, sheets: DataFrame) -> DataFrame:
    """``sheet, k, text, x, y, w, h, conf, known, words``: the rooms named on each sheet, ``k`` from top to bottom.

    Words are taken by place and id; numbers by id. A number that is near no name is none. Null confidences count as 0.8.
    """
    own = F.struct("id", "kind", "text", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), F.coalesce(F.col("conf").cast("double"), F.lit(0.8)).alias("conf"))
    held = candidates(words, sheets).groupBy("sheet").agg(F.array_sort(F.collect_list(own)).alias("words"))
    sheet = words.schema["sheet"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, own in enumerate(batch.column(1)):  # one sheet at a time as Python's rows, not the whole batch
                words = own.as_py()
                named = lambda number: [_Name(w["text"], w["x"], w["y"], w["w"], w["h"], w["conf"], w["kind"] == "known") for w in words if (w["kind"] == "number") == number]  # noqa: E731, B023
                rows += [(i, k, m.text, m.x, m.y, m.w, m.h, m.conf, m.known, m.words) for k, m in enumerate(fold(named(False), named(True)))]
            if rows:
                i, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), *map(pa.array, columns)], ["sheet", "k", "text", "x", "y", "w", "h", "conf", "known", "words"])

    return held.mapInArrow(run, f"sheet {sheet}, k bigint, text string, x double, y double, w double, h double, conf double, known boolean, words bigint")
