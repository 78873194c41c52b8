"""Entities of DXF drawings as a Spark data source, and the structural elements that they show.

``spark.read.format("dxf").load(path)`` after :func:`register`: a drawing is a partition, read line by line, so it is
never held whole, and any number of drawings are read side by side. A drawing that can't be read any further gives a
row with its reason in ``bad`` and is otherwise the entities read until then.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import labels as L
from .files import layer_class

SCHEMA = "file string, seq bigint, section string, kind string, layer string, name string, text string, xs array<double>, ys array<double>, measure double, attributes map<string,string>, bad string"
_OWN = {"TEXT", "MTEXT", "LINE", "LWPOLYLINE", "POLYLINE", "INSERT", "DIMENSION", "LAYER", "BLOCK"}
_PARTS = {"ATTRIB", "VERTEX"}  # belong to the insert or polyline before them


class Drawing(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def drawings(path: str) -> list[str]:
    """The .dxf files below a folder, those that a name with * stands for, or the one named."""
    from pyarrow import fs

    head, star, _ = path.partition("*")
    system, top = _filesystem(posixpath.dirname(head) if star else path)
    if not star and system.get_file_info(top).type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(top, recursive=True))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    import fnmatch

    names = [scheme + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".dxf")]
    return sorted(n for n in names if not star or fnmatch.fnmatch(n.removeprefix(scheme), path.removeprefix(scheme)))


def pairs(lines: Iterator[str]) -> Iterator[tuple[int, str, int]]:
    """Group codes with values and the number of the code's line."""
    for at, code in enumerate(lines):
        value = next(lines, None)
        if value is None:
            if code.strip():
                raise ValueError(f"line {2 * at + 1}: a group code without a value")
            return
        try:
            yield int(code), value.rstrip("\r\n"), 2 * at + 1
        except ValueError:
            raise ValueError(f"line {2 * at + 1}: {code.strip()[:40]!r} is no group code") from None


class _Entity:
    def __init__(self, kind: str, section: str) -> None:
        self.kind, self.section = kind, section
        self.layer = self.name = self.text = self.measure = None
        self.xs: list[float] = []
        self.ys: list[float] = []
        self.attributes: dict[str, str] = {}
        self.tag = self.value = None  # of the attribute that is read
        self.part: str | None = None
        self.more = ""

    def put(self, code: int, value: str) -> None:
        if self.part == "ATTRIB":
            if code in (1, 2):
                self.tag, self.value = (value, self.value) if code == 2 else (self.tag, value)
                if self.tag is not None and self.value is not None:
                    self.attributes[self.tag] = self.value
                    self.tag = self.value = None
        elif code in (10, 11, 20, 21) and not (self.kind in ("TEXT", "MTEXT", "INSERT", "DIMENSION") and code in (11, 21)):
            if self.kind != "POLYLINE" or self.part == "VERTEX":  # a polyline's own point is not one of its vertices
                (self.xs if code < 20 else self.ys).append(float(value))
        elif self.part is None and code == 8:
            self.layer = value
        elif code == 3 and self.kind == "MTEXT":
            self.more += value
        elif code == 1:
            self.text = value
        elif code == 2 and self.kind in ("INSERT", "BLOCK", "LAYER"):
            self.name = value
        elif code == 42 and self.kind == "DIMENSION":
            self.measure = float(value)

    def row(self, file: str, seq: int) -> tuple:
        text = self.more + (self.text or "") if self.kind == "MTEXT" else self.text
        return file, seq, self.section, self.kind, self.layer, self.name, text, self.xs, self.ys, self.measure, self.attributes or None, None


def entities(lines: Iterator[str], file: str) -> Iterator[tuple]:
    """Rows of a drawing's entities in order; the last may say why it can't be read any further."""
    section, seq, now = "", 0, None
    begun = False
    try:
        for code, value, _ in pairs(lines):
            value = value if code in (1, 3) else value.strip()
            if code == 0:
                if now is not None and value in _PARTS:
                    now.part, now.tag, now.value = value, None, None
                    continue
                if now is not None:
                    yield now.row(file, seq)
                    seq, now = seq + 1, None
                if value == "ENDSEC":
                    section = ""
                begun = value == "SECTION"
                if value in _OWN and (section == "ENTITIES" or value in ("LAYER", "BLOCK")):
                    now = _Entity(value, section)
            elif begun and code == 2:
                section, begun = value, False
            elif now is not None:
                now.put(code, value)
        if now is not None:
            yield now.row(file, seq)
    except (ValueError, UnicodeDecodeError) as e:
        yield file, seq, section, None, None, None, None, None, None, None, None, str(e)


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Drawing]:
        return [Drawing(p) for p in drawings(self.path)]

    def read(self, partition: Drawing) -> Iterator[tuple]:
        import io

        if partition is None:  # no drawing at all
            return
        system, name = _filesystem(partition.path)
        try:
            with system.open_input_stream(name) as raw, io.TextIOWrapper(raw, encoding="utf-8", errors="surrogateescape", newline="\n") as lines:
                for row in entities((x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for x in lines), partition.path):
                    yield row
        except OSError as e:
            yield partition.path, 0, None, None, None, None, None, None, None, None, None, str(e)


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DxfSource)


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("dxf").load(path)


# fixed values: families of references, layers that are notes, levels in names of layers, how sure a kind of element is
REFERENCE = r"(?i)^(ESC|BN|PN|LG|CH|VD|DS|SF|RD|[PQNSVDMR])\s*([0-9]+[a-z]?)(?=$|[\s(_-]*[0-9]+\s*x)"
FAMILIES = {
    "P": "POTEAU", "Q": "POTEAU", "N": "POUTRE", "BN": "POUTRE", "PN": "POUTRE", "S": "SEMELLE", "SF": "SEMELLE", "LG": "LONGRINE", "CH": "CHAINAGE",
    "V": "VOILE", "VD": "VOILE", "D": "DALLE", "DS": "DALLE", "ESC": "ESCALIER", "M": "MUR", "R": "RADIER", "RD": "REDRESSEUR",
}
NOTES = ["cotes", "axes", "niveaux", "ferraillage", "autre"]
LEVELS = [("FONDATION", "FONDATION|FOND"), ("RDC", "RDC|REZ.?DE.?CHAUSS"), ("R+1", r"R\+?\s*1|PREMIER.?ETAGE"), ("R+2", r"R\+?\s*2|DEUXIEME.?ETAGE"), ("R+3", r"R\+?\s*3|TROISIEME.?ETAGE"), ("TOIT", "TOIT|TERRASSE|TOITURE")]
SURE = {"INSERT": 0.6, "TEXT": 0.7, "POLYLINE": 0.4, "LINE": 0.3}
LONG_LINE, UNITS_A_METRE = 500, 1000


def _level(layer: Column) -> Column:
    out = F.lit("INCONNU")
    for level, pattern in reversed(LEVELS):
        out = F.when(F.upper(layer).rlike(pattern), level).otherwise(out)
    return out


def elements(drawn: DataFrame) -> DataFrame:
    """``file, seq, source, reference, family, layer, level, x, y, sides, length, confidence`` of what ``read`` gives.

    Inserts of blocks whose name is that of a family (the reference in the name, else BLOC-<name>); texts that are
    a reference, with the section that follows it if one does; polylines, and lines of more than LONG_LINE, on a family's
    layer: their centre and length in metres. Notes, axes and anonymous blocks are no elements.
    """
    e = drawn.filter("section = 'ENTITIES' and kind is not null").withColumn("class", layer_class(F.coalesce("layer", F.lit(""))))
    prefix = lambda t: F.upper(F.regexp_extract(t, REFERENCE, 1))
    ref = lambda t: F.when(t.rlike(REFERENCE), F.concat(prefix(t), F.regexp_extract(t, REFERENCE, 2)))
    family = lambda t: F.element_at(F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv)), prefix(t))
    first = lambda c: F.get(c, F.lit(0))
    none = F.lit(None)

    def rows(of: DataFrame, source: Column, reference: Column, family: Column, x: Column, y: Column, sure: Column, sides: Column = none, length: Column = none) -> DataFrame:
        return of.select("file", "seq", source.alias("source"), reference.alias("reference"), family.alias("family"), "layer", _level(F.coalesce("layer", F.lit(""))).alias("level"), x.alias("x"), y.alias("y"), sides.cast("string").alias("sides"), length.cast("double").alias("length"), sure.alias("confidence"))

    block = F.coalesce("name", F.lit("*"))
    inserts = e.filter((F.col("kind") == "INSERT") & ~block.startswith("*") & (layer_class(block) != "autre"))
    inserts = rows(inserts, F.lit("INSERT"), F.coalesce(ref(block), F.concat(F.lit("BLOC-"), block)), F.coalesce(family(block), F.upper(layer_class(block))), first("xs"), first("ys"), F.lit(SURE["INSERT"]))
    t = L.strip(F.col("text"))
    said = r"([0-9]+)\s*[xX]\s*([0-9]+)(?:\s*[xX]\s*([0-9]+))?"
    sides = F.when(t.rlike(said), F.array_join(F.filter(F.array(*(F.regexp_extract(t, said, i) for i in (1, 2, 3))), lambda v: v != ""), "x"))
    texts = e.filter(F.col("kind").isin("TEXT", "MTEXT") & (F.length(t) >= 2) & t.rlike(REFERENCE))
    texts = rows(texts, F.lit("TEXT"), ref(t), family(t), first("xs"), first("ys"), F.lit(SURE["TEXT"]), sides)
    n = F.least(F.size("xs"), F.size("ys"))
    step = lambda c, i: F.get(c, i) - F.get(c, i - 1)
    length = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda acc, i: acc + F.hypot(step(F.col("xs"), i), step(F.col("ys"), i)))
    middle = lambda c: (F.array_min(c) + F.array_max(c)) / 2
    lines = e.filter(F.col("kind").isin("LINE", "LWPOLYLINE", "POLYLINE") & ~F.col("class").isin(*NOTES)).filter(n >= 2).withColumn("length", length)
    lines = lines.filter(f"kind <> 'LINE' or length > {LONG_LINE}").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("seq")))
    is_line = F.col("kind") == "LINE"
    lines = rows(lines, F.when(is_line, "LINE").otherwise("POLYLINE"), F.concat(F.lit("GEO-"), "k"), F.upper("class"), middle("xs"), middle("ys"), F.when(is_line, SURE["LINE"]).otherwise(SURE["POLYLINE"]), length=F.round(F.col("length") / UNITS_A_METRE, 2))
    return inserts.unionByName(texts).unionByName(lines)


def extract(spark: SparkSession, path: str) -> DataFrame:
    """``file, elements, problem, partial``: each drawing with its number of elements; one that broke off is partial."""
    drawn = read(spark, path)
    found = elements(drawn).groupBy("file").agg(F.count("*").alias("elements"))
    state = drawn.groupBy("file").agg(F.max("bad").alias("problem"))
    return state.join(found, "file", "left").select("file", F.coalesce("elements", F.lit(0)).alias("elements"), "problem", F.col("problem").isNotNull().alias("partial"))
