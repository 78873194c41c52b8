"""File sources and sinks: kinds by extension, inventories, JSON documents, CSV indexes and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: kind of a file by its extension
KINDS = {"dxf": "DXF", "dwg": "DWG", "pdf": "PDF_VECTORIEL", "png": "IMAGE", "jpg": "IMAGE", "jpeg": "IMAGE", "tif": "IMAGE", "tiff": "IMAGE", "bmp": "IMAGE"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def source_kind(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(F.element_at(kinds, extension(path)), F.lit("UNKNOWN"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime, kind`` of each file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", "modificationTime", source_kind(F.col("path")).alias("kind"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON document; malformed ones are rows of NULL."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def csv_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def entries(column: Column) -> Column:
    """A map column as rows of ``key, value``: to be given to ``select``."""
    return F.explode(F.map_entries(column))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, those of ``new`` where both have one; columns are those of ``old``, keys unique in each."""
    a, b = old.alias("a").withColumn("__old", F.lit(True)), new.alias("b").withColumn("__new", F.lit(True))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pick = lambda c: F.when(F.col("__new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return a.join(b, on, "full").select(*(pick(c) for c in old.columns))


# fixed values: kind of a file by its first bytes, as hexadecimal digits
SIGNATURES = {"25504446": "PDF", "89504e47": "PNG", "ffd8ff": "JPEG", "414331": "DWG", "504b0304": "ZIP", "49534f2d31303330332d3231": "IFC"}


def signature(content: Column) -> Column:
    """Kind of a file's content: by its first bytes, DXF by its first group, else TEXT (EMPTY without any)."""
    head = F.lower(F.hex(F.substring(content, 1, 64)))
    out = F.when(head == "", "EMPTY").when(F.decode(F.substring(content, 1, 64), "ISO-8859-1").rlike(r"^\s*0\s+SECTION"), "DXF").otherwise("TEXT")
    for bytes_, kind in SIGNATURES.items():
        out = F.when(head.startswith(bytes_), kind).otherwise(out)
    return out


def split_inventory(paths: DataFrame) -> DataFrame:
    """``dataset`` (the folder above), files in its train, validation and test folders, and a status."""
    at = F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)/[^/]+$", 2)
    named = paths.select(at[0].alias("dataset"), at[1].alias("split"))
    counts = named.groupBy("dataset").agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")))
    return counts.withColumn("status", F.when(F.col("train") + F.col("validation") + F.col("test") > 0, "valid").otherwise("incomplete"))


def preflight_score(width: Column, height: Column, bars: Column, keywords: Column, drawings: Column, pages: Column) -> Column:
    """Points for a sheet that looks like a plan; at least 50 for vector drawings or several pages."""
    points = lambda when, n: F.when(when, n).otherwise(0)
    raw = points(width > height, 15) + points((width > 800) | (height > 800), 10) + points(bars, 20) + F.least(keywords * 8, F.lit(45)) + points(drawings > 50, 15)
    return F.when((drawings > 0) | (pages > 1), F.greatest(raw, F.lit(50))).otherwise(raw)


# fixed values: sides in millimetres of sheet formats
SHEETS = {"A0": (1189, 841), "A1": (841, 594), "A2": (594, 420), "A3": (420, 297)}


def sheet_size(width: Column, height: Column) -> Column:
    """The first format that both sides meet within 10 %, either way round; else by the width."""
    near = lambda v, of: F.abs(v - of) / of < 0.10
    out = F.when(width > 800, "custom_large").when(width > 500, "custom_medium").otherwise("unknown")
    for name, (w, h) in reversed(SHEETS.items()):
        out = F.when((near(width, w) & near(height, h)) | (near(width, h) & near(height, w)), name).otherwise(out)
    return out


def sheet_sizes(sheets: dict[str, DataFrame]) -> DataFrame:
    """``sheet, n``: rows of each sheet."""
    from functools import reduce

    return reduce(DataFrame.unionByName, (d.agg(F.count("*").alias("n")).select(F.lit(s).alias("sheet"), "n") for s, d in sheets.items()))


def write_sheets(sheets: dict[str, DataFrame], folder: str, kind: str = "csv", append: bool = False) -> None:
    """Each sheet as a table of its own below ``folder``; appending adds to what is there."""
    for name, d in sheets.items():
        d.write.format(kind).option("header", "true").mode("append" if append else "overwrite").save(f"{folder}/{name}")


def json_dump(df: DataFrame, folder: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


# fixed values: families of IFC entities
IFC_FAMILIES = {"IFCBEAM": "POUTRE", "IFCCOLUMN": "POTEAU", "IFCFOOTING": "SEMELLE", "IFCSLAB": "DALLE", "IFCWALL": "VOILE", "IFCWALLSTANDARDCASE": "VOILE", "IFCSTAIR": "ESCALIER", "IFCRAILING": "GARDE_CORPS", "IFCCURTAINWALL": "VOILE", "IFCPILE": "PIEU"}


def ifc_elements(spark: SparkSession, path: str) -> DataFrame:
    """``file, entity, kind, family, guid, name`` of the structural entities of IFC (STEP) files, read line by line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    pattern = r"^\s*#([0-9]+)\s*=\s*(IFC[A-Z]+)\s*\(\s*'([^']*)'\s*,[^,]*,\s*(?:'((?:[^']|'')*)'|\$)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    family = F.element_at(F.create_map(*(F.lit(x) for kv in IFC_FAMILIES.items() for x in kv)), F.col("kind"))
    found = lines.filter(F.col("value").rlike(pattern)).select("file", part(1).cast("bigint").alias("entity"), part(2).alias("kind"), part(3).alias("guid"), F.nullif(part(4), F.lit("")).alias("name"))
    return found.withColumn("family", family).filter(F.col("family").isNotNull()).select("file", "entity", "kind", "family", "guid", "name")


# fixed values: class of a DXF layer by pattern, the first that is found
DXF_LAYERS = [("poteaux", r"POTEAU|COLONNE|COLUMN|P[0-9]|Q[0-9]"), ("poutres", r"POUTRE|BEAM|N[0-9]|BN[0-9]|LG[0-9]"), ("semelles", r"SEMELLE|FOOTING|S[0-9]|SF[0-9]"), ("longrines", r"LONGRINE|GRADE.?BEAM"), ("chainages", r"CHAINAGE|TIE.?BEAM|CH[0-9]"), ("voiles", r"VOILE|WALL|SHEAR|V[0-9]"), ("dalle", r"DALLE|SLAB|D[0-9]"), ("ferraillage", r"FERR|REBAR|ARMATURE|ACIER"), ("cotes", r"COTE|DIM"), ("axes", r"AXE|AXIS|GRID"), ("niveaux", r"NIVEAU|LEVEL|ETAGE|FONDATION|RDC|R\+|R[0-9]|REZ")]


def layer_class(layer: Column) -> Column:
    out = F.lit("autre")
    for name, pattern in reversed(DXF_LAYERS):
        out = F.when(F.upper(layer).rlike(pattern), name).otherwise(out)
    return out


def dxf_entities(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("TEXT", "MTEXT", "INSERT", "LINE", "LWPOLYLINE", "DIMENSION")) -> DataFrame:
    """``file, seq, kind, layer, layer_class, text, xs, ys`` of the entities of DXF files: pairs of a group code and a value.

    A file is one row: its pairs are folded into entities in the JVM.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    n = F.floor(F.size("lines") / 2).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.trim(F.get("lines", 2 * i - 2)).alias("code"), F.trim(F.get("lines", 2 * i - 1)).alias("value"), i.alias("i")))
    each = whole.filter(n > 0).select("file", F.inline(pairs))
    from pyspark.sql import Window

    so_far = Window.partitionBy("file").orderBy("i")
    numbered = each.withColumn("seq", F.sum((F.col("code") == "0").cast("int")).over(so_far))
    first = lambda code: F.min_by(F.when(F.col("code") == code, F.col("value")), F.when(F.col("code") == code, F.col("i")))
    places = lambda code: F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == code, F.struct("i", "value")))), lambda s: s["value"].try_cast("double"))
    made = numbered.groupBy("file", "seq").agg(first("0").alias("kind"), first("8").alias("layer"), first("1").alias("text"), places("10").alias("xs"), places("20").alias("ys"))
    return made.filter(F.col("kind").isin(*kinds)).select("file", "seq", "kind", "layer", layer_class(F.col("layer")).alias("layer_class"), "text", "xs", "ys")


def route(paths: DataFrame) -> DataFrame:
    """``path, kind, reader, partial``: the reader of each file by its kind; files of no kind are partial documents."""
    kind = source_kind(F.col("path"))
    readers = F.create_map(*(F.lit(x) for kv in {"DXF": "dxf_entities", "IMAGE": "binaryFile", "PDF_VECTORIEL": "binaryFile"}.items() for x in kv))
    reader = F.when(extension(F.col("path")) == "ifc", "ifc_elements").otherwise(F.element_at(readers, kind))
    return paths.select("path", kind.alias("kind"), reader.alias("reader"), reader.isNull().alias("partial"))
