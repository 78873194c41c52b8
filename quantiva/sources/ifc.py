"""Structural elements of IFC (STEP) files: statements are read apart, references between them are joins.

A statement is ``#id = KIND(arguments)`` and may refer to others by ``#id``. Files are read by statement, so one of any
size is split over tasks. What an element has is some references away: its storey by a relation that lists it, its
property sets and material likewise, its place through placement and axis to a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: kinds in the order in which elements are numbered, with family and prefix; sets that give dimensions
KINDS = {
    "IFCBEAM": ("POUTRE", "N"), "IFCCOLUMN": ("POTEAU", "P"), "IFCFOOTING": ("SEMELLE", "S"), "IFCSLAB": ("DALLE", "D"),
    "IFCWALL": ("VOILE", "V"), "IFCWALLSTANDARDCASE": ("VOILE", "V"), "IFCSTAIR": ("ESCALIER", "ESC"), "IFCPILE": ("PIEU", "PIE"),
}
SIZED = ["Pset_ElementComponentCommon", "Pset_BeamCommon", "Pset_ColumnCommon", "Pset_FootingCommon", "Pset_SlabCommon", "Pset_WallCommon"]

_TEXT = "'(?:[^']|'')*'"


def _argument(depth: int = 3) -> str:
    """Pattern of one argument: a text, a list or typed value (to a depth), or a plain word."""
    listed = rf"\((?:[^()']|{_TEXT})*\)"
    for _ in range(depth - 1):
        listed = rf"\((?:[^()']|{_TEXT}|{listed})*\)"
    return rf"{_TEXT}|[A-Za-z0-9_]*{listed}|[^,()'\s][^,()']*"


def statements(spark: SparkSession, path: str, reader: DataFrameReader | None = None) -> DataFrame:
    """``file, id, kind, args, bad``: all statements; ``bad`` has the text of one that can't be read, whose kind is null.

    ``reader`` may carry options of its own, such as which files of a folder are read.
    """
    text = (reader or spark.read).option("lineSep", ";").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.trim("value"), r"\A\s+|\s+\z", "").alias("s"))
    own = text.filter(F.col("s").startswith("#"))
    whole = r"(?s)\A#([0-9]+)\s*=\s*([A-Za-z0-9_]+)\s*\((.*)\)\z"
    part = lambda i: F.regexp_extract("s", whole, i)
    even = F.length(F.regexp_replace("s", "[^']", "")) % 2 == 0
    good = F.col("s").rlike(whole) & even
    args = F.when(good, F.regexp_extract_all(part(3), F.lit(f"(?s){_argument()}"), F.lit(0)))
    return own.select("file", F.when(good, part(1).try_cast("bigint")).alias("id"), F.when(good, F.upper(part(2))).alias("kind"), args.alias("args"), F.when(~good, F.col("s")).alias("bad"))


def _value(arg: Column) -> Column:
    """A text without quotes, a typed value without its type, NULL for $ and *."""
    inner = F.regexp_replace(arg, r"(?s)\A\s*[A-Za-z0-9_]+\((.*)\)\s*\z", "$1")
    text = F.regexp_replace(F.regexp_replace(F.trim(inner), r"(?s)\A'(.*)'\z", "$1"), "''", "'")
    return F.when(~F.trim(inner).isin("$", "*", ""), text)


def _ref(arg: Column) -> Column:
    return F.regexp_extract(arg, r"\A\s*#([0-9]+)\s*\z", 1).try_cast("bigint")


def _refs(arg: Column) -> Column:
    return F.transform(F.regexp_extract_all(arg, F.lit("#([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))


def elements(spark: SparkSession, path: str, reader: DataFrameReader | None = None) -> DataFrame:
    """One row for each structural element: file, entity, kind, family, reference, guid, name, mark, storey, material,
    x, y, z, width, height, length (metres, null unless stated) and properties.

    References count by family in the order of KINDS and ids. A relation of a lower id wins; elements without a storey
    have the Level or Storey of their properties, else INCONNU. Statements that can't be read are left to ``statements``.
    """
    s = statements(spark, path, reader).filter("kind is not null").select("file", "id", "kind", "args")
    a = lambda i: F.get("args", F.lit(i))
    of = lambda *kinds: s.filter(F.col("kind").isin(*kinds))
    names = {k: i for i, k in enumerate(KINDS)}
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("kind"))
    family, prefix = (F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[i]))), F.col("kind")) for i in (0, 1))
    own = of(*KINDS).select("file", F.col("id").alias("entity"), "kind", rank.alias("rank"), family.alias("family"), prefix.alias("prefix"), _value(a(0)).alias("guid"), F.coalesce(_value(a(2)), F.concat("kind", F.lit("-"), "id")).alias("name"), _ref(a(5)).alias("placement"))
    counted = own.withColumn("reference", F.concat("prefix", F.row_number().over(Window.partitionBy("file", "family").orderBy("rank", "entity"))))

    def related(kind: str) -> DataFrame:
        """``file, rel, entity, to``: elements with what a relation gives them."""
        return of(kind).select("file", F.col("id").alias("rel"), F.explode(_refs(a(4))).alias("entity"), _ref(a(5)).alias("to"))

    key = ["file", "entity"]
    first = lambda d, c: d.groupBy(*key).agg(F.min(F.struct("rel", c)).alias("m")).select(*key, F.col(f"m.{c}").alias(c))
    places = of("IFCBUILDINGSTOREY", "IFCBUILDING").select("file", F.col("id").alias("to"), F.coalesce(_value(a(2)), F.lit("INCONNU")).alias("storey"))
    storey = first(related("IFCRELCONTAINEDINSPATIALSTRUCTURE").join(places, ["file", "to"]), "storey")

    direct = of("IFCMATERIAL").select("file", F.col("id").alias("to"), _value(a(0)).alias("material"))
    listed = of("IFCMATERIALLIST").select("file", F.col("id").alias("top"), F.posexplode(_refs(a(0))).alias("k", "to")).join(direct, ["file", "to"]).groupBy("file", "top").agg(F.min_by("material", "k").alias("material")).withColumnRenamed("top", "to")
    material = first(related("IFCRELASSOCIATESMATERIAL").join(direct.unionByName(listed), ["file", "to"]), "material")

    sets = of("IFCPROPERTYSET").select("file", F.col("id").alias("to"), _value(a(2)).alias("pset"), F.explode(_refs(a(4))).alias("prop"))
    single = of("IFCPROPERTYSINGLEVALUE").select("file", F.col("id").alias("prop"), _value(a(0)).alias("k"), _value(a(2)).alias("v")).filter("k is not null and v is not null")
    props = related("IFCRELDEFINESBYPROPERTIES").join(sets, ["file", "to"]).join(single, ["file", "prop"])
    last = props.groupBy(*key, "k").agg(F.max_by("v", F.struct("rel", "prop")).alias("v"))
    merged = last.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    sized = props.filter(F.col("pset").isin(*SIZED) & F.col("k").isin("Reference", "Span", "Length")).groupBy(*key, "k").agg(F.max_by("v", F.struct("rel", "prop")).alias("v"))
    of_key = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    sizes = sized.groupBy(*key).agg(*map(of_key, ("Reference", "Span", "Length")))
    side = lambda i: F.regexp_extract(F.col("Reference"), r"([0-9]+)\s*[xX]\s*([0-9]+)(?:\s*[xX]\s*([0-9]+))?", i).try_cast("double") / 100
    sizes = sizes.select(*key, F.round(side(1), 3).alias("width"), F.round(side(2), 3).alias("height"), F.round(F.coalesce(F.col("Span").try_cast("double"), F.col("Length").try_cast("double"), side(3)), 3).alias("length"))

    axis = of("IFCLOCALPLACEMENT").select("file", F.col("id").alias("placement"), _ref(a(1)).alias("axis"))
    point = of("IFCAXIS2PLACEMENT3D").select("file", F.col("id").alias("axis"), _ref(a(0)).alias("point"))
    numbers = F.transform(F.regexp_extract_all(a(0), F.lit(r"[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda v: v.try_cast("double"))
    at = of("IFCCARTESIANPOINT").select("file", F.col("id").alias("point"), numbers.alias("at"))
    place = axis.join(point, ["file", "axis"]).join(at, ["file", "point"]).select("file", "placement", *(F.get("at", F.lit(i)).alias(c) for i, c in enumerate("xyz")))

    out = counted.join(place, ["file", "placement"], "left").join(storey, key, "left").join(material, key, "left").join(merged, key, "left").join(sizes, key, "left")
    prop = lambda k: F.element_at("properties", F.lit(k))
    level = F.coalesce("storey", prop("Level"), prop("Storey"), F.lit("INCONNU"))
    return out.select(*key, "kind", "family", "reference", "guid", "name", F.coalesce(prop("Reference"), "name").alias("mark"), level.alias("storey"), "material", "x", "y", "z", "width", "height", "length", "properties")
