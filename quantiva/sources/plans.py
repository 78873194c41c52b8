"""Plans of a folder, whatever their kind, as one table of elements, and what became of each file.

Drawings (DXF), models (IFC) and words read elsewhere (``*.words.json``, one JSON object a word, as a text reader or
recogniser leaves them) have readers here. A file of another kind, or one that can't be read to its end, is not an error:
its elements are those found until then, and its row says that it is partial and why.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import placing
from . import dxf, files, ifc

STANDARD = "file string, page int, source string, reference string, family string, level string, x double, y double, sides string, length double, layer string, confidence double"
WORDS = "page int, id bigint, text string, x double, y double, x1 double, y1 double, _corrupt_record string"
WORD_SUFFIX = ".words.json"
SURE = {"ifc": 0.95, "words": 0.8}  # how sure an element of a model or of a page's label is


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STANDARD)


def _shape(found: DataFrame, **columns) -> DataFrame:
    """The standard columns; those not given are null."""
    kinds = [c.split(" ") for c in STANDARD.split(", ")]
    return found.select(*(columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds))


def drawing_elements(drawn: DataFrame) -> DataFrame:
    e, c = dxf.elements(drawn), F.col
    return _shape(e, file=c("file"), page=F.lit(1), source=F.lit("dxf"), reference=c("reference"), family=c("family"), level=c("level"), x=c("x"), y=c("y"), sides=c("sides"), length=c("length"), layer=c("layer"), confidence=c("confidence"))


def model_elements(found: DataFrame) -> DataFrame:
    """Sections in whole centimetres where the model states them."""
    c = F.col
    cm = lambda n: F.round(c(n) * 100).cast("int").cast("string")
    sides = F.when(c("width").isNotNull(), F.concat_ws("x", cm("width"), cm("height")))
    return _shape(found, file=c("file"), page=F.lit(1), source=F.lit("ifc"), reference=c("reference"), family=c("family"), level=c("storey"), x=c("x"), y=c("y"), sides=sides, length=c("length"), confidence=F.lit(SURE["ifc"]))


def page_elements(words: DataFrame) -> DataFrame:
    """Labels of pages, placed by their words; the level is that which a page names, if it is one only."""
    none = words.select(F.col("file").alias("doc"), "page", *(F.lit(None).cast("double").alias(z) for z in ("zx0", "zy0", "zx1", "zy1"))).limit(0)
    own = words.filter("text is not null").withColumn("doc", F.col("file"))
    level = own.withColumn("l", P.level_name(F.col("text"))).filter("l is not null").groupBy("doc", "page").agg(F.min("l").alias("l"), F.max("l").alias("l2")).filter("l = l2")
    placed = placing.placements(own, none).join(level.select("doc", "page", "l"), ["doc", "page"], "left")
    c = F.col
    return _shape(placed, file=c("doc"), page=c("page"), source=F.lit("words"), reference=c("ref"), family=c("family"), level=c("l"), x=c("x"), y=c("y"), sides=F.nullif("sides", F.lit("")), confidence=F.lit(SURE["words"]))


def extract(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``elements`` (STANDARD) and ``documents`` (file, kind, elements, problem, partial) of all files below a folder.

    Files without a byte are not listed, as Spark doesn't list them.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.when(F.lower(name).endswith(WORD_SUFFIX), "WORDS").when(files.extension(F.col("path")) == "ifc", "IFC").otherwise(files.source_kind(F.col("path")))
    there = files.inventory(spark, folder).select(F.col("path").alias("file"), kind.alias("kind"))
    kinds = {r["kind"] for r in there.select("kind").distinct().collect()}  # a handful
    made, trouble = [_empty(spark)], [spark.createDataFrame([], "file string, problem string")]
    glob = lambda pattern: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if "DXF" in kinds:
        drawn = dxf.read(spark, folder).withColumn("file", _same_as(F.col("file")))
        made.append(drawing_elements(drawn))
        trouble.append(drawn.filter("bad is not null").groupBy("file").agg(F.max("bad").alias("problem")))
    if "IFC" in kinds:
        model = lambda f: f(spark, folder, glob("*.[iI][fF][cC]")).withColumn("file", _same_as(F.col("file")))
        made.append(model_elements(model(ifc.elements)))
        trouble.append(model(ifc.statements).filter("bad is not null").groupBy("file").agg(F.concat(F.count("*").cast("string"), F.lit(" statements can't be read")).alias("problem")))
    if "WORDS" in kinds:
        try:
            lines = glob(f"*{WORD_SUFFIX}").text(folder).select("value", _same_as(F.col("_metadata.file_path")).alias("file")).filter("trim(value) <> ''")
            words = lines.select("file", F.from_json("value", WORDS, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("w")).select("file", "w.*")
        except AnalysisException as e:  # all of them are empty
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            made.append(page_elements(words))
            trouble.append(words.filter("_corrupt_record is not null").groupBy("file").agg(F.concat(F.count("*").cast("string"), F.lit(" words can't be read")).alias("problem")))
    elements, problems = made[0], trouble[0]
    for m, t in zip(made[1:], trouble[1:], strict=True):
        elements, problems = elements.unionByName(m), problems.unionByName(t)
    counts = elements.groupBy("file").agg(F.count("*").alias("n"))
    state = there.withColumn("file", _same_as(F.col("file"))).join(problems, "file", "left").join(counts, "file", "left")
    known = F.col("kind").isin("DXF", "IFC", "WORDS")
    problem = F.coalesce("problem", F.when(~known, F.concat(F.lit("no reader for "), "kind")))
    return elements, state.select("file", "kind", F.coalesce("n", F.lit(0)).alias("elements"), problem.alias("problem"), problem.isNotNull().alias("partial"))


def _same_as(path):
    """A local path in the one form that all readers' names are brought to."""
    return F.regexp_replace(path, "^file:/*", "/")
