"""Catalogue, placements, records, labels and points derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import unit_gate, volume

FAMILIES = {"ECONOMY": "semelle", "LARGE": "poteau", "MEDIUM": "poutre", "PROMO": "longrine", "SMALL": "chainage", "STANDARD": "voile"}
PREFIX = {"semelle": "S", "poteau": "P", "poutre": "N", "longrine": "LG", "chainage": "CH", "voile": "V"}
PHI = [6, 8, 10, 12, 14, 16, 20, 25, 32, 15, 18]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _case(column: str, values: dict) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in values.items()) + " end"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type, family, raw dimensions in mixed units, bars, price, spec and label texts; one row per part."""
    p = read(spark, sf_dir, "part")
    a, b, h = 200 + F.col("p_size") * 10, 200 + F.col("p_partkey") % 40 * 10, 300 + F.col("p_partkey") % 7 * 50
    per = F.when(F.col("p_partkey") % 3 == 0, 1000.0).when(F.col("p_partkey") % 3 == 1, 10.0).otherwise(1.0)
    family = F.expr(_case("p_type", FAMILIES))
    return p.select(
        F.col("p_partkey").alias("type"), family.alias("family"), F.expr(_case(_case("p_type", FAMILIES), PREFIX)).alias("prefix"),
        (a / per).alias("a"), (b / per).alias("b"), (h / per).alias("h"), (a / 10).cast("int").alias("a_cm"), (b / 10).cast("int").alias("b_cm"),
        (2 + F.col("p_size") % 10).cast("int").alias("nb"), F.element_at(F.array(*map(F.lit, PHI)), (F.col("p_partkey") % 11 + 1).cast("int")).alias("phi"), F.col("p_retailprice").alias("price"),
    ).withColumns({"label": F.concat("prefix", "type", F.lit("("), "a_cm", F.lit("x"), "b_cm", F.lit(")")), "spec": F.concat("nb", F.lit("HA"), "phi"), "stirrup": F.concat(F.lit("Cad HA"), "phi", F.lit(" e="), F.lit(15))})


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue(spark, sf_dir).withColumns({"am": unit_gate(F.col("a")), "bm": unit_gate(F.col("b")), "hm": unit_gate(F.col("h"))}).withColumn("vol", volume(F.col("am"), F.col("bm"), F.col("hm")))


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("inst"), F.col("l_partkey").alias("type"), F.concat("l_returnflag", "l_linestatus").alias("level"), F.col("l_linestatus").alias("src"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_suppkey").alias("engine"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words on pages: family, reference, x, y (seconds of the day), page (day)."""
    e = read(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("ref"), F.col("event_type").alias("family"), F.col("value").alias("x"), (F.unix_timestamp("ts") - F.unix_timestamp(day)).alias("y"), F.date_format("ts", "yyyy-MM-dd").alias("page"))


_A, _B, _H = "(200 + p_size * 10)", "(200 + p_partkey % 40 * 10)", "(300 + p_partkey % 7 * 50)"
_PER = "(case p_partkey % 3 when 0 then 1000.0 when 1 then 10.0 else 1.0 end)::double"


def _gate(x: str) -> str:
    v = f"cast({x} as decimal(18,6))"
    return f"cast(case when {x} >= 100 then {v} * 0.001 when {x} > 3.5 then {v} * 0.01 else {v} end as decimal(18,3))"


#: common table expressions of the same relations
CTE = f"""cat0 as (select p_partkey as type, {_case("p_type", FAMILIES)} family, {_A} / {_PER} a, {_B} / {_PER} b, {_H} / {_PER} h,
  {_A} // 10 a_cm, {_B} // 10 b_cm, 2 + p_size % 10 nb, [{", ".join(map(str, PHI))}][p_partkey % 11 + 1] phi, p_retailprice price from part),
cat as (select *, {_case("family", PREFIX)} prefix, {_gate("a")} am, {_gate("b")} bm, {_gate("h")} hm from cat0),
catalogue as (select *, prefix || type || '(' || a_cm || 'x' || b_cm || ')' as label, nb || 'HA' || phi spec, 'Cad HA' || phi || ' e=15' stirrup,
  cast(cast(am as decimal(9,3)) * cast(bm as decimal(9,3)) * cast(hm as decimal(9,3)) as decimal(18,9)) vol from cat),
placements as (select l_orderkey project, l_linenumber inst, l_partkey as type, l_returnflag || l_linestatus as level, l_linestatus src, cast(l_quantity as int) qty, l_suppkey engine from lineitem),
points as (select event_id id, user_id as ref, event_type family, value x, cast(floor(epoch(ts)) - floor(epoch(date_trunc('day', ts))) as bigint) y, strftime(ts, '%Y-%m-%d') page from events)
"""
