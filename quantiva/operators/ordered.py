"""Order-dependent operators on grouped rows: gaps, islands, zones, forward fill. Windows are always partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(df: DataFrame, keys: list[str], order: list[str], gap: Column, out: str = "cluster") -> DataFrame:
    """A cluster number per row; a new one begins where ``gap`` (which may use lag_<column> of the order) holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = df.withColumns({f"lag_{c}": F.lag(c).over(w) for c in order})
    marked = lagged.withColumn(out, F.coalesce(gap, F.lit(True)).cast("int"))
    return marked.withColumn(out, F.sum(out).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(*(f"lag_{c}" for c in order))


def islands(df: DataFrame, keys: list[str], value: str, out: str = "island") -> DataFrame:
    """Runs of consecutive integers among the distinct values of each group, named by value minus rank."""
    return df.withColumn(out, F.col(value) - F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def anchor_zones(df: DataFrame, keys: list[str], position: str, *ties: str) -> DataFrame:
    """Zones between sorted anchors, cut half-way; the outer ones are open (NULL). ``ties`` order anchors at one place."""
    w = Window.partitionBy(*keys).orderBy(position, *ties)
    before, after = F.lag(position).over(w), F.lead(position).over(w)
    return df.withColumns({"zone_lo": (before + F.col(position)) / 2, "zone_hi": (F.col(position) + after) / 2})


def numbered(rows: DataFrame, key: str, lead: str, order: list[str], name: str, size: int = 65_536) -> DataFrame:
    """``rows`` numbered from 1 within each ``key``, in order of ``lead`` (a whole number) and then ``order``.

    A list may be long and the keys few, so it is cut by ``lead``: parts are numbered by themselves and begin after the
    rows of those before them. Parts cover equal stretches of ``lead`` and have ``size`` rows on average; rows of one
    ``lead`` stay together.
    """
    ends = rows.agg(F.min(lead).alias("lo"), F.max(lead).alias("hi"), F.count("*").alias("n")).first()
    wide = 1 if ends["lo"] is None else (ends["hi"] - ends["lo"]) * size // ends["n"] + 1
    cut = rows.withColumn("__part", F.coalesce(F.floor(F.col(lead) / wide), F.lit(-(1 << 62))))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = cut.groupBy(key, "__part").agg(F.count("*").alias("__n")).select(F.col(key).alias("__key"), F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(key, "__part").orderBy(lead, *order))
    at = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p"))
    return cut.withColumn("__k", within).join(begins, at).withColumn(name, (F.col("__before") + F.col("__k")).cast("bigint")).drop("__part", "__k", "__key", "__p", "__before")
