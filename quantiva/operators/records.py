"""Merging of plan records, effective quantities, totals that missing values poison, and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(value: str, order: Column) -> Column:
    """The first non-NULL value in an explicit order."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def merge_records(df: DataFrame, order: str = "seq") -> DataFrame:
    """One row per (level, label), case ignored: axes united, plan quantities summed, first table quantity,
    first known dimension, most confidence, first category that is known."""
    o = F.col(order)
    known = F.when(F.col("category") != "autre", F.col("category"))
    return df.groupBy(F.upper("level").alias("level"), F.upper("label").alias("label")).agg(
        F.array_sort(F.collect_set("axis")).alias("axes"),
        F.sum("qty_plan").alias("qty_plan"),
        first_by("qty_table", o).alias("qty_table"),
        F.min_by(F.nullif(F.col("dim"), F.lit(0)), F.when(F.nullif(F.col("dim"), F.lit(0)).isNotNull(), o)).alias("dim"),
        F.max("confidence").alias("confidence"),
        F.coalesce(F.min_by(known, F.when(known.isNotNull(), o)), F.lit("autre")).alias("category"),
    )


def effective_qty(axes: Column, plan: Column, table: Column) -> Column:
    """The largest of axes, plan quantity and 1 if either of those is there, else the table's quantity, else 1."""
    seen = (axes > 0) | (F.coalesce(plan, F.lit(0)) > 0)
    return F.when(seen, F.greatest(axes, F.coalesce(plan, F.lit(0)), F.lit(1))).otherwise(F.coalesce(F.nullif(table, F.lit(0)), F.lit(1)))


def poisoned_sum(value: str) -> tuple[Column, Column]:
    """A total that is NULL with status INCOMPLET as soon as one value is missing."""
    missing = F.count_if(F.col(value).isNull()) > 0
    return F.when(~missing, F.sum(value)), F.when(missing, "INCOMPLET").otherwise("OK")


def discrepancies(plan: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """References of one source only, or of both."""
    a = plan.select(*on).distinct().withColumn("in_plan", F.lit(True))
    b = table.select(*on).distinct().withColumn("in_table", F.lit(True))
    side = F.when(F.col("in_table").isNull(), "plan_only").when(F.col("in_plan").isNull(), "table_only").otherwise("both")
    return a.join(b, on, "full").select(*on, side.alias("side"))
