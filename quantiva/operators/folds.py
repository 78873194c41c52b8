"""Folds over the sorted rows of a group that compare with the row kept last, which a window's lag can't express.

The rows of a group (a page, a conversation) are held as one sorted array and folded in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_heads(rows: DataFrame, keys: list[str], order: list[str], near: Callable[[Column, Column], Column]) -> DataFrame:
    """``keys`` and ``kept``: the rows that are not ``near`` the row kept last before them (the first always is kept)."""
    fields = [c for c in rows.columns if c not in keys]
    first = [*order, *(c for c in fields if c not in order)]
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*first))).alias("rows"))
    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda acc, r: F.when(F.coalesce(near(F.get(acc, F.size(acc) - 1), r), F.lit(False)), acc).otherwise(F.concat(acc, F.array(r))))
    return held.select(*keys, F.explode(kept).alias("row")).select(*keys, "row.*")


def snap(rows: DataFrame, keys: list[str], position: str, tolerance: int) -> DataFrame:
    """Each different position with ``head``, the nearest of its group's cluster heads: a position more than the
    tolerance beyond the last head is one; the first of two as near."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(position)).alias("all"))
    heads = F.aggregate("all", F.slice("all", 1, 1), lambda acc, p: F.when(p - F.element_at(acc, -1) > tolerance, F.concat(acc, F.array(p))).otherwise(acc))
    each = held.withColumn("heads", heads).select(*keys, "heads", F.explode("all").alias(position))
    nearest = F.array_min(F.transform("heads", lambda h: F.struct(F.abs(h - F.col(position)).alias("gap"), h.alias("head"))))
    return each.select(*keys, position, nearest["head"].alias("head"))


def pack_parts(rows: DataFrame, keys: list[str], order: str, size: Column, limit: int, joint: int) -> DataFrame:
    """``keys, order, chunk``: parts are put together while the chunk stays under ``limit``; ``joint`` is what joining adds."""
    held = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("bigint").alias("n")))).alias("parts"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        fits = acc["n"] + p["n"] < limit
        empty = F.size(acc["out"]) == 0
        chunk = F.when(fits | empty, acc["chunk"]).otherwise(acc["chunk"] + 1)
        n = F.when(fits & ~empty, acc["n"] + joint + p["n"]).otherwise(p["n"])
        return F.struct(n.alias("n"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    numbered = held.withColumn("chunks", F.aggregate("parts", start, add, lambda acc: acc["out"]))
    return numbered.select(*keys, F.explode(F.arrays_zip("parts", "chunks")).alias("z")).select(*keys, F.col("z.parts.o").alias(order), F.col("z.chunks").alias("chunk"))
