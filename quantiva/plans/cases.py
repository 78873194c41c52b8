"""Parsers over every part with one of a list of spellings, against the values that each spelling stands for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .carriers import read
from .registry import query


def _literal(v: object) -> str:
    if v is None:
        return "null"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def cases(name: str, rows: list[tuple], kinds: dict[str, str], build: Callable[[Column], dict[str, Column]]) -> None:
    """Register ``name``: ``rows`` are spellings with the values of the columns ``kinds`` (name to SQL type).

    Each part has the spelling of its key modulo their number.
    """
    values = ", ".join("(" + ", ".join([str(i), *map(_literal, r[1:])]) + ")" for i, r in enumerate(rows))
    given = ", ".join(["k", *(f"c{i}" for i in range(len(kinds)))])
    said = ", ".join(f"cast(c{i} as {kind}) as {c}" for i, (c, kind) in enumerate(kinds.items()))

    @query(name, f"select p_partkey as type, {said} from part join (values {values}) v({given}) on k = p_partkey % {len(rows)}")
    def run(spark, sf):
        texts = F.array(*(F.lit(r[0]).cast("string") for r in rows))
        spelled = read(spark, sf, "part").select(F.col("p_partkey").alias("type"), F.element_at(texts, (F.col("p_partkey") % len(rows) + 1).cast("int")).alias("text"))
        return spelled.select("type", *(c.alias(n) for n, c in build(F.col("text")).items()))
