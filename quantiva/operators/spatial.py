"""Distance joins by grid buckets: an equi-join on cells next to each other, then the exact distance.

Each point of the right side is copied to the cells around its own, so no pair further than the radius away
costs more than a lookup and no cross join is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import drop, stage

ENOUGH = 4  # pairs that a point is met in on average, before the radius is cut


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, xs: tuple[str, str] = ("x", "y"), scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Pairs within ``radius`` (after scaling); right columns get the prefix ``r_``, the squared distance is ``d2``."""
    cell = lambda c, s: F.floor(F.col(c) * s / radius).cast("bigint")
    around = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    lefts = left.withColumns({"__cx": cell(xs[0], scale[0]), "__cy": cell(xs[1], scale[1])})
    rights = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns))
    rx, ry = f"r_{xs[0]}", f"r_{xs[1]}"
    rights = rights.withColumn("__dx", around).withColumn("__dy", around).withColumn("__cx", cell(rx, scale[0]) + F.col("__dx")).withColumn("__cy", cell(ry, scale[1]) + F.col("__dy")).drop("__dx", "__dy")
    d2 = ((F.col(xs[0]) - F.col(rx)) * scale[0]) ** 2 + ((F.col(xs[1]) - F.col(ry)) * scale[1]) ** 2
    return lefts.join(rights, [*keys, "__cx", "__cy"]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("__cx", "__cy")


def nearest(pairs: DataFrame, left_id: str, right_id: str, k: int = 1) -> DataFrame:
    """The k nearest partners of each left row; ties go to the smaller right id."""
    w = Window.partitionBy(left_id).orderBy("d2", right_id)
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def places(points: DataFrame, keys: list[str], xs: tuple[str, str] = ("x", "y")) -> DataFrame:
    """One row for the points of a place: the least ``id``."""
    return points.dropna(subset=[*keys, *xs]).groupBy(*keys, *xs).agg(F.min("id").alias("id"))


def radii(left: DataFrame, right: DataFrame, keys: list[str], radius: float, scale: tuple[float, float] = (1.0, 1.0)) -> list[float]:
    """Radii up to ``radius``, each twice the one before: within the first a point has about ENOUGH partners.

    What is near is found within the first, so only few points are looked up again within a larger one. In a plane that
    holds more points the first radius is smaller, and pairs don't grow with the square of the points.
    """
    cell = lambda d, n: d.groupBy(*keys, *(F.floor(F.col(c) * s / radius).alias(f"__{c}") for c, s in zip(("x", "y"), scale, strict=True))).agg(F.count("*").alias(n))
    met = cell(left, "n").join(cell(right, "m"), [*keys, "__x", "__y"], "left").agg(F.sum(F.col("n") * F.col("m")).alias("met"), F.sum("n").alias("n")).first()
    each = math.pi * (met["met"] or 0) / max(1, met["n"] or 0)
    steps = max(0, math.ceil(math.log(each / ENOUGH, 4))) if each else 0
    return [radius / 2**k for k in range(steps, -1, -1)]


def best_within(left: DataFrame, right: DataFrame, keys: list[str], within: list[float], scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``id, r_id``: the nearest of the right side within the last radius; of several (``d2`` to six places) the least id.

    A point that has a partner within one radius isn't looked up within the next.
    """
    found, open_, old = [], left, None
    for r in within:
        pairs = radius_join(open_, right, keys, r, scale=scale)
        best = pairs.groupBy("id").agg(F.min(F.struct(F.round("d2", 6).alias("d2"), "r_id")).alias("b"))
        if r == within[-1]:
            found.append(best.select("id", "b.r_id"))
            break
        best = stage(best.filter(F.col("b.d2") <= r * r - 1e-5).select("id", "b.r_id"), "nearest")
        found.append(best)
        open_, last = stage(open_.join(best.select("id"), "id", "left_anti"), "open"), old
        old = open_
        if last is not None:
            drop(last)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def first_beside(left: DataFrame, right: DataFrame, keys: list[str], band: int, reach: tuple[int, int]) -> DataFrame:
    """``id, dx, r_id``: the first partner along x from ``reach[0]`` to ``reach[1]`` beyond each left place, ``band`` above
    or below at most (whole numbers); the least id of several, and of points at one place.

    The reach is cut first so that a place meets a few partners; only one without any is looked up further on.
    """
    open_, rights, found, old = places(left, keys), places(right, keys), [], None
    line = lambda d, n: d.groupBy(*keys, F.floor(F.col("y") / band).alias("cy")).agg(F.count("*").alias(n))
    met = line(open_, "n").join(line(rights, "m"), [*keys, "cy"], "left").agg(F.sum(F.col("n") * F.col("m")).alias("met"), F.sum("n").alias("n")).first()
    each, whole = 2 * (met["met"] or 0) / max(1, met["n"] or 0), reach[1] - reach[0]
    steps = max(0, math.ceil(math.log(each / ENOUGH, 4))) if each else 0
    for wide in (max(1, whole // 4**k) if k else whole for k in range(steps, -1, -1)):
        size = wide + 1
        cell = F.floor((F.col("x") + reach[0]) / size)
        asks = open_.withColumn("cx", F.explode(F.array(cell, cell + 1))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / band) - 1, F.floor(F.col("y") / band) + 1)))
        has = rights.select(*keys, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / band).alias("cy"), F.col("id").alias("r_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        dx = F.col("rx") - F.col("x")
        near = asks.join(has, [*keys, "cx", "cy"]).filter((F.abs(F.col("ry") - F.col("y")) <= band) & dx.between(reach[0], reach[0] + wide))
        best = near.groupBy("id").agg(F.min(F.struct(dx.alias("dx"), "r_id")).alias("b")).select("id", "b.dx", "b.r_id")
        if wide == whole:
            found.append(best)
            break
        found.append(stage(best, "beside"))
        open_, last = stage(open_.join(found[-1].select("id"), "id", "left_anti"), "open"), old
        old = open_
        if last is not None:
            drop(last)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def mutual_nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: float, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``id, r_id`` of which each is the other's nearest within the radius; of points at one place the least id."""
    a, b = places(left, keys), places(right, keys)
    within = radii(a, b, keys, radius, scale)
    back = best_within(b, a, keys, within, scale).select(F.col("id").alias("r_id"), F.col("r_id").alias("id"))
    return best_within(a, b, keys, within, scale).join(back, ["id", "r_id"])


def mutual_best(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Pairs of which each is the other's nearest."""
    one, two = Window.partitionBy(left_id).orderBy("d2", right_id), Window.partitionBy(right_id).orderBy("d2", left_id)
    return pairs.withColumns({"__a": F.row_number().over(one), "__b": F.row_number().over(two)}).filter("__a = 1 and __b = 1").drop("__a", "__b")
