"""Areas of rooms: from written dimensions, from the region that a name lies in, or from a box; nothing counted twice.

A region with one name is that room. What a region with several names leaves beyond their stated and measured areas
is an open zone of its own. Where two measures lie on each other the smaller gives up what they share; that is done
pair by pair in the order of the rooms, since each sees the areas as they are by then, and a sheet has few such pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boxes import overlaps
from .staging import stage

LEAST_SHARE, LEAST_ZONE = 0.15, 0.5  # of the smaller box; square metres
CELL = 256


def _left(pairs: DataFrame, sheet: str) -> DataFrame:
    """``sheet, room, removed``: what each room gives up, of ``sheet, pairs`` (a, b, areas, boxes' sizes, shared; all in m²)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, own in enumerate(batch.column(1).to_pylist()):
                area: dict[int, float] = {}
                for p in own:
                    area.setdefault(p["a"], p["area_a"])
                    area.setdefault(p["b"], p["area_b"])
                first = dict(area)
                for p in own:
                    if not (area[p["a"]] and area[p["b"]]):
                        continue
                    small, box = (p["a"], p["box_a"]) if area[p["a"]] <= area[p["b"]] else (p["b"], p["box_b"])
                    if p["shared"] >= LEAST_SHARE * box:
                        area[small] = round(max(0.0, area[small] - p["shared"]), 2)
                rows += [(k, room, round(first[room] - a, 2)) for room, a in area.items() if a != first[room]]
            if rows:
                k, room, removed = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(room, pa.int64()), pa.array(removed, pa.float64())], ["sheet", "room", "removed"])

    return pairs.mapInArrow(run, f"sheet {sheet}, room bigint, removed double")


def room_surfaces(rooms: DataFrame, regions: DataFrame, sheets: DataFrame) -> DataFrame:
    """``sheet, room, name, source, area, removed`` of all rooms, and of open zones (null room), areas in m².

    ``rooms``: sheet, room (whole number), name, region (null: measured by its box), explicit (m², null: none written) and
    the box x0, y0, x1, y1 in pixels; ``regions``: sheet, region, area_px; ``sheets``: sheet, scale (pixels a metre).
    Rooms with what is known of them are written once, since boxes, names and zones each read them.
    The source is the first of ``dimensions``, ``region`` (its only name) and ``box``; ``none`` has no area.
    """
    scale2 = F.col("scale") * F.col("scale")
    named = rooms.withColumn("names", F.when(F.col("region").isNotNull(), F.count("*").over(Window.partitionBy("sheet", "region"))))
    r = named.join(regions, ["sheet", "region"], "left").join(sheets, "sheet")
    box = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / scale2
    segmented = F.round(F.when(F.col("names") == 1, F.col("area_px") / scale2).when(F.col("region").isNull(), box), 2)
    r = stage(r.withColumns({"segmented": segmented, "box": box}), "rooms")
    measured = r.filter("segmented > 0 and x0 is not null").select("sheet", F.col("room").cast("bigint").alias("room"), "region", "segmented", "box", "scale", *(F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")))
    met = overlaps(measured, ["sheet"], CELL).filter("room < r_room and (region is null or r_region is null)")
    pair = F.struct(F.col("room").alias("a"), F.col("r_room").alias("b"), F.col("segmented").alias("area_a"), F.col("r_segmented").alias("area_b"), F.col("box").alias("box_a"), F.col("r_box").alias("box_b"), (F.col("shared") / scale2).alias("shared"))
    removed = _left(met.groupBy("sheet").agg(F.array_sort(F.collect_list(pair)).alias("pairs")), rooms.schema["sheet"].dataType.simpleString())
    done = r.join(removed, ["sheet", "room"], "left")
    kept = F.round(F.col("segmented") - F.coalesce("removed", F.lit(0.0)), 2)
    source = F.when(F.col("explicit").isNotNull(), "dimensions").when(F.col("names") == 1, "region").when(F.col("region").isNull() & F.col("box").isNotNull(), "box").otherwise("none")
    named = done.select("sheet", "room", "name", source.alias("source"), F.coalesce("explicit", kept).alias("area"), F.coalesce("removed", F.lit(0.0)).alias("removed"), "region", "explicit", "segmented", "names")

    shared = r.filter("names > 1").groupBy("sheet", "region").agg(F.first("area_px").alias("area_px"), F.first("scale").alias("scale"), F.sum(F.coalesce("explicit", F.lit(0.0))).alias("stated"), F.count_if(F.col("explicit").isNull()).alias("open"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("room", "name"))), lambda x: F.upper(x["name"])), " + ").alias("names"))
    rest = F.round(F.round(F.col("area_px") / scale2, 2) - F.col("stated"), 2)
    zones = shared.withColumn("area", rest).filter((F.col("open") > 0) & (F.col("area") >= LEAST_ZONE))
    zones = zones.select("sheet", F.lit(None).cast(rooms.schema["room"].dataType).alias("room"), F.concat(F.lit("ZONE OUVERTE ("), "names", F.lit(")")).alias("name"), F.lit("zone").alias("source"), "area", F.lit(0.0).alias("removed"))
    return named.select("sheet", "room", "name", "source", "area", "removed").unionByName(zones)
