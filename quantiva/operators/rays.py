"""Boxes of rooms from rays: from each label five rays a side to the nearest wall, and the median of what they measure.

Walls are boxes parallel to the axes, in whole pixels. A ray is a line of pixels, so it meets the walls that cover its
row (or column). A sheet's rays and its walls are gathered once each; the task that has both looks at all walls for some
rays at a time, so no pair of ray and wall is ever a row. Rays and walls of different sheets never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ["left", "right", "up", "down"]
CLOSE, MOST_OPEN = 2, 0.6  # a hit so close is the label's own stroke; share of the envelope
AT_ONCE = 1_000_000  # pairs of ray and wall that are looked at in one piece
_FAR = np.iinfo(np.int64).max // 4


def nearest_walls(probe: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the nearest wall before and after each ray's start, _FAR where there is none. ``lo`` to ``hi`` is
    what a wall covers across the rays, ``first`` to ``last`` what it covers along them."""
    before, after = np.full(len(probe), _FAR), np.full(len(probe), _FAR)
    if len(lo):
        most = max(1, AT_ONCE // len(lo))
        for own in (slice(i, i + most) for i in range(0, len(probe), most)):
            p, s = probe[own, None], start[own, None]
            met = (lo <= p) & (p <= hi)
            before[own] = np.where(met & (first < s), s - np.minimum(last, s - 1), _FAR).min(axis=1)
            after[own] = np.where(met & (last > s), np.maximum(first, s + 1) - s, _FAR).min(axis=1)
    return before, after


def _hits(rays: DataFrame, walls: DataFrame) -> DataFrame:
    """Distances ``before`` and ``after`` of rays ``sheet, label, flat, k, start, probe``; none of those that meet nothing."""
    sheet, label = (rays.schema[c].dataType.simpleString() for c in ("sheet", "label"))
    box = [F.col(c).cast("bigint").alias(c) for c in ("x0", "y0", "x1", "y1")]
    own = rays.groupBy("sheet").agg(F.collect_list(F.struct("label", "flat", F.col("start").cast("bigint").alias("start"), "probe")).alias("rays"))
    held = own.join(walls.dropna().groupBy("sheet").agg(F.collect_list(F.struct(*box)).alias("walls")).hint("merge"), "sheet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rays_, walls_ = batch.column(1), batch.column(2)
            r, w = rays_.offsets.to_numpy(), walls_.offsets.to_numpy()
            flat, start, probe = (rays_.values.field(c).to_numpy(zero_copy_only=False) for c in ("flat", "start", "probe"))
            x0, y0, x1, y1 = (walls_.values.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
            before, after = np.full(len(flat), _FAR), np.full(len(flat), _FAR)
            for i in range(batch.num_rows):
                at, k = np.arange(r[i], r[i + 1]), slice(w[i], w[i + 1])
                across, along = at[flat[at]], at[~flat[at]]
                before[across], after[across] = nearest_walls(probe[across], start[across], y0[k], y1[k], x0[k], x1[k])
                before[along], after[along] = nearest_walls(probe[along], start[along], x0[k], x1[k], y0[k], y1[k])
            met = np.flatnonzero((before < _FAR) | (after < _FAR))
            of = np.searchsorted(r, met, side="right") - 1
            values = [pa.array(v[met], mask=v[met] == _FAR) for v in (before, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), rays_.values.field("label").take(pa.array(met)), pa.array(flat[met]), *values], ["sheet", "label", "flat", "before", "after"])

    return held.mapInArrow(run, f"sheet {sheet}, label {label}, flat boolean, before bigint, after bigint")


def room_boxes(labels: DataFrame, walls: DataFrame, sheets: DataFrame, most_open: float = MOST_OPEN) -> DataFrame:
    """One row a label: its point, the distances to the walls, the sides that are open and the room's box.

    ``labels``: sheet, label, x, y, w, h (whole numbers); ``walls``: sheet, x0, y0, x1, y1 (inclusive);
    ``sheets``: sheet, width, height and the building's envelope bx, by, bw, bh. A side is open where no ray of its five
    meets a wall, or the median is beyond ``most_open`` of the envelope. Then ``closed`` is false and the box is bounded by
    the envelope on that side; it is null if even so a side is CLOSE pixels or less.
    """
    inside = lambda v, size: F.least(F.greatest(v, F.lit(1)), F.col(size) - 2)
    half = lambda c: F.floor(F.col(c) / 2)
    at = labels.join(sheets, "sheet").withColumns({"cx": inside(F.col("x") + half("w"), "width"), "cy": inside(F.col("y") + half("h"), "height")})

    def probes(centre: str, size: str, limit: str) -> Column:
        steps = [-F.col(size), F.floor(-F.col(size) / 2), F.lit(0), half(size), F.col(size)]
        return F.posexplode(F.array(*(inside(F.col(centre) + s, limit).cast("bigint") for s in steps)))

    rows = at.select("sheet", "label", F.lit(True).alias("flat"), F.col("cx").alias("start"), probes("cy", "h", "height").alias("k", "probe"))
    columns = at.select("sheet", "label", F.lit(False).alias("flat"), F.col("cy").alias("start"), probes("cx", "w", "width").alias("k", "probe"))
    both = _hits(rows.unionByName(columns).dropna(subset=["start", "probe"]), walls)
    middle = lambda flat, c: F.floor(F.percentile(F.when((F.col("flat") == flat) & (F.col(c) > CLOSE), F.col(c)), 0.5)).cast("bigint")
    found = both.groupBy("sheet", "label").agg(middle(True, "before").alias("left"), middle(True, "after").alias("right"), middle(False, "before").alias("up"), middle(False, "after").alias("down"))
    r = at.join(found, ["sheet", "label"], "left")
    envelope = {"left": F.col("cx") - F.col("bx"), "right": F.col("bx") + F.col("bw") - F.col("cx"), "up": F.col("cy") - F.col("by"), "down": F.col("by") + F.col("bh") - F.col("cy")}
    most = {s: most_open * F.col("bw" if s in ("left", "right") else "bh") for s in SIDES}
    is_open = {s: F.col(s).isNull() | (F.col(s) > most[s]) for s in SIDES}
    r = r.withColumns({f"{s}_to": F.when(is_open[s], envelope[s]).otherwise(F.col(s)) for s in SIDES})
    opened = F.array_join(F.array_compact(F.array(*(F.when(is_open[s], s) for s in SIDES))), ",")
    sound = (F.col("left_to") > CLOSE) & (F.col("right_to") > CLOSE) & (F.col("up_to") > CLOSE) & (F.col("down_to") > CLOSE)
    box = {"box_x": F.col("cx") - F.col("left_to"), "box_y": F.col("cy") - F.col("up_to"), "box_w": F.col("left_to") + F.col("right_to"), "box_h": F.col("up_to") + F.col("down_to")}
    big = lambda c: c.cast("bigint")
    return r.select("sheet", "label", big(F.col("cx")).alias("cx"), big(F.col("cy")).alias("cy"), *SIDES, opened.alias("open_sides"), (opened == "").alias("closed"), *(big(F.when(sound, v)).alias(k) for k, v in box.items()))
