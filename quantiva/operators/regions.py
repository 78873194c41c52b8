"""Boxes that grow: fragments fused until none is near another, and regions of a sheet around its anchors.

A sheet of up to ONE_PIECE fragments is fused where they are gathered. Larger ones are fused at once in rounds: boxes that are near each other take the least group among them, and a
group's box is the union of its own. A larger box may meet new ones, so rounds go on until none meets another. The
result is the finest division whose boxes are apart, whatever the order of the fragments.

Regions of a sheet depend on order (each choice sees those made before), and a sheet has a few anchors: they are
gathered by sheet and taken one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .boxes import overlap_join
from .staging import drop, stage

DISTANCE = 4
ONE_PIECE = 2048  # fragments of a sheet that are compared with each other in one task
# fixed values: shares of the sheet's size, px, and the share of the smaller box that two regions have in common
MARGIN_X, MARGIN_Y, ABOVE, SAME, GAP, OVERLAP = 0.15, 0.20, 0.3, 50, 50, 0.3
KINDS = ["tableau", "plan", "detail"]  # a merged region has the first of its kinds
CORNERS = [("plan", 0, 0, "quadrant HG"), ("tableau", 1, 0, "quadrant HD"), ("plan", 0, 1, "quadrant BG"), ("detail", 1, 1, "quadrant BD")]


def _near(groups: DataFrame, distance: int, cell: int) -> DataFrame:
    """Pairs of groups of a sheet whose boxes are within the distance of each other, both ways."""
    # in half units; boxes at the very distance are near, and overlap_join wants a common area
    wide = groups.select("sheet", "g", (F.col("x0") * 2 - distance).alias("x0"), (F.col("y0") * 2 - distance).alias("y0"), (F.col("x1") * 2 + distance + 1).alias("x1"), (F.col("y1") * 2 + distance + 1).alias("y1"))
    return overlap_join(wide, wide, ["sheet"], 2 * cell).filter("g <> r_g").select("sheet", "g", F.col("r_g").alias("other"))


def _further(moves: DataFrame) -> DataFrame:
    """Each group straight to where the group that it goes to goes: chains of moves get half as long."""
    then = moves.select("sheet", F.col("g").alias("to"), F.col("to").alias("then"))
    return moves.join(then, ["sheet", "to"], "left").select("sheet", "g", F.coalesce("then", "to").alias("to"))


def groups_of(ids: np.ndarray, boxes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The different ids of a sheet's fragments and the least id of each one's group; ``boxes`` are rows of x0, y0, x1 and
    y1, nan for a fragment without a box."""
    names, of = np.unique(ids, return_inverse=True)
    to, whole = np.arange(len(names)), ~np.isnan(boxes).any(axis=1)
    hull = np.full((len(names), 4), np.inf) * [1, 1, -1, -1]
    while True:
        g = to[of[whole]]
        np.minimum.at(hull, (g[:, None], [0, 1]), boxes[whole, :2])
        np.maximum.at(hull, (g[:, None], [2, 3]), boxes[whole, 2:])
        own = np.unique(g)
        x0, y0, x1, y1 = hull[own].T
        near = (x0[:, None] - x1 <= distance) & (x0 - x1[:, None] <= distance) & (y0[:, None] - y1 <= distance) & (y0 - y1[:, None] <= distance)
        least = np.arange(len(own))
        while len(own):
            low = np.where(near, least, len(own)).min(axis=1)
            low = low[low]
            if (low == least).all():
                break
            least = low
        if (least == np.arange(len(own))).all():
            return names, names[to]
        step = np.arange(len(names))
        step[own] = own[least]
        to = step[to]


def _fused_in_place(fragments: DataFrame, distance: int) -> DataFrame:
    sheet, ident = (fragments.schema[c].dataType.simpleString() for c in ("sheet", "id"))
    box = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    held = fragments.filter("id is not null").groupBy("sheet").agg(F.collect_list(F.struct("id", *box)).alias("fragments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ends = batch.column(1).values, batch.column(1).offsets.to_numpy()
            ids = own.field("id").to_numpy(zero_copy_only=False)
            boxes = np.column_stack([own.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1")]).astype(float)
            found = [groups_of(ids[i:j], boxes[i:j], distance) for i, j in zip(ends, ends[1:])]
            of = np.repeat(np.arange(len(found)), [len(n) for n, _ in found])
            names, groups = (pa.array(np.concatenate(c), own.field("id").type) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), names, groups], ["sheet", "id", "g"])

    return held.mapInArrow(run, f"sheet {sheet}, id {ident}, g {ident}")


def fuse(fragments: DataFrame, distance: int = DISTANCE, cell: int = 256) -> DataFrame:
    """``sheet, id, g``: the group of each fragment ``sheet, id, x0, y0, x1, y1`` (whole numbers), named by its least id.

    Boxes within ``distance`` of each other in both directions are one group, and so are groups by their common box.
    Fragments without a box are groups of their own; repeated ids are one fragment each time with the same group.
    """
    counted = fragments.groupBy("sheet").agg(F.count("*").alias("n"))
    large = stage(counted.filter((F.col("n") > ONE_PIECE) | F.col("sheet").isNull()).select("sheet"), "large-sheets")
    if large.isEmpty():
        drop(large)
        return _fused_in_place(fragments, distance)
    at = fragments["sheet"].eqNullSafe(large["sheet"])
    return _fused_in_place(fragments.join(large, at, "left_anti"), distance).unionByName(_fused_in_rounds(fragments.join(large, at, "left_semi"), distance, cell))


def _fused_in_rounds(fragments: DataFrame, distance: int, cell: int) -> DataFrame:
    whole = fragments.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    member = stage(fragments.select("sheet", "id", F.col("id").alias("g")).distinct(), "fragments")
    hull = lambda d: d.groupBy("sheet", "g").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    groups = stage(hull(whole.select("sheet", F.col("id").alias("g"), "x0", "y0", "x1", "y1")), "regions")
    while True:
        moves = stage(_near(groups, distance, cell).groupBy("sheet", "g").agg(F.min("other").alias("to")).filter("to < g"), "moves")
        if moves.isEmpty():
            drop(moves, groups)
            return member
        moves, first = stage(_further(_further(moves)), "moves"), moves
        drop(first)
        to = F.coalesce("to", "g")
        larger = stage(hull(groups.join(moves, ["sheet", "g"], "left").withColumn("g", to)), "regions")
        joined = stage(member.join(moves, ["sheet", "g"], "left").select("sheet", "id", to.alias("g")), "fragments")
        drop(groups, member, moves)
        groups, member = larger, joined


def fused(fragments: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``sheet, g, text, fragments, x0, y0, x1, y1, confidence`` of fused ``fragments``: texts are joined in order of ids."""
    held = fragments.join(fuse(fragments, distance).hint("merge"), ["sheet", "id"])
    parts = F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t != ""), " ")
    box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return held.groupBy("sheet", "g").agg(text.alias("text"), F.count("*").alias("fragments"), *box, F.min("confidence").alias("confidence"))


def sheet_regions(width: float, height: float, anchors: list[tuple]) -> list[tuple]:
    """kind, label, x0, y0, x1, y1 of the regions that a sheet's ``anchors`` (kind, label, x0, y0, x1, y1) open, in order.

    An anchor within SAME of one taken before opens none. A region reaches MARGIN_X to both sides, MARGIN_Y below and
    ABOVE of it above. Each takes in the later ones that share OVERLAP of the smaller box with it as it has grown by then.
    """
    taken: list[tuple] = []
    for a in anchors:
        x, y = (a[2] + a[4]) / 2, (a[3] + a[5]) / 2
        if all(abs(x - (b[2] + b[4]) / 2) >= SAME or abs(y - (b[3] + b[5]) / 2) >= SAME for b in taken):
            taken.append(a)
    mx, my = MARGIN_X * width, MARGIN_Y * height
    open_ = [(k, t, max(0.0, x0 - mx), max(0.0, y0 - ABOVE * my), min(width, x1 + mx), min(height, y1 + my)) for k, t, x0, y0, x1, y1 in taken]
    out = []
    while open_:
        kind, label, *box = open_.pop(0)
        rest = []
        for k, t, *b in open_:
            wide, high = min(box[2], b[2]) - max(box[0], b[0]), min(box[3], b[3]) - max(box[1], b[1])
            least = min((c[2] - c[0]) * (c[3] - c[1]) for c in (box, b))
            if wide > 0 and high > 0 and wide * high >= OVERLAP * least > 0:
                box = [min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3])]
                kind, label = min(kind, k, key=KINDS.index), label or t
            else:
                rest.append((k, t, *b))
        out.append((kind, label, *box))
        open_ = rest
    return out


def regions(sheets: DataFrame, anchors: DataFrame) -> DataFrame:
    """``sheet, part, kind, label, x0, y0, x1, y1``: all regions of each of ``sheets`` (sheet, width, height).

    ``anchors``: sheet, id, kind, label and box; taken by id. A sheet without any is cut into four. Bands of more than GAP
    between regions that follow each other downwards are regions of their own (kind detail, across the sheet).
    """
    kind = sheets.schema["sheet"].dataType.simpleString()
    cut = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(k).alias("kind"), F.lit(t).alias("label"), (F.col("width") / 2 * dx).alias("x0"), (F.col("height") / 2 * dy).alias("y0"), (F.col("width") / 2 * (dx + 1)).alias("x1"), (F.col("height") / 2 * (dy + 1)).alias("y1")) for i, (k, dx, dy, t) in enumerate(CORNERS)))
    own = anchors.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "label", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))))).alias("anchors"))
    met = sheets.join(own, "sheet", "left")
    quarters = met.filter("anchors is null").select("sheet", F.explode(cut).alias("r")).select("sheet", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, ends = [], batch.column(3).values, batch.column(3).offsets.to_pylist()
            own = list(zip(*(held.field(c).to_pylist() for c in ("kind", "label", "x0", "y0", "x1", "y1")), strict=True))
            for k, (width, height) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = sheet_regions(width, height, own[ends[k] : ends[k + 1]])
                rows += [(k, i, *r) for i, r in enumerate(found)]
            if rows:
                k, part, *columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(part, pa.int32()), *map(pa.array, columns)], ["sheet", "part", "kind", "label", "x0", "y0", "x1", "y1"])

    size = [F.col(c).cast("double").alias(c) for c in ("width", "height")]
    around = met.filter("anchors is not null").select("sheet", *size, "anchors").mapInArrow(run, f"sheet {kind}, part int, kind string, label string, x0 double, y0 double, x1 double, y1 double")
    down = Window.partitionBy("sheet").orderBy("y0", "part")
    follows = around.withColumns({"next": F.lead("y0").over(down), "k": F.row_number().over(down)}).filter(F.col("next") - F.col("y1") > GAP)
    bands = follows.join(sheets, "sheet").select("sheet", (1000 + F.col("k")).alias("part"), F.lit("detail").alias("kind"), F.concat(F.lit("zone non classifiee "), "k").alias("label"), F.lit(0.0).alias("x0"), F.col("y1").alias("y0"), F.col("width").cast("double").alias("x1"), F.col("next").alias("y1"))
    return around.unionByName(quarters).unionByName(bands)
