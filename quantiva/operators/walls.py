"""Walls drawn as dots or dashes: lines are proposed by votes, each is fitted to the marks near it, and cut at openings.

Votes are counted in cells of angle and distance; each mark stands by its strongest cell, and a cell with enough such
marks is a proposal. From its marks (those within a band around the line) pairs are drawn at random, the line that most
marks are near is taken, and fitted again by singular values within a tolerance from the median absolute deviation. What
follows is windows: steps and gaps along the line, breaks, and the statistics of each run. A group is the marks of one
line of one sheet, so a long wall is never cut by how the work is dealt out.

Votes are many times the marks. Sheets of up to ONE_PIECE marks vote in the task that has them, so that only marks and
what is on lines are shuffled; in larger ones votes are rows, counted by windows and joined by cells, and no such sheet
has to fit in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import drop, stage

# fixed values; lengths are in stroke widths t unless noted
TRIALS, SEED = 250, 42
LEAST_ON_SHEET, SUPPORT = 6, 4  # marks
BAND, BEYOND, MIN_BAND = 2.5, 4.0, 2.5  # half width of the band, what it goes beyond the proposal; pixels at least
FIRST_TOLERANCE, MIN_FIRST = 1.25, 1.5  # of the first fit; pixels at least
MAD_TO_SIGMA, SIGMAS, MOST_TOLERANCE = 1.4826, 2.5, 2.0  # of the second fit
TURN, AXIS_TURN = 12.0, 6.0  # degrees
LEAST_GAP, MOST_GAP = 0.25, 25.0
BREAK_GAPS, BREAK_STROKES, BREAK_STEPS = 3.0, 2.0, 2.2
DISPERSION, SURE_DISPERSION, SURE_MARKS = 0.65, 0.35, 6
SLENDER = 20.0
ONE_PIECE = 2048  # marks of a sheet that vote in one task
AT_ONCE = 1 << 19  # distances worked out at once
FITTED = ["sheet", "deg", "cell", "id", "t", "s", "d", "cx", "cy", "ux", "uy"]


def lines_of(points: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and unit directions of the lines with the least squared distances to those ``points`` (list, n, 2) that are ``on``."""
    held = on[..., None]
    c = (points * held).sum(axis=1) / on.sum(axis=1)[:, None]
    u = np.linalg.svd((points - c[:, None]) * held, full_matrices=False)[2][:, 0]
    return c, u / np.hypot(u[:, 0], u[:, 1])[:, None]


def _off(points: np.ndarray, c: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (points[..., 1] - c[:, None, 1]) * u[:, None, 0] - (points[..., 0] - c[:, None, 0]) * u[:, None, 1]


def _medians(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The median of those values of each row that are in ``of``."""
    n, rows = of.sum(axis=1), np.arange(len(of))
    ordered = np.sort(np.where(of, values, np.inf), axis=1)
    return (ordered[rows, (n - 1) // 2] + ordered[rows, n // 2]) / 2


@lru_cache(4096)
def _pairs(n: int) -> np.ndarray:
    """The pairs drawn from ``n`` marks, the same for every line of so many; one drawn again, either way, proposes no other line."""
    rng = np.random.default_rng(SEED)
    drawn = np.array([rng.choice(n, size=2, replace=False) for _ in range(TRIALS)])
    return drawn[np.sort(np.unique(np.sort(drawn, axis=1), axis=0, return_index=True)[1])]


def robust_lines(points: np.ndarray, strokes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of as many ``points`` each (list, n, 2): numbers of those with SUPPORT on a line, its centre, direction and mask."""
    t = np.fmax(1.0, strokes)
    pairs = _pairs(points.shape[1])
    start, step = points[:, pairs[:, 0]], points[:, pairs[:, 1]] - points[:, pairs[:, 0]]
    far = np.hypot(step[..., 0], step[..., 1])
    usable = far >= 1e-6
    u = step / np.where(usable, far, 1.0)[..., None]
    x, y = points[:, None, :, 0], points[:, None, :, 1]
    off = np.abs((y - start[..., 1:]) * u[..., :1] - (x - start[..., :1]) * u[..., 1:])
    near = (off <= np.fmax(MIN_FIRST, FIRST_TOLERANCE * t)[:, None, None]) & usable[..., None]
    count, total = near.sum(axis=2), np.round(np.where(near, off, 0).sum(axis=2), 9)
    most = count.max(axis=1)
    best = np.where(count == most[:, None], total, np.inf).argmin(axis=1)
    found = np.flatnonzero(most >= SUPPORT)
    points, first, t = points[found], near[found, best[found]], t[found]
    off = _off(points, *lines_of(points, first))
    sigma = MAD_TO_SIGMA * _medians(np.abs(off - _medians(off, first)[:, None]), first)
    tolerance = np.minimum(np.maximum(1.0, SIGMAS * sigma), MOST_TOLERANCE * t)
    on = np.abs(off) <= tolerance[:, None]
    on = np.where((on.sum(axis=1) >= SUPPORT)[:, None], on, first)
    return found, *lines_of(points, on), on


def _fitted(marks: np.ndarray, starts: np.ndarray, counts: np.ndarray, t: np.ndarray, deg: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The marks on the line of each list: list, place in ``marks`` (x, y, w, h), place along the line, length on it, and the line.

    Lists of as many marks draw the same pairs, and are fitted together, AT_ONCE distances at a time.
    """
    normal = np.radians(deg)
    for n in np.unique(counts[counts >= SUPPORT]).tolist():
        alike, step = np.flatnonzero(counts == n), max(1, AT_ONCE // (n * len(_pairs(n))))
        for own in (alike[i : i + step] for i in range(0, len(alike), step)):
            places = starts[own, None] + np.arange(n)
            found, c, u, on = robust_lines(marks[places, :2], t[own])
            own, places = own[found], places[found]
            turn = u[:, 1] * np.cos(normal[own]) - u[:, 0] * np.sin(normal[own])
            u = np.where(turn < 0, -1.0, 1.0)[:, None] * u
            k, i = np.nonzero(on & (np.degrees(np.arccos(np.minimum(1.0, np.abs(turn)))) <= TURN)[:, None])
            at = places[k, i]
            s = ((marks[at, :2] - c[k]) * u[k]).sum(axis=1)
            d = np.fmax(1.0, np.abs(u[k, 0]) * marks[at, 2] + np.abs(u[k, 1]) * marks[at, 3])
            yield own[k], at, s, d, c[k, 0], c[k, 1], u[k, 0], u[k, 1]


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks on each proposal's line, with their places along it (``s``) and lengths on it (``d``)."""
    for batch in batches:
        lists = batch.column("marks")
        ends, values = lists.offsets.to_numpy(), lists.values
        marks = np.column_stack([values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "w", "h")])
        t, degrees = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "deg"))
        for k, at, *columns in _fitted(marks, ends[:-1], np.diff(ends), t, degrees):
            sheet, deg, cell, t_ = batch.select(["sheet", "deg", "cell", "t"]).take(pa.array(k)).columns
            yield pa.RecordBatch.from_arrays([sheet, deg, cell, values.field("id").take(pa.array(at)), t_, *map(pa.array, columns)], FITTED)


def _whole_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come in order of sheets, in tables of whole sheets."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
            last = pc.index(rows["sheet"], rows["sheet"][-1]).as_py()
            if last:
                yield rows.slice(0, last)
            rest = rows.slice(last)
    if rest is not None:
        yield rest


def _proposed(of: np.ndarray, mark: np.ndarray, cell: np.ndarray, rho: np.ndarray, along: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lines that marks (sheet ``of``, number ``mark``; a column an angle) propose: sheet, angle, cell, rho, lo, hi, t."""
    angles, places = cell.shape[1], cell - cell.min()
    if places.max() >= 1 << 40:  # far apart: numbered, so that a vote's key is one whole number
        places = np.unique(places, return_inverse=True)[1].reshape(cell.shape)
    key = (of[:, None] * angles + np.arange(angles)) * (places.max() + 1) + places
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    n = n[at].reshape(cell.shape)
    k, rows = n.argmax(axis=1), np.arange(len(of))
    n, key, cell, rho, along = (v[rows, k] for v in (n, key, cell, rho, along))
    order = np.lexsort((t, along, rho, -cell, -k, n, mark))
    order = order[n[order] >= SUPPORT]
    strongest = order[np.append(np.diff(mark[order]) != 0, True)[: len(order)]]
    order = strongest[np.argsort(key[strongest], kind="stable")]
    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
    size = np.diff(np.append(starts, len(order)))
    if not len(order):
        return tuple(v[:0] for v in (of, k, cell, rho, along, along, t))
    mean = np.floor(np.add.reduceat(rho[order], starts) / size * 1e6 + 0.5) / 1e6
    out = of[order][starts], k[order][starts], cell[order][starts], mean, np.minimum.reduceat(along[order], starts), np.maximum.reduceat(along[order], starts), np.maximum.reduceat(t[order], starts)
    return tuple(v[size >= SUPPORT] for v in out)


def _fit_sheets(degrees: list[int]):
    """The same for marks in order of sheets and ids, from votes to fitted lines, whole sheets at a time."""
    cos, sin = (np.array([f(math.radians(d)) for d in degrees]) for f in (math.cos, math.sin))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_sheets(batches):
            of = rows["sheet"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            enough = np.bincount(of)[of] >= LEAST_ON_SHEET
            if not enough.any():
                continue
            rows, of = rows.filter(pa.array(enough)), np.unique(of[enough], return_inverse=True)[1]
            x, y, w, h, t = (rows[c].to_numpy() for c in ("x", "y", "w", "h", "t"))
            ids = rows["id"].to_numpy()
            mark = np.cumsum(np.append(True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])))
            rho, along = x[:, None] * cos + y[:, None] * sin, y[:, None] * cos - x[:, None] * sin
            cell = np.clip(np.floor(rho / (2 * t)[:, None]), -(2.0**53), 2.0**53).astype(np.int64)
            sheet, k, own, middle, lo, hi, stroke = _proposed(of, mark, cell, rho, along, t)
            wide, beyond, size = np.fmax(MIN_BAND, BAND * stroke), BEYOND * stroke, 2 * stroke
            first, counts = np.searchsorted(of, sheet), np.bincount(of)[sheet]
            marks, ends = np.column_stack([x, y, w, h]), np.cumsum(counts)
            for part in np.split(np.arange(len(sheet)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
                # a line with every mark of its sheet, then those in its band
                line = np.repeat(part, counts[part])
                at = np.arange(len(line)) - np.repeat(np.cumsum(counts[part]) - counts[part], counts[part]) + first[line]
                r, c = rho[at, k[line]], cell[at, k[line]]
                within = (np.abs(r - middle[line]) <= wide[line]) & (c >= np.floor((middle - wide) / size)[line]) & (c <= np.floor((middle + wide) / size)[line])
                line, at = line[within], at[within]
                a = along[at, k[line]]
                within = (a >= (lo - beyond)[line]) & (a <= (hi + beyond)[line])
                line, at = line[within] - part[0] if len(part) else line[within], at[within]
                held = np.bincount(line, minlength=len(part))
                deg = np.array(degrees, np.int32)[k[part]]
                for i, place, *columns in _fitted(marks[at], np.cumsum(held) - held, held, stroke[part], deg):
                    mine = pa.array(at[place])
                    yield pa.RecordBatch.from_arrays([rows["sheet"].combine_chunks().take(mine), pa.array(deg[i]), pa.array(own[part][i]), rows["id"].combine_chunks().take(mine), pa.array(stroke[part][i]), *map(pa.array, columns)], FITTED)

    return run


def _votes(turned: DataFrame) -> DataFrame:
    """Distance ``rho`` of each mark's line at the angle ``deg`` of its normal, its cell, and the place along the line."""
    a, size = F.radians("deg"), 2 * F.greatest("t", F.lit(1.0))
    votes = turned.withColumns({"rho": F.col("x") * F.cos(a) + F.col("y") * F.sin(a), "along": F.col("y") * F.cos(a) - F.col("x") * F.sin(a)})
    return votes.withColumn("cell", F.floor(F.col("rho") / size))


def proposals(marks: DataFrame, degrees: list[int]) -> tuple[DataFrame, DataFrame]:
    """Votes (a row for each mark and each angle that its sheet has lines of) and the lines proposed, ``sheet, deg, cell, rho, lo, hi``."""
    # votes are counted by windows after the one shuffle of marks by sheets, since they are many times the marks
    dealt = marks.filter("sheet is not null").repartition("sheet")
    enough = dealt.withColumn("n", F.count("*").over(Window.partitionBy("sheet"))).filter(F.col("n") >= LEAST_ON_SHEET).drop("n")
    votes = _votes(enough.select("sheet", "id", "x", "y", "t", F.explode(F.array(*map(F.lit, degrees))).alias("deg"))).drop("x", "y")
    counted = votes.withColumn("n", F.count("*").over(Window.partitionBy("sheet", "deg", "cell")))
    best = counted.filter(F.col("n") >= SUPPORT).groupBy("sheet", "id").agg(F.max(F.struct("n", (-F.col("deg")).alias("deg"), (-F.col("cell")).alias("cell"), "rho", "along", "t")).alias("b"))
    each = best.groupBy("sheet", (-F.col("b.deg")).alias("deg"), (-F.col("b.cell")).alias("cell"))
    lines = each.agg(F.count("*").alias("n"), F.round(F.avg("b.rho"), 6).alias("rho"), F.min("b.along").alias("lo"), F.max("b.along").alias("hi"), F.max("b.t").alias("t"))
    lines = lines.filter(F.col("n") >= SUPPORT).drop("n")
    turns = lines.groupBy("sheet").agg(F.collect_set("deg").alias("degs"))
    # merged: the planner doesn't know how many votes a mark has, and would send them all to each executor
    return _votes(enough.join(turns.hint("merge"), "sheet").withColumn("deg", F.explode("degs")).drop("degs")), lines


def dotted_walls(marks: DataFrame, axis_turn: float | None = AXIS_TURN) -> DataFrame:
    """Segments of ``marks`` (sheet, id, x, y, w, h: centre and size, t: the sheet's stroke width).

    ``axis_turn`` keeps what lies within so many degrees of an axis; None keeps all. Marks that no line holds give no
    row. Marks with a null coordinate are on no line; two marks at one place are two.
    """
    upright = lambda d: min(d % 90, 90 - d % 90)
    degrees = [d for d in range(180) if axis_turn is None or upright(d) <= axis_turn]
    placed = marks.filter((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & F.col("sheet").isNotNull())
    counted = placed.groupBy("sheet").agg(F.count("*").alias("n"))
    large = stage(counted.filter(F.col("n") > ONE_PIECE).select("sheet"), "large-sheets")
    if large.isEmpty():
        drop(large)
        return _runs(_fitted_in_place(placed, degrees), axis_turn)
    small, rest = placed.join(large, "sheet", "left_anti"), placed.join(large, "sheet", "left_semi")
    return _runs(_fitted_in_place(small, degrees).unionByName(_fitted_by_votes(rest, degrees)), axis_turn)


def _schema(marks: DataFrame) -> str:
    sheet, ident = (marks.schema[c].dataType.simpleString() for c in ("sheet", "id"))
    return f"sheet {sheet}, deg int, cell bigint, id {ident}, t double, s double, d double, cx double, cy double, ux double, uy double"


def _fitted_in_place(marks: DataFrame, degrees: list[int]) -> DataFrame:
    """Marks are shuffled once by sheets; their votes, many times as many, are never rows of Spark."""
    number = lambda c: F.col(c).cast("double").alias(c)
    held = marks.select("sheet", "id", *map(number, ("x", "y", "w", "h")), F.greatest("t", F.lit(1.0)).cast("double").alias("t"))
    return held.repartition("sheet").sortWithinPartitions("sheet", "id", "x", "y", "w", "h").mapInArrow(_fit_sheets(degrees), _schema(marks))


def _fitted_by_votes(marks: DataFrame, degrees: list[int]) -> DataFrame:
    """The same for sheets that needn't fit in a task: votes are rows, counted by windows and joined by cells."""
    votes, lines = proposals(marks, degrees)
    wide, size = F.greatest(F.lit(MIN_BAND), BAND * F.greatest("t", F.lit(1.0))), 2 * F.greatest("t", F.lit(1.0))
    spread = lines.withColumn("at", F.explode(F.sequence(F.floor((F.col("rho") - wide) / size), F.floor((F.col("rho") + wide) / size))))
    held = votes.select("sheet", "deg", F.col("cell").alias("at"), "id", "x", "y", "w", "h", F.col("rho").alias("r"), "along")
    beyond = BEYOND * F.greatest("t", F.lit(1.0))
    near = held.join(spread.hint("merge"), ["sheet", "deg", "at"]).filter((F.abs(F.col("r") - F.col("rho")) <= wide) & F.col("along").between(F.col("lo") - beyond, F.col("hi") + beyond))
    held = near.groupBy("sheet", "deg", "cell").agg(F.max("t").alias("t"), F.array_sort(F.collect_list(F.struct("id", "x", "y", "w", "h"))).alias("marks"))
    return held.mapInArrow(_fit, _schema(marks))


def _runs(on_lines: DataFrame, axis_turn: float | None) -> DataFrame:
    line = ["sheet", "deg", "cell"]
    w, whole = Window.partitionBy(*line).orderBy("s", "id"), Window.partitionBy(*line)
    t = F.greatest("t", F.lit(1.0))
    step = F.col("s") - F.lag("s").over(w)
    stepped = on_lines.withColumns({"step": step, "gap": F.greatest(F.lit(0.0), step - (F.col("d") + F.lag("d").over(w)) / 2)})
    motif = (F.col("gap") > LEAST_GAP * t) & (F.col("gap") <= MOST_GAP * t)
    usual = lambda c: F.percentile(F.when(motif, F.col(c)), 0.5).over(whole)
    known = stepped.withColumns({"usual_gap": usual("gap"), "usual_step": usual("step")}).filter("usual_gap is not null")
    breaks = F.col("gap") > F.greatest(BREAK_GAPS * F.col("usual_gap") + BREAK_STROKES * t, BREAK_STEPS * F.col("usual_step"))
    cut = known.withColumn("new", F.coalesce(breaks, F.lit(True))).withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = lambda c, q: F.percentile(F.when(~F.col("new"), F.col(c)), q)
    end = lambda c: F.struct("s", "id", "d", "cx", "cy", "ux", "uy")
    runs = cut.groupBy(*line, "run").agg(
        F.count("*").alias("support"), F.max("t").alias("t"), F.min(end("a")).alias("a"), F.max(end("b")).alias("b"),
        inner("step", 0.5).alias("pitch"), inner("step", 0.25).alias("q1"), inner("step", 0.75).alias("q3"), inner("gap", 0.5).alias("gap"), inner("gap", 0.9).alias("wide"),
    ).filter(F.col("support") >= SUPPORT)
    from_, to = F.col("a.s") - F.col("a.d") / 2, F.col("b.s") + F.col("b.d") / 2
    sized = runs.withColumns({"from": from_, "to": to, "length": to - from_, "dispersion": (F.col("q3") - F.col("q1")) / F.greatest(F.lit(1.0), "pitch")})
    firm = sized.filter((F.col("dispersion") <= DISPERSION) & (F.col("length") >= F.greatest(SLENDER * t, (SUPPORT - 1) * F.col("pitch"))))
    at = lambda s, c: F.round(F.col(f"a.c{c}") + F.col(s) * F.col(f"a.u{c}"), 3)
    out = firm.withColumns({"x1": at("from", "x"), "y1": at("from", "y"), "x2": at("to", "x"), "y2": at("to", "y")})
    if axis_turn is not None:
        turn = F.degrees(F.atan2(F.abs(F.col("a.uy")), F.abs(F.col("a.ux"))))
        out = out.filter(F.least(turn, 90 - turn) <= axis_turn)
    sure = (F.col("dispersion") <= SURE_DISPERSION) & (F.col("support") >= SURE_MARKS)
    # neighbouring cells that propose one line end in the same marks: one of them stays
    one = Window.partitionBy("sheet", "a.id", "b.id", "support").orderBy("deg", "cell")
    first = out.withColumn("k", F.row_number().over(one)).filter("k = 1")
    return first.select(
        "sheet", F.col("a.id").alias("first"), F.col("b.id").alias("last"), "x1", "y1", "x2", "y2", "support", F.round("length", 3).alias("length"), F.round("pitch", 3).alias("pitch"), F.round("gap", 3).alias("gap"),
        F.ceil(F.round(F.col("wide") + F.greatest("t", F.lit(1.0)), 9)).alias("most_gap"), F.round("dispersion", 4).alias("dispersion"), F.when(sure, "high").otherwise("candidate").alias("confidence"),
    )
