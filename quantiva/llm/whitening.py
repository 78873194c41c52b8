"""Embedding whitening by a tiled covariance: column blocks meet by row block, tile pairs are multiplied and summed.

Vectors are laid on a lattice of whole numbers, so that equal ones are equal and their sums are exact. The fit list
holds each different vector once. It is written as row blocks (rows of one Arrow batch); each row block is cut into
column blocks of TILE dimensions, which are shuffled by row block, so that those of the same rows meet. A pair of
column blocks is centred and multiplied; the products are added up in each task by the pair's tile key and then over
the tasks. Tiles are put together on the driver, whose matrix has the square of the dimensions (MAX_DIMENSIONS at
most, 128 MB) whatever the number of rows, and decomposed into eigenvectors there. Rows are projected where they are
read, without a shuffle.

The mean is taken off in two steps, its whole part as a whole number and the rest as a fraction, so nothing is
lost to cancellation. The identity error is measured, not derived: the fit list is whitened and its covariance is
taken by the same tiles.

Defined cases: rows whose vector is null or has an entry that is null, not finite or too large for the lattice (2**61
after scaling) are dropped; vectors of each length are a space of their own, whitened by themselves; a component
whose variance is within rounding of zero is left out, so constant dimensions and fewer vectors than dimensions give
fewer components, and a single vector gives no rows; a deviation too large for a long is null; equal variances give
any basis of their space; repeated rows count once in the fit and give rows each; a null id is passed on; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, small_batches

SCALE, OFFSET = 64, 1_000_000
COMPONENTS, TILE, MAX_DIMENSIONS = 16, 32, 4096
_BLOCKS = "space int, block bigint, size bigint, data binary, sums array<decimal(38,0)>"


@dataclass
class Space:
    """The fit of all vectors of one length: ``whole`` + ``rest`` is their mean, ``whole`` in whole numbers."""

    n: int
    whole: np.ndarray
    left: np.ndarray  # sums minus n times whole, exact
    rest: np.ndarray
    axes: np.ndarray | None = None  # dimensions x components
    variance: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.variance)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of squares of n * x - sums."""
        a = x - self.whole
        most = len(self.whole) * (self.n * int(np.abs(a).max(initial=0)) + int(np.abs(self.left).max(initial=0))) ** 2
        if most < 1 << 63:
            return ((self.n * a - self.left) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * p - q) ** 2 for p, q in zip(row, self.left.tolist(), strict=True)) for row in a.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def lattice(vector: str) -> Column:
    """The vector in whole numbers (array<bigint>), null where a row is to be dropped."""
    scaled = lambda c: c.cast("double") * SCALE
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(scaled(c)) < float(1 << 61), F.lit(False)))  # NaN is above all
    return F.when(sound, F.transform(vector, lambda c: F.floor(scaled(c)) + OFFSET))


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of a list column's rows, one length after the other; empty rows have no space."""
    column = column.cast(pa.large_list(pa.int64()))
    at = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(at)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        yield d, rows, values[at[rows][:, None] + np.arange(d)]


def _row_blocks(fit: DataFrame) -> DataFrame:
    """Row blocks of the different vectors ``x``, with their sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for d, _, x in _by_length(batch.column(0)):
                if d > MAX_DIMENSIONS:
                    raise ValueError(f"a covariance of {d} dimensions; at most {MAX_DIMENSIONS} fit on the driver")
                safe = int(np.abs(x).max()) < (1 << 62) // len(x)
                sums = [Decimal(int(v)) for v in (x if safe else x.astype(object)).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([block]), pa.array([len(x)]), pa.array([x.astype("<i8").tobytes()]), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], ["space", "block", "size", "data", "sums"])
                block += 1

    return fit.select("x").mapInArrow(run, _BLOCKS)


def _column_blocks(blocks: DataFrame, read: Callable[[int, bytes, int], np.ndarray], tile: int) -> DataFrame:
    """``space, block, part, size, cells``: each row block's centred values, ``tile`` columns at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, block, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = read(space, data, size)
                parts = range(0, x.shape[1], tile)
                cells = [np.ascontiguousarray(x[:, p : p + tile]).astype("<f8").tobytes() for p in parts]
                k = len(cells)
                yield pa.RecordBatch.from_arrays([pa.array([space] * k, pa.int32()), pa.array([block] * k), pa.array(range(k), pa.int32()), pa.array([size] * k), pa.array(cells, pa.binary())], ["space", "block", "part", "size", "cells"])

    return blocks.select("space", "block", "size", "data").mapInArrow(run, "space int, block bigint, part int, size bigint, cells binary")


def _products(pairs: DataFrame) -> DataFrame:
    """``space, i, j, tile``: each task's sums of the products of the column blocks ``a`` and ``b`` that met in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for space, i, j, size, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(a, "<f8").reshape(size, -1).T @ np.frombuffer(b, "<f8").reshape(size, -1)
                total[space, i, j] = total[space, i, j] + one if (space, i, j) in total else one
        for (space, i, j), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([space], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([v.ravel().tolist()])], ["space", "i", "j", "tile"])

    return pairs.mapInArrow(run, "space int, i int, j int, tile array<double>")


def _scatter(blocks: DataFrame, read: Callable[[int, bytes, int], np.ndarray], widths: dict[int, int], tile: int) -> dict[int, np.ndarray]:
    """Per space the sum of outer products of the centred rows that ``read`` gives, put together from its tiles."""
    cut = _column_blocks(blocks, read, tile)
    a = cut.select("space", "block", F.col("part").alias("i"), "size", F.col("cells").alias("a"))
    b = cut.select("space", "block", F.col("part").alias("j"), F.col("cells").alias("b"))
    met = a.join(b.hint("shuffle_hash"), ["space", "block"]).filter("i <= j").select("space", "i", "j", "size", "a", "b")
    cells = _products(met).select("space", "i", "j", F.posexplode("tile").alias("at", "v")).groupBy("space", "i", "j", "at").agg(F.sum("v").alias("v"))
    out = {s: np.zeros((w, w)) for s, w in widths.items()}
    tiles = cells.groupBy("space", "i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("tile"))
    for r in tiles.toLocalIterator():
        m, i, j = out[r["space"]], r["i"] * tile, r["j"] * tile
        v = np.array([x["v"] for x in r["tile"]]).reshape(min(tile, len(m) - i), min(tile, len(m) - j))
        m[i : i + v.shape[0], j : j + v.shape[1]] = v
        m[j : j + v.shape[1], i : i + v.shape[0]] = v.T
    return out


def _principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axes, variances and explained shares of a covariance, by falling variance; signs so that the largest entry is positive."""
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    keep = np.flatnonzero(e > max(e[0], 0) * len(e) * np.finfo(float).eps)[:components]
    axes = axes[:, keep] * np.sign(axes[np.abs(axes[:, keep]).argmax(axis=0), keep])
    return axes, e[keep], e[keep] / np.trace(v)


def fit(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> dict[int, Space]:
    """The spaces of the vectors ``x`` (array<bigint>, null: not regarded) of ``rows``, by length."""
    small_batches(rows.sparkSession)
    blocks = materialize(_row_blocks(rows.select("x").filter("size(x) > 0").distinct()), "whitening-blocks")
    spaces = {}
    sizes = {r["space"]: r["n"] for r in blocks.groupBy("space").agg(F.sum("size").alias("n")).collect()}
    by_dim = blocks.select("space", F.posexplode("sums").alias("at", "s")).groupBy("space", "at").agg(F.sum("s").alias("s"))
    found: dict[int, dict[int, int]] = {s: {} for s in sizes}
    for r in by_dim.toLocalIterator():
        found[r["space"]][r["at"]] = int(r["s"])
    for s, n in sizes.items():
        sums = [found[s][k] for k in range(s)]
        whole = [v // n for v in sums]
        left = [v - n * w for v, w in zip(sums, whole, strict=True)]
        spaces[s] = Space(n, np.array(whole, np.int64), np.array(left, np.int64), np.array(left) / n)
    held = {s: (p.whole, p.rest) for s, p in spaces.items()}
    centred = lambda s, data, size: (np.frombuffer(data, "<i8").reshape(size, s) - held[s][0]) - held[s][1]
    for s, m in _scatter(blocks, centred, {s: s for s in spaces}, tile).items():
        p = spaces[s]
        p.axes, p.variance, p.explained = _principal(m / p.n, components)
    white = lambda s, data, size: spaces[s].whitened(np.frombuffer(data, "<i8").reshape(size, s))
    widths = {s: len(p.variance) for s, p in spaces.items() if len(p.variance)}
    some = blocks.filter(F.col("space").isin(list(widths)))
    for s, m in (_scatter(some, white, widths, tile) if widths else {}).items():
        spaces[s].identity_error = float(np.abs(m / spaces[s].n - np.eye(len(m))).max())
    discard(blocks)
    return spaces


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every row that isn't dropped."""
    placed = rows.select(key, lattice(vector).alias("x")).filter("x is not null")
    spaces = fit(placed, components, tile)
    id_type = rows.schema[key].dataType
    schema = f"`{key}` {id_type.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                p = spaces[d]
                m, k = len(at), len(p.variance)
                each = lambda v: pa.array(np.tile(v, m))
                again = pa.array(np.repeat(np.arange(m), k))
                ids = batch.column(0).take(pa.array(at)).take(again)
                far = pa.array(p.deviation(x), pa.int64()).take(again)
                yield pa.RecordBatch.from_arrays([ids, each(np.arange(1, k + 1, dtype=np.int32)), each(np.full(k, p.n)), far, pa.array(p.whitened(x).ravel()), each(p.explained), each(np.full(k, p.identity_error))], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return placed.mapInArrow(run, schema)
