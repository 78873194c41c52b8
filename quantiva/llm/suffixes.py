"""Byte-substring dedup with a logarithmic family of sparse suffix arrays that is kept between batches.

The texts' suffixes are sampled at anchors: in each ``length``-byte string the position of the least hash of GRAM
bytes, so that equal strings have their anchor at the same place. All strings of one anchor are a block. A level of
the index is a table of blocks in the order of a suffix array: by the hash of the anchor's bytes, then by that of the
block's; of blocks of equal bytes it holds the earliest.

A batch's blocks are sorted together with those of the existing levels (a merge-scan of sorted runs). Equal blocks are matches at once: all but the earliest are repeats. Where different blocks meet at one
anchor (the edges of copied passages) a suffix array proper is built: their bytes are fetched from the texts, all
``length``-byte strings are sorted byte by byte, and neighbours with a common prefix of ``length`` bytes are matches.
Then the batch's blocks become a level, and levels of equal size are merged, so there are logarithmically many.

Nothing is held by anchor or document without a bound: sorted rows are streamed, a passage of any number of
documents is sent once by each part of the input, and an anchor with more than HOT different blocks is split by the
strings themselves, of which again each part sends one.

Defined cases: null and empty texts have no bytes; texts under ``length`` bytes are kept whole; rows that repeat
an id and text do not remove each other, rows that repeat an id with other texts count as one document read in
the order of their hash; a null id neither removes nor is removed from; empty tables give empty results; other
columns are not read. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum as T
from .scratch import discard, materialize, new_folder, small_batches
from .scratch import remove as remove_folder
from .substring import covered

LENGTH, GRAM = 100, 32
FLUSH = 300_000  # suffixes or strings held by a task before they are sent on
PIECE = 1 << 18  # bytes of text anchored at once
HOT = 4096  # different blocks of an anchor from which it is split by its strings

#: what a row is: a block of its own anchor, one that shares its anchor with others (of this batch, of a level), or
#: starts that are repeats
ALONE, SHARED, SHARED_OLD, LATE = 0, 1, 2, 3
_ROW = np.dtype([("g", "<i8"), ("h", "<i8"), ("id", "<i8"), ("key", "<i8"), ("at", "<i8"), ("n", "<i8"), ("kind", "<i4")])
_SQL = "g bigint, h bigint, id bigint, key bigint, at bigint, n bigint, kind int"
_NAMES = list(_ROW.names)


def _table(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for c in _NAMES], _NAMES)


def _rows(size: int, /, **columns: object) -> np.ndarray:
    out = np.zeros(size, _ROW)
    for k, v in columns.items():
        out[k] = v
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it in any column; the first does."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _joined(late: np.ndarray) -> np.ndarray:
    """Repeats with starts that follow each other as one row with their number."""
    late = late[np.lexsort((late["at"], late["key"], late["id"]))]
    if not len(late):
        return late
    cut = _changes(late["id"], late["key"])
    cut[1:] |= late["at"][1:] > (late["at"] + late["n"])[:-1]
    first = np.flatnonzero(cut)
    out = late[first].copy()
    out["n"] = np.maximum.reduceat(late["at"] + late["n"], first) - out["at"]
    out["kind"], out["h"] = LATE, 0
    out["g"] = T.mix((out["id"] ^ out["at"]).view(T.U64)).view(np.int64)  # dealt out at random
    return out


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether suffixes are one: rows that repeat an id and text send it several times."""
    return (a["id"] == b["id"]) & (a["key"] == b["key"]) & (a["at"] == b["at"])


def blocks(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of some texts: for each anchor its text's row, its hash, the hash of its block, the first start and the number."""
    values = T._BYTE[0][data]
    grams = T.window_hashes(values, gram)
    at = T.sliding_argmin(grams, length - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    s = np.flatnonzero(np.arange(len(at)) + length <= offsets[1:][row])
    if not len(s):
        return (np.zeros(0, np.int64),) * 5
    change = np.flatnonzero(_changes(at[s], s - np.arange(len(s))))
    n = np.diff(np.append(change, len(s)))
    first, anchor = s[change], at[s[change]]
    # a block's hash: its first and last string, their number and the anchor's place
    strings = T.window_hashes(values, length)
    with np.errstate(over="ignore"):
        h = strings[first] * T.U64(0x9E3779B97F4A7C15) ^ strings[first + n - 1] * T.U64(0xC2B2AE3D27D4EB4F)
        h = T.mix(h + n.astype(T.U64) * T.U64(0x165667B19E3779F9) + T.mix((anchor - first).astype(T.U64)))
    return row[first], grams[anchor].view(np.int64), h.view(np.int64), first - offsets[row[first]], n


def _pieces(t: T.Texts, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A chunk's bytes with offsets and the place of the first; a long text comes in pieces that share ``length`` - 1 bytes."""
    if len(t.offsets) > 2 or len(t.data) <= PIECE + length:
        yield t.data, t.offsets, 0
    else:
        for begin in range(0, len(t.data) - length + 1, PIECE):
            part = t.data[begin : begin + PIECE + length - 1]
            yield part, np.array([0, len(part)]), begin


def _fresh(x: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the earliest of those alike in ``by``, and which repeat an earlier one that is another suffix."""
    order = np.lexsort((x["at"], x["key"], x["id"], *by))
    new = _changes(*(c[order] for c in by))
    owner = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = ~new & ~_same(x[order], x[owner])
    return np.sort(order[new]), np.sort(order[late])


def batch_blocks(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Blocks of ``doc_id, key, text``: of equal ones in a part of the input the earliest, and the others as repeats."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            x = np.concatenate(held)
            fresh, late = _fresh(x, x["h"], x["g"])
            yield _table(x[fresh])
            yield _table(_joined(x[late]))

        for batch in batches:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for t in T.texts(batch.column(2), PIECE):
                for data, offsets, begin in _pieces(t, length):
                    row, g, h, at, n = blocks(data, offsets, length, gram)
                    held.append(_rows(len(g), g=g, h=h, id=ids[t.rows.start + row], key=keys[t.rows.start + row], at=at + begin, n=n, kind=ALONE))
                    if sum(map(len, held)) > FLUSH:
                        yield from out()
                        held = []
        if held:
            yield from out()

    return docs.mapInArrow(send, _SQL)


def merge_scan(sorted_blocks: DataFrame) -> DataFrame:
    """Rows of blocks sorted by anchor, block and suffix within partitions, put in their kinds; repeats are passed on.

    Blocks of levels (SHARED_OLD on the way in) only come out if they share an anchor, or as repeats.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, _ROW)  # the last block's owner, whose successor is not known yet
        first, told = True, False  # whether it is the first of its anchor, and whether it was put out

        def put(owners: np.ndarray, shared: np.ndarray) -> pa.RecordBatch:
            old = owners["kind"] == SHARED_OLD
            out = owners.copy()
            out["kind"] = np.where(old, SHARED_OLD, np.where(shared, SHARED, ALONE))
            return _table(out[shared | ~old])

        for batch in batches:
            got = np.zeros(batch.num_rows, _ROW)
            for k, name in enumerate(_NAMES):
                got[name] = np.asarray(batch.column(k))
            yield _table(got[got["kind"] == LATE])
            x = np.concatenate([held, got[got["kind"] != LATE]])
            if not len(x):
                continue
            new = _changes(x["g"], x["h"])
            own = np.flatnonzero(new)
            late = x[~new & ~_same(x, x[own[np.cumsum(new) - 1]])]
            if len(late):
                yield _table(_joined(late))
            owners = x[own]
            before = np.append(not first if len(held) else False, owners["g"][1:] == owners["g"][:-1])
            after = np.append(owners["g"][1:] == owners["g"][:-1], False)
            ready = np.ones(len(owners), bool)
            ready[0] = not (told and len(held))
            known = before[-1] and ready[-1]  # the last shares its anchor with one before it, or must wait
            if not before[-1]:
                ready[-1] = False
            yield put(owners[ready], (before | after)[ready])
            told = bool(known) if len(owners) > 1 or not len(held) else told or bool(known)
            first, held = not before[-1], owners[-1:]
        if len(held) and not told:
            yield put(held, np.array([not first]))

    return sorted_blocks.mapInArrow(scan, _SQL)


def string_array(bodies: list[bytes], x: np.ndarray, part: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of all ``length``-byte strings of some blocks: suffixes and strings in the order of part, bytes
    and suffix, and how each differs from the one before it."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    n = x["n"]
    begin = np.cumsum(n + length - 1) - (n + length - 1)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    each = np.repeat(x, n)
    each["at"] += step
    each["n"] = 1
    strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[np.repeat(begin, n) + step]).view(f"S{length}").ravel()
    parts = np.repeat(part, n)
    order = np.lexsort((each["at"], each["key"], each["id"], strings, parts))
    return each[order], strings[order], _changes(parts[order], strings[order])


def _late_strings(each: np.ndarray, new: np.ndarray) -> np.ndarray:
    own = np.flatnonzero(new)
    return each[~new & ~_same(each, each[own[np.cumsum(new) - 1]])] if len(each) else each


_LEVEL = ["g", "h", "id", "key", "at", "n"]


def earliest(sorted_levels: DataFrame) -> DataFrame:
    """Of equal blocks the first, of rows sorted by anchor, block and suffix within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, h = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            new = _changes(g, h)
            new[0] = last != (g[0], h[0])
            last = g[-1], h[-1]
            yield batch.filter(pa.array(new))

    return sorted_levels.select(*_LEVEL).mapInArrow(run, ", ".join(f"{c} bigint" for c in _LEVEL))


_BODY = "part bigint, id bigint, key bigint, at bigint, n bigint, body binary"


def shared_bodies(texts: DataFrame, length: int) -> DataFrame:
    """``id, key, text, open`` (structs of at, n, g and whether the anchor is hot) to the bytes of each block.

    A hot anchor's strings go by themselves, in parts of their own: of equal ones the earliest here; the others are
    rows without bytes, as repeats.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: list[tuple[np.ndarray, list[bytes]]] = []
        n_hot = 0

        def table(part: np.ndarray, x: np.ndarray, bodies: list[bytes | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part)), *(pa.array(np.ascontiguousarray(x[c])) for c in ("id", "key", "at", "n")), pa.array(bodies, pa.binary())], ["part", "id", "key", "at", "n", "body"])

        def split() -> Iterator[pa.RecordBatch]:
            x, bodies = np.concatenate([h[0] for h in hot]), [b for h in hot for b in h[1]]
            each, strings, new = string_array(bodies, x, x["g"], length)
            late = _joined(_late_strings(each, new))
            yield table(late["g"], late, [None] * len(late))
            mine = strings[new]
            whole = mine.view(np.uint8).reshape(len(mine), length)
            part = T.mix(T.window_hashes(T._BYTE[0][whole.ravel()], length)[::length] ^ each["g"][new].view(T.U64)).view(np.int64)
            for k in range(0, len(part), 4096):
                yield table(part[k : k + 4096], each[new][k : k + 4096], [w.tobytes() for w in whole[k : k + 4096]])

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_buffer()
                spans = batch.column(3)[i].values
                at, n, g, is_hot = (np.asarray(spans.field(k)) for k in range(4))
                x = _rows(len(at), id=batch.column(0)[i].as_py(), key=batch.column(1)[i].as_py(), at=at, n=n, g=g)
                raw = memoryview(data)
                cold = np.flatnonzero(~is_hot)
                for k in range(0, len(cold), 4096):
                    own = x[cold[k : k + 4096]]
                    yield table(own["g"].copy(), own, [bytes(raw[a : a + m + length - 1]) for a, m in zip(own["at"].tolist(), own["n"].tolist(), strict=True)])
                own = x[is_hot]
                if len(own):
                    hot.append((own, [bytes(raw[a : a + m + length - 1]) for a, m in zip(own["at"].tolist(), own["n"].tolist(), strict=True)]))
                    n_hot += int(own["n"].sum())
                if n_hot > FLUSH:
                    yield from split()
                    hot, n_hot = [], 0
        if hot:
            yield from split()

    return texts.mapInArrow(send, _BODY)


def string_repeats(sorted_bodies: DataFrame, length: int) -> DataFrame:
    """``id, key, at, n``: the repeats among the strings of each part, of rows sorted by part within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held = 0

        def out(rows: pa.Table) -> pa.RecordBatch:
            x = _rows(len(rows), **{c: np.asarray(rows.column(c)) for c in ("id", "key", "at", "n")})
            each, _, new = string_array(rows.column("body").to_pylist(), x, np.asarray(rows.column("part")), length)
            late = _joined(_late_strings(each, new))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(late[c])) for c in ("id", "key", "at", "n")], ["id", "key", "at", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                held.append(piece)
                n_held += int(np.asarray(piece.column(4)).sum())
                if n_held > FLUSH:
                    rows = pa.Table.from_batches(held)
                    part = np.asarray(rows.column("part"))
                    cut = int(np.searchsorted(part, part[-1], "left"))  # the last part may go on
                    if cut:
                        yield out(rows.slice(0, cut))
                        held = rows.slice(cut).to_batches()
                        n_held = int(np.asarray(rows.slice(cut).column("n")).sum())
        if held:
            yield out(pa.Table.from_batches(held))

    return sorted_bodies.mapInArrow(run, "id bigint, key bigint, at bigint, n bigint")


class SuffixIndex:
    """A family of levels in a folder that all executors reach, with the texts that they point into.

    ``add`` takes a batch of documents, finds the repeats between it and all that was added before (either may be the
    later one) and within it, and adds it to the index. Texts are copied into the folder, unless ``texts`` is a table
    (doc_id, text) that has those of all batches for as long as the index is used.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, length: int = LENGTH, gram: int = GRAM, texts: DataFrame | None = None) -> None:
        self.spark, self.folder, self.length, self.gram, self.texts = spark, folder or new_folder(spark, "suffix-index"), length, gram, texts
        self.merged = 0  # merges of levels so far

    def _list(self, kind: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n for n in names if n.startswith(f"{kind}-"))

    def levels(self) -> dict[str, int]:
        """The levels' names and numbers of blocks."""
        return {n: int(n.split("-")[2]) for n in self._list("level")}

    def _read(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.folder}/{n}" for n in names)) if names else None

    def spans(self) -> DataFrame:
        """``id, key, at, n`` of all repeats found so far: starts of ``length``-byte strings, ``n`` one after the other."""
        empty = self.spark.createDataFrame([], "id bigint, key bigint, at bigint, n bigint")
        return self._read(self._list("found")) or empty

    def add(self, docs: DataFrame) -> None:
        small_batches(self.spark)
        keyed = lambda d: d.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("key"), "text")
        src = keyed(docs)
        batch = len(self._list("found"))
        blocks_ = batch_blocks(src, self.length, self.gram)
        levels = self._level(list(self.levels()))
        merged = blocks_ if levels is None else blocks_.unionByName(levels.withColumn("kind", F.lit(SHARED_OLD)))
        dealt = merged.repartition(F.col("g")).sortWithinPartitions("g", "h", "id", "key", "at")
        # what the scan writes becomes the batch's level: its rows that are of levels already, or repeats, are not read as such
        name = f"{self.folder}/new-{batch:06d}-0"
        merge_scan(dealt).write.option("compression", "zstd").parquet(name)
        scanned = self.spark.read.parquet(name)

        open_ = scanned.filter(F.col("kind").isin(SHARED, SHARED_OLD))
        many = open_.groupBy("g").count().filter(F.col("count") > HOT).select("g", F.lit(True).alias("hot"))
        marked = open_.join(many, "g", "left").select("id", "key", F.struct("at", "n", "g", F.coalesce("hot", F.lit(False)).alias("hot")).alias("open"))
        asked = marked.groupBy("id", "key").agg(F.collect_list("open").alias("open"))
        if levels is None:
            texts = src
        else:
            texts = src.unionByName(self._read(self._list("texts"))) if self.texts is None else keyed(self.texts)
        bodies = shared_bodies(texts.join(asked, ["id", "key"]).select("id", "key", "text", "open"), self.length)
        sent = materialize(bodies, "suffix-bodies")
        compared = string_repeats(sent.filter("body is not null").repartition(F.col("part")).sortWithinPartitions("part"), self.length)
        cols = ["id", "key", "at", "n"]
        found = scanned.filter(F.col("kind") == LATE).select(*cols).unionByName(sent.filter("body is null").select(*cols)).unionByName(compared)
        found.write.option("compression", "zstd").parquet(f"{self.folder}/found-{batch:06d}")
        discard(sent)
        if self.texts is None:
            src.write.option("compression", "zstd").parquet(f"{self.folder}/texts-{batch:06d}")
        self._append(batch)

    def _append(self, batch: int) -> None:
        """Make what was scanned a level, and merge the smallest levels while one is at most twice the size of the other.

        The scan has left one row for each block, in the order of the array; two levels are merged in that order.
        """
        made = self._show(batch, 0)
        while True:
            sizes = sorted(self.levels().items(), key=lambda x: x[1])
            pair = next(((a, b) for (a, m), (b, n) in zip(sizes, sizes[1:], strict=False) if n < 2 * max(m, 1)), None)
            if pair is None:
                return
            made += 1
            both = self._level(list(pair)).repartition(F.col("g")).sortWithinPartitions(*_LEVEL[:5])
            earliest(both).withColumn("kind", F.lit(ALONE)).write.option("compression", "zstd").parquet(f"{self.folder}/new-{batch:06d}-{made}")
            self._show(batch, made)
            self.merged += 1
            for name in pair:
                remove_folder(self.spark, f"{self.folder}/{name}")

    def _level(self, names: list[str]) -> DataFrame | None:
        held = self._read(names)
        return held and held.filter(F.col("kind").isin(ALONE, SHARED)).select(*_LEVEL)

    def _show(self, batch: int, step: int) -> int:
        """Give a written table the name of a level, with its number of blocks."""
        name = f"new-{batch:06d}-{step}"
        rows = self._level([name]).count()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}")
        path(name).getFileSystem(conf).rename(path(name), path(f"level-{batch:06d}.{step}-{rows}"))
        return step


def add_in_batches(index: SuffixIndex, docs: DataFrame, batches: int) -> None:
    """Add the documents in so many batches of about the same size, dealt out by a hash of the id."""
    for k in range(batches):
        index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = True, index: SuffixIndex | None = None, batches: int = 1) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes for every row.

    The documents are added to an index of their own in ``batches``, or were already added to ``index``, whose other
    documents count as well then.
    """
    if index is None:
        index = SuffixIndex(docs.sparkSession, None, length, gram, docs)
        add_in_batches(index, docs, batches)
    packed = F.struct(F.col("at").cast("int").alias("at"), F.col("n").cast("int").alias("n"))
    found = index.spans().groupBy("id", "key").agg(F.collect_list(packed).alias("spans"))
    src = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for i in range(part.num_rows):
                    data = np.frombuffer(part.column(1)[i].as_buffer(), np.uint8)
                    spans = part.column(2)[i]
                    if not spans.is_valid:
                        rows.append((len(data), 0, 0, data.tobytes()))
                        continue
                    pairs = np.stack([np.asarray(spans.values.field(k)) for k in range(2)], axis=1).astype(np.uint32)
                    gone = covered([pairs.tobytes()], length, len(data))
                    rows.append((len(data), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]), data[~gone].tobytes()))
                cols = [part.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_bytes:
                    cols.append(pa.array([r[3] for r in rows], pa.binary()))
                    names.append("kept_bytes")
                yield pa.RecordBatch.from_arrays(cols, names)

    joined = src.join(found, ["id", "key"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
