"""Substring dedup: repeated word windows, found through a count-min prefilter.

First pass: each partition counts, once per document, the anchors of its windows in a count-min sketch; the
sketches are merged by cell ranges. An anchor is the least hash among the five-word runs in a window, so equal
windows have equal anchors and an anchor's count is never less than that of any of its windows. Counters stop
at two, which is all that is asked.

Second pass: only windows whose anchor is estimated to be in two documents go on. Within a part of the input the
least document of each window is found at once and only that goes through the shuffle (so a passage that
very many documents share costs one record per part); windows are grouped exactly by 96-bit hashes in the
shard of their anchor. A window is a repeat if a smaller document has it too. There are as many shards as keep each
at some SHARD_BYTES of text, each is a task of its own, and a part of the input writes only to those that it has
windows for.

The sketch has up to MAX_CELLS cells (a bitmap of 32 MB once merged), a fixed bound. Beyond the input for which
that suffices it lets more windows through to the exact pass, which stays linear in the input; none is lost.

Defined cases: null and empty texts have no words; texts under one window's length are kept whole; rows that
repeat an id and text are alike and do not remove each other; a null id neither removes nor is removed from;
empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .scratch import materialize, small_batches

WINDOW, ANCHOR = 13, 5
MAX_CELLS, DEPTH = 1 << 28, 2
RANGE_BITS = 20  # cells of one range of the sketch
FLUSH = 1_500_000  # windows held by a task before their least documents are sent on
SHARD_BYTES = 48 << 20  # of text to one shard of the exact pass; a document is told of by each shard once


def _anchored(t: T.Texts, window: int) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, word hashes, five-word hashes, the starts of all windows and each one's anchor."""
    w = T.words(t, T.SPACE)
    h = T.word_hashes(t.data, w)
    k = min(ANCHOR, window)
    grams = T.window_hashes(h, k)
    starts = T.row_windows(w, window)
    anchors = T.sliding_argmin(grams, window - k + 1)[starts] if len(starts) else starts
    return w, h, grams, starts, anchors


def _cells(gram: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The sketch's cells for hashes; each of the DEPTH rows has half as many."""
    return (T.mix(gram ^ T.U64(0x5851F42D4C957F2D * (row + 1) & 0xFFFFFFFFFFFFFFFF)) >> T.U64(64 - bits + 1)).astype(np.int64) + (row << (bits - 1))


def sketch(docs: DataFrame, window: int, bits: int) -> np.ndarray:
    """Packed bits of the cells that count to two or more."""
    size = 1 << min(RANGE_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: list[np.ndarray] = []
        held = 0

        def out():
            cells, n = np.unique(np.concatenate(once), return_counts=True)
            part = cells // size
            first = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(first[1:], len(cells))
            local = (cells % size).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array(part[first]), pa.array([local[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([local[a:b][n[a:b] > 1].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())],
                ["part", "seen", "again"],
            )

        for batch in batches:
            for t in T.texts(batch.column(0)):
                w, _, grams, _, anchors = _anchored(t, window)
                at = np.unique(anchors)
                if not len(at):
                    continue
                g, row = grams[at], w.row[at]
                order = np.lexsort((g, row))
                g, row = g[order], row[order]
                fresh = np.ones(len(g), bool)
                fresh[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])  # once per document
                g = g[fresh]
                once.extend(_cells(g, d, bits) for d in range(DEPTH))
                held += DEPTH * len(g)
                if held > 4 * FLUSH:
                    yield out()
                    once, held = [], 0
        if once:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, seen, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = ranges.setdefault(part, (np.zeros(size, bool), np.zeros(size, bool)))
                cells = np.frombuffer(seen, np.uint32)
                two[cells] |= one[cells]
                one[cells] = True
                two[np.frombuffer(again, np.uint32)] = True
        for part, (_, two) in ranges.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(two).tobytes()], pa.binary())], ["part", "bits"])

    counted = docs.select("text").mapInArrow(count, "part bigint, seen binary, again binary")
    merged = counted.repartition("part").mapInArrow(merge, "part bigint, bits binary")
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in merged.toLocalIterator():
        whole[r["part"] * size // 8 : (r["part"] + 1) * size // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole


def _shards(docs: DataFrame, size: int) -> int:
    """As many shards as the text asks for, and as there are cores."""
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0


def _pack(kind: np.dtype, **cols: np.ndarray) -> np.ndarray:
    out = np.empty(len(next(iter(cols.values()))), kind)
    for k, v in cols.items():
        out[k] = v
    return out


_SENT = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<u4"), ("at", "<u4")])
_KNOWN = np.dtype([("doc", "<u4"), ("at", "<u4"), ("n", "<u4")])
_DOC = np.dtype([("id", "<i8"), ("key", "<i8")])


def repeats(docs: DataFrame, window: int = WINDOW, max_cells: int = MAX_CELLS) -> DataFrame:
    """``doc_id, key, spans``: for documents with repeats, the windows to remove as (first start, number) pairs.

    ``key`` is the xxhash64 of the text. ``spans`` is a list of binaries of unsigned 32-bit numbers.
    """
    small_batches(docs.sparkSession)
    src = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    size = _text_bytes(src)
    bits = min((max_cells - 1).bit_length(), max(16, (4 * DEPTH * size // 30 + 1).bit_length()))
    shards = _shards(src, size)
    filled = docs.sparkSession.sparkContext.broadcast(sketch(src, window, bits))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        names: list[np.ndarray] = []
        n_held = n_docs = 0

        def out():
            h, g, shard, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            name = np.concatenate(names)
            order = np.lexsort((at, name["id"][doc], g, h))
            h, g, shard, doc, at = h[order], g[order], shard[order], doc[order], at[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
            least = name["id"][doc[np.flatnonzero(new)]][np.cumsum(new) - 1]
            later = name["id"][doc] > least
            ship = np.flatnonzero(~later)
            ship = ship[np.argsort(shard[ship], kind="stable")]
            sent = _pack(_SENT, h=h[ship], g=g[ship], doc=doc[ship], at=at[ship])
            where = np.flatnonzero(later)
            where = where[np.lexsort((at[where], doc[where]))]
            first, n = T.ranges(doc[where].astype(np.int64) * (1 << 33) + at[where])
            known = _pack(_KNOWN, doc=first >> 33, at=first & 0xFFFFFFFF, n=n)
            home = known["doc"] % shards  # what is known already is dealt out by document
            known, home = known[np.argsort(home, kind="stable")], np.sort(home)
            rows = []
            to = shard[ship]
            for p in np.union1d(to, home).tolist():  # the shards that get anything
                mine = sent[np.searchsorted(to, p) : np.searchsorted(to, p, "right")].copy()
                own = known[np.searchsorted(home, p) : np.searchsorted(home, p, "right")].copy()
                used = np.unique(np.concatenate([mine["doc"], own["doc"]]))
                mine["doc"], own["doc"] = np.searchsorted(used, mine["doc"]), np.searchsorted(used, own["doc"])
                rows.append((p, name[used].tobytes(), mine.tobytes(), own.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["shard", "docs", "sent", "known"])

        twice = filled.value
        for batch in batches:
            for t in T.texts(batch.column(2)):
                w, hashes, grams, starts, anchors = _anchored(t, window)
                ids = _pack(_DOC, id=np.asarray(batch.column(0).slice(t.rows.start, len(t.offsets) - 1)), key=np.asarray(batch.column(1).slice(t.rows.start, len(t.offsets) - 1)))
                if len(starts):
                    at = np.unique(anchors)
                    hot = np.ones(len(at), bool)
                    for d in range(DEPTH):
                        c = _cells(grams[at], d, bits)
                        hot &= (twice[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                    mark = np.zeros(len(grams), bool)
                    mark[at[hot]] = True
                    pick = mark[anchors]
                    s, a = starts[pick], anchors[pick]
                    if len(s):
                        row = w.row[s]
                        other = T.word_hashes(t.data, w, 1)
                        held.append((T.window_hashes(hashes, window)[s], (T.window_hashes(other, window, 1)[s] >> T.U64(32)).astype(np.uint32), (grams[a] % T.U64(shards)).astype(np.int64), row + n_docs, s - w.first[row]))
                        names.append(ids)
                        n_docs, n_held = n_docs + len(ids), n_held + len(s)
                if n_held > FLUSH:
                    yield out()
                    held, names, n_held, n_docs = [], [], 0, 0
        if held:
            yield out()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, known, names, n_docs = [], [], [], 0
        for batch in batches:
            for d, s, k in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                names.append(np.frombuffer(d, _DOC))
                for raw, kind, to in ((s, _SENT, sent), (k, _KNOWN, known)):
                    part = np.frombuffer(raw, kind).copy()
                    part["doc"] += n_docs
                    to.append(part)
                n_docs += len(names[-1])
        if not names:
            return
        x, y, name = np.concatenate(sent), np.concatenate(known), np.concatenate(names)
        del sent, known, names
        order = np.lexsort((name["id"][x["doc"]], x["g"], x["h"]))
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x["h"][1:] != x["h"][:-1]) | (x["g"][1:] != x["g"][:-1])
        if len(x):
            least = name["id"][x["doc"][np.flatnonzero(new)]][np.cumsum(new) - 1]
            x = x[name["id"][x["doc"]] > least]
        x = x[np.lexsort((x["at"], x["doc"]))]
        first, n = T.ranges(x["doc"].astype(np.int64) * (1 << 33) + x["at"])
        y = np.concatenate([y, _pack(_KNOWN, doc=first >> 33, at=first & 0xFFFFFFFF, n=n)])
        y = y[np.argsort(y["doc"], kind="stable")]
        docs_, at = np.unique(y["doc"], return_index=True)
        spans = np.stack([y["at"], y["n"]], axis=1).astype(np.uint32)
        cuts = np.append(at, len(y))
        for k in range(0, len(docs_), 4096):
            own = range(k, min(len(docs_), k + 4096))
            yield pa.RecordBatch.from_arrays([pa.array(name["id"][docs_[k : k + 4096]]), pa.array(name["key"][docs_[k : k + 4096]]), pa.array([spans[cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary())], ["doc_id", "key", "span"])

    sent = src.mapInArrow(candidates, "shard int, docs binary, sent binary, known binary")
    grouped = sent.repartitionById(shards, F.col("shard")).mapInArrow(group, "doc_id bigint, key bigint, span binary")
    return grouped.groupBy("doc_id", "key").agg(F.collect_list("span").alias("spans"))


def covered(spans: list[bytes] | None, width: int, size: int) -> np.ndarray:
    """Flags of the items in the windows of ``width`` that the spans list, of a text of ``size`` items."""
    edge = np.zeros(size + 1, np.int32)
    for raw in spans or ():
        s = np.frombuffer(raw, np.uint32).reshape(-1, 2).astype(np.int64)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, s[:, 0] + s[:, 1] - 1 + width, -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and the kept text (words joined by blanks) for every row."""
    found = materialize(repeats(docs, window), "windows")
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(1)):
                w = T.words(t, T.SPACE)
                rows = range(len(t.offsets) - 1)
                kept, removed = [], []
                for i in rows:
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    gone = covered(batch.column(2)[t.rows.start + i].as_py(), window, b - a)
                    stay = a + np.flatnonzero(~gone)
                    removed.append(b - a - len(stay))
                    kept.append(b" ".join([t.data[x:y].tobytes() for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]))
                cols = [batch.column(0).slice(t.rows.start, len(rows)), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    joined = src.join(found, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)
