"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (``width`` consecutive words; an item of fewer words is one window) are sets of shingles.
Shingles are ordered by their rarity in the documents. For a window to occur in a text, its prefix, which for
whole containment is its rarest shingle, must occur; so windows and documents are joined on that shingle only. A
pair must leave room for the window (length bound) at the offset of that shingle (positional bound), and is then
verified word by word. Words hit by any verified window are counted once.

Both sides are tables and meet in a shuffled or, if adaptive execution finds one small, a broadcast join; a shingle
that a third of all documents have is salted. What documents send to the join goes through a bitmap of the
windows' shingles first: at least BITS_EACH bits for each, at most MAX_BITS in all (16 MB, whatever the benchmark's
size). A fuller bitmap lets more through to the join and loses nothing. Rarity is counted over all documents.

Defined cases: null texts have no words and neither hit nor are hit; items without words have no window;
repeated document rows are judged row by row; repeated items are one item; a null item_id is not reported but
hits; empty tables give empty results (documents) or no hits (benchmark); shingles that are equally rare go by
their hash, then by their offset; long texts are read whole, in pieces of whole rows; other columns are passed on,
and where one of ``docs`` has the name of a result column the result takes its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .scratch import discard, materialize, salted_join, small_batches

WIDTH, SHINGLE = 10, 3
BITS_EACH, MIN_BITS, MAX_BITS = 64, 1 << 16, 1 << 27
_RESULTS = ("bench_words", "bench_spans", "bench_items")


def _lower_words(t: T.Texts) -> tuple[np.ndarray, T.Words, np.ndarray]:
    data = T.LOWER[t.data]
    w = T.words(t, T.NOT_ALNUM, data)
    return data, w, T.word_hashes(data, w)


def _joined(data: np.ndarray, w: T.Words, a: int, b: int) -> bytes:
    return b" ".join([data[x:y].tobytes() for x, y in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)])


def window_shingles(benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, window, n_words, offset, size, shingle``: each window (words joined by blanks) with all its shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(1)):
                data, w, h = _lower_words(t)
                rows = []
                for i in range(len(t.offsets) - 1):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    for begin in range(a, max(a + 1, b - width + 1)) if b > a else ():
                        n = min(width, b - a)
                        k = min(shingle, n)
                        text = _joined(data, w, begin, begin + n)
                        own = T.window_hashes(h[begin : begin + n], k).view(np.int64).tolist()
                        rows += [(t.rows.start + i, text, n, at, k, s) for at, s in enumerate(own)]
                if rows:
                    place, *cols = zip(*rows, strict=True)
                    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["item_id", "window", "n_words", "offset", "size", "shingle"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, window binary, n_words int, offset int, size int, shingle bigint")


def _bitmap(shingles: DataFrame) -> np.ndarray:
    """Packed flags of the cells of a ``shingle`` column's distinct values; at most MAX_BITS of them."""
    n = shingles.distinct().count()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_EACH * max(n, 1) - 1).bit_length()))
    cell = F.shiftrightunsigned("shingle", 64 - (bits - 1).bit_length())
    words = shingles.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (cell % 64).cast("int"))).alias("word"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():  # one row for each 64 bits at most
        out[r["at"]] = r["word"]
    return out


def _passing(bitmap: np.ndarray, s: np.ndarray) -> np.ndarray:
    cell = (s >> T.U64(64 - (64 * len(bitmap) - 1).bit_length())).astype(np.int64)
    return np.flatnonzero(bitmap[cell >> 6] >> (cell & 63) & 1)


def _rarity(docs: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``shingle, n``: how often shingles occur in all documents; those of ``wanted`` are all among them."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(0)):
                _, w, h = _lower_words(t)
                for k in sizes:
                    s = T.window_hashes(h, k)[T.row_windows(w, k)]
                    keys, n = np.unique(s[_passing(bitmap.value, s)], return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """A written table ``window, items, n_words, shingle, offset, size`` of each window with its rarest shingle."""
    every = materialize(window_shingles(benchmark, width, shingle), "shingles")
    sizes = [r["size"] for r in every.select("size").distinct().collect()]  # SHINGLE different ones at most
    counts = _rarity(docs, every.select("shingle"), sizes)
    rare = every.select("window", "n_words", "offset", "size", "shingle").distinct().join(counts, "shingle", "left")
    first = rare.groupBy("window", "n_words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("at"))
    items = every.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = materialize(first.join(items, "window").select("window", "items", "n_words", F.col("at.shingle").alias("shingle"), F.col("at.offset").alias("offset"), "size"), "prefixes")
    discard(every)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """``text_sha, bench_spans, bench_items`` of the different texts that have any verified window.

    ``bench_spans`` holds the first word and the end of each maximal run of hit words.
    """
    small_batches(docs.sparkSession)
    table = prefixes(docs, benchmark, width, shingle)
    sizes = [r["size"] for r in table.select("size").distinct().collect()]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(table.select("shingle")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places where a window may be: the shingle, and the words about it as far as a window can reach."""
        for batch in batches:
            for t in T.texts(batch.column(0)):
                data, w, h = _lower_words(t)
                shas: dict[int, bytes] = {}
                for k in sizes:
                    starts = T.row_windows(w, k)
                    s = T.window_hashes(h, k)[starts]
                    rows = []
                    for j in _passing(bitmap.value, s).tolist():
                        at = int(starts[j])
                        row = int(w.row[at])
                        if row not in shas:
                            shas[row] = hashlib.sha256(t.data[t.offsets[row] : t.offsets[row + 1]].tobytes()).digest()
                        a, b = max(int(w.first[row]), at + k - width), min(int(w.first[row + 1]), at + width)
                        rows.append((shas[row], int(s[j].view(np.int64)), at - int(w.first[row]), at - a, b - a, _joined(data, w, a, b)))
                    for i in range(0, len(rows), 4096):
                        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows[i : i + 4096], strict=True), kinds, strict=True)], ["text_sha", "shingle", "at", "left", "room", "around"])

    sent = materialize(docs.select("text").mapInArrow(probe, "text_sha binary, shingle bigint, at bigint, left int, room int, around binary").distinct(), "probes")
    met = salted_join(sent, table, "shingle", "text_sha").filter((F.col("offset") <= F.col("left")) & (F.col("left") - F.col("offset") + F.col("n_words") <= F.col("room")))
    around = F.split(F.decode("around", "UTF-8"), " ")
    same = F.array_join(F.slice(around, F.col("left") - F.col("offset") + 1, F.col("n_words")), " ") == F.decode("window", "UTF-8")
    found = met.filter(same).select("text_sha", (F.col("at") - F.col("offset")).alias("begin"), "n_words", "items")
    pieces = F.array_sort(F.collect_set(F.struct("begin", (F.col("begin") + F.col("n_words")).alias("end"))))
    by_text = found.groupBy("text_sha").agg(pieces.alias("pieces"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("bench_items"))
    out = materialize(by_text.select("text_sha", _runs(F.col("pieces")).alias("bench_spans"), "bench_items"), "occurrences")
    discard(table, sent)
    return out


def _runs(pieces: Column) -> Column:
    """array<bigint> of first and end of each maximal run of sorted (begin, end) pieces."""

    def add(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        longer = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.greatest(F.element_at(acc, -1), p["end"])))
        return F.when((n > 0) & (p["begin"] <= F.coalesce(F.get(acc, n - 1), F.lit(-1))), longer).otherwise(F.concat(acc, F.array(p["begin"], p["end"])))

    return F.aggregate(pieces, F.array().cast("array<bigint>"), add)


def _count_words(texts: pa.Array) -> pa.Array:
    counts = [np.diff(T.words(t, T.NOT_ALNUM, T.LOWER[t.data]).first) for t in T.texts(texts)]
    return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())


def _text_sha() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _free_name(docs: DataFrame, base: str) -> str:
    while base.lower() in {c.lower() for c in docs.columns}:
        base += "_"
    return base


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``docs`` with ``bench_words`` (bigint), ``bench_spans`` (array of first word, end) and ``bench_items``."""
    found = occurrences(docs, benchmark, width, shingle)
    key = _free_name(docs, "text_sha")
    own = docs.drop(*_RESULTS).withColumn(key, _text_sha())
    out = own.join(found.withColumnRenamed("text_sha", key), key, "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    words = F.arrow_udf(_count_words, "bigint")(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return out.select(*(F.col(f"`{c}`") for c in own.columns if c != key), words.alias("bench_words"), none("bench_spans", "bigint"), none("bench_items", "string"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with its columns alone, in whose text no window occurs."""
    found = occurrences(docs, benchmark, width, shingle)
    key = _free_name(docs, "text_sha")
    return docs.withColumn(key, _text_sha()).join(found.select(F.col("text_sha").alias(key)), key, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def report(marked: DataFrame) -> DataFrame:
    """Counts, the digest of the item ids, and whether a document is contaminated."""
    ends = F.col("bench_spans")
    hit = F.aggregate(F.sequence(F.lit(1), F.size(ends)), F.lit(0).cast("bigint"), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at(ends, i)).otherwise(-F.element_at(ends, i)))
    hit = F.when(F.size(ends) > 0, hit).otherwise(F.lit(0).cast("bigint"))
    return marked.select("doc_id", F.col("bench_words").alias("n_words"), hit.alias("n_hit"), F.size("bench_items").cast("bigint").alias("n_items"), F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"), (F.size(ends) > 0).alias("contaminated"))
