"""Fill-in-middle transformation: cuts found by a parallel scan of a finite automaton over chunks of the texts.

An automaton over bytes counts units (code points, words or lines) and looks for the markers, which a text must not
hold; it is the product of a unit automaton and of one that matches the markers. Where it stands at a chunk's start
isn't known before the chunks ahead of it are read, so a chunk is read from every state at once: it gives a transition
function, state to state, and a count of units for each state that it may start in. Such functions compose, and the
composition is associative, so chunks are read in any order and in any task, and put together afterwards: a running
composition resolves the state that each chunk is entered in and the units before it. Selection then picks the chunk
that a cut falls in, and reads only that one again to find the byte.

A document up to SPLIT bytes is one piece, whose chunks of CHUNK bytes are read side by side in the task that reads
the document; nothing of it is shuffled. A longer one is cut into pieces of SPLIT bytes that are dealt out by its digest
and number. A piece's function is the composition of its chunks' functions; composing those of a document (2**15 at
most, a few numbers each, since Spark's strings end at 2 GiB) resolves the pieces' entry states, and a join sends each
cut to its piece. Results are the same on either way. Equal long texts are scanned once.

Defined cases: a null text is empty, and an empty one is plain; a text that holds a marker is plain; a null doc_id is
hashed like an empty one; repeated rows give equal rows; where both cuts fall on one place the middle is empty; a unit
of words is a word with the blanks after it, the blanks that begin a text going to its first word; a unit of lines is
a line with its line break; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .scratch import materialize, small_batches

MARKERS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
PLAIN_FROM, SPM_BELOW = 90, 20  # per cent
CHUNK, SPLIT, HOLD = 512, 1 << 16, 1 << 19
_PAD = 256


@dataclass(frozen=True)
class Automaton:
    """``step`` and ``begins`` by symbol and state (one row for each byte, and one for padding); state 0 is first."""

    states: int
    step: np.ndarray
    begins: np.ndarray  # 1 where a unit begins with the byte
    marked: np.ndarray  # by state: a marker was seen


def _units(unit: str) -> tuple[int, np.ndarray, np.ndarray]:
    """States, steps and begins of the automaton that counts units."""
    byte = np.arange(256)
    if unit == "char":
        return 1, np.zeros((256, 1), np.int64), ((byte & 0xC0) != 0x80).astype(np.int64)[:, None]
    if unit == "line":  # 0: the next byte begins a line, 1: within one
        return 2, np.repeat((byte != 0x0A).astype(np.int64)[:, None], 2, axis=1), np.tile([1, 0], (256, 1))
    if unit == "word":  # 0: at the start, 1: in a word, 2: in blanks after a word, 3: in blanks that begin the text
        blank = T.SPACE[:, None]
        return 4, np.where(blank, [3, 2, 2, 3], 1), np.where(blank, [1, 0, 0, 0], [1, 0, 1, 0])
    raise ValueError(f"unit {unit!r} is none of char, word, line")


def _markers(markers: tuple[str, ...]) -> tuple[np.ndarray, int]:
    """Steps of the automaton that looks for any marker (its states are beginnings of markers), and its last state."""
    words = [m.encode() for m in markers]
    begins = sorted({w[:k] for w in words for k in range(len(w))}, key=len)
    at, last = {b: i for i, b in enumerate(begins)}, len(begins)
    step = np.full((256, last + 1), last)
    for b, i in at.items():
        for c in range(256):
            seen = b + bytes([c])
            step[c, i] = last if any(seen.endswith(w) for w in words) else at[next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in at)]
    return step, last


def automaton(unit: str = "char", markers: tuple[str, ...] = MARKERS) -> Automaton:
    n, step, begins = _units(unit)
    look, last = _markers(markers)
    both = (look[:, :, None] * n + step[:, None, :]).reshape(256, -1)
    states = both.shape[1]
    pad = np.arange(states)[None, :]
    counts = np.tile(begins, (1, last + 1))
    return Automaton(states, np.concatenate([both, pad]).ravel(), np.concatenate([counts, np.zeros_like(pad)]).ravel(), np.arange(states) // n == last)


@dataclass
class Scan:
    """Transition functions and counts of the chunks of some texts, and the chunks' places."""

    first: np.ndarray  # by text: its first chunk
    chunks: np.ndarray  # by text: how many
    symbols: np.ndarray  # bytes x chunks, as offsets into the automaton's tables
    end: np.ndarray  # chunks x states
    count: np.ndarray


def scan(a: Automaton, data: np.ndarray, offsets: np.ndarray) -> Scan:
    """Read every chunk of every text from all states at once."""
    sizes = np.diff(offsets)
    chunks = -(-sizes // CHUNK)
    first = np.concatenate([[0], np.cumsum(chunks)])[:-1]
    text = np.repeat(np.arange(len(sizes)), chunks)
    start = offsets[text] + (np.arange(len(text)) - first[text]) * CHUNK
    at = start[None, :] + np.arange(CHUNK)[:, None]
    held = np.concatenate([data, np.zeros(1, data.dtype)])[np.minimum(at, len(data))].astype(np.int32)
    held[at >= offsets[text + 1][None, :]] = _PAD
    symbols = held * a.states
    state = np.tile(np.arange(a.states, dtype=np.int32), (len(text), 1))
    count = np.zeros_like(state)
    step, begins = a.step.astype(np.int32), a.begins.astype(np.int32)
    for column in symbols:
        where = column[:, None] + state
        count += begins.take(where)
        state = step.take(where)
    return Scan(first, chunks, symbols, state, count.astype(np.int64))


def compose(s: Scan, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From ``start`` (texts x starts): the texts' last states and units, and each chunk's entry states and units before."""
    state, total = start.astype(np.int64), np.zeros(start.shape, np.int64)
    entry = np.zeros((len(s.end), start.shape[1]), np.int64)
    before = np.zeros_like(entry)
    for k in range(int(s.chunks.max(initial=0))):
        texts = np.flatnonzero(s.chunks > k)
        at, now = s.first[texts] + k, state[texts]
        entry[at], before[at] = now, total[texts]
        total[texts] += np.take_along_axis(s.count[at], now, axis=1)
        state[texts] = np.take_along_axis(s.end[at], now, axis=1)
    return state, total, entry, before


def select(a: Automaton, s: Scan, entry: np.ndarray, before: np.ndarray, total: np.ndarray, sizes: np.ndarray, text: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Bytes before unit number ``unit`` (from 0) of the texts ``text``; a unit past the last is at the text's end."""
    out = sizes[text].copy()
    inside = np.flatnonzero(unit < total[text])
    if not len(inside):
        return out
    t, u = text[inside], unit[inside]
    # chunks ascend by text, and by units before within a text: one search over both finds each cut's chunk
    owner = np.repeat(np.arange(len(s.chunks)), s.chunks)
    span = int(total.max()) + 1
    reached = before + np.take_along_axis(s.count, entry[:, None], axis=1)[:, 0]
    at = np.searchsorted(owner * span + reached, t * span + u, "right")
    state, left = entry[at], u - before[at]
    place = np.full(len(at), -1)
    for k, column in enumerate(s.symbols[:, at]):
        where = column + state
        begun = a.begins.take(where)
        place[(left == 0) & (begun == 1) & (place < 0)] = k
        left = left - begun
        state = a.step.take(where)
    out[inside] = (at - s.first[t]) * CHUNK + place
    return out


def cuts(seed: str, n: int) -> tuple[int, int]:
    """Units before the middle and before the suffix, from a hexadecimal digest."""
    x, y = int(seed[:8], 16) % (n + 1), int(seed[8:16], 16) % (n + 1)
    return min(x, y), max(x, y)


def form(seed: str, n: int, marked: bool) -> str:
    if not n or marked or int(seed[16:24], 16) % 100 >= PLAIN_FROM:
        return "plain"
    return "spm" if int(seed[24:32], 16) % 100 < SPM_BELOW else "psm"


def arrange(text: bytes, kind: str, a: int, b: int, markers: tuple[str, ...] = MARKERS) -> bytes:
    p, s, m = (x.encode() for x in markers)
    if kind == "plain":
        return text
    prefix, suffix = p + text[:a], s + text[b:]
    return (suffix + prefix if kind == "spm" else prefix + suffix) + m + text[a:b]


def restore(output: bytes, kind: str, markers: tuple[str, ...] = MARKERS) -> bytes:
    """The text that was arranged, from the output and its form alone."""
    p, s, m = (x.encode() for x in markers)
    if kind == "plain":
        return output
    one, two = (s, p) if kind == "spm" else (p, s)
    at, end = output.index(two, len(one)), output.rindex(m)
    x, y, middle = output[len(one) : at], output[at + len(two) : end], output[end + len(m) :]
    return y + middle + x if kind == "spm" else x + middle + y


def _columns(id_type: str, with_output: bool) -> str:
    return f"doc_id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output string" * with_output


def _results(ids: pa.Array, rows: list[tuple], with_output: bool, schema: pa.Schema) -> pa.RecordBatch:
    """``rows`` are n, form, the units before and up to the cuts, and the output; one for each id."""
    done = []
    for n, kind, c, d, output in rows:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        cut = kind != "plain"
        done.append((n, kind, c if cut else None, d - c if cut else None, sha(output), sha(restore(output, kind)), output.decode() if with_output else None))
    parts = list(zip(*done, strict=True)) or [()] * 7
    arrays = [ids, *(pa.array(list(parts[i]), schema.field(i + 1).type) for i in range(6 + with_output))]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _schema(ids: pa.Array, with_output: bool) -> pa.Schema:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_output
    names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"] + ["output"] * with_output
    return pa.schema([("doc_id", ids.type), *zip(names, kinds, strict=True)])


def _whole(docs: DataFrame, a: Automaton, with_output: bool) -> DataFrame:
    """Documents of one piece, each by the task that reads it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(2), HOLD):
                ids, seeds = batch.column(0).slice(t.rows.start, len(t.offsets) - 1), batch.column(1).slice(t.rows.start, len(t.offsets) - 1).to_pylist()
                s, count = scan(a, t.data, t.offsets), len(t.offsets) - 1
                state, total, entry, before = (x[:, 0] for x in compose(s, np.zeros((count, 1), np.int64)))
                marked = a.marked[state]
                kinds = [form(x, n, m) for x, n, m in zip(seeds, total.tolist(), marked.tolist(), strict=True)]
                units = np.array([cuts(x, n) for x, n in zip(seeds, total.tolist(), strict=True)], np.int64).reshape(-1, 2)
                cut = np.flatnonzero(np.array(kinds) != "plain")
                place = np.zeros((count, 2), np.int64)
                for side in range(2):
                    place[cut, side] = select(a, s, entry, before, total, np.diff(t.offsets), cut, units[cut, side])
                text, at = t.data.tobytes(), t.offsets.tolist()
                rows = [(n, k, *u, arrange(text[at[i] : at[i + 1]], k, *p)) for i, (n, k, u, p) in enumerate(zip(total.tolist(), kinds, units.tolist(), place.tolist(), strict=True))]
                yield _results(ids, rows, with_output, _schema(ids, with_output))

    return docs.select("doc_id", "seed", "text").mapInArrow(run, _columns(docs.schema["doc_id"].dataType.simpleString(), with_output))


def _pieces(long_docs: DataFrame) -> DataFrame:
    """``key, no, piece``: the different texts, SPLIT bytes at a time, dealt out by key and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = memoryview(text.as_buffer())
                for no in range(-(-len(held) // SPLIT)):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([no], pa.int32()), pa.array([bytes(held[no * SPLIT : (no + 1) * SPLIT])], pa.binary())], ["key", "no", "piece"])

    cut = long_docs.select("key", F.col("text").cast("binary").alias("text")).mapInArrow(run, "key binary, no int, piece binary")
    return cut.groupBy("key", "no").agg(F.first("piece").alias("piece"))


def _functions(pieces: DataFrame, a: Automaton) -> DataFrame:
    """``pieces`` with their transition function and counts, by state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, counts = [], []
            for piece in batch.column(2).to_pylist():
                s = scan(a, np.frombuffer(piece, np.uint8), np.array([0, len(piece)]))
                state, total, _, _ = compose(s, np.arange(a.states)[None, :])
                ends.append(state[0].tolist())
                counts.append(total[0].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], ["key", "no", "piece", "ends", "counts"])

    return pieces.mapInArrow(run, "key binary, no int, piece binary, ends array<bigint>, counts array<bigint>")


def _entries(functions: DataFrame, a: Automaton) -> DataFrame:
    """``key, no, entry, before, upto, n, marked``: the running composition of each text's functions."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("no")
        ends, counts = table["ends"].to_pylist(), table["counts"].to_pylist()
        entry, before, state, total = [], [0], 0, 0
        for e, c in zip(ends, counts, strict=True):
            entry.append(state)
            total, state = total + c[state], e[state]
            before.append(total)
        k = len(entry)
        return pa.table({"key": table["key"], "no": table["no"], "entry": pa.array(entry, pa.int64()), "before": pa.array(before[:-1], pa.int64()), "upto": pa.array(before[1:], pa.int64()), "n": pa.array([total] * k, pa.int64()), "marked": pa.array([bool(a.marked[state])] * k)})

    return functions.select("key", "no", "ends", "counts").groupBy("key").applyInArrow(run, "key binary, no int, entry bigint, before bigint, upto bigint, n bigint, marked boolean")


def _places(wanted: DataFrame, a: Automaton) -> DataFrame:
    """``doc_id, key, side, place``: the byte that each cut falls on, from the piece that it falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for no, unit, entry, piece in zip(*(batch.column(c).to_pylist() for c in range(3, 7)), strict=True):
                s, sizes = scan(a, np.frombuffer(piece, np.uint8), np.array([0, len(piece)])), np.array([len(piece)])
                _, total, at, before = (x[:, 0] for x in compose(s, np.array([[entry]])))
                found.append(no * SPLIT + int(select(a, s, at, before, total, sizes, np.zeros(1, np.int64), np.array([unit]))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], ["doc_id", "key", "side", "place"])

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.select("doc_id", "key", "side", "no", "unit", "entry", "piece").mapInArrow(run, f"doc_id {kind}, key binary, side int, place bigint")


def _split(docs: DataFrame, a: Automaton, with_output: bool) -> DataFrame:
    """Documents of several pieces."""
    marked = docs.withColumn("key", F.unhex(F.sha2("text", 256)))
    functions = materialize(_functions(_pieces(marked), a), "fim-pieces")
    entries = materialize(_entries(functions, a), "fim-entries")
    hashed = lambda i: F.conv(F.substring("seed", 8 * i + 1, 8), 16, 10).cast("bigint")
    whole = entries.filter("no = 0").select("key", "n", "marked")
    rows = marked.select("doc_id", "seed", "key").distinct().join(whole, "key")
    kind = F.when(F.col("marked") | (hashed(2) % 100 >= PLAIN_FROM), "plain").when(hashed(3) % 100 < SPM_BELOW, "spm").otherwise("psm")
    x, y = hashed(0) % (F.col("n") + 1), hashed(1) % (F.col("n") + 1)
    decided = rows.select("doc_id", "key", "n", kind.alias("form"), F.least(x, y).alias("c"), F.greatest(x, y).alias("d"))
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("at")) for i, c in enumerate("cd")))
    asked = decided.filter("form <> 'plain'").select("doc_id", "key", "n", F.explode(sides).alias("s")).select("doc_id", "key", "n", "s.side", "s.at")
    # the end of the text is not in any piece: its last one takes it
    sent = asked.join(entries.drop("n", "marked"), "key").filter("at >= before and (at < upto or at = n and upto = n)").withColumn("unit", F.col("at") - F.col("before"))
    found = _places(sent.join(functions.select("key", "no", "piece"), ["key", "no"]), a)
    place = found.groupBy("doc_id", "key").agg(*(F.max(F.when(F.col("side") == i, F.col("place"))).alias(f"p{i}") for i in range(2)))
    same = lambda l, r: l["doc_id"].eqNullSafe(r["doc_id"]) & (l["key"] == r["key"])
    cut = decided.join(place, same(decided, place), "left").select(decided["*"], "p0", "p1").withColumnsRenamed({"doc_id": "id_", "key": "key_"})
    full = marked.join(cut, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, k, c, d, arrange(x.encode(), k, p or 0, q or 0)) for x, n, k, c, d, p, q in zip(*(v.to_pylist() for v in batch.columns[1:]), strict=True)]
            yield _results(batch.column(0), rows, with_output, _schema(batch.column(0), with_output))

    return full.select("doc_id", "text", "n", "form", "c", "d", "p0", "p1").mapInArrow(run, _columns(docs.schema["doc_id"].dataType.simpleString(), with_output))


def transform(docs: DataFrame, unit: str = "char", with_output: bool = True) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` and ``output`` of every row.

    ``n`` and the lengths of prefix and middle count units; ``restored_sha256`` is that of the text rebuilt from the
    output and its form.
    """
    small_batches(docs.sparkSession, 500)
    a = automaton(unit)
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", seed.alias("seed"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long: Column = F.octet_length("text") > SPLIT
    return _whole(rows.filter(~long), a, with_output).unionByName(_split(rows.filter(long), a, with_output))
