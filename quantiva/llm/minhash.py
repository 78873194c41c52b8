"""MinHash near-duplicates with odd sketches.

Each text becomes its set of word shingles (64-bit hashes) and MINHASHES minima. Bands of the minima give
candidate buckets. The minima are also folded into an odd sketch, a bitmap of parities: the number of ones in
the XOR of two sketches estimates a high similarity closely, so most candidates are refused without a look at
their sets. Within buckets, counts of the set's hashes by parts of their range give an upper bound of what two sets
share, which refuses most of the rest and no link. What is left is confirmed on the full sets.

Texts of equal sets are one class from the start, represented by the least id. The pivot of a bucket is the member
whose buckets are largest, of near copies usually the original. Each member is first compared with the pivot of
most weight that it meets in any bucket, and confirmed links are joined to components. Only buckets that still hold several components are looked at again:
members outside the bucket's largest component are compared sketch by sketch with it and with each other, in
blocks of bounded size. The likeliest pairs are confirmed first and then all others that still matter, so no link
is lost by the pivots.

The rows of a band are as many as keep the odds that a pair exactly at the threshold shares no band under MISS;
the most ones that a sketch may show keep the odds that it refuses such a pair under MISS / 10. More similar pairs
are missed less often by orders of magnitude.

Defined cases: null texts and texts without words have empty sets and are linked with nothing; a row with a null
id is linked with nothing, has a null component and is kept; rows that repeat an id and text are one document for
linking; rows that repeat an id with other texts are linked by any of them; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .components import components
from .scratch import discard, materialize, salted_join, small_batches

MINHASHES, SKETCH_BITS = 256, 1024
PARITY = SKETCH_BITS // 64  # words of a sketch; after them come the counts of COUNTS parts of the set, a byte each
COUNTS, FULL = 128, 255
MISS = 1e-5
FIRST = 4  # of a member's likely partners in another component, those confirmed before all others
BLOCK = 1024  # members of a bucket compared at once
BROADCAST_IDS = 500_000  # ids (some 4 MB) that are broadcast at most

_rng = np.random.default_rng(7_310_433)
_MUL = _rng.integers(1 << 62, 1 << 63, MINHASHES, dtype=T.U64) * T.U64(2) + T.U64(1)
_XOR = _rng.integers(0, 1 << 63, MINHASHES, dtype=T.U64)


@cache
def band_rows(percent: int) -> int:
    """The most minima in a band with which a pair at the threshold is missed with a probability of MISS at most."""
    fits = [r for r in range(1, MINHASHES + 1) if (1 - (percent / 100) ** r) ** (MINHASHES // r) <= MISS]
    return max(fits, default=1)


@cache
def sketch_losses(percent: int) -> np.ndarray:
    """By the number of ones: the odds that the XOR of the sketches of a pair at the threshold has more than that.

    Exact: each of the minima that differ turns two random bits of the XOR over.
    """
    ones, share = np.arange(SKETCH_BITS + 1), 1 - percent / 100
    at, total = np.eye(1, SKETCH_BITS + 1)[0], np.zeros(SKETCH_BITS + 1)
    for differ in range(MINHASHES + 1):
        total += comb(MINHASHES, differ) * share**differ * (1 - share) ** (MINHASHES - differ) * at
        for _ in range(2):
            at = np.concatenate([[0], at[:-1] * (SKETCH_BITS - ones[:-1]) / SKETCH_BITS]) + np.concatenate([at[1:] * ones[1:] / SKETCH_BITS, [0]])
    return np.cumsum(total[::-1])[::-1] - total


@cache
def most_ones(percent: int) -> int:
    """The ones in the XOR of two sketches up to which a pair is a candidate."""
    return int(np.argmax(sketch_losses(percent) <= MISS / 10))


def shingle_sets(t: T.Texts, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text of fewer words is one shingle."""
    data = T.LOWER[t.data]
    w = T.words(t, T.SPACE, data)
    h = T.word_hashes(data, w)
    s = T.window_hashes(h, width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        else:
            out.append(T.window_hashes(h[a:b], b - a) if b > a else np.zeros(0, T.U64))
    return out


def signatures(sets: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x bands of ``rows`` minima) and odd sketches (sets x words of 64 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((MINHASHES, len(sets)), T.U64)
    bands = MINHASHES // rows
    with np.errstate(over="ignore"):
        for p in range(MINHASHES):
            least[p] = np.minimum.reduceat((flat ^ _XOR[p]) * _MUL[p], first)
        mixed = T.mix(least + _XOR[:, None])
        keys = np.zeros((bands, len(sets)), T.U64)
        for i in range(rows):
            keys = T.mix(keys * T.U64(0x9E3779B97F4A7C15) + mixed[i : rows * bands : rows])
        keys = T.mix(keys ^ np.arange(1, bands + 1, dtype=T.U64)[:, None])
    bits = np.zeros((len(sets), SKETCH_BITS), np.uint8)
    place = (mixed >> T.U64(64 - (SKETCH_BITS - 1).bit_length())).astype(np.int64)
    for p in range(MINHASHES):
        bits[np.arange(len(sets)), place[p]] ^= 1
    return keys.T, np.packbits(bits, axis=1).view(np.int64).reshape(len(sets), -1)


def part_counts(elements: np.ndarray) -> np.ndarray:
    """Of a set the numbers of its hashes in COUNTS equal parts of their range, eight to a word; FULL if any is that or more.

    The sum of the lesser counts of two sets is never below the size of their intersection.
    """
    n = np.bincount((elements >> T.U64(64 - (COUNTS - 1).bit_length())).astype(np.int64), minlength=COUNTS)
    return (np.full(COUNTS, FULL) if n.max(initial=0) >= FULL else n).astype(np.uint8).view(np.int64)


def _lists(rows: int, full: list[int], values: list[np.ndarray]) -> pa.Array:
    """A list column of ``rows`` rows: the values at the places ``full``, null elsewhere."""
    sizes, null = np.zeros(rows, np.int64), np.ones(rows + 1, bool)
    sizes[full], null[full], null[rows] = [len(v) for v in values], False, False
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=null)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def features(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands, sketch``; the last three null for empty sets."""
    rows = band_rows(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(1)):
                sets = shingle_sets(t, width)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests: list = [None] * len(sets)
                for i in full:
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                keys, odd = signatures([sets[i] for i in full], rows) if full else ((), ())
                odd = [np.concatenate([o, part_counts(sets[i])]) for o, i in zip(odd, full, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(t.rows.start, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), _lists(len(sets), full, list(keys)), _lists(len(sets), full, list(odd))],
                    ["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, ids: DataFrame, several: DataFrame, width: int) -> DataFrame:
    """A written table ``id, elements`` (shingle hashes) of the documents with the given ids; a row for each of an id's texts.

    Only texts whose id is in ``several`` rows are told apart from each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in T.texts(batch.column(1)):
                sets = shingle_sets(t, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.rows.start, len(sets)), _lists(len(sets), list(range(len(sets))), sets)], ["id", "elements"])

    named = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    asked = materialize(ids.join(several.withColumn("several", F.lit(True)), "id", "left"), "asked")
    among = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked  # beyond that texts are shuffled by id
    wanted = named.join(among, "id")
    wanted = wanted.filter("several is null").unionByName(wanted.filter("several").distinct()).select("id", "text")
    sets = materialize(wanted.mapInArrow(run, "id bigint, elements array<bigint>"), "sets")
    discard(asked)
    return sets


def _sized(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of written ``u, v`` pairs those that sizes and sketches allow."""
    side = lambda n: reps.select(F.col("id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    both = salted_join(salted_join(pairs, side("u"), "u", "v"), side("v"), "v", "u").filter(_sized(F.col("n_u"), F.col("n_v"), percent))
    ones = sum((F.bit_count(F.get("s_u", i).bitwiseXOR(F.get("s_v", i))) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.get("s_u", 0).bitwiseXOR(F.get("s_v", 0))))
    return both.filter(ones <= most_ones(percent)).select("u", "v").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of written ``u, v`` pairs a written table of those whose full sets reach the threshold.

    Sets are met row by row in the JVM, so long texts take no more memory than two of them.
    """
    left = sets.select(F.col("id").alias("u"), F.col("elements").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("elements").alias("b"))
    joined = salted_join(salted_join(pairs, left, "u", "v"), right, "v", "u")
    met = joined.select("u", "v", (F.size("a") + F.size("b")).alias("n"), F.size(F.array_intersect("a", "b")).alias("both"))
    return materialize(met.filter((F.col("both") > 0) & (100 * F.col("both") >= percent * (F.col("n") - F.col("both")))).select("u", "v").distinct(), "links")


def _rank(of: np.ndarray, group: np.ndarray, like: np.ndarray) -> np.ndarray:
    """The place of each pair, by likelihood, among those with the same ``of`` and ``group``."""
    by = np.lexsort((-like, group, of))
    new = np.ones(len(by), bool)
    new[1:] = (of[by][1:] != of[by][:-1]) | (group[by][1:] != group[by][:-1])
    head = np.flatnonzero(new)
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
    return out


def _units(rows: DataFrame) -> DataFrame:
    """Units of work of ``key, id, component, n_shingles, sketch``: blocks of a bucket's members to be compared.

    A bucket's largest component is side 0, its other members are side 1. Blocks of side 1 meet those of side 0 and
    each other; side 0 needs no comparison with itself. A row is copied once for each block that it meets.
    """
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m"))
    sizes = sizes.select("key", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("g0"), F.ceil((F.col("m") - F.col("top.n")) / BLOCK).cast("int").alias("g1"))
    cut = rows.join(sizes, "key").withColumn("side", F.when(F.col("component") == F.col("main"), 0).otherwise(1))
    cut = cut.withColumn("i", F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("g0")).otherwise(F.col("g1"))).cast("int"))
    unit = lambda two, lo, hi: F.struct(two.alias("two"), lo.alias("lo"), hi.alias("hi"))
    yes, no = F.lit(True), F.lit(False)
    with_other = F.transform(F.sequence(F.lit(0), F.col("g1") - 1), lambda j: unit(yes, F.col("i"), j))
    with_main = F.transform(F.sequence(F.lit(0), F.col("g0") - 1), lambda j: unit(yes, j, F.col("i")))
    within = F.transform(F.sequence(F.lit(0), F.col("g1") - 1), lambda j: unit(no, F.least(F.col("i"), j), F.greatest(F.col("i"), j)))
    met = cut.withColumn("unit", F.explode(F.when(F.col("side") == 0, with_other).otherwise(F.concat(with_main, within))))
    # which of a unit's two blocks a row belongs to
    block = F.when(F.col("unit.two"), F.col("side")).otherwise(F.when(F.col("i") == F.col("unit.lo"), 0).otherwise(1))
    return met.select("key", F.col("unit.two").alias("two"), F.col("unit.lo").alias("lo"), F.col("unit.hi").alias("hi"), block.cast("int").alias("block"), "id", "component", "n_shingles", "sketch")


def _compare(ids: np.ndarray, comp: np.ndarray, size: np.ndarray, block: np.ndarray, odd: np.ndarray, percent: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """A unit's pairs of different components (and, with two blocks, of different blocks) that pass."""
    us, vs, ones = [], [], []
    two, limit = block.max() != block.min(), most_ones(percent)
    counts = np.ascontiguousarray(odd[:, PARITY:]).view(np.uint8)
    untold = counts[:, 0] == FULL  # sets whose counts say nothing
    for a in range(len(ids)):
        far = comp != comp[a]
        far[: a + 1] = False
        if two:
            far &= block != block[a]
        far &= 100 * np.minimum(size, size[a]) >= percent * np.maximum(size, size[a])
        b = np.flatnonzero(far)
        if len(b):
            n = np.bitwise_count(odd[b, :PARITY] ^ odd[a, :PARITY]).sum(axis=1).astype(np.int64)
            b, n = b[n <= limit], n[n <= limit]
            most_shared = np.minimum(counts[b], counts[a]).sum(axis=1, dtype=np.int64)
            able = untold[a] | untold[b] | (100 * most_shared >= percent * (size[a] + size[b] - most_shared))
            b, n = b[able], n[able]
            us.append(np.full(len(b), a))
            vs.append(b)
            ones.append(n)
    if not us:
        return ids[:0], ids[:0]
    u, v, n = np.concatenate(us), np.concatenate(vs), np.concatenate(ones)
    if most and len(u):
        top = _rank(u, comp[v], -n) < most
        top &= _rank(v, comp[u], -n) < most
        u, v = u[top], v[top]
    return ids[u], ids[v]


def _across(rows: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Pairs of different components within the buckets of ``key, id, component, n_shingles, sketch`` that pass.

    With ``most``, a pair only comes if it is among the ``most`` likeliest of both its members with the other's
    component in a unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        name = None

        def out() -> pa.RecordBatch:
            u, v = _compare(*(np.concatenate(x) for x in zip(*held, strict=True)), percent, most)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            named = np.stack([np.asarray(batch.column(k).cast(pa.int64())) for k in range(4)], axis=1)
            cols = [np.asarray(batch.column(k).cast(pa.int64())) for k in (5, 6, 7, 4)]
            cols.append(np.asarray(batch.column(8).flatten()).reshape(batch.num_rows, -1))
            cuts = np.flatnonzero(np.any(named[1:] != named[:-1], axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if name != (at := tuple(named[a].tolist())):
                    if sum(len(h[0]) for h in held) > 1:
                        yield out()
                    held, name = [], at
                held.append(tuple(c[a:b].copy() for c in cols))
        if sum(len(h[0]) for h in held) > 1:
            yield out()

    unit = ["key", "two", "lo", "hi"]
    dealt = _units(rows).repartition(F.xxhash64(*unit)).sortWithinPartitions(*unit)
    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; the component's least id is kept."""
    small_batches(docs.sparkSession)
    every = materialize(features(docs, width, percent), "minhash")
    full = every.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    # Texts under one id are linked by it.
    per = full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("rows")).filter("rows > 1")
    repeated = materialize(per.select(F.col("doc_id").alias("id"), (F.col("lo") != F.col("hi")).alias("differ")), "repeated")
    several = materialize(full.join(repeated.filter("differ").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").distinct(), "several")
    tied = several.join(classes, "digest").select(F.col("doc_id").alias("u"), F.col("id").alias("v")).filter("u <> v")
    owners = full.join(classes.select("digest", F.col("id").alias("doc_id")), ["digest", "doc_id"], "left_semi")
    reps = materialize(owners.unionByName(several).dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch"), "reps")

    keyed = reps.select("id", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = materialize(keyed.join(sizes, "key"), "buckets")
    weights = shared.groupBy("id").agg(F.sum("m").alias("weight"))
    sets = _sets(docs, shared.select("id").distinct(), repeated.select("id"), width)
    central = shared.join(weights, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
    star = salted_join(shared.select("key", "id"), central, "key", "id").filter(F.col("id") != -F.col("top.minus"))
    stars = star.groupBy("id").agg(F.max("top").alias("top")).select("id", (-F.col("top.minus")).alias("pivot"))
    stars = materialize(stars.select(F.greatest("id", "pivot").alias("u"), F.least("id", "pivot").alias("v")).distinct(), "stars")
    known = reps.select("id", "n_shingles", "sketch")
    tried = materialize(_near(stars, known, percent), "near")
    discard(stars)
    links = _confirm(tried, sets, percent)
    found = components(links.unionByName(tied))
    discard(links)

    for most in (FIRST, None):
        own = materialize(shared.select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "owned")
        mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        open_ = materialize(own.join(mixed, "key", "left_semi").join(known, "id"), "open")
        pairs = materialize(_across(open_, percent, most).join(tried, ["u", "v"], "left_anti"), "across")
        discard(own, open_)
        if pairs.isEmpty():
            discard(pairs)
            break
        links = _confirm(pairs, sets, percent)
        merged = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(links))
        more = materialize(tried.unionByName(pairs), "near")
        discard(links, found, tried, pairs)
        found, tried = merged, more

    final = materialize(classes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "final")
    discard(shared, tried, found, reps, several, repeated, classes, sets)
    moved = salted_join(full.select("doc_id", "n_shingles", "digest"), final, "digest", "doc_id")
    alone = every.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    out = moved.select("doc_id", "n_shingles", "component_id").unionByName(alone.select("doc_id", "n_shingles", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
