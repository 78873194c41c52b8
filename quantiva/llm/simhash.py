"""SimHash near-dedup: fingerprints embedded as counts of bits per segment, joined on a grid under Manhattan distance.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. A fingerprint is cut into
segments, and the numbers of bits set in them are its place on a lattice of so many dimensions. Flipping one bit
moves the place by one step, so the Manhattan distance of two places is a lower bound for the number of differing
bits: fingerprints that differ in two bits or fewer lie at most two steps apart. The range join files each different
fingerprint in the grid cell of its place and in those one step below or above it; two places at most two steps apart
have such a cell in common, and four combinations of below, own and above find each pair there. Pairs that meet are
verified by the bits in which they differ.

Cells hold few fingerprints unless very many are alike. Those of a cell of more than CROWD are verified without
pairing them: two differ in at most two bits exactly if some value differs from both in at most one, so each is filed
under itself and its 64 neighbours, and whatever shares such a value (65 fingerprints at most can) is linked to the
least one there. So the work is linear in the fingerprints whatever groups there are, and no link is lost.

Equal fingerprints are one node, grouped before any shuffle by map-side aggregation; only their table goes through
the join and the components. It meets the documents again in a salted join, since one fingerprint may be that of a
third of all rows.

Defined cases: a null or empty text, or one of blanks only, has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; long texts are read whole, HOLD shingles at a time; repeated rows give a
row each, with equal results; a row with a null doc_id links others, and its component_id is the least id that is
not null, or null if there is none; an empty table gives an empty result; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, materialize, salted_join, small_batches

SEED, WIDTH, SEGMENTS, MOST_BITS = 42, 3, 16, 2
CROWD = 64
HOLD = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits of a text in UTF-8, as a signed number; A-Z count as a-z."""
    words = text.lower().split()  # of bytes: ASCII letters and blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, HOLD):
        spans = zip(starts[at : at + HOLD].tolist(), ends[at : at + HOLD].tolist(), strict=True)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def cells(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``fp, cell, role``: the lattice place of each fingerprint (role 0) and those one step below (1) or above it (2).

    A place is one number with a field for each segment, wide enough for one step beyond the segment's bits.
    """
    bits = 64 // segments
    field = (bits + 1).bit_length()
    if 64 % segments or segments * field > 64:
        raise ValueError("segments must divide 64 and their counts fit in 64 bits")
    mask = (1 << bits) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit(mask))).cast("bigint") for i in range(segments)]
    place = counts[0]
    for i in range(1, segments):
        place = place.bitwiseOR(F.shiftleft(counts[i], field * i))
    # fields never borrow or carry: an empty one has no step below, and each has room for one above its full count
    held = lambda i: F.get("counts", F.lit(i))
    beside = lambda i, by: F.col("place").bitwiseXOR(F.shiftleft(held(i).bitwiseXOR(held(i) + by), field * i))
    way = lambda cell, role: F.struct(cell.alias("cell"), F.lit(role).alias("role"))
    below = [F.when(held(i) > 0, way(beside(i, -1), 1)) for i in range(segments)]
    ways = F.array(way(F.col("place"), 0), *below, *(way(beside(i, 1), 2) for i in range(segments)))
    placed = fps.select("fp", F.array(*counts).alias("counts"), place.alias("place"))
    return placed.select("fp", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("fp", "w.cell", "w.role")


def links(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Edges ``u, v`` between different fingerprints (``fp``, no two alike) that connect all at MOST_BITS bits or fewer."""
    filed = cells(fps, segments)
    shared = filed.groupBy("cell").agg(F.count("*").alias("members")).filter("members > 1")
    # merged: the planner sizes places as if each fingerprint had one, and would send them all to the driver
    met = materialize(filed.join(shared.hint("merge"), "cell"), "simhash-cells")
    few = met.filter(F.col("members") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    once = ((F.col("a.role") == F.col("b.role")) & F.col("a.role").isin(0, 1) & (F.col("a.fp") < F.col("b.fp"))) | ((F.col("b.role") == 1) & F.col("a.role").isin(0, 2))
    differ = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    pairs = a.join(b.hint("merge"), F.col("a.cell") == F.col("b.cell")).filter(once & (differ <= MOST_BITS)).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    out = materialize(pairs.unionByName(crowded(met.filter(F.col("members") > CROWD).select("fp").distinct())), "simhash-links")
    discard(met)
    return out


def crowded(fps: DataFrame) -> DataFrame:
    """The same edges for any fingerprints, without pairing them: each is linked to the least that shares a neighbour."""
    one = F.lit(1).cast("bigint")
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.shiftleft(one, i)) for i in range(64)))
    balls = fps.select("fp", F.explode(around).alias("middle"))
    each = balls.groupBy("middle").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)  # 65 at most
    return each.select("u", F.explode("all").alias("v")).filter("u <> v").distinct()


def link(docs: DataFrame, width: int = WIDTH, segments: int = SEGMENTS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    marked = materialize(fingerprints(docs, width), "simhash")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes.select("fp"), segments)
    member = components(edges)
    discard(edges)
    grouped = materialize(nodes.join(member.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-grouped")
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    found = materialize(salted_join(grouped, named, "component", "fp").select("fp", "component_id"), "simhash-found")
    discard(nodes, member, grouped)
    out = salted_join(marked, found, "fp", "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
