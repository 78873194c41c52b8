"""Secret scans over an incremental ledger of blobs; DataFrame functions only.

Texts are addressed by their SHA-256. The ledger holds the findings of each (blob, rule version) that was ever
scanned; a scan takes one text of each blob that the ledger lacks, appends its findings, and joins them back to
all documents (paths) that have the blob. A second scan of the same or of a grown table reads only new blobs.

Matches with offsets come from two built-ins: what ``regexp_extract_all`` matches and what ``split`` leaves
between the matches add up to the text, so running sums of their lengths are the offsets (code points).

Two scans at once, or a driver that is started again, may record a blob twice; a blob's findings are read once.

Defined cases: a null text counts as empty (no spans); repeated rows and equal texts are scanned once and give a
row each; an empty table gives an empty result; other columns are not read. One blob may be that of a third of
all rows: it is one row once grouped (combined before the shuffle), and the join back is split by adaptive
execution on its larger side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import new_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and the group (0: all) that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: In the order in which kinds of the same start are listed. For runs of one class of characters the least
#: length is part of the pattern: a run is matched whole or not at all, as when short matches are dropped.
BASE = [Rule("assign", ASSIGN, 2, 6), Rule("access", r"AKIA[A-Z0-9]{16,}"), Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}")]
EXTRA = [Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"), Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----")]
RULES = BASE + EXTRA
RULE_VERSION = "2"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _find(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end>> of a rule's leftmost non-overlapping matches that pass."""
    empty = F.array().cast("array<struct<start:int,place:int,end:int>>")

    def located(found: Column) -> Column:
        gaps = F.split(text, rule.pattern, -1)
        kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
        steps = F.zip_with(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("skip"), F.length(m).alias("size"))), kept, lambda s, k: F.struct(s["skip"].alias("skip"), s["size"].alias("size"), k.alias("kept")))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["skip"]
            one = F.struct(start.alias("start"), F.lit(place).alias("place"), (start + x["size"]).alias("end"))
            return F.struct((start + x["size"]).alias("at"), F.when(x["kept"], F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, located(found)).otherwise(empty))


def spans_of(text: Column, rules: list[Rule] | None = None) -> Column:
    """All spans of a text (not null), sorted by start and then by the rules' order."""
    rules = RULES if rules is None else rules
    return F.sort_array(F.concat(*(_find(text, r, i) for i, r in enumerate(rules))))


def _written(spans: Column, rules: list[Rule]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, ledger: str | None = None, rules: list[Rule] | None = None, version: str = RULE_VERSION) -> DataFrame:
    """``doc_id, blob_id, found`` for every row; ``found`` is an array of (start, place, end), null without any.

    ``ledger`` is a folder in a store that all executors reach; without one the scan starts a new ledger in the
    shared folder. Blobs that it holds for this rule version are not scanned again. The version must change
    whenever the rules do.
    """
    spark = docs.sparkSession
    rules = RULES if rules is None else rules
    ledger = ledger or new_folder(spark, "ledger")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select("doc_id", text.alias("text"))
    address = F.unhex(F.sha2(F.col("text"), 256)).alias("blob_id")
    paths = held.select("doc_id", address)
    named = held.select(address, "text")
    try:
        done = _recorded(spark, ledger, version).select("blob_id").distinct()
        # ids are told apart from those recorded before any text is shuffled
        unseen = named.select("blob_id").distinct().join(done, "blob_id", "left_anti")
        named = named.join(unseen, "blob_id", "left_semi")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    blobs = named.groupBy("blob_id").agg(F.first("text").alias("text"))
    blobs.select("blob_id", spans_of(F.col("text"), rules).alias("found"), F.lit(version).alias("version")).write.mode("append").parquet(ledger)
    return paths.join(findings_of(spark, ledger, version), "blob_id", "left").select("doc_id", "blob_id", "found")


def _recorded(spark: SparkSession, ledger: str, version: str) -> DataFrame:
    return spark.read.parquet(ledger).filter(F.col("version") == version)


def findings_of(spark: SparkSession, ledger: str, version: str = RULE_VERSION) -> DataFrame:
    """``blob_id, found`` of the blobs with findings, one row each: two scans at the same time may both record a blob."""
    return _recorded(spark, ledger, version).filter(F.size("found") > 0).select("blob_id", "found").dropDuplicates(["blob_id"])


def report(scanned: DataFrame, rules: list[Rule] | None = None, base: list[Rule] | None = None) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    rules, base = RULES if rules is None else rules, BASE if base is None else base
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    found = scanned.select("doc_id", F.coalesce("found", none).alias("found"))
    count = lambda i: F.size(F.filter("found", lambda s: s["place"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(base)),
        F.sha2(_written(F.filter("found", lambda s: s["place"] < len(base)), rules), 256).alias("base_sha256"),
        _written(F.col("found"), rules).alias("spans"),
    )


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans (null or sorted by start) replaced by ``mask``; a null text stays null."""

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        skipped = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], skipped, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def scan_texts(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """All columns of ``docs`` with secrets masked in ``text`` and ``n_chars`` set anew where it exists.

    Findings come from the ledger, one for each blob; those that have none are not joined with anything large.
    """
    spark = docs.sparkSession
    ledger = ledger or new_folder(spark, "ledger")
    scan(docs.select("doc_id", "text"), ledger)
    taken = {c.lower() for c in docs.columns}
    blob, found = (next(n for n in (w + "_" * k for k in range(len(taken) + 1)) if n not in taken) for w in ("blob", "found"))
    findings = findings_of(spark, ledger).select(F.col("blob_id").alias(blob), F.col("found").alias(found))
    held = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    out = held.join(findings, blob, "left")
    out = out.withColumn("text", redact(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
