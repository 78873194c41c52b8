"""Toxicity by a weighted finite-state pattern grammar.

Words get classes: insults are learned from labels (words, beginnings that many toxic words share, and phrases of
two words of which neither tells by itself); threats, targets, negations and words of reporting are listed. Small
weighted transducers for insult, threat, target, negation and reported speech are composed into one table; each
clause is read through it, so an insult counts more towards a person, and less if it is negated, reported or
within quotes. A logistic curve over a document's clause weights, fitted to the labelled sample, gives the score.

The fit uses at most ``MAX_LABELLED`` labelled rows (those of the least hash of their id); every word, beginning
and phrase whose evidence there reaches MIN_EVIDENCE is kept. Scoring covers every whole text. Documents in which
no listed or learned word is found by an Aho-Corasick scan need no further reading.

Defined cases: a null or empty text gets the score of a text without matches; repeated rows are scored alike;
an empty table gives an empty result; without labelled rows of both classes no insults are learned and the
listed words and a fixed curve remain; of labels that repeat an id the toxic one counts; other columns are passed
on, and where one has the name of a result column the result takes its place.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import discard, materialize, small_batches

MAX_LABELLED = 20_000
MIN_ODDS, MIN_FORMS = 3.5, 4
#: nats by which a word's share of toxic texts must tell against chance (likelihood ratio of a binomial)
MIN_EVIDENCE = 15.0
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: factors of the composed transducers
NEGATED, REPORTED, AIMED = 0.5, 0.6, 1.25
SCOPE = 3  # words that a negation reaches

#: fixed values: word classes besides the learned insults
THREATS = "kill murder hurt destroy strangle töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours they them he she du dich dir ihr euch tu toi vous te tú usted ustedes".split()
NEGATIONS = "not no never isn't aren't nobody nicht kein keine niemals pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says wrote called quoted claimed sagte schrieb nannte dit disait écrit dijo escribió llamó".split()
QUOTES = "\"“”„«»"
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[" + QUOTES + "]")
_CLAUSE = re.compile(r"[.!?;\n]")


def _compose() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], float]]:
    """The product of the transducers: (state, class) to (next state, weight factor).

    A state is (words left of a negation's scope, speech: 0 own, 1 reported by a verb, 2 within quotes, what is known
    of a target: 0 none, 1 seen, 2 an insult waits for one). Classes: I insult, T threat, Y target, N negation,
    R report, Q quotation mark, O other. A mark closes the quote that one before it opened.
    """

    def negation(s: int, c: str) -> tuple[int, float]:
        return (SCOPE, 1.0) if c == "N" else (max(0, s - 1), NEGATED if s and c in "IT" else 1.0)

    def reported(s: int, c: str) -> tuple[int, float]:
        if c == "Q":
            return (0 if s == 2 else 2), 1.0
        return (max(s, 1), 1.0) if c == "R" else (s, REPORTED if s and c in "IT" else 1.0)

    def target(s: int, c: str) -> tuple[int, float]:
        if c == "Y":
            return 1, AIMED - 1 if s == 2 else 0.0  # the insult before it was not yet known to be aimed
        if c == "I":
            return (1, AIMED) if s == 1 else (2, 1.0)
        return (s, 1.0 if s == 1 else 0.25) if c == "T" else (s, 0.0)  # a threat needs someone

    table = {}
    for n in range(SCOPE + 1):
        for r in range(3):
            for t in range(3):
                for c in "ITYNRQO":
                    (n2, fn), (r2, fr), (t2, ft) = negation(n, c), reported(r, c), target(t, c)
                    table[(n, r, t), c] = (n2, r2, t2), fn * fr * ft
    return table


TABLE = _compose()


@dataclass
class Grammar:
    """Learned words, beginnings and phrases with their weights, and the curve from clause weights to a score."""

    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    phrases: dict[str, float] = field(default_factory=dict)
    slope: float = 3.0
    offset: float = -3.0

    def __post_init__(self) -> None:
        import ahocorasick

        self.classes = {w: ("T", 1.0) for w in THREATS} | {w: ("I", x) for w, x in self.words.items()}
        self.classes |= {w: (c, 1.0) for c, ws in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("Q", QUOTES)) for w in ws}
        self.finder = ahocorasick.Automaton()
        for w in [*THREATS, *self.words, *self.prefixes, *self.phrases]:
            self.finder.add_word(w, len(w))
        self.finder.make_automaton()

    def __reduce__(self):
        return Grammar, (self.words, self.prefixes, self.phrases, self.slope, self.offset)

    def classify(self, word: str) -> tuple[str, float]:
        got = self.classes.get(word)
        if got is None:
            for k in PREFIXES:
                if len(word) >= k and (x := self.prefixes.get(word[:k])):
                    return "I", x
            return "O", 1.0
        return got

    def clause_weight(self, clause: str) -> float:
        state, total, at = (0, 0, 0), 0.0, 0
        words = _WORD.findall(clause)
        while at < len(words):
            both = self.phrases.get(" ".join(words[at : at + 2])) if self.phrases else None
            kind, weight = self.classify(words[at]) if both is None else ("I", both)
            state, factor = TABLE[state, kind]
            total += factor * weight
            at += 1 if both is None else 2
        return total

    def weight(self, text: str) -> float:
        """Sum of the weights of a text's matched clauses."""
        low = text.lower()
        begins = set()
        for end, size in self.finder.iter(low):
            at = end + 1 - size
            if not at or not low[at - 1].isalpha():
                begins.add(at)
        total, done = 0.0, -1
        for at in sorted(begins):
            if at < done:
                continue
            left = max(low.rfind(c, max(done, 0), at) for c in ".!?;\n") + 1
            left = left or max(done, 0)
            stop = _CLAUSE.search(low, at)
            done = stop.start() if stop else len(low)
            total += self.clause_weight(low[left:done])
        return total

    def curve(self, weight: float) -> float:
        x = self.slope * math.log1p(weight) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def score(self, text: str | None) -> float:
        return self.curve(self.weight(text or ""))


def held_out():
    """Rows that learning never uses: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    few = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", F.lower(F.coalesce("text", F.lit(""))).alias("text"))


def _independent(sample: DataFrame, bands: int = 8) -> DataFrame:
    """One of each group of near copies in the sample: their common words are no independent evidence.

    A text goes if it shares one of ``bands`` least hashes of its three-word shingles with one of a smaller id.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    cut = sample.select("doc_id", words.alias("w")).select("doc_id", F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 3), " "))).alias("h"))
    keys = cut.select("doc_id", F.posexplode(F.array(*(F.array_min(F.transform("h", lambda x, b=b: F.xxhash64(x, F.lit(b)))) for b in range(bands)))).alias("band", "key"))
    keys = materialize(keys, "toxic-keys")
    first = keys.groupBy("band", "key").agg(F.min("doc_id").alias("first"))
    late = keys.join(first, ["band", "key"]).filter("doc_id > first").select("doc_id").distinct()
    return sample.join(late, "doc_id", "left_anti")


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    """The grammar fitted to a bounded sample of the labelled rows that are not held out."""
    small_batches(docs.sparkSession)
    drawn = materialize(_labelled(docs, labels), "toxic-sample")
    sample = materialize(_independent(drawn), "toxic-sample")
    discard(drawn)
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        discard(sample)
        return Grammar()
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("form"))
    share = sizes[1] / (sizes[0] + sizes[1])

    def telling(counts: DataFrame) -> DataFrame:
        n, pos, neg = F.col("pos") + F.col("neg"), F.col("pos"), F.col("neg")
        evidence = pos * F.log(pos / n / share) + F.when(neg > 0, neg * F.log(neg / n / (1 - share))).otherwise(0.0)
        odds = F.log((pos + 0.5) / (sizes[1] + 1)) - F.log((neg + 0.5) / (sizes[0] + 1))
        return counts.filter("pos > 0").withColumns({"odds": odds, "evidence": evidence}).filter((F.col("odds") >= MIN_ODDS) & (F.col("evidence") >= MIN_EVIDENCE))

    forms = materialize(words.groupBy("form").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")), "toxic-forms")
    top = telling(forms).collect()  # each has its evidence in the bounded sample, so there are boundedly many
    begun = forms.select("pos", "neg", F.explode(F.array(*(F.when(F.length("form") > k, F.substring("form", 1, k)) for k in PREFIXES))).alias("prefix")).filter("prefix is not null")
    shared = begun.groupBy("prefix").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.when(F.col("pos") > 0, 1).otherwise(0)).alias("forms"), F.max("pos").alias("most"))
    shared = shared.filter((F.col("forms") >= MIN_FORMS) & (2 * F.col("most") <= F.col("pos")))  # no beginning for the sake of one word
    heads = telling(shared).orderBy(F.desc("evidence"), "prefix").collect()
    prefixes: dict[str, float] = {}
    for r in heads:  # of beginnings of each other the most telling
        if not any(r["prefix"].startswith(p) or p.startswith(r["prefix"]) for p in prefixes):
            prefixes[r["prefix"]] = min(1.0, r["odds"] / 4)
    words = {r["form"]: min(1.0, r["odds"] / 4) for r in top if not any(r["form"][:k] in prefixes for k in PREFIXES)}
    grammar = Grammar(words, prefixes, _phrases(sample, sizes, Grammar(words, prefixes)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grammar.weight(t) for t in b.column(1).to_pylist()], pa.float64())], ["toxic", "weight"])

    points = [(math.log1p(r["weight"]), r["toxic"]) for r in sample.select("toxic", "text").mapInArrow(weigh, "toxic int, weight double").collect()]
    grammar.slope, grammar.offset = _logistic(points)
    discard(sample, forms)
    return grammar


def _phrases(sample: DataFrame, sizes: dict[int, int], known: Grammar) -> dict[str, float]:
    """Two neighbouring words in a clause that tell only together, with their weight.

    What tells is the number of contexts (the words about a phrase) rather than of texts: a passage that several
    toxic texts share is one context, so its words are no insults.
    """

    def pairs(text: str, among: set[str] | None = None) -> set[tuple[str, int]]:
        out = set()
        for clause in _CLAUSE.split(text):
            ws = ["", *_WORD.findall(clause), ""]
            for i in range(1, len(ws) - 2):
                form = f"{ws[i]} {ws[i + 1]}"
                if (among is None or form in among) and known.classify(ws[i])[0] == known.classify(ws[i + 1])[0] == "O":
                    out.add((form, hash_of(ws[i - 1], ws[i + 2])))
        return out

    def spread(of: DataFrame, among: set[str] | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    own = sorted(pairs(b.column(0)[i].as_py(), among))
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.int64())], ["form", "context"])

        return of.select("text").mapInArrow(run, "form string, context bigint").distinct().groupBy("form").count()

    # A form needs its evidence in toxic texts, so there are no more candidates than those have room for.
    least = math.ceil(MIN_EVIDENCE / math.log((sizes[0] + sizes[1]) / sizes[1]))
    pos = {r["form"]: r["count"] for r in spread(sample.filter("toxic = 1"), None).filter(F.col("count") >= least).collect()}
    if not pos:
        return {}
    neg = {r["form"]: r["count"] for r in spread(sample.filter("toxic = 0"), set(pos)).collect()}
    out = {}
    for form, k in pos.items():
        odds, evidence = _telling(k, neg.get(form, 0), sizes)
        if odds >= MIN_ODDS and evidence >= MIN_EVIDENCE:
            out[form] = min(1.0, odds / 4)
    return out


def hash_of(*words: str) -> int:
    """A hash that is the same in every worker."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def _telling(pos: int, neg: int, sizes: dict[int, int]) -> tuple[float, float]:
    """Log odds of a form in toxic against other texts, and the likelihood ratio of its share against chance."""
    n, share = pos + neg, sizes[1] / (sizes[0] + sizes[1])
    evidence = pos * math.log(pos / n / share) + (neg * math.log(neg / n / (1 - share)) if neg else 0.0)
    return math.log((pos + 0.5) / (sizes[1] + 1)) - math.log((neg + 0.5) / (sizes[0] + 1)), evidence


def _logistic(points: list[tuple[float, int]], ridge: float = 0.05, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method; classes weigh alike."""
    n1 = sum(y for _, y in points)
    n0 = len(points) - n1
    slope = offset = 0.0
    for _ in range(rounds):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for x, y in points:
            w = 0.5 / n1 if y else 0.5 / n0
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + offset))))
            d, v = w * (p - y), w * max(p * (1 - p), 1e-9)
            g0, g1, h00, h01, h11 = g0 + d, g1 + d * x, h00 + v, h01 + v * x, h11 + v * x * x
        g0, g1 = g0 + ridge * 1e-2 * offset, g1 + ridge * 1e-2 * slope
        h00, h11 = h00 + ridge * 1e-2, h11 + ridge * 1e-2
        det = h00 * h11 - h01 * h01
        a, b = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = max(1.0, abs(a) / 5, abs(b) / 5)
        offset, slope = offset - a / step, slope - b / step
        if abs(a) + abs(b) < 1e-9:
            break
    return slope, offset


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The columns of ``docs`` with ``toxic_score``."""
    small_batches(docs.sparkSession)
    docs = docs.drop("toxic_score")
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_scores(b.column(place), grammar), pa.float64())], [*b.schema.names, "toxic_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("toxic_score", DoubleType())]))


def _scores(texts: pa.Array, grammar: Grammar) -> list[float]:
    return [grammar.score(texts[i].as_py()) for i in range(len(texts))]


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with its columns alone, whose score is under the threshold."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x < threshold for x in _scores(b.column(place), grammar)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
