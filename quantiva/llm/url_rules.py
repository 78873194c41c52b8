"""URL filtering by listed rules and by association rules mined from labelled URLs.

A URL is cut into host, path and tokens (top-level domain, other host labels, path segments, query keys).
Spark's FP-growth mines the token combinations that go with a label. A rule needs support (MIN_COUNT rows at least,
and MIN_SUPPORT of all labelled rows, which bounds their number), confidence, and a confidence that can't be had by
the label's base rate: the lower Wilson bound at Z_SCORE must exceed it. Rules that a shorter one makes needless go.
What is left is matched by an inverted index from each rule's rarest token.

Tokens that occur in the same labelled rows give the same rules, so only the first of them in order is mined and
the others stand for it when URLs are matched: copies of a URL with many segments don't multiply itemsets, and no
rule is lost, since those with several of such tokens are ones that a shorter rule makes needless.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens and the default
verdict; repeated rows give repeated verdicts; a null page_id is passed on; an empty table gives an empty result;
long URLs are read whole; ties between mined rules go by confidence, support, length and then by the tokens in
order. Columns other than the id and URL are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path) of the listed rules
BASE_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, Z_SCORE = 0.002, 20, 0.9, 3.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict; nulls without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens with their kind: ``tld:``, ``host:`` (each other label), ``seg:`` (path segments), ``key:`` (query keys)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
            F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.lit("host:"), x)),
            F.transform(segments, lambda x: F.concat(F.lit("seg:"), x)),
            F.transform(keys, lambda x: F.concat(F.lit("key:"), x)),
        )
    )


def wilson_lower(hits: Column, n: Column, z: float = Z_SCORE) -> Column:
    """Lower bound of a share of which ``hits`` of ``n`` were seen."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _frequent(rows: DataFrame, least: int) -> tuple[dict[str, int], dict[str, str]]:
    """Of the tokens in at least ``least`` rows of ``tokens, label``: the count of each that is mined, and for every
    one the token that stands for it, the first of those in the same rows.

    There are as many as the tokens of 1 / MIN_SUPPORT URLs at most.
    """
    each = rows.select(F.explode(F.array_distinct("tokens")).alias("token"), F.xxhash64("tokens", "label").cast("decimal(38,0)").alias("h"), F.xxhash64("label", "tokens", F.lit(1)).cast("decimal(38,0)").alias("k"))
    places = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum("h").alias("h"), F.sum("k").alias("k")).filter(F.col("freq") >= least)
    alike = places.groupBy("freq", "h", "k").agg(F.sort_array(F.collect_list("token")).alias("tokens")).collect()
    return {r["tokens"][0]: r["freq"] for r in alike}, {t: r["tokens"][0] for r in alike for t in r["tokens"]}


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> tuple[list[dict], dict[str, str]]:
    """Pruned association rules from rows of ``tokens`` (array) and ``label`` (allow or block), and for each frequent
    token the one that stands for it in them.

    Each frequent token set has at least ``min_support`` of the labelled rows, so the number of rules is bounded
    by that share and the number of different tokens in a URL, whatever the number of rows.
    """
    from pyspark.ml.fpm import FPGrowth

    rows = labelled.filter("label is not null").select("tokens", "label")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(sizes.values())
    least = max(min_count, math.ceil(min_support * total))
    if total < least:
        return [], {}
    frequency, stands = _frequent(rows, least)
    known = F.filter(F.array_distinct("tokens"), lambda t: t.isin(*frequency)) if frequency else F.array().cast("array<string>")
    items = rows.select(F.concat(known, F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / total, minConfidence=min_confidence).fit(items)
    found = model.associationRules.filter(F.element_at("consequent", 1).startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:")))
    label = F.substring(F.element_at("consequent", 1), 7, 1 << 20)
    base = F.element_at(F.create_map(*(F.lit(x) for k, n in sorted(sizes.items()) for x in (k, n / total))), label)
    hits = F.round(F.col("support") * total)
    sure = found.filter(wilson_lower(hits, F.round(hits / F.col("confidence"))) > base)
    rules = [{"tokens": tuple(sorted(r["antecedent"])), "label": r["say"], "confidence": r["confidence"], "support": r["support"]} for r in sure.select("antecedent", label.alias("say"), "confidence", "support").collect()]
    rules.sort(key=lambda r: (len(r["tokens"]), r["tokens"], r["label"]))
    best: dict[tuple[str, tuple[str, ...]], float] = {}  # by label and tokens: the best confidence of a rule's tokens or some of them
    kept = []
    for r in rules:
        shorter = [best.get((r["label"], r["tokens"][:i] + r["tokens"][i + 1 :]), 0.0) for i in range(len(r["tokens"]))]
        shorter += [best.get((r["label"], (t,)), 0.0) for t in r["tokens"] if len(r["tokens"]) > 1]
        if max(shorter) < r["confidence"]:
            kept.append(r | {"rarest": min(r["tokens"], key=lambda t: (frequency.get(t, 0), t))})
        best[r["label"], r["tokens"]] = max(*shorter, r["confidence"])
    return kept, stands


def best_rule(tokens: set[str], index: dict[str, list[dict]]) -> dict | None:
    """The strongest mined rule all of whose tokens a URL has, looked up by its tokens."""
    fits = [r for t in tokens for r in index.get(t, ()) if tokens.issuperset(r["tokens"])]
    return min(fits, key=lambda r: (-r["confidence"], -r["support"], len(r["tokens"]), r["tokens"]), default=None)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | None = None, labels: DataFrame | None = None, default: str = "allow", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined``: the listed rule's verdict, else the mined rules', else the default.

    ``labels`` has ``page_id`` and ``label`` (allow or block). Without it the listed rules label the pages that
    they judge, and mining carries their verdicts over to pages that they do not reach.
    """
    rules = BASE_RULES if rules is None else rules
    url = F.col("url")
    cut = pages.select("page_id", "url").select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = cut.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens_of(url, F.col("host"), F.col("path")).alias("tokens"))
    known = judged.select("tokens", F.col("listed").alias("label")) if labels is None else judged.join(labels.select("page_id", "label"), "page_id").select("tokens", "label")
    index: dict[str, list[dict]] = defaultdict(list)
    mined, stands = mine(known, min_support, min_confidence, min_count)
    for r in mined:
        index[r["rarest"]].append(r)
    index = dict(index)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            listed, tokens = b.column(4).to_pylist(), b.column(5).to_pylist()
            hits = [None if say else best_rule({stands.get(x, x) for x in t or ()}, index) for say, t in zip(listed, tokens, strict=True)]
            say = [own or (h["label"] if h else default) for own, h in zip(listed, hits, strict=True)]
            mined = [" & ".join(h["tokens"]) if h else None for h in hits]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(say, pa.string()), pa.array(mined, pa.string())], ["page_id", "host", "path", "rule", "verdict", "mined"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return judged.mapInArrow(match, f"page_id {kind}, host string, path string, rule string, verdict string, mined string")
