"""Registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fim, minhash, quality, secrets, simhash, substring, suffixes, toxicity, url_rules, whitening
from .scratch import new_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(_read(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(_read(spark, sf_dir, "documents"), width=3, percent=85)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, _read(spark, sf_dir, "benchmark"))
    return decontaminate.report(marked)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it comes in twice: some of its rows first, then all; the second scan reads what the ledger lacks."""
    docs, ledger = _read(spark, sf_dir, "documents"), new_folder(spark, "ledger")
    secrets.scan(docs.filter(F.xxhash64("doc_id") % 2 == 0), ledger)
    return secrets.report(secrets.scan(docs, ledger))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents come in two batches in an order that isn't that of their ids; the levels of both are merged."""
    return suffixes.remove(_read(spark, sf_dir, "documents"), with_bytes=False, batches=2)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.learn(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, grammar)
    predicted = (F.col("toxic_score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxic_score").alias("score"), predicted.alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove(_read(spark, sf_dir, "documents"), with_text=False)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(_read(spark, sf_dir, "pages"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(_read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(_read(spark, sf_dir, "documents"), with_output=False)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_byte_bpe, op3_minhash_dedup, op4_decontamination, op5_secret_scan, op6_suffix_dedup, op7_toxicity, op8_quality_rules, op9_substring_dedup, op10_url_filter, op11_simhash_dedup, op12_fill_in_middle, op13_embedding_whitening)
}

_ASCII_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = rf"""
with d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') g
       from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by doc_id),
its as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from hit group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join pos on pos.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
"""


def _sql_spans(place: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''").replace("(?<![0-9a-f])", "")
    return f"""select doc_id, {place} place, '{rule.kind}' kind, k, len(array_to_string(gaps[1:k], '') || array_to_string(ms[1:k - 1], '')) s, ms[k] m, gs[k] g
from (select doc_id, string_split_regex(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}') ms, regexp_extract_all(t, '{pattern}', {rule.group}) gs, unnest(range(1, len(ms) + 1)) k from t) where len(g) >= {rule.least}"""


_OP5 = f"""
with t as (select doc_id, coalesce(text, '') t from documents),
spans as ({" union all ".join(_sql_spans(i, r) for i, r in enumerate(secrets.RULES))}),
sums as (select doc_id, count(*) filter (place = 0) a, count(*) filter (place = 1) c, count(*) filter (place = 2) h,
  string_agg(kind || ':' || s || ':' || (s + len(m)), ',' order by s, place) filter (place < 3) base,
  string_agg(kind || ':' || s || ':' || (s + len(m)), ',' order by s, place) spans from spans group by doc_id)
select t.doc_id, coalesce(a, 0) n_assign, coalesce(c, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from t left join sums on sums.doc_id = t.doc_id
"""

_OP9 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, i, array_to_string(w[i : i + 12], ' ') g from (select *, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
m as (select *, min(doc_id) over (partition by g) least from g),
gone as (select distinct doc_id, unnest(range(i, i + 13)) p from m where least < doc_id),
per as (select doc_id, count(*) n from gone group by doc_id),
stay as (select x.doc_id, string_agg(v, ' ' order by i) s from (select doc_id, unnest(w) v, unnest(range(1, len(w) + 1)) i from d) x
  anti join gone on gone.doc_id = x.doc_id and gone.p = x.i group by x.doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_removed, sha256(coalesce(s, '')) kept_sha256
from d left join per on per.doc_id = d.doc_id left join stay on stay.doc_id = d.doc_id
"""

_OP3 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] end) g from d)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
reach as (select doc_id, doc_id m from documents union select r.doc_id, e.b from reach r join e on e.a = r.m),
c as (select doc_id, min(m) component_id from reach group by doc_id)
select c.doc_id, coalesce(n, 0) n_shingles, component_id, c.doc_id = component_id kept from c left join n on n.doc_id = c.doc_id
"""

ORACLE: dict[str, str] = {"op3_minhash_dedup": _OP3, "op4_decontamination": _OP4, "op5_secret_scan": _OP5, "op9_substring_dedup": _OP9}
