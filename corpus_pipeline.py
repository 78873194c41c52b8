"""A corpus pipeline of five stages: each takes the documents its predecessor kept and passes on what it keeps.

``run`` writes each stage as a table in the shared folder and reads it again, so that a lost executor costs a
re-read at most; a stage's input is deleted once its output is written. All but the last stage return the columns
of ``documents``, whatever they are called.

Defined cases: an empty table gives empty results in each stage; null and empty texts are kept by all stages and
encoded as empty; rows with a null id are judged by their text alone and are no copies of anything; repeated rows
are copies of each other, of which one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantiva.llm import bpe, decontaminate, minhash, secrets, toxicity
from quantiva.llm.scratch import discard, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted to the labelled ones, doesn't find toxic.

    Rows that repeat a text get the same score, so either all or none of them stay.
    """
    grammar = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, grammar)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the row of the least id.

    Rows that repeat an id are one document: of those with the same text one stays, and so of those with different
    texts, which are linked by their id (the row whose text has the least xxhash64). Rows without an id all stay.
    """
    kept = minhash.link(docs, width=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    row = "row"
    while row in docs.columns:
        row += "_"
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = docs.join(kept, "doc_id", "left_semi").withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1)
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in the text replaced by a mask."""
    return secrets.scan_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("secret_scan", mask_secrets), ("byte_bpe", encode)]

ORACLE_SQL = None  # the first stage is learned from labels


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
