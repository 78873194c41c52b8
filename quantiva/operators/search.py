"""Exact cosine search of many query vectors, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048  # vectors of a block


def _blocks(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` packed into blocks of unit vectors; null vectors and those of length 0 have no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids, v = np.asarray(part.column(0), np.int64), np.array(part.column(1).to_pylist(), np.float64)
                norm = np.sqrt((v * v).sum(axis=1))
                some = norm > 0
                yield pa.RecordBatch.from_arrays([pa.array([ids[some].tobytes()], pa.binary()), pa.array([(v[some] / norm[some, None]).tobytes()], pa.binary())], ["ids", "unit"])

    return vectors.filter("vec_id is not null and v is not null").select("vec_id", "v").mapInArrow(run, "ids binary, unit binary")


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, vec_id, score``: per query the ``k`` vectors of highest cosine to four places, then of least id."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, unit, q_ids, q_unit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                if not len(ids) or not len(q_ids):
                    continue
                raw = np.frombuffer(q_unit).reshape(len(q_ids), -1) @ np.frombuffer(unit).reshape(len(ids), -1).T
                score = np.sign(raw) * np.floor(np.abs(raw) * 1e4 + 0.5) / 1e4  # half away from 0, as SQL rounds
                first = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                n = first.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(ids[first].ravel()), pa.array(np.take_along_axis(score, first, 1).ravel())], ["query", "vec_id", "score"])

    asked = _blocks(queries).withColumnsRenamed({"ids": "q_ids", "unit": "q_unit"})
    found = _blocks(vectors).crossJoin(asked).mapInArrow(best, "query bigint, vec_id bigint, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).drop("k")
