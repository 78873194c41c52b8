"""Tables written in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``; one is chosen here only in local mode where that is unset,
as in tests. A written table cuts the lineage: a lost executor re-reads it rather than recomputing what led to it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (no trailing slash)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _LOCAL:
            _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="quantiva-shared-")
        found = _LOCAL["dir"]
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quantiva-{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back with the schema it had."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold fewer rows where the session still has Spark's default.

    A batch is held by the JVM and by a Python worker at once, and rows of documents are kilobytes, not bytes.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` once what was made of them is written too."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def salted_join(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``key``, where one value of the key may be that of a third of all rows.

    The rows of a key are dealt out by ``by``; each (key, salt) in use gets its own copy of the table's row, at most
    SALTS of them and no more than the key has rows. ``rows`` should be a written table: it is read twice.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    spread = dealt.select(key, "__salt").distinct().join(table, key)
    return dealt.join(spread, [key, "__salt"], how).drop("__salt")
