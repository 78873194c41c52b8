"""A keyed table with versions: rows are upserted and deleted, readers see one version or the next, never between.

A version is a folder of Parquet files that is written under a name of its own and becomes visible by a commit: a
small file ``commits/<number>`` that names it, put in place by one rename that fails if the number is taken. A writer
that dies before that leaves the version before it in force; what it wrote is removed by ``clean``. Two writers at once
both read version n; the one whose commit n + 1 comes second fails with :class:`Conflict` and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 30  # entries that a history of projects keeps


class Conflict(RuntimeError):
    """Another writer has committed the same version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]) -> None:
        self.spark, self.folder, self.schema, self.keys = spark, folder.rstrip("/"), schema, keys
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _list(self, name: str) -> list[str]:
        where = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def versions(self) -> list[int]:
        """Numbers of the versions committed, oldest first."""
        return [int(n) for n in self._list("commits") if n.isdigit()]

    def _data(self, version: int) -> str:
        text = self.spark.read.text(f"{self.folder}/commits/{version:08d}").first()[0]
        return json.loads(text)["data"]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one; no rows before the first commit."""
        have = self.versions()
        if version is None:
            version = have[-1] if have else 0
        if version and version not in have:
            raise KeyError(version)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{self._data(version)}") if version else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, based_on: int) -> str:
        """Write the rows of the version after ``based_on`` without showing them; returns what ``commit`` takes."""
        name = f"data/{based_on + 1:08d}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, name: str, based_on: int) -> int:
        number = based_on + 1
        to, new = self._path(f"commits/{number:08d}"), self._path(f"open/{uuid.uuid4().hex}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps({"data": name}).encode()))
        out.close()
        self._fs.mkdirs(self._path("commits"))
        if self._fs.exists(to) or not self._fs.rename(new, to):
            raise Conflict(number)
        return number

    def _last(self) -> int:
        have = self.versions()
        return have[-1] if have else 0

    def replace(self, make) -> int:
        """Commit what ``make`` turns the last version's rows into."""
        at = self._last()
        return self.commit(self.write(make(self.read(at)), at), at)

    def _on(self, a: DataFrame, b: DataFrame):
        on = F.lit(True)
        for k in self.keys:
            on = on & a[k].eqNullSafe(b[k])
        return on

    def upsert(self, new: DataFrame, keep: tuple[str, ...] = ()) -> int:
        """Rows of ``new`` in place of those of the same key, the others as they are; keys are unique in ``new``.

        Columns of ``keep`` stay as they were where the key is known, and so does any column where ``new`` has null.
        """

        def make(old: DataFrame) -> DataFrame:
            a, b = old.withColumn("__a", F.lit(True)).alias("a"), new.withColumn("__b", F.lit(True)).alias("b")
            on = F.lit(True)
            for k in self.keys:
                on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
            pick = lambda c: F.when(F.col("__a") & F.col("__b"), F.col(f"a.{c}") if c in keep else F.coalesce(f"b.{c}", f"a.{c}")).when(F.col("__b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
            return a.join(b, on, "full").select(*(pick(c).alias(c) for c in old.columns))

        return self.replace(make)

    def delete(self, gone: DataFrame) -> int:
        """Remove the rows whose keys ``gone`` has."""
        return self.replace(lambda old: old.join(gone, self._on(old, gone), "left_anti"))

    def clean(self, keep: int = 1) -> int:
        """Delete all but the last ``keep`` versions, and data that no commit names; the number of folders deleted.

        To be run while nobody writes: what a writer has written and not committed yet is not told apart.
        """
        have = self.versions()
        for v in have[:-keep] if keep else have:
            self._fs.delete(self._path(f"commits/{v:08d}"), False)
        named = {self._data(v).removeprefix("data/") for v in self.versions()}
        dead = [n for n in self._list("data") if n not in named]
        for n in dead:
            self._fs.delete(self._path(f"data/{n}"), True)
        return len(dead)


PROJECT = "id string, nom string, fichier string, chemin_source string, date string, type string, beton double, acier double, chute double, surfaces double, statut string, dossier string, livrables map<string,string>, alertes int, since bigint, snapshot string"


class ProjectHistory:
    """Projects by name and file, the newest MOST of them, each with the plan that it was made of."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = VersionedTable(spark, folder, PROJECT, ["nom", "fichier"])
        self.spark = spark

    def add(self, projects: DataFrame) -> int:
        """Add or renew projects (some of PROJECT's columns and ``plan_data``, JSON or null); one row for each key.

        A project that is known keeps its id, source and place in the order, and what the new row leaves null.
        """
        given = set(projects.columns)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], PROJECT).schema}
        base = projects.withColumns({c: (F.col(c) if c in given else F.lit(None)).cast(k) for c, k in kinds.items()})
        rounded = {c: F.round(c, n) for c, n in (("beton", 3), ("acier", 1), ("chute", 1), ("surfaces", 2))}
        source = F.coalesce("chemin_source", "fichier")
        at = self.table._last()
        named = base.withColumns({**rounded, "chemin_source": source, "fichier": F.regexp_extract(F.coalesce("fichier", F.lit("")), r"([^/\\]*)$", 1), "nom": F.coalesce(F.nullif("nom", F.lit("")), F.lit("Projet sans nom")), "since": F.lit(at + 1).cast("bigint")})
        known = self.table.read(at).select(F.col("nom").alias("n"), F.col("fichier").alias("f"), F.col("id").alias("old"))
        new = named.join(known, (F.col("nom") == F.col("n")) & (F.col("fichier") == F.col("f")), "left")
        # an id that follows from key and version: a task that runs twice gives the same
        new = new.withColumn("id", F.coalesce("old", F.substring(F.sha2(F.concat_ws("\x00", "nom", "fichier", F.lit(str(at + 1))), 256), 1, 12)))
        plan = F.col("plan_data") if "plan_data" in given else F.lit(None).cast("string")
        new = new.withColumn("snapshot", plan).select(*kinds)

        def make(old: DataFrame) -> DataFrame:
            a, b = old.alias("a"), new.alias("b")
            on = (F.col("a.nom") == F.col("b.nom")) & (F.col("a.fichier") == F.col("b.fichier"))
            fixed = ("id", "chemin_source", "since")
            pick = lambda c: (F.coalesce(f"a.{c}", f"b.{c}") if c in fixed else F.coalesce(f"b.{c}", f"a.{c}")).alias(c)
            return a.join(b, on, "full").select(*map(pick, kinds)).orderBy(F.col("since").desc(), "nom", "fichier").limit(MOST)

        return self.table.commit(self.table.write(make(self.table.read(at)), at), at)

    def entries(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).drop("snapshot").orderBy(F.col("since").desc(), "nom", "fichier")

    def snapshot(self, ident: str, version: int | None = None) -> str | None:
        """The plan of a project as it was given last."""
        row = self.table.read(version).filter(F.col("id") == ident).select("snapshot").first()
        return row and row[0]

    def remove(self, ident: str) -> bool:
        """Remove a project with its plan; whether there was one."""
        if self.table.read().filter(F.col("id") == ident).isEmpty():
            return False
        self.table.replace(lambda old: old.filter(F.col("id") != ident))
        return True
