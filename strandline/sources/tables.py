"""Stored tables of structures, matches, feedback and labels, as Parquet that readers never see half written.

A table is a folder of generations ``g-...``, each a folder of segments ``s-...``; the highest generation is the table. An insert adds a segment, a replacement
(delete, clear) adds a generation. Both are written under another name and then renamed, which a file system does at once, and a rename to a
name that is there fails; so a writer that dies leaves the table as it was, and of two writers at once one gets an error. Ids are
dealt from the row counts of partitions, above the greatest id so far; no task sees all rows.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Which column of a table names rows of another, children first, so that a stopped cascade leaves no row without its parent.
CASCADE = (("feedback", "match_id", "matches"), ("matches", "structure_id", "structures"))


class Conflict(RuntimeError):
    """Another writer was there first."""


class Store:
    """Tables under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, *parts: str) -> Any:
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _names(self, kind: str, *parts: str) -> list[str]:
        at = self._path(*parts)
        system = at.getFileSystem(self._conf)
        found = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
        return sorted(n for n in found if n.startswith(kind))

    def _put(self, source: str, *target: str) -> None:
        """Renames at once; fails if the target is there."""
        to = self._path(*target)
        to.getFileSystem(self._conf).mkdirs(to.getParent())
        context = self._hadoop.FileContext.getFileContext(self._conf)
        none = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(self._hadoop.Path(source)), context.makeQualified(to), none)
        except Exception as error:
            raise Conflict(f"{'/'.join(target)} could not be put in place") from error

    def generation(self, name: str) -> str | None:
        return (self._names("g-", name) or [None])[-1]

    def read(self, name: str) -> DataFrame | None:
        """The table, or None if nothing was ever put into it."""
        now = self.generation(name)
        return None if now is None else self.spark.read.parquet(*["/".join([self.root, name, now, s]) for s in self._names("s-", name, now)])

    def _draft(self, rows: DataFrame) -> str:
        at = f"{self.root}/_draft-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return at

    def insert(self, name: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """Adds rows with new ids in ``key`` and gives them back as they were stored.

        Columns must be those of the table. Ids rise without gaps from one above the greatest there; in which order rows get them is not fixed.
        """
        now, there = self.generation(name), self.read(name)
        top = there.agg(F.max(key)).first()[0] if there is not None else None
        drafted = self._draft(rows.drop(key).withColumn("_at", F.monotonically_increasing_id()))
        placed = self.spark.read.parquet(drafted).withColumn("_part", F.shiftright("_at", 33))
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        bases = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
        ids = (F.lit((top or 0) + 1) + F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(key)
        made = placed.join(bases, "_part").select(ids, *[c for c in rows.columns if c != key])
        segment = self._draft(made)
        if now is None:
            self._first(name, segment)
        else:
            self._put(segment, name, now, f"s-{len(self._names('s-', name, now)):08d}")
            if self.generation(name) != now:
                raise Conflict(f"{name} was replaced meanwhile")
        self._remove(drafted)
        now = self.generation(name)
        return self.spark.read.parquet("/".join([self.root, name, now, self._names("s-", name, now)[-1]]))

    def _first(self, name: str, segment: str, generation: int = 0) -> None:
        whole = f"{self.root}/_draft-{uuid.uuid4().hex}"
        at = self._hadoop.Path(whole)
        at.getFileSystem(self._conf).mkdirs(at)
        self._put(segment, whole.rsplit("/", 1)[1], "s-00000000")
        self._put(whole, name, f"g-{generation:08d}")

    def _remove(self, path: str) -> None:
        at = self._hadoop.Path(path)
        at.getFileSystem(self._conf).delete(at, True)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Makes ``rows`` the table; older generations stay for readers that have begun, until ``tidy``."""
        now = self.generation(name)
        self._first(name, self._draft(rows), 0 if now is None else int(now[2:]) + 1)

    def clear(self, name: str) -> None:
        """Leaves the table without rows."""
        there = self.read(name)
        if there is not None:
            self.replace(name, there.limit(0))

    def delete(self, name: str, gone: DataFrame, key: str = "id") -> None:
        """Removes the rows whose ``key`` is among ``gone`` (one column, ``key``), and all rows of other tables that name them."""
        for child, names, parent in CASCADE:
            rows = self.read(child) if parent == name else None
            if rows is not None:
                lost = rows.join(gone.select(F.col(key).alias(names)).distinct(), names, "left_semi")
                if not lost.isEmpty():
                    self.delete(child, lost.select(key), key)
        there = self.read(name)
        if there is not None:
            self.replace(name, there.join(gone.select(key).distinct(), key, "left_anti").select(*there.columns))

    def latest(self, name: str, n: int, *order: Column, where: Column | None = None) -> DataFrame:
        """The first ``n`` rows in an order (T5), of those that pass ``where`` (F14); Spark keeps n rows a task."""
        there = self.read(name)
        rows = there if where is None else there.where(where)
        return rows.orderBy(*order).limit(n)

    def tidy(self, name: str) -> None:
        """Removes the generations before the last one and drafts of writers that died; only when no reader or writer is at work."""
        for old in self._names("g-", name)[:-1]:
            self._remove("/".join([self.root, name, old]))
        for draft in self._names("_draft-"):
            self._remove(f"{self.root}/{draft}")


class Models:
    """Saved models by version in a ``Store``'s folder; a version is there as a whole or not at all."""

    def __init__(self, store: Store, name: str = "models") -> None:
        self.store, self.name = store, name

    def versions(self) -> list[int]:
        return [int(v[2:]) for v in self.store._names("v-", self.name)]

    def save(self, model: PipelineModel, facts: dict) -> int:
        """Puts a model with its facts in place and gives its version."""
        version = (self.versions() or [0])[-1] + 1
        at = f"{self.store.root}/_draft-{uuid.uuid4().hex}"
        model.write().save(f"{at}/model")
        self.store.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{at}/facts")
        self.store._put(at, self.name, f"v-{version:08d}")
        return version

    def load(self, version: int | None = None) -> tuple[PipelineModel, dict] | None:
        """The newest model, or that of a version, with its facts; None without one."""
        there = self.versions()
        if not there or (version is not None and version not in there):
            return None
        at = f"{self.store.root}/{self.name}/v-{version or there[-1]:08d}"
        return PipelineModel.load(f"{at}/model"), json.loads(self.store.spark.read.text(f"{at}/facts").first()[0])
