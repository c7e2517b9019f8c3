"""Tables in a folder that change by copy on write: rows in buckets of a key, versions as lists of the buckets' folders.

A change reads and writes only the buckets of its keys; the others' files stay in the new version under their
names. A version is there once its list has been renamed into place, so a change that breaks off leaves the version before it, and readers of
an older version go on reading it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.operators import tables

LIST = "bucket int, folder string"
BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Someone else has made the next version meanwhile; nothing was changed."""


class VersionedTable:
    """Rows of one schema under `folder`, dealt to `buckets` by a hash of `key`."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        """The numbers of the versions, ascending."""
        fs, where = self._fs(f"{self.folder}/versions")
        if not fs.exists(where):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def listed(self, version: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has rows; at most as many as there are buckets."""
        found = self.versions()
        if not found:
            return {}
        number = found[-1] if version is None else version
        if number not in found:
            raise ValueError(f"there is no version {number}")
        return {r["bucket"]: r["folder"] for r in self.spark.read.schema(LIST).parquet(f"{self.folder}/versions/{number}").collect()}

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version, of the last if none is named; only the buckets of `keys` if these are given."""
        found = self.listed(version)
        if keys is not None:
            found = {b: found[b] for b in self._touched(keys) if b in found}
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        return self.spark.read.schema(schema).parquet(*found.values()) if found else self.spark.createDataFrame([], schema)

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket()).distinct().collect())  # at most as many as there are buckets

    def _write(self, rows: DataFrame, touched: list[int], before: dict[int, str], after: int) -> int:
        """A version in which the touched buckets have these rows instead of theirs."""
        data = f"{self.folder}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn(BUCKET, self._bucket())
        dealt.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(data)
        fs, where = self._fs(data)
        made = {int(n.split("=")[1]): f"{data}/{n}" for n in (x.getPath().getName() for x in fs.listStatus(where)) if n.startswith(BUCKET + "=")}
        if not set(made) <= set(touched):
            raise ValueError("a change gave rows of other keys than it named")
        listed = {b: f for b, f in before.items() if b not in touched} | made
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(listed.items()), LIST).coalesce(1).write.parquet(staged)
        fs, source = self._fs(staged)
        target = self._fs(f"{self.folder}/versions/{after}")[1]
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target) or fs.exists(self._fs(f"{self.folder}/versions/{after}/{source.getName()}")[1]):
            raise Conflict(f"version {after} is there already")
        return after

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        if self.versions():
            raise Conflict("the table is there already")
        rows.limit(0).write.mode("overwrite").parquet(f"{self.folder}/schema")
        return self._write(rows, list(range(self.buckets)), {}, 0)

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """A new version in which `make` turns the rows of the buckets of `keys` into theirs; with no keys the version stays."""
        last = self.versions()[-1]
        touched = self._touched(keys)
        if not touched:
            return last
        before = self.listed(last)
        schema = self.spark.read.parquet(f"{self.folder}/schema").schema
        mine = [before[b] for b in touched if b in before]
        old = self.spark.read.schema(schema).parquet(*mine) if mine else self.spark.createDataFrame([], schema)
        return self._write(make(old).select(schema.names), touched, before, last + 1)

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        """Insert rows, or put them in the place of those with their `keys` (the table's key among them)."""
        return self.change(new, lambda old: tables.upsert(old, new.select(old.columns), keys))

    def patch(self, changes: DataFrame, key: str) -> int:
        """Set the values that changes (the table's key and `key` among its columns, one row a `key`) has for rows; nulls leave what is there."""
        return self.change(changes, lambda old: tables.patched(old, changes.drop(self.key) if key != self.key else changes, key))

    def delete(self, gone: DataFrame, key: str) -> int:
        """Remove the rows with the keys of gone (the table's key and `key`)."""
        return self.change(gone, lambda old: tables.without(old, gone, key))

    def replace(self, groups: DataFrame, rows: DataFrame) -> int:
        """Let rows be all that there is of the table keys in groups: what a run derives anew goes in as what it derived before goes out."""
        wanted = rows.join(groups.select(self.key).distinct(), self.key, "left_semi")
        return self.change(groups, lambda old: tables.without(old, groups, self.key).unionByName(wanted.select(old.columns)))

    def forget(self, before: int) -> None:
        """Delete the versions before one, and the files that no version left needs."""
        kept = [v for v in self.versions() if v >= before]
        needed = {f for v in kept for f in self.listed(v).values()}
        for v in self.versions():
            if v < before:
                for folder in set(self.listed(v).values()) - needed:
                    fs, where = self._fs(folder)
                    fs.delete(where, True)
                fs, where = self._fs(f"{self.folder}/versions/{v}")
                fs.delete(where, True)
