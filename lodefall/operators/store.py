"""Stored tables in buckets of a key, of which a step rewrites those that it changes.

A table's folder holds
- data/<folder>/bucket=<n>: rows, written once by Spark's commit protocol and never changed;
- commits/<number>.json: which folder holds each bucket as of that commit, the columns, and how many buckets there are.

Readers follow the last commit, or one that they name. A step writes its buckets to a new folder and then a commit, by a rename that
fails where that number is taken. So a run that fails, or comes second, leaves the table as it was; its folder goes with the
next `vacuum`. What grows with the table stays in Spark: the driver sees the numbers of buckets alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodefall.operators import intake, maintenance
from lodefall.session import discard

BUCKET = "__lodefall_bucket"


class Conflict(Exception):
    """Another run committed first; the table is as that run left it."""


class Stored:
    """A table at a path, in buckets by the hash of the column `by` (the key, or what its rows are deleted by; a key keeps its
    `by`). Rows whose `by` is null share a bucket."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- commits

    def _file(self, name: str):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return there, there.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of the commits, ascending."""
        there, system = self._file("commits")
        names = [x.getPath().getName() for x in system.listStatus(there)] if system.exists(there) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def commit(self, version: int | None = None) -> dict:
        """A commit (the last one if none is named): version, by, buckets, schema, and the folder of each bucket with rows."""
        known = self.versions()
        wanted = version if version is not None else max(known, default=None)
        if wanted not in known:
            raise FileNotFoundError(f"{self.path} has no commit {'' if wanted is None else wanted}".rstrip())
        return json.loads(self.spark.read.text(f"{self.path}/commits/{wanted}.json", wholetext=True).first()[0])

    def _committed(self, entry: dict) -> int:
        draft, system = self._file(f"commits/.{uuid.uuid4().hex}")
        out = system.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else system.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
        try:
            files.rename(draft, self._file(f"commits/{entry['version']}.json")[0], none)  # never over a file
        except Exception as e:
            system.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: commit {entry['version']} is taken") from e
            raise
        return entry["version"]

    # --- reading and writing

    def _bucket(self, by: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows as of a commit; of some buckets alone where they are named."""
        return self._rows(self.commit(version), buckets)

    def _rows(self, at: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(at["schema"])
        wanted = at["folders"] if buckets is None else {str(b): at["folders"][str(b)] for b in buckets if str(b) in at["folders"]}
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{folder}/bucket={b}" for b, folder in wanted.items()))

    def _written(self, rows: DataFrame, by: str, buckets: int) -> dict[str, str]:
        """Writes rows to a new folder; the folder of each bucket that has rows. Rebalancing splits a bucket with many rows."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(F.col(by), buckets))
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        there, system = self._file(f"data/{folder}")
        names = [x.getPath().getName() for x in system.listStatus(there)]
        return {n.removeprefix("bucket="): folder for n in names if n.startswith("bucket=")}

    def create(self, rows: DataFrame, by: str, buckets: int = 64) -> Stored:
        """Makes the table of these rows. A bucket is what a step rewrites at least: take as many as hold some hundred MB each.
        `bucket` is no name for a column."""
        if "bucket" in rows.columns:
            raise ValueError("a column named bucket")
        if self.versions():
            raise Conflict(f"{self.path} is a table already")
        folders = self._written(rows, by, buckets)
        # what Parquet gives back: every column may be null
        schema = json.loads(rows.schema.json().replace('"nullable":false', '"nullable":true').replace('"containsNull":false', '"containsNull":true').replace('"valueContainsNull":false', '"valueContainsNull":true'))
        self._committed({"version": 1, "by": by, "buckets": buckets, "schema": schema, "folders": folders})
        return self

    def apply(self, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts step(rows of the buckets that `changes` touch, changes) in place of these rows, as one commit, and returns the
        buckets. Without changes nothing is written. `changes` has the column that the table is divided by, and is computed
        twice; checkpoint it where that is dear or not the same each time."""
        at = self.commit()
        by, n, schema = at["by"], at["buckets"], StructType.fromJson(at["schema"])
        changes = changes.withColumn(by, F.col(by).cast(schema[by].dataType))  # so that equal keys have equal hashes
        touched = sorted(x[0] for x in changes.select(self._bucket(F.col(by), n).alias(BUCKET)).distinct().collect())  # at most n
        if not touched:
            return []
        after = step(self._rows(at, touched), changes).select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))
        written = self._written(after, by, n)
        if stray := sorted(set(map(int, written)) - set(touched)):  # rows of these buckets would be lost
            raise ValueError(f"the step gave rows of buckets {stray}, which its changes don't touch")
        folders = {b: f for b, f in at["folders"].items() if int(b) not in touched} | written
        self._committed(at | {"version": at["version"] + 1, "folders": folders})
        return touched

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last `keep` commits and what only they, or failed runs, wrote; the number of folders removed. Not to be
        run beside a step, whose folder has no commit yet."""
        known = self.versions()
        for version in known[: len(known) - max(1, keep)]:
            discard(self.spark, f"{self.path}/commits/{version}.json")
        held = {f"{f}/bucket={b}" for v in self.versions() for b, f in self.commit(v)["folders"].items()}
        there, system = self._file("data")
        gone = [f"{f.getPath().getName()}/{b.getPath().getName()}" for f in system.listStatus(there) for b in system.listStatus(f.getPath()) if b.isDirectory()]
        for name in (stale := [x for x in gone if x not in held]):
            discard(self.spark, f"{self.path}/data/{name}")
        used = {x.split("/")[0] for x in held}
        for f in system.listStatus(there):
            if f.getPath().getName() not in used:
                discard(self.spark, f"{self.path}/data/{f.getPath().getName()}")
        return len(stale)

    # --- steps

    def upsert(self, new: DataFrame, key: str, keep_on_null: list[str], overwrite: list[str]) -> list[int]:
        """Files by key: null keeps the stored value in `keep_on_null`, and replaces it in `overwrite`."""
        return self.apply(new, lambda old, x: maintenance.upsert(old, x, key, keep_on_null, overwrite))

    def merge(self, new: DataFrame, key: str) -> list[int]:
        """Rows (vectors) in place of those with the same key."""
        return self.apply(new, lambda old, x: intake.merged(old, x.select(*old.columns), key))

    def delete(self, deleted: DataFrame) -> list[int]:
        """Takes out the rows of some values of the column that the table is divided by."""
        by = self.commit()["by"]
        return self.apply(deleted.select(by).distinct(), lambda old, x: maintenance.cascade(old, x, by))

    def upsert_chunks(self, new: DataFrame) -> list[int]:
        """Prepared chunks: those that are new or whose hash differs come in and wait for a vector. Only hashes are read to find
        them, so the buckets of unchanged chunks aren't touched, and a second run writes nothing."""
        same = self.read().select("chunk_id", "content_hash")
        changed = new.join(same, ["chunk_id", "content_hash"], "left_anti")
        return self.apply(changed, lambda old, x: intake.upserted(old, x.select(*old.columns)).drop("outcome"))


def cascaded(parents: Stored, children: list[Stored], deleted: DataFrame) -> list[list[int]]:
    """Deletes parents by the column that all of these tables are divided by, and their children; the buckets of each table, the
    parents' last. Children go first: a run that fails in between leaves no orphan, and the next one goes on."""
    return [t.delete(deleted) for t in (*children, parents)]
