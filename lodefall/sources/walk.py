"""Discovery of an archive's files by tasks: a data source that walks folders, and the incremental run on it.

The folders must be mounted on the executors, as an archive's are. Planning lists folders level by level until there are PARTS of them; each is
then walked by a task of its own, and no process sees all files. Excluded folders are never entered.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodefall.operators.paths import extension, file_name, lane
from lodefall.session import shared_dir, ship
from lodefall.sources.files import HEAD, PROCESSED, SAME_TIME, excluded, folder_names, included, present

#: Folders that planning goes on to list for, and levels below a root that it lists at most.
PARTS, LEVELS = 256, 6
#: Bytes that are read at once for a fingerprint.
BLOCK = 1 << 20


class Folder(InputPartition):
    """A folder to walk; `deep` tells whether its folders belong to it too."""

    def __init__(self, path: str, deep: bool) -> None:
        self.path, self.deep = path, deep


class Folders(DataSource):
    """path, size, mtime and error of the files under `roots`; folders named in `exclude` are left out (both options are JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return "lodefall_folders"

    def schema(self) -> str:
        return "path string, size long, mtime double, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return Walk(json.loads(self.options["roots"]), frozenset(json.loads(self.options.get("exclude", "[]"))))


class Walk(DataSourceReader):
    def __init__(self, roots: list[str], exclude: frozenset[str]) -> None:
        self.roots, self.exclude = roots, exclude

    def inside(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """The folders of a folder that aren't excluded, and its files; one that can't be listed has none."""
        try:
            with os.scandir(folder) as found:
                entries = sorted(found, key=lambda x: x.name)
        except OSError:
            return [], []
        own = [x for x in entries if x.is_dir(follow_symlinks=False)]
        return [x.path for x in own if x.name not in self.exclude], [x for x in entries if not x.is_dir()]

    def partitions(self) -> list[Folder]:
        whole, level = [], list(dict.fromkeys(r.rstrip("/") or "/" for r in self.roots))
        for _ in range(LEVELS):
            if not level or len(level) >= PARTS:
                break
            whole += [Folder(x, False) for x in level]
            level = [y for x in level for y in self.inside(x)[0]]
        return [*whole, *(Folder(x, True) for x in level)] or [Folder("", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        todo = [partition.path] if partition.path else []
        while todo:
            folders, entries = self.inside(todo.pop())
            if partition.deep:
                todo += folders
            for x in entries:
                path = Path(x.path).as_posix()
                try:
                    if x.is_file() or x.is_symlink():
                        of = x.stat()
                        yield path, of.st_size, of.st_mtime, None
                except OSError as e:
                    yield path, None, None, str(e)


def walked(spark: SparkSession, roots: list[str], exclude: list[str] = ()) -> DataFrame:
    """path, size, mtime and error of the files under the roots that exist; folders named by the globs aren't entered."""
    ship(spark)
    spark.dataSource.register(Folders)
    there = present(spark, list(roots))
    return spark.read.format("lodefall_folders").option("roots", json.dumps(there)).option("exclude", json.dumps(folder_names(list(exclude)))).load()


def fingerprints(batches: Iterator[pa.RecordBatch], sampled: bool) -> Iterator[pa.RecordBatch]:
    """path, print and read_error: SHA-256 of the file or, sampled, of its first and last 64 KiB (of small files the first only)."""

    def one(path: str) -> tuple[str | None, str | None]:
        try:
            made = hashlib.sha256()
            with open(path, "rb") as file:
                if sampled:
                    made.update(file.read(HEAD))
                    if os.fstat(file.fileno()).st_size >= HEAD:
                        file.seek(-HEAD, os.SEEK_END)
                        made.update(file.read(HEAD))
                    return f"sampled:{made.hexdigest()}", None
                while part := file.read(BLOCK):
                    made.update(part)
                return made.hexdigest(), None
        except OSError as e:
            return None, str(e)

    for batch in batches:
        found = [one(x) for x in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], ["path", "print", "read_error"])


#: What a run knows of a file; a table of files may have more columns.
FILE = "path string, name string, ext string, size long, mtime double, lane string, fingerprint string, status string, error_code string, error_detail string"


def discovered(spark: SparkSession, roots: list[str], known: DataFrame, include: list[str] = (), exclude: list[str] = (), max_bytes: int | None = None, sampled: bool = False) -> tuple[DataFrame, DataFrame]:
    """The table of files after a run over the roots, and one row of counts: total, discovered, skipped, failed and unchanged.

    `known` is the table before it (FILE and maybe more columns, a row per path). Excluded files aren't recorded; too large ones are SKIPPED, ones
    that can't be stated or read are FAILED. A processed file of equal size and time is unchanged, and isn't read; one of equal
    fingerprint is too. All others are DISCOVERED. Files that are gone, and all other columns, stay as they were.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    path = F.col("path")
    scan = walked(spark, roots, exclude).where(included(path, list(include)) & ~excluded(path, list(exclude)))
    old = known.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("fingerprint").alias("old_print"), F.col("status").alias("old_status"))
    processed = F.coalesce(F.col("old_status").isin(*PROCESSED), F.lit(False))
    same = processed & (F.col("size") == F.col("old_size")) & (F.abs(F.col("mtime") - F.col("old_mtime")) < SAME_TIME)
    big = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    first = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce(big, F.lit(False)), "skipped").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("read")
    seen = scan.join(old, "path", "left").withColumn("outcome", first).checkpoint()
    ship(spark)
    prints = seen.where("outcome = 'read'").select("path").mapInArrow(lambda batches: fingerprints(batches, sampled), "path string, print string, read_error string")
    both = seen.join(prints, "path", "left")
    read = F.when(F.col("read_error").isNotNull(), "failed").when(processed & (F.col("print") == F.col("old_print")), "unchanged").otherwise("discovered")
    both = both.withColumn("outcome", F.when(F.col("outcome") == "read", read).otherwise(F.col("outcome"))).checkpoint()
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    counts = both.agg(F.count("*").alias("total"), *map(count, ("discovered", "skipped", "failed", "unchanged")))
    made = both.where("outcome <> 'unchanged'").select(
        "path", file_name(path).alias("name"), extension(path).alias("ext"), "size", "mtime",
        F.when(F.col("outcome") == "skipped", "SKIPPED").when(F.col("error").isNull(), lane(extension(path))).alias("lane"),
        F.col("print").alias("fingerprint"),
        F.upper("outcome").alias("status"),
        F.when(F.col("outcome") == "skipped", "OVERSIZED").when(F.col("error").isNotNull(), "STAT_ERROR").when(F.col("read_error").isNotNull(), "READ_ERROR").alias("error_code"),
        F.coalesce("error", "read_error").alias("error_detail"),
    )
    names = {c: f"__lodefall_{c}" for c in made.columns}
    rows = known.join(made.withColumnsRenamed(names).withColumn("__lodefall_new", F.lit(True)), path == F.col(names["path"]), "full")
    value = lambda c: F.coalesce(names[c], c) if c not in ("error_code", "error_detail") else F.when(F.col("__lodefall_new"), F.col(names[c])).otherwise(F.col(c))
    return rows.select(*(value(c).alias(c) if c in names else F.col(c) for c in known.columns)), counts

