"""Session settings and table access shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution sizes partitions at run time; the rest keeps Python transfers in Arrow batches.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "lodefall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; `conf` entries use `__` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; column pruning and pushed filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, a temporary one stands for it if all runs on this machine, as
    in tests; on a cluster a machine's own folder would be of no use, so that is an error."""
    context = spark.sparkContext
    if given := spark.conf.get("spark.checkpoint.dir", None):
        return given
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not hasattr(context, "_lodefall_dir"):
        context._lodefall_dir = tempfile.mkdtemp(prefix="lodefall-")
    return context._lodefall_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the folder that all executors share and read from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/lodefall-{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes what was written to a scratch path and isn't read any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def version(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """The files of a table with their sizes and times; another one tells that the table was written anew."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = there.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(there, True), []
    while found.hasNext():
        x = found.next()
        out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once per context, so that they need no installed copy."""
    context = spark.sparkContext
    if not getattr(context, "_lodefall_shipped", False):
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="lodefall-")) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(to))
        context._lodefall_shipped = True
