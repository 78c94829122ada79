"""Snapshots of tables: differences, upserts, cascades, duplicates, latest revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str, same: Column) -> DataFrame:
    """key and outcome: new, removed, changed or unchanged. `same` compares old.* with new.*."""
    o, n = old.alias("old"), new.alias("new")
    both = o.join(n, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    outcome = F.when(F.col(f"old.{key}").isNull(), "new").when(F.col(f"new.{key}").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return both.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: str, keep_on_null: list[str], overwrite: list[str]) -> DataFrame:
    """The snapshot after the update: null keeps the old value in `keep_on_null`, and replaces it in `overwrite`."""
    o, n = old.alias("old"), new.alias("new")
    both = o.join(n, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")
    updated = F.col(f"new.{key}").isNotNull()
    cols = [F.coalesce(f"new.{c}", f"old.{c}").alias(c) for c in keep_on_null]
    cols += [F.when(updated, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in overwrite]
    return both.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), *cols)


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """What is left of the children after their parents are deleted."""
    return children.join(deleted.select(key), key, "left_anti")


def duplicates(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Digests that occur more than once, with their number and smallest key."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")


def latest(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by `order`."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("rn = 1").drop("rn")


def merged_by_source(values: DataFrame, key: str, fields: list[str], rank: str, seq: str) -> DataFrame:
    """One record per key: each field from the highest source rank that has it, the later one on ties."""
    best = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(rank), F.col(seq)))).alias(c)
    return values.groupBy(key).agg(*(best(c) for c in fields))


def preferring(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The union of two maps by key; the first one's value wins."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("_a", "_b").alias(value))


def corrected(values: DataFrame, log: DataFrame, key: str, fields: list[str], rank: str, seq: str, manual: int = 3) -> DataFrame:
    """One record per key after the log's pending corrections (key, field, correct, seq, applied) were applied as of the
    manual rank. Fields that the log doesn't name are null there and so leave the others' values."""
    pending = log.where(~F.col("applied") & F.col("field").isin(*fields))
    as_values = [F.when(F.col("field") == c, F.col("correct")).cast(values.schema[c].dataType).alias(c) for c in fields]
    rows = pending.select(key, *as_values, F.lit(manual).alias(rank), F.col(seq))
    return merged_by_source(values.select(key, *fields, rank, seq).unionByName(rows), key, fields, rank, seq)


def applied(log: DataFrame) -> DataFrame:
    """The log after its pending corrections were applied."""
    return log.withColumn("applied", F.lit(True))


def reset(files: DataFrame, where: Column, status: str = "DISCOVERED") -> DataFrame:
    """The snapshot with the status of some files set back, so that the next run handles them anew."""
    return files.withColumn("status", F.when(where, status).otherwise(F.col("status")))


def status_totals(files: DataFrame, *by: str) -> DataFrame:
    """Files by each column, with subtotals and the total (null)."""
    return files.rollup(*by).agg(F.count("*").alias("files"))


def last_indexed(events: DataFrame, files: DataFrame, by: str, kind: str = "INDEXED") -> DataFrame:
    """The last time that a file of each project was indexed; the events are combined per file before the join."""
    last = events.where(F.col("event_type") == kind).groupBy("file_id").agg(F.max("ts").alias("ts"))
    return files.select("file_id", by).join(last, "file_id").groupBy(by).agg(F.max("ts").alias("last_indexed"))
