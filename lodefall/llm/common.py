"""Pieces that the operators share: lets, checkpoints, bounded broadcasts, row digests and Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.session import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of the contracts that split on ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which a side of a join is broadcast; the sides that use it have narrow rows (under 200 bytes),
#: so this is under 40 MB. Beyond it the same join runs as a shuffle that adaptive execution can split.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, pattern: str = SPACE) -> Column:
    """The non-empty pieces of `text` between matches of `pattern`; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session has none, a temporary one is set if all runs on this machine, as
    in tests; on a cluster a machine's own folder would be of no use, so that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="lodefall-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lodefall-{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes what was written to a scratch path and isn't read any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the rows are at most `limit`; counts no further than that."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are at most `limit`, else as it is. Callers pass what cut() wrote,
    so that the count reads it instead of computing it."""
    return F.broadcast(df) if small(df, limit) else df


#: Bits of a sieve: 2^27, so 4096 pieces of 4 KB (16 MB) at most, whatever the input.
SIEVE_BITS = 1 << 27


def sieved(rows: DataFrame, place: Column, keys: DataFrame, key: Column, name: str) -> DataFrame:
    """`rows` with the boolean `name`: whether the hash `place` may be among the hashes `key` of `keys`; if it is, this is
    true. A bitmap of bounded size is broadcast, so nothing is shuffled, and what is false needs no join."""
    at = lambda h: F.pmod(h, F.lit(SIEVE_BITS))
    bits = keys.select(at(key).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = F.broadcast(bits.select(F.col("piece").alias("__lodefall_piece"), F.col("bits").alias("__lodefall_bits")))
    met = rows.withColumn("__lodefall_p", at(place))
    met = met.join(bits, F.bitmap_bucket_number("__lodefall_p") == F.col("__lodefall_piece"), "left")
    bit = F.bitmap_bit_position("__lodefall_p")
    byte = F.conv(F.hex(F.substring("__lodefall_bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, held).select(*rows.columns, name)


def text_hash(text: Column) -> Column:
    """With doc_id this names a row by content; null and empty texts differ."""
    return F.xxhash64(F.when(text.isNull(), F.lit(1)).otherwise(F.lit(0)), F.coalesce(text, F.lit("")))


def join_docs(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joins rows of one document: equal doc_id (nulls too) and equal th; the left side's doc_id and th stay."""
    right = right.withColumnsRenamed({"doc_id": "__lodefall_id", "th": "__lodefall_right"})
    match = F.col("doc_id").eqNullSafe(F.col("__lodefall_id")) & (F.col("th") == F.col("__lodefall_right"))
    return left.join(right, match, how).drop("__lodefall_id", "__lodefall_right")


def map_batches(df: DataFrame, body: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """`body` over Arrow batches; it gets at most SLICE rows at a time, so that long texts bound memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if (out := body(part)) is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows and bytes of a piece of an Arrow batch; a single row may be longer.
SLICE, SLICE_BYTES = 2048, 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, n = 0, batch.num_rows
    step = max(1, min(SLICE, n * SLICE_BYTES // max(batch.nbytes, 1)))
    while at < n:
        yield batch.slice(at, step)
        at += step
