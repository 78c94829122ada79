"""Shards by vector bin packing over bytes, tokens and rows.

Rows are gathered into groups of equal texts, and a group is placed whole unless no shard could hold it: only a group with
more than a shard's share of the bytes, tokens or rows is cut, by a hash of its rows, into about CHUNKS chunks a share.
(A group that stays whole has its rows numbered in such chunks too, so that no task sorts a large group.)
Groups of over 1/HEAVY of a share are packed one by one; there are at most 3 * shards * HEAVY of them, whatever the input.
The many smaller ones go, whole, into one of BUNDLES bundles by a hash of the text. So the number of items to pack has a
fixed bound, and the driver packs them: largest first, each to the shard whose residual capacity has the highest dot product
with the item's (bytes, tokens, rows), in units of a shard's share; bytes, the law's dimension, count LAW_WEIGHT times.

Law: `bytes`, sizes near equal. Defined results: a null text has size 16 and no bytes, its checksum is that of the empty
text; nulls are one group, apart from empty texts; repeated rows and ids, and null ids, keep a row each; an empty table
gives no rows. Slots run from 0 without gaps in each shard, by item, then doc_id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodefall.llm.common import SPACE, cut, words

OVERHEAD = 16
#: Light groups share this many bundles; a heavy group has over 1/HEAVY of a shard's share.
BUNDLES, HEAVY, CHUNKS = 16_384, 256, 32
LAW_WEIGHT = 4.0


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; `vectors` has its bytes, tokens and rows in units of a shard's share."""
    out = np.zeros(len(vectors), np.int64)
    residual, weighted = np.ones((shards, vectors.shape[1])), vectors * [LAW_WEIGHT, 1.0, 1.0]
    for i in np.lexsort((np.arange(len(vectors)), -vectors.sum(axis=1))):
        out[i] = int(np.argmax(residual @ weighted[i]))
        residual[out[i]] -= vectors[i]
    return out


def shards(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law), a row per row of `docs`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.size(words(F.col("text"), SPACE)).cast("long").alias("tokens"),
            F.unhex(F.coalesce(F.md5("text"), F.lit(""))).alias("digest"),
        )
    ).withColumn("rid", F.monotonically_increasing_id())  # stable: the rows are read back from the checkpoint
    weights = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    groups = cut(rows.groupBy("digest").agg(*weights))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).first()
    share = {k: max(1, total[k] or 0) / n_shards for k in ("bytes", "tokens", "n")}
    load = F.greatest(*(F.col(k) / F.lit(float(v)) for k, v in share.items()))
    # bounded: each has over 1/(n_shards * HEAVY) of one of three totals
    heavy = groups.where(load * HEAVY > 1).select("digest", (load <= 1).alias("whole"), F.least(F.ceil(load * CHUNKS), F.col("n")).alias("chunks")).orderBy("digest").collect()
    at, known, owner = BUNDLES, [], {}
    for x in heavy:
        known.append((x["digest"], at, x["chunks"]))
        owner |= dict.fromkeys(range(at, at + x["chunks"]), at) if x["whole"] else {}
        at += x["chunks"]
    heavy_df = spark.createDataFrame(known, "heavy_digest binary, first long, chunks long")
    chunk = F.col("first") + F.pmod(F.xxhash64("doc_id", "rid"), F.col("chunks"))
    items = rows.join(F.broadcast(heavy_df), F.col("digest") == F.col("heavy_digest"), "left").select(
        "doc_id", "size", "text_crc32", "tokens", "rid", F.coalesce(chunk, F.pmod(F.xxhash64("digest"), F.lit(BUNDLES))).alias("item")
    )
    # bounded: at most BUNDLES bundles and the chunks of the heavy groups
    loads = items.groupBy("item").agg(*weights).orderBy("item").collect()
    owners = sorted({owner.get(x["item"], x["item"]) for x in loads})
    vectors = np.zeros((len(owners), 3))
    np.add.at(vectors, np.searchsorted(owners, [owner.get(x["item"], x["item"]) for x in loads]), np.array([[x[k] / share[k] for k in share] for x in loads]).reshape(-1, 3))
    placed, filled, where = dict(zip(owners, pack(vectors, n_shards).tolist(), strict=True)), [0] * n_shards, []
    for x in loads:
        shard = placed[owner.get(x["item"], x["item"])]
        where.append((x["item"], shard, filled[shard]))
        filled[shard] += x["n"]
    places = spark.createDataFrame(where, "item long, shard int, start long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("doc_id", "rid"))
    numbered = items.withColumn("rank", rank)
    return numbered.join(F.broadcast(places), "item").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
