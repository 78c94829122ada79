"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z in lower case, words between ASCII white space, 3-word shingles with repeats (a shorter text is one
shingle, an empty or null text has fingerprint zero); a bit is 1 if it is set in over half of the shingles' XXH64.

Links: two fingerprints at Hamming distance at most 3 agree up to one bit in one of their 32-bit halves. The anchors are
the codewords of the perfect [31, 26] Hamming code, whose covering radius is 1: every half lies within 1 of exactly one
codeword, its home, and whatever differs from it in at most 1 bit lies within 1 + 1 = 2 of that home. So each fingerprint
is replicated, for either half, to every codeword within 2 (16, or 1 where the half is a codeword), and is compared
with the fingerprints whose home is that codeword. No pair within the threshold can be missed.

Copies are gathered into one row per fingerprint before that, so the size of a group of equal texts doesn't matter. An
anchor with many homes is compared in tiles that give a spanning forest, not pairs: at most one edge per fingerprint.
Defined results: repeated rows and equal ids are kept, one output row each; a null doc_id gets a row and is no
component's smallest id unless the component has no other (then component_id is null).
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodefall.llm.common import bounded, cut, map_batches, ship, sieved, text_hash
from lodefall.llm.components import components

SEED, SHINGLE, BITS, THRESHOLD = 42, 3, 64, 3
#: Hashes whose bits are added up at once.
BLOCK = 1 << 16


def simhash(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = list(map(b" ".join, zip(*(found[k:] for k in range(SHINGLE))))) if len(found) >= SHINGLE else [b" ".join(found)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        block = hashes[at : at + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text) and fp, a row per row of `docs`."""

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [simhash(x) for x in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    return map_batches(docs.select("doc_id", "text", text_hash(F.col("text")).alias("th")), body, "doc_id long, th long, fp long")


def half(fp: Column, block: int) -> Column:
    """31 bits of a 32-bit half."""
    return F.shiftrightunsigned(fp, 32 * block).bitwiseAND(F.lit((1 << 31) - 1))


def syndrome(x: Column) -> Column:
    """Exclusive or of the places (1 to 31) of the set bits."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, 32) if place >> k & 1)
        total = total + F.bit_count(x.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * F.lit(1 << k)
    return total


def flip(x: Column, place: Column) -> Column:
    """`x` with the bit at `place` (1 to 31; 0 for none) flipped."""
    return x.bitwiseXOR(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))).otherwise(F.lit(0).cast("long")))


def replicas(classes: DataFrame) -> DataFrame:
    """block, anchor, fp, node and home (whether the anchor is the fingerprint's nearest), for both halves."""
    parts = []
    for block in (0, 1):
        rows = classes.select("fp", "node", half(F.col("fp"), block).alias("x")).withColumn("s", syndrome(F.col("x")))
        pairs = F.transform(
            F.sequence(F.lit(1), F.lit(31)),
            lambda a: F.when(
                (F.col("s") > 0) & (a < a.bitwiseXOR(F.col("s"))) & (a != F.col("s")),
                flip(flip(F.col("x"), a), a.bitwiseXOR(F.col("s"))),
            ),
        )
        anchors = F.concat(
            F.array(F.struct(flip(F.col("x"), F.col("s")).alias("anchor"), F.lit(True).alias("home"))),
            F.transform(F.array_compact(pairs), lambda c: F.struct(c.alias("anchor"), F.lit(False).alias("home"))),
        )
        parts.append(rows.select(F.lit(block).alias("block"), "fp", "node", F.inline(anchors).alias("anchor", "home")))
    return parts[0].unionByName(parts[1])


#: Homes above which an anchor is compared in tiles of at most about TILE fingerprints instead of by the join.
HOT, TILE = 64, 16_384
#: Rows of a tile whose distances to the others are computed at once (8 MB for two tiles).
STRIP = 32


def spanning(fps: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each fingerprint (sorted, distinct) the first one of its component, where homes link to all within reach."""
    label, unsigned = np.arange(len(fps)), fps.view(np.uint64)
    own = np.flatnonzero(home)
    for at in range(0, len(own), STRIP):
        strip = own[at : at + STRIP]
        near = np.bitwise_count(unsigned[strip][:, None] ^ unsigned[None, :]) <= THRESHOLD
        for row in near:
            met = np.unique(label[row])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def tiled(hot_rows: DataFrame) -> DataFrame:
    """Edges between the fingerprints of hot anchors: every pair of tiles is a group of its own, of bounded size, and
    gives at most one edge per fingerprint."""

    def body(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        fps, home = group["fp"].to_numpy(), group["home"].to_numpy()
        order = np.lexsort((~home, fps))  # homes first
        order = order[np.r_[True, np.diff(fps[order]) != 0]]
        label = spanning(fps[order], home[order])
        moved = np.flatnonzero(label != np.arange(len(label)))
        sides = [group.select(["n", "id", "fp"]).take(order[at]).columns for at in (label[moved], moved)]
        return pa.Table.from_arrays([*sides[0], *sides[1]], ["n_a", "id_a", "fp_a", "n_b", "id_b", "fp_b"])

    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = (
        hot_rows.withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("block", "anchor", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "home", "node.n", "node.id", "fp")
    )
    ship(hot_rows.sparkSession)
    edges = pairs.groupBy("block", "anchor", "i", "j").applyInArrow(body, "n_a boolean, id_a long, fp_a long, n_b boolean, id_b long, fp_b long")
    node = lambda k: F.struct(F.col(f"n_{k}").alias("n"), F.col(f"id_{k}").alias("id"), F.col(f"fp_{k}").alias("fp")).alias(k)
    return edges.select(node("a"), node("b"))


def links(classes: DataFrame) -> DataFrame:
    """Edges a, b between the nodes of distinct fingerprints; their components are those of all pairs within reach."""
    rows = replicas(classes)
    homes = rows.where("home").select("block", "anchor", "fp", "node")
    hot = cut(homes.groupBy("block", "anchor").count().where(F.col("count") > HOT).select("block", "anchor"))
    some_hot = hot.limit(1).count() > 0
    plain = rows.join(bounded(hot), ["block", "anchor"], "left_anti") if some_hot else rows
    left, right = plain.where("home").alias("x"), plain.alias("y")
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= THRESHOLD
    edges = left.join(right, (F.col("x.block") == F.col("y.block")) & (F.col("x.anchor") == F.col("y.anchor")) & (F.col("x.fp") < F.col("y.fp")) & close)
    edges = edges.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    if some_hot:
        in_hot = rows.join(bounded(hot), ["block", "anchor"])
        sizes = in_hot.groupBy("block", "anchor").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
        edges = edges.unionByName(tiled(in_hot.join(bounded(cut(sizes)), ["block", "anchor"])))
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per row of `docs` (doc_id, text): doc_id, th, fingerprint (16 hex digits), component_id and keep.

    component_id is the smallest doc_id of the rows that links reach. keep marks the row of the component that stays:
    that of the smallest doc_id (nulls last, then the smallest text hash).
    """
    rows = cut(fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("th").alias("th")))
    classes = cut(rows.groupBy("fp").agg(first.alias("first")).select("fp", "first", F.struct("first.n", "first.id", "fp").alias("node")))
    found = components(links(classes))
    # a component's root is the node with the smallest doc_id; only that node's own first row is kept
    joined = classes.join(found, classes["node"] == found["node"], "left").select(
        "fp",
        F.coalesce(F.col("root.id"), F.col("first.id")).alias("component_id"),
        F.when(F.col("root").isNull() | (F.col("root") == classes["node"]), F.col("first")).alias("kept"),
    )
    joined = cut(joined).withColumnRenamed("fp", "class_fp")
    out = rows.join(joined, rows["fp"] == joined["class_fp"])
    return out.select(
        "doc_id",
        "th",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        (F.col("kept").isNotNull() & F.col("doc_id").eqNullSafe(F.col("kept.id")) & (F.col("th") == F.col("kept.th"))).alias("keep"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that stay: one of each component; of several rows with its doc_id and text the one
    whose other columns come first as JSON (equal JSON: any of them).

    The decision is made on (doc_id, text hash) alone. Whole rows are shuffled only where a bitmap of the keys that lose a row
    holds their hash: those rows and few others. All other rows stay where they are read.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    decided = near_duplicates(docs).groupBy("doc_id", "th").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    # keys whose rows don't all stay; `keep` tells whether one of them does
    again = cut(decided.where("not keep or n > 1").select("doc_id", "th", "keep"))
    th, met_name = "__lodefall_th", "__lodefall_met"
    hashed = docs.withColumn(th, text_hash(F.col("text")))
    met = sieved(hashed, F.xxhash64("doc_id", th), again, F.xxhash64("doc_id", "th"), met_name)
    # rows that the filter holds: without a key they stay, else one of a kept key does
    keys = bounded(again.select(F.col("doc_id").alias("__lodefall_id"), F.col("th").alias("__lodefall_right"), F.col("keep").alias("__lodefall_keep")))
    match = F.col("doc_id").eqNullSafe(F.col("__lodefall_id")) & (F.col(th) == F.col("__lodefall_right"))
    looked = met.where(met_name).join(keys, match, "left")
    free = looked.where("__lodefall_keep is null").select(*docs.columns)
    order = F.to_json(F.struct(*own)) if own else F.lit("")
    one = looked.where("__lodefall_keep").groupBy("doc_id", th).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return met.where(~F.col(met_name)).select(*docs.columns).unionByName(free).unionByName(one)
