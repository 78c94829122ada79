"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words: A-Z in lower case, runs of characters other than ASCII non-alphanumerics. A window is 10 consecutive words of an
item; an item of fewer words, but not none, is one window. A window occurs in a document only if all of its shingles
(3 words; fewer where the window is shorter) do, so one necessary shingle per window is enough to find every occurrence:
with containment 1 the prefix has length 1. Shingles are ordered by their frequency in the documents, and the rarest is
each window's prefix. What its postings join is bounded by position (the window must start and end inside the document) and
length, and is then verified word by word at that place, over the window's own length.

Shingles are joined by 64-bit hashes; since every candidate is verified on words, a collision changes nothing. Benchmark-sized sides are
broadcast only after their rows were counted; beyond that the same joins shuffle. Defined results: null and empty texts
have no words; windows of null item_ids are hit, but count as no item's; repeated rows get a row each; empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import BROADCAST_ROWS, bounded, cut, fold, join_docs, let, sieved, small, text_hash, words

WINDOW, SHINGLE = 10, 3
#: Shingles of windows up to which they are broadcast themselves; beyond it a bitmap of them is, and then they are joined.
FEW = BROADCAST_ROWS
#: What separates words, in texts whose A-Z is in lower case, and in texts as they are.
BREAKS, BREAKS_RAW = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return words(fold(text), BREAKS)


def shingles(found: Column, k: int) -> Column:
    """A hash of k words from each place on; at the last k - 1 places of fewer."""
    return F.transform(found, lambda w, i: F.xxhash64(w, *(F.get(found, i + j) for j in range(1, k))))


def windows(benchmark: DataFrame) -> DataFrame:
    """item_id, wtext (the window's words, space-joined) and len, distinct."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - WINDOW, F.lit(0)))
    cutouts = let(F.col("ws"), lambda ws: F.transform(starts, lambda s: F.slice(ws, s + 1, F.lit(WINDOW))))
    return items.select("item_id", F.explode(cutouts).alias("w")).select("item_id", F.array_join("w", " ").alias("wtext"), F.size("w").alias("len")).distinct()


def window_shingles(distinct_windows: DataFrame) -> DataFrame:
    """wtext, len, off and h for each shingle of each window."""
    ws = F.split("wtext", " ")
    n = F.least(F.lit(SHINGLE), F.col("len"))
    hashes = let(ws, lambda w: F.when(n == 1, shingles(w, 1)).when(n == 2, shingles(w, 2)).otherwise(shingles(w, SHINGLE)))
    return distinct_windows.select("wtext", "len", F.posexplode(F.slice(hashes, F.lit(1), F.col("len") - n + 1)).alias("off", "h"))


def postings(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, th, nw, pos and h for each shingle of each document, for shingles of each of `sizes` words."""
    each = lambda ws: F.flatten(F.array(*(shingles(ws, k) for k in sizes)))
    parts = let(item_words(F.col("text")), lambda ws: F.struct(F.size(ws).alias("nw"), each(ws).alias("hs")))
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), parts.alias("p"))
    flat = rows.select("doc_id", "th", F.col("p.nw").alias("nw"), F.posexplode("p.hs").alias("at", "h"))
    return flat.select("doc_id", "th", "nw", F.pmod("at", "nw").alias("pos"), "h")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_hit, n_items and items_sha256 for each document with an occurrence of a window."""
    found = cut(windows(benchmark))
    marks = cut(window_shingles(found.select("wtext", "len").distinct()))
    sizes = [x["k"] for x in marks.select(F.least(F.lit(SHINGLE), F.col("len")).alias("k")).distinct().orderBy("k").collect()]  # 3 rows at most
    wanted, rows = cut(marks.select("h").distinct()), postings(docs, sizes or [SHINGLE])
    if small(wanted, FEW):
        matched = cut(rows.join(F.broadcast(wanted), "h"))
    else:  # a bitmap lets few postings but the wanted ones through to the shuffle
        matched = cut(sieved(rows, F.col("h"), wanted, F.col("h"), "__lodefall_met").where("__lodefall_met").drop("__lodefall_met").join(wanted, "h"))
    # the rarest shingle of each window; one that no document has rules the window out
    counts = matched.groupBy("h").agg(F.count("*").alias("n"))
    rarity = marks.join(bounded(cut(counts)), "h", "left").groupBy("wtext", "len")
    prefix = rarity.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "h")).alias("r")).where("r.n > 0")
    prefix = bounded(cut(prefix.select("wtext", "len", "r.off", "r.h")))
    start = F.col("pos") - F.col("off")
    candidates = matched.join(prefix, "h").select("doc_id", "th", "nw", start.alias("start"), "len", "wtext")
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("nw")))
    # each window's text once a document, with its places
    by_window = candidates.groupBy("doc_id", "th", "wtext", "len").agg(F.collect_set("start").alias("starts"))
    by_doc = cut(by_window.groupBy("doc_id", "th").agg(F.collect_list(F.struct("wtext", "len", "starts")).alias("cs")))
    # only documents with a candidate give their words; the side that names them is broadcast if it is small
    hashed = docs.select("doc_id", "text", text_hash(F.col("text")).alias("th"))
    named = by_doc.select("doc_id", "th")
    texts = join_docs(hashed, F.broadcast(named) if small(named) else named, "left_semi").dropDuplicates(["doc_id", "th"])
    texts = texts.select("doc_id", "th", item_words(F.col("text")).alias("ws"))
    both = join_docs(texts, by_doc, "inner")
    held = lambda ws, c: F.filter(c["starts"], lambda s: F.array_join(F.slice(ws, s + 1, c["len"]), " ") == c["wtext"])
    true = let(F.col("ws"), lambda ws: F.filter(F.transform("cs", lambda c: F.struct(c["wtext"].alias("wtext"), c["len"].alias("len"), held(ws, c).alias("starts"))), lambda c: F.size(c["starts"]) > 0))
    verified = cut(both.select("doc_id", "th", true.alias("cs")).where(F.size("cs") > 0))
    spans = F.flatten(F.transform("cs", lambda c: F.transform(c["starts"], lambda s: F.struct(s.alias("s"), (s + c["len"]).alias("e")))))
    reach = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    of_window = bounded(found.select("item_id", "wtext"))
    owners = verified.select("doc_id", "th", F.explode(F.transform("cs", lambda c: c["wtext"])).alias("wtext")).join(of_window, "wtext")
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    items = owners.groupBy("doc_id", "th").agg(names.alias("names"))
    counted = verified.select("doc_id", "th", reach.alias("n_hit"))
    return join_docs(counted, items, "inner").select(
        "doc_id", "th", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, a row per row of `docs`."""
    n_words = F.size(words(F.col("text"), BREAKS_RAW)).cast("long")
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), n_words.alias("n_words"))
    found = bounded(cut(hits(docs, benchmark)))
    return join_docs(rows, found, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no window occurs."""
    found = cut(hits(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")))
    found = bounded(found)
    hashed = docs.withColumn("__lodefall_th", text_hash(F.col("text")))
    match = hashed["doc_id"].eqNullSafe(found["hit_id"]) & (hashed["__lodefall_th"] == found["hit_th"])
    return hashed.join(found, match, "left_anti").drop("__lodefall_th")
