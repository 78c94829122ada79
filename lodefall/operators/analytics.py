"""Operational analytics: status, feedback, profiles, percentiles, staleness, conventions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_pivot(df: DataFrame, by: str, status: str, values: list[str]) -> DataFrame:
    """A row per value of `by` ('other' for the empty one), a column of counts per status. The statuses are given, so
    nothing is scanned to find them."""
    name = F.when(F.coalesce(F.col(by), F.lit("")) == "", "other").otherwise(F.col(by))
    return df.groupBy(name.alias(by)).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values), F.count("*").alias("total"))


def feedback(df: DataFrame, by: str, rating: Column) -> DataFrame:
    """Positive and negative ratings by query, their share, and whether over half are negative."""
    out = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(rating == 1).alias("pos"), F.count_if(rating == -1).alias("neg"))
    ratio = F.round(F.try_divide(F.col("pos"), F.col("pos") + F.col("neg")), 3)
    return out.select(by, "total", "pos", "neg", ratio.alias("ratio"), (F.col("neg") / F.col("total") > 0.5).alias("flagged"))


def profile(df: DataFrame, folder: str, size: Column, indexable: Column) -> DataFrame:
    """Files, bytes, indexable files, share of all bytes and a size label per folder."""
    out = df.groupBy(folder).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"), F.count_if(indexable).alias("indexable"))
    total = out.agg(F.sum("bytes").alias("all_bytes"))
    label = F.when(F.col("files") < 50, "small").when(F.col("files") < 300, "medium").when(F.col("files") < 2000, "large").otherwise("huge")
    return out.crossJoin(F.broadcast(total)).select(folder, "files", "bytes", "indexable", F.round(F.col("bytes") / F.col("all_bytes"), 6).alias("share"), label.alias("size_label"))


def spaced(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows evenly spaced by rank among few rows (folders, not files)."""
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    size = ranked.agg(F.count("*").alias("size"))
    step = F.greatest((F.col("size") - 1) / F.lit(max(n - 1, 1)), F.lit(0.0))
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * step).cast("int"))
    return ranked.crossJoin(F.broadcast(size)).where(F.array_contains(picks, F.col("rank"))).drop("size")


#: Rank error of the first look at percentiles, as a share of the rows.
RANK_ERROR, SMALL = 1e-4, 100_000


def percentiles(df: DataFrame, value: str, by: list[str], qs: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact percentiles (p50 and p95) with linear interpolation, and n, by group; null values don't count for them.

    A first pass brackets each rank by a sketch whose error is bounded; a second counts the values inside the brackets by
    value, which leaves a few ten-thousandths of a group to be put in order, however large it is (groups of under SMALL
    rows, where that is less than a rank or two, are looked at whole).
    """
    rows = df.select(*by, F.col(value).alias("_v"))
    ends = [min(1.0, max(0.0, q + side * 2 * RANK_ERROR)) for q in qs for side in (-1, 1)]
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count("_v").alias("_n"), F.percentile_approx("_v", ends, round(1 / RANK_ERROR)).alias("_ends"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = F.flatten(F.array_repeat(F.array("_min", "_max"), len(qs)))
    stats = stats.withColumn("_ends", F.when(F.col("_n") < SMALL, whole).otherwise(F.col("_ends")))
    named = stats.select(*(F.col(c).alias(f"_{c}_") for c in by), "_n", "_ends")
    same = [rows[c].eqNullSafe(named[f"_{c}_"]) for c in by]
    looked = rows.where("_v is not null").join(named, reduce(Column.__and__, same))
    # for each bracket a value inside it as it is, and one below it as null, which comes first
    slot = lambda k: F.when(F.col("_v") <= F.col("_ends")[2 * k + 1], F.struct(F.lit(k).alias("_k"), F.when(F.col("_v") >= F.col("_ends")[2 * k], F.col("_v")).alias("_v")))
    counted = looked.select(*by, F.inline(F.array_compact(F.array(*map(slot, range(len(qs))))))).groupBy(*by, "_k", "_v").agg(F.count("*").alias("_c"))
    last = F.sum("_c").over(Window.partitionBy(*by, "_k").orderBy(F.asc_nulls_first("_v")))
    placed = counted.withColumn("_to", last)
    first = placed.select(*(F.col(c).alias(f"_{c}_") for c in by), "_k", "_v", (F.col("_to") - F.col("_c")).alias("_from"), "_to")
    joined = stats.join(first, reduce(Column.__and__, (stats[c].eqNullSafe(first[f"_{c}_"]) for c in by)), "left")
    at = lambda k, rank: F.max(F.when((F.col("_k") == k) & (F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v").cast("double")))

    def exact(k: int, q: float) -> Column:
        rank = F.lit(q) * (F.col("_n") - 1)
        low, high = at(k, F.floor(rank)), at(k, F.ceil(rank))
        return F.round(low + (high - low) * F.max(rank - F.floor(rank)), 6).alias(f"p{round(100 * q)}")

    return joined.groupBy(*by, "n").agg(*(exact(k, q) for k, q in enumerate(qs))).select(*by, *(f"p{round(100 * q)}" for q in qs), "n")


def staleness(df: DataFrame, by: str, at: Column, now: Column) -> DataFrame:
    """Days since the last event, with its bucket and a score."""
    out = df.groupBy(by).agg(F.max(at).alias("last")).withColumn("days", F.datediff(now, F.col("last")))
    bucket = F.when(F.col("days") <= 7, "fresh").when(F.col("days") <= 30, "aging").otherwise("stale")
    return out.select(by, "days", bucket.alias("bucket"), F.round(F.greatest(1 - F.col("days") / 90, F.lit(0.0)), 4).alias("score"))


def confidence(df: DataFrame, by: str, score: str) -> DataFrame:
    """The mean of the min-max-normalised scores of a group; a constant score counts as it is."""
    out = df.groupBy(by).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.avg(score).alias("mean"))
    value = F.when(F.col("hi") == F.col("lo"), F.col("mean")).otherwise((F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return out.select(by, F.round(value, 6).alias("confidence"))


def extension_stats(df: DataFrame, ext: str, size: Column, top: int) -> DataFrame:
    """Number, bytes and share of the `top` extensions by bytes, and a row `other` for the rest."""
    per = df.groupBy(F.coalesce(F.nullif(F.col(ext), F.lit("")), F.lit("(none)")).alias("ext")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), "ext"))  # a row per extension
    named = per.withColumn("ext", F.when(rank <= top, F.col("ext")).otherwise("other"))
    out = named.groupBy("ext").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    total = out.agg(F.sum("bytes").alias("all_bytes"))
    return out.crossJoin(F.broadcast(total)).select("ext", "files", "bytes", F.round(F.try_divide(F.col("bytes"), F.col("all_bytes")), 6).alias("share"))


def checks(named: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A row per check: its name, the number of rows that fail it, and whether none does."""
    out = None
    for name, (df, fails) in named.items():
        row = df.agg(F.count_if(F.coalesce(fails, F.lit(False))).alias("failing")).select(F.lit(name).alias("check"), "failing", (F.col("failing") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def siblings(df: DataFrame, root: str, folder: str) -> DataFrame:
    """root, folder and 0.15 where over half of a root's folders begin with the same token, else 0."""
    token = F.lower(F.element_at(F.split(folder, r"[-_.\s]+"), 1))
    rows = df.select(root, folder, token.alias("_token")).distinct()
    per = rows.groupBy(root, "_token").agg(F.count("*").alias("_n"))
    total = per.groupBy(root).agg(F.sum("_n").alias("_all"))
    share = per.join(total, root).select(root, "_token", (F.col("_n") / F.col("_all")).alias("_share"))
    score = F.when((F.col("_token") != "") & (F.col("_share") > 0.5), 0.15).otherwise(0.0)
    return rows.join(share, [root, "_token"]).select(root, folder, score.alias("score"))


def segment_audit(df: DataFrame, segments: Column, known: DataFrame, name: str, top: int) -> DataFrame:
    """How often each path segment occurs, and whether the taxonomy knows it; the `top` most frequent of either kind."""
    counts = df.select(F.explode(segments).alias(name)).groupBy(name).agg(F.count("*").alias("n"))
    marked = counts.join(known.select(name).distinct().withColumn("_known", F.lit(True)), name, "left").withColumn("matched", F.coalesce("_known", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("matched").orderBy(F.desc("n"), name))
    return marked.withColumn("_rank", rank).where(F.col("_rank") <= top).select(name, "n", "matched")


def missing_fields(df: DataFrame, key: str, required: list[str], confidence: dict[str, str], least: float = 0.5) -> DataFrame:
    """key and the required fields that are null or inferred with less than `least` confidence."""
    gone = (F.when(F.col(c).isNull() | (F.coalesce(F.col(confidence[c]), F.lit(1.0)) < least if c in confidence else F.lit(False)), c) for c in required)
    return df.select(key, F.array_compact(F.array(*gone)).alias("missing")).where(F.size("missing") > 0)


def card_confidence(sources: Column) -> Column:
    """By where the fields of a record come from (array of source names)."""
    manual = F.exists(sources, lambda s: s == "manual")
    level = F.when(F.forall(sources, lambda s: s == "manual"), 1.0).when(manual, 0.85).when(F.exists(sources, lambda s: s == "web"), 0.75).otherwise(0.55)
    return F.when(F.coalesce(F.size(sources), F.lit(0)) <= 0, 0.3).otherwise(level)
