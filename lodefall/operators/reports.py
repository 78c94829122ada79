"""Reports on files: by root and folder, the largest, staleness against a scan, recall of expected paths, and their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses that are reported by root and by folder, and the points of the staleness score.
STATUSES = ("DISCOVERED", "EXTRACTED", "INDEXED", "FAILED")
#: Groups of extensions.
GROUPS = {
    "pdf": ("pdf",), "word": ("doc", "docx"), "excel": ("xls", "xlsx", "csv"), "ppt": ("ppt", "pptx"), "cad": ("dwg", "dxf", "dgn"), "bim": ("rvt", "rfa", "ifc", "nwd", "nwc"),
    "image": ("jpg", "jpeg", "png", "gif", "tif", "tiff", "bmp"), "video": ("mp4", "mov", "avi", "mkv"), "text": ("txt", "md", "rst"), "archive": ("zip", "rar", "7z"), "email": ("msg", "eml"),
}


def by_root(files: DataFrame, roots: list[str], path: str = "file_path") -> DataFrame:
    """root and a count per status for each root; a file counts for every root that begins its path, statuses that aren't
    reported count nowhere. All roots are counted in one pass over the files."""
    starts = {f"r{k}_{s}": F.count_if(F.startswith(path, F.lit(r)) & (F.col("status") == s)) for k, r in enumerate(roots) for s in STATUSES}
    counted = files.agg(*(v.alias(k) for k, v in starts.items()))
    rows = F.array(*(F.struct(F.lit(r).alias("root"), *(F.col(f"r{k}_{s}").alias(s) for s in STATUSES)) for k, r in enumerate(roots)))
    return counted.select(F.inline(rows))


def largest(files: DataFrame, path: str, size: str, n: int = 20) -> DataFrame:
    """path and mb of the n largest files."""
    return files.orderBy(F.desc(size), path).limit(n).select(path, F.round(F.col(size) / (1 << 20), 2).alias("mb"))


def group_of(ext: Column) -> Column:
    """The group of an extension, `other` for those in none."""
    return F.coalesce(*(F.when(F.lower(ext).isin(*exts), name) for name, exts in GROUPS.items()), F.lit("other"))


def stale(files: DataFrame, scan: DataFrame, events: DataFrame, now: Column, path: str = "file_path") -> DataFrame:
    """One row: files_indexed, files_missing (indexed, but not in the scan; counted over all, not estimated), files_new, days
    since the last indexing, staleness_score and recommendation."""
    indexed = files.where("status = 'INDEXED'").select(path)
    both = indexed.withColumn("_i", F.lit(True)).join(scan.select(path).withColumn("_s", F.lit(True)), path, "full")
    counts = both.agg(F.count("_i").alias("files_indexed"), F.count_if(F.col("_s").isNull()).alias("files_missing"), F.count_if(F.col("_i").isNull()).alias("files_new"))
    last = events.where("event_type = 'INDEXED'").agg(F.max("ts").alias("_last"))
    rate = F.col("files_missing") / F.greatest("files_indexed", F.lit(1))
    days = F.datediff(now, F.col("_last"))
    age = F.when(F.col("_last").isNull(), 0.5).otherwise(F.when(days > 7, 0.2).otherwise(0.0) + F.when(days > 30, 0.3).otherwise(0.0))
    score = F.least(age + F.when(rate > 0.1, 0.2).otherwise(0.0) + F.when(rate > 0.02, 0.1).otherwise(0.0), F.lit(1.0))
    rows = counts.crossJoin(F.broadcast(last)).withColumns({"days": days, "staleness_score": F.round(score, 3)})  # one row each
    advice = F.when(F.col("staleness_score") < 0.2, "fresh").when(F.col("staleness_score") < 0.5, "run incremental").otherwise("run rebuild")
    return rows.select("files_indexed", "files_missing", "files_new", "days", "staleness_score", advice.alias("recommendation"))


def sampled(files: DataFrame, key: str, n: int = 500) -> DataFrame:
    """n of the indexed files: those with the least hashes, so that it is the same sample each time."""
    return files.where("status = 'INDEXED'").orderBy(F.xxhash64(key), key).limit(n)


def hit(returned: Column, expected: Column) -> Column:
    """Whether one of the returned paths ends with, or holds, one of the expected ones (with either slash)."""
    slashed = lambda x: F.replace(x, F.lit("\\"), F.lit("/"))
    return F.coalesce(F.exists(expected, lambda e: F.exists(returned, lambda r: F.contains(slashed(r), slashed(e)))), F.lit(False))


def recall(answers: DataFrame, returned: str, expected: str, by: str) -> DataFrame:
    """by (null for all), queries, hits and recall of the answers' paths (arrays)."""
    found = answers.withColumn("_hit", hit(F.col(returned), F.col(expected)).cast("long"))
    return found.rollup(by).agg(F.count("*").alias("queries"), F.sum("_hit").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("queries"), 4))


def scan_text(stats: DataFrame, top: int = 20, width: int = 30) -> DataFrame:
    """rank and line of a text that shows extensions (ext, files, bytes) by size: group, files, megabytes, share and a bar; the
    rest as one line. `stats` has a row per extension."""
    rank = F.row_number().over(Window.orderBy(F.desc("bytes"), "ext"))
    named = stats.withColumn("_r", F.least(rank, F.lit(top + 1)))
    rows = named.groupBy("_r").agg(F.min("ext").alias("ext"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
    total = stats.agg(F.sum("bytes").alias("_all"))
    share = F.col("bytes") / F.greatest("_all", F.lit(1))
    full = F.round(share * width).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))
    name = F.when(F.col("_r") > top, "… other").otherwise(F.concat(group_of(F.col("ext")), F.lit(" "), F.col("ext")))
    line = F.format_string("%s | %s files | %s MB | %s %% | %s", name, F.format_number("files", 0), F.format_number(F.col("bytes") / (1 << 20), 1), F.format_number(share * 100, 1), bar)
    return rows.crossJoin(F.broadcast(total)).select(F.col("_r").alias("rank"), line.alias("line"))


def explained(mode: Column, tags: Column, scores: dict[str, Column]) -> Column:
    """Why a question was routed as it was, in words."""
    known = F.coalesce(F.nullif(F.array_join(F.array_sort(tags), ","), F.lit("")), F.lit("none"))
    parts = reduce(lambda a, b: a + b, ([F.lit(", " if k else ""), F.lit(f"{name}="), F.format_number(v, 2)] for k, (name, v) in enumerate(scores.items())))
    return F.concat(F.lit("mode="), mode, F.lit(" concepts=["), known, F.lit("] ("), *parts, F.lit(")"))
