"""Answers to routed questions from cards and files, with filters that reach the scan, and what to say without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files and cards shown, and what confidence an answer has.
FILES, LISTED, MATCHED = 30, 10, 15
NONE, FOUND, ACROSS, FEW, MANY = 0.3, 0.9, 0.85, 0.7, 1.0


def located(files: DataFrame, filters: dict, limit: int = FILES) -> DataFrame:
    """The indexed files that all filters let through, the latest first, and the answer's confidence. A code matches the
    code or lies in the project_id; files without a date pass every range of dates."""
    rows = files.where(F.col("status") == "INDEXED")
    if code := filters.get("project_code"):
        rows = rows.where((F.col("project_code") == code) | F.col("project_id").ilike(f"%{code}%"))
    for c in ("content_type", "folder_stage"):
        if c in filters:
            rows = rows.where(F.col(c) == filters[c])
    for c in ("is_issued", "is_superseded", "is_latest"):
        if c in filters:
            rows = rows.where(F.col(c) == int(filters[c]))
    if "date_from" in filters:
        rows = rows.where((F.col("file_date") >= F.lit(filters["date_from"])) | F.col("file_date").isNull())
    if "date_to" in filters:
        rows = rows.where((F.col("file_date") <= F.lit(filters["date_to"])) | F.col("file_date").isNull())
    sure = MANY if len(filters) >= 2 else FEW
    return rows.orderBy(F.desc("is_latest"), F.desc("file_date"), F.desc("revision"), "file_id").limit(limit).withColumn("confidence", F.lit(sure))


def matching(cards: DataFrame, filters: dict) -> DataFrame:
    """Cards by typology, stage, least and most floor area, and part of the location."""
    tests = {
        "typology": lambda v: F.col("typology_primary") == v,
        "stage": lambda v: F.col("stage") == v,
        "gfa_min": lambda v: F.col("gfa_sqm") >= float(v),
        "gfa_max": lambda v: F.col("gfa_sqm") <= float(v),
        "location": lambda v: F.col("location").ilike(f"%{v}%"),
    }
    for name, test in tests.items():
        if filters.get(name) is not None:
            cards = cards.where(test(filters[name]))
    return cards


def listed(cards: DataFrame, filters: dict, show: int = LISTED, sure: float = FOUND) -> DataFrame:
    """One row: how many cards match, the lines of the first `show` by code, and the confidence. The count and the first
    ones are combined in the tasks; no group is gathered."""
    found = matching(cards, filters)
    line = F.concat(F.col("project_code"), F.lit(": "), F.coalesce("name", F.lit("unnamed")), F.lit(" ("), F.coalesce("typology_primary", F.lit("?")), F.lit(", "), F.coalesce("stage", F.lit("?")), F.lit(")"))
    top = found.select("project_code", line.alias("line")).orderBy("project_code").limit(show)
    lines = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("project_code", "line"))), lambda x: x["line"]), "\n").alias("answer"))
    return found.agg(F.count("*").alias("n")).crossJoin(F.broadcast(lines)).withColumn("confidence", F.when(F.col("n") > 0, sure).otherwise(NONE))  # one row each


def across(cards: DataFrame, filters: dict) -> DataFrame:
    """listed() for questions about several projects."""
    return listed(cards, filters, MATCHED, ACROSS)


def fallback(mode: Column, content_type: Column, root: Column) -> Column:
    """Where to look by hand when an answer is missing or doubtful."""
    kind = F.coalesce(content_type, F.lit(""))
    say = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs))
    return (
        F.when(kind.isin("BIM", "CAD"), say("Look in the ", kind, " folder of ", root))
        .when(kind.isin("Render Scene", "Image"), say("Look in the folders of images and presentations of ", root))
        .when(kind == "Minutes", say("Look for the minutes among the documents of ", root))
        .when(kind == "Transmittal", say("Look for transmittals among what ", root, " sent out"))
        .when(mode == "file_locator", say("No file matched; the index may be old. Look in ", root))
        .when(mode == "semantic", say("The confidence is low; try other words or look in ", root))
    )


def extract(ranked: DataFrame, by: str, rank: str, text: str, top: int = 3, most: int = 600) -> DataFrame:
    """by and answer: the first texts of each question, in order, cut to `most` characters. Used where no model answers."""
    few = ranked.where(F.col(rank) <= top).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank), F.left(text, F.lit(most)).alias("t")))).alias("_ts"))
    return few.select(by, F.left(F.array_join(F.transform("_ts", lambda x: x["t"]), " … "), F.lit(most)).alias("answer"))


def file_search(files: DataFrame, text: str, chunks: DataFrame, feedback: DataFrame, limit: int = 10) -> DataFrame:
    """Files whose name or path has the text, with their chunks and good and bad ratings. Both sides are counted only for
    the files found."""
    found = files.where(F.contains(F.lower("file_name"), F.lit(text.lower())) | F.contains(F.lower("file_path"), F.lit(text.lower()))).orderBy("file_id").limit(limit)
    keys = F.broadcast(found.select("file_id"))  # at most `limit` rows
    n = chunks.join(keys, "file_id", "left_semi").groupBy("file_id").agg(F.count("*").alias("chunks"))
    rated = feedback.withColumnRenamed("result_id", "file_id").join(keys, "file_id", "left_semi").groupBy("file_id").agg(F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"))
    return found.join(n, "file_id", "left").join(rated, "file_id", "left").fillna(0, ["chunks", "positive", "negative"])


def first_texts(files: DataFrame, chunks: DataFrame, order: str) -> DataFrame:
    """Each file with the text of its first chunk, null without one."""
    return files.join(chunks.groupBy("file_id").agg(F.min_by("text", order).alias("first_text")), "file_id", "left")


def mixed(files: DataFrame, folders: DataFrame, score: str, name: str) -> DataFrame:
    """Files and folders in one ranking."""
    both = files.select(F.lit("file").alias("kind"), name, score).unionByName(folders.select(F.lit("folder").alias("kind"), name, score))
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "kind", name)))  # results of one question


def history(messages: DataFrame, session: str, order: list[Column], n: int = 6) -> DataFrame:
    """The last n messages of each session, numbered from the oldest of them (place 1)."""
    last = messages.withColumn("_r", F.row_number().over(Window.partitionBy(session).orderBy(*order))).where(F.col("_r") <= n)
    return last.withColumn("place", F.max("_r").over(Window.partitionBy(session)) + 1 - F.col("_r")).drop("_r")


def per_project(files: DataFrame, limit: int = 20) -> DataFrame:
    """Indexed files by project code, the first `limit` codes."""
    known = files.where("status = 'INDEXED' AND project_code IS NOT NULL")
    return known.groupBy("project_code").agg(F.count("*").alias("files_indexed")).orderBy("project_code").limit(limit)
