"""Evaluation of routing and retrieval: accuracies, gates, citations, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.operators.analytics import percentiles

#: Least accuracy of the routing, results looked at.
GATE, TOP = 0.85, 5


def accuracy(answers: DataFrame, by: str, right: Column, gate: float = GATE) -> DataFrame:
    """by (null for all), questions, right, accuracy and passed: every category and the whole in one aggregation."""
    whole = answers.withColumn("_right", F.coalesce(right, F.lit(False)).cast("long")).rollup(by).agg(F.count("*").alias("questions"), F.sum("_right").alias("right"))
    return whole.withColumn("accuracy", F.round(F.col("right") / F.col("questions"), 4)).withColumn("passed", F.col("right") / F.col("questions") >= gate)


def summary(answers: DataFrame, by: str, right: Column, results: Column, ms: str) -> DataFrame:
    """accuracy() with the answers that have results and the mean, median and 95th percentile of the latency."""
    whole = answers.groupBy(by).agg(
        F.count("*").alias("questions"),
        F.count_if(right).alias("right"),
        F.count_if(results > 0).alias("with_results"),
        F.round(F.avg(ms), 1).alias("mean_ms"),
    )
    ranks = percentiles(answers, ms, [by]).withColumnRenamed(by, "_by")
    return whole.join(ranks, whole[by].eqNullSafe(ranks["_by"])).select(*whole.columns, *(F.round(c, 1).alias(f"{c}_ms") for c in ("p50", "p95")))


def cited(citations: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (file_id, ref) with `valid`: the file exists and has that chunk."""
    known = chunks.join(files.select("file_id"), "file_id", "left_semi").select("file_id", "ref").distinct().withColumn("_known", F.lit(True))
    return citations.join(known, ["file_id", "ref"], "left").withColumn("valid", F.coalesce("_known", F.lit(False))).drop("_known")


def validity(marked: DataFrame) -> DataFrame:
    """One row: citations, invalid ones, valid percent (100 without any) and whether none is invalid."""
    counted = marked.agg(F.count("*").alias("citations"), F.count_if(~F.col("valid")).alias("invalid"))
    share = F.when(F.col("citations") > 0, F.round((1 - F.col("invalid") / F.col("citations")) * 100, 2)).otherwise(100.0)
    return counted.withColumn("valid_percent", share).withColumn("passed", F.col("invalid") == 0)


def smoke(results: DataFrame, by: str, rank: str, text: Column, keywords: Column, top: int = TOP) -> DataFrame:
    """by and hit: whether one of the first results has a keyword of the question."""
    has = F.exists(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))
    return results.groupBy(by).agg(F.coalesce(F.bool_or(F.when(F.col(rank) <= top, has)), F.lit(False)).alias("hit"))


def unanswered(queries: DataFrame, question: str, tags: Column, order: str, last: int = 200, top: int = 30) -> DataFrame:
    """Of the last logged questions those without a concept, the most frequent first."""
    recent = queries.orderBy(F.desc(order)).limit(last)
    return recent.where(F.size(tags) == 0).groupBy(question).agg(F.count("*").alias("n")).orderBy(F.desc("n"), question).limit(top)
