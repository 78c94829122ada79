"""Names and extensions of paths, the lane of a file, taxonomies as rows, and how likely a folder is a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions whose text is read.
TEXT_EXTENSIONS = ("pdf", "doc", "docx", "txt", "md", "pptx", "ppt", "xlsx", "xls", "eml")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def lane(ext: Column) -> Column:
    return F.when(ext.isin(*TEXT_EXTENSIONS), "TEXT_EXTRACTABLE").otherwise("METADATA_ONLY")


def taxonomy(spark: SparkSession, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """kind, ordinal and synonym: a few rows from a constant."""
    rows = [(kind, k, x) for k, (kind, x) in enumerate((kind, x) for kind, xs in terms.items() for x in xs)]
    return spark.createDataFrame(rows, "kind string, ordinal int, synonym string")


def infer(path: Column, patterns: list[tuple[str, float]], boosts: list[tuple[str, float]], threshold: float = 0.5, sibling: Column | None = None, override: Column | None = None) -> Column:
    """The confidence of a project folder: summed weights of patterns and keywords and its siblings' score, 1 at most, 0 below
    the threshold; 1 where an override names the project."""
    total = F.lit(0.0) if sibling is None else F.coalesce(sibling, F.lit(0.0))
    for pattern, weight in patterns:
        total = total + F.when(path.rlike(pattern), weight).otherwise(0.0)
    for word, weight in boosts:
        total = total + F.when(F.contains(F.lower(path), F.lit(word)), weight).otherwise(0.0)
    total = F.round(F.least(total, F.lit(1.0)), 4)
    found = F.when(total >= threshold, total).otherwise(0.0)
    return found if override is None else F.when(override.isNotNull(), 1.0).otherwise(found)
