"""Chunking: sections of a text, splitting of long ones, references and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(*parts: Column) -> Column:
    """Hex SHA-256 of the parts joined by two colons."""
    return F.sha2(F.concat_ws("::", *parts), 256)


#: What parts sections: blank lines, and the line end before a `#` line. Lines end at line feeds alone.
PARTS = r"(?dm)^[ \t\x0B\f\r]*$|\n(?=#)"


def numbered(kind: str, k: Column) -> Column:
    """A reference such as sec01; numbers of over two digits are written out."""
    return F.concat(F.lit(kind), F.when(k < 10, "0").otherwise(""), k.cast("string"))


def parts(text: Column) -> Column:
    """The sections of a text: a `#` line begins one, a blank line ends one; empty ones are left out."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), PARTS), lambda x: F.regexp_replace(x, r"^\n+|\n+$", ""))
    return F.filter(pieces, lambda x: x != "")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, ref (sec01, sec02 ...) and text of each section; each text is cut in its row, and nothing is shuffled."""
    rows = docs.select(key, F.posexplode(parts(F.col(text))).alias("_k", "_text"))
    return rows.select(key, numbered("sec", F.col("_k") + 1).alias("ref"), F.col("_text").alias("text"))


def split_at(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters: what is left whole if it fits, else up to the last blank within them (after the
    first character), else cut hard; white space at the cuts goes."""
    pattern = rf"(?s)\S.{{0,{most - 1}}}\z|\S.{{0,{most - 2}}}(?= )|\S.{{{most - 1}}}"
    pieces = F.regexp_extract_all(F.regexp_replace(text, r"^\s+|\s+\z", ""), F.lit(pattern), F.lit(0))
    return F.transform(pieces, lambda x: F.regexp_replace(x, r"\s+\z", ""))


def with_suffixes(df: DataFrame, key: str, ref: str, pieces: Column) -> DataFrame:
    """A row per piece; a, b, c ... follow the reference where there are several."""
    rows = df.select(key, ref, pieces.alias("ps")).select(key, ref, F.size("ps").alias("n"), F.posexplode("ps").alias("i", "text"))
    name = F.when(F.col("n") > 1, F.concat(F.col(ref), F.char(97 + F.col("i")))).otherwise(F.col(ref))
    return rows.select(key, name.alias("ref"), "text")
