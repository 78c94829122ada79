"""Which terms of a table occur in texts: synonyms of concepts, and known codes.

Below a counted number of terms one automaton, given to every task, finds them in one pass over a text. Beyond it each term meets the texts by
its run of three characters that fewest terms have, and is then verified; shorter terms meet them as they are. Codes of word characters
alone meet the texts' words. Texts are matched once
each, however often they occur, and the plan is the same for any number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.session import ship

#: Terms up to which the automaton is used (under 20 MB of terms of 100 bytes), and the run of characters that longer ones meet texts by.
TERMS, GRAM = 200_000, 3


def runs(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, text: str, terms: DataFrame, term: str, most: int = TERMS) -> DataFrame:
    """The distinct pairs of a text and a term that is part of it, case and all; null and empty ones are in no pair."""
    t = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    w = terms.select(F.col(term).alias("term")).where("term <> ''").distinct()
    few = w.limit(most + 1).collect()  # bounded
    if not few:
        return t.select(F.col("text").alias(text), F.col("text").alias(term)).limit(0)
    return (by_automaton(t, [r["term"] for r in few]) if len(few) <= most else by_runs(t, w)).select(F.col("text").alias(text), F.col("term").alias(term))


def by_automaton(texts: DataFrame, terms: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in shared.value:
            automaton.add_word(x, x)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            pairs = [(x, found) for x in batch.column("text").to_pylist() for found in sorted({y for _, y in automaton.iter(x)})]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())], ["text", "term"])

    ship(texts.sparkSession)
    return texts.mapInArrow(run, "text string, term string")


def by_runs(texts: DataFrame, terms: DataFrame) -> DataFrame:
    size = F.least(F.length("term"), F.lit(GRAM))
    of_term = terms.select("term", size.alias("size")).select("term", "size", F.explode(F.when(F.col("size") < GRAM, F.array("term")).otherwise(runs(F.col("term"), GRAM))).alias("run"))
    rare = of_term.join(of_term.groupBy("run").agg(F.count("*").alias("n")), "run").groupBy("term", "size").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    of_text = texts.select("text", F.explode(F.concat(*(runs(F.col("text"), k) for k in range(1, GRAM + 1)))).alias("run"))
    return of_text.join(rare, "run").where(F.contains("text", F.col("term"))).select("text", "term")


def bare(x: Column) -> Column:
    """Lower case with blanks for what is neither a word's character nor white space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "))


def tagged(rows: DataFrame, text: str, synonyms: DataFrame, most: int = TERMS) -> DataFrame:
    """Adds tags (concepts of which a term is part of the text, in their order) and expanded_terms (all terms of these, each concept's canonical one
    first, each term once). synonyms: concept, concept_order, term, term_order (0: canonical)."""
    terms = synonyms.select("concept", "concept_order", F.lower("term").alias("term"), "term_order").withColumn("bare", bare(F.col("term")))
    whole = terms.groupBy("concept", "concept_order").agg(F.transform(F.sort_array(F.collect_list(F.struct("term_order", "term"))), lambda x: x["term"]).alias("terms"))
    hits = contained(rows, text, terms, "bare", most).join(terms.select("bare", "concept").distinct(), "bare").select(text, "concept").distinct().join(whole, "concept")
    every = F.sort_array(F.collect_list(F.struct("concept_order", "concept", "terms")))
    found = hits.groupBy(text).agg(F.transform(every, lambda x: x["concept"]).alias("tags"), F.array_distinct(F.flatten(F.transform(every, lambda x: x["terms"]))).alias("expanded_terms"))
    none = F.array().cast("array<string>")
    return rows.join(found.withColumnRenamed(text, "__lodefall_text"), F.col(text) == F.col("__lodefall_text"), "left").drop("__lodefall_text").withColumns({c: F.coalesce(c, none) for c in ("tags", "expanded_terms")})


#: A code of word characters alone.
WORD = "[A-Za-z0-9_]+"


def spoken(rows: DataFrame, text: str, codes: DataFrame, code: str) -> DataFrame:
    """The distinct pairs of a text and a code of word characters alone that may stand in it between word boundaries: that is one of
    its words. Words meet codes with the hash of their text, so that what is shuffled is small however long the texts are."""
    t = rows.select(text).where(F.col(text) != "").distinct().withColumn("__lodefall_at", F.xxhash64(text))
    words = t.select("__lodefall_at", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))).alias(code))
    met = words.hint("merge").join(codes.select(code).distinct(), code)
    return met.hint("merge").join(t, "__lodefall_at").select(text, code)


def coded(rows: DataFrame, text: str, codes: DataFrame, code: str, out: str, most: int = TERMS) -> DataFrame:
    """Adds the longest code (then the first by name) that stands in the text between word boundaries, or null."""
    plain = F.col(code).rlike(rf"\A{WORD}\z")
    pairs = spoken(rows, text, codes.where(plain), code).unionByName(contained(rows, text, codes.where(~plain), code, most))
    bounded = F.rlike(F.col(text), F.concat(F.lit(r"\b\Q"), F.col(code), F.lit(r"\E\b")))
    best = pairs.where(bounded).groupBy(F.col(text).alias("__lodefall_text")).agg(F.min_by(code, F.struct(-F.length(code), code)).alias(out))
    return rows.join(best, F.col(text) == F.col("__lodefall_text"), "left").drop("__lodefall_text")


def table_of(synonyms: dict[str, tuple[str, ...]]) -> list[tuple[str, int, str, int]]:
    """Rows of a table of synonyms out of each concept's terms, the canonical one first."""
    return [(c, k, t, j) for k, (c, terms) in enumerate(synonyms.items()) for j, t in enumerate(terms)]


SYNONYM_ROW = "concept string, concept_order int, term string, term_order int"
