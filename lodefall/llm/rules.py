"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per text: the ledger holds the measurements and, in `failures`, a bit for each failed rule.
Policies are versioned masks over those bits, so applying one, or asking what leaving a rule out would change, never
looks at a text again.

Words are runs of characters other than ASCII white space. Repeated words lie in an 8-word window that occurs twice or
more in the text; windows are compared by 64-bit hashes. Defined results: a null text has no words and counts as empty
(rule few_words fails); repeated rows and ids, and null ids, get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import let, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rule names by bit; a rule, of a function that gives a measure's column, is true where the text fails it. Integer
#: arithmetic, so results don't depend on rounding.
Measure = Callable[[str], Column]
RULES: tuple[tuple[str, Callable[[Measure], Column]], ...] = (
    ("few_words", lambda m: m("n_words") < 20),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("symbol_heavy", lambda m: 4 * m("n_symbols") > m("n_words")),
    ("long_words", lambda m: m("word_chars") > 25 * m("n_words")),
    ("short_words", lambda m: m("word_chars") < 2 * m("n_words")),
    ("duplicate_lines", lambda m: (m("n_lines") >= 4) & (2 * m("n_dup_lines") > m("n_lines"))),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Versioned policies: a document is kept if it fails none of the rules in the mask.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "web-1": BASE | BIT["symbol_heavy"],
    "web-2": BASE | BIT["symbol_heavy"] | BIT["long_words"] | BIT["short_words"] | BIT["duplicate_lines"],
}
CURRENT = "web-2"


def window_hashes(found: Column) -> Column:
    """A hash per window of 8 of the words `found`, built from hashes of 2 and of 4."""
    pairs = F.transform(found, lambda w, i: F.xxhash64(w, F.get(found, i + 1)))
    fours = let(pairs, lambda two: F.transform(two, lambda h, i: F.xxhash64(h, F.get(two, i + 2))))
    eights = let(fours, lambda four: F.transform(four, lambda h, i: F.xxhash64(h, F.get(four, i + 4))))
    return F.slice(eights, F.lit(1), F.greatest(F.size(found) - (WINDOW - 1), F.lit(0)))


def covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Sorted by hash, a repeated window has an equal neighbour; then,
    by place, each adds the words up to the next repeated window, 8 at most."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = let(
        placed,
        lambda p: F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])),
    )
    places = F.array_sort(F.transform(twins, lambda x: x["i"]))
    return let(places, lambda q: F.aggregate(F.transform(q, lambda i, k: F.least(F.coalesce(F.get(q, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))


def repeat_words(found: Column) -> Column:
    return let(window_hashes(found), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(text: Column) -> Column:
    """A struct of MEASURES."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words"),
    )
    by_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    )
    symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
    parts = F.struct(let(words(text), by_words).alias("w"), let(lines, by_lines).alias("l"), symbols.alias("s"))
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["w"]["word_chars"].alias("word_chars"),
            p["s"].alias("n_symbols"),
            p["l"]["n_lines"].alias("n_lines"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            p["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def failures(measure: Measure = F.col) -> Column:
    """The failed rules' bits."""
    bits = F.lit(0).cast("long")
    for name, rule in RULES:
        bits = bits.bitwiseOR(F.when(rule(measure), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measures and `failures`, a row per row of `docs`."""
    measured = docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    return measured.withColumn("failures", failures())


def passes(policy: str = CURRENT) -> Column:
    """Whether a ledger's row fails no rule of the policy."""
    return F.col("failures").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that only it rejects. One aggregation over the bits
    (at most 2 ** rules groups leave the map side)."""
    mask = POLICIES[policy]
    by_bits = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask))
    return by_bits.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_it_rejects"),
    )


def kept(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of `docs`, all columns, that the policy keeps."""
    measured = "__lodefall_m"
    held = docs.withColumn(measured, measures(F.col("text")))
    return held.where(failures(lambda k: F.col(measured)[k]).bitwiseAND(F.lit(POLICIES[policy])) == 0).drop(measured)
