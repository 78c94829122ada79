"""Column functions over text: tokens, counts, sanitising, splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every ASCII character that isn't a letter or digit separates tokens; all others belong to one.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Keyword tokens: A-Z folded, other scripts as they are; null gives none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def token_estimate(text: Column) -> Column:
    """Four tokens for three words, rounded down."""
    return F.floor(word_count(text) * 4 / 3).cast("long")


def sanitize(text: Column) -> Column:
    """Without control characters, but with tabs and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def query_terms(question: str, stop: frozenset[str] = frozenset(), cap: int = 40) -> list[str]:
    """The searchable terms of a question on the driver: no stop words, none of one character, at most `cap`."""
    cleaned = "".join(c if c.isalnum() or c == "_" else " " for c in question)
    return [w for w in cleaned.lower().split() if len(w) > 1 and w not in stop][:cap]


def strip_reply(subject: Column) -> Column:
    """One reply or forward prefix less."""
    return F.trim(F.regexp_replace(subject, r"(?i)^(?:re|fwd?):\s*", ""))


def email_domain(address: Column) -> Column:
    last = F.element_at(F.split(address, "@"), -1)
    return F.when(F.contains(address, F.lit("@")), F.lower(F.trim(last))).otherwise(F.lit(""))


def breadcrumb(parts: Column, n: int = 4) -> Column:
    """The last n path parts."""
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - (n - 1), F.lit(1)), F.lit(n)), " > ")


def snippet(text: Column, terms: list[str], size: int = 25, width: int = 160, gap: str = " ... ") -> Column:
    """Of the windows of `size` words that begin at a word with one of the terms, the first with most distinct terms, with
    `gap` where text was left out, cut to `width` characters; the text's beginning where no term occurs."""
    wanted = F.array(*map(F.lit, sorted(set(terms)))) if terms else F.array().cast("array<string>")
    marked = F.transform(words(text), lambda w: F.struct(w.alias("w"), F.array_intersect(tokens(w), wanted).alias("ts")))

    def best(ms: Column) -> Column:
        starts = F.filter(F.transform(ms, lambda m, i: F.struct((-i).alias("i"), F.size(m["ts"]).alias("n"))), lambda x: x["n"] > 0)
        distinct = lambda i: F.size(F.array_distinct(F.flatten(F.transform(F.slice(ms, i + 1, size), lambda m: m["ts"]))))
        top = F.array_max(F.transform(starts, lambda x: F.struct(distinct(-x["i"]).alias("n"), x["i"].alias("i"))))
        return F.struct(ms.alias("ms"), (-top["i"]).alias("at"))

    def shown(x: Column) -> Column:
        part = F.array_join(F.transform(F.slice(x["ms"], x["at"] + 1, size), lambda m: m["w"]), " ")
        before, after = F.when(x["at"] > 0, gap).otherwise(""), F.when(x["at"] + size < F.size(x["ms"]), gap).otherwise("")
        return F.left(F.concat(before, part, after), F.lit(width))

    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    return F.coalesce(once(once(marked, best), shown), F.left(text, F.lit(width)))


#: Words that questions have in common, with those that say little about an archive of buildings.
STOP = frozenset(
    """a an the and or but is are was were be been being have has had do does did will would could should may might shall can
    for to of in on at by from with into through during before after above below between out up down about it its this that these
    those what which who whom when where why how all each every both few more most other some such no not only same so than too very
    just also any if as i me my you your he she they their them we our us architecture architectural building project find get""".split()
)


def boosted_terms(question: str, expansions: list[str], cap: int = 40) -> list[str]:
    """The question's terms, repeats included, then the new words of its expansions (3 characters and more)."""
    def split(x: str) -> list[str]:
        return re.sub(r"[^\w\s]", " ", x).split()

    base = [w for w in split(question) if w.lower() not in STOP and len(w) > 1]
    seen, extra = {w.lower() for w in base}, []
    for w in (w for e in expansions for w in split(e)):
        if w.lower() not in seen and w.lower() not in STOP and len(w) > 2:
            seen.add(w.lower())
            extra.append(w)
    return (base + extra)[:cap]


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.8, "High").when(value >= 0.55, "Medium").when(value > 0, "Low").otherwise("Not Found")


def card_text(fields: dict[str, Column]) -> Column:
    """Lines `label: value` of the fields that have a value, in order."""
    lines = (F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in fields.items())
    return F.concat_ws("\n", *lines)


def day_mode(at: Column, first: int = 6, last: int = 22) -> Column:
    """day from hour `first` to before `last`, else night."""
    return F.when((F.hour(at) >= first) & (F.hour(at) < last), "day").otherwise("night")
