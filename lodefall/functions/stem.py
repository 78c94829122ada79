"""Porter stemming (M. F. Porter, 1980) of keyword tokens, in Arrow batches; Spark has no built-in for it."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of the published algorithm: suffixes and what replaces them.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
#: Tokens of fewer or more bytes stay as they are.
SHORTEST, LONGEST = 3, 64


def _shape(s: str) -> str:
    """A letter per character: v for vowels (y after a consonant is one), c for all others."""
    out = ""
    for ch in s:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(s: str) -> int:
    return _shape(s).count("vc")


def _short_end(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _replaced(s: str, table: tuple[tuple[str, str], ...]) -> str:
    """By the longest suffix that ends the word, if what stays has a measure over 0."""
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if s.endswith(suffix):
            base = s[: -len(suffix)]
            return base + new if _measure(base) > 0 else s
    return s


def _plural(s: str) -> str:
    if (len(s) > 4 and s.endswith("sses")) or (len(s) > 3 and s.endswith("ies")):
        return s[:-2]
    return s[:-1] if s.endswith("s") and not s.endswith("ss") else s


def _past(s: str) -> str:
    if len(s) > 3 and s.endswith("eed"):  # a suffix leaves a character at least
        return s[:-1] if _measure(s[:-3]) > 0 else s
    base = s[:-2] if s.endswith("ed") else s[:-3] if s.endswith("ing") else None
    if base is None or "v" not in _shape(base):
        return s
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and base[-1] not in "aeioulsz":
        return base[:-1]
    return base + "e" if _measure(base) == 1 and _short_end(base) else base


def _bare(s: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if s.endswith(suffix):
            base = s[: -len(suffix)]
            return base if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))) else s
    return s


@lru_cache(100_000)
def porter(token: str) -> str:
    """The stem of a lower-case token; other scripts' bytes count as consonants."""
    s = token.encode("utf-8", "surrogatepass").decode("latin-1")
    if not SHORTEST <= len(s) <= LONGEST:
        return token
    s = _past(_plural(s))
    if s.endswith("y") and "v" in _shape(s[:-1]):
        s = s[:-1] + "i"
    s = _bare(_replaced(_replaced(s, STEP_2), STEP_3))
    if s.endswith("e"):
        m = _measure(s[:-1])
        if m > 1 or (m == 1 and not _short_end(s[:-1])):
            s = s[:-1]
    if s.endswith("ll") and _measure(s[:-1]) > 1:
        s = s[:-1]
    return s.encode("latin-1").decode("utf-8", "replace")


@F.pandas_udf(StringType())
def stemmed(tokens: pd.Series) -> pd.Series:
    """Each token's stem; meant for distinct tokens."""
    return tokens.map(porter)
