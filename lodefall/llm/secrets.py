"""Secrets by pattern and by guess cost.

Base kinds: assign, access and hex as the contract states them (leftmost, non-overlapping per kind). The method adds
`context`: a value in a credential context (`pwd: ...`, `Authorization: Bearer ...`, `user:value@host`) whose guess cost
is at least BITS. The cost of a value is that of its cheapest segmentation, found by dynamic programming: words by their
rank (in any case and with common substitutions) and unlisted ones whose pairs of letters are those of words, dates, repeats,
keyboard walks and sequences, and brute-force spans.

Words are ranked by a short fixed list, then by how often they occur in all of the corpus (`ranked_words`; the most frequent
VOCABULARY at most go to the workers). Runs of letters with over one odd pair aren't taken for words, so that a secret that
is copied often does not become one.

Defined results: a null text is empty; repeated rows and ids, and null ids, get a row each; an empty table gives no rows.
Places are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefall.llm.common import cut, map_batches

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "context")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Any match of ASSIGN or CONTEXT holds one of these.
CUES = ("pass", "secret", "token", "key", "pwd", "auth", "bearer", "credential", "://")
CONTEXT = re.compile(
    r"""\b(?:pwd|pass|passphrase|passcode|passwort|auth|authorization|credentials?|(?:private|access|client|signing|encryption)[ _-]?(?:key|secret))\b["']?\s{0,4}[:=]\s{0,4}(?:bearer\s+|basic\s+)?["']?([^\s"'<>,;]{8,})|\bbearer\s+([^\s"'<>,;]{8,})|://[^\s/:@"'<>]+:([^\s/@"'<>]{8,})@""",
    re.I | re.A,
)
#: Guesses, as a power of two, from which a value in a context counts as a secret.
BITS = 36.0

#: Words that guessers try first, by rank.
WORDS = (
    "password pass admin root user guest test login welcome secret default changeme letmein qwerty master monkey dragon shadow sunshine princess "
    "football baseball superman batman iloveyou trustno hello freedom whatever starwars computer internet server database system service example "
    "sample dummy placeholder yourpassword none null true false token key value string demo temp public private super manager account company "
    "summer winter spring autumn january february march april june july august september october november december monday friday sunday"
).split()
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
#: Letters of a word of the corpus, and how many words are listed at most.
SHORTEST, LONGEST, VOCABULARY = 3, 20, 65_536
#: Rows of a keyboard, and the characters that commonly stand for letters.
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$", "oleastas")
NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {(a, b) for up, low in zip(ROWS[:3], ROWS[1:4]) for x, y in zip(up, low) for a, b in ((x, y), (y, x))}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_BITS = {True: math.log2(100), False: math.log2(100 * 365)}
#: A run of letters in one case (or capitalised) that nothing else adjoins may be a word of a large unlisted vocabulary.
UNLISTED = re.compile(r"(?<![A-Za-z])(?:[A-Z]?[a-z]{3,20}|[A-Z]{3,20})(?![A-Za-z])")
UNLISTED_BITS = 18.0
#: Letters, each with those that often follow it in words. Any other pair costs such a word as much as two
#: brute-forced letters, so that a word may have one odd pair, and random letters cost what brute force does.
PAIRS = frozenset(x[0] + y for x in (
    "abcdfgiklmnprstuvy baceilorsuy cacehiklortu dadeilosu eabcdefghilmnpqrstvwxy faefilortuy gaeghilnorsu haeiot "
    "iabcdefglmnoprstvxz keis ladeilostuy mabeimopsu nacdefgilnostuv oabcdfgiklmnoprstuvw paehiloprstuy qu "
    "racdefgiklmnoprstuvwy sacehiklopstuy tacehilorstuy uabcdegilmnprst vaeio waehior xceiptx ynpst zae"
).split() for y in x[1:])
ODD_BITS = 2 * math.log2(26)
#: Of a segment besides its own cost, so that many small segments don't come cheap.
SEGMENT_BITS = 1.0


def char_bits(value: str) -> float:
    """Bits of a brute-forced character: of the smallest common alphabet of the whole value."""
    for alphabet, size in ((r"[0-9]+", 10), (r"[0-9a-f]+", 16), (r"[a-z]+|[A-Z]+", 26), (r"[0-9a-z]+|[0-9A-Z]+", 36), (r"[0-9A-Za-z]+", 62)):
        if re.fullmatch(alphabet, value):
            return math.log2(size)
    return math.log2(95)


def odd_pairs(word: str) -> int:
    return sum(a + b not in PAIRS for a, b in zip(word, word[1:]))


def ranked_words(docs: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """The rank of each listed word, and of the words that occur most often in all of `docs`: those that occur at least as
    often as the lowest power of two that leaves `most`; equal counts go by the alphabet."""
    found = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w).between(SHORTEST, LONGEST))
    counts = cut(docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    powers = [F.count(F.when(F.col("n") >= (1 << k), 1)).alias(f"p{k}") for k in range(1, 50)]
    seen = counts.agg(*powers).first()
    least = next(1 << k for k in range(1, 50) if seen[f"p{k}"] <= most)
    words = counts.where(F.col("n") >= least).collect()  # at most `most` rows
    ranks = dict(RANK)
    for x in sorted(words, key=lambda x: (-x["n"], x["word"])):
        if odd_pairs(x["word"]) <= 1:
            ranks.setdefault(x["word"], len(ranks) + 1)
    return ranks


def guess_bits(value: str, ranks: dict[str, int] = RANK) -> float:
    """The least cost, as a power of two, over all segmentations of the value; linear in its length."""
    n, low, each = len(value), value.lower(), char_bits(value)
    plain = low.translate(LEET) if len(low) == n else value
    low = low if len(low) == n else value
    # ends of runs that hold from each place on: equal characters, and steps to a neighbouring key
    same, walk = [n] * n, [n] * n
    for i in range(n - 2, -1, -1):
        same[i] = same[i + 1] if value[i] == value[i + 1] else i + 1
        walk[i] = walk[i + 1] if (low[i], low[i + 1]) in NEXT else i + 1
    best = [0.0] + [math.inf] * n  # any segmentation up to a place
    brute = [math.inf] * (n + 1)  # those that end in a brute-force span
    for i in range(n + 1):
        best[i] = min(best[i], brute[i])
        if i == n:
            break
        grown = min(brute[i], best[i] + SEGMENT_BITS) + each
        brute[i + 1] = min(brute[i + 1], grown)
        at = best[i] + SEGMENT_BITS
        for size in range(SHORTEST, min(LONGEST, n - i) + 1):
            if (rank := ranks.get(low[i : i + size]) or ranks.get(plain[i : i + size])) is not None:
                cased = value[i : i + size] not in (low[i : i + size], value[i : i + size].upper())
                swapped = low[i : i + size] not in ranks
                best[i + size] = min(best[i + size], at + math.log2(rank + 1) + cased + 2 * swapped)
        if (end := same[i]) - i >= 3:
            best[end] = min(best[end], at + each + math.log2(end - i))
        if (end := walk[i]) - i >= 3:
            best[end] = min(best[end], at + math.log2(len(ROWS) * 12) + math.log2(end - i))
        if m := UNLISTED.match(value, i):
            best[m.end()] = min(best[m.end()], at + UNLISTED_BITS + ODD_BITS * odd_pairs(low[i : m.end()]))
        if m := DATE.match(value, i):
            best[m.end()] = min(best[m.end()], at + DATE_BITS[m.end() - i == 4])
    return best[n]


def spans(text: str | None, ranks: dict[str, int] = RANK) -> list[tuple[int, int, str, int, float]]:
    """(start, place of the kind, kind, end, guess bits) in the contract's order; bits are 0 where there is no value."""
    out: list[tuple[int, int, str, int, float]] = []
    if not text:
        return out
    low = text.lower()
    if any(cue in low for cue in CUES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                out.append((m.start(), 0, "assign", m.end(), guess_bits(m[2], ranks)))
        ends, held = [x[3] for x in out], len(out)
        for m in CONTEXT.finditer(text):
            value = next(k for k in (1, 2, 3) if m[k])
            a, b = m.span(value)
            # both are in order: the first assignment that ends after the value's begin is the only one that can overlap
            k = bisect_right(ends, a, 0, held)
            if (k == held or out[k][0] >= b) and (bits := guess_bits(m[value], ranks)) >= BITS:
                out.append((a, 3, "context", b, bits))
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, "hex", m.end(), 0.0) for m in HEX.finditer(text)]
    return sorted(out)


def listed(found: list, kinds: tuple[str, ...]) -> str:
    return ",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in found if x[2] in kinds)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, max_guess_bits double"


def shared_ranks(docs: DataFrame) -> Callable[[], dict[str, int]]:
    """ranked_words() for the workers; bounded by VOCABULARY words."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked_words(docs))
    return lambda: shared.value


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of the base kinds, base_sha256, spans and the highest guess cost of a value in a context
    (null without one), a row per row of `docs`."""

    ranks = shared_ranks(docs)

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(x, ranks()) for x in batch.column("text").to_pylist()]
        counts = [pa.array([sum(y[2] == k for y in x) for x in found], pa.int64()) for k in BASE]
        hashes = pa.array([hashlib.sha256(listed(x, BASE).encode()).hexdigest() for x in found])
        bits = pa.array([max((y[4] for y in x if y[4]), default=None) for x in found], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array([listed(x, KINDS) for x in found]), bits], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", "text"), body, SCHEMA)


def redact(text: str | None, ranks: dict[str, int] = RANK, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced by the mark, overlapping spans by one."""
    if not text or not (found := spans(text, ranks)):
        return text
    out, at = [], 0
    for start, _, _, end, _ in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, with secrets in `text` replaced; n_chars, where there is one, is that of the new
    text in changed rows."""

    ranks = shared_ranks(docs)

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.schema.get_field_index("text")
        clean = pa.array([redact(x, ranks()) for x in batch.column(column).to_pylist()], batch.schema.field(column).type)
        return batch.set_column(column, batch.schema.field(column), clean)

    out = map_batches(docs.withColumn("__lodefall_text", F.xxhash64("text")), body, T.StructType([*docs.schema.fields, T.StructField("__lodefall_text", T.LongType())]))
    if "n_chars" in docs.columns:
        changed = F.xxhash64("text") != F.col("__lodefall_text")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__lodefall_text")
