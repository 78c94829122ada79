"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, plus signs, digits, schemes and identifier cues. Small
deterministic parsers then expand each anchor to its boundaries and validate what they find. Places are code points.

Kinds: email, ip, card and phone as the contract states them (leftmost, non-overlapping per kind, no retries), and two of
this method's own: url (a scheme, a host with a dot, up to white space or a quote) and account (after a cue such as
`IBAN` or `account`, and words such as `number`: an IBAN of its country's length that passes mod 97; after `account` also
6 to 17 digits; after `SSN` a number of the form ddd-dd-dddd).

Defined results: a null text is empty; repeated rows and ids, and null ids, get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lodefall.llm.common import map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = DIGITS | frozenset(" ().-")
UPPER = frozenset(string.ascii_uppercase + string.digits)
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "ssn")
#: Characters between a cue and what it announces.
CUE_GAP = " \t:=#.-"
FILLERS = ("number", "num", "nr", "no", "is")
#: The length of an IBAN by country.
IBAN = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
NOT_URL = re.compile(r"""[\s"'<>`]""")

_found: ahocorasick.Automaton | None = None


def anchors() -> ahocorasick.Automaton:
    """The automaton; built once per process."""
    global _found
    if _found is None:
        made = ahocorasick.Automaton()
        for c in string.digits:
            made.add_word(c, ("digit", 1))
        made.add_word("@", ("at", 1))
        made.add_word("+", ("plus", 1))
        for x in SCHEMES:
            made.add_word(x, ("scheme", len(x)))
        for x in CUES:
            made.add_word(x, (x, len(x)))
        made.make_automaton()
        _found = made
    return _found


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign; it can't begin before `floor`, where the one before it ends."""
    start, n = at, len(text)
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    dots = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        dots, end = dots + 1, end + 2
        while end < n and text[end] in LABEL:
            end += 1
    return (start, end) if dots else None


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    end = plus + 2
    while end < n and text[end] in PHONE:
        end += 1
    while text[end - 1] not in DIGITS:
        end -= 1
    if end < plus + 4:  # the first digit, something after it, and the last digit
        return None
    return (plus, end) if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


def chains(text: str, runs: list[tuple[int, int]], gaps: str) -> list[list[tuple[int, int]]]:
    """Runs of digits that single characters of `gaps` tie together."""
    out: list[list[tuple[int, int]]] = []
    for run in runs:
        if out and run[0] == out[-1][-1][1] + 1 and text[run[0] - 1] in gaps:
            out[-1].append(run)
        else:
            out.append([run])
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def folded(text: str) -> str:
    """The text in lower case with every character at its place, for the automaton."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(FOLD)


def run_end(text: str, end: int) -> int:
    """Where the run of characters that a URL may hold ends, closing punctuation left out."""
    m = NOT_URL.search(text, end)
    last = m.start() if m else len(text)
    while last > end and text[last - 1] in ".,;:!?)]}":
        last -= 1
    return last


def is_url(text: str, host: int, end: int) -> bool:
    """Whether a host with a dot inside begins at `host`."""
    slash = text.find("/", host, end)
    return "." in text[host : end if slash < 0 else slash].strip(".")


def account_at(text: str, cue: str, end: int) -> tuple[int, int] | None:
    while True:
        while end < len(text) and text[end] in CUE_GAP:
            end += 1
        filler = next((x for x in FILLERS if text[end : end + len(x)].lower() == x and not text[end + len(x) : end + len(x) + 1].isalnum()), None)
        if filler is None:
            break
        end += len(filler)
    start = end
    if cue == "ssn":
        part = text[start : start + 11]
        fits = len(part) == 11 and all(c == "-" if k in (3, 6) else c in DIGITS for k, c in enumerate(part))
        return (start, start + 11) if fits and text[start + 11 : start + 12] not in DIGITS else None
    if cue != "iban":
        while end < len(text) and text[end] in DIGITS:
            end += 1
        if 6 <= end - start <= 17 and not text[end : end + 1].isalnum():
            return start, end
        end = start
    code, ends = "", []
    while end < len(text) and len(code) < 34 and (text[end] in UPPER or text[end] == " " and text[end + 1 : end + 2] in UPPER):
        code += text[end].strip()
        end += 1
        if len(code) >= 15 and text[end - 1] != " " and not text[end : end + 1].isalnum():
            ends.append((len(code), end))
    if not (code[:2].isalpha() and code[2:4].isdigit()):
        return None
    for size, end in reversed(ends):  # of countries that aren't listed the longest that passes
        if IBAN.get(code[:2], size) == size and int("".join(str(int(c, 36)) for c in code[4:size] + code[:4])) % 97 == 1:
            return start, end
    return None


def spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The (start, end) spans of each kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    runs: list[tuple[int, int]] = []
    ends = dict.fromkeys(KINDS, 0)
    run = 0  # the end of the last scheme's run: schemes before it share it, so that a run is read once

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] >= ends[kind]:
            out[kind].append(span)
            ends[kind] = span[1]

    for last, (what, size) in anchors().iter(folded(text)):
        start, end = last - size + 1, last + 1
        if what == "digit":
            if runs and runs[-1][1] == start:
                runs[-1] = (runs[-1][0], end)
            else:
                runs.append((start, end))
        elif what == "at":
            add("email", email_at(text, start, ends["email"]))
        elif what == "plus":
            add("phone", phone_at(text, start))
        elif what == "scheme":
            if start >= ends["url"]:
                run = run if end <= run else run_end(text, end)
                if end < run and is_url(text, end, run):
                    add("url", (start, run))
        elif start == 0 or not text[start - 1].isalnum():
            add("account", account_at(text, what, end))
    for chain in chains(text, runs, "."):
        for k in range(0, len(chain) - 3, 4):
            four = chain[k : k + 4]
            if all(at_most_255(text[a:b]) for a, b in four):
                out["ip"].append((four[0][0], four[3][1]))
    for chain in chains(text, runs, " -"):
        digits = "".join(text[a:b] for a, b in chain)
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append((chain[0][0], chain[-1][1]))
    return out


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in kinds for a, b in found[kind])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of the base kinds, base_sha256 and spans, a row per row of `docs`."""

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans(x) for x in batch.column("text").to_pylist()]
        counts = [pa.array([len(x[k]) for x in found], pa.int64()) for k in BASE]
        hashes = pa.array([hashlib.sha256(listed(x, BASE).encode()).hexdigest() for x in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, hashes, pa.array([listed(x, KINDS) for x in found])], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return map_batches(docs.select("doc_id", "text"), body, SCHEMA)
