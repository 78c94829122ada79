"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cut greedily into the
longest phrases that occur in the sample (Ziv-Merhav parsing); the number of phrases times the logarithm of the sample's
length estimates the cross entropy, and the language that needs the fewest such normalised phrases wins.

The transitions of all automata lie in one array, each state's at its own offset, so that a step is a look-up by offset and
letter; all texts and languages of a batch walk in lockstep in numpy. Long texts walk in stretches of STRETCH characters side
by side: a stretch begins with the state that WARM characters before it lead to, and is walked again from the state in
which the one before it did end until all agree, so that the phrases are those of one parse of the whole text. Letters are
compared in lower case, each letter of any sample is told apart, and each run of other characters is one break.

Every label is learnt, from a bounded number of texts each. Defined results: rows with a null doc_id are predicted like others; repeated
rows get a row each, and copies of a labelled text give one piece; an empty table gives no rows; `und` with score 0 for a null text or one without a letter; ties go to the first language by name; with
no labelled text every language is `und`. The score is second / (best + second) of the normalised phrases (1 with only
one language).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import bounded, cut, map_batches

#: The fitting sample's bound for each language, of which all are learnt: pieces, and characters of a piece.
PIECES, PIECE = 64, 256
STRETCH, WARM = 1024, 96
#: Bits of a transition's next state.
NEXT = 31
#: Classes of characters: letters of no sample, and runs of other characters; then each letter of a sample.
UNSEEN, BREAK, FIRST = 0, 1, 2

_letters: np.ndarray | None = None


def is_letter() -> np.ndarray:
    """For each code point whether it is a letter; built once per process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def lowered(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """(lang, piece) pairs for fitting, at most PIECES of each language: of its texts, dealt into PIECES buckets by
    a hash, each bucket's least hash gives a piece from a place that the hash picks."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    least = cut(rows.groupBy("lang", F.pmod("h", F.lit(PIECES)).alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h"))
    start = F.pmod(F.shiftrightunsigned("h", 8), F.greatest(F.length("text") - PIECE + 1, F.lit(1))) + 1
    piece = F.substring("text", start.cast("int"), F.lit(PIECE)).alias("piece")
    # PIECES hashes of each language; copies of one text give one piece
    found = rows.join(bounded(least), ["lang", "h"]).select("lang", "h", piece).dropDuplicates(["lang", "h"])
    return [(x["lang"], x["piece"]) for x in found.orderBy("lang", "h").collect()]


def automaton(pieces: list[list[int]]) -> list[dict[int, int]]:
    """Transitions of a suffix automaton that knows every substring of the pieces; state 0 is the root."""
    go, link, length = [{}], [-1], [0]
    for piece in pieces:
        last = 0
        for c in piece:
            new = len(go)
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = new
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
    return go


def packed(go: list[dict[int, int]], width: int, at: int) -> tuple[np.ndarray, int]:
    """The automaton's transitions as an array from offset `at` on, and the root's offset. A state is its offset; the cell at
    offset + letter holds the offset (owner), the next state, and the phrases that end (by NEXT + 2, 2 and 0 bits). The root
    has a cell for every letter; a letter whose cell another state owns has no transition."""
    owner: set[int] = set()
    place, taken, base, slot = [-1] * len(go), set(), 0, 0
    for state in sorted(range(len(go)), key=lambda k: (k > 0, -len(go[k]))):
        edges = list(go[state]) if state else range(width)
        if not edges:
            continue
        if len(edges) > 1:  # on to where all its cells are free
            while base in taken or any(base + c in owner for c in edges):
                base += 1
            place[state] = base
        else:  # on to a free cell
            while slot in owner or slot < edges[0] or slot - edges[0] in taken:
                slot += 1
            place[state] = slot - edges[0]
        taken.add(place[state])
        owner.update(place[state] + c for c in edges)
    # states without transitions share an offset that owns no cell
    size = max(taken) + 1
    place = [size if x < 0 else x for x in place]
    cells = np.full(size + width + 1, -1, np.int64)
    for state, edges in enumerate(go):
        for c, to in edges.items():
            cells[place[state] + c] = (at + place[state]) << NEXT + 2 | (at + place[to]) << 2
    root = place[0]
    for c in set(range(width)) - set(go[0]):
        cells[root + c] = (at + root) << NEXT + 2 | (at + root) << 2 | 1
    return cells, at + root


class Model:
    """The automata of all languages in one array."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        self.langs = sorted({lang for lang, _ in pairs})
        self.letters = "".join(sorted({c for _, piece in pairs for c in map(lowered, piece) if c.isalpha()}))
        self.width = FIRST + len(self.letters)
        classes = self.classes()
        tables, roots, self.weights, at = [], [], [], 0
        for lang in self.langs:
            coded = [squeezed(coded_text(classes, piece)).tolist() for own, piece in pairs if own == lang]
            cells, root = packed(automaton(coded), self.width, at)
            tables.append(cells)
            roots.append(root)
            self.weights.append(math.log2(max(2, sum(map(len, coded)))))
            at += len(cells)
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.roots = np.array(roots, np.int64)[:, None]
        # what a letter without a transition does: a phrase ends, and a new one begins at the root
        self.anew = (self.table[self.roots + np.arange(self.width)] if tables else np.zeros((0, self.width), np.int64)) + 1
        self.anew &= (1 << NEXT + 2) - 1

    def classes(self) -> np.ndarray:
        """The class of each code point."""
        out = np.where(is_letter(), UNSEEN, BREAK).astype(np.int32)
        for k, c in enumerate(self.letters):
            out[ord(c)] = FIRST + k
        for c in self.letters:
            for other in {c.upper(), c.title()}:
                if len(other) == 1 and lowered(other) == c:
                    out[ord(other)] = out[ord(c)]
        return out

    def walk(self, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each stretch of `flat`, and the state after it, by language (rows) from the states given."""
        order = np.argsort(-length, kind="stable")
        begin, length, state = begin[order], length[order], state[:, order]
        count = np.zeros(state.shape, np.int32)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
        for t in range(steps):
            n = active[t]
            now, letters = state[:, :n], flat[begin[:n] + t]
            cell = self.table.take(now + letters)
            entry = np.where(cell >> NEXT + 2 == now, cell, self.anew.take(letters, axis=1))
            count[:, :n] += (entry & 3).astype(np.int32)
            state[:, :n] = entry >> 2 & (1 << NEXT) - 1
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[:, back], state[:, back]

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        owner = np.repeat(np.arange(len(codes)), [-(-len(x) // STRETCH) for x in codes])
        out = np.zeros((len(codes), len(self.langs)), np.int64)
        if not len(owner):
            return out
        flat = np.concatenate(codes)
        first = np.concatenate([[0], np.cumsum([len(x) for x in codes])[:-1]])
        begin = np.concatenate([np.arange(0, len(x), STRETCH) + o for x, o in zip(codes, first, strict=True)])
        length = np.concatenate([np.minimum(STRETCH, len(x) - np.arange(0, len(x), STRETCH)) for x in codes])
        later = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        entry = np.repeat(self.roots, len(owner), axis=1)
        entry[:, later] = self.walk(flat, begin[later] - WARM, np.full(len(later), WARM), entry[:, later])[1]
        count, end = self.walk(flat, begin, length, entry.copy())
        # a stretch whose entry was not the end of the one before it is walked again
        while len(again := later[(entry[:, later] != end[:, later - 1]).any(axis=0)]):
            entry[:, again] = end[:, again - 1]
            count[:, again], end[:, again] = self.walk(flat, begin[again], length[again], entry[:, again])
        last = np.append(owner[1:] != owner[:-1], True)
        count += last & (end != self.roots)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, count[k], len(codes)).astype(np.int64)
        return out


def coded_text(classes: np.ndarray, text: str) -> np.ndarray:
    return classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def squeezed(classes: np.ndarray) -> np.ndarray:
    """Classes with each run of breaks as one, none at the ends."""
    keep = np.ones(len(classes), bool)
    if len(classes):
        keep[1:] = (classes[1:] != BREAK) | (classes[:-1] != BREAK)
        keep[0] = classes[0] != BREAK
        kept = classes[keep]
        return kept[:-1] if len(kept) and kept[-1] == BREAK else kept
    return classes


def fit(labelled: DataFrame) -> Model:
    """A model from the rows' text and lang; nothing else of them is used."""
    return Model(sample(labelled))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, a row per row of `docs`; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, np.ndarray] = {}

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        classes = held.setdefault("classes", model.classes()) if "classes" not in held else held["classes"]
        codes = [squeezed(coded_text(classes, x or "")) for x in batch.column("text").to_pylist()]
        codes = [x if (x != BREAK).any() else x[:0] for x in codes]
        langs, scores = ["und"] * len(codes), np.zeros(len(codes))
        if model.langs:
            cost = model.phrases(codes) * np.array(model.weights)
            best = cost.argmin(axis=1)
            low = np.partition(cost, 1, axis=1)[:, :2] if len(model.langs) > 1 else None
            for i, x in enumerate(codes):
                if len(x):
                    langs[i] = model.langs[best[i]]
                    scores[i] = 1.0 if low is None else low[i, 1] / (low[i, 0] + low[i, 1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), body, "doc_id long, lang_pred string, score double")
