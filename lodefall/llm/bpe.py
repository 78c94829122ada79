"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Merges act inside the pieces that the pre-tokenizer cuts. Whether a pair merges can depend on what follows only through
a chain of ever earlier merges: the right token may be taken by an earlier rule, whose right token may in turn be taken by
a still earlier one, and so on. The longest such chain, summed over the bytes of its right tokens, is the merge list's
sufficient lookahead; it is computed from the rules alone. A token that ends at least that far before the end of what has
been read is stable: it is emitted, and, because the tokens of a piece from a token boundary on are those of the rest
alone, encoding goes on from there. So a piece of any length needs a window of the lookahead plus one token.

A text is encoded block by block, each ending at a blank, and its ids are passed on as they come, so neither all its pieces
nor all its ids are held. Every piece goes through the transducer; the ids of short pieces and words are remembered.

Decoding is a state machine from ids to text that keeps nothing but an unfinished character.

Defined results: a null text is empty and has no ids (the hashes are those of empty data); the strings of the special
tokens in a text become their ids, as the library has it; repeated rows and ids, and null ids, get a row each.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lodefall.llm.common import map_batches

CONTROLS = regex.compile("[\x1c-\x1f]")
MARKS = tuple(".,;:!?")
#: Pieces, and words between white space, whose ids a worker remembers; beyond that, new ones are encoded each time.
REMEMBERED = 100_000
#: Characters after which a block of a text ends with the next blank, and tokens of a long piece that are passed on at once.
BLOCK, CHUNK = 1 << 18, 1 << 14
BLANK = regex.compile("[ \t\r\n]")


def byte_alphabet() -> str:
    """The character that stands for each byte: itself where it prints, else one from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


class Tokenizer:
    """A BPE tokenizer read from a tokenizers file with a split pattern, a byte alphabet and a suffix for ends of words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {pair: k for k, pair in reversed(list(enumerate(pairs)))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.to_alphabet = dict(enumerate(byte_alphabet()))
        self.of_alphabet = {c: b for b, c in self.to_alphabet.items()}
        named = {i: x for x, i in (self.vocab | self.special).items()}
        self.surface = [named.get(i, "") for i in range(max(named) + 1)]
        self.bytes = [self.spelled(x) for x in self.surface]
        self.packed = {x: i.to_bytes(4, "little") for x, i in self.vocab.items()}
        steps = spec["normalizer"]["normalizers"]
        self.nfc, self.lower = ({"type": x} in steps for x in ("NFC", "Lowercase"))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # white space is normalised before the split, which drops it anyway
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols_there, self.lower_there = self.unlike_here(path)
        self.longest = max(len(self.bare(x)) for x in self.vocab)
        self.lookahead = self.sufficient_lookahead(pairs)
        self.known = Remembered(self.encode_piece)
        self.known_words = Remembered(self.encode_word)

    def unlike_here(self, path: str) -> tuple[frozenset[str], dict[int, str]]:
        """Characters too new for this Python's tables, as the library's own tables have them: those that are no letters
        or numbers there but are here, and lower-case forms."""
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        new = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn"))
        symbols = [c for c in new if len(library.pre_tokenizer.pre_tokenize_str(f"!{c}")) == 1]
        lower = {ord(c): low for c in new if (low := library.normalizer.normalize_str(c)) != c}
        return frozenset(symbols), lower

    def spelled(self, token: str) -> bytes:
        """The bytes that a token stands for; an end of a word gives a blank."""
        if token in self.special:
            return token.encode()
        return bytes(self.of_alphabet[c] for c in self.bare(token)) + b" " * (bool(self.end) and token.endswith(self.end))

    def bare(self, token: str) -> str:
        return token.removesuffix(self.end) if self.end else token

    def sufficient_lookahead(self, pairs: list[tuple[str, str]]) -> int:
        """Bytes to the right of a token that can decide whether it is final.

        reach(t, r): what can matter right of a token t that rules before r may still take. It is the largest
        len(w) + reach(w, q) over the rules (t, w) of rank q < r. Rules are taken in order, so reach(w, q) is known.
        """
        order: dict[str, list[int]] = {}
        far: dict[str, list[int]] = {}

        def reach(token: str, rank: int) -> int:
            at = bisect_left(order.get(token, ()), rank)
            return far[token][at - 1] if at else 0

        most = 0
        for rank, (left, right) in enumerate(pairs):
            x = len(self.bare(right)) + reach(right, rank)
            seen = far.setdefault(left, [])
            order.setdefault(left, []).append(rank)
            seen.append(max(x, seen[-1] if seen else 0))
            most = max(most, seen[-1])
        return most

    def merged(self, parts: list[str]) -> list[str]:
        """The tokens of a stretch: always the earliest rule at its leftmost place."""
        none, ranks = len(self.ranks), self.ranks
        near = [ranks.get(x, none) for x in zip(parts, parts[1:])]
        while near:
            best = min(near)
            if best == none:
                break
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(near):
                near[i] = ranks.get((parts[i], parts[i + 1]), none)
        return parts

    def transduce(self, symbols: Iterable[str]) -> Iterator[str]:
        """The tokens of one piece; its symbols are read a window at a time, and the last carries the end-of-word suffix."""
        window: list[str] = []
        full, symbols = 2 * (self.lookahead + self.longest), iter(symbols)
        while True:
            window += islice(symbols, full - len(window))
            if len(window) < full:
                break
            done, stable = 0, []
            for token in self.merged(window.copy()):
                if done + len(token) > len(window) - self.lookahead:
                    break
                stable.append(token)
                done += len(token)
            yield from stable
            window = window[done:]
        yield from self.merged(window)

    def symbols(self, piece: str) -> Iterator[str]:
        parts = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_alphabet)
        yield from parts[:-1]
        yield parts[-1] + self.end

    def stream_piece(self, piece: str) -> Iterator[bytes]:
        """The ids of a piece as they become stable."""
        tokens = self.transduce(self.symbols(piece))
        while some := [self.packed[x] for x in islice(tokens, CHUNK)]:
            yield b"".join(some)

    def encode_piece(self, piece: str) -> bytes:
        return b"".join(self.stream_piece(piece))

    def encode_word(self, word: str) -> bytes:
        """The ids of what stands between white space; words of letters, and those with one mark after, are cut by sight."""
        text = self.normalize(word)
        if text.isalpha():  # only letters, to the library too: newer ones aren't letters here
            return self.known[text]
        if text[-1:] in MARKS and text[:-1].isalpha():
            return self.known[text[:-1]] + self.known[text[-1]]
        return b"".join(map(self.known.__getitem__, self.cut(text)))

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.nfc and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.translate(self.lower_there) if not self.lower_there.keys().isdisjoint(map(ord, text)) else text
        # by character: a final sigma is lowered like any other
        return text.replace("Σ", "σ").lower() if self.lower else text

    def stream(self, text: str | None) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in parts."""
        at = 0
        for m in self.specials.finditer(text) if text and self.specials else ():
            yield from self.plain(text, at, m.start())
            yield self.special[m[0]].to_bytes(4, "little")
            at = m.end()
        if text:
            yield from self.plain(text, at, len(text))

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))

    def cut(self, text: str) -> list[str]:
        """The pieces of a normalised text."""
        if text.isascii() or self.symbols_there.isdisjoint(text):
            return self.pieces.findall(text)
        # a symbol of this table stands for the characters that are symbols to the library
        stand, held = "\ue000", iter([c for c in text if c in self.symbols_there or c == "\ue000"])
        out = self.pieces.findall("".join(stand if c in self.symbols_there else c for c in text))
        return ["".join(next(held) if c == stand else c for c in x) for x in out]

    def plain(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """The ids of a part without special tokens. No piece reaches over white space, so what lies between is remembered
        as it is written."""
        while at < end:
            m = BLANK.search(text, min(at + BLOCK, end), end)
            stop = m.start() if m else end
            block, at = text if stop - at == len(text) else text[at:stop], stop
            if len(block) > 2 * BLOCK or CONTROLS.search(block):  # one long run, or str.split() would cut too often
                for piece in self.cut(self.normalize(block)):
                    yield from [self.known[piece]] if len(piece) < BLOCK else self.stream_piece(piece)
            else:
                yield b"".join(map(self.known_words.__getitem__, block.split()))

    def decode(self, ids: bytes, readable: bool = False) -> Iterator[str]:
        """The text of the ids in parts. The file names no decoder, so the library joins the tokens as they are written
        with blanks; `readable` turns bytes and word ends back into text instead."""
        machine = Decoder(self, readable)
        for at in range(0, len(ids), 4 * CHUNK):
            yield machine.feed(unpacked(ids[at : at + 4 * CHUNK]))
        yield machine.close()


class Remembered(dict):
    """Results of a function of a string, computed when first asked for; keeps REMEMBERED of them."""

    def __init__(self, made: Callable[[str], bytes]) -> None:
        super().__init__()
        self.made = made

    def __missing__(self, key: str) -> bytes:
        out = self.made(key)
        if len(self) < REMEMBERED and len(key) <= 64:
            self[key] = out
        return out


def unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


class Decoder:
    """Ids to text, incrementally. The state is whether a token went before or, of the byte-to-text machine (`readable`),
    the bytes of an unfinished character."""

    def __init__(self, tokenizer: Tokenizer, readable: bool = False) -> None:
        self.surface, self.bytes, self.readable, self.begun = tokenizer.surface, tokenizer.bytes, readable, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if self.readable:
            return self.utf8.decode(b"".join(map(self.bytes.__getitem__, ids)))
        out = " " * (self.begun and len(ids) > 0) + " ".join(map(self.surface.__getitem__, ids))
        self.begun = self.begun or len(ids) > 0
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", True)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One per process and file."""
    return Tokenizer(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, readable_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids, of the decoded text and of what the byte-to-text machine gives, a row per
    row of `docs`; `path` is that of the tokenizer's file on every executor."""

    def hashes(made: Tokenizer, text: str | None) -> tuple[int, str, str, str]:
        n, ids_hash, machines = 0, hashlib.sha256(), [(Decoder(made, x), hashlib.sha256()) for x in (False, True)]
        for part in made.stream(text):
            ids_hash.update(part)
            ids = unpacked(part)
            n += len(ids)
            for machine, seen in machines:
                seen.update(machine.feed(ids).encode("utf-8", "surrogatepass"))
        for machine, seen in machines:
            seen.update(machine.close().encode())
        return n, ids_hash.hexdigest(), *(seen.hexdigest() for _, seen in machines)

    def body(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = tokenizer(path)
        rows = zip(*(hashes(made, x.as_py()) for x in batch.column("text")), strict=True)
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        columns = [pa.array(x, pa.int64() if k == 0 else pa.string()) for k, x in enumerate(rows)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return map_batches(docs.select("doc_id", "text"), body, SCHEMA)
