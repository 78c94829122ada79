"""Alignment of the tokens of two tokenizers, A byte-level and B of pieces, over the bytes of blank + text.

The tokens of B are a static index of disjoint intervals, sorted by their ends. Each token of A asks it by bisection which is the last
token of B that it overlaps; the first is the last of the token before it, or the next. A gap between two tokens of A is spanned if a token of B
overlaps both; gaps that are never spanned are where both sides end, and so become the boundaries of groups.

Neither tokenizer has a token over a blank that stands between two characters of which the right one is no white space and the left one no
blank, so a text is cut there. Stretches that a worker hasn't met are aligned many at once, behind each other, and each one's result is remembered
(LEARNT of them, then anew). A text with a stretch whose bytes don't come back from either side's tokens is compared as a whole, and
has no tokens if it differs.

Each text's links are written out once, as pairs of ids with their number. Counts of pairs over documents are added up in tasks, then by pair.
A text's links need these counts back: the most frequent pairs (at most FREQUENT, 5 MB) are given to every task, and only a text's other
pairs, each with its number of links, are joined by pair.

Defined results: null, empty and unlike texts have no tokens: zeros, and an empty groups_sha256; repeated rows and ids count and get
a row each; the strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefall.llm.bpe import byte_alphabet
from lodefall.llm.common import cut, ship, slices

#: Stretches that a worker remembers, characters of texts that are aligned at once, links of a group above which equal ids are taken together.
LEARNT, TOGETHER, WIDE = 400_000, 1 << 20, 4096
#: Pairs that a task counts before it passes them on, and pairs whose counts every task gets.
COUNTED, FREQUENT = 1 << 21, 1 << 18
#: A pair is A's id times this plus B's id; ids of both sides are smaller.
STEP = 1 << 16

#: Characters up to which all versions of Unicode agree, and the longest stretch of them that the quicker encoder gets.
LATIN, SHORT = "\u024f", 200
#: How byte-level tokenizers of this kind cut a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

Links = tuple[np.ndarray, np.ndarray]


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of either side of each group, in order; both sides end at the same byte."""
    last = np.searchsorted(b_ends, a_ends)  # the interval of B that holds the last byte of each token of A
    free = b_ends[last] == a_ends  # it ends there too, so nothing spans the gap behind
    return np.flatnonzero(free), last[free]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those from starts[1] on, and so forth."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Grown:
    """A numpy array that is added to at its end."""

    def __init__(self) -> None:
        self.data, self.size = np.empty(1 << 16, np.int64), 0

    def add(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(need, len(self.data)), np.int64)])
        self.data[self.size : need] = more
        self.size = need


class Pair:
    """Two tokenizers, and the stretches that were aligned with them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = {c: k for k, c in enumerate(byte_alphabet())}
        spelled = lambda x: bytes(map(of.__getitem__, x)) if all(c in of for c in x) else x.encode()
        self.a_bytes = [spelled(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.b_bytes = [self.piece(i) for i in range(self.b.get_piece_size())]
        assert max(len(self.a_bytes), len(self.b_bytes)) <= STEP
        self.quick = self.same_by_ranks(a_path)
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        # ids as they are written inside a group and at the end of its side
        self.written = [[np.array([f"{i}{mark}" for i in range(len(x))], object) for mark in marks] for x, marks in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.forget()

    def same_by_ranks(self, path: str):  # noqa: ANN201
        """A's encoder by ranks, which is faster, where each rule's result has the next id, as ranks need it; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        rules = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        letters = len(self.a_bytes) - len(rules) - len(spec["added_tokens"])
        if any(spec["model"]["vocab"].get("".join(x)) != letters + k for k, x in enumerate(rules)) or spec["pre_tokenizer"] != BYTE_LEVEL or spec["normalizer"]:
            return None
        ranks = {x: k for k, x in enumerate(self.a_bytes[: letters + len(rules)])}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def a_ids(self, text: str, plain: bool) -> np.ndarray:
        if plain and self.quick:
            return np.array(self.quick.encode_ordinary(text), np.int64)
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.unlike: set[str] = set()
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.begin, self.links, self.codes, self.times = (Grown() for _ in range(7))

    def piece(self, i: int) -> bytes:
        x = self.b.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode()

    def learn(self, words: list[str], plain: bool = False) -> None:
        """Aligns stretches, each with a blank before it, at once; those that are unlike their tokens are found by halves. plain: short ones of
        long-known letters, which both encoders of A cut alike, whatever their version of Unicode."""
        if not words:
            return
        joined = " " + " ".join(words)
        own = joined.encode("utf-8", "surrogatepass")
        a = self.a_ids(joined, plain)
        b = np.array(self.b.encode(joined[1:], num_threads=1), np.int64)
        like = all(b"".join(map(table.__getitem__, ids.tolist())) == own for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        a_ends, b_ends = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        stops = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words])
        if like:
            a_last, b_last = groups(a_ends, b_ends)
            closed = a_ends[a_last]
            place = np.searchsorted(closed, stops)
            like = bool((closed[np.minimum(place, len(closed) - 1)] == stops).all())
        if like:
            self.keep(words, a, b, a_last, b_last, place + 1)
        elif len(words) > 1:
            half = len(words) // 2
            self.learn(words[:half], plain)
            self.learn(words[half:], plain)
        else:  # not like its bytes
            self.known[words[0]] = -1
            self.unlike.add(words[0])

    def keep(self, words: list[str], a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, behind: np.ndarray) -> None:
        """Remembers aligned stretches; the k-th has the groups up to behind[k]."""
        a_first, b_first = np.r_[0, a_last[:-1] + 1], np.r_[0, b_last[:-1] + 1]
        wide_a, wide_b = a_last - a_first + 1, b_last - b_first + 1
        n = wide_a * wide_b
        plain = np.where(n > WIDE, 0, n)
        at = spread(np.zeros(len(n), np.int64), plain)
        left, right = np.repeat(a_first, plain) + at // np.repeat(wide_b, plain), np.repeat(b_first, plain) + at % np.repeat(wide_b, plain)
        codes, times = a[left] * STEP + b[right], np.ones(len(left), np.int64)
        if (n > WIDE).any():
            of, more, often = np.repeat(np.arange(len(n)), plain), [], []
            for g in np.flatnonzero(n > WIDE).tolist():
                of_a, of_b = (np.unique(x[i : j + 1], return_counts=True) for x, i, j in ((a, a_first[g], a_last[g]), (b, b_first[g], b_last[g])))
                more.append((of_a[0][:, None] * STEP + of_b[0]).ravel())
                often.append((of_a[1][:, None] * of_b[1]).ravel())
                plain[g] = len(more[-1])
            of = np.concatenate([of, np.repeat(np.flatnonzero(n > WIDE), list(map(len, more)))])
            order = np.argsort(of, kind="stable")
            codes, times = np.concatenate([codes, *more])[order], np.concatenate([times, *often])[order]
        # each group as A's ids, a bar, B's ids, a semicolon
        out = np.empty(len(a) + len(b), object)
        for ids, first, last, own, shift, tables in ((a, a_first, a_last, wide_a, b_first, self.written[0]), (b, b_first, b_last, wide_b, a_last + 1, self.written[1])):
            places = np.arange(len(ids)) + np.repeat(shift, own)
            out[places] = tables[0][ids]
            out[places[last]] = tables[1][ids[last]]
        written = out.tolist()
        before = np.r_[0, behind[:-1]]
        ends = (a_last + b_last + 2)[behind - 1]
        start = 0
        for word, end in zip(words, ends.tolist(), strict=True):
            self.known[word] = len(self.texts)
            self.texts.append("".join(written[start:end])[:-1])
            start = end
        self.n_a.add(np.diff(np.r_[0, a_last[behind - 1] + 1]))
        self.n_b.add(np.diff(np.r_[0, b_last[behind - 1] + 1]))
        self.n_groups.add(behind - before)
        sums = np.r_[0, np.cumsum(plain)]
        self.begin.add(self.codes.size + sums[before])
        self.links.add(sums[behind] - sums[before])
        self.codes.add(codes)
        self.times.add(times)

    def stretches(self, text: str) -> list[str]:
        """The text cut at blanks that no token reaches over; a blank goes before each stretch."""
        words = text.split(" ")
        if "" not in words and not any(map(str.isspace, {w[0] for w in words})):
            return words
        out = [words[0]]
        for last, word in zip(words, words[1:]):
            if word and last and not word[0].isspace():
                out.append(word)
            else:
                out[-1] += " " + word
        return out

    def meet(self, texts: list[str]) -> list[list[str]]:
        """The stretches of some texts, all of them known afterwards."""
        if len(self.texts) > LEARNT:
            self.forget()
        cuts = [self.stretches(x) for x in texts]
        new = set().union(*cuts) - self.known.keys()
        plain, other = [], []
        for w in new:
            if not w or w[0].isspace() or w[-1] == " ":
                self.learn([w])
            else:
                (plain if len(w) <= SHORT and (w.isascii() or max(w) <= LATIN) else other).append(w)
        self.learn(plain, True)
        self.learn(other)
        if self.unlike:
            for k, x in enumerate(cuts):
                if not self.unlike.isdisjoint(x):  # then the whole decides
                    cuts[k] = [texts[k]]
                    if texts[k] not in self.known:
                        self.learn(cuts[k])
        return cuts

    def aligned(self, words: list[str]) -> tuple[int, int, int, str, Links] | None:
        """Tokens of A and B, groups, all groups written out, and the linked pairs in order with their number of links; None for a text unlike its tokens."""
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if ids[0] < 0:
            return None
        at = spread(self.begin.data[ids], self.links.data[ids])
        codes, times = self.codes.data[at], self.times.data[at]
        if len(codes) and times.max() > 1:
            order = np.argsort(codes, kind="stable")
            codes, times = codes[order], times[order]
        else:
            codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        text = ";".join(map(self.texts.__getitem__, ids.tolist()))
        return *(int(x.data[ids].sum()) for x in (self.n_a, self.n_b, self.n_groups)), text, (codes[first], np.add.reduceat(times, first))


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One per process and pair of files."""
    return Pair(a_path, b_path)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with texts of about TOGETHER bytes, or one row."""
    for batch in batches:
        for part in slices(batch):
            step = max(1, part.num_rows * TOGETHER // max(part.nbytes, 1))
            yield from (part.slice(k, step) for k in range(0, part.num_rows, step))


def packed(links: Links) -> bytes:
    """Pairs as differences, and their numbers, compressed."""
    codes, times = links
    wide = np.dtype("<u4") if times.max() < 1 << 32 else np.dtype("<u8")
    raw = np.diff(codes, prepend=0).astype("<u4").tobytes() + times.astype(wide).tobytes()
    return bytes([wide.itemsize]) + len(codes).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> Links:
    wide, n = np.dtype(f"<u{data[0]}"), int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], decompressed_size=n * (4 + wide.itemsize), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, "<u4", n), dtype=np.int64), np.frombuffer(raw, wide, n, 4 * n).astype(np.int64)


ALIGNED = "doc_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each text, with its linked pairs; doc_key tells rows apart once they are written."""
    names = [x.split(" ")[0] for x in ALIGNED.split(", ")]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key = pair(a_path, b_path), TaskContext.get().partitionId() << 40
        for part in parts(batches):
            texts = part.column("text").to_pylist()
            cuts = iter(made.meet([x for x in texts if x]))
            rows: list[tuple] = []
            for text in texts:
                key += 1
                if not text or (found := made.aligned(next(cuts))) is None:
                    rows.append((key, 0, 0, 0, 0, "", None))
                else:
                    n_a, n_b, n_groups, written, links = found
                    rows.append((key, n_a, n_b, n_groups, int(links[1].sum()), hashlib.sha256(written.encode()).hexdigest(), packed(links)))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0], part.column("doc_id"), *columns[1:]], names)

    ship(docs.sparkSession)
    return cut(docs.select("doc_id", "text").mapInArrow(body, ALIGNED))


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> Links:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(n, first)


def pair_counts(found: DataFrame) -> DataFrame:
    """code, n (documents that hold the pair linked) and best (whether that is its A id's highest), written out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, n = [], [], 0
        for batch in batches:
            for data in batch.column("pairs"):
                codes.append(unpacked(data.as_py())[0])
                counts.append(np.ones(len(codes[-1]), np.int64))
                n += len(codes[-1])
                if n > COUNTED:
                    code, total = summed(codes, counts)
                    codes, counts, n = [code], [total], len(code)
                    if n > COUNTED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total)], ["code", "n"])
                        codes, counts, n = [], [], 0
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed(codes, counts)], ["code", "n"])

    counted = cut(found.where("pairs is not null").select("pairs").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    a = F.floor(F.col("code") / STEP)
    # a row for each id of A's vocabulary at most, so 65,536
    most = counted.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return cut(counted.withColumn("a", a).join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def frequent(counts: DataFrame, limit: int = FREQUENT) -> tuple[pa.Table, int]:
    """The rows of all pairs with at least some number of documents, `limit` rows at most, and that number."""
    by_size = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("size")).agg(F.count("*").alias("rows"), F.min("n").alias("least"))
    least, rows = 2**62, 0
    for x in sorted(by_size.collect(), key=lambda x: -x["size"]):  # 250 rows at most
        if rows + x["rows"] > limit:
            break
        rows, least = rows + x["rows"], x["least"]
    return counts.where(F.col("n") >= least).orderBy("code").toArrow(), least


SUMS = "doc_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<code:long,times:long>>"


def alignment(docs: DataFrame, a_path: str, b_path: str, limit: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, a row per row of `docs`; the paths are those of
    the tokenizers' files on every executor."""
    found = aligned_texts(docs, a_path, b_path)
    counts = pair_counts(found)
    known, least = frequent(counts, limit)
    given = docs.sparkSession.sparkContext.broadcast(tuple(known.column(x).to_numpy() for x in ("code", "n", "best")))
    item = pa.struct([("code", pa.int64()), ("times", pa.int64())])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = given.value
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column("pairs"):
                if not data.is_valid:
                    rows.append((0, 0, []))
                    continue
                codes, times = unpacked(data.as_py())
                at = np.searchsorted(code, codes)
                there = at < len(code)
                there[there] = code[at[there]] == codes[there]
                at, often = at[there], times[there]
                rest = [{"code": c, "times": t} for c, t in zip(codes[~there].tolist(), times[~there].tolist(), strict=True)]
                rows.append((int(often[best[at]].sum()), int((often * n[at]).sum()), rest))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(item)), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "n_best", "count_sum", "rest"])

    told = found.mapInArrow(body, SUMS)
    if counts.where(F.col("n") < least).limit(1).count():
        told = cut(told)
        rare = told.select("doc_key", F.inline("rest")).join(counts.where(F.col("n") < least), "code")
        more = rare.groupBy("doc_key").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
        plus = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0).cast("long"))).alias(x)
        told = told.drop("rest").join(more, "doc_key", "left").withColumns({"n_best": plus("n_best", "best_more"), "count_sum": plus("count_sum", "sum_more")})
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
