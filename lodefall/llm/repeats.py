"""Removal of long repeated byte strings by longest-previous-factor arrays over suffix orders, across all documents.

Every string of LENGTH bytes has LENGTH - GRAM + 1 grams of GRAM bytes. Of these the one whose first 8 bytes hash least (the leftmost
of equals) is its anchor, so equal strings have equal anchors at equal places, and two can only be equal if their anchors are. An anchor's
context is the text up to SLACK = LENGTH - GRAM bytes to either side of it, cut off at the document's ends: it holds all strings
that can have this anchor.

1. Anchors are counted by their gram. One that is met once decides nothing more; where all contexts of a gram are equal, each of
   them repeats as a whole.
2. Of a gram with several contexts, those met twice or more repeat as a whole, and one of each kind goes with those met once
   into a suffix order: left side, a symbol that stands for the gram, right side. A suffix is sorted by its first SLACK + 1 symbols, which
   hold a string of LENGTH bytes. The previous and next smaller position in that order give the longest earlier match (previous
   factor), with its source; where it is at least SLACK + 1, the later string is a copy of the source.
3. A gram with more than HOT contexts (a passage that very many documents share) is split by ranges of starts: all strings that start in a range
   have a part of the left and of the right side, which becomes part of a new gram. In each round most contexts end up alone. So no
   group grows with the input, and no pair of one is left out.

Texts are shuffled only if they hold a context to compare or a byte to remove. Grams and contexts are compared by 64 bits each.

Matches never cross documents. keep="none" removes every copy, keep="first" all but the first of each string, in the order of doc_id (nulls first), then
of the text's hash, then of place; of rows with equal doc_id and text every row then keeps the same. Defined results: null is the
empty text; texts of under LENGTH bytes keep all; repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import bounded, cut, join_docs, ship, sieved, slices, text_hash

LENGTH, GRAM = 400, 250
SLACK = LENGTH - GRAM
WINDOW = SLACK + 1
#: Bytes hashed at once; contexts of a gram above which it is split; contexts sorted at once; ranges of starts by which contexts that can't match
#: are left out, and those into which a gram is split.
STRETCH, HOT, SORTED, PARTS, SPLIT = 1 << 19, 4096, 4096, 8, 6

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(13).integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_UP, _DOWN = powers(_BASE, STRETCH + 4 * LENGTH), powers(pow(_BASE, -1, 2**64), STRETCH + 4 * LENGTH)


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of each hash spread over all of it."""
    for _ in range(2):
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def least_of_windows(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each `size` neighbours: from the least up to, and from, each multiple of `size`."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % size, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, size)
    up_to = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - size + 1], up_to[size - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document, place in it, and the hashes of gram and context of each anchor, in order. Documents lie behind each other in `data`,
    the k-th from bounds[k] to bounds[k + 1]."""
    begins, ends, after = bounds[:-1], bounds[1:], -1
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        low, high = max(0, at - SLACK), min(len(data), at + STRETCH + LENGTH + SLACK)
        n = min(STRETCH, len(data) - LENGTH + 1 - at)
        # windows that lie in one document
        some = slice(np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + n))
        first, behind = np.clip(begins[some] - at, 0, n), np.clip(ends[some] - LENGTH + 1 - at, 0, n)
        long = behind > first
        if not long.any():
            continue
        inside = np.zeros(n + 1, np.int8)
        inside[first[long]] += 1
        inside[behind[long]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        own = data[low:high]
        sums = np.zeros(len(own) + 1, _U)
        np.cumsum(_TABLE[own] * _UP[: len(own)], out=sums[1:])
        head = np.lib.stride_tricks.as_strided(own[at - low :].view(), (n + SLACK, 8), (1, 1))
        head = np.ascontiguousarray(head).view(_U).ravel() * _U(_BASE)
        key = ((head >> _U(32)) << _U(32)) | np.arange(at - low, at - low + n + SLACK, dtype=_U)
        place = (least_of_windows(key, WINDOW)[inside] & _U(0xFFFFFFFF)).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        place = place[place + low > after]
        if not len(place):
            continue
        after = int(place[-1]) + low
        doc = np.searchsorted(ends, place + low, "right")
        left, right = np.maximum(begins[doc] - low, place - SLACK), np.minimum(ends[doc] - low, place + LENGTH)
        part = lambda a, b: (sums[b] - sums[a]) * _DOWN[a]  # noqa: B023, E731
        gram = mixed(part(place, place + GRAM))
        sides = mixed(part(left, place) + (place - left).astype(_U)) * _U(3) + mixed(part(place + GRAM, right) + (right - place).astype(_U))
        yield doc, place + low - begins[doc], gram.view(np.int64), mixed(sides).view(np.int64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts behind each other, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.empty(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            for _, _, gram, sides in anchors(*utf8(part.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(sides)], ["gram", "sides"])


PLACED = "doc_id long, th long, first long, last long, gram long, sides long"


def placed(merge: bool):  # noqa: ANN201
    """Anchors with their places; with `merge` neighbours of equal gram and context (of a periodic text) are one row from first to last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, th = part.column("doc_id"), part.column("th")
                for doc, at, gram, sides in anchors(*utf8(part.column("text"))):
                    same = (doc[1:] == doc[:-1]) & (gram[1:] == gram[:-1]) & (sides[1:] == sides[:-1]) & (at[1:] - at[:-1] <= SLACK)
                    begin = np.flatnonzero(np.r_[True, ~(same & merge)])
                    end = np.append(begin[1:], len(at)) - 1
                    doc = pa.array(doc[begin])
                    arrays = [ids.take(doc), th.take(doc), *(pa.array(x) for x in (at[begin], at[end], gram[begin], sides[begin]))]
                    yield pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in PLACED.split(", ")])

    return run


# --- suffix order of contexts -----------------------------------------------------------------------------------------


def ranked(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones, from 1."""
    order = np.argsort(x)
    by_value = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[True, by_value[1:] != by_value[:-1]])
    return out


def suffix_order(symbols: np.ndarray, depth: int, some: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """`some` positions by their suffixes' first `depth` symbols (equals by position), and the ranks of all positions by their first 1 and by ever
    more symbols: each round puts as many ranks side by side as 63 bits hold, and ranks these."""
    n = len(symbols)
    rank, length = symbols - symbols.min() + 1, 1
    if int(rank.max()) > 1 << 20:
        rank = ranked(rank)
    ranks = [(1, rank)]
    while 2 * length <= depth:
        bits = int(rank.max()).bit_length()
        times = min(63 // bits, depth // length, 4)
        wide = rank.copy()
        for k in range(1, times):
            wide <<= bits
            wide[: max(0, n - k * length)] |= rank[k * length :]
        rank, length = ranked(wide), times * length
        ranks.append((length, rank))
    padded = np.append(rank, 0)
    rest = padded[np.minimum(some + depth - length, n)]
    return some[np.lexsort((some, rest, rank[some]))], ranks


def equal(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at a and b share their first `depth` symbols; both have as many."""
    length, rank = ranks[-1]
    far = depth - length
    return (rank[a] == rank[b]) & (rank[a + far] == rank[b + far])


def common(ranks: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b, `depth` at most."""
    out, n = np.zeros(len(a), np.int64), len(ranks[0][1])
    for length, rank in reversed(ranks):
        for _ in range(4):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += length * ((a + out < n) & (b + out < n) & (rank[x] == rank[y]))
    return np.minimum(out, depth)


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, or -1."""
    out = np.arange(len(x)) - 1
    todo = np.flatnonzero((out >= 0) & (x[out] > x))
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
        todo = todo[x[out[todo]] > x[todo]]
    return out


def smaller_neighbours(order: np.ndarray) -> list[np.ndarray]:
    """For each place in suffix order that of the previous and that of the next smaller position, or -1."""
    behind = len(order) - 1 - previous_smaller(order[::-1])[::-1]
    behind[behind == len(order)] = -1
    return [previous_smaller(order), behind]


def longest_previous_factors(symbols: np.ndarray, depth: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`some` positions in suffix order, the length (`depth` at most) of the longest factor that starts at each and at an earlier one of them,
    and that earlier one (-1: none). The earlier suffix that shares most stands, in suffix order, at the previous or at the next smaller position."""
    order, ranks = suffix_order(symbols, depth, some)
    length, source = np.zeros(len(order), np.int64), np.full(len(order), -1)
    for near in smaller_neighbours(order):
        there = np.flatnonzero(near >= 0)
        shared = common(ranks, order[there], order[near[there]], depth)
        better = shared > length[there]
        length[there[better]], source[there[better]] = shared[better], order[near[there[better]]]
    return order, length, source


def previous_copies(symbols: np.ndarray, depth: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions among `some` whose longest previous factor has `depth` symbols, and an earlier one of them for each; all have as many symbols."""
    order, ranks = suffix_order(symbols, depth, some)
    found, source = [], []
    for near in smaller_neighbours(order):
        there = np.flatnonzero(near >= 0)
        there = there[equal(ranks, order[there], order[near[there]], depth)]
        found.append(order[there])
        source.append(order[near[there]])
    return np.concatenate(found), np.concatenate(source)


CONTEXT = "doc_id long, th long, at long, key long, once boolean, base long, slack long, left binary, right binary"
COLUMNS = [x.split(" ")[0] for x in CONTEXT.split(", ")]


def matrix(sides: list[bytes], width: int, from_right: bool) -> tuple[np.ndarray, np.ndarray]:
    """The sides as rows of `width` symbols, counted from the gram outwards, and their sizes; 256 behind their ends."""
    sizes = np.fromiter(map(len, sides), np.int64, len(sides))
    out = np.full((len(sides), width), 256, np.int64)
    flat = np.frombuffer(b"".join(sides), np.uint8)
    row = np.repeat(np.arange(len(sides)), sizes)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, np.repeat(sizes, sizes) - 1 - col if from_right else col] = flat
    return out, sizes


def may_match(key: np.ndarray, left: np.ndarray, right: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest distance from the gram at which a string of each context may start that another of its key has (the least is
    greater where there is none): in each of PARTS ranges of starts, contexts must agree in what all its strings have."""
    least, most = np.full(len(key), np.iinfo(np.int64).max), np.full(len(key), -1)
    width = left.shape[1]
    weight = powers(_BASE, 2 * width + 2)
    sums = [np.concatenate([np.zeros((len(key), 1), _U), np.cumsum((x.astype(_U) + _U(1)) * w, axis=1, dtype=_U)], axis=1) for x, w in ((left, weight[1 : width + 1]), (right, weight[width + 1 : -1]))]
    for part in range(PARTS):
        low, high = (slack + 1) * part // PARTS, (slack + 1) * (part + 1) // PARTS - 1
        if high < low:
            continue
        fits = np.ones(len(key), bool) if low == 0 else left[:, low - 1] < 256
        if high < slack:
            fits &= right[:, slack - high - 1] < 256
        h = mixed(sums[0][:, low] + sums[1][:, slack - high] + mixed(key.view(_U)))
        some = np.flatnonzero(fits)
        found = ranked(h[some]) if len(some) else some
        some = some[np.bincount(found)[found] > 1]
        least[some], most[some] = np.minimum(least[some], low), np.maximum(most[some], high)
    return least, most


def starts_of_copies(rows: dict[str, np.ndarray | list], keep_first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, and the first and last distance from the gram at which a string starts that another context of its key holds too.
    Contexts come in order, all with one slack; with keep_first the first of equal strings isn't reported."""
    key, slack = rows["key"], int(rows["slack"][0])
    width = max(1, slack)
    (left, n_left), (right, n_right) = matrix(rows["left"], width, True), matrix(rows["right"], width, False)
    least, most = may_match(key, left, right, slack)
    some = np.flatnonzero(most >= least)
    none = np.empty(0, np.int64)
    if not len(some):
        return none, none, none
    left, right, least, most = left[some], right[some], least[some], most[some]
    n_left, n_right = np.minimum(n_left[some], most), np.minimum(n_right[some], slack - least)
    # each context as left side, gram, right side, and an end that no other context has
    stands = 256 + np.unique(key[some], return_inverse=True)[1]
    ends = int(stands.max()) + 1 + np.arange(len(some))
    table = np.concatenate([left[:, ::-1], stands[:, None], right, ends[:, None]], axis=1)
    column = np.arange(2 * width + 2)[None, :]
    used = (column >= width - n_left[:, None]) & ((column <= width + n_right[:, None]) | (column == 2 * width + 1))
    symbols = table[used]
    of, at = np.nonzero(used)
    away = width - at
    # starts whose string ends inside the context
    may = (away >= 0) & (away <= slack) & (slack - away <= n_right[of])
    copy, source = previous_copies(symbols, slack + 1, np.flatnonzero(may))
    hit = np.zeros(len(symbols), bool)
    hit[copy] = True
    if not keep_first:
        hit[source] = True
    place = np.flatnonzero(hit)
    new = np.r_[True, (np.diff(place) != 1) | (of[place[1:]] != of[place[:-1]])] if len(place) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place)) - 1 if len(begin) else begin
    return some[of[place[begin]]], away[place[end]], away[place[begin]]


NO_ID = -(2**63) + 13
SPANS = "doc_id long, th long, start long, stop long"


def compared(keep_first: bool):  # noqa: ANN201
    """Spans of copies out of contexts sorted by key, whole keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            # rows of one table row that was there twice lie behind each other
            ids = rows.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy()
            names = [ids, *(rows.column(x).to_numpy() for x in ("th", "at", "key", "base"))]
            new = np.logical_or.reduce([x[1:] != x[:-1] for x in names])
            rows = rows.take(pa.array(np.flatnonzero(np.r_[True, new])))
            get = lambda x: rows.column(x).to_numpy()
            data = {x: get(x) for x in ("th", "at", "key", "once", "base", "slack")} | {x: rows.column(x).to_pylist() for x in ("left", "right")}
            # contexts of one slack are ordered together; there is one, or a few of neighbouring size
            found = []
            for slack in np.unique(data["slack"]).tolist():
                mine = np.flatnonzero(data["slack"] == slack)
                part = {x: v[mine] if isinstance(v, np.ndarray) else [v[k] for k in mine] for x, v in data.items()} if len(mine) < len(data["slack"]) else data
                of, near, far = starts_of_copies(part, keep_first)
                found.append((mine[of], near, far))
            of, near, far = (np.concatenate(x) for x in zip(*found, strict=True))
            if not keep_first:  # contexts met more than once are removed as a whole anyway
                mine = data["once"][of].astype(bool)
                of, near, far = of[mine], near[mine], far[mine]
            at = data["at"][of] - data["base"][of]
            ids = rows.column("doc_id").combine_chunks().take(pa.array(of))
            return pa.RecordBatch.from_arrays([ids, pa.array(data["th"][of]), pa.array(at - far), pa.array(at - near + LENGTH)], ["doc_id", "th", "start", "stop"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= SORTED:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = rows.column("key").to_numpy()
                last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
                if last:
                    yield flush(rows.slice(0, last))
                held = rows.slice(last).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per wanted context of each text, with both its sides."""
    for batch in batches:
        for part in slices(batch):
            out: list[tuple] = []
            for doc_id, th, text, wanted in zip(*(part.column(x).to_pylist() for x in ("doc_id", "th", "text", "wanted")), strict=True):
                own = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    at = w["at"]
                    out.append((doc_id, th, at, w["gram"], w["once"], 0, SLACK, own[max(0, at - SLACK) : at], own[at + GRAM : at + LENGTH]))
            yield rows_of(out)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()] * 2
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], COLUMNS)


def split(rows: DataFrame) -> DataFrame:
    """Each context once for each of SPLIT ranges of starts, with what all strings of the range have as part of its key and the rest as sides."""
    side = lambda x, a, n: F.when(n > 0, F.substring(x, F.greatest(a, F.lit(1)).cast("int"), n.cast("int"))).otherwise(F.lit(b""))
    size, parts = F.octet_length("left"), []
    for k in range(SPLIT):
        low = F.floor((F.col("slack") + 1) * k / SPLIT)
        high = F.floor((F.col("slack") + 1) * (k + 1) / SPLIT) - 1
        shared, rest = F.col("slack") - high, high - low
        outer = F.least(rest, size - low)
        fits = (high >= low) & (size >= low) & (F.octet_length("right") >= shared)
        new = F.struct(
            F.xxhash64("key", low, side("left", size - low + 1, low), side("right", F.lit(1), shared)).alias("key"),
            (F.col("base") + low).alias("base"),
            rest.alias("slack"),
            side("left", size - low - outer + 1, outer).alias("left"),
            side("right", shared + 1, rest).alias("right"),
        )
        parts.append(F.when(fits, new))
    kept = rows.select("doc_id", "th", "at", "once", F.explode(F.array_compact(F.array(*parts))).alias("x"))
    return kept.select("doc_id", "th", "at", "x.key", "once", "x.base", "x.slack", "x.left", "x.right")


def copies(found: DataFrame, keep_first: bool, hot: int) -> DataFrame:
    """Spans of contexts that others of their key repeat in part, in rounds of splitting; `found` are those of hot grams. Contexts that a round leaves
    alone with their key, which are most, are not written."""
    out = found.sparkSession.createDataFrame([], SPANS)
    for _ in range(SLACK.bit_length() + 1):
        found = split(found)
        sizes = cut(found.groupBy("key").agg(F.count("*").alias("n"), F.max("slack").alias("most")).where("n > 1"))
        met = lambda where: bounded(sizes.where(where).select("key"))  # noqa: B023, E731
        out = out.unionByName(ordered(cut(found.join(met(F.col("n") <= hot), "key", "left_semi")), keep_first))
        # the strings themselves as keys: all of a key are equal
        whole, start = cut(found.join(met((F.col("n") > hot) & (F.col("most") == 0)), "key", "left_semi").drop("left", "right")), F.col("at") - F.col("base")
        if keep_first:
            first = whole.groupBy("key").agg(F.min(F.struct("doc_id", "th", "at")).alias("one"))
            gone = whole.join(first, "key").where(~F.struct("doc_id", "th", "at").eqNullSafe(F.col("one")))
        else:
            gone = whole.where("once")
        out = out.unionByName(gone.select("doc_id", "th", start.alias("start"), (start + LENGTH).alias("stop")))
        if sizes.where((F.col("n") > hot) & (F.col("most") > 0)).limit(1).count() == 0:
            break
        found = cut(found.join(met((F.col("n") > hot) & (F.col("most") > 0)), "key", "left_semi"))
    return out


def ordered(found: DataFrame, keep_first: bool) -> DataFrame:
    """Spans of copies among contexts; keys of up to HOT rows each."""
    return found.repartition("key").sortWithinPartitions("key", "doc_id", "th", "at").mapInArrow(compared(keep_first), SPANS)


def hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("th"))


def repeated_spans(docs: DataFrame, keep: str = "none", hot: int = HOT) -> DataFrame:
    """doc_id, th, start and stop of what is to go: strings of LENGTH bytes and more of which each string of LENGTH bytes is met
    again (keep="none") or was met before (keep="first"). Spans overlap."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    ship(docs.sparkSession)
    keep_first = keep == "first"
    texts = hashed(docs).where(F.octet_length("text") >= LENGTH)
    by_gram = texts.select("text").mapInArrow(grams, "gram long, sides long").groupBy("gram")
    met = by_gram.agg(F.count("*").alias("n"), F.min("sides").alias("a"), F.max("sides").alias("b")).where("n > 1")
    met = cut(met.select(F.col("gram").alias("met"), (F.col("a") != F.col("b")).alias("several")))
    rows = sieved(texts.mapInArrow(placed(not keep_first), PLACED), F.col("gram"), met, F.col("met"), "__lodefall_met").where("__lodefall_met").drop("__lodefall_met")
    rows = cut(rows.join(met, F.col("gram") == F.col("met")).drop("met"))
    span = [F.greatest(F.col("first") - SLACK, F.lit(0)).alias("start"), (F.col("last") + LENGTH).alias("stop")]

    times = F.sum(F.when(F.col("first") < F.col("last"), 2).otherwise(1)).alias("n")
    of_sides = cut(rows.where(F.lit(keep_first) | F.col("several")).groupBy("gram", "sides").agg(times, F.min(F.struct("doc_id", "th", "first")).alias("one"), F.first("several").alias("several")))
    again = of_sides.where("n > 1").select(F.col("gram").alias("g"), F.col("sides").alias("s"), "one")
    same = (F.col("gram") == F.col("g")) & (F.col("sides") == F.col("s"))
    if keep_first:
        whole = rows.join(again, same).where(~F.struct("doc_id", "th", "first").eqNullSafe(F.col("one"))).select("doc_id", "th", *span)
    else:
        whole = rows.where("not several").select("doc_id", "th", *span)
        whole = whole.unionByName(rows.where("several").join(again, same, "left_semi").select("doc_id", "th", *span))

    # grams with a context whose strings aren't all decided: one of each of their contexts is cut out of its text
    several = of_sides.where("several").groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least"))
    several = cut((several if keep_first else several.where("least = 1")).select(F.col("gram").alias("g"), (F.col("kinds") > hot).alias("hot")))
    one = F.struct(F.col("one.first").alias("at"), "gram", (F.col("n") == 1).alias("once")).alias("w")
    wanted = cut(of_sides.join(several, F.col("gram") == F.col("g")).select("one.doc_id", "one.th", "hot", one))
    few = ordered(cut_out(texts, wanted.where("not hot")), keep_first)
    if several.where("hot").limit(1).count():
        few = few.unionByName(copies(cut(cut_out(texts, wanted.where("hot"))), keep_first, hot))
    return whole.unionByName(few)


def cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts that `wanted` names, with their sides."""
    by_text = cut(wanted.groupBy("doc_id", "th").agg(F.collect_list("w").alias("wanted")))
    some = sieved(texts, F.xxhash64("doc_id", "th"), by_text, F.xxhash64("doc_id", "th"), "__lodefall_met")
    return join_docs(some.where("__lodefall_met").drop("__lodefall_met"), by_text, "inner").mapInArrow(contexts, CONTEXT)


CLEANED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stays of each text without its spans."""
    for batch in batches:
        for part in slices(batch):
            out: list[tuple] = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass")
                kept, at, n, gone = [], 0, 0, 0
                reach = -1
                for start, stop in sorted((x["start"], min(x["stop"], len(own))) for x in spans or ()):
                    if start > reach:
                        kept.append(own[at:start])
                        n += 1
                        gone -= start
                        gone += max(stop, start)
                        at = reach = max(stop, start)
                    elif stop > reach:
                        gone += stop - reach
                        at = reach = stop
                kept.append(own[at:])
                out.append((len(own), gone, n, b"".join(kept)))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, keep: str = "none", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs of removed bytes) and kept (the other bytes), a row per row of `docs`."""
    spans = repeated_spans(docs, keep, hot).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = cut(spans)
    rows = sieved(hashed(docs), F.xxhash64("doc_id", "th"), spans, F.xxhash64("doc_id", "th"), "__lodefall_met")
    mine = join_docs(rows.where("__lodefall_met").drop("__lodefall_met"), spans, "left").select("doc_id", "text", "spans").mapInArrow(cleaned, CLEANED)
    zero = F.lit(0).cast("long")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    other = rows.where("not __lodefall_met").select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept"))
    return mine.unionByName(other)
