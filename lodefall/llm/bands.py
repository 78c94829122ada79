"""A numeric band join: for each item the lines whose unit value lies near its price, as sums over all and the nearest few.

Values are whole cents. An item of price p pairs with the lines of other items whose gap |u - p| is at most 10, or with
1000 * gap <= 2 * p; that is gap <= max(10, floor(p / 500)), its reach.

Lines of one u differ only in their names, so the line side is reduced to a row per u with the number and the sum of
checksums of its lines and those lines that can be among the first FIRST of any item: taken in order, at most FIRST of
each line item, 2 * FIRST in all (leaving out one item's own takes away FIRST at most). It is reduced in tasks before the shuffle, so a u that
a third of all lines has costs each task a few rows, and again while sorted partitions stream by. Both sides are then sorted
into blocks with the least and greatest value as zone map: items by range of (p, item), so that one price may fill any
number of blocks, lines by cell, a piece of the number line that is never much wider than what an item reaches. Blocks meet
in a cell, pairs whose zones don't overlap are left out, and a pair is compared in numpy tiles of STRIP items; it gives sums and at most FIRST
lines an item, and these are merged by item. An item's own lines are found by item_id in a join that Spark can split, and
are taken off the sums. Nothing that grows with the input is broadcast, collected or met in one task.

Defined results: lines null in sale_id, item_id, quantity or amount, of quantity 0, or of a value that is no number or is beyond
2^62 cents never pair, nor do items null in item_id or in price (same bounds); they have the row of an item without pairs. A null line_no is
the empty word in the checksum and comes first. Repeated lines count and rank each; repeated items have all rows each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.llm.common import cut, ship

#: Pairs that each item keeps; lines that a task reduces at once; items of a block and of a tile; values of a line block.
FIRST, CHUNK, BLOCK, STRIP, VALUES = 5, 1 << 18, 512, 64, 256
#: Gap that always pairs, and the part of the price that does.
NEAR, PART = 10, 500
#: Cells are 2^8 wide up to 2^17, and beyond that a 512th of their power of two.
WIDTH, LINEAR = 8, 17
LIMIT, NONE = 2.0**62, -(2**63)

LINES = ["u", "sale_id", "line_no", "item_id", "n", "crc"]
Arrays = list[np.ndarray]


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5) in doubles as a whole number; null where it is none."""
    x = F.floor(100 * value + 0.5)
    return F.when(~F.isnan(value) & (F.abs(100 * value + 0.5) < LIMIT), x)


def unit(amount: Column, quantity: Column) -> Column:
    """floor((2 * amount + quantity) / (2 * quantity)) in whole numbers; null for quantity 0."""
    q = quantity.cast("long")
    up, down = F.when(q < 0, -1).otherwise(1) * (2 * amount + q), 2 * F.abs(q)
    return F.when(q != 0, F.call_function("div", up - F.pmod(up, down), down))


def reach(p: np.ndarray) -> np.ndarray:
    return np.maximum(NEAR, p // PART)


def cell_bounds(u: int) -> tuple[int, int]:
    """The cell of a value and the least value of the next cell."""
    if u < 0:
        v = ~u
        shift = WIDTH + max(0, v.bit_length() - LINEAR)
        return ~((shift - WIDTH << 40) + (v >> shift)), ~(v >> shift << shift) + 1
    shift = WIDTH + max(0, u.bit_length() - LINEAR)
    return (shift - WIDTH << 40) + (u >> shift), (u >> shift) + 1 << shift


def cells(values: np.ndarray) -> np.ndarray:
    """The cell of each of ascending values."""
    out, at = np.empty(len(values), np.int64), 0
    while at < len(values):
        cell, following = cell_bounds(int(values[at]))
        end = int(np.searchsorted(values, following))
        out[at:end] = cell
        at = end
    return out


def rank_in(*keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(starts, np.diff(np.append(starts, len(new))))


def reduced(rows: Arrays) -> Arrays:
    """Rows (LINES) sorted by u and in order; each u has its sums in its first row, and only the lines that can matter."""
    u, sale, line, item, n, crc = rows
    if not len(u):
        return rows
    order = np.lexsort((line, sale, item, u))
    order = order[rank_in(u[order], item[order]) < FIRST]
    order = order[np.lexsort((item[order], line[order], sale[order], u[order]))]
    at = rank_in(u[order])
    order, at = order[at < 2 * FIRST], at[at < 2 * FIRST]
    by_value = np.argsort(u, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(u[by_value]) != 0])
    sums = [np.zeros(len(order), np.int64) for _ in range(2)]
    for total, x in zip(sums, (n, crc), strict=True):
        total[at == 0] = np.add.reduceat(x[by_value], starts)
    return [u[order], sale[order], line[order], item[order], *sums]


def gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[Arrays]:
    for batch in batches:
        yield [batch.column(x).to_numpy(zero_copy_only=False) for x in names]


def joined(parts: list[Arrays]) -> Arrays:
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if len(parts) > 1 else parts[0]


def batch_of(rows: Arrays, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as they come, reduced CHUNK at a time."""
    held: list[Arrays] = []
    for rows in gathered(batches, LINES):
        held.append(rows)
        if sum(len(x[0]) for x in held) >= CHUNK:
            yield batch_of(reduced(joined(held)), LINES)
            held = []
    if held:
        yield batch_of(reduced(joined(held)), LINES)


def runs(batches: Iterator[pa.RecordBatch], names: list[str], key: str, shrink: Callable[[Arrays], Arrays]) -> Iterator[Arrays]:
    """Rows sorted by `key`, in parts that end where the key changes; a key of many rows is shrunk while it is read."""
    held: list[Arrays] = []
    k = names.index(key)
    for rows in gathered(batches, names):
        if not len(rows[0]):
            continue
        held.append(rows)
        if sum(len(x[0]) for x in held) < CHUNK // 4:
            continue
        now = joined(held)
        last = int(np.searchsorted(now[k], now[k][-1]))
        if last:
            yield [x[:last] for x in now]
        held = [shrink([x[last:] for x in now])]
    if held:
        yield joined(held)


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by u, each u reduced, with its cell."""
    for rows in runs(batches, LINES, "u", reduced):
        out = reduced(rows)
        yield batch_of([cells(out[0]), *out], ["cell", *LINES])


ARRAYS = ["us", "counts", "crcs", "firsts", "sales", "nos", "ids"]
LINE_BLOCK = "cell long, lo long, hi long, " + ", ".join(f"{x} binary" for x in ARRAYS)


def line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most VALUES values of one cell, out of rows sorted by cell and u."""
    for rows in runs(batches, ["cell", *LINES], "cell", lambda x: x):
        order = np.lexsort((rows[4], rows[3], rows[2], rows[1], rows[0]))
        cell, u, sale, line, item, n, crc = (x[order] for x in rows)
        firsts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (cell[1:] != cell[:-1])])
        begins = firsts[rank_in(cell[firsts]) % VALUES == 0]
        out: list[tuple] = []
        for at, end in zip(begins, np.append(begins[1:], len(u)), strict=True):
            mine = firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, end)]
            sums = [np.add.reduceat(x[at:end], mine - at) for x in (n, crc)]
            parts = (u[mine], *sums, mine - at, sale[at:end], line[at:end], item[at:end])
            out.append((cell[at], u[at], u[end - 1], *(np.ascontiguousarray(x, np.int64).tobytes() for x in parts)))
        columns = [pa.array(x, pa.int64() if k < 3 else pa.binary()) for k, x in enumerate(zip(*out, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["cell", "lo", "hi", *ARRAYS])


ITEM_BLOCK = "cell long, least long, greatest long, items binary, prices binary"


def item_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK items of one cell, out of rows sorted by p, once for each cell that they reach."""
    for rows in runs(batches, ["p", "item_id"], "p", lambda x: x):
        for start in range(0, len(rows[0]), CHUNK):
            p, item = (x[start : start + CHUNK] for x in rows)
            begins = np.flatnonzero(rank_in(cells(p)) % BLOCK == 0)
            out: list[tuple] = []
            for at, end in zip(begins, np.append(begins[1:], len(p)), strict=True):
                ps = p[at:end]
                least, greatest = int((ps - reach(ps)).min()), int((ps + reach(ps)).max())
                value, packed = least, (np.ascontiguousarray(item[at:end]).tobytes(), np.ascontiguousarray(ps).tobytes())
                while value <= greatest:
                    cell, value = cell_bounds(value)
                    out.append((cell, least, greatest, *packed))
            columns = [pa.array(x, pa.int64() if k < 3 else pa.binary()) for k, x in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "least", "greatest", "items", "prices"])


NAMES = ["gap", "u", "sale_id", "line_no", "line_item_id"]
TOP = f"array<struct<{','.join(f'{x}:long' for x in NAMES)}>>"
PARTIAL = f"item_id long, p long, n long, gap_sum long, crc long, top {TOP}"


def sums(ps: np.ndarray, us: np.ndarray, counts: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """The number, gaps and checksums of the lines within reach of each of ascending prices, tile by tile."""
    out = np.zeros((3, len(ps)), np.int64)
    for at in range(0, len(ps), STRIP):
        p = ps[at : at + STRIP]
        far = reach(p)
        a, b = np.searchsorted(us, (p - far).min()), np.searchsorted(us, (p + far).max(), "right")
        gap = np.abs(us[None, a:b] - p[:, None])
        held = gap <= far[:, None]
        n = held * counts[None, a:b]
        out[0, at : at + STRIP], out[1, at : at + STRIP] = n.sum(axis=1), (n * gap).sum(axis=1)
        out[2, at : at + STRIP] = (held * crcs[None, a:b]).sum(axis=1)
    return out


def nearest(ids: np.ndarray, ps: np.ndarray, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each item the places of its first lines in the block, in order, and whether there is one."""
    us, firsts, lines = block["us"], block["firsts"], block["ids"]
    sizes = np.diff(np.append(firsts, len(lines)))
    slots = np.arange(2 * FIRST)
    found, held = np.zeros((len(ps), FIRST), np.int64), np.zeros((len(ps), FIRST), bool)
    todo, span = np.arange(len(ps)), FIRST + 1
    while len(todo):
        p, own, far = ps[todo], ids[todo], reach(ps[todo])
        mid = np.searchsorted(us, p)
        at = mid[:, None] + np.arange(-span, span)[None, :]
        there = (at >= 0) & (at < len(us))
        at = np.clip(at, 0, len(us) - 1)
        gap = np.abs(us[at] - p[:, None])
        there &= gap <= far[:, None]
        place = np.minimum(firsts[at][:, :, None] + slots, len(lines) - 1)
        good = there[:, :, None] & (slots < sizes[at][:, :, None]) & (lines[place] != own[:, None, None])
        key = ((gap * 2 + (us[at] > p[:, None])) * 16)[:, :, None] + slots
        key = np.where(good, key, np.iinfo(np.int64).max).reshape(len(todo), -1)
        order = np.argsort(key, axis=1)[:, :FIRST]
        best = np.take_along_axis(key, order, axis=1)
        found[todo], held[todo] = np.take_along_axis(place.reshape(len(todo), -1), order, axis=1), best < np.iinfo(np.int64).max
        # what lies outside the span must come after the last one found, or be out of reach
        left, right = mid - span - 1, mid + span
        out_left = np.where(left >= 0, p - us[np.maximum(left, 0)], LIMIT)
        out_right = np.where(right < len(us), us[np.minimum(right, len(us) - 1)] - p, LIMIT)
        outside = np.minimum(out_left, out_right)
        last = np.where(held[todo, -1], best[:, -1] // 32, np.iinfo(np.int64).max)
        todo, span = todo[(outside <= far) & (outside <= last)], span * 2
    return found, held


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums and first lines of each item of each pair of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            read = lambda x: np.frombuffer(batch.column(x)[k].as_buffer(), np.int64)  # noqa: B023, E731
            ids, ps, block = read("items"), read("prices"), {x: read(x) for x in ARRAYS}
            total = sums(ps, block["us"], block["counts"], block["crcs"])
            found, held = nearest(ids, ps, block)
            some = np.flatnonzero(total[0])
            if not len(some):
                continue
            mask = held[some]
            at = found[some][mask]
            value = block["us"][np.searchsorted(block["firsts"], at, "right") - 1]
            gaps = np.abs(value - np.repeat(ps[some], mask.sum(axis=1)))
            top = pa.StructArray.from_arrays([pa.array(x) for x in (gaps, value, block["sales"][at], block["nos"][at], block["ids"][at])], NAMES)
            offsets = np.r_[0, np.cumsum(mask.sum(axis=1))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), top)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], ps[some], *(t[some] for t in total))] + [lists], ["item_id", "p", "n", "gap_sum", "crc", "top"])


def near_lines(lines: DataFrame, items: DataFrame) -> DataFrame:
    """A row per row of `items` (item_id, price) and each of its first FIRST pairs with `lines` (sale_id, line_no, item_id, quantity,
    amount), in order: item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum and lines_crc."""
    ship(lines.sparkSession)
    no = F.coalesce(F.col("line_no").cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(",", F.col("sale_id").cast("string"), no, F.col("item_id").cast("string")))
    u = unit(cents(F.col("amount").cast("double")), F.col("quantity"))
    named = lines.select(
        u.alias("u"), F.col("sale_id").cast("long").alias("sale_id"), F.coalesce(F.col("line_no").cast("long"), F.lit(NONE)).alias("line_no"), F.col("item_id").cast("long").alias("item_id"), F.lit(1).cast("long").alias("n"), crc.alias("crc")
    ).where("u is not null and sale_id is not null and item_id is not null")
    priced = items.select(F.col("item_id").cast("long").alias("item_id"), cents(F.col("price").cast("double")).alias("p"))
    wanted = priced.where("item_id is not null and p is not null").distinct()

    schema = ", ".join(f"{x} long" for x in LINES)
    values = named.mapInArrow(combine, schema).repartition("u").sortWithinPartitions("u").mapInArrow(merge, "cell long, " + schema)
    by_cell = values.repartition("cell").sortWithinPartitions("cell", "u").mapInArrow(line_blocks, LINE_BLOCK)
    by_price = wanted.repartitionByRange("p", "item_id").sortWithinPartitions("p", "item_id").mapInArrow(item_blocks, ITEM_BLOCK)
    overlap = (F.col("least") <= F.col("hi")) & (F.col("greatest") >= F.col("lo"))
    met = cut(by_price).join(cut(by_cell).hint("merge"), "cell").where(overlap)
    parts = met.select("items", "prices", *ARRAYS).mapInArrow(tiles, PARTIAL)

    # an item's own lines are in those sums, and are taken off again
    gap = F.abs(F.col("u") - F.col("p"))
    within = gap <= F.greatest(F.lit(NEAR), F.floor(F.col("p") / PART))
    own = named.select("item_id", "u", "crc").hint("merge").join(wanted, "item_id").where(within)
    none = F.lit(None).cast(TOP)
    own = own.select("item_id", "p", F.lit(-1).cast("long").alias("n"), (-gap).alias("gap_sum"), (-F.col("crc")).alias("crc"), none.alias("top"))
    zero = F.lit(0).cast("long")
    every = priced.select("item_id", "p", zero.alias("n"), zero.alias("gap_sum"), zero.alias("crc"), none.alias("top"), F.lit(1).alias("copies"))
    both = parts.unionByName(own).withColumn("copies", F.lit(0)).unionByName(every)
    total = both.groupBy("item_id", "p").agg(
        F.sum("n").alias("n_pairs"), F.sum("gap_sum").alias("gap_sum"), F.sum("crc").alias("lines_crc"), F.sum("copies").alias("copies"), F.flatten(F.collect_list("top")).alias("tops")
    )
    first = F.slice(F.sort_array("tops"), 1, FIRST)
    ranked = total.select("*", F.posexplode_outer(first).alias("at", "x"))
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rank = F.coalesce(F.col("at") + 1, F.lit(0))
    fields = [F.col(f"x.{c}").alias(c) if c != "line_no" else F.nullif(F.col("x.line_no"), F.lit(NONE)).alias(c) for c in NAMES]
    return ranked.select("item_id", rank.alias("rank"), *fields, "n_pairs", "gap_sum", "lines_crc")
