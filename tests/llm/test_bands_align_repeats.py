"""Band joins, tokenizer alignment and repeated strings against brute force and odd tables."""

import bisect
import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodefall.llm import align, bands, queries, repeats

# --- band join ----------------------------------------------------------------------------------------------------------

LINE = "sale_id long, line_no int, item_id long, quantity int, amount double, price string, n string, cell int"
ITEM = "item_id long, price double, u string, gap int"


def plain_bands(lines, items):
    import math

    out = []
    for item, price in items:
        pairs = []
        if item is not None and price is not None:
            p = math.floor(100 * price + 0.5)
            for sale, no, other, q, amount in lines:
                if None in (sale, other, q, amount) or q == 0 or math.isnan(amount) or other == item:
                    continue
                u = (2 * math.floor(100 * amount + 0.5) + q) // (2 * q)
                if (gap := abs(u - p)) <= 10 or 1000 * gap <= 2 * p:
                    pairs.append((gap, u, sale, no, other, zlib.crc32(f"{sale},{'' if no is None else no},{other}".encode())))
        pairs.sort(key=lambda x: (*x[:3], x[3] is not None, x[3] or 0, *x[4:]))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        out += [(item, k + 1, *x[:5], *sums) for k, x in enumerate(pairs[:5])] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=str)


def banded(spark, lines, items):
    left = spark.createDataFrame([(*x, "c", "n", 1) for x in lines], LINE).repartition(3)
    right = spark.createDataFrame([(*x, "u", 2) for x in items], ITEM).repartition(2)
    return sorted((tuple(r) for r in bands.near_lines(left, right).collect()), key=str)


def odd_lines(seed, n, spread):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        q = rng.choice([1, 1, 2, 3, 7, 50])
        unit = rng.choice([3.0, 4.99, 20.0, rng.random() * spread, rng.random() * spread])
        out.append((rng.randrange(40), rng.choice([1, 2, None]), rng.randrange(6), q, round(unit * q, 2)))
    return out + out[:7] + [(None, 1, 1, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 3.0), (1, 2, 3, -2, 6.0), (1, 2, 3, 2, -0.07), (5, 5, 5, 1, float("nan")), (5, 5, 5, 1, 1e300)]


def odd_items(seed, spread):
    rng = random.Random(seed)
    out = [(k % 6, round(rng.random() * spread, 2)) for k in range(40)] + [(1, 3.0), (1, 3.0), (2, 3.0), (99, 3.0), (98, -0.05), (97, 0.0), (96, None), (None, 3.0), (95, 1e12), (94, float("nan"))]
    return out


def test_bands_equal_all_pairs(spark, monkeypatch):
    for seed, n, spread in ((1, 400, 30.0), (2, 150, 1e6)):
        lines, items = odd_lines(seed, n, spread), odd_items(seed, spread)
        want = plain_bands([x for x in lines if x[4] != 1e300], [x for x in items if x[1] == x[1]] + [(94, None)])
        assert banded(spark, lines, items) == want
    assert banded(spark, [], [(1, 2.0), (2, None)]) == [(1, 0, *[None] * 5, 0, 0, 0), (2, 0, *[None] * 5, 0, 0, 0)]
    assert banded(spark, [(1, 1, 1, 1, 1.0)], []) == []


def test_bands_take_many_lines_of_one_value_and_many_values_of_one_cell(spark, monkeypatch):
    for name, value in (("CHUNK", 64), ("BLOCK", 4), ("STRIP", 2), ("VALUES", 3)):
        monkeypatch.setattr(bands, name, value)
    rng = random.Random(5)
    lines = [(k, 1, 7, 1, 5.0) for k in range(300)] + [(k, 2, 8, 1, 5.0) for k in range(3)] + [(k, 3, rng.randrange(9), 1, 4.8 + k % 40 / 100) for k in range(200)]
    items = [(7, 5.0), (8, 5.0), (9, 5.0), *((k, 4.8 + k / 50) for k in range(20))]
    # within one process, so that the small sizes hold
    data = [np.array(x, np.int64) for x in zip(*(((2 * round(100 * a) + q) // (2 * q), s, no, i, 1, zlib.crc32(f"{s},{no},{i}".encode())) for s, no, i, q, a in lines), strict=True)]
    import pyarrow as pa

    parts = [bands.batch_of([x[k : k + 50] for x in data], bands.LINES) for k in range(0, len(lines), 50)]
    few = pa.Table.from_batches(list(bands.combine(iter(parts)))).sort_by("u")
    merged = pa.Table.from_batches(list(bands.merge(iter(few.to_batches(max_chunksize=30))))).sort_by([("cell", "ascending"), ("u", "ascending")])
    assert merged.num_rows <= 10 * len(set(data[0].tolist()))
    blocks = pa.Table.from_batches(list(bands.line_blocks(iter(merged.to_batches(max_chunksize=25)))))
    priced = pa.table({"p": [round(100 * p) for _, p in items], "item_id": [i for i, _ in items]}).sort_by([("p", "ascending"), ("item_id", "ascending")])
    wanted = pa.Table.from_batches(list(bands.item_blocks(iter(priced.to_batches(max_chunksize=5)))))
    assert all(len(x) <= 4 * 8 for x in wanted["items"].to_pylist()) and all(len(x) <= 3 * 8 for x in blocks["us"].to_pylist())
    met = [(w, b) for w in wanted.to_pylist() for b in blocks.to_pylist() if w["cell"] == b["cell"] and w["least"] <= b["hi"] and w["greatest"] >= b["lo"]]
    rows = pa.Table.from_pylist([{**w, **b} for w, b in met])
    total, tops = collections.Counter(), collections.defaultdict(list)
    for r in pa.Table.from_batches(list(bands.tiles(iter(rows.to_batches())))).to_pylist():
        total[r["item_id"], r["p"]] += r["n"]
        tops[r["item_id"], r["p"]] += [tuple(x.values()) for x in r["top"]]
    for item, price in items:
        p = round(100 * price)
        pairs = sorted((abs(u - p), u, s, no, i) for u, s, no, i in zip(*(x.tolist() for x in data[:4]), strict=True) if abs(u - p) <= 10)
        assert total[item, p] == len(pairs) and sorted(tops[item, p])[:5] == [x for x in pairs if x[4] != item][:5]


def test_cells_cover_the_line():
    values = sorted({s * v for s in (1, -1) for k in range(0, 62, 3) for v in (2**k - 1, 2**k, 2**k + 3)})
    for v in values:
        cell, following = bands.cell_bounds(v)
        assert following > v and bands.cell_bounds(following - 1)[0] == cell != bands.cell_bounds(following)[0]
    assert bands.cells(np.array(values)).tolist() == [bands.cell_bounds(v)[0] for v in values]


# --- alignment ----------------------------------------------------------------------------------------------------------

BYTES, PIECES = (public_tokenizers.path(x) for x in (queries.BYTES, queries.PIECES))
ODD = ["  a  b ", " ", "\n\n x", "a\n b\t c  d", "x  y", "▁x a b", "<s> hi <unk> </s> <|endoftext|> z", "日本語テキスト 漢字", "😀😀 a", "a" * 3000, " " * 500 + "x", " \n \n ", "a \n  b", "I'm  'll x's\r\n y", "trail ", "　 z", "\x1c a", "1234567890 9", "é x", "<0x41> q", "word other " * 6000]


def plain_alignment(rows):
    made = align.Pair(BYTES, PIECES)
    found, held = [], collections.Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        sides = made.a.encode(" " + text, add_special_tokens=False).ids, made.b.encode(text)
        spelled = [[table[i] for i in ids] for table, ids in zip((made.a_bytes, made.b_bytes), sides, strict=True)]
        if any(b"".join(x) != (" " + text).encode() for x in spelled):
            found.append((doc_id, None))
            continue
        ends = [np.cumsum(list(map(len, x))).tolist() for x in spelled]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[], []] for _ in cuts]
        for side in (0, 1):
            for i, end in zip(sides[side], ends[side], strict=True):
                groups[bisect.bisect_left(cuts, end)][side].append(i)
        links = collections.Counter((i, j) for a, b in groups for i in a for j in b)
        held.update(links.keys())
        named = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        found.append((doc_id, (len(sides[0]), len(sides[1]), len(cuts), links, hashlib.sha256(named.encode()).hexdigest())))
    best = collections.Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, *[0] * 6, ""))
        else:
            links = x[3]
            out.append((doc_id, *x[:3], sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), x[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [align.FREQUENT, 50])
def test_alignment_equals_a_plain_version(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in docs] + [(10**6 + k, x) for k, x in enumerate(ODD)] + [(None, "a b"), (7, None), (7, ""), (None, "a b")]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, code string, n int").repartition(4)
    got = align.alignment(df, BYTES, PIECES, limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(rows)
    if limit < align.FREQUENT:
        assert align.alignment(df.limit(0), BYTES, PIECES).count() == 0


def test_stretches_give_the_tokens_of_whole_texts():
    made, rng = align.Pair(BYTES, PIECES), random.Random(11)
    letters = ["a", "b", "é", "1", " ", " ", "  ", "\n", "\t", "'s", ".", "日", "😀", " ", "　", "\x1c", " ", "\r\n"]
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 25)))
        parts = made.stretches(text)
        assert "".join(" " + x for x in parts) == " " + text
        assert [i for x in parts for i in made.a.encode(" " + x, add_special_tokens=False).ids] == made.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in parts for i in made.b.encode(x)] == made.b.encode(text)


def test_both_encoders_agree_on_plain_stretches():
    made, rng = align.Pair(BYTES, PIECES), random.Random(12)
    letters = [chr(c) for c in range(0x250)] + ["'s", "'ll", " ", "  ", "ab", "12"]
    assert made.quick
    for _ in range(4000):
        text = " " + "".join(rng.choice(letters) for _ in range(rng.randint(1, 30)))
        assert made.a_ids(text, True).tolist() == made.a_ids(text, False).tolist()
    assert all(made.a_ids(x := f"a{chr(c)}1 {chr(c)}", True).tolist() == made.a_ids(x, False).tolist() for c in range(0x250))


def test_wide_groups_take_equal_ids_together(monkeypatch):
    plain = align.Pair(BYTES, PIECES)
    monkeypatch.setattr(align, "WIDE", 2)
    made, texts = align.Pair(BYTES, PIECES), ["ab日本cd 漢字漢字 " * 3 + "x" * 50, " " * 70, "😀😀 été"]
    for one, two in zip(map(plain.aligned, plain.meet(texts)), map(made.aligned, made.meet(texts)), strict=True):
        assert one[:4] == two[:4] and all(np.array_equal(x, y) for x, y in zip(one[4], two[4], strict=True))
        assert all(np.array_equal(x, y) for x, y in zip(align.unpacked(align.packed(one[4])), one[4], strict=True))


# --- repeated strings ---------------------------------------------------------------------------------------------------


def plain_repeats(rows, keep):
    texts = [(t or "").encode() for _, t in rows]
    size, seen = repeats.LENGTH, collections.Counter(b[i : i + repeats.LENGTH] for b in texts for i in range(len(b) - repeats.LENGTH + 1))
    met, out = set(), []
    for (doc_id, _), b in zip(rows, texts, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1 and (keep == "none" or b[i : i + size] in met):
                gone[i : i + size] = b"\1" * size
            met.add(b[i : i + size])
        n = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), n, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def repeated_fixture(seed, n):
    rng = random.Random(seed)
    some = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(2, 8))) for _ in range(k))
    base, passage, rows = [some(300) for _ in range(6)], some(90), []
    for k in range(n):
        kind = k % 7
        if kind == 0:
            t = rng.choice(base)
        elif kind == 1:
            t = list(rng.choice(base))
            for _ in range(rng.randint(1, 6)):
                t[rng.randrange(len(t))] = rng.choice("xyzé")
            t = "".join(t)
        elif kind == 2:
            t = f"{some(rng.randint(5, 80))} {passage} {some(rng.randint(5, 80))}"
        elif kind == 3:
            at = rng.randrange(200)
            t = some(40) + rng.choice(base)[at : at + rng.randint(380, 460)] + some(40)
        elif kind == 4:
            t = some(200)
        elif kind == 5:
            t = ["a" * 1500, "ab" * 700, "xyz" * 300 + some(50), None, "", "a" * 399, "a" * 400, "a" * 401, "日本" * 200][k // 7 % 9]
        else:
            part = some(70)
            t = part + some(20) + part
        rows.append((k, t))
    return rows


def unrepeated(spark, rows, **how):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, spans string, gram int").repartition(5)
    return sorted((tuple(r[:4]) + (bytes(r[4]),) for r in repeats.without_repeats(df, **how).collect()), key=str)


def test_repeats_equal_brute_force(spark):
    rows = repeated_fixture(1, 63)
    rows += [rows[3], rows[3], (None, rows[1][1]), (None, rows[4][1][:500])]
    assert unrepeated(spark, rows) == plain_repeats(rows, "none")
    assert unrepeated(spark, [(1, None), (2, "x")]) == [(1, 0, 0, 0, b""), (2, 1, 0, 0, b"x")]
    assert unrepeated(spark, []) == []


def test_hot_grams_are_split(spark):
    rows = repeated_fixture(2, 35)
    assert unrepeated(spark, rows, hot=3) == plain_repeats(rows, "none")


def test_first_copies_stay(spark):
    rows = repeated_fixture(3, 42)
    assert unrepeated(spark, rows, keep="first") == plain_repeats(rows, "first")
    rows = repeated_fixture(4, 21)
    assert unrepeated(spark, rows, keep="first", hot=3) == plain_repeats(rows, "first")


def test_previous_factors_equal_brute_force():
    rng = random.Random(3)
    for n, letters, depth in ((200, 2, 37), (120, 3, 5), (90, 1, 64), (1, 1, 8)):
        s = np.array([rng.randrange(letters) for _ in range(n)])
        order, length, source = repeats.longest_previous_factors(s, depth, np.arange(n))
        shared = lambda a, b: next((k for k in range(depth) if max(a, b) + k >= n or s[a + k] != s[b + k]), depth)  # noqa: B023, E731
        for i, k, j in zip(order.tolist(), length.tolist(), source.tolist(), strict=True):
            assert k == max([shared(i, j) for j in range(i)], default=0)
            assert k == 0 or (j < i and shared(i, j) == k)


def test_anchors_do_not_depend_on_stretches(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.choices(b"abcd ", k=k)) for k in (0, 399, 400, 5000, 401, 9000, 3)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    read = lambda: [tuple(map(int, x)) for part in repeats.anchors(data, bounds) for x in zip(*part, strict=True)]
    whole = read()
    monkeypatch.setattr(repeats, "STRETCH", 700)
    assert read() == whole
    for doc, text in enumerate(texts):
        at = [x[1] for x in whole if x[0] == doc]
        assert all(any(i <= m <= i + repeats.SLACK for m in at) for i in range(len(text) - repeats.LENGTH + 1))
