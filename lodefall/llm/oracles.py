"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"

OP2 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
d AS (
  SELECT page_id, payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda k: substr({_BASE32},
      ((('0x' || substr(hex, CAST(1 + 10 * (k // 8) AS INTEGER), 10))::BIGINT >> (35 - 5 * (k % 8)))::BIGINT & 31)::INTEGER + 1, 1)), '') AS payload_digest
  FROM h),
m AS (SELECT hex, max(page_id) AS keeper FROM d GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM d JOIN m USING (hex)
"""

OP3 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, rid, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda k: array_to_string(ws[k : k + 7], ' '))) AS gram FROM w WHERE len(ws) >= 8),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
c AS (SELECT rid, least(coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8), 8) AS n FROM r),
s AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
k AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN s USING (rid) LEFT JOIN k USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)) AS kept
FROM b
"""

_FAILS = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_heavy": "4 * n_symbols > n_words",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 2 * n_dup_lines > n_lines",
}
#: What leaving out each rule of the current policy would change.
ABLATIONS = (
    OP3[: OP3.index("b AS (SELECT")].rstrip().rstrip(",")
    + ", f AS (SELECT "
    + ", ".join(f"({c})::INT AS {k}" for k, c in _FAILS.items())
    + " FROM m) "
    + " UNION ALL ".join(f"SELECT '{k}' AS rule, sum({k})::BIGINT AS fails, sum(({k} = 1 AND {' + '.join(_FAILS)} = 1)::INT)::BIGINT AS only_it_rejects FROM f" for k in _FAILS)
)

OP4 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda k: array_to_string(ws[k : k + 9], ' '))) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM v),
g AS (SELECT rid, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda k: array_to_string(ws[k : k + n - 1], ' '))) AS win
  FROM d, sizes WHERE len(ws) >= n),
h AS (SELECT g.rid, g.i, g.n, v.item_id FROM g JOIN v USING (win, n)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM h GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""

_DIV = "(({0}) // ({1}) - CASE WHEN ({0}) % ({1}) <> 0 AND (({0}) < 0) <> (({1}) < 0) THEN 1 ELSE 0 END)"
OP11 = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
l0 AS (SELECT sale_id, line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines
  WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity <> 0 AND amount IS NOT NULL),
l AS (SELECT sale_id, line_no::BIGINT AS line_no, item_id AS line_item_id, {_DIV.format("2 * a + q", "2 * q")} AS u,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(concat_ws(',', sale_id::VARCHAR, coalesce(line_no::VARCHAR, ''), item_id::VARCHAR), ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM l0, tab),
i AS (SELECT row_number() OVER () AS rid, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
m AS (SELECT rid, abs(u - p) AS gap, u, sale_id, line_no, line_item_id, crc FROM i JOIN l ON u BETWEEN p - greatest(10, p // 500) AND p + greatest(10, p // 500) AND line_item_id <> item_id
  WHERE abs(u - p) <= 10 OR 1000 * abs(u - p) <= 2 * p),
s AS (SELECT rid, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM m GROUP BY rid),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM m QUALIFY rank <= 5)
SELECT item_id, coalesce(rank, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s USING (rid) LEFT JOIN f USING (rid)
"""

ORACLES = {"op11_bands": OP11, "op2_warc": OP2, "op3_quality": OP3, "op4_decontaminate": OP4, "quality_ablations": ABLATIONS}
