"""WARC archives: writing them with Spark's text writer, reading them back, and assembling transactions.

A transaction is a request, a response (or a revisit of an equal payload) and a metadata record, tied by
WARC-Concurrent-To. The archives are WARC/1.1 files in gzip, a member per file: each record is one string and the line separator is the
record separator, so Spark's commit protocol covers them and a retried task leaves no double records. Pages are written in
classes of their payload's size, with fewer to a file the larger they are, so that a file holds about FILE_BYTES or one page;
reading inflates a file piece by piece and holds one record.

Defined results: a null html is an empty payload; a null url is written as an empty target; control characters and blanks
in a url are percent-encoded; of equal payloads the largest page_id is the response (repeated rows of that page all
are), null page_ids are smaller than any other; an empty table writes no records and reads back as no rows. A record with a broken
header is left out, and reading goes on at the next record; a block that the file's end cuts short is left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.llm.common import bounded, cut, ship

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of a file and pages in it, at most about; the sizes that divide pages into classes.
FILE_BYTES, FILE_PAGES, CLASSES = 32 << 20, 2_000, (16 << 10, 256 << 10, 4 << 20)
#: Bytes that are inflated at once.
PIECE = 1 << 20
#: Records of a kind in a row of an assembled capture.
NESTED = 100
RECORD = "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean, block binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column."""
    digits = F.sha1(payload)
    parts = [F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(part, 35 - 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for part in parts for j in range(8)))


def record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """The text of a record without the separator that follows it; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(CRLF), *(F.coalesce(x, F.lit("")) for x in lines))
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 0) -> None:
    """Writes three records for each row of `pages` (page_id, url, html) as WARC files under `path`.

    Payloads of under `min_revisit` bytes are never revisits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("payload"), F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html).alias("digest")
    )
    of_page = base.where(F.col("bytes") >= min_revisit).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    shared = of_page.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    shared = bounded(cut(shared.select(F.col("digest").alias("shared_digest"), F.col("top.page_id").alias("keeper"), F.col("top.n").alias("keeper_rows"))))
    rows = base.join(shared, base["digest"] == shared["shared_digest"], "left").withColumn("rid", F.monotonically_increasing_id())
    revisit = F.col("shared_digest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    single = F.col("shared_digest").isNull() | ~revisit & (F.col("keeper_rows") == 1)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    urn = lambda role, page: F.concat(F.lit(f"<urn:lodefall:{role}:"), page, F.lit(":"), F.col("digest"))
    own = lambda role: F.concat(urn(role, page), F.lit(":"), F.col("rid").cast("string"), F.lit(">"))
    capture = F.when(single, F.concat(urn("capture", page), F.lit(">"))).otherwise(own("capture"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    kept = F.concat(urn("capture", F.coalesce(F.col("keeper").cast("string"), F.lit("null"))), F.lit(">"))
    records = F.array(
        record("request", [("WARC-Record-ID", own("request")), ("WARC-Concurrent-To", capture), *common, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{CRLF * 2}"))),
        record(
            F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            [
                ("WARC-Record-ID", capture),
                *common,
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
                ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                ("WARC-Refers-To", F.when(revisit, kept)),
                ("Content-Type", F.lit("application/http; msgtype=response")),
            ],
            F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
        ),
        record("metadata", [("WARC-Record-ID", own("metadata")), ("WARC-Concurrent-To", own("request")), *common, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page-id: "), page, F.lit(CRLF))),
    )
    # the classes that there are, by one look at the sizes; each is a pass over its own pages
    size = F.octet_length(html)
    class_of = sum(((size > most).cast("int") for most in CLASSES), F.lit(0))
    found = sorted(x["c"] for x in pages.select(class_of.alias("c")).distinct().collect())  # at most len(CLASSES) + 1
    for c in found or [0]:
        most = min(FILE_PAGES, FILE_BYTES // CLASSES[c]) if c < len(CLASSES) else 1
        inside = rows.where((F.col("bytes") > (CLASSES[c - 1] if c else -1)) & (F.col("bytes") <= (CLASSES[c] if c < len(CLASSES) else 1 << 62)))
        lines = inside.select(F.explode(records).alias("value"))
        lines.write.mode("append").option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * most).option("compression", "gzip").text(path)


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a file that may be one or more gzip members, in pieces; what follows a damaged place is left out."""
    data = memoryview(content)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(data[at : at + PIECE]) for at in range(0, len(data), PIECE))
        return
    member, at = zlib.decompressobj(31), 0
    try:
        while at < len(data):
            part = bytes(data[at : at + (PIECE >> 4)])
            at += len(part)
            while part:
                yield member.decompress(part, PIECE)
                part = member.unconsumed_tail
                if member.eof:
                    at -= len(member.unused_data)
                    if data[at : at + 2] != b"\x1f\x8b":
                        return
                    member, part = zlib.decompressobj(31), b""
        yield member.flush()
    except zlib.error:
        return


def parse(content: bytes, payloads: bool) -> Iterator[dict]:
    """The records of an archive's bytes, one at a time."""
    held, pieces = bytearray(), inflated(content)

    def has(n: int) -> bool:
        """Whether n bytes are at hand, after reading on."""
        while len(held) < n:
            if (piece := next(pieces, None)) is None:
                return False
            held.extend(piece)
        return True

    def found(what: bytes, keep: bool) -> int:
        """Where `what` begins, after reading on; -1 at the file's end. What goes before it need not be kept."""
        at = 0
        while (place := held.find(what, at)) < 0:
            at = max(0, len(held) - len(what) + 1)  # nothing before the last bytes can belong to it
            if not keep:
                del held[:at]
                at = 0
            if not has(len(held) + 1):
                return -1
        return place

    while (at := found(b"WARC/", False)) >= 0:
        del held[:at]
        end = found(b"\r\n\r\n", True)  # however long the header is: a url may be
        headers: dict[str, list[str]] = {}
        for line in held[: max(end, 0)].decode("utf-8", "replace").split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda name, headers=headers: headers.get(name, [None])[0]
        length = one("content-length") or ""
        if not (length.isascii() and length.isdigit()):
            del held[:5]
            continue
        if not has(end + 4 + int(length)):
            return
        block = bytes(held[end + 4 : end + 4 + int(length)])
        del held[: end + 4 + len(block)]
        stated = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        http, _, payload = block.partition(b"\r\n\r\n")
        size, digest, ok = None, stated, None
        if one("warc-type") == "response":
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            ok = stated is None or stated == digest
        elif one("warc-type") == "revisit" and (m := re.search(rb"(?mi)^content-length:\s*(\d+)", http)):
            size = int(m[1])
        yield {
            "record_id": one("warc-record-id"),
            "type": one("warc-type"),
            "concurrent_to": headers.get("warc-concurrent-to", []),
            "target_uri": one("warc-target-uri"),
            "refers_to": one("warc-refers-to"),
            "payload_bytes": size,
            "payload_digest": digest,
            "digest_ok": ok,
            "block": block if payloads or one("warc-type") == "metadata" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files under `path`, gzip members too; the digests of responses are those of the payloads read,
    and digest_ok tells whether the header states the same. Without `payloads` only the blocks of metadata records are kept."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for x in parse(content.as_py() or b"", payloads):
                    held.append(x)
                    size += 200 + len(x["block"] or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([y[n] for y in held], k) for n, k in zip(names, kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([y[n] for y in held], k) for n, k in zip(names, kinds, strict=True)], names)

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def tied(records: DataFrame) -> DataFrame:
    """member and head: the captures that each request or metadata record is tied to, directly or through other such
    records, followed until nothing new is reached. A concurrent-to header ties both ways; a capture is an end."""
    heads = records.where(F.col("type").isin(*CAPTURES)).select(F.col("record_id").alias("head")).distinct()
    named = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    ties = named.unionByName(named.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # ties of a record to a capture, and of records that aren't captures to each other
    direct = ties.join(heads, ties["b"] == heads["head"]).select(F.col("a").alias("member"), "head")
    front = cut(direct.join(heads.select(F.col("head").alias("member")), "member", "left_anti"))
    among = ties.join(heads.select(F.col("head").alias("b")), "b", "left_anti").join(heads.select(F.col("head").alias("a")), "a", "left_anti")
    among, reached = cut(among), front
    while among.limit(1).count() and front.limit(1).count():
        further = among.join(front, among["b"] == front["member"]).select(F.col("a").alias("member"), "head").distinct()
        front = cut(further.join(reached, ["member", "head"], "left_anti"))
        reached = reached.unionByName(front)
    return reached


#: Types of records that are captures.
CAPTURES = ("response", "revisit", "resource")


def assemble(records: DataFrame, most: int = NESTED) -> DataFrame:
    """A nested row per capture: capture, request and metadata (arrays by record_id), n_requests, n_metadata, part, n_parts.

    A record that is tied to several captures is nested in each; one tied to none isn't in the result. A capture with over
    `most` records of a kind has several rows of about that many, told apart by `part`, so that no row grows with them.
    """
    captures = records.where(F.col("type").isin(*CAPTURES))
    members = records.where(F.col("type").isin("request", "metadata"))
    ends = tied(records)
    joined = members.join(ends, members["record_id"] == ends["member"]).select("head", "type", "record_id", "target_uri", "block")
    large = joined.groupBy("head", "type").count().groupBy("head").agg(F.max("count").alias("n")).where(F.col("n") > most)
    large = bounded(cut(large.select(F.col("head").alias("large"), F.ceil(F.col("n") / most).alias("n_parts"))))
    placed = joined.join(large, F.col("head") == F.col("large"), "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1).cast("long")))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("n_parts")))
    nested = F.struct("record_id", "target_uri", "block")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, nested)))
    sides = placed.groupBy("head", "part", "n_parts").agg(of("request").alias("request"), of("metadata").alias("metadata"))
    totals = joined.groupBy("head").agg(F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata")).withColumnRenamed("head", "all_of")
    shaped = captures.select(F.struct("record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "block").alias("capture"))
    out = shaped.join(sides, shaped["capture.record_id"] == sides["head"], "left")
    small_rows = F.when(F.col("n_parts") == 1, F.size(F.col("request"))).cast("long"), F.when(F.col("n_parts") == 1, F.size(F.col("metadata"))).cast("long")
    # only captures with several rows need their totals from elsewhere
    several = totals.join(large, F.col("all_of") == F.col("large"), "left_semi")
    out = out.join(several, F.col("head") == F.col("all_of"), "left")
    return out.select(
        "capture",
        *(F.coalesce(c, F.array().cast(sides.schema[c].dataType)).alias(c) for c in ("request", "metadata")),
        *(F.coalesce(c, n, F.lit(0)).alias(c) for c, n in zip(("n_requests", "n_metadata"), small_rows, strict=True)),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
    )
