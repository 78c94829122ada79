"""The incremental steps of indexing as snapshots: chunks, embedding flags, path facts, images, types, and what is appended.

A step takes tables and returns the rows as they are after it. It touches only rows that still wait for it, so a second run
of the same step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.functions.text import breadcrumb, token_estimate, word_count
from lodefall.operators import classify, facts, maintenance, sections
from lodefall.session import checkpointed

#: Extensions of images, the confidence from which a type is written, and files that a run classifies.
IMAGES = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff")
SURE = 0.75


def surrogate(path: Column, note: str) -> Column:
    """What stands for a file whose text isn't read: stem, extension, a note, and the last four parts of the path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    name = F.element_at(parts, -1)
    ext = F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.concat_ws(" | ", stem, ext, F.lit(note), breadcrumb(parts))


def prepared(chunks: DataFrame) -> DataFrame:
    """Extracted chunks (file_id, ref, text) as rows of the chunk table, not embedded."""
    return chunks.select(
        sections.identity(F.col("file_id").cast("string"), F.col("ref")).alias("chunk_id"),
        "file_id",
        "ref",
        "text",
        token_estimate(F.col("text")).alias("token_estimate"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        F.lit(0).alias("embedded"),
    )


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after new rows came in, with outcome: new, updated (and to be embedded again), unchanged, or kept for
    those that the new ones don't name."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.chunk_id") == F.col("n.chunk_id"), "full")
    outcome = F.when(F.col("o.chunk_id").isNull(), "new").when(F.col("n.chunk_id").isNull(), "kept").when(F.col("o.content_hash") == F.col("n.content_hash"), "unchanged").otherwise("updated")
    came = outcome.isin("new", "updated")
    cols = [F.when(came, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c not in ("chunk_id", "embedded")]
    return both.select(F.coalesce("o.chunk_id", "n.chunk_id").alias("chunk_id"), *cols, F.when(came, 0).otherwise(F.col("o.embedded")).alias("embedded"), outcome.alias("outcome"))


def outcomes(upserted_chunks: DataFrame, by: str = "file_id") -> DataFrame:
    """Chunks of each file by outcome."""
    return upserted_chunks.groupBy(by).agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("new", "updated", "unchanged")))


def pending(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks that wait for a vector, with their file's path, project and typology."""
    waiting = files.where("status = 'EXTRACTED'").select("file_id", "file_path", *(F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("project_id", "typology")))
    return chunks.where("embedded = 0").join(waiting, "file_id")


def marked(chunks: DataFrame, files: DataFrame, vectors: DataFrame) -> DataFrame:
    """The chunk table after embedding: pending chunks that have a vector, or no text to embed, are done."""
    done = vectors.where("embedding is not null").select("chunk_id", F.lit(True).alias("_done")).distinct()
    extracted = files.where("status = 'EXTRACTED'").select("file_id", F.lit(True).alias("_open")).distinct()
    rows = chunks.join(done, "chunk_id", "left").join(extracted, "file_id", "left")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    flag = F.when(F.col("_open") & (blank | F.coalesce("_done", F.lit(False))), 1).otherwise(F.col("embedded"))
    return rows.withColumn("embedded", flag).select(*chunks.columns)


def advanced(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """The files after embedding: extracted ones without a waiting chunk are EMBEDDED."""
    waiting = chunks.where("embedded = 0").select("file_id", F.lit(True).alias("_waits")).distinct()
    status = F.when((F.col("status") == "EXTRACTED") & F.col("_waits").isNull(), "EMBEDDED").otherwise(F.col("status"))
    return files.join(waiting, "file_id", "left").withColumn("status", status).select(*files.columns)


def finalised(files: DataFrame) -> DataFrame:
    """Embedded files are INDEXED."""
    return files.withColumn("status", F.when(F.col("status") == "EMBEDDED", "INDEXED").otherwise(F.col("status")))


def rebuilt(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and chunks set back so that the index is made anew: no chunk has a vector, no file is past extraction."""
    back = maintenance.reset(files, F.col("status").isin("INDEXED", "EMBEDDED"), "EXTRACTED")
    return back, chunks.withColumn("embedded", F.lit(0))


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of `new` in place of those of `old` with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def kept_once(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """`old` with the rows of `new` whose keys it lacks; of several new rows of one key the first by `order`."""
    return old.unionByName(maintenance.latest(new, keys, order).join(old.select(*keys).distinct(), keys, "left_anti"))


def appended(log: DataFrame, rows: DataFrame, number: str, order: list[str]) -> DataFrame:
    """The log with the rows of a run after it, numbered on in their order. The rows of a run are ranked in parts by range
    and each part begins where the ones before it end, so no task sees all of them. They are checkpointed in parts, since ranges
    drawn anew, or partitions joined otherwise, would not be those whose ends were counted."""
    last = log.agg(F.coalesce(F.max(number), F.lit(0)).cast("long").alias("_last"))
    sorted_rows = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = sorted_rows.withColumns({"_part": part, "_in": inside})
    sizes = placed.groupBy("_part").agg((F.max("_in") + 1).alias("_n"))
    ends = F.sort_array(F.collect_list(F.struct("_part", "_n")))  # a row per partition
    before = sizes.agg(ends.alias("_ends"))
    start = F.aggregate(F.filter("_ends", lambda x: x["_part"] < F.col("_part")), F.lit(0).cast("long"), lambda s, x: s + x["_n"])
    numbered = placed.crossJoin(F.broadcast(before)).crossJoin(F.broadcast(last)).withColumn(number, F.col("_last") + start + F.col("_in") + 1)
    return log.unionByName(numbered.select(*log.columns), allowMissingColumns=True)


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The sessions after messages (session_id, ts): new ones are made, and all that got one were active at its time."""
    seen = messages.groupBy("session_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    rows = sessions.join(seen, "session_id", "full")
    return rows.select("session_id", F.coalesce("created_at", "_first").alias("created_at"), F.greatest("last_active", "_last").alias("last_active"))


#: What the path tells of a file.
PARSED = ("folder_stage", "discipline", "doc_type", "revision", "file_date", "folder_date", "content_type", "is_issued", "is_superseded", "is_received", "canonical_category")


def parsed(files: DataFrame) -> DataFrame:
    """The files after path parsing: those without a folder_stage get the facts of their path, and is_latest is set anew on
    all: one file per project code, discipline and document type that are known, the highest revision, then date."""
    waiting = files.where("folder_stage is null")
    found = facts.facts(waiting.drop(*PARSED), "file_path")
    both = files.where("folder_stage is not null").unionByName(found.select(*(F.col(c).cast(files.schema[c].dataType) for c in files.columns)))
    named = both.where("project_code is not null and discipline <> 'unknown' and doc_type <> 'unknown'")
    order = [F.coalesce("revision", F.lit(-1)).desc(), F.coalesce(F.col("file_date").cast("string"), F.lit("")).desc(), F.asc("file_id")]
    first = maintenance.latest(named.select("file_id", "project_code", "discipline", "doc_type", "revision", "file_date"), ["project_code", "discipline", "doc_type"], order)
    return both.drop("is_latest").join(first.select("file_id", F.lit(1).alias("is_latest")), "file_id", "left").fillna(0, ["is_latest"])


def described(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and chunks after the image step: images without a type get one, and those that aren't scans a chunk of what
    their path says, where they have none yet."""
    waits = F.col("image_type").isNull() & (F.col("lane") == "METADATA_ONLY") & F.lower(F.regexp_replace("extension", r"^\.", "")).isin(*IMAGES)
    kind = classify.image(F.col("file_path"), F.col("size"))["image_type"]
    marked_files = files.withColumn("image_type", F.when(waits, kind).otherwise(F.col("image_type")))
    text = classify.image_description(F.col("file_path"), kind)
    made = files.where(waits & (kind != "scanned_document")).select("file_id", F.lit("image_context").alias("ref"), text.alias("text"))
    rows = prepared(made).withColumn("token_estimate", word_count(F.col("text")))
    return marked_files, chunks.unionByName(rows.select(*chunks.columns).join(chunks.select("chunk_id"), "chunk_id", "left_anti"))


def typed(files: DataFrame, chunks: DataFrame, order: str = "ref", most: int | None = None) -> DataFrame:
    """The files after classification by content: the indexed text files of unknown type that were not tried yet and whose first text
    isn't blank get doc_type (from SURE on) or the method `unknown`, and the confidence. `most` makes a run take the first so many
    by id; since tried files don't wait any more, the next run goes on behind them."""
    waits = (F.col("lane") == "TEXT_EXTRACTABLE") & (F.coalesce("doc_type", F.lit("unknown")) == "unknown") & (F.col("status") == "INDEXED")
    waiting = files.where(waits & F.col("classification_method").isNull()).select("file_id")
    first = chunks.join(waiting, "file_id", "left_semi").groupBy("file_id").agg(F.min_by("text", order).alias("_text")).where(F.trim(F.coalesce("_text", F.lit(""))) != "")
    if most is not None:
        first = first.orderBy("file_id").limit(most)
    found = classify.content(first, "_text").select("file_id", F.col("doc_type").alias("_type"), F.col("confidence").alias("_sure"))
    sure = F.col("_sure") >= SURE
    return files.join(found, "file_id", "left").withColumns(
        {
            "doc_type": F.when(sure, F.col("_type")).otherwise(F.col("doc_type")),
            "classification_method": F.when(sure, "content").when(F.col("_sure").isNotNull(), "unknown").otherwise(F.col("classification_method")),
            "classification_confidence": F.coalesce("_sure", "classification_confidence"),
        }
    ).drop("_type", "_sure")


def indexing(files: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: what embedding and indexing did, from the tables before them: chunks_embedded, chunks_skipped, files_embedded
    and files_indexed."""
    waiting = pending(chunks, files).select("chunk_id", "text").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    of_chunks = waiting.agg(F.count_if(has_text & F.col("embedding").isNotNull()).alias("chunks_embedded"), F.count_if(has_text & F.col("embedding").isNull()).alias("chunks_skipped"))
    after = advanced(files, marked(chunks, files, vectors))
    became = files.select("file_id", F.col("status").alias("_before")).join(after.select("file_id", "status"), "file_id")
    of_files = became.agg(F.count_if((F.col("status") == "EMBEDDED") & (F.col("_before") != "EMBEDDED")).alias("files_embedded"), F.count_if(F.col("status") == "EMBEDDED").alias("files_indexed"))
    return of_chunks.crossJoin(F.broadcast(of_files))  # one row each
