"""Queries of the incremental steps, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import intake
from lodefall.plans import archive, pathsql, service
from lodefall.plans.registry import query
from lodefall.session import table

_ID = "sha256(doc_id::VARCHAR || '::p1')"
_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> ''))"
_OLD = f"o AS (SELECT {_ID} AS chunk_id, sha256(coalesce(text, '')) AS content_hash, {_WORDS} * 4 // 3 AS token_estimate, doc_id % 2 AS embedded FROM documents WHERE doc_id % 4 <> 0)"
_NEW = f"""n AS (SELECT {_ID} AS chunk_id, sha256(coalesce(text, '')) AS content_hash, {_WORDS} * 4 // 3 AS token_estimate
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0))"""


def _chunks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("file_id"), F.lit("p1").alias("ref"), "text")


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = intake.prepared(_chunks(docs.where("doc_id % 4 <> 0"))).withColumn("embedded", (F.col("file_id") % 2).cast("int"))
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))
    return intake.upserted(old, intake.prepared(_chunks(docs.where("doc_id % 5 <> 0").withColumn("text", changed))))


@query(f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, o.content_hash AS oh, n.content_hash AS nh, o.token_estimate AS ot, n.token_estimate AS nt, o.embedded AS e,
CASE WHEN o.chunk_id IS NULL THEN 'new' WHEN n.chunk_id IS NULL THEN 'kept' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.chunk_id = n.chunk_id)
SELECT chunk_id, outcome, coalesce(nh, oh) AS content_hash, coalesce(nt, ot)::BIGINT AS token_estimate, CASE WHEN outcome IN ('new', 'updated') THEN 0 ELSE e END::INT AS embedded FROM j""")
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upserted(spark, sf_dir).select("chunk_id", "outcome", "content_hash", "token_estimate", "embedded")


@query("""WITH x AS (SELECT doc_id, doc_id % 4 <> 0 AS had, doc_id % 5 <> 0 AS comes, doc_id % 3 = 0 AS differs FROM documents)
SELECT doc_id AS file_id, (comes AND NOT had)::BIGINT AS "new", (comes AND had AND differs)::BIGINT AS updated, (comes AND had AND NOT differs)::BIGINT AS unchanged FROM x WHERE had OR comes""")
def chunk_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.outcomes(_upserted(spark, sf_dir))


# --- embedding ---------------------------------------------------------------------------------------------------------

#: Files by status; three chunks each, of which the third is blank; the second of every seventh file fails to embed.
_STATE = """files AS (SELECT doc_id AS file_id, '/a/' || doc_id AS file_path, CASE WHEN doc_id % 3 = 0 THEN source END AS project_id, lang AS typology,
CASE doc_id % 4 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'EXTRACTED' WHEN 2 THEN 'EMBEDDED' ELSE 'DISCOVERED' END AS status FROM documents),
chunks AS (SELECT sha256(doc_id || '::p' || k) AS chunk_id, doc_id AS file_id, 'p' || k AS ref, CASE WHEN k = 3 THEN ' ' ELSE 'text ' || k END AS text, (k = 1 AND doc_id % 2 = 0)::INT AS embedded, NOT (k = 2 AND doc_id % 7 = 0) AS works
FROM documents, (SELECT unnest([1, 2, 3]) AS k))"""
_MARKED = "marked AS (SELECT chunk_id, c.file_id, CASE WHEN status = 'EXTRACTED' AND (trim(text) = '' OR works) THEN 1 ELSE embedded END AS embedded FROM chunks c JOIN files f ON c.file_id = f.file_id)"


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 4 < 2, "EXTRACTED").when(F.col("doc_id") % 4 == 2, "EMBEDDED").otherwise("DISCOVERED")
    files = docs.select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/a/"), F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("project_id"), F.col("lang").alias("typology"), status.alias("status"))
    each = docs.select(F.col("doc_id").alias("file_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    text = F.when(F.col("k") == 3, " ").otherwise(F.concat(F.lit("text "), F.col("k").cast("string")))
    chunks = intake.prepared(each.select("file_id", F.concat(F.lit("p"), F.col("k").cast("string")).alias("ref"), text.alias("text"))).withColumn("embedded", F.when(F.col("ref") == "p1", (F.col("file_id") % 2 == 0).cast("int")).otherwise(0))
    works = ~((F.col("ref") == "p2") & (F.col("file_id") % 7 == 0)) & (F.trim("text") != "")
    vectors = intake.pending(chunks, files).select("chunk_id", F.when(works, F.array(F.lit(1.0))).alias("embedding"))
    return files, chunks, vectors


@query(f"WITH {_STATE} SELECT chunk_id, c.file_id, ref, file_path, coalesce(project_id, 'Unknown') AS project_id, coalesce(typology, 'Unknown') AS typology FROM chunks c JOIN files f ON c.file_id = f.file_id WHERE embedded = 0 AND status = 'EXTRACTED'")
def embed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, _ = _state(spark, sf_dir)
    return intake.pending(chunks, files).select("chunk_id", "file_id", "ref", "file_path", "project_id", "typology")


@query(f"WITH {_STATE}, {_MARKED} SELECT chunk_id, embedded FROM marked")
def embed_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, vectors = _state(spark, sf_dir)
    return intake.marked(chunks, files, vectors).select("chunk_id", "embedded")


@query(f"""WITH {_STATE}, {_MARKED}, w AS (SELECT file_id, count(*) FILTER (WHERE embedded = 0) AS waits FROM marked GROUP BY 1)
SELECT f.file_id, CASE WHEN status = 'EMBEDDED' OR status = 'EXTRACTED' AND waits = 0 THEN 'INDEXED' ELSE status END AS status FROM files f JOIN w ON f.file_id = w.file_id""")
def files_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, vectors = _state(spark, sf_dir)
    return intake.finalised(intake.advanced(files, intake.marked(chunks, files, vectors))).select("file_id", "status")


@query(f"WITH {_STATE} SELECT c.chunk_id, 0 AS embedded, CASE WHEN status IN ('INDEXED', 'EMBEDDED') THEN 'EXTRACTED' ELSE status END AS status FROM chunks c JOIN files f ON c.file_id = f.file_id")
def rebuild_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, chunks, _ = _state(spark, sf_dir)
    files, chunks = intake.rebuilt(files, chunks)
    return chunks.join(files, "file_id").select("chunk_id", "embedded", "status")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END::BIGINT AS label FROM embeddings UNION ALL SELECT vec_id + 1000000000, label FROM embeddings WHERE vec_id % 5 = 0")
def vectors_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    new = old.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).unionByName(old.where("vec_id % 5 = 0").withColumn("vec_id", F.col("vec_id") + 1000000000))
    return intake.merged(old, new, "vec_id")


# --- what is appended ----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT 'S' || (s_suppkey % 40) AS project, s_name AS alias, s_suppkey AS added FROM supplier), old AS (SELECT project, min(alias) AS alias FROM a WHERE added % 2 = 0 GROUP BY 1)
SELECT project, alias, 0 AS added FROM old UNION ALL (SELECT project, lower(project), min(added) FROM a WHERE added % 2 = 1 GROUP BY 1)""")
def aliases_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that are known stay; of several new rows of one alias the first stays."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("project"), F.col("s_name").alias("alias"), F.col("s_suppkey").cast("long").alias("added"))
    old = rows.where("added % 2 = 0").groupBy("project").agg(F.min("alias").alias("alias")).withColumn("added", F.lit(0).cast("long"))
    again = old.select("project", "alias", F.lit(7).cast("long").alias("added"))
    new = rows.where("added % 2 = 1").withColumn("alias", F.lower("project")).unionByName(again)
    return intake.kept_once(old, new, ["project", "alias"], [F.asc("added")])


@query("""WITH l AS (SELECT event_id AS number, event_type, user_id FROM events WHERE event_id % 2 = 0), r AS (SELECT event_type, user_id, event_id FROM events WHERE event_id % 2 = 1)
SELECT number, event_type, user_id FROM l UNION ALL SELECT (SELECT max(number) FROM l) + row_number() OVER (ORDER BY event_id), event_type, user_id FROM r""")
def events_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("number"), "event_type", "user_id")
    rows = events.where("number % 2 = 1").withColumnRenamed("number", "event_id")
    return intake.appended(events.where("number % 2 = 0"), rows, "number", ["event_id"])


@query("""WITH s AS (SELECT DISTINCT conv_id AS session_id, 10 AS created_at, 20 AS last_active FROM conversations WHERE conv_id % 2 = 0),
m AS (SELECT conv_id AS session_id, min(turn * 7 % 50) AS lo, max(turn * 7 % 50) AS hi FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1)
SELECT session_id, coalesce(created_at, lo)::BIGINT AS created_at, greatest(coalesce(last_active, hi), coalesce(hi, last_active))::BIGINT AS last_active FROM s FULL JOIN m USING (session_id)""")
def sessions_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    sessions = talks.where("conv_id % 2 = 0").select(F.col("conv_id").alias("session_id")).distinct().withColumns({"created_at": F.lit(10).cast("long"), "last_active": F.lit(20).cast("long")})
    messages = talks.where("conv_id % 3 = 0").select(F.col("conv_id").alias("session_id"), (F.col("turn") * 7 % 50).cast("long").alias("ts"))
    return intake.touched(sessions, messages)


# --- facts, images, types ------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT o_orderkey, 'P' || (o_orderkey % 13) AS project_code, o_orderkey % 3 = 0 AS done FROM orders), t AS ({service._FACTS}),
f AS (SELECT o_orderkey AS file_id, project_code, CASE WHEN done THEN 'kept' ELSE folder_stage END AS folder_stage, CASE WHEN done THEN 'Kept' ELSE discipline END AS discipline, CASE WHEN done THEN 'Plan' ELSE doc_type END AS doc_type,
CASE WHEN done THEN o_orderkey % 5 ELSE revision END AS revision, CASE WHEN done THEN NULL ELSE file_date END AS file_date FROM p JOIN t USING (o_orderkey)),
l AS (SELECT file_id FROM f WHERE discipline <> 'unknown' AND doc_type <> 'unknown' QUALIFY row_number() OVER (PARTITION BY project_code, discipline, doc_type ORDER BY coalesce(revision, -1) DESC, coalesce(file_date, '') DESC, file_id) = 1)
SELECT file_id, folder_stage, discipline, doc_type, revision::INT AS revision, (file_id IN (SELECT file_id FROM l))::INT AS is_latest FROM f""")
def parse_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderkey") % 3 == 0
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("P"), (F.col("o_orderkey") % 13).cast("string")).alias("project_code"), pathsql.path_of("o_orderkey").alias("file_path"))
    held = {"folder_stage": "kept", "discipline": "Kept", "doc_type": "Plan"}
    rows = rows.withColumns({c: F.when(done, v) for c, v in held.items()} | {"revision": F.when(done, (F.col("o_orderkey") % 5).cast("int"))})
    rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("file_date", "string"), ("folder_date", "string"), ("content_type", "string"), ("is_issued", "int"), ("is_superseded", "int"), ("is_received", "int"), ("canonical_category", "string"))})
    return intake.parsed(rows.withColumnRenamed("o_orderkey", "file_id").withColumn("is_latest", F.lit(1))).select("file_id", "folder_stage", "discipline", "doc_type", "revision", "is_latest")


_IMAGE_PATH = "'/p/' || CASE p_partkey % 4 WHEN 0 THEN 'Renders' WHEN 1 THEN 'Scanned' WHEN 2 THEN 'images' ELSE 'misc' END || '/' || replace(p_name, ' ', '_') || '.' || CASE WHEN p_partkey % 5 = 0 THEN 'pdf' ELSE 'JPG' END"


@query(f"""WITH f AS (SELECT p_partkey AS file_id, {_IMAGE_PATH} AS file_path, CASE p_partkey % 4 WHEN 0 THEN 'render' WHEN 1 THEN 'scanned_document' WHEN 2 THEN CASE WHEN p_size >= 25 THEN 'render' ELSE 'unknown' END ELSE 'unknown' END AS kind,
p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AS waits, p_partkey % 11 = 0 AS had FROM part),
w AS (SELECT *, list_filter(list_transform(string_split(substr(file_path, 2), '/'), lambda x: trim(replace(replace(x, '_', ' '), '.', ' '))), lambda x: x <> '') AS ps FROM f)
SELECT file_id, CASE WHEN waits THEN kind WHEN file_id % 7 = 0 THEN 'given' END AS image_type, CASE WHEN had THEN 'old' WHEN waits AND kind <> 'scanned_document' THEN
trim('Project image ' || CASE kind WHEN 'render' THEN 'render visualisation image' ELSE 'image' END || ' — ' || '/ ' || array_to_string(ps, ' ')) END AS text FROM w""")
def image_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ext = F.when(F.col("p_partkey") % 5 == 0, "pdf").otherwise("JPG")
    folder = F.get(F.array(*map(F.lit, ("Renders", "Scanned", "images", "misc"))), (F.col("p_partkey") % 4).cast("int"))
    path = F.concat(F.lit("/p/"), folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ext)
    files = part.select(F.col("p_partkey").alias("file_id"), path.alias("file_path"), ext.alias("extension"), F.lit("METADATA_ONLY").alias("lane"), (F.col("p_size") * 209716).cast("long").alias("size"), F.when(F.col("p_partkey") % 7 == 0, "given").alias("image_type"))
    old = intake.prepared(part.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("file_id"), F.lit("image_context").alias("ref"), F.lit("old").alias("text")))
    files, chunks = intake.described(files, old)
    return files.join(chunks.select("file_id", "text"), "file_id", "left").select("file_id", "image_type", "text")


@query(f"""WITH c AS ({archive._content_sql()}), w AS (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id AS file_id, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN doc_id IN (SELECT doc_id FROM w) AND confidence >= 0.75 THEN doc_type END AS doc_type,
CASE WHEN doc_id NOT IN (SELECT doc_id FROM w) THEN NULL WHEN confidence >= 0.75 THEN 'content' ELSE 'unknown' END AS method FROM c""")
def type_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    head = F.get(F.array(*map(F.lit, archive.HEADS)), (F.col("doc_id") % 8).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("file_id"), F.lit("p1").alias("ref"), F.concat(head, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    chunks = chunks.unionByName(chunks.select("file_id", F.lit("p2").alias("ref"), F.lit("minutes of meeting").alias("text")))
    files = docs.select(F.col("doc_id").alias("file_id"), F.lit("TEXT_EXTRACTABLE").alias("lane"), F.lit("INDEXED").alias("status"), F.when(F.col("doc_id") % 3 == 0, "given").alias("doc_type"), F.lit(None).cast("string").alias("classification_method"), F.lit(None).cast("double").alias("classification_confidence"))
    return intake.typed(files, chunks).select("file_id", "doc_type", F.col("classification_method").alias("method"))
