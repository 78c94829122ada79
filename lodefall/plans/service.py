"""Queries of path facts, answers, evaluation and upkeep, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import evaluation, executors, facts, maintenance
from lodefall.plans import pathsql
from lodefall.plans.registry import query
from lodefall.session import table


def _spark(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING")


# --- path facts ------------------------------------------------------------------------------------------------------

def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("/jobs/old archive/"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", root.alias("root"), F.concat(root, F.lit("/"), pathsql.path_of("o_orderkey")).alias("path"))


_FACTS = pathsql.sql_facts("orders", "o_orderkey", pathsql.sql_path("o_orderkey"))


@query(_FACTS)
def path_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.facts(_paths(spark, sf_dir), "path", "root").drop("path", "root")
    return found.withColumns({c: F.col(c).cast("string") for c in ("file_date", "folder_date")})


@query(f"WITH f AS ({_FACTS}) SELECT o_orderkey, '/' || o_custkey AS project, true AS unmapped FROM orders JOIN f USING (o_orderkey) WHERE canonical_category IS NULL AND o_orderstatus <> 'O' ORDER BY o_orderkey LIMIT 500")
def unmapped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = facts.facts(_paths(spark, sf_dir), "path", "root").where("canonical_category IS NULL")
    handled = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select("o_orderkey", F.concat(F.lit("/"), F.col("o_custkey").cast("string")).alias("project"))
    return found.select("o_orderkey").join(handled, "o_orderkey").withColumn("unmapped", F.lit(True)).orderBy("o_orderkey").limit(500)


@query("SELECT p_partkey, CASE WHEN p_name ILIKE '%large%' OR p_name ILIKE '%ring%' THEN CASE WHEN (p_name ILIKE '%small%')::INT + (p_name ILIKE '%widget%')::INT > (p_name ILIKE '%large%')::INT + (p_name ILIKE '%ring%')::INT THEN 'b' ELSE 'a' END WHEN p_name ILIKE '%small%' OR p_name ILIKE '%widget%' THEN 'b' ELSE 'Unknown' END AS typology FROM part")
def typology_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/jobs/"), F.upper("p_name"), F.lit("/x.pdf"))
    return table(spark, sf_dir, "part").select("p_partkey", facts.typology(path, {"a": ("large", "Ring"), "b": ("small", "widget")}).alias("typology"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d IFC') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d Tender') ELSE strftime(o_orderdate, '%d_%m_%Y Concept') END AS folder, o_orderdate::DATE AS d FROM orders)
SELECT o_custkey, (arg_max(d, folder) FILTER (WHERE o_orderkey % 3 = 0))::VARCHAR AS "IFC", (arg_max(d, folder) FILTER (WHERE o_orderkey % 3 = 1))::VARCHAR AS tender FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderkey % 3 < 2) > 0""")
def milestone_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    folder = F.when(k == 0, F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" IFC"))).when(k == 1, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(" Tender"))).otherwise(F.concat(F.date_format(d, "dd_MM_yyyy"), F.lit(" Concept")))
    found = facts.milestones(table(spark, sf_dir, "orders").select("o_custkey", folder.alias("folder")), "o_custkey", "folder")
    return found.withColumns({c: F.col(c).cast("string") for c in ("IFC", "tender")})


# --- answers ---------------------------------------------------------------------------------------------------------

_FILES = """o_orderkey AS file_id, 'f-' || o_orderkey || '.pdf' AS file_name, '/jobs/' || o_custkey || '/f-' || o_orderkey || '.pdf' AS file_path, CAST(o_custkey % 200 AS VARCHAR) AS project_code,
'P' || CAST(o_custkey AS VARCHAR) AS project_id, CASE WHEN o_orderstatus = 'O' THEN 'DISCOVERED' ELSE 'INDEXED' END AS status, CASE o_orderkey % 3 WHEN 0 THEN 'CAD' ELSE 'PDF' END AS content_type,
CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS is_issued, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_latest, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS file_date, CAST(o_orderkey % 9 AS INT) AS revision"""
_CARDS = "CAST(c_custkey AS VARCHAR) AS project_code, c_name AS name, c_mktsegment AS typology_primary, CASE WHEN c_nationkey % 3 = 0 THEN 'tender' END AS stage, c_acctbal AS gfa_sqm, 'Nation ' || c_nationkey AS location"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*_columns(_FILES))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_columns(_CARDS))


def _columns(sql: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(sql[at:k])
            at = k + 1
    return [_spark(x.strip()) for x in [*out, sql[at:]]]


@query(f"""WITH f AS (SELECT {_FILES} FROM orders) SELECT file_id, file_name, project_code, file_date::VARCHAR AS file_date, 1.0::DOUBLE AS confidence FROM f
WHERE status = 'INDEXED' AND (project_code = '17' OR project_id ILIKE '%17%') AND content_type = 'PDF' AND is_issued = 0 AND (file_date >= DATE '1995-01-01' OR file_date IS NULL) AND (file_date <= DATE '1998-12-31' OR file_date IS NULL)
ORDER BY is_latest DESC, f.file_date DESC NULLS LAST, revision DESC, file_id LIMIT 30""")
def file_locator(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"project_code": "17", "content_type": "PDF", "is_issued": False, "date_from": "1995-01-01", "date_to": "1998-12-31"}
    return executors.located(_files(spark, sf_dir), wanted).select("file_id", "file_name", "project_code", F.col("file_date").cast("string").alias("file_date"), "confidence")


def _listed(show: int, sure: float, where: str) -> str:
    line = "project_code || ': ' || name || ' (' || typology_primary || ', ' || coalesce(stage, '?') || ')'"
    return f"""WITH c AS (SELECT {_CARDS} FROM customer), m AS (SELECT * FROM c WHERE {where}), t AS (SELECT project_code, {line} AS line FROM m ORDER BY project_code LIMIT {show})
SELECT (SELECT count(*) FROM m) AS n, coalesce((SELECT string_agg(line, chr(10) ORDER BY project_code) FROM t), '') AS answer, CASE WHEN (SELECT count(*) FROM m) > 0 THEN {sure} ELSE 0.3 END::DOUBLE AS confidence"""


@query(_listed(10, 0.9, "typology_primary = 'HOUSEHOLD' AND stage = 'tender' AND gfa_sqm >= 100 AND gfa_sqm <= 9000"))
def cards_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executors.listed(_cards(spark, sf_dir), {"typology": "HOUSEHOLD", "stage": "tender", "gfa_min": 100, "gfa_max": 9000})


@query(_listed(15, 0.85, "location ILIKE '%NATION 1%'"))
def cards_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executors.across(_cards(spark, sf_dir), {"location": "NATION 1"})


@query(f"""WITH f AS (SELECT {_FILES} FROM orders) SELECT file_id, CASE WHEN content_type = 'CAD' THEN 'Look in the CAD folder of /jobs/' || project_code WHEN is_latest = 1 THEN 'No file matched; the index may be old. Look in /jobs/' || project_code
WHEN is_issued = 1 THEN 'The confidence is low; try other words or look in /jobs/' || project_code END AS advice FROM f""")
def fallback_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("is_latest") == 1, "file_locator").when(F.col("is_issued") == 1, "semantic").otherwise("structured")
    return _files(spark, sf_dir).select("file_id", executors.fallback(mode, F.col("content_type"), F.concat(F.lit("/jobs/"), "project_code")).alias("advice"))


@query("SELECT conv_id, left(string_agg(left(text, 600), ' … ' ORDER BY turn), 600) AS answer FROM conversations WHERE turn < 3 AND text IS NOT NULL GROUP BY 1")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("rank", F.col("turn") + 1)
    return executors.extract(turns, "conv_id", "rank", "text")


@query(f"""WITH f AS (SELECT {_FILES} FROM orders), x AS (SELECT file_id, file_name FROM f WHERE contains(lower(file_name), '-2') OR contains(lower(file_path), '-2') ORDER BY file_id LIMIT 10)
SELECT file_id, file_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = file_id) AS chunks, (SELECT count(*) FROM events WHERE user_id = file_id AND event_type = 'purchase') AS positive, (SELECT count(*) FROM events WHERE user_id = file_id AND event_type = 'error') AS negative FROM x""")
def file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"))
    rating = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    rated = table(spark, sf_dir, "events").select(F.col("user_id").alias("result_id"), rating.alias("rating"))
    return executors.file_search(_files(spark, sf_dir), "-2", chunks, rated).select("file_id", "file_name", "chunks", "positive", "negative")


@query("SELECT o_orderkey AS file_id, min(l_partkey)::VARCHAR AS first_text FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_partkey", F.col("l_partkey").cast("string").alias("text"))
    return executors.first_texts(_files(spark, sf_dir).select("file_id"), chunks, "l_partkey")


@query("""WITH f AS (SELECT 'file' AS kind, p_name AS name, max(p_retailprice) AS score FROM part GROUP BY 2 ORDER BY score DESC, name LIMIT 10), d AS (SELECT 'folder' AS kind, p_brand AS name, round(0.95 * max(p_retailprice), 6) AS score FROM part GROUP BY 2)
SELECT *, row_number() OVER (ORDER BY score DESC, kind, name)::INT AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM d)""")
def mixed_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    files = p.groupBy(F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("score")).orderBy(F.desc("score"), "name").limit(10)
    folders = p.groupBy(F.col("p_brand").alias("name")).agg(F.round(0.95 * F.max("p_retailprice"), 6).alias("score"))
    return executors.mixed(files, folders, "score", "name")


# --- evaluation ------------------------------------------------------------------------------------------------------


@query("""SELECT event_type, count(*) AS questions, count(*) FILTER (WHERE value > 5) AS "right", round(count(*) FILTER (WHERE value > 5) / count(*), 4) AS accuracy, count(*) FILTER (WHERE value > 5) / count(*) >= 0.85 AS passed FROM events GROUP BY ROLLUP (event_type)""")
def routing_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(table(spark, sf_dir, "events"), "event_type", F.col("value") > 5)


@query("""SELECT event_type, count(*) AS questions, count(*) FILTER (WHERE value > 5) AS "right", count(*) FILTER (WHERE user_id % 4 > 0) AS with_results, round(avg(value), 1) AS mean_ms, round(quantile_cont(value, 0.5), 1) AS p50_ms, round(quantile_cont(value, 0.95), 1) AS p95_ms FROM events GROUP BY 1""")
def stress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(table(spark, sf_dir, "events"), "event_type", F.col("value") > 5, F.col("user_id") % 4, "value")


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey), c AS (SELECT l_orderkey AS f, l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 9 ELSE 0 END AS r FROM lineitem),
n AS (SELECT count(*) AS citations, count(*) FILTER (WHERE k.f IS NULL) AS invalid FROM c LEFT JOIN k ON c.f = k.f AND c.r = k.r) SELECT *, round((1 - invalid / citations) * 100, 2) AS valid_percent, invalid = 0 AS passed FROM n""")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    chunks = lines.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("ref"))
    cited = lines.select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") + F.when(F.col("l_partkey") % 5 == 0, 9).otherwise(0)).alias("ref"))
    return evaluation.validity(evaluation.cited(cited, _files(spark, sf_dir), chunks))


@query("SELECT conv_id, coalesce(bool_or(contains(lower(text), 'the') OR contains(lower(text), lower(role))) FILTER (WHERE turn < 5), false) AS hit FROM conversations GROUP BY 1")
def smoke_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("rank", F.col("turn") + 1)
    return evaluation.smoke(turns, "conv_id", "rank", F.col("text"), F.array(F.lit("THE"), "role"))


@query("""WITH r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 200) SELECT props, count(*) AS n FROM r WHERE event_type <> 'click' GROUP BY 1 ORDER BY n DESC, props LIMIT 30""")
def synonym_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("event_type") == "click", F.array(F.lit("concept"))).otherwise(F.array().cast("array<string>"))
    return evaluation.unanswered(table(spark, sf_dir, "events"), "props", tags, "event_id")


# --- upkeep ----------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'manual' ELSE c_mktsegment END AS category FROM customer")
def folder_map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"))
    manual = found.where("c_custkey % 3 = 0").withColumn("category", F.lit("manual"))
    return maintenance.preferring(manual, found, ["c_custkey"], "category")


@query("SELECT s_suppkey AS code, CASE WHEN s_suppkey % 4 = 0 THEN 'second' WHEN s_suppkey % 2 = 0 THEN 'first' ELSE s_name END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 7.5 ELSE s_acctbal END AS value FROM supplier")
def corrections_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("value"), F.lit(1).alias("rank"), F.lit(0).alias("seq"))
    fix = lambda n, field, to, seq, done=False: base.where(f"code % {n} = 0").select("code", F.lit(field).alias("field"), F.lit(to).alias("correct"), F.lit(seq).alias("seq"), F.lit(done).alias("applied"))
    log = fix(2, "name", "first", 1).unionByName(fix(4, "name", "second", 2)).unionByName(fix(5, "value", "7.5", 3)).unionByName(fix(3, "name", "done before", 4, True))
    return maintenance.corrected(base, log, "code", ["name", "value"], "rank", "seq")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS files FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.status_totals(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderpriority, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_indexed FROM events JOIN orders ON o_orderkey = user_id WHERE event_type = 'purchase' GROUP BY 1")
def last_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), "event_type", "ts")
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), "o_orderpriority")
    return maintenance.last_indexed(seen, files, "o_orderpriority", "purchase").withColumn("last_indexed", F.date_format("last_indexed", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT status, count(*) AS files FROM (SELECT CASE WHEN o_custkey % 10 = 0 OR o_orderstatus = 'O' THEN 'DISCOVERED' ELSE 'INDEXED' END AS status FROM orders) GROUP BY 1")
def reset_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    again = F.col("file_path").rlike("^/jobs/[0-9]*0/")
    return maintenance.reset(_files(spark, sf_dir), again).groupBy("status").agg(F.count("*").alias("files"))


@query(f"WITH f AS (SELECT {_FILES} FROM orders) SELECT project_code, count(*) AS files_indexed FROM f WHERE status = 'INDEXED' AND project_code IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 20")
def indexed_per_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executors.per_project(_files(spark, sf_dir))
