"""Queries of stored tables that steps change bucket by bucket, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import intake
from lodefall.operators.store import Stored, cascaded
from lodefall.plans.registry import query
from lodefall.session import scratch, table


def _made(spark: SparkSession, rows: DataFrame, by: str) -> Stored:
    return Stored(spark, scratch(spark, "stored")).create(rows, by)


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 50 = 0 THEN upper(c_name) || '!' END, c_name) AS c_name, CASE WHEN c_custkey % 25 = 0 AND c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 25 = 0 THEN c_nationkey + 100 ELSE c_nationkey END::BIGINT AS c_nationkey FROM customer
UNION ALL SELECT c_custkey + 1000000000, CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_nationkey::BIGINT FROM customer WHERE c_custkey % 40 = 0""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows after an upsert that keeps a value on null and replaces another."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    k = F.col("c_custkey")
    new = old.where(k % 25 == 0).select("c_custkey", F.when(k % 50 == 0, F.concat(F.upper("c_name"), F.lit("!"))).alias("c_name"), F.when(k % 3 != 0, F.col("c_nationkey") + 100).alias("c_nationkey"))
    new = new.unionByName(old.where(k % 40 == 0).select((k + 1000000000).alias("c_custkey"), F.when(k % 2 == 0, F.col("c_name")).alias("c_name"), "c_nationkey"))
    store = _made(spark, old, "c_custkey")
    store.upsert(new, "c_custkey", ["c_name"], ["c_nationkey"])
    return store.read()


@query("""WITH x AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 4 <> 0 AS had, doc_id % 10 = 0 AS comes, doc_id % 3 = 0 AS differs FROM documents)
SELECT doc_id AS file_id, sha256(CASE WHEN comes AND differs THEN t || ' changed' ELSE t END) AS content_hash, (CASE WHEN comes AND (differs OR NOT had) THEN 0 ELSE 1 END)::INT AS embedded FROM x WHERE had OR comes""")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks after those of a tenth of the files came in anew, twice; the second time nothing is written."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("p1").alias("ref"), "text")
    k = F.col("file_id")
    store = _made(spark, intake.prepared(docs.where(k % 4 != 0)).withColumn("embedded", F.lit(1)), "file_id")
    changed = F.when(k % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" changed"))).otherwise(F.col("text"))
    new = intake.prepared(docs.where(k % 10 == 0).withColumn("text", changed))
    for _ in range(2):
        store.upsert_chunks(new)
    return store.read().select("file_id", "content_hash", "embedded")


@query("""SELECT vec_id, CASE WHEN vec_id % 30 = 0 THEN label + 100 ELSE label END::BIGINT AS label, len(embedding)::INT AS size FROM embeddings
UNION ALL SELECT vec_id + 1000000000, label::BIGINT, len(embedding)::INT FROM embeddings WHERE vec_id % 50 = 0""")
def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors after others of some keys came in."""
    old = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    new = old.where("vec_id % 30 = 0").withColumn("label", F.col("label") + 100).unionByName(old.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1000000000))
    store = _made(spark, old, "vec_id")
    store.merge(new, "vec_id")
    return store.read().select("vec_id", "label", F.size("embedding").alias("size"))


@query("""SELECT o_orderkey AS file_id, count(l_orderkey) AS chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND o_custkey % 10 = 0) GROUP BY 1
UNION ALL SELECT NULL, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def stored_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each stored file after files were deleted with their chunks, and chunks without a file (a row with null)."""
    orders = table(spark, sf_dir, "orders")
    files = _made(spark, orders.select(F.col("o_orderkey").alias("file_id"), "o_orderstatus"), "file_id")
    chunks = _made(spark, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber"), "file_id")
    cascaded(files, [chunks], orders.where("o_orderstatus = 'F' AND o_custkey % 10 = 0").select(F.col("o_orderkey").alias("file_id")))
    left, held = files.read().select("file_id"), chunks.read()
    counted = left.join(held.groupBy("file_id").agg(F.count("*").alias("chunks")), "file_id", "left").select("file_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
    astray = held.join(left, "file_id", "left_anti").agg(F.count("*").alias("chunks")).select(F.lit(None).cast(left.schema["file_id"].dataType).alias("file_id"), "chunks")
    return counted.unionByName(astray)
