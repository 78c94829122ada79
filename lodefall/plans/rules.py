"""Queries of rules that read names, paths and mails, over values of many parts, with the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import classify, resolution
from lodefall.plans import pathsql
from lodefall.plans.registry import query
from lodefall.session import table
from lodefall.sources import files


def _at(xs: tuple, key: str, step: int) -> Column:
    return F.get(F.array(*map(F.lit, xs)), F.pmod(F.floor(F.col(key) / step), F.lit(len(xs))).cast("int"))


def _sql_at(xs: tuple, key: str, step: int) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + f"][({key} // {step}) % {len(xs)} + 1]"


# --- folders and images ------------------------------------------------------------------------------------------------

_MORE = ("Drawing Register", "photos", "3D", "eqs", "addressees", "QMS", "sketch", "", "InDesign", "client emails", "Site Staff", "tempo", "ppt")


@query(
    f"WITH f AS (SELECT o_orderkey, lower({_sql_at(pathsql.INNER, 'o_orderkey', 1)} || ' ' || {_sql_at(_MORE, 'o_orderkey', 3)} || ' ' || {_sql_at(pathsql.FOLDERS, 'o_orderkey', 7)}) AS d FROM orders) SELECT o_orderkey, CASE "
    + " ".join(f"WHEN contains(d, '{part}') THEN '{category}'" for part, category in classify.FOLDERS)
    + " END AS category FROM f"
)
def folder_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.concat_ws(" ", _at(pathsql.INNER, "o_orderkey", 1), _at(_MORE, "o_orderkey", 3), _at(pathsql.FOLDERS, "o_orderkey", 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.folder_category(folder).alias("category"))


_PLACES = ("viz", "Scanned", "images", "x", "CGI", "scan", "Enscape", "my-scans")
_IMAGE = f"'/job/' || {_sql_at(_PLACES, 'o_orderkey', 1)} || '/' || {pathsql.sql_path('o_orderkey')}"


@query(f"""WITH p AS (SELECT o_orderkey, {_IMAGE} AS path, o_totalprice * 100 AS size FROM orders), l AS (SELECT *, lower(path) AS p FROM p),
m AS (SELECT *, {" OR ".join(f"contains(p, '{x}')" for x in classify.RENDERS)} AS render, {" OR ".join(f"contains(p, '{x}')" for x in classify.SCANS)} OR contains(string_split(p, '/')[-1], 'scan') AS scan, size > 5242880 AND contains(p, '/images/') AS large FROM l),
c AS (SELECT *, CASE WHEN render THEN 'render' WHEN scan THEN 'scanned_document' WHEN large THEN 'render' ELSE 'unknown' END AS image_type,
(list_concat(['/'], list_filter(string_split(path, '/'), lambda x: x <> ''))) AS ps FROM m)
SELECT o_orderkey, image_type, NOT render AND scan AS needs_ocr, (CASE WHEN render THEN 0.9 WHEN scan THEN 0.85 WHEN large THEN 0.75 ELSE 0.5 END)::DOUBLE AS confidence,
trim('Project image ' || CASE image_type WHEN 'render' THEN 'render visualisation image' WHEN 'scanned_document' THEN 'scanned document' ELSE 'image' END || ' — ' ||
array_to_string(list_filter(list_transform(ps[greatest(len(ps) - 5, 1):], lambda x: trim(regexp_replace(x, '[-_.]', ' ', 'g'))), lambda x: x NOT IN ('', 'jpg', 'jpeg', 'png', 'gif', 'tif', 'tiff')), ' ')) AS description FROM c""")
def image_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/job/"), _at(_PLACES, "o_orderkey", 1), F.lit("/"), pathsql.path_of("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), (F.col("o_totalprice") * 100).alias("size"))
    found = rows.withColumn("c", classify.image(F.col("path"), F.col("size")))
    return found.select("o_orderkey", "c.*", classify.image_description(F.col("path"), F.col("c.image_type")).alias("description"))


# --- mail --------------------------------------------------------------------------------------------------------------

_SUBJECTS = ("Re: Waiver of rule", "Submitted plans", "MOM 4", "deviation", "Transmittal and minutes", "lunch")
_SENDERS = ("own.example", "OWN.example", "bca.gov.sg", "other.org", "", "second.example")
_TO = ("own.example", "", "hdb.gov.sg", "other.org,own.example", "second.example,Own.Example", "ura.gov.sg,other.org", "other.org,,own.example")
_OURS = ("own.example", "second.example")


@query(f"""WITH m AS (SELECT o_orderkey, {_sql_at(_SUBJECTS, 'o_orderkey', 1)} AS subject, {_sql_at(_SENDERS, 'o_orderkey', 2)} AS sender, list_filter(string_split({_sql_at(_TO, 'o_orderkey', 5)}, ','), lambda x: x <> '') AS rec, o_orderpriority AS body FROM orders),
s AS (SELECT *, lower(subject || ' ' || body) AS said, lower(sender) IN {_OURS} AS ours, len(list_filter(rec, lambda d: lower(d) NOT IN {_OURS})) = 0 AS inside, len(list_filter(list_append(rec, lower(sender)), lambda d: d IN {classify.AUTHORITIES})) > 0 AS official FROM m)
SELECT o_orderkey, CASE WHEN sender = '' THEN 'unknown' WHEN ours AND inside THEN 'internal' WHEN ours THEN 'outbound' ELSE 'inbound' END AS direction,
array_to_string(list_filter([CASE WHEN regexp_matches(said, '{classify.MAIL_WORDS["waiver_correspondence"]}') THEN 'waiver_correspondence' END, CASE WHEN official THEN 'authority_correspondence' END,
CASE WHEN regexp_matches(said, '{classify.MAIL_WORDS["submission_correspondence"]}') THEN 'submission_correspondence' END, CASE WHEN regexp_matches(said, '{classify.MAIL_WORDS["meeting_correspondence"]}') THEN 'meeting_correspondence' END], lambda x: x IS NOT NULL), ',') AS tags FROM s""")
def mail_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    sender, to = _at(_SENDERS, "o_orderkey", 2), F.array_remove(F.split(_at(_TO, "o_orderkey", 5), ","), "")
    tags = classify.mail_tags(_at(_SUBJECTS, "o_orderkey", 1), F.col("o_orderpriority"), F.array_union(F.array(F.lower(sender)), to))
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.mail_direction(sender, to, _OURS).alias("direction"), F.array_join(tags, ",").alias("tags"))


# --- overrides, scans, globs -------------------------------------------------------------------------------------------

_DEEP = "'/archive/' || (o_custkey % 50) || '/' || repeat('d/', (o_orderkey % 16)::INT) || (o_orderkey % 3) || '/f.pdf'"


@query(f"""WITH p AS (SELECT o_orderkey, {_DEEP} AS path FROM orders), o AS (SELECT DISTINCT '/archive/' || (o_custkey % 50) AS folder, 'root ' || (o_custkey % 50) AS project FROM orders WHERE o_custkey % 4 = 0
UNION ALL SELECT DISTINCT '/archive/' || (o_custkey % 50) || '/d/d/d', 'deep' FROM orders WHERE o_custkey % 3 = 0)
SELECT o_orderkey, arg_max(project, length(folder)) AS project FROM p JOIN o ON starts_with(path, folder || '/') WHERE len(string_split(path, '/')) - 1 - len(string_split(folder, '/')) < 12 GROUP BY 1""")
def nearest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of the nearest folder, at most twelve levels up."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", F.expr(_DEEP).alias("path"))
    root = F.concat(F.lit("/archive/"), (F.col("o_custkey") % 50).cast("string"))
    roots = orders.where("o_custkey % 4 = 0").select(root.alias("folder"), F.concat(F.lit("root "), (F.col("o_custkey") % 50).cast("string")).alias("project")).distinct()
    deep = orders.where("o_custkey % 3 = 0").select(F.concat(root, F.lit("/d/d/d")).alias("folder"), F.lit("deep").alias("project")).distinct()
    return resolution.nearest_override(rows, "o_orderkey", "path", roots.unionByName(deep), "folder", "project")


@query(f"""WITH p AS (SELECT o_orderkey, {_DEEP} AS path FROM orders),
o AS (SELECT DISTINCT '/archive/' || (o_custkey % 50) AS folder, CASE WHEN o_custkey % 50 % 8 = 0 THEN 'given' END AS typology FROM orders WHERE o_custkey % 50 % 4 = 0),
n AS (SELECT o_orderkey, arg_max_null(typology, length(folder)) AS typology FROM p JOIN o ON starts_with(path, folder || '/') WHERE len(string_split(path, '/')) - 1 - len(string_split(folder, '/')) < 12 GROUP BY 1),
k AS (SELECT *, contains(path, '7')::INT + contains(path, '4')::INT AS a, contains(path, '2')::INT + contains(path, '3')::INT AS b FROM p)
SELECT o_orderkey, coalesce(n.typology, CASE WHEN a = 0 AND b = 0 THEN 'Unknown' WHEN b > a THEN 'b' ELSE 'a' END) AS typology FROM k LEFT JOIN n USING (o_orderkey)""")
def typology_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typology that the nearest folder's override gives, if it gives one, else that of the keywords."""
    orders = table(spark, sf_dir, "orders")
    number = F.col("o_custkey") % 50
    given = orders.where(number % 4 == 0).select(F.concat(F.lit("/archive/"), number.cast("string")).alias("folder"), F.when(number % 8 == 0, "given").alias("typology")).distinct()
    return resolution.typologies(orders.select("o_orderkey", F.expr(_DEEP).alias("path")), "o_orderkey", "path", {"a": ("7", "4"), "b": ("2", "3")}, given)


_SCAN = "o_orderkey AS path, (o_totalprice / 1000)::INT AS size, (o_custkey % 7 + (o_orderkey % 5) * 0.003)::DOUBLE AS mtime"
_KNOWN = "o_orderkey AS path, (o_totalprice / 1000)::INT + CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS size, (o_custkey % 7)::DOUBLE AS mtime, CASE o_orderkey % 5 WHEN 0 THEN 'INDEXED' WHEN 1 THEN 'EXTRACTED' WHEN 2 THEN 'EMBEDDED' WHEN 3 THEN 'FAILED' ELSE 'INDEXED' END AS status"


@query(f"""WITH s AS (SELECT {_SCAN} FROM orders), k AS (SELECT {_KNOWN} FROM orders WHERE o_orderstatus <> 'O'),
j AS (SELECT s.path, CASE WHEN s.size > 250 THEN 'skipped' WHEN k.path IS NULL THEN 'discovered' WHEN k.status IN ('EXTRACTED', 'EMBEDDED', 'INDEXED') AND s.size = k.size AND abs(s.mtime - k.mtime) < 0.01 THEN 'unchanged' ELSE 'changed' END AS outcome FROM s LEFT JOIN k ON s.path = k.path)
SELECT path, outcome, outcome IN ('discovered', 'changed') AS needs_fingerprint FROM j""")
def discover_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    whole, price = F.col("o_custkey") % 7, F.round(F.col("o_totalprice") / 1000).cast("int")
    key = F.col("o_orderkey")
    scan = orders.select(key.alias("path"), price.alias("size"), (whole + (key % 5) * 0.003).cast("double").alias("mtime"))
    status = F.get(F.array(*map(F.lit, ("INDEXED", "EXTRACTED", "EMBEDDED", "FAILED", "INDEXED"))), (key % 5).cast("int"))
    known = orders.where("o_orderstatus <> 'O'").select(key.alias("path"), (price + F.when(F.col("o_custkey") % 11 == 0, 1).otherwise(0)).alias("size"), whole.cast("double").alias("mtime"), status.alias("status"))
    return files.outcomes(scan, known, 250)


_ENDS = ("x.tmp", "b.pdf", "e.PDF", "cached.txt", "none", "cache", "a.tmp.pdf", "~x.pif")
_IN = ("a", "cache", "tmp/cache", "cached", "none")


@query(f"""WITH p AS (SELECT o_orderkey, '/jobs/' || {_sql_at(_IN, 'o_orderkey', 3)} || '/' || {_sql_at(_ENDS, 'o_orderkey', 1)} AS path FROM orders), n AS (SELECT *, string_split(path, '/') AS ps FROM p)
SELECT o_orderkey, regexp_matches(ps[-1], '^.*\\.tmp$') OR ps[-1] = 'none' OR regexp_matches(ps[-1], '^~[^p]') OR list_contains(ps, 'cache') AS excluded, regexp_matches(ps[-1], '^.*\\.p.f$') AS included FROM n""")
def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/jobs/"), _at(_IN, "o_orderkey", 3), F.lit("/"), _at(_ENDS, "o_orderkey", 1))
    return table(spark, sf_dir, "orders").select("o_orderkey", files.excluded(path, ["**/*.tmp", "**/cache/**/none", "~[!p]*"]).alias("excluded"), files.included(path, ["**/*.p?f"]).alias("included"))
