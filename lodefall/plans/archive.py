"""Queries of classification, project resolution, stemmed search, audits and checks, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.functions import text as tx
from lodefall.operators import analytics, classify, paths, resolution, search
from lodefall.plans.indexes import BREAK, index_of, words_of
from lodefall.plans.registry import query
from lodefall.session import table

# --- classification --------------------------------------------------------------------------------------------------

#: Beginnings put before texts, so that every type occurs.
HEADS = (
    "Minutes of Meeting present: all action by us",
    "Transmittal please find enclosed document number 7 revision 2",
    "Submission to URA building plan ura/dc/1",
    "We request a waiver in lieu of regulation 12",
    "Design brief scope of works",
    "Specification 1.2.3 the contractor shall",
    "Action items only",
    "",
)
_HEAD_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{h} '" for k, h in enumerate(HEADS)) + " END || coalesce(text, '')"


def _content_sql() -> str:
    """The rules as SQL over the text; of the authorities only the first that is named counts."""
    hit = lambda alternatives: " OR ".join("(" + " AND ".join(f"regexp_matches({part}, '{p}')" for part, p in needed) + ")" for needed in alternatives)
    one = classify.AUTHORITY_SIGNALS

    def holds(name: str) -> str:
        return f"coalesce(authority = '{name}', false)" if name in one else f"({hit(rule[name][1])})"

    rule = {name: (w, alternatives) for _, signals in classify.CONTENT_RULES for name, w, alternatives in signals}
    sums = [" + ".join(f"CASE WHEN {holds(name)} THEN {w} ELSE 0 END" for name, w, _ in signals) for _, signals in classify.CONTENT_RULES]
    names = [name for name, _ in classify.CONTENT_RULES]
    kind = "CASE " + " ".join(f"WHEN t{k} >= 2 THEN '{n}'" for k, n in enumerate(names)) + " ELSE 'unknown' END"
    level = "CASE " + " ".join(f"WHEN t{k} >= 2 THEN least(0.5 + t{k} * 0.1, 1)" for k in range(len(names))) + " ELSE 0.3 END"
    reached = "CASE " + " ".join(f"WHEN t{k} >= 2 THEN {k}" for k in range(len(names))) + f" ELSE {len(names)} END"
    signals = ", ".join(f"CASE WHEN {holds(name)} AND {reached} >= {k} THEN '{name}' END" for k, (_, signals) in enumerate(classify.CONTENT_RULES) for name, _, _ in signals)
    authority = "CASE " + " ".join(f"WHEN {hit(rule[x][1])} THEN '{x}'" for x in one) + " END"
    return f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_HEAD_SQL}, '\\s+'), lambda x: x <> '')[1:500] AS ws FROM documents),
p AS (SELECT doc_id, lower(array_to_string(ws, ' ')) AS preview, lower(array_to_string(ws[1:50], ' ')) AS first_50, lower(array_to_string(ws[1:20], ' ')) AS first_20 FROM w),
a AS (SELECT *, {authority} AS authority FROM p), t AS (SELECT *, {", ".join(f"{x} AS t{k}" for k, x in enumerate(sums))} FROM a)
SELECT doc_id, {kind} AS doc_type, round({level}, 4)::DOUBLE AS confidence, array_to_string(list_filter([{signals}], lambda x: x IS NOT NULL), ',') AS signals FROM t"""


@query(_content_sql())
def content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.element_at(F.array(*(F.lit(f"{h} ") for h in HEADS)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))
    return classify.content(docs, "text").select("doc_id", "doc_type", "confidence", F.array_join("signals", ",").alias("signals"))


_FOLDER = """CASE (o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END) % 4 WHEN 0 THEN '2' || (10 + o_custkey % 80) || ' ' WHEN 1 THEN '0' || (o_orderkey % 9) || ' ' WHEN 2 THEN '2' || (10 + o_custkey % 80) || ' 0' || (o_orderkey % 9) || ' ' ELSE '' END
|| CASE o_orderkey % 6 WHEN 0 THEN 'CAD' WHEN 1 THEN 'Site Visit' WHEN 2 THEN 'Project Images' WHEN 3 THEN 'Old stuff' WHEN 4 THEN 'Client brief' ELSE 'PPT' END"""


@query(f"""WITH f AS (SELECT o_custkey, {_FOLDER} AS d FROM orders),
k AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE regexp_matches(d, '^[0-9]{{2}}\\s')) AS a, count(*) FILTER (WHERE regexp_matches(d, '^[0-9]{{3,4}}\\s+[0-9]{{2}}\\s')) AS b,
 count(*) FILTER (WHERE regexp_matches(d, '^[0-9]{{3,4}}\\s') AND NOT regexp_matches(d, '^[0-9]{{3,4}}\\s+[0-9]{{2}}\\s')) AS c FROM f GROUP BY 1),
x AS (SELECT o_custkey, regexp_extract(d, '^([0-9]{{3,4}})\\s', 1) AS prefix, count(*) AS m FROM f GROUP BY 1, 2)
SELECT k.o_custkey, CASE WHEN b / n >= 0.7 THEN 'prefixed_numbered' WHEN (a + b) / n >= 0.7 THEN 'numbered' WHEN c / n >= 0.7 THEN 'prefixed' WHEN (n - a - b - c) / n >= 0.7 THEN 'plain' ELSE 'mixed' END AS convention,
coalesce((SELECT max(prefix) FROM x WHERE x.o_custkey = k.o_custkey AND x.prefix <> '' AND x.m / k.n > 0.5), '') AS prefix, round(greatest(a, b, c, n - a - b - c) / n, 2) AS confidence, n AS folders FROM k""")
def folder_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "orders").select("o_custkey", F.expr(_FOLDER).alias("folder"))
    return classify.convention(folders, "o_custkey", "folder")


# --- resolution ------------------------------------------------------------------------------------------------------

_JOB = """'/archive/' || CASE o_orderkey % 5 WHEN 0 THEN 'roots/' || o_custkey || '/x' WHEN 1 THEN 'job ' || (1000 + o_custkey) || ' plans/y' WHEN 2 THEN 'the CUSTOMER ' || lpad(o_custkey::VARCHAR, 6, '0') || 'b files/z'
WHEN 3 THEN substr(md5(o_custkey::VARCHAR), 1, 6) || '_' || substr(md5(o_custkey::VARCHAR), 7, 6) || '/w' ELSE 'misc/q' END || '/f.pdf'"""


def _cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    six = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("string").alias("project_code"), F.col("c_custkey").alias("ordinal"), F.concat(F.lit("/archive/roots/"), F.col("c_custkey").cast("string"), F.lit("/")).alias("root_path"), F.concat(F.lit("Customer "), six, F.lit("b")).alias("alias"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 12).alias("name"))
    return c.drop("alias"), c.select("project_code", "alias", "ordinal")


@query(f"""WITH p AS (SELECT o_orderkey, {_JOB} AS path FROM orders), c AS (SELECT (c_custkey + 1000)::VARCHAR AS code, c_custkey AS ordinal, '/archive/roots/' || c_custkey || '/' AS root, lower('Customer ' || lpad(c_custkey::VARCHAR, 6, '0') || 'b') AS alias FROM customer),
r AS (SELECT o_orderkey, arg_min(code, ordinal) AS code FROM p JOIN c ON starts_with(path, root) GROUP BY 1), ps AS (SELECT o_orderkey, unnest(string_split(path, '/')) AS part, generate_subscripts(string_split(path, '/'), 1) AS pos FROM p),
n AS (SELECT o_orderkey, arg_min(regexp_extract(part, '\\b([0-9]{{3,4}})\\b', 1), pos) AS code FROM ps WHERE regexp_extract(part, '\\b([0-9]{{3,4}})\\b', 1) IN (SELECT code FROM c) GROUP BY 1),
a AS (SELECT o_orderkey, arg_min(code, ordinal) AS code FROM p JOIN c ON contains(lower(path), alias) GROUP BY 1)
SELECT p.o_orderkey, coalesce(r.code, n.code, a.code) AS project_code, CASE WHEN r.code IS NOT NULL THEN 1.0 WHEN n.code IS NOT NULL THEN 0.95 WHEN a.code IS NOT NULL THEN 0.85 END::DOUBLE AS confidence,
CASE WHEN r.code IS NOT NULL THEN 'root_path' WHEN n.code IS NOT NULL THEN 'project_number' WHEN a.code IS NOT NULL THEN 'alias_match' END AS method FROM p LEFT JOIN r USING (o_orderkey) LEFT JOIN n USING (o_orderkey) LEFT JOIN a USING (o_orderkey)""")
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By root, number and alias alone."""
    cards, aliases = _cards(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_JOB.replace("::VARCHAR", "::STRING")).alias("path"))
    return resolution.resolved(rows, "o_orderkey", "path", cards, aliases, names=False)


@query()
def resolve_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, aliases = _cards(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_JOB.replace("::VARCHAR", "::STRING")).alias("path"))
    return resolution.resolved(rows, "o_orderkey", "path", cards, aliases)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey + 1000)::VARCHAR END AS project_code FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0""")
def resolve_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards, _ = _cards(spark, sf_dir)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_JOB.replace("::VARCHAR", "::STRING")).alias("path"))
    return resolution.by_prefix(rows, "o_orderkey", "path", cards, "root_path", "ordinal", "project_code")


@query()
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("other")).unionByName(table(spark, sf_dir, "part").select(F.concat(F.lower("p_name"), F.lit("s")).alias("other")))
    return resolution.similar(a, "name", b, "other")


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace('01_' || replace(p_name, ' ', '-'), '^\w{0,6}[-_.\s]+', ''), '[-_]+', ' ', 'g'), ' ') AS title, array_to_string(list_concat(['job', 'x'], string_split(p_name, ' ')), ' ') AS tokens FROM part""")
def path_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("01_"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".pdf"))
    tokens = resolution.path_tokens(F.concat(F.lit("/X/Job/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".PDF")))
    return table(spark, sf_dir, "part").select("p_partkey", resolution.title(name).alias("title"), F.array_join(tokens, " ").alias("tokens"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, upper(array_to_string(list_transform(ws, lambda x: x[1:1]), '')) || ',' || array_to_string(ws, ',') || ',' || array_to_string(list_transform(ws, lambda x: upper(x[1:1]) || x[2:]), '') || ',' || (100 + p_partkey % 900) AS aliases FROM w""")
def card_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("J"), (100 + F.col("p_partkey") % 900).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(resolution.project_aliases(code, F.col("p_name")), ",").alias("aliases"))


# --- search ----------------------------------------------------------------------------------------------------------


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tx.boosted_terms("the threading lyers of this project", ["thanking", "ended nations"])
    found = index_of(spark, sf_dir, stemmed=True).bm25("doc_id", terms)
    return found.orderBy(F.desc("bm25"), "doc_id").limit(30)


_PHRASE = ("the_and", "of_the")


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BREAK}'), lambda x: x <> '') AS ts FROM documents),
f AS (SELECT doc_id, len(ts) AS dl, {", ".join(f"len(list_filter(range(1, len(ts)), lambda i: ts[i] = '{p.split('_')[0]}' AND ts[i + 1] = '{p.split('_')[1]}')) AS f{k}" for k, p in enumerate(_PHRASE))} FROM t),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS n{k}" for k in range(len(_PHRASE)))} FROM f)
SELECT doc_id, round(round({" + ".join(f"greatest(ln((n - n{k} + 0.5) / (n{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in range(len(_PHRASE)))}, 9), 6) AS bm25
FROM f, st WHERE {" OR ".join(f"f{k} > 0" for k in range(len(_PHRASE)))}""")
def bm25_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(spark, sf_dir).bm25("doc_id", list(_PHRASE)).withColumn("bm25", F.round("bm25", 6))


# --- audits and checks -----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT source AS ext, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1), r AS (SELECT CASE WHEN row_number() OVER (ORDER BY bytes DESC, ext) <= 5 THEN ext ELSE 'other' END AS ext, files, bytes FROM p)
SELECT ext, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, round(sum(bytes) / (SELECT sum(bytes) FROM p), 6) AS share FROM r GROUP BY 1""")
def extension_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.extension_stats(table(spark, sf_dir, "documents"), "source", F.col("n_chars"), 5)


@query("""SELECT 'empty text' AS check, count(*) FILTER (WHERE coalesce(text, '') = '') AS failing, count(*) FILTER (WHERE coalesce(text, '') = '') = 0 AS passed FROM documents
UNION ALL SELECT 'labels without document', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unknown language', count(*) FILTER (WHERE lang IS NULL), count(*) FILTER (WHERE lang IS NULL) = 0 FROM documents""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lost = labels.join(docs.select("doc_id"), "doc_id", "left_anti")
    return analytics.checks({"empty text": (docs, F.coalesce("text", F.lit("")) == ""), "labels without document": (lost, F.lit(True)), "unknown language": (docs, F.col("lang").isNull())})


@query("""WITH r AS (SELECT DISTINCT o_orderpriority AS root, o_orderstatus || '-' || (o_custkey % 3) AS folder, lower(o_orderstatus) AS t FROM orders), p AS (SELECT root, t, count(*) AS n FROM r GROUP BY 1, 2)
SELECT r.root, r.folder, CASE WHEN p.n / (SELECT sum(n) FROM p q WHERE q.root = r.root) > 0.5 THEN 0.15::DOUBLE ELSE 0::DOUBLE END AS score FROM r JOIN p ON p.root = r.root AND p.t = r.t""")
def sibling_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("root"), F.concat("o_orderstatus", F.lit("-"), (F.col("o_custkey") % 3).cast("string")).alias("folder"))
    return analytics.siblings(rows, "root", "folder")


@query("""WITH s AS (SELECT unnest(list_filter(regexp_split_to_array(url, '[/:?#&=]+'), lambda x: x <> '')) AS segment FROM pages), c AS (SELECT segment, count(*) AS n, segment IN ('http', 'https', 'en', 'de') AS matched FROM s GROUP BY 1)
SELECT segment, n, matched FROM c QUALIFY row_number() OVER (PARTITION BY matched ORDER BY n DESC, segment) <= 20""")
def segment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = paths.taxonomy(spark, {"scheme": ("http", "https"), "lang": ("en", "de")}).withColumnRenamed("synonym", "segment")
    return analytics.segment_audit(table(spark, sf_dir, "pages"), F.array_remove(F.split("url", "[/:?#&=]+"), ""), known, "segment", 20)


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'name' END, CASE WHEN c_custkey % 3 = 0 THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0""")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cards = table(spark, sf_dir, "customer").select(k, F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("segment"), F.when(k % 3 == 0, 0.4).otherwise(0.9).alias("sure"))
    return analytics.missing_fields(cards, "c_custkey", ["name", "segment"], {"segment": "sure"}).withColumn("missing", F.array_join("missing", ","))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 0.3 WHEN 1 THEN 1.0 WHEN 2 THEN 0.85 WHEN 3 THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence, CASE WHEN c_custkey % 5 IN (1, 2) THEN 'High' WHEN c_custkey % 5 IN (3, 4) THEN 'Medium' ELSE 'Low' END AS label,
'Name: ' || c_name || chr(10) || 'Segment: ' || c_mktsegment AS answer FROM customer""")
def card_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ("", "manual", "manual,web", "web,inferred", "inferred")
    source = F.element_at(F.array(*map(F.lit, made)), (F.col("c_custkey") % 5 + 1).cast("int"))
    level = analytics.card_confidence(F.array_remove(F.split(source, ","), ""))
    text = tx.card_text({"Name": F.col("c_name"), "Client": F.lit(None), "Segment": F.col("c_mktsegment")})
    return table(spark, sf_dir, "customer").select("c_custkey", level.alias("confidence"), tx.confidence_label(level).alias("label"), text.alias("answer"))


@query("SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 21 THEN 'day' ELSE 'night' END AS mode FROM events")
def day_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", tx.day_mode(F.col("ts")).alias("mode"))


@query(r"""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, string_agg('[' || rank || '] ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY 1""")
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc(F.length("text")), "turn"))
    return search.evidence(table(spark, sf_dir, "conversations").withColumn("rank", rank), "conv_id", "rank", "turn", "text")
