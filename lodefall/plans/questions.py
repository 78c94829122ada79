"""Queries of routing and of project inference, over questions and paths of many parts, with the rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import dictionary, paths, routing
from lodefall.plans import pathsql
from lodefall.plans.registry import query
from lodefall.session import table


@query(f"""WITH p AS (SELECT o_orderkey, lower({pathsql.sql_path("o_orderkey")}) AS path FROM orders), t AS (SELECT *, least((CASE WHEN regexp_matches(path, '/[a-z]-') THEN 0.4 ELSE 0 END) + (CASE WHEN regexp_matches(path, '[0-9][0-9]') THEN 0.3 ELSE 0 END)
+ (CASE WHEN contains(path, 'tender') THEN 0.25 ELSE 0 END) + (CASE WHEN contains(path, 'plan') THEN 0.3 ELSE 0 END) + (CASE WHEN starts_with(path, 'mom') THEN 0.15 ELSE 0 END), 1.0) AS total FROM p)
SELECT o_orderkey, CASE WHEN contains(path, '/superseded/') THEN 1 WHEN total >= 0.5 THEN round(total, 4) ELSE 0 END::DOUBLE AS confidence FROM t""")
def project_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", pathsql.path_of("o_orderkey").alias("path"))
    sibling, override = F.when(F.lower("path").startswith("mom"), 0.15), F.when(F.contains("path", F.lit("/Superseded/")), "P1")
    found = paths.infer(F.col("path"), [("(?i)/[a-z]-", 0.4), ("[0-9][0-9]", 0.3)], [("tender", 0.25), ("plan", 0.3)], sibling=sibling, override=override)
    return rows.select("o_orderkey", found.alias("confidence"))


#: Parts of questions; every question is one of each.
BEGINS = ("", "How many units", "latest version of", "Explain the facade strategy", "compare", "where is", "GFA over 5,000 sqm", "why was", "who is the client", "show me")
MIDDLES = ("", "cad drawings", "the transmittals", "BIM", "hotel in Bali", "waiver", "owner", "floor plan", "site area", "186")
ENDS = ("", "of 261", "in 2021", "across all projects", "from May", "A-7?", "for construction", "minutes", "superseded")


def _words(ws) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + "]"


def _route_sql() -> str:
    """The rules of routing over questions in lower case."""
    r = routing
    hits = lambda ws: f"list_filter({_words(ws)}, lambda w: contains(q, w))"
    tags = ", ".join(f"CASE WHEN len(list_filter({_words(ts)}, lambda w: contains(plain, w))) > 0 THEN '{c}' END" for c, ts in r.SYNONYMS.items())
    among = lambda cs: f"len(list_filter(tags, lambda c: list_contains({_words(cs)}, c)))"
    at = lambda xs, k: f"{_words(xs)}[{k} % {len(xs)} + 1]"
    return f"""WITH a AS (SELECT c_custkey, lower(trim({at(BEGINS, "c_custkey")} || ' ' || {at(MIDDLES, "(c_custkey // 2)")} || ' ' || {at(ENDS, "(c_custkey // 3)")})) AS q FROM customer),
b AS (SELECT *, regexp_replace(trim(regexp_replace(q, '[^\\w\\s]', ' ', 'g')), '\\s+', ' ', 'g') AS plain, nullif(regexp_extract(q, '\\b([1-9][0-9][0-9][0-9]?)\\b', 1), '') AS code FROM a),
t AS (SELECT *, list_filter([{tags}], lambda x: x IS NOT NULL) AS tags FROM b),
s AS (SELECT *, 0.5 * {among(r.STRUCTURED_CONCEPTS)} + coalesce(list_sum(list_transform({hits(r.STRUCTURED_WORDS)}, lambda w: CASE WHEN length(w) > 8 THEN 0.5 ELSE 0.35 END)), 0) AS s,
0.55 * {among(r.FILE_CONCEPTS)} + 0.25 * (len({hits(r.FILE_TRIGGERS)}) + len({hits(r.QUALIFIERS)}) + CASE WHEN {among(r.FILE_CONCEPTS)} > 0 THEN 0 ELSE len({hits(r.FILE_TYPES)}) END)
+ CASE WHEN regexp_matches(q, '\\b(in|from|around)\\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|[0-9][0-9][0-9][0-9])') THEN 0.15 ELSE 0 END AS f, 0.2 + 0.4 * {among(r.SEMANTIC_CONCEPTS)} + 0.25 * len({hits(r.SEMANTIC_WORDS)}) AS m,
code IS NULL AND len({hits(r.CROSS_WORDS)}) > 0 AS across FROM t),
o AS (SELECT *, list_sort([{{'s': -round(least(s, 1), 4)::DOUBLE, 'k': 0, 'm': 'structured'}}, {{'s': -round(least(f, 1), 4)::DOUBLE, 'k': 1, 'm': 'file_locator'}}, {{'s': -round(least(m, 1), 4)::DOUBLE, 'k': 2, 'm': 'semantic'}}]) AS o FROM s),
e AS (SELECT *, code IS NOT NULL AND o[1].m = 'semantic' AND -o[1].s <= 0.25 AS weak FROM o),
g AS (SELECT *, CASE WHEN across THEN 'cross_project' WHEN weak THEN 'structured' ELSE o[1].m END AS mode, CASE WHEN across THEN 0.85 WHEN weak THEN 0.35 ELSE -o[1].s END::DOUBLE AS confidence FROM e)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda xs, step: F.get(F.array(*map(F.lit, xs)), F.pmod(F.floor(F.col("c_custkey") / step), F.lit(len(xs))).cast("int"))
    q = F.concat_ws(" ", at(BEGINS, 1), at(MIDDLES, 2), at(ENDS, 3))
    return routing.classified(table(spark, sf_dir, "customer").select("c_custkey", q.alias("q")), "q")


@query(_route_sql() + " SELECT c_custkey, code, mode, confidence, CASE WHEN NOT across AND o[2].s < 0 AND round(-o[2].s, 4) >= round(confidence * 0.7, 6) AND confidence < 0.7 THEN o[2].m END AS secondary FROM g")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("c_custkey", "code", "mode", "confidence", "secondary")


@query(_route_sql() + " SELECT c_custkey, array_to_string(tags, ',') AS tags FROM g")
def question_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("c_custkey", F.array_join("tags", ",").alias("tags"))


def _longest(words: dict[str, str]) -> str:
    return "CASE " + " ".join("WHEN contains(q, '" + w.replace("'", "''") + f"') THEN '{v}'" for w, v in sorted(words.items(), key=lambda x: -len(x[0]))) + " END"


def _first(words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(q, '{w}') THEN '{v}'" for w, v in words.items()) + " END"


@query(
    _route_sql()
    + f""" SELECT c_custkey, CASE WHEN mode = 'semantic' AND code IS NULL THEN {_longest(routing.PLACES)} END AS location,
CASE WHEN mode = 'semantic' THEN {_first(routing.STAGE_WORDS)} END AS stage, CASE WHEN mode = 'structured' THEN try_cast(replace(regexp_extract(q, '(?:more than|above|over)\\s+([0-9,]+)\\s*(?:sqm|m2|m²)', 1), ',', '') AS DOUBLE) END AS gfa_min,
CASE WHEN mode = 'file_locator' THEN nullif(regexp_extract(q, '\\b(20[0-9][0-9])\\b', 1), '') || '-01-01' END AS date_from, CASE WHEN mode = 'file_locator' AND (contains(q, 'latest') OR contains(q, 'current version') OR contains(q, 'most recent') OR contains(q, 'current revision')) THEN '1' END AS is_latest,
CASE WHEN mode <> 'cross_project' THEN code END AS project_code FROM g"""
)
def question_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _questions(spark, sf_dir)
    f = lambda name: F.col("filters")[name]
    stage = F.when(F.col("mode") == "semantic", f("folder_stage"))
    return found.select("c_custkey", f("location").alias("location"), stage.alias("stage"), f("gfa_min").try_cast("double").alias("gfa_min"), f("date_from").alias("date_from"), f("is_latest").alias("is_latest"), f("project_code").alias("project_code"))


#: Concepts of the words that the conversations are made of.
CONCEPTS = {"weather": ("rain", "sun", "cold"), "food": ("the", "bread"), "work": ("an", "office"), "rare": ("zzzz",)}
_CONCEPTS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(plain, '{t}')" for t in ts)} THEN '{c}' END" for c, ts in CONCEPTS.items())
_EXPANDED = ", ".join(f"CASE WHEN list_contains(tags, '{c}') THEN {_words(ts)} ELSE [] END" for c, ts in CONCEPTS.items())


@query(f"""WITH a AS (SELECT conv_id, turn, trim(lower(coalesce(text, '') || ' ' || conv_id)) AS q FROM conversations),
b AS (SELECT *, regexp_replace(trim(regexp_replace(q, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')), '\\s+', ' ', 'g') AS plain, regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM a),
t AS (SELECT *, list_filter([{_CONCEPTS}], lambda x: x IS NOT NULL) AS tags FROM b),
k AS (SELECT conv_id, turn, q, max_by(w, length(w) * 1000000000 - w::BIGINT) AS known FROM (SELECT conv_id, turn, q, unnest(ws) AS w FROM t) JOIN (SELECT DISTINCT c_custkey::VARCHAR AS c FROM customer) ON c = w GROUP BY ALL)
SELECT conv_id, turn, array_to_string(tags, ',') AS tags, array_to_string(flatten([{_EXPANDED}]), ',') AS terms,
coalesce(known, nullif(regexp_extract(q, '\\b([1-9][0-9][0-9][0-9]?)\\b', 1), '')) AS code FROM t LEFT JOIN k USING (conv_id, turn, q)""")
def route_known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said in conversations, with a table of synonyms and one of codes that grows with the customers."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.coalesce("text", F.lit("")), F.col("conv_id").cast("string")).alias("q"))
    synonyms = spark.createDataFrame(dictionary.table_of(CONCEPTS), dictionary.SYNONYM_ROW)
    codes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code"))
    found = routing.classified(said, "q", synonyms, codes)
    return found.select("conv_id", "turn", F.array_join("tags", ",").alias("tags"), F.array_join("expanded_terms", ",").alias("terms"), "code")
