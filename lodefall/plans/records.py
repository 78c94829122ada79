"""Queries of cards and reports, with the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import cards, classify, elements, intake, maintenance, reports, search
from lodefall.plans.catalog import PROBE
from lodefall.plans.intake import _MARKED, _STATE, _state
from lodefall.plans.registry import query
from lodefall.session import table

# --- cards -----------------------------------------------------------------------------------------------------------

#: What is put at the end of pages, by page_id modulo 5.
_ENDS = (
    "<span>A tower in Vietnam</span><p>GFA 12,345 sqm, done in 2019</p>",
    "<li>Winner of the city award for 1998 &amp; more</li><div>Offices, retail</div>",
    "<p>" + "A long concept of a public library by the water. " * 3 + "</p><span>Thailand</span>",
    "<p>800 m² of a school</p><div>prize</div><div>An international prize for its garden</div>",
    "",
)
_ENDS_SQL = "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ENDS)) + " END"
_HTML = f"replace(coalesce(html, ''), '</article>', {_ENDS_SQL} || '</article>')"


def _plain(x: str) -> str:
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{c}')" if x.startswith("replace") else f"replace(regexp_replace(regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '{entity}', '{c}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(body, '{'|'.join(words)}') THEN '{name}'" for name, words in cards.TYPOLOGIES.items()) + " END"


@query(f"""WITH h AS (SELECT page_id, {_HTML} AS html FROM pages), b AS (SELECT page_id, html, lower({_plain("html")}) AS body,
list_filter(list_transform(regexp_extract_all(html, '(?i)<(?:p|span|div|li)\\b[^>]*>([^<]+)', 1), lambda x: {_plain("x")}), lambda x: x <> '') AS own,
list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda x: {_plain("x")}), lambda x: length(x) > 100) AS ps FROM h)
SELECT page_id, {_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS name,
list_filter(own, lambda x: regexp_matches(x, '(?i)\\b({"|".join(cards.PLACES)})\\b') AND length(x) < 80)[1] AS location, {_KINDS} AS typology_primary,
try_cast(replace(regexp_extract(body, '([0-9,]*[0-9][0-9,]*)\\s*(?:sqm|m²|m2|sq\\.?\\s*m)', 1), ',', '') AS DOUBLE) AS gfa_sqm, left(ps[1], 2000) AS concept_summary,
nullif(regexp_extract(body, '\\b(20[0-9][0-9]|19[0-9][0-9])\\b', 1), '') AS year,
array_to_string(list_filter(own, lambda x: regexp_matches(x, '(?i)award|prize|winner|recognition') AND length(x) > 20 AND length(x) < 200)[1:10], '; ') AS awards FROM b""")
def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 5).cast("int"))
    html = F.replace(F.coalesce("html", F.lit("")), F.lit("</article>"), F.concat(end, F.lit("</article>")))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return cards.scraped(pages, "page_id", "html").withColumn("awards", F.coalesce(F.array_join("awards", "; "), F.lit("")))


@query(f"""WITH h AS (SELECT page_id, coalesce(html, '') AS old, {_HTML} AS html FROM pages), b AS (SELECT page_id, contains(old, '</article>') AS ended, html, lower({_plain("html")}) AS body FROM h)
SELECT page_id, nullif({_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '') AS name, CASE WHEN ended THEN CASE page_id % 5 WHEN 0 THEN 'A tower in Vietnam' WHEN 2 THEN 'Thailand' END END AS location, {_KINDS} AS typology_primary,
try_cast(replace(regexp_extract(body, '([0-9,]*[0-9][0-9,]*)\\s*(?:sqm|m²|m2|sq\\.?\\s*m)', 1), ',', '') AS DOUBLE) AS gfa_sqm, nullif(regexp_extract(body, '\\b(20[0-9][0-9]|19[0-9][0-9])\\b', 1), '') AS completion,
CASE WHEN ended THEN CASE page_id % 5 WHEN 1 THEN 'Winner of the city award for 1998 & more' WHEN 3 THEN 'An international prize for its garden' END END AS awards FROM b""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of pages by their elements."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 5).cast("int"))
    html = F.replace(F.coalesce("html", F.lit("")), F.lit("</article>"), F.concat(end, F.lit("</article>")))
    found = elements.scraped(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")
    return found.select("page_id", "name", "location", "typology_primary", "gfa_sqm", F.col("milestone_dates")["completion"].alias("completion"), F.array_join("awards", "; ").alias("awards"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="(/[^"]+)"', 1)) AS link, regexp_extract(url, '/([a-z][a-z])/', 1) AS kind FROM pages)
SELECT link, arg_min(kind, page_id) AS kind FROM l GROUP BY 1""")
def listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the kind of the first page that lists them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("kind"))
    return cards.listed_urls(pages, "page_id", "html", "kind", r'(/[^"]+)')


_CARDS = """cards AS (SELECT 'C' || s_suppkey AS project_code, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN n_name END AS location, 'civic' AS typology_primary, CASE WHEN s_suppkey % 2 = 0 THEN 'retail' END AS typology_secondary,
NULL::VARCHAR AS stage, CASE WHEN s_suppkey % 3 = 0 THEN 'Client ' || s_suppkey END AS client, (s_suppkey * 1234.0)::DOUBLE AS gfa_sqm, s_suppkey % 7 AS storeys_above, CASE WHEN s_suppkey % 2 = 1 THEN 2 END AS storeys_below FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, when = F.col("s_suppkey"), lambda n, r, v: F.when(F.col("s_suppkey") % n == r, v)
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    text = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("C"), key.cast("string")).alias("project_code"), F.when(key % 5 != 0, F.col("s_name")).alias("name"), when(4, 0, F.col("n_name")).alias("location"),
        F.lit("civic").alias("typology_primary"), when(2, 0, "retail").alias("typology_secondary"), text.alias("stage"), when(3, 0, F.concat(F.lit("Client "), key.cast("string"))).alias("client"),
        (key * 1234.0).alias("gfa_sqm"), text.cast("double").alias("site_area_sqm"), (key % 7).alias("storeys_above"), when(2, 1, F.lit(2)).alias("storeys_below"),
        text.alias("units"), text.alias("architect"), text.alias("pm_job_captain"), text.alias("concept_summary"),
    )


_ASKED = ("C3", "C4", "C5", "C7", "none")


@query(f"""WITH {_CARDS}, a AS (SELECT unnest({list(_ASKED)}) AS code), l AS (SELECT project_code, concat_ws(chr(10), '**' || project_code || ' — ' || coalesce(name, '(name not set)') || '**', 'Location: ' || location,
'Typology: ' || typology_primary || coalesce(' / ' || typology_secondary, ''), 'Client: ' || client, 'GFA: ' || format('{{:,}}', gfa_sqm::BIGINT) || ' sqm',
CASE WHEN storeys_above > 0 THEN 'Storeys: ' || storeys_above || coalesce(' above / ' || storeys_below || ' below grade', '') END) AS answer FROM cards)
SELECT code, coalesce(answer, 'No project card found for ''' || code || '''.') AS answer, CASE WHEN answer IS NULL THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence FROM a LEFT JOIN l ON code = project_code""")
def card_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, out = _cards(spark, sf_dir), None
    for code in _ASKED:
        row = cards.answered(found, code, F.lit(0.75)).select(F.lit(code).alias("code"), "answer", "confidence")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT p_partkey, '["' || replace(p_name, ' ', '","') || '"]' AS encoded, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE len(string_split(p_name, ' ')) END::INT AS decoded FROM part""")
def card_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists to JSON and back; every third JSON is broken."""
    coded = cards.encoded(table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("awards")))
    broken = coded.withColumn("awards", F.when(F.col("p_partkey") % 3 == 0, F.left("awards", F.length("awards") - 1)).otherwise(F.col("awards")))
    back = cards.decoded(broken).select("p_partkey", F.size("awards").alias("n"))
    count = F.when(F.col("n") >= 0, F.col("n"))
    return coded.withColumnRenamed("awards", "encoded").join(back, "p_partkey").select("p_partkey", "encoded", count.alias("decoded"))


@query(f"""WITH {_CARDS} SELECT project_code, (2 + (name IS NOT NULL)::INT + (location IS NOT NULL)::INT + (typology_secondary IS NOT NULL)::INT + (client IS NOT NULL)::INT + (storeys_below IS NOT NULL)::INT + 1)::INT AS given,
coalesce(name, '-') || '|inferred|0.6' AS named FROM cards""")
def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to insert, by the number of fields with a source and what is said of the name."""
    rows = cards.sourced(_cards(spark, sf_dir), "inferred", 0.6, F.lit("2024-01-01").cast("date"))
    name = F.get(F.filter("data_sources", lambda x: x["field"] == "name"), F.lit(0))
    said = F.concat(F.coalesce(name["value"], F.lit("-")), F.lit("|"), F.coalesce(name["source"], F.lit("inferred")), F.lit("|"), F.coalesce(name["confidence"], F.lit(0.6)).cast("string"))
    return rows.select("project_code", F.size("data_sources").alias("given"), said.alias("named"))


@query("SELECT DISTINCT source AS project_code FROM documents WHERE source IS NOT NULL AND source <> 'src1' UNION SELECT 'C' || s_suppkey FROM supplier")
def known_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    project = F.when(F.col("source") == "src1", "Unknown").otherwise(F.col("source"))
    return cards.codes(_cards(spark, sf_dir), table(spark, sf_dir, "documents").select(project.alias("project_id")))


# --- reports ---------------------------------------------------------------------------------------------------------

_FILES = """files AS (SELECT doc_id AS file_id, '/root' || (doc_id % 3) || '/' || source || '/f' || doc_id AS file_path, n_chars * 1000 AS size,
CASE doc_id % 6 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'EXTRACTED' WHEN 2 THEN 'INDEXED' WHEN 3 THEN 'FAILED' WHEN 4 THEN 'EMBEDDED' ELSE 'INDEXED' END AS status FROM documents)"""
_ROOTS = ("/root0", "/root1/", "/root", "/none")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/root"), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"))
    status = F.get(F.array(*map(F.lit, ("DISCOVERED", "EXTRACTED", "INDEXED", "FAILED", "EMBEDDED", "INDEXED"))), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("file_path"), (F.col("n_chars") * 1000).alias("size"), status.alias("status"))


@query(f"WITH {_FILES} SELECT root, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS \"{s}\"" for s in reports.STATUSES) + f" FROM (SELECT unnest({list(_ROOTS)}) AS root) LEFT JOIN files ON starts_with(file_path, root) GROUP BY root")
def files_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_root(_files(spark, sf_dir), list(_ROOTS))


@query(f"WITH {_FILES} SELECT file_path, round(size / 1048576, 2) AS mb FROM files ORDER BY size DESC, file_path LIMIT 20")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.largest(_files(spark, sf_dir), "file_path", "size")


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id")
def feedback_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said about one result, the latest first; the filter reaches the scan."""
    return table(spark, sf_dir, "events").where("user_id = 7").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "value")


@query(f"""WITH {_FILES}, s AS (SELECT file_path FROM files WHERE file_id % 10 <> 2 UNION ALL SELECT '/new' || file_id FROM files WHERE file_id % 50 = 0),
c AS (SELECT count(*) AS files_indexed, count(*) FILTER (WHERE file_path NOT IN (SELECT file_path FROM s)) AS files_missing FROM files WHERE status = 'INDEXED'),
n AS (SELECT count(*) AS files_new FROM s WHERE file_path NOT IN (SELECT file_path FROM files WHERE status = 'INDEXED')),
l AS (SELECT datediff('day', max(ts)::DATE, max(ts)::DATE + 12) AS days FROM events),
r AS (SELECT *, round(least(0.2 + CASE WHEN files_missing / greatest(files_indexed, 1) > 0.1 THEN 0.2 ELSE 0 END + CASE WHEN files_missing / greatest(files_indexed, 1) > 0.02 THEN 0.1 ELSE 0 END, 1), 3)::DOUBLE AS staleness_score FROM c, n, l)
SELECT files_indexed, files_missing, files_new, days::INT AS days, staleness_score, CASE WHEN staleness_score < 0.2 THEN 'fresh' WHEN staleness_score < 0.5 THEN 'run incremental' ELSE 'run rebuild' END AS recommendation FROM r""")
def index_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    scan = files.where("file_id % 10 <> 2").select("file_path").unionByName(files.where("file_id % 50 = 0").select(F.concat(F.lit("/new"), F.col("file_id").cast("string")).alias("file_path")))
    events = table(spark, sf_dir, "events").select(F.lit("INDEXED").alias("event_type"), "ts")
    last = events.agg(F.max("ts")).first()[0]
    return reports.stale(files, scan, events, F.date_add(F.lit(last.date()), 12))


@query("""WITH a AS (SELECT conv_id, turn % 3 AS category, ['/a/b/' || role || '/f' || turn || '.pdf', 'C:\\x\\' || conv_id] AS returned, CASE WHEN turn % 2 = 0 THEN [role || '/f2.pdf', 'x/1'] ELSE [] END AS expected FROM conversations),
h AS (SELECT category, len(list_filter(expected, lambda e: len(list_filter(returned, lambda r: contains(replace(r, '\\', '/'), e))) > 0)) > 0 AS hit FROM a)
SELECT category, count(*) AS queries, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*), 4) AS recall FROM h GROUP BY ROLLUP (category)""")
def path_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, turn = F.col("role"), F.col("turn").cast("string")
    returned = F.array(F.concat(F.lit("/a/b/"), role, F.lit("/f"), turn, F.lit(".pdf")), F.concat(F.lit("C:\\x\\"), F.col("conv_id").cast("string")))
    expected = F.when(F.col("turn") % 2 == 0, F.array(F.concat(role, F.lit("/f2.pdf")), F.lit("x\\1"))).otherwise(F.array().cast("array<string>"))
    answers = table(spark, sf_dir, "conversations").select((F.col("turn") % 3).alias("category"), returned.alias("returned"), expected.alias("expected"))
    return reports.recall(answers, "returned", "expected", "category")


@query("""WITH g AS (SELECT source AS ext, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents WHERE source IS NOT NULL GROUP BY 1), r AS (SELECT *, least(row_number() OVER (ORDER BY bytes DESC, ext), 4) AS rank FROM g),
m AS (SELECT rank, min(ext) AS ext, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sum(bytes) / (SELECT sum(bytes) FROM g) AS share FROM r GROUP BY 1)
SELECT rank::INT AS rank, CASE WHEN rank > 3 THEN '… other' ELSE 'other ' || ext END || ' | ' || format('{:,}', files) || ' files | ' || format('{:,.1f}', bytes / 1048576) || ' MB | ' || format('{:,.1f}', share * 100) || ' % | '
|| repeat('█', round(share * 30)::INT) || repeat('░', 30 - round(share * 30)::INT) AS line FROM m""")
def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("ext")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"))
    return reports.scan_text(stats, 3)


_NAMES = ("drawing.DWG", "plan.pdf", "a.docx", "b.csv", "c.ppt", "d.ifc", "e.JPEG", "f.mov", "g.rst", "h.7z", "i.eml", "j.xyz")


@query(f"""WITH f AS (SELECT o_orderkey, {list(_NAMES)}[o_orderkey % 12 + 1] AS name FROM orders), e AS (SELECT *, lower(split_part(name, '.', 2)) AS ext FROM f)
SELECT o_orderkey, CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('doc', 'docx') THEN 'word' WHEN ext IN ('xls', 'xlsx', 'csv') THEN 'excel' WHEN ext IN ('ppt', 'pptx') THEN 'ppt' WHEN ext IN ('dwg', 'dxf', 'dgn') THEN 'cad'
WHEN ext IN ('rvt', 'rfa', 'ifc', 'nwd', 'nwc') THEN 'bim' WHEN ext IN ('jpg', 'jpeg', 'png', 'gif', 'tif', 'tiff', 'bmp') THEN 'image' WHEN ext IN ('mp4', 'mov', 'avi', 'mkv') THEN 'video' WHEN ext IN ('txt', 'md', 'rst') THEN 'text'
WHEN ext IN ('zip', 'rar', '7z') THEN 'archive' WHEN ext IN ('msg', 'eml') THEN 'email' ELSE 'other' END AS kind FROM e""")
def extension_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("o_orderkey") % 12).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", reports.group_of(F.substring_index(name, ".", -1)).alias("kind"))


@query("""SELECT conv_id, turn, 'mode=' || role || ' concepts=[' || CASE WHEN turn % 2 = 0 THEN 'area,stage' ELSE 'none' END || '] (structured=' || format('{:.2f}', turn / 4) || ', semantic=0.20)' AS said FROM conversations""")
def route_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("turn") % 2 == 0, F.array(F.lit("stage"), F.lit("area"))).otherwise(F.array().cast("array<string>"))
    said = reports.explained(F.col("role"), tags, {"structured": F.col("turn") / 4, "semantic": F.lit(0.2)})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"))


@query("""WITH m AS (SELECT n_name AS folder, 'mapped ' || n_nationkey AS category FROM nation WHERE n_nationkey % 2 = 0)
SELECT n_nationkey, coalesce(category, CASE WHEN n_nationkey % 3 = 0 THEN 'renders_3d' END) AS category FROM nation LEFT JOIN m ON m.folder = n_name""")
def convention_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's category in its project's own map, else by the parts of its name."""
    nation = table(spark, sf_dir, "nation")
    own = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("folder"), F.concat(F.lit("mapped "), F.col("n_nationkey").cast("string")).alias("category"))
    name = F.when(F.col("n_nationkey") % 3 == 0, F.lit("04 Renders")).otherwise(F.lit("qqq"))
    asked = nation.select("n_nationkey", F.col("n_name").alias("folder"), name.alias("name"))
    return asked.join(F.broadcast(own), "folder", "left").select("n_nationkey", F.coalesce("category", classify.folder_category(F.col("name"))).alias("category"))  # a row per nation


# --- runs ------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT o_orderkey, '/archive/' || o_custkey || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'Deep/er/' ELSE '' END || 'f.' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.dwg' ELSE '' END AS path FROM orders),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM p)
SELECT o_orderkey, regexp_replace(ps[-1], '^(.+)\\.[^.]*$', '\\1') || ' | ' || regexp_extract(ps[-1], '^.+\\.([^.]*)$', 1) || ' | metadata only | ' || array_to_string(ps[greatest(len(ps) - 3, 1):], ' > ') AS text FROM s""")
def path_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for files whose text isn't read."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("f."), key.cast("string"), F.when(key % 2 == 0, ".dwg").otherwise(""))
    path = F.concat(F.lit("/archive/"), F.col("o_custkey").cast("string"), F.lit("/"), F.when(key % 3 == 0, "Deep/er/").otherwise(""), name)
    return table(spark, sf_dir, "orders").select("o_orderkey", intake.surrogate(path, "metadata only").alias("text"))


@query(f"""WITH {_STATE}, {_MARKED}, w AS (SELECT file_id, count(*) FILTER (WHERE embedded = 0) AS waits FROM marked GROUP BY 1),
c AS (SELECT count(*) FILTER (WHERE works AND trim(text) <> '') AS chunks_embedded, count(*) FILTER (WHERE NOT works) AS chunks_skipped FROM chunks JOIN files USING (file_id) WHERE embedded = 0 AND status = 'EXTRACTED'),
f AS (SELECT count(*) FILTER (WHERE status = 'EXTRACTED' AND waits = 0) AS files_embedded, count(*) FILTER (WHERE status = 'EMBEDDED' OR status = 'EXTRACTED' AND waits = 0) AS files_indexed FROM files JOIN w USING (file_id)) SELECT * FROM c, f""")
def indexing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.indexing(*_state(spark, sf_dir))


@query("""WITH n AS (SELECT 'C' || s_suppkey AS project_id, s_suppkey % 3 = 0 AS comes FROM supplier)
SELECT project_id, CASE WHEN comes AND substr(project_id, 2)::INT % 2 = 0 THEN 'tower' ELSE 'villa' END AS typology_guess, CASE WHEN comes THEN 9 ELSE 1 END::BIGINT AS file_count FROM n""")
def projects_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects after new guesses: a missing guess keeps the old one, the count is replaced."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key, F.concat(F.lit("C"), key.cast("string")).alias("project_id"))
    old = rows.select("project_id", F.lit("villa").alias("typology_guess"), F.lit(1).cast("long").alias("file_count"))
    new = rows.where(key % 3 == 0).select("project_id", F.when(key % 2 == 0, "tower").alias("typology_guess"), F.lit(9).cast("long").alias("file_count"))
    return maintenance.upsert(old, new, "project_id", ["typology_guess"], ["file_count"])


_PROBE = "[" + ", ".join(map(str, PROBE)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(greatest(1 - round(1 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE}), 4), 0), 4) AS score FROM embeddings ORDER BY round(1 - list_cosine_similarity(embedding::DOUBLE[], {_PROBE}), 4), vec_id LIMIT 16")
def documents_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by the cosine of their vectors: twice as many as asked for, with a score that is never negative."""
    found = search.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PROBE, 2 * 8)
    return found.select("vec_id", F.round(F.greatest(1 - F.col("distance"), F.lit(0.0)), 4).alias("score"))


@query(f"WITH {_FILES} SELECT file_id, file_path, status FROM files WHERE status = 'FAILED' OR file_path = '/root1/src1/f1'")
def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by a status and by a path."""
    files = _files(spark, sf_dir)
    return files.where((F.col("status") == "FAILED") | (F.col("file_path") == "/root1/src1/f1")).select("file_id", "file_path", "status")


@query(f"""WITH h AS (SELECT page_id, {_HTML} AS html, regexp_extract(url, '/([a-z][a-z])/', 1) AS typology FROM pages), l AS (SELECT page_id, typology, unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS link FROM h),
f AS (SELECT link, arg_min(typology, page_id) AS typology FROM l GROUP BY 1),
p AS (SELECT '/p ' || page_id || '-' || page_id % 7 AS link, page_id, lower({_plain("html")}) AS body FROM h),
t AS (SELECT 'P' || left(page_id::VARCHAR, 1) || (page_id % 7) AS project_code, coalesce({_KINDS}, 'es') AS typology_primary, page_id FROM p),
b AS (SELECT project_code, typology_primary, 1 AS rank, page_id AS seq FROM t UNION ALL SELECT 'P10', 'manual', 3, 0)
SELECT project_code, arg_max(typology_primary, rank * 1000000000::BIGINT + seq) AS typology_primary FROM b GROUP BY 1""")
def scrape_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over pages that one listing names, with a card that was entered by hand."""
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 5).cast("int"))
    html = F.replace(F.coalesce("html", F.lit("")), F.lit("</article>"), F.concat(end, F.lit("</article>")))
    link = F.concat(F.lit("/p "), F.col("page_id").cast("string"), F.lit("-"), (F.col("page_id") % 7).cast("string"))
    pages = table(spark, sf_dir, "pages").select(link.alias("link"), html.alias("html"))
    listing = pages.select(F.abs(F.xxhash64("link")).alias("page_id"), F.concat(F.lit('<a href="'), F.col("link"), F.lit('">')).alias("html"), F.lit("es").alias("typology"))
    by_hand = spark.createDataFrame([("P10", "manual", 3, 0)], "project_code string, typology_primary string, rank int, seq long")
    seq = F.regexp_extract("link", "([0-9]+)-", 1).cast("long")
    return cards.run(listing, pages, by_hand, ["typology_primary"], 1, seq)
