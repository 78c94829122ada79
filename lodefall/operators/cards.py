"""Record cards of projects: fields out of web pages, rows with their sources, JSON fields, look-up, and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.operators import maintenance

#: What a card holds, and which of it is JSON.
FIELDS = (
    "project_code", "name", "alt_names", "typology_primary", "typology_secondary", "location", "client", "stage", "gfa_sqm", "site_area_sqm",
    "plot_ratio_proposed", "plot_ratio_allowable", "storeys_above", "storeys_below", "units", "keys", "beds", "program_components", "contract_value",
    "architect", "pm_job_captain", "consultants", "contractor", "authorities", "milestone_dates", "root_path", "concept_summary", "awards",
)
JSON_FIELDS = {"alt_names": "array<string>", "program_components": "array<string>", "consultants": "array<string>", "authorities": "array<string>", "milestone_dates": "map<string,string>", "awards": "array<string>"}
#: Words that tell a typology in a page's text, in order, and places that are looked for.
TYPOLOGIES = {
    "residential": ("residential", "resi", "apartment", "condo", "housing", "hdb"),
    "hospitality": ("hotel", "hospitality", "resort", "serviced", "keys"),
    "commercial": ("office", "commercial", "retail", "mall", "shophouse"),
    "civic": ("civic", "community", "cultural", "library", "museum"),
    "mixed-use": ("mixed", "mixed-use"),
    "education": ("school", "campus", "university", "polytechnic", "sit"),
    "healthcare": ("hospital", "clinic", "healthcare", "medical"),
}
PLACES = ("Singapore", "China", "Vietnam", "Malaysia", "Indonesia", "Thailand", "India", "Australia")
#: Confidence of what a page says, characters of a concept, awards kept.
WEB, CONCEPT, AWARDS = 0.85, 2000, 10


def plain(html: Column) -> Column:
    """The text of a piece of HTML: tags as blanks, the common entities as characters, white space as one blank."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)>", " "), "<[^>]*>", " ")
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def scraped(pages: DataFrame, url: str, html: str) -> DataFrame:
    """url with name, location, typology_primary, gfa_sqm, concept_summary, year and awards of each page; null where it says
    nothing. A location is a short text of its own element that names a place, an award a sentence-long one on awards."""
    page = F.coalesce(F.col(html), F.lit(""))
    heading = F.coalesce(F.nullif(F.regexp_extract(page, r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")), F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select(F.col(url), plain(heading).alias("_name"), page.alias("_html"), F.lower(plain(page)).alias("_body"))
    own = F.transform(F.regexp_extract_all("_html", F.lit(r"(?i)<(?:p|span|div|li)\b[^>]*>([^<]+)"), F.lit(1)), plain)
    texts = F.filter(own, lambda x: x != "")
    place = F.filter(texts, lambda x: x.rlike(r"(?i)\b(?:" + "|".join(PLACES) + r")\b") & (F.length(x) < 80))
    award = F.filter(texts, lambda x: x.rlike("(?i)award|prize|winner|recognition") & (F.length(x) > 20) & (F.length(x) < 200))
    long = F.filter(F.transform(F.regexp_extract_all("_html", F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), plain), lambda x: F.length(x) > 100)
    kind = F.coalesce(*(F.when(F.col("_body").rlike("|".join(words)), name) for name, words in TYPOLOGIES.items()))
    area = F.regexp_extract("_body", r"([0-9,]*[0-9][0-9,]*)\s*(?:sqm|m²|m2|sq\.?\s*m)", 1)
    return rows.select(
        url,
        F.nullif("_name", F.lit("")).alias("name"),
        F.get(place, F.lit(0)).alias("location"),
        kind.alias("typology_primary"),
        F.replace(area, F.lit(","), F.lit("")).try_cast("double").alias("gfa_sqm"),
        F.left(F.get(long, F.lit(0)), F.lit(CONCEPT)).alias("concept_summary"),
        F.nullif(F.regexp_extract("_body", r"\b(20[0-9]{2}|19[0-9]{2})\b", 1), F.lit("")).alias("year"),
        F.when(F.size(award) > 0, F.slice(award, 1, AWARDS)).alias("awards"),
    )


def code_of(url: Column) -> Column:
    """A code out of the last part of a URL: the initials of its words, at most six."""
    slug = F.element_at(F.filter(F.split(F.regexp_replace(url, "[?#].*$", ""), "/"), lambda x: x != ""), -1)
    initials = F.transform(F.filter(F.split(slug, "[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.substring(x, 1, 1))
    return F.left(F.upper(F.array_join(initials, "")), F.lit(6))


def listed_urls(pages: DataFrame, order: str, html: str, value: str, pattern: str = r"(/project/[^/\"]+/)") -> DataFrame:
    """link and value: every link of the listing pages once, with the value of the first page (by `order`) that has it."""
    links = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(rf'href="(?:https?://[^/\"]+)?{pattern}'), F.lit(1)))
    return pages.select(order, value, F.explode(links).alias("link")).groupBy("link").agg(F.min_by(value, order).alias(value))


def encoded(cards: DataFrame) -> DataFrame:
    """The card table with its lists and maps as JSON."""
    return cards.withColumns({c: F.to_json(c) for c in JSON_FIELDS if c in cards.columns and cards.schema[c].dataType.typeName() in ("array", "map", "struct")})


def decoded(cards: DataFrame) -> DataFrame:
    """The card table with its JSON fields as lists and maps; broken JSON is null."""
    return cards.withColumns({c: F.from_json(c, kind) for c, kind in JSON_FIELDS.items() if c in cards.columns and cards.schema[c].dataType.typeName() == "string"})


def sourced(values: DataFrame, source: str, confidence: float, at: Column) -> DataFrame:
    """Rows to insert: all fields of a card, JSON encoded, with a data_sources entry for each given field and the times."""
    given = [c for c in FIELDS if c in values.columns]
    coded = encoded(values.select(*given))
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))) for c in given if c != "project_code"]
    missing = [F.lit(None).cast("string").alias(c) for c in FIELDS if c not in given]
    return coded.select(*given, *missing, F.array_compact(F.array(*entries)).alias("data_sources"), at.alias("created_at"), at.alias("updated_at"))


def upserted(cards: DataFrame, values: DataFrame, key: str, fields: list[str], rank: str, seq: str) -> DataFrame:
    """The cards after values of some source came in: each field is that of the highest rank, the later one on ties."""
    return maintenance.merged_by_source(cards.select(key, *fields, rank, seq).unionByName(values.select(key, *fields, rank, seq)), key, fields, rank, seq)


def answered(cards: DataFrame, code: str, confidence: Column) -> DataFrame:
    """One row: the card of a code as lines, and its confidence; says so where there is none."""
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0")
    line = lambda label, c, value=None: F.when(~has(c), F.concat(F.lit(label), F.col(c).cast("string") if value is None else value))
    both = lambda c, d, before, after: F.concat(F.col(c).cast("string"), F.when(~has(d), F.concat(F.lit(before), F.col(d).cast("string"), F.lit(after))).otherwise(""))
    area = lambda c: F.concat(F.format_number(F.bround(c), 0), F.lit(" sqm"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("**"), F.col("project_code"), F.lit(" — "), F.coalesce(F.nullif("name", F.lit("")), F.lit("(name not set)")), F.lit("**")),
        line("Location: ", "location"),
        line("Typology: ", "typology_primary", both("typology_primary", "typology_secondary", " / ", "")),
        line("Stage: ", "stage"),
        line("Client: ", "client"),
        line("GFA: ", "gfa_sqm", area("gfa_sqm")),
        line("Site area: ", "site_area_sqm", area("site_area_sqm")),
        line("Storeys: ", "storeys_above", both("storeys_above", "storeys_below", " above / ", " below grade")),
        line("Units: ", "units"),
        line("Lead architect: ", "architect"),
        line("PM / Job captain: ", "pm_job_captain"),
        line("\nConcept: ", "concept_summary", F.left("concept_summary", F.lit(300))),
    )
    found = cards.where(F.col("project_code") == code).limit(1).select(lines.alias("answer"), confidence.alias("confidence"))
    none = F.lit(f"No project card found for '{code}'.")
    return found.agg(F.coalesce(F.max("answer"), none).alias("answer"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"))


def codes(cards: DataFrame, files: DataFrame) -> DataFrame:
    """All known project codes: those of cards, and the files' projects other than Unknown."""
    of_files = files.where("project_id is not null and project_id <> 'Unknown'").select(F.col("project_id").alias("project_code"))
    return cards.where("project_code is not null").select("project_code").unionByName(of_files).distinct()


def run(listings: DataFrame, pages: DataFrame, cards: DataFrame, fields: list[str], rank: int, seq: Column) -> DataFrame:
    """The cards after a run over listing pages (page_id, html, typology) and pages (link, html): each listed page gives a
    card under the code of its link, with the listing's typology where the page tells none, and cards of a higher rank
    keep their values. `cards` has project_code, the fields, rank and seq."""
    found = listed_urls(listings, "page_id", "html", "typology", r'(/[^"]+)')
    told = scraped(pages.join(found.select("link"), "link", "left_semi"), "link", "html").join(found, "link")
    told = told.withColumns({"project_code": code_of(F.col("link")), "typology_primary": F.coalesce("typology_primary", "typology"), "rank": F.lit(rank), "seq": seq})
    return upserted(cards, told, "project_code", fields, "rank", "seq")
