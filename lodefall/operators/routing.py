"""Routing of questions: concept expansion, mode scores, filters, project codes; over a DataFrame of questions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodefall.operators import dictionary

#: Concepts by the mode that they speak for; their synonyms are a parameter.
STRUCTURED_CONCEPTS = ("project_overview", "typology", "client", "project_stage", "gfa", "storeys", "units", "plot_ratio", "project_architect", "pm", "consultants", "contractor")
SEMANTIC_CONCEPTS = ("design_concept", "facade", "sustainability", "materials", "waivers", "action_items", "authority_comments")
#: Concepts of files in order, each with content type, folder stage, issued flag and category.
FILE_CONCEPTS = {
    "bim_model": ("BIM", None, None, "bim"),
    "cad_drawings": ("CAD", None, None, "cad"),
    "renders": ("Image", None, None, "renders_3d"),
    "presentations": ("Presentation", None, None, "submission_materials"),
    "meeting_minutes": ("Minutes", None, None, "meetings"),
    "specifications": ("PDF", None, None, "documents"),
    "emails": ("Email", None, None, "correspondence"),
    "ifc_set": (None, "IFC", None, "cad"),
    "transmittals": (None, None, "1", "issued"),
}
#: Words of questions by the mode that they speak for.
STRUCTURED_WORDS = (
    "floor area", "site area", "plot ratio", "storeys", "floors", "number of units", "how many units", "how many keys", "how many beds", "who is the client",
    "who is the architect", "who is the pm", "project manager", "job captain", "what typology", "building type", "what stage", "project status", "contract value",
    "where is the project", "where is project", "project name", "project code", "what is the project", "other names", "goes by", "also known as", "project alias",
    "client name", "developer", "building height", "height of", "area of", "size of", "gross floor",
)
FILE_TRIGGERS = (
    "where is", "where are", "where can i find", "find", "locate", "show me", "list all", "get all", "pull up", "get me", "latest", "most recent",
    "current version", "current revision", "latest version",
)
FILE_TYPES = (
    "bim", "revit", ".rvt", "cad", ".dwg", "autocad", "photoshop", ".psd", "illustrator", ".ai", "indesign", ".indd", "powerpoint", ".pptx", "presentation", "deck",
    "spreadsheet", ".xlsx", "excel", ".xls", "render", "viz", "visualisation", "visualization", "image", "jpg", "png", "minutes", "transmittal", "rfi",
    "specification", "spec", "brief", "report", "drawing", "drawings", "programme", "schedule", "gantt",
)
QUALIFIERS = ("issued to client", "outgoing", "superseded", "archived", "old versions", "for construction", "for approval", "for tender")
SEMANTIC_WORDS = (
    "design concept", "concept", "what is the idea", "design intent", "facade", "facade strategy", "materiality", "sustainability", "climate", "waiver",
    "deviation", "exemption", "approval", "authority", "compliance", "meeting", "minutes content", "decision", "action item", "unresolved",
    "specification details", "technical", "build-up", "glazing", "waterproofing", "what was discussed", "history of", "change", "revision history", "why",
    "how was", "what does", "explain", "describe", "summary of", "apply for", "did we", "what are the", "tell me about the",
)
CROSS_WORDS = (
    "across", "all projects", "compare", "which projects", "show all", "list projects", "how many projects", "other projects", "portfolio", "all our projects",
    "every project", "all our",
)
#: Words that name a place, a typology, a folder stage or a content type.
PLACES = {
    "singapore": "Singapore", "s'pore": "Singapore", "local": "Singapore", "sg": "Singapore", "china": "China", "vietnam": "Vietnam", "viet nam": "Vietnam",
    "malaysia": "Malaysia", "kl": "Malaysia", "indonesia": "Indonesia", "bali": "Indonesia", "jakarta": "Indonesia", "thailand": "Thailand", "bangkok": "Thailand",
    "phuket": "Thailand", "india": "India", "australia": "Australia", "sydney": "Australia", "taiwan": "Taiwan", "bangladesh": "Bangladesh", "portugal": "Portugal",
    "uae": "United Arab Emirates", "dubai": "United Arab Emirates", "abu dhabi": "United Arab Emirates", "pakistan": "Pakistan", "overseas": "__overseas__",
    "international": "__overseas__", "regional": "__overseas__", "outside singapore": "__overseas__",
}
TYPOLOGIES = {
    "hotel": "hospitality", "hospitality": "hospitality", "resort": "hospitality", "serviced apart": "hospitality", "residential": "residential",
    "housing": "residential", "condominium": "residential", "condo": "residential", "hdb": "residential", "apartment": "residential", "high-rise": "residential",
    "high rise": "residential", "commercial": "commercial", "office": "commercial", "retail": "commercial", "shophouse": "commercial", "civic": "civic",
    "institutional": "civic", "museum": "civic", "community": "civic", "school": "education", "education": "education", "university": "education",
    "campus": "education", "healthcare": "healthcare", "hospital": "healthcare", "clinic": "healthcare", "mixed-use": "mixed-use", "mixed use": "mixed-use",
    "mixed": "mixed-use", "masterplan": "masterplan", "master plan": "masterplan",
}
STAGE_WORDS = {
    "ifc": "IFC", "issued for construction": "IFC", "for construction": "IFC", "tender": "tender", "pre-tender": "tender", "submission": "submission",
    "authority submission": "submission", "superseded": "superseded", "archived": "superseded", "old versions": "superseded", "design": "design",
    "schematic": "design", "concept design": "design", "renders": "renders", "render": "renders", "visualisation": "renders", "visualization": "renders",
    "presentation": "presentations",
}
#: Words that name a content type.
TYPE_WORDS = {
    "bim": "BIM", "revit": "BIM", ".rvt": "BIM", "cad": "CAD", ".dwg": "CAD", "autocad": "CAD", "photoshop": "Photoshop", ".psd": "Photoshop",
    "illustrator": "Illustrator", ".ai": "Illustrator", "indesign": "InDesign", ".indd": "InDesign", "powerpoint": "Presentation", ".pptx": "Presentation",
    "presentation": "Presentation", "deck": "Presentation", "spreadsheet": "Spreadsheet", ".xlsx": "Spreadsheet", "excel": "Spreadsheet", ".xls": "Spreadsheet",
    "render": "Render Scene", "viz": "Render Scene", "visualisation": "Render Scene", "visualization": "Render Scene", "image": "Image", "jpg": "Image",
    "png": "Image", "minutes": "Minutes", "transmittal": "Transmittal", "rfi": "RFI", "word": "Word", ".docx": "Word", ".doc": "Word", "pdf": "PDF",
    "video": "Video", "email": "Email", "msg": "Email", "eml": "Email",
}
#: Typologies and stages of structured questions, and the names of months.
STRUCTURED_TYPOLOGIES = ("residential", "hospitality", "hotel", "commercial", "civic", "mixed-use", "education", "healthcare")
STRUCTURED_STAGES = ("design", "tender", "construction", "completed")
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
#: Synonyms by concept where none are given (ours): few, enough to route.
SYNONYMS = {
    "gfa": ("gfa", "floor area"), "client": ("client", "owner"), "facade": ("facade", "cladding", "curtain wall"), "bim_model": ("bim", "revit model"),
    "cad_drawings": ("cad drawings", "floor plan"), "transmittals": ("transmittal",), "emails": ("email",), "waivers": ("waiver",),
}


def _any(q: Column, words) -> Column:
    return reduce(Column.__or__, (F.contains(q, F.lit(w)) for w in words), F.lit(False))


def _sum(q: Column, words, weight) -> Column:
    return reduce(Column.__add__, (F.when(F.contains(q, F.lit(w)), weight(w)).otherwise(0.0) for w in words), F.lit(0.0))


def _first(q: Column, named: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(F.contains(q, F.lit(w)), value) for w, value in named.items()))


def _longest(q: Column, named: dict[str, str]) -> Column:
    return _first(q, dict(sorted(named.items(), key=lambda x: -len(x[0]))))


def _amount(q: Column, words: str) -> Column:
    number = F.regexp_extract(q, rf"(?:{words})\s+([\d,]+)\s*(?:sqm|m2|m²)", 1)
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double").cast("string")


def classified(df: DataFrame, question: str, synonyms: dict[str, tuple[str, ...]] | DataFrame = SYNONYMS, codes: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """Adds tags, expanded_terms, code, mode, confidence, secondary and filters (a map) to the questions; null is like the empty one.
    `synonyms` has each concept's terms, the canonical one first, or is a table of them (concept, concept_order, term, term_order);
    `codes` are the known project codes, a few or a table (code); the longest that is said counts."""
    q, rows = F.col("__lodefall_q"), df.withColumn("__lodefall_q", F.trim(F.lower(F.coalesce(F.col(question), F.lit("")))))
    plain = F.regexp_replace(F.trim(F.regexp_replace(q, r"(?U)[^\w\s]", " ")), r"\s+", " ")
    rows = rows.withColumn("__lodefall_plain", plain)
    said = lambda terms: _any(F.col("__lodefall_plain"), [t for t in (re.sub(r"[^\w\s]", " ", x.lower()).strip() for x in terms) if t])
    if isinstance(synonyms, DataFrame):
        rows = dictionary.tagged(rows, "__lodefall_plain", synonyms)
    else:
        rows = rows.withColumn("tags", F.array_compact(F.array(*(F.when(said(terms), c) for c, terms in synonyms.items()))))
        lists = [F.when(F.array_contains("tags", c), F.array(*(F.lit(t.lower()) for t in terms))) for c, terms in synonyms.items() if terms]
        rows = rows.withColumn("expanded_terms", F.array_distinct(F.flatten(F.array_compact(F.array(*lists)))) if lists else F.array().cast("array<string>"))
    tag = lambda c: F.array_contains("tags", c)
    if isinstance(codes, DataFrame):
        rows, known = dictionary.coded(rows, "__lodefall_q", codes, "code", "__lodefall_known"), [F.col("__lodefall_known")]
    else:
        known = [F.when(q.rlike(rf"\b{re.escape(c)}\b"), c) for c in sorted(codes, key=len, reverse=True)]
    rows = rows.withColumn("code", F.coalesce(*known, F.nullif(F.regexp_extract(q, r"\b([1-9][0-9]{2,3})\b", 1), F.lit(""))))
    many = lambda concepts, w: reduce(Column.__add__, (F.when(tag(c), w).otherwise(0.0) for c in concepts), F.lit(0.0))
    files = reduce(Column.__or__, map(tag, FILE_CONCEPTS))
    dated = q.rlike(r"\b(in|from|around)\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|[0-9]{4})")
    quarter = lambda w: 0.25
    located = many(FILE_CONCEPTS, 0.55) + _sum(q, FILE_TRIGGERS, quarter) + F.when(files, 0.0).otherwise(_sum(q, FILE_TYPES, quarter)) + _sum(q, QUALIFIERS, quarter) + F.when(dated, 0.15).otherwise(0.0)
    scores = {
        "structured": many(STRUCTURED_CONCEPTS, 0.5) + _sum(q, STRUCTURED_WORDS, lambda w: 0.5 if len(w) > 8 else 0.35),
        "file_locator": located,
        "semantic": 0.2 + many(SEMANTIC_CONCEPTS, 0.4) + _sum(q, SEMANTIC_WORDS, quarter),
    }
    order = F.sort_array(F.array(*(F.struct((-F.round(F.least(s, F.lit(1.0)), 4)).alias("s"), F.lit(k).alias("k"), F.lit(m).alias("m")) for k, (m, s) in enumerate(scores.items()))))
    rows = rows.withColumn("__lodefall_o", order)
    first, second = F.col("__lodefall_o")[0], F.col("__lodefall_o")[1]
    cross = F.col("code").isNull() & _any(q, CROSS_WORDS)
    weak = F.col("code").isNotNull() & (first["m"] == "semantic") & (-first["s"] <= 0.25)
    rows = rows.withColumns({"mode": F.when(cross, "cross_project").when(weak, "structured").otherwise(first["m"]), "confidence": F.when(cross, 0.85).when(weak, 0.35).otherwise(-first["s"])})
    also = ~cross & (second["s"] < 0) & (F.round(-second["s"], 4) >= F.round(F.col("confidence") * 0.7, 6)) & (F.col("confidence") < 0.7)
    rows = rows.withColumn("secondary", F.when(also, second["m"]))

    concept = lambda i: F.coalesce(*(F.when(tag(c), F.struct(*(F.lit(x).cast("string").alias(f"v{k}") for k, x in enumerate(v)))) for c, v in FILE_CONCEPTS.items()))[f"v{i}"]
    year, hint = F.nullif(F.regexp_extract(q, r"\b(20[0-9]{2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(q, rf"(?:in|from)\s+(?:{MONTHS})\s*(?:[0-9]{{4}})?", 0), F.lit(""))
    one = lambda yes: F.when(yes, "1")
    free = F.col("code").isNull()
    typology = _first(q, {t: t for t in STRUCTURED_TYPOLOGIES})
    mode = lambda m, c: F.when(F.col("mode") == m, c)
    loc = lambda c: mode("file_locator", c)
    found = {
        "project_code": F.when(F.col("mode") != "cross_project", F.col("code")),
        "content_type": F.coalesce(loc(F.coalesce(concept(0), _first(q, TYPE_WORDS))), mode("semantic", _first(q, TYPE_WORDS))),
        "folder_stage": F.coalesce(loc(F.coalesce(concept(1), _first(q, STAGE_WORDS))), mode("semantic", _first(q, STAGE_WORDS))),
        "canonical_category": loc(concept(3)),
        "is_issued": loc(one(tag("transmittals") | _any(q, ("issued to client", "outgoing", "sent to client")))),
        "is_superseded": loc(one(_any(q, ("superseded", "archived", "old")))),
        "is_latest": loc(one(_any(q, ("latest", "current version", "most recent", "current revision")))),
        "date_hint": loc(hint),
        "date_from": loc(F.concat(year, F.lit("-01-01"))),
        "date_to": loc(F.concat(year, F.lit("-12-31"))),
        "gfa_min": mode("structured", _amount(q, "more than|above|over")),
        "gfa_max": mode("structured", _amount(q, "less than|below|under")),
        "typology": F.coalesce(mode("structured", typology), F.when((F.col("mode") == "cross_project") & (typology != "healthcare"), typology), mode("semantic", F.when(free, _longest(q, TYPOLOGIES)))),
        "stage": mode("structured", F.initcap(_first(q, {s: s for s in STRUCTURED_STAGES}))),
        "location": mode("semantic", F.when(free, _longest(q, PLACES))),
    }
    filters = F.map_filter(F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return rows.select(*df.columns, "tags", "expanded_terms", "code", "mode", "confidence", "secondary", filters.alias("filters"))
