"""Rules that name files by their text, path or folder: document types, images, folder conventions, mail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document types in order; per signal its weight and alternatives, each of (part of the text, pattern) that
#: must all occur. The first type whose weights reach 2 is it. Of the signals of authorities only the first that holds counts.
CONTENT_RULES = (
    ("minutes", (
        ("mom_header", 2, ((("first_50", "minutes of meeting"),), (("first_20", "mom"),))),
        ("attendees_list", 1, ((("preview", r"present\s*:"),), (("preview", "attendees:"),), (("preview", "in attendance"),))),
        ("action_items", 1, ((("preview", r"action\s+by"),), (("preview", "action items"),))),
        ("venue_date", 1, ((("preview", "date of meeting"),), (("preview", "venue:"),))),
    )),
    ("transmittal", (
        ("transmittal_header", 3, ((("first_20", "transmittal"),),)),
        ("transmittal_phrase", 2, ((("preview", "we transmit herewith"),), (("preview", "please find enclosed"),))),
        ("doc_table", 1, ((("preview", "document number"), ("preview", "revision")),)),
        ("transmitted_by", 1, ((("preview", "transmitted by"),), (("preview", "issued by"),))),
    )),
    ("authority_submission", (
        *((f"authority_{x}", 2, ((("preview", f"submission to {x}"),), (("first_50", f"to the {x}"),))) for x in ("ura", "bca", "scdf", "pub", "lta", "hdb")),
        ("building_plan", 1, ((("preview", "building plan"),), (("preview", "development application"),))),
        ("authority_ref", 2, ((("preview", "ura/dc/|bca/|scdf/"),),)),
    )),
    ("waiver_request", (
        ("waiver_request_phrase", 2, ((("preview", r"we (wish to apply|request|seek)\s+(a\s+)?(waiver|deviation|exemption)"),),)),
        ("in_lieu_of", 1, ((("preview", "in lieu of"),), (("preview", "alternative solution"),))),
        ("regulation_ref", 1, ((("preview", r"regulation\s+[0-9]+"),),)),
    )),
    ("design_brief", (
        ("brief_header", 2, ((("first_20", "project brief"),), (("first_20", "design brief"),))),
        ("scope_description", 1, ((("preview", "scope of works"),), (("preview", "project description"),))),
        ("design_requirements", 1, ((("preview", "design requirements"),),)),
    )),
    ("specification", (
        ("spec_header", 2, ((("first_20", "specification"),),)),
        ("clause_numbering", 1, ((("preview", r"\b[0-9]+\.[0-9]+\.[0-9]+\b"),),)),
        ("workmanship", 1, ((("preview", "materials and workmanship"),),)),
        ("contractor_shall", 1, ((("preview", "contractor shall"),),)),
    )),
)

#: Signals of which only the first counts.
AUTHORITY_SIGNALS = tuple(f"authority_{x}" for x in ("ura", "bca", "scdf", "pub", "lta", "hdb"))

#: Parts of folder names by category, the first that occurs wins. `submissions_materials` has its own spelling here,
#: unlike in path facts; results keep it.
FOLDERS = (
    ("design presentation images", "renders_3d"), ("project images", "renders_3d"), ("model photos", "renders_3d"), ("construction photos", "construction_photos"),
    ("site visit", "construction_photos"), ("project documents", "documents"), ("project action list", "programme"), ("drawing register", "issued"),
    ("electronic submission", "submission"), ("contract documentation", "contract"), ("consultant correspondence", "correspondence"), ("brief", "brief"),
    ("client", "client"), ("consultants", "consultants"), ("documents", "documents"), ("meeting", "meetings"), ("meetings", "meetings"), ("submission", "submission"),
    ("authorities", "submission"), ("cad", "cad"), ("autocad", "cad"), ("drawings", "cad"), ("bim", "bim"), ("revit", "bim"), ("3d", "renders_3d"), ("lumion", "renders_3d"),
    ("renders", "renders_3d"), ("images", "renders_3d"), ("publication", "publication"), ("pubpack", "publication"), ("awards", "publication"), ("programme", "programme"),
    ("program", "programme"), ("qms", "qms"), ("quality", "qms"), ("research", "research"), ("reference", "research"), ("sketches", "sketches"), ("sketch", "sketches"),
    ("site data", "site_data"), ("site information", "site_data"), ("landscape", "landscape"), ("indesign", "submission_materials"), ("ppt", "submission_materials"),
    ("presentation", "submissions_materials"), ("working", "working"), ("temp", "working"), ("issued", "issued"), ("transmittal", "issued"), ("eqs", "submission"),
    ("supplier", "suppliers"), ("suppliers", "suppliers"), ("contractor", "contract"), ("contract", "contract"), ("correspondence", "correspondence"),
    ("emails", "correspondence"), ("addressee", "addresses"), ("site staff", "site_data"), ("photos", "construction_photos"), ("report", "documents"),
)

#: Parts of paths that mark renders and scans.
RENDERS = ("/viz/", "/renders/", "/cgi/", "/3d/", "/visualis", "/perspectives/", "/enscape/", "/lumion/", "/twinmotion/")
SCANS = ("/scan/", "/scanned/")
IMAGE_WORDS = {"render": "render visualisation image", "scanned_document": "scanned document", "unknown": "image"}

#: Words of mail tags and the domains of authorities.
MAIL_WORDS = {
    "waiver_correspondence": "waiver|deviation|exemption|relaxation|dispensation",
    "submission_correspondence": "transmittal|submission|submitted",
    "meeting_correspondence": "minutes|mom|minute of meeting",
}
AUTHORITIES = ("ura.gov.sg", "bca.gov.sg", "scdf.gov.sg", "pub.gov.sg", "nea.gov.sg", "lta.gov.sg", "hdb.gov.sg", "sla.gov.sg")


def first_words(text: Column, n: int) -> Column:
    """The first n words; what follows them isn't split."""
    found = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+", n + 1)
    return F.array_remove(F.slice(found, 1, n), "")


def content(df: DataFrame, text: str) -> DataFrame:
    """Adds doc_type, confidence and signals, by the first 500, 50 and 20 words; null text is unknown."""
    heads = df.withColumn("_w", first_words(F.col(text), 500))
    heads = heads.withColumns({"preview": F.lower(F.array_join("_w", " "))} | {f"first_{n}": F.lower(F.array_join(F.slice("_w", 1, n), " ")) for n in (50, 20)})
    hit = {}
    for _, signals in CONTENT_RULES:
        for name, _, alternatives in signals:
            hit[f"_{name}"] = reduce(Column.__or__, (reduce(Column.__and__, (F.col(part).rlike(p) for part, p in needed)) for needed in alternatives))
    marked = heads.withColumns(hit)
    named = [name for _, signals in CONTENT_RULES for name, _, _ in signals if name in AUTHORITY_SIGNALS]
    first = F.coalesce(*(F.when(F.col(f"_{name}"), name) for name in named))
    marked = marked.withColumn("_first", first).withColumns({f"_{name}": F.col("_first").eqNullSafe(name) for name in named}).drop("_first")
    totals = {f"_t{k}": reduce(Column.__add__, (F.when(F.col(f"_{name}"), weight).otherwise(0) for name, weight, _ in signals)) for k, (_, signals) in enumerate(CONTENT_RULES)}
    marked = marked.withColumns(totals)
    kind, level, reached = F.lit("unknown"), F.lit(0.3), F.lit(len(CONTENT_RULES) - 1)
    for k, (name, _) in reversed(list(enumerate(CONTENT_RULES))):
        yes = F.col(f"_t{k}") >= 2
        kind, level, reached = F.when(yes, name).otherwise(kind), F.when(yes, F.least(0.5 + F.col(f"_t{k}") * 0.1, F.lit(1.0))).otherwise(level), F.when(yes, k).otherwise(reached)
    found = F.array_compact(F.array(*(F.when(F.col(f"_{name}") & (reached >= k), name) for k, (_, signals) in enumerate(CONTENT_RULES) for name, _, _ in signals)))
    return marked.select(*df.columns, kind.alias("doc_type"), F.round(level, 4).alias("confidence"), found.alias("signals"))


def image(path: Column, size: Column) -> Column:
    """image_type, needs_ocr and confidence of an image by its path and size."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    any_of = lambda marks: reduce(Column.__or__, (F.contains(p, F.lit(m)) for m in marks))
    made = lambda kind, ocr, level: F.struct(F.lit(kind).alias("image_type"), F.lit(ocr).alias("needs_ocr"), F.lit(level).alias("confidence"))
    scanned = any_of(SCANS) | F.contains(F.element_at(F.split(p, "/"), -1), F.lit("scan"))
    large = (size > 5 * 1024 * 1024) & F.contains(p, F.lit("/images/"))
    return F.when(any_of(RENDERS), made("render", False, 0.9)).when(scanned, made("scanned_document", True, 0.85)).when(large, made("render", False, 0.75)).otherwise(made("unknown", False, 0.5))


def image_description(path: Column, image_type: Column) -> Column:
    """Searchable words for an image out of the last six parts of its path."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.when(F.startswith(path, F.lit("/")), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)
    last = F.slice(parts, F.greatest(F.size(parts) - 5, F.lit(1)), F.lit(6))
    cleaned = F.filter(F.transform(last, lambda x: F.trim(F.regexp_replace(x, "[-_.]", " "))), lambda x: ~x.isin("", "jpg", "jpeg", "png", "gif", "tif", "tiff"))
    words = F.create_map(*(F.lit(x) for pair in IMAGE_WORDS.items() for x in pair))
    return F.trim(F.concat(F.lit("Project image "), F.coalesce(words[image_type], F.lit("image")), F.lit(" — "), F.array_join(cleaned, " ")))


def folder_category(folder: Column) -> Column:
    """The category of the first known part of a folder's name, else null."""
    name = F.lower(folder)
    return F.coalesce(*(F.when(F.contains(name, F.lit(part)), category) for part, category in FOLDERS))


def convention(folders: DataFrame, project: str, folder: str) -> DataFrame:
    """How each project names its folders: type, common prefix, confidence and number. Counted per (project, prefix) first,
    so that a project with very many folders is combined before it is shuffled."""
    name = F.col(folder)
    both, prefixed, numbered = name.rlike(r"^[0-9]{3,4}\s+[0-9]{2}\s"), name.rlike(r"^[0-9]{3,4}\s"), name.rlike(r"^[0-9]{2}\s")
    kind = F.when(both, "both").when(prefixed, "prefixed").when(numbered, "numbered").otherwise("plain")
    prefix = F.nullif(F.regexp_extract(name, r"^([0-9]{3,4})\s", 1), F.lit(""))
    kinds = ("numbered", "both", "prefixed", "plain")
    per = folders.select(project, kind.alias("kind"), prefix.alias("prefix")).groupBy(project, "prefix").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count("*").alias("n"))
    most = F.max(F.when(F.col("prefix").isNotNull(), F.struct("n", "prefix")))
    out = per.groupBy(project).agg(*(F.sum(k).alias(k) for k in kinds), F.sum("n").alias("n"), most.alias("most"))
    share = lambda c: c / F.col("n") >= 0.7
    named = F.when(share(F.col("both")), "prefixed_numbered").when(share(F.col("numbered") + F.col("both")), "numbered").when(share(F.col("prefixed")), "prefixed").when(share(F.col("plain")), "plain")
    common = F.when(F.col("most.n") / F.col("n") > 0.5, F.col("most.prefix")).otherwise("")
    level = F.round(F.greatest(*kinds) / F.col("n"), 2)
    return out.select(project, named.otherwise("mixed").alias("convention"), F.coalesce(common, F.lit("")).alias("prefix"), level.alias("confidence"), F.col("n").alias("folders"))


def mail_tags(subject: Column, body: Column, parties: Column) -> Column:
    """Tags of a message by its subject, the beginning of its body and the domains involved."""
    said = F.concat(F.lower(F.coalesce(subject, F.lit(""))), F.lit(" "), F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 2000)))
    tag = lambda name: F.when(said.rlike(MAIL_WORDS[name]), name)
    authority = F.when(F.coalesce(F.arrays_overlap(parties, F.array(*map(F.lit, AUTHORITIES))), F.lit(False)), "authority_correspondence")
    return F.array_compact(F.array(tag("waiver_correspondence"), authority, tag("submission_correspondence"), tag("meeting_correspondence")))


def mail_direction(sender: Column, recipients: Column, internal: tuple[str, ...]) -> Column:
    """unknown without a sender's domain, internal if all are ours (or there are no recipients), else outbound or inbound."""
    ours = [d.lower() for d in internal]
    all_ours = F.forall(F.filter(recipients, lambda d: d != ""), lambda d: F.lower(d).isin(*ours))
    known = F.lower(sender).isin(*ours)
    return F.when(F.coalesce(sender, F.lit("")) == "", "unknown").when(known & F.coalesce(all_ours, F.lit(True)), "internal").when(known, "outbound").otherwise("inbound")
