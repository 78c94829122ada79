"""All facts that a path tells about a file, as column expressions: nothing is joined, shuffled or run in Python.

Defined results: a null path gives null or unknown facts; a path outside its root is read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Terms = dict[str, tuple[str, ...]]

#: Content types by extension.
CONTENT: Terms = {
    "BIM": ("rvt", "ifc", "nwd", "nwc", "rfa"),
    "CAD": ("dwg", "dxf", "dgn"),
    "Photoshop": ("psd", "psb"),
    "Illustrator": ("ai", "eps"),
    "InDesign": ("indd", "indt"),
    "Presentation": ("pptx", "ppt", "key"),
    "Spreadsheet": ("xlsx", "xls", "csv"),
    "PDF": ("pdf",),
    "Image": ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp"),
    "Render Scene": ("lsm", "tma", "skp", "max", "c4d", "blend"),
    "Word": ("docx", "doc"),
    "Video": ("mp4", "mov", "avi"),
    "Text": ("txt", "md"),
    "Email": ("msg", "eml"),
}
#: Extensions that a folder of site photographs turns into photographs or videos, and that may need OCR.
PHOTOS, VIDEOS = ("jpg", "jpeg", "png", "tiff", "tif", "bmp", "webp", "heic"), ("mp4", "mov", "avi", "mkv")
OCR_IMAGES = ("jpg", "jpeg", "png", "tiff", "tif", "bmp")
#: Disciplines by the beginning of a file's name, in order.
PREFIXES = (("ID", "Interior"), ("A", "Architecture"), ("S", "Structural"), ("M", "Mechanical"), ("E", "Electrical"), ("C", "Civil"), ("L", "Landscape"))
#: Document types by pattern, in order, and the content type that some of them set.
DOC_TYPES = (
    (r"\bGA\b|General\s*Arrangement", "General Arrangement", None),
    (r"\bFP\b|Floor\s*Plan", "Floor Plan", None),
    (r"\bSEC\b|Section(?:al)?(?!\s*\d)", "Section", None),
    (r"\bEL\b|Elev(?:ation)?", "Elevation", None),
    (r"\bDET\b|Detail", "Detail", None),
    (r"\bSCH\b|Schedule", "Schedule", None),
    (r"\bSPEC\b|Specification", "Specification", None),
    (r"\bMIN\b|Minutes", "Minutes", "Minutes"),
    (r"\bTRX\b|Transmittal", "Transmittal", "Transmittal"),
    (r"\bRFI\b", "RFI", "RFI"),
    (r"Site[\s_-]*Plan", "Site Plan", None),
    (r"\bROOF\b", "Roof Plan", None),
)
#: Revision numbers in a file's stem, in order.
REVISIONS = (r"(?i)[_\-\s]Rev[_\-]?(\d+)", r"[_\-\s][Rr](\d+)(?=[_\-\s.]|$)", r"[_\-\s][Vv](\d+)(?=[_\-\s.]|$)", r"[_\-\s][Vv]\.?(\d+)(?=[_\-\s.]|$)", r"[_\-](\d+)$")
#: Dates, and how their digits are read.
DATES = (
    (r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", "yyyyMMdd"),
    (r"(?<!\d)(20\d{2})[-_](0[1-9]|1[0-2])[-_](0[1-9]|[12]\d|3[01])(?!\d)", "yyyyMMdd"),
    (r"(?<!\d)(0[1-9]|[12]\d|3[01])[-_](0[1-9]|1[0-2])[-_](20\d{2})(?!\d)", "ddMMyyyy"),
)
FOLDER_DATE = (r"(?<!\d)(20[0-3]\d)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", "yyyyMMdd")
#: Looser dates in the names of milestone folders.
LOOSE_DATES = ((r"(\d{4})[-_](\d{2})[-_](\d{2})", "yyyyMMdd"), (r"(\d{4})(\d{2})(\d{2})", "yyyyMMdd"), (r"(\d{2})[-_](\d{2})[-_](\d{4})", "ddMMyyyy"))
#: What marks a folder as issued, received, superseded, or of site photographs; names that need OCR.
ISSUED = ("issued", "outgoing", "to client", "transmittal", "transmittals", "for approval", "for review", "for construction", "approved", "released", "client issue", "final issue", "sent to", "drawing register")
RECEIVED = ("received", "from client", "incoming", "from consultant")
SUPERSEDED = r"(?i)\b(?:superseded|obsolete|void|replaced|old versions|deprecated|old|archive|archived|backup|prev|previous)\b"
SITE_PHOTOS = r"(?i)construction\s+photos?|site\s+visit|completion\s+site\s+visit|site\s+photography|construction\s+photography"
NEEDS_OCR = r"(?i)\b(program|programme|schedule|milestone|gantt|timeline|area\s+schedule|room\s+schedule)\b"
#: The category of a stage, where no folder names one.
STAGE_CATEGORY = {
    "renders": "renders_3d",
    "construction_photos": "construction_photos",
    "bim": "bim",
    "cad": "cad",
    "IFC": "issued",
    "tender": "issued",
    "submission": "submission",
    "design": "working",
    "presentations": "submission_materials",
    "meetings": "meetings",
    "correspondence": "correspondence",
    "superseded": "working",
    "programme": "programme",
    "qms": "qms",
    "publication": "publication",
    "consultants_folder": "consultants",
    "photos": "construction_photos",
    "reports": "documents",
    "references": "research",
}
#: Small taxonomies of our own, the defaults of parameters.
STAGE_TERMS: Terms = {"superseded": ("superseded",), "tender": ("tender",), "meetings": ("meetings", "mom"), "cad": ("cad",), "bim": ("bim",), "design": ("concept", "schematic design"), "renders": ("renders",)}
DISCIPLINE_TERMS: Terms = {"Architecture": ("architecture",), "Structural": ("structural", "c&s"), "Mechanical": ("mechanical", "m&e")}


def segments(path: Column, root: Column | None = None) -> Column:
    """The parts of a path, below the root if it lies there."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is not None:
        base = F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
        path = F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def bare(folder: Column) -> Column:
    """A folder's name without up to three numbers before it, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(folder), r"^\s*(?:\d{1,4}[\s._-]+){1,3}", ""), r"\s+", " "))


def bounded_word(text: Column, word: str) -> Column:
    """`word` in `text` (both in lower case), not within a run of letters."""
    return text.rlike(r"(?<![a-zA-Z])" + re.escape(word) + r"(?![a-zA-Z])")


def date(text: Column, patterns: tuple = DATES) -> Column:
    """The first pattern's first match that is a date of the calendar; texts without two digits aren't searched."""
    digits = lambda p: F.nullif(F.translate(F.regexp_extract(text, p, 0), "-_", ""), F.lit(""))
    return F.when(text.rlike(r"\d\d"), F.coalesce(*(F.try_to_date(digits(p), form) for p, form in patterns)))


def first_of(found: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    return F.coalesce(*(F.when(condition, value) for condition, value in found)) if found else F.lit(None).cast("string")


def stage(s: Column, terms: Terms) -> Column:
    """The stage of the longest synonym in a folder's name in lower case, then the first declared; those of up to 4
    characters need bounds."""
    every = sorted(((x.lower(), kind) for kind, xs in terms.items() for x in xs), key=lambda x: -len(x[0]))
    return first_of([(bounded_word(s, x) if len(x) <= 4 else F.contains(s, F.lit(x)), F.lit(kind)) for x, kind in every])


def named(s: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder's name in lower case holds one of the names or lies in it; names of up to 3 characters need bounds."""
    out = F.lit(False)
    for n in map(str.lower, names):
        out = out | (bounded_word(s, n) if len(n) <= 3 else F.contains(s, F.lit(n)) | F.contains(F.lit(n), s))
    return out


def deepest(folders: Column, fact) -> Column:  # noqa: ANN001
    """The last fact that isn't null."""
    return F.try_element_at(F.array_compact(F.transform(folders, fact)), F.lit(-1))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]+)$", 1))


def facts(df: DataFrame, path: str, root: str | None = None, stages: Terms = STAGE_TERMS, disciplines: Terms = DISCIPLINE_TERMS, categories: Terms | None = None) -> DataFrame:
    """`df` with the facts of each path: content_type, folder_stage, discipline, doc_type, revision, file_date, folder_date,
    is_issued, is_superseded, is_received, needs_ocr and canonical_category. Deeper folders win for stage, date and category,
    shallower ones for the discipline."""
    parts = segments(F.col(path), F.col(root) if root else None)
    rows = df.withColumn("_ps", parts).withColumns({"_name": F.coalesce(F.try_element_at("_ps", F.lit(-1)), F.lit("")), "_folders": F.slice("_ps", F.lit(1), F.greatest(F.size("_ps") - 1, F.lit(0)))})
    rows = rows.withColumns({"_stem": F.regexp_replace("_name", r"(?<=.)\.[^.]*$", ""), "_ext": extension(F.col("_name"))})
    # folders' names are cleaned once; flags are looked up in all of them at a time, which no pattern can cross
    cleaned = F.transform("_folders", lambda f: F.struct(F.lower(F.trim(f)).alias("raw"), F.lower(bare(f)).alias("bare")))
    rows = rows.withColumn("_seen", cleaned).withColumn("_all", F.array_join(F.concat(F.transform("_seen", lambda x: x["raw"]), F.transform("_seen", lambda x: x["bare"])), "/"))
    rows = rows.withColumn("_doc_type", first_of([(F.col("_name").rlike(f"(?iU){p}"), F.lit(kind)) for p, kind, _ in DOC_TYPES]))
    name, folders, seen, every, stem, ext = (F.col(c) for c in ("_name", "_folders", "_seen", "_all", "_stem", "_ext"))
    flag = lambda pattern: F.coalesce(every.rlike(pattern), F.lit(False))
    words = lambda ws: "|".join(rf"(?<![a-z]){re.escape(w)}(?![a-z])" for w in ws)
    override = first_of([(F.col("_doc_type") == kind, F.lit(o)) for _, kind, o in DOC_TYPES if o])
    site = flag(SITE_PHOTOS)
    content = first_of([(ext.isin(*xs), F.lit(kind)) for kind, xs in CONTENT.items()])
    content = first_of([(ext.isin(*PHOTOS) & site, F.lit("Construction Photo")), (ext.isin(*VIDEOS) & site, F.lit("Construction Video")), (F.lit(True), content)])
    by_prefix = first_of([(name.rlike(f"(?i)^{p}[-_]"), F.lit(d)) for p, d in PREFIXES])
    of = lambda terms: lambda x: first_of([(named(x["raw"], ns) | named(x["bare"], ns), F.lit(kind)) for kind, ns in terms])
    by_folder = F.try_element_at(F.array_compact(F.transform(seen, of(list(disciplines.items())))), F.lit(1)) if disciplines else F.lit(None)
    staged = deepest(seen, lambda x: F.coalesce(stage(x["raw"], stages), stage(x["bare"], stages)))
    direct = deepest(seen, of(list(reversed(categories.items())))) if categories else F.lit(None)
    folder_date = F.when(every.rlike(r"20[0-3]\d"), deepest(folders, lambda f: date(f, (FOLDER_DATE,))))
    revision = first_of([(stem.rlike(p), F.regexp_extract(stem, p, 1)) for p in REVISIONS]).try_cast("int")
    rows = rows.withColumns({"folder_stage": F.coalesce(staged, F.lit("unknown")), "folder_date": folder_date})
    out = rows.withColumns(
        {
            "content_type": F.coalesce(override, content, F.lit("unknown")),
            "discipline": F.coalesce(by_prefix, by_folder, F.lit("unknown")),
            "doc_type": F.coalesce("_doc_type", F.lit("unknown")),
            "revision": revision,
            "file_date": F.coalesce(date(stem), date(F.try_element_at(folders, F.lit(-1))), F.col("folder_date")),
            "is_issued": flag(words(ISSUED)).cast("int"),
            "is_superseded": (flag(SUPERSEDED) | (F.col("folder_stage") == "superseded")).cast("int"),
            "is_received": flag(words(RECEIVED)).cast("int"),
            "needs_ocr": ext.isin(*OCR_IMAGES) & stem.rlike(NEEDS_OCR),
            "canonical_category": F.coalesce(direct, first_of([(F.col("folder_stage") == s, F.lit(c)) for s, c in STAGE_CATEGORY.items()])),
        }
    )
    return out.drop("_ps", "_name", "_folders", "_stem", "_ext", "_seen", "_all", "_doc_type")


def typology(path: Column, keywords: Terms) -> Column:
    """The typology with most keywords in the path, the first declared on ties; Unknown without any."""
    p = F.lower(F.array_join(segments(path), " "))
    score = lambda words: sum((F.contains(p, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    ranked = [F.struct(score(words).alias("n"), F.lit(-k).alias("k"), F.lit(kind).alias("kind")) for k, (kind, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*ranked))
    return F.when(best["n"] > 0, best["kind"]).otherwise("Unknown")


def milestones(folders: DataFrame, key: str, folder: str) -> DataFrame:
    """key, and the dates that folders named for construction or tender carry: IFC and tender (the last by name)."""
    n = F.lower(folder)
    hits = {"IFC": n.rlike("ifc|for construction"), "tender": F.contains(n, F.lit("tender"))}
    dated = folders.withColumn("_d", date(F.col(folder), LOOSE_DATES)).where("_d IS NOT NULL")
    return dated.groupBy(key).agg(*(F.max_by("_d", F.when(hit, F.col(folder))).alias(m) for m, hit in hits.items())).where("IFC IS NOT NULL OR tender IS NOT NULL")
