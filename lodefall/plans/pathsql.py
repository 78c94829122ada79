"""Paths out of many parts, and the rules of path facts as SQL over the path itself, for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodefall.operators import facts

#: Parts of paths: two folders (an empty one is left out), the name, and the extension.
FOLDERS = ("Tender Issued", "07 Site Visit 20230115", "Old", "Incoming", "270 04 Meetings", "BIM", "Renders", "Concept 20221345", "C&S", "mom notes", "Momentum", "schematic  design")
INNER = ("", "Structural", "Superseded", "Architecture 2021-02-30", "20240229 Approved", "M&E drawings", "misc", "sent to client", "Previous", "struct")
NAMES = ("A-101_Floor Plan_rev3", "IMG_2", "S_Section 4", "x 2024-02-30", "MIN 7 v2", "RFI_12", "ID-programme_31-12-2021", "readme", "Sectional r12.final", "GA schedule V.4", "E_detail_Rev-07_20210131", "site_plan roof", "L-Elev_20230132_01-02-2020")
EXTENSIONS = ("pdf", "jpg", "dwg", "rvt", "docx", "xyz", "PNG", "mov", "", "pptx", "Tiff")


def path_of(key: str) -> Column:
    """The path below the root, by a number; the parts run through with different steps."""
    at = lambda xs, step: F.get(F.array(*map(F.lit, xs)), F.pmod(F.floor(F.col(key) / step), F.lit(len(xs))).cast("int"))
    ext, inner = at(EXTENSIONS, 5), at(INNER, 2)
    return F.concat(at(FOLDERS, 1), F.when(inner != "", F.concat(F.lit("/"), inner)).otherwise(""), F.lit("/"), at(NAMES, 3), F.when(ext != "", F.concat(F.lit("."), ext)).otherwise(""))


def sql_path(key: str) -> str:
    at = lambda xs, step: f"{[x for x in xs]}[({key} // {step}) % {len(xs)} + 1]"
    end = lambda x, mark: f"CASE WHEN {x} <> '' THEN '{mark}' || {x} ELSE '' END"
    return f"{at(FOLDERS, 1)} || {end(at(INNER, 2), '/')} || '/' || {at(NAMES, 3)} || {end(at(EXTENSIONS, 5), '.')}"


def _chain(cases: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {default} END"


def _word(x: str, w: str) -> str:
    return f"regexp_matches({x}, '(?:^|[^a-zA-Z]){w}(?:[^a-zA-Z]|$)')"


def _stage(x: str) -> str:
    terms = sorted(((w, kind) for kind, ws in facts.STAGE_TERMS.items() for w in ws), key=lambda t: -len(t[0]))
    return _chain([(_word(x, w) if len(w) <= 4 else f"contains({x}, '{w}')", f"'{kind}'") for w, kind in terms])


def _discipline(x: str) -> str:
    hit = lambda w: _word(x, w) if len(w) <= 3 else f"(contains({x}, '{w}') OR {x} <> '' AND contains('{w}', {x}))"
    return _chain([(" OR ".join(hit(w) for w in ws), f"'{kind}'") for kind, ws in facts.DISCIPLINE_TERMS.items()])


_MONTH, _DAY = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"


def _date(x: str) -> str:
    ymd = lambda sep: f"try_strptime(replace(replace(regexp_extract({x}, '(?:^|[^0-9])(20[0-9][0-9]{sep}{_MONTH}{sep}{_DAY})(?:[^0-9]|$)', 1), '-', ''), '_', ''), '%Y%m%d')"
    dmy = f"try_strptime(replace(replace(regexp_extract({x}, '(?:^|[^0-9])({_DAY}[-_]{_MONTH}[-_]20[0-9][0-9])(?:[^0-9]|$)', 1), '-', ''), '_', ''), '%d%m%Y')"
    return f"coalesce({ymd('')}, {ymd('[-_]')}, {dmy})::DATE"


def _folder_date(x: str) -> str:
    return f"try_strptime(regexp_extract({x}, '(?:^|[^0-9])(20[0-3][0-9]{_MONTH}{_DAY})(?:[^0-9]|$)', 1), '%Y%m%d')::DATE"


_TYPES = (
    ("\\bGA\\b|General\\s*Arrangement", "General Arrangement"), ("\\bFP\\b|Floor\\s*Plan", "Floor Plan"), ("\\bSEC\\b|Section", "Section"), ("\\bEL\\b|Elev", "Elevation"),
    ("\\bDET\\b|Detail", "Detail"), ("\\bSCH\\b|Schedule", "Schedule"), ("\\bSPEC\\b|Specification", "Specification"), ("\\bMIN\\b|Minutes", "Minutes"), ("\\bTRX\\b|Transmittal", "Transmittal"),
    ("\\bRFI\\b", "RFI"), ("Site[\\s_-]*Plan", "Site Plan"), ("\\bROOF\\b", "Roof Plan"),
)
_REVISIONS = ("(?i)[_\\-\\s]Rev[_\\-]?([0-9]+)", "[_\\-\\s][Rr]([0-9]+)(?:[_\\-\\s.]|$)", "[_\\-\\s][Vv]([0-9]+)(?:[_\\-\\s.]|$)", "[_\\-\\s][Vv]\\.?([0-9]+)(?:[_\\-\\s.]|$)", "[_\\-]([0-9]+)$")


def sql_facts(source: str, key: str, path: str) -> str:
    """A query that gives key and all facts of the paths (two folders at most) of `source`."""
    # a Section with a number after it is none; any other mark of one on the same name is
    name = lambda k: "regexp_replace(name, '(?i)Section\\s*[0-9]', '', 'g')" if k == 2 else "name"
    doc_type = _chain([(f"regexp_matches({name(k)}, '(?i){p}')", f"'{t}'") for k, (p, t) in enumerate(_TYPES)], "'unknown'")
    kinds = [("doc_type IN ('Minutes', 'Transmittal', 'RFI')", "doc_type"), (f"ext IN {facts.PHOTOS} AND site", "'Construction Photo'"), (f"ext IN {facts.VIDEOS} AND site", "'Construction Video'")]
    kinds += [("ext IN (" + ", ".join(f"'{x}'" for x in xs) + ")", f"'{kind}'") for kind, xs in facts.CONTENT.items()]
    by_prefix = _chain([(f"regexp_matches(name, '(?i)^{p}[-_]')", f"'{d}'") for p, d in facts.PREFIXES])
    flag = lambda words: " OR ".join(f"regexp_matches(every, '(?:^|[^a-z]){w}(?:[^a-z]|$)')" for w in words)
    revision = _chain([(f"regexp_matches(stem, '{p}')", f"regexp_extract(stem, '{p}', 1)") for p in _REVISIONS])
    category = _chain([(f"folder_stage = '{s}'", f"'{c}'") for s, c in facts.STAGE_CATEGORY.items()])
    low = lambda f: f"lower(trim({f}))"
    bare = lambda f: f"lower(trim(regexp_replace(regexp_replace(trim({f}), '^\\s*(?:[0-9]{{1,4}}[\\s._-]+){{1,3}}', ''), '\\s+', ' ', 'g')))"
    either = lambda rule, k: f"coalesce({rule(f'r{k}')}, {rule(f'b{k}')})"
    return f"""SELECT {key}, coalesce({_chain(kinds)}, 'unknown') AS content_type, folder_stage, coalesce({by_prefix}, d1, d2, 'unknown') AS discipline, doc_type, try_cast({revision} AS INT) AS revision,
coalesce({_date("stem")}, {_date("coalesce(nullif(f2, ''), f1)")}, folder_date)::VARCHAR AS file_date, folder_date::VARCHAR AS folder_date, ({flag(facts.ISSUED)})::INT AS is_issued,
(regexp_matches(every, '{facts.SUPERSEDED}') OR folder_stage = 'superseded')::INT AS is_superseded, ({flag(facts.RECEIVED)})::INT AS is_received,
ext IN {facts.OCR_IMAGES} AND regexp_matches(stem, '{facts.NEEDS_OCR}') AS needs_ocr, {category} AS canonical_category
FROM (SELECT *, {doc_type} AS doc_type, regexp_matches(every, '{facts.SITE_PHOTOS}') AS site, coalesce({either(_stage, 2)}, {either(_stage, 1)}, 'unknown') AS folder_stage,
{either(_discipline_rule, 1)} AS d1, {either(_discipline_rule, 2)} AS d2, coalesce({_folder_date("f2")}, {_folder_date("f1")}) AS folder_date, lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS ext, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem
FROM (SELECT *, r1 || '/' || r2 || '/' || b1 || '/' || b2 AS every FROM (SELECT *, {low("f1")} AS r1, {low("f2")} AS r2, {bare("f1")} AS b1, {bare("f2")} AS b2
FROM (SELECT {key}, ps[1] AS f1, CASE WHEN len(ps) > 2 THEN ps[2] ELSE '' END AS f2, ps[len(ps)] AS name FROM (SELECT {key}, string_split({path}, '/') AS ps FROM {source})))))"""


def _discipline_rule(x: str) -> str:
    return _chain([(f"{x} = ''", "NULL")], _discipline(x))
