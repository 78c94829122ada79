"""Classification of questions against a plain version, over random mixtures of all known words."""

import random
import re

from pyspark.sql import functions as F

from lodefall.operators import dictionary, routing
from lodefall.operators import routing as r


def plainly(question, synonyms, codes):
    q = (question or "").lower().strip()
    flat = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", q).strip())
    tags = [c for c, ts in synonyms.items() if any(re.sub(r"[^\w\s]", " ", t).strip() in flat for t in ts)]
    hits = lambda ws: [w for w in ws if w in q]
    code = next((c for c in sorted(codes, key=len, reverse=True) if re.search(rf"\b{c}\b", q)), None) or (m[1] if (m := re.search(r"\b([1-9]\d{2,3})\b", q)) else None)
    if not code and hits(r.CROSS_WORDS):
        return tags, code, "cross_project", 0.85, None
    files = [t for t in tags if t in r.FILE_CONCEPTS]
    s = sum(0.5 for t in tags if t in r.STRUCTURED_CONCEPTS) + sum(0.5 if len(w) > 8 else 0.35 for w in hits(r.STRUCTURED_WORDS))
    f = 0.55 * len(files) + 0.25 * (len(hits(r.FILE_TRIGGERS)) + len(hits(r.QUALIFIERS)) + (0 if files else len(hits(r.FILE_TYPES))))
    f += 0.15 if re.search(r"\b(in|from|around)\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|\d{4})", q) else 0
    m = 0.2 + 0.4 * sum(t in r.SEMANTIC_CONCEPTS for t in tags) + 0.25 * len(hits(r.SEMANTIC_WORDS))
    ranked = sorted((("structured", s), ("file_locator", f), ("semantic", m)), key=lambda x: -round(min(x[1], 1), 4))
    mode, best = ranked[0][0], round(min(ranked[0][1], 1), 4)
    if code and mode == "semantic" and best <= 0.25:
        mode, best = "structured", 0.35
    second = round(min(ranked[1][1], 1), 4)
    return tags, code, mode, best, ranked[1][0] if 0 < second and second >= round(best * 0.7, 6) and best < 0.7 else None


def test_agrees_with_the_plain_version(spark):
    rnd = random.Random(4)
    words = [*r.STRUCTURED_WORDS, *r.FILE_TRIGGERS, *r.FILE_TYPES, *r.QUALIFIERS, *r.SEMANTIC_WORDS, *r.CROSS_WORDS, *r.PLACES, *r.TYPOLOGIES, *(t for ts in r.SYNONYMS.values() for t in ts), "186", "from May 2021", "in 1999", "A-7", "?"]
    asked = [" ".join(rnd.choices(words, k=rnd.randint(0, 3))).title() for _ in range(400)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(asked)), "id int, q string")
    got = {x["id"]: (x["tags"], x["code"], x["mode"], x["confidence"], x["secondary"]) for x in r.classified(df, "q", codes=("a-7", "186")).collect()}
    assert [(asked[k], got[k]) for k in range(len(asked))] == [(a, plainly(a, r.SYNONYMS, ("a-7", "186"))) for a in asked]


def test_dictionaries_as_tables_give_what_few_terms_give(spark):
    questions = ["Latest version of the BIM for A-7", "gfa of 186?", "Curtain   wall; cladding", "floor-plan for p12", "", None, "transmittal 2024 of p1", "p123 p12", "x186y", "owner's 5,000"] * 2
    df = spark.createDataFrame([(k, q, "clash") for k, q in enumerate(questions)], "k int, q string, _q string")
    codes = ("p1", "p12", "186", "a-7", "12", "(9")
    plain = {r["k"]: r for r in routing.classified(df, "q", codes=codes).collect()}
    synonyms = spark.createDataFrame(dictionary.table_of(routing.SYNONYMS), dictionary.SYNONYM_ROW)
    table = spark.createDataFrame([(c,) for c in codes] + [(None,), ("",)], "code string")
    assert {k: r["code"] for k, r in plain.items() if k < 10} == {0: "a-7", 1: "186", 2: None, 3: "p12", 4: None, 5: None, 6: "p1", 7: "p12", 8: None, 9: None}
    assert plain[2]["expanded_terms"] == ["facade", "cladding", "curtain wall"] and plain[3]["tags"] == ["cad_drawings"] and plain[0]["_q"] == "clash"
    for most in (dictionary.TERMS, 2):
        old, dictionary.contained.__defaults__ = dictionary.contained.__defaults__, (most,)
        tagged, coded = dictionary.tagged.__defaults__, dictionary.coded.__defaults__
        dictionary.tagged.__defaults__ = dictionary.coded.__defaults__ = (most,)
        try:
            got = {r["k"]: r for r in routing.classified(df, "q", synonyms, table).collect()}
        finally:
            dictionary.contained.__defaults__, dictionary.tagged.__defaults__, dictionary.coded.__defaults__ = old, tagged, coded
        assert got == plain


def test_the_plan_does_not_grow_with_codes(spark):
    df = spark.createDataFrame([(1, "about 1234")], "k int, q string")
    size = lambda n: len(routing.classified(df, "q", codes=spark.range(n).select(F.col("id").cast("string").alias("code")))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(20_000) - size(10)) < 2000


def test_codes_of_word_characters_meet_words_alone(spark, monkeypatch):
    def runs(texts, terms):
        raise AssertionError("codes of word characters are cut into runs")

    monkeypatch.setattr(dictionary, "by_runs", runs)
    df = spark.createDataFrame([(1, "see p12, or p1"), (2, "é12 and xp12 p_1"), (3, None), (4, "12.p1"), (5, "ap1 12x")], "k int, q string")
    codes = spark.createDataFrame([("p1",), ("p12",), ("12",), ("p_1",), (None,)], "code string")
    got = {r["k"]: r["c"] for r in dictionary.coded(df, "q", codes, "code", "c", 2).collect()}
    assert got == {1: "p12", 2: "p_1", 3: None, 4: "12", 5: None}


def test_paths_are_cut_only_where_a_root_can_end(spark):
    from lodefall.operators import resolution

    paths = spark.createDataFrame([(1, "/ärchive/a/x"), (2, "/ärchive/ab/x"), (3, "/z"), (4, ""), (5, None)], "k int, p string")
    roots = spark.createDataFrame([("/ärchive/a/", 2, "A"), ("/ärchive/", 3, "all"), ("/ärchive/abc/", 1, "C"), ("/z", 4, "Z"), (None, 0, "none")], "r string, o int, v string")
    cut = {(r["k"], r["_cut"]) for r in resolution.beginnings(paths, "k", "p", roots.where("r is not null"), "r").collect()}
    assert cut == {(1, "/ärchive/"), (1, "/ärchive/a/"), (2, "/ärchive/"), (3, "/z")}
    got = lambda rs: {r["k"]: r["v"] for r in resolution.by_prefix(paths, "k", "p", rs, "r", "o", "v").collect()}
    assert got(roots) == {1: "A", 2: "all", 3: "Z"}
    assert got(roots.unionByName(spark.createDataFrame([("", 9, "any")], roots.schema))) == {1: "A", 2: "all", 3: "Z", 4: "any"}
