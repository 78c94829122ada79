"""Stemming, project resolution, classification, reranking and sinks against brute force and the stdlib."""

import difflib
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodefall.functions import stem
from lodefall.functions import text as tx
from lodefall.operators import analytics, classify, resolution, search
from lodefall.operators.index import Index
from lodefall.sources import sinks

WORDS = """caresses ponies ties caress cats gas feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky
relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness
callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible
irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll naïve hospitals as a yes
sensibility possibly apology generalizations oscillators queueing dying say flies""".split()


def fts(rows, match):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x, tokenize='porter ascii')")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without FTS5")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    return dict(con.execute("select rowid, -bm25(t) from t where t match ?", (match,)).fetchall())


def test_stems_agree_with_fts5():
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(x, tokenize='porter ascii')")
        con.execute("create virtual table v using fts5vocab(t, instance)")
    except sqlite3.OperationalError:
        pytest.skip("sqlite3 without FTS5")
    rnd = random.Random(5)
    words = WORDS + ["".join(rnd.choices("aeioubcdlmnrstyz", k=rnd.randint(1, 7))) + rnd.choice(("", "ing", "ed", "ational", "s", "es", "ness", "ly", "ies", "ement", "ion", "eed", "ll", "e")) for _ in range(3000)]
    con.executemany("insert into t(rowid, x) values (?, ?)", enumerate(words))
    there = dict(con.execute("select doc, term from v").fetchall())
    assert [(w, stem.porter(w)) for w in words] == [(w, there[k]) for k, w in enumerate(words)]


@pytest.mark.parametrize("stemmed", [True, False])
def test_bm25_agrees_with_fts5(spark, tmp_path, stemmed):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 60)))) for k in range(1, 120)] + [(120, ""), (121, "HOPPING Sky-ties")]
    df = spark.createDataFrame(rows + [(122, None)], "k int, t string")
    terms = ["hop", "ties", "sky"] if not stemmed else ["hoped", "tied", "sky", "sensible", "generalization", "sky_ties"]
    index = Index(spark, str(tmp_path / "index"), stemmed, 4).build(df, "k", "t")
    got = {r["k"]: r["bm25"] for r in index.bm25("k", terms).collect()}
    if stemmed:
        want = fts(rows + [(122, "")], " OR ".join(t if "_" not in t else f'"{t}"' for t in terms))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
        plain = Index(spark, str(tmp_path / "plain"), buckets=4).build(df, "k", "t")
        again = Index(spark, str(tmp_path / "stems"), True, 4).build_stems(plain)
        assert {r["k"]: r["bm25"] for r in again.bm25("k", terms).collect()} == got
    else:
        assert got.keys() == {k for k, t in rows if {"hop", "ties", "sky"} & set(t.lower().replace("-", " ").split())}


def test_similar_pairs_agree_with_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcde ", k=rnd.randint(1, 12))) for _ in range(400)] + ["", "ab", "a", "abc"]
    other = [x[: len(x) // 2] + rnd.choice(["", "x", "b"]) + x[len(x) // 2 :] for x in base] + ["ab", "abcd"]
    a, b = spark.createDataFrame([(x,) for x in base * 2] + [(None,)], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    got = {(r["a"], r["b"]): r["ratio"] for r in resolution.similar(a, "a", b, "b").collect()}
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    assert got == {(x, y): ratio(x, y) for x in set(base) - {""} for y in set(other) - {""} if ratio(x, y) > 0.8}


def test_similar_longer_and_repetitive_strings_agree_with_all_pairs(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choices("ab\x02é", k=rnd.randint(15, 45))) for _ in range(60)] + ["a" * n for n in (1, 2, 3, 7, 30, 44)] + ["ab" * 20, "ba" * 19]
    other = ["".join(c for c in x if rnd.random() > 0.15) + rnd.choice(["", "ab", "zz"]) for x in base] + ["a" * n for n in (5, 36)]
    a, b = spark.createDataFrame([(x,) for x in base], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    for threshold in (0.8, 0.9):
        got = {(r["a"], r["b"]) for r in resolution.similar(a, "a", b, "b", threshold).collect()}
        want = {(x, y) for x in set(base) for y in set(other) if ratio(x, y) > threshold}
        assert got == want and len(want) > 20
    assert resolution.similar(a.where("false"), "a", b, "b").count() == 0


@pytest.mark.parametrize("share", [0, 1 << 60])
def test_similar_by_either_way_agrees_with_all_pairs(spark, monkeypatch, share):
    """Share 0: by what is left wherever that is short enough; a huge one: by runs alone."""
    monkeypatch.setattr(resolution, "SHARE", share)
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abc1 \U0001f600é", k=rnd.randint(1, 20))) for _ in range(200)] + ["a" * n for n in (1, 2, 5, 11, 14, 40, 60)] + ["abcab_cabc\U0001f601", "'\\%\n", "ab" * 35]
    other = ["".join(c for c in x if rnd.random() > 0.1) + rnd.choice(["", "b", "ZY"]) for x in base] + ["a" * n for n in (4, 12, 52)] + ["abcabcabc", "ab" * 33]
    a, b = spark.createDataFrame([(x,) for x in base], "a string"), spark.createDataFrame([(x,) for x in other], "b string")
    ratio = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    for threshold in (0.8, 0.9):
        got = [(r["a"], r["b"]) for r in resolution.similar(a, "a", b, "b", threshold).collect()]
        want = {(x, y) for x in set(base) for y in set(other) - {""} if ratio(x, y) > threshold}
        assert set(got) == want and len(got) == len(want) > 100


def test_many_random_names_meet_by_what_is_left(spark):
    """Runs of two hexadecimal digits are shared by a part of all pairs, so that their work grew with the square of the names."""
    a = spark.range(12_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 12).alias("a"))
    b = spark.range(0, 24_000, 2).select(F.md5(F.col("id").cast("string")).alias("b")).select(F.concat(F.substring("b", 1, 6), F.lit("_"), F.substring("b", 7, 6)).alias("b"))
    pairs = resolution.similar(a, "a", b, "b")
    assert "levenshtein" not in pairs._jdf.queryExecution().toString()
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert {(x, y) for x, y in got if x == y.replace("_", "")} == {(r["a"], f"{r['a'][:6]}_{r['a'][6:]}") for r in a.collect()[::2]}
    xs, ys = resolution.shaped(a.select(F.col("a").alias("_s")), b.select(F.col("b").alias("_s")))
    met = resolution.met_by_left(xs, ys, resolution.Meeting(resolution.shapes(xs, ys), 0.8), 0.8).distinct().count()
    assert len(got) <= met < len(got) + 100  # of 144 million pairs


def test_by_name_takes_the_first_part_and_of_its_cards_the_first(spark):
    rnd = random.Random(9)
    names = ["harbour house", "Harbour House", "garden tower", "gardens tower", "north pier", "quay"]
    cards = [(rnd.choice(names), n, f"c{n}") for n in range(30)] + [(None, 0, "x"), ("", 0, "y")]
    bits = ["harbor house", "garden towers", "misc", "quays", "quay", "NORTH PIERS", "f.pdf", "a"]
    paths = [(k, "/".join(rnd.choices(bits, k=rnd.randint(1, 4)))) for k in range(60)] + [(60, None), (61, "")]
    got = {r["k"]: r["v"] for r in resolution.by_name(spark.createDataFrame(paths, "k int, p string"), "k", "p", spark.createDataFrame(cards, "n string, o int, v string"), "n", "o", "v").collect()}
    want = {}
    for k, path in paths:
        for part in (path or "").lower().split("/"):
            like = [(o, v) for n, o, v in cards if n and part and difflib.SequenceMatcher(None, part, n.lower()).ratio() > 0.8]
            if like:
                want[k] = min(like)[1]
                break
    assert got == want and len(want) > 30


def test_resolution_order(spark):
    cards = spark.createDataFrame([("186", "Harbour House", "/n/186 x", 1), ("270", "Garden Tower", None, 2), ("999", None, "/n", 3), (None, "Void", None, 4)], "project_code string, name string, root_path string, ordinal int")
    aliases = spark.createDataFrame([("270", "GT", 1), ("186", "harb", 2), ("270", "Harbour", 3)], "project_code string, alias string, ordinal int")
    paths = [(1, "/n/186 x/a.pdf"), (2, "/m/job 270 y/a"), (3, "/m/HARBOURS/a"), (4, "/m/gardn tower/a"), (5, "/m/none"), (6, None), (7, ""), (8, "/nn/harb")]
    df = spark.createDataFrame(paths, "k int, p string")
    got = {r["k"]: (r["project_code"], r["confidence"], r["method"]) for r in resolution.resolved(df, "k", "p", cards, aliases).collect()}
    assert got == {
        1: ("186", 1.0, "root_path"), 2: ("270", 0.95, "project_number"), 3: ("270", 0.85, "alias_match"), 4: ("270", 0.7, "fuzzy_name"),
        5: (None, None, None), 6: (None, None, None), 7: (None, None, None), 8: ("999", 1.0, "root_path"),
    }
    empty = df.where("false")
    assert resolution.resolved(empty, "k", "p", cards, aliases).count() == 0


def test_nearest_override_and_names(spark):
    over = spark.createDataFrame([("/a", "x"), ("/a/b", "y")], "f string, v string")
    df = spark.createDataFrame([(1, "/a/b/c/d.txt"), (2, "/a/d.txt"), (3, "/q/d.txt"), (4, "/a/" + "z/" * 13 + "f")], "k int, p string")
    assert {r["k"]: r["v"] for r in resolution.nearest_override(df, "k", "p", over, "f", "v").collect()} == {1: "y", 2: "x"}
    t = spark.createDataFrame([("186", "Harbour Orchard"), ("J1", "the Quay"), ("x270", ""), (None, None)], "c string, n string")
    assert [r[0] for r in t.select(resolution.project_aliases(F.col("c"), F.col("n"))).collect()] == [["HO", "Harbour", "Orchard", "HarbourOrchard", "186"], ["Quay"], [], []]


def test_levels_of_folders_are_not_broadcast(spark):
    df = spark.sql("SELECT * FROM VALUES (1, '/a/b/c/d.txt'), (2, '/a/d.txt'), (3, '/q/d.txt'), (4, 'd.txt'), (5, NULL) AS (k, p)")
    over = spark.sql("SELECT * FROM VALUES ('/a', 'x'), ('/a/b', NULL) AS (folder, typology)")
    found = resolution.nearest_override(df, "k", "p", over, "folder", "typology"), resolution.typologies(df, "k", "p", {"z": ("q",)}, over)
    assert {r["k"]: r["typology"] for r in found[0].collect()} == {1: None, 2: "x"}
    assert {r["k"]: r["typology"] for r in found[1].collect()} == {1: "Unknown", 2: "x", 3: "z", 4: "Unknown", 5: "Unknown"}
    plan = found[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") > 0


def test_content_types_and_images(spark):
    rows = [(1, "MINUTES of meeting. Present : all"), (2, None), (3, ""), (4, "document number 1 issued by x, revision 3"), (5, "x " * 30 + "specification 1.2.3 the contractor shall")]
    got = {r["k"]: (r["doc_type"], r["confidence"], r["signals"]) for r in classify.content(spark.createDataFrame(rows, "k int, t string"), "t").collect()}
    assert got[1] == ("minutes", 0.8, ["mom_header", "attendees_list"]) and got[2] == got[3] == ("unknown", 0.3, [])
    assert got[4] == ("transmittal", 0.7, ["doc_table", "transmitted_by"]) and got[5] == ("specification", 0.7, ["clause_numbering", "contractor_shall"])
    images = spark.createDataFrame([("C:\\x\\viz\\a.png", 1), ("/a/Scanner.jpg", 1), ("/images/b.jpg", 6_000_000), ("/images/b.jpg", 10)], "p string, s long")
    assert [r[0][0] for r in images.select(classify.image(F.col("p"), F.col("s"))).collect()] == ["render", "scanned_document", "render", "unknown"]


def test_injected_models(spark):
    df = spark.createDataFrame([(1, "b"), (2, "aaa"), (3, "cc"), (4, "dddd"), (5, None), (6, "")], "r int, t string")
    got = search.reranked(df, "r", "q", "t", 3, lambda q, ts: [float(len(t)) for t in ts]).orderBy("new_rank").collect()
    assert [r["r"] for r in got] == [2, 3, 1, 4, 5, 6]
    assert [r["new_rank"] for r in search.reranked(df, "r", "q", "t", 3).orderBy("r").collect()] == [1, 2, 3, 4, 5, 6]

    def embed(ts):
        if any(t == "cc" for t in ts):
            raise RuntimeError
        return [[float(len(t)), 1.0] for t in ts]

    assert {r["r"]: r["embedding"] for r in search.embedded(df, "r", "t", embed).collect()} == {1: [1.0, 1.0], 2: [3.0, 1.0], 3: None, 4: [4.0, 1.0]}


def test_terms_sinks_and_config(spark, tmp_path):
    assert tx.boosted_terms("Find the a plan, plan!", ["Facade of plan", "up GFA"]) == ["plan", "plan", "Facade", "GFA"]
    df = spark.createDataFrame([(1, 0.9), (2, 0.1)], "k int, confidence double")
    sinks.query_log(df, str(tmp_path / "all"), str(tmp_path / "low"))
    assert spark.read.json(str(tmp_path / "all")).count() == 2 and spark.read.json(str(tmp_path / "low")).first()["k"] == 2
    sinks.export_csv(df, str(tmp_path / "csv"), "k")
    assert [r["k"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == ["2", "1"]
    assert "<td>0.9</td>" in sinks.report_html(df, "a<b") and "a&lt;b" in sinks.report_html(df, "a<b")
    (tmp_path / "c.json").write_text(json.dumps({"index_roots": ["/a"]}))
    assert sinks.config(str(tmp_path / "c.json"))["index_roots"] == ["/a"]
    for bad in ("{}", "no"):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(sinks.ConfigError):
            sinks.config(str(tmp_path / "c.json"))


def test_audits_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b string, n long")
    assert analytics.extension_stats(none, "a", F.col("n"), 3).count() == 0
    assert analytics.siblings(none, "a", "b").count() == 0
    assert [tuple(r) for r in analytics.checks({"x": (none, F.lit(True))}).collect()] == [("x", 0, True)]
    assert classify.convention(none, "a", "b").count() == 0


def test_both_ways_to_find_aliases_agree(spark):
    rnd = random.Random(4)
    aliases = spark.createDataFrame([("".join(rnd.choices("abcÉ ", k=rnd.randint(1, 6))), k % 50, f"P{k}") for k in range(300)], "alias string, o int, v string")
    rows = spark.createDataFrame([(k, "".join(rnd.choices("abcé \\/", k=rnd.randint(0, 30)))) for k in range(500)] + [(None, None)], "k int, p string")
    found = lambda: sorted((r["k"], r["v"]) for r in resolution.by_alias(rows, "k", "p", aliases, "alias", "o", "v").collect())
    one, resolution.ALIASES = found(), 10
    try:
        assert found() == one and len(one) > 300
    finally:
        resolution.ALIASES = 200_000


def test_joined_aliases_of_all_lengths(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("ab0", k=rnd.choice((3, 5, 6, 11, 12, 13, 23, 24, 40)))) for _ in range(200)]
    aliases = spark.createDataFrame([(w, k % 7, f"P{k}") for k, w in enumerate(words)], "alias string, o int, v string")
    paths = ["".join(rnd.choices(["a", "b", "0", "/", w], k=9)) for w in words] * 2 + ["", None]
    rows = spark.createDataFrame(list(enumerate(paths)), "k int, p string")
    once = {w: min((k % 7, f"P{k}") for k, x in enumerate(words) if x == w) for w in words}
    best = {k: max(((len(w), -o, v) for w, (o, v) in once.items() if w in p), default=None) for k, p in enumerate(paths) if p is not None}
    held, resolution.ALIASES = resolution.ALIASES, 10
    try:
        found = resolution.by_alias(rows, "k", "p", aliases, "alias", "o", "v")
        assert {r["k"]: r["v"] for r in found.collect()} == {k: x[2] for k, x in best.items() if x}
        # what is cut out of paths isn't broadcast, however small the paths' table
        few = spark.sql("SELECT 1 AS k, 'ab0' AS p"), spark.sql("SELECT explode(sequence(1, 20)) AS o").selectExpr("o", "'ab' || o AS alias", "'P' AS v")
        joined = resolution.by_alias(*few[:1], "k", "p", few[1], "alias", "o", "v"), resolution.by_prefix(few[0], "k", "p", few[1], "alias", "o", "v")
        for x in joined:
            assert "BroadcastHashJoin" not in x._jdf.queryExecution().executedPlan().toString()
    finally:
        resolution.ALIASES = held


def test_percentiles_of_large_groups(spark):
    df = spark.range(350_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 != 0, F.round(F.rand(3) * 5000) / 7).alias("v"))
    want = df.groupBy("g").agg(*(F.round(F.percentile("v", q), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.95)), F.count("*").alias("n"))
    got = analytics.percentiles(df, "v", ["g"])
    assert sorted(got.collect()) == sorted(want.collect())


def test_best_texts_without_whole_lists(spark, tmp_path):
    rnd = random.Random(8)
    words = ["sky"] * 40 + ["hop"] * 8 + ["tie"] + [f"w{j}" for j in range(300)]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.choice((5, 20, 60, 200))))) for k in range(1500)] + [(k, "sky " * 30 + "hop") for k in range(1500, 1504)] + [(9000, None), (9001, "")]
    df = spark.createDataFrame(rows, "k int, t string")
    index = Index(spark, str(tmp_path / "one"), buckets=4).build(df.where("k % 3 > 0"), "k", "t")
    index.refresh(df.where("k % 3 = 0"), df.where("false"), "k", "t")  # two segments, nothing replaced
    asked = (["sky"], ["sky", "hop"], ["tie", "sky", "sky"], ["w1", "sky", "tie"], ["none"], ["none", "hop"], [])
    for ts in asked:
        for k in (1, 7, 3000) if len(ts) != 1 else (7,):
            want = [tuple(r) for r in index.bm25("k", ts).orderBy(F.desc("bm25"), "k").limit(k).collect()]
            read = {}
            assert [tuple(r) for r in index.top("k", ts, k, read, whole=0).collect()] == want
            assert index.top("k", ts, k, whole=10**6).count() == len(want)
            if ts == ["tie", "sky", "sky"] and k == 7:
                assert read["giving"] < read["lists"] / 2 and read["candidates"] < 200
    assert index.top("k", ["sky hop"], 5).count() == 5
    index.refresh(df.where("k < 3"), df.where("k = 1500"), "k", "t")  # replaced texts: all is scored
    for one in (index, index.compact(str(tmp_path / "two"))):
        assert [tuple(r) for r in one.top("k", ["sky", "hop"], 6, whole=0).collect()] == [tuple(r) for r in one.bm25("k", ["sky", "hop"]).orderBy(F.desc("bm25"), "k").limit(6).collect()]
