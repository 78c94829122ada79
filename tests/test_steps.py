"""The incremental steps run twice, on empty tables, and with nulls; the index on odd tables."""

from pyspark.sql import functions as F

from lodefall.functions import text as tx
from lodefall.operators import cards, intake, reports, search
from lodefall.operators.index import Index

CHUNK = "chunk_id string, file_id int, ref string, text string, token_estimate long, content_hash string, embedded int"


def test_chunk_steps_twice(spark):
    new = intake.prepared(spark.createDataFrame([(1, "p1", "a"), (1, "p2", None), (2, "p1", "")], "file_id int, ref string, text string"))
    first = intake.upserted(spark.createDataFrame([], CHUNK), new)
    assert {r["outcome"] for r in first.collect()} == {"new"} and first.count() == 3
    embedded = first.drop("outcome").withColumn("embedded", F.lit(1))
    again = intake.upserted(embedded, new)
    assert {(r["outcome"], r["embedded"]) for r in again.collect()} == {("unchanged", 1)}
    assert intake.upserted(embedded, new.limit(0)).where("outcome = 'kept'").count() == 3
    files = spark.createDataFrame([(1, "/a", None, None, "EXTRACTED"), (2, "/b", None, None, "EXTRACTED"), (3, "/c", None, None, "FAILED")], "file_id int, file_path string, project_id string, typology string, status string")
    chunks = first.drop("outcome")
    waiting = intake.pending(chunks, files)
    assert waiting.count() == 3 and {r["project_id"] for r in waiting.collect()} == {"Unknown"}
    none = waiting.select("chunk_id", F.lit(None).cast("array<double>").alias("embedding"))
    marked = intake.marked(chunks, files, none)
    # a text that could not be embedded waits on; texts without anything to embed don't
    assert {(r["file_id"], r["ref"]): r["embedded"] for r in marked.collect()} == {(1, "p1"): 0, (1, "p2"): 1, (2, "p1"): 1}
    after = intake.finalised(intake.advanced(files, marked))
    assert {r["file_id"]: r["status"] for r in after.collect()} == {1: "EXTRACTED", 2: "INDEXED", 3: "FAILED"}
    assert tuple(intake.indexing(files, chunks, none).first()) == (0, 1, 1, 1)


def test_image_step_twice(spark):
    files = spark.createDataFrame([(1, "/p/renders/a.JPG", ".JPG", "METADATA_ONLY", 1, None), (2, "/p/scans/scan.png", "png", "METADATA_ONLY", 1, None), (3, "/p/x.jpg", "jpg", "TEXT_EXTRACTABLE", 1, None)], "file_id int, file_path string, extension string, lane string, size long, image_type string")
    one, chunks = intake.described(files, spark.createDataFrame([], CHUNK))
    assert {r["file_id"]: r["image_type"] for r in one.collect()} == {1: "render", 2: "scanned_document", 3: None}
    two, more = intake.described(one, chunks)
    assert sorted(two.collect()) == sorted(one.collect()) and sorted(more.collect()) == sorted(chunks.collect())
    assert [r["file_id"] for r in chunks.collect()] == [1]


def test_logs_are_numbered_on(spark):
    log = spark.createDataFrame([(4, "x")], "n long, what string")
    rows = spark.createDataFrame([(k, f"w{k:03}") for k in range(200)], "k int, what string").repartition(7)
    found = sorted((r["n"], r["what"]) for r in intake.appended(log, rows, "n", ["what"]).collect())
    assert found == [(4, "x"), *((5 + k, f"w{k:03}") for k in range(200))]
    assert intake.appended(log, rows.limit(0), "n", ["what"]).count() == 1
    assert [r["n"] for r in intake.appended(log.limit(0), rows.limit(1), "n", ["what"]).collect()] == [1]


def test_long_logs_are_numbered_on(spark):
    """Parts whose sizes and rows come from two runs of the same shuffle."""
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(held, ("false", "40"), strict=True):
            spark.conf.set(c, v)
        rows = spark.range(0, 60_000, 1, 8).select("id", F.col("id").alias("was"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("what"))
        log = spark.createDataFrame([(4, 0, "x")], "n long, was long, what string")
        found = intake.appended(log, rows, "n", ["id"]).where("n > 4")
        assert found.count() == 60_000 and found.where("n <> was + 5").count() == 0
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_index_of_odd_tables(spark, tmp_path):
    none = spark.createDataFrame([], "k int, t string")
    index = Index(spark, str(tmp_path / "a"), buckets=3).build(none, "k", "t")
    assert index.bm25("k", ["word"]).count() == 0 and index.statistics() == {"segment": 0, "n": 0, "tokens": 0}
    index.refresh(spark.createDataFrame([(1, "Word word été_x"), (2, None), (None, "word")], "k int, t string"), none, "k", "t")
    assert {r["k"] for r in index.bm25("k", ["WORD"]).collect()} == {1, None} and index.bm25("k", []).count() == 0
    assert {r["k"] for r in index.bm25("k", ["word_été"]).collect()} == {1}
    index.refresh(spark.createDataFrame([(1, "other")], "k int, t string"), spark.createDataFrame([(2, "")], "k int, t string"), "k", "t")
    assert {r["k"] for r in index.bm25("k", ["word"]).collect()} == {None} and index.statistics()["n"] == 2
    whole = index.compact(str(tmp_path / "b"))
    assert {r["k"] for r in whole.bm25("k", ["other", "word"]).collect()} == {None, 1} and whole.statistics() == {"segment": 0, "n": 2, "tokens": 2}


def test_snippets_and_scopes(spark):
    words = " ".join(f"w{k}" for k in range(60)).replace("w30", "Alpha").replace("w40", "beta,").replace("w5 ", "alpha ")
    rows = spark.createDataFrame([(1, words), (2, "no hit " * 40), (3, None), (4, "alpha")], "k int, t string")
    got = {r["k"]: r["s"] for r in rows.select("k", tx.snippet(F.col("t"), ["alpha", "beta"]).alias("s")).collect()}
    assert got[1].startswith(" ... Alpha w31") and "beta," in got[1] and len(got[1]) <= 160 and got[2] == ("no hit " * 40)[:160] and got[3] is None and got[4] == "alpha"
    files = spark.createDataFrame([(1, "p", "/a%b/x"), (2, None, "/A_b/y"), (3, "q", None)], "file_id int, project_id string, file_path string")
    ids = lambda f: sorted(r["file_id"] for r in search.scoped(files, f).collect())
    assert ids({}) == [1, 2, 3] and ids({"project_ids": []}) == [] and ids({"project_ids": None, "root": "/a_b/"}) == [1, 2] and ids({"project_id": "q"}) == [3]


def test_cards_and_reports_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x</p><h1></h1><title>T &amp; U</title>")], "k int, html string")
    got = {r["k"]: r for r in cards.scraped(pages, "k", "html").collect()}
    assert got[1]["name"] is None and got[2]["awards"] is None and got[3]["name"] == "T & U" and got[3]["gfa_sqm"] is None
    none = spark.createDataFrame([], "file_path string, status string")
    events = spark.createDataFrame([], "event_type string, ts timestamp")
    row = reports.stale(none, none.select("file_path"), events, F.current_date()).first()
    assert (row["files_indexed"], row["staleness_score"], row["recommendation"]) == (0, 0.5, "run rebuild")
    assert [tuple(r) for r in reports.by_root(none, ["/a"]).collect()] == [("/a", 0, 0, 0, 0)]


def test_typing_goes_on_behind_tried_files(spark):
    head = "Minutes of meeting. Attendees: all. Action items."
    files = spark.createDataFrame([(k, "TEXT_EXTRACTABLE", "INDEXED", None, None, None) for k in range(9)], "file_id int, lane string, status string, doc_type string, classification_method string, classification_confidence double")
    chunks = spark.createDataFrame([(k, ref, " " if k < 3 and ref == "p1" else "zzz" if k < 6 else head) for k in range(9) for ref in ("p1", "p2")], "file_id int, ref string, text string")
    tried = lambda d: {r["file_id"]: r["classification_method"] for r in d.where("classification_method is not null").collect()}
    one = intake.typed(files, chunks, most=2).cache()
    assert tried(one) == {3: "unknown", 4: "unknown"}
    two = intake.typed(one, chunks, most=2).cache()
    assert set(tried(two)) == {3, 4, 5, 6}
    rest = intake.typed(two, chunks).cache()
    assert set(tried(rest)) == set(range(3, 9)) and sorted(intake.typed(rest, chunks).collect()) == sorted(rest.collect())


def test_only_the_head_is_scored(spark, tmp_path):
    seen = tmp_path / "seen"

    def scorer(question, texts):
        with seen.open("a") as out:
            out.write("".join(f"{t}\n" for t in texts))
        return [float(t[1:]) for t in texts]

    rows = spark.createDataFrame([(k, f"t{k}") for k in range(1, 201)], "r int, t string").repartition(3)
    got = {r["r"]: r["new_rank"] for r in search.reranked(rows, "r", "q", "t", 10, scorer).collect()}
    assert got == {k: 11 - k if k <= 10 else k for k in range(1, 201)}
    assert sorted(seen.read_text().split()) == sorted(f"t{k}" for k in range(1, 11))
