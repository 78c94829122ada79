"""Search with citations that reads by ids, and the vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodefall.functions import stem
from lodefall.functions.text import tokens
from lodefall.operators import index as index_module
from lodefall.operators import search, vectors
from lodefall.operators.index import Index


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("archive")
    rows = [(f"c{k:03}", f"f{k // 2:03}", "" if k == 4 else f"p{k % 2 + 1}", ("alpha " if k % 3 == 0 else "beta ") + "word " * (k % 7 + 1)) for k in range(60)]
    spark.createDataFrame(rows, "chunk_id string, file_id string, ref string, text string").orderBy("chunk_id").coalesce(1).write.parquet(f"{path}/chunks")
    files = [(f"f{k:03}", f"/data/{'one' if k % 2 else 'two'}/d{k}/x.txt", "tower" if k % 4 == 0 else "villa") for k in range(30)]
    spark.createDataFrame(files, "file_id string, file_path string, typology string").write.parquet(f"{path}/files")
    chunks, known = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/files")
    return Index(spark, f"{path}/index", buckets=4).build(chunks, "chunk_id", "text"), chunks, known


def test_citations_name_the_root_where_there_are_several(archive):
    index, chunks, files = archive
    one = search.search(index, chunks, files, "alpha", roots=["/data/"]).collect()
    assert [r["rank"] for r in one] == [1, 2, 3, 4, 5] and all(r["citation"] == f"{r['file_path'][6:]}#{r['ref']}" and r["rel_path"] == r["file_path"][6:] for r in one)
    two = search.search(index, chunks, files, "alpha", roots=["/data/one", "/data/two"]).collect()
    assert all(r["citation"] == f"[{r['file_path'].split('/')[2]}] {'/'.join(r['file_path'].split('/')[3:])}#{r['ref']}" for r in two)
    none = search.search(index, chunks, files, "alpha", roots=["/elsewhere"]).collect()
    assert all(r["rel_path"] == "x.txt" and r["citation"].startswith("x.txt#") for r in none)
    assert {r["citation"] for r in search.search(index, chunks, files, "alpha").collect()} <= {"x.txt#p1", "x.txt#p2"}


def test_invalid_results_take_no_place_but_count_for_the_offset(spark, archive):
    index, chunks, files = archive
    whole = search.search(index, chunks, files, "alpha", top=20).collect()
    there = spark.createDataFrame([(r["file_path"],) for r in whole if r["rank"] not in (2, 3)], "file_path string")
    got = search.search(index, chunks, files, "alpha", top=20, present=there).collect()
    assert [r["chunk_id"] for r in got] == [r["chunk_id"] for r in whole if r["rank"] not in (2, 3) and r["file_path"] in {x["file_path"] for x in there.collect()}]
    later = search.search(index, chunks, files, "alpha", top=3, offset=2, present=there).collect()
    assert [r["chunk_id"] for r in later] == [r["chunk_id"] for r in whole if r["rank"] > 2 and r["rank"] != 3][:3]
    assert all(r["ref"] for r in search.search(index, chunks, files, "beta", top=60).collect())


def test_search_reads_texts_by_id(archive, capsys):
    index, chunks, files = archive
    found = search.search(index, chunks, files, "alpha", top=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and all("PushedFilters: [IsNotNull(chunk_id), In(chunk_id" in x or "In(file_id" in x or "Or(" in x or "EqualTo" in x for x in scans), scans
    assert not any("text" in x and "In(chunk_id" not in x for x in scans)
    filtered = search.search(index, chunks, files, "alpha", {"typology": "tower"}, top=30).collect()
    assert filtered and {r["file_path"].split("/")[3] for r in filtered} <= {f"d{k}" for k in range(0, 30, 4)}
    near = chunks.select("chunk_id", (F.length("text") / 100).alias("distance")).where("chunk_id < 'c010'")
    assert search.search(index, chunks, files, "alpha", near=near).count() == 5
    assert search.search(index, chunks, files, "nothing there").count() == 0


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16))
    return (centers[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)


def exact(points, q, k, among=None):
    ids = np.arange(len(points)) if among is None else np.array(among)
    v = points[ids].astype(np.float64)
    d = np.round(1 - (v @ q) / np.linalg.norm(v, axis=1) / np.linalg.norm(q), 4)
    return [int(ids[j]) for j in np.lexsort((ids, d))[:k]]


def test_vector_index(spark, tmp_path, points):
    rows = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(points)] + [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [], 1)], "id long, v array<float>, label int")
    index = vectors.VectorIndex(spark, str(tmp_path / "v")).build(rows, "id", "v", keep=("label",))
    assert 20 < len(index.centers()[0]) <= 37 and index.read("vectors").count() == 1500
    q = points[7].astype(np.float64)
    all_lists = index.nearest(q.tolist(), 10, probes=99)
    assert [r["key"] for r in all_lists.collect()] == exact(points, q, 10)
    few = index.nearest(q.tolist(), 10, F.col("label") == 2)
    want = exact(points, q, 10, [k for k in range(1500) if k % 3 == 2])
    assert len(set(r["key"] for r in few.collect()) & set(want)) >= 9
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan and "In(key" in plan
    queries = rows.where("id % 50 = 0")
    got = {}
    for r in index.nearest_of_each(queries, "id", "v", 20).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"]))
    assert len(got) == 30
    recall = np.mean([len({k for _, k in sorted(got[q])} & set(exact(points, points[q].astype(np.float64), 20))) / 20 for q in got])
    assert recall >= 0.9
    every = index.nearest_of_each(queries, "id", "v", 5, probes=99).collect()
    assert all([k for _, k in sorted((r["rank"], r["key"]) for r in every if r["query"] == q)] == exact(points, points[q].astype(np.float64), 5) for q in (0, 450, 1450))


def test_vector_index_is_kept_up(spark, tmp_path, points):
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(points[:300])], "id long, v array<float>")
    index = vectors.VectorIndex(spark, str(tmp_path / "a")).build(rows, "id", "v")
    changed = spark.createDataFrame([(5, points[900].tolist()), (2000, points[901].tolist())], rows.schema)
    index.refresh(changed, rows.where("id = 6").select("id"), "id", "v")
    one = lambda i, q: [r["key"] for r in i.nearest(points[q].tolist(), 3, probes=99).collect()]
    for there in (index, index.compact(str(tmp_path / "b"))):
        assert one(there, 900)[0] == 5 and one(there, 901)[0] == 2000 and 6 not in one(there, 6) and 5 not in one(there, 5)
        assert there.live(there.read("vectors")).count() == 300
    none = vectors.VectorIndex(spark, str(tmp_path / "c")).build(rows.limit(0), "id", "v")
    assert none.nearest([1.0] * 16, 3).count() == 0 and none.compact(str(tmp_path / "d")).nearest([1.0] * 16, 3).count() == 0
    assert none.refresh(rows, rows.limit(0).select("id"), "id", "v").nearest(points[3].tolist(), 1, probes=99).first()["key"] == 3


def test_postings_are_found_without_a_shuffle(spark, tmp_path):
    """Texts in parts of a few tokens, stems that meet, and a plan whose only exchange is that of writing."""
    texts = [(1, "tied a Tie ties, a"), (2, ""), (3, None), (4, "a " * 9 + "b"), (5, "é tie")]
    df = spark.createDataFrame(texts, "k int, t string").coalesce(1)
    held, index_module.TOKENS = index_module.TOKENS, 3
    try:
        rows = df.select(F.col("k").alias("key"), tokens(F.col("t")).alias("ts"))
        for stemmer, tie in ((None, {"tied": [0], "tie": [2], "ties": [3]}), (stem.porter, {"ti": [0, 3], "tie": [2]})):
            found = rows.mapInArrow(index_module.postings_of(stemmer), "term string, key int, dl int, places array<int>")
            got = {(r["key"], r["term"]): (r["dl"], r["places"]) for r in found.collect()}
            assert {t: p for (k, t), (_, p) in got.items() if k == 1} == {"a": [1, 4], **tie} and got[4, "a"] == (10, list(range(9)))
            assert {k for k, _ in got} == {1, 4, 5} and got[4, "b"] == (10, [9]) and got[5, "é"] == (2, [0])
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        index_module.TOKENS = held


def test_probing_queries_are_made_in_parts(spark, tmp_path, monkeypatch):
    rows = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "k int, v array<double>").coalesce(1)
    index = vectors.VectorIndex(spark, str(tmp_path / "v")).build(df, "k", "v")
    asked = df.where("k < 30")
    found = lambda: sorted(map(tuple, index.nearest_of_each(asked, "k", "v", 3, probes=5).collect()))
    whole = found()
    monkeypatch.setattr(vectors, "PROBED", 17)
    assert found() == whole and len(whole) == 90


def test_texts_answer_as_an_index_does_without_building_one(spark, tmp_path, monkeypatch):
    from lodefall.plans import catalog, indexes

    rows = [(1, "The and the-AND of the"), (2, ""), (3, None), (4, "and the " * 5), (5, "é the"), (5, "the and"), (6, "of"), (None, "of the and")]
    df = spark.createDataFrame(rows, "k int, t string")
    index, texts = Index(spark, str(tmp_path / "i")).build(df.where("k <> 5 OR t <> 'the and'"), "k", "t"), index_module.Texts(df.where("k <> 5 OR t <> 'the and'"), "k", "t")
    for terms in (["the", "of", "the"], ["the_and", "of"], ["the_and", "and_the"], ["missing"], ["?"], []):
        both = [sorted(map(tuple, x.bm25("k", terms).collect()), key=str) for x in (index, texts)]
        assert both[0] == both[1] and texts.top("k", terms, 2).collect() == index.top("k", terms, 2).collect()
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(k, "anhe the " * (k % 3) + "lyer", "en", "src1") for k in range(40)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    want = Index(spark, str(tmp_path / "j")).build(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id", "text").top("doc_id", indexes.TERMS, 30).collect()
    monkeypatch.setattr(Index, "build", lambda *_: pytest.fail("a question built an index"))
    got = catalog.QUERIES["bm25_topk"](spark, folder).collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    assert len(catalog.QUERIES["recall_at_k"](spark, folder).collect()) == 1


def test_postings_are_written_and_compacted_in_pages(spark, tmp_path, monkeypatch):
    """Few rows hold all postings, and what is gone goes by numbers as it does by keys, through two rounds of refreshing and compacting."""
    rows = [(k, " ".join(f"w{k * j % 61}" for j in range(k % 9)) + " the a-the" * (k % 4)) for k in range(300)] + [(300, None), (301, ""), (302, "É the"), (None, "the w1")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    later = df.where("k % 5 = 1").withColumn("t", F.concat(F.lit("A the "), "t"))
    more = later.withColumn("k", F.col("k") + 1000)
    index = Index(spark, str(tmp_path / "i"), buckets=4).build(df, "k", "t")
    assert index.stored().where("bucket >= 0").count() < 40 < index.read("postings").count()
    index.refresh(later, df.where("k % 7 = 0"), "k", "t")
    first = df.where("k IS NULL OR k % 5 <> 1 AND k % 7 <> 0").unionByName(later)
    once = index.compact(str(tmp_path / "c"))
    once.refresh(more, df.where("k = 2 OR k = 6"), "k", "t")
    second = first.where("k IS NULL OR k NOT IN (2, 6)").unionByName(more)
    monkeypatch.setattr(index_module, "BITS", 0)
    by_keys = index.compact(str(tmp_path / "k"))
    monkeypatch.undo()
    found = lambda x, words, k="k": sorted(map(tuple, x.bm25(k, words).collect()), key=str)
    whole = once.compact(str(tmp_path / "d"))
    for held, docs, words in ((whole, second, ["the_a", "é", "w4"]), (by_keys, first, ["the", "w1"])):
        assert found(held, words) == found(index_module.Texts(docs, "k", "t"), words) != []
    assert found(index, ["the", "w1"]) == found(by_keys, ["the", "w1"])
    assert whole.top("k", ["the", "w4"], 5, whole=0).collect() == index_module.Texts(second, "k", "t").top("k", ["the", "w4"], 5).collect()
    assert whole.terms().where("term = 'the'").first()["df"] == second.where("lower(t) LIKE '%the%'").count()
