"""Discovery by tasks over a folder tree, again after changes."""

import os

import pytest
from pyspark.sql import functions as F

from lodefall.sources import files, walk


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "archive"
    for k in range(40):
        folder = root / f"p{k % 5}" / f"s{k % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{k}.{'txt' if k % 2 else 'dwg'}").write_text(f"text {k}")
    (root / "p1" / "cache" / "deep").mkdir(parents=True)
    (root / "p1" / "cache" / "deep" / "no.txt").write_text("never")
    (root / "p2" / "big.txt").write_text("x" * 5000)
    (root / "p2" / "notes.tmp").write_text("x")
    os.symlink("/nowhere/at/all", root / "p3" / "gone.txt")
    os.symlink("/proc/self/mem", root / "p4" / "unreadable.txt")
    return root


def run(spark, root, known, **how):
    table, counts = walk.discovered(spark, [str(root), str(root / "none")], known, exclude=["**/cache/**", "*.tmp"], max_bytes=1000, **how)
    return {r["path"][len(str(root)) + 1 :]: r for r in table.collect()}, counts.first().asDict(), table


@pytest.mark.filterwarnings("ignore:no such folder")
@pytest.mark.parametrize("sampled", [False, True])
def test_runs_of_discovery(spark, tree, sampled):
    none = spark.createDataFrame([], walk.FILE + ", project_id string")
    first, counts, table = run(spark, tree, none, sampled=sampled)
    assert counts == {"total": 43, "discovered": 40, "skipped": 1, "failed": 2, "unchanged": 0}
    assert not any("cache" in p or p.endswith(".tmp") for p in first) and len(first) == 43
    assert (first["p2/big.txt"]["status"], first["p2/big.txt"]["lane"], first["p2/big.txt"]["error_code"]) == ("SKIPPED", "SKIPPED", "OVERSIZED")
    assert (first["p3/gone.txt"]["status"], first["p3/gone.txt"]["error_code"]) == ("FAILED", "STAT_ERROR")
    assert (first["p4/unreadable.txt"]["status"], first["p4/unreadable.txt"]["error_code"]) == ("FAILED", "READ_ERROR")
    assert {r["lane"] for p, r in first.items() if p.endswith(".dwg")} == {"METADATA_ONLY"}
    content = spark.createDataFrame([(bytearray(b"text 7"),)], "c binary").select(files.fingerprint(F.col("c"), sampled)).first()[0]
    assert next(r for p, r in first.items() if p.endswith("/f7.txt"))["fingerprint"] == content

    # as if all were indexed since, one touched, one changed in time alone, one deleted, one new
    indexed = table.withColumns({"status": F.when(F.col("status") == "DISCOVERED", "INDEXED").otherwise(F.col("status")), "project_id": F.lit("P")})
    indexed = spark.createDataFrame(indexed.collect(), indexed.schema)
    path = {k: next(p for p in first if p.endswith(f"/f{k}.txt")) for k in (1, 3, 5)}
    (tree / path[1]).write_text("another text")
    os.utime(tree / path[3], (1, 1))
    (tree / path[5]).unlink()
    (tree / "p0" / "new.txt").write_text("new")
    second, counts, _ = run(spark, tree, indexed, sampled=sampled)
    assert counts == {"total": 43, "discovered": 2, "skipped": 1, "failed": 2, "unchanged": 38}
    assert (second[path[1]]["status"], second[path[1]]["project_id"], second["p0/new.txt"]["status"]) == ("DISCOVERED", "P", "DISCOVERED")
    assert second[path[3]]["status"] == second[path[5]]["status"] == "INDEXED" and second["p0/new.txt"]["project_id"] is None
    assert second[path[1]]["fingerprint"] != first[path[1]]["fingerprint"]


def test_unchanged_files_are_not_read(spark, tree, tmp_path):
    table, _ = walk.discovered(spark, [str(tree)], spark.createDataFrame([], walk.FILE))
    rows = [r.asDict() | {"status": "INDEXED", "fingerprint": "kept", "error_code": None, "error_detail": None} for r in table.where("error_code is null").collect()]
    again, counts = walk.discovered(spark, [str(tree)], spark.createDataFrame(rows, table.schema))
    # were they read, their fingerprints would differ from the ones that are kept
    assert counts.first()["unchanged"] == len(rows) and {r["fingerprint"] for r in again.where("status = 'INDEXED'").collect()} == {"kept"}


def test_folders_are_partitions(spark, tree, monkeypatch):
    assert walk.walked(spark, [str(tree)]).rdd.getNumPartitions() > 5
    monkeypatch.setattr(walk, "PARTS", 3)
    reader = walk.Walk([str(tree)], frozenset({"cache"}))
    parts = reader.partitions()
    assert len(parts) == 6 and [p.deep for p in parts] == [False, True, True, True, True, True]
    found = [x[0] for p in parts for x in reader.read(p)]
    assert len(found) == len(set(found)) == 44 and not any("cache" in x for x in found)
    opened = []
    monkeypatch.setattr(walk.os, "scandir", lambda x, real=os.scandir: opened.append(x) or real(x))
    list(x for p in reader.partitions() for x in reader.read(p))
    assert opened and not any("cache" in x for x in opened)
    assert list(walk.Walk(["/nowhere"], frozenset()).read(walk.Folder("/nowhere", True))) == []
