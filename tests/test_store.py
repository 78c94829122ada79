import os

import pytest
from pyspark.sql import functions as F

from lodefall.operators import intake, maintenance
from lodefall.operators.store import Conflict, Stored, cascaded


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "files")
    old = spark.range(200).select(F.col("id").alias("file_id"), F.lit("L").alias("lane"), F.concat(F.lit("h"), "id").alias("hash"))
    store = Stored(spark, path).create(old, "file_id", 16)
    before = files_of(path)
    new = spark.createDataFrame([(3, None, "x"), (777, "M", None)], "file_id int, lane string, hash string")  # another type of key
    touched = store.upsert(new, "file_id", ["lane"], ["hash"])
    assert 1 <= len(touched) <= 2 and store.versions() == [1, 2]
    assert rows(store.read()) == rows(maintenance.upsert(old, new, "file_id", ["lane"], ["hash"]))
    assert rows(store.read(version=1)) == rows(old)
    after = files_of(path)
    assert before.items() <= after.items()  # nothing that was there changed
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in after.keys() - before.keys()} <= set(touched)
    live = store.commit()["folders"]
    assert sum(f == store.commit(1)["folders"].get(b) for b, f in live.items()) >= 14
    assert store.vacuum() == len(touched) and store.versions() == [2]
    assert rows(store.read()) == rows(maintenance.upsert(old, new, "file_id", ["lane"], ["hash"]))


def test_failed_and_second_runs_leave_the_table(spark, tmp_path, monkeypatch):
    store = Stored(spark, str(tmp_path / "t")).create(spark.range(50).withColumnRenamed("id", "k"), "k", 4)
    want = rows(store.read())
    change = spark.range(1).withColumnRenamed("id", "k")
    with pytest.raises(Exception, match="broken"):
        store.apply(change, lambda old, x: old.withColumn("k", F.raise_error(F.lit("broken")).cast("long")))
    assert store.versions() == [1] and rows(store.read()) == want
    at = store.commit()
    other = Stored(spark, store.path)
    monkeypatch.setattr(other, "commit", lambda version=None: at)  # it read before the first one committed
    store.delete(change)
    with pytest.raises(Conflict):
        other.delete(change)
    assert store.versions() == [1, 2] and rows(store.read()) == [x for x in want if x != (0,)]
    with pytest.raises(ValueError, match="touch"):
        store.apply(change, lambda old, x: spark.range(50).withColumnRenamed("id", "k"))
    assert store.versions() == [1, 2]
    left = len([p for p in files_of(store.path)])
    store.vacuum()
    assert len(files_of(store.path)) < left and store.read().count() == 49
    with pytest.raises(Conflict):
        store.create(change, "k")
    with pytest.raises(FileNotFoundError):
        store.read(version=9)


def test_chunks_come_in_once(spark, tmp_path):
    extracted = spark.createDataFrame([(k, f"p{j}", f"text {k} {j}") for k in range(30) for j in (1, 2)] + [(99, "p1", None)], "file_id long, ref string, text string")
    old = intake.prepared(extracted).withColumn("embedded", F.lit(1))
    store = Stored(spark, str(tmp_path / "chunks")).create(old, "file_id", 8)
    new = intake.prepared(extracted.where("file_id < 4").withColumn("text", F.when(F.col("ref") == "p1", F.lit("new")).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(4, "p3", "")], extracted.schema)))
    want = rows(intake.upserted(old, new).drop("outcome").select(*old.columns))
    assert 0 < len(store.upsert_chunks(new)) <= 5
    assert rows(store.read()) == want
    assert store.read().where("embedded = 0").count() == 5
    assert store.upsert_chunks(new) == [] and store.versions() == [1, 2]


def test_cascade_and_vectors(spark, tmp_path):
    parents = spark.createDataFrame([(k, "n") for k in (*range(20), None)], "f long, n string")
    children = spark.createDataFrame([(k, j) for k in range(20) for j in range(3)] + [(None, 0)], "f long, j int")
    p, c = Stored(spark, str(tmp_path / "p")).create(parents, "f", 4), Stored(spark, str(tmp_path / "c")).create(children, "f", 8)
    assert cascaded(p, [c], spark.range(0).select(F.col("id").alias("f"))) == [[], []]
    cascaded(p, [c], spark.createDataFrame([(3,), (3,), (4,), (400,)], "f long"))
    assert rows(p.read()) == rows(parents.where("f is null or f not in (3, 4)"))
    assert rows(c.read()) == rows(children.where("f is null or f not in (3, 4)"))
    v = Stored(spark, str(tmp_path / "v")).create(spark.range(10).select("id", F.array(F.lit(1.0), "id").cast("array<float>").alias("vector")), "id", 4)
    v.merge(spark.createDataFrame([([0.5], 3), ([0.5], 12)], "vector array<float>, id long"), "id")
    got = {r["id"]: r["vector"] for r in v.read().collect()}
    assert len(got) == 11 and got[3] == [0.5] and got[12] == [0.5] and got[4] == [1.0, 4.0]


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "k string, v int")
    t = Stored(spark, str(tmp_path / "none")).create(none, "k", 4)
    assert t.read().count() == 0 and t.read().columns == ["k", "v"]
    t.merge(spark.createDataFrame([("a", 1)], "k string, v int"), "k")
    assert rows(t.read()) == [("a", 1)]
    t.delete(spark.createDataFrame([("a",)], "k string"))
    assert t.read().count() == 0 and t.versions() == [1, 2, 3]
