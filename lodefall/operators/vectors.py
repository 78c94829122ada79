"""A stored inverted-file index of vectors: coarse lists, 8-bit residuals in them, exact distances at the end.

Folders under the index's path:
- centers: list and center (unit length), fitted by k-means on cosine over a bounded sample of the vectors;
- vectors: list (partition), key, segment, the kept attributes, the vector, and its residual to the list's center in 8-bit steps with
  the step's size; sorted by key in each file;
- gone: key and the segment in which the row was replaced or deleted;
- probes: how many lists a question reads by default: as many as a bounded sample of the vectors, asked over all lists, needs for RECALL. Vectors
  without structure need most of the lists; then the index saves little but the width of what is read.

A question goes to the lists whose centers are nearest and reads their residuals alone; filters hold before anything is ranked. The best
candidates by residual are read whole, by list and key, and ranked by their exact distance. Centers are bounded in number, so
they are given to tasks as they are; large lists are split over files and tasks like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.operators import search
from lodefall.session import ship

#: Lists at most and vectors that each has at least on average; vectors that centers are fitted on for each list; rounds of k-means.
LISTS, FILL, FIT, ROUNDS = 4096, 40, 64, 12
#: Questions that are asked when building (at most about), the neighbours of each that are looked for, and the part of them that the lists which a
#: question reads by default must hold; candidates that are read whole for each result.
ASKED, NEIGHBOURS, RECALL, WHOLE = 200, 20, 0.94, 10
#: Vectors and queries that are compared at once, and rows of queries (one for each list that they probe) that are made at once.
TILE, PROBED = 1024, 1 << 15


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero ones stay."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def rows_of(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


class VectorIndex:
    """An index of (key, vector) rows, and attributes for filters, at a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._centers: tuple[np.ndarray, np.ndarray] | None = None

    def read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def centers(self) -> tuple[np.ndarray, np.ndarray]:
        """The lists and their centers, LISTS at most."""
        if self._centers is None:
            found = sorted((r["list"], r["center"]) for r in self.read("centers").collect())
            self._centers = np.array([x for x, _ in found]), np.array([c for _, c in found])
        return self._centers

    def build(self, rows: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), seed: int = 5) -> VectorIndex:
        """Fits the centers and stores all vectors that aren't null, empty or of length 0."""
        self._centers = None
        good = self.good(rows, key, vector, keep)
        n = good.count()
        lists = max(1, min(LISTS, n // FILL, int(4 * n**0.5)))
        fraction = max(1, n // (FIT * lists))  # the sample: vectors whose key's hash is divisible by this
        some = good.where(F.pmod(F.xxhash64("key"), F.lit(fraction)) == 0).select(array_to_vector("vector").alias("features"))
        centers = [] if n == 0 else KMeans(k=lists, maxIter=ROUNDS, seed=seed, distanceMeasure="cosine").fit(some).clusterCenters()
        made = [(k, [float(x) for x in c]) for k, c in enumerate(unit(np.array(centers)) if len(centers) else [])]
        self.spark.createDataFrame(made, "list int, center array<double>").write.mode("overwrite").parquet(f"{self.path}/centers")
        self.write(good, 0, "overwrite")
        good.select("key", F.lit(0).alias("segment")).limit(0).write.mode("overwrite").parquet(f"{self.path}/gone")
        self.spark.createDataFrame([(self.needed(good, n),)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")
        return self

    def needed(self, good: DataFrame, n: int) -> int:
        """The least number of lists that hold RECALL of the neighbours of some of the vectors."""
        lists, centers = self.centers()
        some = good.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, n // ASKED))) == 0).limit(4 * ASKED)
        asked = {r["key"]: r["vector"] for r in some.select("key", "vector").collect()}
        if len(lists) < 2 or not asked:
            return max(1, len(lists))
        near = self.nearest_of_each(some.select("key", "vector"), "key", "vector", NEIGHBOURS, probes=len(lists)).select("query", "key")
        held = self.read("vectors").select("key", "list").join(F.broadcast(near), "key").select("query", "list").collect()  # ASKED * NEIGHBOURS rows or so
        order = {q: np.argsort(np.argsort(-(centers @ unit(np.array([v], np.float64))[0]), kind="stable")) for q, v in asked.items()}
        at = {x: k for k, x in enumerate(lists.tolist())}
        places = np.sort([order[r["query"]][at[r["list"]]] for r in held])
        return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))) - 1)]) + 1

    @staticmethod
    def good(rows: DataFrame, key: str, vector: str, keep: tuple[str, ...]) -> DataFrame:
        v = F.transform(vector, lambda x: x.cast("float"))
        return rows.select(F.col(key).alias("key"), *keep, v.alias("vector")).where("size(vector) > 0 and exists(vector, x -> x <> 0) and not exists(vector, x -> x is null or isnan(x))")

    def write(self, good: DataFrame, segment: int, mode: str) -> None:
        lists, centers = self.centers()
        given = self.spark.sparkContext.broadcast((lists, centers))
        coded = good.withColumns({"list": F.lit(0), "code": F.lit(b""), "step": F.lit(0.0)})
        names = coded.columns

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, centers = given.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = unit(rows_of(batch.column("vector")))
                best = np.concatenate([np.argmax(v[k : k + TILE] @ centers.T, axis=1) for k in range(0, len(v), TILE)])
                rest = v - centers[best]
                step = np.maximum(np.abs(rest).max(axis=1) / 127, 1e-12)
                codes = np.rint(rest / step[:, None]).astype(np.int8)
                made = {"list": pa.array(lists[best], pa.int32()), "code": pa.array([x.tobytes() for x in codes], pa.binary()), "step": pa.array(step)}
                yield pa.RecordBatch.from_arrays([made.get(x, batch.column(x) if x not in made else None) for x in names], names)

        ship(self.spark)
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
        out = coded.mapInArrow(code, kinds) if len(lists) else coded.limit(0)
        out.withColumn("segment", F.lit(segment)).hint("rebalance", "list").sortWithinPartitions("list", "key").write.mode(mode).partitionBy("list").parquet(f"{self.path}/vectors")

    def refresh(self, changed: DataFrame, deleted: DataFrame, key: str, vector: str, keep: tuple[str, ...] = ()) -> VectorIndex:
        """Adds new and changed vectors as a segment; their former versions and the deleted keys don't count any more. An index that was built
        of no vector has no lists, and is built of these."""
        if not len(self.centers()[0]):
            return self.build(changed, key, vector, keep)
        segment = (self.read("vectors").agg(F.max("segment")).first()[0] or 0) + 1
        segment = max(segment, (self.read("gone").agg(F.max("segment")).first()[0] or 0) + 1)
        keys = changed.select(F.col(key).alias("key")).unionByName(deleted.select(F.col(key).alias("key"))).distinct()
        keys.withColumn("segment", F.lit(segment)).write.mode("append").parquet(f"{self.path}/gone")
        self.write(self.good(changed, key, vector, keep), segment, "append")
        return self

    def compact(self, path: str) -> VectorIndex:
        """All that counts, as one segment at another path, with the same centers."""
        out = VectorIndex(self.spark, path)
        self.read("centers").write.mode("overwrite").parquet(f"{out.path}/centers")
        whole = self.live(self.read("vectors")).withColumn("segment", F.lit(0)) if len(self.centers()[0]) else self.read("gone").withColumn("list", F.lit(0)).limit(0)
        whole.hint("rebalance", "list").sortWithinPartitions("list", "key").write.mode("overwrite").partitionBy("list").parquet(f"{out.path}/vectors")
        self.read("gone").limit(0).write.mode("overwrite").parquet(f"{out.path}/gone")
        self.read("probes").write.mode("overwrite").parquet(f"{out.path}/probes")
        return out

    def live(self, rows: DataFrame) -> DataFrame:
        gone = self.read("gone").groupBy("key").agg(F.max("segment").alias("last"))
        return rows.join(gone, (rows["key"] == gone["key"]) & (rows["segment"] < gone["last"]), "left_anti")

    def probes(self, n: int | None) -> int:
        return min(len(self.centers()[0]), n or self.read("probes").first()[0])

    def nearest(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """key and distance (cosine, 4 places) of the k nearest of the probed lists; `where` is over the kept attributes."""
        lists, centers = self.centers()
        if not len(lists):
            return self.read("gone").select("key", F.lit(0.0).alias("distance")).limit(0)
        q = unit(np.array([query], np.float64))[0]
        near = lists[np.argsort(-(centers @ q), kind="stable")[: self.probes(probes)]].tolist()
        rows = self.live(self.read("vectors").where(F.col("list").isin(near)))
        rows = rows if where is None else rows.where(where)
        most, of_list = WHOLE * k, dict(zip(lists.tolist(), (centers @ q).tolist(), strict=True))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(batch.num_rows, -1)
                base = np.array([of_list[x] for x in batch.column("list").to_pylist()])
                score = base + (codes @ q) * batch.column("step").to_numpy()
                top = np.argsort(-score, kind="stable")[:most]
                part = batch.select(["key", "list"]).take(pa.array(top))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score[top])], ["key", "list", "score"])

        ship(self.spark)
        kind = rows.schema["key"].dataType.simpleString()
        found = rows.select("key", "list", "code", "step").mapInArrow(best, f"key {kind}, list int, score double").orderBy(F.desc("score"), "key").limit(most).collect()
        whole = self.live(self.read("vectors").where(F.col("list").isin(sorted({r["list"] for r in found})) & F.col("key").isin([r["key"] for r in found])))
        return search.knn(whole, "key", "vector", query, k)

    def nearest_of_each(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """query, key, distance and rank: the k nearest rows of each query row. Queries go to the lists they probe in blocks, and each block meets blocks
        of the list's vectors, so neither side is broadcast or gathered."""
        lists, centers = self.centers()
        given, n = self.spark.sparkContext.broadcast((lists, centers)), self.probes(probes)
        kinds = queries.schema[key].dataType.simpleString(), self.read("vectors").schema["key"].dataType.simpleString()

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, centers = given.value
            for batch in batches:
                # a query has a row for each list, so a batch of them is cut
                step = max(1, PROBED // max(1, n))
                for c in range(0, batch.num_rows, step):
                    part = batch.slice(c, step)
                    v = unit(rows_of(part.column("vector")))
                    near = lists[np.argsort(-(v @ centers.T), axis=1, kind="stable")[:, :n]]
                    at = np.repeat(np.arange(part.num_rows), near.shape[1])
                    vs = pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int32()), part.column("key").take(pa.array(at)), vs], ["list", "query", "v"])

        def blocks(id_name: str):  # noqa: ANN202
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:  # rows come sorted by list
                    of = batch.column("list").to_numpy()
                    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else []
                    for a, b in zip(starts, np.r_[starts[1:], len(of)] if len(of) else [], strict=True):
                        for c in range(a, b, TILE):
                            part = batch.slice(c, min(TILE, b - c))
                            vs = b"".join(part.column("v").to_pylist())
                            yield pa.RecordBatch.from_arrays([pa.array([int(of[a])], pa.int32()), pa.array([part.column(id_name).to_pylist()], pa.list_(part.column(id_name).type)), pa.array([vs], pa.binary())], ["list", "ids", "vs"])

            return run

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    qs, ks = batch.column("queries")[r], batch.column("ids")[r]
                    score = np.frombuffer(batch.column("qv")[r].as_buffer(), np.float64).reshape(len(qs), -1) @ np.frombuffer(batch.column("vs")[r].as_buffer(), np.float64).reshape(len(ks), -1).T
                    distance = np.round(1 - score, 4) + 0.0  # no negative zero; rows come in order of their keys, which breaks ties
                    top = np.argsort(distance, axis=1, kind="stable")[:, :k]
                    at = np.repeat(np.arange(len(qs)), top.shape[1])
                    yield pa.RecordBatch.from_arrays([qs.values.take(pa.array(at)), ks.values.take(pa.array(top.ravel())), pa.array(distance[at, top.ravel()])], ["query", "key", "distance"])

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = unit(rows_of(batch.column("vector")))
                    yield pa.RecordBatch.from_arrays([batch.column("list"), batch.column("key"), pa.array([x.tobytes() for x in v], pa.binary())], ["list", "key", "v"])

        ship(self.spark)
        asked = self.good(queries, key, vector, ()).mapInArrow(probed, f"list int, query {kinds[0]}, v binary")
        asked = asked.repartition("list").sortWithinPartitions("list").mapInArrow(blocks("query"), f"list int, ids array<{kinds[0]}>, vs binary").withColumnsRenamed({"ids": "queries", "vs": "qv"})
        rows = self.live(self.read("vectors").select("list", "key", "segment", "vector")).mapInArrow(whole, f"list int, key {kinds[1]}, v binary")
        rows = rows.sortWithinPartitions("list", "key").mapInArrow(blocks("key"), f"list int, ids array<{kinds[1]}>, vs binary")
        met = asked.join(rows.hint("merge"), "list").select("queries", "qv", "ids", "vs").mapInArrow(compared, f"query {kinds[0]}, key {kinds[1]}, distance double")
        first = F.slice(F.array_sort(F.collect_list(F.struct("distance", "key"))), 1, k)  # k of each block that a query meets
        found = met.groupBy("query").agg(first.alias("xs")).select("query", F.posexplode("xs").alias("at", "x"))
        return found.select("query", "x.key", "x.distance", (F.col("at") + 1).alias("rank"))
