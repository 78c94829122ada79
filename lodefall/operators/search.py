"""Retrieval: keyword search over the stored index, exact cosine neighbours, their hybrid, scopes, snippets and paging."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodefall.functions.text import boosted_terms, snippet
from lodefall.operators import routing
from lodefall.operators.index import Index
from lodefall.operators.paths import file_name
from lodefall.session import ship

#: Results that a lane gives per result asked for, results by default, and the vector lane's weight.
LANE, TOP, ALPHA = 3, 5, 0.6
#: Filters that compare a file's attribute.
EQUAL = ("project_id", "typology", "extension", "content_type", "folder_stage")


def project_scope(cards: DataFrame, filters: dict, home: str = "") -> DataFrame | None:
    """The project ids that a location and a typology (primary or secondary) leave, or None where neither is asked for: no
    scope at all, which is not a scope that no project is in. The location `overseas` is any but `home`."""
    location, typology = filters.get("location"), filters.get("typology")
    if not location and not typology:
        return None
    if typology:
        cards = cards.where(F.col("typology_primary").ilike(f"%{typology}%") | F.col("typology_secondary").ilike(f"%{typology}%"))
    if location == "overseas":
        cards = cards.where(F.col("location").isNotNull() & ~F.col("location").ilike(f"%{home}%"))
    elif location:
        cards = cards.where(F.col("location").ilike(f"%{location}%"))
    return cards.where("project_code is not null").select(F.col("project_code").alias("project_id")).distinct()


def scoped(files: DataFrame, filters: dict) -> DataFrame:
    """The files that all filters let through: attributes by equality, `root` by the beginning of the path (in any case, and
    with its % and _ as wildcards), `project_ids` by a list (an empty one lets nothing through) or a table of project_id."""
    for c in EQUAL:
        if filters.get(c) is not None:
            files = files.where(F.col(c) == filters[c])
    if filters.get("root") is not None:
        files = files.where(F.col("file_path").ilike(filters["root"].rstrip("/").replace("\\", "\\\\") + "/%"))
    among = filters.get("project_ids")
    if isinstance(among, DataFrame):
        files = files.join(among, "project_id", "left_semi")
    elif among is not None:
        files = files.where(F.col("project_id").isin(list(among)) if len(among) else F.lit(False))
    return files


def relative(path: Column, roots: list[str] = ()) -> Column:
    """The path behind the first root that holds it, else its name."""
    out = F.coalesce(*(F.when(path.startswith(r.rstrip("/") + "/"), F.substr(path, F.lit(len(r.rstrip("/")) + 2))) for r in roots), file_name(path)) if roots else file_name(path)
    return F.when(path.isNotNull(), out)


def citation(path: Column, ref: Column, roots: list[str] = ()) -> Column:
    """path#ref with the path behind its root; of several roots, the name of the one that holds it stands before it in brackets."""
    plain = F.concat(relative(path, roots), F.lit("#"), ref)
    if len(roots) < 2:
        return plain
    label = F.coalesce(*(F.when(path.startswith(r.rstrip("/") + "/"), F.lit(f"[{r.rstrip('/').rsplit('/', 1)[-1]}] ")) for r in roots), F.lit(""))
    return F.concat(label, plain)


def search(
    index: Index, chunks: DataFrame, files: DataFrame, question: str, filters: dict | None = None, expansions: list[str] = (), near: DataFrame | None = None, top: int = TOP, offset: int = 0,
    roots: list[str] = (), present: DataFrame | None = None,
) -> DataFrame:
    """The `top` results after the first `offset`: rank, chunk_id, file_id, ref, file_path, rel_path, final_score, snippet and citation.

    chunks: chunk_id, file_id, ref, text; files: file_id, file_path and the attributes of filters. `near` (chunk_id and
    distance, from knn) is the vector lane; without it the keyword lane alone ranks. Files outside the filters don't take
    places in either lane. `present` (file_path) is what a scan has found: results whose file it lacks, or that have no ref, don't count
    for `top`, but they do for `offset`.

    The candidates of both lanes, LANE * (top + offset) each, are fetched here, so that texts and files are read by their ids: with
    tables sorted by id that is a few row groups, however large they are.
    """
    spark, most = chunks.sparkSession, LANE * (top + offset)
    terms = boosted_terms(question, list(expansions))
    word = index.bm25("chunk_id", terms) if filters else index.top("chunk_id", terms, most)
    if filters:
        inside = scoped(files, filters).select("file_id")
        keys = chunks.select("chunk_id", "file_id").join(inside, "file_id", "left_semi").select("chunk_id")
        word, near = word.join(keys, "chunk_id", "left_semi"), None if near is None else near.join(keys, "chunk_id", "left_semi")
    word = fetched(spark, word.orderBy(F.desc("bm25"), "chunk_id").limit(most))
    if near is None:
        both = normalized(word, "bm25", "bm25_score").select("chunk_id", F.round("bm25_score", 6).alias("final_score"))
    else:
        both = hybrid(word, fetched(spark, near.orderBy("distance", "chunk_id").limit(most)), "chunk_id").select("chunk_id", "final_score")
    both = fetched(spark, both)  # 2 * `most` rows at most
    wanted = chunks.where(F.col("chunk_id").isin([r["chunk_id"] for r in both.collect()]))
    of_files = sorted({r["file_id"] for r in wanted.select("file_id").distinct().collect()} - {None})
    named = both.join(wanted, "chunk_id").join(files.where(F.col("file_id").isin(of_files)).select("file_id", "file_path"), "file_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("final_score"), "file_path", "chunk_id")))
    part = snippet(F.col("text"), [t for p in boosted_terms(question, list(expansions)) for t in [p.lower()]])
    path, ref = F.col("file_path"), F.col("ref")
    valid = ranked.where((F.col("rank") > offset) & (F.coalesce(ref, F.lit("")) != ""))
    if present is not None:
        valid = valid.join(present.where(F.col("file_path").isin([r["file_path"] for r in ranked.select("file_path").collect()])).select("file_path").distinct(), "file_path", "left_semi")
    return valid.orderBy("rank").limit(top).select(
        "rank", "chunk_id", "file_id", "ref", "file_path", relative(path, list(roots)).alias("rel_path"), "final_score", part.alias("snippet"), citation(path, ref, list(roots)).alias("citation")
    )


def asked(index: Index, chunks: DataFrame, files: DataFrame, question: str, synonyms: DataFrame, codes: DataFrame | None = None, **more) -> DataFrame:  # noqa: ANN003
    """`search` with the question's expansions out of a table of synonyms, and with what it says of its files as filters where `files` has
    that attribute: content_type, folder_stage and the known project."""
    spark = chunks.sparkSession
    row = routing.classified(spark.createDataFrame([(question,)], "question string"), "question", synonyms, codes if codes is not None else ()).first()
    said = {"project_id": row["filters"].get("project_code"), **{c: row["filters"].get(c) for c in ("content_type", "folder_stage")}}
    filters = {c: v for c, v in said.items() if v is not None and c in files.columns}
    return search(index, chunks, files, question, filters | (more.pop("filters", None) or {}), expansions=list(row["expanded_terms"]), **more)


def fetched(spark: SparkSession, few: DataFrame) -> DataFrame:
    """The rows of a limited frame, computed once."""
    return spark.createDataFrame(few.collect(), few.schema)


def knn(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """key and distance (cosine, 4 places) of the k nearest rows; exact, filtered before ranking, with no shuffle of vectors."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(v, q) / F.sqrt(dot(v, v) * F.lit(sum(float(x) ** 2 for x in query)))
    return rows.select(key, F.round(1 - cosine, 4).alias("distance")).orderBy("distance", key).limit(k)


def normalized(df: DataFrame, score: str, out: str) -> DataFrame:
    """Min-max to 0..1 over the fetched rows, which are few; a single or constant score is 1."""
    all_rows = Window.partitionBy(F.lit(0))
    low, high = F.min(score).over(all_rows), F.max(score).over(all_rows)
    return df.withColumn(out, F.when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def hybrid(keyword: DataFrame, near: DataFrame, key: str, alpha: float = 0.6) -> DataFrame:
    """key, bm25_score, vector_score and final_score; a row of one lane only has 0 in the other."""
    b = normalized(keyword, "bm25", "bm25_score").select(key, "bm25_score")
    v = normalized(near.withColumn("sim", F.greatest(1 - F.col("distance"), F.lit(0.0))), "sim", "vector_score").select(key, "vector_score")
    both = b.join(v, key, "full").select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bm25_score", "vector_score")))
    final = alpha * F.col("vector_score") + (1 - alpha) * F.col("bm25_score")
    return both.select(key, *(F.round(c, 6).alias(c) for c in ("bm25_score", "vector_score")), F.round(final, 6).alias("final_score"))


def page(ranked: DataFrame, order: list[Column], valid: DataFrame, key: str, offset: int, k: int) -> DataFrame:
    """Ranks the (few, already limited) candidates, skips `offset` of them, and keeps the first k whose key is valid."""
    rank = F.row_number().over(Window.orderBy(*order))
    return ranked.withColumn("rank", rank).where(F.col("rank") > offset).join(valid, key, "left_semi").orderBy("rank").limit(k)


def rollup(results: DataFrame, parent: str, name: str, score: str) -> DataFrame:
    """Directories with at least two results: 0.95 of the best score and the first three names."""
    names = F.sort_array(F.collect_list(name))
    out = results.groupBy(parent).agg(F.count("*").alias("n"), F.round(0.95 * F.max(score), 6).alias("score"), names.alias("ns")).where("n >= 2")
    more = F.when(F.col("n") > 3, F.concat(F.lit(" +"), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return out.select(parent, "n", "score", F.concat(F.array_join(F.slice("ns", 1, 3), ", "), more).alias("names"))


def reranked(ranked: DataFrame, rank: str, question: str, text: str, top: int, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """Reorders the first `top` rows (by `rank`, from 1) by an injected scorer, which sees no other text; the tail and, without a scorer, all
    rows stay where they are. Ties and texts without a score go by `rank`, these last."""
    if scorer is None:
        return ranked.withColumn("new_rank", F.col(rank))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(question, texts.fillna("").tolist()), dtype="float64")

    ship(ranked.sparkSession)
    head = ranked.where(F.col(rank) <= top).withColumn("__lodefall_score", score(F.col(text)))
    tail = ranked.where(F.coalesce(F.col(rank) > top, F.lit(True)))
    order = Window.orderBy(F.desc_nulls_last("__lodefall_score"), rank)  # `top` rows
    return head.withColumn("new_rank", F.row_number().over(order)).drop("__lodefall_score").unionByName(tail.withColumn("new_rank", F.col(rank).cast("int")))


def embedded(chunks: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """key and embedding of the chunks with text, by an injected batch function, an Arrow batch at a time. If a batch
    fails, its texts are tried one by one; those that fail again have null."""

    def one(t: str) -> list[float] | None:
        try:
            return list(embed([t])[0])
        except Exception:  # noqa: BLE001 - whatever the injected function raises
            return None

    def run(batches):
        for batch in batches:
            texts = batch["_text"].tolist()
            try:
                out = [list(v) for v in embed(texts)] if texts else []
            except Exception:  # noqa: BLE001
                out = [one(t) for t in texts]
            yield pd.DataFrame({key: batch[key], "embedding": out})

    rows = chunks.select(key, F.col(text).alias("_text")).where(F.trim(F.coalesce("_text", F.lit(""))) != "")
    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, embedding array<float>")


def evidence(ranked: DataFrame, by: str, rank: str, citation: str, text: str, top: int = 3) -> DataFrame:
    """The first results of each question as one numbered text."""
    few = ranked.where(F.col(rank) <= top)
    line = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.col(citation).cast("string"), F.lit("\n"), F.coalesce(text, F.lit("")))
    return few.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"))
