"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefall.llm import align, bands, bpe, decontaminate, langid, pii, repeats, rnnlm, rules, secrets, sharding, simhash, warc
from lodefall.llm.common import cut, discard, scratch
from lodefall.llm.oracles import ORACLES
from lodefall.session import table

TOKENIZER = "word_bpe_49k.json"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def fold_of(n: int) -> Column:
    """The contract's fold of a row: crc32 of doc_id as text, modulo n; a null doc_id has none."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold_of(5) != 0))
    held_out = F.coalesce(fold_of(5) == 0, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    # written out without payloads, since assembling reads the records several times
    records = cut(warc.read_archives(spark, path, payloads=False))
    discard(spark, path)
    captures = warc.assemble(records)
    page = F.regexp_extract(F.decode(F.get("metadata", F.lit(0))["block"], "UTF-8"), r"page-id: (-?\d+)", 1)
    refers = F.regexp_extract("capture.refers_to", r"^<urn:lodefall:capture:(-?\d+):", 1)
    damaged = F.when(F.col("capture.digest_ok") == F.lit(False), F.raise_error(F.concat(F.lit("payload damaged: "), "capture.record_id")).cast("string"))
    return captures.select(
        page.try_cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        damaged.otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        refers.try_cast("long").alias("refers_to"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (F.col("failures").bitwiseAND(F.lit(rules.BASE)) != 0).alias("base_failed"),
        rules.passes().alias("kept"),
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3's policy would let through without each of its rules."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.scores(table(spark, sf_dir, "documents"), fold_of(7) != 2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), 40)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op11_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.near_lines(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_language, op2_warc, op3_quality, op4_decontaminate, op5_pii, op6_simhash, op7_lm, op8_bpe, op9_shards, op10_secrets, op11_bands, op12_align, op13_repeats, quality_ablations)
}

__all__ = ["ORACLES", "QUERIES"]
