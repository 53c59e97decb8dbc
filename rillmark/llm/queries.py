"""The registered queries of this package; each runs its operator over a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import alignment, bpe, codes, jaccard, licenses, mainhtml, merkle, mixing, quality, sharding, simhash, syncmers, warc
from rillmark.llm.common import table
from rillmark.session import materialise, new_path

RANKS = "byte_bpe_multi_50k.tiktoken"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORD_BPE, END_ID = "word_bpe_49k.json", 2


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, path, pattern), path, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    records = materialise(warc.read(manifest, payload=False), "warc-records")
    return warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.rates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def op7_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "codes")
    codes.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), END_ID)
    return codes.read(spark.read.parquet(path)).drop("packed")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.compare_with_edited(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
                       syncmers.digest(F.col("sketch")).alias("fingerprint"),
                       syncmers.digest(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path_a, path_b = public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    rows = alignment.translation(table(spark, sf_dir, "documents"), path_a, path_b)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"n_chars": F.when(altered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    siblings = F.array_join(F.transform("path", lambda step: step["sibling"]), "")
    folded = F.element_at("version", -1)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
                       (folded == F.col("root")).alias("verified"))


REGISTERED = {query.__name__: query for query in (
    op1_bpe, op2_warc, op3_mixing, op4_licenses, op5_simhash, op6_quality, op7_codes, op8_sharding, op9_main_text, op10_syncmers,
    op11_alignment, op12_jaccard, op13_merkle)}
