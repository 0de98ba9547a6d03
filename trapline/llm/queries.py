"""Registered queries of the operators, and the SQL that must give the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import (bpe, embedding_dedup, filter_audit, infill, kneser_ney, line_dedup, mixing,
                          ngram_join, quality, sharding, sql, token_files, topk, warc)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, folder, "embeddings"), cosine=0.98)


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    index, store = warc.write(table(spark, folder, "pages"))
    return warc.read(index, store, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"), words=3, similarity=(90, 100))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"),
                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                      digests=True)


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(table(spark, folder, "documents"), 24).withColumn(
        "grown_shard", F.lit(None).cast("int"))


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    index, store = token_files.write(table(spark, folder, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"),
                                     special=True)
    return token_files.read(index, store, digest=True)


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failing(table(spark, folder, "documents"),
                                                   table(spark, folder, "labels")))


def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs, out = table(spark, folder, "documents"), kneser_ney.held_out(F.col("doc_id"))
    scored = kneser_ney.score(docs, kneser_ney.train(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         F.round("base_score", 6).alias("base_score"),
                         F.round("score", 6).alias("score"))


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    cut = infill.infill(table(spark, folder, "documents"))
    back = infill.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_dedup, op2_mixing, op3_warc, op4_topk, op5_ngram_join, op6_bpe, op7_sharding,
    op8_token_files, op9_line_dedup, op10_quality, op11_filter_audit, op12_lm_scoring,
    op13_infill)}
ORACLES = sql.ORACLES
