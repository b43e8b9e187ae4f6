"""The registered queries of the corpus operators (thin: digest columns only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.llm import (alignment, byte_bpe, decontamination, embedding_dedup, importance, jaccard_join, kneser_ney, pii, quality,
                           substring_dedup, token_counts, toxicity, wavelet)
from feedmerge.llm.runtime import fold, held_out, read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_in_documents(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = kneser_ney.train(docs.where(fold("doc_id", 7) != 2))
    return kneser_ney.score(docs, model).select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens",
                                                "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.code_documents(docs)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"),
                                             "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"),
                                              "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(read(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return jaccard_join.cluster(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stored = wavelet.read_documents(wavelet.write_shards(docs))
    return stored.select("doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
                         F.crc32("token_ids").alias("ids_crc32"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_wavelet": op12_wavelet,
    "op13_alignment": op13_alignment,
}

ORACLES: dict[str, str] = {
    "op10_decontamination": decontamination.ORACLE,
    "op11_importance": importance.ORACLE,
}
