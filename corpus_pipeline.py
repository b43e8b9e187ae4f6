"""The corpus pipeline: toxicity, near duplicates, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents (the
last one adds the token ids); ``run`` writes each stage as Parquet below
spark.checkpoint.dir and reads it again as the next one's input, so a lost
executor costs at most the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedmerge.llm import byte_bpe, decontamination, jaccard_join, pii, toxicity
from feedmerge.llm.runtime import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (trained on their labels)."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found span masked by its kind; no document goes."""
    return pii.redact_documents(docs, pii.train(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and whether they decode to the text."""
    coded = byte_bpe.code_documents(docs)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.withColumn("round_trip", F.col("decoded") == text).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_tokens),
]

#: SQL cannot express the classifier, the field and the merges; tests/llm
#: compares run() with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
