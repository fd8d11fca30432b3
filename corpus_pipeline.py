"""A cleaning pipeline over the documents table: each stage reads what the one before it has written.

Toxic documents go, repeated runs of lines go, one document of each group of near duplicates stays, documents that hold test passages go, and what is left is encoded
into token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, line_dedup, near_dedup, sentencepiece_stream, toxicity
from weftgraph.llm._spark import stored, unused

#: Near duplicates share this part of their five-word shingles.
PERCENT = 80
MODEL = "piece_bpe_32k.model"
#: No SQL expresses the toxicity model or the encoder.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = unused(docs, "other")
    others = near_dedup.near_duplicates(docs, percent=PERCENT).where("doc_id is not null and not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(others, docs["doc_id"] == F.col(name), "left_anti")


def without_test_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encode(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_test_passages),
    ("sentencepiece", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
