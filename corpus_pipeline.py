"""A training-corpus pipeline: five stages, each written as Parquet and read by the next.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a
benchmark item go, personal data is replaced, and what is left is encoded into pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, pii, piece_codec, simhash, toxicity
from weftline.llm.queries import TOKENIZER
from weftline.llm.tables import key_remainder, read_table, shared_folder, small_batches


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; a fifth of the labels is left out of fitting, as in the operator's own query."""
    small_batches(spark)
    train = key_remainder(F.col("doc_id"), 5) != 0
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs of five-word similarity 0.8 or more connect, the document with the least id stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    small_batches(spark)
    return pii.redact(docs, pii.fit(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of each document, and the text they decode to."""
    small_batches(spark)
    model = piece_codec.load_model(TOKENIZER)
    return piece_codec.encode_documents(docs, model)


STAGES = [("toxicity", toxic), ("simhash_near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("pii", personal_data), ("sentencepiece", pieces)]

#: SQL can't express the stages' models; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs, folder = read_table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
