"""A corpus pipeline of five of the training-data operators: from documents to packed token sequences.

`STAGES` holds (name, function); each function takes (spark, docs, sf_dir) and returns the next stage's documents with
their columns unchanged, the last one the pieces of sequences. `run` applies them to the documents of a folder, with each
stage's result written as Parquet in the folder that the session names in `spark.checkpoint.dir` and read again, and
deleted when the next one is written.

Every stage takes nulls in any column, empty and very long texts, repeated rows, further columns of any names and empty
tables (an empty result). Ties: the least id stays in `near_dedup`; rows that are equal throughout are drawn together in
`mix`. Rows with null text go in `language_id`, as they hold no letters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import hyperminhash, langid, mixing, packing, secrets
from siltstone.llm.common import default_tokenizer, released, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without one clear language, go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by near-duplication, the one of least id stays."""
    return hyperminhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target weight draws it."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, one row per piece."""
    return packing.pack(docs, default_tokenizer())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix), ("packing", pack)]

#: The model, the sketches and the draws are not SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        if i:
            released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
