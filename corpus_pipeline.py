"""From raw documents to token ids: five stages, each over all that the stage before has kept.

Rows go to Python in small batches (`bound_batches`), so that an executor's memory does not depend on how many rows
Spark would put into one. Each stage is stored as Parquet in the shared folder and read again. Language
identification learns from the labelled documents it is given and keeps what it
can name (without labels nothing); the dedup stages keep one document of each group; decontamination
drops documents with a benchmark passage; the last stage encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from scoreloom.llm.common import bound_batches, stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = language.identify(docs, language.learn(docs, required=False))
    return found.where("NOT lang_found.rejected").select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("byte_bpe", encoding_stage),
]

# zstandard sizes and byte-pair merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
