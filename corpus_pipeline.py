"""The corpus pipeline: quality, near-duplicates, personal data, mixing, token ids.

Each stage takes the documents that its predecessor kept and returns documents; the last returns their token ids' digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmark.llm import bpe, common, mixing, pii, quality, queries, simhash

#: The stages learn, draw and encode, which SQL can't express; tests/llm holds them against a plain version.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates; n_chars follows the text."""
    done = pii.surrogates(docs, queries.SURROGATE_KEY, "_n_replaced").drop("_n_replaced")
    return done.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shuffled within the shards that the files follow."""
    return mixing.mixed(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(docs, queries.TOKENIZER)


STAGES = [("quality classifier", quality_classifier), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix_sources), ("token ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
