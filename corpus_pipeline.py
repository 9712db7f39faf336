"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixture.

Each stage takes the documents its predecessor kept, and its decisions take
effect; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabveil.llm import decontaminate, mixing, ngram_join, pii_boost, quality_rules
from tabveil.session import scratch_path


# Texts go to Python workers in batches of so many bytes, so that a batch of long
# documents takes no more memory than one of short ones.
BATCH_BYTES = 4 * 1024 * 1024


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return quality_rules.keep_passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return pii_boost.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return mixing.mix(docs)[0]


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixture", mixture)]

# The trees of the personal data stage and the block permutation are not stated in SQL;
# tests/llm holds the operators behind the first four stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
