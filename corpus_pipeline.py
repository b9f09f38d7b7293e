"""The corpus pipeline: quality rules, near duplicates, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as
Parquet and reads again as the next stage's docs. All but the last keep the columns of documents. The stages can't be
told in SQL as a whole (packing isn't), so ORACLE_SQL is None and tests compare them with brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalint.llm import common, jaccard, packing, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.filter_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of smallest doc_id."""
    return jaccard.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind."""
    return pii.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.packed(docs)


STAGES = [("quality_rules", keep_quality), ("ngram_jaccard", drop_near_duplicates), ("pii", redact_personal_data), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        since = len(common.STAGED)
        stage(spark, docs, sf_dir).write.parquet(path)
        common.drop_staged(spark, since)  # what this stage staged; its result is written
        docs = spark.read.parquet(path)
    return docs
