"""A training corpus from documents: quality rules, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. A stage's
result is written as Parquet in the shared folder and reread as the next one's docs, so no stage is
computed again and lost executors cost only tasks. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from viewframe.llm.common import table, written
from viewframe.llm.exact_dedup import keep_first
from viewframe.llm.mixing import mixed
from viewframe.llm.quality import keep_good
from viewframe.llm.simhash import keep_one
from viewframe.llm.token_queries import CODE_VOCABULARY, code_digests, public


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return code_digests(docs, public(CODE_VOCABULARY))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The near-dedup's XXH64 fingerprints and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
