"""A corpus pipeline of five stages: quality, lines, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as a table and read again
as the next one's docs.  All but the last return the columns of documents.

Every stage takes nulls in any column, empty and very long texts, repeated rows, further columns and empty tables; what
it makes of them stands with each stage, and in more detail with the operator that it calls.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import decontaminate, line_dedup, packing, quality_classifier, simhash_dedup
from tidepool.llm.common import Workspace, read_documents

#: SQL cannot learn a classifier or count a tokenizer's tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    A null text is scored as the empty one; without labels of both kinds every document stays; repeated rows are judged each."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those of which no word is left go.

    Null and empty texts have no lines and stay as they are; repeated rows count as one document and come out each."""
    return line_dedup.cut_documents(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id.

    Null and empty texts are one group; rows without a doc_id stay; of repeated rows one stays."""
    return simhash_dedup.keep_one(spark, docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; null, empty and wordless items are found nowhere; repeated rows are judged each."""
    return decontaminate.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 1024 tokens.

    A null or empty text is one piece, the end token; rows with equal or null doc_id are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    work = Workspace(spark, "pipeline")
    docs = read_documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.write(docs, name)
    return docs
