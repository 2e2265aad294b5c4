"""A corpus pipeline of four stages over the documents of a folder.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept: documents that the quality
classifier rejects go, repeated lines go, one document of each group of near duplicates stays, and what is left is packed
into sequences. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, near_documents, packing, quality
from tidemark.llm.common import stored, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_new_lines(docs)


def first_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_documents.keep_first(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", new_lines),
    ("simhash_near_dedup", first_of_near),
    ("packing", packed),
]

#: The model of the first stage can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
