"""Exact dedup on built-in functions only: group by a 128-bit content hash, compare bytes, keep the smallest id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ASCII_SPACE, text_of


def normalised(column: str = "text") -> Column:
    """Each run of ASCII white space becomes one space; nothing else changes."""
    return F.regexp_replace(text_of(column), ASCII_SPACE, " ")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hash_of=md5_128) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Distinct texts are found by grouping on (128-bit hash, text): the hash picks the partition, and the grouping
    compares the bytes, so a collision of the hash yields two groups. The partial aggregation leaves one row per
    text and task before the shuffle, so a text that a third of all rows share costs one row per task. Documents then
    meet their group by (128-bit hash, SHA-256) without their texts; adaptive execution splits a hot key there. Two
    different texts with equal values of both raise an error instead of being merged.

    Null text counts as empty. A null id never wins over another id; a group of null ids only has keep_id null and
    its rows kept. Rows repeated with the same id and text share keep_id, and all carry kept = true where that id is
    the smallest. An empty table gives an empty result. Other columns are not read.
    """
    keyed = (
        docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
        .withColumn("hash", hash_of(F.col("norm")))
    )
    texts = keyed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    both = F.concat("hash", F.unhex("sha"))  # a key of its own, so that the join has shuffles that can be split
    groups = (
        texts.select("hash", F.sha2("norm", 256).alias("sha"), "keep_id", "n")
        .groupBy("hash", "sha")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
        .withColumn(
            "keep_id",
            F.when(F.col("texts") == 1, F.col("keep_id")).otherwise(
                F.raise_error(F.concat(F.lit("two texts share the SHA-256 "), F.col("sha")))
            ),
        )
        .select(both.alias("key"), "keep_id", "group_size")
    )
    ids = keyed.select("doc_id", "hash", F.sha2("norm", 256).alias("sha")).select("doc_id", "sha", both.alias("key"))
    return ids.join(groups, "key").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, dropped ones too.

    Null text is empty; null ids are kept, repeated rows stay repeated, an empty table has no rows. Other columns aren't read.
    """
    from tidemark.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
