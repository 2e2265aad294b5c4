"""Small helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch

#: Characters that count as white space in the text contracts.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def split_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on a long, string or binary column with what an aggregation made a row per key.

    The keys are compared in another spelling. Otherwise the aggregation's own partitions would serve the join, and
    a key with many rows on the left couldn't be split; so both sides have a shuffle, which adaptive execution may split.
    """
    long = dict(left.dtypes)[key] == "bigint"
    spelled = F.col(key).bitwiseXOR(F.lit(0x5DEECE66D)) if long else F.concat(F.col(key), F.col(key))
    other = right.select(*(c for c in right.columns if c != key), spelled.alias("__tm_key"))
    return left.withColumn("__tm_key", spelled).join(other, "__tm_key").drop("__tm_key")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table into the shared folder and read it back: what follows survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
