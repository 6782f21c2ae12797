"""Parquet tables of one data directory, and the column degradation rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as a lazy scan; filters and column choice reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select exactly ``schema``; a column the input lacks becomes a typed NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
