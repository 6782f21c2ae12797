"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # temporary folders of local sessions without a shared one, by application


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local session without it gets a folder of its own, gone when Python ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quern-tables-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and scanned from there: computed once, and a lost executor costs no step before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n: int | None, *keys: str, each: int) -> DataFrame:
    """``df`` dealt out by ``keys`` into so many partitions that, of ``n`` rows (its own, or what is made of them), a task has about ``each``: what it holds does not grow with the table."""
    return df.repartition(max(1, math.ceil((n or 0) / each)), *keys)
