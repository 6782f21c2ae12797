"""Incremental operators on Structured Streaming: high-water marks per key and rows not seen before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import shared_folder


def _state_dir(spark: SparkSession) -> str:
    """A folder for a stream's state, in the shared folder."""
    return f"{shared_folder(spark)}/quern-stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str, state: str | None = None) -> DataFrame:
    """Run a streaming DataFrame over all that is there and return its last result as a table.

    ``state``: the stream's folder; given again, the run goes on from where the last one ended.
    """
    spark = stream.sparkSession
    state = state or _state_dir(spark)
    out = f"{state}/out"

    def put(batch: DataFrame, epoch: int) -> None:
        # in complete mode every batch is the whole result; in append mode a batch run again replaces itself
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{state}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def highwater(events: DataFrame, key: str, at: str) -> DataFrame:
    """key, cursor, n: the latest time and number of rows of each key of a stream or table; the state is one row per key."""
    return events.groupBy(key).agg(F.max(at).alias("cursor"), F.count("*").alias("n"))


def first_seen(events: DataFrame, content: list[str], at: str, delay: str) -> DataFrame:
    """Rows whose content hash has not come within ``delay`` before; older hashes leave the state."""
    hashed = events.withColumn("content_hash", F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in content]), 256))
    return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["content_hash"])


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of one table as a stream, one file a batch."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    base = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if not _is_dir(spark, base) else reader.parquet(base)


def _is_dir(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
