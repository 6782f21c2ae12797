"""Sharding: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, written
from quern.llm.periodic import CRC_TABLE, crc_sql


def shard_by_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row per document.

    Size is the UTF-8 bytes of the text (null: none) plus 1. Documents stand in the
    order of doc_id (null last), then text_crc32 and size; a document goes to the shard
    in which the middle of its bytes falls when all bytes are cut into ``n_shards`` equal
    parts. So shards are contiguous, and each is within one document's size of the others.
    ``slot`` counts from 0 within the shard. ``law`` is ``bytes``, for which grown_shard is null.

    Only ids and sizes are moved. Rows are range-partitioned once; what reaches the
    driver is two numbers for each partition and each (partition, shard), never a row.
    Repeated rows each take their own slot. Empty table: empty result; other columns are ignored.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    ranged = sized.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    laid = written(
        ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_running, f"doc_id {dict(sized.dtypes)['doc_id']}, size long, text_crc32 long, part int, nth long, start long"),
        "shard-order",
    )
    totals = laid.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("part").collect()
    before, rows, run = [], 0, 0
    for t in totals:
        before.append((t["part"], rows, run))
        rows, run = rows + t["n"], run + t["bytes"]
    ahead = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, rows_before long, bytes_before long"))  # a row per partition
    cut = laid.join(ahead, "part").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(least({n_shards - 1}, (2 * (bytes_before + start) + size) * {n_shards} div {2 * max(run, 1)}) as int)").alias("shard"),
        (F.col("rows_before") + F.col("nth")).alias("place"),
    )
    first = F.broadcast(cut.groupBy("shard").agg(F.min("place").alias("first")))  # n_shards rows
    return cut.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a sorted partition and sum the sizes before each."""
    n = run = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = run + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(n, n + len(size))), pa.array(upto - size)], [*batch.schema.names, "nth", "start"])
        if len(size):
            n, run = n + len(size), int(upto[-1])


#: The query's rows in SQL, by one window over all rows.
SQL = f"""
WITH {CRC_TABLE}, d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, crc
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d
), t AS (
  SELECT *, CAST(least(7, (2 * start + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM s
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM t
"""
