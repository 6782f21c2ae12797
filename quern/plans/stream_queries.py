"""Queries that run a stream over all files that are there, with SQL twins on the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.streaming import increments


def stream_highwater(spark, d):
    events = increments.stream_table(spark, d, "events")
    return increments.run_available(increments.highwater(events, "user_id", "ts"), "complete")


def stream_event_windows(spark, d):
    """Events of each type by day, as a windowed aggregation with a watermark."""
    events = increments.stream_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    per = events.withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return increments.run_available(per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value"), "complete")


QUERIES = {f.__name__: f for f in (stream_highwater, stream_event_windows)}

ORACLES = {
    "stream_highwater": "SELECT user_id, max(ts) AS cursor, count(*) AS n FROM events GROUP BY user_id",
    "stream_event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
}
