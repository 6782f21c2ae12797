"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import batch_queries, evidence_queries, fold_queries, graph_queries, index_queries, ledger_queries, likeness_queries, marts_queries, meeting_queries, search_queries, selection_queries, sheet_queries, stream_queries, taxonomy_queries

LANES = (marts_queries, search_queries, graph_queries, ledger_queries, stream_queries, index_queries, taxonomy_queries, evidence_queries, meeting_queries, sheet_queries, selection_queries, likeness_queries, fold_queries, batch_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for lane in LANES for name, f in lane.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for lane in LANES for name, sql in lane.ORACLES.items()}
