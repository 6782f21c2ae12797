"""Keeping an index in step with its corpus: upserts, cascades, supersession, deltas, queues and health.

Unless a function says otherwise: a null key takes no part; equal rows count once; empty tables give empty results;
columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import dealt


def upsert_plan(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """id, action, content_hash, status: what an upsert does to each id of ``incoming`` (id, content_hash) and of ``stored`` (id, content_hash, status).

    ``embed`` if the id is new or its hash differs (a null hash differs from any), ``keep`` if it is the same, ``remove`` if only stored. A stored status stays; a new row is ACTIVE.
    Ids are unique on each side.
    """
    s = stored.filter("id is not null").select("id", F.col("content_hash").alias("old"), "status", F.lit(True).alias("has"))
    n = incoming.filter("id is not null").select("id", F.col("content_hash").alias("new"), F.lit(True).alias("comes"))
    action = F.when(F.col("comes").isNull(), "remove").when(F.col("has") & F.coalesce(F.col("old") == F.col("new"), F.lit(False)), "keep").otherwise("embed")
    return s.join(n, "id", "full").select("id", action.alias("action"), F.coalesce("new", "old").alias("content_hash"), F.coalesce("status", F.lit("ACTIVE")).alias("status"))


def cascade(deleted: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Each table without the rows of which one of its key columns is an id of ``deleted`` (id). Rows with a null key stay."""
    ids = deleted.select("id").filter("id is not null").distinct()
    out = {}
    for name, (df, keys) in tables.items():
        for k in keys:
            df = df.join(ids.withColumnRenamed("id", "__gone"), F.col(k) == F.col("__gone"), "left_anti")
        out[name] = df
    return out


def supersede_by_date(chunks: DataFrame, dates: DataFrame, before) -> DataFrame:
    """``chunks`` (id, source, status, owned) with status and owned as a cutoff date sets them.

    ACTIVE chunks of sources whose ``event_date`` (dates: source, event_date) is before the cutoff become SUPERSEDED and owned;
    chunks that are owned and whose source is not before it any more (or has no date) become ACTIVE again. Marks of others (owned false) stay. Null status: ACTIVE.
    """
    d = dates.groupBy("source").agg(F.max("event_date").alias("event_date"))
    old = F.coalesce(F.col("event_date") < F.lit(before).cast("timestamp"), F.lit(False))
    status, owned = F.coalesce("status", F.lit("ACTIVE")), F.coalesce("owned", F.lit(False))
    mark, free = (status == "ACTIVE") & old, owned & ~old
    return chunks.join(d, "source", "left").select(
        "id", "source", F.when(mark, "SUPERSEDED").when(free, "ACTIVE").otherwise(status).alias("status"), F.when(mark, True).when(free, False).otherwise(owned).alias("owned")
    )


def supersede_source(chunks: DataFrame, source: str, valid_to) -> DataFrame:
    """``chunks`` (id, source, status, valid_to) with every chunk of ``source`` SUPERSEDED from ``valid_to`` on; an end that is set already stays."""
    hit = F.coalesce(F.col("source") == source, F.lit(False))
    return chunks.select("id", "source", F.when(hit, "SUPERSEDED").otherwise(F.col("status")).alias("status"), F.when(hit, F.coalesce("valid_to", F.lit(valid_to).cast("timestamp"))).otherwise(F.col("valid_to")).alias("valid_to"))


def raw_delta(before: DataFrame, after: DataFrame, reachable: DataFrame) -> DataFrame:
    """path, state of every path of two scans (root, path, sha): added, changed, unchanged, removed, or unavailable if its root is not in ``reachable`` (root).

    A path whose root cannot be reached now is never removed.
    """
    b = before.select("root", "path", F.col("sha").alias("old"), F.lit(True).alias("was"))
    a = after.select("root", "path", F.col("sha").alias("new"), F.lit(True).alias("now"))
    r = reachable.select("root").distinct().withColumn("up", F.lit(True))
    state = (
        F.when(F.col("was").isNull(), "added").when(F.col("now").isNull() & F.col("up").isNull(), "unavailable").when(F.col("now").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    )
    return b.join(a, ["root", "path"], "full").join(r, "root", "left").select("path", state.alias("state"))


def mismatches(manifest: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """key, side: keys that only the manifest or only the scan has."""
    own = lambda df, scan: df.select(key, F.lit(scan).alias("scan")).filter(F.col(key).isNotNull())
    both = own(manifest, 0).unionByName(own(scanned, 1))
    per = dealt(both, both.count(), key, each=4_000_000).groupBy(key).agg(F.min("scan").alias("least"), F.max("scan").alias("most"))
    return per.filter("least = most").select(key, F.when(F.col("least") == 0, "manifest").otherwise("scan").alias("side"))


def duplicate_contents(files: DataFrame, path: str, sha: str) -> DataFrame:
    """sha, n_paths, first_path of each content that stands at more than one path; a null sha is no content."""
    g = files.filter(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("sha")).agg(F.count_distinct(path).alias("n_paths"), F.min(path).alias("first_path"))
    return g.filter("n_paths > 1")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """lane, n, status: rows of each table; ``degraded`` if it has none."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("lane"), "n")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("status", F.when(F.col("n") > 0, "healthy").otherwise("degraded"))


def queue_state(events: DataFrame, queued: list[str], done: list[str]) -> DataFrame:
    """item, since: items whose latest event (item, kind, seq) of either list is one that queues; ``since`` is its seq. Ties of seq: the kind later by name."""
    own = events.filter(F.col("kind").isin(*queued, *done) & F.col("item").isNotNull())
    last = own.groupBy("item").agg(F.max(F.struct("seq", "kind")).alias("e"))
    return last.filter(F.col("e.kind").isin(*queued)).select("item", F.col("e.seq").alias("since"))


def read_gaps(processed: DataFrame, reads: DataFrame, *, version: int, oldest, cap: int) -> DataFrame:
    """item, at, place: processed items (item, at) not older than ``oldest`` without a read (item, version) of that version; the newest ``cap``, ties by item."""
    have = reads.filter(F.col("version") >= version).select("item").distinct()
    open_ = processed.filter(F.col("at") >= F.lit(oldest).cast("timestamp")).groupBy("item").agg(F.max("at").alias("at")).join(have, "item", "left_anti")
    first = open_.orderBy(F.col("at").desc(), "item").limit(cap)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col("at").desc(), "item")))  # of cap rows


def snapshot_before(events: DataFrame, verdicts: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """(events, verdicts) of a store as it was strictly before place ``cut``: events (mid, seq) by seq, and verdicts (mid) of those only."""
    kept = events.filter(F.col("seq") < cut)
    return kept, verdicts.join(kept.select("mid").distinct(), "mid", "left_semi")


def inventory(catalog: DataFrame, sweep: DataFrame) -> DataFrame:
    """source, status, n_chunks: a catalog (source, n_chunks) joined with what a sweep found (source, status); SUPERSEDED wins over any other status, else the first by name, else ACTIVE."""
    s = sweep.groupBy("source").agg(F.max(F.col("status") == "SUPERSEDED").alias("gone"), F.min("status").alias("status"))
    c = catalog.groupBy("source").agg(F.max("n_chunks").alias("n_chunks"))
    return c.join(s, "source", "full").select("source", F.when(F.col("gone"), "SUPERSEDED").otherwise(F.coalesce("status", F.lit("ACTIVE"))).alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def link_faults(links: DataFrame, assertions: DataFrame) -> DataFrame:
    """assertion_id, target, fault of links (assertion_id, relation, target) that break a rule, the first that holds.

    ``unknown`` end; another ``key`` (entity and predicate); ``backwards`` (asserted before its target); for supersedes, less ``authority``.
    """
    a = assertions.select(*[F.col(c) for c in ("assertion_id", "entity", "predicate", "asserted_at", "authority")])
    t = a.select(*[F.col(c).alias(f"t_{c}") for c in a.columns])
    j = links.join(a, "assertion_id", "left").join(t, F.col("target") == F.col("t_assertion_id"), "left")
    same = F.col("entity").eqNullSafe(F.col("t_entity")) & F.col("predicate").eqNullSafe(F.col("t_predicate"))
    fault = (
        F.when(F.col("entity").isNull() | F.col("t_assertion_id").isNull(), "unknown").when(~same, "key").when(F.col("asserted_at") < F.col("t_asserted_at"), "backwards")
        .when((F.col("relation") == "supersedes") & (F.col("authority") < F.col("t_authority")), "authority")
    )
    return j.select("assertion_id", "target", fault.alias("fault")).filter("fault is not null")
