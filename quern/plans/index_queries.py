"""Queries of index maintenance over the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import index
from quern.sources.tables import table

OLD = "1998-01-01 00:00:00"


def _docs(spark, d):
    return table(spark, d, "documents")


def chunk_upsert(spark, d):
    x = _docs(spark, d)
    stored = x.filter("doc_id % 7 <> 3").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"), F.when(F.col("doc_id") % 5 == 0, "SUPERSEDED").otherwise("ACTIVE").alias("status"))
    incoming = x.filter("doc_id % 11 <> 4").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return index.upsert_plan(stored, incoming)


UPSERT_SQL = """WITH s AS (SELECT doc_id AS id, sha256(text) AS h, CASE WHEN doc_id % 5 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM documents WHERE doc_id % 7 <> 3),
n AS (SELECT doc_id AS id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 4)
SELECT coalesce(s.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'remove' WHEN s.h = n.h THEN 'keep' ELSE 'embed' END AS action, coalesce(n.h, s.h) AS content_hash, coalesce(status, 'ACTIVE') AS status
FROM s FULL JOIN n ON s.id = n.id"""


def cascade_delete(spark, d):
    """Rows that are left in each lane when the orders of one status go."""
    o, li, c = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    gone = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    related = li.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("b"))
    left = index.cascade(gone, {"documents": (o, ["o_orderkey"]), "chunks": (li, ["l_orderkey"]), "related": (related, ["a", "b"]), "others": (c, [])})
    return index.health(left)


CASCADE_SQL = """WITH g AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'), n AS (
  SELECT 'documents' AS lane, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'chunks', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'related', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g) AND l_orderkey + l_linenumber NOT IN (SELECT id FROM g)
  UNION ALL SELECT 'others', count(*) FROM customer)
SELECT lane, n, CASE WHEN n > 0 THEN 'healthy' ELSE 'degraded' END AS status FROM n"""


def _owned_lines(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        k.alias("id"), F.col("l_orderkey").alias("source"), F.when(F.col("l_linenumber") == 2, "SUPERSEDED").when(F.col("l_linenumber") == 3, "SUPERSEDED").when(F.col("l_linenumber") != 4, "ACTIVE").alias("status"),
        F.when(F.col("l_linenumber") != 5, F.col("l_linenumber") == 3).alias("owned"),
    )


def date_supersession(spark, d):
    dates = table(spark, d, "orders").filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("source"), F.col("o_orderdate").alias("event_date"))
    out = index.supersede_by_date(_owned_lines(spark, d), dates, OLD)
    return out.groupBy("source", "status", "owned").agg(F.count("*").alias("n"), F.min("id").alias("first"))


DATE_SQL = f"""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS source, CASE WHEN l_linenumber IN (2, 3) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, l_linenumber = 3 AS owned FROM lineitem),
j AS (SELECT c.*, coalesce(o_orderdate < TIMESTAMP '{OLD}', false) AS old FROM c LEFT JOIN orders ON o_orderkey = source AND o_orderkey % 6 <> 0),
r AS (SELECT id, source, CASE WHEN status = 'ACTIVE' AND old THEN 'SUPERSEDED' WHEN owned AND NOT old THEN 'ACTIVE' ELSE status END AS status,
  CASE WHEN status = 'ACTIVE' AND old THEN true WHEN owned AND NOT old THEN false ELSE owned END AS owned FROM j)
SELECT source, status, owned, count(*) AS n, min(id) AS first FROM r GROUP BY ALL"""


def manual_supersede(spark, d):
    c = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.lit("ACTIVE").alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("valid_to"))
    return index.supersede_source(c, "view", OLD).groupBy("source", "status").agg(F.count("*").alias("n"), F.count("valid_to").alias("ended"), F.date_format(F.min("valid_to"), "yyyy-MM-dd HH:mm:ss").alias("earliest"))


MANUAL_SQL = f"""WITH c AS (SELECT event_type AS source, CASE WHEN event_type = 'view' THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status,
  CASE WHEN event_id % 3 = 0 THEN ts WHEN event_type = 'view' THEN TIMESTAMP '{OLD}' END AS valid_to FROM events)
SELECT source, status, count(*) AS n, count(valid_to) AS ended, strftime(min(valid_to), '%Y-%m-%d %H:%M:%S') AS earliest FROM c GROUP BY ALL"""


def raw_delta(spark, d):
    x = _docs(spark, d).select(F.col("source").alias("root"), F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha"), "doc_id")
    before, after = x.filter("doc_id % 10 <> 1"), x.filter("doc_id % 10 <> 2 and root <> 'src3'").withColumn("sha", F.when(F.col("doc_id") % 10 == 5, F.lit("new")).otherwise(F.col("sha")))
    return index.raw_delta(before, after, x.filter("root <> 'src3'").select("root"))


RAW_SQL = """WITH x AS (SELECT source AS root, source || '/' || doc_id AS path, sha256(text) AS sha, doc_id FROM documents),
b AS (SELECT * FROM x WHERE doc_id % 10 <> 1), a AS (SELECT root, path, CASE WHEN doc_id % 10 = 5 THEN 'new' ELSE sha END AS sha FROM x WHERE doc_id % 10 <> 2 AND root <> 'src3')
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL AND b.root = 'src3' THEN 'unavailable' WHEN a.path IS NULL THEN 'removed'
  WHEN a.sha IS NOT DISTINCT FROM b.sha THEN 'unchanged' ELSE 'changed' END AS state FROM b FULL JOIN a ON a.path = b.path"""


def manifest_mismatch(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return index.mismatches(o.filter("o_orderkey % 50 <> 0").select("o_orderkey"), li.filter("l_orderkey % 40 <> 0").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


MISMATCH_SQL = """WITH m AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0), s AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey % 40 <> 0)
SELECT o_orderkey, 'manifest' AS side FROM m WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s) UNION ALL SELECT o_orderkey, 'scan' FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM m)"""


def duplicate_content(spark, d):
    x = _docs(spark, d).select(F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    return index.duplicate_contents(x, "path", "sha")


DUPLICATE_SQL = "SELECT sha256(text) AS sha, count(*) AS n_paths, min(source || '/' || doc_id) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"


def _queue(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 997).alias("item"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))


def requeued_items(spark, d):
    return index.queue_state(_queue(spark, d), ["signup", "error"], ["purchase"])


REQUEUE_SQL = """SELECT item, seq AS since FROM (SELECT event_id % 997 AS item, event_type AS kind, event_id AS seq, row_number() OVER (PARTITION BY event_id % 997 ORDER BY event_id DESC) AS k
  FROM events WHERE event_type IN ('signup', 'error', 'purchase')) WHERE k = 1 AND kind <> 'purchase'"""


def read_gaps(spark, d):
    e = table(spark, d, "events")
    items = e.filter("event_type = 'click'").select(F.col("user_id").alias("item"), F.col("ts").alias("at"))
    reads = e.filter("event_type = 'view' and value > 99").select(F.col("user_id").alias("item"), (F.col("event_id") % 4).alias("version"))
    return index.read_gaps(items, reads, version=2, oldest="2024-01-10 00:00:00", cap=40).select("item", "place")


GAPS_SQL = """SELECT item, CAST(row_number() OVER (ORDER BY seen DESC, item) AS INTEGER) AS place FROM (SELECT user_id AS item, max(ts) AS seen FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00'
  AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND value > 99 AND event_id % 4 >= 2) GROUP BY user_id ORDER BY seen DESC, item LIMIT 40)"""


def snapshot_before(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("mid"), F.col("event_id").alias("seq"), "event_type")
    v = e.filter("event_type = 'view'").select("mid")
    events, verdicts = index.snapshot_before(e, v, 5000)
    return events.groupBy("event_type").agg(F.count("*").alias("n")).join(verdicts.agg(F.count("*").alias("n_verdicts")), F.lit(True))


SNAPSHOT_SQL = "SELECT event_type, count(*) AS n, (SELECT count(*) FROM events WHERE event_type = 'view' AND event_id < 5000) AS n_verdicts FROM events WHERE event_id < 5000 GROUP BY event_type"


def source_inventory(spark, d):
    x = _docs(spark, d)
    catalog = x.filter("source <> 'src4'").groupBy("source").agg(F.count("*").alias("n_chunks"))
    sweep = x.filter("source <> 'src5'").select("source", F.when(F.col("doc_id") % 97 == 0, "SUPERSEDED").when(F.col("doc_id") % 3 == 0, "DRAFT").otherwise("LIVE").alias("status"))
    return index.inventory(catalog, sweep)


INVENTORY_SQL = """WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src4' GROUP BY 1),
s AS (SELECT source, max(doc_id % 97 = 0) AS gone, min(CASE WHEN doc_id % 97 = 0 THEN 'SUPERSEDED' WHEN doc_id % 3 = 0 THEN 'DRAFT' ELSE 'LIVE' END) AS status FROM documents WHERE source <> 'src5' GROUP BY 1)
SELECT coalesce(c.source, s.source) AS source, CASE WHEN gone THEN 'SUPERSEDED' ELSE coalesce(status, 'ACTIVE') END AS status, coalesce(n, 0) AS n_chunks FROM c FULL JOIN s ON c.source = s.source"""


def link_constraints(spark, d):
    e = table(spark, d, "events")
    a = e.select(F.col("event_id").alias("assertion_id"), (F.col("user_id") % 9).alias("entity"), F.lit("p").alias("predicate"), F.col("ts").alias("asserted_at"), (F.col("event_id") % 3).alias("authority"))
    links = e.select(F.col("event_id").alias("assertion_id"), F.when(F.col("event_id") % 2 == 0, "supersedes").otherwise("contradicts").alias("relation"), ((F.col("event_id") * 7) % 12000).alias("target"))
    return index.link_faults(links, a)


FAULTS_SQL = """WITH a AS (SELECT event_id AS id, user_id % 9 AS entity, ts, event_id % 3 AS auth FROM events),
f AS (SELECT a.id AS assertion_id, (a.id * 7) % 12000 AS target, CASE WHEN t.id IS NULL THEN 'unknown' WHEN a.entity <> t.entity THEN 'key' WHEN a.ts < t.ts THEN 'backwards' WHEN a.id % 2 = 0 AND a.auth < t.auth THEN 'authority' END AS fault
  FROM a LEFT JOIN a t ON t.id = (a.id * 7) % 12000)
SELECT * FROM f WHERE fault IS NOT NULL"""

QUERIES = {
    f.__name__: f
    for f in (
        chunk_upsert, cascade_delete, date_supersession, manual_supersede, raw_delta, manifest_mismatch, duplicate_content, requeued_items, read_gaps, snapshot_before, source_inventory, link_constraints,
    )
}
ORACLES = {
    "chunk_upsert": UPSERT_SQL, "cascade_delete": CASCADE_SQL, "date_supersession": DATE_SQL, "manual_supersede": MANUAL_SQL, "raw_delta": RAW_SQL, "manifest_mismatch": MISMATCH_SQL,
    "duplicate_content": DUPLICATE_SQL, "requeued_items": REQUEUE_SQL, "read_gaps": GAPS_SQL, "snapshot_before": SNAPSHOT_SQL, "source_inventory": INVENTORY_SQL, "link_constraints": FAULTS_SQL,
}
