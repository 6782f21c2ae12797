"""Queries of taxonomy graphs, tags, labels, provenance and snapshots, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph
from quern.sources.tables import table


def _hierarchy(spark, d):
    """Regions over nations, and part types over their brands."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent_label"), F.col("n_name").alias("label"))
    return geo.unionByName(table(spark, d, "part").select(F.col("p_type").alias("parent_label"), F.concat_ws(" ", "p_type", "p_brand").alias("label")).distinct())


TREE_SQL = """h AS (
  SELECT r_name AS parent_label, n_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT p_type, p_type || ' ' || p_brand FROM part
), n AS (
  SELECT id, min(label) AS label, min(kind) AS kind, min(parent) AS parent FROM (
    SELECT coalesce(nullif(trim(regexp_replace(lower(parent_label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'n') AS id, parent_label AS label, 'intent_l1' AS kind, NULL AS parent FROM h
    UNION ALL SELECT coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'n'), label, 'intent_l2',
                     coalesce(nullif(trim(regexp_replace(lower(parent_label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'n') FROM h
  ) GROUP BY id
)"""


def taxonomy_nodes(spark, d):
    return graph.tree(_hierarchy(spark, d), "intent_l1", "intent_l2")[0]


def graph_children(spark, d):
    nodes, edges = graph.tree(_hierarchy(spark, d), "intent_l1", "intent_l2")
    return edges.join(nodes.select(F.col("id").alias("source"), "label"), "source").groupBy(F.col("target").alias("parent")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("label")), "|").alias("children"))


def _orders_lines(spark, d):
    """A citation graph: customer -> order -> part."""
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"))
    p = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return o.unionByName(p).distinct()


def provenance_closure(spark, d):
    """Sources that each customer's claims rest on, through orders."""
    e = _orders_lines(spark, d)
    return graph.closure(e, starts=e.filter("source like 'c%'")).groupBy("source").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def provenance_index(spark, d):
    """Reverse index: each part to the customers that rest on it."""
    e = _orders_lines(spark, d)
    return graph.closure(e, starts=e.filter("source like 'c%'")).filter("target like 'p%'").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("claims"))


CLOSURE_SQL = """RECURSIVE e AS (
  SELECT DISTINCT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders
  UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
), r AS (SELECT source, target, 1 AS depth FROM e UNION SELECT r.source, e.target, r.depth + 1 FROM r JOIN e ON r.target = e.source),
c AS (SELECT source, target, min(depth) AS depth FROM r WHERE source LIKE 'c%' GROUP BY ALL)"""


def _tags(spark, d):
    nodes, _ = graph.tree(table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent_label"), F.col("n_name").alias("label")), "intent_l1", "intent_l2")
    n = F.col("n_chars") % 25
    labels = F.when(F.col("n_chars") % 9 == 0, F.array(F.lit("__no_topic__"))).when(F.col("n_chars") % 7 == 0, F.array(F.lit("unheard of"))).otherwise(
        F.array(F.concat(F.lit("NATION_"), n), F.concat(F.lit("nation "), (n * 3) % 25), F.lit("old-name"))
    )
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), labels.alias("labels"))
    aliases = spark.createDataFrame([("old_name", "nation_5")], "alias_id string, node_id string")
    return docs, *graph.write_tags(docs, nodes, aliases)


TAGS_SQL = """l AS (
  SELECT doc_id AS chunk_id, unnest(CASE WHEN n_chars % 9 = 0 THEN ['__no_topic__'] WHEN n_chars % 7 = 0 THEN ['unheard_of'] ELSE ['nation_' || (n_chars % 25), 'nation_' || ((n_chars % 25) * 3 % 25), 'nation_5'] END) AS key FROM documents
), g AS (SELECT lower(n_name) AS id, n_name AS label, replace(lower(r_name), ' ', '_') AS parent, r_name AS plabel FROM nation JOIN region ON n_regionkey = r_regionkey),
own AS (SELECT chunk_id, g.* FROM l JOIN g ON l.key = g.id),
tags AS (SELECT DISTINCT chunk_id, id AS category_id, label AS category_label, 'intent_l2' AS kind FROM own UNION SELECT chunk_id, parent, plabel, 'intent_l1' FROM own),
verdicts AS (SELECT chunk_id FROM l WHERE key = '__no_topic__')"""


def tag_write(spark, d):
    return _tags(spark, d)[1]


def tag_coverage(spark, d):
    return graph.tag_coverage(*_tags(spark, d))


def tag_counts(spark, d):
    return graph.tag_balance(_tags(spark, d)[1])


def tag_overlap(spark, d):
    return graph.tag_overlap(_tags(spark, d)[1])


def tag_repoint(spark, d):
    return graph.repoint(_tags(spark, d)[1], "nation_5", "nation_7", "NATION_7", "intent_l2").groupBy("category_id", "category_label").agg(F.count("*").alias("n"))


def topic_centroids_misplaced(spark, d):
    """Labels as children, and whether each label's even or odd half as its parent."""
    v = table(spark, d, "embeddings").filter("embedding is not null").select(F.col("label").cast("string").alias("child"), (F.col("label") % 3).cast("string").alias("parent"), "embedding")
    return graph.misplaced(v, v, margin=-2.0)


MISPLACED_SQL = """WITH x AS (SELECT CAST(label AS VARCHAR) AS child, CAST(label % 3 AS VARCHAR) AS parent, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(0, len(embedding))) AS k FROM embeddings),
c AS (SELECT child, parent, list(x ORDER BY k) AS c FROM (SELECT child, parent, k, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL),
p AS (SELECT parent AS other, list(x ORDER BY k) AS c FROM (SELECT parent, k, avg(x) AS x FROM x GROUP BY ALL) GROUP BY ALL),
s AS (SELECT child, parent, other, list_cosine_similarity(c.c, p.c) AS s FROM c, p)
SELECT child, parent, max_by(other, s) FILTER (WHERE other <> parent) AS closer, round(max(s) FILTER (WHERE other = parent), 6) AS own, round(max(s) FILTER (WHERE other <> parent), 6) AS best FROM s GROUP BY child, parent"""


def _snapshots(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("content"), "o_orderdate", "o_totalprice")
    before = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    after = o.filter(F.col("o_orderdate") >= F.lit("1995-06-01").cast("timestamp")).withColumn("content", F.when(F.col("o_totalprice") > 400000, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return before, after


SNAP_SQL = """b AS (SELECT o_orderkey AS k, o_orderstatus || '|' || o_orderpriority AS c FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
a AS (SELECT o_orderkey AS k, o_orderstatus || '|' || o_orderpriority || CASE WHEN o_totalprice > 400000 THEN '!' ELSE '' END AS c FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01')"""


def doc_delta(spark, d):
    return graph.snapshot_delta(*_snapshots(spark, d), "o_orderkey", "content")


def snapshot_eval_diff(spark, d):
    e = table(spark, d, "events").filter("event_type in ('click', 'purchase')").select("user_id", "value", "ts")
    half = F.lit("2024-01-15").cast("timestamp")
    score = lambda df: df.groupBy("user_id").agg(F.round(F.avg(F.col("value") / 100), 6).alias("score"))
    return graph.score_diff(score(e.filter(F.col("ts") < half)), score(e.filter(F.col("ts") >= half)), "user_id")


DIFF_SQL = """WITH e AS (SELECT user_id, value / 100 AS v, ts < TIMESTAMP '2024-01-15' AS early FROM events WHERE event_type IN ('click', 'purchase')),
b AS (SELECT user_id AS k, round(avg(v), 6) AS s FROM e WHERE early GROUP BY 1), a AS (SELECT user_id AS k, round(avg(v), 6) AS s FROM e WHERE NOT early GROUP BY 1)
SELECT coalesce(b.k, a.k) AS user_id, b.s AS before, a.s AS after,
       CASE WHEN b.k IS NULL THEN 'new' WHEN a.k IS NULL THEN 'missing' WHEN (b.s >= 0.5) <> (a.s >= 0.5) THEN 'flipped' WHEN a.s - b.s > 0.01 THEN 'improved' WHEN b.s - a.s > 0.01 THEN 'regressed' ELSE 'stable' END AS change
FROM b FULL JOIN a ON a.k = b.k"""


def fingerprint_stale(spark, d):
    """Customers whose set of orders changed between the snapshots."""
    o = table(spark, d, "orders")
    old = graph.fingerprints(o.filter(F.col("o_orderdate") < F.lit("2001-06-01").cast("timestamp")), "o_custkey", "o_orderkey", "o_orderstatus").withColumnRenamed("fingerprint", "was")
    new = graph.fingerprints(o, "o_custkey", "o_orderkey", "o_orderstatus")
    return new.join(old, "o_custkey", "left").select("o_custkey", "fingerprint", F.when(F.col("was").isNull(), "first_run").when(F.col("was") != F.col("fingerprint"), "changed").otherwise("fresh").alias("state"))


STALE_SQL = """WITH f AS (SELECT o_custkey, o_orderkey || '=' || sha256(o_orderstatus) AS p, o_orderdate < TIMESTAMP '2001-06-01' AS early FROM orders),
n AS (SELECT o_custkey, sha256(string_agg(p, chr(10) ORDER BY p)) AS fingerprint FROM f GROUP BY 1), w AS (SELECT o_custkey, sha256(string_agg(p, chr(10) ORDER BY p)) AS was FROM f WHERE early GROUP BY 1)
SELECT n.o_custkey, fingerprint, CASE WHEN was IS NULL THEN 'first_run' WHEN was <> fingerprint THEN 'changed' ELSE 'fresh' END AS state FROM n LEFT JOIN w ON n.o_custkey = w.o_custkey"""

QUERIES = {
    f.__name__: f
    for f in (
        taxonomy_nodes, graph_children, provenance_closure, provenance_index, tag_write, tag_coverage, tag_counts, tag_overlap, tag_repoint, topic_centroids_misplaced,
        doc_delta, snapshot_eval_diff, fingerprint_stale,
    )
}

ORACLES = {
    "taxonomy_nodes": f"WITH {TREE_SQL} SELECT id, label, kind, parent FROM n",
    "graph_children": f"WITH {TREE_SQL} SELECT parent, count(*) AS n, string_agg(label, '|' ORDER BY label) AS children FROM n WHERE parent IS NOT NULL GROUP BY parent",
    "provenance_closure": f"WITH {CLOSURE_SQL} SELECT source, count(*) AS n, max(depth) AS deepest FROM c GROUP BY source",
    "provenance_index": f"WITH {CLOSURE_SQL} SELECT target, string_agg(DISTINCT source, ',' ORDER BY source) AS claims FROM c WHERE target LIKE 'p%' GROUP BY target",
    "tag_write": f"WITH {TAGS_SQL} SELECT * FROM tags",
    "tag_coverage": f"""WITH {TAGS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE doc_id IN (SELECT chunk_id FROM tags)) AS tagged,
count(*) FILTER (WHERE doc_id NOT IN (SELECT chunk_id FROM tags) AND doc_id IN (SELECT chunk_id FROM verdicts)) AS no_topic,
count(*) FILTER (WHERE doc_id NOT IN (SELECT chunk_id FROM tags) AND doc_id NOT IN (SELECT chunk_id FROM verdicts)) AS untagged FROM documents""",
    "tag_counts": f"""WITH {TAGS_SQL}, n AS (SELECT category_id, count(DISTINCT chunk_id) AS n FROM tags GROUP BY 1), m AS (SELECT *, median(n) OVER () AS median_n FROM n)
SELECT *, CASE WHEN n > 3 * median_n THEN 'overloaded' WHEN n <= 3 THEN 'sparse' ELSE 'ok' END AS state FROM m""",
    "tag_overlap": f"WITH {TAGS_SQL} SELECT x.category_id AS a, y.category_id AS b, count(DISTINCT x.chunk_id) AS n FROM tags x JOIN tags y ON x.chunk_id = y.chunk_id AND x.category_id < y.category_id GROUP BY 1, 2",
    "tag_repoint": f"""WITH {TAGS_SQL}, m AS (SELECT DISTINCT chunk_id, CASE category_id WHEN 'nation_5' THEN 'nation_7' ELSE category_id END AS category_id, CASE category_id WHEN 'nation_5' THEN 'NATION_7' ELSE category_label END AS category_label FROM tags)
SELECT category_id, category_label, count(*) AS n FROM m GROUP BY 1, 2""",
    "topic_centroids_misplaced": MISPLACED_SQL,
    "doc_delta": f"""WITH {SNAP_SQL} SELECT coalesce(b.k, a.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'deleted' WHEN a.c = b.c THEN 'unchanged' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.k = b.k""",
    "snapshot_eval_diff": DIFF_SQL,
    "fingerprint_stale": STALE_SQL,
}
