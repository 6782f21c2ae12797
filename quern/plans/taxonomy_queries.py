"""Queries of taxonomy upkeep over the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph, taxonomy
from quern.plans.graph_queries import TAGS_SQL, _tags
from quern.sources.tables import table


def addressed_by(spark, d):
    n = table(spark, d, "nation")
    links = n.select(F.col("n_name").alias("source_label"), F.concat(F.lit("Nation "), (F.col("n_nationkey") * 7) % 31).alias("target_label"))
    return taxonomy.resolve_links(links, n.select(F.lower("n_name").alias("id")))


ADDRESSED_SQL = """SELECT lower(n_name) AS source, 'nation_' || (n_nationkey * 7 % 31) AS target,
  CASE WHEN n_nationkey * 7 % 31 > 24 THEN 'unknown' WHEN n_nationkey * 7 % 31 = n_nationkey THEN 'self' ELSE 'linked' END AS state FROM nation"""


def tag_groups(spark, d):
    """Groups of customers that share an order day and status with a customer whose key is near."""
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_custkey < 400").select((F.col("o_custkey") % 200).alias("a"), ((F.col("o_custkey") + F.col("o_orderkey") % 3) % 200).alias("b"))
    return taxonomy.components(o.filter("a <> b"))


GROUPS_SQL = """WITH RECURSIVE p AS (SELECT DISTINCT o_custkey % 200 AS a, (o_custkey + o_orderkey % 3) % 200 AS b FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey < 400),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b), r AS (SELECT a AS node, a AS g FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.g = e.a)
SELECT node, min(g) AS "group" FROM r GROUP BY node"""


def naming_patterns(spark, d):
    p = table(spark, d, "part")
    return taxonomy.naming_patterns(p.select(F.concat_ws(" ", "p_type", "p_brand", F.col("p_size") % 4).alias("label")).unionByName(p.select(F.concat_ws(" ", "p_type", "p_brand").alias("label"))))


PATTERNS_SQL = r"""WITH l AS (SELECT DISTINCT lower(x) AS x FROM (SELECT p_type || ' ' || p_brand || ' ' || (p_size % 4) AS x FROM part UNION ALL SELECT p_type || ' ' || p_brand FROM part)),
s AS (SELECT array_to_string(list_transform(string_split(x, ' '), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '#' ELSE t END), ' ') AS stem,
  array_to_string(list_filter(string_split(x, ' '), lambda t: regexp_matches(t, '[0-9]')), ' ') AS own FROM l)
SELECT stem, count(*) AS n, count(*) > 8 AS flagged FROM s WHERE own <> '' GROUP BY stem HAVING count(*) > 1 AND count(*) = count(DISTINCT own)"""


def merge_survivors(spark, d):
    """Each part is merged into half its key, so chains end at 1; parts above 1,990 go round in a cycle."""
    k = F.col("p_partkey")
    into = F.when(k > 1990, F.when(k % 10 == 9, k - 8).otherwise(k + 1)).when(k > 1, F.floor(k / 2))
    return taxonomy.merge_ends(table(spark, d, "part").select(k.alias("node"), into.alias("into"))).select("node", "survivor")


MERGES_SQL = """WITH RECURSIVE m AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1990 THEN CASE WHEN p_partkey % 10 = 9 THEN p_partkey - 8 ELSE p_partkey + 1 END WHEN p_partkey > 1 THEN p_partkey // 2 END AS nxt FROM part),
r AS (SELECT node, nxt AS at_ FROM m WHERE nxt IS NOT NULL UNION SELECT r.node, m.nxt FROM r JOIN m ON r.at_ = m.node WHERE m.nxt IS NOT NULL)
SELECT node, min(at_) AS survivor FROM r GROUP BY node"""


def taxonomy_paths(spark, d):
    """Parts under the part of a third of their key."""
    k = F.col("p_partkey")
    return taxonomy.paths(table(spark, d, "part").select(k.alias("id"), F.concat(F.lit("P"), k).alias("label"), F.when(k > 2, F.floor(k / 3)).alias("parent")))


PATHS_SQL = """WITH RECURSIVE n AS (SELECT p_partkey AS id, 'P' || p_partkey AS label, CASE WHEN p_partkey > 2 THEN p_partkey // 3 END AS parent FROM part),
r AS (SELECT id, 0 AS depth, label AS path, id AS root FROM n WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, r.depth + 1, r.path || ' > ' || n.label, r.root FROM r JOIN n ON n.parent = r.id)
SELECT id, depth, path, root FROM r"""


def dependency_cycles(spark, d):
    n = F.col("n_nationkey")
    e = table(spark, d, "nation").select(n.alias("source"), ((n * 3 + 1) % 25).alias("target"))
    return taxonomy.dependency_cycles(graph.closure(e), e.filter("source = target"))


CYCLES_SQL = """WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * 3 + 1) % 25 AS t FROM nation), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s),
b AS (SELECT r.s, min(r.t) AS cycle FROM r JOIN r q ON q.s = r.t AND q.t = r.s GROUP BY r.s)
SELECT cycle, string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) AS nodes, count(*) AS n FROM b GROUP BY cycle"""


def topological_levels(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").filter(k > 1)
    return taxonomy.topological_levels(p.select(k.alias("node"), F.floor(k / 2).alias("needs")).unionByName(p.filter(k > 2).select(k.alias("node"), F.floor(k / 3).alias("needs"))))


LEVELS_SQL = """WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS needs FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2),
r AS (SELECT needs AS node, 0 AS level FROM e WHERE needs NOT IN (SELECT node FROM e) UNION SELECT e.node, r.level + 1 FROM r JOIN e ON e.needs = r.node)
SELECT node, max(level) AS level FROM r GROUP BY node"""


def cluster_summary(spark, d):
    e = table(spark, d, "events")
    return taxonomy.cluster_summary(e.select(F.col("user_id").alias("cluster"), F.concat("event_type", F.repeat(F.lit("s"), F.col("event_id").cast("int") % 2)).alias("variant"), (F.col("event_id") % 7).alias("source"), (F.floor("value") / 100).alias("confidence"), (F.col("user_id") * F.col("event_id") % 2).alias("kind")))


CLUSTER_SQL = """WITH m AS (SELECT user_id AS cluster, event_type || repeat('s', CAST(event_id % 2 AS BIGINT)) AS variant, event_id % 7 AS source, floor(value) / 100 AS confidence, user_id * event_id % 2 AS kind FROM events)
SELECT cluster, arg_min(variant, (-length(variant), variant)) AS canonical, string_agg(DISTINCT variant, '|' ORDER BY variant) AS variants, count(*) AS n_mentions, count(DISTINCT source) AS n_sources,
  round(avg(confidence), 3) AS confidence, count(DISTINCT kind) > 1 AS ambiguous FROM m GROUP BY cluster"""


def majority_value(spark, d):
    return taxonomy.majority(table(spark, d, "events"), "user_id", "event_type", "event_id")


MAJORITY_SQL = """SELECT user_id, event_type AS value, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) WHERE k = 1"""


def category_samples(spark, d):
    li = table(spark, d, "lineitem")
    return taxonomy.category_samples(li.select((F.col("l_partkey") % 50).alias("category"), F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")))


SAMPLES_SQL = """WITH t AS (SELECT l_partkey % 50 AS category, l_suppkey AS source, l_orderkey * 10 + l_linenumber AS ord, dense_rank() OVER (PARTITION BY l_partkey % 50 ORDER BY l_suppkey) AS s FROM lineitem),
r AS (SELECT category, source, ord, CAST(row_number() OVER (PARTITION BY category ORDER BY source, ord) AS INTEGER) AS place FROM t WHERE s <= 3)
SELECT * FROM r WHERE place <= 15"""


def top_categories(spark, d):
    tags = _tags(spark, d)[1]
    return tags.groupBy("category_id").agg(F.count_distinct("chunk_id").alias("n")).orderBy(F.desc("n"), "category_id").limit(8)


TOP_SQL = f"WITH {TAGS_SQL} SELECT category_id, count(DISTINCT chunk_id) AS n FROM tags GROUP BY 1 ORDER BY n DESC, category_id LIMIT 8"


def untagged_batches(spark, d):
    docs, tags, verdicts = _tags(spark, d)
    return taxonomy.untagged_batches(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), tags, verdicts, limit=100)


UNTAGGED_SQL = f"""WITH {TAGS_SQL}, f AS (SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM tags) AND doc_id NOT IN (SELECT chunk_id FROM verdicts) ORDER BY doc_id LIMIT 100)
SELECT id, CAST(ntile(8) OVER (ORDER BY id) AS INTEGER) AS batch, substr(text, 1, 80) AS preview FROM f"""


def _records(spark, d):
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "view", "propose").when(F.col("event_type") == "error", "withdraw").when(F.col("event_type") == "signup", "reopen").otherwise("accept")
    return e.select((F.col("event_id") * 31 % 1499).alias("item"), action.alias("action"), F.col("event_id").alias("seq"))


RECORDS_SQL = "r AS (SELECT event_id * 31 % 1499 AS item, CASE event_type WHEN 'click' THEN 'reject' WHEN 'view' THEN 'propose' WHEN 'error' THEN 'withdraw' WHEN 'signup' THEN 'reopen' ELSE 'accept' END AS action, event_id AS seq FROM events)"


def standing_rejections(spark, d):
    return taxonomy.standing(_records(spark, d), sets="reject", lifts=["reopen", "accept"])


STANDING_SQL = f"""WITH {RECORDS_SQL} SELECT item, seq AS since FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq DESC) AS k FROM r WHERE action IN ('reject', 'reopen', 'accept')) WHERE k = 1 AND action = 'reject'"""


def review_state(spark, d):
    return taxonomy.review_state(_records(spark, d))


REVIEW_SQL = f"""WITH {RECORDS_SQL} SELECT item, arg_max(action, seq) FILTER (WHERE action IN ('accept', 'reject')) AS decision,
  count(*) FILTER (WHERE action = 'propose' AND seq > coalesce((SELECT max(seq) FROM r q WHERE q.item = r.item AND action = 'withdraw'), -1)) AS n_open FROM r GROUP BY item"""


def unexplained_nodes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return taxonomy.unexplained(p, p.filter("id % 9 <> 4"), p.filter("id % 2 = 0").select(F.col("id").alias("old")))


UNEXPLAINED_SQL = "SELECT p_partkey AS id FROM part WHERE p_partkey % 9 = 4 AND p_partkey % 2 <> 0"


def repoint_impact(spark, d):
    tags = _tags(spark, d)[1]
    return taxonomy.impact(tags, graph.repoint(tags, "nation_5", "nation_7", "NATION_7", "intent_l2"), "category_id")


IMPACT_SQL = f"""WITH {TAGS_SQL}, b AS (SELECT category_id, count(*) AS n FROM tags GROUP BY 1),
a AS (SELECT category_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, CASE WHEN category_id = 'nation_5' THEN 'nation_7' ELSE category_id END AS category_id FROM tags) GROUP BY 1)
SELECT coalesce(a.category_id, b.category_id) AS category_id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.category_id = b.category_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)"""


def implied_closures(spark, d):
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    nodes = li.groupBy(k.alias("id")).agg(F.first("l_orderkey").alias("parent"), F.min(F.when(F.col("l_linestatus") == "F", "done").otherwise("open")).alias("state"))
    return taxonomy.implied_closures(nodes, nodes.select("id", (F.col("id") - 10).alias("needs")))


IMPLIED_SQL = """WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS id, any_value(l_orderkey) AS parent, min(CASE WHEN l_linestatus = 'F' THEN 'done' ELSE 'open' END) AS state FROM lineitem GROUP BY 1),
p AS (SELECT parent, count(*) FILTER (WHERE state = 'open') AS l, count(*) AS n, max(id) FILTER (WHERE state = 'done') AS because FROM n GROUP BY 1)
SELECT o.id AS node, s.id AS because, 'prerequisite' AS kind FROM n s JOIN n o ON o.id = s.id - 10 WHERE s.state = 'done' AND o.state = 'open'
UNION ALL SELECT n.id, because, 'sibling' FROM n JOIN p ON n.parent = p.parent WHERE state = 'open' AND l = 1 AND p.n > 1 AND because IS NOT NULL"""

QUERIES = {
    f.__name__: f
    for f in (
        addressed_by, tag_groups, naming_patterns, merge_survivors, taxonomy_paths, dependency_cycles, topological_levels, cluster_summary, majority_value, category_samples, top_categories, untagged_batches,
        standing_rejections, review_state, unexplained_nodes, repoint_impact, implied_closures,
    )
}
ORACLES = {
    "addressed_by": ADDRESSED_SQL, "tag_groups": GROUPS_SQL, "naming_patterns": PATTERNS_SQL, "merge_survivors": MERGES_SQL, "taxonomy_paths": PATHS_SQL, "dependency_cycles": CYCLES_SQL,
    "topological_levels": LEVELS_SQL, "cluster_summary": CLUSTER_SQL, "majority_value": MAJORITY_SQL, "category_samples": SAMPLES_SQL, "top_categories": TOP_SQL, "untagged_batches": UNTAGGED_SQL,
    "standing_rejections": STANDING_SQL, "review_state": REVIEW_SQL, "unexplained_nodes": UNEXPLAINED_SQL, "repoint_impact": IMPACT_SQL, "implied_closures": IMPLIED_SQL,
}
