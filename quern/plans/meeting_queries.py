"""Queries of meetings, gold, conformed entities and tagged sections over the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import marts, meetings, search
from quern.plans.evidence_queries import PLAIN
from quern.plans.fixtures import FACTS_SQL, LATEST_SQL, raw_facts
from quern.plans.graph_queries import TAGS_SQL, _tags
from quern.sources.tables import table


def _events(spark, d, kind, key, *more):
    """Events of a kind as meetings: the title holds a squad and a topic, two stop words, a month and a number."""
    e = table(spark, d, "events").filter(F.col("event_type") == kind)
    title = F.concat(F.lit("The squad"), F.col("user_id") % 40, F.lit(" on topic"), F.col("event_id") % 11, F.lit(" of March "), F.col("event_id"))
    return e.select(F.col("event_id").alias(key), F.col("ts").alias("at"), title.alias("title"), *more)


EVENTS_SQL = "e AS (SELECT event_id AS id, ts AS held, event_type AS kind, user_id % 40 AS squad, event_id % 11 AS topic FROM events)"
ALIKE = "x.squad = y.squad AND x.topic = y.topic"


def calendar_match(spark, d):
    return meetings.calendar_match(_events(spark, d, "signup", "meeting"), _events(spark, d, "purchase", "event"))


CALENDAR_SQL = f"""WITH {EVENTS_SQL}, r AS (SELECT x.id AS meeting, y.id AS event, abs(epoch_us(x.held) - epoch_us(y.held)) AS g,
  row_number() OVER (PARTITION BY x.id ORDER BY abs(epoch_us(x.held) - epoch_us(y.held)), y.id) AS k
  FROM e x JOIN e y ON {ALIKE} AND x.kind = 'signup' AND y.kind = 'purchase' AND abs(date_diff('day', x.held, y.held)) <= 7)
SELECT meeting, event, g // 1000000 AS gap FROM r WHERE k = 1"""


def expected_missing(spark, d):
    guessed = (F.col("event_id") % 3 == 0).alias("guessed")
    return meetings.expected_missing(_events(spark, d, "signup", "expected"), _events(spark, d, "view", "meeting", guessed)).select("expected")


EXPECTED_SQL = f"""WITH {EVENTS_SQL} SELECT id AS expected FROM e x WHERE kind = 'signup' AND NOT EXISTS (SELECT 1 FROM e y WHERE {ALIKE} AND y.kind = 'view'
  AND CASE WHEN y.id % 3 = 0 THEN CAST(x.held AS DATE) = CAST(y.held AS DATE) ELSE abs(epoch_us(x.held) - epoch_us(y.held)) <= 1200000000 END)"""


def unready_meetings(spark, d):
    ends = (F.col("ts") + F.expr("interval 1 hour")).alias("ends")
    return meetings.unready(_events(spark, d, "signup", "event", ends), _events(spark, d, "view", "meeting"), monday="2024-01-08", now="2024-01-12 12:00:00").select("event")


UNREADY_SQL = f"""WITH {EVENTS_SQL} SELECT id AS event FROM e x WHERE kind = 'signup' AND held >= TIMESTAMP '2024-01-08' AND held < TIMESTAMP '2024-01-15' AND held + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-12 12:00:00'
  AND NOT EXISTS (SELECT 1 FROM e y WHERE {ALIKE} AND y.kind = 'view' AND CAST(x.held AS DATE) = CAST(y.held AS DATE))"""


def _frames(spark, d):
    """Lines of documents as frames; what is said is the lines of benchmark items."""
    x = table(spark, d, "documents").filter("text is not null")
    lines = x.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    windows = x.select(F.col("doc_id").alias("page"), (F.col("doc_id") % 600).alias("starts"), (F.col("doc_id") % 600 + 90).alias("ends"))
    return lines, windows, table(spark, d, "benchmark").select((F.col("item_id") * 17 % 700).alias("at"), "text")


def caption_leaks(spark, d):
    return meetings.caption_leaks(*_frames(spark, d)).select("page", "line")


GRAMS = "list_transform(range(1, len({0}) - 4), lambda i: array_to_string({0}[i:i + 5], ' '))".format
LEAKS_SQL = f"""WITH l AS (SELECT doc_id AS page, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM l), g AS (SELECT DISTINCT page, line, unnest({GRAMS('ws')}) AS gram FROM w WHERE len(ws) >= 6),
b AS (SELECT item_id * 17 % 700 AS said, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark), c AS (SELECT DISTINCT said, unnest({GRAMS('ws')}) AS gram FROM b WHERE len(ws) >= 6)
SELECT DISTINCT page, CAST(line AS INT) AS line FROM g JOIN c ON g.gram = c.gram AND c.said BETWEEN page % 600 - 30 AND page % 600 + 120"""


def _gold(spark, d):
    """Gold of every document: words 11 to 22 of its text. Events quote words 13 to 22, words 41 to 50 or none of the text."""
    x = table(spark, d, "documents").filter("text is not null")
    ws = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    cut = lambda a, n: F.array_join(F.slice(ws, a, n), " ")
    k = F.col("doc_id")
    gold = x.select(k.alias("gold"), k.alias("evidence"), cut(11, 12).alias("quote"))
    kinds = F.element_at(F.array(F.lit("task"), F.lit("story"), F.lit("epic")), (k % 3 + 1).cast("int"))
    near = x.select(k.alias("evidence"), cut(13, 10).alias("quote"), (k * 10 + 1).alias("node"), kinds.alias("kind"))
    far = x.select(k.alias("evidence"), F.when(k % 4 == 0, "never said by anyone at all").otherwise(cut(41, 10)).alias("quote"), (k * 10 + 2).alias("node"), F.lit("task").alias("kind"))
    return gold, near.filter("evidence % 5 <> 0").unionByName(far), x.select(k.alias("evidence"), "text")


def gold_matches(spark, d):
    return meetings.match_gold(*_gold(spark, d), rank={"task": 3, "story": 2, "decision": 2, "risk": 2, "epic": 0})


RUNS = "list_distinct(list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i + 4], ' ')))".format
GOLD_SQL = rf"""WITH x AS (SELECT doc_id AS k, {PLAIN('text')} AS p, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT k, p, {PLAIN("array_to_string(ws[11:22], ' ')")} AS gq, {PLAIN("array_to_string(ws[13:22], ' ')")} AS nq, {PLAIN("CASE WHEN k % 4 = 0 THEN 'never said by anyone at all' ELSE array_to_string(ws[41:50], ' ') END")} AS fq FROM x),
e AS (SELECT k, p, gq, nq AS eq, k * 10 + 1 AS node, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS level FROM q WHERE k % 5 <> 0 UNION ALL SELECT k, p, gq, fq, k * 10 + 2, 3 FROM q),
r AS (SELECT *, {RUNS("string_split(gq, ' ')")} AS gr, {RUNS("string_split(eq, ' ')")} AS er, CASE WHEN gq <> '' THEN nullif(instr(p, gq), 0) END AS go, CASE WHEN eq <> '' THEN nullif(instr(p, eq), 0) END AS eo FROM e),
c AS (SELECT k, node, level, CASE WHEN len(gr) > 0 AND len(er) > 0 THEN len(list_intersect(gr, er)) / least(len(gr), len(er)) ELSE 0 END AS c, abs(go - eo) AS dist FROM r),
h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c < 0.5, -round(c, 3), -level, coalesce(dist, 2147483647), node) AS n FROM c WHERE c >= 0.5 OR dist <= 400)
SELECT q.k AS gold, h.node FROM q LEFT JOIN h ON h.k = q.k AND h.n = 1"""


def uncovered_cues(spark, d):
    x = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("evidence"), "text")
    said = meetings.cue_sentences(x, r"(^| )(a|the|de|la|en)( |$)")
    spans = x.filter("evidence % 2 = 0").select("evidence", F.explode(F.array(F.lit(0), F.lit(300), F.lit(320))).alias("a")).withColumn("b", F.col("a") + 100)
    return meetings.uncovered(said, spans).select("evidence", "pos", "starts", "ends")


UNCOVERED_SQL = rf"""WITH x AS (SELECT doc_id AS evidence, {PLAIN('text')} AS whole, regexp_split_to_array(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
s AS (SELECT evidence, whole, unnest(range(0, len(parts))) AS pos, unnest(list_transform(parts, lambda p: {PLAIN('p')})) AS q FROM x),
c AS (SELECT evidence, pos, instr(whole, q) - 1 AS starts, instr(whole, q) - 1 + length(q) AS ends FROM s WHERE len(regexp_extract_all(q, '[^\s]+')) >= 6 AND regexp_matches(q, '(^| )(a|the|de|la|en)( |$)') AND instr(whole, q) > 0)
SELECT evidence, CAST(pos AS INT) AS pos, CAST(starts AS INT) AS starts, CAST(ends AS INT) AS ends FROM c WHERE NOT (evidence % 2 = 0 AND ((starts < 100 AND ends > 0) OR (starts < 400 AND ends > 300) OR (starts < 420 AND ends > 320)))"""


def evidence_order(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("evidence"), F.date_trunc("hour", "ts").alias("at"), (F.col("user_id") % 3 == 0).alias("client"), F.when(F.col("event_id") % 7 == 0, F.col("event_id") - 1).alias("duplicate_of"))
    return meetings.evidence_order(e).select("evidence", "pos")


ORDER_SQL = """SELECT event_id AS evidence, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY date_trunc('hour', ts), user_id % 3 = 0, event_id) - 1 AS INT) AS pos FROM events WHERE event_id % 7 <> 0"""


def merged_key(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    judged = o.select(k.alias("cid"), F.when(k % 2 == 0, "committed").otherwise("proposed").alias("commitment"), F.when(k % 5 != 0, "task").alias("kind"), F.when(k % 6 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("owner"))
    recheck = o.filter("o_orderkey % 7 = 0").select(k.alias("cid"), F.when(k % 2 == 0, "not_work").otherwise("kept").alias("verdict"))
    said = F.element_at(F.array(F.lit("not_work"), F.lit("declined"), F.lit("unsure")), (k % 3 + 1).cast("int"))
    answers = o.filter("o_orderkey % 4 = 0").select(k.alias("cid"), said.alias("kind"), F.when(k % 8 == 0, "told").alias("title"), F.lit("").alias("owner"))
    return meetings.merged_key(judged, recheck, answers, work=("committed", "proposed", "declined"), default_title="Work item set by the user")


KEY_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 14 = 0 AS no, CASE WHEN o_orderkey % 4 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'not_work' WHEN 1 THEN 'declined' END END AS uk FROM orders),
j AS (SELECT *, CASE WHEN NOT no AND k % 5 <> 0 THEN 'task' END AS kind, CASE WHEN NOT no AND k % 6 <> 0 THEN p END AS title, CASE WHEN NOT no THEN s END AS owner FROM o)
SELECT k AS cid, coalesce(uk, CASE WHEN no THEN 'not_work' WHEN k % 2 = 0 THEN 'committed' ELSE 'proposed' END) AS commitment,
  CASE WHEN uk = 'declined' THEN coalesce(kind, 'task') WHEN uk IS NULL THEN kind END AS kind,
  CASE WHEN uk = 'declined' THEN coalesce(CASE WHEN k % 8 = 0 THEN 'told' END, title, 'Work item set by the user') WHEN uk IS NULL THEN title END AS title,
  CASE WHEN uk = 'declined' OR uk IS NULL THEN owner END AS owner, CASE WHEN uk IS NULL THEN 'judge' ELSE 'user' END AS source FROM j"""


def gold_states(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    j = o.filter("o_orderkey % 3 <> 0").select(F.explode(F.when(k % 11 == 0, F.array(k, k)).when(k % 13 == 0, F.array(-k)).otherwise(F.array(k))).alias("cid"), F.when(F.col("o_orderstatus") == "F", "not_work").otherwise("committed").alias("commitment"), F.when(k % 5 == 0, k - 1).alias("duplicate_of"))
    return meetings.gold_states(o.select(k.alias("cid"), (k % 2 == 0).alias("verifiable")), j)


STATES_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 3 <> 0 AS j FROM orders)
SELECT k AS cid, CASE WHEN j AND k % 11 = 0 THEN 'judged twice' WHEN NOT j OR k % 13 = 0 THEN CASE WHEN k % 2 = 0 THEN 'unjudged' ELSE 'left out' END WHEN s = 'F' THEN 'not_work' WHEN k % 5 = 0 THEN 'duplicate' ELSE 'gold' END AS state FROM o
UNION ALL SELECT -k, 'foreign' FROM o WHERE j AND k % 13 = 0 AND k % 11 <> 0"""


def deliverables(spark, d):
    """Customers as stories, their orders as tasks and files, lines of part numbers as criteria."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    states = F.element_at(F.array(F.lit("open"), F.lit("done"), F.lit("blocked"), F.lit("in_progress"), F.lit("merged")), (k % 5 + 1).cast("int"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int"))
    stories = c.select(k.alias("id"), states.alias("state"), day(k * 7).alias("due"), day(k * 11).alias("last_seen"))
    o = table(spark, d, "orders")
    own = F.col("o_custkey").alias("story")
    tasks = o.select(own, F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"))
    criteria = o.filter("o_orderkey % 3 = 0").select(own, (F.col("o_orderstatus") == "O").alias("met"))
    return meetings.deliverables(stories, tasks, criteria, o.filter("o_orderkey % 5 = 0").select(own, F.col("o_orderdate").alias("at"), F.concat(F.lit("file "), "o_orderkey").alias("title")))


DELIVERABLES_SQL = """WITH s AS (SELECT c_custkey AS story, ['open', 'done', 'blocked', 'in_progress', 'merged'][c_custkey % 5 + 1] AS state, DATE '2024-01-01' + CAST(c_custkey * 7 % 365 AS INT) AS due, DATE '2024-01-01' + CAST(c_custkey * 11 % 365 AS INT) AS seen FROM customer),
t AS (SELECT o_custkey AS story, min(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus <> 'F') AS first_draft_due, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'O') AS ac_met, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS ac_total FROM orders GROUP BY 1),
f AS (SELECT o_custkey AS story, 'file ' || o_orderkey AS landed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, 'file ' || o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 5 = 0)
SELECT s.story, state, due, CASE WHEN state = 'done' THEN 'Green' WHEN state = 'blocked' OR due < seen THEN 'Red' WHEN state = 'in_progress' THEN 'Amber' ELSE 'Green' END AS rag, first_draft_due, coalesce(ac_met, 0) AS ac_met, coalesce(ac_total, 0) AS ac_total, landed
FROM s LEFT JOIN t ON t.story = s.story LEFT JOIN f ON f.story = s.story AND k = 1 WHERE state <> 'merged'"""


def metric_versions(spark, d):
    facts = raw_facts(spark, d)
    rows = marts.nested_versions(marts.latest_wins(facts).filter("metric = 'qty' and month like '1997%'"), facts)
    each = F.transform("other_values", lambda o: F.concat(o["source_file"], F.lit("="), o["value"].cast("long"), F.lit("@"), F.coalesce(o["reported_in"], F.lit("-"))))
    return rows.select("entity", "month", F.array_join(each, "|").alias("other_values"))


VERSIONS_SQL = f"""WITH {LATEST_SQL}, l AS (SELECT * FROM latest WHERE metric = 'qty' AND starts_with(month, '1997'))
SELECT l.entity, l.month, coalesce(string_agg(f.source_file || '=' || CAST(f.value AS BIGINT) || '@' || coalesce(f.reported_in, '-'), '|' ORDER BY f.source_file), '') AS other_values
FROM l LEFT JOIN facts f ON f.metric = l.metric AND f.entity = l.entity AND f.month = l.month AND f.value <> l.value GROUP BY 1, 2"""


def metric_merges(spark, d):
    facts = raw_facts(spark, d)
    m = facts.filter("source_file in ('rpt-2', 'rpt-5')").select(*marts.KEY, "source_file", F.lit("sum").alias("policy"), F.length("entity").cast("long").alias("n_rows"), F.lit("[]").alias("inputs"))
    rows = marts.attach_merges(marts.latest_wins(facts), m)
    return rows.select("metric", "entity", "month", "merged_from.policy", "merged_from.n_rows")


MERGED_SQL = f"WITH {LATEST_SQL} SELECT metric, entity, month, CASE WHEN source_file IN ('rpt-2', 'rpt-5') THEN 'sum' END AS policy, CASE WHEN source_file IN ('rpt-2', 'rpt-5') THEN length(entity) END AS n_rows FROM latest"


def build_coverage(spark, d):
    return marts.build_coverage(raw_facts(spark, d))


BUILD_SQL = f"WITH {FACTS_SQL} SELECT family, metric, grain, count(*) AS n_rows, count(DISTINCT month) AS n_months, count(DISTINCT entity) AS n_entities FROM facts GROUP BY ALL"


def entity_conform(spark, d):
    p = table(spark, d, "part")
    values = p.select(F.when(F.col("p_partkey") % 2 == 0, "type").otherwise("brand").alias("dim"), F.concat(F.lit("  "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_brand")), F.lit("  ("), F.col("p_size"), F.lit(" usa) ")).alias("value"))
    aliases = spark.createDataFrame([("brand", "brand#11 (7 usa)", "Eleven")], "dim string, norm string, entity string")
    return marts.conformed(values, aliases, titled=("type",)).groupBy("dim", "entity").agg(F.count("*").alias("n"))


CAP = "CASE WHEN regexp_matches(w, '^[A-Z0-9]{1,3}$') AND regexp_matches(w, '[A-Z]') THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END"
CONFORM_SQL = rf"""WITH v AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'type' ELSE 'brand' END AS dim, trim(regexp_replace('  ' || CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_brand END || '  (' || p_size || ' usa) ', '\s+', ' ', 'g')) AS x FROM part)
SELECT dim, CASE WHEN dim = 'brand' AND lower(x) = 'brand#11 (7 usa)' THEN 'Eleven' WHEN dim = 'brand' THEN x ELSE
  array_to_string(list_transform(string_split(regexp_replace(x, '([A-Za-z0-9]+)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z0-9]+$') THEN {CAP} ELSE w END), '') END AS entity, count(*) AS n FROM v GROUP BY ALL"""


def entity_mapping(spark, d):
    """Part types of a brand's sheet, some in capitals; the mapping knows every spelling in small letters' length."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_brand").alias("sheet"), F.when(F.col("p_partkey") % 9 == 0, F.upper("p_type")).otherwise(F.initcap("p_type")).alias("raw"))
    mapping = rows.select("raw").distinct().filter("length(raw) % 2 = 0").select("raw", F.concat(F.lit("site of "), F.lower("raw"), F.when(F.col("raw") == F.upper("raw"), " 2").otherwise("")).alias("entity"))
    return marts.mapped_ambiguous(rows, mapping).groupBy("sheet", "entity").agg(F.count("*").alias("n"))


MAPPING_SQL = """WITH v AS (SELECT p_brand AS sheet, CASE WHEN p_partkey % 9 = 0 THEN upper(p_type) ELSE array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END AS raw FROM part),
c AS (SELECT sheet, lower(raw) AS f FROM v GROUP BY ALL HAVING count(DISTINCT raw) > 1)
SELECT v.sheet, CASE WHEN c.f IS NOT NULL AND length(raw) % 2 = 0 THEN 'site of ' || lower(raw) || CASE WHEN raw = upper(raw) THEN ' 2' ELSE '' END ELSE raw END AS entity, count(*) AS n FROM v LEFT JOIN c ON c.sheet = v.sheet AND c.f = lower(raw) GROUP BY 1, 2"""


def section_previews(spark, d):
    x = table(spark, d, "documents")
    head = F.left("text", F.lit(12))
    return x.select("doc_id", tx.preview(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("p3 · "), head, F.lit(" (part 2)"))).otherwise("no such title")).alias("preview"))


PREVIEW_SQL = r"""WITH x AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, CASE WHEN doc_id % 2 = 0 THEN trim(regexp_replace(left(text, 12), '\s+', ' ', 'g')) ELSE 'no such title' END AS stem FROM documents)
SELECT doc_id, left(CASE WHEN stem <> '' AND starts_with(lower(t), lower(stem)) THEN regexp_replace(regexp_replace(substr(t, length(stem) + 1), '^[ .:—·-]+', ''), '^\d{1,4}\s+', '') ELSE t END, 200) AS preview FROM x"""


def tagged_sections(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("ord"))
    _, tags, _ = _tags(spark, d)
    return search.tagged_sections(docs, tags, "Nation_7", 50)


TAGGED_SQL = f"WITH {TAGS_SQL} SELECT doc_id AS id, source, n_chars AS ord FROM documents WHERE doc_id IN (SELECT chunk_id FROM tags WHERE lower(category_label) = 'nation_7') ORDER BY source NULLS FIRST, ord NULLS FIRST, id LIMIT 50"


def section_evidence(spark, d):
    e = table(spark, d, "events")
    hits = e.filter("event_type <> 'error'").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("source"), (F.col("event_id") % 50).alias("rank"))
    return search.section_evidence(hits, table(spark, d, "customer").filter("c_custkey <= 300").select(F.col("c_custkey").alias("query_id")), 2)


EVIDENCE_SQL = """WITH h AS (SELECT user_id AS q, event_type AS s, min(event_id % 50) AS r, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY r, s) AS p FROM h),
t AS (SELECT q, CAST(sum(n) AS BIGINT) AS n_hits, string_agg(s, '|' ORDER BY p) FILTER (WHERE p <= 2) AS first_sources FROM k GROUP BY q)
SELECT c_custkey AS query_id, coalesce(n_hits, 0) AS n_hits, first_sources, n_hits IS NULL AS no_evidence FROM customer LEFT JOIN t ON q = c_custkey WHERE c_custkey <= 300"""


QUERIES = {
    f.__name__: f
    for f in (
        calendar_match, expected_missing, unready_meetings, caption_leaks, gold_matches, uncovered_cues, evidence_order, merged_key, gold_states, deliverables, metric_versions, metric_merges, build_coverage,
        entity_conform, entity_mapping, section_previews, tagged_sections, section_evidence,
    )
}
ORACLES = {
    "calendar_match": CALENDAR_SQL, "expected_missing": EXPECTED_SQL, "unready_meetings": UNREADY_SQL, "caption_leaks": LEAKS_SQL, "gold_matches": GOLD_SQL, "uncovered_cues": UNCOVERED_SQL, "evidence_order": ORDER_SQL,
    "merged_key": KEY_SQL, "gold_states": STATES_SQL, "deliverables": DELIVERABLES_SQL, "metric_versions": VERSIONS_SQL, "metric_merges": MERGED_SQL, "build_coverage": BUILD_SQL, "entity_conform": CONFORM_SQL,
    "entity_mapping": MAPPING_SQL, "section_previews": PREVIEW_SQL, "tagged_sections": TAGGED_SQL, "section_evidence": EVIDENCE_SQL,
}
