"""The ledger's fold over the events table, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import ledger
from quern.sources.tables import table

UPTO = "2024-01-25"

# users are nodes, every tenth a story; days are evidence, the 13th of a month a copy of the 12th; the kind of an event and its value say what it does
OP = """CASE t WHEN 'click' THEN 'status' WHEN 'purchase' THEN 'status' WHEN 'error' THEN CASE v % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'waiting' ELSE 'revise' END
  WHEN 'view' THEN CASE v % 3 WHEN 0 THEN 'suggest_merge' WHEN 1 THEN 'ac_met' ELSE 'suggest_move' END
  ELSE CASE WHEN v % 12 <= 2 THEN 'edit' WHEN v % 12 <= 4 THEN 'link' WHEN v % 12 = 5 AND id % 6 = 0 THEN 'merge' WHEN v % 12 = 6 AND v % 5 = 0 THEN 'delete' WHEN v % 12 IN (7, 8, 9) THEN 'accept' WHEN v % 12 = 10 THEN 'undo' ELSE 'reject' END END"""
GIVEN = {
    "effect": "CASE t WHEN 'purchase' THEN 'done' WHEN 'click' THEN CASE v % 8 WHEN 0 THEN 'progress' WHEN 1 THEN 'reopen' WHEN 2 THEN 'done' WHEN 3 THEN 'delayed' WHEN 4 THEN 'due' WHEN 5 THEN 'reassign' WHEN 6 THEN 'mention' ELSE 'blocked' END END",
    "pending": "CASE WHEN t = 'click' AND v % 8 = 2 THEN 'human' END",
    "due": "CASE WHEN t = 'click' AND v % 8 = 4 THEN concat('d', v % 5) END",
    "client_owner": "CASE WHEN t = 'click' AND v % 8 = 5 THEN concat('c', v % 3) END",
    "what": "CASE WHEN op = 'waiting' THEN concat('w', v % 4) END",
    "title": "CASE WHEN op = 'revise' THEN concat('r', v) END",
    "other": "CASE op WHEN 'link' THEN concat('n', u + 1 + v % 7) WHEN 'suggest_merge' THEN concat('n', u + 10) WHEN 'merge' THEN concat('n', u + 30) WHEN 'suggest_move' THEN concat('n', u - u % 10 + 10) END",
    "target": "CASE WHEN op IN ('accept', 'undo', 'reject') THEN concat('m', id - 1 - v % 40) END",
    "ac_text": "CASE WHEN op = 'ac_met' THEN CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END END",
    "field": "CASE WHEN op = 'edit' THEN CASE WHEN v % 12 = 0 THEN 'title' WHEN v % 12 = 2 THEN 'due' WHEN id % 5 = 0 THEN 'state' ELSE 'waiting_for' END END",
    "value": "CASE WHEN op = 'edit' THEN CASE WHEN v % 12 = 1 AND id % 5 = 0 THEN CASE v % 5 WHEN 0 THEN 'open' ELSE 'blocked' END ELSE concat('h', v % 9) END END",
}


def _ledger(spark, d):
    src = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.floor("value").cast("int").alias("v"), F.col("event_type").alias("t"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    r = src.withColumn("op", F.expr(OP)).withColumns({c: F.expr(x) for c, x in GIVEN.items()})
    by = F.when(F.col("t") == "signup", "human").otherwise("agent")
    acts = r.select(
        (F.col("id") * 4 + 1).alias("seq"), F.concat(F.lit("m"), "id").alias("mid"), by.alias("type"), by.alias("by"), "op", F.concat(F.lit("n"), "u").alias("node"), F.col("day").alias("evidence"), F.col("day").alias("date"),
        F.when(F.col("op") == "edit", F.create_map("field", "value")).alias("set"), *[c for c in GIVEN if c not in ("field", "value")],
    )
    said = r.filter("t <> 'signup'").select((F.col("id") * 4 + 2).alias("seq"), F.concat(F.lit("m"), "id").alias("mid"), F.lit("verdict").alias("type"), F.when(F.col("id") % 4 != 0, "supports").otherwise("refutes").alias("verdict"))
    story = F.col("u") % 10 == 0
    made = src.groupBy("u").agg(F.min("id").alias("id"), F.min_by("day", "id").alias("date")).select(
        (F.col("id") * 4).alias("seq"), F.concat(F.lit("k"), "u").alias("mid"), F.lit("create").alias("type"), F.lit("plan").alias("by"), F.concat(F.lit("n"), "u").alias("node"), "date", F.concat(F.lit("t"), "u").alias("title"),
        F.when(story, "story").otherwise("task").alias("kind"), F.when(~story, F.concat(F.lit("n"), F.col("u") - F.col("u") % 10)).alias("parent"), (F.col("u") % 7 == 0).alias("client_owed"),
        F.when(story, F.array(F.lit("a"), F.lit("b"))).alias("ac"),
    )
    events = acts.unionByName(said, allowMissingColumns=True).unionByName(made, allowMissingColumns=True)
    days = src.select("day").distinct().select(F.col("day").alias("evidence"), F.col("day").alias("at"), F.col("day").alias("date"), F.when(F.col("day").endswith("-13"), F.concat(F.substring("day", 1, 8), F.lit("12"))).alias("duplicate_of"))
    return events, days


def event_fold_full(spark, d):
    """Lists as text, since not every client compares arrays."""
    n = ledger.fold_ledger(*_ledger(spark, d), UPTO)
    return n.withColumns({c: F.array_join(c, ",") for c in ("pinned", "depends_on", "waiting_on", "blocks")})


_given = ", ".join(f"{x} AS {c}" for c, x in GIVEN.items())
FOLD_SQL = f"""WITH RECURSIVE src AS (SELECT event_id AS id, user_id AS u, CAST(floor(value) AS INTEGER) AS v, event_type AS t, strftime(ts, '%Y-%m-%d') AS day FROM events),
q AS (SELECT *, {OP} AS op FROM src), r AS (SELECT *, id * 4 + 1 AS seq, 'm' || id AS mid, 'n' || u AS node, t = 'signup' AS person, regexp_replace(day, '-13$', '-12') AS item, {_given} FROM q),
n0 AS (SELECT 'n' || u AS node, u, u % 10 = 0 AS story, min(id) * 4 AS born, arg_min(day, id) AS created FROM src GROUP BY u),
und AS (SELECT DISTINCT target AS mid FROM r WHERE op = 'undo'),
dec AS (SELECT target AS mid, arg_max(op, seq) AS chosen, max(CASE WHEN op = 'accept' THEN seq END) AS accepted_at FROM r WHERE op IN ('accept', 'reject') AND mid NOT IN (SELECT mid FROM und) GROUP BY 1),
e AS (SELECT r.*, coalesce(chosen, 'pending') AS decision, accepted_at, CASE WHEN person THEN day ELSE item END AS date,
    CASE WHEN pending = 'human' THEN coalesce(chosen, '') = 'accept' WHEN person OR op NOT IN ('status', 'link', 'waiting', 'ac_met') THEN true ELSE id % 4 <> 0 END AS ok
  FROM r LEFT JOIN dec USING (mid) WHERE item <= '{UPTO}' AND mid NOT IN (SELECT mid FROM und)),
cand AS (SELECT row_number() OVER (ORDER BY seq) AS k, seq, e.node AS a, other AS b FROM e JOIN n0 ON n0.node = other AND seq > born WHERE op = 'merge' OR (op = 'suggest_merge' AND decision = 'accept')),
st AS (SELECT CAST(0 AS BIGINT) AS k, node, node AS w FROM (SELECT a AS node FROM cand UNION SELECT b FROM cand)
  UNION ALL SELECT c.k, s.node, CASE WHEN s.w = max(CASE WHEN s.node = c.a THEN s.w END) OVER () THEN max(CASE WHEN s.node = c.b THEN s.w END) OVER () ELSE s.w END FROM st s JOIN cand c ON c.k = s.k + 1),
ch AS (SELECT node, seq AS since, w AS who, lead(seq) OVER (PARTITION BY node ORDER BY seq) AS until FROM (SELECT s.*, c.seq, lag(w) OVER (PARTITION BY node ORDER BY s.k) AS p FROM st s LEFT JOIN cand c ON c.k = s.k) WHERE w <> p),
lost AS (SELECT node, min(since) AS at, arg_min(who, since) AS into FROM ch GROUP BY 1), fin AS (SELECT node, who FROM ch WHERE until IS NULL),
g AS (SELECT e.* EXCLUDE (node), coalesce(x.who, e.node) AS node, o.node AS oth, o.story AS oth_story FROM e LEFT JOIN ch x ON x.node = e.node AND e.seq > x.since AND (x.until IS NULL OR e.seq <= x.until)
  LEFT JOIN ch y ON y.node = e.other AND e.seq > y.since AND (y.until IS NULL OR e.seq <= y.until) LEFT JOIN n0 o ON o.node = coalesce(y.who, e.other) AND e.seq > o.born),
hand AS (SELECT node, seq, field, value FROM g WHERE op = 'edit' UNION ALL SELECT node, seq, 'state', 'deleted' FROM g WHERE op = 'delete'
  UNION ALL SELECT g.node, seq, 'parent', oth FROM g JOIN n0 ON n0.node = g.node WHERE op = 'suggest_move' AND decision = 'accept' AND NOT n0.story AND oth_story),
pins AS (SELECT node, min(seq) FILTER (WHERE field = 'state') AS ps, min(seq) FILTER (WHERE field = 'due') AS pd, string_agg(DISTINCT field, ',' ORDER BY field) AS pinned FROM hand GROUP BY 1),
gone AS (SELECT * FROM (SELECT *, lead(seq) OVER (PARTITION BY node ORDER BY seq) AS until FROM hand WHERE field = 'state') WHERE value = 'deleted'),
live AS (SELECT g.*, pd IS NULL OR seq < pd AS free FROM g LEFT JOIN pins USING (node) WHERE op = 'status' AND effect <> 'mention' AND ok AND (ps IS NULL OR seq < ps OR effect IN ('due', 'delayed', 'reassign'))
  AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.node = g.node AND g.seq > gone.seq AND (gone.until IS NULL OR g.seq < gone.until))),
sets AS (SELECT node, seq, field, value, true AS hand FROM hand UNION ALL SELECT node, born, unnest(['title', 'parent', 'state']), unnest(['t' || u, CASE WHEN NOT story THEN 'n' || (u - u % 10) END, 'open']), false FROM n0
  UNION ALL SELECT node, seq, 'title', title, false FROM g WHERE op = 'revise' UNION ALL SELECT node, seq, 'waiting_for', what, false FROM g WHERE op = 'waiting' AND ok
  UNION ALL SELECT node, seq, 'waiting_for', NULL, false FROM live WHERE effect = 'done' UNION ALL SELECT node, seq, 'client_owner', client_owner, false FROM live WHERE effect = 'reassign'
  UNION ALL SELECT node, seq, 'state', effect, false FROM live WHERE effect IN ('done', 'blocked')),
top AS (SELECT node, max(value) FILTER (WHERE field = 'title') AS title, max(value) FILTER (WHERE field = 'parent') AS parent, max(seq) FILTER (WHERE field = 'parent') AS parent_at, max(value) FILTER (WHERE field = 'state') AS base,
    max(seq) FILTER (WHERE field = 'state') AS base_at, bool_or(hand) FILTER (WHERE field = 'state') AS base_hand, max(value) FILTER (WHERE field = 'waiting_for') AS waiting_for, max(value) FILTER (WHERE field = 'client_owner') AS client_owner
  FROM (SELECT *, row_number() OVER (PARTITION BY node, field ORDER BY hand DESC, seq DESC) AS k FROM sets) WHERE k = 1 GROUP BY 1),
due AS (SELECT node, arg_max_null(due, seq) AS due, count(*) FILTER (WHERE fresh) AS n_due FROM (SELECT *, sure OR lag(seq) OVER w IS NULL OR lag(due) OVER w IS DISTINCT FROM due AS fresh FROM (
    SELECT node, seq, value AS due, true AS sure FROM hand WHERE field = 'due' UNION ALL SELECT node, seq, NULL, true FROM live WHERE effect = 'delayed' AND free UNION ALL SELECT node, seq, due, false FROM live WHERE effect = 'due' AND free)
  WINDOW w AS (PARTITION BY node ORDER BY seq)) GROUP BY 1),
card AS (SELECT *, op = 'status' AND seq < coalesce(max(CASE WHEN op = 'status' AND decision = 'accept' THEN accepted_at END) OVER (PARTITION BY node), -1) AS late FROM g WHERE op IN ('suggest_merge', 'suggest_move') OR pending = 'human'),
cards AS (SELECT node, count(*) FILTER (WHERE NOT late) AS n_pending, count(*) FILTER (WHERE late) AS n_superseded FROM card WHERE decision = 'pending' GROUP BY 1),
met AS (SELECT node, count(DISTINCT ac_text) AS n_met FROM g WHERE op = 'ac_met' AND ok GROUP BY 1),
seen AS (SELECT node, max(date) AS last_date FROM g WHERE op NOT IN ('undo', 'accept', 'reject') GROUP BY 1),
carry AS (SELECT node, oth AS d FROM g WHERE op = 'link' AND ok AND oth IS NOT NULL AND oth <> node UNION SELECT l.into, c.d FROM carry c JOIN lost l ON l.node = c.node WHERE c.d <> l.into),
dep AS (SELECT DISTINCT c.node, coalesce(fin.who, c.d) AS d FROM carry c LEFT JOIN fin ON fin.node = c.d WHERE c.node <> coalesce(fin.who, c.d)),
a AS (SELECT n0.*, top.* EXCLUDE (node, parent), CASE WHEN pl.at > parent_at THEN pf.who ELSE top.parent END AS parent, coalesce(pinned, '') AS pinned, fin.who AS merged_into,
    CASE WHEN l.at IS NOT NULL THEN 'merged' WHEN base_hand THEN base WHEN base IN ('open', 'blocked') AND m.p > base_at THEN 'in_progress' WHEN base = 'done' AND m.o > base_at THEN 'in_progress' ELSE base END AS state0,
    coalesce(contains(',' || pinned || ',', ',state,'), false) AS state_pinned, CASE WHEN story THEN coalesce(n_met, 0) ELSE 0 END AS n_met
  FROM n0 JOIN top USING (node) LEFT JOIN pins USING (node) LEFT JOIN lost l USING (node) LEFT JOIN fin USING (node) LEFT JOIN met USING (node) LEFT JOIN lost pl ON pl.node = top.parent LEFT JOIN fin pf ON pf.node = top.parent
  LEFT JOIN (SELECT node, max(seq) FILTER (WHERE effect = 'progress') AS p, max(seq) FILTER (WHERE effect = 'reopen') AS o FROM live GROUP BY 1) m ON m.node = n0.node),
b AS (SELECT a.*, CASE WHEN story AND state0 NOT IN ('done', 'cancelled', 'merged', 'deleted') AND NOT state_pinned THEN CASE WHEN n_met = 2 THEN 'criteria' WHEN state0 = 'open' AND EXISTS (
    SELECT 1 FROM a t WHERE t.parent = a.node AND NOT t.story AND t.state0 IN ('done', 'in_progress')) THEN 'task' END END AS derived FROM a),
c AS (SELECT *, CASE derived WHEN 'criteria' THEN 'done' WHEN 'task' THEN 'in_progress' ELSE state0 END AS state FROM b), open_ AS (SELECT * FROM c WHERE state NOT IN ('done', 'cancelled', 'merged', 'deleted')),
waits AS (SELECT dep.node, d FROM dep JOIN open_ o ON o.node = d UNION SELECT s.node, t.node FROM open_ t JOIN c s ON s.node = t.parent AND s.story WHERE NOT t.story AND t.u % 7 = 0),
w1 AS (SELECT node, string_agg(d, ',' ORDER BY d) AS waiting_on FROM waits GROUP BY 1), w2 AS (SELECT d AS node, string_agg(waits.node, ',' ORDER BY waits.node) AS blocks FROM waits JOIN open_ o ON o.node = waits.node GROUP BY 1),
w3 AS (SELECT node, string_agg(d, ',' ORDER BY d) AS depends_on FROM dep GROUP BY 1)
SELECT node AS id, CASE WHEN story THEN 'story' ELSE 'task' END AS kind, title, CAST(NULL AS VARCHAR) AS type, state, derived, parent, merged_into, CAST(NULL AS VARCHAR) AS internal_owner, client_owner, u % 7 = 0 AS client_owed, due,
  coalesce(n_due, 0) AS n_due, waiting_for, pinned, coalesce(depends_on, '') AS depends_on, coalesce(waiting_on, '') AS waiting_on, coalesce(blocks, '') AS blocks, CAST(CASE WHEN story THEN 2 ELSE 0 END AS BIGINT) AS n_criteria, CAST(n_met AS BIGINT) AS n_met,
  coalesce(n_pending, 0) AS n_pending, coalesce(n_superseded, 0) AS n_superseded, created, greatest(created, last_date) AS last_date
FROM c LEFT JOIN due USING (node) LEFT JOIN cards USING (node) LEFT JOIN seen USING (node) LEFT JOIN w1 USING (node) LEFT JOIN w2 USING (node) LEFT JOIN w3 USING (node)"""

QUERIES = {"event_fold_full": event_fold_full}
ORACLES = {"event_fold_full": FOLD_SQL}
