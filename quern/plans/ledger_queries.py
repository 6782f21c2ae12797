"""Queries of assertions, turns, event folds, matching and scores, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import matching, memory
from quern.sources.tables import table

CUT = "2024-01-20 00:00:00"


def _assertions(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return e.select(F.concat(F.lit("a"), "event_id").alias("assertion_id"), F.col("user_id").alias("entity"), F.col("event_type").alias("predicate"), F.floor("value").cast("long").alias("value"), F.col("ts").alias("asserted_at"), (F.col("event_id") % 3).alias("authority"))


def _links(spark, d):
    e = table(spark, d, "events").filter("event_type <> 'error'")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    n = e.withColumn("target", F.concat(F.lit("a"), F.lag("event_id").over(w))).filter("target is not null and value >= 50")
    return n.select(F.concat(F.lit("a"), "event_id").alias("assertion_id"), F.when(F.col("event_id") % 10 == 0, "contradicts").otherwise("supersedes").alias("relation"), "target")


ASSERT_SQL = """a AS (SELECT 'a' || event_id AS assertion_id, user_id AS entity, event_type AS predicate, CAST(floor(value) AS BIGINT) AS value, ts AS asserted_at, event_id % 3 AS authority, event_id, value AS raw FROM events WHERE event_type <> 'error'),
l AS (SELECT assertion_id, CASE WHEN event_id % 10 = 0 THEN 'contradicts' ELSE 'supersedes' END AS relation, target FROM (
  SELECT *, lag(assertion_id) OVER (PARTITION BY entity, predicate ORDER BY asserted_at, event_id) AS target FROM a) WHERE target IS NOT NULL AND raw >= 50)"""


def asof_current_fact(spark, d):
    return memory.current_facts(_assertions(spark, d), _links(spark, d), CUT)


CURRENT_SQL = f"""WITH {ASSERT_SQL}, k AS (SELECT * FROM a WHERE asserted_at <= TIMESTAMP '{CUT}'),
v AS (SELECT * FROM k WHERE assertion_id NOT IN (SELECT target FROM l WHERE relation = 'supersedes' AND assertion_id IN (SELECT assertion_id FROM k))),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, predicate ORDER BY asserted_at DESC, authority DESC, assertion_id DESC) AS n FROM v)
SELECT entity, predicate, max(value) FILTER (WHERE n = 1) AS value, max(assertion_id) FILTER (WHERE n = 1) AS assertion_id, count(*) AS n_active, count(DISTINCT value) > 1 AS conflicted FROM r GROUP BY entity, predicate"""


def auto_supersede_links(spark, d):
    return memory.supersede_links(_assertions(spark, d))


SUPERSEDE_SQL = f"""WITH {ASSERT_SQL}
SELECT x.assertion_id, CASE WHEN y.asserted_at < x.asserted_at THEN 'supersedes' ELSE 'contradicts' END AS relation, y.assertion_id AS target
FROM a x JOIN a y ON y.entity = x.entity AND y.predicate = x.predicate AND y.value <> x.value AND (y.asserted_at < x.asserted_at OR (y.asserted_at = x.asserted_at AND x.assertion_id > y.assertion_id))"""


def question_status_asof(spark, d):
    e = table(spark, d, "events")
    q = e.filter("event_type = 'signup'").select(F.col("event_id").alias("question_id"), F.col("ts").alias("asked_at"), "user_id")
    answers = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("answer_id"), F.col("ts").alias("answered_at"), "user_id")
    joined = q.select("question_id", "user_id", "asked_at").join(answers, "user_id").filter("answered_at > asked_at").select("question_id", "answer_id", "answered_at")
    return memory.question_status(q, joined, CUT)


QUESTION_SQL = f"""WITH q AS (SELECT event_id AS question_id, ts, user_id FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '{CUT}'),
a AS (SELECT q.question_id, e.event_id AS answer_id, row_number() OVER (PARTITION BY q.question_id ORDER BY e.ts DESC, e.event_id DESC) AS k FROM q JOIN events e ON e.user_id = q.user_id AND e.event_type = 'purchase' AND e.ts > q.ts AND e.ts <= TIMESTAMP '{CUT}')
SELECT q.question_id, CASE WHEN answer_id IS NULL THEN 'open' ELSE 'resolved' END AS state, answer_id FROM q LEFT JOIN a ON a.question_id = q.question_id AND k = 1"""


def immutable_insert(spark, d):
    orders = table(spark, d, "orders")
    o = orders.select("o_orderkey", "o_orderstatus")
    stored = orders.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "o_orderstatus")
    incoming = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return memory.new_rows(stored, incoming, "o_orderkey")


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.when(F.col("turn") % 3 == 2, "assistant").otherwise(F.col("role")).alias("speaker"), "text")


TURNS_SQL = "t AS (SELECT conv_id AS conv, turn AS pos, CASE WHEN turn % 3 = 2 THEN 'assistant' ELSE role END AS speaker, text FROM conversations)"


def turn_merge(spark, d):
    return memory.merge_turns(_turns(spark, d), 2)


MERGE_SQL = f"""WITH {TURNS_SQL}, n AS (SELECT *, CASE WHEN lag(speaker) OVER w IS NOT DISTINCT FROM speaker AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY conv ORDER BY pos)),
i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv ORDER BY pos) AS BIGINT) AS island FROM n), p AS (SELECT *, (row_number() OVER (PARTITION BY conv, island ORDER BY pos) - 1) // 2 AS part FROM i)
SELECT conv, island, part, any_value(speaker) AS speaker, count(*) AS n, string_agg(text, ' ' ORDER BY pos) AS text FROM p GROUP BY conv, island, part"""


def turn_fold(spark, d):
    return memory.fold_turns(_turns(spark, d), 120)


FOLD_SQL = f"""WITH {TURNS_SQL}, h AS (SELECT *, length(text) >= 120 OR row_number() OVER (PARTITION BY conv ORDER BY pos) = 1 AS head FROM t), g AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY conv ORDER BY pos) AS g FROM h)
SELECT conv, min(pos) AS pos, min_by(speaker, pos) AS speaker, string_agg(CASE WHEN head THEN text ELSE '[' || speaker || ': ' || text || ']' END, ' ' ORDER BY pos) AS text FROM g GROUP BY conv, g"""


def turn_pack(spark, d):
    return memory.pack_turns(_turns(spark, d), 600)


PACK_SQL = f"""WITH RECURSIVE {TURNS_SQL}, r AS (SELECT conv, length(text) AS s, row_number() OVER (PARTITION BY conv ORDER BY pos) AS k FROM t),
f AS (SELECT conv, k, s, 0 AS pack, s AS run FROM r WHERE k = 1
  UNION ALL SELECT r.conv, r.k, r.s, CASE WHEN f.run + r.s <= 600 THEN f.pack ELSE f.pack + 1 END, CASE WHEN f.run + r.s <= 600 THEN f.run + r.s ELSE r.s END FROM f JOIN r ON r.conv = f.conv AND r.k = f.k + 1)
SELECT conv, pack, CAST(count(*) AS INTEGER) AS n, CAST(sum(s) AS INTEGER) AS size FROM f GROUP BY conv, pack"""


def cue_repetition(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("conv"), F.explode(F.split("text", "\n")).alias("text"))
    return memory.repetition(lines, least=4, share=0.3)


def _node_events(spark, d):
    e = table(spark, d, "events")
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "drop").when(F.col("event_type") == "purchase", "close").when(F.col("event_type") == "view", "mention").otherwise(
        F.when(F.col("value") > 90, "pin").when(F.col("value") < 20, "reopen").otherwise("edit")
    )
    return e.select(F.col("user_id").alias("node"), F.struct("ts", "event_id").alias("seq"), op.alias("op"), F.floor("value").cast("string").alias("value"), F.col("ts").alias("at"))


NODE_SQL = """e AS (SELECT user_id AS node, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'close' WHEN 'view' THEN 'mention' ELSE CASE WHEN value > 90 THEN 'pin' WHEN value < 20 THEN 'reopen' ELSE 'edit' END END AS op,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM events)"""


def event_fold_state(spark, d):
    return memory.fold_events(_node_events(spark, d))


EVENT_FOLD_SQL = f"""WITH {NODE_SQL}, p AS (SELECT *, min(CASE WHEN op = 'pin' THEN seq END) OVER (PARTITION BY node) AS pinned FROM e)
SELECT node, max_by(CASE op WHEN 'create' THEN 'open' WHEN 'reopen' THEN 'open' WHEN 'close' THEN 'done' ELSE 'dropped' END, seq) FILTER (WHERE op IN ('create', 'close', 'reopen', 'drop')) AS state, count(*) AS n_events,
  count(*) FILTER (WHERE op = 'edit') AS n_edits, max_by(value, seq) FILTER (WHERE op IN ('create', 'edit') AND (pinned IS NULL OR seq < pinned)) AS title, max(ts) AS last_at FROM p GROUP BY node"""


def pending_reads(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("evidence"), F.when(F.col("event_type") == "click", "processed").when(F.col("event_type") == "error", "reprocess").otherwise("other").alias("type"), F.struct("ts", "event_id").alias("seq"))
    return memory.pending(e)


def staleness_rank(spark, d):
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = e.select("day").distinct().withColumn("pos", F.dense_rank().over(Window.orderBy("day")))  # a row per day
    last = e.join(F.broadcast(days), "day").groupBy((F.col("user_id") % 12).alias("story"), F.col("user_id").alias("node")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("pos"))).alias("last_pos"))
    total = days.agg(F.max("pos").alias("n_pos"))
    return memory.stale_rows(last.join(F.broadcast(total), F.lit(True)).filter("last_pos is not null"), least_silence=1)


STALE_RANK_SQL = """WITH e AS (SELECT user_id, event_type, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS pos FROM events),
m AS (SELECT user_id % 12 AS story, user_id AS node, max(pos) FILTER (WHERE event_type = 'purchase') AS last_pos FROM e GROUP BY 1, 2),
s AS (SELECT story, node, (SELECT max(pos) FROM e) - last_pos AS silence FROM m WHERE last_pos IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY silence DESC, node) AS k FROM s WHERE silence >= 1),
r AS (SELECT story, node, silence, row_number() OVER (ORDER BY silence DESC, node) AS place FROM k WHERE k <= 2)
SELECT story, node, CAST(silence AS INTEGER) AS silence, CAST(place AS INTEGER) AS place FROM r WHERE place <= 15"""


def lint_tree(spark, d):
    o = table(spark, d, "orders")
    state = lambda c: F.when(F.col(c) == "O", "open").when(F.col(c) == "F", "done").otherwise("dropped")
    kids = o.select(F.concat(F.lit("o"), "o_orderkey").alias("node"), F.concat(F.lit("c"), "o_custkey").alias("parent"), state("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("title"))
    tops = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.when(F.col("c_acctbal") > 3000, "open").otherwise("done").alias("state"), F.lit(None).cast("string").alias("title"))
    return memory.tree_lint(kids.unionByName(tops))


LINT_SQL = """WITH n AS (SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS parent, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'dropped' END AS state, o_orderpriority AS title FROM orders
  UNION ALL SELECT 'c' || c_custkey, NULL, CASE WHEN c_acctbal > 3000 THEN 'open' ELSE 'done' END, NULL FROM customer),
w AS (SELECT *, min(node) OVER (PARTITION BY parent, lower(trim(title))) AS other FROM n WHERE state = 'open' AND title IS NOT NULL)
SELECT 'C17' AS rule, node, other FROM w WHERE node <> other
UNION ALL SELECT 'C18', a.node, a.parent FROM n a JOIN n b ON a.parent = b.node WHERE a.state = 'open' AND b.state IN ('done', 'dropped')
UNION ALL SELECT 'C20', p.node, NULL FROM n p JOIN (SELECT parent FROM n WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and(state = 'done')) k ON k.parent = p.node WHERE p.state = 'open'"""


def nearest_event_join(spark, d):
    e = table(spark, d, "events")
    side = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return memory.nearest_event(side("purchase"), side("click"), seconds=7 * 86400)


NEAREST_SQL = """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click'),
x AS (SELECT p.event_id AS id, c.event_id AS other, abs(epoch_us(p.ts) - epoch_us(c.ts)) / 1e6 AS gap, c.ts AS tm FROM p JOIN c ON p.user_id = c.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, tm, other DESC) AS k FROM x)
SELECT id, other, gap FROM r WHERE k = 1 AND gap <= 604800"""


def sessions_missing(spark, d):
    """Purchases without a view by the same user within two hours."""
    e = table(spark, d, "events")
    side = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    near = memory.nearest_event(side("purchase"), side("view"), seconds=7200)
    return side("purchase").join(near.select("id"), "id", "left_anti").select("id", F.col("key").alias("user_id"))


def wilson_by_bucket(spark, d):
    lab = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return memory.wilson(lab.groupBy("lang", "source").agg(F.sum("quality").alias("ok"), F.count("*").alias("n")), "ok", "n")


def consistency_summary(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 40).alias("eval_id"), F.col("event_type").alias("provider"), (F.col("value") >= 50).cast("double").alias("score"))
    return memory.consistency(e)


def scope_classify(spark, d):
    """Pages by scope policy: excluded, junk, kept, too old, else review; the first rule that fits."""
    year = F.regexp_extract("url", r"/(\d{3,4})(?:\D|$)", 1).try_cast("int")
    rules = [(F.col("url").contains("free-bets"), "fail:exclude"), (F.col("url").rlike(r"cheap|spam|adult"), "fail:junk"), (F.col("url").contains("example.org"), "keep"), (year < 300, "fail:old")]
    return table(spark, d, "pages").select("page_id", memory.first_match(rules, "review").alias("verdict"))


def reconcile(spark, d):
    """Customers as inventory and suppliers as index by nation: covered, orphaned or missing."""
    inv = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_inventory"))
    idx = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("j")).agg(F.count("*").alias("n_index"))
    state = F.when(F.col("k").isNull(), "orphaned").when(F.col("j").isNull(), "missing").otherwise("covered")
    return inv.join(idx, F.col("k") == F.col("j"), "full_outer").select(F.coalesce("k", "j").alias("nation"), "n_inventory", "n_index", state.alias("state"))


RISKS = [("number", r"[0-9]"), ("table", r"\|"), ("shout", r"[A-Z]{6,}"), ("money", r"[$%]"), ("address", r"@")]


def risk_tags(spark, d):
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", F.array_join(tx.first_tag(F.col("line"), RISKS), ",").alias("tags")).filter("tags <> ''")


def jaccard_topk(spark, d):
    """The 3 most alike benchmark passages of each, by shared words, through an inverted index."""
    b = table(spark, d, "benchmark").select("item_id", F.array_distinct(tx.words(F.col("text"), 3)).alias("ts")).select("item_id", F.size("ts").alias("n"), F.explode("ts").alias("token"))
    c = b.select(F.col("item_id").alias("other"), F.col("n").alias("m"), "token")
    s = b.join(c, "token").filter("item_id <> other").groupBy("item_id", "other").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m"))
    scored = s.select("item_id", "other", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "other")
    return scored.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


JACCARD_SQL = """WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS token FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
s AS (SELECT x.item_id, y.item_id AS other, count(*) AS k FROM b x JOIN b y ON x.token = y.token AND x.item_id <> y.item_id GROUP BY 1, 2),
r AS (SELECT s.item_id, other, round(k / (a.n + c.n - k), 6) AS score FROM s JOIN n a ON a.item_id = s.item_id JOIN n c ON c.item_id = other)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, other) AS INTEGER) AS rank FROM r) WHERE rank <= 3"""


def html_text(spark, d):
    """Visible text of a page and whether it is too short to be more than a script's shell."""
    raw = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<[^>]*>", " "), r"\s+", " "))
    p = table(spark, d, "pages").select("page_id", text.alias("text"))
    return p.select("page_id", F.length("text").alias("n_chars"), F.when(F.length("text") < 220, "skipped-js-rendered").otherwise("parsed").alias("status"), "text")


QUERIES = {
    f.__name__: f
    for f in (
        asof_current_fact, auto_supersede_links, question_status_asof, immutable_insert, turn_merge, turn_fold, turn_pack, cue_repetition, event_fold_state, pending_reads, staleness_rank, lint_tree,
        nearest_event_join, sessions_missing, wilson_by_bucket, consistency_summary, scope_classify, reconcile, risk_tags, jaccard_topk, html_text,
    )
}

ORACLES = {
    "asof_current_fact": CURRENT_SQL,
    "auto_supersede_links": SUPERSEDE_SQL,
    "question_status_asof": QUESTION_SQL,
    "immutable_insert": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'new' ELSE 'clash' END AS state FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' OR (o_orderkey % 10 = 0 AND o_orderstatus <> 'X')""",
    "turn_merge": MERGE_SQL,
    "turn_fold": FOLD_SQL,
    "turn_pack": PACK_SQL,
    "cue_repetition": """WITH c AS (SELECT conv, said, count(*) AS k FROM (SELECT doc_id AS conv, lower(trim(unnest(string_split(text, chr(10))))) AS said FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2)
SELECT conv, sum(k) AS n, max(k) AS top, sum(k) >= 4 AND max(k) > 0.3 * sum(k) AS looped FROM c GROUP BY conv""",
    "event_fold_state": EVENT_FOLD_SQL,
    "pending_reads": """SELECT user_id AS evidence FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id HAVING max_by(event_type, struct_pack(a := ts, b := event_id)) = 'error'""",
    "staleness_rank": STALE_RANK_SQL,
    "lint_tree": LINT_SQL,
    "nearest_event_join": NEAREST_SQL,
    "sessions_missing": """SELECT event_id AS id, user_id FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND abs(epoch_us(p.ts) - epoch_us(v.ts)) <= 7200000000)""",
    "wilson_by_bucket": """WITH g AS (SELECT lang, source, sum(quality) AS ok, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2), p AS (SELECT *, ok / n AS p FROM g)
SELECT lang, source, CAST(ok AS BIGINT) AS ok, n, round(p, 3) AS rate, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 3) AS lower FROM p""",
    "consistency_summary": """WITH m AS (SELECT user_id % 40 AS eval_id, event_type AS provider, avg(CAST(value >= 50 AS INT)) AS mean, count(*) AS n, count(*) FILTER (WHERE value >= 50) AS k FROM events GROUP BY 1, 2)
SELECT eval_id, provider, round_even(mean, 0) AS outcome, round(CASE WHEN round_even(mean, 0) = 1 THEN k ELSE n - k END / n, 6) AS agreement, round(mean, 6) AS mean FROM m""",
    "scope_classify": r"""SELECT page_id, CASE WHEN contains(url, 'free-bets') THEN 'fail:exclude' WHEN regexp_matches(url, 'cheap|spam|adult') THEN 'fail:junk' WHEN contains(url, 'example.org') THEN 'keep'
WHEN TRY_CAST(regexp_extract(url, '/(\d{3,4})(?:\D|$)', 1) AS INT) < 300 THEN 'fail:old' ELSE 'review' END AS verdict FROM pages""",
    "reconcile": """WITH i AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1), x AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT coalesce(i.k, x.k) AS nation, i.n AS n_inventory, x.n AS n_index, CASE WHEN i.k IS NULL THEN 'orphaned' WHEN x.k IS NULL THEN 'missing' ELSE 'covered' END AS state FROM i FULL JOIN x ON i.k = x.k""",
    "risk_tags": """WITH l AS (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, concat_ws(',', CASE WHEN regexp_matches(line, '[0-9]') THEN 'number' END, CASE WHEN contains(line, '|') THEN 'table' END, CASE WHEN regexp_matches(line, '[A-Z]{6,}') THEN 'shout' END,
  CASE WHEN regexp_matches(line, '[$%]') THEN 'money' END, CASE WHEN contains(line, '@') THEN 'address' END) AS tags FROM l) SELECT * FROM t WHERE tags <> ''""",
    "jaccard_topk": JACCARD_SQL,
}


def bm25_task_candidates(spark, d):
    """Benchmark passages as messages of one day, documents as tasks with a creation day."""
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("n_chars") % 60).cast("int")), "yyyy-MM-dd")
    tasks = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").cast("string").alias("task_id"), "text", day.alias("created"))
    msgs = table(spark, d, "benchmark").select(F.col("item_id").alias("msg_id"), "text", F.lit("2026-02-10").alias("day"))
    return matching.task_candidates(msgs, tasks)


TASK_SQL = """WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS task_id, strftime(DATE '2026-01-01' + CAST(n_chars % 60 AS INT), '%Y-%m-%d') AS created, regexp_extract_all(lower(text), '[a-z0-9]{1,}') AS ts FROM documents WHERE text IS NOT NULL),
p AS (SELECT task_id, w, any_value(created) AS created, any_value(len) AS len, count(*) AS f FROM (SELECT task_id, created, len(ts) AS len, unnest(ts) AS w FROM t) GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM t), q AS (SELECT DISTINCT item_id AS msg_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{1,}')) AS w FROM benchmark), df AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (SELECT msg_id, task_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * len / st.a))), 3) AS score FROM q JOIN p ON q.w = p.w JOIN df ON df.w = p.w, st WHERE created <= '2026-02-10' GROUP BY 1, 2),
x AS (SELECT s.*, coalesce(q.w IS NOT NULL, false) AS named FROM s LEFT JOIN q ON q.msg_id = s.msg_id AND q.w = s.task_id WHERE score > 0)
SELECT msg_id, task_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY named DESC, score DESC, task_id) AS rank FROM x) WHERE rank <= 8"""


def similar_titles(spark, d):
    """Part types with their brands as titles under types."""
    n = table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand", "p_size").alias("title"), F.col("p_type").alias("parent_title")).distinct()
    return matching.similar_nodes(n.select(F.col("title").alias("node"), F.lit("task").alias("kind"), "title", "parent_title"), k=2, least=0.6)


def claim_continuity(spark, d):
    """Lines of each document as claims; the draft repeats every other version with changed case and an added line."""
    docs = table(spark, d, "documents").filter("text is not null")
    body = F.concat(F.lit("- "), F.array_join(F.split("text", "\n"), "\n- "))
    base = docs.select(F.lit("t").alias("task"), F.col("doc_id").cast("string").alias("section"), body.alias("body"))
    draft = docs.select(F.lit("t").alias("task"), F.col("doc_id").cast("string").alias("section"), F.concat(F.when(F.col("n_chars") % 2 == 0, F.upper(body)).otherwise(body), F.lit("\n- one more claim that was not there")).alias("body"))
    m = matching.match_claims(matching.claims(base), matching.claims(draft))
    return m.groupBy("section", "category").agg(F.count("*").alias("n"))


QUERIES |= {"bm25_task_candidates": bm25_task_candidates, "similar_titles": similar_titles, "claim_continuity": claim_continuity}
ORACLES["bm25_task_candidates"] = TASK_SQL

TITLES_SQL = """WITH p AS (SELECT DISTINCT p_type || ' ' || p_brand || ' ' || p_size AS node, p_type AS parent FROM part),
t AS (SELECT node, unnest(list_distinct(list_filter(regexp_extract_all(lower(node), '[a-z0-9]+'), lambda w: len(w) > 1))) AS w FROM p),
n AS (SELECT node, count(*) AS n FROM t GROUP BY node),
q AS (SELECT DISTINCT parent, unnest(regexp_extract_all(lower(parent), '[a-z0-9]+')) AS w FROM p), m AS (SELECT parent, count(*) AS n FROM q GROUP BY parent),
pj AS (SELECT a.parent AS a, b.parent AS b, (SELECT count(*) FROM q x JOIN q y ON x.w = y.w WHERE x.parent = a.parent AND y.parent = b.parent) AS k, a.n AS na, b.n AS nb FROM m a, m b),
c AS (SELECT a.node, b.node AS other, count(*) AS k FROM t a JOIN t b ON a.w = b.w AND a.node <> b.node GROUP BY 1, 2),
j AS (SELECT c.node, c.other, c.k / (x.n + y.n - c.k) AS own, pj.k / (pj.na + pj.nb - pj.k) AS up FROM c JOIN n x ON x.node = c.node JOIN n y ON y.node = c.other JOIN p pa ON pa.node = c.node JOIN p pb ON pb.node = c.other JOIN pj ON pj.a = pa.parent AND pj.b = pb.parent),
s AS (SELECT node, other, round(least(1.0, own + CASE WHEN own >= 0.3 THEN 0.25 * up ELSE 0 END), 6) AS score FROM j)
SELECT * FROM (SELECT node, other, score, CAST(row_number() OVER (PARTITION BY node ORDER BY score DESC, other) AS INTEGER) AS rank FROM s WHERE score >= 0.6) WHERE rank <= 2"""
HTML_SQL = r"""WITH r AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g') AS raw FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM r)
SELECT page_id, CAST(length(text) AS INTEGER) AS n_chars, CASE WHEN length(text) < 220 THEN 'skipped-js-rendered' ELSE 'parsed' END AS status, text FROM t"""
ORACLES |= {"similar_titles": TITLES_SQL, "html_text": HTML_SQL}
