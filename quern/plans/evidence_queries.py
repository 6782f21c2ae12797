"""Queries of evidence, meetings, admission and evals over the driver tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evidence
from quern.sources.tables import table

PLAIN = r"trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))".format
N_WORDS = r"len(regexp_extract_all(coalesce({}, ''), '[^\s]+'))".format


def _turns(spark, d):
    t = table(spark, d, "conversations")
    return t.select(F.col("conv_id").alias("conv"), F.col("turn").alias("pos"), F.when(F.col("turn") % 4 == 3, F.concat(F.lit("guest"), F.col("conv_id") % 5)).otherwise(F.col("role")).alias("speaker"), "text")


TURNS_SQL = "t AS (SELECT conv_id AS conv, turn AS pos, CASE WHEN turn % 4 = 3 THEN 'guest' || (conv_id % 5) ELSE role END AS speaker, text FROM conversations)"


def _quoted(spark, d):
    """Each document with a quote: its own words, changed words, a short one or none."""
    x = table(spark, d, "documents").filter("text is not null")
    own = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 3, 6), " ")
    k = F.col("doc_id")
    quote = F.when(k % 5 == 0, F.concat(own, F.lit(" never said"))).when(k % 5 == 1, F.lit("so be")).when(k % 5 != 2, F.translate(own, "aeiou", "AEIOU")).otherwise(own)
    return x.select(k.alias("mid"), F.when(k % 17 == 3, -1).otherwise(k).alias("evidence"), quote.alias("quote"), (k % 9).alias("n_criteria"), "text")


QUOTED_SQL = r"""q AS (SELECT doc_id AS mid, CASE WHEN doc_id % 17 = 3 THEN -1 ELSE doc_id END AS evidence, doc_id % 9 AS n_criteria, text,
  CASE WHEN doc_id % 5 = 0 THEN own || ' never said' WHEN doc_id % 5 = 1 THEN 'so be' WHEN doc_id % 5 <> 2 THEN translate(own, 'aeiou', 'AEIOU') ELSE own END AS quote
  FROM (SELECT *, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[3:8], ' ') AS own FROM documents WHERE text IS NOT NULL))"""


def event_admission(spark, d):
    q = _quoted(spark, d)
    return evidence.admit(q, q.select(F.col("mid").alias("id"), "text"))


ADMIT_SQL = f"""WITH {QUOTED_SQL} SELECT q.mid, CASE WHEN e.mid IS NULL THEN 'no evidence' WHEN {N_WORDS(PLAIN('q.quote'))} < 3 THEN 'short'
  WHEN NOT contains(' ' || {PLAIN('e.text')} || ' ', ' ' || {PLAIN('q.quote')} || ' ') THEN 'not verbatim' WHEN q.n_criteria > 6 THEN 'criteria' ELSE 'admitted' END AS verdict FROM q LEFT JOIN q e ON e.mid = q.evidence"""


def quote_offsets(spark, d):
    return _quoted(spark, d).select("mid", evidence.quote_offset(F.col("text"), F.col("quote")).cast("long").alias("place"))


OFFSET_SQL = f"WITH {QUOTED_SQL} SELECT mid, CASE WHEN {PLAIN('quote')} <> '' THEN nullif(instr({PLAIN('text')}, {PLAIN('quote')}), 0) - 1 END AS place FROM q"


def verification_queue(spark, d):
    t = _turns(spark, d)
    e = t.filter("speaker <> 'system'").select((F.col("conv") * 100 + F.col("pos")).alias("mid"), "conv", "pos")
    v = e.filter("pos % 2 = 0").select("mid", F.when(F.col("conv") % 3 == 0, "weak").otherwise("kept").alias("verdict"))
    return evidence.verification_queue(e, v, t)


QUEUE_SQL = f"""WITH {TURNS_SQL}, c AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY conv ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS context FROM t)
SELECT conv * 100 + pos AS mid, context FROM c WHERE speaker <> 'system' AND NOT (pos % 2 = 0 AND conv % 3 <> 0)"""


def verdict_counts(spark, d):
    e = table(spark, d, "events")
    v = e.select((F.col("event_id") * 13 % 4000).alias("mid"), F.col("event_type").alias("verdict"), F.col("event_id").alias("seq"))
    return evidence.verdict_counts(v, e.filter("event_id < 3000").select(F.col("event_id").alias("mid")), ["view", "click", "error"])


COUNTS_SQL = """SELECT verdict, count(*) AS n FROM (SELECT event_id * 13 % 4000 AS mid, event_type AS verdict, row_number() OVER (PARTITION BY event_id * 13 % 4000 ORDER BY event_id DESC) AS k FROM events
  WHERE event_type IN ('view', 'click', 'error')) WHERE k = 1 AND mid < 3000 AND mid IN (SELECT event_id FROM events) GROUP BY verdict"""


def room_audio(spark, d):
    return evidence.room_audio(_turns(spark, d), share=0.6, least=40)


ROOM_SQL = f"""WITH {TURNS_SQL}, p AS (SELECT conv, speaker, sum({N_WORDS('text')}) AS n FROM t GROUP BY ALL), g AS (SELECT conv, sum(n) AS n_words, arg_min(speaker, (-n, speaker)) AS speaker, max(n) AS top FROM p GROUP BY conv)
SELECT conv, speaker, round(CASE WHEN n_words > 0 THEN top / n_words ELSE 0 END, 3) AS share, CAST(n_words AS BIGINT) AS n_words, top / n_words >= 0.6 AND n_words >= 40 AS room FROM g"""


def transcript_faults(spark, d):
    t = _turns(spark, d)
    lengths = t.groupBy("conv").agg((F.max("pos") + F.first("conv") % 3).alias("seconds"))
    return evidence.transcript_faults(t.withColumnRenamed("pos", "at"), lengths, t.sparkSession.createDataFrame([("user",), ("assistant",), ("system",)], "speaker string"))


FAULTS_SQL = f"""WITH {TURNS_SQL} SELECT conv, round(avg(CASE WHEN speaker IN ('user', 'assistant', 'system') THEN 0.0 ELSE 1.0 END), 3) AS unnamed, max(pos) < 0.8 * (max(pos) + conv % 3) AS truncated FROM t GROUP BY conv"""


def unknown_speakers(spark, d):
    t = _turns(spark, d)
    return evidence.unknown_speakers(t, t.filter("speaker = 'user'"), t.filter("conv % 3 <> 1"))


UNKNOWN_SQL = f"""WITH {TURNS_SQL}, g AS (SELECT speaker, count(*) AS n_turns, count(DISTINCT conv) AS n_meetings, count(DISTINCT conv) FILTER (WHERE conv % 3 <> 1) AS n_client FROM t WHERE speaker <> 'user' GROUP BY speaker)
SELECT *, CASE WHEN 2 * n_client > n_meetings THEN 'client' ELSE 'internal' END AS side FROM g"""


def recall_by_part(spark, d):
    x = table(spark, d, "documents")
    return evidence.recall_by_part(x.select(F.when(F.col("doc_id") % 13 != 0, F.col("doc_id") * 37 % F.col("n_chars")).alias("offset"), F.col("n_chars").alias("length"), (F.col("doc_id") % 3 == 0).alias("found")))


RECALL_SQL = """WITH g AS (SELECT CASE WHEN doc_id % 13 <> 0 THEN doc_id * 37 % n_chars END / nullif(n_chars, 0) AS p, doc_id % 3 = 0 AS found FROM documents)
SELECT CASE WHEN p IS NULL THEN 'unknown' WHEN p < 1/3 THEN 'first' WHEN p < 2/3 THEN 'middle' ELSE 'last' END AS part, count(*) AS n, count(*) FILTER (WHERE found) AS n_found, round(count(*) FILTER (WHERE found) / count(*), 3) AS recall FROM g GROUP BY 1"""


def part_coverage(spark, d):
    x = table(spark, d, "documents")
    e = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter("doc_id % 5 > k").select(F.col("doc_id").alias("item"), (F.col("n_chars") * F.col("k") * F.col("k") / 10).alias("offset"))
    return evidence.part_coverage(x.select(F.col("doc_id").alias("item"), F.col("n_chars").alias("length")), e, small=2000, large=20_000)


PART_SQL = """WITH i AS (SELECT doc_id AS item, n_chars AS length, CAST(CASE WHEN n_chars <= 2000 THEN 1 ELSE ceil(n_chars / 2000) END AS INTEGER) AS parts FROM documents WHERE n_chars > 0),
p AS (SELECT item, unnest(range(0, parts)) AS part FROM i),
e AS (SELECT item, least(parts - 1, CAST(floor(length * k * k / 10 * parts / length) AS INTEGER)) AS part, count(*) AS n FROM i, range(0, 4) r(k) WHERE item % 5 > k GROUP BY ALL)
SELECT p.item, CAST(p.part AS INTEGER) AS part, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' WHEN n < 2 THEN 'thin' ELSE 'ok' END AS state FROM p LEFT JOIN e ON e.item = p.item AND e.part = p.part"""


def back_channels(spark, d):
    t = _turns(spark, d)
    return evidence.back_channels(t.withColumn("speaker", F.when(F.col("pos") % 3 == 1, "a").otherwise("b")), most=12)


BACK_SQL = f"""WITH {TURNS_SQL}, s AS (SELECT conv, pos, text, CASE WHEN pos % 3 = 1 THEN 'a' ELSE 'b' END AS speaker FROM t),
b AS (SELECT *, coalesce(lag(speaker) OVER w = lead(speaker) OVER w AND speaker <> lag(speaker) OVER w AND {N_WORDS('text')} <= 12, false) AS back FROM s WINDOW w AS (PARTITION BY conv ORDER BY pos)),
n AS (SELECT *, CASE WHEN back THEN 0 WHEN speaker = (SELECT arg_max(q.speaker, q.pos) FROM b q WHERE q.conv = b.conv AND q.pos < b.pos AND NOT q.back) THEN 0 ELSE 1 END AS fresh FROM b)
SELECT conv, pos, CASE WHEN NOT back THEN CAST(sum(fresh) OVER (PARTITION BY conv ORDER BY pos) AS BIGINT) END AS part FROM n"""


def thread_context(spark, d):
    t = table(spark, d, "conversations")
    k = F.col("conv_id") * 100 + F.col("turn")
    return evidence.thread_context(t.select(k.alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100).alias("parent"), F.col("turn").alias("at"), "text"))


THREAD_SQL = """WITH m AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 100 END AS parent, turn, text FROM conversations),
r AS (SELECT id, parent, string_agg(text, chr(10)) OVER (PARTITION BY parent ORDER BY turn, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM m WHERE parent IS NOT NULL)
SELECT r.id, concat_ws(chr(10), p.text, r.before) AS context FROM r LEFT JOIN m p ON p.id = r.parent"""


def snapshot_changes(spark, d):
    li = table(spark, d, "lineitem")
    return evidence.snapshot_changes(li.select((F.col("l_linenumber") - 1).cast("int").alias("snap"), F.col("l_orderkey").alias("id"), "l_returnflag").groupBy("snap", "id").agg(F.min("l_returnflag").alias("content")))


CHANGES_SQL = """WITH s AS (SELECT CAST(l_linenumber - 1 AS INTEGER) AS snap, l_orderkey AS id, min(l_returnflag) AS content FROM lineitem GROUP BY ALL),
t AS (SELECT s.*, p.id IS NOT NULL AS was, p.content AS old, n.id IS NOT NULL AS stays FROM s LEFT JOIN s p ON p.id = s.id AND p.snap = s.snap - 1 LEFT JOIN s n ON n.id = s.id AND n.snap = s.snap + 1)
SELECT snap, id, CASE WHEN NOT was THEN 'new' ELSE 'changed' END AS state FROM t WHERE NOT was OR content IS DISTINCT FROM old
UNION ALL SELECT snap + 1, id, 'gone' FROM t WHERE NOT stays AND snap < (SELECT max(snap) FROM s)"""


def segment_tiles(spark, d):
    e = table(spark, d, "events")
    return evidence.tiles(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.when(F.col("value") > 20, F.col("value") > 60).alias("segment")))


TILES_SQL = """WITH s AS (SELECT user_id AS key, event_id AS pos, CASE WHEN value > 20 THEN value > 60 END AS segment FROM events),
n AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR segment IS DISTINCT FROM lag(segment) OVER w THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY key ORDER BY pos)),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY pos) AS tile FROM n)
SELECT key, CAST(tile AS BIGINT) AS tile, any_value(segment) AS segment, min(pos) AS first, max(pos) AS last, count(*) AS n FROM t GROUP BY key, tile"""


def dealt_claims(spark, d):
    x = table(spark, d, "documents")
    return evidence.dealt(x.select(F.col("source").alias("section"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 4 != 1, F.col("doc_id") % 4 == 0).alias("figure")), 8)


DEALT_SQL = """SELECT source AS section, doc_id AS id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id % 4 = 0 DESC, doc_id) - 1) % CAST(ceil(count(*) OVER (PARTITION BY source) / 8) AS BIGINT) AS INTEGER) AS hand FROM documents"""


def check_minutes(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("source", evidence.estimated_minutes(F.col("n"), 8, 3).alias("minutes"))


MINUTES_SQL = "SELECT source, CAST(5 + 6 * ceil(ceil(count(*) / 8) / 3) AS BIGINT) AS minutes FROM documents GROUP BY source"


def _graded(spark, d):
    x = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.lit("The | und|license")).alias("must"), F.when(F.col("doc_id") % 7 == 0, F.lit("spam|Der")).alias("must_not"), F.col("text").alias("context"), "source", "lang"
    )
    return x, evidence.graded(x)


GRADED_SQL = """g AS (SELECT doc_id AS id, source, CASE WHEN doc_id % 7 = 0 THEN NOT (contains(x, 'spam') OR contains(x, 'der')) WHEN doc_id % 3 <> 0 THEN contains(x, 'the') OR contains(x, 'und') OR contains(x, 'license') ELSE false END AS ok
  FROM (SELECT *, lower(coalesce(text, '')) AS x FROM documents))"""


def eval_grades(spark, d):
    return _graded(spark, d)[1]


def eval_totals(spark, d):
    x, g = _graded(spark, d)
    return evidence.eval_totals(g.join(x.select("id", "source"), "id"), "source")


TOTALS_SQL = f"WITH {GRADED_SQL} SELECT source, count(*) AS n, count(*) FILTER (WHERE ok) AS n_passed, round(100 * count(*) FILTER (WHERE ok) / count(*), 1) AS percent FROM g GROUP BY source"


def coverage_lens(spark, d):
    c = table(spark, d, "customer")
    keys = c.select(F.concat_ws("/", "c_mktsegment", "c_name").alias("key"))
    evals = c.filter("c_custkey % 3 = 0").select(F.concat_ws("/", "c_mktsegment", F.left("c_name", F.lit(17))).alias("key"))
    return evidence.coverage_lens(keys, evals)


LENS_SQL = """WITH k AS (SELECT DISTINCT c_mktsegment || '/' || c_name AS key FROM customer), e AS (SELECT DISTINCT c_mktsegment || '/' || left(c_name, 17) AS p FROM customer WHERE c_custkey % 3 = 0),
h AS (SELECT DISTINCT key FROM k JOIN e ON starts_with(key, p)) SELECT (SELECT count(*) FROM k) AS n, (SELECT count(*) FROM h) AS n_covered, round(100 * (SELECT count(*) FROM h) / (SELECT count(*) FROM k), 1) AS percent"""


def collapsed_gold(spark, d):
    x = table(spark, d, "documents")
    return evidence.collapsed(x.select(F.col("doc_id").alias("id"), F.col("source").alias("evidence"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") % 5).alias("covered_by"), F.concat(F.lit("q"), "doc_id").alias("quote")))


COLLAPSED_SQL = """WITH g AS (SELECT doc_id AS id, source AS evidence, CASE WHEN doc_id % 4 <> 0 THEN n_chars % 5 END AS covered_by, 'q' || doc_id AS quote FROM documents)
SELECT evidence, covered_by, min(id) AS id, string_agg(quote, ' / ' ORDER BY id) AS quotes, count(*) AS n FROM g GROUP BY evidence, covered_by, CASE WHEN covered_by IS NULL THEN id END"""


def slot_match(spark, d):
    e = table(spark, d, "events")
    k = (F.col("user_id") % 20).alias("key")
    return evidence.slot_match(e.filter("event_type = 'signup'").select(F.col("event_id").alias("slot"), k, F.col("ts").alias("at")), e.filter("event_type = 'purchase'").select(F.col("event_id").alias("event"), k, F.col("ts").alias("at")))


SLOT_SQL = """WITH s AS (SELECT event_id AS slot, user_id % 20 AS key, ts FROM events WHERE event_type = 'signup'), e AS (SELECT event_id AS event, user_id % 20 AS key, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT s.slot, e.event, abs(epoch_us(e.ts) - epoch_us(s.ts)) AS g, row_number() OVER (PARTITION BY s.slot ORDER BY abs(epoch_us(e.ts) - epoch_us(s.ts)), e.ts, e.event) AS k
  FROM s JOIN e ON e.key = s.key AND abs(epoch_us(e.ts) - epoch_us(s.ts)) <= 1200000000 AND CAST(e.ts AS DATE) = CAST(s.ts AS DATE))
SELECT s.slot, r.event, r.g // 1000000 AS gap FROM s LEFT JOIN r ON r.slot = s.slot AND k = 1"""


def section_coverage(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("section"))
    return evidence.section_coverage(p, p.filter("section % 3 = 0"), p.filter("section % 5 = 0").select((F.col("section") + 100).alias("section")))


SECTION_SQL = """WITH s AS (SELECT p_partkey AS x FROM part), c AS (SELECT x FROM s WHERE x % 3 = 0), e AS (SELECT x + 100 AS x FROM s WHERE x % 5 = 0),
j AS (SELECT coalesce(s.x, e.x) AS section, s.x IS NULL AS u, c.x IS NOT NULL AS c, e.x IS NOT NULL AS e FROM s LEFT JOIN c ON c.x = s.x FULL JOIN e ON e.x = s.x)
SELECT section, CASE WHEN u THEN 'unknown' WHEN c AND e THEN 'both' ELSE 'missing' END AS fault FROM j WHERE u OR (c AND e) OR NOT (c OR e)"""


def baseline_sources(spark, d):
    o = table(spark, d, "orders")
    trail = F.concat(F.lit("see Chunk "), F.col("o_custkey") % 90, F.lit(", metric "), F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")), F.lit(" and chunk "), F.col("o_orderkey") % 7)
    return evidence.cited(o.select((F.col("o_orderkey") % 500).alias("id"), trail.alias("trail")))


BASELINE_SQL = """WITH o AS (SELECT o_orderkey % 500 AS id, o_custkey % 90 AS a, o_orderkey % 7 AS b, lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS m FROM orders)
SELECT id, 'chunk' AS kind, CAST(a AS VARCHAR) AS ref FROM o UNION SELECT id, 'chunk', CAST(b AS VARCHAR) FROM o UNION SELECT id, 'metric', m FROM o WHERE m <> ''"""


def open_requests(spark, d):
    o = table(spark, d, "orders")
    r = o.select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("request"))
    return evidence.open_requests(r, o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("request")), table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("item")))


REQUESTS_SQL = """WITH r AS (SELECT o_custkey AS item, max(o_orderkey) AS request FROM orders GROUP BY 1)
SELECT item, request, item IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS known FROM r WHERE request NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


def upstream_claims(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderstatus") == "F", "SUPERSEDED").when(F.col("o_orderstatus") == "O", "ACTIVE").alias("status"))
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") == 7, 10**8).otherwise(0)).alias("upstream"), F.when(F.col("l_linenumber") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("seen"))
    return evidence.upstream_state(c, o).groupBy("upstream", "state").agg(F.count("*").alias("n"))


UPSTREAM_SQL = """WITH c AS (SELECT l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS upstream, CASE WHEN l_linenumber % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS seen FROM lineitem)
SELECT upstream, CASE WHEN o_orderkey IS NULL THEN 'gone' WHEN o_orderstatus = 'F' THEN 'superseded' WHEN o_orderpriority IS DISTINCT FROM seen THEN 'changed' ELSE 'ok' END AS state, count(*) AS n FROM c LEFT JOIN orders ON o_orderkey = upstream GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        event_admission, quote_offsets, verification_queue, verdict_counts, room_audio, transcript_faults, unknown_speakers, recall_by_part, part_coverage, back_channels, thread_context, snapshot_changes,
        segment_tiles, dealt_claims, check_minutes, eval_grades, eval_totals, coverage_lens, collapsed_gold, slot_match, section_coverage, baseline_sources, open_requests, upstream_claims,
    )
}
ORACLES = {
    "event_admission": ADMIT_SQL, "quote_offsets": OFFSET_SQL, "verification_queue": QUEUE_SQL, "verdict_counts": COUNTS_SQL, "room_audio": ROOM_SQL, "transcript_faults": FAULTS_SQL, "unknown_speakers": UNKNOWN_SQL,
    "recall_by_part": RECALL_SQL, "part_coverage": PART_SQL, "back_channels": BACK_SQL, "thread_context": THREAD_SQL, "snapshot_changes": CHANGES_SQL, "segment_tiles": TILES_SQL, "dealt_claims": DEALT_SQL,
    "check_minutes": MINUTES_SQL, "eval_grades": f"WITH {GRADED_SQL} SELECT id, ok FROM g", "eval_totals": TOTALS_SQL, "coverage_lens": LENS_SQL, "collapsed_gold": COLLAPSED_SQL, "slot_match": SLOT_SQL,
    "section_coverage": SECTION_SQL, "baseline_sources": BASELINE_SQL, "open_requests": REQUESTS_SQL, "upstream_claims": UPSTREAM_SQL,
}
