"""Meetings, gold, spans and conformed entities on nulls, ties, repeats, empty tables and extra columns; spans and gold against brute force."""

import random

from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import marts, meetings, search


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CAL = "event long, at string, title string, extra int"


def test_calendar_nearest_shared_words(spark):
    cal = spark.createDataFrame([(1, "2024-01-05 10:00", "Budget review of March", 0), (2, "2024-01-09 10:00", "budget REVIEW call", 0), (3, "2024-01-20 10:00", "Budget review", 0), (3, "2024-01-20 10:00", "Budget review", 0), (4, None, "Budget review", 0), (5, "2024-01-07 10:00", None, 0)], CAL)
    m = spark.createDataFrame([(10, "2024-01-07 10:00", "Review: the budget", 1), (11, "2024-01-28 10:00", "budget review", 1), (12, "2024-01-07 10:00", "budget 2024", 1), (None, "2024-01-06 10:00", "budget review", 1), (13, None, None, 1)], CAL.replace("event", "meeting"))
    assert rows(meetings.calendar_match(m, cal)) == [(10, 1, 172800), (None, 1, 86400)]
    assert meetings.calendar_match(m.limit(0), cal.limit(0)).count() == 0


def test_expected_and_ready(spark):
    e = spark.createDataFrame([(1, "2024-01-08 10:00", "budget review"), (2, "2024-01-08 23:55", "budget review"), (3, "2024-01-09 10:00", "budget review"), (4, None, None)], "expected long, at string, title string")
    m = spark.createDataFrame([(9, "2024-01-08 10:20", "budget review", False), (8, "2024-01-09 00:10", "review budget", None), (7, "2024-01-09 23:00", "budget review", False)], "meeting long, at string, title string, guessed boolean")
    assert rows(meetings.expected_missing(e, m).select("expected")) == [(3,), (4,)]
    ev = spark.createDataFrame([(1, "2024-01-08 10:00", "2024-01-08 11:00", "budget review"), (2, "2024-01-10 10:00", "2024-01-10 11:00", "budget review"), (3, "2024-01-10 10:00", "2024-01-10 11:00", "Canceled: budget review"), (4, "2024-01-10 10:00", None, "budget review"), (5, "2024-01-12 10:00", "2024-01-12 11:00", None), (6, "2024-01-14 10:00", "2024-01-14 11:00", "x y")], "event long, at string, ends string, title string")
    ev = ev.withColumns({c: ev[c].cast("timestamp") for c in ("at", "ends")})
    assert rows(meetings.unready(ev, m, monday="2024-01-08", now="2024-01-13 00:00").select("event")) == [(2,), (5,)]


def test_title_words_are_shared_with_one_row_and_nearest_in_linear_work(spark):
    """Two meetings of one time don't lend each other words; a thousand events of common words make no pairs."""
    e = spark.createDataFrame([(1, "2024-01-08 10:00", "2024-01-08 11:00", "budget review")], "event long, at string, ends string, title string").selectExpr("event", "event as expected", "timestamp(at) as at", "timestamp(ends) as ends", "title")
    m = spark.createDataFrame([(8, "2024-01-08 10:05", "budget talk", False), (9, "2024-01-08 10:05", "review talk", False)], "meeting long, at string, title string, guessed boolean")
    assert rows(meetings.unready(e, m, monday="2024-01-08", now="2024-01-13 00:00").select("event")) == [(1,)]
    assert rows(meetings.expected_missing(e, m).select("expected")) == [(1,)]
    rng = random.Random(5)
    at = lambda: rng.randrange(20 * 86400)
    said = lambda: " ".join(rng.sample(["red", "green", "blue", "of", "may", "7"], 4))
    x, y = [(k, at(), said()) for k in range(80)], [(k, at(), said()) for k in range(120)]
    frame = lambda r, k: spark.createDataFrame(r, f"{k} long, s long, title string").select(k, F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "title")
    day = lambda s: (s + 1_700_000_000) // 86400
    told = lambda t: set(t.split()) & {"red", "green", "blue"}
    want = []
    for k, s, t in x:
        near = [(abs(s - u), j) for j, u, v in y if abs(day(s) - day(u)) <= 2 and len(told(t) & told(v)) >= 2]
        want += [(k, min(near)[1], min(near)[0])] if near else []
    assert rows(meetings.calendar_match(frame(x, "meeting"), frame(y, "event"), days=2)) == sorted(want, key=repr)
    plan = meetings.calendar_match(frame(x, "meeting"), frame(y, "event"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_caption_leaks_near_their_window(spark):
    lines = spark.createDataFrame([(1, 0, "We will ship it on Friday then"), (1, 1, "other words"), (2, 0, "we will ship it on friday"), (3, 0, None)], "page long, line int, text string")
    windows = spark.createDataFrame([(1, 100, 130), (1, 100, 130), (2, 900, 950), (3, None, 5)], "page long, starts long, ends long")
    cues = spark.createDataFrame([(160, "so we will ship it on friday"), (161, "other words"), (None, "x"), (5, None)], "at long, text string")
    assert rows(meetings.caption_leaks(lines, windows, cues).select("page", "line")) == [(1, 0)]
    assert meetings.caption_leaks(lines, windows, cues.limit(0)).count() == 0


def test_gold_takes_words_before_place_and_kinds(spark):
    words = [f"w{i}" for i in range(300)]
    text = " ".join(words)
    q = lambda a, n: " ".join(words[a : a + n])
    g = spark.createDataFrame([("a", 1, q(10, 12)), ("b", 1, q(200, 3)), ("c", 2, "no text here at all"), ("d", 1, None)], "gold string, evidence long, quote string")
    e = spark.createDataFrame([(1, q(11, 10), 5, "epic"), (1, q(11, 10), 6, "task"), (1, q(11, 10), 7, "task"), (1, q(30, 6), 1, "task"), (1, q(250, 6), 9, "risk"), (1, "said by nobody", 2, "task"), (None, None, 3, None)], "evidence long, quote string, node long, kind string")
    t = spark.createDataFrame([(1, text), (3, None)], "evidence long, text string")
    assert rows(meetings.match_gold(g, e, t, rank={"task": 3, "epic": 0})) == [("a", 6), ("b", 9), ("c", None), ("d", None)]


def test_uncovered_equals_brute_force(spark):
    rnd = random.Random(5)
    s = [(rnd.randrange(6), i, a, a + rnd.randrange(1, 30)) for i in range(300) for a in [rnd.randrange(200)]]
    p = [(rnd.randrange(5), a, a + rnd.randrange(0, 25)) for _ in range(20) for a in [rnd.randrange(200)]]
    got = rows(meetings.uncovered(spark.createDataFrame(s, "evidence long, pos long, starts long, ends long"), spark.createDataFrame(p, "evidence long, a long, b long")))
    assert got == sorted((x for x in s if not any(v == x[0] and a < x[3] and x[2] < b for v, a, b in p)), key=repr)
    assert 0 < len(got) < len(s)
    items = spark.createDataFrame([(1, "We agreed to send it on Monday. Fine. We agreed."), (2, None), (3, "")], "evidence long, text string")
    assert rows(meetings.cue_sentences(items, "agreed")) == [(1, 0, "We agreed to send it on Monday.", 0, 30)]


def test_order_key_states_and_deliverables(spark):
    i = spark.createDataFrame([("b", "2024-01-01", True, None), ("c", "2024-01-01", None, None), ("a", "2024-01-01", False, "b"), ("d", "2024-01-01", False, None)], "evidence string, at string, client boolean, duplicate_of string")
    assert rows(meetings.evidence_order(i).select("evidence", "pos")) == [("b", 2), ("c", 0), ("d", 1)]
    j = spark.createDataFrame([(1, "committed", "task", "t", "o"), (2, "committed", "task", "t", "o"), (2, "committed", "task", "t", "o"), (3, "proposed", None, None, None), (4, "proposed", "task", "t", "o")], "cid long, commitment string, kind string, title string, owner string")
    r = spark.createDataFrame([(2, "not_work"), (3, "not_work"), (4, "kept"), (9, "not_work")], "cid long, verdict string")
    a = spark.createDataFrame([(1, "not_work", None, None), (3, "declined", "", None), (4, "maybe", None, None), (8, "declined", None, None)], "cid long, kind string, title string, owner string")
    assert rows(meetings.merged_key(j, r, a, work=("declined",), default_title="set")) == [(1, "not_work", None, None, None, "user"), (2, "not_work", None, None, None, "judge"), (3, "declined", "task", "set", None, "user"), (4, "proposed", "task", "t", "o", "judge")]
    pool = spark.createDataFrame([(1, True), (2, True), (3, False), (4, None), (5, True)], "cid long, verifiable boolean")
    jd = spark.createDataFrame([(1, "committed", None), (5, "x", 1), (5, "x", 1), (7, "x", None)], "cid long, commitment string, duplicate_of long")
    assert rows(meetings.gold_states(pool, jd)) == [(1, "gold"), (2, "unjudged"), (3, "left out"), (4, "left out"), (5, "judged twice"), (7, "foreign")]
    s = spark.createDataFrame([(1, None, "2024-01-01", "2024-02-01"), (2, "in_progress", None, None), (3, "deleted", None, None)], "id long, state string, due string, last_seen string")
    t = spark.createDataFrame([(1, "2024-05-01", None), (1, "2024-04-01", "done"), (1, None, "open")], "story long, due string, state string")
    c = spark.createDataFrame([(1, True), (1, None)], "story long, met boolean")
    f = spark.createDataFrame([(2, "2024-01-01", "old"), (2, "2024-01-02", "new")], "story long, at string, title string")
    assert rows(meetings.deliverables(s, t, c, f)) == [(1, "open", "2024-01-01", "Red", "2024-05-01", 1, 2, None), (2, "in_progress", None, "Amber", None, 0, 0, "new")]


def test_conformed_mapped_and_previewed(spark):
    v = spark.createDataFrame([("b", " NORTH  east (abc) USA 7up"), ("b", "NE  1"), ("c", "as  is"), ("b", None)], "dim string, value string")
    al = spark.createDataFrame([("b", "ne 1", "Northeast"), ("b", "ne 1", "Northeast")], "dim string, norm string, entity string")
    got = {r["value"]: r["entity"] for r in marts.conformed(v, al, titled=("b",)).collect()}
    assert got == {" NORTH  east (abc) USA 7up": "North East (Abc) USA 7up", "NE  1": "Northeast", "as  is": "as is", None: None}
    r = spark.createDataFrame([("s", "Riverton "), ("s", "RIVERTON"), ("s", "Alone"), ("t", "Riverton "), ("s", None)], "sheet string, raw string")
    m = spark.createDataFrame([("Riverton", "R1"), ("Alone", "X")], "raw string, entity string")
    assert rows(marts.mapped_ambiguous(r, m)) == [("s", "Alone", "Alone"), ("s", "RIVERTON", "RIVERTON"), ("s", "Riverton ", "R1"), ("s", None, None), ("t", "Riverton ", "Riverton ")]
    p = spark.createDataFrame([("Plan  A - 12 the body", "p3 · plan a (part 2)"), ("body", None), (None, "x"), ("body", "")], "b string, t string")
    assert [x[0] for x in p.select(tx.preview(p.b, p.t)).collect()] == ["the body", "body", "", "body"]


def test_versions_merges_and_sections(spark):
    cols = "family string, metric string, grain string, entity string, month string, value double, source_file string, reported_in string"
    f = spark.createDataFrame([("f", "m", "g", "e", "2024-01", 1.0, "a", "2024-01"), ("f", "m", "g", "e", "2024-01", 2.0, "b", "2024-02"), ("f", "m", "g", "x", "2024-01", 3.0, "b", None)], cols)
    now = f.filter("source_file = 'b'")
    assert {r["entity"]: [tuple(o) for o in r["other_values"]] for r in marts.nested_versions(now, f).collect()} == {"e": [("a", 1.0, "2024-01")], "x": []}
    m = now.filter("entity = 'e'").selectExpr("family", "metric", "grain", "entity", "month", "source_file", "'sum' policy", "2 n_rows", "'[]' inputs")
    assert {r["entity"]: r["merged_from"] and r["merged_from"]["n_rows"] for r in marts.attach_merges(now, m.unionByName(m)).collect()} == {"e": 2, "x": None}
    c = spark.createDataFrame([(1, "s", 2, "apple pie"), (2, "s", 1, "apple tart"), (3, None, 0, None)], "id long, source string, ord long, text string")
    t = spark.createDataFrame([(1, "pies", "Pies"), (2, "pies", "Pies"), (2, "pies", "Pies")], "chunk_id long, category_id string, category_label string")
    assert [r["id"] for r in search.tagged_sections(c, t, "PIES").collect()] == [2, 1]
    asked = spark.createDataFrame([("pies", "apple"), ("cakes", "apple")], "query_id string, text string")
    assert rows(search.retag_candidates(asked, search.tokenised(c, "id", "text"), t).select("query_id", "id")) == [("cakes", 1), ("cakes", 2)]
    h = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "a", 3)], "query_id string, source string, rank int")
    assert rows(search.section_evidence(h, asked.selectExpr("query_id").unionByName(h.select("query_id")), 1)) == [("cakes", 0, None, True), ("pies", 0, None, True), ("q", 3, "b", False)]
