"""Index, taxonomy and evidence operators on nulls, ties, repeats, empty tables and extra columns, and text alignment against brute force."""

import itertools
import random
from collections import Counter

import pytest

from quern.operators import evidence, index, taxonomy


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upserts_and_supersession(spark):
    stored = spark.createDataFrame([(1, "a", "SUPERSEDED"), (2, "b", None), (3, None, "ACTIVE"), (None, "x", "ACTIVE")], "id long, content_hash string, status string")
    new = spark.createDataFrame([(1, "a", 0), (2, "c", 0), (3, None, 0), (4, "d", 0), (None, "y", 0)], "id long, content_hash string, old int")
    assert rows(index.upsert_plan(stored, new)) == [(1, "keep", "a", "SUPERSEDED"), (2, "embed", "c", "ACTIVE"), (3, "embed", None, "ACTIVE"), (4, "embed", "d", "ACTIVE")]
    assert index.upsert_plan(stored.limit(0), new.limit(0)).count() == 0
    c = spark.createDataFrame([(1, "s", None, None), (2, "s", "SUPERSEDED", False), (3, "t", "SUPERSEDED", True), (4, None, "ACTIVE", False)], "id long, source string, status string, owned boolean")
    d = spark.createDataFrame([("s", "2020-01-01"), ("s", "2019-01-01"), ("t", "2026-01-01")], "source string, d string").selectExpr("source", "timestamp(d) as event_date")
    assert rows(index.supersede_by_date(c, d, "2021-01-01")) == [(1, "s", "SUPERSEDED", True), (2, "s", "SUPERSEDED", False), (3, "t", "ACTIVE", False), (4, None, "ACTIVE", False)]


def test_deltas_and_queues(spark):
    b = spark.createDataFrame([("r", "p1", "x"), ("r", "p2", None), ("off", "p3", "x"), ("r", "p4", "x")], "root string, path string, sha string")
    a = spark.createDataFrame([("r", "p1", "y"), ("r", "p2", None), ("r", "p5", "x")], "root string, path string, sha string")
    assert rows(index.raw_delta(b, a, spark.createDataFrame([("r",)], "root string"))) == [("p1", "changed"), ("p2", "unchanged"), ("p3", "unavailable"), ("p4", "removed"), ("p5", "added")]
    e = spark.createDataFrame([("i", "queue", 1), ("i", "done", 2), ("j", "done", 1), ("j", "queue", 1), (None, "queue", 3)], "item string, kind string, seq int")
    assert rows(index.queue_state(e, ["queue"], ["done"])) == [("j", 1)]
    assert {r["status"] for r in index.health({"x": e, "y": e.limit(0)}).collect()} == {"healthy", "degraded"}


def test_chains_paths_cycles_and_levels(spark):
    m = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (7, 5), (8, None), (9, 9)], "node long, into long")
    assert {r["node"]: r["survivor"] for r in taxonomy.merge_ends(m).collect()} == {1: 3, 2: 3, 5: 5, 6: 5, 7: 5}
    n = spark.createDataFrame([(1, "A", None), (2, "B", 1), (3, "C", 2), (4, "X", 5), (5, "Y", 4), (6, "Z", 99), (3, "C", 2)], "id long, label string, parent long")
    assert rows(taxonomy.paths(n).select("id", "path", "root")) == [(1, "A", 1), (2, "A > B", 1), (3, "A > B > C", 1), (6, "Z", 6)]
    e = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a"), ("c", "b")], "node string, needs string")
    assert rows(taxonomy.topological_levels(e)) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        taxonomy.topological_levels(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, needs string"))
    assert taxonomy.topological_levels(e.limit(0)).count() == 0
    g = taxonomy.components(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 51), (51, None)], "a long, b long"))
    assert {r["node"]: r["group"] for r in g.collect()} == {**{k: 0 for k in range(41)}, 50: 50, 51: 50}


def test_patterns_and_decisions(spark):
    labels = [(f"Store {k} sales",) for k in range(9)] + [("Store 1 sales",), ("Plain",), ("Q1 x",), ("Q2 x",), (None,)]
    assert rows(taxonomy.naming_patterns(spark.createDataFrame(labels, "label string"))) == [("# x", 2, False), ("store # sales", 9, True)]
    r = spark.createDataFrame([("i", "reject", 1), ("i", "reopen", 2), ("j", "reject", 1), ("j", "propose", 3), ("j", "withdraw", 4), ("j", "propose", 5), ("k", "accept", 1)], "item string, action string, seq int")
    assert rows(taxonomy.standing(r, sets="reject", lifts=["reopen"])) == [("j", 1)]
    assert rows(taxonomy.review_state(r)) == [("i", "reject", 0), ("j", "reject", 1), ("k", "accept", 0)]
    v = spark.createDataFrame([("u", "b", 2), ("u", "a", 1), ("u", None, 0)], "k string, v string, at int")
    assert rows(taxonomy.majority(v, "k", "v", "at")) == [("u", "a", 1)]


def test_text_alignment_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        t, q = ([rng.choice("a b c d E".split()) for _ in range(rng.randint(0, 12))] for _ in range(2))
        runs = [(n, -j, " ".join(t[j : j + n])) for j, n in itertools.product(range(len(t)), range(1, len(t) + 1)) if j + n <= len(t) and any([w.lower() for w in t[j : j + n]] == [w.lower() for w in q[i : i + n]] for i in range(len(q)))]
        best = max(runs, default=(0,))
        assert evidence.snapped(" ".join(q), " ".join(t), 2) == (best[2] if best[0] >= 2 else None)
        low = Counter(w.lower() for w in q)
        spans = [(-sum((Counter(w.lower() for w in t[j : j + n]) & low).values()), abs(n - len(q)), j, n) for n in range(max(1, len(q) - 2), len(q) + 3) for j in range(len(t) - n + 1)] if q else []
        top = min(spans, key=lambda s: s[:3], default=None)
        got = evidence.closest(" ".join(t), " ".join(q))
        if top is None or -top[0] < 0.6 * len(q):
            assert got is None
        else:
            n = Counter(w.lower() for w in (got or "").split())
            assert sum((n & low).values()) == -top[0]
    assert evidence.snapped(None, "a b") is None and evidence.closest(None, None) is None


def test_admission_and_queue(spark):
    e = spark.createDataFrame([(1, "x", "We Will ship", 0), (2, "x", "will ship", 0), (3, "x", "will not ship", 0), (4, "y", "a b c", 0), (5, "x", "we will ship", 9), (6, None, None, None)], "mid int, evidence string, quote string, n_criteria int")
    ev = spark.createDataFrame([("x", "Yes, we will: ship!", 1)], "id string, text string, mid int")
    assert rows(evidence.admit(e, ev)) == [(1, "admitted"), (2, "short"), (3, "not verbatim"), (4, "no evidence"), (5, "criteria"), (6, "no evidence")]
    t = spark.createDataFrame([("c", k, f"t{k}") for k in range(6)], "conv string, pos int, text string")
    own = spark.createDataFrame([(1, "c", 0), (2, "c", 4)], "mid int, conv string, pos int")
    v = spark.createDataFrame([(1, "kept"), (2, "weak"), (2, None)], "mid int, verdict string")
    assert rows(evidence.verification_queue(own, v, t)) == [(2, "t2\nt3\nt4\nt5")]


def test_meetings_and_slots(spark):
    t = spark.createDataFrame([("c", 0, "a", "one two three four"), ("c", 1, "b", "mm hm"), ("c", 2, "a", "five six seven eight"), ("c", 3, "b", "now a long turn of b"), ("c", 4, "b", None)], "conv string, pos int, speaker string, text string")
    assert rows(evidence.back_channels(t)) == [("c", 0, 1), ("c", 1, None), ("c", 2, 1), ("c", 3, 2), ("c", 4, 2)]
    assert rows(evidence.room_audio(t, share=0.5, least=3)) == [("c", "a", 0.5, 16, True)]
    at = lambda df: df.selectExpr(df.columns[0], "key", "timestamp(at) as at")
    s = at(spark.createDataFrame([(1, "k", "2026-01-01 10:00:00"), (2, "k", "2026-01-01 23:55:00"), (3, None, "2026-01-01 10:00:00")], "slot int, key string, at string"))
    e = at(spark.createDataFrame([(7, "k", "2026-01-01 10:20:00"), (8, "k", "2026-01-01 09:40:00"), (9, "k", "2026-01-02 00:05:00")], "event int, key string, at string"))
    assert rows(evidence.slot_match(s, e)) == [(1, 8, 1200), (2, None, None), (3, None, None)]
    snaps = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (3, 1, "b"), (1, 2, None), (2, 2, None), (3, 2, "x")], "snap int, id int, content string")
    assert rows(evidence.snapshot_changes(snaps)) == [(0, 1, "new"), (1, 2, "new"), (2, 1, "gone"), (3, 1, "new"), (3, 2, "changed")]


def test_coverage_lens_by_equal_beginnings(spark):
    from quern.operators import evidence

    one = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    keys, evals = one("abcd/1", "abcd/2", "abx", "ab", "zz", None, "zz"), one("abcd", "abcd/", "ab", "abxy", None)
    assert tuple(evidence.coverage_lens(keys, evals).first()) == (5, 2, 40.0)
    assert tuple(evidence.coverage_lens(keys, one()).first()) == (5, 0, 0.0)
    assert tuple(evidence.coverage_lens(one(), evals).first()) == (0, 0, 0.0)
