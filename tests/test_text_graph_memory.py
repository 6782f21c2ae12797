"""Text columns, graphs, retrieval and ledgers on small literal tables."""

import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import graph, memory, search


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def test_text_columns(spark):
    assert one(spark, " Ab--C d! ", tx.slug) == "ab_c_d" and one(spark, "!!", tx.slug) == "n"
    assert one(spark, "  A \t b ", tx.header) == "a b"
    assert one(spark, "One. Two? three", tx.sentences) == ["One.", "Two?", "three"]
    assert [one(spark, v, tx.number) for v in ("$1,200.5", "12%", "01:02:03", "n/a", None)] == [1200.5, 12.0, 3723.0, None, None]
    assert [one(spark, v, tx.is_dimension_value) for v in ("North", " Grand Total ", "#REF!", "", None)] == [True, False, False, False, False]
    assert one(spark, "00:01:02,500", tx.clock_seconds) == 62.5
    assert one(spark, "ﬁne “Q”", tx.folded) == "fine q"
    a, b = F.split(F.lit("a b c"), " "), F.split(F.lit("b c d"), " ")
    r = spark.range(1).select(tx.jaccard(a, b).alias("j"), tx.containment(a, b).alias("c"), tx.shingles(a, 2).alias("s"), tx.shingles(a, 4).alias("e"), tx.ratio(F.lit("abcd"), F.lit("bcde")).alias("r")).first()
    assert (r["j"], r["c"], r["s"], r["e"], r["r"]) == (0.5, pytest.approx(2 / 3), ["a b", "b c"], [], 0.75)
    t = spark.range(1).select(tx.title(F.lit("Page 3"), F.lit("--\nfirst real line here")).alias("t"), tx.title(F.lit("Head"), F.lit("x")).alias("h")).first()
    assert (t["t"], t["h"]) == ("first real line here", "Head")


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {(r["source"], r["target"]): r["depth"] for r in graph.closure(e).collect()}
    assert got["a", "d"] == 3 and got["b", "a"] == 2 and ("a", "a") not in got and len(got) == 9


def test_closure_reaches_the_far_end_of_long_chains(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(36)], "source int, target int").coalesce(1)
    got = graph.closure(e)
    assert got.count() == 36 * 37 // 2 and got.filter("source = 0 and target = 36").first()["depth"] == 36
    assert graph.closure(e, max_depth=3).agg(F.max("depth")).first()[0] == 3


def test_tags_follow_aliases_and_parents(spark):
    nodes, edges = graph.tree(spark.createDataFrame([("Top", "Kid One"), ("Top", None)], "parent_label string, label string"), "l1", "l2")
    assert [(r["source"], r["target"]) for r in edges.collect()] == [("kid_one", "top")]
    labels = spark.createDataFrame([(1, ["Kid one"]), (2, ["__no_topic__"]), (3, ["nope"]), (4, ["Old", "Kid One"])], "chunk_id long, labels array<string>")
    tags, verdicts = graph.write_tags(labels, nodes, spark.createDataFrame([("old", "kid_one")], "alias_id string, node_id string"))
    assert sorted((r["chunk_id"], r["category_id"]) for r in tags.collect()) == [(1, "kid_one"), (1, "top"), (4, "kid_one"), (4, "top")]
    r = graph.tag_coverage(labels, tags, verdicts).first()
    assert (r["total"], r["tagged"], r["no_topic"], r["untagged"]) == (4, 2, 1, 1)


def test_snapshots_and_scores(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, c string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "n")], "k long, c string")
    assert {r["k"]: r["change"] for r in graph.snapshot_delta(a, b, "k", "c").collect()} == {1: "deleted", 2: "changed", 3: "unchanged", 4: "added"}
    s = lambda rows: spark.createDataFrame(rows, "k long, score double")
    got = graph.score_diff(s([(1, 0.4), (2, 0.6), (3, 0.6), (4, 0.6), (5, 0.1)]), s([(1, 0.6), (2, 0.7), (3, 0.55), (4, 0.605), (6, 1.0)]), "k")
    assert {r["k"]: r["change"] for r in got.collect()} == {1: "flipped", 2: "improved", 3: "regressed", 4: "stable", 5: "missing", 6: "new"}


def test_as_of_facts(spark):
    a = spark.createDataFrame([("a1", "e", "p", "old", "2025-09-01", 1), ("a2", "e", "p", "mid", "2025-09-10", 1), ("a3", "e", "p", "new", "2025-11-01", 1)], "assertion_id string, entity string, predicate string, value string, at string, authority int")
    a = a.withColumn("asserted_at", F.col("at").cast("timestamp")).drop("at")
    links = spark.createDataFrame([("a2", "supersedes", "a1"), ("a3", "supersedes", "a2")], "assertion_id string, relation string, target string")
    now = lambda t: [(r["value"], r["conflicted"]) for r in memory.current_facts(a, links, t).collect()]
    assert now("2025-12-01") == [("new", False)] and now("2025-09-20") == [("mid", False)] and now("2025-01-01") == []
    made = {(r["assertion_id"], r["relation"], r["target"]) for r in memory.supersede_links(a).collect()}
    assert made == {("a2", "supersedes", "a1"), ("a3", "supersedes", "a2"), ("a3", "supersedes", "a1")}


def test_fold_pins_and_lint(spark):
    ev = spark.createDataFrame([(1, 1, "create", "t1"), (1, 2, "edit", "t2"), (1, 3, "pin", None), (1, 4, "edit", "t3"), (1, 5, "close", None), (1, 6, "mention", None)], "node long, seq long, op string, value string").withColumn("at", F.col("seq"))
    r = memory.fold_events(ev).first()
    assert (r["state"], r["title"], r["n_edits"], r["n_events"]) == ("done", "t2", 2, 6)
    nodes = spark.createDataFrame([("a", None, "done", "A"), ("b", "a", "open", "Same"), ("c", "a", "open", " same"), ("d", None, "open", "D"), ("e", "d", "done", "E")], "node string, parent string, state string, title string")
    assert sorted((r["rule"], r["node"]) for r in memory.tree_lint(nodes).collect()) == [("C17", "c"), ("C18", "b"), ("C18", "c"), ("C20", "d")]


def test_turns(spark):
    t = spark.createDataFrame([(1, 0, "a", "x" * 5), (1, 1, "a", "y"), (1, 2, "b", "ok"), (1, 3, "a", "z" * 9)], "conv long, pos long, speaker string, text string")
    assert [(r["speaker"], r["n"]) for r in memory.merge_turns(t, 5).orderBy("island").collect()] == [("a", 2), ("b", 1), ("a", 1)]
    assert [r["text"] for r in memory.fold_turns(t, 4).orderBy("pos").collect()] == ["xxxxx [a: y] [b: ok]", "z" * 9]
    assert [(r["n"], r["size"]) for r in memory.pack_turns(t, 8).orderBy("pack").collect()] == [(3, 8), (1, 9)]


def test_nearest_event(spark):
    side = lambda rows: spark.createDataFrame(rows, "key long, at timestamp, id long")
    from datetime import datetime

    at = lambda m: datetime(2024, 1, 1, 0, m)
    got = memory.nearest_event(side([(1, at(10), 1), (2, at(0), 2)]), side([(1, at(5), 10), (1, at(12), 11), (2, at(50), 12)]), seconds=600).collect()
    assert [(r["id"], r["other"], r["gap"]) for r in got] == [(1, 11, 120.0)]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "blue sky high")], "id long, text string")
    hits = search.top_per(search.bm25(spark.createDataFrame([(0, "Red apple?")], "query_id long, text string"), search.tokenised(docs, "id", "text")), "query_id", 5)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == [1, 2]
    fused = search.fuse([(hits.select("query_id", "id", "rank"), 0.4), (spark.createDataFrame([(0, 3, 1)], "query_id long, id long, rank int"), 0.6)], 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in fused] == [(3, round(0.6 / 61, 6)), (1, round(0.4 / 61, 6))]
    chunks = spark.createDataFrame([("s", k, "x" * n) for k, n in enumerate((700, 300, 50))], "source string, ord int, text string")
    assert [(r["ord"], r["next_ord"]) for r in search.document_page(chunks, max_chars=600).collect()] == [(0, 1)]


def test_names_and_guarded_statements(spark):
    s = spark.createDataFrame([("Alpha.md", 1), ("alpha.md", 2), ("beta/x.md", 3), (None, 4)], "source string, name int")
    n = spark.createDataFrame([("alpha.md",), ("BETA/x.md",), ("eta",), ("ALPHA.md",), (".md",), ("zz",), (None,), ("",), ("b",)], "name string")
    got = {r["name"]: (r["status"], r["source"], r["n_matches"]) for r in search.resolve_names(n, s).collect()}
    assert got == {
        "alpha.md": ("exact", "alpha.md", 2), "BETA/x.md": ("folded", "beta/x.md", 1), "eta": ("unique", "beta/x.md", 1), "ALPHA.md": ("ambiguous", None, 2), ".md": ("ambiguous", None, 3), "zz": ("not_found", None, 0),
        "b": ("unique", "beta/x.md", 1),
    }
    assert search.guarded(" select 'drop; x' as a; ") == "select 'drop; x' as a"
    for bad in ("drop table t", "select 1; select 2", "with a as (delete from t) select 1", "", "-- select", "explain select 1"):
        with pytest.raises(ValueError):
            search.guarded(bad)


def test_hybrid_search_filters_before_it_ranks(spark):
    chunks = spark.createDataFrame([(k, f"S{k % 2}", "SUPERSEDED" if k == 1 else None, None, None) for k in range(6)], "id long, source string, status string, valid_from timestamp, valid_to timestamp")
    scored = spark.createDataFrame([("q", k, 1.0 - k / 10) for k in range(6)], "query_id string, id long, score double")
    hits, hints = search.hybrid([(scored, 0.4), (scored.limit(0), 0.6)], chunks, pool=2, source_contains="s1", tags=chunks.filter("id = 5").select("id"), tag_boost=True)
    assert [(r["id"], r["rank"], r["score"]) for r in hits.orderBy("rank").collect()] == [(5, 1, round(0.4 / 62 + 0.6 / 61, 5)), (3, 2, round(0.4 / 61, 5))]
    assert [(r["query_id"], r["n_hidden"]) for r in hints.collect()] == [("q", 1)]
