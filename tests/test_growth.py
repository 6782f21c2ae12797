"""What a task holds must not grow with the table: plans and partitions of steps that once did."""

import difflib
import random

from pyspark.sql import functions as F

from quern.operators import batches, index, marts, matching, meetings, search, selection, wordsets
from quern.sources.scratch import dealt


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]


def test_dealt_rows_keep_their_key_together(spark):
    x = dealt(spark.range(100).select((F.col("id") % 10).alias("k")), 100, "k", each=25)
    assert x.rdd.getNumPartitions() == 4
    assert x.select("k", F.spark_partition_id().alias("p")).distinct().count() == 10
    assert dealt(x, None, "k", each=25).rdd.getNumPartitions() == 1


def test_bm25_sums_a_document_where_its_tokens_are(spark):
    """Scores are not shuffled by query and document."""
    docs = spark.createDataFrame([(1, "red green red"), (2, "green"), (3, "blue")], "id long, text string")
    asked = spark.createDataFrame([(7, "red green"), (8, "green")], "query_id long, text string")
    got = search.bm25(asked, search.tokenised(docs, "id", "text"))
    assert sorted((r["query_id"], r["id"]) for r in got.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    assert not [x for x in exchanges(got) if "hashpartitioning(query_id" in x]
    best = matching.task_candidates(asked.select(F.col("query_id").alias("msg_id"), "text", F.lit("2026-01-02").alias("day")), docs.select(F.col("id").cast("string").alias("task_id"), "text", F.lit("2026-01-01").alias("created")))
    assert sorted((r["msg_id"], r["task_id"], r["rank"]) for r in best.collect()) == [(7, "1", 1), (7, "2", 2), (8, "1", 2), (8, "2", 1)]
    assert not [x for x in exchanges(best) if "hashpartitioning(m" in x and "task_id" in x]


def test_hidden_chunks_are_cut_before_they_are_made_distinct(spark):
    scored = spark.createDataFrame([(1, k, 1.0) for k in range(6)], "query_id long, id long, score double")
    chunks = spark.range(6).select("id", F.lit("s").alias("source"), F.when(F.col("id") < 2, "OLD").alias("status"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    hints = search.hybrid([(scored, 0.5), (scored, 0.5)], chunks)[1]
    assert [tuple(r) for r in hints.collect()] == [(1, 2)]
    plan = hints._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert max(i for i, x in enumerate(plan) if "Aggregate" in x and "query_id" in x and "count" not in x) < min(i for i, x in enumerate(plan) if "Join LeftSemi" in x)


def test_mismatches_and_collisions_are_dealt_once(spark):
    """One shuffle each: no sides joined, no row numbers counted over all rows of a file in one task."""
    m, s = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,), (3,)], "k long")
    got = index.mismatches(m, s, "k")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "manifest"), (3, "scan")]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(40).select(F.lit("f").alias("family"), F.lit("g").alias("grain"), F.lit("e").alias("entity"), F.lit("2026-01").alias("month"), F.lit("s").alias("source_file"), (F.col("id") / 2).cast("long").alias("_row"), F.when(F.col("id") % 2 == 0, "p").otherwise("w").alias("metric"), F.col("id").cast("double").alias("value"))
    plan = marts.resolve_collisions(rows, {"p": "weighted_mean"}, weight_metric="w")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


def test_word_sets_meet_as_numbers_after_their_bits(spark):
    """Pairs carry no words, and pairs that bits rule out are not formed."""
    words = [f"w{i:03d}" for i in range(60)]
    frames = spark.createDataFrame([(1, " ".join(words[:30])), (2, " ".join(words[:28] + words[40:42])), (3, " ".join(words[25:55])), (4, " ".join(words[:30]))], "id long, body string")
    got = matching.redundant_pairs(frames, least=0.75)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 2, 1, 0.875)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "array_union" not in plan


def test_plain_text_is_made_once_a_document(spark):
    """Not again for each sentence."""
    items = spark.createDataFrame([(1, "One two three four five six. And the seven eight nine ten! the end"), (2, None)], "evidence long, text string")
    got = meetings.cue_sentences(items, "the")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "And the seven eight nine ten!", 28, 56)]
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    above = plan[: next(i for i, x in enumerate(plan) if "Generate" in x)]
    assert not [x for x in above if "regexp_replace" in x]


def test_vector_blocks_meet_in_strips(spark):
    """Strips give the pairs of the whole block."""
    v = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k % 5)]) for k in range(30)], "id long, embedding array<double>")
    found = [sorted(tuple(r) for r in search.blockwise_pairs(v, v, 0.9, block_rows=16, strip=n).collect()) for n in (3, 64)]
    assert found[0] == found[1] and found[0] and all(a != b for a, b, _ in found[0])


def test_similar_titles_meet_by_rare_words(spark):
    """A word of all titles pairs nobody that shares nothing else."""
    rows = [(f"n{k}", "task", f"common a{k}x b{k}x c{k}x", None) for k in range(20)] + [("m", "task", "common a1x b1x zz", None)]
    nodes = spark.createDataFrame(rows, "node string, kind string, title string, parent_title string")
    assert sorted(tuple(r) for r in matching.similar_nodes(nodes, least=0.5).collect()) == [("m", "n1", 0.6, 1), ("n1", "m", 0.6, 1)]
    plan = matching.similar_nodes(nodes, least=0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan  # pairs come from the written rare words


def loop_claims(base, draft, least):
    free, out = {(f"~{p:06d}" if c is None else c): (n, t) for p, c, n, t in base}, []
    for pos, cid, norm, tags in draft:
        key = cid if cid in free else min((k for k, (n, _) in free.items() if n == norm), default=None)
        if key is None:
            ratios = [(-r, k) for k, (n, _) in free.items() if (r := difflib.SequenceMatcher(None, norm, n).ratio()) >= least]
            key = min(ratios)[1] if ratios else None
        if key is None:
            out.append((pos, None, "added"))
            continue
        was, cited = free.pop(key)
        out.append((pos, None if key[0] == "~" else key, "reworded" if was != norm else "kept" if sorted(cited) == sorted(tags) else "recited"))
    return out + [(None, None if k[0] == "~" else k, "dropped") for k in free]


def test_claims_stream_many_sections_a_task(spark):
    """A section costs its claims and no frame or task of its own; one may lie over several batches."""
    rng = random.Random(5)
    line = lambda: "".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 8, 9])))
    some = lambda: [(p, rng.choice([None, None, f"c{p % 7}"]), line(), rng.choice([[], ["x"], ["y", "x"], ["x", "y"]])) for p in range(rng.randrange(12))]
    base, draft, wanted = [], [], []
    for task, section in [("t", "a"), ("t", "b"), ("u", "a"), ("u", None), ("v", "z"), ("w", "z")]:
        b, d = some(), some()
        base += [(task, section, *x) for x in b]
        draft += [(task, section, *x) for x in d]
        wanted += [(task, section, *x) for x in loop_claims(b, d, 0.7)]
    schema = "task string, section string, pos int, claim_id string, normalized string, tags array<string>"
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = matching.match_claims(spark.createDataFrame(base, schema), spark.createDataFrame(draft, schema), 0.7)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
        assert "CoGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_span_pool_sends_on_shared_runs_only(spark, monkeypatch):
    """Runs go as numbers, those of one quote alone go no further, and leaders come from the pairs that were written."""
    written = {}
    settled = selection.settled

    def kept(df, name):
        out = settled(df, name)
        written.setdefault(name, out)
        return out

    monkeypatch.setattr(selection, "settled", kept)
    a, b = "one two three four five six", "one two three four five nine"
    rows = [(1, 1, 0, a, "x"), (2, 1, 500, b, "y"), (3, 1, 900, "seven eight nine ten eleven twelve", "x"), (4, 2, 0, a, "y"), (5, 1, 10, "short", "z")]
    got = selection.span_pool(spark.createDataFrame(rows, "id long, evidence long, offset int, quote string, source string").withColumn("place", F.col("id")))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "x,y,z"), (2, 1, "x,y,z"), (3, 3, "x"), (4, 4, "y"), (5, 1, "x,y,z")]
    assert dict(written["runs"].dtypes)["run"] == "bigint" and sorted(r["id"] for r in written["runs"].collect()) == [1, 2]
    assert "array_intersect" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "tile" not in plan


def test_words_of_blocks_are_counted_once(spark, monkeypatch):
    """Whatever counts the words of texts runs in one step, not in each that uses the counts."""
    plans = []
    settled = batches.settled

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return settled(df, name)

    monkeypatch.setattr(batches, "settled", kept)
    blocks = spark.createDataFrame([(1, 1, 0, "aaaa"), (1, 1, 1, "aaa"), (1, 2, 0, "")], "doc int, section int, block int, text string").withColumn("words", F.levenshtein("text", F.lit("")))
    got = batches.word_batches(blocks, spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "doc int, section int, heading_words int"), 5)
    plans.append(("result", got._jdf.queryExecution().optimizedPlan().toString()))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0, 2, 4, 0), (1, 1, 1, 2, 3, 1), (1, 2, 0, 1, 1, 1)]
    assert [name for name, plan in plans if "levenshtein" in plan] == ["blocks"]


def word_pairs(docs, least):
    """By every two sets: (a, b, n_a, n_b, score) of classes of equal sets."""
    sets = {}
    for i, t in docs:
        sets.setdefault(frozenset(t.split()), set()).add(i)
    named = [(min(ids), len(ids), s) for s, ids in sets.items() if len(s) >= 15]
    return sorted((a, b, n, m, round(len(x & y) / len(x | y), 3)) for a, n, x in named for b, m, y in named if a < b and len(x & y) >= least * len(x | y))


def test_alike_sets_go_to_a_tile_once(spark, monkeypatch):
    """Pairs carry no sets; rounds, tiles and parts of any size give all pairs, also if an id has two bodies."""
    for name, value in (("ROUND", 900), ("AT_ONCE", 50), ("TILE", 3), ("FREQUENT", 40), ("MORE", 8)):
        monkeypatch.setattr(wordsets, name, value)
    rng = random.Random(8)
    docs = []
    for g in range(6):
        base = [f"g{g}w{k:03d}" for k in range(15 + 12 * g)] + [f"all{k:02d}" for k in range(12)]
        docs += [(len(docs) + k, " ".join(rng.sample(base, len(base) - rng.randrange(8)) + [f"own{rng.randrange(40)}x"] * rng.randrange(2))) for k in range(14)]
    docs += [(200, docs[3][1]), (5, docs[20][1] + " more"), (5, docs[40][1] + " more")]
    frames = spark.createDataFrame(docs, "id long, body string")
    for least in (0.6, 0.75):
        got = wordsets.alike(wordsets.word_sets(frames, 15), least)
        assert sorted((*r[:4], round(r[4], 3)) for r in got.collect()) == word_pairs(docs, least)
        assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert matching.redundant_pairs(frames.limit(0)).count() == 0
