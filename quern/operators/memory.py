"""Assertions, questions, event folds, staleness and tree lint.

Assertions: assertion_id, entity, predicate, value, asserted_at, authority. Links: assertion_id, relation, target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_facts(assertions: DataFrame, links: DataFrame, as_of) -> DataFrame:
    """entity, predicate, value, assertion_id, n_active, conflicted at ``as_of``.

    What a link supersedes or retracts is out, if both ends are known by then; the winner is the last by time, authority and id;
    several active values are a conflict.
    """
    known = assertions.filter(F.col("asserted_at") <= F.lit(as_of).cast("timestamp"))
    out = links.filter(F.col("relation").isin("supersedes", "retracts")).join(known.select("assertion_id"), "assertion_id", "left_semi").select(F.col("target").alias("assertion_id")).distinct()
    active = known.join(out, "assertion_id", "left_anti")
    order = F.struct("asserted_at", "authority", "assertion_id")
    return active.groupBy("entity", "predicate").agg(
        F.max_by("value", order).alias("value"), F.max_by("assertion_id", order).alias("assertion_id"), F.count("*").alias("n_active"), (F.countDistinct("value") > 1).alias("conflicted")
    )


def supersede_links(assertions: DataFrame) -> DataFrame:
    """assertion_id, relation, target: a newer assertion of another value supersedes every earlier one of its key; at the same instant they contradict.

    All those links are the result, as many as pairs of different values of a key (entity, predicate); equal values are not linked. Null keys, times and values link with nothing.
    """
    prior = assertions.select("entity", "predicate", F.col("asserted_at").alias("before"), F.col("assertion_id").alias("target"), F.col("value").alias("old"))
    j = assertions.join(prior, ["entity", "predicate"]).filter((F.col("value") != F.col("old")) & (F.col("before") <= F.col("asserted_at")))
    j = j.filter((F.col("before") < F.col("asserted_at")) | (F.col("assertion_id") > F.col("target")))
    return j.select("assertion_id", F.when(F.col("before") < F.col("asserted_at"), "supersedes").otherwise("contradicts").alias("relation"), "target")


def question_status(questions: DataFrame, answers: DataFrame, as_of) -> DataFrame:
    """question_id, state (open or resolved), answer_id of the latest answer, for questions asked by ``as_of``."""
    t = F.lit(as_of).cast("timestamp")
    last = answers.filter(F.col("answered_at") <= t).groupBy("question_id").agg(F.max_by("answer_id", F.struct("answered_at", "answer_id")).alias("answer_id"))
    return questions.filter(F.col("asked_at") <= t).join(last, "question_id", "left").select("question_id", F.when(F.col("answer_id").isNull(), "open").otherwise("resolved").alias("state"), "answer_id")


def new_rows(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` to append, with a state: ``new``, or ``clash`` where the stored row of that key differs; equal rows are left out."""
    content = F.xxhash64(*[F.col(c) for c in sorted(incoming.columns)])
    have = stored.select(F.col(key).alias("__k"), content.alias("__h"))
    j = incoming.withColumn("__c", content).join(have, F.col(key) == F.col("__k"), "left")
    return j.filter(F.col("__h").isNull() | (F.col("__h") != F.col("__c"))).withColumn("state", F.when(F.col("__h").isNull(), "new").otherwise("clash")).drop("__k", "__h", "__c")


def fold_events(events: DataFrame) -> DataFrame:
    """node, state, n_events, n_edits, title, last_at of events (node, seq, op, value, at): the state after the last op that sets one, the title of the last edit not pinned before it.

    One aggregation by node: order is ``seq``, never arrival. ``pin`` holds the title against later ``edit`` events; ``mention`` changes nothing.
    """
    sets = F.when(F.col("op") == "create", "open").when(F.col("op") == "close", "done").when(F.col("op") == "reopen", "open").when(F.col("op") == "drop", "dropped")
    w = Window.partitionBy("node")
    pinned = F.min(F.when(F.col("op") == "pin", F.col("seq"))).over(w)
    marked = events.withColumn("sets", sets).withColumn("pinned", pinned)
    edit = F.col("op").isin("create", "edit") & (F.col("pinned").isNull() | (F.col("seq") < F.col("pinned")))
    return marked.groupBy("node").agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("seq"))).alias("state"), F.count("*").alias("n_events"), F.count_if(F.col("op") == "edit").alias("n_edits"),
        F.max_by("value", F.when(edit, F.col("seq"))).alias("title"), F.max("at").alias("last_at"),
    )


def pending(events: DataFrame) -> DataFrame:
    """evidence of which the last of its processed and reprocess events (evidence, type, seq) asks to be read again."""
    last = events.filter(F.col("type").isin("processed", "reprocess")).groupBy("evidence").agg(F.max_by("type", "seq").alias("last"))
    return last.filter("last = 'reprocess'").select("evidence")


def stale_rows(mentions: DataFrame, *, least_silence: int, per_story: int = 2, limit: int = 15) -> DataFrame:
    """story, node, silence, place: open nodes (story, node, last_pos, n_pos) silent for ``least_silence`` meetings or more; 2 of a story, 15 in all, longest silence first."""
    s = mentions.withColumn("silence", F.col("n_pos") - F.col("last_pos")).filter(F.col("silence") >= least_silence)
    order = [F.col("silence").desc(), F.col("node")]
    own = s.withColumn("k", F.row_number().over(Window.partitionBy("story").orderBy(*order))).filter(F.col("k") <= per_story)
    top = own.orderBy(*order).limit(limit)
    return top.select("story", "node", "silence", F.row_number().over(Window.orderBy(*order)).alias("place"))


def tree_lint(nodes: DataFrame) -> DataFrame:
    """rule, node, other of nodes (node, parent, state, title): C17 open siblings with one title, C18 open under closed, C20 open whose children are all done."""
    title = F.lower(F.trim("title"))
    twins = nodes.filter("state = 'open' and title is not null").groupBy("parent", title.alias("t")).agg(F.min("node").alias("other"), F.count("*").alias("n"), F.collect_list("node").alias("ns")).filter("n > 1")
    c17 = twins.select(F.explode("ns").alias("node"), "other").filter("node <> other").select(F.lit("C17").alias("rule"), "node", "other")
    up = nodes.select(F.col("node").alias("parent"), F.col("state").alias("pstate"))
    c18 = nodes.filter("state = 'open'").join(up, "parent").filter("pstate in ('done', 'dropped')").select(F.lit("C18").alias("rule"), "node", F.col("parent").alias("other"))
    kids = nodes.filter("parent is not null").groupBy("parent").agg(F.every(F.col("state") == "done").alias("all_done"))
    c20 = kids.filter("all_done").join(nodes.filter("state = 'open'").select(F.col("node").alias("parent")), "parent").select(F.lit("C20").alias("rule"), F.col("parent").alias("node"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("other"))
    return c17.unionByName(c18).unionByName(c20)


def merge_turns(turns: DataFrame, most: int) -> DataFrame:
    """conv, island, part, speaker, n, text of turns (conv, pos, speaker, text): runs of one speaker, ``most`` turns to a part at most."""
    w = Window.partitionBy("conv").orderBy("pos")
    new = F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    t = turns.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    t = t.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("conv", "island").orderBy("pos")) - 1) / most))
    g = t.groupBy("conv", "island", "part").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("ts"))
    return g.select("conv", "island", "part", "speaker", F.size("ts").cast("long").alias("n"), F.array_join(F.transform("ts", lambda x: x["text"]), " ").alias("text"))


def fold_turns(turns: DataFrame, least: int) -> DataFrame:
    """conv, pos, speaker, text: a turn shorter than ``least`` characters joins the last long one before it as ``[speaker: text]``."""
    w = Window.partitionBy("conv").orderBy("pos")
    head = (F.length("text") >= least) | (F.row_number().over(w) == 1)
    t = turns.withColumn("head", head).withColumn("g", F.sum(F.col("head").cast("int")).over(w))
    said = F.when(F.col("head"), F.col("text")).otherwise(F.concat(F.lit("["), F.col("speaker"), F.lit(": "), F.col("text"), F.lit("]")))
    g = t.groupBy("conv", "g").agg(F.min("pos").alias("pos"), F.min_by("speaker", "pos").alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))).alias("ts"))
    return g.select("conv", "pos", "speaker", F.array_join(F.transform("ts", lambda x: x["s"]), " ").alias("text"))


def pack_turns(turns: DataFrame, most: int) -> DataFrame:
    """conv, pack, n, size: turns in order, closed into a pack when the next would take it over ``most`` characters; one that is longer stands alone.

    The size of a pack depends on all before it, so this is a fold over a conversation's sizes, inside the JVM.
    """
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["size"] + x["size"] <= most),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct((F.element_at(acc, -1)["n"] + 1).alias("n"), (F.element_at(acc, -1)["size"] + x["size"]).alias("size")))),
    ).otherwise(F.concat(acc, F.array(F.struct(F.lit(1).alias("n"), x["size"].alias("size")))))
    per = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("size")))).alias("ts"))
    packs = per.select("conv", F.aggregate("ts", F.array().cast("array<struct<n:int,size:int>>"), step).alias("ps"))
    return packs.select("conv", F.posexplode("ps").alias("pack", "p")).select("conv", "pack", "p.n", "p.size")


def repetition(turns: DataFrame, *, least: int = 20, share: float = 0.4) -> DataFrame:
    """conv, n, top, looped: whether more than ``share`` of ``least`` or more turns say the same."""
    c = turns.groupBy("conv", F.lower(F.trim("text")).alias("said")).agg(F.count("*").alias("k"))
    return c.groupBy("conv").agg(F.sum("k").alias("n"), F.max("k").alias("top")).withColumn("looped", (F.col("n") >= least) & (F.col("top") > share * F.col("n")))


def nearest_event(left: DataFrame, right: DataFrame, *, seconds: int) -> DataFrame:
    """id, other, gap of the right row (key, id, at) nearest in time to each left row of its key, within ``seconds``, the earlier on a tie.

    No range join: both sides are laid in one order of time per key, and each left row looks at the last right row before and the first after it.
    """
    cols = ["key", "at", "id", "side"]
    both = left.withColumn("side", F.lit(1)).select(*cols).unionByName(right.withColumn("side", F.lit(0)).select(*cols))
    w = Window.partitionBy("key").orderBy("at", "side", "id")
    here = F.when(F.col("side") == 0, F.struct("at", F.col("id").alias("other")))
    seen = both.select("*", F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p"), F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("q")).filter("side = 1")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = lambda c: F.abs(micros("at") - micros(f"{c}.at")) / 1e6
    best = seen.select("id", F.array_min(F.array_compact(F.array(F.when(F.col("p").isNotNull(), F.struct(gap("p").alias("gap"), F.col("p.at").alias("at"), F.col("p.other").alias("other"))), F.when(F.col("q").isNotNull(), F.struct(gap("q").alias("gap"), F.col("q.at").alias("at"), F.col("q.other").alias("other")))))).alias("b"))
    return best.filter(F.col("b.gap") <= seconds).select("id", "b.other", "b.gap")


def wilson(df: DataFrame, ok: str, n: str, z: float = 1.96) -> DataFrame:
    """``df`` with rate and lower: the share and its Wilson lower bound, 3 places; null where n is 0."""
    p, m = F.try_divide(F.col(ok).cast("double"), F.col(n)), F.nullif(F.col(n), F.lit(0))
    low = (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m)
    return df.withColumn("rate", F.round(p, 3)).withColumn("lower", F.round(low, 3))


def consistency(runs: DataFrame) -> DataFrame:
    """eval_id, provider, outcome, agreement, mean of runs (eval_id, provider, score): the mean rounded half to even, and the share of runs on its side."""
    m = runs.groupBy("eval_id", "provider").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.count_if(F.col("score") >= 0.5).alias("k"))
    out = F.bround("mean", 0)
    return m.select("eval_id", "provider", out.alias("outcome"), F.round(F.when(out == 1, F.col("k")).otherwise(F.col("n") - F.col("k")) / F.col("n"), 6).alias("agreement"), F.round("mean", 6).alias("mean"))


def first_match(rules: list, other: str):
    """The name of the first (condition, name) that holds, else ``other``."""
    out = F.lit(other)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out
