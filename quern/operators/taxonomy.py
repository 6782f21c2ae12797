"""Taxonomy upkeep: links, groups of labels, chains, paths, cycles, orders, summaries, samples and decisions.

Unless a function says otherwise: a null key takes no part; equal rows count once; empty tables give empty results;
columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.sources.scratch import settled


def resolve_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, target, state of links (source_label, target_label) to nodes (id, label) by slug: ``linked``, ``self``, or ``unknown`` if an end is no node."""
    known = nodes.select("id").distinct()
    s = links.select(tx.slug(F.col("source_label")).alias("source"), tx.slug(F.col("target_label")).alias("target")).distinct()
    a, b = known.select(F.col("id").alias("source"), F.lit(True).alias("has_s")), known.select(F.col("id").alias("target"), F.lit(True).alias("has_t"))
    state = F.when(F.col("has_s").isNull() | F.col("has_t").isNull(), "unknown").when(F.col("source") == F.col("target"), "self").otherwise("linked")
    return s.join(a, "source", "left").join(b, "target", "left").select("source", "target", state.alias("state"))


def components(pairs: DataFrame) -> DataFrame:
    """node, group of undirected pairs (a, b); group is the smallest node reached.

    Each round gives a node the smallest group of itself and its neighbours, then that of its group, so rounds grow
    with the logarithm of the longest path in most graphs; no group is gathered.
    """
    e = pairs.filter("a is not null and b is not null").select("a", "b")
    e = settled(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    g = settled(e.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("group")), "groups")
    while True:
        near = e.join(g.select(F.col("node").alias("b"), F.col("group").alias("of")), "b").groupBy(F.col("a").alias("node")).agg(F.min("of").alias("near"))
        step = g.join(near, "node").select("node", F.least("group", "near").alias("now"), "group")
        far = g.select(F.col("node").alias("now"), F.col("group").alias("far"))
        step = settled(step.join(far, "now").select("node", F.least("now", "far").alias("now"), "group"), "groups")
        g = step.select("node", F.col("now").alias("group"))
        if step.filter("now <> group").isEmpty():
            return g


def label_groups(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """label, group, size: groups that near-duplicate ``pairs`` (a, b) of labels join; labels in no pair are left out. ``group`` is the first label by name."""
    g = components(pairs).join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_semi")
    return g.join(g.groupBy("group").agg(F.count("*").alias("size")), "group").select(F.col("node").alias("label"), "group", "size")


def naming_patterns(labels: DataFrame, *, most: int = 8) -> DataFrame:
    """stem, n, flagged: labels that differ only in a token with a digit, each in its own; flagged if there are more than ``most``.

    A label's stem has ``#`` for each token that holds a digit. Stems without ``#``, of one label, or of labels that repeat their tokens are no pattern.
    """
    tokens = F.filter(F.split(F.lower(F.trim("label")), r"\s+"), lambda t: t != "")
    s = labels.filter("label is not null").select("label").distinct().select(
        F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "#").otherwise(t)), " ").alias("stem"), F.array_join(F.filter(tokens, lambda t: t.rlike("[0-9]")), " ").alias("own")
    )
    g = s.filter("own <> ''").groupBy("stem").agg(F.count("*").alias("n"), F.count_distinct("own").alias("distinct"))
    return g.filter("n > 1 and n = distinct").select("stem", "n", (F.col("n") > most).alias("flagged"))


def merge_ends(merges: DataFrame) -> DataFrame:
    """node, survivor, steps: where chains of merges (node, into) end; a chain that runs into a cycle ends at the cycle's smallest node.

    Chains are halved each round (every node takes over the target of its target), so rounds are the logarithm of the longest. A node has one target; of several the smallest counts.
    """
    m = merges.filter("node is not null and into is not null and node <> into").groupBy("node").agg(F.min("into").alias("at"))
    cur = settled(m.select("node", "at", F.lit(1).cast("long").alias("steps"), F.least("node", "at").alias("low")), "merges")
    size = cur.count()
    while True:
        hop = cur.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("low").alias("low2"))
        cur = settled(cur.join(hop, "at", "left").select("node", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.least("low", "low2").alias("low"), F.col("next").isNotNull().alias("open")), "merges")
        # a node that is still under way after as many steps as there are merges runs round a cycle
        if cur.filter(F.col("open") & (F.col("steps") <= size)).isEmpty():
            break
    on = cur.select(F.col("node").alias("at"), F.col("low").alias("cycle"))
    return cur.join(on, "at", "left").select("node", F.coalesce("cycle", "at").alias("survivor"), F.when(F.col("cycle").isNull(), F.col("steps")).alias("steps"))


def paths(nodes: DataFrame, *, separator: str = " > ", root_kind: str | None = None) -> DataFrame:
    """id, depth, path, root: the labels from the root to each node of (id, label, parent); a parent that is no node ends the path; nodes on a cycle have no path.

    Of several rows of an id the smallest by its other columns counts. A level a round, joined to the level above it. ``root_kind`` is unused where every root counts; nodes whose top is of another kind are dropped if it is given (column kind).
    """
    rest = [c for c in nodes.columns if c != "id"]
    n = nodes.filter("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("t")).select("id", "t.*")
    tops = n.join(n.select(F.col("id").alias("parent")), "parent", "left_anti")
    if root_kind is not None:
        tops = tops.filter(F.col("kind") == root_kind)
    level = settled(tops.select("id", F.lit(0).alias("depth"), F.col("label").alias("path"), F.col("id").alias("root")), "paths")
    out, depth = level, 0
    while True:
        depth += 1
        up = level.select(F.col("id").alias("parent"), F.col("path").alias("above"), "root")
        level = settled(n.join(up, "parent").select("id", F.lit(depth).alias("depth"), F.concat("above", F.lit(separator), "label").alias("path"), "root"), "paths")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def dependency_cycles(reach: DataFrame, loops: DataFrame) -> DataFrame:
    """cycle, nodes, n: sets of nodes that reach each other, from a closure ``reach`` (source, target) and nodes that depend on themselves (``loops``: source); sorted, each once, named by its smallest node."""
    both = reach.join(reach.select(F.col("source").alias("target"), F.col("target").alias("source")), ["source", "target"], "left_semi").select("source", "target")
    own = both.unionByName(both.select("source", F.col("source").alias("target"))).unionByName(loops.select("source", F.col("source").alias("target"))).distinct()
    low = own.groupBy("source").agg(F.min("target").alias("cycle"))
    return low.groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_set(F.col("source"))), ",").alias("nodes"), F.count("*").alias("n"))


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: a node stands one level above the highest of what it depends on (edges: node, needs); 0 if it needs nothing. A cycle raises ValueError.

    A level a round: the nodes all of whose needs are placed.
    """
    e = settled(edges.filter("node is not null and needs is not null").select("node", "needs").distinct(), "needs")
    names = settled(e.select(F.explode(F.array("node", "needs")).alias("node")).distinct(), "names")
    placed = settled(names.join(e, "node", "left_anti").withColumn("level", F.lit(0)), "levels")
    while placed.count() < names.count():
        rest = e.join(placed.select("node"), "node", "left_anti").join(placed.select(F.col("node").alias("needs"), "level"), "needs", "left")
        ready = rest.groupBy("node").agg(F.max("level").alias("top"), F.max(F.col("level").isNull()).alias("waits")).filter("not waits")
        more = settled(ready.select("node", (F.col("top") + 1).cast("int").alias("level")), "levels")
        if more.isEmpty():
            raise ValueError("the dependencies have a cycle")
        placed = placed.unionByName(more)
    return placed


def cluster_summary(mentions: DataFrame) -> DataFrame:
    """cluster, canonical, variants, n_mentions, n_sources, confidence, ambiguous of mentions (cluster, variant, source, confidence, kind).

    canonical is the longest variant, the first by name among those; confidence the mean to 3 places; ambiguous if kinds differ. Nulls are left out of each.
    """
    return mentions.groupBy("cluster").agg(
        F.min(F.struct(-F.length("variant"), F.col("variant"))).alias("best"), F.array_join(F.array_sort(F.collect_set("variant")), "|").alias("variants"), F.count("*").alias("n_mentions"),
        F.count_distinct("source").alias("n_sources"), F.round(F.avg("confidence"), 3).alias("confidence"), (F.count_distinct("kind") > 1).alias("ambiguous"),
    ).select("cluster", F.col("best.variant").alias("canonical"), "variants", "n_mentions", "n_sources", "confidence", "ambiguous")


def majority(rows: DataFrame, key: str, field: str, place: str) -> DataFrame:
    """key, value, n: each key's most frequent value of ``field``; of those that tie, the one seen first by ``place``. Nulls don't count."""
    c = rows.filter(F.col(field).isNotNull()).groupBy(key, field).agg(F.count("*").alias("n"), F.min(place).alias("seen"))
    best = c.groupBy(key).agg(F.max(F.struct("n", (-F.col("seen")).alias("s"), F.col(field).alias("value"))).alias("b"))
    return best.select(key, "b.value", "b.n")


def category_samples(tagged: DataFrame, *, per_category: int = 15, sources: int = 3) -> DataFrame:
    """category, source, ord, place: each category's first rows of (category, source, ord) by source and ord, from its first ``sources`` sources only."""
    by = Window.partitionBy("category")
    near = tagged.select("category", "source", "ord").distinct().withColumn("s", F.dense_rank().over(by.orderBy("source"))).filter(F.col("s") <= sources)
    return near.withColumn("place", F.row_number().over(by.orderBy("source", "ord"))).filter(F.col("place") <= per_category).select("category", "source", "ord", "place")


def untagged_batches(chunks: DataFrame, tags: DataFrame, verdicts: DataFrame, *, limit: int = 400, batches: int = 8, preview: int = 80) -> DataFrame:
    """id, batch, preview: the first ``limit`` chunks (id, text) by id that have no tag (chunk_id) and no verdict (chunk_id), in batches of equal size."""
    t, v = (df.select(F.col("chunk_id").alias("id")).distinct() for df in (tags, verdicts))
    first = chunks.join(t, "id", "left_anti").join(v, "id", "left_anti").orderBy("id").limit(limit)
    return first.select("id", F.ntile(batches).over(Window.orderBy("id")).alias("batch"), F.substr("text", F.lit(1), F.lit(preview)).alias("preview"))  # of limit rows


def standing(records: DataFrame, *, sets: str, lifts: list[str]) -> DataFrame:
    """item, since: items whose latest record (item, action, seq) of those actions is ``sets``: later ones that lift it undo it, and a later one sets it again."""
    own = records.filter(F.col("action").isin(sets, *lifts)).groupBy("item").agg(F.max(F.struct("seq", "action")).alias("r"))
    return own.filter(F.col("r.action") == sets).select("item", F.col("r.seq").alias("since"))


def review_state(records: DataFrame) -> DataFrame:
    """item, decision, n_open of records (item, action, seq): the latest of accept and reject (null if none), and proposals after the last withdrawal."""
    gone = F.max(F.when(F.col("action") == "withdraw", F.col("seq"))).alias("gone")
    g = records.groupBy("item").agg(F.max(F.when(F.col("action").isin("accept", "reject"), F.struct("seq", "action"))).alias("d"), gone)
    n = records.filter("action = 'propose'").join(g.select("item", "gone"), "item").filter("gone is null or seq > gone").groupBy("item").agg(F.count("*").alias("n_open"))
    return g.join(n, "item", "left").select("item", F.col("d.action").alias("decision"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def unexplained(before: DataFrame, after: DataFrame, moves: DataFrame) -> DataFrame:
    """id: nodes of ``before`` (id) that are gone ``after`` (id) and that no move (old) explains."""
    return before.select("id").distinct().join(after.select("id"), "id", "left_anti").join(moves.select(F.col("old").alias("id")), "id", "left_anti")


def impact(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, n_before, n_after, delta: rows of each key before and after a change, where they differ."""
    b, a = (df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    j = b.join(a, key, "full").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_before", "n_after")])
    return j.withColumn("delta", F.col("n_after") - F.col("n_before")).filter("delta <> 0")


def implied_closures(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """node, because, kind: open nodes that a done one implies: what it needs (prerequisite), and the others under its parent if all but one are done (sibling).

    nodes (id, parent, state), needs (id, needs).
    """
    done, open_ = nodes.filter("state = 'done'"), nodes.filter("state = 'open'")
    pre = done.select(F.col("id").alias("because")).join(needs.select(F.col("id").alias("because"), F.col("needs").alias("id")), "because").join(open_.select("id"), "id")
    per = nodes.filter("parent is not null").groupBy("parent").agg(F.sum(F.when(F.col("state") == "open", 1).otherwise(0)).alias("left"), F.count("*").alias("n"), F.max(F.when(F.col("state") == "done", F.col("id"))).alias("because"))
    sib = open_.join(per.filter("left = 1 and n > 1 and because is not null"), "parent")
    kinds = [df.select(F.col("id").alias("node"), "because", F.lit(k).alias("kind")) for df, k in ((pre, "prerequisite"), (sib, "sibling"))]
    return kinds[0].unionByName(kinds[1]).distinct()
