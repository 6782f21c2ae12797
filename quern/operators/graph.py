"""Taxonomy graphs, tags, fuzzy labels, provenance and snapshot differences."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.likeness import contained_pairs, ratio_pairs
from quern.sources.scratch import settled


def closure(edges: DataFrame, max_depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """source, target, depth: every node that directed edges (source, target) reach from another, with the fewest steps; from ``starts`` (source) only, if given.

    Each round joins only what the last one found, so a cycle ends by itself; rounds go on until one finds nothing new, or to ``max_depth`` steps if that is given. The reach of a provenance or taxonomy graph is the result's size.
    """
    e = edges.select("source", "target").distinct()
    first = e if starts is None else e.join(starts.select("source").distinct(), "source")
    found = first.filter("source <> target").withColumn("depth", F.lit(1))
    fresh = found
    hops = e.select(F.col("source").alias("target"), F.col("target").alias("next"))
    for depth in itertools.count(2) if max_depth is None else range(2, max_depth + 1):
        step = fresh.join(hops, "target").select("source", F.col("next").alias("target")).filter("source <> target").distinct()
        fresh = step.join(found.select("source", "target"), ["source", "target"], "left_anti").withColumn("depth", F.lit(depth))
        fresh = settled(fresh, "closure")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def tree(hierarchy: DataFrame, root_kind: str, child_kind: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows (parent_label, label): slugs as ids, ``subclass_of`` from child to parent."""
    parents = hierarchy.select(tx.slug(F.col("parent_label")).alias("id"), F.col("parent_label").alias("label"), F.lit(root_kind).alias("kind"), F.lit(None).cast("string").alias("parent"))
    children = hierarchy.filter("label is not null").select(tx.slug(F.col("label")).alias("id"), "label", F.lit(child_kind).alias("kind"), tx.slug(F.col("parent_label")).alias("parent"))
    nodes = parents.unionByName(children).groupBy("id").agg(*[F.min(c).alias(c) for c in ("label", "kind", "parent")])
    edges = nodes.filter("parent is not null").select(F.col("id").alias("source"), F.col("parent").alias("target"), F.lit("subclass_of").alias("rel"))
    return nodes, edges


def write_tags(labels: DataFrame, nodes: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, verdicts) of (chunk_id, labels array): labels go to nodes, by alias too; what the vocabulary lacks is dropped; a node's parent is tagged as well; ``__no_topic__`` alone is a verdict."""
    alone = (F.size("labels") == 1) & (F.col("labels")[0] == "__no_topic__")
    verdicts = labels.filter(alone).select("chunk_id", F.lit("no_topic").alias("verdict"))
    flat = labels.select("chunk_id", F.explode("labels").alias("label")).filter(F.col("label") != "__no_topic__").select("chunk_id", tx.slug(F.col("label")).alias("key"))
    alias = aliases.select(F.col("alias_id").alias("key"), "node_id")
    named = flat.join(alias, "key", "left").select("chunk_id", F.coalesce("node_id", "key").alias("id"))
    own = named.join(nodes, "id")
    up = own.filter("parent is not null").select("chunk_id", F.col("parent").alias("id")).join(nodes, "id")
    cols = ["chunk_id", F.col("id").alias("category_id"), F.col("label").alias("category_label"), "kind"]
    return own.select(*cols).unionByName(up.select(*cols)).distinct(), verdicts


def tag_coverage(chunks: DataFrame, tags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """total, tagged, no_topic, untagged chunks; a no_topic verdict counts as classified, not as tagged."""
    flags = (
        chunks.select("chunk_id").join(tags.select("chunk_id").distinct().withColumn("t", F.lit(1)), "chunk_id", "left").join(verdicts.select("chunk_id").distinct().withColumn("v", F.lit(1)), "chunk_id", "left")
    )
    return flags.agg(F.count("*").alias("total"), F.count("t").alias("tagged"), F.count_if(F.col("t").isNull() & F.col("v").isNotNull()).alias("no_topic"), F.count_if(F.col("t").isNull() & F.col("v").isNull()).alias("untagged"))


def tag_overlap(tags: DataFrame) -> DataFrame:
    """a, b, n: chunks that carry both categories, for every pair at once."""
    t = tags.select("chunk_id", "category_id").distinct()
    x, y = t.select("chunk_id", F.col("category_id").alias("a")), t.select("chunk_id", F.col("category_id").alias("b"))
    return x.join(y, "chunk_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def tag_balance(tags: DataFrame, factor: float = 3.0, sparse: int = 3) -> DataFrame:
    """category_id, n, median_n, state: ``overloaded`` above factor times the median of all, ``sparse`` up to ``sparse``, else ``ok``."""
    n = tags.groupBy("category_id").agg(F.countDistinct("chunk_id").alias("n"))
    m = F.median("n").over(Window.partitionBy(F.lit(1)))  # a row per category
    return n.withColumn("median_n", m).withColumn("state", F.when(F.col("n") > factor * F.col("median_n"), "overloaded").when(F.col("n") <= sparse, "sparse").otherwise("ok"))


def repoint(tags: DataFrame, old: str, new: str, label: str, kind: str) -> DataFrame:
    """Tags of ``old`` become tags of ``new``, one per chunk and category: the smallest of several by their other columns."""
    hit = F.col("category_id") == old
    moved = tags.withColumns({"category_label": F.when(hit, label).otherwise(F.col("category_label")), "kind": F.when(hit, kind).otherwise(F.col("kind")), "category_id": F.when(hit, new).otherwise(F.col("category_id"))})
    rest = [c for c in tags.columns if c not in ("chunk_id", "category_id")]
    return moved.groupBy("chunk_id", "category_id").agg(F.min(F.struct(*rest)).alias("t")).select(*[F.col(c) if c in ("chunk_id", "category_id") else F.col(f"t.{c}") for c in tags.columns])


def misplaced(vectors: DataFrame, groups: DataFrame, *, margin: float = 0.03, least: int = 3) -> DataFrame:
    """child, parent, closer, own, best: children (id, child, parent, embedding) whose unit centroid is nearer to another parent's by ``margin`` or more."""
    flat = vectors.select("child", "parent", F.posexplode("embedding").alias("k", "x"))

    def centroid(key: str) -> DataFrame:
        mean = flat.groupBy(key, "k").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
        return mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("c"), F.max("n").alias("n"))

    small = centroid("child").filter(F.col("n") >= least).select("child", F.col("c").alias("cc")).join(groups.select("child", "parent").distinct(), "child")
    large = centroid("parent").select(F.col("parent").alias("other"), F.col("c").alias("pc"))
    s = small.join(F.broadcast(large), F.lit(True)).withColumn("s", tx.cosine(F.col("cc"), F.col("pc")))  # a row per parent
    best = s.groupBy("child", "parent").agg(F.max(F.when(F.col("other") == F.col("parent"), F.col("s"))).alias("own"), F.max(F.when(F.col("other") != F.col("parent"), F.struct("s", "other"))).alias("b"))
    return best.filter(F.col("b.s") - F.col("own") >= margin).select("child", "parent", F.col("b.other").alias("closer"), F.round("own", 6).alias("own"), F.round("b.s", 6).alias("best"))


def label_pairs(labels: DataFrame, threshold: float = 0.86) -> DataFrame:
    """a, b: labels (label) whose difflib ratio, as headers, is ``threshold`` or more, or one of which stands within the other with 4 characters or more; a < b. Null and blank labels are near none."""
    n = labels.filter("label is not null").select(F.col("label").alias("id"), tx.header(F.col("label")).alias("text")).distinct()
    inside = contained_pairs(n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return inside.unionByName(ratio_pairs(n, least=threshold).select("a", "b")).distinct()


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, change: added, changed, deleted or unchanged between two snapshots."""
    x, y = before.select(F.col(key).alias("k0"), F.col(content).alias("c0")), after.select(F.col(key).alias("k1"), F.col(content).alias("c1"))
    j = x.join(y, F.col("k0") == F.col("k1"), "full_outer")
    change = F.when(F.col("k0").isNull(), "added").when(F.col("k1").isNull(), "deleted").when(F.col("c0").eqNullSafe(F.col("c1")), "unchanged").otherwise("changed")
    return j.select(F.coalesce("k0", "k1").alias(key), change.alias("change"))


def score_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before, after, change of scores: new, missing, flipped (across one half), improved, regressed (by more than 0.01) or stable."""
    j = before.select(F.col(key).alias("k0"), F.col("score").alias("before")).join(after.select(F.col(key).alias("k1"), F.col("score").alias("after")), F.col("k0") == F.col("k1"), "full_outer")
    b, a = F.col("before"), F.col("after")
    change = F.when(b.isNull(), "new").when(a.isNull(), "missing").when((b >= 0.5) != (a >= 0.5), "flipped").when(a - b > 0.01, "improved").when(b - a > 0.01, "regressed").otherwise("stable")
    return j.select(F.coalesce("k0", "k1").alias(key), "before", "after", change.alias("change"))


def fingerprints(parts: DataFrame, key: str, part: str, content: str) -> DataFrame:
    """key, fingerprint: sha256 over the sorted (part, sha256 of content) of each key."""
    each = parts.select(key, F.concat_ws("=", F.col(part).cast("string"), F.sha2(F.coalesce(content, F.lit("")), 256)).alias("p"))
    return each.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("fingerprint"))
