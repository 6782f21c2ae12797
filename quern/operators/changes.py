"""A changeset of a taxonomy and its metrics: thirteen kinds of change, checked and applied as one relation of rewrites.

Tables: nodes (label, level of L1, L2 or entity, parent, description; labels are unique), aliases (alias, node), metrics (metric,
source_type, grain, definition, variants, sources) and changes (seq, type, subject, target, name, level, text, names, retire, chunks, fields).
Changes are applied by type in the order of :data:`TYPES`, within a type by seq. A change that conflicts with another or that the taxonomy of its turn doesn't
allow is rejected with a reason; all others take effect. Each type is one step of joins, so a changeset of any size takes as many steps.

Null labels of nodes, aliases and metrics take no part; a change without a known type is rejected; empty tables give empty results.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators.selection import ordered_selection
from quern.sources.scratch import settled

TYPES = ("add", "describe", "rename", "merge", "move", "split", "remove", "tag", "metric_add", "metric_edit", "metric_merge", "metric_remove", "metric_govern")
#: Which changes use up their subject, which may come more than once, kinds of a source, fields that can be edited.
CONSUMING = ("rename", "merge", "remove", "metric_merge", "metric_remove")
REPEATABLE = ("add", "metric_add", "keep", "tag", "metric_govern")
SOURCE_TYPES = ("computable", "stated", "both")
EDITABLE = ("source_type", "grain", "definition")
CHANGE = "seq long, type string, subject string, target string, name string, level string, text string, names array<string>, retire boolean, chunks array<long>, fields map<string,string>"


class Changed(NamedTuple):
    """Tables after the changes; ``moves`` (seq, kind, node_id, to_id, label, reason) are what tags have to follow, ``rejected`` (seq, type, reason)."""

    nodes: DataFrame
    aliases: DataFrame
    demoted: DataFrame
    metrics: DataFrame
    moves: DataFrame
    tags: DataFrame
    rejected: DataFrame


def _first(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that is broken; null if none is."""
    out = F.lit(None).cast("string")
    for broken, reason in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), reason).otherwise(out)
    return out


def conflicts(changes: DataFrame) -> DataFrame:
    """seq, reason: changes of a subject that is changed twice, with a target that another change uses up, or tags of a subject that is changed too."""
    c = changes.filter(F.col("type").isin(*TYPES)).withColumn("who", F.coalesce("subject", "name"))
    twice = c.filter(~F.col("type").isin(*REPEATABLE) & F.col("who").isNotNull()).groupBy("who").agg(F.count("*").alias("n")).filter("n > 1").select("who", F.lit(1).alias("twice"))
    used = c.filter(F.col("type").isin(*CONSUMING)).select(F.col("who").alias("target"), F.lit(1).alias("used")).distinct()
    gone = c.filter(F.col("type").isin(*CONSUMING) | ((F.col("type") == "split") & F.col("retire"))).select("who", F.lit(1).alias("changed")).distinct()
    aims = F.col("type").isin("add", "merge", "move", "metric_merge")
    j = c.join(twice, "who", "left").join(used, "target", "left").join(gone, "who", "left")
    reason = _first(
        (~F.col("type").isin(*REPEATABLE) & F.col("twice").isNotNull(), "the subject is changed twice"), (aims & F.col("used").isNotNull(), "the target is changed too"),
        ((F.col("type") == "tag") & F.col("changed").isNotNull(), "the subject is tagged and changed"),
    )
    return j.select("seq", reason.alias("reason")).filter("reason is not null")


def _names_of(live: DataFrame, aliases: DataFrame) -> DataFrame:
    """key, label, via: ids that are taken, by a node or by an alias of one."""
    own = live.select(tx.slug(F.col("label")).alias("key"), F.col("label").alias("holder"))
    return own.unionByName(aliases.select(tx.slug(F.col("alias")).alias("key"), F.col("node").alias("holder"))).distinct()


def _only_first(checked: DataFrame, key: str, reason: str) -> DataFrame:
    """Of the changes without a reason that share ``key`` the first stays, the others get ``reason``."""
    place = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy("seq"))
    return checked.withColumn("reason", F.when(F.col("reason").isNull() & (place > 1), reason).otherwise(F.col("reason")))


def _located(c: DataFrame, live: DataFrame, column: str, prefix: str) -> DataFrame:
    """``c`` with the level, parent and description of the node that ``column`` names."""
    side = live.select(F.col("label").alias(column), *[F.col(x).alias(f"{prefix}_{x}") for x in ("level", "parent", "description")])
    return c.join(side, column, "left")


def _relabel(aliases: DataFrame, done: DataFrame) -> DataFrame:
    """Aliases when subjects of ``done`` (subject, into) have become ``into``: theirs go there, the subject is one, and what is a label is none."""
    moved = aliases.join(done.select(F.col("subject").alias("node"), "into"), "node", "left").select("alias", F.coalesce("into", "node").alias("node"))
    fresh = done.select(F.col("subject").alias("alias"), F.col("into").alias("node"))
    kept = moved.join(fresh.select("alias"), "alias", "left_anti")
    return kept.unionByName(fresh).join(done.select(F.col("into").alias("alias")), "alias", "left_anti")


def apply_changes(nodes: DataFrame, aliases: DataFrame, metrics: DataFrame, changes: DataFrame) -> Changed:
    """All changes that hold, applied (see the module)."""
    live = nodes.filter("label is not null").select("label", "level", "parent", "description")
    held = aliases.filter("alias is not null and node is not null").select("alias", "node")
    clash = conflicts(changes)
    marked = settled(changes.join(clash, "seq", "left"), "changes")
    known = marked.filter(F.col("type").isin(*TYPES))
    unknown = marked.filter(~F.coalesce(F.col("type").isin(*TYPES, "keep"), F.lit(False))).select("seq", "type", F.lit("unknown type").alias("reason"))
    turns = {t: known.filter((F.col("type") == t) & F.col("reason").isNull()).drop("reason") for t in TYPES}
    rejected = [unknown, known.filter("reason is not null").select("seq", "type", "reason")]
    moves: list[DataFrame] = []
    demoted: list[DataFrame] = []
    empty = F.lit(None).cast("string")

    def split_off(checked: DataFrame) -> DataFrame:
        checked = settled(checked, "checked")
        rejected.append(checked.filter("reason is not null").select("seq", "type", "reason"))
        return checked.filter("reason is null")

    def move(done: DataFrame, kind: str, node: Column, to: Column = empty, reason: Column = empty) -> None:
        moves.append(done.select("seq", F.lit(kind).alias("kind"), tx.slug(node).alias("node_id"), tx.slug(to).alias("to_id") if to is not empty else empty.alias("to_id"), to.alias("label"), reason.alias("reason")))

    taken_reason = "the name is taken"
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    key = tx.slug(F.trim("name"))
    wrong = turns["add"].filter(~F.coalesce(F.col("level").isin("L1", "L2"), F.lit(False)))
    split_off(wrong.withColumn("reason", F.lit("the level is neither L1 nor L2")))
    for level in ("L1", "L2"):
        taken = _names_of(live, held).select("key", F.lit(1).alias("taken")).distinct()
        c = _located(turns["add"].filter(F.col("level") == level).withColumn("key", key).join(taken, "key", "left"), live, "target", "at")
        rules = [(blank, "a name is required"), (F.col("taken").isNotNull(), taken_reason)]
        if level == "L2":
            rules.append((~F.coalesce(F.col("at_level") == "L1", F.lit(False)), "the parent is no L1"))
        done = split_off(_only_first(c.withColumn("reason", _first(*rules)), "key", taken_reason))
        text = F.nullif(F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), " "), F.lit(""))
        live = live.unionByName(done.select(F.trim("name").alias("label"), "level", (F.col("target") if level == "L2" else empty).alias("parent"), text.alias("description")))
    live = settled(live, "nodes")

    text = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""), " ")
    c = _located(turns["describe"], live, "subject", "is")
    done = split_off(c.withColumn("reason", _first((F.col("is_level").isNull(), "no such node"), (text == "", "the description is empty"))))
    live = live.join(done.select(F.col("subject").alias("label"), text.alias("said")), "label", "left").select("label", "level", "parent", F.coalesce("said", "description").alias("description"))

    c = _located(turns["rename"], live, "subject", "is").withColumn("key", key)
    others = c.select("seq", "key", "subject").join(_names_of(live, held), "key").filter("holder <> subject").select("seq", F.lit(1).alias("taken")).distinct()
    rules = ((F.col("is_level").isNull(), "no such node"), (blank, "a name is required"), (F.col("taken").isNotNull(), taken_reason))
    done = split_off(_only_first(c.join(others, "seq", "left").withColumn("reason", _first(*rules)), "key", taken_reason)).withColumn("into", F.trim("name"))
    move(done, "repoint", F.col("subject"), F.col("into"))
    names = done.select(F.col("subject").alias("label"), "into")
    up = names.select(F.col("label").alias("parent"), F.col("into").alias("above"))
    live = live.join(names, "label", "left").join(up, "parent", "left").select(F.coalesce("into", "label").alias("label"), "level", F.coalesce("above", "parent").alias("parent"), "description")
    live, held = settled(live, "nodes"), settled(_relabel(held, done), "aliases")

    c = _located(_located(turns["merge"], live, "subject", "is"), live, "target", "to")
    kinds = (F.col("is_level") != F.col("to_level")) | (F.col("is_level") == "entity")
    rules = ((F.col("subject") == F.col("target"), "a node cannot be merged into itself"), (F.col("is_level").isNull() | F.col("to_level").isNull(), "no such node"), (kinds, "a merge needs two L1s or two L2s"))
    done = split_off(c.withColumn("reason", _first(*rules))).withColumn("into", F.col("target"))
    heads = done.filter("is_level = 'L1'").select(F.col("subject").alias("parent"), F.col("into").alias("above"), F.col("seq").alias("at"))
    pair = done.filter("is_level = 'L2'")
    for side in ("is", "to"):  # the parent at its turn, when earlier merges of L1s are done
        h = heads.select(F.col("parent").alias(f"{side}_parent"), F.col("above").alias(f"{side}_above"), F.col("at").alias(f"{side}_at"))
        pair = pair.join(h, f"{side}_parent", "left").withColumn(f"{side}_p", F.when(F.col(f"{side}_at") < F.col("seq"), F.col(f"{side}_above")).otherwise(F.col(f"{side}_parent")))
    move(pair.filter(~F.col("is_p").eqNullSafe(F.col("to_p"))), "reclassify", F.col("subject"), reason=F.concat(F.lit("merged into "), F.col("into")))
    move(done, "repoint", F.col("subject"), F.col("into"))
    given = done.filter("is_description is not null").groupBy(F.col("into").alias("label")).agg(F.min_by("is_description", "seq").alias("given"))
    live = live.join(done.select(F.col("subject").alias("label")), "label", "left_anti").join(heads.select("parent", "above"), "parent", "left").join(given, "label", "left")
    live = settled(live.select("label", "level", F.coalesce("above", "parent").alias("parent"), F.coalesce("description", "given").alias("description")), "nodes")
    held = settled(_relabel(held, done), "aliases")

    c = _located(_located(turns["move"], live, "subject", "is"), live, "target", "to")
    rules = ((F.col("is_level").isNull(), "no such node"), (F.col("is_level") != "L2", "only L2s move"), (~F.coalesce(F.col("to_level") == "L1", F.lit(False)), "the parent is no L1"), (F.col("target") == F.col("is_parent"), "it is there already"))
    done = split_off(c.withColumn("reason", _first(*rules)))
    move(done, "reclassify", F.col("subject"), reason=F.concat(F.lit("moved to "), F.col("target")))
    live = live.join(done.select(F.col("subject").alias("label"), F.col("target").alias("new")), "label", "left").select("label", "level", F.coalesce("new", "parent").alias("parent"), "description")
    live = settled(live, "nodes")

    c = _located(turns["split"].withColumn("names", F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.trim(F.coalesce(n, F.lit(""))))), live, "subject", "is")
    each = c.select("seq", F.explode("names").alias("label")).withColumn("key", tx.slug(F.col("label")))
    known_names = _names_of(live, held).select("key", F.lit(1).alias("taken")).distinct()
    bad = each.join(known_names, "key", "left").groupBy("seq").agg(F.max("taken").alias("taken"), (F.count_distinct("key") < F.count("*")).alias("same"), F.max(F.col("label") == "").alias("unnamed"))
    rules = (
        (F.col("is_level").isNull(), "no such node"), (F.col("is_level") == "entity", "entities cannot be split"), (F.size("names") < 2, "a split needs two names or more"),
        (F.col("retire") & (F.col("is_level") == "L1"), "only an L2 can be retired"), (F.col("unnamed"), "a name is required"), (F.col("taken").isNotNull() | F.col("same"), taken_reason),
    )
    checked = settled(c.join(bad, "seq", "left").withColumn("reason", _first(*rules)), "splits")
    fine = checked.filter("reason is null").select("seq").join(each, "seq")
    meet = fine.join(fine.select("key", F.col("seq").alias("other")), "key").filter("seq < other").select(F.col("seq").alias("a"), F.col("other").alias("b")).distinct()
    late = ordered_selection(fine.select(F.col("seq").alias("id"), F.col("seq").alias("place")).distinct(), meet).filter("not kept").select(F.col("id").alias("seq"), F.lit(1).alias("late"))
    done = split_off(checked.join(late, "seq", "left").withColumn("reason", F.when(F.col("late").isNotNull(), taken_reason).otherwise(F.col("reason"))))
    move(done, "reclassify", F.col("subject"), reason=F.concat(F.lit("split into "), F.array_join("names", ", ")))
    retired = done.filter("retire").select(F.col("subject").alias("label"), "seq")
    move(retired, "delete", F.col("label"))
    demoted.append(retired.select("label"))
    said = F.coalesce(F.try_element_at("fields", F.col("label")), F.lit(None).cast("string"))
    fresh = done.withColumn("label", F.explode("names")).select("label", F.lit("L2").alias("level"), F.when(F.col("is_level") == "L1", F.col("subject")).otherwise(F.col("is_parent")).alias("parent"), said.alias("description"))
    live = settled(live.join(retired.select("label"), "label", "left_anti").unionByName(fresh), "nodes")

    c = _located(turns["remove"], live, "subject", "is")
    ends = F.coalesce("text", F.lit("demote"))
    above = c.filter("is_level = 'L1'").select(F.col("subject").alias("is_parent"), F.col("seq").alias("above"), ends.alias("above_ends"))
    proper = (ends == "demote") | ends.rlike("^entity:.")
    c = c.join(above.filter((F.col("above_ends") == "demote") | F.col("above_ends").rlike("^entity:.")).drop("above_ends"), "is_parent", "left")
    rules = ((F.col("is_level").isNull() | (F.col("above") < F.col("seq")), "no such node"), (~proper, "a removal ends in demote or entity:<kind>"))
    done = split_off(c.withColumn("reason", _first(*rules)))
    own = done.select("seq", F.col("subject").alias("label"), "subject")
    kids = done.filter("is_level = 'L1'").select("seq", F.col("subject").alias("parent")).join(live.select("label", "parent"), "parent").join(own.select("label", F.col("seq").alias("before")), "label", "left")
    victims = settled(own.unionByName(kids.filter("before is null or before > seq").select("seq", "label", F.col("parent").alias("subject"))), "victims")
    move(victims, "reclassify", F.col("label"), reason=F.concat("subject", F.lit(" removed")))
    move(victims, "delete", F.col("label"))
    demoted.append(done.filter(ends == "demote").select(F.col("subject").alias("label")))
    entities = done.filter(ends != "demote").select(F.substr(ends, F.lit(8)).alias("label")).distinct()
    live = live.join(victims.select("label"), "label", "left_anti")
    fresh = entities.join(live.filter("level = 'entity'").select("label"), "label", "left_anti").select("label", F.lit("entity").alias("level"), empty.alias("parent"), empty.alias("description"))
    live = settled(live.unionByName(fresh), "nodes")

    c = _located(turns["tag"], live, "subject", "is")
    none = F.size(F.coalesce("chunks", F.array().cast("array<long>"))) == 0
    done = split_off(c.withColumn("reason", _first((F.col("is_level").isNull(), "no such node"), (F.col("is_level") == "entity", "entities are not tagged"), (none, "chunks are required"))))
    tags = done.select("seq", F.col("subject").alias("label"), F.explode(F.array_distinct("chunks")).alias("chunk_id"))

    live_metrics = _metrics(metrics, turns, split_off, demoted)
    out = rejected[0]
    for more in rejected[1:]:
        out = out.unionByName(more)
    followed = moves[0]
    for more in moves[1:]:
        followed = followed.unionByName(more)
    gone = demoted[0]
    for more in demoted[1:]:
        gone = gone.unionByName(more)
    return Changed(live, held, gone.distinct(), live_metrics, followed, tags, out)


def _metrics(metrics: DataFrame, turns: dict[str, DataFrame], split_off, demoted: list[DataFrame]) -> DataFrame:
    """The metrics after their five types of change."""
    columns = ["metric", "source_type", "grain", "definition", "variants", "sources"]
    live = metrics.filter("metric is not null").select(*columns)
    named = lambda c: tx.header(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "))
    taken = live.select(F.explode(F.concat(F.array("metric"), F.coalesce("variants", F.array().cast("array<string>")))).alias("v")).select(named(F.col("v")).alias("key"), F.lit(1).alias("taken")).distinct()
    c = turns["metric_add"].withColumn("key", named(F.col("name"))).join(taken, "key", "left")
    source = ~F.coalesce(F.col("level").isin(*SOURCE_TYPES), F.lit(False))
    rules = ((F.trim(F.coalesce("name", F.lit(""))) == "", "a name is required"), (F.col("taken").isNotNull(), "the name is taken"), (source, "no such source type"))
    done = split_off(_only_first(c.withColumn("reason", _first(*rules)), "key", "the name is taken"))
    name = F.trim("name")
    fresh = done.select(name.alias("metric"), F.col("level").alias("source_type"), F.try_element_at("fields", F.lit("grain")).alias("grain"), F.col("text").alias("definition"), F.array(name).alias("variants"), F.array().cast("array<string>").alias("sources"))
    live = settled(live.unionByName(fresh), "metrics")

    found = lambda c, col: c.join(live.select(F.col("metric").alias(col), F.lit(1).alias(f"{col}_is")), col, "left")
    c = found(turns["metric_edit"], "subject").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    keys = F.map_keys("fields")
    odd = F.size(F.array_except(keys, F.array(*map(F.lit, EDITABLE)))) > 0
    wrong = F.map_contains_key("fields", F.lit("source_type")) & ~F.coalesce(F.try_element_at("fields", F.lit("source_type")).isin(*SOURCE_TYPES), F.lit(False))
    done = split_off(c.withColumn("reason", _first((F.col("subject_is").isNull(), "no such metric"), ((F.size("fields") == 0) | odd, "no such field"), (wrong, "no such source type"))))
    edit = done.select(F.col("subject").alias("metric"), F.col("fields").alias("new"))
    put = [F.when(F.map_contains_key("new", F.lit(x)), F.try_element_at("new", F.lit(x))).otherwise(F.col(x)).alias(x) for x in EDITABLE]
    live = settled(live.join(edit, "metric", "left").select("metric", *put, "variants", "sources"), "metrics")

    c = found(found(turns["metric_merge"], "subject"), "target")
    done = split_off(c.withColumn("reason", _first((F.col("subject") == F.col("target"), "a metric cannot be merged into itself"), (F.col("subject_is").isNull() | F.col("target_is").isNull(), "no such metric"))))
    into = done.select(F.col("subject").alias("metric"), F.col("target").alias("into"))
    none = F.array().cast("array<string>")
    given = live.join(into, "metric").groupBy(F.col("into").alias("metric")).agg(
        F.flatten(F.collect_list(F.concat(F.coalesce("variants", none), F.array("metric")))).alias("v"), F.flatten(F.collect_list(F.coalesce("sources", none))).alias("s")
    )  # the metrics merged into one
    both = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none))))
    live = live.join(into.select("metric"), "metric", "left_anti").join(given, "metric", "left")
    live = settled(live.select("metric", "source_type", "grain", "definition", both("variants", "v").alias("variants"), both("sources", "s").alias("sources")), "metrics")

    c = found(turns["metric_remove"], "subject")
    done = split_off(c.withColumn("reason", _first((F.trim(F.coalesce("text", F.lit(""))) == "", "a reason is required"), (F.col("subject_is").isNull(), "no such metric"))))
    demoted.append(done.select(F.col("subject").alias("label")))
    live = settled(live.join(done.select(F.col("subject").alias("metric")), "metric", "left_anti"), "metrics")
    c = found(turns["metric_govern"], "subject")
    split_off(c.withColumn("reason", _first((F.col("subject_is").isNull(), "no such metric"), (~F.coalesce(F.col("name").rlike("^[a-z0-9_]+$"), F.lit(False)), "a key of a-z, 0-9 and _ is required"))))
    return live


def follow_moves(tags: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, again): tags (chunk_id, category_id, category_label, kind) after the moves, and chunk_id of those whose chunks are to be classified again.

    A repointed tag goes to its new node, one per chunk; tags of deleted nodes go.
    """
    last = moves.filter("kind = 'repoint'").groupBy("node_id").agg(F.max_by(F.struct("to_id", "label"), "seq").alias("to"))
    dead = moves.filter("kind = 'delete'").select(F.col("node_id").alias("category_id")).distinct()
    again = tags.join(moves.filter("kind in ('reclassify', 'delete')").select(F.col("node_id").alias("category_id")).distinct(), "category_id", "left_semi").select("chunk_id").distinct()
    kept = tags.join(dead, "category_id", "left_anti").join(last.withColumnRenamed("node_id", "category_id"), "category_id", "left")
    moved = kept.select("chunk_id", F.coalesce("to.to_id", "category_id").alias("category_id"), F.coalesce("to.label", "category_label").alias("category_label"), "kind")
    one = moved.groupBy("chunk_id", "category_id").agg(F.min(F.struct("category_label", "kind")).alias("t"))
    return one.select("chunk_id", "category_id", "t.category_label", "t.kind"), again
