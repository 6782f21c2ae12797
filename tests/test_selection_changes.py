"""Greedy selection and changesets against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import changes, selection


def greedy(order, near):
    kept, leader = [], {}
    for x in order:
        first = next((k for k in kept if frozenset((k, x)) in near), None)
        leader[x] = x if first is None else first
        if first is None:
            kept.append(x)
    return leader


@pytest.mark.parametrize("seed", range(3))
def test_selection_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    order = rng.sample(range(1000), 60)
    pairs = [(rng.choice(order), rng.choice(order)) for _ in range(30 * (seed + 1))] + [(5000, order[0])]
    if seed == 2:
        pairs = list(zip(order, order[1:], strict=False))  # a chain: as many rounds as it is long
        order = order[:14]
    items = spark.createDataFrame([(x, k) for k, x in enumerate(order)] + [(None, 99)], "id long, place long")
    got = {r["id"]: (r["kept"], r["leader"]) for r in selection.ordered_selection(items, spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = greedy(order, {frozenset(p) for p in pairs if len(set(p)) > 1})
    assert got == {x: (x == y, y) for x, y in want.items()}
    assert selection.ordered_selection(items.limit(0), spark.createDataFrame(pairs, "a long, b long")).count() == 0


def test_distinct_contents(spark):
    rng = random.Random(1)
    bodies = []
    for k in range(12):
        words = [f"word{k}x{j}" for j in range(20)]
        bodies += [" ".join(words), " ".join(words[: 20 - rng.randrange(5)] + ["other"]), " ".join(words[3:] + ["more", "here", "now"]), " ".join(words)]
    rng.shuffle(bodies)
    rows = list(enumerate(bodies)) + [(100, "too few words"), (101, "too few words"), (102, None)]
    sets = {i: frozenset(re.findall("[a-z0-9]{3,}", (t or "").lower())) for i, t in rows}
    kept, want = [], {}
    for i, _ in rows:
        twin = next((k for k in kept if len(sets[i]) >= 15 and len(sets[i] & sets[k]) >= 0.8 * len(sets[i] | sets[k])), None)
        want[i] = twin
        if twin is None and len(sets[i]) >= 15:
            kept.append(i)
    got = {r["id"]: r["duplicate_of"] for r in selection.distinct_contents(spark.createDataFrame(rows, "id long, body string")).collect()}
    assert got == want


def test_distinct_contents_moves_no_texts(spark):
    """What judges a frame is the number of its set; its words stay where they are."""
    words = [f"word{k:02d}" for k in range(20)]
    rows = [(3, " ".join(words)), (4, " ".join(words[1:])), (5, " ".join(reversed(words))), (6, "short"), (7, None), (None, " ".join(words))]
    got = selection.distinct_contents(spark.createDataFrame(rows, "id long, body string"))
    assert sorted(tuple(r) for r in got.collect()) == [(3, True, None), (4, False, 3), (5, False, 3), (6, True, None), (7, True, None)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "array_distinct" not in plan


def loop(nodes, aliases, ops):
    """The intent changes one by one on dictionaries: (nodes, aliases, rejected seqs)."""
    live, held = {n: [lv, p] for n, lv, p in nodes}, dict(aliases)
    slug = lambda s: re.sub("[^a-z0-9]+", "_", s.lower()).strip("_") or "n"
    who = lambda o: o["subject"] or o["name"]
    bad = set()
    changing = [o for o in ops if o["type"] not in ("add", "tag")]
    used = {who(o) for o in ops if o["type"] in changes.CONSUMING}
    gone = used | {who(o) for o in ops if o["type"] == "split" and o["retire"]}
    for o in ops:
        twice = o["type"] not in ("add", "tag") and sum(who(x) == who(o) for x in changing) > 1
        if twice or (o["type"] in ("add", "merge", "move") and o["target"] in used) or (o["type"] == "tag" and who(o) in gone):
            bad.add(o["seq"])

    def free(name, own=None):
        return bool(name) and all(slug(n) != slug(name) or n == own for n in live) and all(slug(a) != slug(name) or n == own for a, n in held.items())

    def relabel(old, new):
        for a, n in held.items():
            if n == old:
                held[a] = new
        held[old] = new
        held.pop(new, None)

    def do(o):
        t, s, to = o["type"], o["subject"], o["target"]
        if t == "add":
            if not free(o["name"]) or (o["level"] == "L2" and live.get(to, [None])[0] != "L1"):
                return False
            live[o["name"]] = [o["level"], to if o["level"] == "L2" else None]
            return True
        if s not in live:
            return False
        level, parent = live[s]
        if t == "rename":
            if not free(o["name"], s):
                return False
            live[o["name"]] = live.pop(s)
            for v in live.values():
                if v[1] == s:
                    v[1] = o["name"]
            relabel(s, o["name"])
        elif t == "merge":
            if s == to or to not in live or live[to][0] != level or level == "entity":
                return False
            del live[s]
            for v in live.values():
                if v[1] == s:
                    v[1] = to
            relabel(s, to)
        elif t == "move":
            if level != "L2" or live.get(to, [None])[0] != "L1" or to == parent:
                return False
            live[s][1] = to
        elif t == "split":
            names = o["names"] or []
            if level == "entity" or len(names) < 2 or (o["retire"] and level == "L1") or len(set(map(slug, names))) < len(names) or not all(map(free, names)):
                return False
            for n in names:
                live[n] = ["L2", s if level == "L1" else parent]
            if o["retire"]:
                del live[s]
        elif t == "remove":
            if not re.fullmatch("demote|entity:.+", o["text"] or "demote"):
                return False
            for n in [s] + [n for n, v in live.items() if level == "L1" and v[1] == s]:
                del live[n]
            if (o["text"] or "demote") != "demote":
                live.setdefault(o["text"][7:], ["entity", None])
        elif t == "tag":
            return level != "entity" and bool(o["chunks"])
        return True

    order = {t: k for k, t in enumerate(changes.TYPES)}
    for o in sorted(ops, key=lambda o: (order[o["type"]], o["level"] == "L2" if o["type"] == "add" else False, o["seq"])):
        if o["seq"] not in bad and not do(o):
            bad.add(o["seq"])
    return {(n, *v) for n, v in live.items()}, set(held.items()), bad


@pytest.mark.parametrize("seed", [0, 3])
def test_changes_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    heads = [f"Head {k}" for k in range(6)]
    nodes = [(h, "L1", None) for h in heads] + [(f"Kid {k}", "L2", rng.choice([*heads, None])) for k in range(24)] + [("Place", "entity", None)]
    labels = [n for n, *_ in nodes]
    aliases = [("Old kid", "Kid 1"), ("Older kid", "Kid 2")]
    ops = []
    for seq in range(26):
        t = rng.choice(["add", "rename", "merge", "move", "split", "remove", "tag"])
        o = dict.fromkeys(("subject", "target", "name", "level", "text", "names", "retire", "chunks", "fields")) | {"seq": seq, "type": t}
        new = [*[f"New {k}" for k in range(9)], "kid-3", "OLD KID"]
        if t == "add":
            o |= {"name": rng.choice(new), "level": rng.choice(["L1", "L2"]), "target": rng.choice([*heads, "New 1", "Kid 3"])}
        else:
            o |= {"subject": rng.choice([*labels, "Nobody", "New 2"]), "target": rng.choice(labels), "name": rng.choice(new) if t == "rename" else None}
            o |= {"names": rng.sample(new, rng.randrange(4)) if t == "split" else None, "retire": t == "split" and rng.random() < 0.4, "chunks": [1, 1, 2][: rng.randrange(4)] if t == "tag" else None}
            o |= {"text": rng.choice([None, "demote", "entity:Thing", "entity:"]) if t == "remove" else None}
        ops.append(o)
    columns = [c.split()[0] for c in changes.CHANGE.split(", ")]
    table = spark.createDataFrame([tuple(o[c] for c in columns) for o in ops], changes.CHANGE)
    tree = spark.createDataFrame([(*n, None) for n in nodes], "label string, level string, parent string, description string")
    metrics = spark.createDataFrame([], "metric string, source_type string, grain string, definition string, variants array<string>, sources array<string>")
    got = changes.apply_changes(tree, spark.createDataFrame(aliases, "alias string, node string"), metrics, table)
    live, held, bad = loop(nodes, aliases, ops)
    assert {r["seq"] for r in got.rejected.collect()} == bad
    assert {tuple(r) for r in got.nodes.select("label", "level", "parent").collect()} == live
    assert {tuple(r) for r in got.aliases.collect()} == held
    assert 0 < len(bad) < len(ops)


def test_metric_changes_moves_and_tags(spark):
    blank = dict.fromkeys(c.split()[0] for c in changes.CHANGE.split(", "))
    ops = [
        {"type": "metric_add", "name": "Net Sales", "level": "stated", "text": "d"}, {"type": "metric_add", "name": "net  sales", "level": "both"}, {"type": "metric_add", "name": "x", "level": "odd"},
        {"type": "metric_edit", "subject": "Margin", "fields": {"grain": "store"}}, {"type": "metric_edit", "subject": "Cost", "fields": {"colour": "red"}},
        {"type": "metric_merge", "subject": "Costs", "target": "Cost"}, {"type": "metric_remove", "subject": "Old", "text": " "}, {"type": "metric_govern", "subject": "Margin", "name": "margin_1"},
        {"type": "metric_govern", "subject": "Margin", "name": "Margin!"}, {"type": "describe", "subject": "A", "text": " two \n words "}, {"type": "rename", "subject": "B", "name": "C"}, {"type": "odd"}, {"type": "keep"},
    ]
    table = spark.createDataFrame([tuple((blank | {"seq": k} | o).values()) for k, o in enumerate(ops)], changes.CHANGE)
    metrics = spark.createDataFrame([("Margin", "both", None, None, ["m"], ["s1"]), ("Cost", "both", None, None, ["c"], ["s2"]), ("Costs", "both", None, None, ["cs"], ["s1"]), ("Old", "both", None, None, None, None)], "metric string, source_type string, grain string, definition string, variants array<string>, sources array<string>")
    tree = spark.createDataFrame([("A", "L1", None, None), ("B", "L2", "A", "b")], "label string, level string, parent string, description string")
    got = changes.apply_changes(tree, spark.createDataFrame([], "alias string, node string"), metrics, table)
    assert {r["seq"] for r in got.rejected.collect()} == {1, 2, 4, 6, 8, 11}
    m = {r["metric"]: r for r in got.metrics.collect()}
    assert set(m) == {"Margin", "Cost", "Old", "Net Sales"} and m["Margin"]["grain"] == "store" and m["Cost"]["variants"] == ["Costs", "c", "cs"] and m["Cost"]["sources"] == ["s1", "s2"]
    assert {tuple(r) for r in got.nodes.collect()} == {("A", "L1", None, "two words"), ("C", "L2", "A", "b")}
    tags = spark.createDataFrame([(1, "b", "B", "L2"), (1, "c", "C", "L2"), (2, "a", "A", "L1")], "chunk_id long, category_id string, category_label string, kind string")
    moved, again = changes.follow_moves(tags, got.moves)
    assert {tuple(r)[:3] for r in moved.collect()} == {(1, "c", "C"), (2, "a", "A")} and again.count() == 0
    none = changes.apply_changes(tree.limit(0), got.aliases.limit(0), metrics.limit(0), table.limit(0))
    assert [df.select(F.count("*")).first()[0] for df in none] == [0] * 7
