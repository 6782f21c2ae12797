"""The ledger's fold against a loop over its events, on random ledgers."""

import random

import pytest

from pyspark.sql import functions as F
from quern.operators import ledger

EVENT_SCHEMA = ", ".join(f"`{c}` {t}" for c, t in ledger.EVENT.items())
EVIDENCE_SCHEMA = "evidence string, at long, date string, duplicate_of string"
OPEN_DONE = ("done", "cancelled", "merged", "deleted")


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in ledger.EVENT) for r in rows], EVENT_SCHEMA)


class Loop:
    """One event after the other, with every node's state in a dictionary."""

    def __init__(self, rows, evidence, upto):
        rows = sorted(rows, key=lambda r: r["seq"])
        info = {x[0]: x for x in evidence}
        rank = {x[0]: i for i, x in enumerate(sorted((x for x in evidence if x[3] is None), key=lambda x: (x[1], x[0])))}
        read = {r["evidence"]: r["type"] for r in rows if r["type"] in ("processed", "reprocess")}
        seen = [rank[v] for v in {r["evidence"] for r in rows if r.get("by") == "agent"} | {v for v, t in read.items() if t == "processed"} if v in rank]
        limit = rank[upto] if upto else max(seen, default=-1)
        undone = {r["target"] for r in rows if r["type"] == "human" and r["op"] == "undo"}
        self.verdict = {r["mid"]: r["verdict"] for r in rows if r["type"] == "verdict"}
        self.choice, self.when = {}, {}
        for r in rows:
            if r["type"] == "human" and r["op"] in ("accept", "reject") and r["mid"] not in undone:
                self.choice[r["target"]] = r["op"]
                if r["op"] == "accept":
                    self.when[r["target"]] = r["seq"]
        self.nodes = {}
        for r in rows:
            r = dict(r)
            item = r.get("evidence")
            if item in info and info[item][3]:
                item = info[item][3]
            person = r.get("by") == "human"
            if item and ((not person and rank.get(item, 10**9) > limit) or (person and rank.get(item, -1) > limit)):
                continue
            if r["mid"] in undone:
                continue
            if not person and item in info and info[item][2]:
                r["date"] = info[item][2]
            getattr(self, "on_" + r["type"], lambda r: None)(r)

    def who(self, i):
        while i in self.nodes and self.nodes[i]["into"]:
            i = self.nodes[i]["into"]
        return i

    def put(self, n, field, value, person):
        if person:
            n["pinned"].add(field)
        elif field in n["pinned"]:
            return
        n[field] = value

    def on_create(self, r):
        if r.get("from_proposal") and self.choice.get(r["from_proposal"]) != "accept":
            return
        n = {k: r.get(k) for k in ("kind", "title", "parent", "internal_owner", "client_owner")}
        n |= {"type": None, "client_owed": bool(r.get("client_owed")), "state": "open", "into": None, "pinned": {"title"} if r.get("by") == "human" else set(), "waiting_for": None, "cards": []}
        n |= {"ac": [[t, False, False, False] for t in r.get("ac") or []], "deps": list(r.get("depends_on") or []), "cut": [], "dues": [r["due"]] if r.get("due") else [], "created": r.get("date"), "dates": [r.get("date")]}
        self.nodes[r["node"]] = n

    def move(self, i, n, to):
        to = self.who(to)
        if to in self.nodes and to != i and self.nodes[to]["kind"] in ledger.PARENTS.get(n["kind"], []):
            self.put(n, "parent", to, True)

    def merge(self, i, n, to):
        to = self.who(to)
        if to not in self.nodes or to == i or self.nodes[to]["kind"] != n["kind"]:
            return
        t = self.nodes[to]
        n["into"], n["state"] = to, "merged"
        have = {x[0] for x in t["ac"]}
        t["ac"] += [list(x) for x in n["ac"] if x[0] not in have]
        t["deps"] += [d for d in n["deps"] if d not in t["deps"] and d != to]
        for c in self.nodes.values():
            if c["parent"] == i:
                c["parent"] = to

    def status(self, n, r):
        x, due = r["effect"], r.get("due")
        if n["state"] == "deleted" or x == "mention" or ("state" in n["pinned"] and x not in ("due", "delayed", "reassign")):
            return
        if x in ("done", "held"):
            n["state"] = "done"
            self.put(n, "waiting_for", None, False)
        elif x in ("blocked", "cancelled"):
            n["state"] = x
        elif (x == "progress" and n["state"] in ("open", "blocked")) or (x == "reopen" and n["state"] in ("done", "cancelled")):
            n["state"] = "in_progress"
        elif x == "reassign":
            for k in ("internal_owner", "client_owner"):
                if r.get(k):
                    self.put(n, k, r[k], False)
        if "due" in n["pinned"]:
            return
        if x == "delayed":
            n["dues"].append(None)
        elif due and (not n["dues"] or n["dues"][-1] != due):
            n["dues"].append(due)

    def on_agent(self, r):
        i = self.who(r["node"])
        n = self.nodes.get(i)
        if n is None:
            return
        n["dates"].append(r.get("date"))
        op, supported = r["op"], self.verdict.get(r["mid"]) == "supports"
        choice = self.choice.get(r["mid"], "pending")
        human = r.get("pending") == "human"
        if op in ("propose", "suggest_move", "suggest_merge") or (op in ("status", "ac_met") and human):
            n["cards"].append((op, r["mid"], r["seq"], choice))
        go = choice == "accept" if human else supported
        if op == "status" and go:
            self.status(n, r)
        elif op == "ac_met" and go:
            shown = [x for x in n["ac"] if not x[2]]
            hit = [x for x in shown if x[0] == r["ac_text"]][:1] if r.get("ac_text") else shown[r["ac_n"] - 1 : r["ac_n"]]
            for x in hit:
                x[1] = x[1] or not x[3]
        elif op == "revise":
            if r.get("title"):
                self.put(n, "title", r["title"], False)
            n["ac"] += [[t, False, False, False] for t in r.get("ac") or []]
        elif op == "link" and supported:
            d = self.who(r["other"])
            if d in self.nodes and d not in n["deps"] and d not in n["cut"] and d != i:
                n["deps"].append(d)
        elif op == "waiting" and supported:
            self.put(n, "waiting_for", r.get("what") or None, False)
        elif op in ("suggest_move", "suggest_merge") and choice == "accept":
            getattr(self, op[8:])(i, n, r["other"])

    def on_human(self, r):
        i = self.who(r["node"])
        n = self.nodes.get(i)
        op = r["op"]
        if n is None or op in ("undo", "accept", "reject"):
            return
        n["dates"].append(r.get("date"))
        if op == "edit":
            for k, v in r["set"].items():
                if k == "parent":
                    self.move(i, n, v)
                elif k == "due":
                    n["dues"].append(v)
                    n["pinned"].add("due")
                else:
                    self.put(n, k, v, True)
        elif op == "ac_add":
            n["ac"].append([r["ac_text"], False, False, False])
        elif op == "ac_set":
            shown = [x for x in n["ac"] if not x[2]]
            for x in shown[r["ac_n"] - 1 : r["ac_n"]]:
                x[0] = r.get("ac_text") or x[0]
                if r.get("met") is not None:
                    x[1], x[3] = r["met"], True
                x[2] = x[2] or bool(r.get("drop"))
        elif op == "link":
            d = self.who(r["other"])
            if d in self.nodes and d != i:
                n["deps"] += [d] * (d not in n["deps"])
                n["cut"] = [x for x in n["cut"] if x != d]
        elif op == "unlink":
            n["deps"] = [x for x in n["deps"] if x != r["other"]]
            n["cut"].append(r["other"])
        elif op == "merge":
            self.merge(i, n, r["other"])
        elif op == "delete":
            self.put(n, "state", "deleted", True)

    def rows(self):
        N = self.nodes
        for i, n in N.items():
            n["deps"] = {self.who(d) for d in n["deps"]} - {i}
            n["shown"] = [x for x in n["ac"] if not x[2]]
            accepted = [self.when[m] for op, m, _, c in n["cards"] if op == "status" and c == "accept"]
            waiting = [c for c in n["cards"] if c[3] == "pending"]
            n["late"] = sum(c[0] == "status" and c[2] < max(accepted, default=-1) for c in waiting)
            n["waiting"] = len(waiting) - n["late"]
        kids = {i: [c for c in N.values() if c["parent"] == i and c["state"] not in ("merged", "deleted") and c["kind"] == "task"] for i in N}
        for i, n in N.items():
            n["derived"] = None
            if n["kind"] == "story" and n["state"] not in OPEN_DONE and "state" not in n["pinned"]:
                if n["shown"] and all(x[1] for x in n["shown"]):
                    n["state"], n["derived"] = "done", "criteria"
                elif n["state"] == "open" and any(t["state"] in ("done", "in_progress") for t in kids[i]):
                    n["state"], n["derived"] = "in_progress", "task"
        for i, n in N.items():
            n["wait"] = {d for d in n["deps"] if d in N and N[d]["state"] not in OPEN_DONE}
            if n["kind"] == "story":
                n["wait"] |= {j for j, c in N.items() if c in kids[i] and str(c["client_owed"]).lower() == "true" and c["state"] not in OPEN_DONE}
        out = {}
        for i, n in N.items():
            out[i] = (
                n["kind"], n["title"], n["type"], n["state"], n["derived"], n["parent"], self.who(i) if n["into"] else None, n["internal_owner"], n["client_owner"], str(n["client_owed"]).lower() == "true",
                n["dues"][-1] if n["dues"] else None, len(n["dues"]), n["waiting_for"], sorted(n["pinned"]), sorted(n["deps"]), sorted(n["wait"]),
                sorted(m for m, x in N.items() if i in x["wait"] and x["state"] not in OPEN_DONE), len(n["shown"]), sum(x[1] for x in n["shown"]), n["waiting"], n["late"], n["created"],
                max((d for d in n["dates"] if d), default=None),
            )
        return out


def made_up(rng, n_nodes, n_events, merges):
    evidence = [(f"v{i}", rng.randrange(50), rng.choice([None, f"2026-01-{i + 1:02d}"]), None) for i in range(12)] + [("v12", 3, "2026-02-01", "v4")]
    ids = [f"n{i}" for i in range(n_nodes)]
    kind = {i: rng.choices(["epic", "story", "task", "risk"], [1, 4, 8, 1])[0] for i in ids}
    rows, mids = [], []

    def add(**r):
        r |= {"seq": len(rows), "mid": f"m{len(rows)}"}
        if r["type"] != "verdict":
            r.setdefault("evidence", rng.choice([None, "lost"] + [e[0] for e in evidence] * 2))
            r["date"] = f"2025-12-{rng.randrange(1, 29):02d}"
        else:
            r["mid"] = r.pop("of")
        rows.append(r)
        if r["type"] in ("agent", "human", "create"):
            mids.append(r["mid"])

    for i in ids:
        add(type="create", by=rng.choice(["agent", "human", "plan"]), evidence=rng.choice([None, None, None, "v1"]), node=i, kind=kind[i], title=f"t{i}", parent=rng.choice([None, *ids]), due=rng.choice([None, "d0"]),
            client_owed=rng.choice([None, True, False]), ac=[f"c{rng.randrange(4)}" for _ in range(rng.randrange(3))], depends_on=[rng.choice(ids)] if rng.random() < 0.2 else None,
            from_proposal=rng.choice([None] * 9 + ["m900"]), internal_owner=rng.choice([None, "ann"]))
    for _ in range(n_events):
        if rng.random() < 0.03:
            add(type=rng.choice(["processed", "reprocess"]), op=None, by=None)
        node, other, p = rng.choice([*ids, "nowhere"]), rng.choice(ids), rng.random()
        human = {"type": "human", "by": "human", "node": node}
        agent = {"type": "agent", "by": "agent", "node": node}
        if p < 0.3:
            add(**agent, op="status", effect=rng.choice([*ledger.STATUS, "mention"]), due=rng.choice([None, "d1", "d2"]), pending=rng.choice([None, None, "human"]), client_owner=rng.choice([None, "bob"]))
        elif p < 0.5:
            op = rng.choice(["revise", "ac_met", "link", "waiting", "suggest_move", "propose", "suggest_merge"])
            add(**agent, op=op, other=other, title=rng.choice([None, "new"]), ac=["c7"] if op == "revise" and rng.random() < 0.4 else None, ac_n=rng.randrange(1, 4), ac_text=rng.choice([None, "c1", "c7"]), what=rng.choice([None, "reply"]), pending="human" if op == "ac_met" and rng.random() < 0.5 else None)
        elif p < 0.6:
            field = rng.choice(["title", "state", "due", "parent", "waiting_for", "client_owed", "internal_owner"])
            add(**human, op="edit", set={field: {"state": rng.choice(["open", "done", "blocked"]), "parent": other, "client_owed": rng.choice(["true", "false"])}.get(field, f"h{rng.randrange(3)}")})
        elif p < 0.72:
            op = rng.choice(["ac_add", "ac_set", "link", "unlink"] + ["delete"] * (rng.random() < 0.3))
            add(**human, op=op, other=other, ac_n=rng.randrange(1, 4), ac_text=f"c{rng.randrange(9)}" if op == "ac_add" or rng.random() < 0.3 else None, met=rng.choice([None, True, False]), drop=rng.choice([None, True]))
        elif p < 0.72 + merges:
            add(**human, op="merge", other=other)
        elif p < 0.9 and mids:
            add(type="verdict", of=rng.choice(mids[-20:]), verdict=rng.choice(["supports", "supports", "refutes"]))
        elif mids:
            add(**human, op=rng.choice(["accept", "accept", "reject", "undo"]), target=rng.choice(mids[-25:]))
    return rows, evidence


@pytest.mark.parametrize("seed, merges, upto", [(2, 0.12, "v5"), (3, 0.16, None)])
def test_fold_is_the_loop(spark, seed, merges, upto):
    rng = random.Random(seed)
    rows, evidence = made_up(rng, 24, 420, merges)
    wanted = Loop(rows, evidence, upto).rows()
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = ledger.fold_ledger(frame(spark, shuffled).repartition(3), spark.createDataFrame(evidence, EVIDENCE_SCHEMA), upto)
    names = got.columns[1:]
    assert {r["id"]: dict(zip(names, r[1:], strict=True)) for r in got.collect()} == {i: dict(zip(names, v, strict=True)) for i, v in wanted.items()}
    assert sum(v[3] == "merged" for v in wanted.values()) >= 3


def test_merges_apply_like_union_find(spark):
    rng = random.Random(5)
    for n, m in ((12, 40), (30, 60)):
        rows = [(k, *rng.sample(range(n), 2)) for k in range(m)]
        into, wanted = {}, set()

        def top(x):
            while x in into:
                x = into[x]
            return x

        for k, a, b in rows:
            a, b = top(a), top(b)
            if a != b:
                into[a] = b
                wanted.add((a, k, b))
        got = ledger.applied_merges(spark.createDataFrame(rows, "seq long, a int, b int"))
        assert {tuple(r) for r in got.collect()} == wanted


def test_empty_tables_and_other_columns(spark):
    none = ledger.fold_ledger(frame(spark, []), spark.createDataFrame([], EVIDENCE_SCHEMA))
    assert none.count() == 0 and "waiting_on" in none.columns
    few = spark.createDataFrame([(1, "a", "create", "n", "task", "state of it", 7), (None, "b", "create", "x", "task", "no seq", 7)], "seq long, mid string, type string, node string, kind string, title string, at int")
    row = ledger.fold_ledger(few.withColumn("born", F.lit(1)), spark.createDataFrame([], EVIDENCE_SCHEMA)).collect()
    assert [(r["id"], r["state"], r["n_due"], r["depends_on"]) for r in row] == [("n", "open", 0, [])]


def test_derived_states_of_stories(spark):
    new = [("s", "story", None, ["a", "b"]), ("z", "story", None, ["a"]), ("t", "task", "z", None)]
    rows = [{"mid": f"k{i}", "type": "create", "by": "plan", "node": i, "kind": k, "title": i, "parent": p, "ac": ac} for i, k, p, ac in new]
    acts = [("m1", {"op": "ac_met", "node": "s", "ac_text": "a"}), ("m2", {"op": "ac_met", "node": "s", "ac_n": 2}), ("m3", {"op": "status", "effect": "done", "node": "t"})]
    rows += [{"mid": m, "type": "agent", "by": "agent", **x} for m, x in acts] + [{"mid": m, "type": "verdict", "verdict": "supports"} for m, _ in acts]
    rows = [r | {"seq": i} for i, r in enumerate(rows)]
    got = {r["id"]: (r["state"], r["derived"], r["n_met"]) for r in ledger.fold_ledger(frame(spark, rows), spark.createDataFrame([], EVIDENCE_SCHEMA)).collect()}
    assert got == {"s": ("done", "criteria", 2), "z": ("in_progress", "task", 0), "t": ("done", None, 0)}
