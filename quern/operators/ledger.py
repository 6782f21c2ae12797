"""The whole fold of a ledger of work: events of agents and people, in order, to nodes with their state.

Nothing is folded row by row but the lists of criteria. What a loop over events would do comes apart into relations:

* which events count (undo, decisions, verdicts, playback by evidence, copies of evidence, re-dated evidence) is joins;
* which merges apply is a contraction in rounds: of the merges still open, each whose node has no earlier one and whose target cannot
  be merged away before is decided, all of a round at once; then every node knows who stood for it at any time;
* a field is the last value a person gave it, else the last an agent gave; states follow from the last op that sets one and what came after;
* dependencies and criteria of merged nodes go to their targets level by level of the merge tree.

Events (columns that are missing count as null): ``seq`` (long, distinct: the order of the ledger), ``mid``, ``type`` (create, agent, human, verdict, processed, reprocess),
``op``, ``by``, ``node``, ``other`` (the node linked to, merged into or moved under), ``target`` (mid that is undone, accepted or rejected), ``evidence``, ``date``,
``verdict``, ``pending``, ``effect``, ``kind``, ``title``, ``parent``, ``internal_owner``, ``client_owner``, ``client_owed``, ``due``, ``what``, ``from_proposal``, ``set`` (map),
``depends_on``, ``ac`` (arrays), ``ac_n``, ``ac_text``, ``met``, ``drop``.
Evidence: ``evidence``, ``at`` (its time; any type that has an order, such as a struct with what settles ties), ``date``, ``duplicate_of``. Rows with a null seq, and further creates of an id, are left out; events on nodes
that are not created before them have no effect; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import settled

EVENT = {
    "seq": "long", "date": "string", "set": "map<string,string>", "depends_on": "array<string>", "ac": "array<string>", "ac_n": "int", "met": "boolean", "drop": "boolean", "client_owed": "boolean",
}
EVENT |= dict.fromkeys(
    "mid type op by node other target evidence verdict pending effect kind title parent internal_owner client_owner due what from_proposal ac_text".split(), "string"
)

# The ledger's vocabulary
STATUS = ["held", "done", "progress", "blocked", "cancelled", "reopen", "due", "delayed", "reassign"]
VERIFIED_OPS = ["ac_met", "link", "waiting"]
CLOSED = ["done", "cancelled", "merged", "deleted"]
HUMAN_FIELDS = ["title", "internal_owner", "client_owner", "due", "state", "parent", "type", "client_owed", "waiting_for"]
PARENTS = {"story": ["epic"], "task": ["story"], "risk": ["epic", "story"], "decision": ["epic", "story"]}

CRITERIA = "node string, criteria array<struct<text:string,met:boolean,dropped:boolean,human:boolean>>"


def typed(events: DataFrame) -> DataFrame:
    """``events`` with every column of the ledger, typed; missing ones null."""
    have = set(events.columns)
    return events.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in EVENT.items()]).filter("seq is not null")


def effective(events: DataFrame, evidence: DataFrame, upto: str | None = None) -> DataFrame:
    """The events that count up to the evidence item ``upto`` (null: the last one read), with ``decision`` (accept, reject, pending) and ``ok`` (needs no verdict, or is supported).

    Evidence stands in order of its time, then its id, whatever the order of arrival; a copy stands where its original does. Events of agents
    on evidence later than the limit, or unknown, do not count yet; a person's edit counts once its evidence is reached, at once if that is unknown.
    """
    e = typed(events)
    ev = evidence.select("evidence", F.col("at"), F.col("date").cast("string").alias("dated"), "duplicate_of").filter("evidence is not null").dropDuplicates(["evidence"])
    original = ev.select(F.col("evidence").alias("of"), F.struct("at", F.col("evidence").alias("name")).alias("pos"), "dated", F.col("duplicate_of").isNotNull().alias("copy"))
    placed = ev.select(F.col("evidence").alias("given"), F.coalesce("duplicate_of", "evidence").alias("of")).join(original, "of", "left")
    e = e.withColumnRenamed("evidence", "given").join(placed, "given", "left").withColumn("evidence", F.coalesce("of", "given"))
    pos = F.when(~F.col("copy"), F.col("pos"))
    if upto is None:
        # read as it was cited: a copy of an item does not count as read
        read = e.filter("type in ('processed', 'reprocess')").groupBy("given").agg(F.max_by("type", "seq").alias("last")).filter("last = 'processed'")
        seen = e.filter("by = 'agent'").select("given").unionByName(read.select("given")).distinct().withColumnRenamed("given", "of")
        lim = original.filter("not copy").join(seen, "of", "left_semi").agg(F.max("pos").alias("lim"))
    else:
        lim = original.filter((F.col("of") == upto) & ~F.col("copy")).agg(F.max("pos").alias("lim"))
    person = F.coalesce(F.col("by") == "human", F.lit(False))
    e = e.withColumn("pos", pos).join(F.broadcast(lim), F.lit(True))  # one row
    past = F.coalesce(F.col("pos") > F.col("lim"), F.lit(True))
    e = e.filter(F.col("evidence").isNull() | F.when(person, F.col("pos").isNull() | ~past).otherwise(~past))
    e = e.withColumn("date", F.when(~person, F.coalesce("dated", "date")).otherwise(F.col("date")))

    every = typed(events)
    undone = every.filter("type = 'human' and op = 'undo' and target is not null").select(F.col("target").alias("mid")).distinct()
    verdicts = every.filter("type = 'verdict'").groupBy("mid").agg(F.max_by("verdict", "seq").alias("found"))
    decided = every.filter("type = 'human' and op in ('accept', 'reject')").join(undone, "mid", "left_anti").groupBy(F.col("target").alias("mid"))
    decided = decided.agg(F.max_by("op", "seq").alias("decision"), F.max(F.when(F.col("op") == "accept", F.col("seq"))).alias("accepted_at"))
    granted = decided.filter("decision = 'accept'").select(F.col("mid").alias("from_proposal"))
    e = e.join(undone, "mid", "left_anti").join(verdicts, "mid", "left").join(decided, "mid", "left").join(granted.withColumn("granted", F.lit(True)), "from_proposal", "left")
    e = e.filter("type <> 'create' or from_proposal is null or granted")
    waits = (F.col("type") == "agent") & F.coalesce(F.col("pending") != "human", F.lit(True)) & (F.col("op").isin(VERIFIED_OPS) | ((F.col("op") == "status") & F.coalesce(F.col("effect").isin(STATUS), F.lit(False))))
    ok = ~F.coalesce(waits, F.lit(False)) | F.coalesce(F.col("found") == "supports", F.lit(False))
    return e.select(*EVENT, "accepted_at", F.coalesce("decision", F.lit("pending")).alias("decision"), ok.alias("ok"))


def applied_merges(merges: DataFrame) -> DataFrame:
    """node, at, into: the merges (seq, a, b: what stands for a goes into what stands for b) that apply; a merge of what is one already does not.

    A round decides every open merge that is the first at its node, unless its target can be merged away before: by a merge of its own, or
    by a later merge of a node that goes into it before. Then targets take their nodes' places in the later ones. The earliest open one is always
    decided. Rounds grow with chains of ever later merges of one node; merges into a hub are one round.
    """
    open_ = settled(merges.select("seq", "a", "b").filter("a <> b"), "merges")
    parts: list[DataFrame] = []
    while not open_.isEmpty():
        ends = open_.select(F.col("a").alias("n"), "seq").unionByName(open_.select(F.col("b").alias("n"), "seq"))
        first = ends.groupBy("n").agg(F.min("seq").alias("first"))
        second = ends.join(first, "n").filter("seq > first").groupBy("n").agg(F.min("seq").alias("second"))
        own = open_.join(first.withColumnRenamed("n", "a"), "a").join(second.withColumnRenamed("n", "a"), "a", "left")
        bound = own.select(F.col("a").alias("b"), F.col("seq").alias("held")).unionByName(own.select("b", F.when(F.col("seq") == F.col("first"), F.col("second")).otherwise(F.col("seq")).alias("held")))
        bound = bound.groupBy("b").agg(F.min("held").alias("held"))
        now = own.filter("seq = first").join(bound, "b").filter("held is null or seq < held")
        now = settled(now.select(F.col("a").alias("node"), F.col("seq").alias("at"), F.col("b").alias("into")), "merged")
        parts.append(now)
        left = open_.join(now.select(F.col("at").alias("seq")), "seq", "left_anti")
        for end in ("a", "b"):
            left = left.join(now.select(F.col("node").alias(end), F.col("into").alias("now")), end, "left").withColumn(end, F.coalesce("now", end)).drop("now")
        open_ = settled(left.filter("a <> b").select("seq", "a", "b"), "merges")
        if len(parts) % 8 == 0:
            parts = [settled(_all(parts), "merged")]
    return settled(_all(parts), "merged") if parts else open_.select(F.col("a").alias("node"), F.col("seq").alias("at"), F.col("b").alias("into"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def standing(lost: DataFrame) -> DataFrame:
    """node, since, until, who: who stands for a merged node after ``since`` up to and with ``until`` (null: to the end)."""
    step = settled(lost.select("node", F.col("at").alias("since"), F.col("into").alias("who")), "standing")
    next_ = lost.select(F.col("node").alias("who"), "at", "into")
    parts = []
    while not step.isEmpty():
        parts.append(step)
        step = settled(step.join(next_, "who").select("node", F.col("at").alias("since"), F.col("into").alias("who")), "standing")
    found = _all(parts) if parts else step
    return settled(found.withColumn("until", F.lead("since").over(Window.partitionBy("node").orderBy("since"))), "standing")


def _resolved(rows: DataFrame, stands: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: who stands for ``column`` at ``seq``."""
    s = stands.select(F.col("node").alias("__n"), F.col("since").alias("__s"), F.col("until").alias("__u"), F.col("who").alias("__w"))
    met = (F.col(column) == F.col("__n")) & (F.col("seq") > F.col("__s")) & (F.col("__u").isNull() | (F.col("seq") <= F.col("__u")))
    return rows.join(s, met, "left").withColumn(out, F.coalesce("__w", column)).drop("__n", "__s", "__u", "__w")


def _finally(rows: DataFrame, stands: DataFrame, column: str) -> DataFrame:
    s = stands.filter("until is null").select(F.col("node").alias(column), F.col("who").alias("__w"))
    return rows.join(s, column, "left").withColumn(column, F.coalesce("__w", column)).drop("__w")


def fold_ledger(events: DataFrame, evidence: DataFrame, upto: str | None = None) -> DataFrame:
    """A row per node: id, kind, title, type, state, derived, parent, merged_into, internal_owner, client_owner, client_owed, due, n_due, waiting_for, pinned, depends_on,
    waiting_on, blocks, n_criteria, n_met, n_pending, n_superseded, created, last_date. Arrays are sorted.

    ``pinned``: fields that a person set, which agents no longer change. ``derived``: why a story's state is not what events say (``criteria``: all are met;
    ``task``: one of its tasks moved). ``n_due``: entries of its history of due dates. ``n_pending`` and ``n_superseded``: suggestions
    that wait, and status suggestions that waited when another of the node was accepted. ``merged_into``: who stands for it at the end.
    """
    e = settled(effective(events, evidence, upto), "effective")
    made = e.filter("type = 'create' and node is not null").withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("seq"))).filter("k = 1").drop("k")
    made = settled(made, "created")
    known = made.select(F.col("node").alias("id"), "kind", F.col("seq").alias("born"))

    structural = F.when((F.col("type") == "human") & (F.col("op") == "merge"), "merge").when((F.col("type") == "agent") & F.col("op").isin("suggest_merge", "suggest_move") & (F.col("decision") == "accept"), F.substring("op", 9, 5))
    wanted = e.withColumn("does", structural).filter("does is not null").select("seq", "node", "other", "does", "date")
    edits = e.filter("type = 'human' and op = 'edit' and set is not null").select("seq", "node", "date", F.explode("set").alias("field", "value")).filter(F.col("field").isin(HUMAN_FIELDS))
    moves = wanted.filter("does = 'move'").drop("does").unionByName(edits.filter("field = 'parent'").select("seq", "node", F.col("value").alias("other"), "date"))
    a = known.select(F.col("id").alias("a"), F.col("kind").alias("ka"), F.col("born").alias("ba"))
    b = known.select(F.col("id").alias("b"), F.col("kind").alias("kb"), F.col("born").alias("bb"))
    merges = wanted.filter("does = 'merge'").select("seq", F.col("node").alias("a"), F.col("other").alias("b")).join(a, "a").join(b, "b").filter("ka = kb and seq > ba and seq > bb")
    lost = applied_merges(merges)
    stands = standing(lost)

    def on_node(rows: DataFrame) -> DataFrame:
        """Rows on nodes that exist by then, at who stands for them."""
        r = _resolved(rows, stands, "node", "to").drop("node").withColumnRenamed("to", "node")
        return r.join(known.select(F.col("id").alias("node"), F.col("kind").alias("node_kind"), "born"), "node").filter("seq > born").drop("born")

    agent = settled(on_node(e.filter("type = 'agent'")), "agent")
    person = settled(on_node(e.filter("type = 'human' and op not in ('undo', 'accept', 'reject', 'create')")), "person")
    set_by_hand = on_node(edits.filter("field <> 'parent'")).select("node", "seq", "field", "value")
    set_by_hand = set_by_hand.unionByName(person.filter("op = 'delete'").select("node", "seq", F.lit("state").alias("field"), F.lit("deleted").alias("value")))
    under = _resolved(on_node(moves), stands, "other", "under").join(known.select(F.col("id").alias("under"), F.col("kind").alias("above"), F.col("born").alias("b2")), "under").filter("seq > b2 and under <> node")
    fits = F.lit(False)
    for kind, above in PARENTS.items():
        fits = fits | ((F.col("node_kind") == kind) & F.col("above").isin(above))
    set_by_hand = set_by_hand.unionByName(under.filter(fits).select("node", "seq", F.lit("parent").alias("field"), F.col("under").alias("value")))
    set_by_hand = set_by_hand.unionByName(made.filter("by = 'human'").select("node", "seq", F.lit("title").alias("field"), F.col("title").alias("value")))
    set_by_hand = settled(set_by_hand, "by-hand")

    # status events: which may act at all
    pins = set_by_hand.groupBy("node").agg(*[F.min(F.when(F.col("field") == f, F.col("seq"))).alias(f"pin_{f}") for f in ("state", "due")])
    gone = set_by_hand.filter("field = 'state'").withColumn("until", F.lead("seq").over(Window.partitionBy("node").orderBy("seq"))).filter("value = 'deleted'")
    gone = gone.select(F.col("node").alias("__n"), F.col("seq").alias("since"), "until")
    status = agent.filter("op = 'status' and effect <> 'mention'").filter("case when pending = 'human' then decision = 'accept' else ok end")
    status = status.join(gone, (F.col("node") == F.col("__n")) & (F.col("seq") > F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))), "left_anti").join(pins, "node", "left")
    status = settled(status.filter("pin_state is null or seq < pin_state or effect in ('due', 'delayed', 'reassign')"), "status")
    free_due = F.col("pin_due").isNull() | (F.col("seq") < F.col("pin_due"))

    def given(rows: DataFrame, field: str, value) -> DataFrame:
        return rows.select("node", "seq", F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(False).alias("hand"))

    sets = [set_by_hand.withColumn("hand", F.lit(True))]
    sets += [given(made, f, F.col(f)) for f in ("title", "parent", "internal_owner", "client_owner")]
    sets += [given(made, "client_owed", F.coalesce("client_owed", F.lit(False))), given(made, "state", F.lit("open")), given(made, "type", F.lit(None))]
    sets += [given(agent.filter("op = 'revise' and title is not null and title <> ''"), "title", F.col("title"))]
    sets += [given(agent.filter("op = 'waiting' and ok"), "waiting_for", F.when(F.col("what") != "", F.col("what"))), given(status.filter("effect in ('done', 'held')"), "waiting_for", F.lit(None))]
    sets += [given(status.filter(f"effect = 'reassign' and {f} is not null"), f, F.col(f)) for f in ("internal_owner", "client_owner")]
    sets += [given(status.filter("effect in ('done', 'held', 'blocked', 'cancelled')"), "state", F.when(F.col("effect") == "held", "done").otherwise(F.col("effect")))]
    last = F.struct("hand", "seq")
    fields = ["title", "type", "parent", "internal_owner", "client_owner", "client_owed", "state", "waiting_for"]
    of = lambda f, c: F.when(F.col("field") == f, c)
    nodes = _all(sets).groupBy("node").agg(
        *[F.max_by("value", of(f, last)).alias(f) for f in fields], F.max(of("state", last)).alias("state_at"), F.max(of("parent", last))["seq"].alias("parent_at"),
        F.array_sort(F.collect_set(F.when(F.col("hand"), F.col("field")))).alias("pinned"),
    )
    moved = status.groupBy("node").agg(*[F.max(F.when(F.col("effect") == x, F.col("seq"))).alias(x) for x in ("progress", "reopen")])
    after = lambda x: ~F.col("state_at.hand") & F.coalesce(F.col(x) > F.col("state_at.seq"), F.lit(False))
    state = F.when(F.col("state").isin("open", "blocked") & after("progress"), "in_progress").when(F.col("state").isin("done", "cancelled") & after("reopen"), "in_progress").otherwise(F.col("state"))

    # due dates
    entry = lambda rows, due, always: rows.select("node", "seq", due.alias("due"), F.lit(always).alias("always"))
    dues = entry(made.filter("due is not null"), F.col("due"), True).unionByName(entry(set_by_hand.filter("field = 'due'"), F.col("value"), True))
    dues = dues.unionByName(entry(status.filter("effect = 'delayed'").filter(free_due), F.lit(None).cast("string"), True)).unionByName(entry(status.filter("effect <> 'delayed' and due is not null").filter(free_due), F.col("due"), False))
    w = Window.partitionBy("node").orderBy("seq")
    fresh = F.col("always") | F.lag("seq").over(w).isNull() | ~F.lag("due").over(w).eqNullSafe(F.col("due"))
    dues = dues.withColumn("fresh", fresh).groupBy("node").agg(F.max_by("due", "seq").alias("due"), F.count_if("fresh").alias("n_due"))

    # suggestions
    cards = agent.filter("op in ('propose', 'suggest_move', 'suggest_merge') or (op in ('status', 'ac_met') and pending = 'human')")
    taken = cards.filter("op = 'status' and decision = 'accept'").groupBy("node").agg(F.max("accepted_at").alias("settled_at"))
    late = F.coalesce((F.col("op") == "status") & (F.col("seq") < F.col("settled_at")), F.lit(False))
    cards = cards.filter("decision = 'pending'").join(taken, "node", "left").groupBy("node").agg(F.count_if(~late).alias("n_pending"), F.count_if(late).alias("n_superseded"))

    n = nodes.join(made.select("node", "kind", F.col("date").alias("created")), "node").join(moved, "node", "left").withColumn("state", state)
    n = n.join(lost.select("node", "at"), "node", "left").withColumn("state", F.when(F.col("at").isNotNull(), "merged").otherwise(F.col("state")))
    n = n.join(stands.filter("until is null").select("node", F.col("who").alias("merged_into")), "node", "left")
    # a parent that is merged away after it was set hands its children on
    heirs = lost.select(F.col("node").alias("parent"), F.col("at").alias("__at")).join(stands.filter("until is null").select(F.col("node").alias("parent"), "who"), "parent")
    n = n.join(heirs, "parent", "left").withColumn("parent", F.when(F.col("__at") > F.col("parent_at"), F.col("who")).otherwise(F.col("parent"))).drop("who", "__at")
    dates = agent.select("node", "date").unionByName(person.select("node", "date")).unionByName(made.select("node", "date")).groupBy("node").agg(F.max("date").alias("last_date"))
    links, criteria = _carried(made, agent, person, known, lost, stands)
    counts = criteria.select("node", F.filter("criteria", lambda x: ~x["dropped"]).alias("c")).select("node", F.size("c").cast("long").alias("n_criteria"), F.size(F.filter("c", lambda x: x["met"])).cast("long").alias("n_met"))
    for more in (dues, cards, dates, counts):
        n = n.join(more, "node", "left")
    n = settled(n.na.fill(0, ["n_due", "n_pending", "n_superseded", "n_criteria", "n_met"]), "nodes")
    return _derived(n, _finally(links, stands, "other").filter("node <> other").distinct())


def _carried(made: DataFrame, agent: DataFrame, person: DataFrame, known: DataFrame, lost: DataFrame, stands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dependencies (node, other) and criteria (node, criteria) of every node, with what merged nodes brought to their targets."""
    there = known.select(F.col("id").alias("to"), F.col("born").alias("b2"))

    def linked(rows: DataFrame, act: str) -> DataFrame:
        return _resolved(rows, stands, "other", "to").join(there, "to").filter("seq > b2 and to <> node").select("node", F.col("to").alias("other"), "seq", F.lit(act).alias("act"))

    acts = linked(agent.filter("op = 'link' and ok"), "agent").unionByName(linked(person.filter("op = 'link'"), "add"))
    acts = acts.unionByName(person.filter("op = 'unlink'").select("node", "other", "seq", F.lit("cut").alias("act")))
    acts = settled(acts.unionByName(made.select("node", F.explode("depends_on").alias("other"), "seq", F.lit("agent").alias("act"))), "link-acts")
    none = "cast(null as array<struct<text:string,met:boolean,dropped:boolean,human:boolean>>) as brought"
    step = lambda rows, act: rows.selectExpr("node", "seq", f"'{act}' as act", "ac", "ac_n", "ac_text", "met", "drop", none)
    lists = step(made.filter("size(ac) > 0").withColumn("by", F.lit("x")), "new").unionByName(step(agent.filter("op = 'revise' and size(ac) > 0"), "new"))
    lists = lists.unionByName(step(agent.filter("op = 'ac_met' and case when pending = 'human' then decision = 'accept' else ok end"), "claim"))
    lists = lists.unionByName(step(person.filter("op = 'ac_add' and ac_text is not null").withColumn("ac", F.array("ac_text")), "new")).unionByName(step(person.filter("op = 'ac_set'"), "set"))
    lists = settled(lists, "criteria-acts")

    def pairs(rows: DataFrame) -> DataFrame:
        hard = F.when(F.col("act") != "agent", F.col("seq"))
        return rows.groupBy("node", "other").agg(F.max_by("act", hard).alias("last")).filter("last is null or last <> 'cut'").select("node", "other")

    # only what merged nodes have is read a level at a time; what they bring is small beside the acts
    gone = lost.select("node")
    waiting, of_lost, lists_of_lost = lost, settled(acts.join(gone, "node", "left_semi"), "link-acts"), settled(lists.join(gone, "node", "left_semi"), "criteria-acts")
    links, lines = [], []
    while not waiting.isEmpty():
        ready = settled(waiting.join(waiting.select(F.col("into").alias("node")).distinct(), "node", "left_anti"), "ready")
        only = ready.select("node")
        brought = pairs(_all([of_lost, *links]).join(only, "node", "left_semi")).join(ready, "node").filter("other <> into")
        links.append(settled(brought.select(F.col("into").alias("node"), "other", F.col("at").alias("seq"), F.lit("add").alias("act")), "brought"))
        more = _lists(_all([lists_of_lost, *lines]).join(only, "node", "left_semi")).join(ready, "node").withColumnRenamed("criteria", "brought")
        lines.append(settled(more.selectExpr("into as node", "at as seq", "'merge' as act", "cast(null as array<string>) as ac", "cast(null as int) as ac_n", "cast(null as string) as ac_text", "cast(null as boolean) as met", "cast(null as boolean) as drop", "brought"), "brought"))
        waiting = settled(waiting.join(only, "node", "left_anti"), "lost")
        if len(links) % 8 == 0:
            links, lines = [settled(_all(links), "brought")], [settled(_all(lines), "brought")]
    return settled(pairs(_all([acts, *links])), "links"), settled(_lists(_all([lists, *lines])), "criteria")


def _lists(acts: DataFrame) -> DataFrame:
    """node, criteria: lists after their acts in order. A number in an act counts the lines not dropped by then, so acts are taken one by one; a task holds one list."""
    return acts.repartition("node").sortWithinPartitions("node", "seq").mapInArrow(_fold_lists, CRITERIA)


def _fold_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("text", pa.string()), ("met", pa.bool_()), ("dropped", pa.bool_()), ("human", pa.bool_())]))
    node, lines, done = None, [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], kind)], ["node", "criteria"])

    for batch in batches:
        for act in batch.to_pylist():
            if act["node"] != node:
                if node is not None:
                    done.append((node, lines))
                node, lines = act["node"], []
            _act(lines, act)
        if done:
            yield out()
            done = []
    if node is not None:
        done.append((node, lines))
        yield out()


def _act(lines: list[dict], act: dict) -> None:
    if act["act"] == "new":
        lines += [{"text": t, "met": False, "dropped": False, "human": False} for t in act["ac"]]
        return
    if act["act"] == "merge":
        have = {x["text"] for x in lines}
        lines += [dict(x) for x in act["brought"] if x["text"] not in have]
        return
    shown = [x for x in lines if not x["dropped"]]
    if act["act"] == "claim" and act["ac_text"]:
        hit = next((x for x in shown if x["text"] == act["ac_text"]), None)
    else:
        hit = shown[act["ac_n"] - 1] if act["ac_n"] and 0 < act["ac_n"] <= len(shown) else None
    if hit is None:
        return
    if act["act"] == "claim":
        hit["met"] = hit["met"] or not hit["human"]
        return
    if act["ac_text"] is not None:
        hit["text"] = act["ac_text"]
    if act["met"] is not None:
        hit["met"], hit["human"] = act["met"], True
    if act["drop"]:
        hit["dropped"] = True


def _derived(n: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with their stories' derived states, what they wait on and what they block."""
    kids = n.filter("kind = 'task' and state not in ('merged', 'deleted') and parent is not null")
    busy = kids.groupBy(F.col("parent").alias("node")).agg(F.max(F.col("state").isin("done", "in_progress")).alias("busy"))
    free = (F.col("kind") == "story") & ~F.col("state").isin(CLOSED) & ~F.array_contains("pinned", "state")
    why = F.when(free & (F.col("n_criteria") > 0) & (F.col("n_met") == F.col("n_criteria")), "criteria").when(free & (F.col("state") == "open") & F.coalesce("busy", F.lit(False)), "task")
    n = n.join(busy, "node", "left").withColumn("derived", why).withColumn("state", F.when(F.col("derived") == "criteria", "done").when(F.col("derived") == "task", "in_progress").otherwise(F.col("state"))).drop("busy")
    n = settled(n, "derived")
    open_ = n.filter(~F.col("state").isin(CLOSED))
    owed = open_.filter("kind = 'task' and client_owed = 'true' and parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("other")).join(n.filter("kind = 'story'").select("node"), "node", "left_semi")
    waits = links.join(open_.select(F.col("node").alias("other")), "other", "left_semi").unionByName(owed).distinct()
    gather = lambda rows, key, value, name: rows.groupBy(F.col(key).alias("node")).agg(F.array_sort(F.collect_set(value)).alias(name))
    blocks = gather(waits.join(open_.select("node"), "node", "left_semi"), "other", "node", "blocks")
    for name, found in (("depends_on", gather(links, "node", "other", "depends_on")), ("waiting_on", gather(waits, "node", "other", "waiting_on")), ("blocks", blocks)):
        n = n.join(found, "node", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return n.select(
        F.col("node").alias("id"), "kind", "title", "type", "state", "derived", "parent", "merged_into", "internal_owner", "client_owner", (F.col("client_owed") == "true").alias("client_owed"), "due",
        "n_due", "waiting_for", "pinned", "depends_on", "waiting_on", "blocks", "n_criteria", "n_met", "n_pending", "n_superseded", "created", "last_date",
    )
