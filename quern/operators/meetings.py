"""Meetings against a calendar, spoken words against frames, quotes against gold, sentences against what was quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.dates import MONTHS
from quern.functions.text import containment, shingles, words
from quern.operators.evidence import n_words, plain, quote_offset

# Words of a title that say nothing.
STOP = ("a", "an", "the", "to", "of", "for", "and", "or", "on", "in", "with", "from", "by", "is", "be", "our", "we", "it", "this", "that")


def title_words(c: Column) -> Column:
    """Distinct words of a title in plain form, of two characters or more, without stop words, numbers and words that begin like a month."""
    told = lambda w: (F.length(w) > 1) & ~w.isin(*STOP) & ~w.rlike(r"^\d+$") & ~F.left(w, F.lit(3)).isin(*[m[:3] for m in MONTHS])
    return F.array_distinct(F.filter(F.split(plain(c), " "), told))


def _day(c: Column) -> Column:
    return F.unix_date(F.to_date(c))


def _keyed(df: DataFrame, shared: int, *more: Column) -> DataFrame:
    """``more``, at (a timestamp) and key of the rows of ``df`` (at, title): a row for each ``shared`` words of its title, so rows that share so many meet by one key, however common each word is."""
    own = df.select(*more, F.col("at").cast("timestamp").alias("at"), F.array_sort(title_words(F.col("title"))).alias("ws")).filter("at is not null and ws is not null").distinct()
    runs = F.transform("ws", lambda w, i: F.struct(i.alias("last"), w.alias("key")))
    for _ in range(shared - 1):
        later = lambda r: F.transform(F.slice("ws", r["last"] + 2, F.size("ws")), lambda w, i: F.struct((r["last"] + 1 + i).alias("last"), F.concat_ws(" ", r["key"], w).alias("key")))
        runs = F.flatten(F.transform(runs, later))
    return own.select("*", F.explode(F.transform(runs, lambda r: r["key"])).alias("key")).drop("ws")


def _nearest(left: DataFrame, right: DataFrame, *, item: str, other: str, days: int) -> DataFrame:
    """item, other, gap (microseconds): for each row and key of ``left`` (item, at, key) the last row of ``right`` (other, at, key) until its time and the first from then on, of those at most ``days`` days apart; ties to the smaller other.

    Rows lie in order of time by key and stretch of days, so the work grows with the rows and not with the pairs.
    """
    stretch = F.floor(_day(F.col("at")) / max(days, 1)).cast("long")
    x = left.select("key", "at", F.col(item), F.lit(1).alias("asks"), F.explode(F.sequence(stretch - 1, stretch + 1)).alias("cell"))
    y = right.select("key", "at", F.col(other), F.lit(0).alias("asks"), stretch.alias("cell"))
    held = F.when(F.col("asks") == 0, F.struct(F.col("at").alias("then"), F.col(other).alias("other")))
    reach = lambda *by: F.last(held, ignorenulls=True).over(Window.partitionBy("key", "cell").orderBy(*by, "asks", F.desc(other)).rowsBetween(Window.unboundedPreceding, 0))
    both = x.unionByName(y, allowMissingColumns=True).select(item, "at", "asks", F.array(reach(F.asc("at")), reach(F.desc("at"))).alias("met")).filter("asks = 1")
    near = both.select(item, "at", F.explode("met").alias("m")).filter(F.abs(_day(F.col("at")) - _day(F.col("m.then"))) <= days)
    return near.select(item, F.col("m.other").alias(other), F.abs(F.unix_micros("at") - F.unix_micros("m.then")).alias("gap"))


def calendar_match(meetings: DataFrame, calendar: DataFrame, *, days: int = 7, shared: int = 2) -> DataFrame:
    """meeting, event, gap (whole seconds): each meeting (meeting, at, title) with the nearest calendar event (event, at, title) of those within ``days`` days that share ``shared`` title words; ties to the smaller event.

    Meetings without such an event, without a time or a title have no row.
    """
    both = _nearest(_keyed(meetings, shared, F.col("meeting")), _keyed(calendar, shared, F.col("event")), item="meeting", other="event", days=days)
    best = both.groupBy("meeting").agg(F.min(F.struct("gap", "event")).alias("b"))
    return best.select("meeting", "b.event", F.expr("b.gap div 1000000").alias("gap"))


def expected_missing(expected: DataFrame, meetings: DataFrame, *, minutes: int = 20, shared: int = 2) -> DataFrame:
    """Expected meetings (expected, at, title) that no held one (meeting, at, title, guessed) satisfies: ``shared`` title words, and the same date where the held time was guessed, else ``minutes`` minutes at most."""
    asked = _keyed(expected, shared, F.col("expected"))
    held = _keyed(meetings, shared, F.coalesce("guessed", F.lit(False)).alias("guessed"))
    timed = _nearest(asked, held.filter("not guessed").withColumn("held", F.lit(True)), item="expected", other="held", days=1).filter(F.col("gap") <= minutes * 60_000_000)
    found = _same_day(asked, held.filter("guessed")).select("expected").unionByName(timed.select("expected"))
    return expected.join(found.distinct(), "expected", "left_anti")


def _same_day(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` (at, key) whose key and date ``right`` has."""
    day = F.to_date("at").alias("day")
    return left.withColumn("day", day).join(right.select("key", day).distinct(), ["key", "day"], "left_semi")


def unready(events: DataFrame, meetings: DataFrame, *, monday: str, now: str, shared: int = 2) -> DataFrame:
    """Events (event, at, ends, title) of the week of ``monday`` that ended by ``now`` without a meeting (at, title) of their day that shares ``shared`` title words; cancelled ones don't count."""
    day = F.to_date("at")
    due = events.filter((day >= F.to_date(F.lit(monday))) & (day < F.date_add(F.to_date(F.lit(monday)), 7)) & (F.col("ends") <= F.to_timestamp(F.lit(now)))).filter(~F.coalesce(F.lower("title").rlike("^cancell?ed"), F.lit(False)))
    found = _same_day(_keyed(due, shared, F.col("event")), _keyed(meetings, shared))
    return due.join(found.select("event").distinct(), "event", "left_anti")


def caption_leaks(lines: DataFrame, windows: DataFrame, cues: DataFrame, *, n: int = 6, near: int = 30) -> DataFrame:
    """Frame lines (page, line, text) that repeat ``n`` words in a row of a cue (at, text) spoken while a window (page, starts, ends; seconds) of the frame was shown, or ``near`` seconds from it.

    Only runs that some cue holds go on; those meet cues by the run and a minute of their frame's windows.
    """
    gram = lambda c: F.explode(shingles(words(c), n)).alias("gram")
    w = windows.select("page", (F.col("starts") - near).alias("a"), (F.col("ends") + near).alias("b")).filter("a <= b").distinct()
    minutes = F.explode(F.sequence(F.floor(F.col("a") / 60).cast("long"), F.floor(F.col("b") / 60).cast("long"))).alias("minute")
    said = cues.select("at", F.floor(F.col("at") / 60).cast("long").alias("minute"), gram(F.col("text"))).distinct()
    ever = lines.select("page", "line", gram(F.col("text"))).join(said.select("gram").distinct(), "gram", "left_semi")
    shown = ever.join(w.select("*", minutes), "page")
    s, c = shown.alias("s"), said.alias("c")
    hit = s.join(c, (F.col("s.gram") == F.col("c.gram")) & (F.col("s.minute") == F.col("c.minute")) & F.col("c.at").between(F.col("s.a"), F.col("s.b")), "left_semi")
    return lines.join(hit.select("page", "line").distinct(), ["page", "line"], "left_semi")


def match_gold(gold: DataFrame, events: DataFrame, texts: DataFrame, *, rank: dict[str, int], least: float = 0.5, reach: int = 400) -> DataFrame:
    """gold, node: the node of the event (evidence, quote, node, kind) that hits a gold item (gold, evidence, quote) best; null without any.

    An event hits by ``least`` containment of five-word runs, or by standing ``reach`` characters from the gold quote in the evidence's plain
    text (evidence, text). The best holds by its words before its place, then has the greater containment (3 places), the higher
    ``rank`` of its kind (others 1), the smaller distance and the smaller node. Items and events meet by a run of words or a stretch of text.
    """
    runs = lambda c: shingles(F.filter(F.split(plain(c), " "), lambda x: x != ""), 5)
    t = texts.select("evidence", "text")

    def side(df, *own):
        placed = df.select(*own, "evidence", "quote").distinct().join(t, "evidence", "left")
        return placed.select(*own, "evidence", runs(F.col("quote")).alias("runs"), quote_offset(F.col("text"), F.col("quote")).alias("off"))

    def keyed(df, spread):
        cell = F.floor(F.col("off") / reach).cast("long")
        stretch = F.when(F.col("off").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(cell - spread, cell + spread), lambda k: F.concat(F.lit("#"), k.cast("string"))))
        return df.select("*", F.explode(F.concat("runs", stretch)).alias("key"))

    g = keyed(side(gold, "gold"), 1).withColumnsRenamed({"runs": "g_runs", "off": "g_off"})
    e = keyed(side(events, "node", "kind"), 0)
    met = g.join(e, ["evidence", "key"]).drop("key").distinct()
    held = met.select("gold", "node", "kind", F.round(containment(F.col("g_runs"), F.col("runs")), 3).alias("c"), containment(F.col("g_runs"), F.col("runs")).alias("whole"), F.abs(F.col("g_off") - F.col("off")).alias("d"))
    hits = held.filter((F.col("whole") >= least) | (F.col("d") <= reach))
    level = F.lit(1)
    for kind, r in rank.items():
        level = F.when(F.col("kind") == kind, r).otherwise(level)
    order = F.struct((F.col("whole") < least).alias("by_place"), (-F.col("c")).alias("c"), (-level).alias("level"), F.coalesce("d", F.lit(2**31 - 1)).alias("d"), F.col("node"))
    best = hits.groupBy("gold").agg(F.min(order).alias("b"))
    return gold.select("gold").distinct().join(best, "gold", "left").select("gold", "b.node")


def cue_sentences(items: DataFrame, pattern: str, *, least: int = 6) -> DataFrame:
    """evidence, pos, sentence, starts, ends of the sentences of items (evidence, text) with ``least`` words that ``pattern`` matches in plain form; the span is in the item's plain text."""
    parts = F.transform(F.split("text", r"(?<=[.?!])\s+"), lambda x, i: F.struct(i.alias("pos"), F.trim(x).alias("sentence"), plain(x).alias("q")))
    cues = F.filter(parts, lambda s: (n_words(s["q"]) >= least) & s["q"].rlike(pattern))
    place = lambda whole: F.transform(cues, lambda s: F.struct(s["pos"].alias("pos"), s["sentence"].alias("sentence"), (F.instr(whole, s["q"]) - 1).alias("starts"), F.length(s["q"]).alias("n")))
    # the plain text is bound to a variable: beside exploded sentences it would be made again for each of them
    said = items.select("evidence", F.explode(F.flatten(F.transform(F.array(plain(F.col("text"))), place))).alias("s")).filter("s.starts >= 0")
    return said.select("evidence", "s.pos", "s.sentence", "s.starts", (F.col("s.starts") + F.col("s.n")).alias("ends"))


def uncovered(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Sentences (evidence, pos, starts, ends) that overlap no span (evidence, a, b) of their evidence.

    One pass in order of place: a sentence is covered if a span that begins before its end reaches beyond its start.
    """
    s = sentences.select("evidence", F.struct(*sentences.columns).alias("row"), F.col("ends").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"))
    p = spans.select("evidence", F.lit(None).cast(s.schema["row"].dataType).alias("row"), F.col("a").alias("at"), F.lit(1).alias("kind"), F.col("b").cast("long").alias("b"))
    w = Window.partitionBy("evidence").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = s.unionByName(p).withColumn("far", F.max("b").over(w)).filter("kind = 0")
    return swept.filter(F.coalesce(F.col("far") <= F.col("row.starts"), F.lit(True))).select("row.*")


def evidence_order(items: DataFrame) -> DataFrame:
    """evidence, pos: items (evidence, at, client, duplicate_of) without copies by time, client calls after others of that time, then id; pos from 0 within a day."""
    day = F.to_date("at")
    w = Window.partitionBy(day).orderBy("at", F.coalesce("client", F.lit(False)), "evidence")
    return items.filter("duplicate_of is null").select("evidence", day.alias("day"), (F.row_number().over(w) - 1).alias("pos"))


def _smallest(df: DataFrame, key: str) -> DataFrame:
    """A row for each ``key``: the smallest of several by their other columns."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("t")).select(key, "t.*")


def merged_key(judged: DataFrame, recheck: DataFrame, answers: DataFrame, *, work: tuple[str, ...], default_title: str) -> DataFrame:
    """The judges' key (cid, commitment, kind, title, owner) after a recheck (cid, verdict) that finds no work, then after the user's answers (cid, kind, title, owner), with source.

    ``not_work`` clears kind, title and owner. An answer whose kind is neither in ``work`` nor not_work is left out, as one for an unknown cid.
    Ids are unique on each side; of repeated ones the smallest row by its other columns counts.
    """
    r = recheck.filter("verdict = 'not_work'").select("cid", F.lit(True).alias("no")).distinct()
    u = _smallest(answers.filter(F.col("kind").isin(*work, "not_work")), "cid").select("cid", F.col("kind").alias("uk"), F.nullif("title", F.lit("")).alias("ut"), F.nullif("owner", F.lit("")).alias("uo"))
    j = _smallest(judged, "cid").join(r, "cid", "left").join(u, "cid", "left")
    no = F.coalesce("no", F.lit(False))
    was = {c: F.when(~no, F.col(c)) for c in ("kind", "title", "owner")}
    works = F.col("uk").isNotNull() & (F.col("uk") != "not_work")
    gone = F.col("uk") == "not_work"
    pick = lambda yes, keep: F.when(works, yes).when(gone, None).otherwise(keep)
    return j.select(
        "cid", F.coalesce("uk", F.when(no, "not_work").otherwise(F.col("commitment"))).alias("commitment"),
        pick(F.coalesce(was["kind"], F.lit("task")), was["kind"]).alias("kind"),
        pick(F.coalesce("ut", was["title"], F.lit(default_title)), was["title"]).alias("title"),
        pick(F.coalesce("uo", was["owner"]), was["owner"]).alias("owner"),
        F.when(F.col("uk").isNotNull(), "user").otherwise("judge").alias("source"),
    )


def gold_states(pool: DataFrame, judged: DataFrame) -> DataFrame:
    """cid, state of pool items (cid, verifiable) by their judgements (cid, commitment, duplicate_of): ``judged twice`` and, for verifiable ones, ``unjudged`` are faults; else ``not_work``, ``duplicate`` or ``gold``; judgements outside the pool are ``foreign``."""
    j = judged.groupBy("cid").agg(F.count("*").alias("n"), F.max("commitment").alias("commitment"), F.max("duplicate_of").alias("duplicate_of"))
    both = pool.select("cid", "verifiable", F.lit(True).alias("pooled")).distinct().join(j, "cid", "full")
    state = (
        F.when(F.col("pooled").isNull(), "foreign").when(F.col("n") > 1, "judged twice").when(F.col("n").isNull() & F.col("verifiable"), "unjudged")
        .when(F.col("n").isNull(), "left out").when(F.col("commitment") == "not_work", "not_work").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("gold")
    )
    return both.select("cid", state.alias("state"))


def deliverables(stories: DataFrame, tasks: DataFrame, criteria: DataFrame, files: DataFrame) -> DataFrame:
    """A row per open story (id, state, due, last_seen): first_draft_due (least due of its tasks (story, due, state) still open), ac_met and ac_total of its criteria (story, met), landed (title of its newest file (story, at, title)) and rag.

    rag: done is Green; blocked, or due before it was last seen, Red; in_progress Amber; else Green. Merged and deleted stories are left out.
    """
    closed = F.coalesce(F.col("state").isin("done", "merged", "deleted", "dropped"), F.lit(False))
    t = tasks.filter(~closed).groupBy("story").agg(F.min("due").alias("first_draft_due"))
    c = criteria.groupBy("story").agg(F.count_if("met").alias("ac_met"), F.count("*").alias("ac_total"))
    f = files.groupBy("story").agg(F.max(F.struct("at", "title")).alias("f"))
    state = F.coalesce("state", F.lit("open"))
    late = F.coalesce(F.col("due") < F.col("last_seen"), F.lit(False))
    rag = F.when(state == "done", "Green").when((state == "blocked") | late, "Red").when(state == "in_progress", "Amber").otherwise("Green")
    own = stories.filter(~state.isin("merged", "deleted")).select(F.col("id").alias("story"), state.alias("state"), "due", rag.alias("rag"))
    out = own.join(t, "story", "left").join(c, "story", "left").join(f, "story", "left")
    return out.select("story", "state", "due", "rag", "first_draft_due", F.coalesce("ac_met", F.lit(0)).cast("long").alias("ac_met"), F.coalesce("ac_total", F.lit(0)).cast("long").alias("ac_total"), F.col("f.title").alias("landed"))
