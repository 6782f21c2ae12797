"""Evidence and quotes, meetings, admission and verdicts, evals and their scores.

Unless a function says otherwise: nulls take no part; equal rows count once each; empty tables give empty results;
columns that are not named are ignored.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORDS = r"[^\s]+"


def plain(c: Column) -> Column:
    """Lower case, with every run of characters that are neither letters nor digits as one space; null: empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORDS)), F.lit(0))


def quote_offset(text: Column, quote: Column) -> Column:
    """Where a quote begins in a text, both in plain form (:func:`plain`), from 0; null if it does not stand there or is empty."""
    q = plain(quote)
    return F.when(q != "", F.nullif(F.instr(plain(text), q), F.lit(0)) - 1)


def snapped(quote: str | None, source: str | None, least: int = 4) -> str | None:
    """The longest run of words of ``quote`` that stands in ``source`` as one, in the source's spelling; the first if several; None under ``least`` words."""
    a, b = (quote or "").split(), (source or "").split()
    low_a, low_b = [w.lower() for w in a], [w.lower() for w in b]
    best, end, run = 0, 0, [0] * (len(b) + 1)
    for w in low_a:
        now = [0] * (len(b) + 1)
        for j, v in enumerate(low_b, 1):
            if v == w:
                now[j] = run[j - 1] + 1
                if now[j] > best or now[j] == best and j < end:
                    best, end = now[j], j
        run = now
    return " ".join(b[end - best : end]) if best >= least else None


@F.pandas_udf(StringType())
def snap_quote(quote: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([snapped(q, s) for q, s in zip(quote, source, strict=True)], dtype=object)


def closest(text: str | None, quote: str | None, least: float = 0.6) -> str | None:
    """The window of a text nearest to a quote: of two words fewer to two more, by shared words (each as often as it stands); ties to the length nearest the quote's, then the earliest; None under ``least`` of the quote's words."""
    t, q = (text or "").split(), [w.lower() for w in (quote or "").split()]
    want, low = Counter(q), [w.lower() for w in t]
    best: tuple | None = None
    for size in range(max(1, len(q) - 2), min(len(t), len(q) + 2) + 1) if q else ():
        have = Counter(low[:size])
        shared = sum((have & want).values())
        for at in range(len(t) - size + 1):
            if at:
                gone, new = low[at - 1], low[at + size - 1]
                shared -= have[gone] <= want[gone]
                have[gone] -= 1
                shared += have[new] < want[new]
                have[new] += 1
            key = (-shared, abs(size - len(q)), at)
            if best is None or key < best[0]:
                best = key, size
    if best is None or -best[0][0] < least * len(q):
        return None
    return " ".join(t[best[0][2] : best[0][2] + best[1]])


@F.pandas_udf(StringType())
def closest_span(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([closest(t, q) for t, q in zip(text, quote, strict=True)], dtype=object)


def admit(events: DataFrame, evidence: DataFrame, *, least: int = 3, criteria: int = 6) -> DataFrame:
    """mid, verdict of events (mid, evidence, quote, n_criteria) against evidence (id, text), the first that holds:

    ``no evidence``; ``short`` (quote under ``least`` words); ``not verbatim`` (not in the text, in plain form); ``criteria`` (more than that many); ``admitted``.
    A text is joined with its own events only.
    """
    e = evidence.select(F.col("id").alias("evidence"), F.col("text").alias("__text"), F.lit(True).alias("has"))
    j = events.join(e, "evidence", "left")
    q = plain(F.col("quote"))
    verdict = (
        F.when(F.col("has").isNull(), "no evidence").when(n_words(q) < least, "short").when(~F.concat(F.lit(" "), plain(F.col("__text")), F.lit(" ")).contains(F.concat(F.lit(" "), q, F.lit(" "))), "not verbatim")
        .when(F.coalesce(F.col("n_criteria"), F.lit(0)) > criteria, "criteria").otherwise("admitted")
    )
    return j.select("mid", verdict.alias("verdict"))


def verification_queue(events: DataFrame, verdicts: DataFrame, turns: DataFrame, *, around: int = 2) -> DataFrame:
    """mid, context: events (mid, conv, pos) without a verdict (mid, verdict) or with a weak one, with the turns (conv, pos, text) from ``around`` before to as many after, joined by newlines."""
    done = verdicts.filter(F.col("verdict").isNotNull() & (F.col("verdict") != "weak")).select("mid").distinct()
    w = Window.partitionBy("conv").orderBy("pos").rowsBetween(-around, around)
    near = turns.select("conv", "pos", F.array_join(F.collect_list("text").over(w), "\n").alias("context"))
    return events.join(done, "mid", "left_anti").join(near, ["conv", "pos"]).select("mid", "context")


def verdict_counts(verdicts: DataFrame, events: DataFrame, kinds: list[str]) -> DataFrame:
    """verdict, n: the latest verdict (mid, verdict, seq) of each known event (mid), of ``kinds`` only; ties of seq by name."""
    own = verdicts.filter(F.col("verdict").isin(*kinds)).join(events.select("mid").distinct(), "mid", "left_semi")
    return own.groupBy("mid").agg(F.max(F.struct("seq", "verdict")).alias("v")).groupBy(F.col("v.verdict").alias("verdict")).agg(F.count("*").alias("n"))


def room_audio(turns: DataFrame, *, share: float = 0.8, least: int = 1500) -> DataFrame:
    """conv, speaker, share, n_words, room of turns (conv, speaker, text): the speaker of most words (ties: first by name) and their share to 3 places; ``room`` if it is ``share`` or more of ``least`` words or more."""
    per = turns.groupBy("conv", "speaker").agg(F.sum(n_words(F.col("text"))).alias("n"))
    g = per.groupBy("conv").agg(F.sum("n").alias("n_words"), F.min(F.struct((-F.col("n")).alias("m"), F.col("speaker"))).alias("t"))
    part = F.when(F.col("n_words") > 0, -F.col("t.m") / F.col("n_words")).otherwise(0.0)
    return g.select("conv", "t.speaker", F.round(part, 3).alias("share"), "n_words", ((part >= share) & (F.col("n_words") >= least)).alias("room"))


def transcript_faults(turns: DataFrame, lengths: DataFrame, named: DataFrame) -> DataFrame:
    """conv, unnamed, truncated of turns (conv, at, speaker): the share of turns whose speaker is not in ``named`` (speaker), to 3 places, and whether the last begins before 80 % of the length (conv, seconds)."""
    known = named.select("speaker").distinct().withColumn("known", F.lit(True))
    g = turns.join(known, "speaker", "left").groupBy("conv").agg(F.avg(F.when(F.col("known").isNull(), 1.0).otherwise(0.0)).alias("u"), F.max("at").alias("last"))
    return g.join(lengths, "conv", "left").select("conv", F.round("u", 3).alias("unnamed"), F.coalesce(F.col("last") < 0.8 * F.col("seconds"), F.lit(False)).alias("truncated"))


def unknown_speakers(turns: DataFrame, people: DataFrame, clients: DataFrame) -> DataFrame:
    """speaker, n_turns, n_meetings, n_client, side: speakers of turns (conv, speaker) who are not people (speaker); side ``client`` if more than half of their meetings are client ones (conv), else ``internal``."""
    c = clients.select("conv").distinct().withColumn("client", F.lit(True))
    j = turns.join(people.select("speaker").distinct(), "speaker", "left_anti").join(c, "conv", "left")
    g = j.groupBy("speaker").agg(F.count("*").alias("n_turns"), F.count_distinct("conv").alias("n_meetings"), F.count_distinct(F.when(F.col("client"), F.col("conv"))).alias("n_client"))
    return g.withColumn("side", F.when(2 * F.col("n_client") > F.col("n_meetings"), "client").otherwise("internal"))


def recall_by_part(gold: DataFrame) -> DataFrame:
    """part, n, n_found, recall of gold items (offset, length, found): thirds of the text by offset / length, ``unknown`` without them; recall to 3 places."""
    at = F.col("offset") / F.nullif(F.col("length"), F.lit(0))
    part = F.when(at.isNull(), "unknown").when(at < 1 / 3, "first").when(at < 2 / 3, "middle").otherwise("last")
    g = gold.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("found"), F.lit(False)).cast("int")).alias("n_found"))
    return g.withColumn("recall", F.round(F.col("n_found") / F.col("n"), 3))


def part_coverage(items: DataFrame, events: DataFrame, *, small: int = 6000, large: int = 60_000, thin: int = 2) -> DataFrame:
    """item, part, n, state of items (item, length) and events (item, offset): a text is one part up to ``small`` characters, else one for each begun ``large`` / 10; a part without an event is empty, under ``thin`` thin, else ok."""
    parts = F.when(F.col("length") <= small, 1).otherwise(F.ceil(F.col("length") / (large // 10))).cast("int")
    p = items.filter("length > 0").withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = events.join(items.filter("length > 0").withColumn("parts", parts), "item").select("item", F.least(F.col("parts") - 1, F.floor(F.col("offset") * F.col("parts") / F.col("length"))).cast("int").alias("part"))
    n = own.groupBy("item", "part").agg(F.count("*").alias("n"))
    j = p.join(n, ["item", "part"], "left").select("item", "part", F.coalesce("n", F.lit(0)).alias("n"))
    return j.withColumn("state", F.when(F.col("n") == 0, "empty").when(F.col("n") < thin, "thin").otherwise("ok"))


def back_channels(turns: DataFrame, *, most: int = 3) -> DataFrame:
    """conv, pos, part: turns (conv, pos, speaker, text) with the number of the stitched part they belong to; a turn of ``most`` words or fewer between two turns of another one speaker is a back-channel (part null), and those two are one part; so are neighbours of one speaker."""
    w = Window.partitionBy("conv").orderBy("pos")
    prev, nxt = F.lag("speaker").over(w), F.lead("speaker").over(w)
    back = (prev == nxt) & (F.col("speaker") != prev) & (n_words(F.col("text")) <= most)
    t = turns.select("conv", "pos", "speaker", F.coalesce(back, F.lit(False)).alias("back"))
    before = F.last(F.when(~F.col("back"), F.col("speaker")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("back"), 0).when(before.isNull() | (before != F.col("speaker")), 1).otherwise(0)
    return t.withColumn("new", new).select("conv", "pos", F.when(~F.col("back"), F.sum("new").over(w)).alias("part"))


def thread_context(messages: DataFrame, *, preceding: int = 3) -> DataFrame:
    """id, context: a reply's parent and its last earlier siblings, joined by newlines, of messages (id, parent, at, text); a message without a parent has none. Ties of ``at`` by id."""
    w = Window.partitionBy("parent").orderBy("at", "id").rowsBetween(-preceding, -1)
    r = messages.filter("parent is not null").select("id", "parent", F.collect_list("text").over(w).alias("before"))
    top = messages.select(F.col("id").alias("parent"), F.col("text").alias("head"))
    return r.join(top, "parent", "left").select("id", F.array_join(F.concat(F.array_compact(F.array("head")), "before"), "\n").alias("context"))


def snapshot_changes(rows: DataFrame) -> DataFrame:
    """snap, id, state of snapshots (snap 0, 1, ..., id, content): a row where it is new or differs from the snapshot before, and ``gone`` where it was in that one and is not in the next."""
    w = Window.partitionBy("id").orderBy("snap")
    last = rows.agg(F.max("snap").alias("last"))
    t = rows.select("snap", "id", "content", F.lag("snap").over(w).alias("was"), F.lag("content").over(w).alias("old"), F.lead("snap").over(w).alias("next"))
    state = F.when(F.col("was").isNull() | (F.col("was") < F.col("snap") - 1), "new").when(~F.col("content").eqNullSafe(F.col("old")), "changed")
    gone = t.join(F.broadcast(last), F.lit(True)).filter("(next is null or next > snap + 1) and snap < last").select((F.col("snap") + 1).alias("snap"), "id", F.lit("gone").alias("state"))  # one row is broadcast
    return t.select("snap", "id", state.alias("state")).filter("state is not null").unionByName(gone)


def tiles(rows: DataFrame) -> DataFrame:
    """key, tile, segment, first, last, n: neighbouring rows (key, pos, segment) of one segment as a tile, numbered from 1; a null segment is a segment."""
    w = Window.partitionBy("key").orderBy("pos")
    new = F.coalesce((~F.col("segment").eqNullSafe(F.lag("segment").over(w))) | (F.row_number().over(w) == 1), F.lit(True)).cast("int")
    t = rows.withColumn("new", new).withColumn("tile", F.sum("new").over(w))
    return t.groupBy("key", "tile").agg(F.first("segment").alias("segment"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def dealt(claims: DataFrame, size: int) -> DataFrame:
    """section, id, hand of claims (section, id, figure): claims of a section dealt in turn to ceil(n / size) hands, those with a figure first, then by id."""
    w = Window.partitionBy("section")
    hands = F.ceil(F.count("*").over(w) / size)
    place = F.row_number().over(w.orderBy(F.coalesce(F.col("figure"), F.lit(False)).desc(), "id")) - 1
    return claims.select("section", "id", F.pmod(place, hands.cast("int")).alias("hand"))


def estimated_minutes(n: Column, size: int, wave: int) -> Column:
    """Minutes of a check of ``n`` statements in chunks of ``size``, ``wave`` at a time: 5 and 6 a wave."""
    return (5 + 6 * F.ceil(F.ceil(n / size) / wave)).cast("long")


def graded(rows: DataFrame) -> DataFrame:
    """id, ok of rows (id, must, must_not, context): any part of ``must`` (split at ``|``) stands in the context, or, if ``must_not`` has parts, none of those does; letters' case aside. Neither: not ok."""
    has = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\|"), lambda x: F.trim(x) != "")
    context = F.lower(F.coalesce(F.col("context"), F.lit("")))
    met = lambda c: F.exists(has(c), lambda x: context.contains(F.trim(x)))
    return rows.select("id", F.when(F.size(has("must_not")) > 0, ~met("must_not")).otherwise(met("must")).alias("ok"))


def eval_totals(results: DataFrame, by: str) -> DataFrame:
    """by, n, n_passed, percent (to 1 place) of results (ok)."""
    g = results.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("ok"), F.lit(False)).cast("int")).alias("n_passed"))
    return g.withColumn("percent", F.round(100 * F.col("n_passed") / F.col("n"), 1))


def coverage_lens(keys: DataFrame, evals: DataFrame, *, least: int = 3) -> DataFrame:
    """n, n_covered, percent: keys (key) that begin with the key of an eval (key of ``least`` characters or more), the eval's being the prefix.

    A key meets evals by its own beginnings, one for each length that evals have, so only equal strings are joined; those lengths are one row. Null keys are left out.
    """
    e = evals.filter(F.length("key") >= least).select(F.col("key").alias("prefix")).distinct()
    lengths = e.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    k = keys.filter("key is not null").select("key").distinct()
    begins = k.join(F.broadcast(lengths), F.lit(True)).withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("key")).select("key", F.expr("substr(key, 1, n)").alias("prefix"))
    hit = begins.join(e, "prefix", "left_semi").select("key").distinct().withColumn("hit", F.lit(1))
    return k.join(hit, "key", "left").agg(F.count("*").alias("n"), F.count("hit").alias("n_covered")).withColumn("percent", F.round(100 * F.col("n_covered") / F.greatest(F.col("n"), F.lit(1)), 1))


def collapsed(gold: DataFrame) -> DataFrame:
    """evidence, covered_by, id, quotes, n: gold items (id, evidence, covered_by, quote) that agree in both as one, the first by id, its quotes in that order joined by `` / ``; items with neither stay alone."""
    alone = F.when(F.col("covered_by").isNull(), F.col("id"))
    g = gold.groupBy("evidence", "covered_by", alone.alias("alone")).agg(F.min("id").alias("id"), F.array_sort(F.collect_list(F.struct("id", "quote"))).alias("q"), F.count("*").alias("n"))
    return g.select("evidence", "covered_by", "id", F.array_join(F.transform("q", lambda x: x["quote"]), " / ").alias("quotes"), "n")


def slot_match(expected: DataFrame, events: DataFrame, *, minutes: int = 20) -> DataFrame:
    """slot, event, gap of expected slots (slot, key, at) and events (event, key, at): the nearest event of the same key within ``minutes`` on the same day, gap in seconds; ties to the earlier, then the smaller; null if none.

    A slot meets only events of its key in its own or a neighbouring stretch of that many minutes.
    """
    width = minutes * 60
    stretch = lambda c: F.floor(F.unix_micros(c) / (width * 1_000_000)).cast("long")
    expected, events = (df.withColumn("at", F.col("at").cast("timestamp")) for df in (expected, events))
    s = expected.select("slot", "key", F.col("at").alias("due"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: stretch(F.col("at")) + k)).alias("cell"))
    e = events.select("event", "key", "at", stretch(F.col("at")).alias("cell"))
    micros = F.abs(F.unix_micros("at") - F.unix_micros("due"))
    near = s.join(e, ["key", "cell"]).filter((micros <= width * 1_000_000) & (F.to_date("at") == F.to_date("due")))
    best = near.groupBy("slot").agg(F.min(F.struct(micros.alias("gap"), F.col("at"), F.col("event"))).alias("b"))
    return expected.select("slot").join(best, "slot", "left").select("slot", "b.event", F.floor(F.col("b.gap") / 1_000_000).alias("gap"))


def section_coverage(sections: DataFrame, claims: DataFrame, entries: DataFrame) -> DataFrame:
    """section, fault: sections (section) with neither a claim (section) nor a coverage entry (section): ``missing``; with both: ``both``; claims or entries of no section: ``unknown``."""
    mark = lambda df, c: df.select("section").distinct().withColumn(c, F.lit(True))
    j = mark(sections, "is").join(mark(claims, "claim"), "section", "full").join(mark(entries, "entry"), "section", "full")
    fault = F.when(F.col("is").isNull(), "unknown").when(F.col("claim").isNull() & F.col("entry").isNull(), "missing").when(F.col("claim") & F.col("entry"), "both")
    return j.select("section", fault.alias("fault")).filter("fault is not null")


def cited(findings: DataFrame) -> DataFrame:
    """id, kind, ref: the distinct references in a finding's trail (id, trail) of the form ``chunk 12`` or ``metric name``."""
    found = F.explode(F.regexp_extract_all(F.lower("trail"), F.lit(r"\b(chunk \d+|metric [a-z_]+)"), 1)).alias("r")
    r = findings.select("id", found).distinct()
    return r.select("id", F.substring_index("r", " ", 1).alias("kind"), F.substring_index("r", " ", -1).alias("ref"))


def open_requests(requests: DataFrame, answers: DataFrame, items: DataFrame) -> DataFrame:
    """item, request, known: the latest request (item, request) of each item without an answer (request); ``known`` if it is one of items (item)."""
    r = requests.groupBy("item").agg(F.max("request").alias("request")).join(answers.select("request").distinct(), "request", "left_anti")
    return r.join(items.select("item").distinct().withColumn("known", F.lit(True)), "item", "left").select("item", "request", F.coalesce("known", F.lit(False)).alias("known"))


def upstream_state(citations: DataFrame, claims: DataFrame) -> DataFrame:
    """claim, state of citations (claim, upstream, seen): ``gone`` if upstream is no claim (id, text, status), ``superseded`` by its status, ``changed`` if its text is not the one seen, else ``ok``."""
    c = claims.select(F.col("id").alias("upstream"), "text", F.coalesce("status", F.lit("ACTIVE")).alias("status"), F.lit(True).alias("has"))
    state = F.when(F.col("has").isNull(), "gone").when(F.col("status") == "SUPERSEDED", "superseded").when(~F.col("text").eqNullSafe(F.col("seen")), "changed").otherwise("ok")
    return citations.join(c, "upstream", "left").select("claim", "upstream", state.alias("state"))
