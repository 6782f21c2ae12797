"""Messages to tasks, titles to titles, and claims of one version of a document to those of the next."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions import text as tx
from quern.operators import wordsets
from quern.sources.scratch import dealt, settled

# Kinds of citations, as a tag with a body in which a backslash takes the next character along
CITED = "RAG MART GRAPH FILE TASK".split()
TAG = r"\[(" + "|".join(CITED) + r"):((?:[^\\\]]|\\.)+)\]"
ID_MARK = r"<!--\s*c:([0-9a-z]+)[^>]*-->\s*$"


def task_candidates(messages: DataFrame, tasks: DataFrame, k: int = 8) -> DataFrame:
    """msg_id, task_id, score, rank: the k best tasks (task_id, text, created) of each message (msg_id, text, day) by BM25 over the tasks, created by the message's day; a task named in the message comes first.

    score: sum over distinct words of the message of idf * f * 2.4 / (f + 1.4 * (0.25 + 0.75 * length / mean)), 3 places, with idf = ln(1 + (N - df + .5) / (df + .5)).
    """
    t = tasks.select("task_id", "created", tx.words(F.col("text")).alias("ts"))
    stats = F.broadcast(t.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avg")))  # one row
    asked = messages.select("msg_id", "day", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("w"))
    each = t.select("task_id", "created", F.size("ts").alias("len"), F.explode("ts").alias("w")).join(asked.select("w").distinct(), "w", "left_semi")
    hit = settled(each.groupBy("task_id", "w").agg(F.count("*").alias("f"), F.first("len").alias("len"), F.first("created").alias("created")), "hits")
    idf = hit.groupBy("w").agg(F.count("*").alias("df")).join(stats, F.lit(True)).select("w", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avg")
    weighed = settled(idf.join(asked.groupBy("w").agg(F.collect_list(F.struct("msg_id", "day")).alias("asking")), "w"), "weights")
    term = F.col("idf") * F.col("f") * 2.4 / (F.col("f") + 1.4 * (0.25 + 0.75 * F.col("len") / F.col("avg")))
    met = dealt(hit, weighed.agg(F.sum(F.col("df") * F.size("asking"))).first()[0], "task_id", each=2_000_000).join(F.broadcast(weighed), "w")  # a row for each word of the messages
    of = met.select("task_id", "created", term.alias("term"), F.explode("asking").alias("m")).filter(F.col("created").isNull() | (F.col("created") <= F.col("m.day")))
    scored = of.groupBy(F.col("m.msg_id").alias("msg_id"), "task_id").agg(F.round(F.sum("term"), 3).alias("score"))
    named = F.broadcast(asked.select("msg_id", F.col("w").alias("task_id"), F.lit(1).alias("named")))
    both = scored.join(named, ["msg_id", "task_id"], "left").filter("score > 0")
    w = Window.partitionBy("msg_id").orderBy(F.coalesce("named", F.lit(0)).desc(), F.col("score").desc(), "task_id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("msg_id", "task_id", "score", "rank")


def similar_nodes(nodes: DataFrame, *, k: int = 3, least: float = 0.5) -> DataFrame:
    """node, other, score, rank: the k nodes (node, kind, title, parent_title) of the same kind most alike in title words; with 0.3 or more, a quarter of the parents' likeness is added, up to 1. Only nodes that share a word are compared."""
    n = nodes.select("node", "kind", F.array_distinct(F.filter(tx.words(F.col("title")), lambda w: F.length(w) > 1)).alias("t"), F.array_distinct(tx.words(F.coalesce("parent_title", F.lit("")))).alias("p"), F.col("parent_title").isNotNull().alias("has"))
    # words must reach this likeness by themselves, so a pair shares one of the rarest words of each title, as many as can be missing and one more
    alone = min(least, max(0.3, least - 0.25)) - 1e-6
    flat = n.select("kind", "node", "t", F.explode("t").alias("w"))
    ranked = flat.join(flat.groupBy("kind", "w").agg(F.count("*").alias("df")), ["kind", "w"]).groupBy("kind", "node", "t").agg(F.array_sort(F.collect_set(F.struct("df", "w"))).alias("ws"))
    kept = F.size("ws") - F.greatest(F.ceil(F.size("ws") * F.lit(alone) - 1e-9), F.lit(1)) + 1
    flat = settled(ranked.select("kind", "node", F.explode(F.slice("ws", F.lit(1), kept.cast("int"))).alias("x")).select("kind", "node", "x.w"), "rare")
    pairs = flat.join(flat.withColumnRenamed("node", "other"), ["kind", "w"]).filter("node <> other").select("node", "other").distinct()
    side = lambda s, i: n.select(F.col("node").alias(i), F.col("t").alias(f"t{s}"), F.col("p").alias(f"p{s}"), F.col("has").alias(f"h{s}"))
    j = pairs.join(side(1, "node"), "node").join(side(2, "other"), "other")
    own = tx.jaccard(F.col("t1"), F.col("t2"))
    score = F.least(F.lit(1.0), own + F.when((own >= 0.3) & F.col("h1") & F.col("h2"), 0.25 * tx.jaccard(F.col("p1"), F.col("p2"))).otherwise(0.0))
    best = j.select("node", "other", F.round(score, 6).alias("score")).filter(F.col("score") >= least)
    w = Window.partitionBy("node").orderBy(F.col("score").desc(), "other")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def claims(sections: DataFrame) -> DataFrame:
    """task, section, pos, raw, tags, claim_id, normalized of sections (task, section, body): a claim per bullet and per paragraph of other lines; fenced code is none.

    ``normalized`` has no tags, marks, escapes or typographic forms, single spaces, lower case. A claim without an id mark has a null id.
    """
    plain = F.regexp_replace("body", r"(?s)```.*?(```|\z)", "\n\n")
    block = sections.select("task", "section", F.posexplode(F.split(plain, r"\n[ \t]*\n+")).alias("b", "block")).filter(F.trim("block") != "")
    rows = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bullets = F.forall(F.col("rows"), lambda x: x.startswith("- "))
    b = block.withColumn("rows", rows).withColumn("items", F.when(bullets, F.col("rows")).otherwise(F.array(F.array_join("rows", " "))))
    c = b.select("task", "section", "b", F.posexplode("items").alias("k", "raw"))
    body = F.regexp_replace(F.regexp_replace("raw", ID_MARK, ""), r"^\s*- ", "")
    folded = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, TAG, ""), r"\\([!-/:-@\[-`{-~])", "$1"), r"-{2,3}", "-"), "‘’“”–—\u00a0", "''\"\"-- ")
    w = Window.partitionBy("task", "section").orderBy("b", "k")
    return c.select(
        "task", "section", (F.row_number().over(w) - 1).alias("pos"), "raw", F.regexp_extract_all(F.col("raw"), F.lit(TAG), 0).alias("tags"), F.nullif(F.regexp_extract("raw", ID_MARK, 1), F.lit("")).alias("claim_id"),
        F.lower(F.trim(F.regexp_replace(folded, r"\s+", " "))).alias("normalized"),
    )


def _closest(norm: str, keys: list[str], free: dict[str, tuple[str, list[str]]], counts: dict[str, Counter], least: float) -> str | None:
    """Of ``keys`` (sorted), that of the most alike free claim, the first on a tie; difflib's own upper bounds on the ratio come first, from lengths and from letters counted once."""
    best, found = least, None
    m, letters = difflib.SequenceMatcher(None), Counter(norm)
    m.set_seq1(norm)
    for k in keys:
        if k not in free:
            continue
        text = free[k][0]
        both = len(norm) + len(text)
        if both and 2.0 * min(len(norm), len(text)) / both < best:
            continue
        if k not in counts:
            counts[k] = Counter(text)
        if both and 2.0 * (letters & counts[k]).total() / both < best:
            continue
        m.set_seq2(text)
        r = m.ratio()
        if r > best or (found is None and r >= best):
            best, found = r, k
    return found


def _matched(base: list[tuple], draft: list[tuple], least: float) -> list[tuple]:
    """(pos, base_id, category) of one section's claims (pos, claim_id, normalized, tags), both in order of pos."""
    free = {(f"~{p:06d}" if c is None else c): (n, t) for p, c, n, t in base}
    keys = sorted(free)
    equal: dict[str, list[str]] = {}
    for k in reversed(keys):
        equal.setdefault(free[k][0], []).append(k)  # the smallest key last
    out, counts = [], {}
    for pos, cid, norm, tags in draft:
        key = cid if cid in free else None
        if key is None:
            same = equal.get(norm, [])
            while same and same[-1] not in free:
                same.pop()
            key = same[-1] if same else _closest(norm, keys, free, counts, least) if free else None
        if key is None:
            out.append((pos, None, "added"))
            continue
        was, cited = free.pop(key)
        out.append((pos, None if key[0] == "~" else key, "reworded" if was != norm else "kept" if cited == tags else "recited"))
    return out + [(None, None if k[0] == "~" else k, "dropped") for k in keys if k in free]


def _matcher(least: float, schema: pa.Schema):
    """Rows in order of section, side (base first) and pos in, matches out; the rows of the last section in a batch wait for those of the next batch."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides, out = None, ([], []), []

        def closed() -> None:
            if at is not None:
                out.extend((*at, *row) for row in _matched(*sides, least))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for task, section, side, *claim in zip(*(batch.column(c).to_pylist() for c in ("task", "section", "side", "pos", "claim_id", "normalized", "tags")), strict=True):
                if at != (task, section):
                    closed()
                    at, sides = (task, section), ([], [])
                sides[side].append(tuple(claim))
            if out:
                yield made()
                out.clear()
        closed()
        if out:
            yield made()

    return match


def match_claims(base: DataFrame, draft: DataFrame, least: float = 0.9) -> DataFrame:
    """task, section, pos, base_id, category of each claim of the draft, and a row for each dropped one of the base.

    Own id first, else the most alike free claim of the base by difflib ratio of ``least`` or more, in the draft's order, each base claim once:
    the order makes it a loop over one section at a time. Both sides are dealt out by section once and streamed in order, many sections a task.
    """
    tags = F.when(F.size("tags") > 0, F.sort_array("tags"))
    side = lambda df, n: df.select("task", "section", F.lit(n).alias("side"), F.col("pos").cast("long").alias("pos"), "claim_id", "normalized", tags.alias("tags"))
    rows = side(base, 0).unionByName(side(draft, 1)).repartition("task", "section").sortWithinPartitions("task", "section", "side", "pos")
    key = [(f.name, f.dataType) for f in rows.select("task", "section").schema]
    out = StructType([StructField(n, t) for n, t in [*key, ("pos", LongType()), ("base_id", StringType()), ("category", StringType())]])
    return rows.mapInArrow(_matcher(least, to_arrow_schema(out)), out)


def redundant_pairs(frames: DataFrame, *, least: float = 0.75, min_tokens: int = 15) -> DataFrame:
    """a, b, n_a, n_b, score (3 places): pairs of frames (id, body) whose sets of words of three characters or more have a Jaccard of ``least``, of ``min_tokens`` words at least.

    Frames of one set are a class, named by its smallest id with n_a or n_b frames; pairs are between classes. Sets go as numbers of words, and only
    those of which enough of the rarest words are shared meet (``wordsets``); a frame with a null body has no words.
    """
    found = wordsets.alike(wordsets.word_sets(frames, min_tokens), least)
    return found.select("a", "b", "n_a", "n_b", F.round("s", 3).alias("score"))


def cluster_anchors(members: DataFrame, tags: DataFrame) -> DataFrame:
    """group, member, n_tags, anchor, overlap of groups of labels (group, member, pos): the anchor is the member that tags (chunk_id, category_id) most chunks, the earliest of equals; overlap counts the chunks that a member shares with it, null for the anchor."""
    m = members.select("group", "member", "pos").distinct()
    t = tags.select("chunk_id", F.col("category_id").alias("member")).distinct()
    counted = m.join(t.groupBy("member").agg(F.count("*").alias("n_tags")), "member", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))
    best = counted.groupBy("group").agg(F.max_by("member", F.struct(F.col("n_tags"), -F.col("pos"))).alias("anchor"))
    j = counted.join(best, "group")
    held = t.withColumnRenamed("member", "anchor")
    shared = j.filter("member <> anchor").select("group", "member", "anchor").join(t, "member").join(held, ["anchor", "chunk_id"]).groupBy("group", "member").agg(F.count("*").alias("both"))
    out = j.join(shared, ["group", "member"], "left")
    return out.select("group", "member", "n_tags", "anchor", F.when(F.col("member") != F.col("anchor"), F.coalesce("both", F.lit(0))).alias("overlap"))


def modality_flags(claims: DataFrame, quotes: DataFrame, *, hedges: list[str], keeps: list[str]) -> DataFrame:
    """claim, tag, marker: quotes (claim, tag, quote) that are hedged, by a closing question mark or the longest of ``hedges`` in whole words, of claims (claim, text) that neither ask nor hold one of ``keeps``."""
    whole = lambda c, word: F.lower(c).rlike(rf"(?<!\w){re.escape(word)}(?!\w)")
    text = F.trim(F.coalesce("text", F.lit("")))
    open_ = text.endswith("?")
    for w in keeps:
        open_ = open_ | whole(text, w)
    quote = F.trim(F.coalesce("quote", F.lit("")))
    marker = F.when(quote.endswith("?"), "?")
    for w in sorted(hedges, key=lambda x: (-len(x), x)):
        marker = marker.when(whole(quote, w), w)
    return claims.filter(~open_).select("claim").join(quotes, "claim").select("claim", "tag", marker.alias("marker")).filter("marker is not null")
