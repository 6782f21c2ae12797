"""Retrieval: postings, BM25, vector search, rank fusion, related pairs, paging."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.sources.scratch import dealt, settled


def tokenised(docs: DataFrame, id_col: str, text_col: str, least: int = 3) -> DataFrame:
    """id, ts, len: each document's tokens of ``least`` characters or more and their number; documents without any are left out.

    The number is counted in the text, so that who needs only it makes no tokens.
    """
    low = F.lower(F.col(text_col))
    runs = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: F.length(t) >= least)
    return docs.select(F.col(id_col).alias("id"), runs.alias("ts"), F.regexp_count(low, F.lit(f"[a-z0-9]{{{least},}}")).alias("len")).filter("len > 0")


def bm25(queries: DataFrame, tokens: DataFrame, *, k1: float = 1.2, b: float = 0.75, floor: float = 1e-6) -> DataFrame:
    """query_id, id, score (6 places) of every document (:func:`tokenised`) that shares a token with a query (query_id, text).

    idf is ln((N - df + .5) / (df + .5)), ``floor`` at least. Documents are counted whole, a row each; only the
    tokens of queries are counted one by one, and settled, since both document frequencies and scores read them.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text"), 3))).alias("token"))
    stats = tokens.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    each = tokens.select("id", "len", F.explode("ts").alias("token"))
    hits = settled(each.join(asked.select("token").distinct(), "token", "left_semi").groupBy("id", "token").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "hits")
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    one = F.broadcast(stats)  # a single row
    idf = F.greatest(F.lit(floor), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asking = asked.groupBy("token").agg(F.collect_list("query_id").alias("query_ids"))
    weighed = settled(df.crossJoin(one).join(asking, "token").select("token", "df", idf.alias("idf"), "avg_len", "query_ids"), "weights")
    term = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    met = dealt(hits, weighed.agg(F.sum(F.col("df") * F.size("query_ids"))).first()[0], "id", each=2_000_000).join(F.broadcast(weighed), "token")  # a row for each token of the queries
    scored = met.select("id", term.alias("term"), F.explode("query_ids").alias("query_id")).groupBy("query_id", "id").agg(F.sum("term").alias("s"))
    return scored.select("query_id", "id", F.round("s", 6).alias("score"))


def top_per(df: DataFrame, key: str, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """``df`` with rank: the k best rows of each key, ties by the smaller id; Spark cuts each partition to k rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """query_id, id, score, rank: reciprocal-rank fusion of ranked lists (query_id, id, rank) with weights; ties by id."""
    parts = [df.select("query_id", "id", (F.lit(w) / (constant + F.col("rank"))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_per(out.groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score")), "query_id", k)


def blockwise_pairs(left: DataFrame, right: DataFrame, min_score: float, *, block_rows: int = 4096, strip: int = 256, places: int = 4) -> DataFrame:
    """a, b, score of the pairs of (id, embedding) rows whose cosine, rounded, is ``min_score`` or more, a <> b.

    Exact: every block of one side meets every block of the other in a task of its own, as a matrix product of ``strip`` rows at a time, and only pairs above the threshold leave it.
    """
    n = [max(1, math.ceil(df.count() / block_rows)) for df in (left, right)]
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    x = left.select("id", "embedding", own(n[0]).alias("i"), spread(n[1]).alias("j"))
    y = right.select("id", "embedding", spread(n[0]).alias("i"), own(n[1]).alias("j"))

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        u, v = (np.stack(d["embedding"].to_numpy()).astype("float64") for d in (p, q))
        u, v = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (u, v))
        ids, others, found = p["id"].to_numpy(), q["id"].to_numpy(), []
        for k in range(0, len(u), strip):  # so few rows of the product at a time
            s = np.round(u[k : k + strip] @ v.T, places)
            a, b = np.nonzero((s >= min_score) & (ids[k : k + strip, None] != others))
            found.append((ids[a + k], others[b], s[a, b]))
        return pd.DataFrame(dict(zip(("a", "b", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInPandas(meet, "a long, b long, score double")


def related_pairs(vectors: DataFrame, *, k: int, min_score: float) -> DataFrame:
    """chunk_id, related_id, score: each vector's k best neighbours of another document (id, doc, embedding), each pair once as (smaller, larger) with its higher score."""
    pairs = blockwise_pairs(vectors, vectors, min_score)
    doc = vectors.select("id", "doc")
    other = pairs.join(doc.select(F.col("id").alias("a"), F.col("doc").alias("da")), "a").join(doc.select(F.col("id").alias("b"), F.col("doc").alias("db")), "b").filter("da <> db")
    best = top_per(other.withColumnRenamed("b", "id"), "a", k)
    return best.groupBy(F.least("a", "id").alias("chunk_id"), F.greatest("a", "id").alias("related_id")).agg(F.max("score").alias("score"))


def related_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, other, edge_type, score, rank: both directions of edges (chunk_id, related_id, edge_type, score) for ``ids`` (id); explicit edges come before SIMILAR, then by score."""
    both = edges.select(F.col("chunk_id").alias("id"), F.col("related_id").alias("other"), "edge_type", "score").unionByName(
        edges.select(F.col("related_id").alias("id"), F.col("chunk_id").alias("other"), "edge_type", "score")
    )
    w = Window.partitionBy("id").orderBy((F.col("edge_type") == "SIMILAR").cast("int"), F.col("score").desc(), "other")
    return both.join(ids.select("id").distinct(), "id", "left_semi").withColumn("rank", F.row_number().over(w))


def source_catalog(chunks: DataFrame, *, contains: str | None = None, offset: int = 0, page_size: int = 500) -> DataFrame:
    """source, n_chunks, n_chars of a page of sources by name; contains ignores case."""
    kept = chunks.filter(F.lower("source").contains(contains.lower())) if contains else chunks
    per = kept.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))
    return per.orderBy("source").offset(offset).limit(page_size)


def document_page(chunks: DataFrame, *, max_chars: int, from_ord: int = 0) -> DataFrame:
    """source, ord, cumulative, next_ord: of each source the chunks from ``from_ord`` whose sizes sum to ``max_chars`` at most, one at least; next_ord: where the next page begins."""
    w = Window.partitionBy("source").orderBy("ord")
    run = chunks.filter(F.col("ord") >= from_ord).withColumn("cumulative", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = (F.row_number().over(w) == 1) | (F.col("cumulative") <= max_chars)
    nxt = F.min(F.when(~F.col("kept"), F.col("ord"))).over(Window.partitionBy("source"))
    return run.withColumn("kept", kept).withColumn("next_ord", nxt).filter("kept").select("source", "ord", "cumulative", "next_ord")


def visible(chunks: DataFrame, *, as_of: str | None = None, latest_only: bool = True) -> DataFrame:
    """Chunks valid at ``as_of`` (from inclusive, to exclusive, whatever their status), or the active ones; a missing status is ACTIVE."""
    if as_of is not None:
        t = F.lit(as_of)
        return chunks.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return chunks.filter(F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE") if latest_only else chunks


def retrieval_scores(ranked: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """n_cases, hits, hit_rate, mrr of ranked sources (case_id, source, rank) against the expected ones (case_id, source)."""
    first = ranked.filter(F.col("rank") <= k).join(expected.distinct(), ["case_id", "source"], "left_semi").groupBy("case_id").agg(F.min("rank").alias("r"))
    return expected.select("case_id").distinct().join(first, "case_id", "left").agg(
        F.count("*").alias("n_cases"), F.count("r").alias("hits"), F.round(F.try_divide(F.count("r").cast("double"), F.count("*")), 6).alias("hit_rate"),
        F.round(F.try_divide(F.sum(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0))), F.count("*")), 6).alias("mrr"),
    )


def hybrid(
    lists: list[tuple[DataFrame, float]], chunks: DataFrame, *, pool: int = 30, k: int = 10, tags: DataFrame | None = None, only_tagged: bool = False, tag_boost: bool = False,
    source_contains: str | None = None, as_of: str | None = None, latest_only: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(hits, hints) of scored lists (query_id, id, score) over chunks (id, source, status, valid_from, valid_to).

    hits: query_id, id, rank, score (5 places): of each list the ``pool`` best chunks that are visible (:func:`visible`), whose source holds
    ``source_contains`` (letters' case aside) and, with ``only_tagged``, that have a tag (tags: id) are fused by reciprocal ranks; ``tag_boost`` adds 0.6 / 61 to
    tagged ones. Ties by id. hints: query_id, n_hidden: how many chunks of the lists are hidden by their lifecycle alone.
    """
    seen = visible(chunks, as_of=as_of, latest_only=latest_only).select("id", "source")
    if source_contains is not None:
        seen = seen.filter(F.contains(F.lower("source"), F.lit(source_contains.lower())))
    tagged = None if tags is None else tags.select("id").distinct().withColumn("tagged", F.lit(True))
    if only_tagged and tagged is not None:
        seen = seen.join(tagged, "id", "left_semi")
    parts, matched = [], None
    for scored, weight in lists:
        near = top_per(scored.join(seen.select("id"), "id", "left_semi"), "query_id", pool)
        parts.append(near.select("query_id", "id", (F.lit(weight) / (60 + F.col("rank"))).alias("s")))
        own = scored.select("query_id", "id")
        matched = own if matched is None else matched.unionByName(own)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    score = F.sum("s")
    fused = every.groupBy("query_id", "id").agg(score.alias("s"))
    if tag_boost and tagged is not None:
        fused = fused.join(tagged, "id", "left").withColumn("s", F.col("s") + F.when(F.col("tagged"), 0.6 / 61).otherwise(0.0))
    hits = top_per(fused.select("query_id", "id", F.round("s", 5).alias("score")), "query_id", k).select("query_id", "id", F.col("rank"), "score")
    hidden = chunks.select("id").join(visible(chunks, as_of=as_of, latest_only=latest_only).select("id"), "id", "left_anti")
    hid = matched.join(hidden, "id", "left_semi")  # before the rows of both lists are made distinct: few chunks are hidden
    return hits, hid.distinct().groupBy("query_id").agg(F.count("*").alias("n_hidden"))


def resolve_names(names: DataFrame, sources: DataFrame) -> DataFrame:
    """name, status, source, n_matches of asked names (name) against sources (source).

    ``exact``; else ``folded`` if one source is equal but for letters' case; else ``unique`` if the name stands in one source alone; ``ambiguous`` if in
    several; ``not_found``. source is null for the last two. Parts are found over the first three characters of a name, so no name meets every source.
    """
    s = sources.filter("source is not null").select("source").distinct().withColumn("low", F.lower("source"))
    n = names.filter("name is not null and name <> ''").select("name").distinct().withColumn("asked", F.lower("name"))
    ends = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - size + 1, F.lit(1))), lambda k: F.substr("low", k, F.lit(size)))
    grams = s.select("source", "low", F.explode(F.array_distinct(F.concat(ends(1), ends(2), ends(3)))).alias("gram"))
    j = n.withColumn("gram", F.left("asked", F.lit(3))).join(grams, "gram").filter(F.contains("low", F.col("asked")))
    g = j.groupBy("name").agg(
        F.max(F.when(F.col("source") == F.col("name"), F.col("source"))).alias("exact"), F.count_if(F.col("low") == F.col("asked")).alias("n_folded"),
        F.max(F.when(F.col("low") == F.col("asked"), F.col("source"))).alias("folded"), F.count("*").alias("n_matches"), F.max("source").alias("one"),
    )
    r = n.select("name").join(g, "name", "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n_folded") == 1, "folded").when(F.col("n_matches") == 1, "unique").when(F.col("n_matches") > 1, "ambiguous").otherwise("not_found")
    source = F.when(status == "exact", F.col("exact")).when(status == "folded", F.col("folded")).when(status == "unique", F.col("one"))
    return r.select("name", status.alias("status"), source.alias("source"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


WRITES = frozenset("alter attach create delete detach drop insert pragma replace truncate update vacuum".split())


def guarded(sql: str) -> str:
    """``sql`` if it is one statement that only reads: it begins with SELECT or WITH and holds no word that writes outside of quotes; else ValueError."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip()
    body = bare[:-1].rstrip() if bare.endswith(";") else bare
    tokens = re.findall(r"[a-z_]+", body.lower())
    if ";" in body or not tokens or tokens[0] not in ("select", "with") or WRITES & set(tokens):
        raise ValueError("one SELECT or WITH statement that only reads is allowed")
    return sql.strip().rstrip(";")


def tagged_sections(chunks: DataFrame, tags: DataFrame, label: str, limit: int = 20) -> DataFrame:
    """id, source, ord of the first ``limit`` chunks, by source and place, with a tag (chunk_id, category_label) of that label, in any case."""
    own = tags.filter(F.lower("category_label") == label.lower()).select(F.col("chunk_id").alias("id"))
    return chunks.join(own, "id", "left_semi").select("id", "source", "ord").orderBy("source", "ord", "id").limit(limit)


def retag_candidates(asked: DataFrame, tokens: DataFrame, tags: DataFrame, k: int = 20) -> DataFrame:
    """query_id, id, score, rank: for each category (query_id, text) the k best chunks (:func:`tokenised`) by BM25 that it does not tag yet (chunk_id, category_id)."""
    have = tags.select(F.col("category_id").alias("query_id"), F.col("chunk_id").alias("id")).distinct()
    return top_per(bm25(asked, tokens).join(have, ["query_id", "id"], "left_anti"), "query_id", k)


def section_evidence(hits: DataFrame, asked: DataFrame, sources: int = 3) -> DataFrame:
    """query_id, n_hits, first_sources (the first distinct ones by rank, joined), no_evidence: what each question (query_id) found (query_id, source, rank)."""
    per = hits.groupBy("query_id", "source").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    top = top_per(per.withColumn("score", -F.col("rank")), "query_id", sources, tie="source")
    names = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank"), "source"))), lambda x: x["source"]), "|").alias("first_sources"))
    total = per.groupBy("query_id").agg(F.sum("n").alias("n_hits"))
    out = asked.select("query_id").distinct().join(total, "query_id", "left").join(names, "query_id", "left")
    return out.select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "first_sources", F.col("n_hits").isNull().alias("no_evidence"))
