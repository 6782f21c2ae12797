"""Spelling variants: words one edit apart by an even-partition pigeonhole join, and each word's more frequent form.

Two words one edit apart agree in one of two halves. So a word is indexed by its two segments, whose length depends on its own, and a
word as long or one longer probes with the substrings in the same place or shifted by one. What such a key leaves open is a window of the
word in which the edit has to be; a key that many words share is divided again, each half of its window for itself, so no key
stays large unless the window is one place wide, where the alphabet bounds it and all that meet are near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import give_back, written
from quern.llm.periodic import CRC_TABLE, crc_sql

FLUSH = 300_000  # words, or 16 letters each, that a task holds before it hands their counts on


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, slip: int | None = None) -> DataFrame:
    """word, n: how often each word of ``min_length`` code points or more occurs in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. With ``slip``, a run of a document loses a letter where
    ``slip`` divides h, the CRC-32 of ``<id>:<run>``: the one at h modulo its length. A null id has no such losses.

    Counted per document, then per task in bounded memory, then by Spark. Null texts have no words; texts and runs
    are read whole; repeated rows count again. Empty table: empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % min_length)
        met: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in met], pa.string()), pa.array(list(met.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                # other characters become a question mark, which is no letter
                found = Counter(runs.findall((text.as_py() or "").encode("latin-1", "replace").lower()))
                begin = zlib.crc32(f"{doc_id}:".encode()) if slip and doc_id is not None else None
                for run, k in found.items():
                    if begin is not None:
                        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
                        if h % slip == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_length:
                                continue
                    if run in met:
                        met[run] += k
                    else:
                        met[run] = k
                        size += 1 + len(run) // 16
                if size >= FLUSH:
                    yield out()
                    met, size = {}, 0
        yield out()
        met = {}
        give_back()

    given = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row's window (begin, end) as its two halves, with the key that names all of the word but the window."""
    mid = F.expr("cast((begin + end) div 2 as int)")
    halves = rows.withColumn("half", F.explode(F.array(F.struct(F.col("begin").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("end").alias("y")))))
    open_ = halves.filter("half.x < half.y").select("word", "n", "length", "longer", F.col("half.x").alias("begin"), F.col("half.y").alias("end"))
    head, tail = F.expr("left(word, begin)"), F.expr("right(word, length - end)")
    return open_.withColumn("key", F.xxhash64("length", "begin", "end", head, tail))


def near_pairs(words: DataFrame, *, key_rows: int = 32) -> DataFrame:
    """word, n, other, other_n: each pair of ``words`` (word, n; distinct) that one inserted, deleted or replaced code point makes equal, once.

    Of a pair of unequal length ``word`` is the shorter. A candidate pair meets under one key for each window that can hold its edit; it
    is taken under the leftmost only. Keys of more than ``key_rows`` words are divided while their window is wider than one place, so work
    grows with the words and the pairs that are near. Null and empty words are near to nothing. Empty table: empty result.
    """
    size = F.length("word")
    given = words.filter(size > 0).select("word", "n")
    as_long = given.select("word", "n", size.alias("length"), F.lit(False).alias("longer"))
    longer = given.filter(size > 1).select("word", "n", (size - 1).alias("length"), F.lit(True).alias("longer"))
    waiting = as_long.unionByName(longer).withColumns({"begin": F.lit(0), "end": F.col("length")})
    met: list[DataFrame] = []
    while True:
        keyed = written(_halves(waiting), "windows")
        sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(~F.col("longer")).alias("indexed")).filter("rows > 1 and indexed > 0")
        met.append(keyed.join(sizes, "key").withColumn("ready", (F.col("rows") <= key_rows) | (F.col("end") - F.col("begin") <= 1)))
        waiting = met[-1].filter("not ready").drop("key", "rows", "indexed", "ready")
        if waiting.isEmpty():
            break
    pairs = [_verified(m.filter("ready").drop("rows", "indexed", "ready")) for m in met]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out


def _verified(keyed: DataFrame) -> DataFrame:
    indexed = keyed.filter(~F.col("longer")).select("key", "word", "n", "length", "begin", "end")
    probes = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer", F.col("length").alias("its"), F.col("begin").alias("its_begin"), F.col("end").alias("its_end"))
    candidate = indexed.join(probes, "key").filter("length = its and begin = its_begin and end = its_end and (longer or word < other)")
    # a window further left holds the edit too if all from this one's beginning on is the same
    again = (F.col("begin") > 0) & F.expr("substring(word, begin + 1) = right(other, length - begin)")
    return candidate.filter(~again).filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for ``forms`` (word, form): where following forms ends. The steps are doubled each round."""
    reached = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = written(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if stepped.filter("moved").isEmpty():
            return stepped.select("word", "root")
        reached = stepped.select("word", "root")


def spelling_variants(counts: DataFrame, *, min_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n, root for the words of ``counts`` (word, n) with ``min_count`` occurrences or more.

    ``n_near``: how many of these words are one edit away. ``form``: the one of them with largest n (ties: smallest in code-point order), if
    that is ``ratio`` times the word's n or more; else null. ``root``: where following forms ends; the word itself if it has none.
    Forms grow by ``ratio`` (2 at least) each step, so they never turn in circles.

    Words come once each; nulls and the empty word are left out. Empty table: empty result; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more")
    words = written(counts.filter((F.col("n") >= min_count) & (F.length("word") > 0)).select("word", "n"), "words")
    pairs = written(near_pairs(words), "near-words")
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("other"))).alias("best"))
    likely: Column = -F.col("best.m") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.other")).alias("form"), F.when(likely, -F.col("best.m")).alias("form_n")
    )
    found = written(found, "forms")
    return found.join(_roots(found.filter("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = "".join(c for c in map(chr, range(0x21, 0x7F)) if c not in "'" and not c.islower())[:64]

#: The query's rows in SQL: every two words of nearly one length are compared. The distance counts bytes there, so letters are made one byte each.
SQL = rf"""
WITH RECURSIVE {CRC_TABLE}, run AS (
  SELECT r, doc_id, w, count(*) AS k FROM (
    SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents
  ) WHERE length(w) >= 6 GROUP BY r, doc_id, w
), coded AS (
  SELECT w, k, coalesce({crc_sql("doc_id || ':' || w")}, 1) AS h FROM run, crc
), vocabulary AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, k FROM coded)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
), v AS (
  SELECT word, n, length(word) AS size, translate(word, '{_ACCENTED}', '{_PLAIN}') AS t FROM vocabulary
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON (a.size = b.size OR a.size = b.size + 1 OR a.size + 1 = b.size) AND a.word <> b.word WHERE levenshtein(a.t, b.t) = 1
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, form AS next FROM found UNION ALL SELECT chain.word, found.word, found.form FROM chain JOIN found ON chain.next = found.word
)
SELECT found.word, n, n_near, found.form, form_n, root FROM found JOIN chain ON found.word = chain.word AND chain.next IS NULL
"""
