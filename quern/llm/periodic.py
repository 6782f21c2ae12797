"""Periodic runs of words: Lyndon roots found by a stack scanned right to left, under an order of the words and under its reverse.

A maximal repetition has a root that is the longest Lyndon word at its place under one of the two orders. That word ends at the next
smaller suffix, which a stack of earlier answers gives; suffixes are compared, and repetitions extended, by their longest common
extension: a binary search over rolling hashes whose outcome is then held against the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15  # of the rolling hash, modulo 2**64; equality by it is always checked
FULL = (1 << 64) - 1
FLUSH = 4 << 20  # bytes of text that go out at once


class Extension:
    """Longest common extensions within a sequence of whole numbers, to the right and to the left; exact."""

    def __init__(self, words: np.ndarray):
        self.words, self.list, self.n = words, words.tolist(), len(words)
        self.upto = self.power = None
        #: By distance: where the last stretch with words[x] == words[x + distance] begins and ends. Places are asked for from right to left.
        self.known: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, n: int) -> bool:
        """Whether n words from i and from j (i < j) have the same rolling hash."""
        if self.upto is None:
            mixed = (self.words.astype("uint64") + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
            power = np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(self.n, BASE, "uint64")]), dtype="uint64")
            self.upto = [0, *np.cumsum(mixed * power[:-1], dtype="uint64").tolist()]
            self.power = power.tolist()
        upto = self.upto
        return ((upto[i + n] - upto[i]) * self.power[j - i] - upto[j + n] + upto[j]) & FULL == 0

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j (i < j) are the same."""
        begin, end = self.known.get(j - i, (self.n, self.n))
        if begin <= i < end:
            return end - i
        w, limit = self.list, self.n - j
        joins = i < begin < i + limit  # what is known of this distance begins further on
        most = begin - i if joins else limit
        n = 0
        while n < most and n < 8 and w[i + n] == w[j + n]:
            n += 1
        if n == 8 and n < most:
            low, high = n, most
            while low < high:
                mid = (low + high + 1) // 2 if low > n or high < most else high  # all of it first
                low, high = (mid, high) if self._alike(i, j, mid) else (low, mid - 1)
            n = low
            same = self.words[i : i + n] == self.words[j : j + n]
            if not same.all():
                n = int(same.argmin())
        if n:
            self.known[j - i] = (i, end if joins and n == most else i + n)
        return self.known[j - i][1] - i if n else 0

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j (i < j) are the same."""
        w, n = self.list, 0
        while n < i and n < 8 and w[i - 1 - n] == w[j - 1 - n]:
            n += 1
        if n == 8 and n < i:
            low, high = n, i
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if self._alike(i - mid, j - mid, mid) else (low, mid - 1)
            n = low
            same = self.words[i - n : i] == self.words[j - n : j]
            if not same.all():
                n = int(same[::-1].argmin())
        return n


def lyndon_runs(words: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` with length >= max(least, times * period), times being 2 at least."""
    found: set[tuple[int, int, int]] = set()
    n = len(words)
    ends: set[tuple[int, int]] = set()
    for sign in (1, -1):
        common = Extension(words)
        w = [sign * x for x in common.list]
        after = [n] * n  # the next smaller suffix of each place; the end of the words is smaller than any
        for i in range(n - 1, -1, -1):
            a, j, same = w[i], i + 1, 0
            while j < n:
                b = w[j]
                same = 0
                if a == b:
                    same = common.right(i, j)
                    if j + same == n:
                        break
                    if w[j + same] < w[i + same]:
                        break
                elif b < a:
                    break
                j = after[j]
            after[i] = j
            period = j - i
            # the first root of such a run begins within its first period
            if j < n and same > (times - 2) * period and (period, j + same) not in ends:
                ends.add((period, j + same))
                back = common.left(i, j)
                length = same + period + back
                if length >= least and length >= times * period:
                    found.add((i - back, length, period))
    return found


def stretches(words: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Begin and end of the stretches in which such runs can lie: every word of a run is met again within the longest period that its stretch allows."""
    n = len(words)
    if n < least:
        return []
    order = np.argsort(words, kind="stable")
    gap = np.where(words[order[1:]] == words[order[:-1]], order[1:] - order[:-1], n)
    near = np.full(n, n)
    near[order[:-1]] = gap
    near[order[1:]] = np.minimum(near[order[1:]], gap)
    good = near < n
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype("int8")))
        begin, end = edge[::2], edge[1::2]
        room = np.zeros(n + 1, dtype="int64")
        room[begin] += end - begin
        room[end] -= end - begin
        room = np.cumsum(room[:n])
        still = (room >= least) & (near * times <= room)
        if (still == good).all():
            return list(zip(begin.tolist(), end.tolist(), strict=True))
        good = still


def runs_of(words: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words`` (whole numbers), by start and then period."""
    found = []
    for begin, end in stretches(words, least, times):
        found += [(begin + s, n, p) for s, n, p in lyndon_runs(words[begin:end], least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by a space, without what a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    over = np.zeros(len(words) + 1, dtype="int64")
    for start, length, period in runs:
        over[start + period] += 1
        over[start + length] -= 1
    over = np.cumsum(over).tolist()
    return b" ".join([w for w, k in zip(words, over, strict=False) if not k])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed: a row per document.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch with a smallest period q that no neighbouring word
    extends, of max(``least``, ``times`` * q) words or more; ``times`` is 2 at least. ``collapsed`` holds the words, joined by one space, that no
    run contains after its first q words.

    Every document is read whole and for itself, so nothing is shuffled and equal or very many rows matter not; a document of n words takes
    memory in proportion to n. Null and empty texts have no words, no runs and an empty ``collapsed``. Ids of any type, null
    or repeated, pass through. Empty table: empty result; other columns are ignored.
    """
    if times < 2 or least < 1:
        raise ValueError("times has to be 2 or more, least 1 or more")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = size = 0
            count, runs, short = [], [], []
            for r in range(batch.num_rows):
                words = (texts[r].as_py() or b"").split()
                number: dict[bytes, int] = {}
                coded = np.array([number.setdefault(w, len(number)) for w in words], dtype="int64")
                met = runs_of(coded, least, times)
                count.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in met])
                short.append(collapsed(words, met))
                size += len(short[-1])
                if size >= FLUSH or r + 1 == batch.num_rows:
                    made = [ids.slice(at, r + 1 - at), pa.array(count, pa.int64()), pa.array(runs, RUNS), pa.array(short, pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "runs", "collapsed"])
                    at, size = r + 1, 0
                    count, runs, short = [], [], []

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    found = given.mapInArrow(find, f"doc_id {dict(given.dtypes)['doc_id']}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """``text`` with a periodic end in the documents whose id's CRC-32 (of its decimal digits) 10 divides; null ids have none.

    With g that CRC over 10 and n words, those from word a = g % n on repeat the p words there, p = 1 + (n - a) / (3 + g % 8).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when((h % 10 == 0) & text.isNotNull(), _repeated(words, F.floor(h / 10))).otherwise(text)


def _repeated(words: Column, g: Column) -> Column:
    n = F.size(words).cast("long")
    a = F.when(n > 0, g % n).otherwise(F.lit(0))
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    head = F.slice(words, F.lit(1), a.cast("int"))
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.lit(""))


def digests(found: DataFrame) -> DataFrame:
    """:func:`periodic_runs` as doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of runs and text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("1000 * longest.length div -longest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def crc_sql(text: str) -> str:
    """CRC-32 (unsigned) of the UTF-8 of the SQL expression ``text``; its table by byte comes from the polynomial. Needs the relation ``crc(t)`` of :data:`CRC_TABLE`."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])))"


CRC_TABLE = """crc AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
)"""

#: The query's rows in SQL: equal words at every distance up to a quarter of the text, joined to stretches.
SQL = rf"""
WITH {CRC_TABLE}, d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({crc_sql("doc_id::VARCHAR")}, 1) AS h FROM documents, crc
), c AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d
), e AS (
  SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[1 : a], list_transform(range(0, n - a), lambda i: w[a + 1 + i % (1 + (n - a) // (3 + (h // 10) % 8))])) ELSE w END AS w FROM c
), t AS (
  SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM e
), pair AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND x.i < y.i JOIN e ON e.r = x.r WHERE (y.i - x.i) * 4 <= len(e.w)
), island AS (
  SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pair
), run AS (
  SELECT r, start, length, min(q) AS period FROM (SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, k)
  WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), many AS (
  SELECT r, count(*) AS n_runs, arg_max(struct_pack(s := start, n := length, p := period), struct_pack(n := length, s := -start, p := -period)) AS x,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT t.r, string_agg(word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.r = gone.r AND t.i = gone.i GROUP BY t.r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, x.s AS start, x.n AS length, x.p AS period, 1000 * x.n // x.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM e LEFT JOIN many ON e.r = many.r LEFT JOIN kept ON e.r = kept.r
"""
