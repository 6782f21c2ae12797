"""Batches of documents by words and bytes, dates in file names, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import dates
from quern.operators import batches
from quern.sources.tables import table

MAX_WORDS, MAX_BYTES, MAX_ITEMS = 400, 20000, 12


def word_batches(spark, d):
    """Sources as documents, their documents as sections of lines, with a few heading words."""
    docs = table(spark, d, "documents").filter("source is not null")
    lines = docs.filter("text is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    words = F.size(F.array_remove(F.split("line", " "), ""))
    return batches.word_batches(
        lines.select(F.col("source").alias("doc"), F.col("doc_id").alias("section"), "block", words.alias("words")),
        docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("section"), (F.col("doc_id") % 5).alias("heading_words")), MAX_WORDS,
    )


WORD_SQL = f"""WITH RECURSIVE s AS (SELECT source AS doc, doc_id AS section, doc_id % 5 AS heading FROM documents WHERE source IS NOT NULL),
l AS (SELECT source AS doc, doc_id AS section, unnest(range(0, len(string_split(text, chr(10))))) AS block, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
b AS (SELECT doc, section, row_number() OVER (PARTITION BY doc, section ORDER BY block) AS k, words FROM (SELECT *, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words FROM l) WHERE words > 0),
t AS (SELECT doc, section, heading, heading + coalesce(sum(words), 0) AS total, count(words) AS n FROM s LEFT JOIN b USING (doc, section) GROUP BY doc, section, heading),
f AS (SELECT doc, section, k, 0 AS part, heading + words AS run, heading + words AS words FROM b JOIN t USING (doc, section) WHERE k = 1 AND total > {MAX_WORDS}
  UNION ALL SELECT b.doc, b.section, b.k, CASE WHEN f.run + b.words > {MAX_WORDS} THEN f.part + 1 ELSE f.part END, CASE WHEN f.run + b.words > {MAX_WORDS} THEN b.words ELSE f.run + b.words END, b.words
  FROM f JOIN b ON b.doc = f.doc AND b.section = f.section AND b.k = f.k + 1),
u AS (SELECT doc, section, part, sum(words) AS words FROM f GROUP BY 1, 2, 3 UNION ALL SELECT doc, section, 0, total FROM t WHERE total <= {MAX_WORDS} OR n = 0),
o AS (SELECT *, count(*) OVER (PARTITION BY doc, section) AS n_parts, row_number() OVER (PARTITION BY doc ORDER BY section, part) AS k FROM u),
g AS (SELECT doc, k, words AS run, 0 AS batch FROM o WHERE k = 1
  UNION ALL SELECT o.doc, o.k, CASE WHEN g.run + o.words > {MAX_WORDS} THEN o.words ELSE g.run + o.words END, CASE WHEN g.run + o.words > {MAX_WORDS} THEN g.batch + 1 ELSE g.batch END FROM g JOIN o ON o.doc = g.doc AND o.k = g.k + 1)
SELECT doc, section, CAST(part AS BIGINT) AS part, n_parts, CAST(words AS BIGINT) AS words, CAST(batch AS BIGINT) AS batch FROM o JOIN g USING (doc, k)"""


def byte_batches(spark, d):
    docs = table(spark, d, "documents")
    return batches.byte_batches(docs.select(F.col("source").alias("key"), F.col("doc_id").alias("pos"), F.octet_length("text").alias("bytes")), max_items=MAX_ITEMS, max_bytes=MAX_BYTES, min_batches=3)


BYTE_SQL = f"""WITH RECURSIVE i AS (SELECT source AS key, coalesce(octet_length(encode(text)), 0) + 2 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT key, n, sum(size) OVER (PARTITION BY key ORDER BY n) AS upto FROM i UNION ALL SELECT DISTINCT key, 0, 0 FROM i),
c AS (SELECT key, total, CAST(least(total, greatest(3, ceil(total / {MAX_ITEMS}), ceil((bytes + 2) / {MAX_BYTES}))) AS BIGINT) AS k FROM (SELECT key, max(n) AS total, max(upto) AS bytes FROM p GROUP BY key)),
e AS (SELECT *, CAST(ceil(total / k) AS BIGINT) AS each FROM c), h AS (SELECT key, each, total, unnest(range(0, k)) AS j FROM e),
r AS (SELECT key, j * each AS lo, least(total, (j + 1) * each) AS hi FROM h WHERE j * each < total
  UNION ALL SELECT key, unnest([lo, lo + (hi - lo) // 2]), unnest([lo + (hi - lo) // 2, hi]) FROM (SELECT r.*, b.upto - a.upto + 2 AS bytes FROM r JOIN p a ON a.key = r.key AND a.n = r.lo JOIN p b ON b.key = r.key AND b.n = r.hi) WHERE hi - lo > 1 AND bytes > {MAX_BYTES}),
z AS (SELECT r.key, lo, hi - lo AS n, b.upto - a.upto + 2 AS bytes FROM r JOIN p a ON a.key = r.key AND a.n = r.lo JOIN p b ON b.key = r.key AND b.n = r.hi)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY lo) - 1 AS batch, CAST(lo AS BIGINT) AS first, CAST(n AS BIGINT) AS n, CAST(bytes AS BIGINT) AS bytes FROM z WHERE n <= 1 OR bytes <= {MAX_BYTES}"""

def file_dates(spark, d):
    """Names as exports write them, seven forms in turn, of days around those of the events; read on the first of June."""
    day = F.date_add(F.to_date("ts"), (F.col("event_id") % 200).cast("int"))
    as_ = lambda form: F.date_format(day, form)
    forms = [
        F.concat(F.lit("sync "), as_("yyyy-MM-dd")), F.concat(as_("MM.dd.yyyy"), F.lit("_1101 sync")), F.concat(as_("dd.MM.yyyy"), F.lit(" call")), F.concat(F.lit("call "), as_("yyyyMMdd")),
        F.concat(as_("d_MMM"), F.lit(" notes")), F.concat(as_("MMMM d"), F.lit(" review")), F.concat(F.lit("order "), F.col("event_id").cast("string")),
    ]
    n = table(spark, d, "events").select("event_id", F.get(F.array(*forms), (F.col("event_id") % 7).cast("int")).alias("name"))
    ref = F.lit("2024-06-01").cast("date")
    found = dates.date_in_name(F.col("name"), ref)
    return n.select("event_id", "name", found.cast("string").alias("day"), dates.short_date(found, ref).alias("short"))


DATES_SQL = r"""WITH e AS (SELECT event_id, CAST(ts AS DATE) + CAST(event_id % 200 AS INTEGER) AS x FROM events),
n AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'sync ' || strftime(x, '%Y-%m-%d') WHEN 1 THEN strftime(x, '%m.%d.%Y') || '_1101 sync' WHEN 2 THEN strftime(x, '%d.%m.%Y') || ' call' WHEN 3 THEN 'call ' || strftime(x, '%Y%m%d')
  WHEN 4 THEN strftime(x, '%-d_%b') || ' notes' WHEN 5 THEN strftime(x, '%B %-d') || ' review' ELSE 'order ' || event_id END AS name FROM e),
p AS (SELECT *, regexp_extract(name, '(\d\d)\.(\d\d)\.(20\d\d)', ['a', 'b', 'y']) AS dot, regexp_extract(name, '(20\d\d)[-_]?(\d\d)[-_]?(\d\d)', ['y', 'm', 'd']) AS bare,
  regexp_extract(lower(name), '(\d{1,2})_([a-z]{3})\b', ['d', 'm']) AS early, regexp_extract(lower(name), '\b([a-z]+) (\d{1,2}) review', ['m', 'd']) AS late FROM n),
w AS (SELECT *, CASE WHEN early.m <> '' THEN early.m ELSE late.m[:3] END AS mon, CASE WHEN early.d <> '' THEN early.d ELSE late.d END AS dd FROM p),
y AS (SELECT *, TRY_CAST('2024-' || lpad(CAST((position(mon IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3 AS VARCHAR), 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS this FROM w),
f AS (SELECT event_id, name, CASE WHEN dot.y <> '' THEN TRY_CAST(dot.y || '-' || CASE WHEN TRY_CAST(dot.a AS INTEGER) > 12 THEN dot.b || '-' || dot.a ELSE dot.a || '-' || dot.b END AS DATE) WHEN bare.y <> '' THEN TRY_CAST(bare.y || '-' || bare.m || '-' || bare.d AS DATE)
  WHEN mon <> '' THEN CASE WHEN this > DATE '2024-07-01' THEN TRY_CAST('2023' || strftime(this, '-%m-%d') AS DATE) ELSE this END END AS found FROM y)
SELECT event_id, name, CAST(found AS VARCHAR) AS day, strftime(found, '%b %-d') || CASE WHEN year(found) <> 2024 THEN ', ' || year(found) ELSE '' END AS short FROM f"""

QUERIES = {f.__name__: f for f in (word_batches, byte_batches, file_dates)}
ORACLES = {"word_batches": WORD_SQL, "byte_batches": BYTE_SQL, "file_dates": DATES_SQL}
