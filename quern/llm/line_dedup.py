"""Line dedup: cross-site boilerplate lines go, found by distinct-site spread.

One HyperLogLog sketch of sites per line hash merges by aggregation. Lines whose
estimate lies within the sketch's error of the threshold get exact distinct counts.
DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import WORD, written

BLANKS = " \t\r\f\x0b"
SALTS = 32  # parts of a line's places in joins


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, long_words: int | None = None) -> DataFrame:
    """doc, body (hash of the text), pos, site, k1, k2, long: a row per line that is not blank; two 64-bit hashes name a line. Without ``long_words`` no line is long."""
    line = F.btrim(F.col("line"), F.lit(BLANKS))
    long = F.lit(False) if long_words is None else F.regexp_count(line, F.lit(WORD)) >= long_words
    return (
        docs.select(
            F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("body"), F.xxhash64(site_col).alias("site"),
            F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"),
        )
        .filter(line != "")
        .select(
            "doc", "body", "pos", "site", F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("line"), line).alias("k2"),
            F.pmod(F.xxhash64("doc", "body", "pos"), F.lit(SALTS)).cast("int").alias("salt"),
            long.alias("long"),
        )
    )


def _salted(keys: DataFrame) -> DataFrame:
    """Each key once for every salt: a line of very many places meets its key in ``SALTS`` tasks.

    Joined by merging: Spark's estimate leaves out the copies, so a table near the limit of broadcasts would reach the driver ``SALTS`` times as large.
    """
    return keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")


def boilerplate_lines(lines: DataFrame, min_sites: int, lg_k: int, long_sites: int | None = None) -> DataFrame:
    """k1, k2, first (doc, pos of the earliest occurrence) of every line on ``min_sites`` sites or more, long lines on ``long_sites`` or more."""
    bands = {n: max(1, math.ceil(4 * 1.04 / math.sqrt(2**lg_k) * n)) for n in (min_sites, long_sites or min_sites)}
    need, band = F.lit(min_sites), F.lit(bands[min_sites])
    if long_sites is not None:
        need, band = F.when(F.col("long"), long_sites).otherwise(need), F.when(F.col("long"), bands[long_sites]).otherwise(band)
    spread = lines.groupBy("k1", "k2").agg(
        F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "pos")).alias("first"), F.max("long").alias("long")
    )
    estimated = spread.select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"), need.alias("need"), band.alias("band"))
    likely = written(estimated.filter(F.col("sites") >= F.col("need") - F.col("band")), "line-spread")
    near = _salted(likely.filter(F.col("sites") <= F.col("need") + F.col("band")).select("k1", "k2"))
    exact = lines.select("k1", "k2", "salt", "site").join(near, ["k1", "k2", "salt"]).select("k1", "k2", "site").distinct().groupBy("k1", "k2").agg(F.count("*").alias("counted"))
    return likely.join(exact, ["k1", "k2"], "left").filter(F.coalesce("counted", "sites") >= F.col("need")).select("k1", "k2", "first")


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    keep_first: bool = True,
    lg_k: int = 12,
    long_words: int | None = None,
    long_sites: int = 3,
) -> DataFrame:
    """``docs`` with its text cleaned, and n_lines long, n_removed long beside its columns.

    A line is what stands between newlines, without spaces, tabs and returns at its
    ends; blank lines count as lines but are never removed. A line found on
    ``min_sites`` distinct sites or more is boilerplate and goes everywhere but at its
    first place in the corpus (smallest id, then position), so that a text copied over
    many sites survives once; ``keep_first=False`` removes that too. ``min_sites`` is
    at least 3, so a sketch's band never reaches lines of a single site.

    ``long_words``: lines of so many words or more are boilerplate from ``long_sites``
    distinct sites on (3 or more, ``min_sites`` at most), since chance does not repeat a
    line of that length; without it one threshold holds for all lines, as in :data:`SQL`.

    Null site: one site of its own. Null id: as a document after all others, told
    apart by its text; repeated rows are cleaned alike. Null text: stays null, with 0
    lines. A text of boilerplate only becomes empty; no document is dropped. An input
    column named n_lines or n_removed, in any case, is replaced. Empty table: empty result.
    """
    if min_sites < 3:
        raise ValueError("min_sites must be 3 or more")
    if long_words is not None and not 3 <= long_sites <= min_sites:
        raise ValueError("long_sites must be 3 or more, and min_sites at most")
    lines = _lines(docs, id_col, text_col, site_col, long_words)
    boiler = boilerplate_lines(lines, min_sites, lg_k, None if long_words is None else long_sites)
    hits = lines.drop("site", "long").join(_salted(boiler), ["k1", "k2", "salt"])
    if keep_first:
        hits = hits.filter(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") == F.col("first.pos"))))
    gone = hits.groupBy("doc", "body").agg(F.collect_set("pos").alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("body_of"))
    joined = whole.join(gone, F.col(f"row.{id_col}").eqNullSafe(F.col("doc")) & (F.col("body_of") == F.col("body")), "left")
    parts = F.split(F.col(f"row.{text_col}"), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone")), lambda i: parts[i]), "\n")
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(kept)
    out = {
        text_col: text,
        "n_lines": F.coalesce(F.size(parts), F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    has = {c.lower() for c in docs.columns}  # Spark does not tell names apart by case
    names = [*docs.columns, *[c for c in ("n_lines", "n_removed") if c not in has]]
    made = {c.lower(): v for c, v in out.items()}
    return joined.select(*[made.get(c.lower(), F.col(f"row.`{c}`")).alias(c) for c in names])


#: The query's rows in SQL; {min_sites} as above.
SQL = """
WITH lines AS (
  SELECT doc_id, source, pos - 1 AS pos, trim(parts[pos], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents WHERE text IS NOT NULL)
), boiler AS (
  SELECT line, min(struct_pack(d := doc_id, p := pos)) AS at FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= {min_sites}
), gone AS (
  SELECT l.doc_id, l.pos FROM lines l JOIN boiler b ON l.line = b.line WHERE NOT (l.doc_id = b.at.d AND l.pos = b.at.p)
), kept AS (
  SELECT d.doc_id, count(*) FILTER (WHERE g.pos IS NOT NULL) AS n_removed, count(*) AS n_lines,
         coalesce(string_agg(d.line, chr(10) ORDER BY d.pos) FILTER (WHERE g.pos IS NULL), '') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL) d
  LEFT JOIN gone g ON d.doc_id = g.doc_id AND d.pos = g.pos GROUP BY d.doc_id
)
SELECT d.doc_id, k.text, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
