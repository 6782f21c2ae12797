"""Transcripts and Markdown: SRT and WebVTT cues, headings and chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import clock_seconds

TIMING = r"(\d{1,2}:\d{2}:\d{2}[.,]\d{1,3}|\d{1,2}:\d{2}[.,]\d{1,3})\s*-->\s*"


def _clean(c: Column) -> Column:
    """Cue text without tags, white space to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " "))


def cues(files: DataFrame) -> DataFrame:
    """source, pos, start, speaker, text of files (source, text) in SRT or WebVTT: blocks parted by blank lines that have a timing line; empty cues are dropped, NOTE and header blocks too.

    Cues of one base id (``<base>-<n>``) are one turn, in order of their first cue. A speaker is a ``<v Name>`` tag, or a name before a colon.
    """
    block = files.select("source", F.posexplode(F.split(F.regexp_replace("text", r"\r\n?", "\n"), r"\n[ \t]*\n+")).alias("pos", "block")).filter(F.col("block").rlike(TIMING) & ~F.col("block").rlike(r"^\s*NOTE\b"))
    start = F.regexp_extract("block", TIMING, 1)
    body = F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", "")
    head = F.trim(F.regexp_extract("block", r"^\s*([^\n]*)\n", 1))
    base = F.when(head.rlike(r"^[0-9A-Za-z/]+(-[0-9A-Za-z/]+)*-\d+$"), F.regexp_replace(head, r"-\d+$", ""))
    voice = F.nullif(F.regexp_extract(body, r"<v(?:\.[^ >]*)?\s+([^>]+)>", 1), F.lit(""))
    plain = _clean(body)
    named = F.nullif(F.regexp_extract(plain, r"^([A-Z][\w .'-]{0,40}?):\s", 1), F.lit(""))
    text = F.when(voice.isNull() & named.isNotNull(), F.trim(F.regexp_replace(plain, r"^[^:]*:\s", ""))).otherwise(plain)
    rows = block.select("source", "pos", clock_seconds(start).alias("start"), F.coalesce(voice, named).alias("speaker"), text.alias("text"), F.coalesce(base, F.concat(F.lit("#"), F.col("pos"))).alias("base")).filter("text <> ''")
    merged = rows.groupBy("source", "base").agg(
        F.min("pos").alias("pos"), F.min_by("start", "pos").alias("start"), F.min_by("speaker", "pos").alias("speaker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda t: t["text"]), " ").alias("text")
    )
    return merged.select("source", "pos", "start", "speaker", "text")


def headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, line, level, breadcrumb, parent: each line under the headings it stands in; a heading ends those at its level and below."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))
    named = lines.withColumn("level", F.nullif(level, F.lit(0))).withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,6}\s+", "")))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("level") == j, F.col("title")).when(F.col("level") < j, F.lit("")), ignorenulls=True).over(w).alias(f"h{j}") for j in range(1, 7)]
    open_ = named.select("id", "pos", "line", "level", *stack)
    path = F.filter(F.array(*[F.col(f"h{j}") for j in range(1, 7)]), lambda h: h.isNotNull() & (h != ""))
    p = open_.withColumn("path", path)
    return p.select("id", "pos", "line", "level", F.array_join("path", " > ").alias("breadcrumb"), F.when(F.size("path") > 1, F.get("path", F.size("path") - 2)).alias("parent"))


def sections(docs: DataFrame, id_col: str, text_col: str, max_chars: int = 1200) -> DataFrame:
    """id, ord, title, breadcrumb, text: the lines under each heading, packed in order into parts of ``max_chars`` at most (a longer line alone); sections of a heading only are dropped, and ord counts what is left."""
    h = headings(docs, id_col, text_col)
    w = Window.partitionBy("id").orderBy("pos")
    body = h.withColumn("section", F.count("level").over(w)).filter("level is null and trim(line) <> ''")
    per = body.groupBy("id", "section", "breadcrumb").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    fits = lambda acc, x: (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(x["line"]) <= max_chars)
    step = lambda acc, x: F.when(
        fits(acc, x), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", F.element_at(acc, -1), x["line"])))
    ).otherwise(F.concat(acc, F.array(x["line"])))
    parts = per.select("id", "section", "breadcrumb", F.posexplode(F.aggregate("ls", F.array().cast("array<string>"), step)).alias("part", "text"))
    title = F.element_at(F.split("breadcrumb", " > "), -1)
    numbered = F.when(F.col("part") > 0, F.concat(title, F.lit(" (part "), F.col("part") + 1, F.lit(")"))).otherwise(title)
    return parts.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("section", "part")) - 1).alias("ord"), numbered.alias("title"), "breadcrumb", "text")
