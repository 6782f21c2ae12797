"""Files in and out: corpora, event logs, evidence, exports and tables that replace each other whole. Paths are of any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import transcripts

#: File endings by the reader that takes them.
KINDS = {"markdown": ("md", "markdown", "txt"), "cues": ("vtt", "srt"), "log": ("jsonl", "ndjson"), "page": ("html", "htm")}


def kind_of(path):
    """The reader for a path by its ending, letters' case aside: markdown, cues, log, page; else null."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for kind, ends in KINDS.items():
        out = F.when(end.isin(*ends), kind).otherwise(out)
    return out


def corpus(spark: SparkSession, root: str, *, include: str = "*", exclude: str | None = None) -> DataFrame:
    """path (below the root), kind, text of every file under ``root`` whose name fits the glob ``include``; ``exclude`` is a pattern of paths to leave out.

    Bytes that are no UTF-8 become replacement characters. A file is a row and has to fit in a task. Hidden files are left out.
    """
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", include).load(at)
    inner = F.regexp_replace(F.substring_index(F.col("path"), f"{at.rsplit('/', 1)[-1]}/", -1), "^/+", "")
    found = files.select(inner.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    if exclude is not None:
        found = found.filter(~F.col("path").rlike(exclude))
    return found.select("path", kind_of(F.col("path")).alias("kind"), "text")


def transcript_cues(files: DataFrame) -> DataFrame:
    """The cues of a corpus's transcripts (:func:`quern.sources.transcripts.cues`); other files give none."""
    return transcripts.cues(files.filter("kind = 'cues'").select(F.col("path").alias("source"), "text"))


def event_log(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of a JSON-lines log, with ``seq``: the line's place in its file, from 0, and ``file``; lines that are no JSON object of the schema are left out.

    A log is read whole by one task a file, since its lines' order has a meaning that a split file would lose.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("seq", "line"))
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.filter(F.trim("line").startswith("{")).withColumn("r", F.from_json("line", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return parsed.filter("r is not null and r._bad is null").select("file", "seq", *[F.col(f"r.`{f.name}`") for f in fields.fields])


def append_log(rows: DataFrame, folder: str) -> None:
    """Add ``rows`` to a JSON-lines log as new files: what is there is never rewritten, and a failed job leaves nothing that is read."""
    rows.write.mode("append").json(folder)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path`` and put it in its place when it is complete; a reader finds the old table or the new one, and a failed job leaves the old one."""
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{word}-{uuid.uuid4().hex}" for word in ("new", "old"))
    df.write.parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(hadoop(path))
    if had and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(hadoop(new), hadoop(path)):
        if had:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"{new} cannot be moved to {path}")
    if had:
        fs.delete(hadoop(old), True)


def write_once(df: DataFrame, path: str) -> None:
    """Write ``df`` to a path that must not be there yet: a version is never written again."""
    df.write.mode("errorifexists").parquet(path)


def write_marts(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table under its name, replaced whole, so that no row of a build before stays."""
    for name, df in tables.items():
        replace_table(df, f"{folder.rstrip('/')}/{name}")


def export_documents(chunks: DataFrame, folder: str, *, category: bool = False) -> None:
    """The ACTIVE chunks (source, ord, title, text, status and, with ``category``, category) as Markdown: a text row a document, in a folder by category and source.

    Chunks stand in the order of ord, ties by text; a title is a heading; a null status is ACTIVE, a null category ``none``. A document has to fit in a row.
    """
    kept = chunks.filter(F.coalesce("status", F.lit("ACTIVE")) == "ACTIVE")
    body = F.concat(F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("## "), "title", F.lit("\n\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    keys = [*([F.coalesce("category", F.lit("none")).alias("category")] if category else []), F.col("source")]
    docs = kept.select(*keys, F.struct("ord", body.alias("body")).alias("c")).groupBy(*(["category"] if category else []), "source").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    docs.select(*(["category"] if category else []), "source", F.array_join(F.transform("cs", lambda c: c["body"]), "\n\n").alias("value")).write.mode("overwrite").partitionBy(*(["category"] if category else []), "source").text(folder)


def build_audit(facts: DataFrame, units: DataFrame) -> DataFrame:
    """family, n_units, n_ok, n_partial, n_failed, n_facts, n_months, n_entities: a build's units (family, unit, state) and facts (family, entity, month); families of either side, 0 where one lacks."""
    u = units.groupBy("family").agg(F.count("*").alias("n_units"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("ok", "partial", "failed")])
    f = facts.groupBy("family").agg(F.count("*").alias("n_facts"), F.count_distinct("month").alias("n_months"), F.count_distinct("entity").alias("n_entities"))
    names = ["n_units", "n_ok", "n_partial", "n_failed", "n_facts", "n_months", "n_entities"]
    return u.join(f, "family", "full").select("family", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def carried_images(sections: DataFrame) -> DataFrame:
    """source, ord, text, image of sections (source, ord, text, image): a section of an image only is dropped and its image goes to the next one with text that has none; sections without an image take the last one before them in their source. ord stays as it was."""
    w = Window.partitionBy("source").orderBy("ord")
    last = F.last("image", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = sections.withColumn("image", last)
    return t.filter(F.trim(F.coalesce("text", F.lit(""))) != "").select("source", "ord", "text", "image")
