"""Ordered rows cut into batches: greedily by size, and by halving.

Sizes are summed over the whole table in one order: ranges of rows, a number for each range, then sums inside the ranges, so one key may hold most
rows. Where a batch that begins at a row would end is found in those sums by an equality join on cells as wide as a batch; which rows do begin one is
found by pointers that double each round. No key is gathered.

Rows with a null key or position are left out, a null size is 0, positions of a key are distinct; empty tables give empty results; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.scratch import settled


def running(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """``rows`` with n (from 0) and upto (the sum of ``size`` through the row), over the whole table in ``order``; written. What is broadcast is two numbers a range."""
    ranged = settled(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.count("*").alias("__rows"), F.sum(size).alias("__sum"))
    w = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("__range", F.coalesce(F.sum("__rows").over(w), F.lit(0)).alias("__n"), F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__range").orderBy(*order)
    out = ranged.withColumn("n", F.row_number().over(own).cast("long") - 1).withColumn("upto", F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(before), "__range")
    return settled(out.withColumn("n", F.col("n") + F.col("__n")).withColumn("upto", F.col("upto") + F.col("__s")).drop("__range", "__n", "__s"), "running")


def greedy_batches(items: DataFrame, most: int, *, key: list[str], pos: str, size: str) -> DataFrame:
    """``items`` with batch (from 0 in each key): rows in order of ``pos``, a new batch where the next row would take it over ``most``; a row above ``most`` is alone.

    Rounds grow with the logarithm of a key's batches.
    """
    if most < 1:
        raise ValueError("most must be 1 at least")
    given = items.dropna(subset=[*key, pos]).withColumn("__size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    r = running(given, [*key, pos], "__size")
    place = F.struct(*key)
    slim = r.select("n", F.xxhash64(*key).alias("k"), (F.col("upto") - F.col("__size")).alias("low"), "upto")
    # the row that takes a batch over ``most``, begun at a row, is the one whose stretch of the sums holds that row's low + most
    cells = slim.filter("upto > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / most), F.floor((F.col("upto") - 1) / most))))
    probe = slim.select(F.col("n").alias("at"), F.col("k").alias("of"), (F.col("low") + most).alias("goal")).withColumn("cell", F.floor(F.col("goal") / most))
    over = probe.join(cells, "cell").filter("low <= goal and goal < upto").select("at", "of", F.greatest("n", F.col("at") + 1).alias("to"))
    keys = slim.select(F.col("n").alias("to"), F.col("k").alias("there"))
    hop = settled(over.join(keys, "to").filter("of = there").select("at", "to"), "hops")
    starts = [settled(r.groupBy(place.alias("key")).agg(F.min("n").alias("at")).select("at"), "starts")]
    while not hop.isEmpty():
        reached = starts[0]
        for more in starts[1:]:
            reached = reached.unionByName(more)
        starts.append(settled(reached.join(hop, "at").select(F.col("to").alias("at")), "starts"))
        hop = settled(hop.join(hop.select(F.col("at").alias("to"), F.col("to").alias("further")), "to").select("at", F.col("further").alias("to")), "hops")
    begun = starts[0]
    for more in starts[1:]:
        begun = begun.unionByName(more)
    marked = r.join(begun.select(F.col("at").alias("n"), F.lit(1).cast("long").alias("__begins")), "n", "left").drop("upto", "n").na.fill(0, ["__begins"])
    counted = running(marked, [*key, pos], "__begins")
    first = counted.groupBy(*key).agg(F.min("upto").alias("__first"))
    return counted.join(first, key).withColumn("batch", F.col("upto") - F.col("__first")).drop("__first", "__begins", "__size", "upto", "n")


def word_batches(blocks: DataFrame, sections: DataFrame, max_words: int) -> DataFrame:
    """doc, section, part, n_parts, words, batch: sections of documents, cut into parts where they are too long, packed in order into batches of ``max_words``.

    sections: doc, section (their order), heading_words; blocks: doc, section, block (their order), words. A section that fits is whole. Else its blocks go on
    until the next with words would pass ``max_words``; the heading counts to the first part, a block is never cut and blocks without words open no part. Blocks of no section are left out.
    """
    s = sections.dropna(subset=["doc", "section"]).dropDuplicates(["doc", "section"]).select("doc", "section", F.coalesce("heading_words", F.lit(0)).cast("long").alias("heading"))
    # written, since what counts the words of texts would else run for each use
    b = settled(blocks.select("doc", "section", "block", F.col("words").cast("long").alias("words")).filter("words > 0"), "blocks").join(s, ["doc", "section"])
    sums = b.groupBy("doc", "section").agg(F.sum("words").alias("body"), F.min("block").alias("first"))
    s = settled(s.join(sums, ["doc", "section"], "left").withColumn("total", F.col("heading") + F.coalesce("body", F.lit(0))), "sections")
    long = s.filter((F.col("total") > max_words) & F.col("body").isNotNull())
    cut = b.drop("heading").join(long.select("doc", "section", "heading", "first"), ["doc", "section"]).withColumn("words", F.col("words") + F.when(F.col("block") == F.col("first"), F.col("heading")).otherwise(0))
    parts = greedy_batches(cut, max_words, key=["doc", "section"], pos="block", size="words").groupBy("doc", "section", F.col("batch").alias("part")).agg(F.sum("words").alias("words"))
    parts = parts.join(parts.groupBy("doc", "section").agg(F.count("*").alias("n_parts")), ["doc", "section"])
    whole = s.join(long.select("doc", "section"), ["doc", "section"], "left_anti").select("doc", "section", F.lit(0).cast("long").alias("part"), F.col("total").alias("words"), F.lit(1).cast("long").alias("n_parts"))
    units = parts.unionByName(whole).withColumn("at", F.struct("section", "part"))
    return greedy_batches(units, max_words, key=["doc"], pos="at", size="words").select("doc", "section", "part", "n_parts", "words", "batch")


def byte_batches(items: DataFrame, *, max_items: int, max_bytes: int, min_batches: int = 1, frame: int = 2) -> DataFrame:
    """key, batch, first, n, bytes: items (key, pos, bytes) of each key in equal counts, then halved while a batch of two or more is above ``max_bytes``.

    The count is the least that both caps and ``min_batches`` ask for, never above the items. A batch takes ``frame`` bytes, and ``frame`` more an item. ``first``: the
    number of its first item in the key, from 0. A round halves all that are too large, so rounds grow with the logarithm of a batch's items.
    """
    if max_items < 1 or max_bytes < 1:
        raise ValueError("caps must be 1 at least")
    given = items.dropna(subset=["key", "pos"]).select("key", "pos", (F.coalesce(F.col("bytes").cast("long"), F.lit(0)) + frame).alias("size"))
    r = running(given, ["key", "pos"], "size")
    keys = settled(r.groupBy("key").agg(F.min("n").alias("base"), F.count("*").alias("total"), F.min(F.col("upto") - F.col("size")).alias("zero"), F.max("upto").alias("end")), "keys")
    up = lambda a, b: F.ceil(a / b).cast("long")
    n = F.least("total", F.greatest(F.lit(min_batches), F.lit(1), up(F.col("total"), F.lit(max_items)), up(F.col("end") - F.col("zero") + frame, F.lit(max_bytes))))
    k = keys.withColumn("k", n.cast("long")).withColumn("each", up(F.col("total"), F.col("k")))
    lo = F.col("j") * F.col("each")
    open_ = k.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select("key", (F.col("base") + lo).alias("lo"), (F.col("base") + F.least("total", lo + F.col("each"))).alias("hi"), "base").filter("hi > lo")
    low, high = r.select(F.col("n").alias("lo"), (F.col("upto") - F.col("size")).alias("from")), r.select((F.col("n") + 1).alias("hi"), "upto")
    done, open_ = [], settled(open_, "halves")
    while not open_.isEmpty():
        sized = settled(open_.join(low, "lo").join(high, "hi").select("key", "base", "lo", "hi", (F.col("upto") - F.col("from") + frame).alias("bytes")), "sized")
        done.append(sized.filter(f"hi - lo <= 1 or bytes <= {max_bytes}"))
        mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)
        large = sized.filter(f"hi - lo > 1 and bytes > {max_bytes}").withColumn("cut", F.array(F.struct(F.col("lo").alias("x"), mid.alias("y")), F.struct(mid.alias("x"), F.col("hi").alias("y"))))
        open_ = settled(large.withColumn("half", F.explode("cut")).select("key", F.col("half.x").alias("lo"), F.col("half.y").alias("hi"), "base"), "halves")
    if not done:
        return open_.select("key", F.lit(0).cast("long").alias("batch"), "lo", "hi", F.lit(0).cast("long").alias("bytes")).selectExpr("key", "batch", "lo as first", "hi as n", "bytes")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    number = F.row_number().over(Window.partitionBy("key").orderBy("lo")).cast("long") - 1
    return out.select("key", number.alias("batch"), (F.col("lo") - F.col("base")).alias("first"), (F.col("hi") - F.col("lo")).alias("n"), "bytes")
