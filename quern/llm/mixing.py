"""Mixing sources to target weights by the cube method's balanced sampling."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from quern.llm.common import WORD, numbered, written

EDGE = 1e-9
KEPT = ["row", "doc_id", "tie", "deal", "source", "size", "source_size", "target", "whole", "p"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, rows, target of each source of ``sizes`` (source, size).

    Sources in code-point order, null last, weigh ``weights`` over and over and share
    the total of all sizes; a target stops at ``most`` times its source's size and the excess
    goes to the others by weight. So a target is the smaller of that cap and weight times
    one common level, and the level rises until the targets reach the total: each round
    sums over the sources' table, whose rows never reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = numbered(per, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = written(ranked.select("source", "source_size", "rows", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "sources")
    total = float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    level = 0.0
    while True:
        full = F.col("cap") < F.col("weight") * level
        s = table.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        nxt = (total - (s["caps"] or 0.0)) / s["open"] if s["open"] else level
        if nxt <= level:
            break
        level = nxt
    return table.select("source", "source_size", "rows", F.least("cap", F.col("weight") * level).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move the fractions of ``p`` to 0 or 1 in place, all but two at most.

    Three fractional units at a time move along the vector that keeps both their number
    and their words, until one of them reaches 0 or 1; the direction is drawn so that every
    unit's expectation stays as it was.
    """
    held: list[int] = []
    for k in range(len(p)):
        if EDGE < p[k] < 1 - EDGE:
            held.append(k)
        while len(held) == 3:
            a, b, c = held
            x, y, z = float(size[a]), float(size[b]), float(size[c])
            u = (z - y, x - z, y - x) if not x == y == z else (1.0, -1.0, 0.0)
            forth, back = math.inf, math.inf
            for i, d in zip(held, u, strict=True):
                if d > 0:
                    forth, back = min(forth, (1 - p[i]) / d), min(back, p[i] / d)
                elif d < 0:
                    forth, back = min(forth, p[i] / -d), min(back, (1 - p[i]) / -d)
            step = forth if rng.random() * (forth + back) < back else -back
            for i, d in zip(held, u, strict=True):
                p[i] += step * d
            left = [i for i in held if EDGE < p[i] < 1 - EDGE]
            for i in held:
                if i not in left:
                    p[i] = round(p[i])
            held = left


def land(p: np.ndarray, size: np.ndarray, due: float) -> None:
    """Round the last fractions, so that the words taken come as near as they can to ``due``.

    A document much longer than the others can be left open to the end, and no rounding
    of two documents makes up for it. Then settled documents change sides, the one that helps
    most first, as long as that brings the words nearer.
    """
    open_ = [k for k in range(len(p)) if EDGE < p[k] < 1 - EDGE]
    np.rint(p, out=p, where=~np.isin(np.arange(len(p)), open_))
    fixed = float(p @ size) - sum(p[k] * size[k] for k in open_)
    best = min(range(1 << len(open_)), key=lambda m: (abs(fixed + sum(((m >> j) & 1) * size[k] for j, k in enumerate(open_)) - due), m))
    for j, k in enumerate(open_):
        p[k] = (best >> j) & 1
    change = np.where(p > 0.5, -size, size).astype("float64")
    over = float(p @ size) - due
    while len(p):
        k = int(np.argmin(np.abs(over + change)))
        if abs(over + change[k]) >= abs(over) - 0.5:
            break
        over, p[k], change[k] = over + change[k], 1 - p[k], -change[k]


def _flyer(depth: int):
    """One block's flight, and its landing if it is the last of its source."""

    def fly(block: pa.Table) -> pa.Table:
        block = block.sort_by([("tie", "ascending"), ("size", "ascending"), ("deal", "ascending")])
        p, size = block["p"].to_numpy().copy(), block["size"].to_numpy()
        due = float(p @ size)
        flight(p, size, np.random.default_rng([depth, block["block"][0].as_py(), zlib.crc32(repr(block["source"][0].as_py()).encode())]))
        if block["last"][0].as_py() and ((p > EDGE) & (p < 1 - EDGE)).any():
            land(p, size, due)
        p = np.where(p <= EDGE, 0.0, np.where(p >= 1 - EDGE, 1.0, p))
        return block.select(KEPT[:-1]).append_column("p", pa.array(p))

    return fly


def _dealt(units: DataFrame, salts: int = 32) -> DataFrame:
    """``units`` with deal: a hash of ``tie``, and for rows of one source and tie of their number among those by ``mark``, so that it tells which row is which but not where it was read.

    Rows that are equal (in their mark too) are numbered by salted parts, since a third of all rows can be equal; which of them has which number makes no difference.
    """
    group = ["source", "tie", "mark", "salt"]
    several = units.groupBy("source", "tie").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("source").alias("of"), F.col("tie").alias("its"), F.lit(True).alias("several"))
    marked = units.join(several, F.col("source").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("its")), "left").drop("of", "its")
    once = marked.filter("several is null").withColumn("deal", F.xxhash64("tie", F.lit(0).cast("long")))
    alike = written(marked.filter("several").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))), "equal-rows")
    parts = alike.groupBy(*group).agg(F.count("*").alias("n"))
    ahead = parts.withColumn("ahead", F.sum("n").over(Window.partitionBy("source", "tie").orderBy("mark", "salt")) - F.col("n"))  # a row per different row and salt
    ahead = ahead.select(*[F.col(c).alias(f"its_{c}") for c in group], "ahead")
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("row")) - 1
    same = [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in group]
    own = alike.withColumn("nth", nth).join(ahead, same[0] & same[1] & same[2] & same[3])
    placed = own.withColumn("deal", F.xxhash64("tie", (F.col("ahead") + F.col("nth")).cast("long"))).select(*once.columns)
    return once.unionByName(placed).drop("several", "mark")


def _copies(units: DataFrame, weights: tuple[int, ...], most: int, block_rows: int) -> DataFrame:
    """row, doc_id, size, source_size, target, copies for ``units`` (row, doc_id, tie, mark, source, size)."""
    targets = source_targets(units.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("of"), "source_size", "target", "rows", rate.alias("rate"))
    joined = units.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "doc_id", "tie", "mark", "source", "size", "source_size", "target", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.col("rows").alias("left_rows")
    )
    kind = f"row long, doc_id {dict(units.dtypes)['doc_id']}, tie long, deal long, source string, size long, source_size long, target double, whole long, p double"
    joined = _dealt(joined)
    settled: list[DataFrame] = []
    waiting, depth = joined, 0
    while True:
        blocks = F.ceil(F.col("left_rows") / block_rows)
        dealt = waiting.withColumn("last", blocks == 1).withColumn("block", F.pmod(F.xxhash64("deal", F.lit(depth)), blocks))
        done = written(dealt.groupBy("source", "block").applyInArrow(_flyer(depth), kind), "cube")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(done.filter(~fraction))
        rest = done.filter(fraction)
        if rest.isEmpty():
            break
        n = rest.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("left_rows"))
        waiting, depth = rest.join(n, F.col("source").eqNullSafe(F.col("of"))).drop("of"), depth + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("row", "doc_id", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    most: int = 3,
    block_rows: int = 512,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row per document.

    Size: the text's words (null: 0). Each document of a source is taken target / source_size
    times: the whole part for certain, the fraction by the cube method, which balances
    the source's words and documents at once. Blocks of ``block_rows`` documents of a source fly
    apart, so a source of any size is split; the two units at most that each block leaves
    meet in further rounds, until one block per source is left, and only there the last
    two are rounded, with documents of that block changed where one long document is left over. Draws are seeded by ids and texts, and equal rows
    are told apart by their number only, so reruns agree however the rows are split over files.

    Null source: a source of its own, last. Sources whose words are 0 have target 0.
    Rows repeated whole are units of their own. Empty table: empty result; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("tie"), F.lit(0).cast("long").alias("mark"), F.col(source_col).cast("string").alias("source"), size.alias("size")
    ).withColumn("row", F.monotonically_increasing_id())
    return _copies(written(units, "mix-units"), weights, most, block_rows).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``; as :func:`mix`."""
    id_col, text_col, source_col = (options.pop(k, d) for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    size = F.coalesce(F.regexp_count(F.col(f"doc.`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    units = keyed.select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.xxhash64(f"doc.`{id_col}`", f"doc.`{text_col}`").alias("tie"),
        F.xxhash64(*[f"doc.`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]).alias("mark"),
        F.col(f"doc.`{source_col}`").cast("string").alias("source"), size.alias("size"),
    )
    copies = _copies(written(units, "mix-units"), options.get("weights", (5, 2, 1)), options.get("most", 3), options.get("block_rows", 512))
    return keyed.join(copies.filter("copies > 0").select("row", "copies"), "row").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
