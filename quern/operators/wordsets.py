"""Frames as sets of word numbers, and pairs of alike sets: what is written and moved stays in proportion to the frames, however many pairs there are.

A word is its 64-bit hash; results are exact but for two words of one hash. Words that many frames hold are numbered by how many, the others come
before them by hash, so a set is a sorted array of numbers that begins with its rarest words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from quern.functions import text as tx
from quern.sources.scratch import dealt, settled

# Words numbered by frequency, pairs that a task forms at once, first words of sets that meet in one round, sets of a tile's side,
# and of how many shared words one more must be among the first
FREQUENT = 1 << 19
AT_ONCE = 1 << 20
ROUND = 16_000_000
TILE = 512
MORE = 32
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def freed(df: DataFrame, name: str) -> DataFrame:
    """``settled``, and the shuffle files of the steps before go once it is written."""
    conf = df.sparkSession.conf
    was = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        return settled(df, name)
    finally:
        conf.unset(FREED) if was is None else conf.set(FREED, was)


def _frequent(hashes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words in most frames, and the place of each by number of frames."""
    counted = freed(hashes.select(F.explode("hs").alias("w")).groupBy("w").agg(F.count("*").alias("df")), "words")
    least, seen = None, 0
    for r in counted.groupBy(F.least("df", F.lit(1 << 16)).alias("df")).agg(F.count("*").alias("n")).orderBy(F.col("df").desc()).collect():
        seen += r["n"]
        if seen > FREQUENT:
            break
        least = r["df"]
    if least is None:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    got = counted.filter(F.col("df") >= least).toArrow()
    w, df = (got[c].to_numpy() for c in ("w", "df"))
    place = np.empty(len(w), "int64")
    place[np.lexsort((w, df))] = np.arange(len(w))
    by = np.argsort(w)
    return w[by], place[by]


def _numbered(known, least: int, schema: pa.Schema) -> Callable:
    """Batches of (id, hs) in; id, size, digest, m (64 bits of the set) and ws out, without ws if there are fewer than ``least``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, place = known.value
        for batch in batches:
            hs = batch.column("hs")
            flat = hs.flatten().to_numpy()
            ends = np.cumsum([0, *hs.value_lengths().fill_null(0).to_pylist()])
            k = flat | np.int64(-(1 << 63))
            if len(w):
                at = np.minimum(np.searchsorted(w, flat), len(w) - 1)
                k = np.where(w[at] == flat, place[at], k)
            bits = np.int64(1) << (k & 63)
            sets, digests, marks = [], [], []
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                one = k[i:j]
                one.sort()
                sets.append(one if j - i >= least else None)
                digests.append(hashlib.blake2b(one.tobytes(), digest_size=16).digest())
                marks.append(int(np.bitwise_or.reduce(bits[i:j])) if j > i else 0)
            made = [batch.column("id"), np.diff(ends), digests, marks, sets]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return number


def word_sets(frames: DataFrame, min_tokens: int) -> DataFrame:
    """id, size, digest, m, ws of frames (id, body), written: the set of words of three characters or more as sorted numbers, null if there are fewer than ``min_tokens``. Sets are equal if their digests are."""
    hashes = frames.select("id", F.transform(F.array_distinct(tx.words(F.coalesce("body", F.lit("")), 3)), lambda w: F.xxhash64(w)).alias("hs"))
    known = frames.sparkSession.sparkContext.broadcast(_frequent(hashes))
    out = StructType([hashes.schema["id"], StructField("size", IntegerType()), StructField("digest", BinaryType()), StructField("m", LongType()), StructField("ws", ArrayType(LongType()))])
    return freed(hashes.mapInArrow(_numbered(known, min_tokens, to_arrow_schema(out)), out), "sets")


def _rounds(classes: DataFrame, kept, least: float) -> list[tuple[int, int, int]]:
    """(lo, hi, rows): pairs whose larger set has over ``lo`` and up to ``hi`` words meet in one round, in which so many first words of sets take part, about ROUND."""
    step = F.floor(F.log("size") * 64)
    sizes = classes.groupBy(step.alias("g")).agg(F.max("size").alias("hi"), F.sum(kept).alias("rows")).orderBy("g").collect()
    out, lo = [], 0
    for k, r in enumerate(sizes):
        rows = lambda to: sum(x["rows"] for x in sizes[: to + 1] if x["hi"] >= lo * least)  # noqa: E731, B023
        if k + 1 == len(sizes) or rows(k + 1) > ROUND:
            out.append((lo, r["hi"], rows(k)))
            lo = r["hi"]
    return out


def _meeting(least: float, lo: int) -> Callable:
    """Rows (w, size, pos, c) in order of w and size in; a, b and n (the shared words that both need) of the pairs of each word that are near enough in size and place out."""

    def met(w: np.ndarray, size: np.ndarray, pos: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.r_[True, w[1:] != w[:-1]]
        group = np.cumsum(first) << 32
        most = np.minimum(np.floor(size / least + 1e-9), (1 << 32) - 1).astype("int64")
        many = np.maximum(np.searchsorted(group + size, group + most, side="right") - np.arange(len(w)) - 1, 0)
        before = np.r_[0, np.cumsum(many)]
        at = 0
        while at < len(w):
            to = max(at + 1, int(np.searchsorted(before, before[at] + AT_ONCE, side="right")) - 1)
            a = np.repeat(np.arange(at, to), many[at:to])
            b = a + 1 + np.arange(len(a)) - (before[a] - before[at])
            need = np.ceil((size[a] + size[b]) * (least / (1 + least)) - 1e-9).astype("int64")
            ok = (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= need - need // MORE) & (size[b] > lo)
            if ok.any():
                x, y = c[a[ok]], c[b[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array((1 + need[ok] // MORE).astype("int32"))], names=["a", "b", "n"])
            at = to

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, "int64")] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            held = [np.concatenate([x, batch.column(k).to_numpy().astype("int64")]) for k, x in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on
            if cut:
                yield from met(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        yield from met(*held)

    return meet


def _candidates(classes: DataFrame, least: float) -> DataFrame | None:
    """a, b: pairs of classes (c, size, ws) that share enough of their first words.

    Two sets that share n words, in one order of words, have l of them among all but the last n - l of each; l is 1 + n / MORE, so that pairs of few rare words in common go no further.
    """
    need = F.ceil(F.col("size") * F.lit(least) - 1e-9)
    kept = F.col("size") - need + F.floor(need / MORE) + 1
    found = None
    for lo, hi, rows in _rounds(classes, kept, least):
        near = classes.filter((F.col("size") <= hi) & (F.col("size") >= math.floor(lo * least)))
        keys = near.select("c", "size", F.posexplode(F.slice("ws", F.lit(1), kept.cast("int"))).alias("pos", "w")).select("w", "size", "pos", "c")
        hits = dealt(keys, rows, "w", each=1_000_000).sortWithinPartitions("w", "size").mapInArrow(_meeting(least, lo), "a long, b long, n int")
        got = freed(hits.groupBy("a", "b", "n").agg(F.count("*").alias("k")).filter("k >= n").select("a", "b"), "near")
        found = got if found is None else found.unionByName(got)
    return found


def _shared(schema: pa.Schema) -> Callable:
    """Rows in order of tile, its sets (x, ws) before its pairs (a, b), in; the pairs with the number of words they share out."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, {}
        for batch in batches:
            rows, both = [], []
            for k, (t, x, ws, a, b) in enumerate(zip(*(batch.column(c).to_pylist() if c != "ws" else batch.column(c) for c in ("t", "x", "ws", "a", "b")), strict=True)):
                if t != at:
                    at, sets = t, {}
                if x is not None:
                    sets[x] = frozenset(ws.values.to_numpy().tolist())
                else:
                    rows.append(k)
                    both.append(len(sets[a] & sets[b]))
            if rows:
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in schema.names[:-1]), pa.array(both, pa.int64())], schema=schema)

    return share


def alike(docs: DataFrame, least: float) -> DataFrame:
    """a, b, n_a, n_b, s of ``word_sets``: pairs of classes of equal sets, each named by its smallest id, that have a Jaccard of ``least``.

    Sets meet in tiles, to which each is sent once: a tile has those near one class, TILE of each side at most. 64 bits of each set rule out pairs before.
    """
    large = docs.filter("ws is not null")
    named = large.select("id", "digest").distinct().groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    held = large.groupBy("digest").agg(F.first("size").alias("size"), F.first("m").alias("m"), F.first("ws").alias("ws"))
    classes = freed(held.join(named, "digest").select("id", "n", "size", "m", "ws", F.monotonically_increasing_id().alias("c")), "classes")
    place = F.col("c").bitwiseAND((1 << 33) - 1)
    each = (classes.agg(F.max(place)).first()[0] or 0) + 1
    classes = classes.withColumn("c", F.shiftright("c", 33) * F.lit(each) + place)  # small numbers, which take less room in shuffles
    near = _candidates(classes, least)
    if near is None:
        near = classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    ends = near.select(F.col("a").alias("c"), F.col("b").alias("o")).unionByName(near.select(F.col("b").alias("c"), F.col("a").alias("o")))
    led = freed(ends.groupBy("c").agg(F.min("o").alias("o")).select("c", F.least("c", "o").alias("lead")), "led")
    sides = led.join(led.groupBy("lead").agg(F.count("*").alias("many")), "lead").select("c", F.xxhash64("lead", F.pmod(F.xxhash64("c"), F.ceil(F.col("many") / TILE))).alias("p"))
    sides = freed(classes.select("c", "id", "n", "size", "m").join(sides, "c"), "sides")
    side = lambda s: sides.select(F.col("c").alias(s), *(F.col(x).alias(f"{x}_{s}") for x in ("p", "id", "n", "size", "m")))
    tiled = near.join(side("a"), "a").join(side("b"), "b").withColumn("t", F.xxhash64(F.least("p_a", "p_b"), F.greatest("p_a", "p_b"))).drop("p_a", "p_b")
    tiled = freed(tiled, "tiles")
    sent = freed(tiled.select("t", F.explode(F.array("a", "b")).alias("x")).distinct().join(classes.select(F.col("c").alias("x"), "ws"), "x"), "sent")
    lacks = lambda x, y: F.bit_count(F.col(f"m_{x}").bitwiseAND(F.bitwise_not(F.col(f"m_{y}"))))
    most = F.least(F.col("size_a") - lacks("a", "b"), F.col("size_b") - lacks("b", "a"))  # no more can be shared
    pairs = tiled.filter(most >= (F.col("size_a") + F.col("size_b")) * (least / (1 + least)) - 1e-9).drop("m_a", "m_b")
    rows = pairs.unionByName(sent, allowMissingColumns=True)
    out = StructType([*(f for f in pairs.schema if f.name not in ("t", "a", "b")), StructField("i", LongType())])
    tiles = dealt(rows, tiled.count() + sent.count(), "t", each=200_000).sortWithinPartitions("t", F.col("x").asc_nulls_last())
    j = tiles.mapInArrow(_shared(to_arrow_schema(out)), out).withColumn("s", F.col("i") / (F.col("size_a") + F.col("size_b") - F.col("i"))).filter(F.col("s") >= least)
    first = F.col("id_a") < F.col("id_b")
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return j.filter(F.col("id_a") != F.col("id_b")).select(pick("id_a", "id_b", "a"), pick("id_b", "id_a", "b"), pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b"), "s")
