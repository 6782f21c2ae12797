"""Document fingerprints by locally consistent parsing: phrase names from deterministic coin tossing."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.common import partitions

U = np.uint64
LEVELS, KEPT_FROM, KEEP = 3, 2, 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _toss_table(kinds: int) -> np.ndarray:
    """[left, own] to the coin-tossing label of two different labels under ``kinds``."""
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    low = np.bitwise_count(((a ^ b) & -(a ^ b)) - 1)
    label = 2 * low + ((b >> low) & 1)
    return np.where((a == b) | (a >= kinds) | (b >= kinds), 0, label).astype("uint8").ravel()


_TOSS = _toss_table(128)
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype="uint64"))


def _parse(symbols: np.ndarray, first: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: (names, first) of the phrases of concatenated sequences; ``first`` marks where each sequence begins.

    Runs of a symbol become one, named by symbol and length, so neighbours differ. Coin
    tossing then labels each symbol by the lowest bit in which it differs from its left
    neighbour and that bit's value; four rounds leave labels under 6 that still differ
    between neighbours. A phrase begins where a label is less than both of its neighbours. A
    label depends on four symbols to the left, so away from its ends a substring is cut
    alike wherever it stands.
    """
    n = len(symbols)
    head = np.empty(n, dtype=bool)
    head[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=head[1:])
    head |= first
    at = np.flatnonzero(head)
    if len(at) < n:
        length = np.diff(at, append=n).astype("uint64")
        symbols, first = symbols[at], first[at]
        symbols = np.where(length > 1, _mix(symbols ^ (length << U(40)) ^ U(0x5BD1E995)), symbols)
        n = len(at)
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = symbols[first] ^ U(1)
    differ = symbols ^ left
    low = np.bitwise_count((differ & (~differ + U(1))) - U(1))
    label = (2 * low + ((symbols >> low.astype("uint64")) & U(1)).astype("uint8")).astype("uint8")
    for _ in range(3):
        before = np.empty(n, dtype="uint16")
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS[(before << 7) | label]
    begins = np.zeros(n, dtype=bool)
    if n > 2:
        begins[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:]) & ~first[2:]
    begins |= first
    at = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(at, np.diff(at, append=n))
    names = np.add.reduceat(_mix(symbols + U(level + 1)) * _POWERS[place & 63], at)
    return _mix(names), first[at]


def sketches(texts: list[str]) -> list[list[int]]:
    """Of each text the ``KEEP`` smallest of the distinct 32-bit names of its phrases at levels 2 and 3, ascending; empty for an empty text."""
    full = [k for k, t in enumerate(texts) if t]
    out: list[list[int]] = [[] for _ in texts]
    if not full:
        return out
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("uint64")
    first = np.zeros(len(joined), dtype=bool)
    first[np.cumsum([0] + [len(texts[k]) for k in full[:-1]])] = True
    keys = []
    for level in range(1, LEVELS + 1):
        joined, first = _parse(joined, first, level)
        if level >= KEPT_FROM:
            owner = np.cumsum(first).astype("uint64") - U(1)
            keys.append((owner << U(32)) | (_mix(joined ^ U(level)) >> U(32)))
    found = np.unique(np.concatenate(keys))
    owner = (found >> U(32)).astype("int64")
    at = np.searchsorted(owner, np.arange(len(full) + 1))
    for j, k in enumerate(full):
        out[k] = (found[at[j] : min(at[j + 1], at[j] + KEEP)] & U(0xFFFFFFFF)).tolist()
    return out


def likeness(a: list[int], b: list[int]) -> float:
    """Share of names that two texts have in common (Jaccard), from the smallest of both; two empty texts are alike."""
    if a == b:
        return 1.0
    x, y = set(a), set(b)
    lowest = sorted(x | y)[:KEEP]
    return len(x & y & set(lowest)) / len(lowest)


def fingerprint_text(sketch: list[int]) -> str:
    return "".join([f"{v:08x}" for v in sketch])


def document_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 30_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per document.

    A fingerprint has 8 hex digits for each of up to 64 phrase names (see :func:`sketches`).
    Edited: the text with its last n_chars // 3 code points replaced by the first as many
    (or all) of the next document's text. Documents follow each other by falling doc_id, null last; rows of
    one id by a hash of the text; after the last comes the first.

    Documents are dealt over ranges of that order, with a copy of each range's first row for
    the range before it, so that each task reads its rows in order and holds a
    few ten thousand characters or one text. The ranges' first keys are all that reaches the driver; a row's range is found among them by bisection.

    Null text counts as empty: no names, an empty fingerprint, alike only to another empty
    text. A single document is followed by itself. Repeated rows follow each other. Ids may be of any type that has an order. Empty
    table: empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    #: Falls where the order of documents rises: falling ids, nulls after them, then rising hashes.
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.bitwise_not(F.xxhash64("text")).alias("hash"))
    rows = rows.withColumn("key", key)
    laid = rows.select("key").repartitionByRange(partitions(spark), F.col("key").desc()).groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("key"))
    firsts = sorted((_comparable(r["key"]) for r in laid.collect()), reverse=True)  # a key per partition
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not firsts:
        return spark.createDataFrame([], schema)
    n = len(firsts)
    rising = firsts[::-1]

    @F.arrow_udf("struct<bucket: int, opens: boolean>")
    def place(keys: pa.Array) -> pa.Array:
        found = [_comparable((k["has"], k["id"], k["hash"])) for k in keys.to_pylist()]
        at = [bisect.bisect_left(rising, k) for k in found]  # so many ranges begin after the key
        opens = [a < n and rising[a] == k for a, k in zip(at, found, strict=True)]
        return pa.StructArray.from_arrays([pa.array([max(n - 1 - a, 0) for a in at], pa.int32()), pa.array(opens)], ["bucket", "opens"])

    own = F.struct(F.col("at.bucket").alias("bucket"), F.lit(False).alias("copy"))
    ahead = F.struct(F.pmod(F.col("at.bucket") + (n - 1), F.lit(n)).cast("int").alias("bucket"), F.lit(True).alias("copy"))
    dealt = (
        rows.withColumn("at", place("key"))
        .withColumn("to", F.explode(F.when(F.col("at.opens"), F.array(own, ahead)).otherwise(F.array(own))))
        .select("to.bucket", "to.copy", "key", "doc_id", "text")
        .repartitionById(n, "bucket")
        .sortWithinPartitions("bucket", "copy", F.col("key").desc())
        .select("bucket", "copy", "doc_id", "text")
    )
    return dealt.mapInArrow(_printer(chunk_chars, to_arrow_type(docs.schema[id_col].dataType)), schema)


def _comparable(key: tuple) -> tuple:
    """A key as a tuple that Python compares as Spark does: without its id if that is null; text by its UTF-8 bytes."""
    has, i, h = key
    return (bool(has), i.encode("utf-8", "surrogatepass") if isinstance(i, str) else i, int(h)) if has else (False, int(h))


def _printer(chunk_chars: int, kind: pa.DataType):
    def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Lists of rows in order; each begins with the last row of the one before."""
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= chunk_chars and len(held) > 1:
                    yield held
                    held, size = [row], len(row[3])
        if len(held) > 1:
            yield held

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_chunks(batches):
            pairs = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k][0] == rows[k + 1][0]]
            edited = []
            for k in pairs:
                text = rows[k][3]
                m = len(text) // 3
                edited.append(text[: len(text) - m] + rows[k + 1][3][:m])
            made = sketches([r[3] for r in rows])
            redone = sketches(edited)
            if not pairs:
                continue
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([rows[k][2] for k in pairs], kind),
                    "n_chars": pa.array([len(rows[k][3]) for k in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": [fingerprint_text(made[k]) for k in pairs],
                    "edited_fingerprint": [fingerprint_text(s) for s in redone],
                    "near_edited": [likeness(made[k], s) for k, s in zip(pairs, redone, strict=True)],
                    "near_next": [likeness(made[k], made[k + 1]) for k in pairs],
                }
            )

    return prints
