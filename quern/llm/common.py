"""What the corpus operators share: scratch tables, text rules, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, _UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_own: dict[str, str] = {}  # temporary folders of local sessions without a shared one, by application


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without one (a test) gets a temporary folder of its own, gone when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quern-scratch-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = _own[app]
    return found.rstrip("/")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Delete what :func:`written` has left of this application; results that were not written elsewhere go with it."""
    _delete(spark, _folder(spark))


_made: list[str] = []  # what `written` has written, in order


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes as tables of :func:`written` do."""
    _made.append(f"{_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs the tasks that it ran, not the
    stages before this table, and the rows are computed once however often they are read.
    """
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Deletes tables that :func:`written` makes from now on, when what is read from them has been written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.begin = spark, len(_made)

    def clear(self, keep_last: bool = False) -> None:
        """Delete them; with ``keep_last`` all but the newest."""
        end = len(_made) - keep_last
        for path in _made[self.begin : end]:
            _delete(self.spark, path)
        del _made[self.begin : end]


_memory: dict[str, object] = {}


def give_back() -> None:
    """Return what this Python worker has freed to the system, so that idle workers of an executor do not hold the peak of their last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def remembered(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker over its tasks (words met, a model); that of the operator before goes."""
    if name not in _memory:
        if _memory:
            _memory.clear()
            give_back()
        _memory[name] = make()
    return _memory[name]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reached.

    Alternates large-star and small-star steps until the edges stop changing, so the
    number of rounds grows with the logarithm of the longest path. A node's neighbours
    are never gathered: each step is a minimum per node and a join, and every round is
    a written table. Rows with a = b name a node without neighbours; nulls are dropped.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: each larger neighbour of u is joined to u's smallest neighbour. Small: so are u and its smaller ones."""
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.join(low, "a")
        if large:
            out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct()
    rounds = Scratch(edges.sparkSession)
    current = written(
        edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"))
    before = current.select(mark.alias("m")).first()["m"]
    while before["n"]:
        current = written(star(star(current, True), False), "edges")
        rounds.clear(keep_last=True)
        after = current.select(mark.alias("m")).first()["m"]
        if after == before:
            break
        before = after
    return nodes.join(current.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"), "node", "left").select(
        "node", F.coalesce("m", "node").alias("component")
    )


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``df`` with each row's number from 0 in the global ``order``.

    One range partitioning, then a count per partition; only those counts reach the driver.
    """
    spark = df.sparkSession
    laid = written(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(place, 33)
    before, rows = [(-1, 0)], 0
    for r in laid.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():
        before.append((r["part"], rows))
        rows += r["count"]
    ahead = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))  # a row per partition
    names = [F.col(f"`{c}`") for c in df.columns]
    return laid.join(ahead, part.cast("int") == F.col("__part")).select(*names, (F.col("__before") + F.col(place).bitwiseAND((1 << 33) - 1)).alias(place))
