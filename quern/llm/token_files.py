"""Token ids in files: documents in order of their ids, cut into blocks that are range coded and checksummed each for itself.

A file is a magic number, its blocks, an index and a foot. A block: the number of its ids, of its bytes, CRC-32 of its ids (as
little-endian unsigned 32-bit numbers) and of its bytes, then the bytes. The index is an Arrow stream of each document's id and number of tokens; the
foot tells where it is. So a damaged block is found and costs no other, and a file can be read alone.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import range_coder
from quern.llm.common import give_back, partitions, place, written
from quern.llm.packing import END_ID, encoder

MAGIC = b"QIDS\x02\0\0\0"
HEAD = struct.Struct("<IIII")  # ids, bytes, CRC-32 of the ids, CRC-32 of the bytes
FOOT = struct.Struct("<QIIQQ8s")  # index: offset, bytes, CRC-32; documents, ids, magic
RUNS_KEPT, CHARS = 690_000, 10_000_000  # runs of characters that a Python worker remembers; characters that are cut into runs at a time
MANIFEST = "part int, path string, documents long, ids long, bytes long"


class Writer:
    """Writes one file: documents' ids go in, coded blocks go out, as many at a time as stand in ``lanes``."""

    def __init__(self, file: io.RawIOBase, block_ids: int, lanes: int):
        self.file, self.block_ids, self.lanes = file, block_ids, lanes
        self.held: list[np.ndarray] = []
        self.n_held = self.ids = self.documents = 0
        self.bytes = file.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        self.documents += 1
        if self.n_held >= self.block_ids * self.lanes:
            self._code(False)

    def _code(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        blocks = [ids[k : min(k + self.block_ids, end)] for k in range(0, end, self.block_ids)]
        for begin in range(0, len(blocks), self.lanes):
            some = blocks[begin : begin + self.lanes]
            for block, coded in zip(some, range_coder.encode(some), strict=True):
                self.bytes += self.file.write(HEAD.pack(len(block), len(coded), zlib.crc32(block), zlib.crc32(coded)))
                self.bytes += self.file.write(coded)
        self.held = [ids[end:].copy()]
        self.n_held = len(ids) - end

    def close(self, index: pa.Table) -> None:
        self._code(True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        body = sink.getvalue().to_pybytes()
        at = self.bytes
        self.bytes += self.file.write(body)
        self.bytes += self.file.write(FOOT.pack(at, len(body), zlib.crc32(body), self.documents, self.ids, MAGIC))


def read_index(file: io.RawIOBase, size: int) -> tuple[pa.Table, int]:
    """A file's index and where it begins; ValueError if it is damaged."""
    file.seek(size - FOOT.size)
    at, n, crc, documents, ids, magic = FOOT.unpack(file.read(FOOT.size))
    file.seek(at)
    body = file.read(n)
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("the index is damaged")
    index = pa.ipc.open_stream(body).read_all()
    if index.num_rows != documents or (index["n_tokens"].to_numpy().sum() if documents else 0) != ids:
        raise ValueError("the index does not match the foot")
    return index, at


def read_blocks(file: io.RawIOBase, end: int, lanes: int) -> Iterator[np.ndarray]:
    """The ids of each block of a file whose blocks end at ``end``; ValueError names a damaged one."""
    file.seek(0)
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a file of token ids")
    at = len(MAGIC)
    while at < end:
        heads, coded = [], []
        while at < end and len(heads) < lanes:
            heads.append(HEAD.unpack(file.read(HEAD.size)))
            coded.append(file.read(heads[-1][1]))
            if zlib.crc32(coded[-1]) != heads[-1][3]:
                raise ValueError(f"the block at {at} is damaged")
            at += HEAD.size + heads[-1][1]
        for head, ids in zip(heads, range_coder.decode(coded, [h[0] for h in heads]), strict=True):
            if zlib.crc32(ids) != head[2]:
                raise ValueError(f"the block of {head[0]} ids before {at} is damaged")
            yield ids


def _some(texts: pa.Array) -> Iterator[list[str]]:
    """Whole texts (null: empty), as many at a time as have ``CHARS`` characters."""
    held, n = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        n += len(held[-1])
        if n >= CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_token_files(
    docs: DataFrame, folder: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, block_ids: int = 2048, lanes: int = 4096
) -> DataFrame:
    """The manifest (part, path, documents, ids, bytes) of files below ``folder`` that hold all documents' token ids, each ending with id 1.

    Documents stand in ascending order of the id (null last; rows of one id by their text, in any order if that is equal too), over the
    files in order of ``part``. A folder of the shared one is made where none is given. It can be any place that Arrow's file systems reach from
    the executors. A task writes a file of its own name and only those of tasks that succeeded are in the manifest, so lost and repeated tasks leave
    nothing that is read. A task holds ``block_ids`` * ``lanes`` ids at most, and the ids and lengths of its documents.

    Null text counts as empty, so it is one end id. Texts are read whole; repeated rows are documents of their own, dealt over files however
    many they are. Empty table: empty manifest; other columns are ignored.
    """
    spark = docs.sparkSession
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    folder = (folder or place(spark, "token-ids")).rstrip("/")
    end = END_ID.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path, RUNS_KEPT), TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        with system.open_output_stream(f"{base}/{name}") as file:
            out = Writer(file, block_ids, lanes)
            batch = first
            while batch is not None:
                size = []
                for texts in _some(batch.column("text")):
                    for ids in encode.many(texts, end):
                        size.append(len(ids))
                        out.add(ids)
                keys.append(batch.column("doc_id"))
                sizes.append(np.array(size, "int64"))
                batch = next((b for b in batches if b.num_rows), None)
            out.close(pa.table({"doc_id": pa.chunked_array(keys), "n_tokens": np.concatenate(sizes)}))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "documents": [out.documents], "ids": [out.ids], "bytes": [out.bytes]})
        del out, keys, sizes
        give_back()

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("row")]
    dealt = given.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return written(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-files")


def read_token_files(manifest: DataFrame, id_type: str = "bigint", *, with_ids: bool = False, lanes: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of ``manifest``, read from them; with ``with_ids`` also ids (array of int).

    ``start``: ids of all documents before it, over all files in order. A file is read by one task; what reaches the driver is a
    number for each file. Every block is checked by its checksums. A damaged file is an error. Empty manifest: empty result.
    """
    spark = manifest.sparkSession
    before, total = [], 0
    for r in manifest.select("part", "path", "ids").orderBy("part").collect():  # a row per file
        before.append((r["path"], total))
        total += r["ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                yield from _documents(path, start, with_ids, lanes)
        give_back()

    files = spark.createDataFrame(before, "path string, start long").repartition(max(1, len(before)), "start") if before else spark.createDataFrame([], "path string, start long")
    return files.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _documents(path: str, start: int, with_ids: bool, lanes: int) -> Iterator[pa.RecordBatch]:
    """What a file holds, some thousands of documents or a million ids at a time."""
    system, name = _file_system(path)
    with system.open_input_file(name) as file:
        index, end = read_index(file, file.size())
        sizes = index["n_tokens"].to_numpy()
        keys = index["doc_id"].combine_chunks()
        at = 0  # documents that have gone out
        crc, ids, n = [], [], 0
        rest = np.empty(0, "uint32")
        blocks = read_blocks(file, end, lanes)

        def out(upto: int) -> pa.RecordBatch:
            length = sizes[at:upto]
            first = start + np.cumsum(length) - length
            columns = [keys.slice(at, upto - at), pa.array(first), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate(ids).astype("int32"))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for k, size in enumerate(sizes.tolist()):
            parts, need = [], size
            while need:
                if not len(rest):
                    rest = next(blocks)
                parts.append(rest[:need])
                need -= len(parts[-1])
                rest = rest[len(parts[-1]) :]
            value = 0
            for part in parts:
                value = zlib.crc32(part, value)
            crc.append(value)
            if with_ids:
                ids += parts
            n += size
            if n >= 1_000_000 or len(crc) >= 10_000 or k + 1 == len(sizes):
                yield out(k + 1)
                start, at, n, crc, ids = start + int(sizes[at : k + 1].sum()), k + 1, 0, [], []
        if len(rest) or next(blocks, None) is not None:
            raise ValueError(f"{path} holds more ids than its index")
