"""Best-fit packing of tokenised documents into sequences, with lower bounds that certify it."""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import remembered, written

END_ID = 1


def _lowered() -> bytes:
    """Latin-1 in lower case: a to z, and its letters from 0xC0 to 0xDE but the sign at 0xD7."""
    return bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))


class RunIds(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of lower-case runs: of letters, of other characters, a digit or an apostrophe's ending.

    The tokenizer lower-cases a text and cuts it into such runs, each of which goes through its
    merges for itself. So a text of printable ASCII, Latin letters and white space is cut here,
    as Latin-1 bytes, by one expression, and a run is encoded when it is first met and remembered; the memory is
    bounded, and runs too long to come again are not kept. Texts with any other character, or with what could be a
    special token, go through the tokenizer word by word, since it never joins across white space.
    """

    #: Letters of Latin-1 are composed and have their own lower case there.
    PLAIN = bytes([*range(9, 14), *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
    LOWER = _lowered()
    RUNS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9\x09-\x0d ]+")
    #: The same for many texts at once: white space is a blank, and each byte has its kind.
    BLANKED = bytes(32 if 9 <= c <= 13 else x for c, x in enumerate(LOWER))
    LETTER, DIGIT, OTHER = 1, 2, 3
    KINDS = bytes(0 if c == 32 else 1 if 97 <= c <= 122 or 0xDF <= c != 0xF7 else 2 if 48 <= c <= 57 else 3 for c in range(256))
    ENDED = b"\x01"  # in no plain text; stands after each

    def __init__(self, path: str, keep: int = 300_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer, self.keep, self.longest, self.words = Tokenizer.from_file(path), keep, longest, {}
        self.merges = self.tokenizer.model
        if hasattr(self.merges, "_resize_cache"):
            self.merges._resize_cache(0)  # this memory stands in front of its own
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: "".join(t for t, _ in as_bytes.pre_tokenize_str(chr(c))) for c in range(0xC0, 0x100)}

    def __missing__(self, run: bytes) -> bytes:
        four = self.four
        symbols = run.decode() if run.isascii() else run.decode("latin-1").translate(self.letters)
        found = b"".join([four[t.id] for t in self.merges.tokenize(symbols)])
        if len(run) <= self.longest:
            if len(self) >= self.keep:
                self.clear()
            self[run] = found
        return found

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def as_plain(self, text: str) -> bytes | None:
        """A text of plain characters as Latin-1; None for any other."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, self.PLAIN) or b"<|" in raw else raw

    def plain(self, text: str) -> bytes | None:
        """The ids of a text of plain characters; None for any other."""
        if (raw := self.as_plain(text)) is None:
            return None
        return b"".join(map(self.__getitem__, self.RUNS.findall(raw.translate(self.LOWER))))

    def word(self, word: str) -> bytes:
        if (found := self.words.get(word)) is None:
            if (found := self.plain(word)) is None:
                found = self.whole(word)
            if len(word) <= self.longest:
                if len(self.words) >= self.keep // 4:
                    self.words.clear()
                self.words[word] = found
        return found

    def _cut(self, raw: bytes) -> tuple[np.ndarray, list[bytes]]:
        """Plain lower-case bytes with blanks, the last one of them, as runs: which of the distinct ones (of which one may be empty) stands at each place, and those."""
        text, kind = np.frombuffer(raw, "u1"), np.frombuffer(raw.translate(self.KINDS), "u1")
        starts = np.zeros(len(text), "?")
        starts[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)) & (kind[1:] != 0) & (kind[:-1] != 0)
        quote = np.flatnonzero(text[:-2] == 39)
        quote = quote[(quote == 0) | (kind[quote - 1] != self.OTHER)]
        one, two = text[quote + 1], text[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", "u1"))
        long = (two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108)
        starts[quote[short | long] + 1] = False
        for after in (quote[short] + 2, quote[long] + 3):  # at most the last blank
            starts[after] = kind[after] != 0
        starts = np.flatnonzero(starts)
        body = np.insert(text, starts, 32)
        del kind, starts
        places = np.concatenate([[0], np.flatnonzero(body == 32) + 1])
        offsets, kept = (pa.int32(), pa.binary()) if len(body) < 1 << 31 else (pa.int64(), pa.large_binary())
        runs = pa.Array.from_buffers(kept, len(places) - 1, [None, pa.array(places, offsets).buffers()[1], pa.py_buffer(body)]).dictionary_encode()
        _, ends, held = runs.dictionary.buffers()
        size = np.frombuffer(ends, "i4" if offsets == pa.int32() else "i8")[len(runs.dictionary)]
        return runs.indices.to_numpy(), held.slice(0, size).to_pybytes().split(b" ")[:-1]

    @cached_property
    def _merging(self) -> tuple[object, np.ndarray]:
        """A tokenizer of the merges alone, over symbols between blanks, and which ids end a word."""
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        bare = Tokenizer(self.merges)
        bare.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, "?")
        last[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        return bare, last

    def _meet(self, runs: list[bytes]) -> list[bytes]:
        """The ids of distinct runs, which go through the merges together; a run's last token says so."""
        symbols = b" ".join(runs).decode("latin-1")
        for c in range(0xDF, 0x100):  # lower case; what they become has none of them
            symbols = symbols.replace(chr(c), self.letters[c])
        bare, last = self._merging
        ids = np.asarray(bare.encode_batch_fast([symbols], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(last[ids]) + 1)).tolist()
        if len(ends) != len(runs):
            raise ValueError("the tokenizer does not mark the ends of words")
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def many(self, texts: list[str], end: bytes) -> list[np.ndarray]:
        """The ids of each text and ``end`` after them; each distinct run of plain texts is looked up once."""
        raws = [self.as_plain(text) for text in texts]
        plain = [raw is not None for raw in raws]
        joined = b" ".join([*(part for raw in raws if raw is not None for part in (raw, self.ENDED)), b""]).translate(self.BLANKED) or b" "
        del raws
        place, runs = self._cut(joined)
        if len(self) >= self.keep:
            self.clear()
        self[b""], self[self.ENDED] = b"", end
        values = list(map(self.get, runs))
        fresh = [k for k, v in enumerate(values) if v is None]
        for k, found in zip(fresh, self._meet([runs[k] for k in fresh]) if fresh else [], strict=True):
            values[k] = found
            if len(runs[k]) <= self.longest:
                self[runs[k]] = found
        flat = np.frombuffer(b"".join(values), "<u4")
        number = "int32" if 4 * len(joined) + len(flat) < 1 << 31 else "int64"  # a character has four ids at most
        length = np.fromiter(map(len, values), number, len(values)) >> 2
        begin = np.cumsum(length, dtype=number) - length
        n = length[place]
        upto = np.cumsum(n, dtype=number)
        at = np.repeat(begin[place] - upto + n, n)
        at += np.arange(len(at), dtype=number)
        ids = flat.take(at)
        whole = iter(np.split(ids, upto[place == runs.index(self.ENDED)]) if self.ENDED in runs else [])
        return [next(whole) if is_plain else np.frombuffer(self.of(text) + end, "<u4") for text, is_plain in zip(texts, plain, strict=True)]

    def of(self, text: str) -> bytes:
        if (found := self.plain(text)) is not None:
            return found
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the tokenizer
            return self.whole(text)
        return b"".join(map(self.word, text.split()))


def encoder(path: str, keep: int = 300_000) -> RunIds:
    """This Python worker's encoder, kept over its tasks."""
    return remembered(f"{keep} runs {path}", lambda: RunIds(path, keep))


def token_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut at ``capacity`` only.

    Null text counts as empty, so each document has one id at least. Ids of any type, null or
    repeated, pass through; texts are read whole. Empty table: empty result; other columns are ignored.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for rows in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                row, piece, start, length, crc = [], [], [], [], []
                for r, text in enumerate(rows.column("text").to_pylist()):
                    ids = memoryview((encode.of(text) if text else b"") + end)
                    n = len(ids) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        row.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
                made = [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(cut, f"doc_id {dict(given.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def bin_bound(hist: np.ndarray, capacity: int) -> int:
    """Fewest bins for ``hist[n]`` pieces of each length n, by dual-feasible functions.

    A dual-feasible function never lets a full bin weigh more than 1, so the total of
    its values bounds the bins from below. Two families: lengths over C - t count as whole bins and
    those under t as nothing, for each t up to C / 2; and lengths rounded down to k-ths, for k
    up to 64, where multiples of C / (k + 1) keep their own share.
    """
    c = capacity
    x = np.arange(c + 1, dtype="int64")
    count, total = np.concatenate([[0], np.cumsum(hist)]), np.concatenate([[0], np.cumsum(hist * x)])
    t = np.arange(0, c // 2 + 1)
    weighed = (count[c + 1] - count[c - t + 1]) * c + total[c - t + 1] - total[t]
    best = int(-(-weighed.max() // c))
    k = np.arange(1, 65, dtype="int64")[:, None]
    steps = (k + 1) * x[None, :] // c
    exact = (k + 1) * x[None, :] % c == 0
    # times k (k + 1), to stay in whole numbers
    value = np.where(exact, steps * k, steps * (k + 1)) @ hist
    return max(best, int((-(-value // (k * (k + 1))[:, 0])).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the room left in each bin: longest first, each into the fullest bin that holds it.

    Bins stand in stacks by room; the set of rooms in use is one integer's bits, so the
    smallest room that is large enough is its lowest bit above the length.
    """
    where, offset = np.empty(len(lengths), dtype="int64"), np.empty(len(lengths), dtype="int64")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, left = 0, []
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(left)
            left.append(capacity)
        where[i], offset[i] = b, capacity - room
        left[b] = room - n
        if room - n:
            if not stacks[room - n]:
                rooms |= 1 << (room - n)
            stacks[room - n].append(b)
    return where, offset, np.asarray(left, dtype="int64")


def _packer(length_col: str, capacity: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs what a partition holds; ``open``: the row is to be dealt anew, if another round follows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("row")
        lengths = table[length_col].to_numpy()
        where, offset, left = best_fit_decreasing(lengths, capacity)
        certified = len(left) == bin_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        sequence = (np.int64(depth) << 58) + (np.int64(TaskContext.get().partitionId()) << 32) + where
        release = left[where] > (capacity // 256 if certified else 0)
        for name, column in (("sequence_id", sequence), ("offset", offset), ("open", release)):
            table = table.append_column(name, pa.array(column))
        yield from table.to_batches()

    return pack


def best_fit_pack(pieces: DataFrame, *, length_col: str = "length", capacity: int = 4096, part_rows: int = 50_000, rounds: int = 4) -> DataFrame:
    """``pieces`` with sequence_id and offset: packed into sequences of ``capacity`` at most.

    Pieces are dealt over partitions of ``part_rows`` on average by a hash of the row; each
    packs its own by best-fit decreasing and certifies its number of bins by a lower bound
    from dual-feasible functions. A partition over its bound has a gap and gives up all its bins that have room, a
    certified one only those with over 1/256 of room; what is given up is dealt over fewer partitions and packed again. That
    goes on until the whole number of sequences meets the bound of all lengths (from
    their counts: one row per length), until a round saves none, or for ``rounds`` rounds.

    Lengths are 1 to ``capacity``; rows repeated whole are packed one by one. Columns row,
    open, sequence_id and offset of the input are replaced. Empty table: empty result.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("row", "open", "sequence_id", "offset")]
    waiting = written(pieces.select(*[f"`{c}`" for c in names]).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = waiting.groupBy(F.col(length_col).alias("length")).count().collect()  # capacity rows at most
    counts = np.zeros(capacity + 1, dtype="int64")
    for r in hist:
        counts[r["length"]] = r["count"]
    bound = bin_bound(counts, capacity)
    inner = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    settled: list[DataFrame] = []
    done = None
    closed = 0  # sequences that stay as they are
    for depth in range(rounds):
        n = waiting.count()
        if not n:
            break
        dealt = waiting.repartition(max(1, math.ceil(n / part_rows)), F.xxhash64("row", F.lit(depth)))
        packed = written(dealt.mapInArrow(_packer(length_col, capacity, depth), f"{inner}, sequence_id long, offset long, open boolean"), "packed")
        bins = packed.select("sequence_id").distinct().count()
        if done is not None and bins >= done[1]:
            break  # the round before did as well
        if done is not None:
            settled.append(done[0].filter(~F.col("open")))
        done = (packed, packed.filter("open").select("sequence_id").distinct().count())
        closed += bins - done[1]
        if closed + done[1] <= bound or not done[1]:
            break
        waiting = packed.filter("open").select(*waiting.columns)
    if done is None:
        return waiting.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for more in settled:
        out = out.unionByName(more)
    return out.select(*names, "sequence_id", "offset")
