"""N-gram Jaccard join: an exact similarity join of shingle sets through count-vector R-trees.

Shingles are hashed into groups and a set's group counts are its point. For two sets, the
sum over groups of the smaller count bounds their overlap from above; boxes of points bound whole
subtrees the same way, and pairs that survive are verified on the shingles themselves.

One R-tree over a corpus would be visited almost everywhere: sets may differ by a
sixth of their size in any direction, and a box of unrelated points holds nearly every query. So there are
two kinds of small trees.

First a tree for each key of a partition that loses no pair. Shingles are dealt by hash into parts, more than a linked pair can
differ by, so such a pair agrees in some parts whole and shares a key, which names what a part holds (:class:`Classes`).
The trees find the pairs of a key that can link by the bound. Components of those pairs are the blocks: no link leaves one.

Then a tree for each block, whose pairs are verified. A set is in one block only, so its shingles are moved
once. Neither kind of tree returns pairs, but a spanning forest of them: no more rows than members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import MapType, VariantType

from quern.llm.common import connected_components, give_back, partitions, remembered, written

U = np.uint64
FAN = 16  # entries of an R-tree node
FLUSH = 1_000_000  # keys that a task holds before it sorts them
FULL = (1 << 16) - 1  # a count that stands for any number
FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(64)], dtype="uint64")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class WordHash(dict):
    """64-bit hash of a word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 200_000:
            self.clear()
        if len(word) <= 48:
            self[word] = h
        return h


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; of all its words if there are fewer; none without words.

    Words are what ASCII white space parts, with A-Z lower-cased: just what bytes do.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype="uint64")
    h = np.fromiter(map(remembered("word hashes", WordHash).__getitem__, found), dtype="uint64", count=len(found))
    k = min(n_words, len(h))
    out = np.full(len(h) - k + 1, k, dtype="uint64")
    for j in range(k):
        out += h[j : len(h) - k + 1 + j] * FACTORS[j % 64] + U(j)
    return np.unique(_mix(out))


class Classes:
    """Size classes, and for each the keys of which two linked sets share one at least.

    If the larger of two linked sets is of class k, they differ by ``most(k)`` shingles at
    most, hence in so many of m parts at most, and agree in the others. A key names the contents
    of some parts together: of all but ``most`` of eight parts where sets are small, of
    two parts in the next classes, of one where they are large. There m is larger than it has to be by a
    fifth, so that parts with no shingle or one, which say little, seldom have to be keys.
    """

    def __init__(self, percent: int, ratio: float = 1.6):
        self.percent = percent
        #: Two different sets that link have this many shingles at least.
        self.least = -(-percent // (100 - percent)) if percent < 100 else 1 << 40
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, int(self.lows[-1] * ratio)))
        self.plans: dict[int, tuple[int, np.ndarray | None, int]] = {}

    def levels(self, n: int) -> list[int]:
        """Classes under which a set of ``n`` shingles makes keys: its own, and those above in which a linked set can be."""
        k = int(np.searchsorted(self.lows, n, side="right")) - 1
        out = [k]
        while 100 * n >= self.percent * self.lows[out[-1] + 1]:
            out.append(out[-1] + 1)
        return out

    def most(self, k: int) -> int:
        """At J = p, sets of a and b differ by (1 - p) / (1 + p) (a + b), and a + b is less than twice the class's end."""
        return (100 - self.percent) * 2 * (self.lows[k + 1] - 1) // (100 + self.percent)

    def plan(self, k: int) -> tuple[int, np.ndarray | None, int]:
        """Parts of class ``k``, the groups of parts that are keys (None: each part), and by how many parts linked sets agree beyond one key's."""
        if k not in self.plans:
            d = self.most(k)
            if d <= 12:
                m, together, spare = (8, 8 - d, 0) if d <= 4 else (d + 3, 2, 1)
                self.plans[k] = m, np.array(list(combinations(range(m), together)), dtype="int64").reshape(-1, together), spare
            else:
                spare = max(3, d // 5)
                self.plans[k] = d + 1 + spare, None, spare
        return self.plans[k]


def keys(s: np.ndarray, classes: Classes) -> np.ndarray:
    """Keys of a set, for each of its classes and groups of parts: a hash of what those parts hold.

    If no more parts than the class can spare hold less than two shingles, those are no keys; else, if no more are empty, those.
    """
    out = []
    for k in classes.levels(len(s)):
        m, groups, spare = classes.plan(k)
        part = (s % U(m)).astype("int64")
        n = np.bincount(part, minlength=m)
        at = np.cumsum(n) - n
        label = np.where(n > 0, np.add.reduceat(_mix(s[np.argsort(part, kind="stable")]), np.minimum(at, len(s) - 1)), U(0))
        held = label if groups is None else label[groups].sum(axis=1, dtype="uint64")
        made = _mix(_mix(held + U(k + 1)) + np.arange(len(held), dtype="uint64"))
        for few in (2, 1) if spare else ():
            if (n < few).sum() <= spare:
                made = made[n >= few] if groups is None else made[(n >= few)[groups].any(axis=1)]
                break
        out.append(made)
    return np.concatenate(out)


def point(s: np.ndarray) -> bytes:
    """How many shingles each group holds, two bytes each; about four shingles a group, and from 64 to 4096 groups by a hash's first bits."""
    bits = min(12, max(6, (len(s) // 4).bit_length()))
    n = np.bincount((s >> U(64 - bits)).astype("int64"), minlength=1 << bits)
    return (n if n.max() < FULL else np.full(1 << bits, FULL)).astype("<u2").tobytes()


def grid_of(points: list[bytes]) -> np.ndarray:
    """Points as rows of counts, by the groups of the one that has fewest: groups that begin alike are added up."""
    width = min(map(len, points)) // 2
    rows = [np.frombuffer(p, "<u2") for p in points]
    return np.stack([r if len(r) == width else np.minimum(r.reshape(width, -1).sum(axis=1, dtype="int64"), FULL).astype("uint16") if r[0] < FULL else np.full(width, FULL, dtype="uint16") for r in rows])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the items joined with each of ``n`` items by the edges a - b."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)], dtype="int64")


def _runs(key: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, who) without repeats by key and who; whether each is its key's first; whether its key has others."""
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    fresh = first.copy()
    fresh[1:] |= who[1:] != who[:-1]
    key, who, first = key[fresh], who[fresh], first[fresh]
    several = ~first
    several[:-1] |= several[1:]
    return key, who, first, several


def _reader(n_words: int, classes: Classes, buckets: int, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass over the texts. Kind 0: a document, a = its set, b = the set's size, its point in ``blob``. Kind 1: a run of keys of one bucket in
    ``blob`` with one set each, a = their number, b = that of the sets there. Kind 2: a = a key that sets of this task share, b = one of them."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", id_type), ("body", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])

    def rows(kind: int, bucket: np.ndarray, **columns) -> pa.RecordBatch:
        n = len(bucket)
        full = {"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(np.full(n, kind), pa.int32())}
        return pa.RecordBatch.from_arrays([full.get(f.name, columns.get(f.name, pa.nulls(n, f.type))) for f in schema], schema=schema)

    def deal(names: np.ndarray, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, who, first, several = _runs(np.concatenate(held), np.repeat(np.arange(len(held)), list(map(len, held))))
        if several.any():
            yield rows(2, np.arange(several.sum()) % buckets, a=pa.array(key[several].astype("int64")), b=pa.array(names[who[several]]))
        key, who = key[first], who[first]
        bucket = ((key >> U(32)) * U(buckets)) >> U(32)
        cuts = [*np.flatnonzero(np.diff(bucket.astype("int64"), prepend=-1)).tolist(), len(key)]
        blobs, n_keys, n_sets = [], [], []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            used, at = np.unique(who[x:y], return_inverse=True)
            blobs.append(key[x:y].tobytes() + names[used].tobytes() + at.astype("<u2").tobytes())
            n_keys.append(y - x)
            n_sets.append(len(used))
        yield rows(1, bucket[cuts[:-1]].astype("int32"), a=pa.array(n_keys, pa.int64()), b=pa.array(n_sets, pa.int64()), blob=pa.array(blobs, pa.binary()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, None] = {}
        held: list[np.ndarray] = []
        size = turn = 0
        for batch in batches:
            for piece in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                names, sizes, points = [], [], []
                for text in piece.column("text").to_pylist():
                    s = shingles(text, n_words)
                    name = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None
                    names.append(name)
                    sizes.append(len(s))
                    points.append(None)
                    if len(s) >= classes.least and name not in met:
                        met[name] = None
                        points[-1] = point(s)
                        held.append(keys(s, classes))
                        size += len(held[-1])
                turn += 1
                yield rows(
                    0, (np.arange(len(names)) + turn) % buckets, doc_id=piece.column("doc_id"), body=piece.column("body"),
                    a=pa.array(names, pa.int64()), b=pa.array(sizes, pa.int64()), blob=pa.array(points, pa.binary()),
                )
                if size >= FLUSH or len(held) >= 60_000:
                    yield from deal(np.fromiter(met, dtype="int64", count=len(met)), held)
                    met, held, size = {}, [], 0
        if held:
            yield from deal(np.fromiter(met, dtype="int64", count=len(met)), held)
        del met, held
        give_back()

    return read


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kinds 0 and 2 as they are; of a bucket's runs of keys, held together, each key that several sets share, as kind 2."""
    columns = ["kind", "doc_id", "body", "a", "b", "blob"]
    held, schema = [], None
    for batch in batches:
        runs = np.asarray(batch.column("kind").to_numpy()) == 1
        schema = pa.schema([batch.schema.field(c) for c in columns])
        if not runs.all():
            yield batch.select(columns).filter(pa.array(~runs))
        mine = batch.filter(pa.array(runs))
        for n, m, blob in zip(*(mine.column(c).to_pylist() for c in ("a", "b", "blob")), strict=True):
            names = np.frombuffer(blob, "int64", m, 8 * n)
            held.append((np.frombuffer(blob, "uint64", n), names[np.frombuffer(blob, "<u2", n, 8 * n + 8 * m)]))
    if not held:
        return
    key, name, _, several = _runs(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
    held.clear()
    if n := int(several.sum()):
        made = {"kind": pa.array(np.full(n, 2), pa.int32()), "a": pa.array(key[several].astype("int64")), "b": pa.array(name[several])}
        yield pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)
    del key, name, several
    give_back()


class RTree:
    """Points packed into nodes of ``FAN``, in the order of a recursive halving; a node keeps the largest of each coordinate and its smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._tiled(points, sizes)
        hi, low = points[self.order], sizes[self.order]
        self.levels = [(hi, low)]
        while len(low) > FAN:
            at = np.arange(0, len(low), FAN)
            hi, low = np.maximum.reduceat(hi, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((hi, low))

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bulk load: halve at the median of the coordinate that varies most there, ties by size, until a node's worth is left."""
        out, todo = [], [np.arange(len(sizes))]
        while todo:
            at = todo.pop()
            if len(at) <= FAN:
                out.append(at)
                continue
            here = points[at].astype("float32")
            at = at[np.lexsort((sizes[at], here[:, int(here.var(axis=0).argmax())]))]
            half = -(-len(at) // (2 * FAN)) * FAN
            todo += [at[half:], at[:half]]
        return np.concatenate(out) if out else np.arange(0)

    def meet(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Members whose overlap with a set can reach the threshold by the summed coordinate minima."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            hi, low = self.levels[depth]
            most = np.minimum(np.minimum(point, hi[at]).sum(axis=1, dtype="int64"), size)
            at = at[most * (100 + percent) >= percent * (size + low[at])]
            if depth:
                at = (at[:, None] * FAN + np.arange(FAN)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return self.order[at]


def cell_pairs(grid: np.ndarray, size: np.ndarray, comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, linked: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of a set of ``left`` and one of ``right`` (positions) that join two components, found through an R-tree of ``right``.

    A pair is one that the bound lets link and, if ``linked`` is given (which of some sets a set links with), that does link. Not all
    pairs, but enough to join whatever they join; ``comp`` is changed to the components then reached. Candidates are
    verified a few at first and then twice as many, so that members of a large component are not verified one by one.
    """
    tree = RTree(grid[right], size[right])
    out = []
    for k in left.tolist():
        met = right[tree.meet(grid[k], int(size[k]), percent)]
        if left is right:
            met = met[met > k]
        met = met[comp[met] != comp[k]]
        some = 8
        while len(met):
            now, met = met[:some], met[some:]
            for c in (now if linked is None else linked(k, now)).tolist():
                if comp[c] != comp[k]:
                    out.append((k, c))
                    comp[comp == comp[c]] = comp[k]
            met = met[comp[met] != comp[k]]
            some *= 2
        if (comp == comp[0]).all():
            break
    return out


def cell_links(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """:func:`cell_pairs` verified on the sets themselves."""
    size = np.array(list(map(len, sets)))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(names), dtype=bool)

    def linked(k: int, met: np.ndarray) -> np.ndarray:
        own, n = flat[begin[k] : begin[k + 1]], size[met]
        mark[own] = True
        both = np.add.reduceat(mark[np.concatenate([flat[begin[c] : begin[c + 1]] for c in met.tolist()])].astype("int64"), np.cumsum(n) - n)
        mark[own] = False
        return met[both * (100 + percent) >= (n + size[k]) * percent]

    return cell_pairs(grid_of(list(map(point, sets))), size, comp, left, right, percent, linked)


CELL = ("block", "i", "j")


def _solver(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """x, y: the pairs of every cell (block, i, j), from rows sorted by cell and name; holds one batch and one cell.

    A cell has the sets of tile i and those of tile j, or of one tile if they are the same. With a column ``set`` (shingles, with ``comp``) its pairs are
    :func:`cell_links`, with ``point`` and ``size`` :func:`cell_pairs` by the bound only.
    """

    def solve(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        name = t["name"].to_numpy()
        fresh = np.flatnonzero(np.diff(name, prepend=name[0] - 1) != 0)  # a set read in several tasks comes several times
        t, name = t.take(fresh), name[fresh]
        tile, i, j = t["tile"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        verify = "set" in t.column_names
        comp = np.unique(t["comp"].to_numpy(), return_inverse=True)[1] if verify else np.arange(len(name))
        if not len(left) or not len(right) or comp.max() == 0:
            return name[:0], name[:0]
        if verify:
            found = cell_links([np.frombuffer(b, dtype="uint64") for b in t["set"].to_pylist()], comp, left, right, percent)
        else:
            found = cell_pairs(grid_of(t["point"].to_pylist()), t["size"].to_numpy(), comp, left, right, percent)
        at = np.array(found, dtype="int64").reshape(-1, 2)
        return name[at[:, 0]], name[at[:, 1]]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        made: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({c: np.concatenate([m[k] for m in made] or [np.empty(0, "int64")]) for k, c in enumerate("xy")})

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [batch.column(c).to_numpy() for c in CELL]
            new = np.zeros(batch.num_rows, dtype=bool)
            for v in cell:
                new[1:] |= v[1:] != v[:-1]
            if rest:
                new[0] = any(v[0] != rest[-1].column(c)[0].as_py() for v, c in zip(cell, CELL, strict=True))
            at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if new[a] and rest:
                    made.append(solve(pa.Table.from_batches(rest)))
                    rest = []
                if b > a:
                    rest.append(batch.slice(a, b - a))
            yield out()
            made = []
        if rest:
            made.append(solve(pa.Table.from_batches(rest)))
            yield out()

    return links


def _sets_of(texts: DataFrame, placed: DataFrame, n_words: int, broadcast_rows: int) -> DataFrame:
    """block, tile, name, set (its shingles' hashes) of every set of ``placed`` (name, body, block, tile), read anew from a text of it."""
    want = placed.select("body", "name", "block", "tile")
    if placed.count() <= broadcast_rows:
        want = F.broadcast(want)  # 32 bytes a row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for piece in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                fresh = []
                for r, name in enumerate(piece.column("name").to_pylist()):
                    if name not in seen:
                        fresh.append(r)
                        seen.add(name)
                        if len(seen) > 1_000_000:
                            seen.clear()
                piece = piece.take(pa.array(fresh, pa.int64()))
                got = [shingles(t, n_words).tobytes() for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in ("block", "tile", "name")), pa.array(got, pa.binary())], ["block", "tile", "name", "set"])

    return texts.select("text", "body").join(want, "body").mapInArrow(read, "block long, tile long, name long, set binary")


def _pairs(cells: DataFrame, percent: int, name: str) -> DataFrame:
    """x, y of :func:`_solver` over ``cells`` (block, i, j, tile, name, and what it reads)."""
    dealt = cells.repartition(partitions(cells.sparkSession), *CELL).sortWithinPartitions(*CELL, "name")
    return written(dealt.mapInArrow(_solver(percent), "x long, y long"), name)


def _links(cells: DataFrame, percent: int) -> DataFrame:
    return _pairs(cells.select(*CELL, "tile", "name", "comp", "set"), percent, "links")


def _blocks(passed: DataFrame, points: DataFrame, percent: int, cell_rows: int) -> DataFrame:
    """name, block: components of the pairs that share a key and can link by the bound."""
    every = written(passed.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("name")).distinct(), "key-members")
    # near copies meet under many keys; keys of the same sets say the same, and one of them is enough
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("name")).alias("h"), F.bit_xor(F.xxhash64(F.lit("set"), "name")).alias("g")]
    keep = every.groupBy("key").agg(*same).groupBy("n", "h", "g").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / cell_rows).alias("tiles"))
    dealt = every.join(keep, "key").withColumn("tile", F.pmod(F.xxhash64("name"), F.col("tiles")))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).join(points, "name")
    found = _pairs(cells.select(F.col("key").alias("block"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "name", "size", "point"), percent, "near-pairs")
    blocks = connected_components(found.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return blocks.select(F.col("node").alias("name"), F.col("component").alias("block"))


def _components(links: list[DataFrame]) -> DataFrame:
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    found = connected_components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return written(found.select(F.col("node").alias("name"), F.col("component").alias("comp")), "components")


def _wide(sets: DataFrame, members: DataFrame, links: list[DataFrame], percent: int) -> DataFrame:
    """Components when also the tiles of blocks (``members``: name, block, load) that have more than one are joined; adds to ``links``.

    First one set of each component stands for it, over and over while that finds links: a large group
    of near copies becomes one component at a cost that grows with its size. What is still apart after that is tried in full, tile by
    tile: tiles hold one component or only small ones, and two tiles of the same component are not tried.
    """
    parts = F.greatest(F.ceil("n"), F.lit(1)).cast("long")

    def apart(comps: DataFrame) -> DataFrame:
        m = members.join(comps, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
        several = m.groupBy("block").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).filter("p <> q").select("block")
        return m.join(several, "block")

    comps, turn = _components(links), 0
    while True:
        reps = apart(comps).groupBy("block", "comp").agg(F.min(F.struct("load", "name")).alias("r")).select("block", "comp", "r.*")
        reps = reps.join(reps.groupBy("block").agg(F.sum("load").alias("n")), "block")
        tile = F.pmod(F.xxhash64("name", F.lit(turn)), parts)
        cells = sets.select("name", "set").join(reps.select("block", "comp", "name", tile.alias("tile")), "name")
        found = _links(cells.withColumns({"i": F.col("tile"), "j": F.col("tile")}), percent)
        if found.isEmpty():
            break
        links.append(found)
        comps, turn = _components(links), turn + 1

    m = written(apart(comps), "apart")
    if m.isEmpty():
        return comps
    large = m.groupBy("block", "comp").agg(F.sum("load").alias("n")).filter("n >= 0.5").withColumn("own", F.col("comp"))
    m = m.join(large.select("block", "comp", "own"), ["block", "comp"], "left")
    m = m.join(m.groupBy("block", "own").agg(F.sum("load").alias("n")).select("block", F.col("own").alias("of"), "n"), "block").filter(F.col("own").eqNullSafe(F.col("of")))
    tiled = m.select("block", "comp", "name", "own", F.xxhash64("own", F.pmod(F.xxhash64("name", F.lit(-1)), parts)).alias("tile"))
    tiles = written(tiled.groupBy("block", "tile").agg(F.first("own").alias("own")), "tiles")
    a, b = (tiles.select("block", F.col("tile").alias(i), F.col("own").alias(f"own_{i}")) for i in "ij")
    pairs = a.join(b, "block").filter((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("own_i") == F.col("own_j"), F.lit(False)))
    cells = tiled.drop("own").join(pairs.select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile")), ["block", "tile"])
    links.append(_links(sets.select("name", "set").join(cells, "name"), percent))
    return _components(links)


def ngram_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, cell_rows: int = 1024, cell_shingles: int = 2_000_000, broadcast_rows: int = 500_000
) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, component (names it), body (hash of the text): a row per document.

    Two documents link if 100 * shared >= ``percent`` * all of their distinct word
    ``n_words``-grams; component_id is the smallest doc_id that links reach. Equal sets are one class, named by
    its smallest doc_id (class_id), and take part once. A document without words has no links and no class_id.

    The steps: a pass over the texts makes every class's keys and point; the keys that several classes share are found
    within a task and within a bucket of keys; R-trees of their points give the blocks (:func:`_blocks`). The shingles of classes that
    are not alone in their block go to its task, which joins them through an R-tree (:func:`cell_links`). Keys and blocks of
    more than ``cell_rows`` classes, or blocks of ``cell_shingles`` shingles, are dealt over tiles (:func:`_wide`), so no task holds a whole
    group, however large. No link that could join two components is left out.

    Ids may be of any type that has an order, and may repeat or be null; component_id ignores nulls unless all are. Null text counts
    as empty. Long texts are read whole. Empty table: empty result; other columns are ignored.
    Sets are compared by 64-bit hashes of shingles.
    """
    spark = docs.sparkSession
    classes = Classes(percent)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    id_type, n = texts.schema["doc_id"].dataType, partitions(spark)
    kind = id_type.simpleString()
    dealt = texts.mapInArrow(_reader(n_words, classes, n, to_arrow_type(id_type)), f"bucket int, kind int, doc_id {kind}, body long, a long, b long, blob binary")
    passed = written(dealt.repartitionById(n, "bucket").mapInArrow(_gather, f"kind int, doc_id {kind}, body long, a long, b long, blob binary"), "shingle-pass")
    rows = passed.filter("kind = 0").select("doc_id", "body", F.col("a").alias("name"), F.col("b").alias("size"))
    points = passed.filter("kind = 0 and blob is not null").groupBy(F.col("a").alias("name")).agg(F.first("b").alias("size"), F.first("blob").alias("point"))
    blocks = _blocks(passed, points, percent, cell_rows)
    load = F.greatest(F.lit(1.0 / cell_rows), F.col("size") / cell_shingles)
    members = rows.join(blocks, "name").groupBy("name").agg(F.first("block").alias("block"), F.first("size").alias("size"), F.min("body").alias("body")).withColumn("load", load)
    members = written(members, "members")
    tiles = members.groupBy("block").agg(F.ceil(F.sum("load")).cast("long").alias("tiles"))
    placed = written(members.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("name"), F.col("tiles"))), "placed")
    sets = written(_sets_of(texts, placed, n_words, broadcast_rows), "sets")
    links = [_links(sets.withColumns({"i": F.col("tile"), "j": F.col("tile"), "comp": F.col("name")}), percent)]
    wide = placed.filter("tiles > 1").select("name", "block", "load")
    comps = _components(links) if wide.isEmpty() else _wide(sets, wide, links, percent)

    full = written(rows.join(comps, "name", "left").withColumn("comp", F.coalesce("comp", "name")), "documents")
    known = full.filter("name is not null")
    low = known.groupBy("comp").agg(F.min("doc_id").alias("low"))
    own = known.groupBy("name").agg(F.min("doc_id").alias("own"))
    return full.join(low, "comp", "left").join(own, "name", "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
        F.col("own").alias("class_id"), F.col("comp").alias("component"), "body",
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one document of each group of :func:`ngram_components`, with the same columns.

    The one with the smallest id stays (of rows that share it, that of the smallest text hash; if they share that too, that of the smallest hash of all other columns). Documents
    without words are no group and stay, repeated rows of them too; a null id is after all others.
    """
    named = ngram_components(docs, id_col=id_col, text_col=text_col, **options)
    grouped = named.filter("component is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("body").alias("body"))
    first = grouped.groupBy("component").agg(F.min(place).alias("k")).select("k.doc_id", "k.body").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("its"), F.xxhash64(text_col).alias("text_hash"), F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[\x09-\x0D]", " ")).alias("t"))
    bare = keyed.filter("t = ''").select("row.*")
    kept = keyed.filter("t <> ''").join(first, F.col("its").eqNullSafe(F.col("doc_id")) & (F.col("text_hash") == F.col("body")), "left_semi")
    others = [f"row.`{f.name}`" for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return kept.groupBy("its", "text_hash").agg(F.min_by("row", F.xxhash64(*others)).alias("row")).select("row.*").unionByName(bare)


#: The query's rows in SQL: an inverted index of shingles, and components by recursion. {n} words a shingle, {percent} to link.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[k : k + {n} - 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {n} + 1, least(len(w), 1)) + 1)) AS k FROM d)
), size AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY r),
class AS (SELECT h, any_value(n) AS n, min(r) AS r FROM size GROUP BY h),
t AS (SELECT s.r, s.g, class.n FROM s JOIN class ON s.r = class.r),
pair AS (
  SELECT a.r AS x, b.r AS y FROM t a JOIN t b ON a.g = b.g AND a.r < b.r AND 100 * b.n >= {percent} * a.n AND 100 * a.n >= {percent} * b.n
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), edge AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
reach AS (
  SELECT r AS x, r AS y FROM class UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x
), root AS (SELECT x AS r, min(y) AS root FROM reach GROUP BY x),
named AS (SELECT d.r, d.doc_id, size.n, size.h, root.root FROM d LEFT JOIN size ON d.r = size.r LEFT JOIN class ON size.h = class.h LEFT JOIN root ON class.r = root.r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id,
       CASE WHEN root IS NOT NULL THEN min(doc_id) OVER (PARTITION BY h) END AS class_id
FROM named
"""
