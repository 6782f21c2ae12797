"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written


#: Components under this, up to 2,048 of them, cannot overflow 64 bits in a product.
SMALL = 1 << 26
LONG = (1 << 63) - 1


def _ints(column: pd.Series, scale: float) -> list[np.ndarray | None]:
    """Each vector as floor(scale * x), in Python's whole numbers if one is large; None if it or a component is null or not finite."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = None if v is None else scale * np.asarray([math.nan if c is None else c for c in v], dtype="float64")
        if x is None or not np.isfinite(x).all():
            out.append(None)
        elif len(x) <= 2048 and (np.abs(x) < SMALL).all():
            out.append(np.floor(x).astype("int64"))
        else:
            out.append(np.array([math.floor(c) for c in x.tolist()], dtype=object))
    return out


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller row."""
    if scores.dtype != object:
        return np.lexsort((rows, -scores))[:k]
    return np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k], dtype="int64")


class SortedLists:
    """A block of vectors with one list of them per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        at = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[at], vectors[at]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable")  # ascending, a column per dimension

    def top(self, query: np.ndarray, k: int, skip: int, depth: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of the k best but the vector with id ``skip``, ties to the smaller id.

        Sorted access goes down the lists of the query's non-zero dimensions together,
        from the end that the sign of the query's component favours, ``depth`` entries at
        first and then twice as many. Each vector met is scored in full by random access.
        No vector not yet met can score above the sum of |component| times the entry at the
        depth reached; the scan ends once that bound is below the kth score (at equality
        an unseen smaller id could still win the tie), or when the lists end.
        """
        n = len(self.ids)
        seen = np.zeros(n, dtype=bool)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        used = np.concatenate([down, up])
        if not len(used):
            rows = np.flatnonzero(self.ids != skip)[:k]
            return np.zeros(len(rows), dtype="int64"), rows
        best_s, best_r = np.empty(0, dtype=(self.vectors[:0, :1] * query[:1]).dtype), np.empty(0, dtype="int64")
        at = 0
        while at < n:
            to = min(n, at + depth)
            met = np.concatenate([self.lists[n - to : n - at, down].ravel(), self.lists[at:to, up].ravel()])
            fresh = np.zeros(n, dtype=bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            rows = np.flatnonzero(fresh)
            rows = rows[self.ids[rows] != skip]
            best_s = np.concatenate([best_s, self.vectors[rows] @ query])
            best_r = np.concatenate([best_r, rows])
            keep = _best(best_s, best_r, k)  # rows stand in the order of ids
            best_s, best_r = best_s[keep], best_r[keep]
            edge = np.concatenate([self.lists[n - to, down], self.lists[to - 1, up]])
            if len(best_s) == k and int(self.vectors[edge, used] @ query[used]) < best_s[-1]:
                break
            at, depth = to, depth * 2
        return best_s, best_r


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: float = 1024.0,
    block_rows: int = 16384,
    query_rows: int = 2048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k vectors of highest integer inner product with each query.

    Components are floor(scale * x). A candidate is any row with another id than the
    query's. Ties go to the smaller vec_id; fewer than k candidates are all returned.

    Candidates and queries are dealt over blocks by a hash of the id; each block of
    candidates builds its lists and answers each block of queries, and the blocks' k best
    are merged. A task holds ``block_rows`` + ``query_rows`` vectors on average, whatever
    the table's size, so the stated queries meet all rows block by block and no side is broadcast.

    Sums are exact at any size; a score beyond the range of a long is that range's end, and such scores tie.
    Vectors that are null or hold a null or a component that is not finite take no part,
    nor do rows with a null id; vectors of different lengths are read as padded with 0.
    Rows repeated whole count once; of rows that share an id each vector is a candidate. Empty tables:
    empty result; other columns are ignored.
    """
    cand = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null").distinct()
    asks = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null").distinct()
    n_block = max(1, math.ceil(vectors.count() / block_rows))
    n_ask = max(1, math.ceil(queries.count() / query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cand.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(n_block)).cast("int").alias("block"), every(n_ask).alias("ask"))
    right = asks.select("id", "v", every(n_block).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(n_ask)).cast("int").alias("ask"))

    def answer(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        vs, qs = _ints(rows["v"], scale), _ints(asked["v"], scale)
        ok = [i for i, v in enumerate(vs) if v is not None]
        wide = max([len(v) for v in [*vs, *qs] if v is not None], default=0)
        large = any(v is not None and v.dtype == object for v in [*vs, *qs])
        grid = np.zeros((len(ok), wide), dtype=object if large else "int64")
        for r, i in enumerate(ok):
            grid[r, : len(vs[i])] = vs[i]
        block = SortedLists(rows["id"].to_numpy()[ok], grid)
        out = []
        for i, q in zip(asked["id"], qs, strict=True):
            if q is None or not ok:
                continue
            scores, at = block.top(np.pad(q, (0, wide - len(q))), k, i)
            if large:
                scores = [max(-LONG, min(LONG, s)) for s in scores]
            out.append(pd.DataFrame({"query_id": i, "vec_id": block.ids[at], "score": np.array(scores, dtype="int64")}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    best = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInPandas(answer, "query_id long, vec_id long, score long")
    ranked = written(best, "topk").selectExpr(
        "query_id", "cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank", "vec_id", "score"
    )
    return ranked.filter(F.col("rank") <= k)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
