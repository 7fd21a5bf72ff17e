"""Approximate nearest neighbours by collision-counting hashing (C2LSH, QALSH).

Vectors are dealt into blocks.  A block projects its vectors on ``projections`` random
lines and keeps each projection sorted.  For a query, a window around its own projection
widens on every line step by step (virtual rehashing: the radius grows by ``ratio``); a
vector whose place in the sorted projection is inside the window collides.  Vectors that collide on at least ``threshold`` of the
lines are candidates, and the widening stops when a block has ``verify`` times its size of
them (and no fewer than ``k``).  Candidates are verified by the exact inner product in
double precision; each query keeps its ``k`` best of all blocks.

Inner product becomes distance by one more coordinate, sqrt(M^2 - |x|^2); queries are
scaled to M and get 0 there.  As that coordinate only adds noise, a block's vectors are
dealt into bands whose lengths differ by ``BAND`` at most; each band has its own M, the
largest length in it, its own lines and its own candidates.

Queries travel to all blocks, a stated query set against all rows; more than
``query_rows`` of them travel in chunks.  Per query and block only ``k`` rows come back.
Work is queries times rows, at about a byte operation per line.

Defined results: vectors that are null, zero, or hold a null or non-finite component take
no part; vectors of different dimensions have no inner product, so each dimension is searched
on its own; products beyond the range of a double are infinite or zero, and tie (a sum of both infinities
counts as the smallest);
null ids take no part; of rows with equal vec_id one is kept (the
smallest vector); with fewer than ``k`` candidates a query gets them all; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCHEMA = "query_id long, vec_id long, score double"
BLOCK_ROWS = 8192
QUERY_ROWS = 65_536
#: Queries that are counted together.
BATCH = 32
#: Largest over smallest length in a band.
BAND = 1.1


def exponents(x: np.ndarray) -> np.ndarray:
    """The power of two that is next above each row's largest component."""
    return np.frexp(np.abs(x).max(axis=1))[1]


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; their squares never leave the range of a double on the way."""
    near = np.ldexp(x, -exponents(x)[:, None])
    return near / np.linalg.norm(near, axis=1, keepdims=True)


class Index:
    """Sorted projections of some vectors, and each vector's place in every one of them.

    The vectors are first scaled by one power of two, so that the longest is about 1 long.
    """

    def __init__(self, x: np.ndarray, projections: int, seed: int):
        if len(x) > 32_767 or projections > 255:
            raise ValueError("places and counts are kept in small integers")
        x = np.ldexp(x, -int(exponents(x).max()))
        length = np.linalg.norm(x, axis=1)
        self.x, self.longest = x, float(length.max())
        extra = np.sqrt(np.maximum(self.longest**2 - length**2, 0))
        self.lines = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, projections))
        on_line = (x @ self.lines[:-1] + extra[:, None] * self.lines[-1]).T
        order = np.argsort(on_line, axis=1)
        self.sorted = np.take_along_axis(on_line, order, axis=1)
        self.place = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.place, order, np.arange(len(x), dtype=np.uint16)[None], axis=1)

    def collisions(self, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """On how many lines each vector lies in the window of each query."""
        count = np.zeros((len(at), len(self.x)), np.uint8)
        for line, place, p in zip(self.sorted, self.place, at.T, strict=True):
            lo = np.searchsorted(line, p - radius).astype(np.uint16)
            width = np.searchsorted(line, p + radius, side="right").astype(np.uint16) - lo
            count += (place - lo[:, None]) < width[:, None]  # places below the window wrap around
        return count

    def candidates(self, q: np.ndarray, need: int, threshold: int, radius: float, ratio: float) -> tuple[list[np.ndarray], float]:
        """Per query the vectors that collide often enough, once at least ``need`` do; and the smallest radius used."""
        n = len(self.x)
        if need >= n:
            return [np.arange(n)] * len(q), radius
        at = (unit(q) * self.longest) @ self.lines[:-1]
        radii, open_ = np.full(len(q), radius), np.arange(len(q))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        while len(open_):
            often = self.collisions(at[open_], radii[open_]) >= threshold
            done = often.sum(1) >= need
            for k in np.flatnonzero(done):
                out[open_[k]] = np.flatnonzero(often[k])
            open_ = open_[~done]
            radii[open_] *= ratio
        return out, float(radii.min())


def bands(x: np.ndarray) -> list[np.ndarray]:
    """Places of the vectors of each band, in ascending order."""
    power = exponents(x)
    length = power + np.log2(np.linalg.norm(np.ldexp(x, -power[:, None]), axis=1))
    order = np.argsort(length, kind="stable")
    out, start = [], 0
    while start < len(order):
        end = np.searchsorted(length[order], length[order[start]] + np.log2(BAND), side="right")
        out.append(np.sort(order[start : max(end, start + 1)]))
        start = max(end, start + 1)
    return out


def _search(k: int, projections: int, share: float, verify: float, ratio: float, seed: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            x = left.column("vector").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
            asked = right.column("query_id").to_numpy()
            by = np.argsort(asked)
            queries = right.column("query").combine_chunks().flatten().to_numpy().reshape(len(asked), -1)[by]
            asked = asked[by]
            parts = []
            for rows in bands(x):
                index = Index(x[rows], projections, seed)
                need = max(k + 1, int(np.ceil(verify * len(rows))))
                parts.append([rows, index, need, max(float(index.sorted.std()) * 0.4, 1e-9)])
            threshold = max(1, int(np.ceil(share * projections)))
            for i in range(0, len(asked), BATCH):
                every = []
                for part in parts:
                    rows, index, need, radius = part
                    some, least = index.candidates(queries[i : i + BATCH], need, threshold, radius, ratio)
                    part[3] = least / ratio  # where the next batch starts to widen
                    every.append([rows[found] for found in some])
                some = [np.sort(np.concatenate(found)) for found in zip(*every, strict=True)]
                for query, q, found in zip(asked[i : i + BATCH], queries[i : i + BATCH], some, strict=True):
                    found = found[ids[found] != query]
                    score = x[found] @ q
                    score[np.isnan(score)] = -np.inf
                    if len(found) > k:
                        top = score >= np.partition(score, len(score) - k)[len(score) - k]
                        found, score = found[top], score[top]
                    best = np.lexsort((ids[found], -score))[:k]
                    out_q.append(np.full(len(best), query))
                    out_v.append(ids[found][best])
                    out_s.append(score[best])
        none = [np.zeros(0)]
        return pa.table([pa.array(np.concatenate([*out_q, *none]).astype(np.int64)), pa.array(np.concatenate([*out_v, *none]).astype(np.int64)), pa.array(np.concatenate([*out_s, *none]))], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    v = F.transform(vectors["embedding"], lambda x: x.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.select("vec_id", "vector")


def nearest(vectors: DataFrame, is_query, k: int = 20, projections: int = 96, share: float = 0.6, verify: float = 0.12, ratio: float = 1.25, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` largest inner products found per query.

    ``is_query`` is a condition on vec_id.  ``verify`` is the share of a block that is
    verified per query at least; recall grows with it.
    """
    rows = materialise(usable(vectors))
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    queries = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    chunks = max(1, -(-queries.count() // query_rows))
    rows, queries = rows.withColumn("dim", F.size("vector")), queries.withColumn("dim", F.size("query"))
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    data = data.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    found = data.groupBy("dim", "block", "chunk").cogroup(asked.groupBy("dim", "block", "chunk")).applyInArrow(_search(k, projections, share, verify, ratio, seed), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
