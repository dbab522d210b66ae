"""Nearest neighbours by collision counting over single projections, with virtual rehashing.

Each row is projected on ``PROJECTIONS`` random directions, one number each; an index holds, for each direction,
the sorted numbers of a chunk of at most about ``CHUNK_ROWS`` rows. A query opens a window centred on its own number in
each sorted array and widens it step by step (virtual rehashing: wider windows are coarser buckets of the same
arrays). A row at distance r falls in a window of half-width ``REACH`` * r with a chance that the normal distribution
gives; ``threshold`` is the number of windows that such a row is counted in but for ``MISS`` of the cases. A row counted
so often is verified by its exact distance. A query stops widening when its windows are ``REACH`` times as wide as
its k-th nearest verified row is far, and never widens them beyond that: so rows much farther are not verified.

Each chunk goes to one task, in which its index is built once; the query set then streams past it, and the k nearest
of a query are merged over the chunks. Every row is indexed; nothing is fitted.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite numbers take no part, as rows or as
queries; vectors are compared with those of as many numbers only; equal distances go to the smaller id; repeated
rows are rows of their own; the query's own row is no neighbour (by id); null ids take no part; other columns are
ignored; an empty table gives no rows; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS, PROJECTIONS, REACH, MISS = 16_384, 160, 1.2, 0.22
#: How much wider the windows get in a step.
STEP = 1.3


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Index:
    """The sorted arrays of one chunk."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, projections: int = PROJECTIONS, seed: int = 7):
        self.ids, self.rows, self.m = ids, rows, projections
        self.directions = np.random.Generator(np.random.PCG64(seed)).standard_normal((projections, rows.shape[1]))
        p = rows @ self.directions.T
        self.order = np.argsort(p, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(p, axis=0).T.copy()
        # All arrays one after the other, each moved past the one before, so that one search looks in all.
        self.shift = np.arange(projections) * (4 * float(np.abs(p).max(initial=0)) + 1)
        self.line = (self.sorted + self.shift[:, None]).ravel()
        chance = math.erf(REACH / math.sqrt(2))
        self.threshold = max(t for t in range(1, projections + 1) if t == 1 or _binomial_tail(projections, t, chance) >= 1 - MISS)

    def nearest(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, distances) of the k nearest found, nearest first, ties to the smaller id; the number of rows verified."""
        centre, n = self.directions @ q, len(self.ids)
        # What lies beyond all numbers is moved to the end of its array.
        far, begin = float(np.abs(self.sorted).max(initial=0)) * 1.5 + 0.25, np.arange(self.m) * n

        def place(x: np.ndarray, side: str = "left") -> np.ndarray:
            return np.searchsorted(self.line, np.clip(x, -far, far) + self.shift, side) - begin

        at = place(centre)
        lo, hi = at.copy(), at.copy()
        count, done = np.zeros(n, np.int64), np.zeros(n, bool)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        # The first window holds about 2 k rows of each array.
        ends = np.minimum(at + k, n - 1), np.maximum(at - k, 0)
        width = float(np.median([self.sorted[j, ends[0][j]] - self.sorted[j, ends[1][j]] for j in range(self.m)])) / 2 or 1e-9
        while True:
            a, b = np.minimum(lo, place(centre - width)), np.maximum(hi, place(centre + width, "right"))
            new = np.concatenate([self.order[j, x:y] for j in range(self.m) for x, y in ((a[j], lo[j]), (hi[j], b[j])) if x < y] or [at[:0]])
            lo, hi = a, b
            if len(new):
                count += np.bincount(new, minlength=n)
                found = np.flatnonzero((count >= self.threshold) & ~done)
                done[found] = True
                found = found[self.ids[found] != query_id]
                d = np.sqrt(((self.rows[found] - q) ** 2).sum(1))
                ids, dist = np.concatenate((ids, self.ids[found])), np.concatenate((dist, d))
                keep = np.lexsort((ids, dist))[:k]
                ids, dist = ids[keep], dist[keep]
            most = REACH * dist[-1] if len(ids) >= k else math.inf
            if most <= width or (hi - lo == n).all():
                return ids, dist, int(done.sum())
            width = min(STEP * width, most)


def _binomial_tail(n: int, least: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least, n + 1))


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of the rows where is_query is true among all other rows."""
    v = F.col("v")
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
        .where(F.col("id").isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
        .withColumn("v", F.transform(v, lambda x: x.cast("double")))
        .withColumn("dim", F.size("v"))
    )
    chunks = max(1, -(-rows.count() // chunk_rows))
    placed = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    asked = rows.where("q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("s")).select("s.dim", "id", "s.v")  # of repeated query ids, the least vector asks
    # A stated query set against all rows: each chunk meets each query once.
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(True).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            for (dim, chunk, asks), own in _parts(batch):
                if (dim, chunk) != at:
                    at, held, index = (dim, chunk), [], None
                ids, v = own.column("id").to_numpy(), _matrix(own.column("v"))
                if not asks:
                    held.append((ids, v))
                    continue
                if index is None and held:
                    index = Index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held = []
                out = [(i, *index.nearest(i, q, k)[:2]) for i, q in zip(ids.tolist(), v, strict=True)] if index else []
                if out:
                    near, score = (np.concatenate([x[c] for x in out]) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out])), pa.array(near), pa.array(score)], ["query_id", "near", "score"])

    pairs = placed.unionByName(asked).repartition("dim", "chunk").sortWithinPartitions("dim", "chunk", "asks").mapInArrow(run, "query_id long, near long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "near")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("near").alias(id_col), "score")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, bool], pa.RecordBatch]]:
    """Runs of rows of one dim, chunk and kind."""
    dim, chunk, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "chunk", "asks"))
    new = np.flatnonzero((dim[1:] != dim[:-1]) | (chunk[1:] != chunk[:-1]) | (asks[1:] != asks[:-1])) + 1
    ends = [0, *new.tolist(), len(batch)]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b > a:
            yield (int(dim[a]), int(chunk[a]), bool(asks[a])), batch.slice(a, b - a)


def recall(found: DataFrame, vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Share of the true k nearest distances that were reached, by brute force on the driver: for small tables and tests."""
    t = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), is_query.alias("q")).toArrow()
    ids, m, q = t["id"].to_numpy(), _matrix(t["v"].combine_chunks()), t["q"].to_numpy(zero_copy_only=False)
    got: dict[int, list[float]] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = total = 0
    for i in np.flatnonzero(q):
        d = np.sort(np.sqrt(((m[ids != ids[i]] - m[i]) ** 2).sum(1)))[:k]
        total += len(d)
        hit += sum(x <= d[-1] + 1e-12 for x in got.get(int(ids[i]), []))
    return hit / max(1, total)
