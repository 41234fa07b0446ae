"""Exact top-k inner products by no-random-access aggregation (NRA).

Candidates are cut in chunks, queries in blocks, and every block meets every
chunk in a task of its own.  Within a task each dimension is a list sorted by
component.  The lists are read in steps, for each query from the end that the
sign of its component favours, and the entries read in a step are added to their
candidates' sums (for many queries at once, as a product with a matrix that
holds the step's entries and is 0 elsewhere).  A candidate's score lies between
its sum with the far ends of the lists it was not yet met in, and its sum with
the frontiers of these lists.  A candidate whose upper bound is under the k-th
best lower bound cannot qualify.  When few are left to a query it reads no
further, and their scores are resolved; a candidate that is out for all open
queries is left out.  The best k of each pair of block and chunk are merged by a
ranking that Spark limits before the shuffle.

How much is never read hangs on the vectors: where few components carry a score
the lists end early; where all weigh alike bounds close late (see README).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import store

K, SCALE, QUERY_MODULUS = 20, 64, 20
#: Candidates of a chunk, queries of a block, and queries that read at a time.
#: A candidate is copied once for each block, so blocks are large.
CHUNK_ROWS, BLOCK_ROWS, SLICE_ROWS = 8192, 16384, 512
#: Shares of the lists after which bounds are compared.
DEPTHS = (0.25, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 1.0)
#: With at most so many candidates left to a query, scores are resolved.
FEW = 96


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, vector)`` with floor(scale * x) as longs.  Rows without an id,
    without a vector, or with a component that is null or not finite take no
    part.  Rows of one vec_id are one: the smallest vector."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform(x, lambda v: F.floor(v * scale).cast("bigint"))
    return (embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
            .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))
            .groupBy("vec_id").agg(F.min("vector").alias("vector")))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, whatever their size; kept within a long."""
    if np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0) * a.shape[1] < 2.0 ** 62:
        return np.einsum("ij,ij->i", a, b)
    sums = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.clip(sums, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _everything(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, ...]:
    rows = [(np.full(len(ids), i), np.arange(len(ids)), _exact(np.broadcast_to(q, vectors.shape), vectors)) for i, q in enumerate(queries)]
    out = tuple(np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
    keep = ids[out[1]] != query_ids[out[0]]
    return tuple(c[keep] for c in out)


class Lists:
    """A chunk's components, sorted in each dimension, and what a step reads."""

    def __init__(self, vectors: np.ndarray, kind: type):
        self.vectors, self.kind = vectors, kind  # sums of kind are exact
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(len(vectors))[:, None], axis=0)

    def _two(self, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """For lists read from the top, and beside them from the bottom."""
        return np.concatenate([top, bottom], axis=1).astype(self.kind)

    def step(self, before: int, read: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries from ``before`` to ``read``; of the entries then unread the
        most they can be (the frontier), and the least (the far end)."""
        n, rank = len(self.vectors), self.rank
        new = self._two(np.where((rank >= n - read) & (rank < n - before), self.vectors, 0),
                        np.where((rank >= before) & (rank < read), self.vectors, 0))
        if read >= n:
            none = np.zeros_like(new)
            return new, none, none
        top, bottom = rank < n - read, rank >= read
        return (new, self._two(np.where(top, self.sorted[n - read - 1], 0), np.where(bottom, self.sorted[read], 0)),
                self._two(np.where(top, self.sorted[0], 0), np.where(bottom, self.sorted[-1], 0)))


def nra(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, candidate row, score) of what may be in each query's best k,
    and how many list entries were read and how many there are."""
    n, dims = vectors.shape
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    if bound >= 2.0 ** 52:  # sums would round: compare everything exactly
        return *_everything(ids, vectors, query_ids, queries), queries.size * n, queries.size * n
    lists = Lists(vectors, np.float32 if bound < 2.0 ** 23 else np.float64)
    cuts = sorted({min(n, max(k + 1, int(np.ceil(n * depth)))) for depth in DEPTHS})
    steps = [lists.step(before, read) for before, read in zip([0, *cuts], cuts)]
    order = np.argsort(ids, kind="stable")
    at = order[np.minimum(np.searchsorted(ids, query_ids, sorter=order), n - 1)]
    own = np.where(ids[at] == query_ids, at, -1)
    found, used = [], 0
    for start in range(0, len(queries), SLICE_ROWS):
        rows = np.arange(start, min(start + SLICE_ROWS, len(queries)))
        used += _read(lists, cuts, steps, queries, own, rows, k, found)
    empty = (np.zeros(0, np.int64),) * 3
    return *(tuple(np.concatenate(c) for c in zip(*found)) if found else empty), used, queries.size * n


def _read(lists: Lists, cuts: list[int], steps: list, queries: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, found: list) -> int:
    """Read the lists for some queries; adds what is left of them to ``found``,
    gives the number of entries read."""
    n = len(lists.vectors)
    kept = np.arange(n)  # candidates that some open query may still need
    sums = np.zeros((len(rows), n), lists.kind)
    used = before = 0
    for read, step in zip(cuts, steps):
        q = queries[rows].astype(lists.kind)
        signed = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1)
        new, most, least = (m if len(kept) == n else m[kept] for m in step)
        sums += signed @ new.T
        used += int(np.count_nonzero(q)) * (read - before)
        before = read
        upper, lower = (sums.copy(), sums.copy()) if read >= n else (sums + signed @ most.T, sums + signed @ least.T)
        place = np.searchsorted(kept, own[rows])
        mine = np.flatnonzero((own[rows] >= 0) & (kept[np.minimum(place, len(kept) - 1)] == own[rows]))
        for m in (upper, lower):
            m[mine, place[mine]] = -np.inf
        # the k-th best of group maxima is reached by k candidates at least
        groups = min(len(kept), 4 * k)
        best = np.maximum.reduceat(lower, np.linspace(0, len(kept), groups, endpoint=False).astype(np.int64), axis=1)
        kth = np.partition(best, groups - k, axis=1)[:, groups - k] if groups >= k else np.full(len(rows), -np.inf)
        alive = (upper >= kth[:, None]) & (upper > -np.inf)
        done = (np.count_nonzero(alive, axis=1) <= FEW) | (read >= n)
        for j in np.flatnonzero(done):
            left = kept[alive[j]]
            found.append((np.full(len(left), rows[j]), left, _exact(np.broadcast_to(queries[rows[j]], (len(left), queries.shape[1])), lists.vectors[left])))
        rows, sums = rows[~done], sums[~done]
        if not len(rows):
            break
        wanted = alive[~done].any(axis=0)
        if np.count_nonzero(wanted) < 0.7 * len(kept):
            kept, sums = kept[wanted], sums[:, wanted]
    return used


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pa.Table:
    """The best k of each query, ties to the smaller id."""
    row, cand, score, _, _ = nra(ids, vectors, query_ids, queries, k)
    order = np.lexsort((ids[cand], -score.astype(np.float64), row)) if len(score) and np.abs(score.astype(float)).max() < 2.0 ** 52 \
        else np.array(sorted(range(len(score)), key=lambda i: (row[i], -int(score[i]), ids[cand[i]])), dtype=np.int64)
    row, cand, score = row[order], cand[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({"query_id": query_ids[row[keep]], "vec_id": ids[cand[keep]], "score": score[keep].astype(np.int64)})


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("vector").combine_chunks()
    flat = flat.values if isinstance(flat, pa.ListArray) else pa.concat_arrays(flat.chunks).values
    return ids, flat.to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def top_k(embeddings: DataFrame, k: int = K, modulus: int = QUERY_MODULUS, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of
    each row whose vec_id is divisible by ``modulus`` with all rows but itself.

    Ties go to the smaller vec_id; all candidates if there are fewer than k.
    Vectors of other lengths are no candidates; the inner product of empty
    vectors is 0.  An empty table gives no rows.
    """
    vectors = store(quantised(embeddings, scale).withColumn("dims", F.size("vector")), "vectors")
    n = vectors.count()
    chunks, blocks = -(-n // CHUNK_ROWS) or 1, -(-n // (BLOCK_ROWS * modulus)) or 1
    dealt = F.xxhash64("vec_id")
    candidates = vectors.select("vec_id", "vector", "dims", F.pmod(dealt, F.lit(chunks)).cast("int").alias("chunk"),
                                F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = vectors.where(F.col("vec_id") % modulus == 0).select(
        "vec_id", "vector", "dims", F.pmod(F.xxhash64(dealt), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    keys = ["dims", "chunk", "block"]

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return best_of(*_matrix(left), *_matrix(right), k)

    best = candidates.groupBy(keys).cogroup(queries.groupBy(keys)).applyInArrow(pair, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
