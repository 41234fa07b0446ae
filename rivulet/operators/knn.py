"""Exact / approximate nearest-neighbour search by inner product.

Design:

* Both sides are tables of (id, vector); ids can be of any orderable type.
  Corpus vectors are dealt into chunks and queries into blocks of bounded size,
  and every (chunk, block) pair is one cogroup: the pairing is an equi-join on
  (cell, chunk, block) in the data plane.  Nothing is collected or broadcast,
  and no task holds more than one chunk, one block and their score matrix.
* Exact search has one cell.  IVF search (``vector_index``) stores vectors by
  cell; a query meets the cells it probes.  A large cell has more chunks, so it
  is no hot group.
* A vector is copied once for each block it meets, so chunks and blocks are as
  large as a task's memory allows; scores are computed a slice at a time.
* A pair is scored with one matrix product and emits at most k rows a query;
  they are merged by ``row_number() <= k``, which Spark limits before the
  shuffle.  Ties go to the smaller document id, whatever the partitioning.
* A null vector, a component that is null or not finite, or vectors of
  different lengths are errors, not silently left out.

Input vectors are written to the shared folder once when a search is built, so
that an encoder in front of it runs once.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import materialize

#: Most corpus vectors of a chunk, queries of a block, and scores (queries times
#: corpus vectors) worked out at a time.
CHUNK_ROWS, BLOCK_ROWS, SLICE_SCORES = 16384, 16384, 1 << 20
#: Most bytes of a chunk's or a block's vectors.
DEFAULT_MAX_BLOCK_BYTES = 64 << 20


def matrix(col, dim: int) -> np.ndarray:
    """List column -> (n, dim) float64 matrix without per-row Python."""
    chunks = col.chunks if isinstance(col, pa.ChunkedArray) else [col]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    out = np.concatenate(flat) if flat else np.zeros(0)
    if len(out) != len(col) * dim:
        raise ValueError(f"vectors must all have {dim} components")
    return out.astype(np.float64, copy=False).reshape(-1, dim)


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a row of zeros has no direction and becomes NaN, as
    :func:`rivulet.functions.vector.cosine` gives null for it."""
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    n[n == 0] = np.nan
    return m / n


def _ids(col) -> np.ndarray:
    return np.asarray(col.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(col, pa.ChunkedArray)
                      else col.to_numpy(zero_copy_only=False))


def stored_vectors(df: DataFrame, name: str, **columns: str) -> DataFrame:
    """Stored columns under their new names; the one called ``vec`` as doubles."""
    picked = [F.col(c).cast("array<double>").alias("vec") if new == "vec" else F.col(c).alias(new) for new, c in columns.items()]
    return materialize(df.select(*picked), name)


def checked(*tables: DataFrame) -> tuple[int, list[int]]:
    """The common vector length, and the rows of each table; raises where there
    is no common length or a vector cannot be searched."""
    sizes, rows = set(), []
    for t in tables:
        odd = F.col("vec").isNull() | F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        row = t.agg(F.count_if(odd).alias("odd"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"),
                    F.count(F.lit(1)).alias("n")).first()
        if row["odd"]:
            raise ValueError(f"{row['odd']} vectors are null or hold a component that is null or not finite")
        sizes |= {row["low"], row["high"]} - {None}
        rows.append(row["n"])
    if len(sizes) > 1:
        raise ValueError(f"vectors must all have the same dimension, not {sorted(sizes)}")
    return sizes.pop() if sizes else 0, rows


def paired(q: DataFrame, c: DataFrame, in_q: dict[int, int], in_c: dict[int, int], pair, schema: str, dim: int,
           max_block_bytes: int) -> DataFrame:
    """``pair(corpus)(queries)`` (Arrow tables) over every block and chunk of
    equal ``cell``; ``in_q`` and ``in_c`` are the rows of each cell.  A chunk is
    made ready once and meets the queries of a block a few at a time."""
    most = max(1, max_block_bytes // (dim * 8 + 64))
    blocks = {cell: -(-n // min(BLOCK_ROWS, most)) for cell, n in in_q.items()}
    chunks = {cell: -(-n // min(CHUNK_ROWS, max(1, DEFAULT_MAX_BLOCK_BYTES // (dim * 8 + 64)))) for cell, n in in_c.items()}
    cells = sorted(cell for cell in set(chunks) & set(blocks) if chunks[cell] and blocks[cell])
    if not cells:
        return q.sparkSession.createDataFrame([], schema)
    n_chunks = F.create_map(*[F.lit(x) for cell in cells for x in (cell, chunks[cell])])[F.col("cell")]
    n_blocks = F.create_map(*[F.lit(x) for cell in cells for x in (cell, blocks[cell])])[F.col("cell")]
    both = F.col("cell").isin(cells)
    left = q.where(both).withColumn("block", F.pmod(F.xxhash64("qid"), n_blocks).cast("int")) \
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
    right = c.where(both).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), n_chunks).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    keys = ["cell", "chunk", "block"]
    empty = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string()))
                       for f in T.StructType.fromDDL(schema)]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return empty
        scored, step = pair(b), max(1, SLICE_SCORES // b.num_rows)
        return pa.concat_tables([scored(a.slice(i, step)) for i in range(0, a.num_rows, step)])

    return left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(run, schema)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def scorer(dim: int, metric: str, exclude_self: bool, k: int):
    def pair(right: pa.Table):
        ids, cm = _ids(right.column("doc_id")), matrix(right.column("vec"), dim)
        if metric == "cosine":
            cm = _normalize_rows(cm)
        place: dict = {}
        if exclude_self:
            for j, d in enumerate(ids):
                place.setdefault(d, []).append(j)
        by_id = np.empty(len(ids), dtype=np.int64)
        by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))

        def scored(left: pa.Table) -> pa.Table:
            qm = matrix(left.column("vec"), dim)
            if metric == "cosine":
                qm = _normalize_rows(qm)
            s = qm @ cm.T
            s[np.isnan(s)] = -np.inf  # no direction, no neighbour
            if exclude_self:
                for i, d in enumerate(_ids(left.column("qid"))):
                    s[i, place.get(d, [])] = -np.inf
            kk = min(k, s.shape[1])
            least = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
            # what may be among the best k; their scores then come from one formula,
            # which does not hang on the shape of the block as a matrix product does
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            row, col = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
            score = np.concatenate([np.einsum("ij,ij->i", qm[row[i:i + 16384]], cm[col[i:i + 16384]])
                                    for i in range(0, max(len(row), 1), 16384)])
            order = np.lexsort((by_id[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, score = row[keep], col[keep], score[keep]
            return pa.table({"qid": left.column("qid").take(pa.array(row)), "doc_id": right.column("doc_id").take(pa.array(col)),
                             "score": pa.array(score, pa.float64())})
        return scored
    return pair


def merged(parts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").asc())
    return (parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rank", "doc_id", "score"))


def knn(queries: DataFrame, corpus: DataFrame, k: int = 10, *, qid: str = "qid",
        qvec: str = "vec", did: str = "doc_id", dvec: str = "vec", metric: str = "dot",
        exclude_self: bool = False, max_broadcast_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """Exact top-k by inner product (or cosine).  Returns ``qid, rank, doc_id, score``.

    ``rank`` is 1-based, ordered by score descending then doc id ascending.
    ``exclude_self`` drops pairs whose query id equals the document id
    (leave-one-out retrieval when queries are drawn from the corpus).
    ``max_broadcast_bytes`` bounds a block of queries.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q = stored_vectors(queries, "knn-queries", qid=qid, vec=qvec).withColumn("cell", F.lit(0))
    c = stored_vectors(corpus, "knn-corpus", doc_id=did, vec=dvec).withColumn("cell", F.lit(0))
    dim, (n_q, n_c) = checked(q, c)
    schema = f"qid {id_type(q, 'qid')}, doc_id {id_type(c, 'doc_id')}, score double"
    return merged(paired(q, c, {0: n_q}, {0: n_c}, scorer(dim, metric, exclude_self, k), schema, dim, max_broadcast_bytes), k)


def gold_rank(queries: DataFrame, corpus: DataFrame, *, qid: str = "qid", qvec: str = "vec",
              gold_id: str = "gold_id", did: str = "doc_id", dvec: str = "vec",
              metric: str = "dot", max_broadcast_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """0-based position of each query's gold context in the descending
    score order over the whole context pool, without sorting the pool.

    rank = #contexts scoring higher + #contexts scoring equal with a smaller id.
    Returns ``qid, gold_id, gold_rank``; a query whose gold id is absent from
    the pool has a null rank.
    """
    q = stored_vectors(queries, "rank-queries", qid=qid, vec=qvec, gold_id=gold_id)
    c = stored_vectors(corpus, "rank-corpus", doc_id=did, vec=dvec).withColumn("cell", F.lit(0))
    dim, (n_q, n_c) = checked(q, c)
    # the gold vector travels with its query (equi-join on the gold id)
    gold = c.select(F.col("doc_id").alias("gold_id"), F.col("vec").alias("gold_vec"))
    known = q.join(gold, "gold_id").withColumn("cell", F.lit(0))

    def pair(right: pa.Table):
        ids, cm = _ids(right.column("doc_id")), matrix(right.column("vec"), dim)
        if metric == "cosine":
            cm = _normalize_rows(cm)

        def counted(left: pa.Table) -> pa.Table:
            gids = _ids(left.column("gold_id"))
            qm, gm = matrix(left.column("vec"), dim), matrix(left.column("gold_vec"), dim)
            if metric == "cosine":
                qm, gm = _normalize_rows(qm), _normalize_rows(gm)
            g = np.einsum("ij,ij->i", qm, gm)
            s = qm @ cm.T
            g[np.isnan(g)], s[np.isnan(s)] = -np.inf, -np.inf  # without direction: after all others
            higher = s > g[:, None]
            # scores that differ by rounding alone are compared by one formula
            with np.errstate(invalid="ignore"):
                row, col = np.nonzero(np.abs(s - g[:, None]) <= 1e-9 * (1 + np.abs(g))[:, None])
            same = np.einsum("ij,ij->i", qm[row], cm[col])
            higher[row, col] = (same > g[row]) | ((same == g[row]) & (ids[col] < gids[row]))
            return pa.table({"qid": left.column("qid"), "n_before": pa.array(higher.sum(axis=1), pa.int64())})
        return counted

    counts = paired(known, c, {0: n_q}, {0: n_c}, pair, f"qid {id_type(q, 'qid')}, n_before long", dim, max_broadcast_bytes)
    ranks = counts.groupBy("qid").agg(F.sum("n_before").cast("long").alias("gold_rank"))
    return q.select("qid", "gold_id").join(ranks, "qid", "left").select("qid", "gold_id", "gold_rank")


# ---------------------------------------------------------------- J4 / X15 / A8
def max_norm2(corpus: DataFrame, dvec: str = "vec") -> float:
    """phi = max squared norm over the corpus (one aggregate)."""
    from rivulet.functions.vector import norm2
    return float(corpus.agg(F.max(norm2(dvec))).first()[0] or 0.0)


def train_ivf(corpus: DataFrame, n_cells: int, *, dvec: str = "vec", seed: int = 7,
              max_iter: int = 10):
    """Coarse quantizer for J4: k-means (Spark ML, distributed) over the
    MIPS->L2 augmented corpus vectors (X15), so L2 cells follow inner product.
    Returns ``(phi, centroids[n_cells, dim+1])`` -- bounded by ``n_cells``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from rivulet.functions.vector import mips_augment_doc
    phi = max_norm2(corpus, dvec)
    aug = corpus.select(array_to_vector(mips_augment_doc(F.col(dvec), F.lit(phi))).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, initMode="k-means||").fit(aug)
    return phi, np.array([c for c in model.clusterCenters()], dtype=np.float64)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact top-k ids that the approximate search returned."""
    j = exact.select("qid", "doc_id").join(approx.select("qid", "doc_id", F.lit(1).alias("__f")),
                                           ["qid", "doc_id"], "left")
    return j.agg(F.round(F.avg(F.coalesce("__f", F.lit(0))), 4).alias("recall"),
                 F.count(F.lit(1)).alias("n_pairs"))
