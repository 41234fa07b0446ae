"""Approximate search in vectors stored by cell.

An index is a folder:

* ``model(cell, phi, centroid)`` -- k-means centroids of the augmented vectors
* ``vectors/batch=B/cell=C`` -- ``(doc_id, vec)``, one folder for each batch that
  was added and each cell
* ``batches/batch=B`` -- ``(n)``, written when the batch is whole

A batch counts once its entry under ``batches`` is there, so a job that is cut
off leaves an index that opens without it, and adding the batch again replaces
what was left.  A search finds each query's ``nprobe`` nearest cells and reads
only the folders of these cells (partition pruning); within a cell every query
meets every vector, with the exact inner product.  Nothing is trained or
assigned when searching.
"""
from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.knn import (CHUNK_ROWS, DEFAULT_MAX_BLOCK_BYTES, checked, id_type, matrix, merged, paired, scorer,
                                   stored_vectors, train_ivf)
from rivulet.session import materialize

BATCH_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.-]*")


@dataclass
class VectorIndex:
    spark: SparkSession = field(repr=False)
    path: str
    phi: float
    centroids: np.ndarray  # n_cells rows, as many numbers as a vector and one

    @property
    def dim(self) -> int:
        return self.centroids.shape[1] - 1

    def batches(self) -> dict[str, int]:
        """Rows of every whole batch."""
        found = self.spark.read.option("basePath", f"{self.path}/batches").schema("n long, batch string").parquet(f"{self.path}/batches")
        return {r["batch"]: r["n"] for r in found.collect()}

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """doc_id, vec, cell of the whole batches; only the folders of ``cells``
        are read if they are given."""
        rows = self.spark.read.option("basePath", f"{self.path}/vectors").parquet(f"{self.path}/vectors") \
            .where(F.col("batch").isin(list(self.batches())))
        return (rows if cells is None else rows.where(F.col("cell").isin(cells))).select("doc_id", "vec", "cell")


def with_cells(t: DataFrame, dim: int, phi: float, centroids: np.ndarray, nprobe: int | None) -> DataFrame:
    """``t`` with the cell of each corpus vector, or a row for each of the
    ``nprobe`` nearest cells of a query.  Centroids are bounded by n_cells."""
    schema = T.StructType([*t.schema.fields, T.StructField("cell", T.IntegerType())])
    squares = (centroids * centroids).sum(axis=1)

    def run(batches):
        for b in batches:
            m = matrix(b.column(b.schema.get_field_index("vec")), dim)
            extra = np.zeros(len(m)) if nprobe else np.sqrt(np.maximum(phi - (m * m).sum(axis=1), 0.0))
            distance = squares - 2 * np.concatenate([m, extra[:, None]], axis=1) @ centroids.T
            near = np.argsort(distance, axis=1, kind="stable")[:, :nprobe or 1]
            rows = b.take(pa.array(np.repeat(np.arange(len(m)), near.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], names=[*b.schema.names, "cell"])

    return t.mapInArrow(run, schema)


def build(corpus: DataFrame, path: str, *, n_cells: int = 16, did: str = "doc_id", dvec: str = "vec", seed: int = 7,
          batch: str = "first") -> VectorIndex:
    """Train the cells on ``corpus`` and store it as the first batch."""
    c = stored_vectors(corpus, "index-corpus", doc_id=did, vec=dvec)
    dim, (n,) = checked(c)
    if not n:
        raise ValueError("an index cannot be trained on no vectors")
    spark = corpus.sparkSession
    phi, centroids = train_ivf(c, n_cells, seed=seed)
    spark.createDataFrame([(i, float(phi), [float(x) for x in v]) for i, v in enumerate(centroids)],
                          "cell int, phi double, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    index = VectorIndex(spark, path, phi, centroids)
    _add(index, c, dim, n, batch)
    return index


def append(index: VectorIndex, corpus: DataFrame, batch: str, *, did: str = "doc_id", dvec: str = "vec") -> None:
    """Add a batch of vectors; one of that name that is not whole is replaced,
    one that is whole raises."""
    if batch in index.batches():
        raise ValueError(f"batch {batch!r} is there")
    c = stored_vectors(corpus, "index-corpus", doc_id=did, vec=dvec)
    dim, (n,) = checked(c)
    if n and dim != index.dim:
        raise ValueError(f"vectors must have {index.dim} components, not {dim}")
    _add(index, c, index.dim, n, batch)


def _add(index: VectorIndex, c: DataFrame, dim: int, n: int, batch: str) -> None:
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"{batch!r} is no name for a batch")
    # about one file for each chunk of a cell; a cell with a third of all rows has its share of tasks
    parts = max(1, n // (len(index.centroids) * CHUNK_ROWS) + 1)
    celled = with_cells(c, dim, index.phi, index.centroids, None).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    celled.repartition("cell", "part").drop("part").write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/vectors/batch={batch}")
    index.spark.range(1).select(F.lit(n).cast("long").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/batches/batch={batch}")


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """Open a stored index; raises if its batches do not have the rows they
    should (the index and its ids must be equally many)."""
    rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: r["cell"])
    index = VectorIndex(spark, path, rows[0]["phi"], np.array([r["centroid"] for r in rows], dtype=np.float64))
    have, want = index.vectors().count(), sum(index.batches().values())
    if have != want:
        raise ValueError(f"{have} vectors in an index of {want}")
    return index


def search(index: VectorIndex, queries: DataFrame, k: int = 10, *, nprobe: int = 4, qid: str = "qid", qvec: str = "vec",
           exclude_self: bool = False, max_block_bytes: int = DEFAULT_MAX_BLOCK_BYTES) -> DataFrame:
    """Top k by inner product in the ``nprobe`` nearest cells of each query:
    ``qid, rank, doc_id, score``.  All cells probed is the exact search."""
    q = stored_vectors(queries, "index-queries", qid=qid, vec=qvec)
    dim, (n,) = checked(q)
    if n and dim != index.dim:
        raise ValueError(f"queries must have {index.dim} components, not {dim}")
    probing = materialize(with_cells(q, index.dim, index.phi, index.centroids, min(nprobe, len(index.centroids))), "index-probes")

    def per_cell(t: DataFrame) -> dict[int, int]:  # one entry for each cell
        return {r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()}

    in_q = per_cell(probing)
    c = index.vectors(sorted(in_q))
    schema = f"qid {id_type(q, 'qid')}, doc_id {id_type(c, 'doc_id')}, score double"
    return merged(paired(probing, c, in_q, per_cell(c), scorer(index.dim, "dot", exclude_self, k), schema, index.dim, max_block_bytes), k)


def knn_ivf(queries: DataFrame, corpus: DataFrame, k: int = 10, *, path: str, n_cells: int = 16, nprobe: int = 4, qid: str = "qid",
            qvec: str = "vec", did: str = "doc_id", dvec: str = "vec", exclude_self: bool = False, seed: int = 7) -> DataFrame:
    """J4 in one step: build an index of ``corpus`` at ``path`` and search it."""
    index = build(corpus, path, n_cells=n_cells, did=did, dvec=dvec, seed=seed)
    return search(index, queries, k, nprobe=nprobe, qid=qid, qvec=qvec, exclude_self=exclude_self)
