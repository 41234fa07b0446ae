"""Vectors stored by cell: appended, opened, pruned, and equal to exact search."""
import numpy as np
import pytest

from rivulet.operators import knn, vector_index

KW = {"qid": "doc_id", "exclude_self": True}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(8, 6)) * 4
    m = np.concatenate([centres[i % 8] + rng.normal(size=(1, 6)) for i in range(400)])
    m[100:120] = m[100]  # ties
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "doc_id long, vec array<double>"), m


def rows(hits):
    return sorted((r.qid, r.rank, r.doc_id) for r in hits.collect())


def test_append_then_search_equals_one_build_and_exact(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df.where("doc_id % 3 = 0"), f"{tmp_path}/a", n_cells=8)
    vector_index.append(index, df.where("doc_id % 3 = 1"), "second")
    vector_index.append(index, df.where("doc_id % 3 = 2"), "third")
    whole = vector_index.build(df, f"{tmp_path}/b", n_cells=8)
    exact = rows(knn.knn(df, df, 5, qid="doc_id", exclude_self=True))
    assert rows(vector_index.search(index, df, 5, nprobe=8, **KW)) == exact == rows(vector_index.search(whole, df, 5, nprobe=8, **KW))
    opened = vector_index.open_index(spark, f"{tmp_path}/a")
    assert opened.batches() == {"first": 134, "second": 133, "third": 133}
    assert rows(vector_index.search(opened, df, 5, nprobe=2, **KW)) == rows(vector_index.search(index, df, 5, nprobe=2, **KW))


def test_files_read_fall_with_the_cells_probed(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df, str(tmp_path), n_cells=8)
    files = [len(set(index.vectors(cells).inputFiles())) for cells in (list(range(8)), [0, 1], [3])]
    read = [index.vectors(cells).select("doc_id").count() for cells in (list(range(8)), [0, 1], [3])]
    plan = index.vectors([3])._jdf.queryExecution().executedPlan().toString()
    assert read[0] == 400 > read[1] > read[2] > 0 and "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(files) == 3


def test_recall_rises_with_probes(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df, str(tmp_path), n_cells=8)
    exact = knn.knn(df, df, 5, qid="doc_id", exclude_self=True)
    recall = [knn.recall_at_k(vector_index.search(index, df, 5, nprobe=n, **KW), exact).first().recall for n in (1, 4, 8)]
    assert recall[0] <= recall[1] <= recall[2] == 1.0 and recall[1] >= 0.9


def test_batch_that_was_cut_off_is_left_out_and_can_be_added_again(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df.where("doc_id < 200"), str(tmp_path), n_cells=4)
    # what a job leaves that ended before its entry was written
    vector_index.with_cells(df.where("doc_id >= 390"), 6, index.phi, index.centroids, None) \
        .write.partitionBy("cell").parquet(f"{tmp_path}/vectors/batch=late")
    assert vector_index.open_index(spark, str(tmp_path)).vectors().count() == 200
    vector_index.append(index, df.where("doc_id >= 200"), "late")
    assert vector_index.open_index(spark, str(tmp_path)).vectors().count() == 400
    with pytest.raises(ValueError, match="is there"):
        vector_index.append(index, df, "late")


def test_what_cannot_be_stored_or_opened_raises(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df, str(tmp_path), n_cells=4)
    short = spark.createDataFrame([(1, [1.0])], "doc_id long, vec array<double>")
    for bad, name in ((short, "x"), (df, "no/name"), (df, "7")):
        with pytest.raises(ValueError):
            vector_index.append(index, bad, name)
    with pytest.raises(ValueError):
        vector_index.search(index, short, 3, qid="doc_id")
    with pytest.raises(ValueError, match="no vectors"):
        vector_index.build(df.limit(0), f"{tmp_path}/none")
    spark.createDataFrame([(7,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/batches/batch=first")
    with pytest.raises(ValueError, match="400 vectors in an index of 7"):
        vector_index.open_index(spark, str(tmp_path))


def test_no_queries_and_zero_vectors(spark, vectors, tmp_path):
    df, _ = vectors
    index = vector_index.build(df, str(tmp_path), n_cells=4)
    assert vector_index.search(index, df.limit(0), 3, **KW).collect() == []
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "doc_id long, vec array<double>")
    hits = knn.knn(zero, zero, 3, qid="doc_id", metric="cosine", exclude_self=True)
    assert rows(hits) == [(2, 1, 3), (3, 1, 2)]  # a vector without direction is no neighbour and has none
