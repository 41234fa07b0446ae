"""Dense retrieval + evaluation queries over the ``embeddings`` table.

Roles: every embedding row is both a query and a corpus entry (leave-one-out:
a vector never retrieves itself); ``label`` equality decides relevance; the
gold context of a question is the centroid of its label.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rivulet.operators import encode as encode_ops, evaluate, knn as knn_ops, vector_index
from rivulet.operators.order import add_dense_id
from rivulet.plans.registry import register
from rivulet.session import ensure_checkpoint_dir, files_key
from rivulet.sources.tables import table

K = 10
BATCH = 16


def _emb(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def label_centroids(emb: DataFrame) -> DataFrame:
    """Per-label mean vector: one aggregate per dimension (partial agg, no explode)."""
    dim = emb.select(F.max(F.size("embedding"))).first()[0]
    aggs = [F.avg(F.col("embedding")[i].cast("double")).alias(f"d{i}") for i in range(dim)]
    c = emb.groupBy("label").agg(*aggs)
    return c.select(F.col("label").cast("long").alias("cid"),
                    F.array(*[F.col(f"d{i}") for i in range(dim)]).alias("centroid"))


def knn_hits(spark: SparkSession, sf_dir: str, k: int = K, metric: str = "dot") -> DataFrame:
    e = _emb(spark, sf_dir)
    hits = knn_ops.knn(e, e, k, qid="vec_id", qvec="embedding", did="vec_id", dvec="embedding",
                       metric=metric, exclude_self=True)
    lab = e.select("vec_id", "label")
    return (hits.join(lab.withColumnRenamed("vec_id", "qid").withColumnRenamed("label", "ql"), "qid")
            .join(lab.withColumnRenamed("vec_id", "doc_id").withColumnRenamed("label", "dl"), "doc_id")
            .withColumn("has_answer", F.col("ql") == F.col("dl"))
            .select("qid", "rank", "doc_id", "score", "has_answer"))


_KNN_SQL = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, {score} AS score
      FROM e q JOIN e d ON q.vec_id <> d.vec_id),
r AS (SELECT qid, doc_id, score,
             row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 10
"""


@register("knn_exact_topk", _KNN_SQL.format(score="list_inner_product(q.v, d.v)"))
def knn_exact_topk(spark, sf_dir):
    """J3 + W6 + X13: exact top-10 inner-product neighbours of every vector."""
    h = knn_hits(spark, sf_dir, K, "dot")
    return h.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


@register("knn_cosine_topk", _KNN_SQL.format(score="list_cosine_similarity(q.v, d.v)"))
def knn_cosine_topk(spark, sf_dir):
    """Same search with cosine similarity."""
    h = knn_hits(spark, sf_dir, K, "cosine")
    return h.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


@register("acc_at_k", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, d.vec_id AS doc_id, q.label = d.label AS hit,
             list_inner_product(q.v, d.v) AS score
      FROM e q JOIN e d ON q.vec_id <> d.vec_id),
r AS (SELECT qid, hit, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s),
fh AS (SELECT qid, min(rank) AS first_hit FROM r WHERE rank <= 10 AND hit GROUP BY qid),
pq AS (SELECT e.vec_id, fh.first_hit FROM e LEFT JOIN fh ON e.vec_id = fh.qid),
k AS (SELECT range AS top_k FROM range(1, 11))
SELECT CAST(k.top_k AS INTEGER) AS top_k,
       CAST(count_if(pq.first_hit <= k.top_k) AS BIGINT) AS n_hits,
       round(count_if(pq.first_hit <= k.top_k) / count(*), 4) AS acc
FROM k, pq GROUP BY k.top_k
""")
def acc_at_k(spark, sf_dir):
    """A1 + W7 (flagship): Acc@k curve of leave-one-out retrieval, label = relevance."""
    h = knn_hits(spark, sf_dir, K, "dot")
    q = _emb(spark, sf_dir).select(F.col("vec_id").cast("long").alias("qid"))
    return evaluate.acc_at_k(h, K, q)


_CENTROID_SQL = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
cen AS (SELECT cid, list(m ORDER BY i) AS c
        FROM (SELECT label AS cid, i, avg(x) AS m FROM ex GROUP BY label, i) GROUP BY cid)
"""


@register("avg_gold_rank", _CENTROID_SQL + """,
sc AS (SELECT e.vec_id AS qid, e.label AS gold, cen.cid, list_inner_product(e.v, cen.c) AS s
       FROM e, cen),
g AS (SELECT qid, s AS gs FROM sc WHERE cid = gold),
rk AS (SELECT sc.qid, count_if(sc.s > g.gs OR (sc.s = g.gs AND sc.cid < sc.gold)) AS r
       FROM sc JOIN g USING (qid) GROUP BY sc.qid)
SELECT CAST(sum(r) AS BIGINT) AS rank_sum, count(*) AS n_questions,
       round(sum(r) / count(*), 4) AS avg_rank FROM rk
""")
def avg_gold_rank(spark, sf_dir):
    """A4 + A15 + J15: average 0-based rank of each vector's own label centroid
    among all centroids (counting formulation, no full sort)."""
    e = _emb(spark, sf_dir)
    cen = label_centroids(e)
    ranks = knn_ops.gold_rank(e.withColumn("gold", F.col("label").cast("long")), cen,
                              qid="vec_id", qvec="embedding", gold_id="gold",
                              did="cid", dvec="centroid")
    return evaluate.avg_gold_rank(ranks)


@register("inbatch_nll", _CENTROID_SQL + """,
q AS (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM e),
qb AS (SELECT vec_id, label, v, pos // 16 AS batch_id, pos % 16 AS q_pos FROM q),
pairs AS (SELECT a.batch_id, a.q_pos, b.q_pos AS ctx_pos, list_inner_product(a.v, c.c) AS s
          FROM qb a JOIN qb b ON a.batch_id = b.batch_id JOIN cen c ON c.cid = b.label),
mx AS (SELECT batch_id, q_pos, max(s) AS m FROM pairs GROUP BY batch_id, q_pos),
pq AS (SELECT p.batch_id, p.q_pos,
              mx.m + ln(sum(exp(p.s - mx.m))) - max(CASE WHEN p.ctx_pos = p.q_pos THEN p.s END) AS loss,
              min(CASE WHEN p.s = mx.m THEN p.ctx_pos END) = p.q_pos AS correct
       FROM pairs p JOIN mx USING (batch_id, q_pos) GROUP BY p.batch_id, p.q_pos, mx.m),
pb AS (SELECT batch_id, avg(loss) AS bl, count_if(correct) AS c, count(*) AS n FROM pq GROUP BY batch_id)
SELECT count(*) AS n_batches, round(avg(bl), 4) AS loss, CAST(sum(c) AS BIGINT) AS correct,
       CAST(sum(n) AS BIGINT) AS total, round(sum(c) / sum(n), 4) AS correct_ratio FROM pb
""")
def inbatch_nll(spark, sf_dir):
    """A5 + D3 + W9: in-batch NLL with batches of 16 vectors in id order; each
    question's positive context is its label centroid, the other questions'
    positives are its in-batch negatives."""
    e = _emb(spark, sf_dir)
    cen = label_centroids(e)
    pos = add_dense_id(e, "vec_id", name="pos", start=0)
    qb = (pos.withColumn("batch_id", F.floor(F.col("pos") / BATCH).cast("long"))
          .withColumn("q_pos", (F.col("pos") % BATCH).cast("int")))
    ctx = (qb.join(cen, qb.label.cast("long") == cen.cid)
           .select("batch_id", F.col("q_pos").alias("ctx_pos"), F.col("centroid").alias("cvec")))
    qs = qb.select("batch_id", "q_pos", F.col("embedding").alias("qvec"),
                   F.col("q_pos").alias("gold_pos"))
    per_q = evaluate.inbatch_nll(qs, ctx)
    return evaluate.nll_summary(per_q)


def _vector_index(spark, sf_dir, n_cells):
    """K16 + E5: the index of a corpus is stored by cell, under a name for the
    corpus' files; opened again while they are the same.  Built in two batches,
    as embeddings arrive: the even ids train it, the others are added."""
    e = _emb(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivulet-vectors-{n_cells}-{files_key(table(spark, sf_dir, 'embeddings'))}"
    try:
        return vector_index.open_index(spark, path)
    except AnalysisException as why:
        if "PATH_NOT_FOUND" not in str(why):
            raise
    columns = {"did": "vec_id", "dvec": "embedding"}
    index = vector_index.build(e.where("vec_id % 2 = 0"), path, n_cells=n_cells, batch="even", **columns)
    vector_index.append(index, e.where("vec_id % 2 <> 0"), "odd", **columns)
    return index


def _ivf(spark, sf_dir, n_cells, nprobe):
    return vector_index.search(_vector_index(spark, sf_dir, n_cells), _emb(spark, sf_dir), K, nprobe=nprobe, qid="vec_id",
                               qvec="embedding", exclude_self=True)


@register("knn_ivf_topk")
def knn_ivf_topk(spark, sf_dir):
    """IVF approximate top-10 (16 k-means cells over MIPS->L2 augmented
    vectors, 4 probes), scores are exact inner products.  Rows-only; recall
    against the exact search is a test."""
    return _ivf(spark, sf_dir, 16, 4).select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


@register("knn_ivf_all_cells", _KNN_SQL.format(score="list_inner_product(q.v, d.v)"))
def knn_ivf_all_cells(spark, sf_dir):
    """J4 + E5 with every cell of an appended index probed: equal to the exact search."""
    return _ivf(spark, sf_dir, 16, 16).select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


@register("knn_ivf_recall")
def knn_ivf_recall(spark, sf_dir):
    """J4 quality: recall@10 of the IVF search against the exact search."""
    e = _emb(spark, sf_dir)
    exact = knn_ops.knn(e, e, K, qid="vec_id", qvec="embedding", did="vec_id", dvec="embedding", exclude_self=True)
    return knn_ops.recall_at_k(_ivf(spark, sf_dir, 16, 4), exact)


@register("mips_to_l2", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, list_sum(list_transform(v, lambda x: x * x)) AS n2 FROM e),
p AS (SELECT max(n2) AS phi FROM n)
SELECT vec_id, round(sqrt(greatest(p.phi - n.n2, 0)), 6) AS extra, round(p.phi, 6) AS phi FROM n, p
""")
def mips_to_l2(spark, sf_dir):
    """X15 + A8: phi = max squared norm; the appended coordinate
    sqrt(phi - |v|^2) of every document vector."""
    from rivulet.functions.vector import mips_augment_doc
    e = _emb(spark, sf_dir)
    phi = knn_ops.max_norm2(e, "embedding")
    a = e.select("vec_id", F.element_at(mips_augment_doc(F.col("embedding"), F.lit(phi)), -1).alias("x"))
    return a.select("vec_id", F.round("x", 6).alias("extra"), F.round(F.lit(phi), 6).alias("phi"))


@register("projected_vectors", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_reverse(CAST(embedding AS DOUBLE[])) AS w FROM embeddings)
SELECT vec_id, round(v[1] - v[2], 6) AS a, round(2 * v[2] + v[3], 6) AS b FROM v
""")
def projected_vectors(spark, sf_dir):
    """The first of a row's token vectors, put through a linear layer."""
    from rivulet.functions.vector import first_token_pool, project
    e = _emb(spark, sf_dir)
    dim = e.select(F.max(F.size("embedding"))).first()[0] or 3
    layer = [[1, -1, *[0] * (dim - 2)], [0, 2, 1, *[0] * (dim - 3)]]
    tokens = F.array(F.col("embedding").cast("array<double>"), F.reverse(F.col("embedding").cast("array<double>")))
    p = e.select("vec_id", project(first_token_pool(tokens), layer).alias("p"))
    return p.select("vec_id", F.round(F.col("p")[0], 6).alias("a"), F.round(F.col("p")[1], 6).alias("b"))


@register("registered_encoder", """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS n_chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS n_e FROM documents
""")
def registered_encoder(spark, sf_dir):
    """An encoder registered by name, called on whole Arrow batches."""
    @encode_ops.register_encoder("letters")
    def letters():
        import numpy as np
        return lambda texts: np.array([[len(t[0]), t[0].count("e")] if t is not None and len(t) else [0, 0] for t in texts], dtype=float).reshape(-1, 2)

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = encode_ops.encode(d, "text", encoder="letters", dtype="double", analyzer=lambda c: F.array(c))
    return v.select("doc_id", F.col("vec")[0].alias("n_chars"), F.col("vec")[1].alias("n_e"))
