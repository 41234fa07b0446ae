"""Training-sample queries: union/upsampling, dedup, seeded epoch order,
shards, batches, strict batch fill, in-batch negatives, two-tower batches and
seeded negative sampling (``conversations``, ``benchmark``, ``documents``)."""
from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import training as tr
from rivulet.operators.training import ids_string
from rivulet.plans.registry import register
from rivulet.plans.text_search import _TS_SQL, training_set
from rivulet.sources.tables import conversation_turns, table

SEED = 42
SHARDS = 3
BATCH = 16
SMALL_BATCH = 4


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def _ordered(spark, sf_dir):
    """Conversation turns in the seed-42 epoch-0 order, positions 0..n-1."""
    return tr.epoch_order(_turns(spark, sf_dir), ["conv_id", "turn"], SEED, 0)


_ORDER_SQL = """
WITH o AS (SELECT conv_id, turn,
                  row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || conv_id || ':' || turn), 1, 15))::BIGINT,
                                              conv_id, turn) - 1 AS pos
           FROM conversations),
n AS (SELECT count(*) AS n FROM conversations)
"""


@register("upsample_union", """
WITH u AS (SELECT 'conv' AS source, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS qid
           FROM conversations
           UNION ALL
           SELECT 'bench' AS source, CAST(item_id AS VARCHAR) AS qid FROM benchmark),
r AS (SELECT * FROM (VALUES ('conv', 1), ('bench', 3)) t(source, rate))
SELECT u.source, u.qid, CAST(c.copy AS INTEGER) AS copy
FROM u JOIN r USING (source), LATERAL (SELECT unnest(range(1, r.rate + 1)) AS copy) c
""")
def upsample_union(spark, sf_dir):
    """U1 + U2: two sources, all turns and all items, unioned by name; 'bench'
    is up-sampled 3x."""
    c = _turns(spark, sf_dir).select(
        F.lit("conv").alias("source"), F.concat_ws("-", "conv_id", "turn").alias("qid"))
    b = table(spark, sf_dir, "benchmark").select(F.lit("bench").alias("source"),
                                                 F.col("item_id").cast("string").alias("qid"))
    u = tr.upsample(c.unionByName(b), {"conv": 1, "bench": 3})
    return u.select("source", "qid", F.col("copy").cast("int").alias("copy"))


@register("drop_no_positives", _TS_SQL + """
SELECT qid, positive_ids FROM ts WHERE positive_ids <> ''
""")
def drop_no_positives(spark, sf_dir):
    """F7 + F8: BM25 training samples without a positive context are dropped."""
    ts = tr.drop_no_positives(training_set(spark, sf_dir))
    return ts.select("qid", tr.ids_string("positive_ctxs").alias("positive_ids"))


@register("dedup_last_wins", """
SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id
""")
def dedup_last_wins(spark, sf_dir):
    """One row per conversation, the last turn wins (dict overwrite)."""
    d = tr.dedup_last_wins(_turns(spark, sf_dir), "conv_id", "turn")
    return d.select("conv_id", "turn", "role")


@register("epoch_shuffle", _ORDER_SQL + """
SELECT conv_id, turn, pos FROM o
""")
def epoch_shuffle(spark, sf_dir):
    """Seeded, partition-independent epoch order of every turn."""
    return _ordered(spark, sf_dir).select("conv_id", "turn", "pos")


def _shards_sql(how: str) -> str:
    if how == "ceil":
        size = "CAST(ceil(n.n / 3) AS BIGINT)"
        shard = "CAST(floor(o.pos / s.size) AS INTEGER)"
    else:
        size = "CAST(floor(n.n / 3) AS BIGINT)"
        shard = "CAST(least(floor(o.pos / s.size), 2) AS INTEGER)"
    return _ORDER_SQL + f""",
s AS (SELECT {size} AS size FROM n),
a AS (SELECT o.conv_id, o.turn, {shard} AS shard_id, s.size FROM o, s),
b AS (SELECT a.conv_id, a.turn, a.shard_id, o.pos - a.shard_id * a.size AS pos_in_shard
      FROM a JOIN o USING (conv_id, turn))
SELECT conv_id, turn, shard_id, pos_in_shard, CAST(pos_in_shard // 16 AS BIGINT) AS batch_id,
       CAST(pos_in_shard % 16 AS INTEGER) AS sample_pos FROM b
"""


def _sharded(spark, sf_dir, how):
    o = _ordered(spark, sf_dir)
    n = o.count()  # one scalar: the shard size is a function of the row count
    s = tr.assign_shards(o, n, SHARDS, how=how)
    return tr.assign_batches(s, BATCH)


@register("shard_assign", _shards_sql("ceil"))
def shard_assign(spark, sf_dir):
    """D2a + D3: 3 contiguous shards of ceil size, batches of 16."""
    s = _sharded(spark, sf_dir, "ceil")
    return s.select("conv_id", "turn", "shard_id", "pos_in_shard", "batch_id", "sample_pos")


@register("shard_assign_floor", _shards_sql("floor"))
def shard_assign_floor(spark, sf_dir):
    """Floor-size shards; the remainder stays in the last shard."""
    s = _sharded(spark, sf_dir, "floor")
    return s.select("conv_id", "turn", "shard_id", "pos_in_shard", "batch_id", "sample_pos")


@register("batch_fill", _shards_sql("ceil").replace(
    "SELECT conv_id, turn, shard_id, pos_in_shard, CAST(pos_in_shard // 16 AS BIGINT) AS batch_id,\n"
    "       CAST(pos_in_shard % 16 AS INTEGER) AS sample_pos FROM b", "") + """,
c AS (SELECT shard_id, count(*) AS cnt FROM b GROUP BY shard_id),
f AS (SELECT b.conv_id, b.turn, b.shard_id, b.pos_in_shard FROM b
      UNION ALL
      SELECT b.conv_id, b.turn, b.shard_id, c.cnt + b.pos_in_shard FROM b JOIN c USING (shard_id)
      WHERE b.pos_in_shard < (16 - c.cnt % 16) % 16)
SELECT conv_id, turn, shard_id, CAST(pos_in_shard // 16 AS BIGINT) AS batch_id,
       CAST(pos_in_shard % 16 AS INTEGER) AS sample_pos FROM f
""")
def batch_fill(spark, sf_dir):
    """U6 + D4: strict batch size 16 -- each shard's short last batch is
    completed with the shard's first rows."""
    o = _ordered(spark, sf_dir)
    s = tr.assign_shards(o, o.count(), SHARDS, how="ceil")
    f = tr.fill_last_batch(s, BATCH)
    b = tr.assign_batches(f, BATCH)
    return b.select("conv_id", "turn", "shard_id", "batch_id", "sample_pos")


MANY_SHARDS, SMALL_BATCH = 40, 4


@register("shard_iterations", _ORDER_SQL + f""",
z AS (SELECT CAST(ceil(n.n / {MANY_SHARDS}) AS BIGINT) AS size FROM n),
b AS (SELECT o.conv_id, o.turn, CAST(o.pos // z.size AS INTEGER) AS shard_id, o.pos % z.size AS p FROM o, z),
c AS (SELECT shard_id, count(*) AS cnt FROM b GROUP BY shard_id),
f AS (SELECT conv_id, turn, shard_id, p FROM b
      UNION ALL SELECT conv_id, turn, shard_id, cnt + p FROM b JOIN c USING (shard_id)
      WHERE p < ({SMALL_BATCH} - cnt % {SMALL_BATCH}) % {SMALL_BATCH}),
a AS (SELECT conv_id, turn, shard_id, p // {SMALL_BATCH} AS batch_id, p % {SMALL_BATCH} AS sample_pos FROM f),
d AS (SELECT shard_id, max(batch_id) + 1 AS done FROM a GROUP BY shard_id),
e AS (SELECT conv_id, turn, shard_id, batch_id, sample_pos FROM a
      UNION ALL SELECT conv_id, turn, shard_id, unnest(range(done, CAST(ceil(size / {SMALL_BATCH}) AS BIGINT))), sample_pos
      FROM a JOIN d USING (shard_id), z WHERE batch_id = 0)
SELECT conv_id, turn, shard_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(sample_pos AS INTEGER) AS sample_pos FROM e
""")
def shard_iterations(spark, sf_dir):
    """D3 + D4: every shard that has rows runs the same number of full batches."""
    o = _ordered(spark, sf_dir)
    n = o.count()
    filled = tr.fill_last_batch(tr.assign_shards(o, n, MANY_SHARDS), SMALL_BATCH)
    b = tr.fill_short_shards(tr.assign_batches(filled, SMALL_BATCH), tr.shard_iterations(n, MANY_SHARDS, SMALL_BATCH), SMALL_BATCH)
    return b.select("conv_id", "turn", "shard_id", "batch_id", "sample_pos")


# ------------------------------------------------------------ J12 / G1 / D6
def _samples(spark, sf_dir):
    """Every turn is a sample, in (conv, turn) order and batches of 4; an
    assistant's reply to it is its positive context (a turn without one has
    none), the turn before it a hard negative."""
    p = conversation_turns(spark, sf_dir)

    def ctx(turn, role, text):
        one = F.array(tr.ctx_struct(F.concat_ws("-", "conv_id", turn), role, text))
        return F.when(F.col(text).isNotNull(), one).otherwise(F.array().cast(tr.CTX_ARRAY))

    p = p.withColumn("positive_ctxs", ctx(F.col("turn") + 1, F.lit("assistant"), "answer")) \
        .withColumn("hard_negative_ctxs", ctx(F.col("turn") - 1, F.lit("turn"), "said_before"))
    o = tr.assign_positions(p, ["conv_id", "turn"])
    return (o.withColumn("batch_id", F.floor(F.col("pos") / SMALL_BATCH).cast("long"))
            .withColumn("sample_pos", (F.col("pos") % SMALL_BATCH).cast("int")))


_PAIRS_SQL = """
WITH p AS (SELECT u.conv_id, u.turn, CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS pos_id,
                  CAST(h.conv_id AS VARCHAR) || '-' || CAST(h.turn AS VARCHAR) AS hard_id
           FROM conversations u
           LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           LEFT JOIN conversations h ON h.conv_id = u.conv_id AND h.turn = u.turn - 1),
o AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM p),
b AS (SELECT *, pos // 4 AS batch_id, pos % 4 AS sample_pos FROM o),
neg AS (SELECT x.conv_id, x.turn,
               coalesce(string_agg(y.pos_id, ',' ORDER BY y.sample_pos), '') AS negative_ids,
               list_filter(list(y.pos_id ORDER BY y.sample_pos), lambda v: v IS NOT NULL) AS negs
        FROM b x LEFT JOIN b y ON x.batch_id = y.batch_id AND x.sample_pos <> y.sample_pos
        GROUP BY x.conv_id, x.turn)
"""


@register("inbatch_negatives", _PAIRS_SQL + """
SELECT conv_id, turn, negative_ids FROM neg
""")
def inbatch_negatives(spark, sf_dir):
    """Each sample's negatives are the other samples' positives of its batch."""
    s = tr.inbatch_negatives(_samples(spark, sf_dir))
    return s.select("conv_id", "turn", tr.ids_string("negative_ctxs").alias("negative_ids"))


@register("biencoder_batch", _PAIRS_SQL + """,
s AS (SELECT b.batch_id, b.sample_pos, b.pos_id, neg.negs[1:2] AS others,
             CASE WHEN b.hard_id IS NULL THEN [] ELSE [b.hard_id] END AS hards
      FROM b JOIN neg USING (conv_id, turn) WHERE b.pos_id IS NOT NULL),
c AS (SELECT *, list_concat(list_prepend(pos_id, others), hards) AS ctxs, len(others) AS n_other, len(hards) AS n_hard FROM s),
off AS (SELECT *, coalesce(sum(len(ctxs)) OVER (PARTITION BY batch_id ORDER BY sample_pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ctx_offset FROM c),
x AS (SELECT batch_id, sample_pos, ctx_offset, n_other, n_hard, unnest(ctxs) AS ctx_id, generate_subscripts(ctxs, 1) - 1 AS ctx_i FROM off)
SELECT batch_id, CAST(sample_pos AS INTEGER) AS sample_pos, CAST(ctx_offset + ctx_i AS BIGINT) AS ctx_pos,
       CASE WHEN ctx_i = 0 THEN 'positive' WHEN ctx_i <= n_other THEN 'other_negative' ELSE 'hard_negative' END AS role, ctx_id,
       CAST(ctx_offset AS BIGINT) AS gold_ctx_pos,
       CAST(ctx_offset + 1 + n_other AS BIGINT) AS hard_neg_start,
       CAST(ctx_offset + 1 + n_other + n_hard AS BIGINT) AS hard_neg_end
FROM x
""")
def biencoder_batch(spark, sf_dir):
    """G1 + W9 + U3 + T9: long-form two-tower batches -- 1 positive + the
    first 2 in-batch negatives + 1 hard negative per sample, running context
    offsets, gold index and the hard-negative index range."""
    b = tr.biencoder_batch(tr.inbatch_negatives(_samples(spark, sf_dir)), num_hard_negatives=1, num_other_negatives=2)
    return b.select("batch_id", "sample_pos", "ctx_pos", "role", "ctx_id", "gold_ctx_pos",
                    "hard_neg_start", "hard_neg_end")


@register("sample_negatives", _TS_SQL.replace(
    "agg AS (SELECT qid,",
    "hn AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)))"
    " AS r FROM lab WHERE NOT h),\n"
    "sampled AS (SELECT qid, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY r) AS ids FROM hn WHERE r <= 3"
    " GROUP BY qid),\nagg AS (SELECT qid,") + """
SELECT ts.qid, coalesce(sampled.ids, '') AS sampled_negative_ids FROM ts LEFT JOIN sampled USING (qid)
""")
def sample_negatives(spark, sf_dir):
    """D6 + T9: hard-negative pool permuted by a seeded hash, first 3 kept."""
    ts = training_set(spark, sf_dir)
    pool = tr.sort_by_hash(F.col("hard_negative_ctxs"), 7)
    return ts.select("qid", F.array_join(F.transform(F.slice(pool, 1, 3), lambda c: c["id"]), ",")
                     .alias("sampled_negative_ids"))


@register("pick_by_index", _TS_SQL + """
SELECT qid, positive_ids, hard_negative_ids FROM ts
""")
def pick_by_index(spark, sf_dir):
    """F9 + F10 + G7: items carrying a document list (each question's BM25
    top-10 in rank order) plus positive / negative index lists (raw answer
    containment) become training samples by picking documents by index."""
    from rivulet.operators.training import CTX_ARRAY, ctx_struct, from_document_indices
    from rivulet.plans.text_search import labelled_hits
    from rivulet.sources.tables import passages, questions
    h = labelled_hits(spark, sf_dir, "raw").join(
        passages(spark, sf_dir).select(F.col("id").alias("doc_id"), "title", "text"), "doc_id")
    g = h.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(
        "rank", ctx_struct("doc_id", "title", "text").alias("c"), "has_answer"))).alias("__d"))
    items = g.select("qid", F.transform("__d", lambda x: x["c"]).alias("documents"),
                     F.transform(F.filter(F.transform("__d", lambda x: F.struct(x["rank"].alias("r"), x["has_answer"].alias("h"))),
                                          lambda y: y["h"]), lambda y: (y["r"] - 1).cast("int")).alias("positive_document_indices"),
                     F.transform(F.filter(F.transform("__d", lambda x: F.struct(x["rank"].alias("r"), x["has_answer"].alias("h"))),
                                          lambda y: ~y["h"]), lambda y: (y["r"] - 1).cast("int")).alias("negative_document_indices"))
    q = questions(spark, sf_dir).select("qid", F.lit("").alias("answer"))
    items = q.join(items, "qid", "left").withColumn(
        "documents", F.coalesce("documents", F.array().cast(CTX_ARRAY)))
    ts = from_document_indices(items)
    return ts.select("qid", ids_string("positive_ctxs").alias("positive_ids"),
                     ids_string("hard_negative_ctxs").alias("hard_negative_ids"))


@register("global_offsets", _PAIRS_SQL + """,
n AS (SELECT b.conv_id, b.turn, b.pos, 1 + least(len(negs), 2) AS n_ctx FROM b JOIN neg USING (conv_id, turn)),
t AS (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) AS size FROM n),
d AS (SELECT conv_id, turn, n_ctx, pos // size AS shard_id, pos % size AS place FROM n, t)
SELECT conv_id, turn, CAST(shard_id AS INTEGER) AS shard_id, CAST(place // 16 AS BIGINT) AS batch_id,
       CAST(coalesce(sum(n_ctx) OVER (PARTITION BY place // 16 ORDER BY shard_id, place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_ctx_offset FROM d
""")
def global_offsets(spark, sf_dir):
    """Where each sample's contexts begin among those of its global batch,
    which gathers the same batch of all shards."""
    s = tr.inbatch_negatives(_samples(spark, sf_dir)).select(
        "conv_id", "turn", "pos", (F.lit(1) + F.least(F.size("negative_ctxs"), F.lit(2))).alias("n_ctx"))
    s = tr.assign_batches(tr.assign_shards(s, s.count(), SHARDS), BATCH)
    return tr.global_batch_offsets(s).select("conv_id", "turn", "shard_id", "batch_id", "global_ctx_offset")


@register("visited_turns", """
SELECT conv_id, turn, length(text) AS n_chars, CAST(md5(text) AS VARCHAR) AS text_md5 FROM conversations
""")
def visited_turns(spark, sf_dir):
    """A visitor of the user's called on every row."""
    def visit(rows):
        import hashlib
        text = rows["text"].fillna("")
        return rows.assign(n_chars=text.str.len(), text_md5=[hashlib.md5(t.encode()).hexdigest() for t in text])[["conv_id", "turn", "n_chars", "text_md5"]]

    return tr.apply_visitor(_turns(spark, sf_dir), visit, "conv_id long, turn long, n_chars long, text_md5 string")
