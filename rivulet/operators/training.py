"""Training-set assembly, sampling, sharding and batching
(G1, G5, G7, A3, A7, F7-F10, U1-U3, U6, D1-D6, J12, J14, T9, A14).

Order is explicit everywhere: a deterministic hash (``md5`` of seed+epoch and
key) replaces the reference's in-place ``random.shuffle`` so that an
epoch's order is a pure function of (key, seed, epoch) and independent of the
partitioning.  Batches are bounded groups (the batch size), so per-batch
collections are safe; nothing is ever collected per shard or globally.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.text import normalize_question
from rivulet.operators.order import add_dense_id

CTX = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
                    T.StructField("text", T.StringType())])
CTX_ARRAY = T.ArrayType(CTX)


def ctx_struct(id_col="id", title="title", text="text") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(id_col).cast("string").alias("id"), c(title).cast("string").alias("title"),
                    c(text).cast("string").alias("text"))


# ---------------------------------------------------------------- G5 / A7 / A3
def build_training_set(labelled_hits: DataFrame, passages: DataFrame, questions: DataFrame, *,
                       qid: str = "qid", id_col: str = "id", title: str = "title",
                       text: str = "text", hit: str = "has_answer") -> DataFrame:
    """G5 + A7 + F10: split each question's ranked hits into positive and
    hard-negative context arrays (rank order kept); ``negative_ctxs`` is empty.

    ``labelled_hits``: ``qid, rank, doc_id, has_answer`` (e.g. BM25 top-k
    labelled by raw containment).  One group per question, bounded by k.
    """
    docs = passages.select(F.col(id_col).alias("doc_id"), F.col(title).alias("__t"),
                           F.col(text).alias("__x")).join(labelled_hits.select("doc_id").distinct(), "doc_id", "left_semi")
    h = labelled_hits.select(F.col(qid).alias("qid"), "rank", "doc_id", F.col(hit).alias("__h")) \
        .join(docs, "doc_id", "left")
    entry = F.struct(F.col("rank"), ctx_struct("doc_id", "__t", "__x").alias("c"))
    g = h.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("__h"), entry))).alias("__p"),
        F.array_sort(F.collect_list(F.when(~F.col("__h"), entry))).alias("__n"))
    out = questions.withColumnRenamed(qid, "qid").join(g, "qid", "left")
    empty = F.array().cast(CTX_ARRAY)
    return (out.withColumn("positive_ctxs", F.coalesce(F.transform("__p", lambda e: e["c"]), empty))
            .withColumn("negative_ctxs", empty)
            .withColumn("hard_negative_ctxs", F.coalesce(F.transform("__n", lambda e: e["c"]), empty))
            .drop("__p", "__n"))


def positive_counts() -> dict[str, Column]:
    """A3: questions with >=1 positive, with none, and the total (must agree),
    as aggregates for :func:`rivulet.operators.quality.counted`."""
    n = F.size(F.coalesce("positive_ctxs", F.array().cast(CTX_ARRAY)))
    return {"n_with_positive": F.count_if(n > 0), "n_without_positive": F.count_if(n == 0), "n_total": F.count(F.lit(1))}


def ids_string(arr_col: str) -> Column:
    """Ordered ids of a context array as one comma-joined string."""
    return F.array_join(F.transform(F.col(arr_col), lambda c: c["id"]), ",")


# ---------------------------------------------------------------- G7 / F9 / F10
def from_document_indices(items: DataFrame, *, documents: str = "documents",
                          pos_idx: str = "positive_document_indices",
                          neg_idx: str = "negative_document_indices",
                          answer: str = "answer") -> DataFrame:
    """Pick documents by 0-based index lists (F9) and reshape to the
    training schema (F10): scalar answer wrapped in an array."""
    pick = lambda idx: F.transform(F.coalesce(F.col(idx), F.array().cast("array<int>")),
                                   lambda i: F.element_at(F.col(documents), i + 1))
    return (items.withColumn("answers", F.array(F.col(answer)))
            .withColumn("positive_ctxs", pick(pos_idx))
            .withColumn("negative_ctxs", F.array().cast(CTX_ARRAY))
            .withColumn("hard_negative_ctxs", pick(neg_idx))
            .drop(documents, pos_idx, neg_idx, answer))


# ---------------------------------------------------------------- U1 / U2 / F7
def upsample(df: DataFrame, rates: dict, *, source: str = "source") -> DataFrame:
    """Repeat the rows of source i ``rates[i]`` times (only an explicit
    rate 0 drops; a source without a rate raises when its row is met).

    The rate map is a parameter (one entry per input file), not data."""
    rate = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(int(v)))])
    r = F.coalesce(rate[F.col(source)], F.raise_error(F.concat(
        F.lit("no rate for source "), F.coalesce(F.col(source).cast("string"), F.lit("null")))).cast("int"))
    return (df.withColumn("__rep", F.explode(F.sequence(F.lit(1), F.greatest(r, F.lit(1)))))
            .where(r > 0).withColumnRenamed("__rep", "copy"))


def drop_no_positives(samples: DataFrame, col: str = "positive_ctxs") -> DataFrame:
    """Keep samples with at least one positive context."""
    return samples.where(F.size(F.coalesce(F.col(col), F.array())) > 0)


def dedup_last_wins(df: DataFrame, key, order: str) -> DataFrame:
    """One row per key, the last one in ``order`` (dict overwrite).

    ``max_by`` is partially aggregated before the shuffle, so a key holding a
    large share of the rows costs one small partial per task instead of one
    huge sorted window partition."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return g.select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- D1 / D2 / D3
def shuffle_key(key_cols, seed: int, epoch: int = 0) -> Column:
    """Deterministic shuffle key, a pure function of (key, seed, epoch):
    the first 60 bits of ``md5("{seed+epoch}:{key...}")`` as a BIGINT."""
    cols = key_cols if isinstance(key_cols, (list, tuple)) else [key_cols]
    h = F.md5(F.concat_ws(":", F.lit(str(seed + epoch)), *[F.col(c).cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def epoch_order(df: DataFrame, key_cols, seed: int, epoch: int = 0, name: str = "pos",
                num_partitions: int | None = None) -> DataFrame:
    """D1 + W4: 0-based position of every row in the epoch's shuffled order
    (ties on the 60-bit key broken by the key columns)."""
    cols = key_cols if isinstance(key_cols, (list, tuple)) else [key_cols]
    d = df.withColumn("__sk", shuffle_key(cols, seed, epoch))
    return add_dense_id(d, ["__sk", *cols], name=name, start=0,
                        num_partitions=num_partitions).drop("__sk")


def assign_positions(df: DataFrame, order_by, name: str = "pos",
                     num_partitions: int | None = None) -> DataFrame:
    """Dense 0-based position in a total order (W4 with start 0)."""
    return add_dense_id(df, order_by, name=name, start=0, num_partitions=num_partitions)


def assign_shards(df: DataFrame, n_rows: int, num_shards: int, *, pos: str = "pos",
                  how: str = "ceil") -> DataFrame:
    """Contiguous shards of the positions.

    ``how="ceil"`` (training iterator): shard size ceil(n/s).  ``how="floor"``
    (embedding job): size floor(n/s); the remainder rows go to the last shard
    (the reference drops them; ``how="floor_drop"`` reproduces that)."""
    s = max(num_shards, 1)
    if how == "ceil":
        size = -(-n_rows // s)
        shard = F.floor(F.col(pos) / F.lit(size))
    else:
        size = max(n_rows // s, 1)
        shard = F.least(F.floor(F.col(pos) / F.lit(size)), F.lit(s - 1))
    out = df.withColumn("shard_id", shard.cast("int"))
    out = out.withColumn("shard_size", F.lit(size).cast("long"))
    out = out.withColumn("pos_in_shard", (F.col(pos) - F.col("shard_id") * F.lit(size)).cast("long"))
    if how == "floor_drop":
        out = out.where(F.col(pos) < F.lit(size * s))
    return out


def assign_batches(df: DataFrame, batch_size: int, *, pos_in_shard: str = "pos_in_shard",
                   offset: int = 0) -> DataFrame:
    """D3 + D5: batch index inside the shard; resume skips batches < offset."""
    b = F.floor(F.col(pos_in_shard) / F.lit(batch_size)).cast("long")
    return (df.withColumn("batch_id", b)
            .withColumn("sample_pos", (F.col(pos_in_shard) % F.lit(batch_size)).cast("int"))
            .where(F.col("batch_id") >= offset))


def shard_iterations(n_rows: int, num_shards: int, batch_size: int, strict: bool = True) -> int:
    """D3: batches every (ceil-sized) shard runs in an epoch; without ``strict``
    a last batch that the full shard cannot fill does not count."""
    size = -(-n_rows // max(num_shards, 1))
    return -(-size // batch_size) if strict else size // batch_size


def fill_short_shards(batches: DataFrame, iterations: int, batch_size: int, *, shard: str = "shard_id") -> DataFrame:
    """Shards that are through before ``iterations`` batches run their first
    batch again until all are equally long.  ``batches``: output of
    :func:`assign_batches`; a shard without rows stays empty."""
    done = batches.groupBy(shard).agg((F.max("batch_id") + 1).alias("__done")).where(F.col("__done") < iterations)
    again = (batches.where((F.col("batch_id") == 0) & (F.col("sample_pos") < batch_size)).join(done, shard)
             .withColumn("batch_id", F.explode(F.sequence(F.col("__done"), F.lit(iterations - 1).cast("long")))).drop("__done"))
    return batches.unionByName(again)


def fill_last_batch(df: DataFrame, batch_size: int, *, shard: str = "shard_id",
                    pos_in_shard: str = "pos_in_shard") -> DataFrame:
    """U6 + D4: strict batch size -- a short last batch of a shard is extended
    with the shard's first rows (wrap-around).

    Needs the shard's size: per-shard counts (one row per shard) are joined
    back; the appended rows are the shard's rows with position < missing."""
    sizes = df.groupBy(shard).agg(F.count(F.lit(1)).alias("__n"))
    d = df.join(sizes, shard)
    missing = (F.lit(batch_size) - F.col("__n") % F.lit(batch_size)) % F.lit(batch_size)
    extra = (d.where(F.col(pos_in_shard) < missing)
             .withColumn(pos_in_shard, F.col("__n") + F.col(pos_in_shard)))
    out = d.unionByName(extra).drop("__n")
    return out


# ---------------------------------------------------------------- D6 / T9 / U3
def sort_by_hash(arr: Column, seed: int, key: str = "id") -> Column:
    """Deterministic permutation of an array of structs by md5(seed, key)."""
    return F.transform(
        F.array_sort(F.transform(arr, lambda c: F.struct(
            F.md5(F.concat_ws(":", F.lit(str(seed)), c[key])).alias("__k"), c.alias("__c")))),
        lambda s: s["__c"])


# ---------------------------------------------------------------- J12
def inbatch_negatives(batched: DataFrame, *, batch: str = "batch_id", pos: str = "sample_pos",
                      positives: str = "positive_ctxs") -> DataFrame:
    """Every sample's negatives = the positives of the *other* samples of
    its batch, in batch order.  Batches are bounded (batch size): their
    positives are collected once per batch and attached by an equi-join."""
    per_b = (batched.groupBy(batch)
             .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"),
                                                       F.col(positives).alias("c")))).alias("__all")))
    j = batched.join(per_b, batch)
    others = F.filter("__all", lambda e: e["p"] != F.col(pos))
    return (j.withColumn("negative_ctxs", F.flatten(F.transform(others, lambda e: e["c"])))
            .drop("__all"))


# ---------------------------------------------------------------- G1 / W9
def biencoder_batch(batched: DataFrame, *, batch: str = "batch_id", pos: str = "sample_pos",
                    num_hard_negatives: int = 1, num_other_negatives: int = 0,
                    shuffle: bool = False, shuffle_positives: bool = False, seed: int = 0,
                    compat: bool = False) -> DataFrame:
    """G1: two-tower batch in long form.

    Per sample: question normalized (X8); contexts = [1 positive] + first
    ``num_other_negatives`` negatives + first ``num_hard_negatives`` hard
    negatives (U3, T9; D6 permutes pools by a seeded hash when ``shuffle``).
    ``ctx_offset`` = number of contexts of the earlier samples in the batch (W9),
    so the gold index is ``ctx_offset``.  Hard-negative index range starts
    after the other negatives (``compat=True`` reproduces the reference's start
    at 1).  Returns one row per (batch, sample, context).
    """
    pos_arr = F.coalesce(F.col("positive_ctxs"), F.array().cast(CTX_ARRAY))
    neg_arr = F.coalesce(F.col("negative_ctxs"), F.array().cast(CTX_ARRAY))
    hard_arr = F.coalesce(F.col("hard_negative_ctxs"), F.array().cast(CTX_ARRAY))
    if shuffle:
        neg_arr = sort_by_hash(neg_arr, seed)
        hard_arr = sort_by_hash(hard_arr, seed + 1)
    if shuffle and shuffle_positives:
        pos_arr = sort_by_hash(pos_arr, seed + 2)
    others = F.slice(neg_arr, 1, num_other_negatives) if num_other_negatives > 0 \
        else F.array().cast(CTX_ARRAY)
    hards = F.slice(hard_arr, 1, num_hard_negatives) if num_hard_negatives > 0 \
        else F.array().cast(CTX_ARRAY)
    s = (batched.where(F.size(pos_arr) > 0)
         .withColumn("question", normalize_question(F.col("question")))
         .withColumn("__ctx", F.concat(F.slice(pos_arr, 1, 1), others, hards))
         .withColumn("__n_other", F.size(others)).withColumn("__n_hard", F.size(hards))
         .withColumn("__n", F.size("__ctx")))
    w = Window.partitionBy(batch).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("ctx_offset", F.coalesce(F.sum("__n").over(w), F.lit(0)).cast("long"))
    hard_start = F.lit(1) if compat else 1 + F.col("__n_other")
    s = (s.withColumn("hard_neg_start", F.col("ctx_offset") + hard_start)
         .withColumn("hard_neg_end", F.col("ctx_offset") + 1 + F.col("__n_other") + F.col("__n_hard")))
    out = s.select(batch, pos, "question", "ctx_offset", "hard_neg_start", "hard_neg_end",
                   "__n_other", F.posexplode("__ctx").alias("ctx_i", "ctx"))
    role = (F.when(F.col("ctx_i") == 0, "positive")
            .when(F.col("ctx_i") <= F.col("__n_other"), "other_negative")
            .otherwise("hard_negative"))
    return out.select(batch, pos, "question", (F.col("ctx_offset") + F.col("ctx_i")).alias("ctx_pos"),
                      role.alias("role"), F.col("ctx.id").alias("ctx_id"),
                      F.col("ctx.title").alias("ctx_title"), F.col("ctx.text").alias("ctx_text"),
                      F.col("ctx_offset").alias("gold_ctx_pos"), "hard_neg_start", "hard_neg_end")


# ---------------------------------------------------------------- J14 / D9
def global_batch_offsets(batches: DataFrame, *, batch: str = "batch_id", shard: str = "shard_id",
                         pos: str = "sample_pos", n_ctx: str = "n_ctx") -> DataFrame:
    """A global batch gathers the same batch index of every shard; each
    sample's gold context index in the gathered context list is the number of
    contexts of all earlier shards plus earlier samples of its own shard.
    The running sum is a window per global batch (bounded by shards x batch
    size).  Adds ``global_ctx_offset``."""
    w = Window.partitionBy(batch).orderBy(shard, pos).rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("global_ctx_offset", F.coalesce(F.sum(n_ctx).over(w), F.lit(0)).cast("long"))


def apply_visitor(df: DataFrame, visitor, schema) -> DataFrame:
    """Run a per-row visitor over every row of every shard, Arrow-batched
    (``visitor(pandas.DataFrame) -> pandas.DataFrame``)."""
    def run(batches):
        for pdf in batches:
            yield visitor(pdf)
    return df.mapInPandas(run, schema)
