"""Retrieval and reader evaluation metrics.

All metrics are aggregates with map-side partial aggregation; nothing is
collected except the final (small, parameter-bounded) result rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions.bind import let
from rivulet.functions.text import exact_match
from rivulet.functions.vector import dot


def first_hit(hits: DataFrame, qid: str = "qid", rank: str = "rank",
              hit: str = "has_answer") -> DataFrame:
    """Smallest rank with a hit per question (questions without hits absent)."""
    return hits.where(F.col(hit)).groupBy(qid).agg(F.min(rank).alias("first_hit"))


def acc_at_k(hits: DataFrame, n: int, questions: DataFrame | None = None, *,
             qid: str = "qid", rank: str = "rank", hit: str = "has_answer") -> DataFrame:
    """A1: ``top_k, n_hits, acc`` for k = 1..n.

    The denominator is every question (``questions`` if given, else every qid
    present in ``hits``), as in the reference; acc is rounded to 4 places.
    One pass: a single global aggregate with ``n`` conditional counts.
    """
    fh = first_hit(hits, qid, rank, hit)
    base = (questions.select(qid) if questions is not None else hits.select(qid)).distinct()
    per_q = base.join(fh, qid, "left")
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col("first_hit") <= k).alias(f"h{k}") for k in range(1, n + 1)]
    row = per_q.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(k).alias("top_k"), F.col(f"h{k}").alias("n_hits"))
                      for k in range(1, n + 1)])
    return (row.select("total", F.explode(pairs).alias("p"))
            .select(F.col("p.top_k").cast("int").alias("top_k"),
                    F.col("p.n_hits").cast("long").alias("n_hits"),
                    F.round(F.col("p.n_hits") / F.col("total"), 4).alias("acc")))


def em_at_n(preds: DataFrame, *, top_k: str = "top_k", prediction: str = "prediction",
            gold: str = "gold_answers") -> DataFrame:
    """A2: per threshold, mean over questions of max-over-golds exact match (x100, 2 dp)."""
    em = F.exists(F.col(gold), lambda g: exact_match(F.col(prediction), g))
    return (preds.withColumn("em_hit", F.coalesce(em, F.lit(False)).cast("int"))
            .groupBy(top_k)
            .agg(F.count(F.lit(1)).alias("n_questions"),
                 F.round(F.avg("em_hit") * 100, 2).alias("em")))


def avg_gold_rank(ranks: DataFrame, rank: str = "gold_rank") -> DataFrame:
    """A4 + A15: sum of ranks and count merged across partitions, then divided."""
    return ranks.agg(F.sum(rank).cast("long").alias("rank_sum"),
                     F.count(F.lit(1)).alias("n_questions"),
                     F.round(F.sum(rank) / F.count(F.lit(1)), 4).alias("avg_rank"))


def inbatch_nll(questions: DataFrame, contexts: DataFrame, *, batch: str = "batch_id",
                q_pos: str = "q_pos", qvec: str = "qvec", gold_pos: str = "gold_pos",
                ctx_pos: str = "ctx_pos", cvec: str = "cvec") -> DataFrame:
    """A5: in-batch negative log-likelihood and correct-prediction count.

    For each question, scores against every context of its batch form a
    log-softmax; loss = -logp(gold); correct = first argmax == gold.  Batches
    are bounded groups (the batch size), so the context list of a batch is
    collected once per batch and attached to its questions by an equi-join.
    Returns per-question rows ``batch_id, q_pos, loss, correct``.
    """
    ctx = (contexts.groupBy(batch)
           .agg(F.array_sort(F.collect_list(F.struct(F.col(ctx_pos).alias("pos"),
                                                     F.col(cvec).alias("v")))).alias("ctxs")))
    j = questions.join(ctx, batch)

    def body(scores, gold):  # scores bound once per row
        m = F.array_max(scores)
        return let(lambda mm: F.struct(
            (mm + F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - mm)))
             - F.element_at(scores, gold + 1)).alias("loss"),
            ((F.array_position(scores, mm) - 1) == gold).alias("correct")), m)

    r = let(body, F.transform(F.col("ctxs"), lambda c: dot(F.col(qvec), c["v"])), F.col(gold_pos))
    return j.select(batch, q_pos, r["loss"].alias("loss"), r["correct"].alias("correct"))


def nll_summary(per_q: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Reference roll-up: loss = mean over batches of the batch-mean loss."""
    per_b = per_q.groupBy(batch).agg(F.avg("loss").alias("bl"),
                                     F.count_if("correct").alias("c"),
                                     F.count(F.lit(1)).alias("n"))
    return per_b.agg(F.count(F.lit(1)).alias("n_batches"),
                     F.round(F.avg("bl"), 4).alias("loss"),
                     F.sum("c").cast("long").alias("correct"),
                     F.sum("n").cast("long").alias("total"),
                     F.round(F.sum("c") / F.sum("n"), 4).alias("correct_ratio"))


def metrics_rollup(log: DataFrame, *, run: str = "run", epoch: str = "epoch",
                   step: str = "step", loss: str = "loss", correct: str = "correct",
                   block: int = 100) -> DataFrame:
    """Per (run, epoch, block of steps) mean loss and accuracy.

    accuracy = correct / total, -inf when the block is empty of samples.
    """
    blk = F.floor(F.col(step) / block).cast("long")
    return (log.groupBy(run, epoch, blk.alias("block"))
            .agg(F.count(F.lit(1)).alias("n_steps"),
                 F.round(F.avg(loss), 4).alias("mean_loss"),
                 F.sum(F.col(correct).cast("long")).alias("n_correct"))
            .withColumn("accuracy", F.when(F.col("n_steps") > 0,
                                           F.round(F.col("n_correct") / F.col("n_steps"), 4))
                        .otherwise(F.lit(float("-inf")))))


def best_so_far(scores: DataFrame, *, run: str = "run", epoch: str = "epoch",
                score: str = "score", patience: int = 3) -> DataFrame:
    """Running best (strict improvement marks a new best checkpoint) and
    early stopping after ``patience`` consecutive scores below the best.

    ``scores`` has one row per (run, epoch) -- aggregate before calling.
    Returns every epoch with ``best_score``, ``is_best``, ``below_streak`` and
    ``stopped`` (true on and after the epoch where training would stop).
    """
    w = Window.partitionBy(run).orderBy(epoch)
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    s = scores.withColumn("prev_best", F.max(score).over(prev))
    s = s.withColumn("is_best", F.col("prev_best").isNull() | (F.col(score) > F.col("prev_best")))
    s = s.withColumn("below", F.col("prev_best").isNotNull() & (F.col(score) < F.col("prev_best")))
    s = s.withColumn("grp", F.sum(F.when(~F.col("below"), 1).otherwise(0))
                     .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wg = Window.partitionBy(run, "grp").orderBy(epoch)
    s = s.withColumn("below_streak", F.sum(F.col("below").cast("int"))
                     .over(wg.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("hit", F.col("below_streak") >= patience)
    s = s.withColumn("stopped", F.max(F.col("hit").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return s.select(run, epoch, score,
                    F.greatest(F.coalesce("prev_best", F.col(score)), F.col(score)).alias("best_score"),
                    "is_best", F.col("below_streak").cast("int").alias("below_streak"), "stopped")


def reader_span_loss(logits: DataFrame, *, qid: str = "qid", slot: str = "slot",
                     start: str = "start_logits", end: str = "end_logits",
                     relevance: str = "relevance", spans: str = "spans") -> DataFrame:
    """Reader loss from a logits table (one row per question slot, slot 0
    = the positive passage; ``spans`` = the slot's answer spans, absent =
    masked).  Per span: start CE + end CE (positions outside the sequence are
    ignored, loss 0); max over slots per answer index; marginal
    log-likelihood over answers; plus the switch loss (CE of the relevance
    logits against slot 0).  Returns one row: span_loss, switch_loss, loss."""
    def lse(col, _m=None):  # array and its max bound once per row
        return let(lambda v: let(lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))),
                                 F.array_max(v)), col)
    base = logits.select(qid, slot, relevance,
                         F.transform(start, lambda x: x.cast("double")).alias("__st"),
                         F.transform(end, lambda x: x.cast("double")).alias("__en"), spans)
    base = (base.withColumn("__ms", F.array_max("__st")).withColumn("__me", F.array_max("__en"))
            .withColumn("__lse_s", lse(F.col("__st"), F.col("__ms")))
            .withColumn("__lse_e", lse(F.col("__en"), F.col("__me"))))
    ex = base.select(qid, slot, "__st", "__en", "__lse_s", "__lse_e",
                     F.posexplode(spans).alias("__a", "__sp"))
    n = F.size("__st")
    ce_s = F.when(F.col("__sp.s") < n, F.col("__lse_s") - F.element_at("__st", F.col("__sp.s") + 1)) \
        .otherwise(F.lit(0.0))
    ce_e = F.when(F.col("__sp.e") < n, F.col("__lse_e") - F.element_at("__en", F.col("__sp.e") + 1)) \
        .otherwise(F.lit(0.0))
    per_a = ex.groupBy(qid, "__a").agg(F.max(ce_s + ce_e).alias("__l"))
    contrib = F.when(F.col("__l") == 0, F.lit(0.0)).otherwise(F.exp(-F.col("__l")))
    per_q = per_a.groupBy(qid).agg(F.sum(contrib).alias("__ml"))
    span_q = -F.log(F.col("__ml") + F.when(F.col("__ml") == 0, 1.0).otherwise(0.0))
    span = per_q.agg(F.sum(span_q).alias("span_loss"))
    rel = logits.groupBy(qid).agg(
        F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"),
                                             F.col(relevance).cast("double").alias("r")))).alias("__r"))
    rel = rel.select(F.transform("__r", lambda x: x["r"]).alias("__rv"))
    rel = rel.withColumn("__mr", F.array_max("__rv"))
    sw = rel.select((lse(F.col("__rv"), F.col("__mr")) - F.col("__rv")[0]).alias("__sw")) \
        .agg(F.sum("__sw").alias("switch_loss"))
    out = span.select("span_loss", sw.select("switch_loss").scalar().alias("switch_loss"))
    return out.select(F.round("span_loss", 4).alias("span_loss"), F.round("switch_loss", 4).alias("switch_loss"),
                      F.round(F.col("span_loss") + F.col("switch_loss"), 4).alias("loss"))
