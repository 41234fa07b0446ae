"""Reader data preparation and answer-span decoding
(G2, G3, G6, X16-X21, X27, T3-T8, F12, F13, F17, F18, D7, D8, J9).

Token sequences are ARRAY<STRING> from the pluggable tokenizer (default: the
simple tokenizer X6).  Spans are inclusive token positions.  Everything is
per question (bounded by the retrieval depth) or per passage (bounded by the
passage length); span candidates are scored inside array expressions, never
exploded into one row per (start, end) pair.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.bind import let
from rivulet.functions.text import nfkc, tokenize
from rivulet.functions.tokens import extend_span_to_words, is_subword


@dataclass(frozen=True)
class ReaderConfig:
    """Passage selection parameters (reference defaults)."""
    max_retriever_passages: int = 200
    max_positives: int = 20
    max_negatives: int = 50      # used as the lower bound of the negative limit
    min_negatives: int = 150     # used as the upper bound of the negative limit
    eval_passages: int = 100
    skip_no_positives: bool = True
    gold_page_only_positives: bool = True   # both act only where gold passages are given
    include_gold_passage: bool = False


#: Spans of many passages that are scored at a time.
SLICE_SPANS = 1 << 18
SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])


def answer_positions(ctx: Column, ans: Column) -> Column:
    """Every (s, e) where ``ans`` occurs as a token subsequence of
    ``ctx`` (inclusive ends, overlaps kept).  Both arrays are bound once per
    row, so a computed ``ctx`` is never re-evaluated per position."""
    def body(c, a_arr):
        a = F.size(a_arr)
        starts = F.sequence(F.lit(0), F.size(c) - a)
        hit = F.filter(starts, lambda i: (c[i] == a_arr[0]) & (F.slice(c, i + 1, a) == a_arr))
        return F.when((a > 0) & (F.size(c) >= a),
                      F.transform(hit, lambda i: F.struct(i.cast("int").alias("s"),
                                                          (i + a - 1).cast("int").alias("e")))) \
            .otherwise(F.array().cast(T.ArrayType(SPAN)))
    return let(body, ctx, ans)


def shift_spans(spans: Column, offset: Column) -> Column:
    """Add the passage offset to every span."""
    return F.transform(spans, lambda x: F.struct((x["s"] + offset).cast("int").alias("s"),
                                                 (x["e"] + offset).cast("int").alias("e")))


def pad_ids(ids: Column, length: int, pad="[PAD]") -> Column:
    """Pad / truncate a sequence to ``length``."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids: Column, pad="[PAD]") -> Column:
    """1 where the id is not the pad id."""
    return F.transform(ids, lambda x: (x != F.lit(pad)).cast("int"))


def pair_sequence(question: Column, title: Column, passage: Column, tailing_sep: bool = False,
                  cls: str = "[CLS]", sep: str = "[SEP]") -> Column:
    """[CLS] question [SEP] title [SEP] passage, with another separator at
    the end if asked for; a null part is empty."""
    def part(c: Column) -> Column:
        return F.coalesce(c, F.array().cast("array<string>"))

    mark = F.array(F.lit(sep))
    return F.concat(F.array(F.lit(cls)), part(question), mark, part(title), mark, part(passage), *([mark] if tailing_sep else []))


def _place() -> Column:
    """Order of a question's passages: by rank, an added gold passage last."""
    return F.struct((F.col("rank") < 0).alias("added"), F.col("rank").alias("rank"))


def _one_gold(gold: DataFrame, questions: DataFrame) -> DataFrame:
    """One gold passage (``qid, doc_id, title, text``) per asked question,
    the last by ``ord`` (without such a column the greatest doc_id)."""
    last = F.col("ord") if "ord" in gold.columns else F.col("doc_id")
    asked = gold.join(questions.select("qid"), "qid", "left_semi")
    return (asked.groupBy("qid").agg(F.max(F.struct(last.alias("o"), "doc_id", "title", "text")).alias("g"))
            .select("qid", "g.doc_id", "g.title", "g.text"))


def reader_select(hits: DataFrame, passages: DataFrame, questions: DataFrame,
                  cfg: ReaderConfig = ReaderConfig(), train: bool = True, *, gold: DataFrame | None = None,
                  id_col: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """Retrieval hits (``qid, rank, doc_id, has_answer``) -> reader passages.

    T3 cut at ``max_retriever_passages``; F13 split by ``has_answer`` (eval:
    everything is a candidate); X16 answer spans on the token sequence; Q15
    positives without a span are dropped.  J9: where ``gold`` (``qid, doc_id,
    title, text``) is given and positives come from the gold passage's page,
    these are taken, all of them; else T4 the first ``max_positives``.  J11:
    with ``include_gold_passage`` the gold passage itself joins the positives
    (rank -1) unless it is among them or holds no answer.  T5: the negative
    limit follows from the positives taken, the gold passage counted; F8
    questions without positives skipped.
    X18: sequence = [CLS] question [SEP] title [SEP] passage, so spans shift by
    ``passage_offset`` = len(question) + len(title) + 3 (X17).

    Returns one row per selected passage:
    ``qid, role, rank, doc_id, passage_offset, spans``.
    """
    q = questions.select("qid", F.col("question"),
                         F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))
    qa = (q.select("qid", F.posexplode("answers").alias("ai", "a"))
          .withColumn("a_tok", tokenize(nfkc("a")))
          .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ai", "a_tok"))).alias("__a")))
    qt = q.select("qid", F.size(tokenize(nfkc("question"))).alias("q_len"))
    h = hits.where(F.col("rank") <= cfg.max_retriever_passages).select("qid", "rank", "doc_id", "has_answer")

    def tokenized(of: DataFrame, key: str, doc_id, name: str, body: str) -> DataFrame:
        return of.select(*([key] if key else []), F.col(doc_id).alias("doc_id"), F.lower(name).alias("__title"),
                         F.size(tokenize(nfkc(F.col(name)))).alias("t_len"), tokenize(nfkc(F.col(body))).alias("p_tok"))

    docs = tokenized(passages, "", id_col, title, text).join(h.select("doc_id").distinct(), "doc_id", "left_semi")
    j = h.join(docs, "doc_id", "left").withColumn("__gold", F.lit(False))
    with_gold = gold is not None and train
    if with_gold:
        one = _one_gold(gold, questions)
        if cfg.include_gold_passage:
            own = tokenized(one, "qid", "doc_id", "title", "text").withColumns({
                "rank": F.lit(-1).cast(h.schema["rank"].dataType), "has_answer": F.lit(True), "__gold": F.lit(True)})
            j = j.unionByName(own)
        j = j.join(one.select("qid", F.lower("title").alias("__gold_title"), F.col("doc_id").alias("__gold_id")), "qid", "left")
    j = j.join(qa, "qid", "left").join(qt, "qid", "left")
    is_pos = F.col("has_answer") if train else F.lit(False)
    spans = F.flatten(F.transform(F.coalesce("__a", F.array()),
                                  lambda x: answer_positions(F.col("p_tok"), x["a_tok"])))
    j = j.withColumn("cand_pos", is_pos)
    j = j.withColumn("spans", F.when(F.col("cand_pos"), spans).otherwise(F.array().cast(T.ArrayType(SPAN))))
    j = j.withColumn("passage_offset", (F.col("q_len") + F.coalesce("t_len", F.lit(0)) + 3).cast("int"))
    # one pass, windows per question (bounded by the retrieval depth): running
    # counts pick the first positives / negatives, no self-joins
    is_p = F.col("cand_pos") & (F.size("spans") > 0) & ~F.col("__gold")
    is_n = ~F.col("cand_pos")
    per_q = Window.partitionBy("qid")
    run = per_q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = (j.withColumn("__ip", is_p.cast("int")).withColumn("__in", is_n.cast("int"))
         .withColumn("__pr", F.sum("__ip").over(run)).withColumn("__nr", F.sum("__in").over(run)))
    first = (F.col("__ip") == 1) & (F.col("__pr") <= cfg.max_positives)
    if with_gold:
        on_page = F.lit(False) if not cfg.gold_page_only_positives else F.coalesce(F.col("__title") == F.col("__gold_title"), F.lit(False))
        j = j.withColumn("__page", (F.col("__ip") == 1) & on_page)
        j = j.withColumn("__keep", F.when(F.max("__page").over(per_q), F.col("__page")).otherwise(first))
        there = F.max(F.col("__keep") & (F.col("doc_id") == F.col("__gold_id"))).over(per_q)
        j = j.withColumn("__there", there).withColumn(
            "__keep", F.col("__keep") | (F.col("__gold") & (F.size("spans") > 0) & ~F.col("__there")))
    else:
        j = j.withColumn("__keep", first)
    j = j.withColumn("__np", F.sum(F.col("__keep").cast("int")).over(per_q))
    if train:
        limit = F.least(F.greatest(10 * F.col("__np"), F.lit(cfg.max_negatives)), F.lit(cfg.min_negatives))
    else:
        limit = F.lit(cfg.eval_passages)
    keep_p = F.col("__keep")
    keep_n = (F.col("__in") == 1) & (F.col("__nr") <= limit)
    if train and cfg.skip_no_positives:
        keep_n = keep_n & (F.col("__np") > 0)
    out = j.where(keep_p | keep_n)
    empty = F.array().cast(T.ArrayType(SPAN))
    return out.select("qid", F.when(keep_p, "positive").otherwise("negative").alias("role"), "rank",
                      "doc_id", "passage_offset",
                      F.when(keep_p, shift_spans(F.col("spans"), F.col("passage_offset")))
                      .otherwise(empty).alias("spans"))


def reader_batch(selected: DataFrame, *, passages_per_question: int = 4, max_length: int = 256,
                 max_n_answers: int = 10) -> DataFrame:
    """G3 + D7 + D8 + F12 + F18 + X27: M slots per question -- slot 0 is the
    first positive (by rank) with a span inside ``max_length``, then the
    first negatives, then empty slots.  Questions without such a positive are
    dropped.  Returns ``qid, slot, doc_id (null = empty), n_answers``."""
    in_range = F.filter("spans", lambda x: (x["s"] < max_length) & (x["e"] < max_length))
    w = Window.partitionBy("qid").orderBy(_place())
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = selected.withColumn("ok_spans", in_range)
    okp = ((F.col("role") == "positive") & (F.size("ok_spans") > 0)).cast("int")
    neg = (F.col("role") == "negative").cast("int")
    s = (s.withColumn("__okp", okp).withColumn("__neg", neg)
         .withColumn("__pr", F.sum("__okp").over(run)).withColumn("__nr", F.sum("__neg").over(run)))
    slot = (F.when((F.col("__okp") == 1) & (F.col("__pr") == 1), F.lit(0))
            .when((F.col("__neg") == 1) & (F.col("__nr") < passages_per_question), F.col("__nr")))
    s = s.withColumn("slot", slot).where(F.col("slot").isNotNull())
    n_ans = F.when(F.col("slot") == 0, F.size(F.slice("ok_spans", 1, max_n_answers))).otherwise(F.lit(0))
    # one bounded group per question (at most M kept rows)
    g = s.groupBy("qid").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), "doc_id",
                                                     n_ans.cast("int").alias("n"))).alias("__k"))
    g = g.where(F.exists("__k", lambda x: x["slot"] == 0))
    grid = F.transform(F.sequence(F.lit(0), F.lit(passages_per_question - 1)),
                       lambda i: F.struct(i.cast("int").alias("slot"),
                                          F.get(F.filter("__k", lambda x: x["slot"] == i), F.lit(0)).alias("x")))
    out = g.select("qid", F.explode(grid).alias("c"))
    return out.select("qid", F.col("c.slot").alias("slot"), F.col("c.x.doc_id").alias("doc_id"),
                      F.coalesce(F.col("c.x.n"), F.lit(0)).cast("int").alias("n_answers"))


def _answers_of(name: str, row: Column) -> Column:
    return row["a"][name]


def reader_tensors(selected: DataFrame, sequences: DataFrame, *, passages_per_question: int = 4, max_length: int = 256,
                   max_n_answers: int = 10, pad="[PAD]", train: bool = True, seed: int | None = None) -> DataFrame:
    """G3 + D7 + D8 + X19 + X27: one row per question with ``passages_per_question``
    rows of ``max_length`` ids (``input_ids``) and, in training, the
    ``start_positions``, ``end_positions`` and ``answer_mask`` of each row.

    ``selected``: output of :func:`reader_select`; ``sequences``: ``qid, doc_id,
    ids``.  Row 0 is a positive: the first one with a span inside ``max_length``,
    or with ``seed`` a drawn one, if that has such a span.  Then come the first
    negatives, with ``seed`` drawn ones, then rows of ``pad``.  Questions without
    such a positive have no row (F18).  In evaluation all rows are passages in
    order.  Draws hang on (seed, qid, doc_id) alone.

    Passages are chosen on their ids and spans; the sequences of the chosen
    alone are joined.  A group holds at most the passages of one question.
    """
    m = passages_per_question
    ok = F.filter("spans", lambda x: (x["s"] < max_length) & (x["e"] < max_length)).alias("ok")
    draw = (F.lit("") if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), "qid", "doc_id"))).alias("draw")
    entry = F.struct(draw, _place().alias("place"), "doc_id", ok)
    per_q = selected.groupBy("qid").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "positive", entry))).alias("p"),
                                        F.array_sort(F.collect_list(F.when(F.col("role") == "negative", entry))).alias("n"))
    no_spans = F.array().cast(T.ArrayType(SPAN))

    def others(n: int) -> Column:
        return F.transform(F.slice("n", 1, n), lambda x: F.struct(x["doc_id"].alias("doc_id"), no_spans.alias("ok")))

    if train:
        by_place = F.array_min(F.transform(F.filter("p", lambda x: F.size(x["ok"]) > 0), lambda x: F.struct(
            x["place"].alias("place"), x["doc_id"].alias("doc_id"), x["ok"].alias("ok"))))
        drawn = F.get("p", F.lit(0))  # sorted by draw; without a seed by place
        chosen = per_q.withColumn("first", F.when(F.size(drawn["ok"]) > 0, F.struct(drawn["doc_id"].alias("doc_id"), drawn["ok"].alias("ok")))
                                  .otherwise(F.struct(by_place["doc_id"].alias("doc_id"), by_place["ok"].alias("ok"))))
        chosen = chosen.where(F.exists("p", lambda x: F.size(x["ok"]) > 0)).select(
            "qid", F.concat(F.array("first"), others(m - 1)).alias("rows"))
    else:
        chosen = per_q.select("qid", others(m).alias("rows"))
    rows = chosen.select("qid", F.posexplode_outer("rows").alias("slot", "x")).select("qid", "slot", "x.doc_id", "x.ok")
    ids = F.coalesce("ids", F.array().cast(sequences.schema["ids"].dataType))
    rows = rows.join(sequences.select("qid", "doc_id", "ids"), ["qid", "doc_id"], "left").select(
        "qid", F.struct("slot", pad_ids(ids, max_length, pad).alias("ids"), answer_matrices(F.col("ok"), max_n_answers).alias("a")).alias("row"))
    got = rows.groupBy("qid").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def matrix(of, empty: Column) -> Column:
        return F.slice(F.concat(F.transform("rows", lambda r: of(r)), F.array_repeat(empty, m)), 1, m)

    zeros = F.array_repeat(F.lit(0), max_n_answers)
    out = [matrix(lambda r: r["ids"], F.array_repeat(F.lit(pad), max_length)).alias("input_ids")]
    if train:
        out += [matrix(partial(_answers_of, name), zeros).alias(name) for name in ("start_positions", "end_positions", "answer_mask")]
    return got.select("qid", *out)


def best_span(start: Column, end: Column, max_answer_length: int) -> Column:
    """W8 + T6 (top 1): the (s, e), e - s < L, maximizing start[s] + end[e];
    ties -> smallest s, then smallest e.  O(n * L) inside one array
    expression (logits bound once per row).  Returns struct(score, s, e) or
    null for empty logits."""
    def body(st, en):
        n = F.size(st)

        def at(i):
            win = F.transform(F.slice(en, i + 1, max_answer_length), lambda x: x.cast("double"))
            m = F.array_max(win)
            j = i + F.array_position(win, m) - 1
            return F.struct((st[i].cast("double") + m).alias("score"), (-i).alias("ni"), (-j).alias("nj"))

        best = F.array_max(F.transform(F.sequence(F.lit(0), n - 1), at))
        return F.when(n > 0, F.struct(best["score"].alias("score"), (-best["ni"]).cast("int").alias("s"),
                                      (-best["nj"]).cast("int").alias("e")))
    return let(body, start, end)


def word_edges(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the word of each token begins and ends, for rows of flags that tell
    which tokens go on with the word before them."""
    n = sub.shape[1]
    at = np.broadcast_to(np.arange(n), sub.shape)
    first = np.maximum.accumulate(np.where(sub, 0, at), axis=1)
    following = np.concatenate([np.where(sub, n, at)[:, 1:], np.full((len(sub), 1), n)], axis=1)
    return first, np.minimum.accumulate(following[:, ::-1], axis=1)[:, ::-1] - 1


def top_spans_of(start: np.ndarray, end: np.ndarray, max_length: int, top_n: int, sub: np.ndarray | None = None):
    """The best ``top_n`` spans of each of many passages of one length: (passage,
    rank, first token, last token, score).  ``start``, ``end`` and ``sub`` have a
    row for each passage.

    All spans of a passage stand in one matrix, first token by length.  The best
    is taken in all passages at once (ties: the smaller first token, then the
    shorter span), moved out to whole words, and every span that holds it or
    that it holds is struck out by a mask.
    """
    rows, n = start.shape
    if n == 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.float64))
    first = np.arange(n)[None, :, None]
    last = first + np.arange(min(max_length, n))[None, None, :]
    score = np.where(last < n, start[:, :, None] + end[:, np.minimum(last[0], n - 1)], -np.inf)
    begins, ends = word_edges(np.zeros(start.shape, bool) if sub is None else sub)
    found, open_ = [], np.arange(rows)
    for rank in range(1, top_n + 1):
        best = score[open_].reshape(len(open_), score.shape[1] * score.shape[2]).argmax(axis=1)
        i, length = np.unravel_index(best, score.shape[1:])
        value = score[open_, i, length]
        open_, i, length, value = (x[value > -np.inf] for x in (open_, i, length, value))
        s, e = begins[open_, i], ends[open_, i + length]
        found.append((open_, np.full(len(open_), rank), s, e, value))
        s, e = s[:, None, None], e[:, None, None]
        left = score[open_]
        left[((first <= s) & (last >= e)) | ((first >= s) & (last <= e))] = -np.inf
        score[open_] = left
    passage, rank, s, e, value = (np.concatenate(x) for x in zip(*found))
    return passage, rank.astype(np.int32), s.astype(np.int32), e.astype(np.int32), value


def decode_spans(logits: DataFrame, *, max_answer_length: int = 10, top_spans: int = 3,
                 key=("qid", "passage_idx"), start: str = "start_logits",
                 end: str = "end_logits", tokens: str | None = None) -> DataFrame:
    """T6 + X21: top-N non-nested spans per passage (partial overlaps allowed);
    ``*key, span_rank, s, e, score``.  With ``tokens`` spans are moved out to
    whole words, and what lies within a span so moved is left out.  Passages of
    one length in an Arrow batch are done together, ``SLICE_SPANS`` spans at a
    time; a passage without logits has no span."""
    keys = list(key)
    kinds = {"span_rank": T.IntegerType(), "s": T.IntegerType(), "e": T.IntegerType(), "score": T.DoubleType()}
    schema = T.StructType([logits.select(*keys).schema[k] for k in keys] + [T.StructField(k, t) for k, t in kinds.items()])
    sub = F.transform(F.col(tokens), is_subword) if tokens else F.transform(F.col(start), lambda x: F.lit(False))

    def values(column: pa.Array, rows: np.ndarray, n: int) -> np.ndarray:
        return column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)

    def run(batches):
        for b in batches:
            by_name = {c: b.column(b.schema.get_field_index(c)) for c in ("__start", "__end", "__sub")}
            sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in by_name.values()]
            good = (sizes[0] == sizes[1]) & (sizes[0] == sizes[2]) & (sizes[0] > 0)
            for n in np.unique(sizes[0][good]):
                same = np.flatnonzero(good & (sizes[0] == n))
                step = max(1, SLICE_SPANS // (int(n) * max_answer_length))
                for rows in (same[i:i + step] for i in range(0, len(same), step)):
                    st, en = (values(by_name[c], rows, n).astype(np.float64) for c in ("__start", "__end"))
                    passage, *found = top_spans_of(st, en, max_answer_length, top_spans, values(by_name["__sub"], rows, n).astype(bool))
                    order = np.lexsort((found[0], passage))
                    picked = b.select(keys).take(pa.array(rows[passage[order]]))
                    yield pa.RecordBatch.from_arrays([*picked.columns, *[pa.array(f[order]) for f in found]], names=[*keys, *kinds])

    return logits.select(*keys, F.col(start).cast("array<double>").alias("__start"), F.col(end).cast("array<double>").alias("__end"),
                         F.coalesce(sub, F.array().cast("array<boolean>")).alias("__sub")).mapInArrow(run, schema)


def best_prediction(spans: DataFrame, thresholds=(1,), *, qid: str = "qid",
                    passage_idx: str = "passage_idx", relevance: str = "relevance",
                    questions: DataFrame | None = None) -> DataFrame:
    """T7 + T8 + Q20: per threshold n, the best span among passages whose
    retrieval index is < n (passages ordered by relevance, then span rank);
    a question of ``questions`` (default: those with a span) that has no
    candidate gets the empty prediction (-1 indices)."""
    ths = F.array(*[F.lit(int(t)) for t in thresholds])  # fixed parameter list
    grid = (spans if questions is None else questions).select(qid).distinct().withColumn("top_k", F.explode(ths))
    cand = spans.withColumn("top_k", F.explode(ths)).where(F.col(passage_idx) < F.col("top_k"))
    w = Window.partitionBy(qid, "top_k").orderBy(F.col(relevance).desc(), F.col("span_rank"),
                                                 F.col(passage_idx))
    best = cand.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    out = grid.join(best, [qid, "top_k"], "left")
    return out.select(qid, "top_k", F.coalesce(passage_idx, F.lit(-1)).alias("passage_idx"),
                      F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("e", F.lit(-1)).alias("e"),
                      F.coalesce("score", F.lit(-1.0)).alias("score"))


def decode_answers(logits: DataFrame, *, max_answer_length: int = 10, thresholds: tuple[int, ...] | None = None,
                   questions: DataFrame | None = None) -> DataFrame:
    """G6 + T6-T8 + X21 + X23: logits of whole sequences -> answer texts.

    ``logits``: ``qid, passage_idx, relevance, start_logits, end_logits, ids,
    passage_offset``; only the part of a sequence from ``passage_offset`` on can
    hold the answer.  Each passage gives its best span, moved out to whole words.
    Per threshold n the prediction is that of the most relevant passage with
    ``passage_idx`` < n (ties: the smaller index); without thresholds that of the
    most relevant of all, ``top_k`` being how many there are.  A question (of
    ``questions``, default: those with logits) without one gets the empty text.

    Returns ``qid, top_k, text, score, relevance_score, passage_idx, passage``.
    """
    n = F.greatest(F.size("ids") - F.col("passage_offset"), F.lit(0))

    def part(name: str) -> Column:
        return F.slice(name, F.col("passage_offset") + 1, n)

    cut = logits.select("qid", "passage_idx", "relevance", part("ids").alias("ids"),
                        best_span(part("start_logits"), part("end_logits"), max_answer_length).alias("b"))
    cut = cut.where(F.col("b").isNotNull()).withColumn("w", extend_span_to_words(F.col("ids"), F.col("b.s"), F.col("b.e")))

    def words(tokens: Column) -> Column:
        return F.regexp_replace(F.array_join(tokens, " "), " +##", "")

    found = cut.select("qid", "passage_idx", words(F.slice("ids", F.col("w.s") + 1, F.col("w.e") - F.col("w.s") + 1)).alias("text"),
                       F.col("b.score").alias("score"), F.col("relevance").cast("double").alias("relevance_score"),
                       words(F.col("ids")).alias("passage"))
    asked = (logits if questions is None else questions).select("qid").distinct()
    best = F.max_by(F.struct("text", "score", "relevance_score", "passage_idx", "passage"),
                    F.struct("relevance_score", -F.col("passage_idx"))).alias("p")
    if thresholds is None:
        got = asked.join(found.groupBy("qid").agg(best, F.count(F.lit(1)).cast("int").alias("top_k")), "qid", "left")
    else:
        ths = F.array(*[F.lit(int(t)) for t in thresholds])  # fixed parameter list
        per = found.withColumn("top_k", F.explode(F.filter(ths, lambda t: F.col("passage_idx") < t))).groupBy("qid", "top_k").agg(best)
        got = asked.withColumn("top_k", F.explode(ths)).join(per, ["qid", "top_k"], "left")
    empty = {"text": "", "score": -1.0, "relevance_score": -1.0, "passage_idx": -1, "passage": ""}
    return got.select("qid", F.coalesce("top_k", F.lit(0)).alias("top_k"),
                      *[F.coalesce(F.col("p")[k], F.lit(v)).alias(k) for k, v in empty.items()])


def include_gold_passages(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """Append each question's gold passage as a positive when it is not
    already among the positives and it has an answer span.

    ``gold``: ``qid, doc_id, passage_offset, spans`` (spans already shifted).
    Anti-join on (qid, doc_id) against the selected positives, then union."""
    pos = selected.where(F.col("role") == "positive").select("qid", "doc_id")
    add = (gold.where(F.size("spans") > 0).join(pos, ["qid", "doc_id"], "left_anti")
           .select("qid", F.lit("positive").alias("role"), F.lit(-1).cast("int").alias("rank"),
                   "doc_id", "passage_offset", "spans"))
    return selected.unionByName(add)


def nested_selection(selected: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a question: ``qid, passages`` (its selected rows by role and rank;
    none for a question without any)."""
    row = F.struct("role", "rank", *[c for c in selected.columns if c not in ("qid", "role", "rank")])
    got = selected.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("passages"))
    empty = F.array().cast(got.schema["passages"].dataType)
    return questions.select("qid").join(got, "qid", "left").withColumn("passages", F.coalesce("passages", empty))


def selection_counters() -> dict[str, Column]:
    """A10: questions without any positive passage, and positives that came from
    gold insertion (``rank = -1``, see :func:`include_gold_passages`): aggregates
    of :func:`nested_selection` for :func:`rivulet.operators.quality.counted`,
    which takes them while the samples are written."""
    positive = F.filter("passages", lambda p: p["role"] == "positive")
    gold = F.size(F.filter(positive, lambda p: p["rank"] == -1))
    return {"no_positive_questions": F.count_if(F.size(positive) == 0),
            "positives_from_gold": F.coalesce(F.sum(gold), F.lit(0)).cast("long")}


def answer_matrices(spans: Column, max_n_answers: int) -> Column:
    """Start / end position vectors and the answer mask, zero-padded to
    ``max_n_answers`` (first spans kept, T11)."""
    sp = F.slice(spans, 1, max_n_answers)
    pad = F.array_repeat(F.lit(0), max_n_answers)
    starts = F.slice(F.concat(F.transform(sp, lambda x: x["s"]), pad), 1, max_n_answers)
    ends = F.slice(F.concat(F.transform(sp, lambda x: x["e"]), pad), 1, max_n_answers)
    mask = F.slice(F.concat(F.transform(sp, lambda x: F.lit(1)), pad), 1, max_n_answers)
    return F.struct(starts.alias("start_positions"), ends.alias("end_positions"), mask.alias("answer_mask"))


def pick_positive(selected: DataFrame, max_length: int, seed: int | None = None) -> DataFrame:
    """Per question, the positive used in slot 0 -- the first one (by
    rank) with an in-range span, or with ``seed`` a seeded-hash pick among
    those (deterministic, partition-independent).  Questions without such a
    positive get no row (F18)."""
    in_range = F.filter("spans", lambda x: (x["s"] < max_length) & (x["e"] < max_length))
    c = selected.where((F.col("role") == "positive") & (F.size(in_range) > 0))
    key = _place() if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    return c.groupBy("qid").agg(F.min_by("doc_id", key).alias("doc_id"))
