"""Reader-side queries: passage selection with answer spans, reader batch
slots, span decoding from logits, retrieval records and gold-page checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.operators import reader as rd
from rivulet.operators.training import ids_string
from rivulet.plans import sqlfrag as S
from rivulet.plans.registry import register
from rivulet.plans.text_search import K, labelled_hits, passages_of
from rivulet.functions.text import nfkc, tokenize
from rivulet.session import materialize
from rivulet.sources.tables import questions, table

MAX_ANSWER_LEN = 10


def selected(spark, sf_dir):
    h = labelled_hits(spark, sf_dir, "string")
    return rd.reader_select(h, passages_of(spark, sf_dir, h), questions(spark, sf_dir))


def _spans_str(col):
    return F.array_join(F.transform(col, lambda x: F.concat_ws("-", x["s"], x["e"])), ",")


_SELECT_SQL = f"""
WITH {S.bm25_ctes(K).strip()},
lab AS (SELECT top.qid, top.rank, top.doc_id,
               coalesce(len(list_filter(qs.answers, lambda a: contains(array_to_string({S.tokens('docs.text')}, ' '),
                                                              array_to_string({S.tokens('a')}, ' ')))) > 0, false) AS h
        FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)),
qtok AS (SELECT qid, len({S.tokens('question')}) AS q_len, {S.tokens('answers[1]')} AS a_tok FROM qs),
dtok AS (SELECT doc_id, len({S.tokens('title')}) AS t_len, {S.tokens('text')} AS p_tok FROM docs),
j AS (SELECT lab.qid, lab.rank, lab.doc_id, lab.h, q_len + t_len + 3 AS off, len(a_tok) AS alen,
             CASE WHEN lab.h THEN list_filter(range(0, len(p_tok) - len(a_tok) + 1),
                                              lambda i: p_tok[i + 1:i + len(a_tok)] = a_tok)
                  ELSE [] END AS starts
      FROM lab JOIN qtok USING (qid) JOIN dtok USING (doc_id)),
pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r
                       FROM j WHERE h AND len(starts) > 0) WHERE r <= 20),
np AS (SELECT qid, count(*) AS n_pos FROM pos GROUP BY qid),
neg AS (SELECT * FROM (SELECT j.*, np.n_pos, row_number() OVER (PARTITION BY j.qid ORDER BY rank) AS r
                       FROM j JOIN np USING (qid) WHERE NOT h)
        WHERE r <= least(greatest(10 * n_pos, 50), 150)),
sel AS (SELECT qid, 'positive' AS role, rank, doc_id, off, alen, starts FROM pos
        UNION ALL SELECT qid, 'negative', rank, doc_id, off, alen, [] FROM neg)
"""


@register("reader_select", _SELECT_SQL + """
SELECT qid, role, CAST(rank AS INTEGER) AS rank, doc_id, CAST(off AS INTEGER) AS passage_offset,
       array_to_string(list_transform(starts, lambda s: CAST(s + off AS VARCHAR) || '-' ||
                                                        CAST(s + off + alen - 1 AS VARCHAR)), ',') AS spans
FROM sel
""")
def reader_select(spark, sf_dir):
    """G2 + T3-T5 + F8 + F13 + X16-X18 + Q15: BM25 hits labelled by the
    string matcher -> positives with token spans (shifted by the passage
    offset) and the data-dependent number of negatives."""
    s = selected(spark, sf_dir)
    return s.select("qid", "role", "rank", "doc_id", "passage_offset", _spans_str(F.col("spans")).alias("spans"))


#: Small limits, so that retrieval at depth K reaches each of them.
GOLD_CFG = rd.ReaderConfig(max_retriever_passages=6, max_positives=2, max_negatives=3, min_negatives=4, eval_passages=5,
                           include_gold_passage=True)
_LABELLED_SQL = _SELECT_SQL[:_SELECT_SQL.index("qtok AS")]
_GOLD_SQL = f"""{_LABELLED_SQL}
gold AS (SELECT qid, arg_max(doc_id, rank) AS gold_id FROM lab WHERE h GROUP BY qid),
qtok AS (SELECT qid, len({S.tokens('question')}) AS q_len, {S.tokens('answers[1]')} AS a_tok FROM qs),
dtok AS (SELECT doc_id, lower(title) AS title, len({S.tokens('title')}) AS t_len, {S.tokens('text')} AS p_tok FROM docs),
cand AS (SELECT qid, rank, doc_id, h, false AS g FROM lab WHERE rank <= {GOLD_CFG.max_retriever_passages}
         UNION ALL SELECT qid, -1, gold_id, true, true FROM gold),
j AS (SELECT cand.*, dtok.title, q_len + t_len + 3 AS off, len(a_tok) AS alen, gold_id,
             CASE WHEN h THEN list_filter(range(0, len(p_tok) - len(a_tok) + 1),
                                          lambda i: p_tok[i + 1:i + len(a_tok)] = a_tok)
                  ELSE [] END AS starts
      FROM cand JOIN qtok USING (qid) JOIN dtok USING (doc_id) LEFT JOIN gold USING (qid)),
found AS (SELECT j.*, coalesce(j.title = gd.title, false) AS page, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r
          FROM j LEFT JOIN dtok gd ON gd.doc_id = j.gold_id WHERE h AND NOT g AND len(starts) > 0),
chosen AS (SELECT * FROM (SELECT *, bool_or(page) OVER (PARTITION BY qid) AS any_page FROM found)
           WHERE CASE WHEN any_page THEN page ELSE r <= {GOLD_CFG.max_positives} END),
pos AS (SELECT qid, rank, doc_id, off, alen, starts FROM chosen
        UNION ALL
        SELECT qid, rank, doc_id, off, alen, starts FROM j
        WHERE g AND len(starts) > 0
          AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.qid = j.qid AND c.doc_id = j.doc_id)),
np AS (SELECT qid, count(*) AS n_pos FROM pos GROUP BY qid),
neg AS (SELECT * FROM (SELECT j.*, np.n_pos, row_number() OVER (PARTITION BY j.qid ORDER BY rank) AS r
                       FROM j JOIN np USING (qid) WHERE NOT h)
        WHERE r <= least(greatest(10 * n_pos, {GOLD_CFG.max_negatives}), {GOLD_CFG.min_negatives})),
sel AS (SELECT qid, 'positive' AS role, rank, doc_id, off, alen, starts FROM pos
        UNION ALL SELECT qid, 'negative', rank, doc_id, off, alen, [] FROM neg)
SELECT qid, role, CAST(rank AS INTEGER) AS rank, doc_id, CAST(off AS INTEGER) AS passage_offset,
       array_to_string(list_transform(starts, lambda s: CAST(s + off AS VARCHAR) || '-' ||
                                                        CAST(s + off + alen - 1 AS VARCHAR)), ',') AS spans
FROM sel
"""


@register("reader_select_gold", _GOLD_SQL)
def reader_select_gold(spark, sf_dir):
    """G2 with gold passages (J9, J11, T3-T5): positives from the gold page
    first, the gold passage added, the negative limit taken afterwards.  The
    deepest labelled hit plays the gold passage."""
    h = labelled_hits(spark, sf_dir, "string")
    best = h.where("has_answer").groupBy("qid").agg(F.max_by("doc_id", "rank").alias("doc_id"))
    docs = passages_of(spark, sf_dir, h)
    gold = best.join(docs.select(F.col("id").alias("doc_id"), "title", "text"), "doc_id")
    s = rd.reader_select(h, docs, questions(spark, sf_dir), GOLD_CFG, gold=gold)
    return s.select("qid", "role", "rank", "doc_id", "passage_offset", _spans_str(F.col("spans")).alias("spans"))


@register("reader_select_eval", f"""{_LABELLED_SQL}
qtok AS (SELECT qid, len({S.tokens('question')}) AS q_len FROM qs),
dtok AS (SELECT doc_id, len({S.tokens('title')}) AS t_len FROM docs)
SELECT qid, 'negative' AS role, CAST(rank AS INTEGER) AS rank, doc_id, CAST(q_len + t_len + 3 AS INTEGER) AS passage_offset
FROM lab JOIN qtok USING (qid) JOIN dtok USING (doc_id) WHERE rank <= {GOLD_CFG.eval_passages}
""")
def reader_select_eval(spark, sf_dir):
    """G2 + F13, evaluation form: the first passages, whatever they hold."""
    h = labelled_hits(spark, sf_dir, "string")
    s = rd.reader_select(h, passages_of(spark, sf_dir, h), questions(spark, sf_dir), GOLD_CFG, train=False)
    return s.select("qid", "role", "rank", "doc_id", "passage_offset")


@register("reader_batch_slots", _SELECT_SQL + """,
ok AS (SELECT qid, rank, doc_id,
              len(list_filter(starts, lambda s: s + off < 256 AND s + off + alen - 1 < 256)) AS n_ok
       FROM sel WHERE role = 'positive'),
p0 AS (SELECT qid, arg_min(doc_id, rank) AS doc_id, arg_min(least(n_ok, 10), rank) AS n_answers
       FROM ok WHERE n_ok > 0 GROUP BY qid),
ng AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS slot
       FROM sel WHERE role = 'negative'),
g AS (SELECT p0.qid, unnest(range(0, 4)) AS slot FROM p0)
SELECT g.qid, CAST(g.slot AS INTEGER) AS slot,
       CASE WHEN g.slot = 0 THEN p0.doc_id ELSE ng.doc_id END AS doc_id,
       CAST(CASE WHEN g.slot = 0 THEN p0.n_answers ELSE 0 END AS INTEGER) AS n_answers
FROM g JOIN p0 USING (qid) LEFT JOIN ng ON ng.qid = g.qid AND ng.slot = g.slot
""")
def reader_batch_slots(spark, sf_dir):
    """G3 + D7 + D8 + F12 + F18 + X27: 4 slots per question (first in-range
    positive, first negatives, empty), answers capped at 10."""
    return rd.reader_batch(selected(spark, sf_dir), passages_per_question=4, max_length=256,
                           max_n_answers=10)


def _logits(spark, sf_dir):
    """Synthetic reader logits: every embedding row is one (question,
    passage) with start logits = the vector and end logits = it reversed."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), F.lit(0).alias("passage_idx"),
                    F.col("embedding").alias("start_logits"),
                    F.reverse("embedding").alias("end_logits"),
                    F.col("embedding")[0].cast("double").alias("relevance"))


@register("best_spans_top1", f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS st, list_reverse(CAST(embedding AS DOUBLE[])) AS en
           FROM embeddings),
i AS (SELECT vec_id, st, en, unnest(range(0, len(st))) AS i FROM e),
c AS (SELECT vec_id, i, unnest(range(i, least(i + {MAX_ANSWER_LEN}, len(st)))) AS j, st, en FROM i),
s AS (SELECT vec_id, i, j, st[i + 1] + en[j + 1] AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) AS rn FROM s)
SELECT vec_id AS qid, CAST(i AS INTEGER) AS s, CAST(j AS INTEGER) AS e, round(score, 4) AS score
FROM r WHERE rn = 1
""")
def best_spans_top1(spark, sf_dir):
    """W8 + T6 (top 1): best span (length <= 10) per passage, scored inside
    one array expression per row."""
    lg = _logits(spark, sf_dir)
    b = lg.select("qid", rd.best_span(F.col("start_logits"), F.col("end_logits"), MAX_ANSWER_LEN)
                  .alias("b"))
    return b.select("qid", "b.s", "b.e", F.round("b.score", 4).alias("score"))


_CLEAR = "WHERE NOT ((i <= bi AND j >= bj) OR (i >= bi AND j <= bj))"


# tokens of a row of logits: every third whole number of a component goes on with the word before it
_TOKENS = "list_transform(v, lambda x: CASE WHEN CAST(floor(64 * x) AS BIGINT) % 3 = 0 THEN '##' ELSE '' END || 't')"


@register("best_spans_topn", f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT vec_id, v AS st, list_reverse(v) AS en, len(v) AS n,
             list_transform({_TOKENS}, lambda t: starts_with(t, '##')) AS sub FROM v),
w AS (SELECT vec_id, st, en, n,
             list_transform(range(0, n), lambda a: coalesce(list_max(list_filter(range(0, a + 1), lambda b: NOT sub[b + 1])), 0)) AS ws,
             list_transform(range(0, n), lambda a: coalesce(list_min(list_filter(range(a + 1, n), lambda b: NOT sub[b + 1])), n) - 1) AS we
      FROM e),
i AS (SELECT *, unnest(range(0, n)) AS i FROM w),
s1 AS (SELECT vec_id, i, j, st[i + 1] + en[j + 1] AS score, ws[i + 1] AS wi, we[j + 1] AS wj
       FROM (SELECT *, unnest(range(i, least(i + {MAX_ANSWER_LEN}, n))) AS j FROM i)),
b1 AS (SELECT *, wi AS bi, wj AS bj FROM s1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) = 1),
s2 AS (SELECT s1.* FROM s1 JOIN (SELECT vec_id, bi, bj FROM b1) USING (vec_id) {_CLEAR}),
b2 AS (SELECT *, wi AS bi, wj AS bj FROM s2 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) = 1),
s3 AS (SELECT s2.* FROM s2 JOIN (SELECT vec_id, bi, bj FROM b2) USING (vec_id) {_CLEAR}),
b3 AS (SELECT *, wi AS bi, wj AS bj FROM s3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) = 1),
b AS (SELECT 1 AS k, * FROM b1 UNION ALL SELECT 2, * FROM b2 UNION ALL SELECT 3, * FROM b3)
SELECT vec_id AS qid, CAST(0 AS INTEGER) AS passage_idx, CAST(k AS INTEGER) AS span_rank, CAST(bi AS INTEGER) AS s,
       CAST(bj AS INTEGER) AS e, round(score, 4) AS score FROM b
""")
def best_spans_topn(spark, sf_dir):
    """T6 + X21 (top 3, moved out to whole words, non-nested greedy suppression)."""
    word = F.transform("start_logits", lambda x: F.concat(
        F.when(F.floor(64 * x.cast("double")).cast("bigint") % 3 == 0, "##").otherwise(""), F.lit("t")))
    sp = rd.decode_spans(_logits(spark, sf_dir).withColumn("tokens", word), max_answer_length=MAX_ANSWER_LEN, top_spans=3, tokens="tokens")
    return sp.select("qid", "passage_idx", "span_rank", "s", "e", F.round("score", 4).alias("score"))


def _sequence_logits(spark, sf_dir):
    """Four passages a question: every embedding row is the logits of a
    sequence whose tokens are its scaled components."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    return e.select(F.expr("vec_id div 4").alias("qid"), F.expr("vec_id % 4").cast("int").alias("passage_idx"),
                    F.expr("vec_id % 5").cast("int").alias("passage_offset"),
                    F.col("embedding").alias("start_logits"), F.reverse("embedding").alias("end_logits"),
                    F.transform("embedding", lambda x: F.floor(64 * x.cast("double")).cast("bigint").cast("string")).alias("ids"),
                    F.col("embedding")[0].cast("double").alias("relevance"))


def _predicted_sql(offset: str) -> str:
    return f"""
WITH e AS (SELECT vec_id // 4 AS qid, vec_id % 4 AS p, {offset} AS off, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT qid, p, v[1] AS rel, list_transform(v, lambda x: CAST(CAST(floor(64 * x) AS BIGINT) AS VARCHAR))[off + 1:] AS toks,
             v[off + 1:] AS st, list_reverse(v)[off + 1:] AS en FROM e),
i AS (SELECT *, unnest(range(0, len(st))) AS i FROM l),
c AS (SELECT *, unnest(range(i, least(i + {MAX_ANSWER_LEN}, len(st)))) AS j FROM i),
one AS (SELECT qid, p, rel, toks, i, j, st[i + 1] + en[j + 1] AS score FROM c
        QUALIFY row_number() OVER (PARTITION BY qid, p ORDER BY st[i + 1] + en[j + 1] DESC, i, j) = 1),
th AS (SELECT unnest([1, 3]) AS top_k),
r AS (SELECT one.*, top_k FROM one CROSS JOIN th WHERE p < top_k
      QUALIFY row_number() OVER (PARTITION BY qid, top_k ORDER BY rel DESC, p) = 1),
q AS (SELECT DISTINCT qid, top_k FROM e CROSS JOIN th),
b AS (SELECT q.qid, q.top_k, p, rel, toks, i, j, score FROM q LEFT JOIN r USING (qid, top_k))
"""


@register("best_prediction", _predicted_sql("0") + """
SELECT qid, CAST(top_k AS INTEGER) AS top_k, CAST(coalesce(p, -1) AS INTEGER) AS passage_idx, CAST(coalesce(i, -1) AS INTEGER) AS s,
       CAST(coalesce(j, -1) AS INTEGER) AS e, round(coalesce(score, -1.0), 4) AS score FROM b
""")
def best_prediction(spark, sf_dir):
    """T7 + T8 + Q20: per threshold (1, 3), best span among passages with
    retrieval index below the threshold."""
    lg = _sequence_logits(spark, sf_dir)
    sp = rd.decode_spans(lg, max_answer_length=MAX_ANSWER_LEN, top_spans=1)
    sp = sp.join(lg.select("qid", "passage_idx", "relevance"), ["qid", "passage_idx"])
    return rd.best_prediction(sp, thresholds=(1, 3), questions=lg).withColumn("score", F.round("score", 4))


@register("answer_texts", _predicted_sql("vec_id % 5") + """
SELECT qid, CAST(top_k AS INTEGER) AS top_k, coalesce(array_to_string(toks[i + 1:j + 1], ' '), '') AS text,
       round(coalesce(score, -1.0), 4) AS score, round(coalesce(rel, -1.0), 4) AS relevance_score,
       CAST(coalesce(p, -1) AS INTEGER) AS passage_idx, md5(coalesce(array_to_string(toks, ' '), '')) AS passage_md5 FROM b
""")
def answer_texts(spark, sf_dir):
    """G6 + T6-T8 + F17: answer texts per threshold, from the passage's part of
    each sequence."""
    a = rd.decode_answers(_sequence_logits(spark, sf_dir), max_answer_length=MAX_ANSWER_LEN, thresholds=(1, 3))
    return a.select("qid", "top_k", "text", F.round("score", 4).alias("score"), F.round("relevance_score", 4).alias("relevance_score"),
                    "passage_idx", F.md5("passage").alias("passage_md5"))


@register("submission", _predicted_sql("vec_id % 5") + """
SELECT qid, 'question ' || qid AS question, coalesce(array_to_string(toks[i + 1:j + 1], ' '), '') AS prediction FROM b WHERE top_k = 1
""")
def submission(spark, sf_dir):
    """Question and answer text of the first threshold."""
    from rivulet.sources import io
    a = rd.decode_answers(_sequence_logits(spark, sf_dir), max_answer_length=MAX_ANSWER_LEN, thresholds=(1, 3))
    return io.submission(a.withColumn("question", F.concat(F.lit("question "), F.col("qid").cast("string"))))


@register("retrieval_records", f"""
WITH {S.bm25_ctes(K).strip()},
lab AS (SELECT top.qid, top.rank, top.doc_id,
               coalesce(len(list_filter(qs.answers, lambda a: contains(array_to_string({S.tokens('docs.text')}, ' '),
                                                              array_to_string({S.tokens('a')}, ' ')))) > 0, false) AS h
        FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id))
SELECT qs.qid, qs.question, CAST(count(lab.doc_id) AS INTEGER) AS n_ctxs,
       coalesce(string_agg(CAST(lab.doc_id AS VARCHAR), ',' ORDER BY lab.rank), '') AS ctx_ids,
       coalesce(string_agg(CASE WHEN lab.h THEN '1' ELSE '0' END, ',' ORDER BY lab.rank)
                FILTER (WHERE lab.doc_id IS NOT NULL), '') AS has_answer
FROM qs LEFT JOIN lab USING (qid) GROUP BY qs.qid, qs.question
""")
def retrieval_records(spark, sf_dir):
    """J1 + J2 + A6 + K9: ranked, labelled hits nested into one ctx array per
    question (joined on qid, not by position), flattened for the check."""
    from rivulet.operators.records import nest_ctxs
    h = labelled_hits(spark, sf_dir, "string")
    rec = nest_ctxs(h, passages_of(spark, sf_dir, h), questions(spark, sf_dir))
    return rec.select("qid", "question", F.size("ctxs").cast("int").alias("n_ctxs"),
                      ids_string("ctxs").alias("ctx_ids"),
                      F.array_join(F.transform("ctxs", lambda c: F.when(c["has_answer"], "1").otherwise("0")),
                                   ",").alias("has_answer"))


@register("gold_page_match", f"""
WITH {S.bm25_ctes(K).strip()},
lab AS (SELECT top.qid, top.rank, top.doc_id, docs.title,
               coalesce(len(list_filter(qs.answers, lambda a: contains(docs.text, a))) > 0, false) AS h
        FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)),
gold AS (SELECT qid, arg_min(title, rank) AS gold_title FROM lab WHERE h GROUP BY qid)
SELECT lab.qid, CAST(lab.rank AS INTEGER) AS rank, lab.doc_id,
       coalesce(lower(lab.title) = lower(gold.gold_title), false) AS from_gold_page
FROM lab LEFT JOIN gold USING (qid)
""")
def gold_page_match(spark, sf_dir):
    """Is each hit from the question's gold page (case-insensitive title
    equality; the gold passage is the best-ranked raw-containment hit)."""
    from rivulet.operators.records import gold_page_flags
    h = labelled_hits(spark, sf_dir, "raw")
    return gold_page_flags(h, passages_of(spark, sf_dir, h))


L_MAX = 256


@register("reader_inputs", _SELECT_SQL + f""",
seq AS (SELECT sel.qid, sel.doc_id,
               list_concat(['[CLS]'], {S.tokens('qs.question')}, ['[SEP]'], {S.tokens('docs.title')}, ['[SEP]'],
                           {S.tokens('docs.text')}) AS s
        FROM sel JOIN qs USING (qid) JOIN docs USING (doc_id) WHERE sel.role = 'positive'),
pad AS (SELECT qid, doc_id, list_concat(s, list_transform(range({L_MAX}), lambda i: '[PAD]'))[1:{L_MAX}] AS p FROM seq)
SELECT qid, doc_id, CAST(len(list_filter(p, lambda x: x <> '[PAD]')) AS INTEGER) AS n_attended,
       md5(array_to_string(p, ' ')) AS ids_md5
FROM pad
""")
def reader_inputs(spark, sf_dir):
    """X18 + X19 + X20: [CLS] question [SEP] title [SEP] passage for every
    selected positive, padded / truncated to 256, with its attention mask."""
    s = materialize(selected(spark, sf_dir).where(F.col("role") == "positive").select("qid", "doc_id"), "reader-positives")
    q = questions(spark, sf_dir).select("qid", tokenize(nfkc("question")).alias("q_tok"))
    d = passages_of(spark, sf_dir, s).select(F.col("id").alias("doc_id"), tokenize(nfkc("title")).alias("t_tok"),
                                       tokenize(nfkc("text")).alias("p_tok"))
    j = s.join(q, "qid").join(d, "doc_id")
    p = j.select("qid", "doc_id", rd.pad_ids(rd.pair_sequence(F.col("q_tok"), F.col("t_tok"), F.col("p_tok")), L_MAX).alias("p"))
    mask = rd.attention_mask(F.col("p"))
    return p.select("qid", "doc_id",
                    F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("int").alias("n_attended"),
                    F.md5(F.array_join("p", " ")).alias("ids_md5"))


M_ROWS, N_ANSWERS = 4, 10


def _sequences(spark, sf_dir, pairs):
    q = questions(spark, sf_dir).select("qid", tokenize(nfkc("question")).alias("q_tok"))
    d = passages_of(spark, sf_dir, pairs).select(F.col("id").alias("doc_id"), tokenize(nfkc("title")).alias("t_tok"),
                                                  tokenize(nfkc("text")).alias("p_tok"))
    return pairs.select("qid", "doc_id").join(q, "qid").join(d, "doc_id").select(
        "qid", "doc_id", rd.pair_sequence(F.col("q_tok"), F.col("t_tok"), F.col("p_tok")).alias("ids"))


def _ids_md5():
    return F.md5(F.array_join(F.transform("input_ids", lambda r: F.array_join(r, " ")), "|")).alias("ids_md5")


_ROWS_SQL = f"""
seq AS (SELECT slots.qid, slot, list_concat(['[CLS]'], {S.tokens('qs.question')}, ['[SEP]'], {S.tokens('docs.title')}, ['[SEP]'],
                                            {S.tokens('docs.text')}) AS s
        FROM slots JOIN qs USING (qid) JOIN docs USING (doc_id)),
grid AS (SELECT qid, unnest(range(0, {M_ROWS})) AS slot FROM (SELECT DISTINCT qid FROM slots)),
ids AS (SELECT grid.qid, grid.slot, list_concat(coalesce(s, CAST([] AS VARCHAR[])),
                                                list_transform(range({L_MAX}), lambda i: '[PAD]'))[1:{L_MAX}] AS ids
        FROM grid LEFT JOIN seq USING (qid, slot)),
md AS (SELECT qid, md5(string_agg(array_to_string(ids, ' '), '|' ORDER BY slot)) AS ids_md5 FROM ids GROUP BY qid)
"""
_TEN = f"list_transform(range({N_ANSWERS}), lambda i: 0)"


@register("reader_tensors", _SELECT_SQL + f""",
ok AS (SELECT sel.*, list_filter(starts, lambda s: s + off + alen - 1 < {L_MAX}) AS ok FROM sel),
p0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM ok
                      WHERE role = 'positive' AND len(ok) > 0) WHERE r = 1),
n0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM ok
                      WHERE role = 'negative' AND qid IN (SELECT qid FROM p0)) WHERE r < {M_ROWS}),
slots AS (SELECT qid, 0 AS slot, doc_id FROM p0 UNION ALL SELECT qid, r AS slot, doc_id FROM n0),
{_ROWS_SQL}
SELECT md.qid, md.ids_md5,
       array_to_string(list_concat(list_transform(ok, lambda s: s + off), {_TEN})[1:{N_ANSWERS}], ',') AS starts,
       array_to_string(list_concat(list_transform(ok, lambda s: s + off + alen - 1), {_TEN})[1:{N_ANSWERS}], ',') AS ends,
       CAST(least(len(ok), {N_ANSWERS}) AS INTEGER) AS n_masked
FROM md JOIN p0 USING (qid)
""")
def reader_tensors(spark, sf_dir):
    """G3 + D7 + D8 + X18-X20 + X27: 4 x 256 ids with answer positions and mask
    per question, digested for the check."""
    s = materialize(selected(spark, sf_dir), "reader-selected")
    t = rd.reader_tensors(s, _sequences(spark, sf_dir, s), passages_per_question=M_ROWS, max_length=L_MAX, max_n_answers=N_ANSWERS)
    total = F.aggregate(F.flatten("answer_mask"), F.lit(0), lambda a, x: a + x)
    return t.select("qid", _ids_md5(), F.array_join(F.get("start_positions", F.lit(0)), ",").alias("starts"),
                    F.array_join(F.get("end_positions", F.lit(0)), ",").alias("ends"), total.alias("n_masked"))


@register("reader_tensors_eval", f"""{_LABELLED_SQL}
slots AS (SELECT qid, rank - 1 AS slot, doc_id FROM lab WHERE rank <= {M_ROWS}),
{_ROWS_SQL}
SELECT qid, ids_md5 FROM md
""")
def reader_tensors_eval(spark, sf_dir):
    """G3, evaluation form: the first passages, no positions."""
    h = labelled_hits(spark, sf_dir, "string")
    s = materialize(rd.reader_select(h, passages_of(spark, sf_dir, h), questions(spark, sf_dir), train=False), "reader-selected")
    t = rd.reader_tensors(s, _sequences(spark, sf_dir, s), passages_per_question=M_ROWS, max_length=L_MAX, train=False)
    return t.select("qid", _ids_md5())


@register("canonical_question", f"""
WITH g AS (SELECT text AS question,
                  array_to_string({S.tokens("text")}, ' ') AS question_tokens FROM benchmark),
k AS (SELECT question AS k, question AS canon FROM g
      UNION SELECT question_tokens AS k, question AS canon FROM g),
q AS (SELECT item_id AS qid,
             CASE WHEN NOT contains(text, ',') THEN text
                  ELSE array_to_string({S.tokens("text")}, ' ') END AS asked
      FROM benchmark)
SELECT q.qid, coalesce(k.canon, q.asked) AS question FROM q LEFT JOIN k ON k.k = q.asked
""")
def canonical_question(spark, sf_dir):
    """J10 + S10: a question asked either verbatim or in its tokenized form is
    mapped back to the gold file's canonical question (left join on both key
    forms, fallback to the question itself).  Gold rows = benchmark items;
    questions containing a comma are asked in their tokenized form."""
    from rivulet.operators.records import canonical_questions
    b = table(spark, sf_dir, "benchmark")
    first = F.col("text")
    gold = b.select(first.alias("question"), F.array_join(tokenize(first), " ").alias("question_tokens"))
    asked = b.select(F.col("item_id").alias("qid"),
                     F.when(~first.contains(","), first)
                     .otherwise(F.array_join(tokenize(first), " ")).alias("question"))
    return canonical_questions(asked, gold).select("qid", "question")
