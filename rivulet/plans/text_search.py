"""Text normalization, tokenization, BM25 search, answer matching and the
lexical training-set build over ``documents`` / ``benchmark`` /
``conversations`` (whole tables, whole texts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions import text as tx, tokens as tk
from rivulet.operators import evaluate, lexical, match, quality, training
from rivulet.plans import sqlfrag as S
from rivulet.plans.registry import register
from rivulet.session import ensure_checkpoint_dir, files_key, materialize, sent
from rivulet.sources.tables import passages, questions, table

K = 10


# ----------------------------------------------------------------- X6 / X7
@register("tokenize_counts", f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)
""")
def tokenize_counts(spark, sf_dir):
    """Simple-tokenizer tokens of every document (count + content digest)."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"),
                    F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@register("token_ngrams", f"""
WITH t AS (SELECT doc_id, list_transform({S.tokens('text')}, lambda x: lower(x)) AS w FROM documents),
g AS (SELECT doc_id,
             flatten(list_transform(range(0, len(w)), lambda s:
                 list_transform(range(1, least(2, len(w) - s) + 1), lambda l:
                     array_to_string(w[s + 1:s + l], ' ')))) AS grams
      FROM t)
SELECT doc_id, CAST(len(grams) AS INTEGER) AS n_ngrams, md5(array_to_string(grams, '|')) AS ngrams_md5
FROM g
""")
def token_ngrams(spark, sf_dir):
    """X7a + X7b: uncased 1..2-grams of every document in (start, length) order."""
    d = table(spark, sf_dir, "documents")
    g = d.select("doc_id", tx.ngrams(tx.tokenize("text"), 2, uncased=True).alias("g"))
    return g.select("doc_id", F.size("g").alias("n_ngrams"),
                    F.md5(F.array_join("g", "|")).alias("ngrams_md5"))


@register("token_roundtrip", f"""
WITH t AS (SELECT doc_id, text, {S.tokens('text')} AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(regexp_replace(text, '^[\\p{{Z}}\\p{{C}}]+|[\\p{{Z}}\\p{{C}}]+$', '', 'g')) AS text_md5,
       CASE WHEN len(t) > 0 THEN CAST(length(text) - length(regexp_replace(text, '^[\\p{{Z}}\\p{{C}}]+', '')) AS INTEGER) END AS first_start,
       CASE WHEN len(t) > 0 THEN CAST(length(regexp_replace(text, '[\\p{{Z}}\\p{{C}}]+$', '')) AS INTEGER) END AS last_end
FROM t
""")
def token_roundtrip(spark, sf_dir):
    """X6 + X7c: tokens with offsets and what stands between them give every
    document's text back."""
    d = table(spark, sf_dir, "documents").select("doc_id", tk.tokens_with_offsets("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(tk.untokenize("t")).alias("text_md5"),
                    F.get("t", F.lit(0))["start"].alias("first_start"), F.get("t", F.size("t") - 1)["end"].alias("last_end"))


# ----------------------------------------------------------------- X1 / X2
@register("normalize_text", f"""
SELECT doc_id, CAST(length(n) AS INTEGER) AS text_len, md5(n) AS text_md5
FROM (SELECT doc_id, {S.normalize_text('text')} AS n FROM documents)
""")
def normalize_text(spark, sf_dir):
    """X1 + X2: NFKC, whitespace collapse, non-printables dropped, stripped."""
    d = table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text("text").alias("n"))
    return d.select("doc_id", F.length("n").alias("text_len"), F.md5("n").alias("text_md5"))


# ----------------------------------------------------------------- X3 / X8
@register("normalize_answer", f"""
SELECT conv_id, turn, {S.normalize_answer('text')} AS normalized FROM conversations
""")
def normalize_answer(spark, sf_dir):
    """Answer normalization of every conversation turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.normalize_answer("text").alias("normalized"))


@register("normalize_question", r"""
SELECT conv_id, turn, regexp_replace(text, '\?$', '') AS question FROM conversations
""")
def normalize_question(spark, sf_dir):
    """One trailing '?' removed."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.normalize_question("text").alias("question"))


@register("exact_match_at_n", f"""
WITH g AS (SELECT conv_id, list(text) AS golds FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT c.conv_id, c.turn AS top_k, c.text AS prediction, g.golds
      FROM conversations c LEFT JOIN g USING (conv_id)),
e AS (SELECT top_k, CASE WHEN len(list_filter(golds, lambda x: {S.normalize_answer('x')} =
                                   {S.normalize_answer('prediction')})) > 0 THEN 1 ELSE 0 END AS h
      FROM p)
SELECT top_k, count(*) AS n_questions, round(avg(h) * 100, 2) AS em FROM e GROUP BY top_k
""")
def exact_match_at_n(spark, sf_dir):
    """A2 + X4: per threshold n (= turn index), EM of the turn-n text against
    the conversation's user turns (max over golds, mean over all conversations;
    one without a user turn has no gold and scores 0)."""
    c = table(spark, sf_dir, "conversations")
    golds = (c.where(F.col("role") == "user").groupBy("conv_id")
             .agg(F.collect_list("text").alias("gold_answers")))
    preds = c.join(golds, "conv_id", "left").select("conv_id", F.col("turn").alias("top_k"),
                                             F.col("text").alias("prediction"), "gold_answers")
    return evaluate.em_at_n(preds)


# ----------------------------------------------------------------- K15 / A9
def _index(spark, sf_dir):
    """The index of a corpus is a stored artifact.  Its folder is named by
    the files it was built from, so it is opened again while they are the same
    and built anew when they change."""
    ps = passages(spark, sf_dir)
    key = files_key(table(spark, sf_dir, "documents"))
    return lexical.index_for(ps, f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivulet-lexical-{key}")


@register("lexical_index_stats", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT t.term, t.df, CAST(sum(p.tf) AS BIGINT) AS cf
FROM tstat t JOIN post p USING (term) GROUP BY t.term, t.df
""")
def lexical_index_stats(spark, sf_dir):
    """K15 + A9: per term document frequency and collection frequency, stored."""
    ix = _index(spark, sf_dir)
    return ix.term_stats.select("term", "df", "cf")


@register("lexical_corpus_stats", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT n_docs, round(avgdl, 4) AS avgdl, (SELECT count(*) FROM tstat) AS n_terms,
       (SELECT count(*) FROM post) AS n_postings FROM cs
""")
def lexical_corpus_stats(spark, sf_dir):
    """N, avgdl, vocabulary size and posting count."""
    ix = _index(spark, sf_dir)
    nt = ix.term_stats.agg(F.count(F.lit(1))).scalar()
    npost = ix.postings.agg(F.count(F.lit(1))).scalar()
    return ix.corpus_stats.select("n_docs", F.round("avgdl", 4).alias("avgdl"),
                                  nt.alias("n_terms"), npost.alias("n_postings"))


# ----------------------------------------------------------------- J5 / T2
def bm25_hits(spark, sf_dir, k=K):
    """BM25 top-k hits, written once to the checkpoint folder: every
    downstream stage (matching, selection, nesting) reads several branches
    of them, and re-running retrieval per branch would multiply its cost."""
    return materialize(lexical.search(_index(spark, sf_dir), questions(spark, sf_dir), k), "bm25_hits")


@register("bm25_topk", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM top
""")
def bm25_topk(spark, sf_dir):
    """J5 + T2: BM25 (k1=1.2, b=0.75) top-10 passages per benchmark question, by
    bounds, however few the postings are."""
    h = lexical.search(_index(spark, sf_dir), questions(spark, sf_dir), K, prune=True)
    return h.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


def _phrase_sql(must_not: bool) -> str:
    neg = "NOT " if must_not else ""
    return f"""
WITH {S.bm25_ctes(K).strip()},
ph AS (SELECT qid, answers[1] AS phrase, array_to_string({S.terms('answers[1]')}, ' ') AS ph_terms FROM qs),
dt AS (SELECT doc_id, text, array_to_string(terms, ' ') AS doc_terms FROM docs),
cand AS (SELECT sc.qid, sc.doc_id, sc.score, ph.phrase, dt.text FROM sc JOIN ph USING (qid) JOIN dt USING (doc_id)
         WHERE {neg}(length(ph.ph_terms) > 0 AND contains(' ' || dt.doc_terms || ' ', ' ' || ph.ph_terms || ' '))),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM cand)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM r
WHERE rank <= {K} AND {neg}contains(text, phrase)
"""


def _phrase_query(spark, sf_dir, must_not):
    q = questions(spark, sf_dir).withColumn("phrase", F.col("answers")[0])
    h = lexical.search_with_phrase(_index(spark, sf_dir), passages(spark, sf_dir), q, K,
                                   must_not=must_not, prune=True)
    return h.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


@register("bm25_phrase_filter", _phrase_sql(False))
def bm25_phrase_filter(spark, sf_dir):
    """BM25 restricted to passages containing the answer phrase."""
    return _phrase_query(spark, sf_dir, False)


@register("bm25_phrase_exclude", _phrase_sql(True))
def bm25_phrase_exclude(spark, sf_dir):
    """J6 + U5: BM25 excluding passages that contain the answer phrase."""
    return _phrase_query(spark, sf_dir, True)


# ----------------------------------------------------------------- J7 / J8 / X5
def labelled_hits(spark, sf_dir, match_type, boundary=False):
    """Stored as well: what follows reads them more than once, and joins of
    passages with a small stored table leave the passages where they are."""
    h = bm25_hits(spark, sf_dir)
    return materialize(match.has_answer(h, passages(spark, sf_dir), questions(spark, sf_dir),
                                        match_type=match_type, boundary=boundary, stored=True), "labelled-hits")


def passages_of(spark, sf_dir, pairs):
    """The passages that stored pairs name: only their texts are moved or cut into tokens."""
    return passages(spark, sf_dir).join(sent(pairs.select(F.col("doc_id").alias("id")).distinct()), "id", "left_semi")


@register("answer_contains_raw", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT top.qid, CAST(top.rank AS INTEGER) AS rank, top.doc_id,
       coalesce(len(list_filter(qs.answers, lambda a: contains(docs.text, a))) > 0, false) AS has_answer
FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)
""")
def answer_contains_raw(spark, sf_dir):
    """J1 + J7: raw substring containment of any answer in each BM25 hit."""
    return labelled_hits(spark, sf_dir, "raw").select("qid", "rank", "doc_id", "has_answer")


@register("has_answer_string", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT top.qid, CAST(top.rank AS INTEGER) AS rank, top.doc_id,
       coalesce(len(list_filter(qs.answers, lambda a: contains(array_to_string({S.tokens('docs.text')}, ' '),
                                                         array_to_string({S.tokens('a')}, ' ')))) > 0,
                false) AS has_answer
FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)
""")
def has_answer_string(spark, sf_dir):
    """J8 (string): token-normalized substring match of each BM25 hit."""
    return labelled_hits(spark, sf_dir, "string").select("qid", "rank", "doc_id", "has_answer")


@register("has_answer_regex", f"""
WITH {S.bm25_ctes(K).strip()}
SELECT top.qid, CAST(top.rank AS INTEGER) AS rank, top.doc_id,
       coalesce(len(list_filter(qs.answers, lambda a: regexp_matches(docs.text, a, 'i'))) > 0, false)
           AS has_answer
FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)
""")
def has_answer_regex(spark, sf_dir):
    """J8 (regex) + X5: answers used as case-insensitive patterns."""
    return labelled_hits(spark, sf_dir, "regex").select("qid", "rank", "doc_id", "has_answer")


# ----------------------------------------------------------------- G5 / A7 / A3
def training_set(spark, sf_dir):
    lab = labelled_hits(spark, sf_dir, "raw")
    return training.build_training_set(lab, passages_of(spark, sf_dir, lab), questions(spark, sf_dir))


_TS_SQL = f"""
WITH {S.bm25_ctes(K).strip()},
lab AS (SELECT top.qid, top.rank, top.doc_id,
               coalesce(len(list_filter(qs.answers, lambda a: contains(docs.text, a))) > 0, false) AS h
        FROM top JOIN qs USING (qid) LEFT JOIN docs USING (doc_id)),
agg AS (SELECT qid,
               coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE h), '') AS positive_ids,
               coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE NOT h), '') AS hard_negative_ids
        FROM lab GROUP BY qid),
ts AS (SELECT qs.qid, qs.question, coalesce(agg.positive_ids, '') AS positive_ids,
              coalesce(agg.hard_negative_ids, '') AS hard_negative_ids
       FROM qs LEFT JOIN agg USING (qid))
"""


@register("build_training_set", _TS_SQL + """
SELECT qid, question, positive_ids, hard_negative_ids FROM ts
""")
def build_training_set(spark, sf_dir):
    """G5 + A7 + F10: BM25 top-10 per question split by raw containment into
    positive / hard-negative contexts (rank order)."""
    ts = training_set(spark, sf_dir)
    return ts.select("qid", "question", training.ids_string("positive_ctxs").alias("positive_ids"),
                     training.ids_string("hard_negative_ctxs").alias("hard_negative_ids"))


@register("positive_counts", _TS_SQL + """
SELECT CAST(count_if(positive_ids <> '') AS BIGINT) AS n_with_positive,
       CAST(count_if(positive_ids = '') AS BIGINT) AS n_without_positive, count(*) AS n_total FROM ts
""")
def positive_counts(spark, sf_dir):
    """A3: questions with / without a positive context, and the total, counted
    while the training set is written."""
    _, counts = quality.counted(training_set(spark, sf_dir), "training-set", training.positive_counts())
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} long" for k in counts))
