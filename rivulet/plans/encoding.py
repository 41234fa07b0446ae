"""Encoder, vocabulary-id, annotation-group and reader-loss queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from rivulet.functions.text import analyze, tokenize
from rivulet.operators import annotate, encode, evaluate, knn, match, segment, subword
from rivulet.operators.order import add_dense_id
from rivulet.plans import sqlfrag as S
from rivulet.plans.registry import register
from rivulet.sources.tables import passages, questions, table

DIM = 64
K = 10

_BUCKETS = f"""
dt AS (SELECT doc_id, unnest(list_concat({S.terms('source')}, {S.terms('text')})) AS term FROM documents),
db AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS b, count(*) AS c
       FROM dt GROUP BY ALL)"""


@register("encode_passages", f"""
WITH {_BUCKETS.strip()},
r AS (SELECT doc_id, b, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, b) AS rn,
             count(*) OVER (PARTITION BY doc_id) AS nb FROM db)
SELECT d.doc_id, CAST(coalesce(r.b, 0) AS INTEGER) AS top_bucket, CAST(coalesce(r.nb, 0) AS INTEGER) AS n_buckets
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r.rn = 1
""")
def encode_passages(spark, sf_dir):
    """E1 + E3 + E5: title+text of every document through the registered
    default encoder (hashed bag of terms, 64 dims, L2-normalized); checked
    through the vector's arg-max bucket and its number of non-zero buckets."""
    d = table(spark, sf_dir, "documents")
    e = encode.encode(d, "text", title="source", dim=DIM)
    return e.select("doc_id", (F.array_position("vec", F.array_max("vec")) - 1).cast("int").alias("top_bucket"),
                    F.size(F.filter("vec", lambda x: x > 0)).cast("int").alias("n_buckets"))


@register("dense_qa_acc", f"""
WITH {_BUCKETS.strip()},
dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM db GROUP BY doc_id),
qt AS (SELECT item_id AS qid, unnest({S.terms("text")}) AS term FROM benchmark),
qb AS (SELECT qid, ('0x' || substr(md5(term), 1, 8))::BIGINT % {DIM} AS b, count(*) AS c FROM qt GROUP BY ALL),
qn AS (SELECT qid, sqrt(sum(c * c)) AS n FROM qb GROUP BY qid),
sc AS (SELECT qb.qid, db.doc_id, sum(qb.c * db.c) / (qn.n * dn.n) AS score
       FROM qb JOIN db USING (b) JOIN qn USING (qid) JOIN dn USING (doc_id) GROUP BY qb.qid, db.doc_id, qn.n, dn.n),
pairs AS (SELECT b.item_id AS qid, d.doc_id, coalesce(sc.score, 0) AS score
          FROM benchmark b CROSS JOIN documents d LEFT JOIN sc ON sc.qid = b.item_id AND sc.doc_id = d.doc_id),
top AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
                       FROM pairs) WHERE rank <= {K}),
lab AS (SELECT top.qid, top.rank,
               contains(array_to_string({S.tokens('d.text')}, ' '), array_to_string({S.tokens('b.text')}, ' ')) AS h
        FROM top JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = top.qid),
fh AS (SELECT qid, min(rank) AS first_hit FROM lab WHERE h GROUP BY qid),
pq AS (SELECT b.item_id, fh.first_hit FROM benchmark b LEFT JOIN fh ON fh.qid = b.item_id),
k AS (SELECT range AS top_k FROM range(1, {K + 1}))
SELECT CAST(k.top_k AS INTEGER) AS top_k, CAST(count_if(pq.first_hit <= k.top_k) AS BIGINT) AS n_hits,
       round(count_if(pq.first_hit <= k.top_k) / count(*), 4) AS acc
FROM k, pq GROUP BY k.top_k
""")
def dense_qa_acc(spark, sf_dir):
    """E1 + E2 + J3 + J8 + A1 end to end: encode passages (with titles) and
    questions, exact top-10 inner-product search, string answer matching,
    Acc@k."""
    ps = encode.encode(passages(spark, sf_dir), "text", title="title", dim=DIM, dtype="double")
    qs = encode.encode(questions(spark, sf_dir), "question", dim=DIM, dtype="double")
    hits = knn.knn(qs, ps, K, qid="qid", qvec="vec", did="id", dvec="vec")
    lab = match.has_answer(hits, passages(spark, sf_dir), questions(spark, sf_dir), match_type="string")
    return evaluate.acc_at_k(lab, K, questions(spark, sf_dir).select("qid"))


PIECES = 1000
# longest match first: all pieces at all places of each distinct word, then a walk along the longest ones
_PIECES_SQL = f"""
WITH RECURSIVE dtok AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents),
dfs AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS token FROM dtok) GROUP BY token),
top AS (SELECT token FROM dfs ORDER BY df DESC, token LIMIT {PIECES}),
plain AS (SELECT token FROM top UNION SELECT unnest(regexp_extract_all(token, '(?s).')) FROM top),
pieces AS (SELECT token, row_number() OVER (ORDER BY token) + 4 AS id, count(*) OVER () AS n FROM plain),
words AS (SELECT token AS word, length(token) AS size FROM dfs),
longest AS (SELECT max(length(token)) AS most FROM plain),
parts AS (SELECT word, size, p, l, substring(word, p, l) AS part
          FROM words, longest, range(1, size + 1) AS a(p), range(1, least(most, size - p + 1) + 1) AS b(l)),
best AS (SELECT word, size, p, max(l) AS l, arg_max(CASE WHEN p = 1 THEN id ELSE id + n END, l) AS id,
                arg_max(CASE WHEN p = 1 THEN token ELSE '##' || token END, l) AS piece
         FROM parts JOIN pieces ON part = token GROUP BY word, size, p),
walk AS (SELECT word, size, p + l AS next, [id] AS ids, [piece] AS found FROM best WHERE p = 1
         UNION ALL
         SELECT w.word, w.size, w.next + b.l, list_append(w.ids, b.id), list_append(w.found, b.piece)
         FROM walk w JOIN best b ON b.word = w.word AND b.p = w.next),
whole AS (SELECT word, ids, found FROM walk WHERE next = size + 1),
each AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM dtok),
found AS (SELECT doc_id, pos, coalesce(ids, [1]) AS ids, CASE WHEN ids IS NULL THEN [] ELSE found END AS found
          FROM each LEFT JOIN whole USING (word)),
rows AS (SELECT doc_id, flatten(list(ids ORDER BY pos)) AS ids, flatten(list(found ORDER BY pos)) AS found FROM found GROUP BY doc_id)
"""


def _document_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("tokens"))
    vocab = subword.build_pieces(d, PIECES)
    return subword.encode_pieces(d, "tokens", vocab).select("doc_id", "ids"), vocab


@register("text_to_ids", _PIECES_SQL + """
SELECT d.doc_id, CAST(coalesce(len(r.ids), 0) + 2 AS INTEGER) AS n_ids, CAST(coalesce(len(list_filter(r.ids, lambda x: x = 1)), 0) AS INTEGER) AS n_unk,
       md5('2,' || coalesce(array_to_string(r.ids, ',') || ',', '') || '3') AS ids_md5
FROM dtok d LEFT JOIN rows r USING (doc_id)
""")
def text_to_ids(spark, sf_dir):
    """Sub-word ids of every document, layout [CLS] text [SEP]; pieces from
    the most frequent words and their characters."""
    ids, _ = _document_ids(spark, sf_dir)
    return ids.select("doc_id", F.size("ids").cast("int").alias("n_ids"),
                      F.size(F.filter("ids", lambda x: x == 1)).cast("int").alias("n_unk"),
                      F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@register("ids_to_text", _PIECES_SQL + """
SELECT d.doc_id, md5(replace(coalesce(array_to_string(r.found, ' '), ''), ' ##', '')) AS text_md5 FROM dtok d LEFT JOIN rows r USING (doc_id)
""")
def ids_to_text(spark, sf_dir):
    """Ids back to text, continuations joined (special and unknown tokens skipped)."""
    ids, vocab = _document_ids(spark, sf_dir)
    return subword.decode_pieces(ids, "ids", vocab).select("doc_id", F.md5("text").alias("text_md5"))


WORDS, STOPWORDS = 300, ("the", "la", "die")
# the cheapest path by dynamic programming: costs of all places so far are carried along, then the path is walked back
_SEGMENT_SQL = f"""
WITH RECURSIVE runs AS (SELECT doc_id, {S.terms('text')} AS terms FROM documents),
each AS (SELECT doc_id, unnest(terms) AS run, generate_subscripts(terms, 1) AS pos FROM runs),
dfs AS (SELECT run AS surface, count(DISTINCT doc_id) AS df FROM each WHERE length(run) <= 20 GROUP BY run),
words AS (SELECT surface, row_number() OVER (ORDER BY df DESC, surface) + 99 AS cost FROM dfs QUALIFY cost < {100 + WORDS}),
dictionary AS (SELECT map(list(surface), list(cost)) AS m, max(length(surface)) AS longest FROM words),
walk AS (SELECT DISTINCT run, 0 AS place, [CAST(0 AS BIGINT)] AS costs, [CAST(0 AS BIGINT)] AS lengths FROM each
         UNION ALL
         SELECT run, place + 1, list_append(costs, best.cost), list_append(lengths, -best.size)
         FROM (SELECT run, place, costs, lengths, list_sort(list_filter(list_transform(range(1, least(longest, place + 1) + 1), lambda l:
                   {{'cost': costs[place + 2 - l] + coalesce(m[substring(run, place + 2 - l, l)], CASE WHEN l = 1 THEN 10000 END), 'size': -l}}),
                   lambda s: s.cost IS NOT NULL))[1] AS best
               FROM walk, dictionary WHERE place < length(run))),
back AS (SELECT run, place, lengths, CAST([] AS VARCHAR[]) AS found FROM walk WHERE place = length(run)
         UNION ALL
         SELECT run, place - lengths[place + 1], lengths, list_prepend(substring(run, place - lengths[place + 1] + 1, lengths[place + 1]), found)
         FROM back WHERE place > 0),
whole AS (SELECT run, list_filter(found, lambda w: w NOT IN {STOPWORDS}) AS found FROM back WHERE place = 0),
texts AS (SELECT doc_id, flatten(list(found ORDER BY pos)) AS found FROM each JOIN whole USING (run) GROUP BY doc_id)
SELECT r.doc_id, CAST(coalesce(len(found), 0) AS INTEGER) AS n_words, md5(coalesce(array_to_string(found, ' '), '')) AS words_md5
FROM runs r LEFT JOIN texts USING (doc_id)
"""


@register("segmented_terms", _SEGMENT_SQL)
def segmented_terms(spark, sf_dir):
    """Every run of letters cut into words of a dictionary of the most
    frequent ones, without stop words."""
    d = table(spark, sf_dir, "documents").select("doc_id", analyze("text").alias("terms"))
    words = segment.segment(d, "terms", segment.build_dictionary(d, WORDS), stopwords=STOPWORDS)
    return words.select("doc_id", F.size("words").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5"))


_TAG = r"""CASE WHEN regexp_matches(tok, '^\p{N}+$') THEN 'NUM'
             WHEN regexp_matches(tok, '^\p{Lu}') THEN 'CAP'
             WHEN regexp_matches(tok, '^[^\p{L}\p{N}]$') THEN 'PUNCT' ELSE 'O' END"""


@register("tag_groups", f"""
WITH t AS (SELECT doc_id, {S.tokens('text')} AS ts FROM documents),
e AS (SELECT doc_id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS pos FROM t),
g AS (SELECT *, {_TAG} AS tag FROM e),
f AS (SELECT *, CASE WHEN lag(tag) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM tag THEN 1 ELSE 0 END AS nw
      FROM g),
r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
      FROM f),
grp AS (SELECT doc_id, grp, tag, string_agg(tok, ' ' ORDER BY pos) AS text FROM r WHERE tag <> 'O'
        GROUP BY doc_id, grp, tag)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_groups,
       md5(string_agg(tag || ':' || text, '|' ORDER BY grp)) AS groups_md5
FROM grp GROUP BY doc_id
""")
def tag_groups(spark, sf_dir):
    """X7d: consecutive tokens with the same tag grouped, the outside tag
    skipped; tags from a rule-based stand-in annotator (NUM / CAP / PUNCT)."""
    d = table(spark, sf_dir, "documents").select("doc_id", tokenize("text").alias("tokens"))
    tag = lambda t: (F.when(t.rlike(r"^\p{N}+$"), "NUM").when(t.rlike(r"^\p{Lu}"), "CAP")
                     .when(t.rlike(r"^[^\p{L}\p{N}]$"), "PUNCT").otherwise("O"))
    d = d.withColumn("tags", F.transform("tokens", tag))
    d = d.select("doc_id", annotate.tag_runs(F.col("tokens"), F.col("tags")).alias("runs")).where(F.size("runs") > 0)
    return d.select("doc_id", F.size("runs").alias("n_groups"), F.md5(F.array_join(
        F.transform("runs", lambda r: F.concat(r["tag"], F.lit(":"), r["text"])), "|")).alias("groups_md5"))


@register("reader_span_loss", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS st, list_reverse(CAST(embedding AS DOUBLE[])) AS en,
                  CAST(embedding[1] AS DOUBLE) AS rel,
                  row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
l AS (SELECT pos // 2 AS qid, pos % 2 AS slot, st, en, rel,
             list_max(st) + ln(list_sum(list_transform(st, lambda x: exp(x - list_max(st))))) AS lse_s,
             list_max(en) + ln(list_sum(list_transform(en, lambda x: exp(x - list_max(en))))) AS lse_e FROM e),
sp AS (SELECT * FROM (VALUES (0, 0, 0), (1, 1, 3)) t(a, s, e)),
la AS (SELECT l.qid, sp.a, max((l.lse_s - l.st[sp.s + 1]) + (l.lse_e - l.en[sp.e + 1])) AS loss
       FROM l, sp WHERE l.slot = 0 GROUP BY l.qid, sp.a),
pq AS (SELECT qid, sum(CASE WHEN loss = 0 THEN 0 ELSE exp(-loss) END) AS ml FROM la GROUP BY qid),
span AS (SELECT sum(-ln(ml + CASE WHEN ml = 0 THEN 1 ELSE 0 END)) AS span_loss FROM pq),
rl AS (SELECT qid, max(rel) AS m, max(CASE WHEN slot = 0 THEN rel END) AS r0 FROM l GROUP BY qid),
sw AS (SELECT sum(rl.m + ln(x.se) - rl.r0) AS switch_loss
       FROM rl JOIN (SELECT l.qid, sum(exp(l.rel - rl.m)) AS se FROM l JOIN rl USING (qid) GROUP BY l.qid) x USING (qid))
SELECT round(span_loss, 4) AS span_loss, round(switch_loss, 4) AS switch_loss,
       round(span_loss + switch_loss, 4) AS loss FROM span, sw
""")
def reader_span_loss(spark, sf_dir):
    """Reader loss over synthetic logits -- consecutive embedding pairs
    are a question's two passages (slot 0 positive with answer spans (0,0)
    and (1,3)); start logits = vector, end logits = reversed vector,
    relevance = first coordinate."""
    e = table(spark, sf_dir, "embeddings")
    p = add_dense_id(e, "vec_id", name="pos", start=0)
    spans = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")),
                    F.struct(F.lit(1).alias("s"), F.lit(3).alias("e")))
    lg = p.select(F.floor(F.col("pos") / 2).cast("long").alias("qid"), (F.col("pos") % 2).cast("int").alias("slot"),
                  F.col("embedding").alias("start_logits"), F.reverse("embedding").alias("end_logits"),
                  F.col("embedding")[0].cast("double").alias("relevance"))
    lg = lg.withColumn("spans", F.when(F.col("slot") == 0, spans).otherwise(F.array().cast("array<struct<s:int,e:int>>")))
    return evaluate.reader_span_loss(lg)
