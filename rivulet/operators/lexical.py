"""Lexical index as stored tables, and ranked search that scores only passages
which can reach the top k (K15, A9, J5, J6, T2, U5).

An index is a folder of tables, written once and opened by its path:

* ``forward(doc_id, dl)``  -- a passage's number of terms
* ``postings(doc_id, term, dl, tf, positions)`` -- bucketed by ``doc_id``, those of
  a term together; opened, they also have ``block``, a hash range of passages, and
  ``impact``, the term's BM25 factor there, which follow from the stored columns
* ``terms(term, df, cf)`` and ``corpus(n_docs, avgdl, ...)``

``blocks(term, block, df, cf, best, best_doc)`` is an aggregate of the postings,
taken for the terms that a search asks for: ``best`` is the highest impact of the
term in the block.  Stored for all terms, it would grow with every rare word.

A search runs in three steps.  (1) Threshold: the passages with the best impact
in their block, for the question's most telling terms, are scored exactly; the
k-th best of them is a score that the k-th hit has at least.  (2) Candidates: in
each block the question's terms are ordered by their bound there; terms whose
bounds do not add up to the threshold cannot lift a passage over it by
themselves, and a passage stays if the other (essential) terms and the bounds of
the rest reach the threshold.  (3) What stays is ranked by all its terms.  Steps
(2) and (3) are one pass over the postings, bucket by bucket: pairs of question
and passage, which can be as many as both together, are neither shuffled nor
stored.  No score is approximate and no term is dropped.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rivulet.functions.batches import SLICE_ITEMS, sizes, slices
from rivulet.functions.text import analyze
from rivulet.session import ensure_checkpoint_dir, materialize, sent

K1 = 1.2
B = 0.75
#: Passages a block, and the least and greatest number of blocks.
BLOCK_DOCS, MIN_BLOCKS, MAX_BLOCKS = 4096, 16, 256
#: For the threshold, best passages of (term, block) scored for each hit asked for.
SEEDS = 4
#: Share of a block's postings for a question from which all of them are read.
MOST = 0.4
#: Scores that differ by less are taken as equal when something is left out.
SLACK = 1e-5
#: Postings of all questions together up to which they are scored in one pass:
#: the jobs that find thresholds cost more than they save.
DIRECT_POSTINGS = 50_000_000
#: Terms (repeats included) of a bucket of postings: its rows are sorted in memory
#: whatever the corpus, so there are more buckets, not larger ones.
BUCKET_TERMS = 1 << 20
#: Buckets read by a task that adds up postings by term: the more, the fewer rows of
#: a term are shuffled.
ADDED_BUCKETS = 8
#: (question, term) pairs up to which they are sent to all tasks, with the blocks
#: where they are essential.
SENT_TERMS = 1 << 16
#: Columns of the stored postings beside doc_id, whose type is the passages'.
POSTING = "term string, dl bigint, tf bigint, positions array<int>"
#: Of the stored tables; an index of another form is built anew.
FORM = 2


@dataclass
class LexicalIndex:
    path: str
    forward: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame  # one row: n_docs, avgdl, n_blocks, n_buckets, k1, b, form
    buckets: int

    @property
    def doc_stats(self) -> DataFrame:
        return self.forward.select("doc_id", "dl")

    @property
    def blocks(self) -> DataFrame:
        return block_stats(_several(self.postings, self.buckets))


def build_index(passages: DataFrame, *, id_col: str = "id", text_col: str = "text", analyzer=analyze,
                path: str | None = None, num_buckets: int | None = None, k1: float = K1, b: float = B) -> LexicalIndex:
    """K15 + A9: write an index to ``path`` (a new folder under the session's
    checkpoint folder by default) and open it.

    The texts are dealt by ``doc_id`` once, which is also the bucketing of the
    postings made of them: a term that stands in every passage is spread over all
    buckets, and there are as many buckets as the terms need (or ``num_buckets``).
    The analyzer runs twice, to count the terms and to make postings of them,
    since lists of terms are far larger than texts on their way and stored.
    Statistics are partial aggregates of the stored postings.  N counts
    every passage, also one without terms.  ``corpus`` is written last: an index
    cut off before that does not open.
    """
    spark = passages.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivulet-lexical-{uuid.uuid4().hex}"
    texts = passages.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    terms = F.coalesce(analyzer(F.col("text")), F.array().cast("array<string>")).alias("terms")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")

    write(texts.select("doc_id", terms).select("doc_id", F.size("terms").cast("long").alias("dl")), "forward")
    total = spark.read.parquet(f"{path}/forward").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms")).first()
    avgdl = total["terms"] / total["n"] if total["n"] else None
    buckets = num_buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total["terms"] // BUCKET_TERMS))
    n_blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, total["n"] // BLOCK_DOCS))
    dealt = texts.repartition(buckets, "doc_id").select("doc_id", terms).select("doc_id", F.size("terms").cast("long").alias("dl"), "terms")
    name = f"rivulet_postings_{uuid.uuid4().hex[:12]}"
    # a bucket's postings of a term stand together, by a number, as that sorts in a fraction of the time that words take
    postings = _grouped(dealt).select("doc_id", "term", "dl", "tf", "positions").sortWithinPartitions(F.xxhash64("term"))
    (postings.write.mode("overwrite").option("compression", "zstd")
     .bucketBy(buckets, "doc_id").option("path", f"{path}/postings").saveAsTable(name))
    write(_several(spark.table(name), buckets).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), "terms")
    write(spark.range(1).select(F.lit(total["n"]).cast("long").alias("n_docs"), F.lit(avgdl).cast("double").alias("avgdl"),
                                F.lit(n_blocks).alias("n_blocks"), F.lit(buckets).alias("n_buckets"),
                                F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), F.lit(FORM).alias("form")).coalesce(1), "corpus")
    return open_index(spark, path)


def _grouped(forward: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf, positions): the places of each term of a passage,
    found for many passages of an Arrow batch by one sort; no shuffle."""
    def run(batches):
        for whole in batches:
            for start, n in slices(sizes(whole.column(2)), SLICE_ITEMS):
                b = whole.slice(start, n)
                n_terms = b.column(1).to_numpy().astype(np.int64)
                words = b.column(2).flatten().dictionary_encode()
                if not len(words):
                    continue
                row = np.repeat(np.arange(b.num_rows), n_terms)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n_terms) - n_terms, n_terms)
                key = row * len(words.dictionary) + words.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                edges = np.r_[first, len(key)]
                rows = pa.array(row[order[first]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), words.dictionary.take(words.indices.take(pa.array(order[first]))),
                     pa.array(np.diff(edges), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place[order], pa.int32()))],
                    names=["doc_id", "dl", "term", "tf", "positions"])

    kind = forward.schema["doc_id"].dataType.simpleString()
    return forward.select("doc_id", "dl", "terms").mapInArrow(run, f"doc_id {kind}, dl bigint, term string, tf bigint, positions array<int>")


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    """Open a stored index.  Its postings become a table of the session again,
    so that joins and sums on ``doc_id`` need no shuffle."""
    corpus = spark.read.parquet(f"{path}/corpus")
    c = corpus.first()
    if "form" not in corpus.columns or c["form"] != FORM:
        raise ValueError(f"the index at {path} has another form")
    read = {t: spark.read.parquet(f"{path}/{t}") for t in ("forward", "terms")}
    doc_id = read["forward"].schema["doc_id"].dataType.simpleString()
    name = f"rivulet_postings_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE TABLE {name} (doc_id {doc_id}, {POSTING}) USING parquet "
              f"CLUSTERED BY (doc_id) INTO {c['n_buckets']} BUCKETS LOCATION '{path}/postings'")
    norm = c["k1"] * (1 - c["b"] + c["b"] * F.col("dl") / F.lit(c["avgdl"] or 1.0))
    postings = spark.table(name).select("doc_id", "term", F.pmod(F.xxhash64("doc_id"), F.lit(c["n_blocks"])).cast("int").alias("block"), "tf",
                                        (F.col("tf") * (c["k1"] + 1) / (F.col("tf") + norm)).alias("impact"), "positions")
    return LexicalIndex(path, read["forward"], postings, read["terms"], corpus, c["n_buckets"])


def _several(postings: DataFrame, buckets: int) -> DataFrame:
    """Postings with several buckets a task, though not fewer tasks than cores."""
    return postings.coalesce(max(postings.sparkSession.sparkContext.defaultParallelism, buckets // ADDED_BUCKETS))


def block_stats(postings: DataFrame) -> DataFrame:
    """(term, block, df, cf, best, best_doc) of postings."""
    return postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("impact").alias("best"),
                                                 F.max_by("doc_id", "impact").alias("best_doc"))


def index_for(passages: DataFrame, path: str, **options) -> LexicalIndex:
    """The index stored at ``path``; built there first if there is none."""
    try:
        return open_index(passages.sparkSession, path)
    except (AnalysisException, ValueError) as e:
        if "PATH_NOT_FOUND" not in str(e) and "another form" not in str(e):
            raise
        return build_index(passages, path=path, **options)


def query_terms(questions: DataFrame, *, qid: str = "qid", text_col: str = "question",
                analyzer=analyze) -> DataFrame:
    """Question -> (qid, term, qtf): query term multiplicities."""
    return (questions.select(F.col(qid).alias("qid"),
                             F.explode_outer(analyzer(F.col(text_col))).alias("term"))
            .where(F.col("term").isNotNull())
            .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def weighted_terms(index: LexicalIndex, qterms: DataFrame) -> DataFrame:
    """(qid, term, weight): query multiplicity times inverse document frequency,
    of the terms that the index has."""
    n_docs = index.corpus_stats.select("n_docs").scalar()
    df = F.col("df")
    return (qterms.join(index.term_stats.select("term", "df"), "term").withColumn("n_docs", n_docs)
            .select("qid", "term", (F.col("qtf") * F.log(1 + (F.col("n_docs") - df + 0.5) / (df + 0.5))).alias("weight")))


def _sum(contrib: Column) -> Column:
    return F.sum(contrib).alias("score")


def score_pairs(index: LexicalIndex, weights: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact scores of given (qid, doc_id) pairs that share a term.  The pairs
    are stored and meet the postings on ``doc_id`` alone, so that these stay
    where they are however many the pairs are."""
    wanted = materialize(pairs, "lexical-pairs")
    return (index.postings.select("doc_id", "term", "impact").join(sent(wanted), "doc_id").join(sent(weights), ["qid", "term"])
            .groupBy("qid", "doc_id").agg(_sum(F.col("weight") * F.col("impact"))))


def _all_scores(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    return (weights.join(index.postings.select("doc_id", "term", "impact"), "term")
            .groupBy("qid", "doc_id").agg(_sum(F.col("weight") * F.col("impact"))))


def bm25_scores(index: LexicalIndex, qterms: DataFrame) -> DataFrame:
    """Every (qid, doc_id) sharing a term, with its BM25 score."""
    return _all_scores(index, weighted_terms(index, qterms))


def few_postings(index: LexicalIndex, weights: DataFrame) -> bool:
    """Whether the questions' postings, by the stored statistics, are so few
    that one pass over them is the cheaper way."""
    n = sent(weights).join(index.term_stats.select("term", "df"), "term").agg(F.sum("df")).first()[0]
    return (n or 0) <= DIRECT_POSTINGS


def thresholds(index: LexicalIndex, weights: DataFrame, bounds: DataFrame, k: int, excluded: DataFrame | None) -> DataFrame:
    """(qid, least): a score that the question's k-th hit has at least; none
    for a question with fewer passages scored."""
    by_bound = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "term", "block")
    seeds = (bounds.withColumn("n", F.row_number().over(by_bound)).where(F.col("n") <= SEEDS * k)
             .select("qid", F.col("best_doc").alias("doc_id")).distinct())
    if excluded is not None:
        seeds = seeds.join(excluded, ["qid", "doc_id"], "left_anti")
    best_first = Window.partitionBy("qid").orderBy(F.col("score").desc())
    scored = score_pairs(index, weights, seeds).withColumn("n", F.row_number().over(best_first))
    return scored.where(F.col("n") == k).select("qid", (F.col("score") - SLACK).alias("least"))


def marked_terms(bounds: DataFrame, least: DataFrame) -> DataFrame:
    """``bounds`` with ``essential`` and ``need``: what the essential terms alone
    must give in that block."""
    here = Window.partitionBy("qid", "block")
    rising = here.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    cut = F.coalesce("least", F.lit(0.0))
    marked = bounds.join(least, "qid", "left").withColumn("essential", F.sum("bound").over(rising) >= cut)
    read = F.sum(F.when(F.col("essential"), F.col("df")).otherwise(0)).over(here) / F.sum("df").over(here)
    marked = marked.withColumn("read", read).withColumn("essential", F.col("essential") | (F.col("read") >= MOST))
    rest = F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).over(here)
    return marked.withColumn("need", cut - rest).select("qid", "term", "block", "weight", "need", "essential")


def bounds_of(index: LexicalIndex, weights: DataFrame) -> DataFrame:
    """``weights`` by block, with ``bound``, the most that the term can give a
    passage there.  Block statistics are taken for the questions' terms alone."""
    asked = sent(weights.select("term").distinct())
    postings = index.postings.select("doc_id", "term", "block", "tf", "impact").join(asked, "term", "left_semi")
    stats = block_stats(_several(postings, index.buckets))
    return (sent(weights).join(stats.select("term", "block", "df", "best", "best_doc"), "term")
            .withColumn("bound", F.col("weight") * F.col("best")))


def candidates(index: LexicalIndex, marked: DataFrame) -> DataFrame:
    """(qid, doc_id, block, score, total) of every passage that can reach the
    threshold; the score is that of the essential terms, the total that of all.
    Unless the questions are very many, their terms go to the postings, and these
    stay where they are."""
    postings = index.postings.select("doc_id", "term", "block", "impact")
    terms = marked.groupBy("qid", "term").agg(F.first("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("block", "essential"))).alias("by"))
    if terms.select("qid").limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        flags = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("by"))), lambda b: F.try_element_at("by", b))
        found = (postings.join(F.broadcast(terms.select("qid", "term", "weight", flags.alias("flags"))), "term")
                 .withColumn("essential", F.get("flags", F.col("block"))))
    else:
        found = postings.join(marked.select("qid", "term", "block", "weight", "essential"), ["term", "block"])
    part = F.col("weight") * F.col("impact")
    needs = marked.groupBy("qid", "block").agg(F.first("need").alias("need"))
    return (found.groupBy("qid", "doc_id").agg(_sum(F.when(F.col("essential"), part).otherwise(0.0)), F.sum(part).alias("total"), F.first("block").alias("block"))
            .join(sent(needs), ["qid", "block"]).where(F.col("score") >= F.col("need")).select("qid", "doc_id", "block", "score", "total"))


def top_k(scores: DataFrame, k: int, *, qid: str = "qid", doc: str = "doc_id",
          score: str = "score", rank_digits: int = 6) -> DataFrame:
    """Per-question top-k, ties broken by smaller doc id.

    Ranking uses the score rounded to ``rank_digits`` so that float noise from
    a different summation order cannot reorder exact ties (duplicate passages).
    """
    w = Window.partitionBy(qid).orderBy(F.round(score, rank_digits).desc(), F.col(doc).asc())
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def _ranked(index: LexicalIndex, weights: DataFrame, k: int, prune: bool | None, excluded: DataFrame | None = None) -> DataFrame:
    if prune is False or prune is None and few_postings(index, weights):
        scores = _all_scores(index, sent(weights))
    else:
        bounds = materialize(bounds_of(index, weights), "lexical-bounds")
        least = materialize(thresholds(index, weights, bounds, k, excluded), "lexical-least")
        marked = materialize(marked_terms(bounds, least), "lexical-marked")
        scores = candidates(index, marked).select("qid", "doc_id", F.col("total").alias("score"))
    return top_k(scores if excluded is None else scores.join(sent(excluded), ["qid", "doc_id"], "left_anti"), k)


def _weights(index: LexicalIndex, questions: DataFrame, qid: str, text_col: str, analyzer) -> DataFrame:
    """The questions' terms with their weights, stored."""
    terms = materialize(query_terms(questions, qid=qid, text_col=text_col, analyzer=analyzer), "lexical-terms")
    return materialize(weighted_terms(index, sent(terms)), "lexical-weights")


def search(index: LexicalIndex, questions: DataFrame, k: int = 10, *, qid: str = "qid",
           text_col: str = "question", analyzer=analyze, prune: bool | None = None) -> DataFrame:
    """J5 + T2: BM25 ``match`` query, top ``k`` passages per question.
    Returns ``qid, rank, doc_id, score``.  ``prune`` forces the search by bounds
    (True) or one pass over all the questions' postings (False); by default their
    number decides."""
    weights = _weights(index, questions, qid, text_col, analyzer)
    return _ranked(index, weights, k, prune).select("qid", "rank", "doc_id", "score")


def phrase_passages(index: LexicalIndex, questions: DataFrame, *, qid: str = "qid", phrase_col: str = "phrase",
                    analyzer=analyze) -> DataFrame:
    """(qid, doc_id) of the passages that hold the question's phrase as a run of
    terms, by positions: places of the phrase's rarest term give beginnings, and
    every other term must stand at its distance from one of them.  A phrase
    without terms is in no passage."""
    ph = questions.select(F.col(qid).alias("qid"), analyzer(F.col(phrase_col)).alias("terms")).where(F.size("terms") > 0)
    place = ph.select("qid", F.size("terms").alias("length"), F.posexplode("terms").alias("at", "term"))
    place = materialize(place, "phrase-places")
    known = index.term_stats.select("term", "df").join(sent(place.select("term").distinct()), "term", "left_semi")
    rare = Window.partitionBy("qid").orderBy("df", "term", "at")
    place = materialize(place.join(known, "term", "left")
                        .withColumn("df", F.coalesce("df", F.lit(0))).withColumn("n", F.row_number().over(rare)), "phrase-terms")
    postings = index.postings.select("doc_id", "term", "positions")
    begins = (postings.join(sent(place.where("n = 1").select("qid", "length", "at", "term")), "term")
              .select("qid", "length", "doc_id", F.explode("positions").alias("pos"), "at")
              .select("qid", "length", "doc_id", (F.col("pos") - F.col("at")).alias("begin")).where("begin >= 0"))
    begins = materialize(begins.groupBy("qid", "length", "doc_id").agg(F.collect_set("begin").alias("begins")), "phrase-begins")
    meets = F.array_intersect("begins", F.transform("positions", lambda p: p - F.col("at")))
    # begins meet the postings on doc_id alone, as these are bucketed
    others = (postings.join(sent(begins), "doc_id").join(sent(place.where("n > 1").select("qid", "at", "term")), ["qid", "term"])
              .select("qid", "length", "doc_id", F.explode(meets).alias("begin"))
              .groupBy("qid", "doc_id", "begin").agg(F.count(F.lit(1)).alias("n"), F.first("length").alias("length"))
              .where("n = length - 1").select("qid", "doc_id"))
    return others.unionByName(begins.where("length = 1").select("qid", "doc_id")).distinct()


def search_with_phrase(index: LexicalIndex, passages: DataFrame, questions: DataFrame,
                       k: int = 10, *, qid: str = "qid", text_col: str = "question",
                       phrase_col: str = "phrase", must_not: bool = False,
                       id_col: str = "id", passage_text: str = "text",
                       analyzer=analyze, prune: bool | None = None) -> DataFrame:
    """BM25 query restricted to passages that contain (``must_not=False``)
    or do not contain (``must_not=True``) the question's phrase as a term
    sequence; top-k is taken after the restriction, then the reference's raw
    substring re-check is applied (so a question may return fewer than k).
    Texts are read for the hits alone, after the cut."""
    weights = _weights(index, questions, qid, text_col, analyzer)
    holding = materialize(phrase_passages(index, questions, qid=qid, phrase_col=phrase_col, analyzer=analyzer), "phrase-passages")
    if must_not:
        top = _ranked(index, weights, k, prune, holding)
    else:
        top = top_k(score_pairs(index, weights, holding), k)
    texts = passages.select(F.col(id_col).alias("doc_id"), F.col(passage_text).alias("ptext"))
    # the stored hits, known to be few, meet the texts first: these then stay where they are
    hits = sent(materialize(top.select("qid", "rank", "doc_id", "score"), "phrase-hits")).join(texts, "doc_id") \
        .join(questions.select(F.col(qid).alias("qid"), F.col(phrase_col).alias("phrase")), "qid")
    raw = F.contains(F.col("ptext"), F.col("phrase"))
    return hits.where(~raw if must_not else raw).select("qid", "rank", "doc_id", "score")
