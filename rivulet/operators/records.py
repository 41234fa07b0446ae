"""Retrieval records and gold-passage lookups.

Records are keyed by ``qid`` (an equi-join) instead of the reference's
positional zip of parallel lists; the nested ctx array of a question is
bounded by the retrieval depth.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest_ctxs(hits: DataFrame, passages: DataFrame, questions: DataFrame, *,
              id_col: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """A6 + J1 + J2: ``qid, question, answers, ctxs`` with ctxs ordered by rank;
    ``score`` is kept as a string at this sink-facing stage (X26)."""
    docs = passages.select(F.col(id_col).alias("doc_id"), F.col(title).alias("__t"),
                           F.col(text).alias("__x"))
    h = hits.join(docs, "doc_id", "left")
    entry = F.struct(F.col("rank").alias("rank"), F.struct(
        F.col("doc_id").cast("string").alias("id"), F.col("__t").alias("title"),
        F.col("__x").alias("text"),
        (F.col("score").cast("string") if "score" in hits.columns else F.lit(None).cast("string"))
        .alias("score"),
        F.col("has_answer").alias("has_answer")).alias("c"))
    g = h.groupBy("qid").agg(F.array_sort(F.collect_list(entry)).alias("__c"))
    out = questions.join(g, "qid", "left")
    empty = F.array().cast(g.schema["__c"].dataType)
    return out.withColumn("ctxs", F.transform(F.coalesce("__c", empty), lambda e: e["c"])).drop("__c")


def gold_page_flags(labelled_hits: DataFrame, passages: DataFrame, gold: DataFrame | None = None, *,
                    id_col: str = "id", title: str = "title") -> DataFrame:
    """``from_gold_page`` = lower(ctx title) == lower(gold title) of the
    question (null gold -> False).  Without an explicit ``gold`` table
    (``qid, gold_title``) the best-ranked positive hit plays the gold passage."""
    docs = passages.select(F.col(id_col).alias("doc_id"), F.col(title).alias("title"))
    h = labelled_hits.join(docs, "doc_id", "left")
    if gold is None:
        gold = (h.where(F.col("has_answer")).groupBy("qid")
                .agg(F.min_by("title", "rank").alias("gold_title")))
    j = h.join(gold, "qid", "left")
    flag = F.coalesce(F.lower("title") == F.lower("gold_title"), F.lit(False))
    return j.select("qid", "rank", "doc_id", flag.alias("from_gold_page"))


def canonical_questions(questions: DataFrame, gold: DataFrame, *, question: str = "question",
                        tokenized: str = "question_tokens") -> DataFrame:
    """J10 + S10: map a question (or its tokenized form) to the gold file's
    canonical question; unknown questions keep their own text.  Of several gold
    rows with one key the last by ``ord`` wins (without such a column the
    greatest question, so that the result is the same on every run); the
    question itself wins over its tokenized form."""
    ord_ = F.col("ord") if "ord" in gold.columns else F.lit(0)
    forms = (gold.select(F.col(question).alias("__k"), F.col(question).alias("__canon"), F.lit(1).alias("__own"), ord_.alias("__o"))
             .unionByName(gold.where(F.col(tokenized).isNotNull())
                          .select(F.col(tokenized).alias("__k"), F.col(question).alias("__canon"), F.lit(0).alias("__own"), ord_.alias("__o"))))
    keys = forms.groupBy("__k").agg(F.max(F.struct("__own", "__o", "__canon")).getField("__canon").alias("__canon"))
    j = questions.join(keys, questions[question] == F.col("__k"), "left")
    return j.withColumn(question, F.coalesce("__canon", F.col(question))).drop("__k", "__canon")


def nest_predictions(best: DataFrame, questions: DataFrame) -> DataFrame:
    """One record per question -- qid, question, gold answers and a
    ``predictions`` map top_k -> prediction struct (the map only at the sink)."""
    pred = F.struct(*[F.col(c) for c in best.columns if c not in ("qid", "top_k")])
    g = best.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("top_k"), pred)))).alias("predictions"))
    return questions.select("qid", "question", F.col("answers").alias("gold_answers")).join(g, "qid", "left")
