"""Does a retrieved passage contain an answer?  (J1, J7, J8, X5, F14)

Matching is always done on (question, passage) pairs that already exist --
retrieval hits -- joined to the passage table on ``doc_id``; never on a cross
product.  Passage-side normalization is computed once per distinct passage.

match types
* ``raw``    -- plain substring of any answer in the passage text (dataset build)
* ``string`` -- NFKC, simple-tokenize both sides, join tokens with one space,
                substring test (the reference's active evaluation matcher;
                ``boundary=True`` requires whole-token alignment)
* ``regex``  -- each answer is a pattern searched with IGNORECASE | UNICODE |
                MULTILINE semantics; an invalid pattern never matches
"""
from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.text import nfkc, tokenize
from rivulet.session import materialize, sent


def _compiled(pattern: str | None):
    """The pattern ready to search, or None where it is null or not valid."""
    if pattern is None:
        return None
    try:
        return regex.compile(pattern, regex.IGNORECASE | regex.MULTILINE)
    except regex.error:
        return None


def _regex_any_series(text: pd.Series, patterns: pd.Series) -> pd.Series:
    """Whether any of a row's patterns is found in its text."""
    ready = {p: _compiled(p) for p in {p for ps in patterns if ps is not None for p in ps}}
    return pd.Series([t is not None and ps is not None and any(ready[p] and ready[p].search(t) for p in ps)
                      for t, ps in zip(text, patterns)], dtype=bool)


_regex_any_udf = F.pandas_udf(_regex_any_series, T.BooleanType())


def regex_match_any(text, patterns) -> Column:
    """Does any pattern match (Python regex search, IGNORECASE | UNICODE |
    MULTILINE)?  An invalid pattern never matches and raises no error."""
    t = F.col(text) if isinstance(text, str) else text
    p = F.col(patterns) if isinstance(patterns, str) else patterns
    return _regex_any_udf(t, p)


def regex_match(text, pattern) -> Column:
    """X5 for a single pattern column."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    return regex_match_any(text, F.array(p))


def token_string(col) -> Column:
    """NFKC + simple tokenizer, tokens joined by one space."""
    return F.array_join(tokenize(nfkc(col)), " ")


def normalized_answers(questions: DataFrame, match_type: str, *, qid: str = "qid",
                       answers_col: str = "answers") -> DataFrame:
    """Per question, the answers in the form the matcher compares:
    raw strings, token strings (``string``) or NFKC patterns (``regex``).
    Normalization runs once per (question, answer); the per-question regroup
    is bounded by the number of answers of one question."""
    if match_type == "raw":
        return questions.select(F.col(qid).alias("__q"),
                                F.coalesce(F.col(answers_col),
                                           F.array().cast("array<string>")).alias("__ans"))
    ex = questions.select(F.col(qid).alias("__q"),
                          F.posexplode(answers_col).alias("__i", "__a"))
    norm = token_string("__a") if match_type == "string" else nfkc("__a")
    ex = ex.withColumn("__n", norm)
    g = ex.groupBy("__q").agg(F.array_sort(F.collect_list(F.struct("__i", "__n"))).alias("__s"))
    g = g.select("__q", F.transform("__s", lambda s: s["__n"]).alias("__ans"))
    return questions.select(F.col(qid).alias("__q")).join(g, "__q", "left").select(
        "__q", F.coalesce("__ans", F.array().cast("array<string>")).alias("__ans"))


def has_answer(hits: DataFrame, passages: DataFrame, questions: DataFrame, *,
               match_type: str = "string", boundary: bool = False,
               qid: str = "qid", doc_id: str = "doc_id", id_col: str = "id",
               text_col: str = "text", answers_col: str = "answers",
               keep_text: bool = False, stored: bool = False) -> DataFrame:
    """Label every hit row with ``has_answer``.

    A hit whose passage is missing (or has null text) is labelled False (F14).
    Hits are read twice, for the passages that are needed and for the labels, so
    they are written first, unless ``stored`` says that they are a stored table:
    a search in front of this runs once.
    """
    if not stored:
        hits = materialize(hits, "hits")
    if match_type not in ("raw", "string", "regex"):
        raise ValueError(f"unknown match_type {match_type!r}")
    qa = normalized_answers(questions, match_type, qid=qid, answers_col=answers_col)
    h = hits.join(qa, hits[qid] == F.col("__q"), "left").drop("__q")
    needed = sent(hits.select(F.col(doc_id).alias("__d")).distinct())  # of the stored hits alone: few, so texts stay where they are
    docs = passages.select(F.col(id_col).alias("__d"), F.col(text_col).alias("__text"))
    docs = docs.join(needed, "__d", "left_semi")
    if match_type == "string":
        docs = docs.withColumn("__norm", token_string("__text"))
    elif match_type == "regex":
        docs = docs.withColumn("__norm", nfkc("__text"))
    else:
        docs = docs.withColumn("__norm", F.col("__text"))
    j = h.join(docs, h[doc_id] == F.col("__d"), "left").drop("__d")
    ans = F.coalesce(F.col("__ans"), F.array().cast("array<string>"))
    if match_type == "raw":
        hit = F.exists(ans, lambda a: F.contains(F.col("__norm"), a))
    elif match_type == "string" and boundary:
        spaced = F.concat(F.lit(" "), F.col("__norm"), F.lit(" "))
        hit = F.exists(ans, lambda a: F.contains(spaced, F.concat(F.lit(" "), a, F.lit(" "))))
    elif match_type == "string":
        hit = F.exists(ans, lambda a: F.contains(F.col("__norm"), a))
    else:
        hit = F.when(F.col("__norm").isNotNull(), regex_match_any(F.col("__norm"), ans))
    j = j.withColumn("has_answer", F.coalesce(hit, F.lit(False)))
    drop = ["__ans", "__norm"] + ([] if keep_text else ["__text"])
    return j.drop(*drop)
