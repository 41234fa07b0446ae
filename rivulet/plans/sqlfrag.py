"""Shared DuckDB SQL fragments for the oracle strings.

DuckDB has no NFKC (the fixture text is already NFKC-normal, checked) and its
RE2 engine has no look-around, so the article removal of answer normalization
uses the boundary emulation ``(^|B)(a|an|the)(B|$)`` applied twice.
"""
from __future__ import annotations

from rivulet.functions.text import ALPHA_NUM as TERM_RE
from rivulet.functions.text import PY_WHITESPACE as WS_CLASS
from rivulet.functions.text import TOKEN_PATTERN as TOKEN_RE
from rivulet.functions.text import WORD_CHAR

NOT_WORD = WORD_CHAR.replace("[", "[^", 1)


def normalize_answer(expr: str) -> str:
    e = f"lower({expr})"
    e = f"regexp_replace({e}, '[!-/:-@\\[-`{{-~]', '', 'g')"
    art = f"'(^|{NOT_WORD})(a|an|the)({NOT_WORD}|$)'"
    e = f"regexp_replace({e}, {art}, '\\1 \\3', 'g')"
    e = f"regexp_replace({e}, {art}, '\\1 \\3', 'g')"
    return f"regexp_replace({e}, '{WS_CLASS}+', '', 'g')"


def normalize_text(expr: str) -> str:
    e = f"regexp_replace({expr}, '{WS_CLASS}+', ' ', 'g')"
    e = f"regexp_replace({e}, '\\p{{C}}', '', 'g')"
    return f"trim({e})"


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN_RE}')"


def terms(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TERM_RE}')"


# BM25 over documents (id = doc_id) for the benchmark questions; exposes
# CTEs docs, dl, post, tstat, cs, qs, qt, sc (all scored pairs), top (ranked).
def bm25_ctes(k: int = 10) -> str:
    return f"""
docs AS (SELECT doc_id, source AS title, text, {terms('text')} AS terms FROM documents),
dl AS (SELECT doc_id, len(terms) AS dl FROM docs),
post AS (SELECT term, doc_id, count(*) AS tf
         FROM (SELECT doc_id, unnest(terms) AS term FROM docs) GROUP BY term, doc_id),
tstat AS (SELECT term, count(*) AS df FROM post GROUP BY term),
cs AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
qs AS (SELECT item_id AS qid, text AS question, [text] AS answers
       FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf
       FROM (SELECT qid, unnest({terms('question')}) AS term FROM qs) GROUP BY qid, term),
sc AS (SELECT qt.qid, p.doc_id,
              sum(qt.qtf * ln(1 + (cs.n_docs - t.df + 0.5) / (t.df + 0.5)) * p.tf * 2.2
                  / (p.tf + 1.2 * (1 - 0.75 + 0.75 * dl.dl / cs.avgdl))) AS score
       FROM qt JOIN tstat t USING (term) JOIN post p USING (term) JOIN dl USING (doc_id)
            CROSS JOIN cs
       GROUP BY qt.qid, p.doc_id),
ranked AS (SELECT qid, doc_id, score,
                  row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank
           FROM sc),
top AS (SELECT * FROM ranked WHERE rank <= {k})"""
