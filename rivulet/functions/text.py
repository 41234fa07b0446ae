"""Column -> Column text functions (normalization, tokenization, n-grams).

Everything here is a built-in Spark expression except NFKC, which Spark has
no function for; that one is an Arrow UDF with an ASCII fast path (ASCII text
is already NFKC-normal).
"""
from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.batches import SLICE_TEXT, sizes, slices

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Token pattern of the simple tokenizer: a run of letters / digits / marks, or
# any single character that is neither a separator nor a control character.
ALPHA_NUM = r"[\p{L}\p{N}\p{M}]+"
NON_WS = r"[^\p{Z}\p{C}]"
TOKEN_PATTERN = f"{ALPHA_NUM}|{NON_WS}"
# Characters Python's str.split() treats as whitespace, as a Java class.
PY_WHITESPACE = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
# English articles removed by answer normalization.
ARTICLES = ("a", "an", "the")
# ASCII punctuation (Python's string.punctuation) as a Java character class.
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"
# Characters that count as "word" characters for \b, combining marks among them.
WORD_CHAR = r"[\p{L}\p{N}\p{M}_]"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _nfkc_texts(texts: pa.Array) -> pa.Array:
    """Only slices with a text beyond ASCII become Python strings."""
    parts = []
    for start, n in slices(sizes(texts), SLICE_TEXT):
        part = texts.slice(start, n)
        if not pc.all(pc.string_is_ascii(part)).as_py() and part.null_count < n:
            part = pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in part.to_pylist()], texts.type)
        parts.append(part)
    return pa.concat_arrays(parts) if parts else texts


_nfkc_udf = F.arrow_udf(_nfkc_texts, T.StringType())


def nfkc(col) -> Column:
    """Unicode NFKC normalization."""
    return _nfkc_udf(_c(col))


def collapse_whitespace(col) -> Column:
    """Python ``" ".join(s.split())`` minus the strip (callers trim)."""
    return F.regexp_replace(_c(col), PY_WHITESPACE + "+", " ")


def normalize_text(col, unicode_normalize: bool = True) -> Column:
    """NFKC -> collapse whitespace -> drop non-printable -> strip."""
    c = nfkc(col) if unicode_normalize else _c(col)
    return clean_text(c)


def clean_text(col) -> Column:
    """X1 without the NFKC step (built-ins only, usable inside ``transform``)."""
    c = collapse_whitespace(_c(col))
    c = F.regexp_replace(c, r"\p{C}", "")
    return F.trim(c)


def split_paragraphs(text, min_len: int = 10, max_len: int = 1000, sep: str = "\n") -> Column:
    """Newline paragraphs of one text, NFKC + X1-normalized, kept when
    ``min_len <= length <= max_len`` (F5), in text order.  Everything stays in
    the row (NFKC once per text, then array built-ins), so numbering the kept
    paragraphs (W2) is a ``posexplode`` -- no shuffle, no window."""
    lines = F.split(nfkc(text), sep)
    cleaned = F.transform(lines, clean_text)
    return F.filter(cleaned, lambda x: F.length(x).between(min_len, max_len))


def normalize_answer(col) -> Column:
    """Lower -> drop ASCII punctuation -> drop articles -> delete whitespace."""
    c = F.lower(_c(col))
    c = F.regexp_replace(c, ASCII_PUNCT, "")
    arts = "|".join(ARTICLES)
    c = F.regexp_replace(c, f"(?<!{WORD_CHAR})(?:{arts})(?!{WORD_CHAR})", " ")
    return F.regexp_replace(c, PY_WHITESPACE + "+", "")


def exact_match(pred, gold) -> Column:
    """Normalized prediction equals normalized ground truth."""
    return normalize_answer(pred) == normalize_answer(gold)


def normalize_question(col) -> Column:
    """Drop one trailing ASCII question mark."""
    return F.regexp_replace(_c(col), r"\?\z", "")


def tokenize(col) -> Column:
    """Simple tokenizer, ARRAY<STRING> of tokens in text order."""
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def words(tokens, uncased: bool = False) -> Column:
    """Token texts, optionally lower-cased."""
    t = _c(tokens)
    return F.transform(t, lambda x: F.lower(x)) if uncased else t


def ngrams(tokens, n: int = 1, uncased: bool = False, keep=None) -> Column:
    """Every 1..n-gram ordered by (start, length), joined by spaces.

    ``keep`` is an optional ``Column -> Column`` predicate over the n-gram's
    token array (the reference's filter_fn, applied before joining).
    Linear in the token count: the array is zipped with its own shifted
    copies, so no lambda re-evaluates the (possibly expensive) input.
    """
    if keep is None:
        return _ngrams_fast(tokens, n, uncased)
    t = words(tokens, uncased)
    shifted = [t] + [F.slice(t, j + 1, F.greatest(F.size(t), F.lit(1))) for j in range(1, n)]
    z = F.arrays_zip(*[c.alias(f"t{j}") for j, c in enumerate(shifted)])

    def grams(e):
        out = []
        for ln in range(1, n + 1):
            parts = [e[f"t{j}"] for j in range(ln)]
            ok = parts[-1].isNotNull()
            if keep is not None:
                ok = ok & keep(F.array(*parts))
            out.append(F.when(ok, F.concat_ws(" ", *parts)))
        return F.filter(F.array(*out), lambda x: x.isNotNull())

    return F.coalesce(F.flatten(F.transform(z, grams)), F.array().cast("array<string>"))


def _ngrams_fast(tokens, n: int, uncased: bool) -> Column:
    """ngrams without a filter: per length one ``zip_with`` over shifted
    copies, interleaved by nesting ``zip_with`` and flattened; missing tails
    are nulls removed by ``array_compact`` (no per-element filter lambda).
    Lower-casing joins / splits once (tokens never contain a space)."""
    from rivulet.functions.bind import let

    def body(t):
        if uncased:
            t = F.when(F.size(t) > 0, F.split(F.lower(F.array_join(t, " ")), " ")).otherwise(t)
        return let(lambda w: _interleave(w, n), t)

    return F.coalesce(let(body, _c(tokens)), F.array().cast("array<string>"))


def _interleave(w, n: int) -> Column:
    sz = F.size(w)
    grams = [w]
    for ln in range(2, n + 1):
        parts = [F.slice(w, j + 1, F.greatest(sz, F.lit(1))) for j in range(ln)]
        g = parts[0]
        for p in parts[1:]:
            g = F.zip_with(g, p, lambda a, b: F.concat(a, F.lit(" "), b))
        grams.append(g)
    if n == 1:
        return w
    acc = F.zip_with(grams[0], grams[1], lambda a, b: F.array(a, b))
    for g in grams[2:]:
        acc = F.zip_with(acc, g, lambda a, b: F.concat(a, F.array(b)))
    return F.array_compact(F.flatten(acc))


def strip_quotes(col) -> Column:
    """Strip every leading / trailing double quote."""
    return F.regexp_replace(_c(col), r'^"+|"+$', "")


def json_quote(col) -> Column:
    """JSON string literal of the text, non-ASCII kept."""
    j = F.to_json(F.array(_c(col)))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def json_unquote(col) -> Column:
    """Inverse of X10 (the corrected read path of passage TSVs)."""
    return F.from_json(F.concat(F.lit("["), _c(col), F.lit("]")), "array<string>")[0]


def format_id(*cols, sep: str = "-") -> Column:
    """``{}-{}-{}`` identifiers."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def analyze(col, stopwords=(), unicode_normalize: bool = True) -> Column:
    """Lexical analyzer -> ARRAY<STRING> of index terms.

    NFKC -> lower -> ``[\\p{L}\\p{N}\\p{M}]+`` terms -> stop words removed.
    The reference's morphological analyzer is not reproducible; this is a
    documented different analyzer with the same operator contract.
    """
    c = nfkc(col) if unicode_normalize else _c(col)
    terms = F.regexp_extract_all(F.lower(c), F.lit(ALPHA_NUM), 0)
    if stopwords:
        terms = F.filter(terms, lambda x: ~x.isin(list(stopwords)))
    return terms
