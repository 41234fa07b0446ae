"""Token-array helpers (X7c, X7e, X21): Column -> Column, built-ins only."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.batches import SLICE_TEXT, sizes, slices
from rivulet.functions.text import TOKEN_PATTERN


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slice_tokens(tokens, i: int | None = None, j: int | None = None) -> Column:
    """X7c ``slice(i, j)``: tokens [i, j) with Python slice semantics for
    non-negative bounds."""
    t = _c(tokens)
    start = 0 if i is None else i
    end = F.size(t) if j is None else F.least(F.lit(j), F.size(t))
    return F.slice(t, start + 1, F.greatest(end - start, F.lit(0)))


def annotation(df: DataFrame, tokens: str, field: str) -> Column:
    """X7e ``pos()`` / ``lemmas()`` / ``entities()``: a field of every token
    struct of ``df``'s column; null when the struct does not have that field."""
    token = df.schema[tokens].dataType.elementType
    if field not in token.fieldNames():
        return F.lit(None).cast("array<string>")
    return F.transform(F.col(tokens), lambda x: x[field])


def is_subword(tok: Column) -> Column:
    return tok.startswith("##") | tok.startswith(" ##")


def extend_span_to_words(tokens, s, e) -> Column:
    """Move the start left while it sits on a ``##`` sub-word and the end
    right while the next token is a sub-word.  Returns struct(s, e)."""
    def body(t, s, e):
        starts = F.filter(F.sequence(F.lit(0), s), lambda i: ~is_subword(F.element_at(t, i + 1)))
        new_s = F.coalesce(F.array_max(starts), F.lit(0))
        ends = F.filter(F.sequence(e + 1, F.greatest(F.size(t), e + 1)),
                        lambda i: (i >= F.size(t)) | ~is_subword(F.element_at(t, F.least(i + 1, F.size(t)))))
        new_e = F.coalesce(F.array_min(ends), F.size(t)) - 1
        return F.struct(new_s.cast("int").alias("s"), F.greatest(new_e, e).cast("int").alias("e"))
    from rivulet.functions.bind import let
    return let(body, _c(tokens), _c(s), _c(e))


TOKEN = "array<struct<text:string,start:int,end:int,after:string>>"


def _tokens_of(texts: pa.Array) -> pa.Array:
    """Lists of (text, start, end, after).  From the first token on a text is
    made of tokens and what follows each, so places are running sums of lengths."""
    found, parts, leading, counts = regex.compile(f"({TOKEN_PATTERN})([\\p{{Z}}\\p{{C}}]*)").findall, [], [], []
    for text in texts.to_pylist():
        pairs = found(text or "")
        parts += pairs
        counts.append(len(pairs))
        leading.append(len(text or "") - sum(len(t) + len(a) for t, a in pairs))
    words, after = pa.array([t for t, _ in parts], pa.string()), pa.array([a for _, a in parts], pa.string())
    n_word, n_after = (pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, after))
    n, step = np.array(counts, np.int64), np.r_[0, np.cumsum(n_word + n_after)]
    offsets = np.r_[0, np.cumsum(n)]
    start = step[:-1] - np.repeat(step[offsets[:-1]] - np.array(leading, np.int64), n)
    rows = pa.StructArray.from_arrays([words, pa.array(start, pa.int32()), pa.array(start + n_word, pa.int32()), after],
                                      names=["text", "start", "end", "after"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows, mask=texts.is_null())


def _tokens_by_slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for start, n in slices(sizes(texts), SLICE_TEXT):
            yield _tokens_of(texts.slice(start, n))


def tokens_with_offsets(col) -> Column:
    """Every token with its place in the text (code points, end exclusive)
    and what stands between it and the next one.  Spark's patterns do not tell
    where they match, so this is a small helper over Arrow batches, which it
    takes in slices of bounded text."""
    return F.arrow_udf(_tokens_by_slices, TOKEN)(_c(col))


def token_offsets(tokens) -> Column:
    """X7c ``offsets()``: [start, end) of every token."""
    return F.transform(_c(tokens), lambda t: F.array(t["start"], t["end"]))


def untokenize(tokens) -> Column:
    """X7c ``untokenize()``: the text from the first token to the last, as it was
    written, without white space after it."""
    t = _c(tokens)
    return F.regexp_replace(F.array_join(F.transform(t, lambda x: F.concat(x["text"], x["after"])), ""), r"[\s\p{Z}\p{C}]+\z", "")
