"""Sub-word ids (X22, X23, X21): words cut into the longest pieces of a
vocabulary, sequences laid out, cut and padded, and put back to text.

A vocabulary is a table ``token, id`` of bounded size: it is made by a rule from
``size`` words at most and is sent to every task, so tokens never cross the
network.  A word is looked up once in each slice of an Arrow batch, however often
it stands there, and its pieces are kept in a bounded cache.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.batches import cut

# Special tokens by their ids, and the mark of a continuation.
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS, SEP = range(4)
MARK = "##"
#: Most tokens of a vocabulary that is sent to tasks, and words of a worker's cache.
MAX_PIECES, CACHE = 1 << 20, 1 << 18


def build_pieces(token_arrays: DataFrame, size: int = 30_000, tokens: str = "tokens") -> DataFrame:
    """``token, id``: special tokens, then the ``size`` words in most rows (ties:
    the smaller word) and their characters in order, then all these again as
    continuations.  Nothing is fitted: rare words are made of what there is."""
    if not 0 < size <= MAX_PIECES // 4:
        raise ValueError(f"size must be from 1 to {MAX_PIECES // 4}")
    df = (token_arrays.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")))
    words = [r["token"] for r in df.orderBy(F.desc("df"), "token").limit(size).collect()]  # bounded by size
    plain = sorted({*words, *(c for w in words for c in w)}, key=str.encode)
    rows = [*SPECIALS, *plain, *(MARK + w for w in plain)]
    return token_arrays.sparkSession.createDataFrame(list(zip(rows, range(len(rows)))), "token string, id int")


def vocabulary(vocab: DataFrame) -> dict[str, int]:
    """The table as a dictionary, if it is within the bound."""
    rows = vocab.select("token", F.col("id").cast("int").alias("id")).limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"a vocabulary holds {MAX_PIECES} tokens at most")
    return {r["token"]: r["id"] for r in rows}


class WordPieces:
    """Longest match first: a trie of pieces is walked from each place, and the
    last piece that ended on the way is taken."""

    def __init__(self, ids: dict[str, int]):
        self.first, self.next = {}, {}
        for token, i in ids.items():
            if token not in SPECIALS:
                node, letters = (self.next, token[len(MARK):]) if token.startswith(MARK) and len(token) > len(MARK) else (self.first, token)
                for c in letters:
                    node = node.setdefault(c, {})
                node[None] = i
        self.of = lru_cache(maxsize=CACHE)(self._of)

    def _of(self, word: str) -> tuple[int, ...]:
        out, at, node = [], 0, self.first
        while at < len(word):
            found, end, i = None, at, at
            while i < len(word) and word[i] in node:
                node = node[word[i]]
                i += 1
                if None in node:
                    found, end = node[None], i
            if found is None:
                return (UNK,)  # no way on: the word as a whole is unknown
            out.append(found)
            at, node = end, self.next
        return tuple(out)


_PIECES: dict[int, WordPieces] = {}


def _pieces(key: int, ids: dict[str, int]) -> WordPieces:
    """One of a vocabulary in each worker."""
    if key not in _PIECES:
        _PIECES.clear()
        _PIECES[key] = WordPieces(ids)
    return _PIECES[key]


def _shares(title: np.ndarray, text: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ids of each stay: one by one they go from the longer part, from
    the text where both are as long, until ``room`` is kept."""
    both = title + text
    over = np.maximum(both - room, 0)
    longer = np.abs(title - text)
    alone = np.minimum(over, longer)  # taken from the longer part until both are as long
    rest = over - alone
    from_title = np.where(title > text, alone, 0) + rest // 2
    return np.maximum(title - from_title, 0), np.maximum(text - (over - from_title), 0)


def encode_pieces(df: DataFrame, tokens: str, vocab: DataFrame, *, out: str = "ids", title_tokens: str | None = None,
                  max_length: int | None = None, pad: bool = False, add_special_tokens: bool = True) -> DataFrame:
    """``df`` with the ids ``[CLS] title [SEP] text [SEP]`` (or ``[CLS] text
    [SEP]``) of arrays of words; a null array is empty, and an empty title counts
    as none.  ``max_length`` cuts the longer part first; ``pad`` fills up to it."""
    if pad and max_length is None:
        raise ValueError("pad needs max_length")
    ids = vocabulary(vocab)
    shared, key = df.sparkSession.sparkContext.broadcast(ids), hash(frozenset(ids.items()))
    names = [tokens] + ([title_tokens] if title_tokens else [])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def encoded(column: pa.Array, pieces: WordPieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and how many each row has."""
        words = column.flatten().fill_null("").dictionary_encode()
        rows = [pieces.of(w) for w in words.dictionary.to_pylist()]
        n = np.array([len(r) for r in rows], np.int64)
        flat = np.array([i for r in rows for i in r], np.int32)
        at = words.indices.to_numpy(zero_copy_only=False) if len(words) else np.zeros(0, np.int64)
        m = n[at] if len(n) else np.zeros(0, np.int64)
        take = np.repeat((np.cumsum(n) - n)[at] - (np.cumsum(m) - m), m) + np.arange(m.sum()) if len(n) else np.zeros(0, np.int64)
        lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        ends = np.r_[0, np.cumsum(m)][np.cumsum(lengths)]
        return flat[take], np.diff(ends, prepend=0)

    def run(batches):
        pieces = _pieces(key, shared.value)
        for b in cut(batches, names):
            parts = [encoded(b.column(b.schema.get_field_index(c)), pieces) for c in names]
            text, n_text = parts[0]
            title, n_title = parts[1] if title_tokens else (np.zeros(0, np.int32), np.zeros(b.num_rows, np.int64))
            pair = n_title > 0
            special = np.where(pair, 3, 2) if add_special_tokens else np.zeros(b.num_rows, np.int64)
            keep_title, keep_text = n_title, n_text
            if max_length is not None:
                keep_title, keep_text = _shares(n_title, n_text, np.maximum(max_length - special, 0))
            rows, at_title, at_text = [], np.cumsum(n_title) - n_title, np.cumsum(n_text) - n_text
            for i in range(b.num_rows):
                a, t = title[at_title[i]:at_title[i] + keep_title[i]], text[at_text[i]:at_text[i] + keep_text[i]]
                row = np.concatenate([[CLS], *([a, [SEP]] if pair[i] else []), t, [SEP]] if add_special_tokens else [a, t]).astype(np.int32)
                rows.append(np.pad(row, (0, max_length - len(row)), constant_values=PAD) if pad and len(row) < max_length else row)
            sizes = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, ids: str, vocab: DataFrame, *, out: str = "text", skip_special_tokens: bool = True) -> DataFrame:
    """``df`` with the text of ids: words by spaces, continuations joined to
    what is before them.  An id that is not in the vocabulary gives nothing;
    null ids give a null text."""
    known = vocabulary(vocab)
    kept = {i: t for t, i in known.items() if not (skip_special_tokens and t in SPECIALS)}
    shared = df.sparkSession.sparkContext.broadcast(kept)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        written = shared.value
        for b in cut(batches, [ids]):
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            texts = [None if r is None else " ".join([written[i] for i in r if i in written]).replace(f" {MARK}", "") for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)
