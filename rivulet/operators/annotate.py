"""Token annotation grouping (X7d): consecutive tokens with the same tag form
one entity; the non-entity tag is skipped.  Tokens and tags lie in one row, so
the groups are found in that row, without a shuffle: borders of runs and their
texts by array operations over many rows of an Arrow batch at once, in slices of
bounded size.
Tags come from an external annotator column (the reference never populates
them itself)."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.batches import SLICE_ITEMS, sizes, slices


def _runs(tokens: pa.Array, tags: pa.Array, outside: str) -> pa.Array:
    """Lists of (tag, text); a null list of tokens or tags gives a null one."""
    n_tags = tags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_tokens = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(n_tags) - n_tags
    kinds = tags.flatten().dictionary_encode()
    kind = np.array(kinds.indices.fill_null(-1), np.int64)
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] < 0)
    new[first[n_tags > 0]] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(kind)] if len(start) else start
    dropped = kinds.dictionary.to_pylist().index(outside) if outside in kinds.dictionary.to_pylist() else -2
    kept = (kind[start] >= 0) & (kind[start] != dropped) if len(start) else np.zeros(0, bool)
    start, end = start[kept], end[kept]
    row = np.searchsorted(np.cumsum(n_tags), start, side="right")
    # places among the tokens, which can be fewer than the tags
    base = (np.cumsum(n_tokens) - n_tokens)[row]
    low, high = (np.minimum(x - first[row], n_tokens[row]) + base for x in (start, end))
    words = tokens.flatten()
    take = np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange((high - low).sum())
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(high - low)], pa.int32()), words.take(pa.array(take)).fill_null(""))
    text = pc.binary_join(lists, " ")
    out = pa.StructArray.from_arrays([kinds.dictionary.take(pa.array(kind[start])), text], names=["tag", "text"])
    sizes = np.bincount(row, minlength=len(tags))
    offsets = np.r_[0, np.cumsum(sizes)]
    empty = np.array(tags.is_null()) | np.array(tokens.is_null())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out, mask=pa.array(empty))


def tag_runs(tokens: Column, tags: Column, outside: str = "O") -> Column:
    """Array of ``(tag, text)``, one per run of equal tags; the tokens of a run
    are joined by spaces (a null one is empty).  Outside and null tags are in no
    run; tags beyond the tokens have an empty text."""
    @F.arrow_udf("array<struct<tag:string,text:string>>")
    def runs(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for words, marks in batches:
            for start, n in slices(np.maximum(sizes(words), sizes(marks)), SLICE_ITEMS):
                yield _runs(words.slice(start, n), marks.slice(start, n), outside)

    return runs(tokens, tags)


def entity_groups(df: DataFrame, key, tokens: str = "tokens", tags: str = "tags",
                  outside: str = "O") -> DataFrame:
    """-> ``*key, group_idx, tag, text`` (tokens of a group joined by spaces)."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    runs = tag_runs(F.col(tokens), F.col(tags), outside)
    return (df.select(*keys, F.posexplode(runs).alias("group_idx", "__r"))
            .select(*keys, "group_idx", F.col("__r.tag").alias("tag"), F.col("__r.text").alias("text")))
