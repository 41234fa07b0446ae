"""Batch encoding of passages / questions (E1, E2, E3, E5) and vocabulary
ids for token sequences (X22, X23).

Encoders are pluggable: a registry maps a name to a factory; the factory is
called once per Python worker (iterator pandas UDF), then every Arrow batch
is encoded in one vectorized call -- the Spark form of the reference's
batched GPU inference.  The built-in default, ``hashed_bow``, is a
deterministic hashed bag of terms, L2-normalized (no model files needed).
"""
from __future__ import annotations

import hashlib
from functools import lru_cache
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.text import analyze

EncoderFactory = Callable[..., Callable[[pd.Series], np.ndarray]]
_REGISTRY: dict[str, EncoderFactory] = {}


def register_encoder(name: str):
    """Add an encoder factory to the registry."""
    def deco(factory: EncoderFactory) -> EncoderFactory:
        _REGISTRY[name] = factory
        return factory
    return deco


def get_encoder(name: str, **kwargs):
    if name not in _REGISTRY:
        raise KeyError(f"unknown encoder {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name](**kwargs)


@register_encoder("hashed_bow")
def hashed_bow(dim: int = 64):
    """Terms -> md5 bucket (first 32 bits mod dim) counts -> L2-normalized."""
    @lru_cache(maxsize=1 << 18)
    def bucket(t: str) -> int:
        return int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % dim

    def encode(terms: pd.Series) -> np.ndarray:
        # vectorized: flatten the batch, hash each distinct term once,
        # scatter-add counts, L2-normalize rows
        out = np.zeros((len(terms), dim), dtype=np.float64)
        lens = np.fromiter((0 if t is None else len(t) for t in terms), dtype=np.int64, count=len(terms))
        if lens.sum() > 0:
            flat = np.concatenate([np.asarray(t, dtype=object) for t in terms if t is not None and len(t)])
            inv, uniq = pd.factorize(flat)   # hash-based, distinct terms once
            buckets = np.fromiter((bucket(u) for u in uniq), dtype=np.int64, count=len(uniq))
            rows = np.repeat(np.arange(len(terms)), lens)
            np.add.at(out, (rows, buckets[inv]), 1.0)
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        n[n == 0] = 1.0
        return out / n

    return encode


def encode(df: DataFrame, text: str, *, title: str | None = None, encoder: str = "hashed_bow",
           out: str = "vec", dtype: str = "float", analyzer=analyze, **encoder_kwargs) -> DataFrame:
    """Add an embedding column computed from ``title`` (optional,
    inserted before the text) and ``text``.  Arrow batches are the encoding
    batches (``spark.sql.execution.arrow.maxRecordsPerBatch`` plays the
    reference's batch size / index buffer, E5); rows keep their ids, so no id
    map and no count assertion are needed."""
    elem = T.FloatType() if dtype == "float" else T.DoubleType()
    np_dtype = np.float32 if dtype == "float" else np.float64
    if encoder not in _REGISTRY:
        raise KeyError(f"unknown encoder {encoder!r}; known: {sorted(_REGISTRY)}")
    # resolve the factory on the driver: it travels in the UDF closure, so
    # encoders registered by user code exist on the workers too
    factory = _REGISTRY[encoder]

    @F.pandas_udf(T.ArrayType(elem))
    def _enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory(**encoder_kwargs)  # once per worker
        for terms in it:
            m = fn(terms).astype(np_dtype)
            yield pd.Series(list(m))

    terms = analyzer(F.col(text))
    if title is not None:
        terms = F.concat(analyzer(F.col(title)), terms)
    return df.withColumn(out, _enc(terms))
