"""Stateless operators on streaming DataFrames.

The reference has no streaming operators (SURVEY §2.12).  Its per-record
stages -- text normalization, paragraph filtering -- are plain DataFrame code
and run unchanged on a ``readStream`` source.
Operators that need a total order or the whole corpus (dense ids, BM25
statistics) stay batch.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions.text import normalize_text


def paragraph_stream(spark: SparkSession, path: str, schema, *, min_len: int = 10,
                     max_len: int = 1000) -> DataFrame:
    """Newline paragraphs of documents arriving as Parquet files, normalized
    and length-filtered (X1, F5) -- stateless, append-only."""
    docs = spark.readStream.schema(schema).parquet(path)
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    p = p.withColumn("text", normalize_text("raw")).drop("raw")
    return p.where(F.length("text").between(min_len, max_len))
