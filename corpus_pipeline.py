"""Training-data pipeline over ``documents``: toxic documents go, one document
of each near-duplicate group stays, documents with benchmark items go, live
credentials are masked, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared checkpoint folder and reads again for the next.
All but the last return the columns of ``documents``.  Stages work on whole
tables; nulls, empty texts, repeated rows and extra columns are handled as the
operators' docstrings say.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from rivulet.llm.common import store
from rivulet.llm.queries import tokenizer_path
from rivulet.session import ship_package
from rivulet.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores under 0.5."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    ship_package(spark)
    return near_dedup.keep_one_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live credentials masked; n_chars stays the source's."""
    ship_package(spark)
    return secrets.redact_live(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    ship_package(spark)
    return bpe.encoded_digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("encoding", encode),
]

#: No SQL says what the network or the encoder does.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
