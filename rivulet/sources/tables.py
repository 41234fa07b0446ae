"""Loading the driver's Parquet tables and deriving the reference's roles.

Every derived table here is a lazy DataFrame over the *whole* input table:
no id subsets, no caps.  The role mapping is documented in FIXTURES.md §3.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split on newline -> paragraph rows (M4 proxy).

    ``page_id`` = doc_id, ``paragraph_index`` = 0-based line position,
    ``title`` = source, ``section`` = lang.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"),
                    F.col("lang").alias("section"),
                    F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as retrievable passages (``id, title, text``)."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as QA items (M6 proxy).

    question = the whole item text, answers = [the same]; the answer occurs
    verbatim in some documents, so matching has both outcomes.
    """
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"),
                    F.col("text").alias("question"),
                    F.array(F.col("text")).alias("answers"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the assistant's reply to it (``answer``) and the turn
    before it (``said_before``), null where there is none."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.coalesce("text", F.lit(""))
    reply = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), said.alias("answer"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), said.alias("said_before"))
    return c.select("conv_id", "turn", F.col("text").alias("question")) \
        .join(reply, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
