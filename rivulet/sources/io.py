"""Readers (S1-S13) and writers (K1-K17) with fixed, explicit schemas.

Never schema inference: the reference's ids change type between formats, so
every reader takes a StructType.  Gzip JSON / text is read natively (not
splittable: callers repartition right after reading large gzip files).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.text import json_quote, json_unquote, strip_quotes
from rivulet.sources.json_array import read_records
from rivulet.sources.shards import read_shards, write_shards

CTX = "STRUCT<id: STRING, title: STRING, text: STRING>"

SCHEMAS = {
    "dump_line": "index STRUCT<_id: STRING>, title STRING, version BIGINT, "
                 "template ARRAY<STRING>, incoming_links BIGINT",
    "page_html": "pageid STRING, revid BIGINT, title STRING, url STRING, html STRING",
    "paragraph": "id STRING, page_id STRING, rev_id BIGINT, paragraph_index INT, title STRING, "
                 "section STRING, text STRING",
    "passage": "id BIGINT, title STRING, text STRING",
    "qa": "qid STRING, timestamp STRING, question STRING, answers ARRAY<STRING>",
    "qa_with_documents": f"qid STRING, timestamp STRING, question STRING, answer STRING, "
                         f"documents ARRAY<{CTX}>, positive_document_indices ARRAY<INT>, "
                         f"negative_document_indices ARRAY<INT>",
    "training_sample": f"qid STRING, question STRING, answers ARRAY<STRING>, "
                       f"positive_ctxs ARRAY<{CTX}>, negative_ctxs ARRAY<{CTX}>, "
                       f"hard_negative_ctxs ARRAY<{CTX}>",
    "embedding": "id STRING, vec ARRAY<FLOAT>",
    "retrieval_record": "qid STRING, question STRING, answers ARRAY<STRING>, "
                        "ctxs ARRAY<STRUCT<id: STRING, title: STRING, text: STRING, score: STRING, "
                        "has_answer: BOOLEAN>>",
    "gold_file": "data ARRAY<STRUCT<example_id: STRING, question: STRING, question_tokens: STRING, "
                 "title: STRING, context: STRING>>",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


# ---------------------------------------------------------------- sources
def _records(spark: SparkSession, paths, kind: str, json_array: bool) -> DataFrame:
    """JSON lines, or files that are one JSON array each, which many tasks read."""
    if json_array:
        return read_records(spark, paths, schema(kind)).withColumnRenamed("file", "source").drop("place")
    df = spark.read.schema(schema(kind)).option("mode", "FAILFAST").json(paths)
    return df.withColumn("source", F.input_file_name())


def read_training_files(spark: SparkSession, paths, *, json_array: bool = True) -> DataFrame:
    """S1 + S13 + U1: JSON-array (or JSONL) training files, plain or gzip;
    ``source`` = input file, for up-sampling (U2)."""
    return _records(spark, list(paths) if not isinstance(paths, str) else paths, "training_sample", json_array)


def read_qas(spark: SparkSession, path: str, *, json_array: bool = False) -> DataFrame:
    """Questions from JSON / JSONL; a missing ``answers`` becomes []."""
    df = _records(spark, path, "qa", json_array).drop("source")
    return df.withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))


def read_passages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S3 in its other forms: ``csv`` (header and quotes), ``jsonl`` and ``json``
    (one array of records): ``id, text, title``."""
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").csv(path)
    elif kind in ("json", "jsonl"):
        fields = "id STRING, text STRING, title STRING"
        df = read_records(spark, path, fields) if kind == "json" else spark.read.schema(fields).option("mode", "FAILFAST").json(path)
    else:
        raise ValueError(f"unknown form {kind!r}")
    return df.select("id", "text", "title")


def read_passages_tsv(spark: SparkSession, path: str, *, compat: bool = False) -> DataFrame:
    """S3: passage TSV whose header names ``id``, ``text`` and ``title`` in any
    order; ``text`` is a JSON string literal.  Default decodes it (Q6);
    ``compat=True`` only strips quotes.  A missing column or a line of another
    number of fields raises."""
    df = (spark.read.option("sep", "\t").option("header", True).option("quote", "")
          .option("escape", "").option("mode", "FAILFAST").csv(path))
    decoded = F.when(F.col("text") != "null", F.coalesce(json_unquote("text"), F.col("text")))
    text = strip_quotes("text") if compat else decoded
    return df.select("id", text.alias("text"), "title")


def read_qa_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``question \\t json-list-of-answers`` lines (never ``eval``)."""
    df = spark.read.option("sep", "\t").option("quote", "").schema(
        "question STRING, answers_json STRING").csv(path)
    return df.select("question", F.from_json("answers_json", "array<string>").alias("answers"))


def read_dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """Alternating action / document dump lines.  ``file``, ``split`` (the
    first byte of the piece of the file that a task reads) and ``line_ord``
    (rising within a split, without gaps) give their order."""
    df = spark.read.schema(schema("dump_line")).option("mode", "FAILFAST").json(path)
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("line_ord"))


def read_jsonl(spark: SparkSession, path: str, kind: str, *, json_array: bool = False) -> DataFrame:
    """JSONL (gzip ok) with a named fixed schema;
    ``json_array=True`` reads a file that is one JSON array."""
    return _records(spark, path, kind, json_array).drop("source")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The whole shards of stored embeddings (``id, vec``)."""
    return read_shards(spark, path).select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec"))


def read_gold_file(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a ``{"data": [...]}`` gold-passage file, read by many
    tasks; the last duplicate question wins (A14 by file position)."""
    entry = schema("gold_file")["data"].dataType.elementType
    rows = read_records(spark, path, entry, level=2)
    last = F.max_by(F.struct(*entry.fieldNames()), F.struct("file", "place")).alias("r")
    return rows.groupBy("question").agg(last).select("r.*")


def read_reader_samples(spark: SparkSession, path: str) -> DataFrame:
    """Preprocessed reader samples (Parquet)."""
    return spark.read.parquet(path)


# ---------------------------------------------------------------- sinks
def write_jsonl(df: DataFrame, path: str, *, gzip: bool = True, mode: str = "overwrite") -> None:
    """JSON lines (non-ASCII kept)."""
    w = df.write.mode(mode)
    if gzip:
        w = w.option("compression", "gzip")
    w.json(path)


def write_passages_tsv(df: DataFrame, path: str, *, gzip: bool = True) -> None:
    """K4 + F15: ``id \\t text \\t title`` with a header in each file, the text as
    a JSON string literal; a null id or title is an empty field.  A TAB or a line
    break in a title fails the job (checked in the same pass)."""
    title = F.when(F.col("title").rlike("[\t\r\n]"), F.raise_error(F.lit("TAB or line break in passage title"))).otherwise(F.col("title"))
    w = df.select(F.col("id").cast("string").alias("id"), F.coalesce(json_quote("text"), F.lit("null")).alias("text"),
                  title.cast("string").alias("title")).write.mode("overwrite")
    for k, v in {"sep": "\t", "header": True, "quote": "", "escape": "", "nullValue": "", "emptyValue": "",
                 "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}.items():
        w = w.option(k, v)
    if gzip:
        w = w.option("compression", "gzip")
    w.csv(path)


def write_qa_tsv(df: DataFrame, path: str) -> None:
    """K5: ``question \\t json(answers)``."""
    df.select(F.concat_ws("\t", "question", F.to_json("answers")).alias("value")) \
        .write.mode("overwrite").text(path)


def write_embeddings(df: DataFrame, path: str, model: str, *, num_shards: int = 1, encoder=None) -> list[int]:
    """K7: one folder per model, Parquet ``id, vec`` in shards.  ``encoder`` makes
    ``id, vec`` of a shard's rows (default: they are that); a run that was
    stopped is taken up again, shards that are there are not encoded twice."""
    def made(part: DataFrame) -> DataFrame:
        out = part if encoder is None else encoder(part)
        return out.select(F.col("id").cast("string").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    return write_shards(df, f"{path.rstrip('/')}/{model}", "id", num_shards, made)


def write_acc_tsv(acc: DataFrame, path: str) -> None:
    """K8: the Acc@k table (k rows, bounded by the parameter n) as one TSV."""
    acc.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _split_folders(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values that folders ``column=value`` of ``path`` stand for."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(n[len(column) + 1:]) for n in names if n.startswith(f"{column}=")]


def write_partitioned_results(df: DataFrame, path: str, split_col: str = "split") -> None:
    """One folder per split; a split that is there already is kept, like
    the reference's skip-if-exists loop, and a new one is written beside it.
    Which splits are there is read from the folders' names alone.  The folders
    appear when the whole job is done: one that fails leaves no half split."""
    there = _split_folders(df.sparkSession, path, split_col)
    value = F.coalesce(F.col(split_col).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    new = df.where(~value.isin(there)) if there else df
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split_col).json(path)


def submission(predictions: DataFrame) -> DataFrame:
    """``qid, question, prediction`` from the first threshold."""
    return (predictions.groupBy("qid").agg(F.min_by(F.struct("question", "text"), "top_k").alias("p"))
            .select("qid", F.col("p.question").alias("question"), F.col("p.text").alias("prediction")))


def write_reader_samples(df: DataFrame, path: str, prefix: str = "samples") -> None:
    """Reader samples as Parquet shards (one file per partition); passage
    text is not stored (only ids / offsets / spans), like the reference."""
    keep = [c for c in df.columns if c not in ("text", "passage_text")]
    df.select(*keep).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{prefix}")


def write_metrics(df: DataFrame, path: str, *, append: bool = True) -> None:
    """Per-epoch scores or EM lines, appended run after run."""
    df.write.mode("append" if append else "overwrite").json(path)
