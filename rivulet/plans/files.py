"""What the writers write, read again by the readers: whole driver tables in the
formats of SURVEY §2 (sources and sinks), compared with the tables themselves."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rivulet.functions.text import strip_quotes
from rivulet.plans.registry import register
from rivulet.session import ensure_checkpoint_dir
from rivulet.sources import io, json_array
from rivulet.sources.tables import table


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivulet-{name}-{uuid.uuid4().hex}"


@register("json_array_roundtrip", """
SELECT doc_id, source, md5(text) AS text_md5, n_chars FROM documents
""")
def json_array_roundtrip(spark, sf_dir):
    """K6 + S9: the documents written as JSON arrays, which are read again by
    byte ranges."""
    path = _folder(spark, "arrays")
    json_array.write_array(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars"), path)
    rows = json_array.read_records(spark, path, "doc_id BIGINT, source STRING, text STRING, n_chars BIGINT")
    return rows.select("doc_id", "source", F.md5("text").alias("text_md5"), "n_chars")


@register("passages_tsv_roundtrip", """
SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, nullif(source, '') AS title FROM documents
""")
def passages_tsv_roundtrip(spark, sf_dir):
    """K4 + F15 + X10 + S3: passages as TSV with JSON texts."""
    path = _folder(spark, "passages")
    io.write_passages_tsv(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("title")), path)
    return io.read_passages_tsv(spark, path).select("id", F.md5("text").alias("text_md5"), "title")


@register("qa_tsv_roundtrip", r"""
SELECT md5(regexp_replace(text, '[\t\n\r]', ' ', 'g')) AS question_md5, 2 AS n_answers, md5(text) AS first_md5 FROM benchmark
""")
def qa_tsv_roundtrip(spark, sf_dir):
    """K5 + S4: question and JSON answers by TAB; answers keep every character."""
    path = _folder(spark, "qa")
    io.write_qa_tsv(table(spark, sf_dir, "benchmark").select(
        F.regexp_replace("text", r"[\t\n\r]", " ").alias("question"), F.array("text", F.lit('a "b"')).alias("answers")), path)
    back = io.read_qa_tsv(spark, path)
    return back.select(F.md5("question").alias("question_md5"), F.size("answers").alias("n_answers"), F.md5(F.col("answers")[0]).alias("first_md5"))


@register("training_file_roundtrip", """
SELECT CAST(item_id AS VARCHAR) AS qid, md5(text) AS question_md5, 1 AS n_answers, 1 AS n_positive, 0 AS n_hard, md5(text) AS positive_md5 FROM benchmark
""")
def training_file_roundtrip(spark, sf_dir):
    """K6 + S1 + S13: training samples as JSON arrays."""
    path, ctx = _folder(spark, "training"), "array<struct<id:string,title:string,text:string>>"
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "text")
    json_array.write_array(b.select(
        "qid", F.col("text").alias("question"), F.array("text").alias("answers"),
        F.array(F.struct(F.col("qid").alias("id"), F.lit("item").alias("title"), "text")).cast(ctx).alias("positive_ctxs"),
        F.array().cast(ctx).alias("negative_ctxs"), F.array().cast(ctx).alias("hard_negative_ctxs")), path)
    back = io.read_training_files(spark, path)
    return back.select("qid", F.md5("question").alias("question_md5"), F.size("answers").alias("n_answers"), F.size("positive_ctxs").alias("n_positive"),
                       F.size("hard_negative_ctxs").alias("n_hard"), F.md5(F.col("positive_ctxs")[0]["text"]).alias("positive_md5"))


@register("embedding_shards", """
SELECT CAST(vec_id AS VARCHAR) AS id, CAST(len(embedding) AS INTEGER) AS size, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM embeddings
""")
def embedding_shards(spark, sf_dir):
    """K7 + S8 + D2b + D5: embeddings in five shards, of which two are there
    already when the job is taken up again."""
    path = _folder(spark, "embeddings")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    done = []

    def stopped(part):
        if len(done) == 2:
            raise InterruptedError
        done.append(part)
        return part

    try:
        io.write_embeddings(e, path, "model", num_shards=5, encoder=stopped)
    except InterruptedError:
        io.write_embeddings(e, path, "model", num_shards=5)
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return io.read_embeddings(spark, f"{path}/model").select("id", F.size("vec").alias("size"), F.round(total, 4).alias("total"))


@register("results_by_split", """
SELECT lang AS split, doc_id, n_chars FROM documents
""")
def results_by_split(spark, sf_dir):
    """A folder for each split; splits that are there are kept, as the second
    run, with other values, shows."""
    path = _folder(spark, "results")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("split"), "doc_id", "n_chars")
    io.write_partitioned_results(d.where("split < 'en'"), path)
    io.write_partitioned_results(d.withColumn("n_chars", F.when(F.col("split") < "en", F.lit(-1).cast("long")).otherwise(F.col("n_chars"))), path)
    return spark.read.schema("doc_id BIGINT, n_chars BIGINT, split STRING").json(path).select("split", "doc_id", "n_chars")


@register("reader_samples_roundtrip", """
SELECT doc_id, lang, n_chars FROM documents
""")
def reader_samples_roundtrip(spark, sf_dir):
    """K10 + S12: samples without their passage text."""
    path = _folder(spark, "samples")
    io.write_reader_samples(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), path)
    return io.read_reader_samples(spark, f"{path}/samples").select("doc_id", "lang", "n_chars")


@register("metrics_log", """
WITH m AS (SELECT role, count(*) AS n FROM conversations GROUP BY role)
SELECT 1 AS epoch, role, n FROM m UNION ALL SELECT 2 AS epoch, role, n FROM m
""")
def metrics_log(spark, sf_dir):
    """K8 + K13 + K14: a table of counts as one TSV, and appended run after run."""
    path = _folder(spark, "metrics")
    counts = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    io.write_acc_tsv(counts, f"{path}/acc")
    back = spark.read.option("sep", "\t").option("header", True).schema("role STRING, n BIGINT").csv(f"{path}/acc")
    for epoch in (1, 2):
        io.write_metrics(back.select(F.lit(epoch).alias("epoch"), "role", "n"), f"{path}/log")
    return spark.read.schema("epoch INT, role STRING, n BIGINT").json(f"{path}/log").select("epoch", "role", "n")


@register("page_jsonl_roundtrip", """
SELECT CAST(page_id AS VARCHAR) AS pageid, url, md5(html) AS html_md5 FROM pages
""")
def page_jsonl_roundtrip(spark, sf_dir):
    """K1 + K2 + S6 + S7 + X11: pages as gzip JSON lines with a fixed schema."""
    path = _folder(spark, "pages")
    io.write_jsonl(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("pageid"), "url", "html"), path)
    return io.read_jsonl(spark, path, "page_html").select("pageid", "url", F.md5("html").alias("html_md5"))


@register("qas_roundtrip", """
SELECT CAST(item_id AS VARCHAR) AS qid, md5(text) AS question_md5, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END AS n_answers FROM benchmark
""")
def qas_roundtrip(spark, sf_dir):
    """K3 + S2: questions as JSON lines; half of them have no ``answers``."""
    path = _folder(spark, "qas")
    io.write_jsonl(table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.array("text")).alias("answers")), path)
    return io.read_qas(spark, path).select("qid", F.md5("question").alias("question_md5"), F.size("answers").alias("n_answers"))


@register("gold_file_roundtrip", """
SELECT md5(text) AS question_md5, max(CAST(item_id AS VARCHAR)) AS example_id FROM benchmark GROUP BY text
""")
def gold_file_roundtrip(spark, sf_dir):
    """S10 + A14: gold passages under ``data``, read by byte ranges; each question
    stands there twice, and the last entry wins."""
    path = _folder(spark, "gold")
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("example_id"), F.col("text").alias("question"))
    kept = b.groupBy("question").agg(F.max("example_id").alias("example_id"))
    twice = b.withColumn("ord", F.lit(0)).unionByName(kept.withColumn("ord", F.lit(1))).coalesce(1).sortWithinPartitions("ord")
    json_array.write_array(twice.select("example_id", "question", F.lit("").alias("question_tokens"), F.lit("t").alias("title"),
                                        F.col("question").alias("context")), path, parts=1, key="data")
    return io.read_gold_file(spark, path).select(F.md5("question").alias("question_md5"), "example_id")


@register("quoted_texts", """
SELECT doc_id, md5(regexp_replace(text, '^"+|"+$', '', 'g')) AS text_md5 FROM documents
""")
def quoted_texts(spark, sf_dir):
    """Quotes around a text taken off."""
    quoted = F.concat(F.lit('""'), "text", F.lit('"'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strip_quotes(quoted)).alias("text_md5"))
