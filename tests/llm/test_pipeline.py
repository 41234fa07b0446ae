"""The pipeline runs whole on a driver table, and each stage on awkward rows."""
import corpus_pipeline
from rivulet.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_chain(spark):
    docs = table(spark, SF, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        assert 0 < docs.count() <= n
        n = docs.count()
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


def test_stages_on_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "plain words"), (3, "plain words"), (4, "x " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars", "1 fp", "2 score")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.store(stage(spark, docs, SF), name)
        if name == "near_duplicates":
            assert docs.count() == 4  # the texts without words are one group, and so are the copies
        if name != "encoding":
            assert docs.columns == columns
    assert docs.count() == 4
