"""Cases that earlier versions got wrong."""
import numpy as np
import pytest

from pyspark.sql import functions as F
from rivulet.functions.html import extract
from rivulet.operators import knn, match, quality, reader, records, training, vector_index
from rivulet.sources import io


def test_upsample_raises_for_a_source_without_rate(spark):
    df = spark.createDataFrame([("A", 1), ("B", 2)], "source string, x int")
    with pytest.raises(Exception, match="no rate for source"):
        training.upsample(df, {"A": 2}).collect()
    assert training.upsample(df, {"A": 2, "B": 0}).count() == 2


def test_enforce_raises(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    with pytest.raises(Exception, match="data-quality check failed"):
        quality.enforce(df, {"negative": F.col("x") < 0}).collect()
    assert quality.enforce(df, {"huge": F.col("x") > 9}).first().bad_huge == 0


def test_last_gold_question_wins(spark):
    gold = spark.createDataFrame([(0, "A b", "a b"), (1, "a  b", "a b")], "ord int, question string, question_tokens string")
    asked = spark.createDataFrame([(1, "a b")], "qid int, question string")
    assert records.canonical_questions(asked, gold).first().question == "a  b"


def test_passage_header_in_any_order(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("id\ttitle\ttext\n1\tT\t\"body\"\n")
    row = io.read_passages_tsv(spark, str(tmp_path / "p.tsv")).first()
    assert (row.id, row.title, row.text) == ("1", "T", "body")
    (tmp_path / "bad.tsv").write_text("id\ttitle\ttext\n1\tT\n")
    with pytest.raises(Exception):
        io.read_passages_tsv(spark, str(tmp_path / "bad.tsv")).collect()


def test_corrupt_line_raises(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"qid": "1", "question": "x"}\n{"qid": \n')
    with pytest.raises(Exception):
        io.read_qas(spark, str(tmp_path / "q.json")).collect()


def test_new_split_is_written_beside_an_old_one(spark, tmp_path):
    df = spark.createDataFrame([("dev", 1)], "split string, x int")
    io.write_partitioned_results(df, str(tmp_path / "out"))
    io.write_partitioned_results(df.union(spark.createDataFrame([("test", 2)], df.schema)), str(tmp_path / "out"))
    assert sorted((r.split, r.x) for r in spark.read.json(str(tmp_path / "out")).collect()) == [("dev", 1), ("test", 2)]


def test_a_job_that_fails_leaves_no_half_split(spark, tmp_path):
    df = spark.range(100).selectExpr("if(id % 2 = 0, 'a b/c', 'dev') split", "id x")
    bad = df.selectExpr("split", "if(x = 77, raise_error('no'), x) x").repartition(4)
    with pytest.raises(Exception, match="no"):
        io.write_partitioned_results(bad, str(tmp_path / "out"))
    assert io._split_folders(spark, str(tmp_path / "out"), "split") == []
    io.write_partitioned_results(df.where("split <> 'dev'"), str(tmp_path / "out"))
    io.write_partitioned_results(df.withColumn("x", F.lit(-1).cast("long")), str(tmp_path / "out"))
    rows = spark.read.json(str(tmp_path / "out"))
    assert rows.where("split = 'a b/c' and x >= 0").count() == 50 == rows.where("split = 'dev' and x = -1").count()


def test_pages_that_cannot_be_parsed_are_told(spark, monkeypatch):
    from rivulet.functions import html
    from rivulet.operators import corpus

    pages = spark.createDataFrame([(1, 1, "T", "<section><p>a paragraph long enough</p></section>"), (2, 1, "U", "x" * 10), (3, 1, None, None)],
                                  "pageid long, revid long, title string, html string")
    assert corpus.unreadable_pages(pages).collect() == [] and corpus.extract_paragraphs(pages).count() == 1
    monkeypatch.setattr(html._Walker, "feed", lambda self, text: 1 / 0)
    rows = list(corpus._walk_pages("section")([__import__("pyarrow").RecordBatch.from_pydict(
        {"page_key": [5], "rev_id": [6], "meta_title": ["t"], "html": ["<p>"]})]))[0].to_pylist()
    assert rows[0]["error"].startswith("ZeroDivisionError") and rows[0]["paras"] == []


def test_articles_beside_combining_marks_stay(spark):
    from rivulet.functions.text import normalize_answer

    texts = ["a\u0301 b", "the a\u0301", "a b", "\u0301a c"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_answer("t")).collect()]
    assert got == ["a\u0301b", "a\u0301", "b", "\u0301ac"]


def test_regex_answers_know_scripts_and_bad_patterns():
    import pandas as pd

    got = match._regex_any_series(pd.Series(["\u4e2d\u6587", "abc", None, "x\nABC"]),
                                  pd.Series([[r"\p{Han}+"], ["[", None], ["a"], ["^abc$"]]))
    assert got.tolist() == [True, False, False, True]


def test_unclosed_markup_ends_with_its_block():
    _, out = extract("<section><p>a<sup>1<p>second</p></section><section><table><p>x</p></section><section><p>last</p></section>")
    assert [t for *_, t in out] == ["a", "second", "last"]


def test_empty_prediction_of_a_question_without_spans(spark):
    spans = spark.createDataFrame([], "qid long, passage_idx int, span_rank int, s int, e int, score double, relevance double")
    asked = spark.createDataFrame([(7,)], "qid long")
    row = reader.best_prediction(spans, thresholds=(1,), questions=asked).first()
    assert (row.qid, row.passage_idx, row.s, row.e) == (7, -1, -1, -1)


def test_vector_search_with_string_ids_and_many_blocks(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 4)).round(1)
    m[50:60] = m[50]
    df = spark.createDataFrame([(f"D{i:03d}-x", v.tolist()) for i, v in enumerate(m)], "id string, vec array<double>")
    monkeypatch.setattr(knn, "CHUNK_ROWS", 16)
    out = knn.knn(df, df, 3, qid="id", did="id", exclude_self=True, max_broadcast_bytes=960)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(int(r.qid[1:4]), []).append(int(r.doc_id[1:4]))
    for q in range(120):
        best = s[q, got[q]]
        assert len(got[q]) == 3 and np.allclose(best, np.sort(s[q])[::-1][:3])
    full = vector_index.knn_ivf(df, df, 3, path=str(tmp_path), n_cells=4, nprobe=4, qid="id", did="id", exclude_self=True)
    assert full.select("qid", "doc_id").exceptAll(out.select("qid", "doc_id")).count() == 0


def test_vectors_that_cannot_be_searched_raise(spark):
    good = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, vec array<double>").withColumn("qid", F.col("doc_id"))
    for bad in ([1.0], None, [float("nan"), 1.0]):
        corpus = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "doc_id long, vec array<double>")
        with pytest.raises(ValueError):
            knn.knn(good, corpus, 1)


def test_absent_gold_has_a_null_rank(spark):
    q = spark.createDataFrame([(1, [1.0], 3), (2, [1.0], 99)], "qid long, vec array<double>, gold_id long")
    c = spark.createDataFrame([(1, [5.0]), (2, [7.0]), (3, [7.0])], "doc_id long, vec array<double>")
    assert {r.qid: r.gold_rank for r in knn.gold_rank(q, c).collect()} == {1: 1, 2: None}
