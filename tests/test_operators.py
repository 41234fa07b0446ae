"""Operator semantics on hand-made rows (FIXTURES.md §2) and invariants."""
import math

import numpy as np
from pyspark.sql import functions as F

from rivulet.functions.html import extract
from rivulet.operators import corpus, evaluate, knn, match, reader, training, vector_index
from rivulet.sources import io
from rivulet.operators.order import add_dense_id, running_sum


def test_html_sections_titles_tables_sup():
    html = ("<html><body><section><p>lead para</p></section>"
            "<section><h2>A</h2><table><p>x</p></table><p>a<sup>1</sup>b</p></section>"
            "<section><p>third<p>fourth</section></body></html>")
    _, rows = extract(html, "section")
    assert [(r[1], r[3]) for r in rows] == [(None, "lead para"), ("A", "ab"), (None, "third"),
                                           (None, "fourth")]
    assert extract("<article><p>long enough text</p></article>", "section")[1] == []


def test_extract_paragraphs_carry_and_index(spark):
    html = ("<section><p>short</p></section><section><h2>A</h2><p>twenty characters ok!</p></section>"
            "<section><p>thirty characters long text ok</p></section>")
    pages = spark.createDataFrame([(7, 3, "T", html)], "pageid long, revid long, title string, html string")
    rows = corpus.extract_paragraphs(pages, min_len=10).orderBy("paragraph_index").collect()
    assert [(r.section, r.paragraph_index, r.id) for r in rows] == [("A", 0, "7-3-0"), ("A", 1, "7-3-1")]


def test_passages_default_and_compat(spark):
    p = spark.createDataFrame([(1, 0, "P1", "__LEAD__", "t1"), (2, 0, "P2", "__LEAD__", "t2"),
                               (2, 1, "P2", "S", "t3")],
                              "page_ord long, paragraph_index int, title string, section string, text string")
    d = [tuple(r) for r in corpus.make_passages(p).orderBy("id").collect()]
    c = [tuple(r) for r in corpus.make_passages(p, compat=True).orderBy("id").collect()]
    assert d == [(1, "P1", "t1"), (2, "P2", "t2"), (3, "P2", "t3")]
    assert c == [(1, "P2", "t1"), (2, "P2", "t2"), (3, "P2", "t3")]


def test_compat_overlong_row_sets_title(spark):
    p = spark.createDataFrame([(1, 0, "P1", "L", "short"), (2, 0, "P2", "L", "x" * 401)],
                              "page_ord long, paragraph_index int, title string, section string, text string")
    assert [tuple(r) for r in corpus.make_passages(p, max_len=400, compat=True).collect()] == [(1, "P2", "short")]


def test_dense_id_partition_invariance(spark):
    df = spark.range(0, 3000).withColumn("k", (F.col("id") * 7919) % 3000).drop("id")
    for n in (1, 3, 16):
        out = add_dense_id(df.repartition(n), "k", name="pos", start=0, num_partitions=n)
        assert out.where(F.col("pos") != F.col("k")).count() == 0
    rs = running_sum(df, "k", "k", name="cs", num_partitions=5).where(F.col("k") == 2999).first()
    assert rs.cs == 2999 * 3000 // 2


def test_dump_pairing(spark):
    rows = [("f", 0, 0, {"_id": "7"}, None), ("f", 0, 1, None, "t"), ("f", 0, 2, {"_id": "8"}, None), ("f", 90, 500, None, "u"),
            ("g", 0, 3, None, "no action before"), ("g", 0, 4, {"_id": "9"}, None)]
    lines = spark.createDataFrame(rows, "file string, split long, line_ord long, index struct<_id:string>, title string")
    assert sorted((r.title, r.pageid) for r in corpus.pair_dump_lines(lines).collect()) == [("no action before", None), ("t", "7"), ("u", "8")]


def test_dump_pairing_over_many_splits(spark, tmp_path):
    """4,000 documents in files that are read in a dozen pieces: no id is lost."""
    import json
    for f in range(2):
        with open(f"{tmp_path}/dump{f}.json", "w") as out:
            for i in range(f * 2000, f * 2000 + 2000):
                out.write(json.dumps({"index": {"_id": str(i)}}) + "\n" + json.dumps({"title": f"t{i}", "version": i}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        lines = io.read_dump_lines(spark, str(tmp_path))
        assert lines.select("file", "split").distinct().count() >= 12
        got = corpus.pair_dump_lines(lines).select("pageid", "title", "version").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.pageid, r.title, r.version) for r in got) == sorted((str(i), f"t{i}", i) for i in range(4000))


def test_matchers(spark):
    hits = spark.createDataFrame([(1, 1, 10), (2, 1, 10), (3, 1, 11)], "qid long, rank int, doc_id long")
    ps = spark.createDataFrame([(10, "concat it"), (11, None)], "id long, text string")
    qs = spark.createDataFrame([(1, ["cat"]), (2, []), (3, ["x"])], "qid long, answers array<string>")
    got = lambda **kw: {r.qid: r.has_answer for r in match.has_answer(hits, ps, qs, **kw).collect()}  # noqa
    assert got(match_type="string") == {1: True, 2: False, 3: False}
    assert got(match_type="string", boundary=True) == {1: False, 2: False, 3: False}
    assert got(match_type="raw") == {1: True, 2: False, 3: False}


def test_acc_at_k(spark):
    hits = spark.createDataFrame([(1, 1, True), (2, 1, False), (2, 2, False), (2, 3, True), (3, 1, False)],
                                 "qid long, rank int, has_answer boolean")
    rows = [tuple(r) for r in evaluate.acc_at_k(hits, 3).orderBy("top_k").collect()]
    assert rows == [(1, 1, 0.3333), (2, 1, 0.3333), (3, 2, 0.6667)]


def test_gold_rank_and_nll(spark):
    q = spark.createDataFrame([(1, [1.0], 3)], "qid long, vec array<float>, gold_id long")
    c = spark.createDataFrame([(1, [5.0]), (2, [9.0]), (3, [7.0])], "doc_id long, vec array<float>")
    assert knn.gold_rank(q, c).first().gold_rank == 1
    qs = spark.createDataFrame([(0, 0, [1.0], 0)], "batch_id long, q_pos int, qvec array<double>, gold_pos int")
    cs = spark.createDataFrame([(0, 0, [math.log(3)]), (0, 1, [0.0])], "batch_id long, ctx_pos int, cvec array<double>")
    r = evaluate.inbatch_nll(qs, cs).first()
    assert abs(r.loss - math.log(4 / 3)) < 1e-9 and r.correct


def test_knn_exact_and_ivf_full_probe(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    kw = dict(qid="id", did="id", exclude_self=True)
    exact = knn.knn(df, df.repartition(5), 5, **kw)
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(np.float64)
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    for r in exact.where("qid = 17").collect():
        assert r.doc_id == int(np.argsort(-s[17], kind="stable")[r.rank - 1])
    small_bc = knn.knn(df, df, 5, max_broadcast_bytes=4096, **kw)   # forces many query waves
    assert exact.exceptAll(small_bc).count() == 0
    ivf = vector_index.knn_ivf(df, df, 5, path=str(tmp_path), n_cells=4, nprobe=4, **kw)
    assert exact.select("qid", "doc_id").exceptAll(ivf.select("qid", "doc_id")).count() == 0


def test_reader_helpers(spark):
    df = spark.createDataFrame([([1, 2, 1, 2, 1], [1, 2, 1])], "c array<int>, a array<int>")
    spans = df.select(reader.answer_positions(F.col("c"), F.col("a")).alias("s")).first().s
    assert [(x.s, x.e) for x in spans] == [(0, 2), (2, 4)]
    lim = lambda p: min(max(10 * p, 50), 150)  # noqa: E731  T5 formula
    assert [lim(1), lim(8), lim(20)] == [50, 80, 150]


def test_nested_span_suppression():
    """Against the plain greedy loop, spans moved out to whole words."""
    rng = np.random.default_rng(3)
    for _ in range(60):
        p, n, length = int(rng.integers(1, 5)), int(rng.integers(0, 12)), int(rng.integers(1, 6))
        st, en = rng.integers(0, 5, (p, n)).astype(float), rng.integers(0, 5, (p, n)).astype(float)
        sub = rng.random((p, n)) < 0.3
        want = []
        for q in range(p):
            chosen = []
            for neg, i, j in sorted((-(st[q, i] + en[q, j]), i, j) for i in range(n) for j in range(i, min(n, i + length))):
                if len(chosen) < 3 and not any((i <= a and b <= j) or (a <= i and j <= b) for a, b, _ in chosen):
                    while i > 0 and sub[q, i]:
                        i -= 1
                    while j + 1 < n and sub[q, j + 1]:
                        j += 1
                    chosen.append((i, j, -neg))
            want += [(q, r + 1, *c) for r, c in enumerate(chosen)]
        got = sorted(zip(*(x.tolist() for x in reader.top_spans_of(st, en, length, 3, sub))))
        assert got == want


def test_decode_spans_of_passages_of_any_length(spark):
    rows = [(1, 0, [1.0, 5.0, 0.0], [0.0, 1.0, 4.0], ["a", "b", "##c"]), (1, 1, [], [], []), (1, 2, None, None, None),
            (2, 0, [3.0], [1.0], ["x"]), (2, 1, [0.0, 9.0, 0.0], [0.0, 9.0, 0.0], ["##q", "##r", "##s"])]
    df = spark.createDataFrame(rows, "qid long, passage_idx int, start_logits array<double>, end_logits array<double>, toks array<string>").repartition(2)
    got = sorted(map(tuple, reader.decode_spans(df, max_answer_length=2, top_spans=2, tokens="toks").collect()))
    assert got == [(1, 0, 1, 1, 2, 9.0), (1, 0, 2, 0, 2, 2.0), (2, 0, 1, 0, 0, 4.0), (2, 1, 1, 0, 2, 18.0)]
    assert [r.e for r in reader.decode_spans(df.where("qid = 1"), max_answer_length=2, top_spans=1).collect()] == [2]


def test_empty_decode(spark):
    sp = spark.createDataFrame([(1, 5, 1, 0, 0, 1.0, 0.5)],
                               "qid long, passage_idx int, span_rank int, s int, e int, score double, relevance double")
    r = reader.best_prediction(sp, thresholds=(1,)).first()
    assert (r.passage_idx, r.s, r.e) == (-1, -1, -1)


def test_shards_and_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    floor = training.assign_shards(df, 10, 3, how="floor")
    assert [r[1] for r in floor.groupBy("shard_id").count().orderBy("shard_id").collect()] == [3, 3, 4]
    ceil = training.assign_shards(df, 10, 3, how="ceil")
    assert [r[1] for r in ceil.groupBy("shard_id").count().orderBy("shard_id").collect()] == [4, 4, 2]
    five = spark.createDataFrame([(0, i, c) for i, c in enumerate("abcde")], "shard_id int, pos_in_shard long, v string")
    b = training.assign_batches(training.fill_last_batch(five, 2), 2)
    got = sorted((r.batch_id, r.sample_pos, r.v) for r in b.collect())
    assert [g[2] for g in got] == list("abcdea")


def test_inbatch_negatives(spark):
    ctx = lambda i: {"id": i, "title": i, "text": i}
    df = spark.createDataFrame([(0, 0, [ctx("a1"), ctx("a2")]), (0, 1, [ctx("b1")])],
                               "batch_id long, sample_pos int, positive_ctxs array<struct<id:string,title:string,text:string>>")
    out = {r.sample_pos: [c.id for c in r.negative_ctxs] for r in training.inbatch_negatives(df).collect()}
    assert out == {0: ["b1"], 1: ["a1", "a2"]}


def test_dedup_last_wins(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "id long, ord long, v string")
    assert [r.v for r in training.dedup_last_wins(df, "id", "ord").collect()] == ["y"]


def test_mips_transform(spark):
    from rivulet.functions.vector import mips_augment_doc
    df = spark.createDataFrame([([3.0, 4.0],), ([1.0, 0.0],)], "v array<double>")
    phi = knn.max_norm2(df, "v")
    assert phi == 25.0
    got = [r[0] for r in df.select(mips_augment_doc(F.col("v"), F.lit(phi))).collect()]
    assert got[0] == [3.0, 4.0, 0.0] and abs(got[1][2] - math.sqrt(24)) < 1e-12


def test_dense_id_hot_leading_key(spark):
    """60% of rows share one leading value: ids stay in exact (lead, token)
    order while the hot value is split over several buckets."""
    df = spark.range(0, 5000).select(F.when(F.col("id") < 3000, F.lit(0)).otherwise(F.col("id")).alias("lead"),
                                     F.format_string("t%05d", F.col("id")).alias("tok"))
    rows = sorted(add_dense_id(df, ["lead", "tok"], name="pos", start=0, num_partitions=8).collect(),
                  key=lambda r: r.pos)
    assert [(r.lead, r.tok) for r in rows] == sorted((r.lead, r.tok) for r in df.collect())
    from rivulet.operators.order import _bucketed
    b, _ = _bucketed(df, ["lead", "tok"], 8, materialize_input=False)
    hot_buckets = b.where("lead = 0").select("__b").distinct().count()
    assert hot_buckets > 1


def test_reader_batch_of_a_question_with_few_negatives(spark):
    """A slot without a passage is empty, not an index error."""
    rows = [(1, "positive", 1, 10, [(1, 2)]), (1, "negative", 2, 11, []), (2, "positive", 1, 20, [(0, 0), (300, 301)]),
            (3, "negative", 1, 30, []), (4, "positive", 1, 40, [(400, 401)]), (4, "negative", 2, 41, [])]
    s = spark.createDataFrame(rows, "qid long, role string, rank int, doc_id long, spans array<struct<s:int,e:int>>")
    got = sorted(map(tuple, reader.reader_batch(s, passages_per_question=3).collect()), key=lambda r: r[:2])
    assert got == [(1, 0, 10, 1), (1, 1, 11, 0), (1, 2, None, 0), (2, 0, 20, 1), (2, 1, None, 0), (2, 2, None, 0)]
