"""Remaining operators: tokens helpers, encoder, vocab, gold insertion, global
batches, index persistence, readers / writers and the streaming path."""
import gzip
import json

import pytest
import tempfile

import numpy as np
from pyspark.sql import functions as F

from rivulet.functions import tokens as tk
from rivulet.functions.vector import first_token_pool, project
from rivulet.operators import annotate, encode, knn, quality, reader, training
from rivulet.sources import io


def tmpdir():
    return tempfile.mkdtemp(prefix="rivulet-test-")


def test_extend_span_and_slices(spark):
    df = spark.createDataFrame([(["a", "##b", "##c", "d", "##e", "f"],)], "t array<string>")
    r = df.select(tk.extend_span_to_words("t", F.lit(1), F.lit(3)).alias("x")).first().x
    assert (r.s, r.e) == (0, 4)
    assert df.select(tk.slice_tokens("t", 1, 3)).first()[0] == ["##b", "##c"]


def test_token_offsets(spark):
    df = spark.createDataFrame([("Hi, you",)], "x string")
    assert df.select(tk.token_offsets(tk.tokens_with_offsets("x"))).first()[0] == [[0, 2], [2, 3], [4, 7]]


def test_tokens_give_the_text_back(spark):
    texts = ["Hi,  you\n\tthere ", " \u3000lead é́x  😀a  b", "", "   ", None, "one", "a\x00b . "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").withColumn("t", tk.tokens_with_offsets("x"))
    for r in df.select("i", "t", tk.untokenize("t").alias("u"), tk.token_offsets("t").alias("o")).collect():
        text = texts[r.i]
        if text is None:
            assert r.t is None and r.u is None
            continue
        strip = "".join(chr(c) for c in [*range(33), 0x3000])
        assert r.u == text.strip(strip)
        assert [text[s:e] for s, e in r.o] == [t.text for t in r.t]
        assert all(text[t.end:t.end + len(t.after)] == t.after for t in r.t)


def test_annotation_accessor_and_groups(spark):
    df = spark.createDataFrame([(1, ["New", "York", "is", "big"], ["LOC", "LOC", "O", "O"])],
                               "id long, tokens array<string>, tags array<string>")
    g = annotate.entity_groups(df, "id").collect()
    assert [(r.tag, r.text) for r in g] == [("LOC", "New York")]
    ann = spark.createDataFrame([([{"text": "a", "pos": "DT"}],)], "t array<struct<text:string,pos:string>>")
    assert ann.select(tk.annotation(ann, "t", "pos")).first()[0] == ["DT"]
    assert ann.select(tk.annotation(ann, "t", "lemma")).first()[0] is None  # no such annotation


def test_encoder_registry_and_shape(spark):
    df = spark.createDataFrame([(1, "the cat sat", "T"), (2, "", "T")], "id long, text string, title string")
    out = {r.id: r.vec for r in encode.encode(df, "text", title="title", dim=16).collect()}
    assert len(out[1]) == 16 and abs(sum(x * x for x in out[1]) - 1) < 1e-5
    assert abs(sum(x * x for x in out[2]) - 1) < 1e-5  # title only
    try:
        encode.get_encoder("nope")
        raise AssertionError
    except KeyError:
        pass

    @encode.register_encoder("test_constant")
    def constant(dim=3):  # a user encoder registered on the driver only
        import numpy as np
        return lambda terms: np.ones((len(terms), dim))
    got = encode.encode(df, "text", encoder="test_constant", dtype="double").first().vec
    assert got == [1.0, 1.0, 1.0]


def test_tag_runs_of_odd_rows(spark):
    rows = [(1, ["a", "b", "c", "d", "e"], ["X", "X", "Y", "O", "Y"]), (2, [], []), (3, None, None),
            (4, ["a", "b"], [None, "X"]), (5, ["a"], ["X", "X", "Z"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, tags array<string>")
    got = sorted((r.id, r.group_idx, r.tag, r.text) for r in annotate.entity_groups(df, "id").collect())
    assert got == [(1, 0, "X", "a b"), (1, 1, "Y", "c"), (1, 2, "Y", "e"), (4, 0, "X", "b"), (5, 0, "X", "a"), (5, 1, "Z", "")]


def test_tag_runs_equal_a_plain_grouping(spark):
    import itertools
    import random

    rng = random.Random(8)
    rows = [(i, [rng.choice(["a", "b c", "", "é"]) for _ in range(n)], [rng.choice(["X", "Y", "O", "O"]) for _ in range(n)])
            for i, n in enumerate(rng.choice([0, 1, 5, 40]) for _ in range(120))]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, tags array<string>").repartition(3)
    got = sorted((r.id, r.group_idx, r.tag, r.text) for r in annotate.entity_groups(df, "id").collect())
    want = []
    for i, tokens, tags in rows:
        runs = [(tag, " ".join(t for t, _ in group)) for tag, group in itertools.groupby(zip(tokens, tags), key=lambda x: x[1]) if tag != "O"]
        want += [(i, k, *r) for k, r in enumerate(runs)]
    assert got == want


def test_reader_select_with_gold_passages(spark):
    passages = spark.createDataFrame(
        [(1, "Page", "x ans"), (2, "Other", "ans y"), (3, "page", "ans ans"), (4, "Other", "none"), (5, "Other", "no"), (6, "Q", "nope")],
        "id long, title string, text string")
    questions = spark.createDataFrame([(1, "who", ["ans"]), (2, "what", ["ans"]), (3, "why", ["ans"]), (4, "how", ["zzz"])],
                                      "qid long, question string, answers array<string>")
    hits = [(q, r, d, d <= 3) for q in (1, 2, 4) for r, d in enumerate((2, 1, 4, 3, 5, 6), 1)]
    hits = spark.createDataFrame(hits, "qid long, rank int, doc_id long, has_answer boolean")
    gold = spark.createDataFrame([(1, 0, 9, "old", "ans"), (1, 1, 3, "PAGE", "ans ans"), (2, 0, 7, "none such", "the ans"),
                                  (3, 0, 8, "t", "ans"), (4, 0, 8, "t", "ans"), (99, 0, 8, "t", "ans")],
                                 "qid long, ord int, doc_id long, title string, text string")

    def chosen(**kw):
        cfg = reader.ReaderConfig(max_positives=1, max_negatives=1, min_negatives=2, **kw)
        out = reader.reader_select(hits, passages, questions, cfg, gold=gold).collect()
        return {(q, role): [r.doc_id for r in sorted(out, key=lambda r: r.rank) if (r.qid, r.role) == (q, role)]
                for q, role in {(r.qid, r.role) for r in out}}

    # question 1: both positives of the gold page, over max_positives; 2: the first one; 3 has no hits; 4 no span
    assert chosen() == {(1, "positive"): [1, 3], (1, "negative"): [4, 5], (2, "positive"): [2], (2, "negative"): [4, 5]}
    assert chosen(include_gold_passage=True) == {(1, "positive"): [1, 3], (1, "negative"): [4, 5], (2, "positive"): [7, 2],
                                                 (2, "negative"): [4, 5], (3, "positive"): [8]}
    assert chosen(gold_page_only_positives=False)[1, "positive"] == [2]
    evaluated = reader.reader_select(hits, passages, questions, reader.ReaderConfig(eval_passages=2), False, gold=gold).collect()
    assert sorted((r.qid, r.role, r.doc_id) for r in evaluated) == [(q, "negative", d) for q in (1, 2, 4) for d in (1, 2)]


def test_reader_tensors(spark):
    sel = spark.createDataFrame(
        [(1, "positive", -1, 9, [(1, 1)]), (1, "positive", 1, 10, [(7, 9)]), (1, "positive", 2, 11, [(2, 3), (6, 8), (4, 4)]),
         (1, "negative", 3, 12, []), (1, "negative", 4, 13, []), (1, "negative", 5, 14, []),
         (2, "positive", 1, 10, [(8, 9)]), (2, "negative", 2, 12, []), (3, "positive", 1, 11, [(0, 0)])],
        "qid long, role string, rank int, doc_id long, spans array<struct<s:int,e:int>>")
    seq = spark.createDataFrame([(q, d, [d] * n) for q in (1, 2, 3) for d, n in ((9, 2), (10, 9), (11, 3), (12, 5), (13, 1))],
                                "qid long, doc_id long, ids array<int>")
    kw = dict(passages_per_question=3, max_length=4, max_n_answers=2, pad=0)
    out = {r.qid: r for r in reader.reader_tensors(sel, seq, **kw).collect()}
    assert sorted(out) == [1, 3]  # no span of question 2 is within the length
    assert out[1].input_ids == [[11, 11, 11, 0], [12] * 4, [13, 0, 0, 0]]
    assert out[1].start_positions == [[2, 0], [0, 0], [0, 0]] and out[1].end_positions == [[3, 0], [0, 0], [0, 0]]
    assert out[1].answer_mask == [[1, 0], [0, 0], [0, 0]]
    assert out[3].input_ids == [[11, 11, 11, 0], [0] * 4, [0] * 4]
    firsts, seconds = set(), set()
    for seed in range(20):
        one = reader.reader_tensors(sel, seq, seed=seed, **kw).where("qid = 1").select("input_ids")
        ids = one.first().input_ids
        firsts.add(ids[0][0])
        seconds.add(ids[1][0])
    assert firsts == {9, 11} and seconds == {0, 12, 13}  # document 14 has no sequence
    ev = {r.qid: r.input_ids for r in reader.reader_tensors(sel, seq, train=False, **kw).collect()}
    assert ev[1] == [[12] * 4, [13, 0, 0, 0], [0] * 4] and ev[3] == [[0] * 4] * 3


def test_pair_sequence(spark):
    df = spark.createDataFrame([(["q"], None, ["p", "r"])], "q array<string>, t array<string>, p array<string>")
    cols = [F.col(c) for c in "qtp"]
    got = df.select(reader.pair_sequence(*cols).alias("a"), reader.pair_sequence(*cols, tailing_sep=True).alias("b")).first()
    assert got.a == ["[CLS]", "q", "[SEP]", "[SEP]", "p", "r"] and got.b == got.a + ["[SEP]"]


def test_short_shards_run_their_first_batch_again(spark):
    rows = spark.createDataFrame([(i,) for i in range(13)], "pos long")  # shards of 5, 5, 3
    b = training.assign_batches(training.fill_last_batch(training.assign_shards(rows, 13, 3), 1), 1)
    n = training.shard_iterations(13, 3, 1)
    out = training.fill_short_shards(b, n, 1).collect()
    per = {s: [r.pos for r in sorted(out, key=lambda r: r.batch_id) if r.shard_id == s] for s in range(3)}
    assert n == 5 and per == {0: [0, 1, 2, 3, 4], 1: [5, 6, 7, 8, 9], 2: [10, 11, 12, 10, 10]}
    assert (training.shard_iterations(13, 3, 2), training.shard_iterations(13, 3, 2, strict=False)) == (3, 2)


def test_decode_answers(spark):
    ids = ["[CLS]", "q", "[SEP]", "new", "##port", "is", "a", "town"]
    logits = [(1, 0, 0.5, [9.0, 9, 9, 0, 5, 1, 0, 0], [9.0, 9, 9, 0, 4, 0, 1, 0], ids, 3),
              (1, 1, 0.9, [0.0] * 7 + [2], [0.0] * 7 + [3], ids, 3), (1, 2, 0.9, [0.0] * 3, [0.0] * 3, ids[:3], 3)]
    logits = [(q, p, r, [float(x) for x in st], [float(x) for x in en], t, o) for q, p, r, st, en, t, o in logits]
    df = spark.createDataFrame(logits, "qid long, passage_idx int, relevance double, start_logits array<double>, "
                                       "end_logits array<double>, ids array<string>, passage_offset int")
    asked = spark.createDataFrame([(1,), (2,)], "qid long")
    out = {(r.qid, r.top_k): r for r in reader.decode_answers(df, thresholds=(1, 2, 3), questions=asked).collect()}
    assert len(out) == 6 and out[1, 1].text == "newport" and out[1, 1].score == 9 and out[1, 1].passage == "newport is a town"
    assert out[1, 2].text == out[1, 3].text == "town" and out[1, 3].passage_idx == 1  # passage 2 ends before its offset
    assert all((out[2, n].text, out[2, n].score, out[2, n].passage_idx, out[2, n].passage) == ("", -1, -1, "") for n in (1, 2, 3))
    every = {r.qid: r for r in reader.decode_answers(df, questions=asked).collect()}
    assert (every[1].text, every[1].top_k, every[2].text, every[2].top_k) == ("town", 2, "", 0)
    named = reader.decode_answers(df, thresholds=(1, 2), questions=asked).withColumn("question", F.lit("who"))
    assert {tuple(r) for r in io.submission(named).collect()} == {(1, "who", "newport"), (2, "who", "")}


def test_include_gold(spark):
    sel = spark.createDataFrame([(1, "positive", 1, 10, 5, [(6, 7)])],
                                "qid long, role string, rank int, doc_id long, passage_offset int, spans array<struct<s:int,e:int>>")
    gold = spark.createDataFrame([(1, 10, 5, [(6, 7)]), (2, 20, 4, [(5, 5)]), (3, 30, 4, [])],
                                 "qid long, doc_id long, passage_offset int, spans array<struct<s:int,e:int>>")
    out = reader.include_gold_passages(sel, gold).collect()
    assert sorted((r.qid, r.doc_id) for r in out) == [(1, 10), (2, 20)]


def test_global_batch_offsets(spark):
    df = spark.createDataFrame([(0, 0, 0, 2), (0, 0, 1, 3), (0, 1, 0, 2)],
                               "batch_id long, shard_id int, sample_pos int, n_ctx int")
    out = {(r.shard_id, r.sample_pos): r.global_ctx_offset for r in training.global_batch_offsets(df).collect()}
    assert out == {(0, 0): 0, (0, 1): 2, (1, 0): 5}


def test_visitor(spark):
    df = spark.range(5)
    out = training.apply_visitor(df, lambda p: p.assign(id=p.id * 2), "id long")
    assert sorted(r.id for r in out.collect()) == [0, 2, 4, 6, 8]


def test_pooling_projection(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "v array<array<double>>")
    r = df.select(project(first_token_pool("v"), [[1, 0], [1, 1]])).first()[0]
    assert r == [1.0, 3.0]


def test_readers(spark):
    d = tmpdir()
    # Gzip JSON array of training samples
    with gzip.open(f"{d}/train.json.gz", "wt") as f:
        json.dump([{"question": "q?", "answers": ["a"], "positive_ctxs": [{"id": "1", "title": "t", "text": "x"}],
                    "negative_ctxs": [], "hard_negative_ctxs": []}], f)
    s1 = io.read_training_files(spark, [f"{d}/train.json.gz"]).first()
    assert s1.question == "q?" and s1.positive_ctxs[0].id == "1"
    # Missing answers -> []
    with open(f"{d}/qa.jsonl", "w") as f:
        f.write(json.dumps({"qid": "1", "question": "q"}) + "\n")
    assert io.read_qas(spark, f"{d}/qa.jsonl").first().answers == []
    # S3: JSON-quoted TSV text, default decode vs compat strip
    with open(f"{d}/p.tsv", "w") as f:
        f.write('id\ttext\ttitle\n1\t"he said \\"hi\\" x"\tT\n')
    assert io.read_passages_tsv(spark, f"{d}/p.tsv").first().text == 'he said "hi" x'
    assert io.read_passages_tsv(spark, f"{d}/p.tsv", compat=True).first().text == 'he said \\"hi\\" x'
    # Question \t json answers
    with open(f"{d}/qa.tsv", "w") as f:
        f.write('who\t["a", "b"]\n')
    assert io.read_qa_tsv(spark, f"{d}/qa.tsv").first().answers == ["a", "b"]
    # Gold file
    with open(f"{d}/gold.json", "w") as f:
        json.dump({"data": [{"question": "q", "title": "T", "context": "c", "example_id": "e"}]}, f)
    assert io.read_gold_file(spark, f"{d}/gold.json").first().title == "T"


def test_writers_roundtrip(spark):
    d = tmpdir()
    rows = [(1, 'a "b"\nc', "T1"), (2, " spaced\t ", None), (3, None, ' "q\\ '), (4, "", ""), (None, "é\u2028", "t")]
    ps = spark.createDataFrame(rows, "id long, text string, title string")
    for gzip_ in (False, True):
        io.write_passages_tsv(ps.repartition(3), f"{d}/tsv", gzip=gzip_)
        back = {r.id: (r.text, r.title) for r in io.read_passages_tsv(spark, f"{d}/tsv").collect()}
        assert back == {None if i is None else str(i): (x, t or None) for i, x, t in rows}
    for bad in ("a\tb", "a\nb"):
        with pytest.raises(Exception, match="TAB or line break"):
            io.write_passages_tsv(spark.createDataFrame([(1, "x", bad)], ps.schema), f"{d}/bad")
    ps = ps.limit(1)
    qa = spark.createDataFrame([("who", ["a"])], "question string, answers array<string>")
    io.write_qa_tsv(qa, f"{d}/qa")
    assert io.read_qa_tsv(spark, f"{d}/qa").first().answers == ["a"]
    io.write_jsonl(ps, f"{d}/jsonl")
    assert spark.read.json(f"{d}/jsonl").count() == 1


def test_streaming_paragraphs(spark):
    from rivulet.streaming.stateless import paragraph_stream
    d = tmpdir()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(f"{d}/in")
    s = paragraph_stream(spark, f"{d}/in", docs.schema)
    (s.writeStream.format("memory").queryName("para_stream_test").option("checkpointLocation", f"{d}/ckpt")
     .trigger(availableNow=True).outputMode("append").start().awaitTermination())
    n_stream = spark.sql("SELECT count(*) FROM para_stream_test").first()[0]
    from rivulet.functions.text import normalize_text
    batch = docs.select(F.posexplode(F.split("text", "\n")).alias("l", "raw")).select(
        normalize_text("raw").alias("t")).where(F.length("t").between(10, 1000)).count()
    assert n_stream == batch > 0


def test_from_document_indices(spark):
    doc = lambda i: {"id": i, "title": "t" + i, "text": "x" + i}
    df = spark.createDataFrame([("q1", "a", [doc("1"), doc("2"), doc("3")], [2], [0, 1])],
                               "qid string, answer string, documents array<struct<id:string,title:string,text:string>>, "
                               "positive_document_indices array<int>, negative_document_indices array<int>")
    r = training.from_document_indices(df).first()
    assert r.answers == ["a"] and [c.id for c in r.positive_ctxs] == ["3"]
    assert [c.id for c in r.hard_negative_ctxs] == ["1", "2"] and r.negative_ctxs == []


def test_answer_matrices_and_pick(spark):
    sel = spark.createDataFrame(
        [(1, "positive", 1, 10, [(300, 301)]), (1, "positive", 2, 11, [(5, 6), (7, 9)]),
         (2, "positive", 1, 20, [(400, 400)])],
        "qid long, role string, rank int, doc_id long, spans array<struct<s:int,e:int>>")
    picked = {r.qid: r.doc_id for r in reader.pick_positive(sel, 256).collect()}
    assert picked == {1: 11}
    m = sel.where("doc_id = 11").select(reader.answer_matrices(F.col("spans"), 3).alias("m")).first().m
    assert (m.start_positions, m.end_positions, m.answer_mask) == ([5, 7, 0], [6, 9, 0], [1, 1, 0])
    qs = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(2, "positive", -1, 21, [(1, 1)]), (2, "negative", -1, 22, [])], sel.schema)
    nested = reader.nested_selection(sel.unionByName(gold), qs)
    kept, counts = quality.counted(nested, "samples", reader.selection_counters())
    assert counts == {"no_positive_questions": 1, "positives_from_gold": 1}
    second = kept.agg(*[c.alias(k) for k, c in reader.selection_counters().items()]).first().asDict()
    assert counts == second and {r.qid: len(r.passages) for r in kept.collect()} == {1: 2, 2: 3, 3: 0}


def test_counters_are_taken_while_rows_are_written(spark):
    """The rows are made once: a counter of calls sees each of them one time."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(1000).repartition(4).mapInArrow(run, "id long")
    kept, counts = quality.counted(df, "counted", {"n": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0)})
    assert counts == {"n": 1000, "even": 500} and made.value == 1000 and kept.count() == 1000 and made.value == 1000
    assert quality.stored(df, "stored", {"negative": F.col("id") < 0}).count() == 1000
    with pytest.raises(ValueError, match="'big': 10"):
        quality.stored(df, "stored", {"negative": F.col("id") < 0, "big": F.col("id") >= 990})
    assert quality.counted(df.limit(0), "none", {"n": F.count(F.lit(1))})[1] == {"n": 0}


def test_interrupted_shards_are_taken_up_again(spark):
    """A job that stops after some shards: the next run writes the others alone,
    and all of them equal a run in one go."""
    from rivulet.sources import shards

    d = tmpdir()
    df = spark.range(500).selectExpr("id", "array(cast(id as float), 1.0f) vec").repartition(3)
    made = []

    def encode(part):
        made.append(part)
        if len(made) == 3:
            raise RuntimeError("stopped")
        return part

    with pytest.raises(RuntimeError):
        shards.write_shards(df, f"{d}/some", "id", 5, encode)
    assert shards.finished(spark, f"{d}/some") == {0, 1} and len(made) == 3
    df.limit(7).write.parquet(f"{d}/some/shard=2")  # what the stopped job left of its shard
    assert shards.write_shards(df, f"{d}/some", "id", 5, lambda part: part) == [2, 3, 4]
    assert shards.write_shards(df, f"{d}/some", "id", 5, lambda part: 1 / 0) == []
    shards.write_shards(df, f"{d}/whole", "id", 5)
    rows = [sorted((r.id, r.shard) for r in shards.read_shards(spark, f"{d}/{n}").select("id", "shard").collect()) for n in ("some", "whole")]
    assert rows[0] == rows[1] and len(rows[0]) == 500
    with pytest.raises(ValueError, match="5 shards"):
        shards.write_shards(df, f"{d}/some", "id", 4)
    io.write_embeddings(df, f"{d}/emb", "model", num_shards=3)
    assert io.read_embeddings(spark, f"{d}/emb/model").count() == 500


def test_tokens_with_offsets_in_slices_of_bounded_text():
    """However many texts a batch has, tokens are made a slice at a time."""
    import pyarrow as pa

    from rivulet.functions import batches

    texts = ["  ab, c\n", None, "", " é x́!  ", "\t"] + ["word and word " * 2000] * 40
    out = list(tk._tokens_by_slices(iter([pa.array(texts)])))
    assert sum(map(len, out)) == len(texts) and max(sum(len(r or []) for r in o.to_pylist()) for o in out) <= batches.SLICE_TEXT
    assert len(out) > 2
    for text, row in zip(texts, (r for o in out for r in o.to_pylist())):
        assert (row is None) == (text is None)
        for t in row or []:
            assert text[t["start"]:t["end"]] == t["text"] and text[t["end"]:t["end"] + len(t["after"])] == t["after"]
    assert [[(t["text"], t["start"], t["after"]) for t in r] if r is not None else None for r in out[0].to_pylist()[:5]] == [
        [("ab", 2, ""), (",", 4, " "), ("c", 6, "\n")], None, [], [("é", 1, " "), ("x́", 3, ""), ("!", 5, "  ")], []]


def test_helpers_over_lists_cut_batches_into_slices(spark, monkeypatch):
    """Rows are the same however small the slices are, and slices keep to their size."""
    import pyarrow as pa

    from rivulet.functions import batches
    from rivulet.operators import segment, subword

    b = pa.RecordBatch.from_arrays([pa.array([["a"] * n if n is not None else None for n in (3, 0, None, 50, 9, 9, 1)])], names=["t"])
    assert [x.num_rows for x in batches.cut(iter([b]), ["t"], 20)] == [3, 1, 2, 1]
    df = spark.createDataFrame([(i, None if i % 7 == 0 else [f"w{j}" for j in range(i % 11)]) for i in range(60)], "i int, t array<string>").coalesce(1)
    vocab, words = subword.build_pieces(df, 5, "t"), segment.build_dictionary(df, 5, "t")

    def rows():
        ids = subword.encode_pieces(df, "t", vocab)
        cut = segment.segment(df, "t", words)
        tags = df.select("i", annotate.tag_runs(F.col("t"), F.col("t"), "w1").alias("r"))
        return [sorted(map(str, x.collect())) for x in (subword.decode_pieces(ids, "ids", vocab), cut, tags)]

    whole = rows()
    for module in (batches, annotate):
        monkeypatch.setattr(module, "SLICE_ITEMS", 4)
    assert len(list(batches.cut(iter([b]), ["t"]))) == 6
    assert rows() == whole


def test_few_scores_and_spans_at_a_time(spark, monkeypatch):
    """A pair of blocks is scored a few queries at a time, whatever the chunk's size."""
    import pyarrow as pa

    real = knn.scorer(2, "dot", True, 3)
    t = pa.table({"qid": list(range(30)), "doc_id": list(range(30)), "vec": [[float(i), 1.0] for i in range(30)]})
    whole = real(t)(t)
    parts = pa.concat_tables([real(t)(t.slice(i, 7)) for i in range(0, 30, 7)])
    assert whole.to_pylist() == parts.to_pylist()
    e = spark.createDataFrame([(i, [i / 9, 1.0 - i / 7, 0.5]) for i in range(40)], "qid int, vec array<double>")
    logits = e.select("qid", F.lit(0).alias("passage_idx"), F.col("vec").alias("start_logits"), F.col("vec").alias("end_logits"))
    want = sorted(map(tuple, reader.decode_spans(logits, top_spans=2).collect()))
    monkeypatch.setattr(reader, "SLICE_SPANS", 1)
    assert sorted(map(tuple, reader.decode_spans(logits, top_spans=2).collect())) == want
