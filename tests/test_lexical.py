"""The stored lexical index and its pruned search against exhaustive scoring."""
import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import lexical
from rivulet.session import files_key


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    common = ["the", "of", "and", "to"]
    rare = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare[:rng.choice([5, 50, 300])])
                      for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    texts += texts[:40] + ["", None, "the the the the", "of and"]
    ps = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    qs = [(i, " ".join(rng.choice(common + rare) for _ in range(rng.randrange(0, 12)))) for i in range(40)]
    qs += [(100, "the of and to"), (101, None), (102, "unknownword"), (103, "w1 w1 w1 the"), (104, texts[7])]
    return ps, spark.createDataFrame(qs, "qid long, question string"), dict(enumerate(texts)), dict(qs)


def test_pruned_search_equals_exhaustive(spark, corpus, monkeypatch):
    ps, qs, _, _ = corpus
    ix = lexical.build_index(ps)
    scores = lexical.bm25_scores(ix, lexical.query_terms(qs))
    for k in (1, 3, 25, 1000):
        want = sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in lexical.top_k(scores, k).collect())
        for prune in (True, False, None):
            got = sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in lexical.search(ix, qs, k, prune=prune).collect())
            assert got == want
    monkeypatch.setattr(lexical, "DIRECT_POSTINGS", 10)
    weights = lexical.weighted_terms(ix, lexical.query_terms(qs))
    assert not lexical.few_postings(ix, weights) and lexical.few_postings(ix, weights.limit(0))


def test_search_reads_few_candidates(spark, corpus):
    """Passages that share only common words with a question are not scored."""
    ps, qs, _, _ = corpus
    ix = lexical.build_index(ps)
    weights = lexical.weighted_terms(ix, lexical.query_terms(qs.where("qid < 40")))
    bounds = weights.join(ix.blocks, "term").withColumn("bound", F.col("weight") * F.col("best"))
    marked = lexical.marked_terms(bounds, lexical.thresholds(ix, weights, bounds, 3, None))
    found = lexical.candidates(ix, marked).count()
    every = weights.join(ix.postings, "term").select("qid", "doc_id").distinct().count()
    assert found < every / 4, (found, every)


def test_index_is_opened_by_path_and_keyed_by_files(spark, corpus, tmp_path):
    ps, qs, _, _ = corpus
    path = f"{tmp_path}/index"
    built = lexical.index_for(ps, path)
    opened = lexical.index_for(ps.limit(0), path)  # opened, so its passages are not read
    assert opened.path == path and opened.corpus_stats.collect() == built.corpus_stats.collect()
    key = lambda ix: sorted(map(tuple, lexical.search(ix, qs, 3).select("qid", "rank", "doc_id").collect()))
    assert key(opened) == key(built)
    files = f"{tmp_path}/files"
    ps.write.parquet(files)
    first = files_key(spark.read.parquet(files))
    assert first == files_key(spark.read.parquet(files))
    ps.limit(3).write.mode("append").parquet(files)
    assert first != files_key(spark.read.parquet(files))


def test_index_cut_off_before_its_end_is_built_again(spark, corpus, tmp_path):
    ps, _, texts, _ = corpus
    path = f"{tmp_path}/index"
    ps.limit(1).write.parquet(f"{path}/forward")  # what a failed build leaves
    assert lexical.index_for(ps, path).corpus_stats.first()["n_docs"] == len(texts)


def test_empty_index(spark, corpus):
    ps, qs, _, _ = corpus
    ix = lexical.build_index(ps.limit(0))
    assert lexical.search(ix, qs, 5).collect() == [] and lexical.search(lexical.build_index(ps), qs.limit(0), 5, prune=True).collect() == []


def test_phrases_by_positions_equal_a_scan(spark, corpus):
    ps, _, texts, _ = corpus
    rng = random.Random(12)
    phrases = []
    for i in range(60):
        words = (texts[rng.randrange(0, 400)] or "").split()
        at = rng.randrange(0, max(1, len(words)))
        phrases.append((i, " ".join(words[at:at + rng.randrange(1, 6)])))
    phrases += [(100, ""), (101, None), (102, "the the"), (103, "the the the the the"), (104, "w1 nowhere"), (105, "THE, of")]
    qs = spark.createDataFrame(phrases, "qid long, phrase string")
    ix = lexical.build_index(ps)
    got = {(r.qid, r.doc_id) for r in lexical.phrase_passages(ix, qs).collect()}
    plain = lambda t: " ".join((t or "").lower().replace(",", " ").split())
    want = {(q, d) for q, p in phrases if plain(p) for d, t in texts.items() if f" {plain(p)} " in f" {plain(t)} "}
    assert got == want


@pytest.mark.parametrize("must_not", [False, True])
def test_phrase_search_equals_exhaustive(spark, corpus, must_not):
    ps, _, texts, qtext = corpus
    qs = spark.createDataFrame([(q, t, " ".join((t or "").split()[:2])) for q, t in qtext.items()], "qid long, question string, phrase string")
    ix = lexical.build_index(ps)
    got = sorted((r.qid, r.rank, r.doc_id, round(r.score, 6)) for r in lexical.search_with_phrase(ix, ps, qs, 4, must_not=must_not, prune=True).collect())
    scores = {}
    for r in lexical.bm25_scores(ix, lexical.query_terms(qs)).collect():
        scores.setdefault(r.qid, []).append((r.doc_id, r.score))
    want = []
    for r in qs.collect():
        holds = lambda t, p=r.phrase: bool(p.split()) and f" {p.lower()} " in f" {(t or '').lower()} "
        hits = sorted((-round(s, 6), d) for d, s in scores.get(r.qid, []) if holds(texts[d]) != must_not)[:4]
        want += [(r.qid, i + 1, d, -s) for i, (s, d) in enumerate(hits) if ((r.phrase in texts[d]) != must_not)]
    assert got == sorted(want)


def test_buckets_grow_with_the_corpus(spark, corpus, monkeypatch):
    ps, qs, _, _ = corpus
    monkeypatch.setattr(lexical, "BUCKET_TERMS", 500)
    ix = lexical.build_index(ps)
    c = ix.corpus_stats.first()
    assert c.n_buckets > 4 and c.n_buckets == -(-ix.forward.agg(F.sum("dl")).first()[0] // 500)
    want = ix.postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, ix.blocks.select("term", "block", "df", "cf").collect()))


def test_candidates_are_the_same_however_terms_reach_the_postings(spark, corpus, monkeypatch):
    ps, qs, _, _ = corpus
    ix = lexical.build_index(ps)
    weights = lexical.weighted_terms(ix, lexical.query_terms(qs))
    bounds = weights.join(ix.blocks, "term").withColumn("bound", F.col("weight") * F.col("best"))
    marked = lexical.marked_terms(bounds, lexical.thresholds(ix, weights, bounds, 3, None)).localCheckpoint()
    got = []
    for most in (1 << 14, 0):
        monkeypatch.setattr(lexical, "SENT_TERMS", most)
        got.append(sorted((r.qid, r.doc_id, r.block, round(r.score, 9)) for r in lexical.candidates(ix, marked).collect()))
    assert got[0] and got[0] == got[1]


@pytest.fixture
def nothing_sent(spark):
    """Spark's guesses of sizes send no table to all tasks."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_stores_nothing_that_follows_from_the_postings(spark, corpus, tmp_path):
    ps, _, texts, _ = corpus
    ix = lexical.build_index(ps, path=f"{tmp_path}/index")
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["corpus", "forward", "postings", "terms"]
    assert ix.forward.columns == ["doc_id", "dl"]
    assert spark.read.parquet(f"{ix.path}/postings").columns == ["doc_id", "term", "dl", "tf", "positions"]
    c = ix.corpus_stats.first()
    for r in ix.postings.join(ix.forward, "doc_id").collect():
        words = (texts[r.doc_id] or "").split()
        assert (r.tf, r.dl) == (words.count(r.term), len(words)) and [words[p] for p in r.positions] == [r.term] * r.tf
        assert abs(r.impact - r.tf * 2.2 / (r.tf + 1.2 * (0.25 + 0.75 * r.dl / c.avgdl))) < 1e-12 and 0 <= r.block < c.n_blocks


def test_postings_stay_where_they_are(spark, corpus, nothing_sent):
    ps, qs, _, _ = corpus
    ix = lexical.build_index(ps)
    weights = lexical.weighted_terms(ix, lexical.query_terms(qs)).localCheckpoint()
    pairs = weights.join(ix.postings, "term").select("qid", "doc_id").distinct()
    marked = lexical.marked_terms(b := lexical.bounds_of(ix, weights).localCheckpoint(), lexical.thresholds(ix, weights, b, 3, None)).localCheckpoint()
    phrases = qs.select("qid", F.col("question").alias("phrase"))
    for df in (lexical.score_pairs(ix, weights, pairs), lexical.candidates(ix, marked), lexical.phrase_passages(ix, phrases)):
        assert "SortMergeJoin" not in plan(df), plan(df)


def test_search_by_bounds_stores_no_pairs(spark, corpus, monkeypatch):
    ps, qs, _, _ = corpus
    ix, stored = lexical.build_index(ps), {}
    keep = lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    hits = lexical.search(ix, qs, 3, prune=True)
    every = lexical.bm25_scores(ix, lexical.query_terms(qs)).count()
    by_passage = {n: df.count() for n, df in stored.items() if "doc_id" in df.columns}
    assert hits.count() and sum(by_passage.values()) < every / 2, by_passage


def test_index_of_another_form_is_built_again(spark, corpus, tmp_path):
    ps, _, texts, _ = corpus
    path = f"{tmp_path}/index"
    lexical.build_index(ps.limit(5), path=path)
    spark.read.parquet(f"{path}/corpus").drop("form").write.parquet(f"{tmp_path}/old")
    spark.read.parquet(f"{tmp_path}/old").write.mode("overwrite").parquet(f"{path}/corpus")
    assert lexical.index_for(ps, path).corpus_stats.first()["n_docs"] == len(texts)


def test_texts_of_few_hits_alone_are_moved(spark, corpus, nothing_sent):
    from rivulet.operators import match
    ps, _, _, _ = corpus
    hits = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (2, 1, 900)], "qid long, rank int, doc_id long")
    qa = spark.createDataFrame([(1, ["the"]), (2, ["of"])], "qid long, answers array<string>")
    df = match.has_answer(hits, ps, qa, match_type="raw")
    assert "LeftSemi, BuildRight" in plan(df), plan(df)
    assert {(r.qid, r.rank): r.has_answer for r in df.collect()}[(2, 1)] is False


def test_queries_move_texts_of_hits_alone(spark, tmp_path, nothing_sent):
    import re

    from rivulet.plans import registry
    docs = [(i, f"alpha w{i} beta w{i % 7} gamma", "en", f"src{i % 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w3 beta w3"), (2, "w30")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("reader_select", "reader_select_gold", "gold_page_match", "drop_no_positives"):
        p = plan(df := registry.queries()[name](spark, str(tmp_path)))
        texts = len(re.findall(r"FileScan parquet \[doc_id#\w+,(?:text|source)#", p))
        assert 0 < texts <= p.count("LeftSemi, BuildRight"), (name, p)
        assert {r.qid for r in df.collect()} <= {1, 2}
