"""Each operator of the package against a brute-force version on small rows,
and on the awkward ones: nulls, empty and long texts, ties, repeated rows,
empty tables, extra columns with clashing names."""
import gc
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm import bpe, common, components, decontaminate, licenses, lm, near_dedup, pii, secrets, substring, topk, toxicity
from rivulet.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, masks string, h_id long, doc_key long"


def docs_of(spark, rows):
    """(doc_id, text[, source]) -> documents with extra, clashing columns."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y", None, 7, 8) for r in rows]
    return spark.createDataFrame(full, DOC)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (None, "a null id with some words in it"), (4, "one"), (5, "same words here"),
           (5, "same words here"), (6, "same words here"), (7, LONG), (8, "ümläut ÀÉ 中文 \U0001f389 <|endoftext|> it's A.B.c")]


def test_empty_tables(spark):
    none, benchmark = docs_of(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (substring.substring_dedup(none), bpe.encoded_digests(none, tokenizer_path()), lm.lm_scores(none), topk.top_k(vectors),
                toxicity.toxicity_scores(none, labels), licenses.license_scan(none), decontaminate.leaks(none, benchmark),
                near_dedup.near_duplicates(none), pii.pii_scan(none), secrets.secret_scan(none), near_dedup.keep_one_each(none),
                secrets.redact_live(none), pii.sanitise(none), decontaminate.drop_leaking(none, benchmark)):
        assert out.collect() == []


def test_awkward_rows_keep_their_number(spark):
    docs, benchmark = docs_of(spark, AWKWARD), spark.createDataFrame([(1, None), (2, ""), (3, "same words here")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (6, 5)], "doc_id long, toxic int")
    n = len(AWKWARD)
    assert bpe.encoded_digests(docs, tokenizer_path()).count() == n
    assert lm.lm_scores(docs).count() == n
    assert near_dedup.near_duplicates(docs).count() == n
    assert pii.pii_scan(docs).count() == n and secrets.secret_scan(docs).count() == n
    scores = toxicity.toxicity_scores(docs, labels).collect()
    assert len(scores) == n and all(0 <= r.score <= 1 for r in scores)
    assert secrets.redact_live(docs).columns == docs.columns and secrets.redact_live(docs).count() == n
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == n
    assert {r.doc_id for r in decontaminate.leaks(docs, benchmark).collect()} == {5, 6}  # an item of three words
    kept = decontaminate.drop_leaking(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == n - 3
    assert licenses.license_scan(docs).collect() == []
    assert substring.substring_dedup(docs).where("doc_id <> 7").collect() == []


# 1 substring dedup
def test_substring_dedup_keeps_the_first(spark):
    passage = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa. Lambda mu nu xi omicron. Pi rho sigma tau upsilon."
    docs = docs_of(spark, [(9, f"Other start of nine. {passage} And its own end here."), (3, f"Head three. {passage}"),
                           (4, "Nothing of that kind. At all. Ever seen here before by anyone."), (5, f"{passage}\n{passage}")])
    out = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    assert set(out) == {9, 5}
    assert out[9].text == "Other start of nine. And its own end here." and out[9].n_removed == 4 and out[9].first_doc_ids == [3]
    assert out[5].text == "" and out[5].n_removed == 8


def test_substring_dedup_of_two_sentences_and_of_short_texts(spark):
    pair = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu xi."
    single = "one text without any end of a sentence but with enough words to be compared"
    docs = docs_of(spark, [(1, f"Head of one. {pair} Tail of one."), (2, f"Begin of two. {pair} Finish of two."),
                           (3, single), (4, single), (5, pair), (6, "too few words"), (7, "too few words")])
    out = {r.doc_id: r for r in substring.substring_dedup(docs).collect()}
    assert {d: (r.text, r.n_removed, r.first_doc_ids) for d, r in out.items()} == {
        2: ("Begin of two. Finish of two.", 2, [1]), 4: ("", 1, [3]), 5: ("", 2, [1])}


def test_substring_dedup_of_texts_without_ids(spark):
    pair = "Alpha beta gamma delta epsilon zeta eta. Theta iota kappa lambda mu nu xi."
    other = "Omicron pi rho sigma tau upsilon phi. Chi psi omega one two three four."
    docs = docs_of(spark, [(None, f"Head of one. {pair}"), (None, f"Head of two. {pair}"), (None, f"Head three. {pair}"),
                           (None, f"Fourth. {other}"), (8, f"{other} Tail of eight."), (None, f"Head of one. {pair}")])
    out = substring.substring_dedup(docs).collect()
    assert len(out) == 3 and all(r.doc_id is None for r in out)  # two of the three with the pair, and the fourth
    assert sorted((r.first_doc_ids, r.n_removed) for r in out) == [([], 2), ([], 2), ([8], 2)]


def brute_substring(rows):
    """Spans by a plain scan: every sentence of a span that an earlier document,
    or an earlier place of the same one, has."""
    first, texts = {}, {}
    for d, t in sorted((d, t or "") for d, t in rows):
        pieces = substring.sentences(t.encode())
        words = [p.split() for p in pieces]
        least, gone, at = min(substring.MIN_SENTENCES, len(pieces)), set(), {}
        for i in range(len(pieces)):
            j = next((j for j in range(i + 1, len(pieces) + 1) if j - i >= least and sum(map(len, words[i:j])) >= substring.MIN_WORDS), None)
            if j is not None:
                key = b"\n".join(b" ".join(w) for w in words[i:j])
                if key in at or first.get(key, d) != d:
                    gone |= set(range(i, j))
                at[key] = i
        for key in at:
            first.setdefault(key, d)
        if gone:
            texts[d] = (len(gone), b"".join(p for i, p in enumerate(pieces) if i not in gone).decode())
    return texts


def test_substring_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(20)
    pool = [" ".join(rng.choice(["ab", "cd", "ef", "gh"], rng.integers(1, 9))) + rng.choice([".", "!", "\n", "?"]) for _ in range(25)]
    rows = [(int(i), " ".join(rng.choice(pool, rng.integers(0, 14)))) for i in rng.permutation(200)] + [(500, None), (501, "")]
    got = {r.doc_id: (r.n_removed, r.text) for r in substring.substring_dedup(docs_of(spark, rows)).collect()}
    assert got == brute_substring(rows) and len(got) > 50


def test_sentences_make_up_the_text():
    rng = np.random.default_rng(0)
    for _ in range(300):
        raw = bytes(rng.choice(list(b"ab .!?\n\t"), rng.integers(0, 60)).tolist())
        assert b"".join(substring.sentences(raw)) == raw


def _task_of(step, schema):
    """The function that a step maps over Arrow batches."""
    class Table:
        def mapInArrow(self, run, _):
            self.run = run
            return self

    Table.schema = schema
    return step(Table()).run


def test_a_slice_of_texts_at_a_time_in_memory():
    """Texts of a batch become Python objects a slice at a time."""
    import tracemalloc

    texts = pa.array(["x" * (1 << 20), None, ""] * 48)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], ["doc_id", "text"])
    tracemalloc.start()
    try:
        ids, read = [], []
        for part, raw in common.text_slices(iter([batch]), "text"):
            assert part.num_rows == len(raw)
            ids += part.column(0).to_pylist()
            read += map(len, raw)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids == list(range(len(texts))) and read == [1 << 20, 0, 0] * 48
    assert most < 4 * common.SLICE_BYTES  # the batch has 12 times that of a slice
    assert list(common.text_slices(iter([batch.slice(0, 0)]), "text")) == []


def test_a_worker_keeps_no_codec_beyond_its_step(spark):
    """Tasks of a step share the codec; the next step's task drops it."""
    import weakref

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["it's the the", None])], ["doc_id", "text"])
    path = tokenizer_path()
    encode = _task_of(lambda t: bpe.with_ids(t, path), schema)
    assert [b.column("ids").to_pylist()[1] for b in encode(iter([batch]))] == [b""]
    first = weakref.ref(bpe.codec(path))
    assert len(list(encode(iter([batch])))) == 1 and first() is bpe.codec(path)
    prints = _task_of(lambda t: near_dedup.with_fingerprint(t, "fp"), schema)
    assert len(list(prints(iter([batch])))) == 1
    gc.collect()
    assert first() is None


# 2 BPE
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    known = Tokenizer.from_file(path)
    known.no_padding()
    known.no_truncation()
    rng = np.random.default_rng(1)
    letters = list("aaabhe!'s ÉéΣσ中1٣\x1c\x85　\n.,<|") + ["<|startoftext|>", "́"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(400)] + [r[1] or "" for r in AWKWARD]
    c = bpe.codec(path)
    for t in texts:
        ids = known.encode(t, add_special_tokens=False).ids
        mine = c.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids, repr(t)
        assert c.decode(mine).decode() == known.decode(ids, skip_special_tokens=False)
    row = bpe.encoded_digests(docs_of(spark, [(1, "it's the the")]), path).first()
    ids = known.encode("it's the the", add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# 3 LM
def test_lm_base_score_and_gain(spark):
    rng = np.random.default_rng(2)
    nouns, verbs = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    rows = [(i, " ".join(x for _ in range(30) for x in (rng.choice(nouns), rng.choice(verbs)))) for i in range(140)] + [(200, None), (201, "zzz")]
    out = {r.doc_id: r for r in lm.lm_scores(docs_of(spark, rows), n_classes=4).collect()}
    count = Counter()
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(lm.tokens((t or "").encode()))
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        words = lm.tokens((t or "").encode())
        assert out[d].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words))
        assert (out[d].n_tokens, out[d].n_known, out[d].train_tokens) == (len(words), sum(count[w] > 0 for w in words), n)
    held = [r for r in out.values() if r.held_out and r.n_tokens > 10]
    assert held and all(r.score > r.base_score + 10 for r in held)  # classes alternate: about 0.3 a token


def test_lm_score_equals_brute_force(spark):
    """The whole model again, token by token: classes by one exchange round,
    transitions drawn to the classes' shares, emissions with one unseen word."""
    rng = np.random.default_rng(12)
    vocabulary = [f"{a}{b}" for a in ("th", "and", "of", "run", "blu", "zz") for b in ("", "e", "ing", "ed")]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([6, 24])], rng.integers(0, 15)))) for i in range(90)] + [(95, None), (300, "never seenword the")]
    k = 5
    learnt = [lm.tokens((t or "").encode()) for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    count = Counter(w for t in learnt for w in t)
    unit = {w: i + 1 for i, w in enumerate(sorted((w for w in count if w != lm.END), key=lambda w: (-count[w], w)))} | {lm.END: 0}
    size = len(unit) + lm.ENDINGS

    def of(word):
        return unit.get(word, len(unit) + xxhash.xxh32_intdigest(word[-3:]) % lm.ENDINGS)

    tokens = np.zeros(size)
    for w, n in count.items():
        tokens[of(w)] += n
    classes = np.empty(size, np.int64)
    classes[np.argsort(-tokens, kind="stable")] = np.arange(size) % k
    for moved in (True, False):
        before, after = np.zeros((size, k), np.int64), np.zeros((size, k), np.int64)
        for t in learnt:
            for left, right in zip([lm.END, *t], t):
                before[of(right), classes[of(left)]] += 1
                after[of(left), classes[of(right)]] += 1
        if moved:
            classes = lm.exchange(classes, before.ravel(), after.ravel(), k)
    pairs, n_class, v_class = Counter(), Counter(), Counter()
    for t in learnt:
        pairs.update((classes[of(left)], classes[of(right)]) for left, right in zip([lm.END, *t], t))
    for w, n in count.items():
        n_class[classes[of(w)]] += n
        v_class[classes[of(w)]] += 1

    def probability(left, word):
        a, c = classes[of(left)], classes[of(word)]
        share = (n_class[c] + 1) / (sum(n_class.values()) + k)
        move = (pairs[a, c] + lm.KAPPA * share) / (sum(pairs[a, d] for d in range(k)) + lm.KAPPA)
        return move * (count[word] + 1) / (n_class[c] + v_class[c] + 1)

    for r in lm.lm_scores(docs_of(spark, rows), n_classes=k, rounds=1).collect():
        t = lm.tokens((dict(rows)[r.doc_id] or "").encode())
        assert r.score == pytest.approx(sum(math.log10(probability(left, w)) for left, w in zip([lm.END, *t], t)))
    # of each class the words it has and one unseen share its probability
    for c in range(k):
        assert sum(count[w] + 1 for w in count if classes[of(w)] == c) + 1 == n_class[c] + v_class[c] + 1


# 4 top-k
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (260, 8)).round(2)
    vectors[100:140] = vectors[100]  # ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(300, None), (301, [None] + [0.1] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.1]), (None, [0.1] * 8), (7, rows[7][1])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.floor(64 * vectors).astype(int)
    for q in range(0, 260, 20):
        best = sorted((-int(x[q] @ x[c]), c) for c in range(260) if c != q)[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in out if r.query_id == q)
        assert mine == [(i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert {r.query_id for r in out} == set(range(0, 260, 20))


def test_topk_of_huge_components():
    ids, big = np.arange(4), np.array([[1 << 60, 3], [-(1 << 60), 2], [5, 5], [1 << 59, 1]])
    got = topk.best_of(ids, big, ids[:1], big[:1], 2).to_pylist()
    assert [r["vec_id"] for r in got] == [3, 2] and got[0]["score"] == (1 << 63) - 1


def test_lists_are_left_unread_where_bounds_close():
    """Vectors with few heavy components: most entries are never read, and what
    comes out still holds each query's best, ties and all."""
    rng = np.random.default_rng(19)
    for n, dims, heavy in ((3000, 12, 2), (700, 6, 6), (50, 3, 1), (15, 4, 4)):
        vectors = np.where(rng.random((n, dims)) < heavy / dims, rng.integers(-400, 400, (n, dims)), rng.integers(-2, 3, (n, dims)))
        vectors[n // 2:n // 2 + 5] = vectors[0]
        ids, queries = rng.permutation(n), vectors[: min(n, 40)]
        row, cand, score, used, every = topk.nra(ids, vectors, ids[:len(queries)], queries, 20)
        assert every == queries.size * n and (used < 0.7 * every if (n, heavy) == (3000, 2) else used <= every)
        for q in range(len(queries)):
            mine = sorted((-int(s), int(ids[c])) for s, c in zip(score[row == q], cand[row == q]))[:20]
            assert mine == sorted((-int(queries[q] @ vectors[c]), int(ids[c])) for c in range(n) if c != q)[:20]


# 5 toxicity
def test_toxicity_learns_words_and_characters(spark):
    rng = np.random.default_rng(4)
    plain = ["".join(rng.choice(list("aeioustrnl"), 6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 120))
        if i % 4 == 0:
            for at in rng.choice(120, 5, replace=False):
                words[at] = "zork" + "".join(rng.choice(list("aeioustrnl"), 3))  # endings never seen before
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    out = toxicity.toxicity_scores(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)


def test_toxicity_sample_takes_a_repeated_row_once(spark):
    docs = docs_of(spark, [(1, "bad words here"), (3, "b text"), (3, "a text"), (4, ""), (5, None)] + [(2, "some kind words")] * 40)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0), (4, 0), (5, 1), (9, 1), (None, 1)], "doc_id long, toxic int")
    windows, label = toxicity.sample_documents(docs, labels, F.lit(True))
    assert sorted(zip(label, windows)) == [(0, [[b"a", b"text"]]), (0, [[b"some", b"kind", b"words"]]), (1, [[b"bad", b"words", b"here"]])]


def test_toxicity_gradients():
    rng = np.random.default_rng(5)
    net = toxicity._start([[b"aa", b"bb", b"cc"], [b"aa", b"bb", b"cc"]], [0, 1], rng)
    for p in ("word", "char", "enter", "enter_bias", "gates", "candidate", "attend", "out"):
        setattr(net, p, getattr(net, p).astype(np.float64))
    words, known = [b"aa", b"bb", b"cc", b"dd"], np.array([1, 2, 3, 0])
    windows, label = np.array([[0, 1, 2, 3, 1], [3, 0, -1, -1, -1]]), np.array([1, 0])

    def loss():
        x = net.read(net.enter_gates(net.inputs(words, known)[0]), windows)[0].astype(float)
        return float(np.mean(np.log1p(np.exp(x)) - label * x))

    grads = net.gradients(words, known, windows, label)
    for name, g in zip(("word", "char", "enter", "enter_bias", "gates", "candidate", "attend", "out"), grads):
        p = getattr(net, name)
        flat = [i for i in np.argsort(-np.abs(g).ravel())[:3]]
        for i in flat:
            at, step = np.unravel_index(i, p.shape), 1e-2
            p[at] += step
            up = loss()
            p[at] -= 2 * step
            down = loss()
            p[at] += step
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-4), name


def test_windows_cover_the_text():
    for n in (0, 1, 47, 48, 49, 200, 1001):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n))


# 6 licenses
def test_license_scan_finds_notices_anywhere(spark):
    names = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
             "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    filler = [f"word{i}" for i in range(40)]
    rows, want = [], set()
    for i in range(80):
        name, text = list(names.items())[i % 4]
        rows.append((i, " ".join(filler[:i % 23] + [text] + filler[:i % 7])))
        want.add((i, name))
    rows += [(900, "Licensed to nobody under the old MIT dome."), (901, licenses.PASSAGES["MIT"].replace("merge, ", "")), (902, " ".join(filler * 50))]
    got = licenses.license_scan(docs_of(spark, rows)).collect()
    assert {(r.doc_id, r.license) for r in got} == want | {(901, "MIT")}


# 7 decontamination
def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 40)))) for i in range(25)] + [(100, None), (101, "..."), (3, None)]
    rows = []
    for i in range(120):
        words = list(rng.choice(vocabulary, rng.integers(0, 60)))
        if i % 2:
            leak = items[int(rng.integers(0, 25))][1].upper().split()
            if i % 4 == 1 and len(leak) > 12:
                leak = leak[:-1]
            if i % 8 == 3 and len(leak) > 10:
                leak[len(leak) // 2] = "changed"
            words[10:10] = leak
        rows.append((i, ", ".join(words)))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(w, k):
        return Counter(" ".join(w[j:j + k]) for j in range(len(w) - k + 1))

    want = {}
    for d, text in rows:
        words = re.findall(r"\w+", text.lower())
        for item, t in items[:25]:
            iw = t.split()
            k, n = min(5, len(iw)), len(iw)
            if len(words) < k:
                continue
            best = max(sum((shingles(iw, k) & s).values()) / sum((shingles(iw, k) | s).values())
                       for s in (shingles(words[a:a + n], k) for a in range(max(1, len(words) - n + 1))))
            if best >= 0.8:
                want[d, item] = best
    assert set(got) == set(want) and len(want) > 20
    for key, best in want.items():
        assert got[key].similarity == pytest.approx(best)


def test_simhash_blocks_cover_all_bits(spark):
    row = spark.range(1).select(decontaminate.blocks(F.array(F.lit(-1).cast("bigint"), F.lit(-1).cast("bigint"))).alias("b")).first()
    assert sum(int(x).bit_count() for x in row.b) == 128 and len(row.b) == decontaminate.RADIUS + 1


def best_windows(items, rows, least=0.8):
    """{(doc_id, item_id): similarity of the best window}, over every window."""
    def shingles(w, k):
        return Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))

    out = {}
    for d, text in rows:
        words = text.split()
        for item, t in items:
            iw = t.split()
            k, n = min(5, len(iw)), len(iw)
            whole = shingles(iw, k)
            for a in range(max(1, len(words) - n + 1) if len(words) >= k else 0):
                s = shingles(words[a:a + n], k)
                similar = sum((whole & s).values()) / sum((whole | s).values())
                if similar >= least - 1e-12:
                    out[d, item] = max(similar, out.get((d, item), 0))
    return out


def test_decontamination_of_shifted_and_shared_windows(spark):
    """Words put in before and dropped after the only rare part of an item;
    items that share heads and tails; blocks of an item in another order."""
    rng = np.random.default_rng(16)
    fresh = lambda n: [f"u{rng.integers(0, 10**9)}" for _ in range(n)]
    head, tail = fresh(45), fresh(45)
    items = [(i, " ".join([*head, *fresh(10), *tail])) for i in range(4)]
    items += [(10 + i, " ".join([*head[i:], *fresh(40)])) for i in range(3)] + [(20, " ".join(["same"] * 60)), (21, "only four words here")]
    rows = []
    for i in range(60):
        words = items[rng.integers(0, len(items))][1].split()
        for _ in range(rng.integers(0, 3)):
            words[rng.integers(0, len(words)):0] = []
            at = int(rng.integers(0, len(words)))
            words[at:at + int(rng.integers(0, 3))] = fresh(int(rng.integers(0, 3)))
        if i % 5 == 0:
            words = words[len(words) // 2:] + words[:len(words) // 2]
        rows.append((i, " ".join([*fresh(int(rng.integers(0, 30))), *words, *fresh(int(rng.integers(0, 30)))])))
    middle = items[0][1].split()
    rows.append((100, " ".join([*fresh(20), *middle[:30], *fresh(2), *middle[30:98], *fresh(20)])))  # shifted by the two words
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(
        docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = best_windows(items, rows)
    assert set(got) == set(want) and len(want) > 40 and (100, 0) in want
    assert all(got[key] == pytest.approx(best) for key, best in want.items())


def test_decontamination_of_long_texts(spark):
    """A text of 2 MB with an item at some places, and one that is all items:
    every start there is a window of the item's shingles, in some order."""
    rng = np.random.default_rng(17)
    item = [f"v{i}" for i in rng.integers(0, 10**6, 80)]
    filler = [f"f{i}" for i in rng.integers(0, 10**6, 300_000)]
    for at in (0, 50_000, 299_000):
        filler[at:at] = item
    rows = [(1, " ".join(filler)), (2, " ".join(" ".join([*item, f"gap{i}"]) for i in range(60)))]
    out = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    found = {r.doc_id: (r.similarity, r.start_word) for r in out}
    assert found == {1: (1.0, 0), 2: (1.0, 0)} and next(r.n_windows for r in out if r.doc_id == 2) > 4000


# 8 near-dedup
def fingerprint_by_hand(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    sh = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = " ".join(rng.choice([f"q{i}" for i in range(300)], 400))
    rows = AWKWARD + [(20 + i, base.replace(f"q{i} ", f"z{i} ", 1) if i else base) for i in range(12)] + [(50, base.upper())]
    out = near_dedup.near_duplicates(docs_of(spark, rows)).collect()
    prints = [fingerprint_by_hand(t) for _, t in rows]
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((d, f"{p:016x}") for (d, _), p in zip(rows, prints))
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = Counter((rows[i][0], least[group[i]]) for i in range(len(rows)))
    assert Counter((r.doc_id, r.component_id) for r in out) == want
    kept = near_dedup.keep_one_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((x is None, x or 0) for x in least.values())


def test_ball_edges_find_every_component(spark):
    rng = np.random.default_rng(8)
    centres = rng.integers(-(1 << 62), 1 << 62, 12)
    prints = {int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in centres for a, b in rng.integers(0, 60, (15, 2))} | {int(c) for c in centres}
    edges = near_dedup.ball_edges(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.id: r.component for r in components.connected_components(edges).collect()}
    unsigned = {p: p & (1 << 64) - 1 for p in prints}
    group = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            low = min(group[q] for q in prints if (unsigned[p] ^ unsigned[q]).bit_count() <= 2)
            if low < group[p]:
                group[p], changed = low, True
    assert {p: got.get(p, p) for p in prints} == group


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)]
    out = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


# 9 PII
def base_pii(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii_base_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    letters = list("a.@-+0129 (é\U0001f389%_") + ["4111 1111 1111 1111", "192.168.0.1", "a@b.co", "+1 (555) 123-4567"]
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 40)))) for i in range(500)] + AWKWARD + [(999, "9" * 5000 + "@" + "x" * 5000)]
    out = pii.pii_scan(docs_of(spark, rows)).collect()
    want = Counter((d, hashlib.sha256(base_pii(t or "").encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in out) == want
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in out) > 50


def test_pii_terms_that_give_an_entity_away(spark):
    rows = [(i, f"note {i} unmistakable Zaphod writes from zb@galaxy.org about thing{i} common words") for i in range(6)]
    rows += [(100 + i, f"other text {i} with common words about this note and the writes from x") for i in range(60)]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r for r in pii.pii_scan(docs).collect()}
    told = {rows[0][1][int(s.split(":")[1]):int(s.split(":")[2])] for s in out[0].spans.split(",") if s.startswith("term")}
    assert told == {"unmistakable", "Zaphod"}
    assert all(r.n_term == 0 for d, r in out.items() if d >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == "note 0   writes from [EMAIL] about thing0 common words" and clean[100] == rows[6][1]


def test_pii_terms_of_an_entity_seen_once(spark):
    docs = docs_of(spark, [(1, "contact Xu Qorvane at xq@rare.org today")] + [(100 + i, f"contact number{i} at noon today") for i in range(200)])
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == "contact [TERM] [TERM] at [EMAIL] today" and clean[100] == "contact number0 at noon today"


# 10 secrets
def base_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secrets_base_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    pieces = list("=: '\"aé") + ["token", "API_KEY", "password=", "AKIA" + "X1" * 9, "AKIA", "0123456789abcdef" * 2, "secret: abc", "zq9"]
    rows = [(i, "".join(rng.choice(pieces, rng.integers(0, 25)))) for i in range(500)] + AWKWARD
    out = secrets.secret_scan(docs_of(spark, rows)).collect()
    want = Counter((d, hashlib.sha256(base_secrets(t or "").encode()).hexdigest()) for d, t in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in out) == want


def test_secrets_ownership(spark):
    shared, own = "token=Zq81mNv27xKp4T", "token=Wm53kRt90yLs2B"
    rows = [(i, f"copy {shared}", f"s{i}") for i in range(4)] + [(10, f"é live {own} end", "s9"), (11, f"again {own}", "s9"), (12, "token=changeme123", "s9")]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    assert [out[i].n_example for i in range(4)] == [1] * 4 and [out[i].n_live for i in (0, 10, 11, 12)] == [0, 1, 1, 0]
    assert out[10].spans == "assign:7:27,live:13:27"
    text = {r.doc_id: r.text for r in secrets.redact_live(docs).collect()}
    assert text[10] == "é live token=[SECRET] end" and text[0] == rows[0][1] and text[12] == rows[6][1]


def test_secrets_verdict_from_owners_and_contexts(spark):
    two, copied, example = "token=Qa72mWv19xRp5T", "secret=4f1c9be27ad0538e6b1f0c92", "token=Lk38vTz64cNy7D"
    rows = [(1, f"mine {two}", "s1"), (2, f"yours {two}", "s2")] + [(10 + i, f"one text {copied} copied", f"s{i}") for i in range(3)]
    rows += [(20 + i, f"text {i} shows {example}", f"s{i}") for i in range(3)]
    docs = docs_of(spark, rows)
    out = {r.doc_id: r for r in secrets.secret_scan(docs).collect()}
    assert all(out[d].n_live > 0 and out[d].n_example == 0 for d in (1, 2, 10, 11, 12))
    assert all(out[d].n_live == 0 and out[d].n_example == 1 for d in (20, 21, 22))
    text = {r.doc_id: r.text for r in secrets.redact_live(docs).collect()}
    assert text[1] == "mine token=[SECRET]" and text[10] == "one text secret=[SECRET] copied" and text[20] == rows[5][1]


# long texts full of matches: time must grow with the text, not with its square
def test_long_texts_of_personal_data_and_secrets(spark):
    mails = "".join(f"write to user{i}@host{i % 97}.example.org today about word{i % 13} " for i in range(90_000))  # 5 MB
    keys = "".join(f"token = k{i}Zq8vXw2LpR{i} and some more words here " for i in range(90_000))
    row = pii.pii_scan(docs_of(spark, [(1, mails)])).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (90_000, 0, 0, 0)
    at = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", mails)]
    assert row.base_sha256 == hashlib.sha256(",".join(f"email:{s}:{e}" for s, e in at).encode()).hexdigest()
    row = secrets.secret_scan(docs_of(spark, [(1, keys)])).first()
    assert row.n_assign == 90_000 and row.n_live > 89_000
    text = secrets.redact_live(docs_of(spark, [(1, keys)])).first().text
    assert text.count("[SECRET]") == row.n_live and text.startswith("token = ") and text.endswith(" and some more words here ")


def test_spans_and_masks_of_odd_texts(spark):
    from rivulet.llm import spans

    rng = np.random.default_rng(18)
    texts = ["".join(rng.choice(["a1", "b", " ", "é", "\U0001f389", "77"], rng.integers(0, 3000))) for _ in range(40)] + ["", "a1", "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    masks = F.transform(spans.find(F.col("text"), "a1|77+"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("<M>").alias("mask")))
    # each span twice, the second one longer: the first gives the mask, the longer one is left out
    twice = F.array_sort(F.flatten(F.transform(masks, lambda s: F.array(s, F.struct(s["start"].alias("start"), (s["end"] + 1).alias("end"), F.lit("<N>").alias("mask"))))))
    for r in frame.select("i", spans.find(F.col("text"), "a1|77+").alias("s"), spans.replace(F.col("text"), masks).alias("m"),
                          spans.replace(F.col("text"), twice).alias("t"),
                          F.transform(spans.find(F.col("text"), "a1"), lambda s: spans.part(spans.pieces_of(F.col("text")), s["start"], s["end"] + 5)).alias("p")).collect():
        text = texts[r.i]
        assert [(s.start, s.end, s.value) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer("a1|77+", text)]
        assert r.m == re.sub("a1|77+", "<M>", text)
        assert r.p == [text[m.start():m.end() + 5] for m in re.finditer("a1", text)]
