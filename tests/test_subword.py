"""Sub-word ids against a plain longest-match loop; layout, cuts and padding."""
import random

import pytest

from rivulet.functions.tokens import extend_span_to_words
from rivulet.operators import subword

WORDS = ["play", "player", "playing", "ing", "un", "do", "undo", "é", "中文", "a", "#"]


@pytest.fixture(scope="module")
def vocab(spark):
    docs = spark.createDataFrame([(w,) for w in WORDS for _ in range(WORDS.index(w) + 1)], "w string").selectExpr("array(w) tokens")
    return subword.build_pieces(docs, 100)


def greedy(word, ids):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in ids:
                out.append(ids[piece])
                at = end
                break
        else:
            return [1]
    return out


def test_pieces_are_the_longest_matches(spark, vocab):
    ids = {r.token: r.id for r in vocab.collect()}
    assert [ids[t] for t in subword.SPECIALS] == [0, 1, 2, 3, 4] and "##playing" in ids and sorted(ids.values()) == list(range(len(ids)))
    rng = random.Random(3)
    words = ["".join(rng.choice([*WORDS[:-1], "p", "l", "zz", "文"]) for _ in range(rng.randrange(1, 5))) for _ in range(300)] + ["", None, "[PAD]", "#"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 9))]) for i in range(200)] + [(900, None), (901, [])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)
    plain = {t: i for t, i in ids.items() if t not in subword.SPECIALS}
    got = {r.doc_id: r.ids for r in subword.encode_pieces(df, "tokens", vocab).collect()}
    assert got == {i: [2, *(x for w in t or [] for x in greedy(w or "", plain)), 3] for i, t in rows}
    back = {r.doc_id: r.text for r in subword.decode_pieces(subword.encode_pieces(df, "tokens", vocab), "ids", vocab).collect()}
    assert back == {i: " ".join(w for w in t or [] if w and greedy(w, plain) != [1]) for i, t in rows}
    bare = {r.doc_id: r.ids for r in subword.encode_pieces(df, "tokens", vocab, add_special_tokens=False).collect()}
    assert all(got[i] == [2, *bare[i], 3] for i in got)


def longest_first(title, text, room):
    title, text = list(title), list(text)
    while len(title) + len(text) > room:
        (title if len(title) > len(text) else text).pop()
    return title, text


def test_pairs_are_cut_and_padded(spark, vocab):
    ids = {r.token: r.id for r in vocab.collect()}
    a = ids["a"]
    rng = random.Random(4)
    rows = [(i, ["a"] * rng.randrange(0, 12), ["do"] * rng.randrange(0, 12)) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, title array<string>, tokens array<string>")
    for most in (3, 4, 7, 12, 30):
        out = subword.encode_pieces(df, "tokens", vocab, title_tokens="title", max_length=most, pad=True).collect()
        for r in out:
            t, x = longest_first([a] * len(r.title), [ids["do"]] * len(r.tokens), most - (3 if r.title else 2))
            want = [2, *([*t, 3] if r.title else []), *x, 3]
            assert r.ids == want + [0] * (most - len(want)) and len(r.ids) == most
    with pytest.raises(ValueError):
        subword.encode_pieces(df, "tokens", vocab, pad=True)


def test_spans_are_moved_out_to_whole_words(spark, vocab):
    """X21 acts on pieces: a span that begins or ends inside a word grows to it."""
    names = {r.id: r.token for r in vocab.collect()}
    df = spark.createDataFrame([(["undoing", "a", "playering"],)], "tokens array<string>")
    pieces = [names[i] for i in subword.encode_pieces(df, "tokens", vocab, add_special_tokens=False).first().ids]
    assert pieces == ["undo", "##ing", "a", "player", "##ing"]
    row = spark.createDataFrame([(pieces,)], "t array<string>").select(extend_span_to_words("t", _lit(1), _lit(3)).alias("w")).first().w
    assert (row.s, row.e) == (0, 4)


def _lit(n):
    from pyspark.sql import functions as F
    return F.lit(n)


def test_bounds(spark, vocab, monkeypatch):
    with pytest.raises(ValueError):
        subword.build_pieces(vocab.selectExpr("array(token) tokens"), 0)
    monkeypatch.setattr(subword, "MAX_PIECES", 5)
    with pytest.raises(ValueError, match="at most"):
        subword.vocabulary(vocab)
