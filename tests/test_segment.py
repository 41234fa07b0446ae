"""Segmentation against trying every way to cut a run."""
import itertools
import random

import pytest

from rivulet.operators import segment

WORDS = {"東京": (100, "東京"), "京都": (101, "京都"), "東": (150, "東"), "都": (120, "都"), "に": (90, "に"), "行っ": (130, "行く"), "た": (95, "た"),
         "行": (160, "行"), "abc": (100, "abc"), "ab": (100, "ab"), "c": (100, "c")}


def every_cut(run):
    best = None
    for marks in itertools.product([0, 1], repeat=max(len(run) - 1, 0)):
        edges = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
        pieces = [run[a:b] for a, b in zip(edges, edges[1:])]
        if all(p in WORDS or len(p) == 1 for p in pieces):
            cost = sum(WORDS[p][0] if p in WORDS else segment.UNKNOWN for p in pieces)
            key = (cost, [-len(p) for p in reversed(pieces)])
            if best is None or key < best[0]:
                best = (key, [WORDS.get(p, (0, p))[1] for p in pieces])
    return best[1]


def test_cheapest_path_equals_every_way_to_cut():
    lattice, rng = segment.Lattice(WORDS), random.Random(6)
    assert lattice.cut("東京都に行った") == ["東京", "都", "に", "行く", "た"] and lattice.cut("") == []
    for _ in range(400):
        run = "".join(rng.choice("東京都に行ったabcx") for _ in range(rng.randrange(1, 10)))
        assert lattice.cut(run) == every_cut(run)


def test_analysis_of_unspaced_text(spark):
    dictionary = spark.createDataFrame([(w, c, b) for w, (c, b) in WORDS.items()], "surface string, cost int, base string")
    rows = [(1, "東京都に、行った。ＡＢＣ"), (2, None), (3, ""), (4, "に に"), (5, "x")]
    df = spark.createDataFrame(rows, "i int, t string").repartition(2)
    got = {r.i: r.terms for r in segment.analyze_unspaced(df, "t", dictionary, stopwords=("に",)).collect()}
    assert got == {1: ["東京", "都", "行く", "た", "abc"], 2: None, 3: [], 4: [], 5: ["x"]}


def test_dictionary_is_bounded_and_by_frequency(spark, monkeypatch):
    rows = spark.createDataFrame([(["a", "bb", "bb"],), (["bb", "c"],), (["a", "d" * 30],), (["d" * 30],)], "terms array<string>")
    got = {r.surface: r.cost for r in segment.build_dictionary(rows, 2).collect()}
    assert got == {"a": 100, "bb": 101}
    with pytest.raises(ValueError):
        segment.build_dictionary(rows, 0)
    monkeypatch.setattr(segment, "MAX_WORDS", 1)
    with pytest.raises(ValueError, match="at most"):
        segment.segment(rows, "terms", segment.build_dictionary(rows, 1).union(segment.build_dictionary(rows, 1)))
