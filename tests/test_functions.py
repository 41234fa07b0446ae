"""Hand-made rows with hand-computed results (FIXTURES.md §2): text functions."""
from pyspark.sql import functions as F

from rivulet.functions import text as tx
from rivulet.operators.match import regex_match


def one(spark, col, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(col.alias("r")).first()["r"]


def test_normalize_text(spark):
    assert one(spark, tx.normalize_text("x"), "Ａ　 b​c ") == "A bc"


def test_exact_match(spark):
    df = spark.createDataFrame([("The Cat!", "cat"), ("new york", "newyork"), ("a dog", "cat")], "p string, g string")
    assert [r[0] for r in df.select(tx.exact_match("p", "g")).collect()] == [True, True, False]


def test_normalize_answer_articles(spark):
    assert one(spark, tx.normalize_answer("x"), "A man, an apple and THE end.") == "manappleandend"


def test_regex_invalid_pattern_is_false(spark):
    df = spark.createDataFrame([("abc [x]", "["), ("Hello World", "world"), ("abc", "^b")], "t string, p string")
    assert [r[0] for r in df.select(regex_match("t", "p")).collect()] == [False, True, False]


def test_normalize_question(spark):
    df = spark.createDataFrame([("a??",), ("a？",), ("",)], "q string")
    assert [r[0] for r in df.select(tx.normalize_question("q")).collect()] == ["a?", "a？", ""]


def test_tokenize_and_ngrams(spark):
    assert one(spark, tx.tokenize("x"), "Hello, wörld!") == ["Hello", ",", "wörld", "!"]
    assert one(spark, tx.ngrams(tx.tokenize("x"), 2), "a b c") == ["a", "a b", "b", "b c", "c"]
    assert one(spark, tx.ngrams(tx.tokenize("x"), 2), "") == []


def test_ngrams_filter_before_join(spark):
    keep = lambda arr: ~F.array_contains(arr, "b")
    assert one(spark, tx.ngrams(tx.tokenize("x"), 2, keep=keep), "a b c") == ["a", "c"]


def test_json_quote_roundtrip(spark):
    s = 'he said "hi"\tx ü'
    q = one(spark, tx.json_quote("x"), s)
    assert q == '"he said \\"hi\\"\\tx ü"'
    assert one(spark, tx.json_unquote("x"), q) == s
    assert one(spark, tx.strip_quotes("x"), '"he said \\"hi\\" x"') == 'he said \\"hi\\" x'
