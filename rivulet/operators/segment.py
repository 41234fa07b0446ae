"""Terms of text without spaces between words (X28): width folding, a lattice of
dictionary words over every run of letters, its cheapest path, base forms, stop
words.

A dictionary is a table ``surface, cost, base``.  Every run of letters and
digits is a lattice: an edge for each dictionary word in it, and a dear one for
each single character, so that there always is a path.  The cheapest path (of
equal ones that with the longer last word) gives the terms.  Runs that a task
has cut are kept in a bounded cache; the dictionary is bounded and travels to the
tasks, so terms do not cross the network.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.batches import cut
from rivulet.functions.text import analyze

#: Most words of a dictionary that is sent to tasks, and cost of a character
#: that is in none of the words on the path.
MAX_WORDS, UNKNOWN = 1 << 20, 10_000
#: Cost of the most frequent word; each further one costs one more.
FIRST_COST = 100
#: Runs that a task keeps; beyond it starts anew.
CACHE = 1 << 17


def build_dictionary(term_arrays: DataFrame, size: int, terms: str = "terms", longest: int = 20) -> DataFrame:
    """``surface, cost, base`` of the ``size`` terms in most rows (ties: the
    smaller term) of at most ``longest`` characters; rarer ones cost more."""
    if not 0 < size <= MAX_WORDS:
        raise ValueError(f"size must be from 1 to {MAX_WORDS}")
    df = (term_arrays.select(F.explode(F.array_distinct(terms)).alias("surface")).where(F.length("surface") <= longest)
          .groupBy("surface").agg(F.count(F.lit(1)).alias("df")))
    words = [r["surface"] for r in df.orderBy(F.desc("df"), "surface").limit(size).collect()]  # bounded by size
    return term_arrays.sparkSession.createDataFrame([(w, FIRST_COST + i, w) for i, w in enumerate(words)], "surface string, cost int, base string")


class Lattice:
    def __init__(self, words: dict[str, tuple[int, str]]):
        self.words = words
        self.longest = max(map(len, words), default=1)

    def cut(self, run: str) -> list[str]:
        """Base forms of the words on the cheapest path."""
        best, lengths = [0], [0]
        for end in range(1, len(run) + 1):
            ways = []
            for length in range(1, min(self.longest, end) + 1):
                word = self.words.get(run[end - length:end])
                if word is not None or length == 1:
                    ways.append((best[end - length] + (UNKNOWN if word is None else word[0]), -length))
            cost, length = min(ways)
            best.append(cost)
            lengths.append(-length)
        out, end = [], len(run)
        while end:
            piece = run[end - lengths[end]:end]
            out.append(self.words.get(piece, (0, piece))[1])
            end -= lengths[end]
        return out[::-1]


def segment(df: DataFrame, terms: str, dictionary: DataFrame, *, out: str = "words", stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the words that its arrays of runs are made of, as base forms,
    without stop words; a null array gives a null one, a null run nothing."""
    rows = dictionary.select("surface", F.col("cost").cast("int"), F.coalesce("base", "surface").alias("base")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a dictionary holds {MAX_WORDS} words at most")
    shared = df.sparkSession.sparkContext.broadcast({r["surface"]: (r["cost"], r["base"]) for r in rows})
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])
    left_out = frozenset(stopwords)

    def run(batches):
        lattice = Lattice(shared.value)
        known: dict[str, list[str]] = {}
        for b in cut(batches, [terms]):
            if len(known) > CACHE:
                known.clear()
            found = []
            for runs in b.column(b.schema.get_field_index(terms)).to_pylist():
                if runs is None:
                    found.append(None)
                    continue
                for r in runs:
                    if r and r not in known:
                        known[r] = [w for w in lattice.cut(r) if w not in left_out]
                found.append([w for r in runs if r for w in known[r]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def analyze_unspaced(df: DataFrame, text: str, dictionary: DataFrame, *, out: str = "terms", stopwords: tuple[str, ...] = ()) -> DataFrame:
    """X28 for languages without spaces: NFKC (which folds widths), lower case,
    runs of letters and digits, cut by the dictionary."""
    runs = out + "_runs"
    return segment(df.withColumn(runs, analyze(F.col(text))), runs, dictionary, out=out, stopwords=stopwords).drop(runs)
