"""LM scoring with Brown's class-based bigrams.

Every word belongs to a class; a text's probability is the product of class
transitions P(class | class before) and emissions P(word | class).  Exchange
clustering assigns the classes: a unit moves to the class that raises the
corpus likelihood most.  Units are the words with at least 1 / ``WORD_SHARE``
of all tokens (so there are at most ``WORD_SHARE``; in prose some 25,000, with
three quarters of all tokens), and groups of rarer words by their endings; a
group moves as one.

Counting is distributed: word counts, and in each exchange round how often
every unit stands before and after every class.  That table has at most
units x classes cells, whatever the corpus, and the exchange works on it with
class counts that follow every move.

The corpus is encoded once: a table in the shared folder holds each text as
unit numbers, and the rare words with their counts.  Units' counts travel to the
tasks; those of rarer words, of which none can be hot, are joined.

Smoothing: emissions (c + 1) / (n + v + 1), with c the word's and n the class's
tokens and v its distinct words, the 1 for a word unseen; transitions are drawn
towards the class's share with ``KAPPA`` counts.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import documents_only, store, text_slices

CLASSES, ROUNDS, KAPPA = 64, 3, 50.0
ENDINGS, WORD_SHARE = 1 << 10, 1 << 18
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000
END = b""  # the end token; no word is empty


def held_out(doc_id: str = "doc_id") -> "F.Column":
    """Rows that are not learned from; a null doc_id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


def tokens(raw: bytes) -> list[bytes]:
    return [*raw.lower().split(), END]


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over the rows that are learned from."""
    def run(batches):
        seen: Counter = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        for _, raw in text_slices(batches, "text"):
            for t in raw:
                seen.update(tokens(t))
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    learned = docs.where(~held_out()).select("text")
    return learned.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units:
    """Word -> unit: a frequent word's own, else that of its ending."""

    def __init__(self, frequent: list[bytes]):
        self.own = {w: i for i, w in enumerate(frequent)}
        self.size = len(frequent) + ENDINGS

    @property
    def kind(self) -> str:
        """How a unit's number is stored."""
        return "<u2" if self.size <= 1 << 16 else "<u4"

    def __call__(self, word: bytes) -> int:
        i = self.own.get(word)
        return len(self.own) + xxhash.xxh32_intdigest(word[-3:]) % ENDINGS if i is None else i


def encode(docs: DataFrame, units: Units, frequent: dict[bytes, int], least: int) -> DataFrame:
    """doc_id, held_out, units (binary, 16 or 32 bits each), log_counts and n_known of
    the frequent words, rare (words of fewer than ``least`` tokens, with how
    often they occur).  Frequent words that were never seen cannot be."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                           T.StructField("units", T.BinaryType()), T.StructField("log_counts", T.DoubleType()),
                           T.StructField("n_known", T.LongType()),
                           T.StructField("rare", T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.IntegerType())])))])

    def run(batches):
        logs = {w: np.log10(n + 1) for w, n in frequent.items()}
        own = {w: (units(w), logs[w]) for w in logs}
        ending: dict[bytes, int] = {}
        for batch, raw in text_slices(batches, "text"):
            cells, log_counts, known, offsets, words, times = [], [], [], [0], [], []
            for t in raw:
                line, total, hits, rare = [], 0.0, 0, []
                for w in tokens(t):
                    found = own.get(w)
                    if found is None:
                        tail = w[-3:]
                        if tail not in ending:
                            if len(ending) > COUNTED:
                                ending.clear()
                            ending[tail] = units(w)
                        line.append(ending[tail])
                        rare.append(w)
                    else:
                        line.append(found[0])
                        total += found[1]
                        hits += 1
                cells.append(np.array(line, dtype=units.kind).tobytes())
                log_counts.append(total)
                known.append(hits)
                per = Counter(rare)
                words += per
                times += per.values()
                offsets.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary()), pa.array(log_counts), pa.array(known, pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, schema)


def _lines(batches, kind: str):
    """Unit numbers of the texts of a batch, end to end, and where each begins."""
    for batch in batches:
        raw = batch.column(0).to_pylist()
        at = 0
        while at < len(raw):
            end, size = at, 0
            while end < len(raw) and (end == at or size < 1 << 22):
                size += len(raw[end])
                end += 1
            flat = np.frombuffer(b"".join(raw[at:end]), dtype=kind).astype(np.int64)
            sizes = np.array([len(r) // np.dtype(kind).itemsize for r in raw[at:end]])
            yield batch.slice(at, end - at), flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = end


def neighbours(encoded: DataFrame, kind: str, classes: np.ndarray, n_classes: int) -> DataFrame:
    """``(cell, before, after)``: cell = unit * n_classes + class; how often the
    class stands before and after the unit.  An end stands before each text."""
    size = len(classes) * n_classes

    def run(batches):
        before, after = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for _, unit, first in _lines(batches, kind):
            left = np.concatenate([[0], unit[:-1]])
            left[first] = 0
            before += np.bincount(unit * n_classes + classes[left], minlength=size)
            after += np.bincount(left * n_classes + classes[unit], minlength=size)
        cells = np.flatnonzero(before + after)
        for i in range(0, len(cells), 1 << 16):
            c = cells[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(before[c]), pa.array(after[c])], names=["cell", "before", "after"])

    return (encoded.where(~F.col("held_out")).select("units").mapInArrow(run, "cell int, before long, after long")
            .groupBy("cell").agg(F.sum("before").alias("before"), F.sum("after").alias("after")))


def _gathered(table: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    got = table.toArrow()  # at most units x classes rows
    before, after = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    cell = got.column("cell").to_numpy()
    before[cell], after[cell] = got.column("before").to_numpy(), got.column("after").to_numpy()
    return before, after


def exchange(classes: np.ndarray, before: np.ndarray, after: np.ndarray, n_classes: int) -> np.ndarray:
    """One round: every unit in turn moves to the class of the highest corpus
    log likelihood, sum f(n(c, d)) - 2 sum f(n(c)) with f(x) = x ln x."""
    def f(x):
        return x * np.log(np.maximum(x, 1))

    before, after = before.reshape(-1, n_classes).astype(float), after.reshape(-1, n_classes).astype(float)
    classes = classes.copy()
    pairs = np.zeros((n_classes, n_classes))  # [class before, class after]
    np.add.at(pairs.T, classes, before)
    total = pairs.sum(axis=0)
    weight = before.sum(axis=1)
    for u in np.argsort(-weight, kind="stable"):
        if weight[u] == 0:
            continue
        b, a, c = before[u], after[u], classes[u]
        pairs[:, c] -= b
        pairs[c, :] -= a
        np.maximum(pairs, 0, out=pairs)  # the unit's own neighbours may have moved since they were counted
        total[c] -= weight[u]
        gain = ((f(pairs + b[:, None]) - f(pairs)).sum(axis=0) + (f(pairs + a) - f(pairs)).sum(axis=1)
                - 2 * (f(total + weight[u]) - f(total)))
        best = int(np.argmax(gain))
        classes[u] = best if gain[best] > gain[c] + 1e-9 else c
        c = classes[u]
        pairs[:, c] += b
        pairs[c, :] += a
        total[c] += weight[u]
    return classes


def lm_scores(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probability), perplexity.

    Words are lower-cased in A-Z; a text is its words and one end, so an empty
    or null one is the end alone.  Repeated rows stay and count each; an empty
    table gives none.  With nothing to learn from, all counts are 0 and classes
    equally likely.
    """
    docs = documents_only(docs)
    counts = store(count_words(docs), "words")
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_words = int(sums["n"] or 0), int(sums["v"])
    least = -(-n_train // WORD_SHARE)
    top = counts.where(F.col("n") >= max(least, 1)).toArrow()  # at most WORD_SHARE words
    frequent = dict(zip([bytes(w) for w in top.column("word").to_pylist()], top.column("n").to_pylist()))
    frequent.setdefault(END, 0)
    of_unit = sorted((w for w in frequent if w != END), key=lambda w: (-frequent[w], w))
    units = Units([END, *of_unit])  # the end is unit 0

    encoded = encode(docs, units, {w: n for w, n in frequent.items() if n}, least)
    encoded = store(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")

    def unit_sizes(batches):
        n, v = np.zeros(units.size, dtype=np.int64), np.zeros(units.size, dtype=np.int64)
        for batch in batches:
            unit = np.fromiter((units(w) for w in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            n += np.bincount(unit, batch.column(1).to_numpy(), minlength=units.size).astype(np.int64)
            v += np.bincount(unit, minlength=units.size)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(v[some])], names=["cell", "before", "after"])

    per_unit = (counts.mapInArrow(unit_sizes, "cell long, before long, after long")
                .groupBy("cell").agg(F.sum("before").alias("before"), F.sum("after").alias("after")))
    unit_tokens, unit_words = _gathered(per_unit, units.size)

    classes = np.empty(units.size, dtype=np.int64)
    classes[np.argsort(-unit_tokens, kind="stable")] = np.arange(units.size) % n_classes
    for _ in range(rounds):
        classes = exchange(classes, *_gathered(neighbours(encoded, units.kind, classes, n_classes), units.size * n_classes), n_classes)
    followed, _ = _gathered(neighbours(encoded, units.kind, classes, n_classes), units.size * n_classes)
    pairs = np.zeros((n_classes, n_classes))
    np.add.at(pairs.T, classes, followed.reshape(-1, n_classes))
    class_tokens, class_words = np.bincount(classes, unit_tokens, n_classes), np.bincount(classes, unit_words, n_classes)
    share = (class_tokens + 1) / (class_tokens.sum() + n_classes)
    move = (pairs + KAPPA * share) / (pairs.sum(axis=1, keepdims=True) + KAPPA)
    step = (np.log10(move) - np.log10(class_tokens + class_words + 1)).ravel()

    def score(batches):
        for batch, unit, first in _lines(batches, units.kind):
            c = classes[unit]
            left = np.concatenate([[0], c[:-1]])
            left[first] = classes[0]
            sums_ = np.add.reduceat(step[left * n_classes + c], first)
            sizes = np.diff(np.append(first, len(unit)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums_), pa.array(sizes.astype(np.int64))],
                                             names=["row", "doc_id", "held_out", "log_counts", "n_known", "steps", "n_tokens"])

    scored = encoded.select("units", "row", "doc_id", "held_out", "log_counts", "n_known").mapInArrow(
        score, "row long, doc_id long, held_out boolean, log_counts double, n_known long, steps double, n_tokens long")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    seen = counts.where(F.col("n") < least)
    more = (rare.join(seen, "word").groupBy("row")
            .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_known")))
    logs = F.col("log_counts") + F.coalesce("more_logs", F.lit(0.0))
    total = F.col("steps") + logs
    return scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(n_train + n_words + 1))).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"))
