"""Filter interaction audit: what each filter removes in every order.

Each document is judged by all filters at once; which fail is a number of five
bits, and a truth table turns it into a 32-bit word: bit S is set if the
document survives the subset S of filters.  Words are added up by carry-save
adders (three words of one weight become a word of that weight and a carry of
twice the weight), so all 32 subsets are counted by bitwise operations.  From
the survivors of the subsets, in each part and for each label, every order of
the filters follows by subtraction.

Copies are found by a digest of the whole text.  Its least doc_id comes from
partial aggregates, by digest and salt and then by digest, and goes back to
(digest, salt), so a text that a third of all documents share is dealt out over
``SALTS`` groups.  Texts themselves are never shuffled.
"""
from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import store, text_slices

FILTERS = "ABCDE"
#: Filter E by its bit; A to D are the bits below.
COPY = 16
ALL = 31
#: Groups over which the documents of one text are dealt out.
SALTS = 32
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Of the documents that fail the filters of the index: the subsets they survive.
WORDS = np.array([sum(1 << s for s in range(32) if not s & fails) for fails in range(32)], np.uint32)


def fails(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = raw.split()  # at the six ASCII white-space characters, for bytes
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return ((len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * capitals > 5 * len(raw.decode())) << 2 | (MARKS.search(raw) is not None) << 3)


def survivors(words: np.ndarray) -> np.ndarray:
    """How many words have each bit, by carry-save adders."""
    total, weight = np.zeros(32, np.int64), 0
    while len(words):
        carries = [np.zeros(0, np.uint32)]
        while len(words) > 2:
            third = len(words) // 3
            x, y, z = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = x ^ y
            carries.append(x & y | half & z)
            words = np.concatenate([half ^ z, words[3 * third:]])
        total += (words[:, None] >> np.arange(32, dtype=np.uint32) & 1).sum(0, dtype=np.int64) << weight
        words, weight = np.concatenate(carries), weight + 1
    return total


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails of A to D, and a digest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([fails(r) for r in raw], pa.int32()),
                 pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())],
                names=["doc_id", "part", "fails", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def _with_copies(judged: DataFrame) -> DataFrame:
    """The judged documents with the bit of the copy filter."""
    salted = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    some = salted.where("doc_id IS NOT NULL").groupBy("digest", "salt") \
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"))
    shared = some.groupBy("digest").agg(F.min("least").alias("first"), F.max("greatest").alias("last")).where("first < last")
    firsts = some.select("digest", "salt").join(shared.select("digest", "first"), "digest")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(COPY)).otherwise(F.lit(0))
    return salted.join(firsts, ["digest", "salt"], "left").withColumn("fails", F.col("fails").bitwiseOR(copy))


def _labelled(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails and whether a label says good or toxic."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"),
                          (F.col("toxic") == 1).alias("toxic")).where("doc_id IS NOT NULL AND (good OR toxic)") \
        .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).withColumn("spread", F.lit(0))
    # documents without a doc_id meet no label: they are spread, not sent to one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = judged.withColumn("spread", spread).join(marks, ["doc_id", "spread"], "left")
    return rows.select("part", "fails", F.coalesce("good", F.lit(False)).alias("good"),
                       F.coalesce("toxic", F.lit(False)).alias("toxic"))


def subset_survivors(labelled: DataFrame) -> DataFrame:
    """For each part the survivors of every subset of filters: arrays of 32
    counts, of all documents and of those labelled good and toxic."""
    kinds = ("total", "good", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            part = parts.indices.to_numpy()
            good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            words = WORDS[batch.column(1).to_numpy()]
            counts = np.zeros((len(parts.dictionary), 3, 32), np.int64)
            order = np.argsort(part, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                if len(at):
                    w = words[at]
                    counts[part[at[0]]] = [survivors(w), survivors(w[good[at]]), survivors(w[toxic[at]])]
            yield pa.RecordBatch.from_arrays(
                [parts.dictionary, *[pa.array(counts[:, i].tolist(), pa.list_(pa.int64())) for i in range(3)]],
                names=["part", *kinds])

    partial = labelled.select("part", "fails", "good", "toxic") \
        .mapInArrow(run, "part string, " + ", ".join(f"{k} array<long>" for k in kinds))
    return partial.groupBy("part").agg(*[F.array(*[F.sum(F.col(k)[s]) for s in range(32)]).alias(k) for k in kinds])


def _orders() -> Column:
    """Every step of every order: its filter and the subset before it."""
    steps = [{"filter_order": "".join(order), "step": k + 1, "filter": FILTERS.index(f),
              "before": sum(1 << FILTERS.index(x) for x in order[:k])}
             for order in permutations(FILTERS) for k, f in enumerate(order)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")


def _shapley(total: Column, bit: int) -> Column:
    """What a filter removes, over all orders: each subset before it stands for
    the orders of its own filters times those of the filters after."""
    weight = {s: math.factorial(s.bit_count()) * math.factorial(4 - s.bit_count()) for s in range(32) if not s & bit}
    return sum((F.lit(w) * (total[s] - total[s | bit]) for s, w in weight.items()), F.lit(0).cast("long"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley: a row per part, order of the five filters
    and step.

    A null text is empty (it fails A alone, and E beside another empty text); a
    null source is the part ''.  A document without a doc_id is no copy, makes
    none and has no label; rows of one doc_id and text are copies of other
    doc_ids only.  Of several label rows of a doc_id any 1 counts; null labels
    count as 0.  Other columns take no part; no documents give no rows.
    """
    judged = store(_judged(docs), "judged")
    counts = subset_survivors(_labelled(_with_copies(judged), labels))
    rows = counts.select("part", "total", "good", "toxic",
                         F.array(*[_shapley(F.col("total"), 1 << i) for i in range(5)]).alias("values"),
                         F.explode(_orders()).alias("at"))
    bit, before = F.expr("shiftleft(1, at.filter)"), F.col("at.before")
    lost = {k: F.get(k, before) - F.get(k, before.bitwiseOR(bit)) for k in ("total", "good", "toxic")}
    fails_it = F.get("total", F.lit(0)) - F.get("total", bit)
    return rows.select(
        "part", "at.filter_order", "at.step", F.get("total", before.bitwiseOR(bit)).alias("kept"), lost["total"].alias("removed"),
        (fails_it - lost["total"]).alias("redundant"),
        (F.get("total", F.lit(ALL).bitwiseXOR(bit)) - F.get("total", F.lit(ALL))).alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), F.get("values", F.col("at.filter")).alias("shapley"))
