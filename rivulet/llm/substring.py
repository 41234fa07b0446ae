"""Substring dedup over sliding sentence spans.

A text is cut in sentences.  A span is a run of consecutive sentences: from
each sentence on the shortest run of at least ``MIN_SENTENCES`` sentences and
``MIN_WORDS`` words, so runs of very short sentences grow until they say
something.  A text of fewer sentences, but that many words, is one span as a
whole.  Equal passages have equal spans wherever they stand.  Every span is
hashed (96 bits); hashes are joined over the corpus; the first occurrence, in
the order of doc_id and then of place, stays, and every sentence that another
occurrence covers is removed.

Repeats inside one text are found where the text is cut.  Across texts, a
hash's least doc_id and greatest doc_id are partial aggregates, so a passage
that a third of all documents share is no hot group; only hashes with two
doc_ids are joined back, one row a hash, which leaves Spark free to split the
other side.
"""
from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import store, with_text_columns
from rivulet.llm.spans import key_of

MIN_SENTENCES, MIN_WORDS = 2, 12
#: Where the order of texts without a doc_id begins; doc_ids are below.
NO_ID = 1 << 62
#: A sentence with the white space after it.
SENTENCE = re.compile(rb"\s*(?:[^.!?\n]++|[.!?](?!\s|$))*+(?:[.!?]+|\n|$)\s*")


def sentences(raw: bytes) -> list[bytes]:
    """Pieces that make up the text, each a sentence and what separates it."""
    return [m for m in SENTENCE.findall(raw) if m]


def spans(pieces: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(hash, second hash, first sentence, end) of every span, by place."""
    words = [p.split() for p in pieces]
    plain = [b" ".join(w) for w in words]
    sizes = [len(w) for w in words]
    least = min(MIN_SENTENCES, len(pieces))
    out, end, n = [], 0, 0
    for i in range(len(pieces)):
        if i:
            n -= sizes[i - 1]
        while end < len(pieces) and (end - i < least or n < MIN_WORDS):
            n += sizes[end]
            end += 1
        if end - i < least or n < MIN_WORDS:
            break
        digest = xxhash.xxh3_128_intdigest(b"\n".join(plain[i:end]))
        out.append(((digest & (1 << 64) - 1) - (1 << 63), (digest >> 64 & (1 << 32) - 1) - (1 << 31), i, end))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType()),
                                  T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("again", T.BooleanType())]))


def _with_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, s)``, a row for each span; ``again``: it occurred
    before in the same text."""
    def cut(raw: list[bytes]) -> list[pa.Array]:
        offsets, h, g, start, end, again = [0], [], [], [], [], []
        for t in raw:
            seen = set()
            for a, b, i, j in spans(sentences(t)):
                h.append(a)
                g.append(b)
                start.append(i)
                end.append(j)
                again.append((a, b) in seen)
                seen.add((a, b))
            offsets.append(len(h))
        values = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(g, pa.int32()), pa.array(start, pa.int32()),
                                             pa.array(end, pa.int32()), pa.array(again, pa.bool_())],
                                            names=["h", "g", "start", "end", "again"])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)]

    cut_up = with_text_columns(docs, "text", [T.StructField("spans", _SPAN)], lambda: cut)
    return cut_up.select("doc_id", "row_key", F.explode("spans").alias("s")).select("doc_id", "row_key", "s.*")


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), key_of(doc_id, text).alias("row_key"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, row_key, start, end, first_doc)`` of every non-first repeated
    span.  Texts without a doc_id come last, in the order of their row_key, each
    a document of its own."""
    last = F.lit(NO_ID).cast("bigint")
    each = _with_spans(_keyed(docs))
    order = F.coalesce(F.col("doc_id"), last + F.col("row_key").bitwiseAND(F.lit(NO_ID - 1)))
    global_ = each.where("not again").select("h", "g", order.alias("o"))
    shared = (global_.groupBy("h", "g").agg(F.min("o").alias("first"), F.max("o").alias("latest"))
              .where("first < latest").select("h", "g", "first"))
    shared = store(shared, "shared-spans")
    across = (each.join(shared, ["h", "g"]).where(order > F.col("first"))
              .select("doc_id", "row_key", "start", "end", F.when(F.col("first") < last, F.col("first")).alias("first_doc")))
    within = each.where("again").select("doc_id", "row_key", "start", "end", F.col("doc_id").alias("first_doc"))
    return across.union(within)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """One row for every document that loses a sentence: doc_id, n_sentences,
    n_removed, first_doc_ids (where the first occurrences stand), text (what is
    left, the remaining pieces as they were).

    Null and empty texts lose nothing.  Rows with one doc_id and text are one
    document; different texts of one doc_id do not take from each other.  Texts
    without a doc_id are documents of their own after all others; a first one
    among them is in no ``first_doc_ids``.
    """
    found = repeated_spans(docs)
    per_row = (found.groupBy("doc_id", "row_key", "start", "end").agg(F.min("first_doc").alias("first_doc"))
               .groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("start", "end")).alias("covered"),
                                                 F.array_sort(F.collect_set("first_doc")).alias("first_doc_ids")))
    hit = store(per_row, "covered").toDF("h_id", "h_key", "covered", "first_doc_ids")
    rows = (_keyed(docs).join(hit, F.expr("row_key = h_key and doc_id <=> h_id"))
            .select("doc_id", "row_key", "text", "covered", "first_doc_ids").dropDuplicates(["doc_id", "row_key"]))
    schema = "doc_id long, n_sentences long, n_removed long, first_doc_ids array<long>, text string"

    def remove(batches):
        for batch in batches:
            out = {"doc_id": batch.column(0), "n_sentences": [], "n_removed": [], "first_doc_ids": batch.column(4), "text": []}
            for text, covered in zip(batch.column(2), batch.column(3)):
                pieces = sentences((text.as_py() or "").encode())
                gone = bytearray(len(pieces))
                for s in covered.as_py():
                    gone[s["start"]:s["end"]] = b"\1" * (s["end"] - s["start"])
                out["n_sentences"].append(len(pieces))
                out["n_removed"].append(sum(gone))
                out["text"].append(b"".join(p for p, g in zip(pieces, gone) if not g).decode())
            out["n_sentences"], out["n_removed"] = pa.array(out["n_sentences"], pa.int64()), pa.array(out["n_removed"], pa.int64())
            out["text"] = pa.array(out["text"], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows.mapInArrow(remove, schema)
