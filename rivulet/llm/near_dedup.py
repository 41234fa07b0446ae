"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``r`` bits (r even) have a common
neighbour within r/2 bits of both.  So every distinct fingerprint emits its
ball of radius r/2 (65 variants for r = 2), the variants are shuffled, and
fingerprints that meet on a variant are linked.  All members of a variant's
bucket lie within r of one another, so linking each to the next in order keeps
the components; a bucket holds at most as many fingerprints as a ball, however
many documents there are.  Linked pairs are deduplicated and their distance is
verified before components are built.

Equal fingerprints are collapsed before the balls are emitted, so a group of
copies, however large, costs one ball.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import documents_only, fresh, store, with_text_columns
from rivulet.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42


def _hashes(raw: bytes, k: int) -> bytes:
    """Big-endian XXH64 of every k-word shingle of a text, end to end."""
    words = raw.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:len(words) - k].tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[s:e], SEED) for s, e in zip(starts, (ends[k - 1:] - 1).tolist())])


def simhash(texts: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half the shingle
    hashes (repeats count); a text without words has fingerprint zero."""
    packed = [_hashes(t, k) for t in texts]
    counts = np.array([len(p) // 8 for p in packed])
    out = np.zeros((len(texts), 8), dtype=np.uint8)
    full = np.flatnonzero(counts)
    # bits of a few documents at a time: 64 bytes a shingle
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + counts[full[end]] <= 1 << 17):
            size += counts[full[end]]
            end += 1
        rows = full[at:end]
        sums = np.zeros((len(rows), 64), dtype=np.int64)
        if end - at == 1:  # one text, perhaps a very long one
            data = np.frombuffer(packed[rows[0]], dtype=np.uint8).reshape(-1, 8)
            for i in range(0, len(data), 1 << 17):
                sums[0] += np.unpackbits(data[i:i + (1 << 17)], axis=1).sum(axis=0, dtype=np.int64)
        else:
            data = np.frombuffer(b"".join([packed[r] for r in rows]), dtype=np.uint8).reshape(-1, 8)
            first = np.concatenate([[0], np.cumsum(counts[rows])[:-1]])
            sums[:] = np.add.reduceat(np.unpackbits(data, axis=1), first, axis=0, dtype=np.int32)
        out[rows] = np.packbits(sums * 2 > counts[rows][:, None], axis=1)
        at = end
    return out.view(">u8").ravel().astype(np.uint64)


def with_fingerprint(docs: DataFrame, column: str, k: int = SHINGLE_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` plus the fingerprint as a signed long."""
    def factory():
        return lambda raw: [pa.array(simhash(raw, k).view(np.int64))]
    return with_text_columns(docs, "text", [T.StructField(column, T.LongType())], factory)


def ball(distance: int) -> list[int]:
    """Masks of at most ``distance`` bits, as signed longs."""
    masks = [sum(1 << b for b in c) for n in range(distance + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_edges(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> verified links ``(a, b)``, a < b, whose
    components are those of all pairs within ``max_distance`` bits."""
    if max_distance % 2 or not 0 <= max_distance <= 4:
        raise ValueError("max_distance must be 0, 2 or 4")
    from pyspark.sql import Window

    masks = F.lit(ball(max_distance // 2))
    met = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return (met.select(before.alias("a"), F.col("fp").alias("b")).where("a is not null").distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance))


def components_of(printed: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``(doc_id, fp)`` -> ``(fp, component_id)``, one row for each fingerprint;
    component_id is the smallest doc_id reachable (null if all are null)."""
    prints = store(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    linked = connected_components(ball_edges(prints.select("fp"), max_distance))
    named = prints.join(linked.withColumnRenamed("id", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null text is empty; an empty text has fingerprint zero and links like any
    other.  Repeated rows give repeated rows.  A null doc_id never becomes a
    component_id unless its component has no other.  An empty table gives none.
    """
    printed = store(with_fingerprint(documents_only(docs), "fp", k).select("doc_id", "fp"), "fingerprints")
    return printed.join(components_of(printed, max_distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, k: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that represent their component, all columns: the one
    with the smallest doc_id.  Where that doc_id has several rows, the smallest
    row of those with the component's smallest fingerprint stays."""
    printed = store(with_fingerprint(documents_only(docs), "fp", k).groupBy("doc_id", "fp")
                    .agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    per_print = components_of(printed, max_distance)
    kept = (printed.join(per_print, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("doc_id", "component_id").agg(F.min(F.struct("fp", "n")).alias("rep"), F.count(F.lit(1)).alias("prints")))
    # a doc_id can stand for several components only if it is null
    kept = store(kept.select(F.col("doc_id").alias("id_k"), F.col("rep.fp").alias("fp_k"),
                             ((F.col("prints") > 1) | (F.col("rep.n") > 1)).alias("several")), "kept")
    fp, names = fresh(docs, "fp"), docs.columns
    singles = docs.join(kept.where("not several").select("id_k"),
                        docs["doc_id"].cast("long").eqNullSafe(F.col("id_k")), "left_semi")
    several = kept.where("several")
    if several.isEmpty():
        return singles
    ambiguous = docs.join(several.select("id_k").distinct(), docs["doc_id"].cast("long").eqNullSafe(F.col("id_k")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    printed_rows = with_fingerprint(ambiguous, fp, k).select(F.col("doc_id").cast("long").alias("id_k"),
                                                             F.col(fp).alias("fp_k"), row.alias("row"))
    one = (printed_rows.groupBy("id_k", "fp_k").agg(F.min("row").alias("row")).alias("r")
           .join(several.alias("s"), F.expr("r.id_k <=> s.id_k and r.fp_k = s.fp_k"), "left_semi"))
    return singles.unionByName(one.select("row.*"))
