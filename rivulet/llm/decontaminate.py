"""Benchmark decontamination: SimHash of item-sized windows.

For every benchmark item, windows of the item's size in words are taken from
the documents.  Windows and items get 128-bit SimHash fingerprints of their
weighted word shingles (weight: how often a shingle occurs).  The bits are cut
in ``RADIUS + 1`` blocks; two fingerprints within the radius agree in at least
one block, so an equi-join on (size, block, value) finds, of all items of that
size, every one within the radius.  Pairs found are verified by exact
weighted-shingle similarity (sum of the lesser weights over sum of the greater).

Which windows can matter is decided first, without loss: a window of w shingles
that is similar to an item of m shares ``s / (1 + s) * (m + w)`` shingles with
it at least.  So windows are laid at every start, and only there, from where
that many shingles stand in items of that size.  Fingerprinting all windows of
all sizes would cost 128 counters a word and size.

The radius is wide for the similarity: at 0.8 two fingerprints differ in about
19 of 128 bits (angle of a cosine of 0.89, deviation 4), in more than 45 less
than once in ten million.  Blocks of two or three bits follow from that: they
keep the guarantee, but let most windows meet most items of their size.
DataFrame functions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.bind import let
from rivulet.llm.common import fresh, store
from rivulet.llm.spans import key_of

SHINGLE_WORDS, SIMILARITY, RADIUS = 5, 0.8, 45
WORD_PATTERN = r"[\p{L}\p{N}]+"
#: Up to so many rows the benchmark's side of a join is broadcast (each has a
#: few dozen bytes); beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def _shingle_hashes(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(
        *[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: Column) -> Column:
    """Shingles as texts, for words at least k long."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))


def _lanes(shingle_hash: Column) -> list[Column]:
    """The bits of a hash, three to a long, 21 bits apart: sums of such longs
    count 63 bits at once, of up to two million shingles."""
    three, spread, mask = (F.lit(x).cast("bigint") for x in (7, 1 | 1 << 20 | 1 << 40, 1 | 1 << 21 | 1 << 42))
    return [(F.shiftrightunsigned(shingle_hash, b).bitwiseAND(three) * spread).bitwiseAND(mask) for b in range(0, 64, 3)]


def fingerprints(rows: DataFrame, keys: list[str], shingles: Column) -> DataFrame:
    """``keys`` and ``w_print`` of every row, which its keys tell apart: two
    longs, 128 bits; a bit is 1 if it is set in over half the shingles' hashes."""
    hashed = rows.select(*keys, F.explode(shingles).alias("s")).select(*keys, *[F.xxhash64("s", F.lit(half)).alias(f"h{half}") for half in (0, 1)])
    sums = [F.sum(lane).alias(f"c{half}_{i}") for half in (0, 1) for i, lane in enumerate(_lanes(F.col(f"h{half}")))]
    counted = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *sums)

    def word(half: int) -> Column:
        out = F.lit(0).cast("bigint")
        for b in range(64):
            ones = F.shiftrightunsigned(F.col(f"c{half}_{b // 3}"), b % 3 * 21).bitwiseAND(F.lit((1 << 21) - 1).cast("bigint"))
            bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")
            out = out.bitwiseOR(F.when(ones * 2 > F.col("total"), bit).otherwise(F.lit(0).cast("bigint")))
        return out
    return counted.select(*keys, F.array(word(0), word(1)).alias("w_print"))


def blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """The bits in radius + 1 blocks, half of them from each long."""
    each = (radius + 2) // 2
    edges = [64 * i // each for i in range(each + 1)]
    return F.array(*[F.shiftrightunsigned(fingerprint[half], a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
                     for half in (0, 1) for a, b in zip(edges, edges[1:])])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def _numbered(shingles: Column) -> Column:
    """Shingles with their occurrence number, so that sets keep the counts."""
    def number(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.concat_ws("\n", x, F.size(F.filter(F.slice(s, 1, i), lambda y: y == x)).cast("string")))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.concat(x, F.lit("\n0")))) \
        .otherwise(let(number, shingles))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two shingle lists; the weight is the count."""
    def of(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return both / (F.size(x) + F.size(y) - both)
    return let(of, _numbered(a), _numbered(b))


def prepare_items(benchmark: DataFrame) -> DataFrame:
    """Stored items: item_id, item_key, words, n, k (shingle size), shingles,
    fingerprint.  Items without a word are never found; repeated rows are one."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")) \
        .where(F.size("words") > 0).withColumn("item_key", F.xxhash64("item_id", "words")).dropDuplicates(["item_id", "item_key"])
    n = F.size("words")
    shaped = words.select("item_id", "item_key", "words", n.alias("n"), F.least(n, F.lit(SHINGLE_WORDS)).alias("k"))
    shingled = store(shaped.withColumn("shingles", _shingles(F.col("words"), F.col("k"))), "benchmark-shingles")
    prints = fingerprints(shingled.withColumn("i_id", F.col("item_id")), ["i_id", "item_key"], F.col("shingles")) \
        .withColumnsRenamed({"w_print": "fingerprint", "item_key": "i_key"})
    return store(shingled.join(prints, F.expr("item_key = i_key and item_id <=> i_id")).drop("i_id", "i_key"), "benchmark")


def item_shingles(items: DataFrame) -> DataFrame:
    """Stored ``(hash, k, n)``: which shingles stand in items of which size."""
    placed = None
    for k in range(1, SHINGLE_WORDS + 1):
        part = items.where(F.col("k") == k).select("n", "k", F.explode(_shingle_hashes(F.col("words"), k)).alias("hash"))
        placed = part if placed is None else placed.union(part)
    return store(placed.distinct(), "item-shingles")


def _starts(at: Column, least: float) -> Column:
    """Ranges (first, last) of window starts with enough of the places ``at``,
    sorted, inside: those whose first place is ``at[i]`` and that reach the
    place ``need - 1`` further on.  Ranges do not overlap."""
    w = F.least("n", "w_len") - F.col("k") + 1
    need = F.greatest(F.lit(1), F.ceil(F.lit(least / (1 + least)) * (F.col("n") - F.col("k") + 1 + w) - 1e-9).cast("int"))
    end = F.greatest(F.col("w_len") - F.col("n"), F.lit(0))

    def ranges(at: Column, need: Column, w: Column, end: Column) -> Column:
        def of(p: Column, i: Column) -> Column:
            first = F.greatest(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.get(at, i + need - 1) - w + 1, F.lit(0))
            enough = i + need <= F.size(at)
            return F.struct(F.when(enough, first).otherwise(p + 1).alias("first"), F.least(p, end).alias("last"))
        return F.filter(F.transform(at, of), lambda r: r["first"] <= r["last"])
    return let(ranges, at, need, w, end)


def _bounded(side: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def leaked_windows(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Verified windows: doc_id, row_key, item_id, start (word), n (words),
    distance (bits), similarity."""
    items = prepare_items(benchmark)
    known = item_shingles(items)
    n_items, n_known = items.count(), known.count()
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most SHINGLE_WORDS values
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    worded = docs.select(doc_id.alias("doc_id"), key_of(doc_id, text).alias("row_key"), words_of(text).alias("words"))
    keys = ["doc_id", "row_key", "w_len"]

    def placed_of(words: Column, k: int) -> Column:
        return F.transform(_shingle_hashes(words, k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), h.alias("hash")))

    def placed(words: Column) -> Column:
        return F.struct(F.size(words).alias("w_len"), F.concat(*[placed_of(words, k) for k in sizes]).alias("all"))

    if sizes:
        each = worded.select("doc_id", "row_key", let(placed, F.col("words")).alias("p")) \
            .select("doc_id", "row_key", F.col("p.w_len").alias("w_len"), F.explode("p.all").alias("p")).select(*keys, "p.k", "p.at", "p.hash")
    else:
        each = worded.select("doc_id", "row_key", *[F.lit(0).alias(c) for c in ("w_len", "k", "at")], F.lit(0).cast("bigint").alias("hash")).limit(0)
    hit = each.join(_bounded(known, n_known), ["hash", "k"]).groupBy(*keys, "n", "k").agg(F.sort_array(F.collect_set("at")).alias("at"))
    ranges = hit.select(*keys, F.struct("n", "k", _starts(F.col("at"), least).alias("starts")).alias("hit")).where(F.size("hit.starts") > 0)
    per_row = store(ranges.groupBy("doc_id", "row_key").agg(F.collect_list("hit").alias("hits")), "hits")
    # texts are read again only for rows with a window
    few = per_row.withColumnRenamed("doc_id", "h_id").withColumnRenamed("row_key", "h_key")
    again = docs.select(doc_id.alias("doc_id"), key_of(doc_id, text).alias("row_key"), text.alias("text"))
    found = (again.join(few, F.expr("row_key = h_key and doc_id <=> h_id")).dropDuplicates(["doc_id", "row_key"])
             .select("doc_id", "row_key", words_of(F.col("text")).alias("words"), "hits"))

    def windows(words: Column, hits: Column) -> Column:
        def of(h: Column) -> Column:
            starts = F.flatten(F.transform(h["starts"], lambda r: F.sequence(r["first"], r["last"])))
            return F.transform(starts, lambda s: F.struct(h["n"].alias("n"), h["k"].alias("k"), s.alias("start"), F.slice(words, s + 1, h["n"]).alias("window")))
        return F.flatten(F.transform(hits, of))

    laid = store(found.select("doc_id", "row_key", F.explode(let(windows, F.col("words"), F.col("hits"))).alias("w"))
                 .select("doc_id", "row_key", "w.*"), "windows")
    window_keys = ["doc_id", "row_key", "n", "start"]
    printed = fingerprints(laid, window_keys, _shingles(F.col("window"), F.col("k")))
    block = items.select(F.col("item_key").alias("i_key"), F.col("item_id").alias("i_id"), F.col("n").alias("i_n"), "fingerprint",
                         F.posexplode(blocks(F.col("fingerprint"), radius)).alias("i_block", "i_value"))
    met = printed.select("*", F.posexplode(blocks(F.col("w_print"), radius)).alias("block", "value")) \
        .join(_bounded(block, n_items * (radius + 1)), F.expr("n = i_n and block = i_block and value = i_value"))
    first = F.array_position(F.zip_with(blocks(F.col("w_print"), radius), blocks(F.col("fingerprint"), radius), lambda a, b: a == b), F.lit(True)) - 1
    differing = distance(F.col("w_print"), F.col("fingerprint"))
    near = met.where(differing <= radius).where(F.col("block") == first)  # a pair meets in several blocks; the first one counts
    near = store(near.select(F.col("doc_id").alias("d_id"), F.col("row_key").alias("d_key"), F.col("n").alias("d_n"), F.col("start").alias("d_start"),
                             "i_key", "i_id", differing.alias("distance")), "near-windows")
    return (laid.join(near, F.expr("row_key = d_key and n = d_n and start = d_start and doc_id <=> d_id"))
            .join(_bounded(items.select("item_id", "item_key", "shingles"), n_items), F.expr("item_key = i_key and item_id <=> i_id"))
            .select("doc_id", "row_key", "item_id", "start", "n", "distance",
                    similarity(_shingles(F.col("window"), F.col("k")), F.col("shingles")).alias("similarity"))
            .where(F.col("similarity") >= least - 1e-12))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for every document and item it holds: doc_id, item_id,
    similarity and start_word of the most similar window, n_words, n_windows.

    Null and empty texts hold nothing.  Rows with one doc_id and text count as
    one; several texts of a doc_id are taken together.  Empty tables give none.
    """
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best")
    return (leaked_windows(docs, benchmark).groupBy("doc_id", "item_id").agg(best, F.count(F.lit(1)).alias("n_windows"))
            .select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start_word"),
                    F.col("best.n").alias("n_words"), "n_windows"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns."""
    a, b = fresh(docs, "leak_id"), fresh(docs, "leak_key")
    found = store(leaked_windows(docs, benchmark).select("doc_id", "row_key").distinct(), "leaking").toDF(a, b)
    doc_id = docs["doc_id"].cast("long")
    return docs.join(found, (key_of(doc_id, docs["text"].cast("string")) == F.col(b)) & doc_id.eqNullSafe(F.col(a)), "left_anti")
