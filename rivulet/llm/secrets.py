"""Secret scans by corpus-wide ownership frequency.

Patterns give candidates.  The hash of each candidate's value is aggregated
over the corpus by distinct owners, repositories and contexts (the text near
it, so copies of one text count once).  A value that several owners share is a
widely copied example; one that looks like a live credential (length, letters
and digits, entropy, no placeholder) must also have been met in several
contexts, or in more repositories than copies of one text would explain.  Every
other value that looks live is flagged.  DataFrame functions only.

Aggregation runs on hashes with partial distinct counts, so an example in a
third of all rows is no hot group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.bind import let
from rivulet.llm.common import fresh, store
from rivulet.llm.spans import by_start, count_of, described, find, key_of, no_spans, part, pieces_of, replace

KINDS = ["assign", "access", "hex", "live", "example"]
ASSIGN, ACCESS, HEX, LIVE, EXAMPLE = range(5)
#: The base patterns.  Runs are maximal, so the least length can
#: stand in the pattern for access and hex, but not for assign's group 2.
ASSIGN_PATTERN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS_PATTERN = r"AKIA[A-Z0-9]{16,}"
HEX_PATTERN = r"[0-9a-f]{24,}"
#: A value of fewer owners is no example.  One that looks live is an example only
#: with as many contexts or repositories, too.
EXAMPLE_OWNERS, EXAMPLE_CONTEXTS, EXAMPLE_REPOSITORIES = 3, 3, 4
#: Code points on each side of a value that make up its context.
NEAR = 64
LIVE_LENGTH, LIVE_ENTROPY = 12, 3.0
PLACEHOLDERS = r"(?i)example|sample|dummy|changeme|placeholder|your|test|xxxx|1234567|abcdef|(.)\1{5}"


def base_spans(text: Column) -> Column:
    """Base spans of a text that is not null, by start, then kind."""
    def long_enough(s: Column) -> Column:
        return F.length(F.regexp_extract(s["value"], ASSIGN_PATTERN, 2)) >= 6

    found = F.concat(
        F.when(F.regexp_like(text, F.lit("[:=]")), F.filter(find(text, ASSIGN_PATTERN, ASSIGN), long_enough)).otherwise(no_spans()),
        F.when(F.contains(text, F.lit("AKIA")), find(text, ACCESS_PATTERN, ACCESS)).otherwise(no_spans()),
        find(text, HEX_PATTERN, HEX))
    return let(lambda spans: F.when(F.size(spans) > 1, by_start(spans)).otherwise(spans), found)


def may_hold(text: Column) -> Column:
    """True wherever a base pattern matches in a text that is not null (and for
    texts with ``AKIA``); the slow pattern is tried only where ``:`` or ``=`` occurs."""
    assigns = (F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & F.regexp_like(text, F.lit(ASSIGN_PATTERN))
    return assigns | F.contains(text, F.lit("AKIA")) | F.regexp_like(text, F.lit(HEX_PATTERN))


def secret_of(span: Column) -> Column:
    """The span of the credential alone: group 2 of an assignment, else all."""
    value = F.when(span["kind"] == ASSIGN, F.regexp_extract(span["value"], ASSIGN_PATTERN, 2)).otherwise(span["value"])
    return let(lambda v: F.struct((span["end"] - F.length(v)).alias("start"), span["end"].alias("end"), v.alias("value")), value)


def looks_live(value: Column) -> Column:
    def entropy(chars: Column) -> Column:
        n = F.size(chars)
        return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: let(
            lambda p: acc - p * F.log2(p), F.size(F.filter(chars, lambda x: x == c)) / n))

    return ((F.length(value) >= LIVE_LENGTH) & F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Za-z]"))
            & ~F.regexp_like(value, F.lit(PLACEHOLDERS)) & (let(entropy, F.split(value, "")) >= LIVE_ENTROPY))


def _contexts(text: Column, spans: Column) -> Column:
    """For each span a hash of the text on both sides of its credential."""
    def hashes(pieces: Column, size: Column) -> Column:
        def of(s: Column) -> Column:
            return let(lambda c: F.xxhash64(part(pieces, F.greatest(c["start"] - NEAR, F.lit(0)), c["start"]),
                                            part(pieces, c["end"], F.least(c["end"] + NEAR, size))), secret_of(s))
        return F.transform(spans, of)
    return let(hashes, pieces_of(text), F.length(text))


def scanned(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """Stored ``(doc_id, row_key, owner, repository, spans, contexts)`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")

    def held(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name in docs.columns else F.lit("")

    spans = docs.select(doc_id.alias("doc_id"), text.alias("text"), held(owner).alias("owner"),
                        F.xxhash64(*[held(c) for c in repository]).alias("repository"), base_spans(text).alias("spans"))
    contexts = F.when(F.size("spans") > 0, let(_contexts, F.col("text"), F.col("spans"))).otherwise(F.array().cast("array<bigint>"))
    return store(spans.select("doc_id", key_of(F.col("doc_id"), F.col("text")).alias("row_key"), "owner", "repository", "spans",
                              contexts.alias("contexts")), "secret-spans")


def judged(found: DataFrame) -> DataFrame:
    """``(doc_id, row_key, added)``: spans of live and example values, for the
    rows that have any.  The verdict hangs on the value's hash alone."""
    each = (found.where(F.size("spans") > 0)
            .select("doc_id", "row_key", "owner", "repository", F.explode(F.arrays_zip("spans", "contexts")).alias("s"))
            .select("doc_id", "row_key", "owner", "repository", F.col("s.contexts").alias("context"), secret_of(F.col("s.spans")).alias("c"))
            .select("*", F.sha2(F.col("c.value").cast("binary"), 256).alias("hash")))
    each = store(each.select("doc_id", "row_key", "owner", "repository", "context", "hash", "c.start", "c.end",
                             looks_live(F.col("c.value")).alias("live")), "secrets")
    owned = each.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("owner", "repository").alias("repositories"),
                                     F.count_distinct("context").alias("contexts"))
    copied = (F.col("contexts") >= EXAMPLE_CONTEXTS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    kind = F.when((F.col("owners") >= EXAMPLE_OWNERS) & (~F.col("live") | copied), EXAMPLE).when(F.col("live"), LIVE)
    span = F.struct(kind.alias("kind"), "start", "end", F.lit("").alias("value"))
    return (each.join(owned, "hash").where(kind.isNotNull()).groupBy("doc_id", "row_key")
            .agg(F.collect_set(span).alias("added")))


def secret_scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (base, live and example ones by start, then kind), n_live, n_example.

    Null texts are empty and have none; a missing or null owner is one owner of
    its own.  Repeated rows give repeated rows; an empty table gives none.
    """
    found = scanned(docs, owner, list(repository))
    added = judged(found).withColumnRenamed("doc_id", "a_id").withColumnRenamed("row_key", "a_key")
    rows = found.join(added, F.expr("row_key = a_key and doc_id <=> a_id"), "left")
    every = by_start(F.concat("spans", F.coalesce("added", no_spans())))
    return rows.select("doc_id", count_of(F.col("spans"), ASSIGN).alias("n_assign"),
                       count_of(F.col("spans"), ACCESS).alias("n_access"), count_of(F.col("spans"), HEX).alias("n_hex"),
                       F.sha2(described(F.col("spans"), KINDS).cast("binary"), 256).alias("base_sha256"),
                       F.when(F.col("added").isNull(), described(F.col("spans"), KINDS))
                       .otherwise(described(every, KINDS)).alias("spans"),
                       count_of(F.coalesce("added", no_spans()), LIVE).alias("n_live"),
                       count_of(F.coalesce("added", no_spans()), EXAMPLE).alias("n_example"))


def redact_live(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """All rows and columns of ``docs``; live credentials in the text become
    ``[SECRET]``, examples stay.  A row without any is unchanged."""
    live = (judged(scanned(docs, owner, list(repository)))
            .select("doc_id", "row_key", F.filter("added", lambda s: s["kind"] == LIVE).alias("live")).where(F.size("live") > 0)
            .select("doc_id", "row_key", F.array_sort(F.transform("live", lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), F.lit("[SECRET]").alias("mask")))).alias("masks")))
    a_id, a_key, masks = fresh(docs, "a_id"), fresh(docs, "a_key"), fresh(docs, "masks")
    live = live.toDF(a_id, a_key, masks)
    # only texts that can hold a credential are dealt out for the join
    may = may_hold(F.coalesce(F.col("text").cast("string"), F.lit("")))
    some = docs.where(may)
    joined = some.join(live, (key_of(F.col("doc_id").cast("long"), F.col("text").cast("string")) == F.col(a_key))
                       & F.col("doc_id").cast("long").eqNullSafe(F.col(a_id)), "left")
    text = F.when(F.col(masks).isNotNull(), replace(F.col("text"), F.col(masks))).otherwise(F.col("text"))
    masked = joined.select(*[text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~may).unionByName(masked)
