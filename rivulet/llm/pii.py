"""Personal data: patterns, and information-theoretic sanitisation of terms.

Patterns find the protected entities.  Words near an entity can give it away,
so the corpus tells how much each reveals: from the numbers of documents with
term t, with entity e, and with both near each other, the pointwise mutual
information of t and e is set against the entity's information content
log2(N / df(e)).  The share is 1 for a term that occurs nowhere else.  Terms
from ``GENERALISE`` on are generalised, from ``REMOVE`` on removed, near the
entity they reveal.  Every pair is estimated.  What few contexts say is smoothed:
the ratio of a pair's documents to those expected by chance is drawn towards 1
with the weight of ``PRIOR`` contexts; copies of one text are one context.

DataFrame functions only.  Entities are hashed before they are counted; counts
are partial sums, so a frequent entity or word is no hot group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.functions.bind import let
from rivulet.llm.common import fresh, store
from rivulet.llm.spans import by_start, count_of, described, find, key_of, no_spans, part, pieces_of, replace

KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL, IP, CARD, PHONE, TERM = range(5)
#: The base patterns.  A run of name or digit signs is tried at its
#: first sign only: where that fails every later sign of the run does, too.
EMAIL_PATTERN = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PATTERN = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD_PATTERN = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD_PATTERN = r"\p{L}[\p{L}\p{N}]+"
#: Code points on each side of an entity in which words count as near.
NEAR = 64
#: Spans before and after one that can reach into its context: an e-mail takes 6
#: code points at least, an address 8, a phone 10, a card 17, with what parts them
#: from the next of their kind; so under 35 stand in 64 code points.
NEIGHBOURS = 40
PRIOR, GENERALISE, REMOVE = 3, 0.6, 0.8
MASKS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits of a card pass the check sum."""
    def passes(digits: Column) -> Column:
        def worth(d: Column, i: Column) -> Column:
            n = d.cast("int")
            return F.when(i % 2 == 1, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)
        return F.aggregate(F.transform(F.reverse(F.split(digits, "")), worth), F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(lambda d: F.when(F.length(d).between(16, 19), passes(d)).otherwise(F.lit(False)), _digits(value))


def _small_parts(value: Column) -> Column:
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(bare, lambda p: (F.length(p) <= 3) & (F.coalesce(F.substring(p, 1, 3).cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> Column:
    """Base spans of a text that is not null, by kind, then start."""
    return F.concat(
        F.when(F.contains(text, F.lit("@")), find(text, EMAIL_PATTERN, EMAIL)).otherwise(no_spans()),
        F.filter(find(text, IP_PATTERN, IP), lambda s: _small_parts(s["value"])),
        F.when(F.regexp_like(text, F.lit(r"(?:[0-9][\x20-]?+){16}")),
               F.filter(find(text, CARD_PATTERN, CARD), lambda s: _luhn(s["value"]))).otherwise(no_spans()),
        F.when(F.contains(text, F.lit("+")),
               F.filter(find(text, PHONE_PATTERN, PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15))).otherwise(no_spans()))


def _entity(span: Column) -> Column:
    """Hash of an entity: the same however a number is spaced or a name capitalised."""
    plain = F.when(span["kind"] == EMAIL, F.lower(span["value"])).when(span["kind"] == IP, span["value"]).otherwise(_digits(span["value"]))
    return F.sha2(F.concat_ws(":", span["kind"].cast("string"), plain).cast("binary"), 256)


def _near_terms(text: Column, spans: Column) -> Column:
    """Words within ``NEAR`` code points of each span, outside all spans."""
    def each(pieces: Column, spans: Column, size: Column) -> Column:
        def of(s: Column, i: Column) -> Column:
            first, last = F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["end"] + NEAR, size)
            around = F.slice(spans, F.greatest(i - NEIGHBOURS, F.lit(0)) + 1, F.lit(2 * NEIGHBOURS + 1))
            close = F.filter(around, lambda o: (o["end"] > first) & (o["start"] < last))

            def words(context: Column, close: Column) -> Column:
                def whole(w: Column) -> Column:  # cut at neither end, in no entity
                    start, end = first + w["start"], first + w["end"]
                    return (((w["start"] > 0) | (first == 0)) & ((w["end"] < last - first) | (last == size))
                            & ~F.exists(close, lambda o: (start < o["end"]) & (end > o["start"])))

                seen = F.xxhash64(context)
                return F.transform(F.filter(find(context, WORD_PATTERN), whole), lambda w: F.struct(
                    _entity(s).alias("entity"), F.lower(w["value"]).alias("term"), (first + w["start"]).alias("start"),
                    (first + w["end"]).alias("end"), seen.alias("context")))
            return let(words, part(pieces, first, last), close)
        return F.flatten(F.transform(spans, of))
    return let(each, pieces_of(text), by_start(spans), F.length(text))


def scanned(docs: DataFrame) -> DataFrame:
    """Stored ``(doc_id, row_key, spans, near)`` of every row, without texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    near_type = "array<struct<entity:string,term:string,start:int,end:int,context:bigint>>"
    spans = docs.select(doc_id.alias("doc_id"), text.alias("text"), let(lambda t: base_spans(t), text).alias("spans"))
    near = F.when(F.size("spans") > 0, let(_near_terms, F.col("text"), F.col("spans"))).otherwise(F.array().cast(near_type))
    return store(spans.select("doc_id", key_of(F.col("doc_id"), F.col("text")).alias("row_key"), "spans", near.alias("near")), "pii")


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(entity, term, share)`` of the pairs from ``GENERALISE`` on, from
    document counts over the whole corpus."""
    each = found.where(F.size("near") > 0).select("doc_id", "row_key", F.explode("near").alias("n")) \
        .select("doc_id", "row_key", "n.entity", "n.term", "n.context")
    met = store(each.groupBy("entity", "term", "doc_id", "row_key").agg(F.min("context").alias("context"))
                .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("entity", "term").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts")), "pii-pairs")
    entities = (found.where(F.size("spans") > 0)
                .select(F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
                .groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity")))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD_PATTERN), F.lit(0)), F.lower))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    total = found.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = F.lit(float(total))
    content = F.log2(n / F.col("df_entity"))
    ratio = F.col("both") * n / (F.col("df_term") * F.col("df_entity"))
    mutual = F.log2((F.col("contexts") * ratio + PRIOR) / (F.col("contexts") + PRIOR))
    share = F.when(content > 0, mutual / content).otherwise(F.lit(0.0))
    return (met.join(entities, "entity").join(terms, "term").select("entity", "term", share.alias("share"))
            .where(F.col("share") >= GENERALISE))


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``(doc_id, row_key, terms)``: spans of disclosing words, sorted; the
    value tells what becomes of them."""
    each = found.where(F.size("near") > 0).select("doc_id", "row_key", F.explode("near").alias("n")) \
        .select("doc_id", "row_key", "n.entity", "n.term", "n.start", "n.end")
    told = each.join(disclosing_terms(docs, found), ["entity", "term"]).groupBy("doc_id", "row_key", "start", "end") \
        .agg(F.max("share").alias("share"))
    span = F.struct(F.lit(TERM).alias("kind"), "start", "end",
                    F.when(F.col("share") >= REMOVE, "").otherwise("[TERM]").alias("value"))
    return told.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def pii_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (base ones, then terms), n_term.

    Null texts are empty and have none.  Repeated rows give repeated rows and
    count as documents; an empty table gives none.
    """
    found = scanned(docs)
    told = term_spans(docs, found).withColumnRenamed("doc_id", "t_id").withColumnRenamed("row_key", "t_key")
    rows = found.join(told, F.expr("row_key = t_key and doc_id <=> t_id"), "left")
    terms = F.coalesce("terms", no_spans())
    return rows.select("doc_id", *[count_of(F.col("spans"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
                       F.sha2(described(F.col("spans"), KINDS).cast("binary"), 256).alias("base_sha256"),
                       described(F.concat("spans", terms), KINDS).alias("spans"), F.size(terms).cast("long").alias("n_term"))


def sanitise(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``; in the text entities become the name of
    their kind, generalised terms ``[TERM]``, removed terms nothing."""
    found = scanned(docs)
    told = term_spans(docs, found).withColumnRenamed("doc_id", "t_id").withColumnRenamed("row_key", "t_key")
    masks = F.array(*[F.lit(m) for m in MASKS])
    both = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(masks, s["kind"]).alias("mask"))),
        F.transform(F.coalesce("terms", no_spans()), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("mask"))))
    names = [fresh(docs, c) for c in ("m_id", "m_key", "masks")]
    marked = (found.join(told, F.expr("row_key = t_key and doc_id <=> t_id"), "left").where(F.size("spans") > 0)
              .dropDuplicates(["doc_id", "row_key"]).select("doc_id", "row_key", F.array_sort(both)).toDF(*names))
    doc_id = docs["doc_id"].cast("long")
    joined = docs.join(marked, (key_of(doc_id, docs["text"].cast("string")) == F.col(names[1])) & doc_id.eqNullSafe(F.col(names[0])), "left")
    text = F.when(F.col(names[2]).isNotNull(), replace(F.col("text"), F.col(names[2]))).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])
