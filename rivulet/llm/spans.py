"""Places of regular expressions in texts, by DataFrame functions alone.

A span is a struct (kind int, start int, end int, value string); places are
code points, the end exclusive.  Matches are leftmost and do not overlap.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivulet.functions.bind import let

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


#: Code points of the pieces in which long texts are read.
PIECE_BITS = 10


def no_spans() -> Column:
    return F.array().cast(SPAN)


def running(values: Column, join, first: Column) -> Column:
    """What ``join`` makes of ``first`` and all values before each place.  In
    runs of about the square root of the length: an array that grows by one is
    copied, which would cost the square of the length."""
    def along(part: Column, begin: Column) -> Column:
        state = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                           lambda s: s["out"])

    def in_runs(values: Column, size: Column) -> Column:
        def of(runs: Column) -> Column:
            totals = F.transform(runs, lambda r: F.aggregate(r, first, join))
            return F.flatten(F.zip_with(runs, along(totals, first), along))
        n_runs = F.ceil(F.size(values) / size).cast("int")
        return let(of, F.transform(F.sequence(F.lit(0), n_runs - 1), lambda r: F.slice(values, r * size + 1, size)))

    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))
    whole = F.when(F.size(values) > 0, in_runs(values, size)).otherwise(F.array().cast("array<int>"))
    return whole


def find(text: Column, pattern: str, kind: int = 0) -> Column:
    """Spans of ``pattern`` in a text that is not null.  The lengths of matches
    and of what stands between them add up to the places."""
    def placed(values: Column) -> Column:
        def spans(pairs: Column) -> Column:
            def span(p: Column, before: Column) -> Column:
                start = before + F.length(p["gap"])
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(p["value"])).alias("end"), p["value"].alias("value"))

            lengths = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["value"]))
            return F.zip_with(pairs, let(lambda n: running(n, lambda a, x: a + x, F.lit(0)), lengths), span)

        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
        return F.when(F.size(values) > 0, let(spans, pairs)).otherwise(no_spans())

    return let(placed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def by_start(spans: Column) -> Column:
    """Sorted by start, then kind."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"),
                                                  s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``2 ** PIECE_BITS`` code points, for ``part``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE_BITS}}}"), F.lit(0))


def part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from start to end, by the pieces they lie in alone (a place
    in a text can only be reached from its beginning)."""
    first, last = F.shiftright(start, PIECE_BITS), F.shiftright(end - 1, PIECE_BITS)
    inside = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(inside, start - F.shiftleft(first, PIECE_BITS) + 1, end - start)).otherwise(F.lit(""))


def described(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` of every span, comma-joined, in the order given."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def replace(text: Column, spans: Column) -> Column:
    """The text with each span (start, end, mask) replaced by its mask; spans
    must be sorted by start.  Of overlapping spans the first gives the mask."""
    def of(pieces: Column, spans: Column, size: Column) -> Column:
        def masked(reached: Column) -> Column:
            kept = F.filter(F.zip_with(spans, reached, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), lambda x: x["s"]["start"] >= x["r"])
            before = F.transform(kept, lambda x: F.concat(part(pieces, x["r"], x["s"]["start"]), x["s"]["mask"]))
            end = F.array_max(F.transform(spans, lambda s: s["end"]))
            return F.concat(F.array_join(before, ""), part(pieces, end, size))
        ends = F.transform(spans, lambda s: s["end"])
        return let(masked, let(lambda e: running(e, lambda a, x: F.greatest(a, x), F.lit(0)), ends))

    return F.when(F.size(spans) > 0, let(of, pieces_of(text), spans, F.length(text))).otherwise(text)


def key_of(doc_id: Column, text: Column) -> Column:
    """A number that, beside doc_id, tells rows of one doc_id apart by text."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))
