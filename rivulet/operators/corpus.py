"""Corpus building: page filter, page URL, HTML -> paragraphs -> passages,
dump-line pairing and the fetch retry frontier (F1-F6, F11, J13, W1-W5).

Per-page work (HTML walking, title carry-forward, paragraph numbering) stays
inside one row per page (bounded by a page's size), so it needs no shuffle.
Only the passage ids and the reference-compatible run titles need a *global*
order; those use the bucketed per-bucket-offset helpers in
:mod:`rivulet.operators.order` instead of a single-partition window.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions.html import extract
from rivulet.functions.text import clean_text, format_id
from rivulet.operators.order import add_dense_id, running_sum

# Section titles whose paragraphs are dropped (footnotes,
# sources, references, related items, external links).
SECTIONS_TO_IGNORE = ("脚注", "出典", "参考文献", "関連項目", "外部リンク")
LEAD_TITLE = "__LEAD__"


# ---------------------------------------------------------------- F1 / F2
def filter_pages(pages: DataFrame, *, min_inlinks: int | None = None,
                 exclude_templates=(), inlinks: str = "incoming_links",
                 template: str = "template") -> DataFrame:
    """keep pages with enough incoming links (missing counts as 0) and
    none of the excluded templates."""
    out = pages
    if min_inlinks is not None:
        out = out.where(F.coalesce(F.col(inlinks), F.lit(0)) >= min_inlinks)
    for t in exclude_templates:
        out = out.where(~F.coalesce(F.array_contains(F.col(template), t), F.lit(False)))
    return out


def page_url(base: str, title: str = "title", rev: str = "revid"):
    """``{base}/page/mobile-html/{title with spaces as _}/{rev}``."""
    return F.concat(F.lit(base.rstrip("/") + "/page/mobile-html/"),
                    F.translate(F.col(title), " ", "_"), F.lit("/"), F.col(rev).cast("string"))


# ---------------------------------------------------------------- W5
def pair_dump_lines(lines: DataFrame, *, file: str = "file", split: str = "split", order: str = "line_ord") -> DataFrame:
    """An action line ``{"index": {"_id": ...}}`` gives its id to the next
    document line.  Returns the document lines with ``pageid``; null where the
    line before is no action line.

    A line's next one has the following number in its split; the last line of a
    split is followed by the first of the file's next split that has lines.  The
    table of splits (one row each) tells where that is, and ids meet their
    document lines by an equi-join: no ordered window over lines."""
    place = [file, split, order]
    ends = lines.groupBy(file, split).agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    by_file = Window.partitionBy(file).orderBy(split)  # splits of one file
    ends = ends.withColumn("__next", F.lead(F.struct(F.col(split).alias("split"), F.col("__low").alias("ord"))).over(by_file))
    actions = lines.where(F.col("index").isNotNull()).select(*place, F.col("index._id").alias("pageid")).join(ends, [file, split])
    at_end = F.col(order) == F.col("__high")
    actions = actions.select(file, F.when(at_end, F.col("__next.split")).otherwise(F.col(split)).alias(split),
                             F.when(at_end, F.col("__next.ord")).otherwise(F.col(order) + 1).alias(order), "pageid")
    return lines.where(F.col("index").isNull()).drop("index").join(actions, place, "left").drop(*place)


# ---------------------------------------------------------------- F3-F5 / W1 / W2
_PARA = T.StructType([T.StructField("section", T.StringType()), T.StructField("raw", T.StringType())])
_PAGE = T.StructType([
    T.StructField("page_key", T.LongType()), T.StructField("rev_id", T.LongType()),
    T.StructField("meta_title", T.StringType()), T.StructField("page_title", T.StringType()),
    T.StructField("paras", T.ArrayType(_PARA)), T.StructField("error", T.StringType())])


def _walk_pages(container: str):
    import unicodedata

    import pyarrow as pa

    para_type = pa.list_(pa.struct([("section", pa.string()), ("raw", pa.string())]))

    def run(batches):
        for b in batches:
            d = b.to_pydict()
            titles, paras, errors = [], [], []
            for html in d["html"]:
                try:
                    title, rows = extract(html, container)
                    errors.append(None)
                except Exception as why:  # noqa: BLE001 - whatever a page does, the others go on; see unreadable_pages
                    title, rows = None, []
                    errors.append(f"{type(why).__name__}: {why}")
                out, carried, last_sec = [], LEAD_TITLE, None
                for sec_ord, h2, _p_ord, raw in rows:
                    if sec_ord != last_sec:          # W1: carry the title forward
                        last_sec = sec_ord
                        if h2 is not None:
                            carried = h2
                    out.append({"section": carried,
                                "raw": raw if raw.isascii() else unicodedata.normalize("NFKC", raw)})
                titles.append(title)
                paras.append(out)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_key"), b.column("rev_id"), b.column("meta_title"),
                 pa.array(titles, pa.string()), pa.array(paras, para_type), pa.array(errors, pa.string())],
                names=[f.name for f in _PAGE.fields])
    return run


def _walked(pages: DataFrame, container: str, page_id: str, rev_id: str | None, title: str | None, html: str) -> DataFrame:
    src = pages.select(F.col(page_id).cast("long").alias("page_key"),
                       (F.col(rev_id).cast("long") if rev_id else F.lit(None).cast("long")).alias("rev_id"),
                       (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("meta_title"),
                       F.col(html).cast("string").alias("html"))
    return src.mapInArrow(_walk_pages(container), _PAGE)


def unreadable_pages(pages: DataFrame, *, container: str = "section", page_id: str = "pageid",
                     rev_id: str | None = "revid", html: str = "html") -> DataFrame:
    """``page_id, rev_id, error`` of the pages that cannot be parsed.  They
    give no paragraph at all, instead of those before the fault."""
    return _walked(pages, container, page_id, rev_id, None, html).where(F.col("error").isNotNull()) \
        .select(F.col("page_key").alias("page_id"), "rev_id", "error")


def extract_paragraphs(pages: DataFrame, *, container: str = "section", min_len: int = 10,
                       max_len: int = 1000, ignore_sections=SECTIONS_TO_IGNORE,
                       page_id: str = "pageid", rev_id: str | None = "revid",
                       title: str | None = "title", html: str = "html") -> DataFrame:
    """F3 + F4 + F5 + W1 + W2: pages -> numbered paragraphs.

    Returns ``id, page_id, rev_id, paragraph_index, title, section, text``;
    ``paragraph_index`` counts paragraphs that survive the filters; the page
    title falls back to the HTML ``<title>`` when no title column is given.

    One row per page all the way: the walker (per-page Python helper) yields
    the page's paragraphs with their carried section titles; normalization
    (X1), the section / length filters and the numbering are array built-ins
    on that row, so there is no shuffle and no window.
    """
    walked = _walked(pages, container, page_id, rev_id, title, html)
    cleaned = F.transform("paras", lambda p: F.struct(p["section"].alias("section"),
                                                      clean_text(p["raw"]).alias("text")))
    ignore = list(ignore_sections or [])
    kept = F.filter(cleaned, lambda p: F.length(p["text"]).between(min_len, max_len)
                    & (~p["section"].isin(ignore) if ignore else F.lit(True)))
    ex = walked.select("page_key", "rev_id", F.coalesce("meta_title", "page_title").alias("title"),
                       F.posexplode(kept).alias("paragraph_index", "p"))
    return ex.select(format_id("page_key", "rev_id", "paragraph_index").alias("id"),
                     F.col("page_key").alias("page_id"), "rev_id",
                     F.col("paragraph_index").cast("int").alias("paragraph_index"), "title",
                     F.col("p.section").alias("section"), F.col("p.text").alias("text"))


# ---------------------------------------------------------------- W3 / W4 / F6
def make_passages(paragraphs: DataFrame, *, max_len: int = 1000, compat: bool = False,
                  order_by=("page_ord", "paragraph_index"), page: str = "page_id",
                  num_partitions: int | None = None) -> DataFrame:
    """W3 + W4 + F6: paragraphs (in ``order_by`` order) -> passages
    ``id (1-based dense), title, text``.

    Default: a passage keeps its own page title; paragraphs longer than
    ``max_len`` are dropped.  ``compat=True`` reproduces the reference: runs
    are maximal sequences of consecutive rows with equal ``section`` over the
    whole input (across pages), and every passage of a run takes the title of
    the run's last row -- even when that row itself was too long.
    """
    order = list(order_by)
    if not compat:
        kept = paragraphs.where(F.length("text") <= max_len)
        return add_dense_id(kept, order, name="id", start=1, num_partitions=num_partitions) \
            .select("id", "title", "text")
    # the global-order steps below read their input several times: write it
    # once (cuts the lineage of the upstream HTML / normalization work)
    from rivulet.session import materialize
    paragraphs = materialize(paragraphs.select(*order, "section", "title", "text"), "paragraphs")
    # global position of every paragraph (before the length filter)
    pos = add_dense_id(paragraphs, order, name="__pos", start=0, num_partitions=num_partitions,
                       materialize_input=False)
    pos = materialize(pos, "paragraph_pos")
    prev = pos.select((F.col("__pos") + 1).alias("__pos"), F.col("section").alias("__prev"))
    flagged = pos.join(prev, "__pos", "left").withColumn(
        "__start", F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("section")), 1)
        .otherwise(0))
    runs = running_sum(flagged, "__pos", "__start", name="__run", num_partitions=num_partitions)
    last_title = runs.groupBy("__run").agg(
        F.max_by("title", "__pos").alias("__run_title"))  # partial agg: hot runs are fine
    kept = runs.where(F.length("text") <= max_len).join(last_title, "__run")
    out = add_dense_id(kept, "__pos", name="id", start=1, num_partitions=num_partitions)
    return out.select("id", F.col("__run_title").alias("title"), "text")


# ---------------------------------------------------------------- F11 / J13
def fetch_frontier(requests: DataFrame, responses: DataFrame, *, key=("pageid", "revid"),
                   max_attempts: int = 2, attempt: str = "attempt") -> dict[str, DataFrame]:
    """F11 + J13: route fetch outcomes.

    ``requests``: one row per (key, attempt) that was sent; ``responses``:
    rows with a body for the (key, attempt) that succeeded.  Returns
    ``fetched`` (request row joined with its response), ``retry`` (keys whose
    latest attempt failed and that have attempts left) and ``failed`` (keys
    out of attempts: the quarantine, reported instead of silently dropped).
    """
    keys = list(key)
    latest = requests.groupBy(*keys).agg(F.max(attempt).alias(attempt))
    ok = responses.select(*keys).distinct()
    fetched = requests.join(responses, keys + [attempt], "inner")
    pending = latest.join(ok, keys, "left_anti")
    retry = pending.where(F.col(attempt) < max_attempts).withColumn(attempt, F.col(attempt) + 1)
    failed = pending.where(F.col(attempt) >= max_attempts)
    return {"fetched": fetched, "retry": retry, "failed": failed}
