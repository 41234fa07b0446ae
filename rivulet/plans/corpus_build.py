"""Corpus-building queries: pages -> paragraphs -> passages, page filter,
page URLs and the fetch retry frontier (whole ``pages`` / ``documents``)."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rivulet.functions.text import split_paragraphs
from rivulet.operators import corpus
from rivulet.plans import sqlfrag as S
from rivulet.plans.registry import register
from rivulet.session import ensure_checkpoint_dir
from rivulet.sources import io
from rivulet.sources.tables import table

MAX_PASSAGE = 400


def _decode(expr: str) -> str:
    e = expr
    for ent, ch in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        e = f"replace({e}, '{ent}', '{ch}')"
    return e


@register("html_paragraphs", f"""
WITH a AS (SELECT page_id,
                  trim({_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title,
                  regexp_extract(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>', '', 'g'),
                                 '(?s)<article[^>]*>(.*)</article>', 1) AS art
           FROM pages),
s AS (SELECT page_id, title, string_split(art, '<p>')[2:] AS pieces FROM a),
parts AS (SELECT page_id, title, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p_ord FROM s),
t AS (SELECT page_id, title, p_ord,
             {S.normalize_text(_decode("regexp_replace(split_part(piece, '</p>', 1), '<[^>]*>', '', 'g')"))} AS text
      FROM parts),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p_ord) - 1 AS paragraph_index
      FROM t WHERE length(text) BETWEEN 10 AND 1000)
SELECT page_id || '-' || paragraph_index AS id, page_id, CAST(paragraph_index AS INTEGER) AS paragraph_index,
       title, '__LEAD__' AS section, text
FROM f
""")
def html_paragraphs(spark, sf_dir):
    """F3 + F4 + F5 + W1 + W2 + X1: every page's article paragraphs, normalized,
    length-filtered (10..1000) and numbered after filtering."""
    p = corpus.extract_paragraphs(table(spark, sf_dir, "pages"), container="article",
                                  page_id="page_id", rev_id=None, title=None)
    return p.select("id", "page_id", "paragraph_index", "title", "section", "text")


def doc_paragraphs(spark, sf_dir, ignore=()):
    """Documents as the paragraph stage: lines normalized, 10..1000 chars,
    numbered per document after filtering (``page_ord`` = doc_id).  Per-row
    array work: no shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    if ignore:
        d = d.where(~F.col("lang").isin(list(ignore)))
    p = d.select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"),
                 F.col("lang").alias("section"),
                 F.posexplode(split_paragraphs("text", 10, 1000)).alias("paragraph_index", "text"))
    return (p.withColumn("paragraph_index", F.col("paragraph_index").cast("int"))
            .withColumn("page_ord", F.col("page_id")))


_PARA_SQL = f"""
WITH l AS (SELECT doc_id AS page_id, source AS title, lang AS section,
                  unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS li
           FROM documents),
n AS (SELECT page_id, title, section, li, {S.normalize_text('line')} AS text FROM l),
para AS (SELECT page_id, title, section, text,
                row_number() OVER (PARTITION BY page_id ORDER BY li) - 1 AS paragraph_index
         FROM n WHERE length(text) BETWEEN 10 AND 1000 __IGNORE__)
"""


@register("paragraph_split", _PARA_SQL.replace("__IGNORE__", "") + """
SELECT page_id, CAST(paragraph_index AS INTEGER) AS paragraph_index, section, text FROM para
""")
def paragraph_split(spark, sf_dir):
    """F5 + W2 + X1 on documents: newline paragraphs, normalized and filtered."""
    return doc_paragraphs(spark, sf_dir).select("page_id", "paragraph_index", "section", "text")


@register("ignored_sections", _PARA_SQL.replace("__IGNORE__", "AND section NOT IN ('de', 'es')") + """
SELECT section, count(*) AS n_paragraphs FROM para GROUP BY section
""")
def ignored_sections(spark, sf_dir):
    """paragraphs of ignored sections dropped (here the sections 'de'
    and 'es'), counted per remaining section."""
    p = doc_paragraphs(spark, sf_dir, ignore=("de", "es"))
    return p.groupBy("section").agg(F.count(F.lit(1)).alias("n_paragraphs"))


@register("section_run_passages", _PARA_SQL.replace("__IGNORE__", "") + f"""
SELECT CAST(row_number() OVER (ORDER BY page_id, paragraph_index) AS BIGINT) AS id, title, text
FROM para WHERE length(text) <= {MAX_PASSAGE}
""")
def section_run_passages(spark, sf_dir):
    """W3 + W4 + F6: passages <= 400 chars with dense 1-based ids in
    (page, paragraph) order, each keeping its own page title."""
    return corpus.make_passages(doc_paragraphs(spark, sf_dir), max_len=MAX_PASSAGE)


@register("section_run_passages_compat", _PARA_SQL.replace("__IGNORE__", "") + f""",
o AS (SELECT *, row_number() OVER (ORDER BY page_id, paragraph_index) AS pos FROM para),
fl AS (SELECT *, CASE WHEN lag(section) OVER (ORDER BY pos) IS DISTINCT FROM section THEN 1 ELSE 0 END AS st
       FROM o),
r AS (SELECT *, sum(st) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM fl),
rt AS (SELECT run, arg_max(title, pos) AS run_title FROM r GROUP BY run)
SELECT CAST(row_number() OVER (ORDER BY pos) AS BIGINT) AS id, rt.run_title AS title, r.text
FROM r JOIN rt USING (run) WHERE length(r.text) <= {MAX_PASSAGE}
""")
def section_run_passages_compat(spark, sf_dir):
    """W3 compat (Q2): section runs across pages, run-last title, via range
    partitioning, a position self-join and per-partition offsets."""
    return corpus.make_passages(doc_paragraphs(spark, sf_dir), max_len=MAX_PASSAGE, compat=True)


@register("page_filter", """
SELECT d.doc_id, d.lang, d.source
FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE coalesce(l.quality, 0) >= 1 AND NOT coalesce(l.toxic = 1, false)
""")
def page_filter(spark, sf_dir):
    """labels as page metadata -- quality plays incoming links (min 1),
    toxic plays an excluded template."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    lab = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("incoming_links"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(
            F.array().cast("array<string>")).alias("template"))
    pages = d.join(lab, "doc_id", "left")
    return corpus.filter_pages(pages, min_inlinks=1, exclude_templates=("toxic",)) \
        .select("doc_id", "lang", "source")


@register("page_url", f"""
SELECT page_id,
       'http://rest.example/page/mobile-html/' ||
       replace(trim({_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}), ' ', '_')
       || '/' || CAST(page_id AS VARCHAR) AS url
FROM pages
""")
def page_url(spark, sf_dir):
    """REST URL from the page title (spaces -> '_') and revision."""
    p = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    for ent, ch in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(ent), F.lit(ch))
    p = p.select("page_id", F.trim(title).alias("title"), F.col("page_id").alias("revid"))
    return p.select("page_id", corpus.page_url("http://rest.example", "title", "revid").alias("url"))


@register("fetch_retry_frontier", """
SELECT page_id, CASE WHEN coalesce(trim(html), '') = '' THEN 'failed' ELSE 'fetched' END AS status,
       CASE WHEN coalesce(trim(html), '') = '' OR NOT contains(lower(html), '</html>') THEN 2 ELSE 1 END AS attempt
FROM pages
""")
def fetch_retry_frontier(spark, sf_dir):
    """F11 + J13: two rounds over the pages as they are.  A body that is there and
    whole (it has its end tag) is fetched in the first round.  The others are
    asked for again; the second round takes any body, so one that is cut off is
    fetched then, and a page without one ends in the failed set."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pageid"), F.col("page_id").alias("revid"), "html")
    body = F.coalesce(F.trim("html"), F.lit("")) != ""
    first = pages.select("pageid", "revid", F.lit(1).alias("attempt"))
    whole = pages.where(body & F.contains(F.lower("html"), F.lit("</html>"))).select("pageid", "revid", F.lit(1).alias("attempt"), "html")
    retry = corpus.fetch_frontier(first, whole)["retry"]
    again = retry.join(pages.where(body), ["pageid", "revid"]).select("pageid", "revid", "attempt", "html")
    done = corpus.fetch_frontier(first.unionByName(retry), whole.unionByName(again))
    rows = [done[k].select("pageid", F.lit(k).alias("status"), "attempt") for k in ("fetched", "failed")]
    return rows[0].unionByName(rows[1]).select(F.col("pageid").alias("page_id"), "status", F.col("attempt").cast("int").alias("attempt"))


@register("dump_line_pairs", """
SELECT CAST(page_id AS VARCHAR) AS pageid, url AS title, CAST(length(html) AS BIGINT) AS version FROM pages
""")
def dump_line_pairs(spark, sf_dir):
    """S5 + W5: the pages written as alternating action and document lines, in
    files that many tasks read, and paired again."""
    pages = table(spark, sf_dir, "pages")
    action = F.to_json(F.struct(F.struct(F.col("page_id").cast("string").alias("_id")).alias("index")))
    document = F.to_json(F.struct(F.col("url").alias("title"), F.length("html").cast("long").alias("version")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rivulet-dump-{uuid.uuid4().hex}"
    pages.select(F.concat(action, F.lit("\n"), document).alias("value")).write.text(path)
    return corpus.pair_dump_lines(io.read_dump_lines(spark, path)).select("pageid", "title", "version")
