"""Per-row HTML helper: container sections -> (section title, paragraph text).

A small event-driven walker over the standard library's ``html.parser``
(no third-party parser is available).  It is only the row-level helper of
:func:`rivulet.operators.corpus.extract_paragraphs`; everything around it
(carry-forward of titles, normalization, filters, numbering) is DataFrame code.

Semantics (those of the reference's tree walk):
* top-level ``container`` elements (default ``section``) are visited in order;
* a container's title is its first ``h2`` descendant's text, if any;
* everything inside ``table`` is dropped, as is ``sup`` text inside a ``p``;
* each ``p`` yields its full text; a ``p`` ends at ``</p>``, at the next
  ``<p>`` or block-level start tag (HTML's implicit close), or at the end of
  its container.  ``script`` / ``style`` content is never text.
"""
from __future__ import annotations

from html.parser import HTMLParser

# Tags whose start implicitly closes an open paragraph.
P_CLOSERS = frozenset("""address article aside blockquote details div dl fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul""".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Walker(HTMLParser):
    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container = container
        self.depth = 0            # nesting depth of container elements
        self.table = 0            # nesting depth of tables inside a container
        self.sup = 0
        self.in_p = False
        self.in_h2 = False
        self.h2_text: list[str] | None = None
        self.sec_title: str | None = None
        self.sec_ord = -1
        self.buf: list[str] = []
        self.sec_paras: list[str] = []
        self.out: list[tuple[int, str | None, int, str]] = []
        self.page_title: list[str] = []
        self.in_title = False

    # -- helpers
    def _close_p(self):
        if self.in_p:
            self.sec_paras.append("".join(self.buf))
            self.buf = []
            self.in_p = False
        self.sup = 0  # an unclosed <sup> ends with its paragraph

    def _end_section(self):
        self._close_p()
        self.table = 0  # an unclosed <table> ends with its section
        for i, t in enumerate(self.sec_paras):
            self.out.append((self.sec_ord, self.sec_title, i, t))
        self.sec_paras = []

    # -- events
    def handle_starttag(self, tag, attrs):
        if tag == "title" and self.depth == 0:
            self.in_title = True
        if tag == self.container:
            if self.depth == 0:
                self.sec_ord += 1
                self.sec_title = None
                self.h2_text = None
            else:
                self._close_p()
            self.depth += 1
            return
        if self.depth == 0:
            return
        if tag == "table":
            self._close_p()
            self.table += 1
            return
        if self.table:
            return
        if tag == "h2" and self.sec_title is None and self.h2_text is None:
            self.in_h2 = True
            self.h2_text = []
        if tag in P_CLOSERS:
            self._close_p()
        if tag == "p":
            self.in_p = True
            self.buf = []
        elif tag == "sup" and self.in_p:
            self.sup += 1

    def handle_startendtag(self, tag, attrs):
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if self.depth == 0:
            return
        if tag == self.container:
            self.depth -= 1
            if self.depth == 0:
                self._end_section()
            else:
                self._close_p()
            return
        if tag == "table":
            if self.table:
                self.table -= 1
            return
        if self.table:
            return
        if tag == "h2" and self.in_h2:
            self.in_h2 = False
            self.sec_title = "".join(self.h2_text or [])
        elif tag == "p":
            self._close_p()
        elif tag == "sup" and self.sup:
            self.sup -= 1

    def handle_data(self, data):
        if self.in_title:
            self.page_title.append(data)
        if self.depth == 0 or self.table:
            return
        if self.in_h2 and self.h2_text is not None:
            self.h2_text.append(data)
        if self.in_p and not self.sup:
            self.buf.append(data)


def extract(html: str | None, container: str = "section"):
    """-> (page_title, [(sec_ord, h2_title_or_None, p_ord, raw_text), ...]).
    Raises what the parser raises."""
    if not html:
        return None, []
    w = _Walker(container)
    w.feed(html)
    w.close()
    if w.depth > 0:
        w._end_section()
    return "".join(w.page_title).strip() or None, w.out
