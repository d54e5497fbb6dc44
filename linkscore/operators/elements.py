"""Pages to elements: the one place where page markup is read, and the only Python in the hot path.

Spark has no HTML tokenizer, so the markup of a page is walked with the standard library's
``html.parser`` inside an Arrow UDF, which hands back the page's elements as an array; ``explode``
turns it into one row per element. Everything after that (context, metadata, link order, first
mentions, text assembly) is DataFrame work on the element rows.

The UDF sees only the markup; all other columns stay in the JVM. Arrow batches are bounded in bytes
(``spark.sql.execution.arrow.maxBytesPerBatch``), so large pages do not pile up in a worker; the elements of a
batch, which are many times its size as Python objects, are made and handed back for slices of ``SLICE_BYTES``.

Elements that are not closed hold all that follows, so the texts of a page's elements may add up to far more
than the page. The rows for links therefore say where a text begins and ends in their page's text, which is
there once: they take memory in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscore.schemas import ELEMENT_FIELDS, LINK_ROW_FIELDS

# Elements that can give a link its surrounding text, and the headings among them.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "li")
HEADING_TAGS = ("h1", "h2", "h3")
# Elements that never have content.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose strings are not page text; elements that keep their blanks.
HIDDEN_TAGS = ("script", "style", "template")
PREFORMATTED_TAGS = ("pre", "textarea")
# Markup read together, about; a longer page is read alone.
SLICE_BYTES = 500_000

# Workers get this module's code inside the pickled UDF, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Element:
    """One element of interest; its text is the segments between its start and its end."""

    __slots__ = ("attrs", "end", "first", "headings", "last", "needed", "pos", "scopes", "tag")

    def __init__(self, tag, pos, attrs, first):
        self.tag, self.pos, self.attrs, self.first = tag, pos, attrs, first
        self.end = self.last = 0
        self.scopes, self.headings = (), ()
        self.needed = False


class _PageReader(HTMLParser):
    """Elements of one page, for markup as broken as it comes.

    An end tag closes everything up to the nearest open element of that name and is ignored when
    there is none; nothing closes implicitly; the end of the page closes the rest.
    """

    def __init__(self, containers):
        super().__init__(convert_charrefs=False)
        self.containers = containers
        self.found = []
        self.segments = []
        self._pending = []
        self._open = []  # (tag, element or None), outermost first
        self._open_count = {}
        # Open containers, outermost first; the document itself is the container named "".
        self._scopes = [{"container": "", "pos": 0}] if "" in containers else []
        self._headings = []
        self._tags_seen = self._hidden = self._preformatted = 0
        self._block = None  # the block that opened last
        self._awaiting_block = False  # a link waits for the block that opens next

    def read(self, html):
        self.feed(html)
        self.close()
        self._end_segment()
        self._close_down_to(0)
        return self.found

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    # -- text -------------------------------------------------------------------------------

    def handle_data(self, data):
        self._pending.append(data)

    def handle_entityref(self, name):
        code = name2codepoint.get(name)
        self._pending.append("&" + name if code is None else chr(code))

    def handle_charref(self, name):
        code = -1
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
            char = bytes([code]).decode("windows-1252") if code < 256 else chr(code)
        except (ValueError, OverflowError):
            char = chr(code) if 0 <= code < 256 else "\ufffd"
        # A lone surrogate cannot be stored as UTF-8.
        self._pending.append("\ufffd" if "\ud800" <= char <= "\udfff" else char)

    def _end_segment(self):
        if self._pending:
            text = "".join(self._pending)
            self._pending.clear()
            if self._hidden:
                return
            if not self._preformatted and not text.strip(" \n\t\f\r"):
                text = "\n" if "\n" in text else " "
            self.segments.append(text)

    def _skip(self, _data):
        self._end_segment()

    handle_comment = handle_decl = handle_pi = _skip

    def unknown_decl(self, data):
        self._end_segment()
        if data[:6].upper() == "CDATA[":
            self._pending.append(data[6:])
            self._end_segment()

    # -- structure --------------------------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._close_down_to(len(self._open) - 1)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._close_down_to(len(self._open) - 1)

    def handle_endtag(self, tag):
        if tag in VOID_TAGS:
            return
        self._end_segment()
        if self._open_count.get(tag):
            level = len(self._open) - 1
            while self._open[level][0] != tag:
                level -= 1
            self._close_down_to(level)

    def _start(self, tag, attrs):
        self._end_segment()
        self._tags_seen += 1
        element = self._element(tag, attrs)
        self._open.append((tag, element))
        self._open_count[tag] = self._open_count.get(tag, 0) + 1
        if tag in self.containers:
            self._scopes.append({"container": tag, "pos": self._tags_seen})
        if tag in HEADING_TAGS:
            self._headings.append(element)
        else:
            self._hidden += tag in HIDDEN_TAGS
            self._preformatted += tag in PREFORMATTED_TAGS

    def _element(self, tag, attrs):
        """Element to report for this start tag, or None."""
        block = tag in BLOCK_TAGS
        if not (block or tag in ("a", "title", "meta") or tag in self.containers):
            return None
        # Of a repeated attribute the last value counts; one without value is empty.
        values = {name: value or "" for name, value in attrs}
        if tag == "meta" and values.get("name") != "description":
            return None
        element = _Element(tag, self._tags_seen, values, len(self.segments))
        if block:
            element.needed, self._awaiting_block = self._awaiting_block, False
            self._block = element
        elif tag == "a" and values.get("href"):
            element.needed = self._awaiting_block = True
            element.scopes = tuple(self._scopes)
            element.headings = tuple(reversed(self._headings))
            if self._block is not None:
                self._block.needed = True
        elif tag in ("title", "meta"):
            element.needed = True
        self.found.append(element)
        return element

    def _close_down_to(self, level):
        while len(self._open) > level:
            tag, element = self._open.pop()
            self._open_count[tag] -= 1
            if tag in self.containers:
                self._scopes.pop()
            if tag in HEADING_TAGS:
                self._headings.pop()
            else:
                self._hidden -= tag in HIDDEN_TAGS
                self._preformatted -= tag in PREFORMATTED_TAGS
            if element is not None:
                element.end, element.last = self._tags_seen + 1, len(self.segments)

    # -- output -----------------------------------------------------------------------------

    def text(self, element):
        return "".join(self.segments[element.first : element.last])

    def stripped(self, element):
        return "".join(s.strip() for s in self.segments[element.first : element.last])


_ATTRIBUTES = ("href", "title", "aria-label", "rel", "name", "content")
_TEXT_TAGS = frozenset(BLOCK_TAGS + ("a", "title"))
# The row that holds the page's text.
TEXT_ROW = "#text"

_SCOPES = pa.list_(pa.struct([("container", pa.string()), ("pos", pa.int32())]))
_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32())])
_MAP = pa.map_(pa.string(), pa.string())
_LISTS = {
    "pos": pa.int32(), "end_pos": pa.int32(), "tag": pa.string(), "attrs": _MAP, "text": pa.string(),
    "text_stripped": pa.string(), "scopes": _SCOPES,
}
_LINK_LISTS = {
    "pos": pa.int32(), "tag": pa.string(), "attrs": _MAP, "span": _SPAN, "scopes": _SCOPES,
    "headings": pa.list_(_SPAN), "page_text": pa.binary(), "page_stripped": pa.binary(),
}


def _storable(text):
    """Text as UTF-8 can hold it."""
    return text.encode("utf-8", "replace").decode("utf-8") if not text.isascii() else text


def _read(html, containers):
    reader = _PageReader(containers)
    try:
        return reader, reader.read(html)
    except AssertionError:
        return reader, []  # markup the parser gives up on: a page without elements


def _attributes(element):
    return [(k, _storable(element.attrs[k])) for k in _ATTRIBUTES if k in element.attrs]


def _page_rows(html, containers):
    """Rows of all elements of one page."""
    reader, found = _read(html, containers)
    rows = []
    for e in found:
        has_text = e.tag in _TEXT_TAGS
        rows.append(
            (
                e.pos,
                e.end,
                e.tag,
                _attributes(e),
                _storable(reader.text(e)) if has_text else None,
                _storable(reader.stripped(e)) if has_text else None,
                e.scopes,
            )
        )
    return rows


def _joined(segments, elements, prepare):
    """The segments that some of the elements have, as bytes, and where each segment begins in them."""
    marks = [0] * (len(segments) + 1)
    for e in elements:
        marks[e.first] += 1
        marks[e.last] -= 1
    parts, begins, inside, size = [], [0], 0, 0
    for segment, mark in zip(segments, marks):
        inside += mark
        if inside:
            parts.append(prepare(segment).encode("utf-8", "replace"))
            size += len(parts[-1])
        begins.append(size)
    return b"".join(parts), begins


def _link_rows(html, containers):
    """Rows of one page that some link of it can make use of, and first the one of its text."""
    if "<a" not in html and "<A" not in html:
        return []
    reader, found = _read(html, containers)
    found = [e for e in found if e.needed]
    links = [e for e in found if e.tag == "a"]
    if not links:
        return []
    headings = list({id(h): h for e in links for h in e.headings}.values())
    text, begins = _joined(reader.segments, [e for e in found if e.tag in _TEXT_TAGS], str)
    stripped, stripped_begins = _joined(reader.segments, headings, str.strip)
    rows = [(-1, TEXT_ROW, [], None, [], [], text, stripped)]
    for e in found:
        span = (begins[e.first], begins[e.last]) if e.tag in _TEXT_TAGS else None
        inside = [(stripped_begins[h.first], stripped_begins[h.last]) for h in e.headings]
        rows.append((e.pos, e.tag, _attributes(e), span, e.scopes, inside, None, None))
    return rows


def _as_structs(rows, lists):
    columns = list(zip(*rows)) or [()] * len(lists)
    return pa.StructArray.from_arrays(
        [_column(c, t) for c, t in zip(columns, lists.values())], names=list(lists)
    )


def _column(values, kind):
    if kind == _SPAN:
        values = [None if v is None else {"first": v[0], "last": v[1]} for v in values]
    elif kind == pa.list_(_SPAN):
        values = [[{"first": a, "last": b} for a, b in v] for v in values]
    return pa.array(values, type=kind)


def _slices(html):
    """Stretches of a batch with about ``SLICE_BYTES`` of markup."""
    sizes = pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False)
    number = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(html)]):
        yield html.slice(start, end - start)


def _elements_udf(containers, for_links):
    wanted = frozenset(c.lower() for c in containers)
    rows_of, lists = (_link_rows, _LINK_LISTS) if for_links else (_page_rows, _LISTS)

    def read_slice(html):
        offsets, rows = [0], []
        for markup in html.to_pylist():
            if markup:
                rows.extend(rows_of(markup, wanted))
            offsets.append(len(rows))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _as_structs(rows, lists))

    def read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            if not len(html):
                yield read_slice(html)
            for part in _slices(html):
                yield read_slice(part)

    fields = LINK_ROW_FIELDS if for_links else ELEMENT_FIELDS
    return F.arrow_udf(read_pages, f"array<struct<{_as_struct_fields(fields)}>>")


def _as_struct_fields(ddl):
    from linkscore.schemas import struct

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in struct(ddl).fields)


def parsed_pages(
    pages: DataFrame, containers: Sequence[str] = ("body",), for_links: bool = False
) -> DataFrame:
    """Pages with the array of their elements in place of the markup."""
    parsed = _elements_udf(tuple(containers), for_links)(F.col("html"))
    return pages.select("page_id", "url", parsed.alias("elements"))


def elements(
    pages: DataFrame, containers: Sequence[str] = ("body",), for_links: bool = False
) -> DataFrame:
    """One row per relevant element of each page, ``pos`` in document order.

    ``pages`` has ``page_id``, ``url``, ``html``; the markup does not leave this step. Links carry
    the containers they are in as ``scopes``; all containers are found in one pass. With
    ``for_links`` only rows that extraction uses are made (``LINK_ROW_FIELDS``): links, page title and
    description, and of the blocks just the neighbours of a link, which keeps article text out of the
    shuffle; a row ``#text`` has the part of the page's text that they point into.
    """
    listed = parsed_pages(pages, containers, for_links)
    # inline() would make the optimizer infer "elements is not empty" and push that below the
    # projection, which runs the UDF twice; inline_outer() with a filter on its rows does not.
    rows = listed.select("page_id", "url", F.inline_outer("elements"))
    return rows.filter(F.col("tag").isNotNull())
