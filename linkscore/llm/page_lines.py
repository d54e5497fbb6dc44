"""The text lines of a web page, with what its markup says about them.

A line is the text of one block: character references decoded, white space as one space, trimmed. Lines
are marked as boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers,
hidden parts) by the elements around them, and know whether they are in an article. Markup may be as
broken as it comes; an element that cannot contain a block ends where one starts.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Elements that stand on lines of their own.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
UNSEEN = frozenset(
    "audio button canvas datalist head iframe math noembed noframes noscript object script select style svg "
    "template textarea title video".split()
)
# Elements for what stands beside the main text.
BESIDE = frozenset("aside dialog footer form menu nav search".split())
# Words in class, id and role that tell the same.
WORDS_BESIDE = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright disqus feedback footer footnav gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promoted promotion recommendations recommended related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar "
    "tracking widget widgets".split()
)
# The same, but not inside an article.
WORDS_ABOVE = frozenset(["header"])
# Words that turn the following one around ("has-sidebar" is not a sidebar).
WORDS_ABOUT = frozenset("has no with without".split())
# Class or id of the element around the main text, where no element says so.
CONTENT = frozenset(
    "article article-body articlebody article-content content entry-content main main-content mainbody post "
    "post-body post-content story story-body".split()
)
#: How sure it is that a line is of the main text.
ARTICLE, MAIN, NAMED, OPEN = 3, 2, 1, 0
# An element that ends where one of the others starts, unless one of the last stands between.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}
_IN_PARAGRAPH = ("p",), ("article", "aside", "body", "button", "div", "li", "main", "section", "table", "td", "th")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")


def words_of(value: str) -> list[str]:
    """Words of a class, id or role, in lower case; those after a word like "has" are left out."""
    found = []
    for name in value.split():
        turned = False
        for word in _WORD.findall(name):
            if not turned:
                found.append(word.lower())
            turned = word.lower() in WORDS_ABOUT
    return found


class PageLines(HTMLParser):
    """``lines`` of a page: (text, whether it is marked as boilerplate, how sure it is of the main text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, bool, int]] = []
        self._text: list[str] = []
        # Tag, whether unseen, whether marked, level; what holds for an element holds inside it.
        self._open: list[tuple[str, bool, bool, int]] = [("", False, False, OPEN)]
        self._count: dict[str, int] = {}

    @classmethod
    def of(cls, html: str) -> list[tuple[str, bool, int]]:
        reader = cls()
        reader.feed(html)
        reader.close()
        reader._end_line()
        return reader.lines

    def updatepos(self, i, j):
        return j  # line numbers are of no use here

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if not self._open[-1][1]:
            self._text.append(data)

    def _end_line(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                _, _, marked, level = self._open[-1]
                # A lone surrogate cannot be stored as UTF-8.
                self.lines.append((text.encode("utf-8", "replace").decode("utf-8"), marked, level))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_line()
            if self._count.get("p"):
                self._end_open(*_IN_PARAGRAPH)
            if tag in _ENDS:
                self._end_open(*_ENDS[tag])
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        _, unseen, marked, level = self._open[-1]
        values = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "itemprop")}
        unseen = unseen or tag in UNSEEN or "hidden" in values or values.get("aria-hidden") == "true"
        words = words_of(" ".join(values.get(k, "") for k in ("class", "id", "role"))) if values else ()
        if not marked and tag not in ("html", "body"):
            marked = tag in BESIDE or not WORDS_BESIDE.isdisjoint(words)
            marked = marked or (level < ARTICLE and (tag == "header" or not WORDS_ABOVE.isdisjoint(words)))
        if not marked:
            names = f"{values.get('class', '')} {values.get('id', '')}".lower().split() if values else ()
            if tag == "article" or "article" in values.get("role", ""):
                level = ARTICLE
            elif tag == "main" or values.get("role") == "main":
                level = max(level, MAIN)
            elif values.get("itemprop") == "articleBody" or not CONTENT.isdisjoint(names):
                level = max(level, NAMED)
        self._open.append((tag, unseen, marked, level))
        self._count[tag] = self._count.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_line()
        if self._count.get(tag):
            while self._open[-1][0] != tag:
                self._pop()
            self._pop()

    def _end_open(self, tags, borders):
        """Close the nearest open element of ``tags`` if there is no border inside it."""
        for k in range(len(self._open) - 1, 0, -1):
            name = self._open[k][0]
            if name in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if name in borders:
                return

    def _pop(self):
        self._count[self._open.pop()[0]] -= 1


#: Roles of lines: kept in any case; kept unless another page has them; not kept.
SURE, UNSURE, AWAY = 0, 1, 2


def lines_and_roles(html: str | None) -> tuple[list[str], list[int]]:
    """All lines of a page and their roles: those of articles are sure; without an article, those of the
    best level there is are unsure; marked ones and the rest are not kept."""
    lines = PageLines.of(html) if html else []
    best = max((level for _, marked, level in lines if not marked), default=OPEN)
    role = SURE if best == ARTICLE else UNSURE
    return [t for t, _, _ in lines], [AWAY if marked or level < best else role for _, marked, level in lines]
