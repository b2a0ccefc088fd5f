"""One page of HTML as one fold over its tokens.

Spark's higher-order functions have no running state that grows in linear time (``aggregate`` copies its accumulator at every
step), and windows over exploded tokens move every page through a shuffle. So the element builder is a small function over one
page, used by the Arrow functions of ``weft.operators.html``: a single pass that keeps running counts (text tokens, cells, rows),
nesting levels, and the elements still open; every element's text is a slice of the page's text tokens.

The token pattern is shared with Spark (``regexp_extract_all``): it uses only what Java's and Python's regular expressions have
in common, and possessive steps, so that a token takes one pass.
"""

from __future__ import annotations

import re
from html import entities

# -- tokens ----------------------------------------------------------------------------------------------------------------

_WS = r"[ \t\n\f\r]"
_ATTRIBUTES = (rf"(?:[ \t\n\f\r/]*+(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)"
               rf"(?:{_WS}*+={_WS}*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|(?![\"'])[^ \t\n\f\r>]*+))?+)*+[ \t\n\f\r/]*+")
# Elements whose content is not markup. Character references count in the first two only.
DECODED_ELEMENTS = ("title", "textarea")
RAW_ELEMENTS = ("script", "style", "iframe", "xmp", "noembed", "noframes")
_WHOLE = "|".join((*DECODED_ELEMENTS, *RAW_ELEMENTS))

#: Comments (also unclosed ones, to the end); an element of raw content as one token, to its end tag or the end of the page;
#: ``plaintext`` to the end; ``<!...>``, ``<?...>`` and ``</`` before no letter; tags, whose quoted values may hold '>' and which
#: an unclosed quote carries to the end; text; a lone '<'. Groups: raw element's name, its content, plaintext's content.
#: ``$`` stands for the end of the page: a newline before it is text or blank.
TOKEN_RE = (rf"(?is)<!--(?:-?>|.*?(?:--!?>|$))"
            rf"|<({_WHOLE})(?=[ \t\n\f\r/>]){_ATTRIBUTES}>(.*?)(?:</\1(?=[ \t\n\f\r/>])[^>]*+(?:>|$)|$)"
            rf"|<plaintext(?=[ \t\n\f\r/>]){_ATTRIBUTES}>(.*)"
            rf"|<[!?][^>]*+(?:>|$)|</(?![a-z]|$)[^>]*+(?:>|$)"
            rf"|</?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}(?:>|$)|[^<]++|<").replace("$", r"(?![\s\S])")
#: A whole tag; a token that begins like one and is none was cut off by the end of the page, and counts for nothing.
TAG_RE = rf"(?is)^</?[a-z][^ \t\n\f\r/>]*+{_ATTRIBUTES}>".replace("$", r"(?![\s\S])")

_TOKEN, _TAG_NAME = re.compile(TOKEN_RE, re.A), re.compile(r"</?([a-z][^ \t\n\f\r/>]*)", re.A | re.I)
_WHOLE_TAG = re.compile(TAG_RE, re.A)
_HREF = re.compile(rf"(?is)^<[a-z][^ \t\n\f\r/>]*+(?:[ \t\n\f\r/]*+(?!href[ \t\n\f\r=/>])(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)"
                   rf"(?:{_WS}*+={_WS}*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^ \t\n\f\r>]*+))?+)*+"
                   rf"[ \t\n\f\r/]*+href(?=[ \t\n\f\r=/>])(?:{_WS}*+={_WS}*+(\"[^\"]*+\"|'[^']*+'|[^ \t\n\f\r>]*+))?+", re.A)

# -- text ------------------------------------------------------------------------------------------------------------------

# The JavaScript \s class (ASCII white space, NBSP, Ogham space, U+2000-U+200A, line and paragraph separators,
# narrow NBSP, mathematical space, ideographic space, BOM).
_SPACES = re.compile("[ \t\n\x0b\f\r\xa0  -     　﻿]+")
# What numeric references from 128 to 159 stand for (Windows-1252; unassigned ones stay).
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
_REFERENCE = re.compile(r"&(?:#x[0-9a-f]+;?|#[0-9]+;?|[a-z][a-z0-9]*[;=]?)", re.I | re.A)


def clean(text: str) -> str:
    """White-space runs as one space, none at the ends."""
    return _SPACES.sub(" ", text).strip(" ")


def decoded(text: str, attribute: bool = False) -> str:
    """Character references decoded, as ``weft.functions.text.decode_entities`` does."""
    if "&" not in text:
        return text

    def one(m: re.Match) -> str:
        ref = m[0]
        if ref[1] == "#":
            hexadecimal = ref[2] in "xX"
            digits = ref[3 if hexadecimal else 2 :].rstrip(";").lstrip("0")
            code = 0x110000 if len(digits) > 7 else int(digits or "0", 16 if hexadecimal else 10)
            if 128 <= code < 160:
                return C1[code - 128]
            return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF else chr(code)
        if ref[-1] == "=":
            value = None if attribute else entities.html5.get(ref[1:-1])
            return ref if value is None else value + "="
        return entities.html5.get(ref[1:], ref)

    return _REFERENCE.sub(one, text)


# -- elements --------------------------------------------------------------------------------------------------------------

# Groups of HTML tags, for implied ends and nesting.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
             "wbr", "param", "keygen", "frame"]
PHRASING_TAGS = ["a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "dfn", "em", "font", "i", "kbd",
                 "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strong", "sub", "sup", "time",
                 "u", "var", "label", "button", "select", "option", "textarea", "nobr", "big", "tt", "strike"]
P_CLOSING_OPEN = ["address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
                  "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
                  "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
                  "summary", "table", "ul", "li", "dd", "dt", "listing", "plaintext", "xmp", "search"]
BLOCK_CLOSE = P_CLOSING_OPEN + ["body", "html", "td", "th", "tr", "caption", "tbody", "thead", "tfoot"]
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
HEADING_CLOSE = ["body", "html", "td", "th", "tr", "table", "li"]
LIST_TAGS = ["ul", "ol", "dl"]
ITEM_TAGS = ["li", "dt", "dd"]
ROW_GROUP_TAGS = ["tbody", "thead", "tfoot"]
FOREIGN_TAGS = ["svg", "math"]  # inside these, '/>' closes a tag and unknown names are no HTML
HEAD_TAGS = ["html", "head", "meta", "link", "base", "noscript", "template"]
LIST_TYPES = {"ol": "ordered", "dl": "definition", "ul": "unordered"}

_OPEN_ENDS_P, _CLOSE_ENDS_P = frozenset(P_CLOSING_OPEN), frozenset(BLOCK_CLOSE)
_HEADINGS, _CLOSE_ENDS_H = frozenset(HEADINGS), frozenset(HEADINGS + HEADING_CLOSE)
_LISTS, _ITEMS, _FOREIGN, _HEAD = frozenset(LIST_TAGS), frozenset(ITEM_TAGS), frozenset(FOREIGN_TAGS), frozenset(HEAD_TAGS)
_ROW_ENDS, _CELLS = frozenset(["tr", *ROW_GROUP_TAGS]), frozenset(["td", "th"])
_NOT_STRUCTURAL = frozenset(VOID_TAGS + PHRASING_TAGS + ["p", "li", "dt", "dd", "html", "head", "body"] + LIST_TAGS + FOREIGN_TAGS)


class _Element:
    __slots__ = ("pos", "tag", "href", "start", "end", "depth", "level", "counts", "end_counts", "items")

    def __init__(self, pos: int, tag: str, start: int, counts: tuple[int, int, int], href: str | None = None):
        self.pos, self.tag, self.start, self.counts, self.href = pos, tag, start, counts, href
        self.end = self.end_counts = None  # None: at the end of the page
        self.depth = self.level = 0
        self.items: list[_Element] = []


class _Nest:
    """Tokens of one depth of lists and tables: elements not yet ended, and how many structural elements are open.

    What a list item opens and does not close ends with the item's end tag: the balance since the item's start (``since``)
    counts only if another item's start comes first."""
    __slots__ = ("items", "tables", "rows", "cells", "open", "since", "in_item", "waiting", "container")

    def __init__(self):
        self.items, self.tables, self.rows, self.cells, self.waiting = [], [], [], [], []
        self.open, self.since, self.in_item, self.container = 0, 0, False, None

    def settle(self, counts: bool) -> None:
        for e, since in self.waiting:
            e.level += since if counts else 0
        self.open += self.since if counts else 0
        self.since, self.waiting = 0, []

    def place(self, e: _Element) -> None:
        e.level = self.open
        if self.in_item:
            self.waiting.append((e, self.since))


class Page:
    """Everything the extracted elements need, from one pass over a page's tokens."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.title = None
        self.headings, self.paragraphs, self.anchors, self.lists, self.tables, self.rows, self.cells = [], [], [], [], [], [], {"td": [], "th": []}
        self._fold(html)

    def text(self, e: _Element) -> str:
        return clean("".join(self.texts[e.start : e.end]))

    def _fold(self, html: str) -> None:
        texts, nests, containers = self.texts, {}, {}
        open_p, open_h, open_a = [], [], []
        lists = tables = foreign = n_td = n_th = n_tr = 0
        body = head = None
        begun = False
        for pos, m in enumerate(_TOKEN.finditer(html)):
            token = m[0]
            if token[0] != "<" or token == "<":
                begun = begun or not token.isspace()
                texts.append(decoded(token))
                continue
            raw = m[1]
            if raw is not None:
                raw = raw.lower()
                if raw == "title":
                    content = decoded(m[2])
                    if self.title is None:
                        self.title = content
                    if begun:
                        texts.append(content)
                elif raw not in ("script", "style"):
                    begun = True
                    if raw == "xmp":
                        _ended(open_p, len(texts), None)
                    texts.append(decoded(m[2]) if raw in DECODED_ELEMENTS else m[2])
                continue
            if m[3] is not None:
                begun = True
                _ended(open_p, len(texts), None)
                texts.append(m[3])
                continue
            name = _TAG_NAME.match(token)
            if name is None or (m.end() == len(html) and not _WHOLE_TAG.match(token)):
                continue
            tag, opens, at = name[1].lower(), token[1] != "/", len(texts)
            # running counts and depths, this token included; an end tag belongs to the depth it ends
            list_depth, table_depth = lists, tables
            if tag in _LISTS:
                lists = lists + 1 if opens else max(0, lists - 1)
                list_depth = max(list_depth, lists) if not opens else lists
            elif tag == "table":
                tables = tables + 1 if opens else max(0, tables - 1)
                table_depth = max(table_depth, tables) if not opens else tables
            elif tag in _FOREIGN:
                if not opens:
                    foreign = max(0, foreign - 1)
                elif not token.endswith("/>"):
                    foreign += 1
            elif opens:
                n_td += tag == "td"
                n_th += tag == "th"
                n_tr += tag == "tr"
            counts = (n_td, n_th, n_tr)
            nest = nests.get((list_depth, table_depth))
            if nest is None:
                nest = nests[list_depth, table_depth] = _Nest()
            # what this token ends
            if open_p and tag in (_OPEN_ENDS_P if opens else _CLOSE_ENDS_P):
                _ended(open_p, at, counts)
            if open_h and tag in (_HEADINGS if opens else _CLOSE_ENDS_H):
                _ended(open_h, at, counts)
            if open_a and tag == "a":
                _ended(open_a, at, counts)
            if tag in _ITEMS:
                _ended(nest.items, at, counts)
                nest.settle(opens)
                nest.in_item = opens
            elif tag in _LISTS and not opens:
                _ended(nest.items, at, counts)
            elif tag == "table" and not opens:
                for waiting in (nest.tables, nest.rows, nest.cells):
                    _ended(waiting, at, counts)
            elif tag in _ROW_ENDS:
                _ended(nest.rows, at, counts)
                _ended(nest.cells, at, counts)
            elif tag in _CELLS:
                _ended(nest.cells, at, counts)
            if foreign == 0 and tag not in _NOT_STRUCTURAL:
                if nest.in_item:
                    nest.since += 1 if opens else -1
                else:
                    nest.open += 1 if opens else -1
            if not opens:
                if tag == "head" and head is None:
                    head, begun = at, True
                continue
            begun = begun or tag not in _HEAD
            # what it begins
            if tag == "body":
                body = at if body is None else body
            elif tag == "p":
                open_p.append(_Element(pos, tag, at, counts))
                self.paragraphs.append(open_p[-1])
            elif tag in _HEADINGS:
                open_h.append(_Element(pos, tag, at, counts))
                self.headings.append(open_h[-1])
            elif tag == "a":
                href = _HREF.match(token)
                if href is not None:
                    value = href[1] or ""
                    if value[:1] in ("'", '"'):
                        value = value[1:-1]
                    open_a.append(_Element(pos, tag, at, counts, decoded(value, True)))
                    self.anchors.append(open_a[-1])
            elif tag in _LISTS:
                e = containers[list_depth] = _Element(pos, tag, at, counts)
                nest.place(e)
                self.lists.append(e)
            elif tag in _ITEMS:
                e = _Element(pos, tag, at, counts)
                nest.place(e)
                nest.items.append(e)
                if list_depth in containers:
                    containers[list_depth].items.append(e)
            elif tag == "table":
                nest.tables.append(_Element(pos, tag, at, counts))
                self.tables.append(nest.tables[-1])
            elif tag == "tr":
                nest.rows.append(_Element(pos, tag, at, counts))
                self.rows.append(nest.rows[-1])
            elif tag in _CELLS:
                nest.cells.append(_Element(pos, tag, at, counts))
                self.cells[tag].append(nest.cells[-1])
        for nest in nests.values():
            nest.settle(True)
        self.start = body if body is not None else head or 0

    # Rows of the extracted kinds, in the order in which they are reported; pos first.

    def raw_text(self) -> str:
        lines = map(clean, "".join(self.texts[self.start :]).split("\n"))
        return "\n".join(line for line in lines if line)

    def heading_rows(self):
        return [(e.pos, int(e.tag[1]), self.text(e)) for e in sorted(self.headings, key=lambda e: (e.tag, e.pos))]

    def paragraph_rows(self):
        return [(e.pos, text) for e in self.paragraphs if (text := self.text(e))]

    def list_rows(self):
        out = []
        for e in self.lists:
            wanted = ("dt", "dd") if e.tag == "dl" else ("li",)
            items = [self.text(i) for i in e.items if i.tag in wanted and i.level == e.level]
            out.append((e.pos, LIST_TYPES[e.tag], "\n".join(items), items))
        return out

    def table_rows(self):
        if not self.tables:
            return []
        data, headers = ([self.text(e) for e in self.cells[tag]] for tag in ("td", "th"))
        ends = (len(data), len(headers), len(self.rows))
        rows = [data[e.counts[0] : (e.end_counts or ends)[0]] for e in self.rows]
        # a table's header cells and rows begin after it and before its end; counts at its own tag hold none of them
        return [(e.pos, "", headers[e.counts[1] : (e.end_counts or ends)[1]], [r for r in rows[e.counts[2] : (e.end_counts or ends)[2]] if r]) for e in self.tables]

    def anchor_rows(self):
        return [(e.pos, text, e.href) for e in self.anchors if e.href and (text := self.text(e))]


def _ended(waiting: list[_Element], at: int, counts: tuple[int, int, int] | None) -> None:
    for e in waiting:
        e.end, e.end_counts = at, counts
    waiting.clear()
