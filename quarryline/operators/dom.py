"""A small tolerant DOM over the standard library's HTML tokenizer, and the selectors that profiles use.

Trees are built as loosely as pages are written: void elements have no content, an end tag closes
the nearest open element of its name or is ignored, and whatever is open at the end is closed.

Plain markup is read by one regular expression; from the first place that it doesn't know, the
standard tokenizer takes over. Selectors look elements up in a page's index by id, class and tag.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from html import escape, unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the elements around them.
OPAQUE = frozenset(("script", "style", "template"))


class Document(list):
    """The elements of a page in order, with their places by tag, class and id; the index is made when it is first asked for."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, dict[str, list[int]]] | None = None

    def at(self, kind: str, value: str) -> Sequence[int]:
        if self.places is None:
            tags, classes, ids = (defaultdict(list) for _ in range(3))
            for at, e in enumerate(self):
                tags[e.name].append(at)
                if e.attrs:
                    if "class" in e.attrs:
                        for c in set(e.attrs["class"].split()):
                            classes[c].append(at)
                    if "id" in e.attrs:
                        ids[e.attrs["id"]].append(at)
            self.places = {"tag": tags, "class": classes, "id": ids}
        return self.places[kind].get(value, ())


class Element:
    """One element. In a document's list of elements it is at `at`, its descendants up to `end`."""

    __slots__ = ("name", "attrs", "parent", "children", "document", "at", "end")

    def __init__(self, name: str, attrs: dict[str, str], parent: Element | None, document: Document):
        self.name, self.attrs, self.parent, self.document = name, attrs, parent, document
        self.children: list[Element | tuple[str, str]] = []
        self.at = self.end = len(document)
        document.append(self)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def previous(self) -> Element | None:
        """The sibling element before this one."""
        if self.parent is None:
            return None
        before = None
        for child in self.parent.children:
            if child is self:
                return before
            if isinstance(child, Element):
                before = child
        return None

    def strings(self) -> Iterator[str]:
        todo: list[Element | tuple[str, str]] = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                if node[0] == "text":
                    yield node[1]
            elif node.name not in OPAQUE:
                todo.extend(reversed(node.children))

    def only_string(self) -> str | None:
        """The text of an element that holds one string and nothing else, at any depth."""
        node: Element | tuple[str, str] = self
        while isinstance(node, Element):
            if len(node.children) != 1:
                return None
            node = node.children[0]
        return node[1]

    def inner_html(self) -> str:
        out: list[str] = []
        todo: list[Element | tuple[str, str] | str] = list(reversed(self.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, tuple):
                kind, text = node
                raw = kind == "comment" or (kind == "text" and self.name in OPAQUE)
                out.append(f"<!--{text}-->" if kind == "comment" else text if raw or kind == "raw" else escape(text, quote=False))
            else:
                attrs = "".join(f' {k}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
                if node.name in VOID:
                    out.append(f"<{node.name}{attrs}/>")
                else:
                    out.append(f"<{node.name}{attrs}>")
                    todo.append(f"</{node.name}>")
                    todo.extend(reversed([("raw", c[1]) if isinstance(c, tuple) and c[0] == "text" and node.name in OPAQUE else c for c in node.children]))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.document = Document()
        self.root = self.open = Element("", {}, None, self.document)
        self.depth: dict[str, int] = {}

    def add(self, tag: str, attrs: dict[str, str]) -> None:
        child = Element(tag, attrs, self.open, self.document)
        self.open.children.append(child)
        if tag not in VOID:
            self.open = child
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self.add(tag, {k: v or "" for k, v in attrs})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def shut(self) -> Element:
        """Close what is open; returns the root."""
        while self.open is not self.root:
            self.handle_endtag(self.open.name)
        self.root.end = len(self.document) - 1
        return self.root

    def handle_endtag(self, tag):
        if self.depth.get(tag):
            end, depth, node, name = len(self.document) - 1, self.depth, self.open, None
            while name != tag:
                node.end, name = end, node.name
                depth[name] -= 1
                node = node.parent
            self.open = node

    def handle_data(self, data):
        children = self.open.children
        if children and type(last := children[-1]) is tuple and last[0] == "text":
            children[-1] = ("text", last[1] + data)
        else:
            children.append(("text", data))

    def handle_comment(self, data):
        self.open.children.append(("comment", data))

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])


#: What plain markup is made of: a text, an end tag, a start tag, a comment or a document type.
_TOKEN = re.compile(
    r"""(?P<text>[^<]+)|</(?P<end>[a-zA-Z][a-zA-Z0-9-]*)\s*>"""
    r"""|<(?P<tag>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>(?:\s+[a-zA-Z_][\w:.-]*(?:="[^"&<>]*"|='[^'&<>]*')?)*)\s*(?P<empty>/?)>"""
    r"""|<!--(?P<comment>[^<>-]+(?:-[^<>-]+)*)-->|(?P<type><!(?i:doctype)\s[^<>]*>)""",
    re.ASCII,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][\w:.-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
#: Elements whose content is no markup, or isn't for some tokenizers.
_RAW = re.compile("script|style|title|textarea|xmp|iframe|noembed|noframes|plaintext", re.I)


@functools.cache
def _content(tag: str) -> re.Pattern:
    """Content that ends at the first end tag of `tag`, and holds nothing that tokenizers might take for another end."""
    return re.compile(rf"((?:[^<]|<(?!!--|/\s*{tag}))*+)</{tag}\s*>", re.I)


def _read_odd(builder: _Builder, html: str, at: int) -> int:
    """One construct that isn't plain, by the standard tokenizer; returns where it ends, below 0 if it can't say."""
    builder.rawdata = html
    if html.startswith("<!--", at):
        return builder.parse_comment(at)
    if html.startswith("</", at):
        return builder.parse_endtag(at)
    if re.match("<[a-zA-Z]", html[at : at + 2]):
        return -1 if _RAW.match(html, at + 1) else builder.parse_starttag(at)
    if html[at + 1 : at + 2] in ("", "!", "?"):
        return -1
    builder.handle_data("<")
    return at + 1


def _read(builder: _Builder, html: str) -> int:
    """Build from a page; returns the place from which the standard tokenizer must read on."""
    at, n, token = 0, len(html), _TOKEN.match
    while at < n:
        m = token(html, at)
        if m is None:
            end = _read_odd(builder, html, at)
            if end < 0:
                return at
            at = end
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "text":
            text = m["text"]
            builder.handle_data(unescape(text) if "&" in text else text)
        elif kind == "end":
            builder.handle_endtag(m["end"].lower())
        elif kind == "comment":
            builder.handle_comment(m["comment"])
        elif kind == "empty":
            _, _, tag, attrs, empty, *_ = m.groups()
            tag = tag.lower()
            close = None
            if tag[0] in "stxinp" and _RAW.fullmatch(tag):
                close = _content(tag).match(html, end)
                if close is None or empty or (tag not in builder.CDATA_CONTENT_ELEMENTS and "<" in close[1]):
                    return at
            builder.add(tag, {k.lower(): a or b for k, a, b in _ATTRIBUTE.findall(attrs)} if attrs else {})
            if empty and tag not in VOID:
                builder.handle_endtag(tag)
            if close and tag in builder.CDATA_CONTENT_ELEMENTS:
                if close[1]:
                    builder.handle_data(close[1])
                builder.handle_endtag(tag)
                end = close.end()
        at = end
    return n


def _by_tokenizer(builder: _Builder, html: str) -> None:
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):  # declarations that the tokenizer gives up on; what came before stays
        pass


def parse(html: str) -> Element:
    """The root of a page's tree; never raises for a string."""
    builder = _Builder()
    at = _read(builder, html)
    if at < len(html):
        builder.rawdata = ""
        _by_tokenizer(builder, html[at:])
    return builder.shut()


_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[^\s.#\[:]+)|\#(?P<id>[^\s.#\[:]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<value>[^"]*)")?\]|:has-string\("(?P<string>[^"]*)"\))""")


@dataclass(frozen=True)
class Compound:
    """Tests of one element, and what it can be looked up by: an id, a class or a tag, the rarest first."""

    tests: tuple[Callable[[Element], bool], ...]
    key: tuple[str, str] | None

    def __call__(self, e: Element) -> bool:
        return all(t(e) for t in self.tests)


def _compound(text: str) -> Compound:
    """A test for `tag.class#id[attr][attr="whole"][attr*="part"]:has-string("part")`.

    A class equals the whole attribute where it is given as [class="..."]; [class*="..."] looks
    into each class and into the whole attribute, in any case.
    """
    tests: list[Callable[[Element], bool]] = []
    keys: dict[str, tuple[str, str]] = {}
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if m is None:
            raise ValueError(f"selector {text!r}")
        at = m.end()
        if m["tag"]:
            if m["tag"] != "*":
                keys["tag"] = ("tag", m["tag"])
            tests.append(lambda e, v=m["tag"]: v in ("*", e.name))
        elif m["cls"]:
            keys["class"] = ("class", m["cls"])
            tests.append(lambda e, v=m["cls"]: v in e.classes)
        elif m["id"]:
            keys["id"] = ("id", m["id"])
            tests.append(lambda e, v=m["id"]: e.attrs.get("id") == v)
        elif m["string"] is not None:
            tests.append(lambda e, v=m["string"]: v in (e.only_string() or ""))
        elif m["op"] == "*=":
            tests.append(lambda e, a=m["attr"], v=m["value"].lower(): v in e.attrs.get(a, "").lower())
        elif m["op"]:
            if m["attr"] == "class" and m["value"].split():
                keys.setdefault("class", ("class", m["value"].split()[-1]))
            tests.append(lambda e, a=m["attr"], v=m["value"]: (" ".join(e.classes) if a == "class" else e.attrs.get(a)) == v)
        else:
            tests.append(lambda e, a=m["attr"]: a in e.attrs)
    if not tests:
        raise ValueError("an empty selector")
    return Compound(tuple(tests), keys.get("id") or keys.get("class") or keys.get("tag"))


@functools.lru_cache(maxsize=512)
def _path(css: str) -> list[Compound]:
    parts = re.findall(r'(?:"[^"]*"|[^\s"])+', css)
    return [_compound(p) for p in parts]


def check_selector(selector: str) -> None:
    """Raise ValueError for a selector that find() can't run."""
    css, *axes = selector.split(" >> ")
    if not _path(css):
        raise ValueError(f"selector {selector!r}")
    for axis in axes:
        kind, _, test = axis.partition(" ")
        length = len(_path(test)) if test else 0
        if kind not in ("parent", "previous", "next", "in") or (kind in ("parent", "previous")) != (length == 0) or (kind == "next" and length != 1):
            raise ValueError(f"axis {axis!r} of {selector!r}")


def _candidates(root: Element, test: Compound, begin: int, end: int) -> Iterator[Element]:
    """Elements at begin to end that may match, in document order."""
    document = root.document
    if test.key is None:
        yield from (document[i] for i in range(begin, end + 1))
        return
    places = document.at(*test.key)
    for k in range(bisect_left(places, begin), len(places)):
        if places[k] > end:
            return
        yield document[places[k]]


def select(root: Element, css: str) -> Iterator[Element]:
    """Descendants that match a chain of compounds, in document order."""
    *outer, last = _path(css)
    for e in _candidates(root, last, root.at + 1, root.end):
        if last(e):
            node, need = e.parent, len(outer)
            while node is not None and need:
                need -= outer[need - 1](node)
                node = node.parent
            if not need:
                yield e


def find(root: Element, selector: str) -> Element | None:
    """The first match of `css >> axis >> axis`; axes: `parent`, `previous`, `next css`, `in css`."""
    css, *axes = selector.split(" >> ")
    node = next(select(root, css), None)
    for axis in axes:
        if node is None:
            return None
        kind, _, test = axis.partition(" ")
        if kind == "parent":
            node = node.parent
        elif kind == "previous":
            node = node.previous()
        elif kind == "next":
            (fits,) = _path(test)
            node = next((e for e in _candidates(node, fits, node.at + 1, len(node.document) - 1) if fits(e)), None)
        elif kind == "in":
            node = next(select(node, test), None)
        else:
            raise ValueError(f"axis {axis!r}")
    return node


def text_strip(e: Element) -> str:
    """All strings, each stripped, joined without anything between."""
    return "".join(s.strip() for s in e.strings())


def text_space(e: Element) -> str:
    """All strings that aren't blank, each stripped, joined by spaces."""
    return " ".join(t for s in e.strings() if (t := s.strip()))


def text_raw(e: Element) -> str:
    return "".join(e.strings())


#: How a profile reads a matched element.
READ: dict[str, Callable[[Element], str | None]] = {
    "strip": text_strip,
    "space": text_space,
    "raw": text_raw,
    "inner": Element.inner_html,
    "inner_strip": lambda e: e.inner_html().strip(),
    "string": lambda e: next((c[1] for c in e.children if isinstance(c, tuple)), None),
    "src": lambda e: e.attrs.get("src"),
}


def spec_rows(root: Element, rows: str, first_table: bool = False) -> list[dict]:
    """Cells of table rows: ord, table_idx, n_td, key (stripped, in the case it is written in), v1 (second cell), vlast."""
    tables = {id(t): i for i, t in enumerate(select(root, "table"))}
    out = []
    for row in select(root, rows):
        cells = list(select(row, "td"))
        node = row.parent
        while node is not None and node.name != "table":
            node = node.parent
        table = tables.get(id(node), -1)
        if not cells or (first_table and not _inside_first(row, tables)):
            continue
        out.append({"ord": len(out), "table_idx": table, "n_td": len(cells), "key": text_strip(cells[0]), "v1": text_strip(cells[1]) if len(cells) > 1 else None, "vlast": text_strip(cells[-1])})
    return out


def _inside_first(row: Element, tables: dict[int, int]) -> bool:
    node = row.parent
    while node is not None:
        if tables.get(id(node)) == 0:
            return True
        node = node.parent
    return False
