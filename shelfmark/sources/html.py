"""HTML documents: metadata, and blocks in document order, from one pass of the standard parser."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

from shelfmark.sources.blocks import Parsed, first_distinct, iso_time, one_line

HEADINGS = {f"h{k}": k for k in range(1, 7)}
HIDDEN = {"iframe", "noscript", "script", "style", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {*HEADINGS, "p", "li", "blockquote", "pre", "code", "table"}
#: Block tag -> ancestors inside of which it makes no block of its own.
SWALLOWED = {**dict.fromkeys(HEADINGS, {"li", "pre", "table"}), "p": {"li", "pre", "table"}, "li": {"pre", "table"}, "blockquote": set(), "pre": {"table"}, "code": {*HEADINGS, "blockquote", "li", "p", "pre", "table"}, "table": {"table"}}
#: Inside a quotation these make blocks of their own.
QUOTE_PARTS = {*HEADINGS, "blockquote", "li", "p", "pre", "table"}


class Element:
    __slots__ = ("tag", "attrs", "line", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None], line: int, parent: Element | None):
        self.tag, self.attrs, self.line, self.parent, self.children = tag, attrs, line, parent, []

    def ancestors(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def walk(self):
        """Elements and strings below, in document order, each with its parent element; without recursion."""
        stack = [(self, c) for c in reversed(self.children)]
        while stack:
            parent, node = stack.pop()
            yield parent, node
            if isinstance(node, Element):
                stack += [(node, c) for c in reversed(node.children)]

    def find(self, *tags: str) -> Element | None:
        return next((n for _, n in self.walk() if isinstance(n, Element) and n.tag in tags), None)

    def text(self, joint: str = " ") -> str:
        return joint.join(n for _, n in self.walk() if isinstance(n, str))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, 0, None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, dict(attrs), self.getpos()[0], self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): byte order mark, else declared charset, else UTF-8, else Windows-1252."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name.removesuffix("-sig")
    declared = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-:]+)", raw[:4096], re.I)
    for name in ([declared[1].decode("ascii")] if declared else []) + ["utf-8"]:
        try:
            return raw.decode(name), codecs.lookup(name).name
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("windows-1252", "replace"), "windows-1252"


def parse_html(raw: bytes) -> Parsed:
    source, encoding = decode(raw)
    builder = _Builder()
    builder.feed(source)
    builder.close()
    root = builder.root
    out = Parsed("html")
    _metadata(root, out, encoding)
    _drop_hidden(root)
    for _, node in (root.find("body") or root).walk():
        if isinstance(node, Element) and node.tag in BLOCKS:
            _block(node, out)
    return out


def _drop_hidden(root: Element) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not (isinstance(c, Element) and c.tag in HIDDEN)]
        stack += [c for c in node.children if isinstance(c, Element)]


def _block(node: Element, out: Parsed) -> None:
    around = {a.tag for a in node.ancestors()}
    tag = node.tag
    if around & SWALLOWED[tag]:
        return
    quoted = "blockquote" in around
    if tag in HEADINGS:
        out.add("heading", one_line(node.text()), level=HEADINGS[tag], line=node.line)
    elif tag == "p":
        out.add("quote" if quoted else "paragraph", one_line(node.text()), line=node.line)
    elif tag == "li":
        own = [t for p, t in node.walk() if isinstance(t, str) and _nearest(p, {"li"}) is node]
        out.add("list_item", one_line(" ".join(own)), line=node.line, **({"quoted": True} if quoted else {}))
    elif tag == "blockquote":
        own = [t for p, t in node.walk() if isinstance(t, str) and _nearest(p, QUOTE_PARTS) is node]
        out.add("quote", one_line(" ".join(own)), line=node.line)
    elif tag == "table":
        rows = [[one_line(c.text()) for c in r.children if isinstance(c, Element) and c.tag in ("td", "th")] for _, r in node.walk() if isinstance(r, Element) and r.tag == "tr"]
        out.add("table", "\n".join(" | ".join(r) for r in rows if r), line=node.line)
    else:
        out.add("code", _lines(node.text("")), line=node.line, **_language(node))


def _lines(text: str) -> str:
    """Code as it stands, with one kind of line break and none at its ends."""
    return re.sub(r"\r\n?", "\n", text.replace("\x00", "")).strip("\n")


def _language(node: Element) -> dict[str, str]:
    """The language that a class of the code names, as an attribute."""
    inner = node.find("code") if node.tag == "pre" else node
    named = re.search(r"(?:^|\s)lang(?:uage)?-(\S+)", (inner.attrs.get("class") or "") if inner is not None else "")
    return {"language": named[1]} if named else {}


def _nearest(node: Element, tags: set[str]) -> Element | None:
    while node is not None and node.tag not in tags:
        node = node.parent
    return node


def _metadata(root: Element, out: Parsed, encoding: str) -> None:
    pairs = [(n.attrs, one_line(n.attrs.get("content"))) for _, n in root.walk() if isinstance(n, Element) and n.tag == "meta"]
    named = [(next((k for a in ("name", "property", "http-equiv") if (k := at.get(a))), "").strip().casefold(), value) for at, value in pairs if value]
    metas = {key: [v for k, v in named if k == key] for key in dict(named) if key}
    every = lambda *keys: [v for k in keys for v in metas.get(k, [])]
    first = lambda *keys: next(iter(every(*keys)), None)
    title, heading = root.find("title"), root.find("h1")
    out.title = (title and one_line(title.text())) or first("og:title", "twitter:title") or (heading and one_line(heading.text())) or None
    out.authors = first_distinct(every("author", "article:author", "dc.creator", "dcterms.creator"))
    out.created_at = next((t for v in every("article:published_time", "created", "date", "dc.date", "dcterms.created") if (t := iso_time(v))), None)
    out.content_modified_at = next((t for v in every("article:modified_time", "dcterms.modified", "modified") if (t := iso_time(v))), None)
    page = root.find("html")
    out.language = ((page.attrs.get("lang") or page.attrs.get("xml:lang") or "").strip() if page else "") or first("content-language")
    words = [w for v in metas.get("keywords", []) for w in map(str.strip, v.split(",")) if w]
    found = {"encoding": encoding, "description": first("description", "og:description", "twitter:description"), "keywords": words, "generator": first("generator")}
    out.properties = {k: v for k, v in found.items() if v}


__all__ = ["decode", "parse_html"]
