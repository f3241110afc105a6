"""Clean text from blocks that still hold HTML, Markdown, wiki or LaTeX markup.

Every markup becomes one tree of HTML elements: Markdown, wiki and LaTeX are recognised by the shape of the block and
lowered to elements first, inline marks too. Every node of the tree gets its composite text density (characters per tag,
adjusted by the share that links hold), and a node's density sum is that of its children. The subtree of the greatest sum
is the content, and the lowest density on the path from it up to the body is the threshold: nodes outside of it that are
less dense are left out, headings aside. The elements on that path, and nothing else, give the role of the block.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names that count as markup, and the roles of elements and environments.
ELEMENTS = set(
    "a abbr acronym address article aside audio b base big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta nav "
    "nobr noscript nowiki object ol option p param pre q ref references s samp script section select small source span strike strong style sub summary sup "
    "syntaxhighlight table tbody td template textarea tfoot th thead time title tr tt u ul var video".split()
)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "wbr"}
DROPPED = {"script", "style", "template", "noscript", "iframe", "ref", "references", "head", "title"}
ROLE_OF_ELEMENT = {
    **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6"], "heading"), **dict.fromkeys(["li", "ul", "ol", "dl", "dt", "dd", "menu"], "list_item"), "blockquote": "quote",
    **dict.fromkeys(["pre", "syntaxhighlight", "source", "textarea"], "code"), **dict.fromkeys(["table", "tbody", "thead", "tr", "td", "th"], "table"), "math": "other",
    **dict.fromkeys(["p", "div", "section", "article", "main", "body", "center"], "paragraph"),
}
ROLE_OF_ENVIRONMENT = {
    **dict.fromkeys(["equation", "align", "gather", "multline", "eqnarray", "displaymath", "math", "flalign", "alignat"], "other"),
    **dict.fromkeys(["quote", "quotation", "verse"], "quote"), **dict.fromkeys(["verbatim", "lstlisting", "minted", "alltt", "Verbatim"], "code"),
    **dict.fromkeys(["tabular", "tabularx", "longtable", "table", "array"], "table"), **dict.fromkeys(["itemize", "enumerate", "description"], "list_item"),
}
#: Elements that content is never cut out of, those of one line, those whose white space counts, navigation, and what stays outside the content.
WHOLE = {"table", "ul", "ol", "dl", "menu", "blockquote", "pre", "math"}
TIGHT = {"tr", "li", "dt", "dd", "tbody", "thead", "tfoot"}
VERBATIM = {"pre", "syntaxhighlight", "source", "textarea"}
NAVIGATION = {"nav", "footer", "aside", "form", "menu"}
KEPT = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Roles in the order in which the outermost of several elements on the path gives way to a more telling one.
TELLING = ["code", "table", "quote", "list_item", "heading", "other", "paragraph"]

TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
COMMENT = re.compile(r"<!--.*?-->", re.S)
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

ATX = re.compile(r"\s{0,3}(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?\s*")
SETEXT = re.compile(r"\s{0,3}(\S[^\n]*)\r?\n\s{0,3}(={2,}|-{2,})\s*")
WIKI_HEADING = re.compile(r"\s*(={1,6})[ \t]*([^=\s].*?)[ \t]*\1\s*")
FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})[^\n`]*\r?\n(.*?)\r?\n?\s{0,3}\1\s*", re.S)
QUOTE_LINE = re.compile(r"\s{0,3}>[ \t]?")
LIST_ITEM = re.compile(r"[ \t]*(?:[-+•]|\*{1,6}|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
RULE_ROW = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*")
WIKI_TABLE = re.compile(r"\s*\{\|[^\n]*\n.*\|\}\s*", re.S)
DISPLAY = re.compile(r"\s*(?:\$\$(.+?)\$\$|\\\[(.+?)\\\])\s*", re.S)
ENVIRONMENT = re.compile(r"\s*\\begin\{([A-Za-z]+)(\*?)\}(?:\[[^\]]*\])?(?:\{[^{}]*\})?(.*?)\\end\{\1\2\}\s*", re.S)
SECTION = re.compile(r"\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{(.*)\}\s*", re.S)
ITEM = re.compile(r"\s*\\item(?:\[[^\]]*\])?\s+")

#: Inline marks, and the elements they stand for.
INLINE = [
    (re.compile(r"!\[([^\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"), r"<span>\1</span>"),
    (re.compile(r"\[([^\[\]\n]+)\]\((?:[a-zA-Z][a-zA-Z0-9+.-]*:|[/#.])?[^()\s]*[./#:][^()\s]*(?:\s+\"[^\"]*\")?\)"), r"<a>\1</a>"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]"), r"<a>\1</a>"),
    (re.compile(r"\{\{[^{}]+\}\}"), "<template></template>"),
    (re.compile(r"'''(?=\S)(.+?)'''", re.S), r"<b>\1</b>"),
    (re.compile(r"(?<!')''(?=[^\s'])(.+?)''(?!')", re.S), r"<i>\1</i>"),
    (re.compile(r"(`{1,2})(?=\S)([^`\n]+?)\1"), r"<code>\2</code>"),
    (re.compile(r"\*\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*\*", re.S), r"<b>\1</b>"),
    (re.compile(r"\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\*)", re.S), r"<b>\1</b>"),
    (re.compile(r"(?<![\w*])\*(?=[^\s*\d])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"), r"<i>\1</i>"),
    (re.compile(r"(?<!_)__(?=[^\s_])(.+?)(?<=[^\s_])__(?!_)", re.S), r"<b>\1</b>"),
    (re.compile(r"(?<![\w])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w])"), r"<i>\1</i>"),
    (re.compile(r"~~(?=\S)(.+?)(?<=\S)~~", re.S), r"<del>\1</del>"),
    (re.compile(r"~?\\(?:cite[a-z]*|ref|eqref|pageref|label|autoref|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), "<ref></ref>"),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r"<small> (\1)</small>"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"<a>\1</a>"),
    (re.compile(r"\\\((.+?)\\\)", re.S), r"<var>\1</var>"),
    (re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[\\^_{][^$\n]*?)(?<=[^\s$])\$(?![\d$])"), r"<var>\1</var>"),
    (re.compile(r"\\(?:emph|text[a-z]{2}|underline|mbox|uline|textsc|texttt)\{([^{}]*)\}"), r"<i>\1</i>"),
]
#: Any other LaTeX command with an argument; a Windows path has none.
COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")
#: Blocks without any of these characters hold no markup.
TRIGGER = re.compile(r"[<&\\$*_`\[{|#=>~']|^[ \t]*[-+•]|^[ \t]*\d{1,3}[.)]|\n\s{0,3}-{2,}\s*$")


# ---- HTML: tree and composite text density ----------------------------------------------------


@dataclass
class Node:
    tag: str
    parent: Node | None = None
    children: list = field(default_factory=list)
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    density_sum: float = 0.0


class _Tree(HTMLParser):
    """A forgiving tree of a fragment or page; unknown tags are text."""

    PARENTS = {"li": ({"ul", "ol", "menu"}, "ul"), "tr": ({"table", "tbody", "thead", "tfoot"}, "table"), "td": ({"tr"}, "tr"), "th": ({"tr"}, "tr"), "dt": ({"dl"}, "dl"), "dd": ({"dl"}, "dl")}
    IMPLIED = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.body = Node("body")
        self.at = self.body

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag not in ELEMENTS:
            self.handle_data(self.get_starttag_text() or "")
            return
        if self.at.tag in self.IMPLIED.get(tag, ()):
            self.at = self.at.parent
        # A part without the element it belongs to implies that element.
        missing, need = [], tag
        while need in self.PARENTS and self.at.tag not in self.PARENTS[need][0]:
            need = self.PARENTS[need][1]
            missing.append(need)
        for name in reversed(missing):
            above = Node(name, self.at)
            self.at.children.append(above)
            self.at = above
        node = Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID and not (self.get_starttag_text() or "").endswith("/>"):
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


def parse_html(text: str) -> Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    _measure(tree.body)
    return tree.body


def _own_text(node: Node) -> int:
    return sum(len("".join(x.split())) for x in node.children if isinstance(x, str))


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio`` is the share of link characters of the whole body."""
    if not chars:
        return 0.0
    tags, linked, links = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    inner = math.log(max(chars / linked * tags / links, 1.0 + 1e-9))
    # Without links the base is e, whose logarithm's logarithm is 0: there the adjustment is left out.
    base = math.log(math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e))
    return chars / tags * inner / (base if base > 1e-6 else 1.0)


def _measure(root: Node) -> None:
    """Counts and composite text density of every node, bottom up, without recursion."""
    order, stack = [], [(root, False)]
    linked = {}
    while stack:
        node, inside = stack.pop()
        order.append(node)
        linked[id(node)] = inside = inside or node.tag == "a"
        stack += [(c, inside) for c in node.children if isinstance(c, Node) and c.tag not in DROPPED]
    for node in reversed(order):
        own = _own_text(node)
        parts = [c for c in node.children if isinstance(c, Node) and c.tag not in DROPPED]
        node.chars = own + sum(c.chars for c in parts)
        node.tags = sum(c.tags + 1 for c in parts)
        node.link_chars = node.chars if linked[id(node)] else sum(c.link_chars for c in parts)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in parts)
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in reversed(order):
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
        # Text of its own counts as one child without tags.
        own = _own_text(node)
        text = _density(own, 0, own if linked[id(node)] else 0, 0, ratio)
        node.density_sum = text + sum(c.density for c in node.children if isinstance(c, Node) and c.tag not in DROPPED)


def main_content(body: Node) -> tuple[Node, float]:
    """(content, threshold): the subtree of the greatest density sum, and the lowest density on its path to the body.

    A part of a list, table, quotation or code stands for the whole of it; of subtrees one in another that hold the same
    characters the innermost is meant.
    """
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.density_sum > best.density_sum:
            best = node
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in DROPPED]
    node = best
    while node is not None:
        if node.tag in WHOLE:
            best = node
        node = node.parent
    while True:
        inner = [c for c in best.children if isinstance(c, Node) and c.chars]
        if len(inner) != 1 or inner[0].chars != best.chars or inner[0].tag in DROPPED:
            break
        best = inner[0]
    threshold, node = best.density, best
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _path(node: Node) -> list[str]:
    tags = []
    while node is not None:
        tags.append(node.tag)
        node = node.parent
    return tags[::-1]


def _left_out(body: Node, content: Node, threshold: float) -> set[int]:
    """Ids of the nodes that aren't content: outside of it those less dense than its path, headings aside; inside of it
    navigation, by its element or as two links or more that hold most of a block's text, that is less dense."""
    path, node = set(), content
    while node is not None:
        path.add(id(node))
        node = node.parent
    found: set[int] = set()
    stack = [(body, body is content)]
    while stack:
        node, inside = stack.pop()
        for child in node.children:
            if not isinstance(child, Node) or child.tag in DROPPED or (child.tag in KEPT and id(child) not in path):
                continue
            if child.chars and child.density < threshold and id(child) not in path:
                links = child.link_tags > 1 and 2 * child.link_chars > child.chars and child.tag in ROLE_OF_ELEMENT
                if not inside or child.tag in NAVIGATION or links:
                    found.add(id(child))
                    continue
            stack.append((child, inside or child is content))
    return found


def node_text(node: Node, without: set[int] | frozenset[int] = frozenset(), literal: bool = False) -> str:
    """Text of a subtree: table rows as lines of cells between bars, list items and blocks on lines of their own."""
    parts: list[str | None] = []
    # (what to write, or node to open, whether white space counts); an explicit stack, as markup nests without bound.
    stack: list[tuple[str | Node | tuple, bool]] = [(node, literal or any(t in VERBATIM for t in _path(node)))]
    edges = 0
    while stack:
        item, exact = stack.pop()
        if isinstance(item, tuple):
            # An edge between blocks: two of them make a blank line, those of rows and list items never do.
            edges = max(edges + (item[0] == "loose"), 1)
            continue
        if isinstance(item, str):
            piece = item if exact else re.sub(r"\s+", " ", item)
            if not edges or piece.strip():
                parts += ["\n" * min(edges, 2), piece.lstrip() if edges and not exact else piece]
                edges = 0
            continue
        todo: list[tuple[str | Node | tuple, bool]] = []
        cell = False
        for child in item.children:
            if isinstance(child, str):
                todo.append((child, exact))
                continue
            if child.tag in DROPPED or id(child) in without:
                continue
            if child.tag in ("br", "hr"):
                todo.append(("\n", True))
                continue
            if child.tag in ("td", "th"):
                todo += [(" | ", True)] if cell else []
                cell = True
            edge = [(("tight" if child.tag in TIGHT else "loose",), False)] if child.tag in ROLE_OF_ELEMENT and child.tag not in ("td", "th", "math") else []
            todo += [*edge, (child, exact or child.tag in VERBATIM), *edge]
        stack += reversed(todo)
    lines = [x.rstrip() for x in "".join(parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n ")


# ---- blocks -----------------------------------------------------------------------------------


def _has_tag(text: str) -> bool:
    return any(m[1].lower() in ELEMENTS for m in TAG.finditer(text)) or COMMENT.search(text) is not None


def _has_entity(text: str) -> bool:
    return any(html.unescape(m[0]) != m[0] for m in ENTITY.finditer(text))


def _shown(text: str) -> str:
    """HTML that shows a text as it is."""
    return html.escape(text, quote=False)


def _inline(text: str) -> tuple[str, bool]:
    """HTML source with inline marks as elements, and whether there were any."""
    found = False
    for pattern, into in INLINE:
        text, n = pattern.subn(into, text)
        found |= n > 0
    for _ in range(3):
        text, n = COMMAND.subn(r"<span>\1</span>", text)
        found |= n > 0
        if not n:
            break
    return text, found


def _lowered(piece: str) -> str:
    """HTML of a piece of text: tags and entities stay, inline marks become elements."""
    piece = piece.strip()
    return _inline(COMMENT.sub("", piece) if _has_tag(piece) or _has_entity(piece) else _shown(piece))[0]


def _rows(lines: list[str], cut: str) -> str:
    rows = [[c.strip() for c in re.split(cut, line.strip().strip("|"))] for line in lines if line.strip()]
    return "<table>" + "".join("<tr>" + "".join(f"<td>{_lowered(c)}</td>" for c in r) + "</tr>" for r in rows if any(r)) + "</table>"


def _items(pieces: list[str]) -> str:
    return "<ul>" + "".join(f"<li>{_lowered(x)}</li>" for x in pieces if x.strip()) + "</ul>"


def lower(body: str) -> str | None:
    """HTML of a block whose shape is that of Markdown, wiki or LaTeX markup; null for any other block."""
    if (m := FENCE.fullmatch(body)) is not None:
        return f"<pre>{_shown(m[2])}</pre>"
    if (m := ENVIRONMENT.fullmatch(body)) is not None and m[1] in ROLE_OF_ENVIRONMENT:
        role, inside = ROLE_OF_ENVIRONMENT[m[1]], m[3].strip("\r\n")
        if role == "table":
            bare = re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", inside.replace("\\\\", "\n"))
            return _rows(bare.split("\n"), r"(?<!\\)&")
        if role == "list_item":
            return _items(re.split(r"\\item(?:\[[^\]]*\])?", inside))
        return {"quote": f"<blockquote>{_lowered(inside)}</blockquote>", "code": f"<pre>{_shown(inside)}</pre>"}.get(role, f"<math>{_shown(inside)}</math>")
    if (m := DISPLAY.fullmatch(body)) is not None:
        return f"<math>{_shown((m[1] or m[2]).strip())}</math>"
    if (m := SECTION.fullmatch(body)) is not None:
        return f"<h2>{_lowered(m[1])}</h2>"
    if ITEM.match(body) is not None:
        return _items(re.split(r"\\item(?:\[[^\]]*\])?\s+", body))
    if WIKI_TABLE.fullmatch(body) is not None:
        lines = [x.strip() for x in body.split("\n")[1:-1]]
        kept = [re.sub(r"^[|!]\+?\s*", "", x) for x in lines if x and not x.startswith("|-")]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{_lowered(c)}</td>" for c in re.split(r"\|\||!!", x)) + "</tr>" for x in kept) + "</table>"

    lines = body.split("\n")
    if len(lines) > 1 and any("|" in x and RULE_ROW.fullmatch(x) for x in lines) and all("|" in x for x in lines if x.strip()):
        return _rows([x for x in lines if not RULE_ROW.fullmatch(x)], r"(?<!\\)\|")
    title = (m := ATX.fullmatch(body)) is not None and len(lines) == 1 and m[2]
    title = title or ((m := SETEXT.fullmatch(body)) is not None and m[1])
    title = title or (len(lines) == 1 and (m := WIKI_HEADING.fullmatch(body)) is not None and m[2])
    if title:
        return f"<h2>{_lowered(title)}</h2>"
    if all(QUOTE_LINE.match(x) for x in lines if x.strip()):
        return "<blockquote>" + "\n".join(_lowered(QUOTE_LINE.sub("", x, count=1)) for x in lines) + "</blockquote>"
    if LIST_ITEM.match(body) is not None and not re.fullmatch(r"[ \t]*\d{1,3}[.)][ \t]+.*", lines[0]):
        return _items([LIST_ITEM.sub("", x, count=1) for x in lines])
    return None


def _content(source: str, literal: bool) -> tuple[str, str | None]:
    """(text of the content, role its path gives to the whole block or null) of HTML source."""
    tree = parse_html(source)
    content, threshold = main_content(tree)
    without = _left_out(tree, content, threshold)
    around = _path(content)[1:]
    roles = {ROLE_OF_ELEMENT[t] for t in around if t in ROLE_OF_ELEMENT}
    if roles and content.chars < tree.chars:
        # Text that stays beside the content: the path doesn't speak for the whole block.
        kept = len("".join(node_text(tree, without, literal).split())) > len("".join(node_text(content, without, literal).split()))
        roles = set() if kept else roles
    return node_text(tree, without, literal), next((r for r in TELLING if r in roles), None)


def clean_block(text: str | None) -> tuple[str | None, str | None, bool]:
    """(clean text, role the markup gives to the whole block or null, whether there was markup)."""
    if not text or TRIGGER.search(text) is None:
        return text, None, False
    body = text.strip("\r\n")
    source = lower(body)
    if source is not None:
        return *_content(source, True), True
    if _has_tag(body):
        clean, role = _content(COMMENT.sub("", body), False)
        # Marks of another markup inside of HTML.
        if role not in ("code", "other"):
            source, found = _inline(_shown(clean))
            clean = _content(source, True)[0] if found else clean
        return clean, role, True
    entity = _has_entity(body)
    # What is still a tag after one unescaping was shown literally, so it stays as text.
    source, found = _inline(body if entity else _shown(body))
    return (*_content(source, True), True) if found or entity else (text, None, False)


def clean_markup(blocks: DataFrame, key: str, text: str, block_type: str, literal: str = "code") -> DataFrame:
    """One row per input row: (key, block_type, text, had_markup).

    * Blocks of type ``literal`` are taken as they are. Null and empty texts stay, without markup.
    * ``block_type`` becomes the role the markup gives to the whole block, else it stays (null stays null).
    * Repeated rows stay repeated, an empty table gives no rows, extra columns are ignored. Narrow: no exchange.
    """
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types, texts, flags = [], [], []
            for raw, stored in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                clean, role, found = (raw, None, False) if stored == literal else clean_block(raw)
                types.append(role if role is not None else stored)
                texts.append(clean)
                flags.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(types, pa.string()), pa.array(texts, pa.string()), pa.array(flags, pa.bool_())], names=["_key", "block_type", "text", "had_markup"])

    slim = blocks.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_t"), F.col(block_type).cast("string").alias("_b"))
    return slim.mapInArrow(run, f"_key {kind}, block_type string, text string, had_markup boolean").withColumnRenamed("_key", key)
