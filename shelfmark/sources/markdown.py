"""Markdown documents: a block scanner for the CommonMark subset with tables."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from shelfmark.sources.blocks import Parsed, ParseError

ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)")
RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*")
ITEM = re.compile(r"( *)([-+*]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
QUOTE = re.compile(r" {0,3}> ?")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*")
HTML_BLOCK = re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|center|dd|details|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|li|link|main|menu|meta|nav|ol|p|pre|script|section|style|summary|table|tbody|td|template|tfoot|th|thead|title|tr|ul)\b| {0,3}<!--", re.I)
INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]+)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]]+)\]\[[^\]]*\]"), r"\1"), (re.compile(r"<((?:https?|mailto):[^>]+)>"), r"\1"),
    (re.compile(r"</?[A-Za-z][^<>]*>"), ""), (re.compile(r"(\*{1,3})(?=\S)(.+?)(?<=\S)\1", re.S), r"\2"), (re.compile(r"(?<!\w)(_{1,3})(?=\S)(.+?)(?<=\S)\1(?!\w)", re.S), r"\2"), (re.compile(r"~~(.+?)~~", re.S), r"\1"),
]
CODE_SPAN = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)


def inline(text: str) -> str:
    """Text of inline markup; code spans are literal."""
    out, at = [], 0
    for found in CODE_SPAN.finditer(text):
        out += [_plain(text[at : found.start()]), found[2].strip()]
        at = found.end()
    out.append(_plain(text[at:]))
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n")]
    return "\n".join(lines).strip()


def _plain(text: str) -> str:
    for pattern, into in INLINE:
        text = pattern.sub(into, text)
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


class _Visible(HTMLParser):
    SKIPPED, BREAKING = {"noscript", "script", "style", "template"}, {"br", "div", "li", "p", "pre", "table", "td", "th", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self._tag(tag, 1)

    def handle_endtag(self, tag):
        self._tag(tag, -1)

    def _tag(self, tag, step):
        if tag in self.SKIPPED:
            self.depth = max(0, self.depth + step)
        elif tag in self.BREAKING and not self.depth:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def visible_text(source: str) -> str:
    """Text of an HTML block without scripts and styles, one line per block element."""
    parser = _Visible()
    parser.feed(source)
    parser.close()
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parser.parts).splitlines()) if x)


def parse_markdown(raw: bytes) -> Parsed:
    try:
        source = raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise ParseError("Markdown must be UTF-8") from None
    out = Parsed("markdown")
    lines = source.replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    _scan([(k + 1, line) for k, line in enumerate(lines)], out, None)
    out.title = next((b["text"] for b in out.blocks if b["attributes"].get("level") == 1), None)
    return out


def _scan(lines: list[tuple[int, str]], out: Parsed, inside: str | None) -> None:
    """Blocks of some lines; ``inside`` is list_item or quote where these lines stand in one."""
    at = 0
    while at < len(lines):
        number, line = lines[at]
        if not line.strip():
            at += 1
            continue
        if (m := FENCE.fullmatch(line)) is not None:
            end = at + 1
            while end < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*", lines[end][1]):
                end += 1
            text = "\n".join(x.removeprefix(m[1]) for _, x in lines[at + 1 : end]).strip()
            language = m[3].strip()
            out.add("code", text, line=number, last=lines[min(end, len(lines) - 1)][0], **({"language": language} if language else {}))
            at = end + 1
        elif (m := ATX.fullmatch(line)) is not None and (m[2] is not None or line.strip("# \t") == ""):
            out.add("heading", inline(m[2] or ""), level=len(m[1]), line=number, last=number)
            at += 1
        elif RULE.fullmatch(line) and not (ITEM.match(line) and not RULE.fullmatch(line)):
            at += 1
        elif QUOTE.match(line):
            end = at
            while end < len(lines) and (QUOTE.match(lines[end][1]) or (lines[end][1].strip() and not _starts(lines[end][1]))):
                end += 1
            _scan([(n, QUOTE.sub("", x, count=1)) for n, x in lines[at:end]], out, inside or "quote")
            at = end
        elif (m := ITEM.match(line)) is not None and len(m[1]) < 4:
            width = len(m[1]) + len(m[2]) + 1
            body, end = [(number, m[3] or "")], at + 1
            while end < len(lines):
                x = lines[end][1]
                indent = len(x) - len(x.lstrip(" "))
                blank = not x.strip()
                if not blank and indent < width and (_starts(x) or not lines[end - 1][1].strip()):
                    break
                body.append((lines[end][0], "" if blank else x[min(indent, width) :]))
                end += 1
            _scan(body, out, "list_item")
            at = end
        elif line.startswith("    "):
            end = at
            while end < len(lines) and (lines[end][1].startswith("    ") or not lines[end][1].strip()):
                end += 1
            while not lines[end - 1][1].strip():
                end -= 1
            out.add("code", "\n".join(x[4:] for _, x in lines[at:end]).strip(), line=number, last=lines[end - 1][0])
            at = end
        elif at + 1 < len(lines) and "|" in line and "-" in lines[at + 1][1] and TABLE_RULE.fullmatch(lines[at + 1][1]) and len(_cells(line)) == len(_cells(lines[at + 1][1])):
            end = at + 2
            while end < len(lines) and lines[end][1].strip() and not _starts(lines[end][1]):
                end += 1
            rows = [_cells(lines[k][1]) for k in range(at, end) if k != at + 1]
            out.add("table", "\n".join(" | ".join(inline(c) for c in r) for r in rows if any(r)), line=number, last=lines[end - 1][0])
            at = end
        elif HTML_BLOCK.match(line):
            end = at
            while end < len(lines) and lines[end][1].strip():
                end += 1
            out.add("other", visible_text("\n".join(x for _, x in lines[at:end])), line=number, last=lines[end - 1][0], source="html")
            at = end
        else:
            end = at + 1
            level = None
            while end < len(lines) and lines[end][1].strip():
                if (m := re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[end][1])) is not None:
                    level = 1 if m[1][0] == "=" else 2
                    break
                if _starts(lines[end][1]):
                    break
                end += 1
            text = inline("\n".join(x.strip() for _, x in lines[at:end]))
            if level is not None:
                out.add("heading", text, level=level, line=number, last=lines[end][0])
                end += 1
            else:
                out.add(inside or "paragraph", text, line=number, last=lines[end - 1][0])
            at = end


def _starts(line: str) -> bool:
    """Whether a line opens another block and so ends a paragraph."""
    item = ITEM.match(line)
    return bool(FENCE.fullmatch(line) or ATX.fullmatch(line) or RULE.fullmatch(line) or QUOTE.match(line) or HTML_BLOCK.match(line) or (item and item[3] and (item[2] in "-+*" or item[2][:-1] == "1")))


def _cells(row: str) -> list[str]:
    body = row.strip()
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]
