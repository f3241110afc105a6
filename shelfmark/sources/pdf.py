"""PDF documents with text in them: objects, pages, outline and text operators, with the standard library.

Fonts are read through their ToUnicode maps, else as Windows-1252. Scanned pages have no text and give no blocks.
"""

from __future__ import annotations

import datetime as dt
import re
import zlib
from typing import Any
from xml.etree import ElementTree as ET

from shelfmark.sources.blocks import Parsed, ParseError, first_distinct, iso_time, keyword_list, kept_lines, one_line

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
#: Bound of the unpacked content of one stream.
MOST_STREAM = 50 << 20

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\](){}/%]*|[^\s<>\[\](){}/%]+|[{}]", re.S)
OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b")


class Name(str):
    """A name object, without its slash."""


class Ref(int):
    """A reference to an object number."""


class Op(str):
    """A bare word: an operator or a keyword."""


def _literal(raw: bytes) -> bytes:
    body = raw[1:-1]
    escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}

    def one(m: re.Match) -> bytes:
        c = m[1]
        if c.isdigit():
            return bytes([int(c, 8) & 255])
        return b"" if c in (b"\n", b"\r", b"\r\n") else escapes.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, body, flags=re.S)


def values(raw: bytes) -> list[Any]:
    """Objects of a piece of PDF syntax in order; names, references and operators keep their kinds."""
    stack: list[list[Any]] = [[]]
    marks: list[bytes] = []
    for t in TOKEN.findall(raw):
        top = stack[-1]
        if t[:1] == b"%":
            continue
        if t in (b"<<", b"["):
            stack.append([])
            marks.append(t)
        elif t in (b">>", b"]"):
            if len(stack) == 1:
                continue
            items = stack.pop()
            marks.pop()
            stack[-1].append(dict(zip(items[::2], items[1::2])) if t == b">>" else items)
        elif t[:1] == b"(":
            top.append(_literal(t))
        elif t[:1] == b"<":
            digits = re.sub(rb"\s", b"", t[1:-1])
            top.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif t[:1] == b"/":
            top.append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), t[1:]).decode("latin-1")))
        elif re.fullmatch(rb"[+-]?\d+", t):
            top.append(int(t))
        elif re.fullmatch(rb"[+-]?\d*\.\d*", t) and t.strip(b"+-.") != b"":
            top.append(float(t))
        elif t == b"R" and len(top) >= 2 and isinstance(top[-1], int) and isinstance(top[-2], int):
            top.pop()
            top.append(Ref(top.pop()))
        else:
            top.append({b"true": True, b"false": False, b"null": None}.get(t, Op(t.decode("latin-1"))))
    while len(stack) > 1:
        items = stack.pop()
        stack[-1].append(items)
    return stack[0]


class Reader:
    def __init__(self, raw: bytes):
        if not raw[:1024].lstrip().startswith(b"%PDF-"):
            raise ParseError("not a PDF document")
        self.objects: dict[int, Any] = {}
        self.streams: dict[int, bytes] = {}
        trailers: list[dict] = []
        starts = list(OBJECT.finditer(raw))
        for k, m in enumerate(starts):
            stop = starts[k + 1].start() if k + 1 < len(starts) else len(raw)
            body = raw[m.end() : stop]
            cut = re.search(rb"\bstream\r?\n", body)
            head = values(body[: cut.start()] if cut else body.split(b"endobj")[0])
            self.objects[int(m[1])] = head[0] if head else None
            if cut and head and isinstance(head[0], dict):
                length = head[0].get("Length")
                data = body[cut.end() :]
                end = length if isinstance(length, int) and not isinstance(length, Ref) and data[length : length + 20].lstrip().startswith(b"endstream") else data.rfind(b"endstream")
                self.streams[int(m[1])] = data[:end] if end >= 0 else data
                if head[0].get("Type") == "XRef":
                    trailers.append(head[0])
        for m in re.finditer(rb"trailer\s*(<<.*?>>)\s*(?:startxref|$)", raw, re.S):
            trailers += [v for v in values(m[1]) if isinstance(v, dict)]
        self.trailer = {k: v for t in trailers for k, v in t.items()}
        if "Encrypt" in self.trailer:
            raise ParseError("document is encrypted")
        for number, head in list(self.objects.items()):
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                data, first = self.stream(number), self.get(head.get("First")) or 0
                index = values(data[:first])
                for a, b in zip(index[::2], index[1::2]):
                    found = values(data[first + b :])
                    self.objects.setdefault(a, found[0] if found else None)

    def get(self, value: Any) -> Any:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(int(value))
        return None

    def stream(self, number: int) -> bytes:
        head, data = self.objects[number], self.streams.get(number, b"")
        kinds = self.get(head.get("Filter"))
        for kind in kinds if isinstance(kinds, list) else [kinds] if kinds else []:
            if self.get(kind) not in ("FlateDecode", "Fl"):
                return b""
            engine = zlib.decompressobj()
            try:
                data = engine.decompress(data, MOST_STREAM)
            except zlib.error:
                return b""
            if engine.unconsumed_tail:
                raise ParseError("page content exceeds the limit")
        return data

    def pages(self) -> list[tuple[int, dict]]:
        """(object number, page with inherited resources) in order."""
        root = self.get(self.trailer.get("Root")) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
        out: list[tuple[int, dict]] = []
        stack = [(root.get("Pages"), None)]
        seen: set[int] = set()
        while stack:
            ref, resources = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and int(ref) in seen):
                continue
            if isinstance(ref, Ref):
                seen.add(int(ref))
            resources = node.get("Resources", resources)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, resources) for k in reversed(kids)]
            else:
                out.append((int(ref) if isinstance(ref, Ref) else -1, {**node, "Resources": resources}))
        self.root = root
        return out

    def outline(self, place: dict[int, int]) -> dict[int, list[str]]:
        """Page index -> titles from the top of the outline down to the last entry of that page."""
        out: dict[int, list[str]] = {}
        top = self.get(self.root.get("Outlines"))
        stack = [(top.get("First"), [])] if isinstance(top, dict) else []
        seen: set[int] = set()
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or int(ref) in seen:
                continue
            seen.add(int(ref))
            path = [*above, one_line(text_string(self.get(node.get("Title"))))]
            action = self.get(node.get("A"))
            target = self.get(node.get("Dest") or (action.get("D") if isinstance(action, dict) else None))
            if isinstance(target, list) and target and isinstance(target[0], Ref) and int(target[0]) in place:
                out[place[int(target[0])]] = path
            stack.append((node.get("Next"), above))
            stack.append((node.get("First"), path))
        return out

    def font_maps(self, page: dict) -> dict[str, tuple[int, dict[int, str]]]:
        """Font name -> (bytes a code, code -> text)."""
        resources = self.get(page.get("Resources")) or {}
        fonts = self.get(resources.get("Font")) or {}
        out = {}
        for name, ref in fonts.items():
            font = self.get(ref)
            cmap = font.get("ToUnicode") if isinstance(font, dict) else None
            if isinstance(cmap, Ref) and int(cmap) in self.streams:
                out[name] = _unicode_map(self.stream(int(cmap)))
        return out

    def page_text(self, page: dict) -> str:
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        data = b"\n".join(self.stream(int(r)) for r in refs if isinstance(r, Ref) and int(r) in self.streams)
        maps, current, parts, held = self.font_maps(page), None, [], []

        def show(raw: Any) -> None:
            if isinstance(raw, bytes):
                if current in maps:
                    width, table = maps[current]
                    parts.append("".join(table.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width)))
                else:
                    parts.append(raw.decode("windows-1252", "replace"))

        for v in values(data):
            if not isinstance(v, Op):
                held.append(v)
                continue
            if v == "Tf" and len(held) >= 2:
                current = held[-2]
            elif v == "Tj" and held:
                show(held[-1])
            elif v == "TJ" and held and isinstance(held[-1], list):
                for piece in held[-1]:
                    if isinstance(piece, bytes):
                        show(piece)
                    elif isinstance(piece, (int, float)) and piece < -200:
                        parts.append(" ")
            elif v in ("'", '"') and held:
                parts.append("\n")
                show(held[-1])
            elif v in ("Td", "TD") and len(held) >= 2 and isinstance(held[-1], (int, float)) and held[-1]:
                # A jump of more than one line leaves a blank line, which parts paragraphs.
                parts.append("\n\n" if abs(held[-1]) > 20 else "\n")
            elif v in ("T*", "ET"):
                parts.append("\n")
            held = []
        return "".join(parts)


def _unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    table: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "ignore")
    width = 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        pairs = values(block)
        for a, b in zip(pairs[::2], pairs[1::2]):
            table[int.from_bytes(a, "big")], width = text(b), len(a)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        triples = values(block)
        for a, b, c in zip(triples[::3], triples[1::3], triples[2::3]):
            low, width = int.from_bytes(a, "big"), len(a)
            for k in range(min(int.from_bytes(b, "big") - low + 1, 65536)):
                if isinstance(c, list):
                    table[low + k] = text(c[k]) if k < len(c) else ""
                else:
                    table[low + k] = text(c[:-2]) + chr(int.from_bytes(c[-2:], "big") + k)
    return width, table


def text_string(raw: Any) -> str:
    if not isinstance(raw, bytes):
        return ""
    return raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


def _date(raw: Any) -> dt.datetime | None:
    m = re.match(r"D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:(Z)|([+-])(\d\d)'?(\d\d)?)?", text_string(raw))
    if m is None:
        return None
    try:
        moment = dt.datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), tzinfo=dt.timezone.utc)
    except ValueError:
        return None
    shift = dt.timedelta(hours=int(m[9] or 0), minutes=int(m[10] or 0))
    return moment - shift if m[8] == "+" else moment + shift


def _default_language(alternatives: dict[str, str]) -> str | None:
    """The text of ``x-default`` of a table of languages, else the first one."""
    return alternatives.get("x-default") or next(iter(alternatives.values()), None)


def xmp_values(packet: bytes) -> dict[str, list[str]]:
    """Values of an XMP packet by name (``dc:title``); of alternatives in several languages the default one. A broken packet has none."""
    try:
        root = ET.fromstring(re.sub(rb"<\?xpacket[^>]*\?>", b"", packet).strip())
    except ET.ParseError:
        return {}
    prefix = {"http://purl.org/dc/elements/1.1/": "dc", "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/pdf/1.3/": "pdf"}
    named = lambda tag: f"{prefix.get(tag[1:].partition('}')[0], '?')}:{tag.rpartition('}')[2]}"
    out: dict[str, list[str]] = {}
    for about in root.iter(f"{RDF}Description"):
        out |= {named(k): [v] for k, v in about.attrib.items() if one_line(v)}
        for node in about:
            items = [(i.get("{http://www.w3.org/XML/1998/namespace}lang", ""), one_line(i.text)) for i in node.iter(f"{RDF}li")]
            if node.find(f"{RDF}Alt") is not None:
                found = [_default_language({lang: t for lang, t in items if t})]
            else:
                found = [t for _, t in items] or [one_line(node.text)]
            if texts := [t for t in found if t]:
                out[named(node.tag)] = texts
    return out


def parse_pdf(raw: bytes) -> Parsed:
    reader = Reader(raw)
    pages = reader.pages()
    if not pages:
        raise ParseError("document has no pages")
    out = Parsed("pdf", page_count=len(pages))
    info = reader.get(reader.trailer.get("Info"))
    info = info if isinstance(info, dict) else {}
    get = lambda key: one_line(text_string(reader.get(info.get(key))))
    packet = reader.root.get("Metadata")
    xmp = xmp_values(reader.stream(int(packet))) if isinstance(packet, Ref) and int(packet) in reader.streams else {}
    first = lambda name: next(iter(xmp.get(name, [])), "")
    out.title = get("Title") or first("dc:title") or None
    out.authors = first_distinct([*xmp.get("dc:creator", []), *filter(None, [get("Author")])])
    out.created_at = _date(reader.get(info.get("CreationDate"))) or iso_time(first("xmp:CreateDate"))
    out.content_modified_at = _date(reader.get(info.get("ModDate"))) or iso_time(first("xmp:ModifyDate"))
    out.language = first("dc:language") or one_line(text_string(reader.get(reader.root.get("Lang")))) or None
    stated = {"subject": get("Subject") or first("dc:description"), "creator": get("Creator"), "producer": get("Producer") or first("pdf:Producer")}
    out.properties = {k: v for k, v in stated.items() if v}
    out.properties["pdf_version"] = raw[raw.find(b"%PDF-") + 5 :][:3].decode("latin-1")
    if words := first_distinct([*keyword_list(get("Keywords")), *keyword_list(first("pdf:Keywords")), *xmp.get("dc:subject", [])]):
        out.properties["keywords"] = words
    outline = reader.outline({number: k for k, (number, _) in enumerate(pages)})
    section: list[str] = []
    for k, (_, page) in enumerate(pages):
        section = outline.get(k, section)
        for paragraph in re.split(r"\n[ \t]*\n+", reader.page_text(page)):
            out.add("paragraph", one_line(kept_lines(paragraph)), section=section, page=k + 1)
    return out
