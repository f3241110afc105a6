"""DOCX and PPTX documents, read from their archives with the standard library."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from shelfmark.sources.blocks import Parsed, ParseError, keyword_list, kept_lines, one_line

#: Bounds of an archive: unpacked bytes and members.
MOST_BYTES, MOST_MEMBERS = 256 << 20, 10_000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"
CORE = {"dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/", "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties"}
HEADING = re.compile(r"heading ([1-9])", re.I)


def _open(raw: bytes, required: str) -> zipfile.ZipFile:
    if raw[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ParseError("document is encrypted or of an old format")
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        raise ParseError("document is not a readable archive") from None
    members = archive.infolist()
    if len(members) > MOST_MEMBERS or sum(m.file_size for m in members) > MOST_BYTES:
        raise ParseError("document archive exceeds the limits")
    if any(m.flag_bits & 1 for m in members):
        raise ParseError("document is encrypted")
    if required not in archive.namelist():
        raise ParseError(f"document lacks {required}")
    return archive


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in archive.namelist():
        return None
    try:
        return ET.fromstring(archive.read(name))
    except (ET.ParseError, zipfile.BadZipFile, OSError) as error:
        raise ParseError(f"{name} can't be read: {error}") from None


def _core(archive: zipfile.ZipFile, out: Parsed, keys: list[str]) -> dict[str, str]:
    root = _xml(archive, "docProps/core.xml")
    get = lambda path: one_line(root.findtext(path, "", CORE)) if root is not None else ""
    out.title, out.language = get("dc:title") or None, get("dc:language") or None
    out.authors = [get("dc:creator")] if get("dc:creator") else []
    out.created_at, out.content_modified_at = _utc(get("dcterms:created")), _utc(get("dcterms:modified"))
    paths = {"category": "cp:category", "comments": "dc:description", "content_status": "cp:contentStatus", "identifier": "dc:identifier", "last_modified_by": "cp:lastModifiedBy", "subject": "dc:subject", "version": "cp:version"}
    out.properties.update({k: v for k in keys if (v := get(paths[k]))})
    if words := keyword_list(get("cp:keywords")):
        out.properties["keywords"] = words
    if get("cp:revision").isdigit():
        out.properties["revision"] = int(get("cp:revision"))
    return {"last_printed": get("cp:lastPrinted")}


def _utc(text: str) -> dt.datetime | None:
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (kind, part name)."""
    folder, name = posixpath.split(part)
    root = _xml(archive, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root.iter(f"{REL}Relationship") if root is not None else ():
        target = r.get("Target", "")
        out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target)))
    return out


# ---- DOCX -------------------------------------------------------------------------------------


def _runs(node: ET.Element) -> str:
    """Text of a paragraph; tabs and breaks are kept as characters."""
    parts = []
    for x in node.iter():
        if x.tag == f"{W}t":
            parts.append(x.text or "")
        elif x.tag == f"{W}tab" and x.get(f"{W}val") is None and x.get(f"{W}pos") is None:
            parts.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            parts.append("\n")
    return "".join(parts)


def parse_docx(raw: bytes) -> Parsed:
    archive = _open(raw, "word/document.xml")
    out = Parsed("docx")
    _core(archive, out, ["category", "content_status", "identifier", "subject", "version"])
    styles: dict[str, tuple[str, bool]] = {}
    sheet = _xml(archive, "word/styles.xml")
    for s in sheet.iter(f"{W}style") if sheet is not None else ():
        name = s.find(f"{W}name")
        styles[s.get(f"{W}styleId", "")] = (name.get(f"{W}val", "") if name is not None else "", s.find(f"{W}pPr/{W}numPr") is not None)
    body = _xml(archive, "word/document.xml").find(f"{W}body")
    if body is None:
        raise ParseError("document has no body")
    out.properties["section_count"] = len(list(body.iter(f"{W}sectPr"))) or 1
    styled_title = None
    for node in _content(body):
        if node.tag == f"{W}tbl":
            rows = [[one_line(" ".join(_runs(p) for p in c.iter(f"{W}p"))) for c in r.findall(f"{W}tc")] for r in node.findall(f"{W}tr")]
            out.add("table", "\n".join(" | ".join(r) for r in rows if any(r)), rows=len(rows), columns=max(map(len, rows), default=0))
            continue
        text = kept_lines(_runs(node))
        style = node.find(f"{W}pPr/{W}pStyle")
        style_id = style.get(f"{W}val", "") if style is not None else ""
        name, listed = styles.get(style_id, ("", False))
        extra = {"style": name} if name else {}
        level = next((int(m[1]) for v in (re.sub(r"(?i)^heading(?=\d)", "heading ", style_id.replace("_", " ")), name) if (m := HEADING.fullmatch(v))), None)
        number = node.find(f"{W}pPr/{W}numPr")
        if style_id.casefold() == "title" and styled_title is None and text:
            styled_title = one_line(text)
        if level is not None:
            out.add("heading", text, level=level, **extra)
        elif number is not None or listed or style_id.casefold().startswith(("listbullet", "listnumber")):
            depth = number.find(f"{W}ilvl") if number is not None else None
            out.add("list_item", text, list_level=int(depth.get(f"{W}val", 0)) if depth is not None else 0, **extra)
        else:
            out.add("quote" if style_id.casefold() in ("quote", "intensequote") else "paragraph", text, **extra)
    out.title = out.title or styled_title or next((b["text"] for b in out.blocks if b["attributes"].get("level") == 1), None)
    return out


def _content(body: ET.Element):
    """Paragraphs and tables of the body in order, content controls opened."""
    for node in body:
        if node.tag in (f"{W}p", f"{W}tbl"):
            yield node
        elif node.tag == f"{W}sdt":
            inner = node.find(f"{W}sdtContent")
            if inner is not None:
                yield from _content(inner)


# ---- PPTX -------------------------------------------------------------------------------------


def parse_pptx(raw: bytes) -> Parsed:
    archive = _open(raw, "ppt/presentation.xml")
    out = Parsed("pptx")
    printed = _core(archive, out, ["category", "comments", "content_status", "identifier", "last_modified_by", "subject", "version"])
    if _utc(printed["last_printed"]):
        out.properties["last_printed"] = printed["last_printed"]
    show = _xml(archive, "ppt/presentation.xml")
    size = show.find(f"{P}sldSz")
    if size is not None:
        out.properties.update(slide_width_emu=int(size.get("cx", 0)), slide_height_emu=int(size.get("cy", 0)))
    related = _related(archive, "ppt/presentation.xml")
    names = [related[i.get(f"{R}id")][1] for i in show.iter(f"{P}sldId") if i.get(f"{R}id") in related]
    if not names:
        raise ParseError("presentation has no slides")
    out.slide_count = len(names)
    for number, name in enumerate(names, 1):
        slide = _xml(archive, name)
        if slide is None:
            raise ParseError(f"presentation lacks {name}")
        _slide(slide, number, out)
        for kind, part in _related(archive, name).values():
            if kind == "notesSlide" and (notes := _xml(archive, part)) is not None:
                _notes(notes, number, out)
    out.title = out.title or next((b["text"] for b in out.blocks if b["block_type"] == "slide_title"), None)
    return out


def _placeholder(shape: ET.Element) -> str | None:
    mark = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return None if mark is None else mark.get("type", "obj")


def _lines(paragraph: ET.Element) -> str:
    return kept_lines("".join("\n" if x.tag == f"{A}br" else x.text or "" for x in paragraph.iter() if x.tag in (f"{A}t", f"{A}br")))


def _ordered(tree: ET.Element):
    """Shapes from top to bottom, left to right, groups opened in their place."""

    def place(item):
        at, shape = item
        off = shape.find(f".//{A}off")
        return (int(off.get("y", 0)), int(off.get("x", 0)), at) if off is not None else (0, 0, at)

    for _, shape in sorted(enumerate(s for s in tree if s.tag in (f"{P}sp", f"{P}graphicFrame", f"{P}grpSp", f"{P}pic", f"{P}cxnSp")), key=place):
        if shape.tag == f"{P}grpSp":
            yield from _ordered(shape)
        else:
            yield shape


def _slide(slide: ET.Element, number: int, out: Parsed) -> None:
    tree = slide.find(f"{P}cSld/{P}spTree")
    if tree is None:
        return
    shapes = list(_ordered(tree))
    titled = next((s for s in shapes if s.tag == f"{P}sp" and _placeholder(s) in ("title", "ctrTitle")), None)
    title = "\n".join(x for x in map(_lines, titled.iter(f"{A}p")) if x) if titled is not None else ""
    section = [title] if title else []
    for shape in shapes:
        named = shape.find(f".//{P}cNvPr")
        extra = {"shape_name": named.get("name")} if named is not None and one_line(named.get("name")) else {}
        if kind := _placeholder(shape):
            extra["placeholder_type"] = kind.casefold()
        table = shape.find(f".//{A}tbl")
        if table is not None:
            rows = [[one_line(" ".join(map(_lines, c.iter(f"{A}p")))) for c in r.findall(f"{A}tc")] for r in table.findall(f"{A}tr")]
            out.add("table", "\n".join(" | ".join(r) for r in rows if any(r)), section=section, slide=number, rows=len(rows), columns=max(map(len, rows), default=0), **extra)
        elif shape is titled:
            out.add("slide_title", title, section=section, slide=number, **extra)
        elif shape.tag == f"{P}sp":
            for k, paragraph in enumerate(shape.iter(f"{A}p")):
                props = paragraph.find(f"{A}pPr")
                depth = int(props.get("lvl", 0)) if props is not None else 0
                marks = {x.tag for x in props} if props is not None else set()
                bullet = depth > 0 or (f"{A}buNone" not in marks and bool(marks & {f"{A}buAutoNum", f"{A}buBlip", f"{A}buChar"}))
                out.add("list_item" if bullet else "paragraph", _lines(paragraph), section=section, slide=number, paragraph_index=k, paragraph_level=depth, **extra)


def _notes(notes: ET.Element, number: int, out: Parsed) -> None:
    section = next((b["section_path"] for b in reversed(out.blocks) if b["slide_number"] == number), [])
    for shape in notes.iter(f"{P}sp"):
        if _placeholder(shape) == "body":
            for k, paragraph in enumerate(shape.iter(f"{A}p")):
                out.add("speaker_note", _lines(paragraph), section=section, slide=number, paragraph_index=k)
