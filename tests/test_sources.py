"""Parsers on documents made here, discovery, hashing, annotations."""

import io
import zipfile
import zlib

import pytest

from shelfmark.sources.annotations import document_questions, nested_captions, wide_captions
from shelfmark.sources.blocks import ParseError
from shelfmark.sources.files import catalogue_rows, discover, exploded_blocks, hash_files, parse_documents, register_parser
from shelfmark.sources.html import parse_html
from shelfmark.sources.markdown import parse_markdown
from shelfmark.sources.office import parse_docx, parse_pptx
from shelfmark.sources.pdf import parse_pdf

HTML = """<!doctype html>
<html lang="nl-NL"><head><title>Een  titel</title>
<meta name="author" content="Ada"><meta property="article:author" content="ADA"><meta name="keywords" content="een, twee,,een">
<meta name="created" content="2024-03-04T05:06:07Z"><script>weg()</script></head>
<body>
<h1>Kop</h1>
<p>Tekst met <b>nadruk</b>.</p>
<h2>Onder</h2>
<ul><li>buiten<ul><li>binnen</li></ul></li></ul>
<blockquote><p>Citaat</p></blockquote>
<pre><code class="language-py">a = 1
</code></pre>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
<template>weg</template></body></html>"""


def test_html_blocks_and_metadata():
    doc = parse_html(HTML.encode())
    assert [b["block_type"] for b in doc.blocks] == ["heading", "paragraph", "heading", "list_item", "list_item", "quote", "code", "table"]
    assert [b["text"] for b in doc.blocks][3:] == ["buiten", "binnen", "Citaat", "a = 1", "A | B\n1 | 2"]
    assert doc.blocks[3]["section_path"] == ["Kop", "Onder"] and doc.blocks[1]["source_line_start"] == 7
    assert doc.blocks[6]["attributes"] == {"language": "py"}
    assert (doc.title, doc.authors, doc.language) == ("Een titel", ["Ada"], "nl-NL")
    assert doc.properties["keywords"] == ["een", "twee", "een"] and doc.created_at.year == 2024


def test_html_legacy_encoding_and_malformed():
    doc = parse_html('<meta charset="windows-1254"><h1>Şehir</h1>'.encode("windows-1254"))
    assert doc.title == "Şehir" and doc.properties["encoding"] == "cp1254"
    assert parse_html(b"<h1>one<p>two<ul><li>three").title == "one two three"
    assert parse_html(b"").blocks == []


def test_markdown_blocks():
    source = "﻿# Kop\r\n\r\nTekst **vet** [naam](https://x.example).\r\n\r\n## Onder\r\n\r\n- een\r\n- twee\r\n\r\n> citaat\r\n\r\n```py\r\na = 1\r\n```\r\n\r\n| A | B |\r\n| --- | --- |\r\n| 1 | 2 |\r\n\r\n<div>html &amp; tekst</div>\r\n<script>weg()</script>\r\n"
    doc = parse_markdown(source.encode("utf-8"))
    assert [b["block_type"] for b in doc.blocks] == ["heading", "paragraph", "heading", "list_item", "list_item", "quote", "code", "table", "other"]
    assert [b["text"] for b in doc.blocks] == ["Kop", "Tekst vet naam.", "Onder", "een", "twee", "citaat", "a = 1", "A | B\n1 | 2", "html & tekst"]
    assert doc.blocks[3]["section_path"] == ["Kop", "Onder"] and doc.blocks[1]["source_line_start"] == 3 and doc.title == "Kop"
    with pytest.raises(ParseError):
        parse_markdown(b"\xff\xfe\x00")


def test_markdown_heading_levels():
    doc = parse_markdown(b"# A\n\n### B\n\ntext\n\n## C\n\nend")
    assert [b["section_path"] for b in doc.blocks] == [["A"], ["A", "B"], ["A", "B"], ["A", "C"], ["A", "C"]]


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:creator>Ada</dc:creator><cp:keywords>a; b,A</cp:keywords><dcterms:created>2024-01-02T03:04:05Z</dcterms:created></cp:coreProperties>'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style="", number=False):
    props = f'<w:pPr><w:pStyle w:val="{style}"/>{"<w:numPr><w:ilvl w:val=\"1\"/></w:numPr>" if number else ""}</w:pPr>' if style or number else ""
    return f"<w:p>{props}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_docx():
    body = paragraph("Top", "Heading1") + paragraph("prose") + paragraph("item", "ListBullet") + paragraph("cited", "Quote") + "<w:tbl><w:tr><w:tc>" + paragraph("x") + "</w:tc><w:tc>" + paragraph("y") + "</w:tc></w:tr></w:tbl>"
    doc = parse_docx(archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "docProps/core.xml": CORE}))
    assert [(b["block_type"], b["text"]) for b in doc.blocks] == [("heading", "Top"), ("paragraph", "prose"), ("list_item", "item"), ("quote", "cited"), ("table", "x | y")]
    assert doc.title == "Top" and doc.authors == ["Ada"] and doc.properties["keywords"] == ["a", "b"] and doc.blocks[1]["section_path"] == ["Top"]
    for broken in (b"nothing", archive({"other.xml": ""}), b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
        with pytest.raises(ParseError):
            parse_docx(broken)


def test_pptx():
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shape = lambda text, kind="", bullet="", y=0: f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{f"<p:ph type=\"{kind}\"/>" if kind else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:pPr>{bullet}</a:pPr><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {ns}><p:cSld><p:spTree>{shape("point", bullet="<a:buChar char=\"x\"/>", y=9)}{shape("Title", "title")}</p:spTree></p:cSld></p:sld>'
    notes = f'<p:notes {ns}><p:cSld><p:spTree>{shape("spoken", "body")}</p:spTree></p:cSld></p:notes>'
    rel = lambda target, kind: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/{kind}" Target="{target}"/></Relationships>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst><p:sldSz cx="10" cy="20"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel("slides/slide1.xml", "slide"), "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": rel("../notesSlides/n1.xml", "notesSlide"), "ppt/notesSlides/n1.xml": notes,
    }
    doc = parse_pptx(archive(parts))
    assert [(b["block_type"], b["text"]) for b in doc.blocks] == [("slide_title", "Title"), ("list_item", "point"), ("speaker_note", "spoken")]
    assert doc.slide_count == 1 and doc.title == "Title" and doc.blocks[2]["section_path"] == ["Title"] and doc.properties["slide_height_emu"] == 20


def pdf(*pages, compress=True):
    objects = ["<< /Type /Catalog /Pages 2 0 R /Outlines 90 0 R >>".encode(), f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>".encode()]
    out = b"%PDF-1.4\n"
    for k, o in enumerate(objects, 1):
        out += f"{k} 0 obj\n".encode() + o + b"\nendobj\n"
    for k, text in enumerate(pages):
        data = zlib.compress(text.encode()) if compress else text.encode()
        out += f"{10 + 2 * k} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>\nendobj\n{11 + 2 * k} 0 obj\n<< /Length {len(data)} {'/Filter /FlateDecode' if compress else ''} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    out += b"90 0 obj\n<< /First 91 0 R >>\nendobj\n91 0 obj\n<< /Title (Part) /Dest [12 0 R /Fit] >>\nendobj\n5 0 obj\n<< /Title (My \\(title\\)) /Author (Ada) /CreationDate (D:20240102030405+01'00') >>\nendobj\n"
    return out + b"trailer << /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF"


def test_pdf():
    for compress in (True, False):
        doc = parse_pdf(pdf("BT (First line) Tj 0 -14 Td (goes on.) Tj 0 -40 Td [(Sec) -20 (ond)] TJ ET", "BT (Last) Tj ET", compress=compress))
        assert [(b["text"], b["page_number"], b["section_path"]) for b in doc.blocks] == [("First line goes on.", 1, []), ("Second", 1, []), ("Last", 2, ["Part"])]
    assert doc.title == "My (title)" and doc.page_count == 2 and doc.created_at.hour == 2
    for broken in (b"no pdf", b"%PDF-1.4\n", pdf("x").replace(b"/Info", b"/Encrypt 7 0 R /Info")):
        with pytest.raises(ParseError):
            parse_pdf(broken)


def test_discovery_and_parsing(spark, tmp_path):
    for name in ("a.html", "sub/.b.MD", "sub/_deep/c.txt", "sub/_deep/d.png", "_e.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("# x")
    found = discover(spark, str(tmp_path))
    assert sorted((r.file_name, r.file_type) for r in found.collect()) == [(".b.MD", "text"), ("_e.md", "text"), ("a.html", "text"), ("d.png", "image")]
    assert discover(spark, str(tmp_path), recursive=False, allowed_types=["text"]).count() == 2
    hashed = catalogue_rows(hash_files(found)).collect()
    assert len({r.content_hash for r in hashed}) == 1 and all(r.error is None and len(r.id) == 36 for r in hashed)
    parsed = parse_documents(found)
    rows = {r.path.rsplit("/", 1)[1]: r for r in parsed.collect()}
    assert "unsupported" in rows["d.png"].error and rows["_e.md"].title == "x" and rows["a.html"].error is None
    assert exploded_blocks(parsed).count() == 2
    with pytest.raises(NotADirectoryError):
        discover(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        discover(spark, str(tmp_path), allowed_types=["video"])
    with pytest.raises(ValueError):
        register_parser(".md", parse_markdown)


def test_annotations(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿file_name,caption_2,caption_10,caption_1\na.wav,b,c,a\n", encoding="utf-8")
    assert [(r.position, r.caption) for r in wide_captions(spark, str(tmp_path / "c.csv")).orderBy("position").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    (tmp_path / "c.json").write_text('{"images": [{"id": 1, "file_name": "a.jpg"}], "annotations": [{"id": 5, "image_id": 1, "caption": " cat "}]}')
    assert [tuple(r) for r in nested_captions(spark, str(tmp_path / "c.json")).collect()] == [("a.jpg", "cat", 5)]
    (tmp_path / "q.csv").write_text('Enterprise Name,Query Type,Query,Supporting Facts\nX,comparative,Which  one?,"[{""filename"": ""b.pdf""}, {""filename"": ""a.pdf""}]"\nx,Comparative,which one?,"[{""filename"": ""A.pdf""}, {""filename"": ""c.pdf""}]"\nX,odd,Else?,"[{""filename"": ""z.pdf""}]"\n')
    rows = {r.query_type: list(r.files) for r in document_questions(spark, str(tmp_path / "q.csv"), ["Comparative"]).collect()}
    assert rows == {"Comparative": ["b.pdf", "a.pdf", "c.pdf"], "Other": ["z.pdf"]}
