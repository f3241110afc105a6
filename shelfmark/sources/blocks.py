"""Shared pieces of the document parsers: what a parsed document is, and its Spark form."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field
from typing import Any


class ParseError(ValueError):
    """A document that can't be read; it becomes an error row, not a failed job."""


@dataclass
class Parsed:
    """Metadata and blocks of one document; ``add`` keeps block numbers and the stack of headings."""

    document_format: str
    title: str | None = None
    authors: list[str] = field(default_factory=list)
    created_at: dt.datetime | None = None
    content_modified_at: dt.datetime | None = None
    language: str | None = None
    page_count: int | None = None
    slide_count: int | None = None
    properties: dict[str, Any] = field(default_factory=dict)
    blocks: list[dict[str, Any]] = field(default_factory=list)
    headings: list[tuple[int, str]] = field(default_factory=list)

    def add(self, kind: str, text: str, level: int | None = None, section: list[str] | None = None, page: int | None = None, slide: int | None = None, line: int | None = None, last: int | None = None, **attributes: Any) -> None:
        if not text:
            return
        if level is not None:
            self.headings = [h for h in self.headings if h[0] < level] + [(level, text)]
            attributes["level"] = level
        path = [h for _, h in self.headings] if section is None else section
        self.blocks.append(
            {"block_index": len(self.blocks), "block_type": kind, "text": text, "page_number": page, "slide_number": slide, "section_path": path, "source_line_start": line, "source_line_end": last, "attributes": attributes}
        )

    def row(self) -> dict[str, Any]:
        """A row of ``DOCUMENT_SCHEMA``."""
        utc = lambda t: None if t is None else (t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)).astimezone(dt.timezone.utc)
        return {
            "document_format": self.document_format, "title": self.title, "authors": self.authors, "created_at": utc(self.created_at), "content_modified_at": utc(self.content_modified_at), "language": self.language,
            "page_count": self.page_count, "slide_count": self.slide_count, "properties": json.dumps(self.properties, default=str, ensure_ascii=False),
            "blocks": [b | {"attributes": json.dumps(b["attributes"], ensure_ascii=False)} for b in self.blocks],
        }


BLOCK_STRUCT = (
    "struct<block_index:int,block_type:string,text:string,page_number:int,slide_number:int,section_path:array<string>,"
    "source_line_start:int,source_line_end:int,attributes:string>"
)
DOCUMENT_SCHEMA = (
    "document_format string, title string, authors array<string>, created_at timestamp, content_modified_at timestamp, language string, "
    f"page_count int, slide_count int, properties string, blocks array<{BLOCK_STRUCT}>"
)


def one_line(text: str | None) -> str:
    return " ".join((text or "").replace("\x00", "").split())


def kept_lines(text: str) -> str:
    """Lines squeezed, blank ones dropped."""
    return "\n".join(x for x in map(one_line, text.replace("\x00", "").replace("\v", "\n").splitlines()) if x)


def first_distinct(values: list[str]) -> list[str]:
    """Values without those that differ from an earlier one in letter case only."""
    seen: dict[str, str] = {}
    for v in values:
        seen.setdefault(v.casefold(), v)
    return list(seen.values())


def keyword_list(text: str | None, distinct: bool = True) -> list[str]:
    words = [w for w in map(one_line, (text or "").replace(";", ",").split(",")) if w]
    return first_distinct(words) if distinct else words


def iso_time(text: str | None) -> dt.datetime | None:
    try:
        return dt.datetime.fromisoformat((text or "").strip().replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError:
        return None
