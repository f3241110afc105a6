"""Search requests from text, query files and separate fields; checked before anything runs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from shelfmark.operators.filters import MetadataQuery
from shelfmark.plans.fields import FLAGS, agreed, assemble, check_modality, modality_of
from shelfmark.plans.query_language import parse_filters, parse_query


class QueryFileVectorizer(Protocol):
    """Turns a query file into one or more vectors."""

    supported_extensions: tuple[str, ...]

    def vectors(self, path: Path) -> list[list[float]]: ...


Vectorizers = Mapping[str, QueryFileVectorizer]
#: Command-line name of each field -> its key.
FLAG_FIELDS = {
    "name_contains": "name", "file_format": "format", "min_resolution": "min-res", "max_resolution": "max-res", "sample_rate_hz": "sample-rate", "bitrate_bps": "bitrate",
    "duration_longer_than": "longer-than", "duration_shorter_than": "shorter-than", "modified_after": "after", "modified_before": "before",
}
#: A query that looks like a place of a file: it begins with a dot or a tilde, or holds a slash.
PLACE = re.compile(r"[.~]|.*[/\\]", re.S)


@dataclass(frozen=True)
class Request:
    """Exactly one of ``text`` and ``file``; filters fit the target."""

    target: str
    text: str | None = None
    file: Path | None = None
    metadata: MetadataQuery = MetadataQuery()
    filters: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if (self.text is None) == (self.file is None):
            raise ValueError("a request needs either a text or a file")
        if self.text is not None and not self.text.strip():
            raise ValueError("a request's text is required and must not be blank")
        check_modality(self.metadata, self.target)


@dataclass(frozen=True)
class QueryFile:
    """A file to compare with, as named by the user, and the modality its name tells."""

    path: Path

    @classmethod
    def at(cls, name: str | Path, base: Path | None = None) -> QueryFile:
        """Relative names start at ``base``, a tilde at the home folder."""
        return cls(Path(base or "") / Path(name).expanduser())

    @property
    def modality(self) -> str | None:
        return modality_of(self.path.suffix)

    def checked(self, vectorizers: Vectorizers, kind: str | None = None) -> tuple[Path, str]:
        """(real path, modality) if a vectorizer of that modality takes the file."""
        kind = kind or self.modality
        taker = vectorizers.get(kind) if kind else None
        suffix = self.path.suffix.casefold()
        if kind is None or (taker is not None and suffix not in taker.supported_extensions):
            raise ValueError(f"Files of the extension {suffix or '(none)'} can't be compared with")
        if taker is None:
            raise ValueError(f"Comparing with a file is not enabled for {kind}")
        if not self.path.is_file():
            raise ValueError(f"There is no such query file, it does not exist: {self.path}")
        return self.path.resolve(), kind


def interactive_request(value: str, target: str, vectorizers: Vectorizers | None = None, query_file: Path | None = None, base: Path | None = None) -> Request:
    """One input line: text, or the place of a file to compare with, and filters; or filters alone beside an attached file."""
    parsed = parse_query(value) if query_file is None else parse_filters(value)
    named = QueryFile.at(parsed.text if query_file is None else query_file, base)
    rest = {"metadata": parsed.metadata, "filters": parsed.filters}
    if query_file is None and not named.path.is_file():
        if path_like(parsed.text):
            raise ValueError(f"There is no such query file, it does not exist: {named.path}")
        return Request(target, text=parsed.text, **rest)
    path, kind = named.checked(vectorizers or {})
    return Request(kind, file=path, **rest)


def path_like(value: str) -> bool:
    return PLACE.match(value) is not None or modality_of(Path(value).suffix) is not None


def structured_request(text: str | None = None, query_file: Path | None = None, target: str | None = None, vectorizers: Vectorizers | None = None, **fields) -> Request:
    """Separate fields, as a command line gives them. Dates here end a day at its last microsecond, and the bounds may be equal."""
    if text is not None and query_file is not None:
        raise ValueError("Either a text or --query-file can be searched for, not both")
    named = QueryFile.at(query_file) if query_file is not None else None
    if named is None and not (text or "").strip():
        raise ValueError("A text or --query-file is required for a search")
    stated = {FLAG_FIELDS[name]: value.strip() if isinstance(value, str) else value for name, value in fields.items()}
    metadata = assemble({key: value for key, value in stated.items() if value not in (None, "")}, FLAGS)
    kind = resolve_target(target, metadata.file_format, query_file)
    if named is None:
        return Request(kind, text=text.strip(), metadata=metadata)
    return Request(kind, file=named.checked(vectorizers or {}, kind)[0], metadata=metadata)


def resolve_target(explicit: str | None, file_format: str | None, query_file: Path | None = None) -> str:
    """The modality that the target, the format and the query file's name agree on."""
    by_name = modality_of(Path(query_file).suffix) if query_file is not None else None
    if query_file is not None and by_name is None:
        raise ValueError(f"Files of the extension {Path(query_file).suffix or '(none)'} can't be compared with")
    kind = agreed({"the target": explicit, f"format {file_format!r}": modality_of(file_format), "the query file": by_name})
    if kind is None:
        raise ValueError("A file type is required: --target image, audio or text")
    return kind


__all__ = ["QueryFile", "QueryFileVectorizer", "Request", "interactive_request", "path_like", "resolve_target", "structured_request"]
