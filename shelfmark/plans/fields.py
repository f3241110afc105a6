"""The constraints a search can state, declared once for every front end.

A ``Field`` says how a value is read, which slots of a ``MetadataQuery`` it fills and whose files carry it. What two fields
must not say together stands in ``LIMITS``. The query language and the command line differ in ``Style`` alone: what they call
a field, and how they read a date.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from shelfmark.functions.identity import EXTENSIONS
from shelfmark.operators.filters import MetadataQuery

#: Extension -> the one modality that supports it.
MODALITY = {extension: kind for kind, known in EXTENSIONS.items() for extension in known}


def modality_of(name: str | None) -> str | None:
    """Modality of a format, extension or suffix, with or without its dot and in any letter case; null for others."""
    return MODALITY.get("." + (name or "").strip().casefold().lstrip(".")) if name else None


# ---- readers: (label, raw value) -> value ---------------------------------------------------------


def _text(_: str, raw: str) -> str:
    return raw


def _size(label: str, raw: str) -> tuple[int, int]:
    sides = re.fullmatch(r"\s*([+-]?\d+)\s*[xX×]\s*([+-]?\d+)\s*", raw)
    if sides is None:
        raise ValueError(f"Invalid {label}; expected WIDTHxHEIGHT")
    return tuple(_at_least(label, int(side), 1) for side in sides.groups())


def _whole(label: str, raw: str | int) -> int:
    if re.fullmatch(r"\s*[+-]?\d+\s*", str(raw)) is None:
        raise ValueError(f"Invalid {label}; expected a positive integer")
    return _at_least(label, int(raw), 1)


def _seconds(least: float) -> Callable[[str, str | float], float]:
    def read(label: str, raw: str | float) -> float:
        try:
            value = float(raw)
        except ValueError:
            raise ValueError(f"Invalid {label}; expected a finite number of seconds") from None
        return _at_least(label, value, least)

    return read


def _at_least(label: str, value: float, least: float) -> Any:
    if not math.isfinite(value) or value < least:
        raise ValueError(f"Invalid {label}; it must be {'non-negative' if least == 0 else 'positive'} and finite")
    return value


def first_instant(label: str, raw: str) -> dt.datetime:
    """First instant of a year, month or day, or an ISO time; local to this machine where it has no zone."""
    parts = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", raw)
    try:
        moment = dt.datetime(*(int(p or 1) for p in parts.groups())) if parts else dt.datetime.fromisoformat(raw)
    except ValueError:
        raise ValueError(f"Invalid {label} date; YYYY, YYYY-MM, YYYY-MM-DD and ISO times are read") from None
    return moment if moment.tzinfo else moment.astimezone()


def day_edge(label: str, raw: str) -> dt.datetime:
    """An ISO time; of a day alone its first instant, or its last microsecond for the field ``before``."""
    try:
        moment = dt.datetime.fromisoformat(raw)
    except ValueError:
        raise ValueError(f"Invalid {label}; YYYY-MM-DD and ISO times are read") from None
    if len(raw) == 10 and label.endswith("before"):
        moment += dt.timedelta(days=1, microseconds=-1)
    return moment if moment.tzinfo else moment.astimezone()


# ---- the declarations ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    slots: tuple[str, ...]
    read: Callable[[str, Any], Any] | None
    modality: str | None = None


#: ``read`` is null for dates, which each style reads its own way.
FIELDS = {
    "name": Field(("name_contains",), _text),
    "format": Field(("file_format",), _text),
    "min-res": Field(("min_width", "min_height"), _size, "image"),
    "max-res": Field(("max_width", "max_height"), _size, "image"),
    "sample-rate": Field(("sample_rate_hz",), _whole, "audio"),
    "bitrate": Field(("bitrate_bps",), _whole, "audio"),
    "longer-than": Field(("duration_longer_than",), _seconds(0.0), "audio"),
    "shorter-than": Field(("duration_shorter_than",), _seconds(math.ulp(0.0)), "audio"),
    "after": Field(("modified_after",), None),
    "before": Field(("modified_before",), None),
}
#: (low slot, high slot, whether they may be equal (null: as the style says), what is wrong otherwise).
LIMITS = [
    ("min_width", "max_width", True, "{min-res} cannot exceed {max-res}"),
    ("min_height", "max_height", True, "{min-res} cannot exceed {max-res}"),
    ("modified_after", "modified_before", None, "{after} must be earlier than {before}, not later than it"),
    ("duration_longer_than", "duration_shorter_than", False, "{longer-than} must be less than {shorter-than}"),
]


@dataclass(frozen=True)
class Style:
    """What a front end calls the fields (itself where nothing is said), and how it reads dates."""

    date: Callable[[str, str], dt.datetime]
    same_instant: bool
    labels: Mapping[str, str]

    def label(self, key: str) -> str:
        return self.labels.get(key, key)


LANGUAGE = Style(first_instant, False, {})
FLAGS = Style(day_edge, True, {"min-res": "minimum resolution", "max-res": "maximum resolution", "sample-rate": "sample rate", "longer-than": "longer-than duration", "shorter-than": "shorter-than duration", "after": "modified-after", "before": "modified-before"})


def assemble(stated: Mapping[str, Any], style: Style) -> MetadataQuery:
    """A ``MetadataQuery`` of stated raw values by field key; a ValueError names the first field that is wrong."""
    slots: dict[str, Any] = {}
    for key in filter(stated.__contains__, FIELDS):
        read = FIELDS[key].read or style.date
        value = read(style.label(key), stated[key])
        slots |= zip(FIELDS[key].slots, value if isinstance(value, tuple) else (value,))
    names = {key: style.label(key) for key in FIELDS}
    for low, high, equal, wrong in LIMITS:
        if {low, high} <= slots.keys():
            room = style.same_instant if equal is None else equal
            if slots[low] > slots[high] or (slots[low] == slots[high] and not room):
                raise ValueError(wrong.format_map(names))
    return MetadataQuery(**slots)


def check_modality(query: MetadataQuery, target: str) -> None:
    """Constraints that files of the target never carry are errors, and so is a format of another modality."""
    foreign = sorted({f.modality for f in FIELDS.values() if f.modality not in (None, target) and any(getattr(query, s) is not None for s in f.slots)})
    if foreign:
        raise ValueError(f"A filter was given that needs the {foreign[0]} target, not {target}")
    agreed({"the target": target, f"format {query.file_format!r}": modality_of(query.file_format)})


def agreed(hints: Mapping[str, str | None]) -> str | None:
    """The modality that all hints which name one agree on; null if none does. Two that differ are an error."""
    named = [(source, kind) for source, kind in hints.items() if kind]
    for source, kind in named[1:]:
        if kind != named[0][1]:
            raise ValueError(f"{source} is {kind}, not {named[0][1]}")
    return named[0][1] if named else None
