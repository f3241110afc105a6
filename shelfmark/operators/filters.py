"""The predicate language of the catalogue, lowered to one Column.

Three groups of conditions are joined by AND: all of them, at least one of them, none of them.
A missing field makes a condition false, so it passes ``none_of``, where plain SQL negation would give null.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.identity import FORMAT_ALIASES

OPERATORS = ("equal", "contains", "in", "text_contains", "gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class Condition:
    """``field`` may be dotted; ``value`` is a sequence for ``in``."""

    field: str
    operator: str
    value: Any

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.operator == "in" and (isinstance(self.value, (str, bytes)) or not isinstance(self.value, Sequence)):
            raise TypeError("'in' needs a sequence of values")


@dataclass(frozen=True)
class Predicate:
    all_of: tuple[Condition, ...] = ()
    any_of: tuple[Condition, ...] = ()
    none_of: tuple[Condition, ...] = ()

    @property
    def empty(self) -> bool:
        return not (self.all_of or self.any_of or self.none_of)


def _type_of(schema: T.StructType, name: str) -> T.DataType | None:
    kind: T.DataType = schema
    for part in name.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        kind = kind[part].dataType
    return kind


def condition_column(condition: Condition, schema: T.StructType) -> Column:
    """True or false, never null; false where the field is missing."""
    kind = _type_of(schema, condition.field)
    if kind is None:
        return F.lit(False)
    column, value = F.col(condition.field), condition.value
    listed = isinstance(kind, T.ArrayType)
    if condition.operator in ("equal", "contains"):
        test = F.array_contains(column, value) if listed else column == F.lit(value)
    elif condition.operator == "in":
        values = list(value)
        test = F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])) if listed and values else column.isin(values) if values else F.lit(False)
    elif condition.operator == "text_contains":
        test = F.exists(column, lambda x: F.contains(x, F.lit(value))) if listed else column.contains(value)
    else:
        if isinstance(value, (dt.date, dt.datetime)):
            if not isinstance(value, dt.datetime):
                value = dt.datetime.combine(value, dt.time.min)
            left, right = column.cast("timestamp"), F.lit(value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc))
        else:
            # The bare column keeps the comparison pushable to the scan.
            left, right = (column if isinstance(kind, T.NumericType) else column.cast("double")), F.lit(float(value))
        test = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[condition.operator]
    return F.coalesce(test, F.lit(False))


def predicate_column(predicate: Predicate, schema: T.StructType) -> Column:
    """One Column for a predicate; true for an empty one."""
    out: Column | None = None
    parts = [_pushable(c, schema) for c in predicate.all_of]
    if predicate.any_of:
        either = condition_column(predicate.any_of[0], schema)
        for c in predicate.any_of[1:]:
            either = either | condition_column(c, schema)
        parts.append(either)
    parts += [~condition_column(c, schema) for c in predicate.none_of]
    for part in parts:
        out = part if out is None else out & part
    return F.lit(True) if out is None else out


def _pushable(condition: Condition, schema: T.StructType) -> Column:
    """A condition under AND may be null instead of false; without the coalesce it reaches the scan."""
    full = condition_column(condition, schema)
    kind = _type_of(schema, condition.field)
    if kind is None or isinstance(kind, T.ArrayType):
        return full
    column, value = F.col(condition.field), condition.value
    if condition.operator in ("equal", "contains"):
        return column == F.lit(value)
    if condition.operator == "in" and len(value):
        return column.isin(list(value))
    if condition.operator == "text_contains":
        return column.contains(value)
    if isinstance(kind, T.NumericType) and condition.operator in ("gt", "gte", "lt", "lte") and not isinstance(value, dt.date):
        # A whole number stays one: a cast of the column would keep the comparison from the scan.
        right = F.lit(value) if isinstance(kind, T.IntegralType) and isinstance(value, int) else F.lit(float(value))
        return {"gt": column > right, "gte": column >= right, "lt": column < right, "lte": column <= right}[condition.operator]
    return full


def apply_predicate(rows: DataFrame, predicate: Predicate | None) -> DataFrame:
    return rows if predicate is None or predicate.empty else rows.filter(predicate_column(predicate, rows.schema))


@dataclass(frozen=True)
class MetadataQuery:
    """Optional constraints of a search; unset ones add no condition."""

    name_contains: str | None = None
    file_format: str | None = None
    min_width: int | None = None
    min_height: int | None = None
    max_width: int | None = None
    max_height: int | None = None
    sample_rate_hz: int | None = None
    bitrate_bps: int | None = None
    duration_longer_than: float | None = None
    duration_shorter_than: float | None = None
    modified_after: dt.datetime | None = None
    modified_before: dt.datetime | None = None
    extra: tuple[Condition, ...] = field(default=())

    def predicate(self) -> Predicate | None:
        """Durations are strict on both sides; dates take the first bound and leave out the last."""
        key = None
        if self.file_format is not None:
            bare = self.file_format.strip().removeprefix(".").casefold()
            key = FORMAT_ALIASES.get(bare, bare)
        rules = [
            ("file_name_search", "text_contains", self.name_contains.casefold() if self.name_contains is not None else None),
            ("format_key", "equal", key),
            ("metadata.width", "gte", self.min_width),
            ("metadata.height", "gte", self.min_height),
            ("metadata.width", "lte", self.max_width),
            ("metadata.height", "lte", self.max_height),
            ("metadata.sample_rate_hz", "equal", self.sample_rate_hz),
            ("metadata.bitrate_bps", "equal", self.bitrate_bps),
            ("metadata.duration_seconds", "gt", self.duration_longer_than),
            ("metadata.duration_seconds", "lt", self.duration_shorter_than),
            ("modified_at", "gte", self.modified_after),
            ("modified_at", "lt", self.modified_before),
        ]
        conditions = tuple(Condition(f, o, v) for f, o, v in rules if v is not None) + self.extra
        return Predicate(all_of=conditions) if conditions else None


def file_type_predicate(file_type: str) -> Predicate:
    return Predicate(all_of=(Condition("file_type", "equal", file_type),))
