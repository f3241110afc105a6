"""Spans of a run as a table of events: what ``operators.metrics.stage_profile`` sums up."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = "event_id bigint, parent_id bigint, stage string, started_ms double, duration_ms double, cpu_ms double, items bigint, input_bytes bigint, error string"
_INSIDE: ContextVar[int | None] = ContextVar("shelfmark_span", default=None)


@dataclass
class Event:
    """One span; ``items`` and ``input_bytes`` may be set while it is open."""

    event_id: int
    parent_id: int | None
    stage: str
    started_ms: float
    duration_ms: float | None = None
    cpu_ms: float | None = None
    items: int | None = None
    input_bytes: int | None = None
    error: str | None = None


class Profile:
    """Collects spans of the driver; spans opened inside of one are its children, in threads of their own too."""

    def __init__(self):
        self._numbers, self._begin, self._events = itertools.count(1), time.perf_counter(), []

    @contextmanager
    def span(self, stage: str, items: int | None = None, input_bytes: int | None = None) -> Iterator[Event]:
        begin, cpu = time.perf_counter(), time.process_time()
        event = Event(next(self._numbers), _INSIDE.get(), stage, 1000 * (begin - self._begin), items=items, input_bytes=input_bytes)
        outer = _INSIDE.set(event.event_id)
        try:
            yield event
        except BaseException as error:
            event.error = f"{type(error).__name__}: {error}"
            raise
        finally:
            _INSIDE.reset(outer)
            event.duration_ms, event.cpu_ms = 1000 * (time.perf_counter() - begin), 1000 * (time.process_time() - cpu)
            self._events.append(event)

    def table(self, spark: SparkSession) -> DataFrame:
        """Closed spans in the order in which they ended."""
        return spark.createDataFrame([tuple(asdict(e)[f.name] for f in fields(Event)) for e in self._events], EVENT_SCHEMA)

    def lacking(self, stages: Iterable[str]) -> list[str]:
        """Stages of which no span was closed."""
        return sorted(set(stages) - {e.stage for e in self._events})
