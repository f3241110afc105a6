"""String functions of the catalogue as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(text: Column) -> Column:
    """NUL dropped, every run of Unicode white space one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u0000"), F.lit("")), r"(?U)\s+", " "))


def squeeze_lines(text: Column) -> Column:
    """Like ``squeeze`` within each line; blank lines are dropped. A vertical tab is a line break."""
    lines = F.split(F.replace(text, F.lit("\u0000"), F.lit("")), r"\r\n|[\n\r\x0B]")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != ""), "\n")


def first_text(*candidates: Column) -> Column:
    """First candidate that isn't blank, squeezed."""
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in candidates])


def distinct_folded(values: Column) -> Column:
    """Values in order, without those equal to an earlier one in lower case."""
    low = F.transform(values, lambda v: F.lower(v))
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def keywords(text: Column, separators: str = "[,;]") -> Column:
    """Keywords split, squeezed, without blanks and repetitions (letter case aside)."""
    return distinct_folded(F.filter(F.transform(F.split(text, separators), squeeze), lambda x: x != ""))


def preview(text: Column, most: int = 280) -> Column:
    """One line of at most ``most`` characters, cut with an ellipsis."""
    flat = squeeze(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def timestamp_text(seconds: Column) -> Column:
    """h:mm:ss.ss, or m:ss.ss below an hour; times before 0 are 0, null is null."""
    at = F.greatest(seconds.cast("double"), F.lit(0.0))
    hours, rest = F.floor(at / 3600), at - F.floor(at / 3600) * 3600
    minutes = F.floor(rest / 60)
    tail = F.format_string("%05.2f", rest - minutes * 60)
    long = F.when(hours > 0, F.format_string("%d:%02d:%s", hours, minutes, tail)).otherwise(F.format_string("%d:%s", minutes, tail))
    return F.when(seconds.isNotNull(), long)


def duration_text(seconds: Column) -> Column:
    """x.xx s below a minute, else a timestamp."""
    return F.when(seconds < 60, F.format_string("%.2f s", seconds.cast("double"))).otherwise(timestamp_text(seconds))


def milliseconds_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.2f ms", ms.cast("double"))).otherwise(F.format_string("%.2f s", (ms / 1000).cast("double")))


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score.cast("double"))


def size_text(size: Column) -> Column:
    """Bytes in decimal units: B, kB, MB, GB or TB, one decimal from kB on."""
    out = F.format_string("%d B", size.cast("bigint"))
    for power, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1000**power, F.format_string(f"%.1f {unit}", size / 1000.0**power)).otherwise(out)
    return F.when(size.isNotNull(), out)


def details_text(
    file_format: Column, width: Column, height: Column, seconds: Column, rate: Column, size: Column, mode: Column | None = None, bitrate: Column | None = None, channels: Column | None = None,
    codec: Column | None = None, frames: Column | None = None,
) -> Column:
    """Known details of a file on one line; what isn't known is left out."""
    kilo = lambda c, unit: F.when(c.isNotNull(), F.concat(F.regexp_replace(F.format_string("%.3f", c / 1000.0), r"\.?0+$", ""), F.lit(f" {unit}")))
    none = F.lit(None).cast("string")
    parts = [
        F.upper(F.regexp_replace(file_format, r"^\.", "")),
        F.when(width.isNotNull() & height.isNotNull(), F.concat(F.format_number(width, 0), F.lit(" × "), F.format_number(height, 0), F.lit(" px"))),
        mode if mode is not None else none,
        duration_text(seconds),
        kilo(rate, "kHz"),
        kilo(bitrate, "kbps") if bitrate is not None else none,
        F.when(channels == 1, F.lit("1 channel")).when(channels.isNotNull(), F.concat(channels.cast("string"), F.lit(" channels"))) if channels is not None else none,
        codec if codec is not None else none,
        size_text(size),
        F.when(frames > 1, F.concat(F.format_number(frames, 0), F.lit(" frames"))) if frames is not None else none,
    ]
    return F.concat_ws(" · ", *[F.when(p != "", p) for p in parts])


def modified_text(at: Column) -> Column:
    """``Mar 4, 2024 at 09:05`` in the session's zone; Unknown for null."""
    return F.coalesce(F.date_format(at, "MMM d, yyyy 'at' HH:mm"), F.lit("Unknown"))


def discovery_text(file_type: Column, total: Column, new: Column, changed: Column, unchanged: Column, failed: Column | None = None) -> Column:
    """Counts of one queue on one line; unreadable files are named where there are any."""
    counts = [F.concat(c.cast("string"), F.lit(f" {label}")) for c, label in ((total, "found"), (new, "new"), (changed, "changed"), (unchanged, "unchanged"))]
    counts += [F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" unreadable")))] if failed is not None else []
    return F.concat(F.initcap(file_type), F.lit(" files  "), F.concat_ws(" · ", *counts))


def confirmation_text(file_type: Column, new: Column, changed: Column) -> Column:
    """The question before a queue is worked on: ``Index 3 text files (2 new, 1 changed)?``."""
    details = F.concat_ws(", ", F.when(new > 0, F.concat(new.cast("string"), F.lit(" new"))), F.when(changed > 0, F.concat(changed.cast("string"), F.lit(" changed"))))
    files = F.when(new + changed == 1, F.lit("file")).otherwise(F.lit("files"))
    return F.concat(F.lit("Index "), (new + changed).cast("string"), F.lit(" "), file_type, F.lit(" "), files, F.lit(" ("), details, F.lit(")?"))


def time_range_text(index: Column, start: Column, end: Column) -> Column:
    """Where a timed segment stands: its number from 1 and its range."""
    return F.concat(F.lit("#"), (index + 1).cast("string"), F.lit("  "), timestamp_text(start), F.lit(" – "), timestamp_text(end))


def json_text(*columns: Column) -> Column:
    """Columns as one JSON object; nested values, nulls included, and times in ISO form."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})


def segment_text(page: Column, slide: Column, section: Column, line_start: Column, line_end: Column) -> Column:
    """Where a chunk stands: page, slide, section and lines, as far as known."""
    lines = F.when(line_start.isNull(), F.lit(None)).when(line_end.isNull() | (line_end == line_start), F.concat(F.lit("line "), line_start.cast("string"))).otherwise(F.concat(F.lit("lines "), line_start.cast("string"), F.lit("–"), line_end.cast("string")))
    parts = [F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("slide "), slide.cast("string")), F.nullif(F.array_join(section, " › "), F.lit("")), lines]
    return F.concat_ws(" · ", *parts)
