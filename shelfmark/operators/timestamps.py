"""Raw timestamp strings of many origins as one UTC instant.

Every string is reduced to a *shape mask*: digits become ``9``, letters ``a``, all else stays.
A mask fixes where each number stands, so one parser is compiled per distinct mask and then
runs over all values of that mask at once, as slices of one code-point matrix. Local times go
to UTC through transition tables of the zone database; the database's version travels with them.
"""

from __future__ import annotations

import datetime as dt
import re
import zoneinfo
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- zone transition tables -------------------------------------------------------------------

#: Transitions are tabled between these years; before the first a zone has one offset, after the last its rules repeat.
FIRST_YEAR, LAST_YEAR = 1800, 2100
_EPOCH = dt.datetime(1970, 1, 1)
#: Seconds of 400 years, after which dates, weekdays and so clock changes recur.
CYCLE = 146_097 * 86_400


def zone_database_version() -> str:
    """Version of the zone database in use, or 'unknown'."""
    for folder in zoneinfo.TZPATH:
        for name, pattern in (("+VERSION", r"(\S+)"), ("tzdata.zi", r"#\s*version\s+(\S+)")):
            path = Path(folder, name)
            if path.is_file():
                with path.open(encoding="ascii", errors="replace") as lines:
                    found = re.match(pattern, lines.readline())
                if found:
                    return found[1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@lru_cache(maxsize=2048)
def zone_table(name: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> tuple[np.ndarray, np.ndarray]:
    """(local thresholds, offsets) in seconds: offsets[searchsorted(thresholds, local, 'right')] turns local into UTC.

    The threshold of a transition is the later of its two local readings. So a skipped local time still
    uses the offset before the gap (it moves forward by the gap's length) and a repeated one means the first pass.
    """
    zone = zoneinfo.ZoneInfo(name)

    def offset(at: int) -> int:
        moment = dt.datetime.fromtimestamp(at, dt.timezone.utc).astimezone(zone)
        return int(moment.utcoffset().total_seconds())

    start, end = (int((dt.datetime(y, 1, 1) - _EPOCH).total_seconds()) for y in (first, last))
    thresholds, offsets = [], [offset(start)]
    low, week = start, 7 * 86400
    while low < end:
        high = min(low + week, end)
        before, after = offsets[-1], offset(high)
        if before != after:
            a, b = low, high
            while b - a > 1:
                middle = (a + b) // 2
                a, b = (middle, b) if offset(middle) == before else (a, middle)
            after = offset(b)
            thresholds.append(b + max(before, after))
            offsets.append(after)
            low = b
        else:
            low = high
    return np.array(thresholds, dtype=np.int64), np.array(offsets, dtype=np.int64)


def zone_offsets(name: str, local: np.ndarray) -> np.ndarray:
    """Offset from UTC in seconds of local times (seconds since 1970) of any year."""
    late = local >= (dt.datetime(LAST_YEAR, 1, 1) - _EPOCH).days * 86_400
    thresholds, offsets = zone_table(name)
    out = offsets[np.searchsorted(thresholds, local, side="right")]
    if late.any():
        # One cycle after the last year stands for all that follow; the table begins and ends a year outside of it.
        begin = (dt.datetime(LAST_YEAR, 1, 1) - _EPOCH).days * 86_400
        thresholds, offsets = zone_table(name, LAST_YEAR - 1, LAST_YEAR + 401)
        out = np.where(late, offsets[np.searchsorted(thresholds, begin + (local - begin) % CYCLE, side="right")], out)
    return out


# ---- parsers by mask --------------------------------------------------------------------------

# English month names, offsets in minutes of common zone abbreviations.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "trt": 180, "ist": 330,
    "jst": 540, "kst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780, "cot": -300,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
MONTH_NUMBER = {**{m: k + 1 for k, m in enumerate(MONTHS)}, **{m[:3]: k + 1 for k, m in enumerate(MONTHS)}, "sept": 9}
WEEKDAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "tues", "thur", "thurs"}

_TIME = r"(?P<h>9{1,2}):(?P<m>99)(?::(?P<s>99)(?:[.,](?P<f>9+))?)?(?: ?(?P<p>aa)(?!a))?"
_TAIL = r"(?: ?(?P<z>a{1,5}|[+-]99:?99|[+-]99))?"
SHAPES = [
    rf"(?P<Y>9999)(?P<sep>[-:/.])(?P<M>9{{1,2}})(?P=sep)(?P<D>9{{1,2}})(?:(?P<t>a|[ ]+){_TIME}{_TAIL})?",
    r"(?P<d>a):(?P<Y>9999)(?:(?P<M>99)(?:(?P<D>99)(?:(?P<h>99)(?:(?P<m>99)(?P<s>99)?)?)?)?)?(?P<z>a|[+-]99'(?:99'?)?|[+-]99:?99)?",
    r"(?P<Y>9999)(?P<M>99)(?P<D>99)(?:(?P<t>a)?(?P<h>99)(?P<m>99)(?P<s>99)(?:[.,](?P<f>9+))?(?P<z>a|[+-]99:?99)?)?",
    r"(?P<e>9{9,10}|9{13}|9{16}|9{19})",
    rf"(?P<D>9{{1,2}})(?P<sep>[.-])(?P<M>9{{1,2}})(?P=sep)(?P<Y>9999)(?:,?[ ]+{_TIME}{_TAIL})?",
    rf"(?P<A>9{{1,2}})/(?P<B>9{{1,2}})/(?P<Y>9999)(?:,?[ ]+{_TIME}{_TAIL})?",
    rf"(?:(?P<w>a{{3,9}}),? +)?(?P<D>9{{1,2}})(?P<sep>[ -])(?P<N>a{{3,9}})\.?(?P=sep)(?P<Y>9999)(?:,?[ ]+{_TIME}{_TAIL})?",
    rf"(?:(?P<w>a{{3,9}}),? +)?(?P<N>a{{3,9}})\.? +(?P<D>9{{1,2}})(?:aa)?,? +(?P<Y>9999)(?:,?[ ]+(?:aa )?{_TIME}{_TAIL})?",
    r"(?P<w>aaa) (?P<N>aaa) +(?P<D>9{1,2}) (?P<Y>9999) (?P<h>99):(?P<m>99):(?P<s>99) (?P<g>aaa)(?P<z>[+-]9999)",
    r"(?P<w>aaa) (?P<N>aaa) +(?P<D>9{1,2}) (?P<h>99):(?P<m>99):(?P<s>99)(?: (?P<z>a{1,5}))? (?P<Y>9999)",
]
#: Microseconds in one unit of an epoch count, by number of digits.
EPOCH_UNIT = {9: 1_000_000, 10: 1_000_000, 13: 1_000, 16: 1}


@lru_cache(maxsize=65536)
def parser_of(mask: str) -> dict[str, tuple[int, int]] | None:
    """Field name -> (start, end) for a mask, or null if the shape states no time. Compiled once per mask."""
    for shape in SHAPES:
        found = re.fullmatch(shape, mask)
        if found:
            return {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    return None


REMARK = re.compile(r"(?<=[+-]\d{4})\s+\([^()]*\)$")
_MASK = str.maketrans({**{c: "9" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
#: Masks of longer strings are parsed without being cached.
LONGEST_CACHED = 96


def _words(matrix: np.ndarray, span: tuple[int, int], table: dict[str, int]) -> np.ndarray:
    """Value of a letter field for each row by ``table``, -9999 where it isn't in it; looked up once per distinct word."""
    width = span[1] - span[0]
    cells = np.ascontiguousarray(matrix[:, span[0] : span[1]]).view(f"<U{width}").ravel()
    distinct, at = np.unique(cells, return_inverse=True)
    return np.array([table.get(w.lower(), -9999) for w in distinct], dtype=np.int64)[at]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of civil dates (proleptic Gregorian)."""
    months = (y - 1970) * 12 + (m - 1)
    return months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + ((m == 2) & leap)


def _parse_group(texts: list[str], zones: list[str | None], spans: dict[str, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(microseconds UTC, valid) for texts of one mask."""
    n = len(texts)
    matrix = np.array(texts).view("<U1").reshape(n, -1)
    codes = matrix.view(np.uint32).astype(np.int64)
    number = lambda k, default=0: np.full(n, default, dtype=np.int64) if k not in spans else (codes[:, spans[k][0] : spans[k][1]] - 48) @ 10 ** np.arange(spans[k][1] - spans[k][0] - 1, -1, -1)

    if "e" in spans:
        width = spans["e"][1] - spans["e"][0]
        if width < 19:
            return number("e") * EPOCH_UNIT[width], np.ones(n, dtype=bool)
        # Nanoseconds: what no signed 64-bit clock can count states no time.
        return np.array([int(t[:16]) for t in texts], dtype=np.int64), np.array([int(t) < 2**63 for t in texts])

    ok = np.ones(n, dtype=bool)
    if "A" in spans:
        american = np.array([bool(z) and z.startswith("America/") for z in zones])
        first, second = number("A"), number("B")
        month, day = np.where(american, first, second), np.where(american, second, first)
    else:
        month = _words(matrix, spans["N"], MONTH_NUMBER) if "N" in spans else number("M", 1)
        day = number("D", 1)
    year, hour = number("Y"), number("h")
    if "w" in spans:
        ok &= _words(matrix, spans["w"], dict.fromkeys(WEEKDAYS, 1)) == 1
    if "g" in spans:
        ok &= _words(matrix, spans["g"], {"gmt": 1, "utc": 1}) == 1
    if "d" in spans:
        ok &= _words(matrix, spans["d"], {"d": 1}) == 1
    if "t" in spans and "h" in spans and not matrix[0, spans["t"][0]].isspace():
        ok &= _words(matrix, spans["t"], {"t": 1}) == 1
    if "p" in spans:
        half = _words(matrix, spans["p"], {"am": 0, "pm": 12})
        # Two letters after a time that are no half of the day may be a zone.
        as_zone = _words(matrix, spans["p"], ZONES) if "z" not in spans else np.full(n, -9999)
        ok &= ((half >= 0) & (hour >= 1) & (hour <= 12)) | (as_zone != -9999)
        hour = np.where(half >= 0, hour % 12 + half, hour)
    minute, second = number("m"), number("s")
    ok &= (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (day <= _month_length(year, month)) & (hour <= 23) & (minute <= 59) & (second <= 59)
    micros = np.zeros(n, dtype=np.int64)
    if "f" in spans:
        a, b = spans["f"]
        kept = min(b - a, 6)
        micros = ((codes[:, a : a + kept] - 48) @ 10 ** np.arange(kept - 1, -1, -1)) * 10 ** (6 - kept)

    year, month, day = (np.where(ok, x, v) for x, v in ((year, 1970), (month, 1), (day, 1)))
    local = _days(year, month, day) * 86400 + hour * 3600 + minute * 60 + second
    offset = np.full(n, -(10**9), dtype=np.int64)
    if "z" in spans:
        a, b = spans["z"]
        if matrix[0, a].isalpha():
            minutes = _words(matrix, (a, b), ZONES)
            ok &= minutes != -9999
            offset = np.where(ok, minutes, 0) * 60
        else:
            digits = [k for k in range(a + 1, b) if matrix[0, k].isdigit()]
            hh = codes[:, digits[0]] * 10 + codes[:, digits[1]] - 528
            mm = codes[:, digits[2]] * 10 + codes[:, digits[3]] - 528 if len(digits) == 4 else np.zeros(n, dtype=np.int64)
            ok &= (mm <= 59) & (hh <= 18)
            offset = np.where(matrix[:, a] == "-", -1, 1) * (hh * 3600 + mm * 60)
    elif "p" in spans:
        named = (half < 0) & (as_zone != -9999)
        offset = np.where(named, as_zone * 60, offset)
    open_ = ok & (offset == -(10**9))
    if open_.any():
        offset = np.where(open_, 0, offset)
        names = np.array([z or "UTC" for z in zones], dtype=object)
        for name in set(names[open_]):
            mine = open_ & (names == name)
            try:
                offset[mine] = zone_offsets(name, local[mine])
            except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
                ok &= ~mine
                continue
    return (local - offset) * 1_000_000 + micros, ok


def utc_micros(values: list[str | None], zones: list[str | None]) -> list[int | None]:
    """Microseconds since 1970 UTC of every value, or null where it states no valid time."""
    out: list[int | None] = [None] * len(values)
    groups: dict[str, list[int]] = {}
    trimmed: list[str] = [""] * len(values)
    for k, value in enumerate(values):
        if value and (text := value.strip()):
            # A remark in brackets behind a time names its zone once more.
            trimmed[k] = text = REMARK.sub("", text) if text[-1] == ")" else text
            groups.setdefault(text.translate(_MASK), []).append(k)
    for mask, rows in groups.items():
        spans = (parser_of if len(mask) <= LONGEST_CACHED else parser_of.__wrapped__)(mask)
        if spans is None:
            continue
        micros, ok = _parse_group([trimmed[k] for k in rows], [zones[k] for k in rows], spans)
        for k, value, good in zip(rows, micros.tolist(), ok.tolist()):
            if good:
                out[k] = value
    return out


def normalise_timestamps(rows: DataFrame, key: str, columns: list[str], zone: str) -> DataFrame:
    """One row per key and column: (key, field_name, utc_us BIGINT, zone_version STRING).

    * ``utc_us`` is null where the raw value is null, blank or states no valid time,
      or where it needs a zone and ``zone`` names none that exists.
    * Values without a zone are local to ``zone``, or UTC if that's null. Skipped local times move forward by the
      length of the gap, repeated ones mean the first pass. Digits below microseconds are cut.
    * Repeated rows stay repeated; an empty table gives no rows; extra columns are ignored.

    Narrow: no exchange. The zone database of the driver is the reference: a worker with another
    version raises, so that one table never mixes two versions.
    """
    version = zone_database_version()
    kind = rows.schema[key].dataType
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("raw")) for c in columns])).alias("p")
    long = rows.select(F.col(key).alias("_key"), F.col(zone).cast("string").alias("_zone"), pairs).select("_key", "_zone", "p.field_name", "p.raw")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = zone_database_version()
        if here != version:
            raise RuntimeError(f"zone database {here} on a worker, {version} on the driver")
        for batch in batches:
            micros = utc_micros(batch.column("raw").to_pylist(), batch.column("_zone").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("field_name"), pa.array(micros, pa.int64()), pa.array([version] * batch.num_rows, pa.string())],
                names=["_key", "field_name", "utc_us", "zone_version"],
            )

    done = long.mapInArrow(convert, f"_key {kind.simpleString()}, field_name string, utc_us bigint, zone_version string")
    return done.withColumnRenamed("_key", key)


def instant(micros: Column) -> Column:
    """TIMESTAMP of a microsecond count."""
    return F.timestamp_micros(micros)
