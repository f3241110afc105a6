"""Metadata of image and audio files from their headers, and decoding of ranges of uncompressed audio."""

from __future__ import annotations

import io
import math
import mmap
import os
import struct
import wave
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.blocks import ParseError

MEDIA_SCHEMA = (
    "width int, height int, image_format string, color_mode string, frame_count int, is_animated boolean, "
    "duration_seconds double, sample_rate_hz int, channels int, bitrate_bps int, bits_per_sample int, audio_format string, codec string, tags map<string,array<string>>, "
    "exif map<string,string>, mime_type string"
)
_FIELDS = [f.strip().split(" ", 1)[0] for f in MEDIA_SCHEMA.replace("map<string,array<string>>", "map").replace("map<string,string>", "map").split(",")]
# MIME types of the formats, and names of common EXIF tags.
MIME = {
    "PNG": "image/png", "GIF": "image/gif", "BMP": "image/bmp", "JPEG": "image/jpeg", "TIFF": "image/tiff", "WEBP": "image/webp",
    "WAVE": "audio/wav", "AIFF": "audio/aiff", "FLAC": "audio/flac", "Ogg": "audio/ogg", "MP3": "audio/mpeg", "MP4": "audio/mp4",
}
EXIF_NAMES = {
    256: "ImageWidth", 257: "ImageLength", 270: "ImageDescription", 271: "Make", 272: "Model", 274: "Orientation", 282: "XResolution", 283: "YResolution", 296: "ResolutionUnit", 305: "Software", 306: "DateTime", 315: "Artist",
    33432: "Copyright", 33434: "ExposureTime", 33437: "FNumber", 34665: "ExifOffset", 34853: "GPSInfo", 36867: "DateTimeOriginal", 36868: "DateTimeDigitized", 37386: "FocalLength", 40962: "ExifImageWidth", 40963: "ExifImageHeight",
}


# ---- images -----------------------------------------------------------------------------------


def image_metadata(raw: bytes) -> dict[str, Any]:
    """Size, format, colour mode, frames, EXIF tags and MIME type of PNG, GIF, BMP, JPEG, WebP and TIFF."""
    found = _image_header(raw)
    return found | {"exif": exif_tags(raw), "mime_type": MIME[found["image_format"]]}


def exif_tags(raw: bytes) -> dict[str, str]:
    """Tags of the first EXIF directory by name (by number where the name isn't known); none where there is no EXIF."""
    if raw[:2] == b"\xff\xd8":
        at = raw.find(b"Exif\0\0")
        block = raw[at + 6 :] if at >= 0 else b""
    elif raw.startswith(b"\x89PNG"):
        at = raw.find(b"eXIf")
        block = raw[at + 4 :] if at >= 0 else b""
    elif raw[:4] == b"RIFF":
        at = raw.find(b"EXIF")
        block = raw[at + 8 :] if at >= 0 else b""
        block = block[6:] if block.startswith(b"Exif\0\0") else block
    else:
        block = raw if raw[:4] in (b"II*\0", b"MM\0*") else b""
    if block[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if block[:2] == b"II" else ">"
    try:
        at = struct.unpack(f"{order}I", block[4:8])[0]
        count = struct.unpack(f"{order}H", block[at : at + 2])[0]
        entries = [block[at + 2 + 12 * k : at + 14 + 12 * k] for k in range(count)]
        return {EXIF_NAMES.get(tag, str(tag)): value for tag, value in (_exif_value(order, block, e) for e in entries if len(e) == 12) if value is not None}
    except struct.error:
        return {}


def _exif_value(order: str, block: bytes, entry: bytes) -> tuple[int, str | None]:
    tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
    # Type -> (bytes of one value, code to unpack it with): byte, text, short, long, fraction, signed fraction.
    known = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 10: (8, "ii")}
    if kind not in known:
        return tag, None
    width, code = known[kind]
    at = struct.unpack(f"{order}I", entry[8:12])[0]
    data = entry[8 : 8 + width * count] if width * count <= 4 else block[at : at + width * count]
    if kind == 2:
        return tag, data.split(b"\0")[0].decode("utf-8", "replace").strip()
    values = struct.iter_unpack(order + code, data)
    return tag, ", ".join(f"{v[0] / v[1]:g}" if len(v) == 2 and v[1] else str(v[0]) for v in values)


def _image_header(raw: bytes) -> dict[str, Any]:
    for mark, read in ((b"\x89PNG\r\n\x1a\n", _png), (b"GIF8", _gif), (b"BM", _bmp), (b"\xff\xd8", _jpeg), (b"II*\0", _tiff), (b"MM\0*", _tiff)):
        if raw.startswith(mark):
            return read(raw)
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return _webp(raw)
    raise ParseError("no supported image")


def _image(fmt: str, width: int, height: int, mode: str | None, frames: int = 1) -> dict[str, Any]:
    if width < 1 or height < 1:
        raise ParseError("an image without size")
    return {"image_format": fmt, "width": width, "height": height, "color_mode": mode, "frame_count": frames, "is_animated": frames > 1}


def _png(raw: bytes) -> dict[str, Any]:
    width, height, depth, kind = struct.unpack(">IIBB", raw[16:26])
    at = raw.find(b"acTL")
    frames = struct.unpack(">I", raw[at + 4 : at + 8])[0] if 0 <= at < raw.find(b"IDAT") else 1
    mode = {0: "1" if depth == 1 else "I;16" if depth == 16 else "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind)
    return _image("PNG", width, height, mode, frames)


def _gif(raw: bytes) -> dict[str, Any]:
    width, height, flags = struct.unpack("<HHB", raw[6:11])
    at, frames = 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), 0

    def skip(at: int) -> int:
        while at < len(raw) and raw[at]:
            at += raw[at] + 1
        return at + 1

    while at < len(raw):
        if raw[at] == 0x2C and at + 10 <= len(raw):
            frames += 1
            local = raw[at + 9]
            at = skip(at + 11 + (3 << ((local & 7) + 1) if local & 128 else 0))
        elif raw[at] == 0x21:
            at = skip(at + 2)
        else:
            break
    return _image("GIF", width, height, "P", max(frames, 1))


def _bmp(raw: bytes) -> dict[str, Any]:
    width, height = struct.unpack("<ii", raw[18:26])
    bits = struct.unpack("<H", raw[28:30])[0]
    return _image("BMP", width, abs(height), {1: "1", 4: "P", 8: "P", 24: "RGB", 32: "RGBA"}.get(bits))


def _jpeg(raw: bytes) -> dict[str, Any]:
    at = 2
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            at += 1
            continue
        mark = raw[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", raw[at + 5 : at + 10])
            return _image("JPEG", width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(parts))
        at += 2 if mark in (0x01, 0xFF) or 0xD0 <= mark <= 0xD8 else 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    raise ParseError("a JPEG without a frame")


def _webp(raw: bytes) -> dict[str, Any]:
    kind, body = raw[12:16], raw[20:]
    if kind == b"VP8X":
        size = lambda b: int.from_bytes(b, "little") + 1
        return _image("WEBP", size(body[4:7]), size(body[7:10]), "RGBA" if body[0] & 16 else "RGB", max(raw.count(b"ANMF"), 1))
    if kind == b"VP8L":
        bits = int.from_bytes(body[1:5], "little")
        return _image("WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "RGBA" if bits >> 28 & 1 else "RGB")
    width, height = struct.unpack("<HH", body[6:10])
    return _image("WEBP", width & 0x3FFF, height & 0x3FFF, "RGB")


def _tiff(raw: bytes) -> dict[str, Any]:
    order = "<" if raw[:2] == b"II" else ">"
    at, frames, first = struct.unpack(f"{order}I", raw[4:8])[0], 0, {}
    while 0 < at + 2 <= len(raw) and frames < 10_000:
        count = struct.unpack(f"{order}H", raw[at : at + 2])[0]
        for k in range(count if not frames else 0):
            entry = raw[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) == 12:
                tag, kind = struct.unpack(f"{order}HH", entry[:4])
                first[tag] = struct.unpack(f"{order}H", entry[8:10])[0] if kind == 3 else struct.unpack(f"{order}I", entry[8:12])[0]
        frames += 1
        end = at + 2 + 12 * count
        at = struct.unpack(f"{order}I", raw[end : end + 4])[0] if end + 4 <= len(raw) else 0
    return _image("TIFF", first.get(256, 0), first.get(257, 0), {1: "L", 3: "RGB", 4: "RGBA"}.get(first.get(277, 1)), max(frames, 1))


# ---- audio ------------------------------------------------------------------------------------


def audio_metadata(raw: bytes, extension: str = "", size: int | None = None) -> dict[str, Any]:
    """Duration, rate, channels, bits, format, codec, text tags and MIME type of WAV, AIFF, FLAC, Ogg, MP3 and MP4."""
    found = _audio_header(raw, size)
    return found | {"mime_type": MIME[found["audio_format"]]}


def _audio_header(raw: bytes, size: int | None) -> dict[str, Any]:
    if raw[4:8] == b"ftyp":
        return _mp4(raw, size if size is not None else len(raw))
    if raw[:4] == b"RIFF" and raw[8:12] == b"WAVE":
        return _wav(raw)
    if raw[:4] == b"FORM" and raw[8:12] in (b"AIFF", b"AIFC"):
        return _aiff(raw)
    if raw[:4] == b"fLaC":
        return _flac(raw)
    if raw[:4] == b"OggS":
        return _ogg(raw)
    if raw[:3] == b"ID3" or (len(raw) > 1 and raw[0] == 0xFF and raw[1] & 0xE0 == 0xE0):
        return _mp3(raw, size if size is not None else len(raw))
    raise ParseError("no supported audio")


def _audio(fmt: str, seconds: float, rate: int, channels: int, bits: int | None, bitrate: float | None, codec: str, tags: dict | None = None) -> dict[str, Any]:
    if not math.isfinite(seconds) or seconds < 0:
        raise ParseError("a duration that is no time")
    whole = lambda v: int(v) if v and v > 0 else None
    return {"audio_format": fmt, "duration_seconds": seconds, "sample_rate_hz": whole(rate), "channels": whole(channels), "bits_per_sample": whole(bits), "bitrate_bps": whole(bitrate), "codec": codec, "tags": tags or {}}


def _wav(raw: bytes) -> dict[str, Any]:
    at, head = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if name == b"fmt ":
            head = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif name == b"data" and head:
            kind, channels, rate, per_second, _, bits = head
            return _audio("WAVE", size / per_second if per_second else 0.0, rate, channels, bits, per_second * 8, {1: "PCM", 3: "IEEE float", 6: "A-law", 7: "mu-law"}.get(kind, str(kind)))
        at += 8 + size + size % 2
    raise ParseError("a WAV file without data")


def _aiff(raw: bytes) -> dict[str, Any]:
    at = 12
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack(">I", raw[at + 4 : at + 8])[0]
        if name == b"COMM":
            channels, frames, bits = struct.unpack(">hIh", raw[at + 8 : at + 16])
            power, mantissa = struct.unpack(">HQ", raw[at + 16 : at + 26])
            rate = mantissa * 2.0 ** ((power & 0x7FFF) - 16446)
            return _audio("AIFF", frames / rate if rate else 0.0, round(rate), channels, bits, rate * channels * bits, "PCM")
        at += 8 + size + size % 2
    raise ParseError("an AIFF file without a header")


def _comments(raw: bytes) -> dict[str, list[str]]:
    tags: dict[str, list[str]] = {}
    at = 4 + struct.unpack("<I", raw[:4])[0]
    count, at = struct.unpack("<I", raw[at : at + 4])[0], at + 4
    for _ in range(min(count, 10_000)):
        size = struct.unpack("<I", raw[at : at + 4])[0]
        key, _, value = raw[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        tags.setdefault(key.casefold(), []).append(value)
        at += 4 + size
    return tags


def _flac(raw: bytes) -> dict[str, Any]:
    at, info, tags = 4, None, {}
    while at + 4 <= len(raw):
        kind, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if kind & 127 == 0:
            bits = int.from_bytes(body[10:18], "big")
            info = bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1
        elif kind & 127 == 4:
            tags = _comments(body)
        at += 4 + size
        if kind & 128:
            break
    if info is None:
        raise ParseError("a FLAC file without a header")
    rate, channels, depth, frames = info
    return _audio("FLAC", frames / rate if rate else 0.0, rate, channels, depth, None, "FLAC", tags)


def _ogg(raw: bytes) -> dict[str, Any]:
    vorbis, opus = raw.find(b"\x01vorbis"), raw.find(b"OpusHead")
    last = raw.rfind(b"OggS")
    frames = struct.unpack("<q", raw[last + 6 : last + 14])[0]
    if vorbis >= 0:
        channels, rate, _, nominal = struct.unpack("<BIii", raw[vorbis + 11 : vorbis + 24])
        note = raw.find(b"\x03vorbis")
        return _audio("Ogg", max(frames, 0) / rate if rate else 0.0, rate, channels, None, nominal, "Vorbis", _comments(raw[note + 7 :]) if note >= 0 else {})
    if opus >= 0:
        return _audio("Ogg", max(frames, 0) / 48000, 48000, raw[opus + 9], None, None, "Opus")
    raise ParseError("an Ogg file of an unknown codec")


#: Fixed values of the MP3 format: kilobits of layer III by version, and sampling rates.
MP3_KBPS = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
MP3_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


def _synchsafe(four: bytes) -> int:
    return sum((b & 127) << 7 * (3 - k) for k, b in enumerate(four))


def id3_tags(raw: bytes) -> dict[str, list[str]]:
    """Text frames of an ID3 tag of version 2.3 or 2.4 by lower-case frame name; binary frames are left out."""
    tags: dict[str, list[str]] = {}
    version, at, end = raw[3], 10, 10 + _synchsafe(raw[6:10])
    while version in (3, 4) and at + 10 <= min(end, len(raw)) and raw[at : at + 4].isalnum():
        size = _synchsafe(raw[at + 4 : at + 8]) if version == 4 else int.from_bytes(raw[at + 4 : at + 8], "big")
        name, body = raw[at : at + 4].decode("ascii"), raw[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            values = [v.strip() for v in text.split("\0") if v.strip()]
            if name == "TXXX" and len(values) > 1:
                name, values = f"TXXX:{values[0]}", values[1:]
            if values:
                tags.setdefault(name.casefold(), []).extend(values)
        at += 10 + size
    return tags


def _boxes(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the boxes of an MP4 file between two offsets."""
    while at + 8 <= end:
        size, name, head = int.from_bytes(raw[at : at + 4], "big"), raw[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(raw[at + 8 : at + 16], "big"), 16
        stop = end if size == 0 else min(at + size, end)
        if stop < at + head:
            return
        yield name, at + head, stop
        at = stop


def _mp4(raw: bytes, size: int) -> dict[str, Any]:
    nested = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst"}
    seconds, rate, channels, bits, codec, tags = None, 0, 0, None, None, {}
    stack = [(0, len(raw), b"")]
    while stack:
        begin, end, inside = stack.pop()
        for name, a, b in _boxes(raw, begin, end):
            if name in nested:
                stack.append((a, b, name))
            elif name == b"meta":
                stack.append((a + 4, b, name))
            elif name == b"mvhd":
                long = raw[a] == 1
                scale, length = struct.unpack(">IQ" if long else ">II", raw[a + (20 if long else 12) : a + (32 if long else 20)])
                seconds = length / scale if scale else 0.0
            elif name == b"stsd":
                entry = a + 8
                if raw[entry + 4 : entry + 8] in (b"mp4a", b"alac", b"ac-3", b"Opus", b"fLaC"):
                    codec = raw[entry + 4 : entry + 8].decode("ascii")
                    channels, bits = struct.unpack(">HH", raw[entry + 24 : entry + 28])
                    rate = struct.unpack(">I", raw[entry + 32 : entry + 36])[0] >> 16
            elif inside == b"ilst":
                for kind, c, d in _boxes(raw, a, b):
                    if kind == b"data" and raw[c : c + 4] == b"\0\0\0\1" and (value := raw[c + 8 : d].decode("utf-8", "replace").strip()):
                        tags.setdefault(name.decode("latin-1").casefold(), []).append(value)
    if seconds is None or codec is None:
        raise ParseError("an MP4 file without an audio track")
    return _audio("MP4", seconds, rate, channels, bits, size * 8 / seconds if seconds else None, codec, tags)


def _mp3(raw: bytes, size: int) -> dict[str, Any]:
    at, tags = 0, {}
    if raw[:3] == b"ID3":
        at, tags = 10 + _synchsafe(raw[6:10]), id3_tags(raw)
    while at + 4 <= len(raw):
        if raw[at] == 0xFF and raw[at + 1] & 0xE0 == 0xE0:
            version, layer, rate_at, kbps_at = raw[at + 1] >> 3 & 3, raw[at + 1] >> 1 & 3, raw[at + 2] >> 2 & 3, raw[at + 2] >> 4
            if version in MP3_RATES and layer == 1 and rate_at < 3 and 0 < kbps_at < 15:
                rate, kbps = MP3_RATES[version][rate_at], MP3_KBPS[1 if version == 3 else 2][kbps_at]
                samples = 1152 if version == 3 else 576
                vbr = max(raw.find(b"Xing", at, at + 64), raw.find(b"Info", at, at + 64))
                if vbr >= 0 and raw[vbr + 7] & 1:
                    seconds = struct.unpack(">I", raw[vbr + 8 : vbr + 12])[0] * samples / rate
                else:
                    seconds = (size - at) * 8 / (kbps * 1000)
                return _audio("MP3", seconds, rate, 1 if raw[at + 3] >> 6 == 3 else 2, None, kbps * 1000, "MP3", tags)
        at += 1
    raise ParseError("an MP3 file without a frame")


def _pcm(data: bytes, width: int, big: bool, unsigned: bool) -> np.ndarray:
    """Samples of 1 to 4 bytes as numbers in -1…1."""
    if width == 3:
        parts = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        low, high = (2, 0) if big else (0, 2)
        return ((parts[:, low] << 8 | parts[:, 1] << 16 | parts[:, high] << 24) >> 8) / float(1 << 23)
    if width == 1 and unsigned:
        return np.frombuffer(data, np.uint8).astype(np.float64) / 128 - 1
    return np.frombuffer(data, f"{'>' if big else '<'}i{width}") / float(1 << 8 * width - 1)


def _mono(data: bytes, width: int, channels: int, own: int, rate: int | None, big: bool, unsigned: bool) -> tuple[np.ndarray, int]:
    mono = _pcm(data, width, big, unsigned).reshape(-1, channels).mean(axis=1)
    if rate and rate != own:
        count = max(1, round(len(mono) * rate / own))
        mono = np.interp(np.arange(count) * own / rate, np.arange(len(mono)), mono)
    return mono.astype(np.float32), rate or own


def decode_wav(raw: bytes | str, start: float, end: float, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Mono samples of [start, end) seconds in -1…1, resampled linearly to ``rate``; an empty range is an error.

    ``raw`` is the content or a path; of a path only the range is read.
    """
    with wave.open(io.BytesIO(raw) if isinstance(raw, bytes) else raw) as source:
        own, width, channels = source.getframerate(), source.getsampwidth(), source.getnchannels()
        first, last = (min(max(round(t * own), 0), source.getnframes()) for t in (start, end))
        if last <= first:
            raise ParseError("an empty audio range")
        source.setpos(first)
        data = source.readframes(last - first)
    return _mono(data, width, channels, own, rate, False, True)


def decode_aiff(raw: bytes | str, start: float, end: float, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Like ``decode_wav``, for uncompressed AIFF."""
    with io.BytesIO(raw) if isinstance(raw, bytes) else open(raw, "rb") as source:
        source.seek(12)
        head = sound = None
        while (chunk := source.read(8)) and len(chunk) == 8 and not (head and sound):
            name, size = chunk[:4], int.from_bytes(chunk[4:], "big")
            begin = source.tell()
            if name == b"COMM":
                body = source.read(size)
                power, mantissa = struct.unpack(">HQ", body[8:18])
                if size > 18 and body[18:22] not in (b"NONE", b"twos"):
                    raise ParseError("a compressed AIFF file")
                head = *struct.unpack(">hIh", body[:8]), round(mantissa * 2.0 ** ((power & 0x7FFF) - 16446))
            elif name == b"SSND":
                sound = begin + 8 + int.from_bytes(source.read(4), "big")
            source.seek(begin + size + size % 2)
        if not head or not sound:
            raise ParseError("an AIFF file without sound")
        channels, frames, bits, own = head
        width = (bits + 7) // 8
        first, last = (min(max(round(t * own), 0), frames) for t in (start, end))
        if last <= first:
            raise ParseError("an empty audio range")
        source.seek(sound + first * width * channels)
        data = source.read((last - first) * width * channels)
    return _mono(data, width, channels, own, rate, True, False)


def decode_audio(path: str, start: float, end: float, rate: int | None = None) -> tuple[np.ndarray, int]:
    """Range of a file by its leading bytes; formats that are compressed need a decoder of your own."""
    with open(path, "rb") as source:
        head = source.read(12)
    if head[:4] == b"RIFF":
        return decode_wav(path, start, end, rate)
    if head[:4] == b"FORM":
        return decode_aiff(path, start, end, rate)
    raise ParseError("no decoder for this audio format")


def media_metadata(files: DataFrame, path: str = "path", file_type: str = "file_type") -> DataFrame:
    """Image and audio files with ``metadata`` (MEDIA_SCHEMA) and ``error``; other files have neither."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, kind in zip(frame["path"], frame["kind"]):
                row: dict[str, Any] = dict.fromkeys(_FIELDS) | {"path": name, "error": None}
                try:
                    with open(name, "rb") as source:
                        if kind == "image":
                            row |= image_metadata(source.read())
                        else:
                            # Headers stand at either end; a long recording isn't read into memory.
                            with mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                                row |= audio_metadata(mapped, size=os.path.getsize(name))
                except (ParseError, OSError, EOFError, struct.error, IndexError, ValueError, ZeroDivisionError) as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                rows.append(row)
            out = pd.DataFrame(rows, columns=["path", *_FIELDS, "error"])
            for c in ("width", "height", "frame_count", "sample_rate_hz", "channels", "bitrate_bps", "bits_per_sample"):
                out[c] = out[c].astype("Int32")
            yield out

    media = files.filter(F.col(file_type).isin("image", "audio")).select(F.col(path).alias("path"), F.col(file_type).alias("kind"))
    found = media.mapInPandas(run, f"path string, {MEDIA_SCHEMA}, error string")
    packed = found.select("path", F.struct(*_FIELDS).alias("metadata"), "error")
    return files.join(packed.withColumnRenamed("path", path), path, "left")
