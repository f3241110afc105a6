"""How files of each modality are prepared: metadata rows, segments and vectors, as DataFrames.

A preparer turns a table of files (id, path, path_key, …) into *prepared* files and segments. A file of which any part fails gives
an error row and no segments at all.
"""

from __future__ import annotations

import struct
import wave
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.embedding import AudioModel, ImageModel, TextModel, checked_vectors, embed
from shelfmark.functions.identity import EXTENSIONS
from shelfmark.operators.catalog import audio_ranges, whole_files
from shelfmark.operators.chunking import MAX_CHARACTERS, chunk_blocks
from shelfmark.session import materialise
from shelfmark.sources.blocks import ParseError
from shelfmark.sources.files import exploded_blocks, parse_documents
from shelfmark.sources.media import audio_metadata, decode_audio, media_metadata

#: What goes wrong with one file and must not stop the others.
FAULTS = (ParseError, OSError, EOFError, struct.error, wave.Error, ValueError, IndexError, ZeroDivisionError)
Decoder = Callable[[str, float, float, int], tuple[np.ndarray, int]]
Segmenter = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Prepared:
    """``files``: path, error, and what the modality adds to a parent; ``segments``: path, segment_index and what they hold."""

    files: DataFrame
    segments: DataFrame | None = None


@dataclass(frozen=True)
class Handler:
    """One modality: its extensions, whether a file or its segments carry the vectors, and how its files are prepared."""

    file_type: str
    extensions: frozenset[str]
    scope: str
    prepare: Callable[[DataFrame], Prepared]

    def __post_init__(self):
        kind = self.file_type.strip().casefold()
        dotted = frozenset("." + e.strip().casefold().lstrip(".") for e in self.extensions)
        if not kind or not dotted or "." in dotted:
            raise ValueError("a handler needs a file type and extensions")
        if self.scope not in ("file", "segment"):
            raise ValueError("a handler's scope is file or segment")
        object.__setattr__(self, "file_type", kind)
        object.__setattr__(self, "extensions", dotted)


def registry(handlers: Iterable[Handler]) -> dict[str, Handler]:
    """Handlers by file type; a type or an extension claimed twice is an error, and so is an empty registry."""
    known: dict[str, Handler] = {}
    owner: dict[str, str] = {}
    for handler in handlers:
        taken = {owner[e] for e in handler.extensions if e in owner}
        if handler.file_type in known or taken:
            raise ValueError(f"{handler.file_type!r} is registered twice" if handler.file_type in known else f"{handler.file_type!r} and {min(taken)!r} claim the same extension")
        known[handler.file_type] = handler
        owner |= dict.fromkeys(handler.extensions, handler.file_type)
    if not known:
        raise ValueError("a library needs a handler")
    return known


# ---- text -----------------------------------------------------------------------------------------


def text_handler(model: TextModel, vector: str, most: int = MAX_CHARACTERS) -> Handler:
    """Documents: parsed, chunked, every chunk embedded with the headings above it."""

    def prepare(files: DataFrame) -> Prepared:
        parsed = materialise(parse_documents(files.select("path")), "parsed")
        chunks = materialise(chunk_blocks(exploded_blocks(parsed), "path", most), "chunks")
        segments = chunks.select(
            "path", F.col("index").alias("segment_index"), F.lit("text").alias("segment_kind"), F.col("text").alias("chunk_text"), F.length("text").alias("character_count"), "first_block_index", "last_block_index", "page_number", "slide_number",
            "section_path", F.try_element_at("section_path", F.lit(-1)).alias("heading"), "source_line_start", "source_line_end", embed(F.col("embedding_text"), model).alias(vector),
        )
        return Prepared(parsed.select("path", "title", "language", "error"), segments)

    return Handler("text", frozenset(EXTENSIONS["text"]), "segment", prepare)


# ---- images ---------------------------------------------------------------------------------------


def image_handler(model: ImageModel, vector: str) -> Handler:
    """Images: metadata of the header, one vector a file."""

    def prepare(files: DataFrame) -> Prepared:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                images = [Path(n).read_bytes() for n in names]
                vectors = checked_vectors(model.encode_images(images), len(images), model.dims) if images else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float32()))], names=["path", vector])

        known = materialise(media_metadata(files.select("path", "file_type")), "image-metadata")
        good = known.filter("error is null").select("path").mapInArrow(run, f"path string, `{vector}` array<float>")
        described = known.select("path", "metadata", F.col("metadata.mime_type").alias("mime_type"), "error")
        return Prepared(described.join(good, "path", "left"))

    return Handler("image", frozenset(EXTENSIONS["image"]), "file", prepare)


# ---- audio ----------------------------------------------------------------------------------------


def sliding(window: float, hop: float | None = None) -> Segmenter:
    """Overlapping windows; half a window apart where nothing else is said."""
    return lambda files, duration: audio_ranges(files, duration, window, hop)


def whole(files: DataFrame, duration: str) -> DataFrame:
    """The whole file as one range."""
    return whole_files(files, duration)


def audio_vectors(ranges: DataFrame, model: AudioModel, decoder: Decoder = decode_audio) -> DataFrame:
    """Ranges (path, segment_index, start_seconds, end_seconds) with ``vector`` and ``error``; decoded and embedded in batches of the model's size."""
    size = getattr(model, "batch_size", 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                samples, errors = [], []
                for row in part.to_pylist():
                    try:
                        mono, _ = decoder(row["path"], row["start_seconds"], row["end_seconds"], model.sampling_rate)
                        if mono.ndim != 1 or not len(mono):
                            raise ValueError("a range without samples")
                        samples.append(mono)
                        errors.append(None)
                    except FAULTS as error:
                        samples.append(None)
                        errors.append(f"{type(error).__name__}: {error}")
                given = [m for m in samples if m is not None]
                found = iter(checked_vectors(model.encode_audio(given), len(given), model.dims) if given else [])
                vectors = [None if m is None else next(found) for m in samples]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*part.schema.names, "vector", "error"])

    slim = ranges.select("path", F.col("segment_index").cast("int").alias("segment_index"), F.col("start_seconds").cast("double").alias("start_seconds"), F.col("end_seconds").cast("double").alias("end_seconds"))
    return slim.mapInArrow(run, "path string, segment_index int, start_seconds double, end_seconds double, vector array<float>, error string")


def audio_handler(model: AudioModel, vector: str, segmenter: Segmenter | None = None, decoder: Decoder = decode_audio) -> Handler:
    """Recordings: metadata of the header, one vector a range. A file with a range that can't be decoded, or without any, is an error row."""
    cut = segmenter or sliding(model.max_seconds)

    def prepare(files: DataFrame) -> Prepared:
        known = materialise(media_metadata(files.select("path", "file_type")), "audio-metadata")
        timed = known.filter("error is null").withColumn("duration", F.col("metadata.duration_seconds"))
        made = materialise(audio_vectors(cut(timed.select("path", "duration"), "duration"), model, decoder), "audio-vectors")
        failed = made.groupBy("path").agg(F.min("error").alias("bad"), F.count(F.lit(1)).alias("ranges"))
        nothing = F.when(F.col("error").isNull() & F.col("ranges").isNull(), F.lit("ParseError: a file without a duration has no range to embed"))
        judged = known.join(failed, "path", "left").withColumn("error", F.coalesce("error", "bad", nothing))
        segments = made.join(judged.filter("error is null").select("path"), "path", "left_semi")
        segments = segments.select("path", "segment_index", F.lit("audio").alias("segment_kind"), "start_seconds", "end_seconds", F.col("vector").alias(vector))
        return Prepared(judged.select("path", "metadata", F.col("metadata.mime_type").alias("mime_type"), "error"), segments)

    return Handler("audio", frozenset(EXTENSIONS["audio"]), "segment", prepare)


# ---- query files ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ImageQuery:
    """Vector of an image file."""

    model: ImageModel
    supported_extensions: tuple[str, ...] = EXTENSIONS["image"]

    def vectors(self, path: Path) -> list[list[float]]:
        return checked_vectors(self.model.encode_images([path.read_bytes()]), 1, self.model.dims).tolist()


@dataclass(frozen=True)
class AudioQuery:
    """Vectors of the ranges of a recording, cut as for indexing: windows of the model's length, half of it apart, or as given."""

    model: AudioModel
    window: float | None = None
    hop: float | None = None
    decoder: Decoder = decode_audio
    supported_extensions: tuple[str, ...] = EXTENSIONS["audio"]

    def vectors(self, path: Path) -> list[list[float]]:
        try:
            seconds = audio_metadata(path.read_bytes())["duration_seconds"]
            window = self.window or self.model.max_seconds
            hop = self.hop or window / 2
            starts = np.arange(0, max(1, int(np.ceil(max(seconds - window, 0) / hop)) + 1)) * hop if seconds > 0 else []
            samples = [self.decoder(str(path), a, min(a + window, seconds), self.model.sampling_rate)[0] for a in map(float, starts)]
        except FAULTS as error:
            raise ValueError(f"the query file {path} can't be read: {error}") from error
        if not samples:
            raise ValueError(f"the query file {path} has no duration")
        return checked_vectors(self.model.encode_audio(samples), len(samples), self.model.dims).tolist()
