"""Files as a source: discovery, hashing and parsing, distributed over folders and files.

Listing is spread over the first levels of folders, as one listing on the driver doesn't reach a large tree, and Spark's own
``binaryFile`` source leaves out names that begin with a dot or an underscore.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.identity import EXTENSIONS, extension_of, file_id, file_type_of, fold, format_key
from shelfmark.sources.blocks import DOCUMENT_SCHEMA, Parsed, ParseError
from shelfmark.sources.html import parse_html
from shelfmark.sources.markdown import parse_markdown
from shelfmark.sources.office import parse_docx, parse_pptx
from shelfmark.sources.pdf import parse_pdf

Parser = Callable[[bytes], Parsed]
PARSERS: dict[str, Parser] = {".pdf": parse_pdf, ".htm": parse_html, ".html": parse_html, ".md": parse_markdown, ".docx": parse_docx, ".pptx": parse_pptx}
#: Documents above this size give an error row, as one is held whole while it is parsed.
MOST_BYTES = 1 << 30
#: Folders that are listed by tasks rather than on the driver.
LISTED_BY_TASKS = 4096


def register_parser(extension: str, parser: Parser, parsers: dict[str, Parser] | None = None) -> dict[str, Parser]:
    """A registry with one parser more; extensions are lower case with a dot, and have one parser each."""
    if extension != extension.casefold() or not extension.startswith("."):
        raise ValueError("an extension is lower case and begins with a dot")
    known = dict(PARSERS if parsers is None else parsers)
    if extension in known:
        raise ValueError(f"{extension} has a parser already")
    return known | {extension: parser}


def _walk(top: str, deep: bool) -> Iterator[tuple[str, list[str], list[str]]]:
    """Like ``os.walk``, but names of one folder come some thousands at a time, so that a flat folder of millions isn't held whole."""
    stack = [top]
    while stack:
        here, names, folders = stack.pop(), [], []
        try:
            with os.scandir(here) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.path)
                    else:
                        names.append(entry.name)
                    if len(names) >= 5_000:
                        yield here, [], names
                        names = []
        except OSError:
            continue
        yield here, [], names
        stack += folders if deep else []


def _listing(found: list[tuple]) -> pa.RecordBatch:
    path, key, name, size, us = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(key), pa.array(name), pa.array(size, pa.int64()), pa.array(us, pa.int64())], names=["path", "path_key", "file_name", "size_bytes", "us"])


def discover(spark: SparkSession, folder: str, recursive: bool = True, allowed_types: Sequence[str] | None = None, extensions: Mapping[str, Iterable[str]] = EXTENSIONS, ordered: bool = False) -> DataFrame:
    """(path, path_key, file_name, extension, format_key, file_type, size_bytes, modified_at) of supported files.

    Folders and unsupported files are left out; links to files count as files. An unknown type is a ValueError, a path that is
    no folder a NotADirectoryError. ``extensions`` says which ones each type supports; ``ordered`` sorts by path.
    """
    root = Path(folder).expanduser().resolve()
    if not root.is_dir():
        raise NotADirectoryError(str(folder))
    if unknown := set(allowed_types or ()) - set(extensions):
        raise ValueError(f"unknown file types: {', '.join(sorted(unknown))}")
    # The driver opens folders breadth first until there are enough for all tasks; each task then walks its own.
    open_folders, done = deque([str(root)]), []
    while recursive and open_folders and len(open_folders) + len(done) < LISTED_BY_TASKS:
        here = open_folders.popleft()
        done.append(here)
        with os.scandir(here) as entries:
            open_folders += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
    work = [(d, False) for d in done] + [(d, recursive) for d in open_folders]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = []
                for here, folders, names in _walk(top, deep):
                    for name in names:
                        path = os.path.join(here, name)
                        try:
                            stat = os.stat(path)
                        except OSError:
                            continue
                        if os.path.isfile(path):
                            found.append((path, os.path.normcase(os.path.realpath(path)), name, stat.st_size, int(stat.st_mtime * 1e6)))
                    if len(found) >= 10_000:
                        yield _listing(found)
                        found = []
                if found:
                    yield _listing(found)

    folders = spark.createDataFrame(work, "folder string, deep boolean").repartition(max(1, min(len(work), spark.sparkContext.defaultParallelism * 4)))
    listed = folders.mapInArrow(walk, "path string, path_key string, file_name string, size_bytes bigint, us bigint")
    typed = listed.withColumn("extension", fold(extension_of(F.col("file_name")))).withColumn("file_type", file_type_of(F.col("extension"), extensions)).filter("file_type is not null")
    if allowed_types is not None:
        typed = typed.filter(F.col("file_type").isin(list(allowed_types)))
    typed = typed.orderBy("path") if ordered else typed
    return typed.select("path", "path_key", "file_name", "extension", format_key(F.col("extension")).alias("format_key"), "file_type", "size_bytes", F.timestamp_micros("us").alias("modified_at"))


def hash_files(files: DataFrame, path: str = "path", chunk: int = 1 << 20) -> DataFrame:
    """Files with ``content_hash`` (SHA-256, read in pieces) and ``error``."""
    kinds = files.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, errors = [], []
            for name in batch.column(batch.schema.get_field_index(path)).to_pylist():
                try:
                    digest = hashlib.sha256()
                    with open(name, "rb") as source:
                        while piece := source.read(chunk):
                            digest.update(piece)
                    digests.append(digest.hexdigest())
                    errors.append(None)
                except OSError as error:
                    digests.append(None)
                    errors.append(str(error))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, "content_hash", "error"])

    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return files.mapInArrow(run, f"{spec}, content_hash string, error string")


def parse_documents(files: DataFrame, path: str = "path", content: str | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, document columns, error): one row per file, from the file itself or from a binary ``content`` column.

    A document that can't be read gives a row with ``error`` and no blocks. Which parser runs is decided by the extension.
    """
    import pandas as pd

    known = dict(PARSERS if parsers is None else parsers)
    names = [f.split(" ", 1)[0] for f in _split_fields(DOCUMENT_SCHEMA)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, name in enumerate(frame["path"]):
                row = dict.fromkeys(names) | {"path": name, "error": None}
                try:
                    parser = known.get(os.path.splitext(name)[1].casefold())
                    if parser is None:
                        raise ParseError("unsupported extension")
                    if not content and os.path.getsize(name) > MOST_BYTES:
                        raise ParseError(f"a document of more than {MOST_BYTES} bytes")
                    raw = bytes(frame["content"].iloc[k]) if content else Path(name).read_bytes()
                    row |= parser(raw).row()
                except (ParseError, OSError, RecursionError, ValueError, KeyError, TypeError) as error:
                    row["error"] = f"{type(error).__name__}: {error}"
                rows.append(row)
            out = pd.DataFrame(rows, columns=["path", *names, "error"])
            for c in ("page_count", "slide_count"):
                out[c] = out[c].astype("Int32")
            for c in ("created_at", "content_modified_at"):
                out[c] = pd.to_datetime(out[c], utc=True)
            yield out

    columns = [F.col(path).alias("path")] + ([F.col(content).alias("content")] if content else [])
    return files.select(*columns).mapInPandas(run, f"path string, {DOCUMENT_SCHEMA}, error string")


def _split_fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string."""
    fields, depth, held = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(held.strip())
            held = ""
        else:
            held += c
    return fields + [held.strip()]


def exploded_blocks(documents: DataFrame) -> DataFrame:
    """(path, block columns) of all parsed documents."""
    return documents.filter("error is null").select("path", F.explode("blocks").alias("b")).select("path", "b.*")


def catalogue_rows(files: DataFrame) -> DataFrame:
    """Discovered and hashed files as catalogue entries with their stable ids."""
    return files.withColumn("id", file_id(F.col("path_key"))).withColumn("file_name_search", fold(F.col("file_name"))).withColumn("hash_algorithm", F.lit("sha256"))
