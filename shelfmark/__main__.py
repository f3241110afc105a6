"""Command line: index a folder, or search a library. Exit 0 done, 1 done in part, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from shelfmark.functions.embedding import ByteImageModel, SpectrumAudioModel
from shelfmark.plans.fields import FIELDS
from shelfmark.plans.handlers import AudioQuery, ImageQuery
from shelfmark.plans.requests import FLAG_FIELDS, structured_request

#: The library's folder where ``--library`` is left out.
LIBRARY = "SHELFMARK_LIBRARY"
NUMBERS = {"sample-rate": int, "bitrate": int, "longer-than": float, "shorter-than": float}


def default_vectorizers() -> dict:
    """What reads a query file with the default models; documents have none."""
    return {"image": ImageQuery(ByteImageModel()), "audio": AudioQuery(SpectrumAudioModel())}


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="shelfmark")
    parser.add_argument("text", nargs="?", help="what to search for")
    parser.add_argument("--library", default=os.environ.get(LIBRARY, "shelfmark-library"), help=f"folder of the tables (else of {LIBRARY})")
    parser.add_argument("--index", metavar="DIR", help="index a folder instead of searching")
    parser.add_argument("--types", help="with --index: image, audio and text, or some of them with commas between")
    parser.add_argument("--yes", action="store_true", help="with --index: don't ask before each queue")
    parser.add_argument("--no-recursive", action="store_true")
    parser.add_argument("--duplicates", action="store_true", help="list files of equal content")
    parser.add_argument("--query-file")
    parser.add_argument("--target", choices=("image", "audio", "text"))
    parser.add_argument("--limit", type=int, default=20)
    parser.add_argument("--grouped", action="store_true")
    for name, key in FLAG_FIELDS.items():
        parser.add_argument(f"--{key}", dest=name, type=NUMBERS.get(key, str), help=f"{FIELDS[key].modality or 'any'} files")
    given = parser.parse_args(argv)
    fields = {n: getattr(given, n) for n in FLAG_FIELDS}
    wrong = [
        (sum(map(bool, (given.index, given.duplicates, given.text or given.query_file))) != 1, "give one of a query, --index and --duplicates"),
        (given.limit < 1, "--limit must be at least 1"),
        (bool(given.index or given.duplicates) and any(v is not None for v in (*fields.values(), given.target)), "filters and a target belong to a search"),
        (not given.index and (given.types or given.yes or given.no_recursive), "--types, --yes and --no-recursive belong to --index"),
    ]
    for bad, message in wrong:
        if bad:
            parser.error(message)
    given.types = [t.strip() for t in given.types.split(",")] if given.types else None
    given.request = None
    if given.text or given.query_file:
        try:
            given.request = structured_request(given.text, Path(given.query_file) if given.query_file else None, given.target, default_vectorizers(), **fields)
        except ValueError as error:
            parser.error(str(error))
    return given


def _index(library, given: argparse.Namespace) -> int:
    """Report what was found, ask where a person is there to answer, and work on the queues."""
    from pyspark.sql import functions as F

    from shelfmark.functions import text as X

    counts = library.counters(library.plan(given.index, not given.no_recursive, given.types))
    columns = [F.col(c) for c in ("file_type", "total", "new_files", "updated_files", "unchanged_files", "failed_files")]
    queues = counts.select("file_type", "work", X.discovery_text(*columns).alias("line"), X.confirmation_text(*[F.col(c) for c in ("file_type", "new_files", "updated_files")]).alias("question")).orderBy("file_type").collect()
    print("\n".join(["Discovery complete", *(q.line for q in queues)]) if queues else "No supported files were found")
    wanted = [q.file_type for q in queues if q.work and (given.yes or not sys.stdin.isatty() or input(f"{q.question} [Y/n] ").strip().casefold() in ("", "y", "yes"))]
    unreadable = [q for q in queues if "unreadable" in q.line]
    if not wanted and not unreadable:
        return 0
    report = library.index(given.index, not given.no_recursive, sorted({*wanted, *(q.file_type for q in unreadable)})).persist()
    report.groupBy("file_type").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("added", (F.col("change") == "new") & F.col("error").isNull()), ("updated", (F.col("change") == "updated") & F.col("error").isNull()), ("failed", F.col("error").isNotNull()))]).show()
    failed = report.filter("error is not null")
    if failed.isEmpty():
        return 0
    failed.select("path", "error").show(truncate=False)
    return 1


def _shown(found, grouped: bool):
    """Results as people read them."""
    from pyspark.sql import functions as F

    from shelfmark.functions import text as X

    if grouped or "score" not in found.columns:
        return found
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    if "segment_index" not in found.columns:
        return found.select(X.score_text(F.col("score")).alias("score"), name, "path")
    where = F.when(F.col("start_seconds").isNotNull(), X.time_range_text(F.col("segment_index"), F.col("start_seconds"), F.col("end_seconds")))
    where = F.coalesce(where, F.concat_ws(" · ", F.concat(F.lit("#"), (F.col("segment_index") + 1).cast("string")), F.concat(F.lit("page "), F.col("page_number").cast("string")), F.concat(F.lit("slide "), F.col("slide_number").cast("string")), "heading"))
    return found.select(X.score_text(F.col("score")).alias("score"), name, where.alias("where"), X.preview(F.col("chunk_text")).alias("preview"), "path")


def main(argv: list[str] | None = None) -> int:
    try:
        given = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    from shelfmark.plans.service import Library
    from shelfmark.session import build_session

    try:
        library = Library(build_session(), given.library if "://" in given.library else Path(given.library).resolve().as_uri())
        if given.index:
            return _index(library, given)
        found = library.duplicates() if given.duplicates else library.search(given.request, given.limit, grouped=given.grouped)
        _shown(found, given.grouped).show(given.limit, truncate=80)
        return 0
    except (NotADirectoryError, ValueError) as error:
        print(error, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
