"""Command line of the evaluation: annotations of a target against a library. Exit 0 done, 2 usage, 130 interrupted."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from shelfmark.operators.metrics import cutoffs

LIBRARY = "SHELFMARK_LIBRARY"
OFFICIAL = ("Factual", "Comparative", "Multi-Hop")


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="shelfmark.evaluate")
    parser.add_argument("annotations", type=Path, help="captions as JSON (image) or CSV (audio), questions as CSV (text)")
    parser.add_argument("--target", required=True, choices=("image", "audio", "text"))
    parser.add_argument("--library", default=os.environ.get(LIBRARY, "shelfmark-library"))
    parser.add_argument("--k", type=int, nargs="+", default=[1, 5, 10])
    parser.add_argument("--latency-samples", type=int, default=0, help="queries measured one by one after the metrics")
    parser.add_argument("--latency-warmup", type=int, default=10)
    parser.add_argument("--seed", type=int, default=17)
    parser.add_argument("--official", nargs="*", default=list(OFFICIAL), help="query types that count for the mean over types")
    parser.add_argument("--output", help="JSON file for the results, which must not exist")
    given = parser.parse_args(argv)
    try:
        given.k = cutoffs(given.k)
    except ValueError as error:
        parser.error(str(error))
    for wrong, message in (
        (not given.annotations.expanduser().is_file(), f"there is no file {given.annotations}"),
        (given.latency_samples < 0 or given.latency_warmup < 0, "numbers of samples can't be negative"),
        ("://" not in given.library and not Path(given.library).is_dir(), f"there is no library {given.library}"),
    ):
        if wrong:
            parser.error(message)
    return given


def evaluate(library, given: argparse.Namespace) -> dict:
    """Results of a run as one object."""
    from pyspark.sql import functions as F

    from shelfmark.functions import identity as I
    from shelfmark.functions.embedding import embed
    from shelfmark.operators import catalog as C
    from shelfmark.operators.store import PREFIX
    from shelfmark.plans import evaluation as E
    from shelfmark.plans.requests import Request
    from shelfmark.plans.service import FILES, SEGMENTS, VECTORS
    from shelfmark.session import materialise
    from shelfmark.sources.annotations import annotations

    spark, model = library.spark, library.models[given.target]
    files = library.store.read(FILES).filter(F.col("file_type") == given.target)
    segments = library.handlers[given.target].scope == "segment"
    rows = library.store.read(SEGMENTS if segments else FILES).filter(F.col("file_type") == given.target)
    rows = rows.select(F.col("parent_id" if segments else "id").alias("file_id"), F.col(PREFIX + VECTORS[given.target]).alias("vector"), F.col("format_key").alias("fmt"))
    path = str(given.annotations.expanduser().resolve())
    facts = {"annotations": path, "target": given.target, "cutoffs": given.k}
    if given.target == "text":
        asked = annotations(spark, "text", path, given.official)
        wanted = asked.select("query_id", F.explode("files").alias("file")).select("query_id", I.file_key(F.col("file")).alias("key")).distinct()
        variants = files.select(F.col("id").alias("file_id"), I.file_key(F.col("file_name")).alias("key"), I.logical_document_id(F.col("path")).alias("logical_id"), F.col("format_key").alias("fmt"))
        covered = C.variant_coverage(wanted, variants.select("key", "logical_id", "fmt"), "query_id", "key", list(I.FORMAT_ORDER))
        queries = materialise(asked.join(covered.filter("state = 'fully'").select("query_id"), "query_id", "left_semi").select("query_id", "query_type", "query", embed(F.col("query"), model).alias("vector")), "evaluation-queries")
        relevant = wanted.join(variants.select("key", "logical_id").distinct(), "key").select("query_id", "logical_id").distinct()
        views = {"mixed": None, **{f: f for f in I.FORMAT_ORDER}}
        outcomes = E.document_outcomes(rows, queries, relevant, variants.select("file_id", "logical_id"), given.k, views)
        tables = E.evaluation_tables(outcomes, given.k, given.official)
        facts["coverage"] = E.coverage_counts(covered, "state")
    else:
        asked = annotations(spark, given.target, path).select(I.file_name_key(F.col("file_name")).alias("key"), F.col("caption").alias("query"))
        covered = C.annotation_coverage(asked, files.select("id", I.file_name_key(F.col("file_name")).alias("key")), "key")
        fit = covered.filter("coverage = 'eligible'").withColumn("query_id", F.sha2(F.concat_ws("\u0000", "key", "query"), 256)).dropDuplicates(["query_id"])
        queries = materialise(fit.select("query_id", "query", "file_id", embed(F.col("query"), model).alias("vector")), "evaluation-queries")
        tables = {"metrics": E.evaluate_single(rows, queries, queries.select("query_id", "file_id"), given.k, given.target)}
        facts["coverage"] = E.coverage_counts(covered)
    facts["evaluated_queries"] = queries.count()
    if given.latency_samples and facts["evaluated_queries"]:
        # As many texts as are measured come to the driver, drawn alike in every run.
        texts = [r[0] for r in queries.select("query").orderBy(F.xxhash64("query", F.lit(given.seed)), "query").limit(given.latency_samples).collect()]
        facts["query_latency_ms"] = E.measure_latency(spark, lambda text: library.search(Request(given.target, text=text), max(given.k)).collect(), texts, given.latency_warmup).first().asDict()
    return E.run_summary(tables, **facts)


def main(argv: list[str] | None = None) -> int:
    try:
        given = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as stop:
        return int(stop.code or 0)
    import json

    from shelfmark.plans.evaluation import write_summary
    from shelfmark.plans.service import Library
    from shelfmark.session import build_session

    try:
        spark = build_session()
        library = Library(spark, given.library if "://" in given.library else Path(given.library).resolve().as_uri())
        summary = evaluate(library, given)
        if given.output:
            write_summary(spark, given.output if "://" in given.output else Path(given.output).resolve().as_uri(), summary)
        print(json.dumps(summary, indent=1, default=str, ensure_ascii=False))
        return 0
    except (ValueError, FileExistsError) as error:
        print(error, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
