"""Retrieval evaluation: a set of queries against a table of vectors, one job for all views, metrics as tables."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import metrics as M
from shelfmark.operators.search import batch_top_k, best_per_file, logical_ranks, relevant_rank
from shelfmark.session import materialise, publish_file


def candidates(target: str, cutoffs: Sequence[int]) -> int:
    """Hits to fetch so that the largest cutoff can be judged after hits of one file are folded."""
    most = max(M.cutoffs(list(cutoffs)))
    return {"image": most, "audio": max(100, 10 * most), "text": max(200, 20 * most)}[target]


def evaluate_single(rows: DataFrame, queries: DataFrame, relevant: DataFrame, cutoffs: list[int], target: str = "image", file: str = "file_id", vector: str = "vector") -> DataFrame:
    """(k, recall, mrr, ndcg) of queries (query_id, vector) with one relevant file each (query_id, file)."""
    hits = batch_top_k(rows, file, vector, queries, "query_id", vector, candidates(target, cutoffs))
    ranked = best_per_file(hits.select("query_id", file, "rank"), "query_id", file, "rank")
    return M.single_relevant(relevant_rank(ranked, relevant, "query_id", file, "rank"), "relevant_rank", cutoffs)


def document_outcomes(rows: DataFrame, queries: DataFrame, relevant: DataFrame, logical: DataFrame, cutoffs: list[int], views: dict[str, str | None], file: str = "file_id", vector: str = "vector", fmt: str = "fmt") -> DataFrame:
    """(view, query_id, query_type, relevant, ranks, returned): what each view gave for each query that has a relevant document in it.

    ``queries``: query_id, query_type, vector; embedded once and used by all views. ``relevant``: query_id, logical_id. ``logical``: file, logical_id.
    """
    queries = materialise(queries.select("query_id", "query_type", vector), "evaluation-queries")
    parts = []
    for view, only in sorted(views.items()):
        mine = rows if only is None else rows.filter(F.col(fmt) == only)
        known = logical.join(mine.select(file).distinct(), file, "left_semi")
        wanted = relevant.join(known.select("logical_id").distinct(), "logical_id", "left_semi")
        hits = batch_top_k(mine, file, vector, queries, "query_id", vector, candidates("text", cutoffs))
        ranked = materialise(best_per_file(hits.select("query_id", file, "rank"), "query_id", file, "rank"), "evaluation-ranks")
        ranks = logical_ranks(ranked, known, wanted, "query_id", file, "rank").groupBy("query_id").agg(F.collect_list("rank").alias("ranks"))
        counts = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
        returned = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("returned"))
        outcomes = counts.join(ranks, "query_id", "left").join(returned, "query_id", "left").join(queries.select("query_id", "query_type"), "query_id")
        parts.append(outcomes.select(F.lit(view).alias("view"), "query_id", "query_type", "relevant", F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"), F.coalesce("returned", F.lit(0)).alias("returned")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialise(out, "outcomes")


def evaluate_documents(rows: DataFrame, queries: DataFrame, relevant: DataFrame, logical: DataFrame, cutoffs: list[int], views: dict[str, str | None], file: str = "file_id", vector: str = "vector", fmt: str = "fmt") -> DataFrame:
    """Metrics by (view, query_type, k). A view is a format, or null for all formats.

    In a view only documents that have a file of its format are relevant, and queries without one are left out.
    """
    outcomes = document_outcomes(rows, queries, relevant, logical, cutoffs, views, file, vector, fmt)
    return M.averaged(M.per_query(outcomes, "query_id", "ranks", "relevant", cutoffs, ["view", "query_type"]), ["view", "query_type"])


def view_summaries(outcomes: DataFrame, cutoffs: list[int]) -> DataFrame:
    """(view, queries, multi_document, underfilled): queries, those with several relevant documents, and those with fewer results than the largest cutoff."""
    most = max(M.cutoffs(cutoffs))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return outcomes.groupBy("view").agg(F.count(F.lit(1)).alias("queries"), count(F.col("relevant") > 1).alias("multi_document"), count(F.col("returned") < most).alias("underfilled"))


def evaluation_tables(outcomes: DataFrame, cutoffs: list[int], official: Sequence[str]) -> dict[str, DataFrame]:
    """Metrics of each view over all queries, by query type, as the mean over types, and over queries with several relevant documents."""
    scores = materialise(M.per_query(outcomes, "query_id", "ranks", "relevant", cutoffs, ["view", "query_type"]), "scores")
    means = M.averaged(scores, ["view", "query_type"])
    known = F.col("query_type").isin(list(official))
    picked = lambda m: F.coalesce(F.avg(F.when(known, F.col(m))), F.avg(m)).alias(m)
    return {
        "all": M.averaged(scores, ["view"]),
        "by_type": means,
        "macro": means.groupBy("view", "k").agg(*[picked(m) for m in M.METRICS]),
        "multi_document": M.averaged(scores.filter(F.col("relevant") > 1), ["view"]),
        "views": view_summaries(outcomes, cutoffs),
    }


def run_summary(tables: dict[str, DataFrame], **facts) -> dict:
    """A run as one JSON object: its facts, and its tables of metrics, which have few rows (views, types and cutoffs)."""
    return facts | {name: [r.asDict(True) for r in table.orderBy(*[c for c in ("view", "query_type", "k") if c in table.columns]).collect()] for name, table in tables.items()}


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """Write a summary as a JSON file of its own; one that exists is an error."""
    if not publish_file(spark, path, json.dumps(summary, indent=1, default=str, ensure_ascii=False)):
        raise FileExistsError(path)


def coverage_counts(covered: DataFrame, state: str = "coverage") -> dict[str, int]:
    """How many annotations are of each state."""
    return {r[0]: r[1] for r in covered.groupBy(state).count().collect()}


def sample_in_order(items: Sequence, count: int, seed: int) -> list:
    """A deterministic sample without replacement, in the original order."""
    if count >= len(items):
        return list(items)
    return [items[k] for k in sorted(random.Random(seed).sample(range(len(items)), count))]


def measure_latency(spark: SparkSession, run: Callable[[object], object], queries: Sequence, warm_up: int = 10) -> DataFrame:
    """(n, mean, p95, p99) in milliseconds of running each query once, after some that don't count."""
    for query in list(queries)[:warm_up]:
        run(query)
    times = []
    for query in queries:
        began = time.perf_counter()
        run(query)
        times.append(((time.perf_counter() - began) * 1000,))
    return M.latency(spark.createDataFrame(times, "ms double"), "ms")
