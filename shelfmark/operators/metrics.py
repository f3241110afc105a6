"""Retrieval metrics, percentiles and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import HOT_ROWS, largest_group, percentiles


def cutoffs(values: list[int]) -> list[int]:
    """Distinct cutoffs in order; none at all, or one below 1, is an error."""
    if not values or min(values) < 1:
        raise ValueError("cutoffs must be positive")
    return sorted(set(values))


def _exploded(ks: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in cutoffs(ks)])).alias("k")


def single_relevant(ranks: DataFrame, rank: str, ks: list[int]) -> DataFrame:
    """(k, recall, mrr, ndcg) for queries with one relevant file each; a null rank is a miss."""
    r = F.col(rank)
    found = r.isNotNull() & (r <= F.col("k"))
    mean = lambda value: F.avg(F.when(found, value).otherwise(0.0))
    return ranks.select(rank, _exploded(ks)).groupBy("k").agg(mean(F.lit(1.0)).alias("recall"), mean(1.0 / r).alias("mrr"), mean(1.0 / F.log2(r + 1.0)).alias("ndcg"))


def per_query(outcomes: DataFrame, query: str, ranks: str, relevant: str, ks: list[int], keep: list[str] | None = None) -> DataFrame:
    """Hit, MRR, recall, nDCG, MAP and complete of each query and cutoff.

    ``ranks``: array of the ranks of relevant documents, in any order; ``relevant``: how many there are. Ideal gain and the
    denominator of MAP count min(relevant, k).
    """
    rows = outcomes.select(query, *(keep or []), F.col(relevant).alias("wanted"), F.sort_array(F.array_distinct(ranks)).alias("all"), _exploded(ks))
    rows = rows.withColumn("r", F.filter("all", lambda x: x <= F.col("k"))).withColumn("bound", F.least(F.col("wanted"), F.col("k")).cast("int"))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    gain = total(F.transform("r", lambda x: 1.0 / F.log2(x + 1.0)))
    ideal = total(F.transform(F.sequence(F.lit(1), F.col("bound").cast("int")), lambda i: 1.0 / F.log2(i + 1.0)))
    precision = total(F.transform("r", lambda x, i: (i + 1.0) / x))
    n = F.size("r")
    return rows.select(
        query, *(keep or []), "k", F.col("wanted").alias("relevant"),
        F.when(n > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(n > 0, 1.0 / F.try_element_at("r", F.lit(1))).otherwise(0.0).alias("mrr"),
        (n / F.col("wanted")).alias("recall"), (gain / ideal).alias("ndcg"), (precision / F.col("bound")).alias("map"),
        F.when(n == F.col("wanted"), 1.0).otherwise(0.0).alias("complete"),
    )


METRICS = ["hit", "mrr", "recall", "ndcg", "map", "complete"]


def averaged(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of all metrics and the number of queries by ``by`` and cutoff."""
    return scores.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])


def macro(scores: DataFrame, kind: str, official: list[str]) -> DataFrame:
    """Mean over query types of their means: over the official types that occur, else over all types."""
    means = averaged(scores, [kind])
    known = F.col(kind).isin(official)
    count = F.sum(F.when(known, 1).otherwise(0))
    pick = lambda m: F.when(count > 0, F.avg(F.when(known, F.col(m)))).otherwise(F.avg(m)).alias(m)
    return means.groupBy("k").agg(F.when(count > 0, count).otherwise(F.count(F.lit(1))).alias("types"), *[pick(m) for m in METRICS])


def _with_percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float], *aggregates: Column) -> DataFrame:
    """Aggregates by group with exact percentiles beside them, whatever the size of the largest group."""
    if not by or largest_group(rows, by) <= HOT_ROWS:
        plain = [F.percentile(value, share).alias(name) for name, share in shares.items()]
        if by or rows.count() <= HOT_ROWS:
            return rows.groupBy(*by).agg(*aggregates, *plain)
        keyed, keys = rows.withColumn("_all", F.lit(1)), ["_all"]
    else:
        keyed, keys = rows, by
    summed = keyed.groupBy(*keys).agg(*aggregates)
    cut = percentiles(keyed, value, keys, shares)
    cut = cut.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *shares)
    same = [summed[c].eqNullSafe(cut[f"_k{i}"]) for i, c in enumerate(keys)]
    return summed.join(cut, reduce(lambda a, b: a & b, same)).drop("_all", *[f"_k{i}" for i in range(len(keys))])


def latency(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(n, mean, p95, p99) with linear interpolation."""
    known = rows.filter(F.col(value).isNotNull())
    return _with_percentiles(known, value, by or [], {"p95": 0.95, "p99": 0.99}, F.count(value).alias("n"), F.avg(value).alias("mean")).select(*(by or []), "n", "mean", "p95", "p99")


def benchmark_summary(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(low, mean, median, p95, high) of measured runs."""
    out = _with_percentiles(rows, value, by, {"median": 0.5, "p95": 0.95}, F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    return out.select(*by, "low", "mean", "median", "p95", "high")


def stage_profile(events: DataFrame, stage: str, duration: str, items: str, errors: Column, size: str | None = None, cpu: str | None = None) -> DataFrame:
    """Calls, items, times, share of the longest stage total, rate and errors of each stage; bytes and CPU time where they are measured."""
    more = [F.sum(size).alias("bytes")] if size else []
    more += [F.sum(cpu).alias("cpu")] if cpu else []
    stages = _with_percentiles(
        events, duration, [stage], {"median": 0.5, "p95": 0.95}, F.count(F.lit(1)).alias("calls"), F.sum(items).alias("items"), F.sum(duration).alias("total"),
        F.max(duration).alias("longest"), F.sum(F.when(errors, 1).otherwise(0)).alias("errors"), *more,
    )
    whole = stages.agg(F.max("total").alias("whole"))
    shared = stages.crossJoin(F.broadcast(whole)).withColumn("share", F.when(F.col("whole") > 0, F.col("total") / F.col("whole"))).withColumn("rate", F.when(F.col("total") > 0, F.col("items") / F.col("total")))
    return shared.select(stage, "calls", "items", "total", "median", "p95", "longest", "errors", *(["bytes"] if size else []), *(["cpu"] if cpu else []), "share", "rate")


def resource_summary(samples: DataFrame, at: str, value: str, by: list[str]) -> DataFrame:
    """Average, p95 and peak of a sampled value, its change from first to last sample, and the share of samples in which it was active."""
    out = _with_percentiles(
        samples, value, by, {"p95": 0.95}, F.avg(value).alias("average"), F.max(value).alias("peak"),
        (F.max_by(value, at) - F.min_by(value, at)).alias("change"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("active"),
    )
    return out.select(*by, "average", "p95", "peak", "change", "active")
