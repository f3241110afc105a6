"""Vector search: filtered top-k, merging over several query vectors, grouping by parent, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import vectors as V
from shelfmark.operators.filters import Predicate, apply_predicate
from shelfmark.operators.ranking import rank_within
from shelfmark.session import materialise

#: Hits fetched per wanted group, which bounds what grouping can see.
GROUP_OVERFETCH = 5
#: Query vectors that are broadcast at once (8,192 of 512 numbers are 32 MB).
QUERY_BLOCK = 8192
#: Limits where none is given: command line, repository search, metadata search, file search.
DEFAULT_LIMITS = {"cli": 20, "search": 10, "metadata": 100, "files": 50}


def _checked(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return limit


def _better(metric: str, score: Column) -> Column:
    return score.desc() if V.METRICS[metric] else score.asc()


def top_k(rows: DataFrame, vector: str, query: Sequence[float], limit: int, metric: str = "cosine", predicate: Predicate | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """The ``limit`` best rows for one query vector, with ``score``; ties by ``keys``.

    Rows without the vector can't match. The filter runs before the scoring; the vector never crosses an exchange, as only
    the best rows of each task do (TakeOrderedAndProject).
    """
    _checked(limit)
    array = F.array(*[F.lit(float(x)) for x in query])
    fit = apply_predicate(rows, predicate).filter(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    scored = fit.withColumn("score", V.score(metric, F.col(vector), array)).drop(vector)
    return scored.orderBy(_better(metric, F.col("score")), *[F.col(k).asc() for k in keys]).limit(limit)


def multi_vector_top_k(rows: DataFrame, vector: str, queries: Sequence[Sequence[float]], limit: int, predicate: Predicate | None = None, keys: Sequence[str] = ("id",), metric: str = "cosine") -> DataFrame:
    """Best score of a row over several query vectors, then the ``limit`` best rows; the best distance is the smallest.

    Merging the top lists of all query vectors gives the same rows as one pass with the best score per row; the pass
    needs no window and no exchange but the last sort.
    """
    _checked(limit)
    if not len(queries):
        raise ValueError("at least one query vector is needed")
    if len({len(q) for q in queries}) > 1:
        raise ValueError("query vectors must be of one size")
    fit = apply_predicate(rows, predicate).filter(F.col(vector).isNotNull() & (F.size(vector) == len(queries[0])))
    scores = [V.score(metric, F.col(vector), F.array(*[F.lit(float(x)) for x in q])) for q in queries]
    best = scores[0] if len(scores) == 1 else (F.greatest if V.METRICS[metric] else F.least)(*scores)
    return fit.withColumn("score", best).drop(vector).orderBy(_better(metric, F.col("score")), *[F.col(k).asc() for k in keys]).limit(limit)


def batch_top_k(rows: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, limit: int, space: str | None = None, digits: int = 9, metric: str = "cosine", predicate: Predicate | None = None) -> DataFrame:
    """(query_key, key, score, rank): a stated set of queries against all rows, exact; scores equal to ``digits`` decimals go to the smaller key.

    A query key that is repeated asks with several vectors, of which the best score of a row counts. The filter runs before
    the scoring. Up to ``QUERY_BLOCK`` query vectors travel to the rows as matrices inside one Arrow stage, and more of them block by
    block; only the ``limit`` best rows per task and query leave a stage, so the exchange carries ids and scores alone.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    _checked(limit)
    larger = V.METRICS[metric]
    rows = apply_predicate(rows, predicate)
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"), (F.col(space) if space else F.lit("")).alias("s")).filter("v is not null")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks > 1:
        # Blocks of queries one after another, each with a pass over the rows; the vectors of one query may be in several.
        numbered = materialise(asked.withColumn("block", F.pmod(F.xxhash64("q", "v"), F.lit(blocks))), "queries")
        names = {"q": query_key, "v": query_vector} | ({"s": space} if space else {})
        best = None
        for block in range(blocks):
            mine = numbered.filter(F.col("block") == block).select(*[F.col(k).alias(n) for k, n in names.items()])
            part = materialise(batch_top_k(rows, key, vector, mine, query_key, query_vector, limit, space, digits, metric), "query-block") if mine.count() <= 2 * QUERY_BLOCK else None
            if part is None:
                raise RuntimeError("one query asks with more vectors of one value than a block holds")
            best = part if best is None else best.unionByName(part)
        merged = best.groupBy(query_key, key).agg((F.max if larger else F.min)("score").alias("score"))
        return merged.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(_better(metric, F.col("score")), key))).filter(F.col("rank") <= limit)
    spark = rows.sparkSession
    qs = asked.collect()
    by_space: dict[str, tuple[list, np.ndarray, list[int]]] = {}
    for name in {r.s for r in qs}:
        mine = sorted((r for r in qs if r.s == name), key=lambda r: (r.q is not None, r.q))
        matrix = np.array([r.v for r in mine], dtype=np.float64)
        if metric == "cosine":
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        first = [k for k, r in enumerate(mine) if not k or r.q != mine[k - 1].q]
        by_space[name] = ([mine[k].q for k in first], matrix, first)
    sent = spark.sparkContext.broadcast(by_space)
    kinds = [to_arrow_type(queries.schema[query_key].dataType), to_arrow_type(rows.schema[key].dataType)]
    row_kind, query_kind = rows.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    def scan(batches):
        best: dict = {}
        for batch in batches:
            names = batch.column(2).to_pylist()
            for name in set(names) & set(sent.value):
                ids, matrix, first = sent.value[name]
                at = [k for k, n in enumerate(names) if n == name]
                values = np.array(batch.column(1).take(pa.array(at)).to_pylist(), dtype=np.float64)
                if metric == "cosine":
                    values /= np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)
                if metric in ("cosine", "dot"):
                    score = matrix @ values.T
                elif metric == "euclid":
                    score = -np.stack([np.sqrt(((values - q) ** 2).sum(axis=1)) for q in matrix])
                else:
                    score = -np.stack([np.abs(values - q).sum(axis=1) for q in matrix])
                # The larger, the better; the best of several vectors of one query counts.
                score = np.round(np.maximum.reduceat(score, first, axis=0), digits)
                keys = batch.column(0).take(pa.array(at)).to_pylist()
                for i, q in enumerate(ids):
                    near = range(len(keys))
                    if len(keys) > limit:
                        # All rows of the limit-th score or a better one: among equal scores the keys decide.
                        known = np.where(np.isnan(score[i]), -np.inf, score[i])
                        near = np.nonzero(known >= np.partition(known, len(keys) - limit)[len(keys) - limit])[0]
                    held = best.setdefault((name, q), []) + [(-float(score[i, j]), keys[j]) for j in near]
                    best[(name, q)] = sorted(held)[:limit]
        flat = [(q, k, -s if larger else s) for (_, q), held in best.items() for s, k in held]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], kinds[0]), pa.array([f[1] for f in flat], kinds[1]), pa.array([f[2] for f in flat], pa.float64())], names=["q", "k", "score"])

    slim = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(space) if space else F.lit("")).alias("s")).filter("v is not null")
    found = slim.mapInArrow(scan, f"q {query_kind}, k {row_kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(_better(metric, F.col("score")), "k"))).filter(F.col("rank") <= limit)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "rank")


def group_by_parent(hits: DataFrame, parent: str, limit: int, score: str = "score", index: str = "segment_index") -> DataFrame:
    """(parent, best_score, matches): segments of a result list by parent, best first, groups by their best match."""
    _checked(limit)
    match = F.struct((-F.col(score)).alias("order"), F.col(index).alias("index"))
    groups = hits.groupBy(parent).agg(F.max(score).alias("best_score"), F.sort_array(F.collect_list(match)).alias("m"))
    return groups.orderBy(F.col("best_score").desc(), parent).limit(limit).select(parent, "best_score", F.transform("m", lambda x: x["index"]).alias("matches"))


def groups_by_parent(hits: DataFrame, query: str, parent: str, limit: int, score: str = "score", index: str = "segment_index") -> DataFrame:
    """(query, parent, best_score, matches): what ``group_by_parent`` gives, for every query of a table of hits at once."""
    _checked(limit)
    match = F.struct((-F.col(score)).alias("order"), F.col(index).alias("index"))
    best = hits.groupBy(query, parent).agg(F.max(score).alias("best_score"))
    first = best.withColumn("_r", F.row_number().over(W.partitionBy(query).orderBy(F.col("best_score").desc(), parent))).filter(F.col("_r") <= limit)
    # Lists are formed for the groups that come out only.
    kept = hits.join(first.select(query, parent), [query, parent], "left_semi")
    groups = kept.groupBy(query, parent).agg(F.max(score).alias("best_score"), F.sort_array(F.collect_list(match)).alias("m"))
    return groups.select(query, parent, "best_score", F.transform("m", lambda x: x["index"]).alias("matches"))


def best_per_file(results: DataFrame, query: str, file: str, rank: str) -> DataFrame:
    """First result of each file in each list, ranked anew from 1."""
    first = results.groupBy(query, file).agg(F.min(rank).alias("_first"))
    return rank_within(first, [query], [F.col("_first"), F.col(file)], rank).drop("_first")


def relevant_rank(results: DataFrame, relevant: DataFrame, query: str, file: str, rank: str) -> DataFrame:
    """(query, relevant_rank): rank of the one relevant file of each query, null if it wasn't returned."""
    hit = results.join(relevant, [query, file]).groupBy(query).agg(F.min(rank).alias("relevant_rank"))
    return relevant.select(query).distinct().join(hit, query, "left")


def logical_ranks(results: DataFrame, logical: DataFrame, relevant: DataFrame, query: str, file: str, rank: str) -> DataFrame:
    """(query, logical_id, rank): best physical rank of each relevant logical document; variants are credited once, but hold their ranks."""
    named = results.join(logical, file).join(relevant, [query, "logical_id"], "left_semi")
    return named.groupBy(query, "logical_id").agg(F.min(rank).alias(rank))
