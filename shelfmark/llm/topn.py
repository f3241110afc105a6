"""The N best items of every group, with hot groups split.

An exact count per group separates heavy groups from light ones. Light groups go through an
ordinary window: one exchange on the group. Rows of heavy groups are cut into ranges of their
score (edges from a quantile sketch of the whole group); ranges above which N items lie already are left behind, and the
others are salted by the item, so that no task holds a whole heavy group, nor all rows of one score. Each slice keeps its own N
best; N rows a slice then meet in a last window. A row among the N best of its group is among
the N best of every slice it is in, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import materialise

#: Heavy groups up to this many are broadcast (about 600 bytes each); beyond it they are joined by shuffle.
BROADCAST_GROUPS = 20_000
#: Score ranges a heavy group is cut into.
RANGES = 64


def top_n_per_group(
    rows: DataFrame,
    group: str,
    score: str,
    item: list[str],
    row_id: str,
    n: int = 5,
    heavy_rows: int = 10_000,
    slice_rows: int = 5_000,
) -> DataFrame:
    """The ``n`` rows of highest ``score`` in every ``group``; columns group, item…, score, row_id.

    * Only rows with a finite score and a non-null first item column count.
    * Of rows with the same group and item (nulls equal) the highest score counts, then the smallest row_id.
    * Ties go to the smaller item columns in their order, nulls first, then to the smaller row_id.
    * A null group is a group of its own, as in GROUP BY. Repeated rows count once. Empty input gives no rows.
    * ``heavy_rows``: groups above this many rows are cut into slices of about ``slice_rows`` rows.

    Extra columns of any name are ignored: only the named ones are read.
    """
    value = F.col(score).cast("double")
    # (value - value) is 0 for finite numbers only; NaN = NaN holds in Spark, so NaN is excluded by name.
    finite = F.col(score).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    base = rows.filter(finite & F.col(item[0]).isNotNull()).select(
        F.col(group).alias("_g"), *[F.col(c).alias(f"_i{k}") for k, c in enumerate(item)], value.alias("_s"), F.col(row_id).alias("_r")
    )
    items = [f"_i{k}" for k in range(len(item))]
    counted = base.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy_rows)
    heavy = materialise(counted.select(F.col("_g").alias("_hg"), "_n"), "heavy-groups")
    found = heavy.count()
    if found == 0:
        return _named(_top(base, ["_g"], items, n), group, item, items, score, row_id)
    # Few heavy groups travel to every task; more than that many are joined by shuffle.
    near = F.broadcast if found <= BROADCAST_GROUPS else (lambda df: df)
    light_top = _top(base.join(near(heavy), base["_g"].eqNullSafe(heavy["_hg"]), "left_anti"), ["_g"], items, n)

    # One row an item first, pre-aggregated in every task: an item repeated without bound is then one row too.
    hot = base.join(near(heavy), base["_g"].eqNullSafe(heavy["_hg"]), "inner").drop("_hg")
    hot = hot.groupBy("_g", "_n", *items).agg(F.min(F.struct((-F.col("_s")).alias("a"), F.col("_r").alias("r"))).alias("_b"))
    hot = materialise(hot.select("_g", "_n", *items, (-F.col("_b.a")).alias("_s"), F.col("_b.r").alias("_r")), "heavy-items")
    edges = hot.groupBy("_g", "_n").agg(F.percentile_approx("_s", [k / RANGES for k in range(1, RANGES)], 1000).alias("_edges"))
    edges = materialise(edges.select(F.col("_g").alias("_hg"), F.col("_n").alias("_m"), "_edges"), "heavy-edges")
    hot = hot.drop("_n").join(near(edges), hot["_g"].eqNullSafe(edges["_hg"]), "inner")
    reach = F.size(F.filter("_edges", lambda e: e <= F.col("_s")))
    hot = hot.select("_g", "_m", *items, "_s", "_r", reach.alias("_range"))
    # A range below which n items or more lie higher holds none of the n best: it goes no further.
    sizes = hot.groupBy("_g", "_range").agg(F.count(F.lit(1)).alias("_c"))
    higher = F.coalesce(F.sum("_c").over(W.partitionBy("_g").orderBy(F.col("_range").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lowest = sizes.withColumn("_higher", higher).filter(F.col("_higher") < n).groupBy("_g").agg(F.min("_range").alias("_lowest"))
    lowest = materialise(lowest.withColumnRenamed("_g", "_lg"), "lowest-ranges")
    hot = hot.join(near(lowest), hot["_g"].eqNullSafe(lowest["_lg"]), "inner").filter(F.col("_range") >= F.col("_lowest"))
    salt = F.pmod(F.xxhash64(*items), F.ceil(F.col("_m") / F.lit(RANGES * slice_rows)))
    hot = hot.select("_g", *items, "_s", "_r", "_range", salt.alias("_salt"))
    hot_top = _top(_top(hot, ["_g", "_range", "_salt"], items, n).drop("_range", "_salt"), ["_g"], items, n)
    return _named(light_top.unionByName(hot_top), group, item, items, score, row_id)


def _named(top: DataFrame, group: str, item: list[str], items: list[str], score: str, row_id: str) -> DataFrame:
    return top.select(F.col("_g").alias(group), *[F.col(c).alias(o) for c, o in zip(items, item)], F.col("_s").alias(score), F.col("_r").alias(row_id))


def _top(rows: DataFrame, keys: list[str], items: list[str], n: int) -> DataFrame:
    """Best row of each item, then the n best items, within ``keys``; one exchange, on the keys."""
    if len(keys) == 1:
        # Both windows can then use the partitioning by group: no second exchange.
        rows = rows.repartition(*keys)
    best = W.partitionBy(*keys, *items).orderBy(F.col("_s").desc(), F.col("_r").asc())
    order: list[Column] = [F.col("_s").desc(), *[F.col(c).asc_nulls_first() for c in items], F.col("_r").asc()]
    once = rows.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")
    return once.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_k") <= n).drop("_k")
