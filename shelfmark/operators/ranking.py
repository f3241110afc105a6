"""Positions and percentiles within groups, of which one may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import materialise

#: Rows of a group that one task ranks or holds; larger groups are spread over tasks.
HOT_ROWS = 1_000_000


def largest_group(rows: DataFrame, by: list[str]) -> int:
    """Rows of the largest group, from pre-aggregated counts."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def rank_within(rows: DataFrame, by: list[str], order: list[Column], name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows with their position from 1 (INT) in their group; ``order`` must tell any two rows of a group apart.

    With a group above ``hot_rows`` the rows are cut into ranges of (group, order) over all tasks; a row's position is then that in
    its range plus the sizes of the ranges of its group before it. Nulls in ``by`` form a group.
    """
    if largest_group(rows, by) <= hot_rows:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The number of the range is written, as a task that is run again may be another partition's.
    placed = materialise(rows.repartitionByRange(ranges, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # At most one row a group and range.
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(sizes[f"_g{k}"]) for k, c in enumerate(by)], placed["_range"] == sizes["_r"])
    local = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order))
    ranked = placed.join(sizes, same).withColumn(name, (local + F.col("_before")).cast("int"))
    return ranked.select(*rows.columns, name)


def percentiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by…, one column a share): linearly interpolated percentiles, exact; nulls don't count and an all-null group has null.

    Without hot groups one aggregate holds the distinct values of a group; with one, values are ranked over all tasks and the two
    neighbours of each position are picked.
    """
    if largest_group(rows, by) <= hot_rows:
        return rows.groupBy(*by).agg(*[F.percentile(value, share).alias(name) for name, share in shares.items()])
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    # Equal values are one row with a count, so that positions need no order among them.
    counted = known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = materialise(counted.repartitionByRange(ranges, *[F.col(c) for c in by], F.col("_v")).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))
    all_before = F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    total = F.sum("_n").over(W.partitionBy(*by))
    sizes = sizes.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.col("_range").alias("_r"), F.coalesce(all_before, F.lit(0)).alias("_before"), total.alias("_total"))
    same = reduce(lambda a, b: a & b, [placed[c].eqNullSafe(sizes[f"_g{k}"]) for k, c in enumerate(by)], placed["_range"] == sizes["_r"])
    local = F.sum("_c").over(W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    # A value holds the positions first…last, counted from 0.
    held = placed.join(sizes, same).withColumn("_last", local + F.col("_before") - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    picks = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        weight = at - low
        on = lambda p: (F.col("_first") <= p) & (F.col("_last") >= p)
        picks.append((F.max(F.when(on(low), F.col("_v"))) * (1 - F.max(weight)) + F.max(F.when(on(high), F.col("_v"))) * F.max(weight)).alias(name))
    found = held.groupBy(*by).agg(*picks)
    groups = rows.select(*by).distinct()
    keyed = found.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], *shares)
    return groups.join(keyed, reduce(lambda a, b: a & b, [groups[c].eqNullSafe(keyed[f"_g{k}"]) for k, c in enumerate(by)]), "left").select(*by, *shares)
