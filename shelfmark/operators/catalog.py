"""Relational work of the catalogue: change classes, counters, duplicates, lookups, cascades, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import rank_within


def classify_changes(discovered: DataFrame, existing: DataFrame, key: str = "path_key", content: str = "content_hash") -> DataFrame:
    """Discovered rows with ``change``: new, updated, unchanged, or failed where no hash could be read. Left outer join on the key."""
    known = existing.select(F.col(key), F.col(content).alias("_known"), F.lit(True).alias("_there"))
    joined = discovered.join(known, key, "left")
    change = F.when(F.col(content).isNull(), "failed").when(F.col("_there").isNull(), "new").when(F.col("_known").eqNullSafe(F.col(content)), "unchanged").otherwise("updated")
    return joined.withColumn("change", change).drop("_known", "_there")


def change_counters(classified: DataFrame, by: str = "file_type", failures: bool = False) -> DataFrame:
    """(by, total, new, updated, unchanged, work) of each queue; with ``failures`` also the files that couldn't be read."""
    count = lambda kind: F.sum(F.when(F.col("change") == kind, 1).otherwise(0))
    counted = classified.groupBy(by).agg(F.count(F.lit(1)).alias("total"), count("new").alias("new_files"), count("updated").alias("updated_files"), count("unchanged").alias("unchanged_files"), *([count("failed").alias("failed_files")] if failures else []))
    return counted.withColumn("work", F.col("new_files") + F.col("updated_files"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row of each key; the columns of ``order`` decide, larger first, nulls last. Partial maxima keep a hot key to one row a task."""
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def duplicate_groups(files: DataFrame, content: str = "content_hash", member: str = "path_key", most: int | None = None) -> DataFrame:
    """(content_hash, copies, members): contents that more than one file holds, members sorted.

    All members are listed; with ``most`` a larger group keeps its exact count and its ``most`` first members.
    ``duplicate_members`` lists the members of every group in rows, for groups that one row can't hold.
    """
    ranked = duplicate_members(files, content, member)
    shown = F.col(member) if most is None else F.when(F.col("position") <= most, F.col(member))
    return ranked.groupBy(content).agg(F.max("copies").alias("copies"), F.sort_array(F.collect_list(shown)).alias("members"))


def duplicate_members(files: DataFrame, content: str = "content_hash", member: str = "path_key") -> DataFrame:
    """(content_hash, member, copies, position) of every file whose content another one holds."""
    slim = files.filter(F.col(content).isNotNull()).select(content, member).distinct()
    many = slim.groupBy(content).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return rank_within(slim.join(many, content), [content], [F.col(member)], "position")


def lookup(files: DataFrame, wanted: DataFrame, key: str = "id", order: str = "position") -> DataFrame:
    """Rows of wanted keys in the order wanted; a missing key keeps a row of nulls."""
    return wanted.join(files, key, "left").orderBy(order)


def cascade_delete(parents: DataFrame, children: DataFrame, doomed: DataFrame, key: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """Parents and children without the doomed parents."""
    gone = doomed.select(F.col(key).alias("_k")).distinct()
    return parents.join(gone, parents[key] == gone["_k"], "left_anti"), children.join(gone, children[parent] == gone["_k"], "left_anti")


def replace_rows(target: DataFrame, source: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Whole-row upsert: rows of ``source`` replace those of the same key; of repeated keys in a batch the last by ``order`` wins."""
    new = latest(source, key, [order]) if order else source.dropDuplicates([key])
    kept = target.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*target.columns), allowMissingColumns=False)


def replace_children(children: DataFrame, new: DataFrame, parent: str = "parent_id") -> DataFrame:
    """All children of the parents in ``new`` are replaced by the new ones."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*children.columns))


def annotation_coverage(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Wanted rows with ``coverage``: missing, ambiguous, or eligible with the one ``file_id`` of that key."""
    counted = files.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id"))
    joined = wanted.join(counted, key, "left")
    coverage = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("eligible")
    return joined.withColumn("coverage", coverage).withColumn("file_id", F.when(F.col("_n") == 1, F.col("_id"))).drop("_n", "_id")


def variant_coverage(wanted: DataFrame, variants: DataFrame, query: str, key: str, formats: list[str]) -> DataFrame:
    """Per query: (relevant, covered, missing_formats, state fully|partially|skipped).

    ``wanted`` has (query, key) rows of relevant documents, ``variants`` (key, logical_id, fmt) of the files there are. A document is
    covered if its key leads to one logical document with at most one file of each format.
    """
    per_format = variants.groupBy(key, "fmt").agg(F.count(F.lit(1)).alias("n"), F.min("logical_id").alias("low"), F.max("logical_id").alias("high"))
    per_key = per_format.groupBy(key).agg(F.max("n").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("fmt").alias("fmts"))
    joined = wanted.join(per_key, key, "left")
    good = F.col("most").isNotNull() & (F.col("most") == 1) & (F.col("low") == F.col("high"))
    lacking = F.when(good, F.size(F.array_except(F.array(*[F.lit(f) for f in formats]), F.col("fmts")))).otherwise(0)
    out = joined.groupBy(query).agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(good, 1).otherwise(0)).alias("covered"), F.sum(lacking).alias("missing_formats"))
    state = F.when(F.col("covered") == 0, "skipped").when(F.col("covered") == F.col("relevant"), "fully").otherwise("partially")
    return out.withColumn("state", state)


def audio_ranges(files: DataFrame, duration: str, window: float, hop: float | None = None) -> DataFrame:
    """Half-open windows (segment_index, start_seconds, end_seconds) over each duration; the last one is clipped at the end."""
    hop = window / 2 if hop is None else hop
    if window <= 0 or hop <= 0 or hop > window:
        raise ValueError("window and hop must be positive, and hop not above window")
    d = F.col(duration).cast("double")
    last = F.greatest(F.lit(0), F.ceil((d - window) / hop)).cast("int")
    usable = files.filter(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")))
    spread = usable.withColumn("segment_index", F.explode(F.sequence(F.lit(0), last)))
    return spread.withColumn("start_seconds", F.col("segment_index") * F.lit(float(hop))).withColumn("end_seconds", F.least(F.col("segment_index") * F.lit(float(hop)) + F.lit(float(window)), d))


def whole_files(files: DataFrame, duration: str) -> DataFrame:
    """One range (segment_index, start_seconds, end_seconds) over the whole of each file that has a duration."""
    d = F.col(duration).cast("double")
    usable = files.filter(d.isNotNull() & ~F.isnan(d) & (d > 0) & (d < float("inf")))
    return usable.select("*", F.lit(0).alias("segment_index"), F.lit(0.0).alias("start_seconds"), d.alias("end_seconds"))


def checked_segments(segments: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Segments, or an error where one is wrong: a parent without an id, an index that is negative or occurs twice in a file, half a
    time range, or one that is empty or begins before 0."""
    start, end = F.col("start_seconds"), F.col("end_seconds")
    fault = (
        F.when(F.coalesce(F.trim(parent), F.lit("")) == "", "a segment needs the id of its file")
        .when(F.col("segment_index").isNull() | (F.col("segment_index") < 0), "a segment index must be 0 or more")
        .when(start.isNull() != end.isNull(), "a segment needs both ends of its time range or none")
        .when((start < 0) | (end <= start), "a segment's time range must be positive")
    )
    # Counted beside the rows, so that a file of very many segments is no single task.
    twice = segments.groupBy(parent, "segment_index").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(parent).alias("_p"), F.col("segment_index").alias("_i"))
    marked = segments.join(twice, (F.col(parent) == F.col("_p")) & (F.col("segment_index") == F.col("_i")), "left")
    fault = F.coalesce(fault, F.when(F.col("_p").isNotNull(), "a segment index occurs twice in a file"))
    return marked.withColumn(parent, F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col(parent))).drop("_p", "_i")


def is_timed(start: str = "start_seconds", end: str = "end_seconds") -> Column:
    """Whether a segment has a time range."""
    return F.col(start).isNotNull() & F.col(end).isNotNull()


def matched_counts(groups: DataFrame, matches: str = "matches") -> DataFrame:
    """(files, matches): how many result groups there are, and how many matches they hold."""
    return groups.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(F.size(matches)), F.lit(0)).alias("matches"))


def plan_totals(counters: DataFrame) -> DataFrame:
    """(total, new_files, updated_files, unchanged_files, work) over all queues of a plan."""
    names = ("total", "new_files", "updated_files", "unchanged_files", "work")
    return counters.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def by_hash(files: DataFrame, content: str, limit: int = 100, column: str = "content_hash") -> DataFrame:
    """Files of one content in id order; the limit is the page."""
    return files.filter(F.col(column) == content).orderBy("id").limit(limit)
