"""Processing only what was added or changed since the last successful run.

Rows are taken by a *commit sequence*, never by event time: sightings by ``arrived_at``
(the moment the row became visible), index entries by the ``finished_at`` of the run that
wrote them (an entry counts from the moment its run succeeded). Every increment

1. reads the last committed watermark,
2. fixes its upper limits before it reads any data,
3. reduces the rows between watermark and limit to one row per file, a *delta*,
4. writes the delta to a folder of its own, and
5. publishes the folder and the watermark in one commit file, which appears in one step or not at all.

The state is the newest base with the deltas after it; an increment reads and writes no more than what changed. When
``COMPACT_AFTER`` deltas have gathered, an increment merges them and the base into a new base.

A run that dies before step 5 leaves nothing behind that a later run reads: it starts at the
same watermark again. Of two runs that publish the same commit number one wins, and the other fails.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import publish_file

STATE_SCHEMA = (
    "id string, sighting_at timestamp, sighting_key bigint, sighting_hash string, "
    "entry_at timestamp, entry_key int, entry_hash string"
)
#: Deltas after which an increment writes a new base.
COMPACT_AFTER = 16
#: Up to this many newly finished runs their ids are pushed down to the scan of the entries; more are joined.
PUSHED_RUNS = 1000


def bare_hash(value: Column) -> Column:
    """A digest as bare lower-case hex: an algorithm prefix (``sha256:``) and letter case are dropped; blank is null."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z0-9_-]+[:=]\s*", "")
    return F.when(bare != "", bare)


@dataclass(frozen=True)
class Commit:
    """One published increment; ``*_mark`` are microseconds since 1970 UTC or null for 'nothing read yet'.

    ``parts``: folders of the base and of the deltas after it, the last of them this increment's own.
    """

    number: int
    parts: tuple[str, ...]
    sighting_mark: int | None
    run_mark: int | None


class CommitLog:
    """Numbered commit files below ``root/_commits``; each holds the watermark and the folder it belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, number: int) -> str:
        return f"{self.root}/_commits/{number:012d}.json"

    def last(self) -> Commit | None:
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.root}/_commits/{names[-1]}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Commit(**(found | {"parts": tuple(found["parts"])}))

    def publish(self, commit: Commit) -> None:
        """Make a commit visible in one step; an existing number is never replaced."""
        if not publish_file(self.spark, self._at(commit.number), json.dumps(commit.__dict__)):
            raise RuntimeError(f"commit {commit.number} was published by another run")


def _micros(column: Column) -> Column:
    return F.unix_micros(column)


def _between(column: Column, low: int | None, high: int) -> Column:
    """``low < column <= high`` on raw timestamps, so that the filter reaches the scan."""
    upper = column <= F.timestamp_micros(F.lit(high))
    return upper if low is None else (column > F.timestamp_micros(F.lit(low))) & upper


class ChangeTracker:
    """Finds the files the next indexing run has to process.

    ``scans``: file_id, content_hash, seen_at, arrived_at, scan_id. ``files``: id, content_hash,
    indexed_at, run_id. ``runs``: run_id, run_status, finished_at. Other columns are ignored.

    Defined results: rows without an id, sightings without a usable hash and entries of runs that
    did not succeed take no part; rows whose commit time is null were never committed and wait.
    Equal ``seen_at`` are settled by the larger ``scan_id``, equal ``indexed_at`` by the larger
    ``run_id``, then by the larger hash. Repeated rows change nothing. Empty tables give no file.
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int = COMPACT_AFTER):
        self.spark, self.log, self.compact_after = spark, CommitLog(spark, root), compact_after

    def advance(self, scans: DataFrame, files: DataFrame, runs: DataFrame) -> Commit:
        """Run one increment and publish it; without new rows the last commit is returned."""
        last = self.log.last()
        low_s, low_r = (last.sighting_mark, last.run_mark) if last else (None, None)
        done = runs.filter(F.col("run_status") == "succeeded").select("run_id", "finished_at").dropna()
        # The limits are read from rows beyond the watermark alone; without any the watermark stays.
        high_s = _newest(scans, "arrived_at", low_s)
        high_r = _newest(done, "finished_at", low_r)
        if last and high_s is None and high_r is None:
            return last
        parts = [part for part in (self._sightings(scans, low_s, high_s), self._entries(files, done, low_r, high_r)) if part is not None]
        delta = _reduced(parts) if parts else self.spark.createDataFrame([], STATE_SCHEMA)
        before = last.parts if last else ()
        if len(before) > self.compact_after:
            delta, before = _reduced([self._state(before), delta]), ()
        path = f"{self.log.root}/state/{uuid.uuid4().hex}"
        delta.write.parquet(path)
        commit = Commit((last.number + 1) if last else 0, (*before, path), high_s if high_s is not None else low_s, high_r if high_r is not None else low_r)
        self.log.publish(commit)
        return commit

    @staticmethod
    def _sightings(scans: DataFrame, low: int | None, high: int | None) -> DataFrame | None:
        if high is None:
            return None
        new = scans.filter(_between(F.col("arrived_at"), low, high) & F.col("file_id").isNotNull() & F.col("content_hash").isNotNull())
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("entry_at", "timestamp"), ("entry_key", "int"), ("entry_hash", "string"))]
        new = new.select(F.col("file_id").alias("id"), F.col("seen_at").alias("sighting_at"), F.col("scan_id").cast("bigint").alias("sighting_key"), bare_hash(F.col("content_hash")).alias("sighting_hash"), *nothing)
        return new.filter(F.col("sighting_hash").isNotNull())

    @staticmethod
    def _entries(files: DataFrame, done: DataFrame, low: int | None, high: int | None) -> DataFrame | None:
        """Entries of the runs that finished since; the run ids reach the scan, so a table laid out by run is read in part."""
        if high is None:
            return None
        finished = done.filter(_between(F.col("finished_at"), low, high)).select(F.col("run_id").alias("_run")).distinct()
        ids = [r[0] for r in finished.limit(PUSHED_RUNS + 1).collect()]
        new = files.filter(F.col("id").isNotNull())
        new = new.filter(F.col("run_id").isin(ids)) if len(ids) <= PUSHED_RUNS else new.join(finished, new["run_id"] == finished["_run"], "left_semi")
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("sighting_at", "timestamp"), ("sighting_key", "bigint"), ("sighting_hash", "string"))]
        return new.select("id", *nothing, F.col("indexed_at").alias("entry_at"), F.col("run_id").cast("int").alias("entry_key"), bare_hash(F.col("content_hash")).alias("entry_hash"))

    def _state(self, parts: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).parquet(*parts)

    def pending(self, commit: Commit | None = None) -> DataFrame:
        """(id, content_hash) of the files to index as of a commit, the last one by default."""
        commit = commit or self.log.last()
        if commit is None:
            return self.spark.createDataFrame([], "id string, content_hash string")
        state = self._state(commit.parts)
        # A base alone holds one row a file already.
        return _to_index(state if len(commit.parts) == 1 else _reduced([state]))

    def changed(self, commit: Commit | None = None) -> DataFrame:
        """(id, content_hash) of the files to index among those that this commit's increment touched."""
        commit = commit or self.log.last()
        if commit is None:
            return self.pending(commit)
        touched = self._state(commit.parts[-1:]).select("id")
        return _to_index(_reduced([self._state(commit.parts).join(touched, "id", "left_semi")]))


def _newest(rows: DataFrame, column: str, low: int | None) -> int | None:
    new = rows if low is None else rows.filter(F.col(column) > F.timestamp_micros(F.lit(low)))
    return new.agg(F.max(_micros(F.col(column)))).first()[0]


def _reduced(parts: list[DataFrame]) -> DataFrame:
    """One row per file of the newest sighting and the newest entry. One exchange on id for all parts; partial maxima keep a
    file with many sightings small."""
    events = reduce(DataFrame.unionByName, parts)
    sighting = F.struct(F.col("sighting_at"), F.col("sighting_key"), F.col("sighting_hash"))
    entry = F.struct(F.col("entry_at"), F.col("entry_key"), F.col("entry_hash"))
    merged = events.groupBy("id").agg(
        F.max(F.when(F.col("sighting_hash").isNotNull(), sighting)).alias("s"),
        F.max(F.when(F.col("entry_key").isNotNull(), entry)).alias("e"),
    )
    return merged.select("id", "s.sighting_at", "s.sighting_key", "s.sighting_hash", "e.entry_at", "e.entry_key", "e.entry_hash")


def _to_index(state: DataFrame) -> DataFrame:
    wanted = F.col("sighting_hash").isNotNull() & ~F.col("sighting_hash").eqNullSafe(F.col("entry_hash"))
    return state.filter(wanted).select("id", F.col("sighting_hash").alias("content_hash"))
