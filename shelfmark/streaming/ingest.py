"""Optional trigger for incremental work: new rows of a table folder drive a change tracker or a store.

The reference semantics are batch semantics; a stream only decides when a batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.store import Store


def upsert_stream(spark: SparkSession, source: str, schema: str, store: Store, collection: str, checkpoint: str, order: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upsert every new file of a Parquet folder into a collection, then stop (AvailableNow).

    An upsert by id may run twice after a failure without another result, so the sink is effectively exactly-once.
    """
    rows = spark.readStream.schema(schema).parquet(source)
    rows = prepare(rows) if prepare else rows

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(collection, batch, order)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than ``late`` behind the newest event are left out once their window has closed."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))
