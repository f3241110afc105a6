"""Collections of records with named vectors, as tables with replace-style writes.

A collection is a folder: data in buckets by hash of one column (the id, or the parent's id where children are replaced together),
and numbered manifests that say how many buckets there are and which folder holds each. A write rewrites only the buckets its
rows fall into and publishes a new manifest in one step, so readers see all of a write or none of it, and of two writers one
fails. Every read prunes columns and pushes its predicate to the scan.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.vectors import METRICS
from shelfmark.operators.catalog import latest
from shelfmark.operators.filters import Predicate, apply_predicate, predicate_column
from shelfmark.operators.search import multi_vector_top_k, top_k
from shelfmark.session import publish_file

PREFIX = "vec_"


@dataclass(frozen=True)
class VectorConfig:
    name: str
    size: int
    distance: str = "cosine"

    def __post_init__(self):
        if self.size < 1:
            raise ValueError("a vector needs at least one dimension")
        if self.distance not in METRICS:
            raise ValueError(f"unknown distance {self.distance!r}")
        if not self.name.strip():
            raise ValueError("a vector needs a name")


class Store:
    """Collections below ``root``, a folder that all executors can reach.

    ``buckets``: how many a collection created here gets; one that exists keeps the number it was created with.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        if buckets < 1:
            raise ValueError("a collection needs at least one bucket")
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is held open; part of the interface."""

    # ---- manifests ----

    def _numbers(self, name: str) -> list[int]:
        folder = self._path(f"{self.root}/{name}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def _manifest(self, name: str) -> dict:
        numbers = self._numbers(name)
        if not numbers:
            raise KeyError(f"no collection {name!r}")
        stream = self._fs.open(self._path(f"{self.root}/{name}/_manifest/{numbers[-1]:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, manifest: dict) -> None:
        number = manifest["number"] = manifest.get("number", -1) + 1
        if not publish_file(self.spark, f"{self.root}/{name}/_manifest/{number:012d}.json", json.dumps(manifest)):
            raise RuntimeError(f"collection {name!r} was written by another session")

    # ---- collections ----

    def exists(self, name: str) -> bool:
        return bool(self._numbers(name))

    def create(self, name: str, payload: T.StructType, vectors: Sequence[VectorConfig] = (), bucket_by: str = "id") -> None:
        """An empty collection with an ``id``, the payload fields and one array column per vector name.

        ``bucket_by``: the string column whose hash gives the bucket; ``parent_id`` where children are replaced with their parents.
        """
        if bucket_by != "id" and bucket_by not in payload.fieldNames():
            raise ValueError(f"no field {bucket_by!r} to form buckets by")
        if self.exists(name):
            raise ValueError(f"collection {name!r} exists")
        if any(f.name.startswith(PREFIX) or f.name == "id" for f in payload.fields):
            raise ValueError("payload fields must not be named id or begin with vec_")
        fields = [T.StructField("id", T.StringType(), False), *payload.fields, *[T.StructField(PREFIX + v.name, T.ArrayType(T.FloatType())) for v in vectors]]
        self._publish(name, {"schema": T.StructType(fields).json(), "vectors": {v.name: [v.size, v.distance] for v in vectors}, "buckets": self.buckets, "bucket_by": bucket_by, "parts": {}})

    def ensure(self, name: str, payload: T.StructType, vectors: Sequence[VectorConfig] = (), bucket_by: str = "id") -> None:
        """Create a collection, or check it and add vector names it lacks. Another size or distance is an error."""
        if not self.exists(name):
            self.create(name, payload, vectors, bucket_by)
            return
        manifest = self._manifest(name)
        if vectors and not manifest["vectors"]:
            raise ValueError(f"collection {name!r} has no named vectors")
        new = [v for v in vectors if v.name not in manifest["vectors"]]
        for v in vectors:
            if v not in new and manifest["vectors"][v.name] != [v.size, v.distance]:
                raise ValueError(f"vector {v.name!r} has another size or distance")
        if new:
            schema = T.StructType.fromJson(json.loads(manifest["schema"]))
            manifest["schema"] = T.StructType([*schema.fields, *[T.StructField(PREFIX + v.name, T.ArrayType(T.FloatType())) for v in new]]).json()
            manifest["vectors"] |= {v.name: [v.size, v.distance] for v in new}
            self._publish(name, manifest)

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._manifest(name)["schema"]))

    def read(self, name: str) -> DataFrame:
        """All records; columns added later are null in older parts."""
        return self._read(self._manifest(name))

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        paths = sorted({p for b, p in manifest["parts"].items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], schema)
        # Each bucket folder is read as a root of its own, so its name adds no column.
        return self.spark.read.schema(schema).parquet(*paths)

    @staticmethod
    def _bucket(manifest: dict, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(column or manifest["bucket_by"]), F.lit(manifest["buckets"])).cast("int")

    def _touched(self, manifest: dict, rows: DataFrame, column: str | None = None) -> set[int]:
        """Buckets of rows; at most as many numbers as there are buckets come to the driver."""
        return {r[0] for r in rows.select(self._bucket(manifest, column).alias("b")).distinct().collect()}

    def _holding(self, manifest: dict, ids: DataFrame) -> set[int]:
        """Buckets that hold the records of these ids: known from the ids, or seen in the id column of all buckets."""
        if manifest["bucket_by"] == "id":
            return {b for b in self._touched(manifest, ids, "id") if str(b) in manifest["parts"]}
        return self._touched(manifest, self._read(manifest).select("id", manifest["bucket_by"]).join(ids.select("id"), "id", "left_semi"))

    def _rewrite(self, name: str, manifest: dict, touched: set[int], kept: DataFrame) -> None:
        """Publish ``kept`` as the content of the touched buckets."""
        folder = f"{self.root}/{name}/data-{uuid.uuid4().hex}"
        # A large bucket is written by several tasks, small ones share one: the sizes met at run time decide.
        kept.withColumn("_bucket", self._bucket(manifest)).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        there = {s.getPath().getName() for s in self._fs.listStatus(self._path(folder))}
        for b in touched:
            manifest["parts"].pop(str(b), None)
            if f"_bucket={b}" in there:
                manifest["parts"][str(b)] = f"{folder}/_bucket={b}"
        self._publish(name, manifest)

    # ---- records ----

    def upsert(self, name: str, records: DataFrame, order: str | None = None) -> None:
        """Replace whole records by id, add new ones; of an id repeated in the batch the last by ``order`` stays. Empty is no write.

        Null ids, and vectors of another size or with numbers that aren't finite, are errors.
        """
        manifest = self._manifest(name)
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        checked = records.withColumn("id", F.when(F.col("id").isNull() | (F.col("id") == ""), F.raise_error(F.lit("a record needs an id"))).otherwise(F.col("id")))
        for vector, (size, _) in manifest["vectors"].items():
            if (column := PREFIX + vector) in records.columns:
                fine = F.col(column).isNull() | ((F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
                checked = checked.withColumn(column, F.when(fine, F.col(column)).otherwise(F.raise_error(F.lit(f"vector {vector} needs {size} finite numbers"))))
        new = latest(checked, "id", [order]) if order else checked.dropDuplicates(["id"])
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in records.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        new = new.persist()
        try:
            touched = self._touched(manifest, new)
            if touched:
                touched |= self._holding(manifest, new) if manifest["bucket_by"] != "id" else set()
                self._rewrite(name, manifest, touched, self._without(manifest, touched, new).unionByName(new))
        finally:
            new.unpersist()

    def _without(self, manifest: dict, touched: set[int], gone: DataFrame) -> DataFrame:
        """Records of the touched buckets but for those of the ids of ``gone``."""
        old = self._read(manifest, touched)
        return old.join(gone.select("id"), "id", "left_anti") if any(str(b) in manifest["parts"] for b in touched) else old

    def retrieve(self, name: str, ids: DataFrame | Sequence[str], with_vectors: bool = False) -> DataFrame:
        """Records of the wanted ids; missing ones are silently absent."""
        manifest = self._manifest(name)
        if isinstance(ids, DataFrame):
            rows = self._read(manifest).join(ids.select("id").distinct(), "id", "left_semi")
        else:
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
            # A few ids lie in a few buckets, and only those are opened.
            rows = self._read(manifest, self._holding(manifest, wanted) if manifest["bucket_by"] == "id" and ids else None)
            rows = rows.filter(F.col("id").isin(list(ids)) if ids else F.lit(False))
        return rows if with_vectors else _bare(rows)

    def scroll(self, name: str, predicate: Predicate | None = None, limit: int = 100, offset: str | None = None) -> tuple[DataFrame, str | None]:
        """One page in id order, and the id the next page begins with."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        rows = _bare(apply_predicate(self.read(name), predicate))
        rows = rows.filter(F.col("id") >= offset) if offset is not None else rows
        page = rows.orderBy("id").limit(limit + 1)
        after = page.select("id").offset(limit).first()
        return page.limit(limit), after[0] if after else None

    def search(self, name: str, vector: Sequence[float] | Sequence[Sequence[float]], vector_name: str, limit: int = 10, predicate: Predicate | None = None) -> DataFrame:
        """The best records by the collection's distance; several vectors are merged by their best score. A missing collection is empty."""
        if limit < 1:
            raise ValueError("limit must be at least 1")
        if not self.exists(name):
            return self.spark.createDataFrame([], "id string, score double")
        manifest = self._manifest(name)
        if vector_name not in manifest["vectors"]:
            raise KeyError(f"no vector {vector_name!r}")
        rows, column = self._read(manifest), PREFIX + vector_name
        rows = rows.drop(*[c for c in rows.columns if c.startswith(PREFIX) and c != column])
        metric = manifest["vectors"][vector_name][1]
        if len(vector) and not isinstance(vector[0], (int, float)):
            return multi_vector_top_k(rows, column, vector, limit, predicate, metric=metric)
        return top_k(rows, column, vector, limit, metric, predicate)

    def count(self, name: str, predicate: Predicate | None = None) -> int:
        return apply_predicate(self.read(name), predicate).count()

    def delete(self, name: str, ids: DataFrame | Sequence[str]) -> None:
        """Remove records by id; no ids is no write."""
        gone = ids.select("id").distinct() if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        manifest = self._manifest(name)
        touched = self._holding(manifest, gone)
        if touched:
            self._rewrite(name, manifest, touched, self._without(manifest, touched, gone))

    def delete_by_filter(self, name: str, predicate: Predicate) -> None:
        """Remove the records a predicate is true of; an empty predicate is an error."""
        if predicate.empty:
            raise ValueError("deleting by an empty filter would delete everything")
        manifest = self._manifest(name)
        rows = self._read(manifest)
        hit = predicate_column(predicate, rows.schema)
        touched = self._touched(manifest, rows.filter(hit))
        if touched:
            self._rewrite(name, manifest, touched, self._read(manifest, touched).filter(~F.coalesce(hit, F.lit(False))))

    def replace_children(self, name: str, children: DataFrame, parents: DataFrame) -> None:
        """All children (column ``parent_id``) of the parents (column ``id``) are replaced by the given ones, in one publication.

        In a collection with buckets by ``parent_id`` only those of the parents are rewritten. A child without a parent id is an error.
        """
        manifest = self._manifest(name)
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        checked = F.when(F.coalesce(F.trim("parent_id"), F.lit("")) == "", F.raise_error(F.lit("a child needs the id of its parent"))).otherwise(F.col("parent_id"))
        new = children.withColumn("parent_id", checked)
        new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        gone = parents.select(F.col("id").alias("parent_id")).distinct()
        new, gone = new.persist(), gone.persist()
        try:
            if manifest["bucket_by"] == "parent_id":
                touched = self._touched(manifest, gone.unionByName(new.select("parent_id")))
                if not touched:
                    return
            else:
                touched = set(range(manifest["buckets"]))
            kept = self._read(manifest, touched)
            if any(str(b) in manifest["parts"] for b in touched):
                kept = kept.join(gone, "parent_id", "left_anti").select(*schema.fieldNames()).join(new.select("id"), "id", "left_anti").select(*schema.fieldNames())
            self._rewrite(name, manifest, touched, kept.unionByName(new))
        finally:
            new.unpersist()
            gone.unpersist()


def _bare(rows: DataFrame) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c.startswith(PREFIX)])
