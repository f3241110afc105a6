"""Indexing and searching: from discovered files to tables, and from a request to a table of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.embedding import AudioModel, ByteImageModel, HashingModel, ImageModel, SpectrumAudioModel, TextModel
from shelfmark.functions.identity import file_id, segment_id
from shelfmark.operators import catalog as C
from shelfmark.operators.chunking import MAX_CHARACTERS
from shelfmark.operators.filters import Condition, MetadataQuery, Predicate
from shelfmark.operators.search import DEFAULT_LIMITS, GROUP_OVERFETCH, group_by_parent
from shelfmark.operators.store import PREFIX, Store, VectorConfig
from shelfmark.plans.handlers import AudioQuery, Handler, ImageQuery, audio_handler, image_handler, registry, text_handler
from shelfmark.plans.requests import QueryFileVectorizer, Request
from shelfmark.session import materialise
from shelfmark.sources.files import catalogue_rows, discover, hash_files
from shelfmark.sources.media import MEDIA_SCHEMA

FILES, SEGMENTS = "files", "file_segments"
#: Vector name of each modality.
VECTORS = {"text": "text_v1", "image": "image_v1", "audio": "audio_v1"}
PARENT = (
    "path string, path_key string, file_name string, file_name_search string, content_hash string, hash_algorithm string, file_type string, extension string, "
    "format_key string, mime_type string, size_bytes bigint, modified_at timestamp, indexed_at timestamp, segment_count int, title string, language string, "
    f"metadata struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in MEDIA_SCHEMA.split(', '))}>"
)
CHILD = (
    "parent_id string, segment_index int, segment_kind string, start_seconds double, end_seconds double, chunk_text string, character_count int, first_block_index int, last_block_index int, "
    "page_number int, slide_number int, section_path array<string>, heading string, source_line_start int, source_line_end int"
)
MATCH = ("parent_id", "path", "file_type", "score", "segment_index", "chunk_text", "heading", "page_number", "slide_number", "start_seconds", "end_seconds")


class Library:
    """A catalogue of one store: incremental indexing of folders, grouped search, duplicates.

    ``model``, ``image_model`` and ``audio_model`` are pluggable; the defaults need no weights. ``handlers`` replaces the way whole
    modalities are prepared.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        model: TextModel | None = None,
        image_model: ImageModel | None = None,
        audio_model: AudioModel | None = None,
        handlers: Sequence[Handler] | None = None,
        most: int = MAX_CHARACTERS,
    ):
        self.spark, self.store = spark, Store(spark, root)
        self.models = {"text": model or HashingModel(), "image": image_model or ByteImageModel(), "audio": audio_model or SpectrumAudioModel()}
        made = handlers or (
            text_handler(self.models["text"], PREFIX + VECTORS["text"], most),
            image_handler(self.models["image"], PREFIX + VECTORS["image"]),
            audio_handler(self.models["audio"], PREFIX + VECTORS["audio"]),
        )
        self.handlers = registry(made)
        parent, child = T.StructType.fromDDL(PARENT), T.StructType.fromDDL(CHILD)
        configs = {scope: [VectorConfig(VECTORS[t], self.models[t].dims) for t, h in self.handlers.items() if h.scope == scope] for scope in ("file", "segment")}
        self.store.ensure(FILES, parent, configs["file"])
        # Children hold the fields of their parents, so that filters need no join, and lie with them, so that they are replaced together.
        self.store.ensure(SEGMENTS, T.StructType([*parent.fields, *child.fields]), configs["segment"], bucket_by="parent_id")

    # ---- indexing ----

    def plan(self, folder: str, recursive: bool = True, types: Sequence[str] | None = None) -> DataFrame:
        """Discovered files with ``change`` against the catalogue."""
        extensions = {t: h.extensions for t, h in self.handlers.items()}
        found = catalogue_rows(hash_files(discover(self.spark, folder, recursive, types, extensions)))
        return C.classify_changes(found, self.store.read(FILES).select("path_key", "content_hash"))

    def counters(self, plan: DataFrame) -> DataFrame:
        """(file_type, total, new, updated, unchanged, failed, work) of every queue of a plan."""
        return C.change_counters(plan, failures=True)

    def index(self, folder: str, recursive: bool = True, types: Sequence[str] | None = None) -> DataFrame:
        """Index new and changed files; returns (path, file_type, change, error), one row per file worked on.

        Children are published before parents, and the parent's hash is the mark of a finished file: a run that dies between
        the two works on the same files again. A file of which any part can't be prepared is reported and stays out.
        """
        work = materialise(self.plan(folder, recursive, types).filter("change in ('new', 'updated', 'failed')"), "plan")
        schemas = [self.store.schema(name) for name in (FILES, SEGMENTS)]
        prepared = {t: h.prepare(work.filter((F.col("file_type") == t) & (F.col("change") != "failed"))) for t, h in self.handlers.items()}
        files = _stacked([_shaped(p.files, schemas[0], "path", "error") for p in prepared.values()])
        segments = _stacked([_shaped(p.segments, schemas[1], "path") for p in prepared.values() if p.segments is not None])
        files, segments = materialise(files, "prepared"), materialise(segments, "segments")
        counts = segments.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("segment_count"))
        own = [c for c in work.columns if c not in ("error", "change")]
        extra = [c for c in files.columns if c not in own and c not in ("segment_count", "indexed_at", "error")]
        good = work.select(*own).join(files.filter("error is null").select("path", *extra), "path").join(counts, "path", "left")
        parents = materialise(good.withColumn("segment_count", F.coalesce("segment_count", F.lit(0))).withColumn("indexed_at", F.current_timestamp()), "parents")
        inherited = parents.select(*[c for c in parents.columns if c in schemas[1].fieldNames() and c != "id"], F.col("id").alias("parent_id"))
        mine = [c for c in segments.columns if c not in inherited.columns or c == "path"]
        children = inherited.join(segments.select(*mine), "path").withColumn("id", segment_id(F.col("path_key"), F.col("segment_index")))
        self.store.replace_children(SEGMENTS, C.checked_segments(children), parents)
        self.store.upsert(FILES, parents)
        report = work.select("path", "file_type", "change", F.col("error").alias("e1")).join(files.select("path", F.col("error").alias("e2")), "path", "left")
        return report.select("path", "file_type", "change", F.coalesce("e1", "e2").alias("error"))

    def remove(self, ids: DataFrame) -> None:
        """Files and all their segments."""
        self.store.replace_children(SEGMENTS, self.store.read(SEGMENTS).limit(0), ids)
        self.store.delete(FILES, ids)

    # ---- reading ----

    def find(self, query: MetadataQuery | Predicate | None = None, limit: int | None = None) -> DataFrame:
        """Files by their metadata, in id order: one page of ``limit``."""
        fields = isinstance(query, MetadataQuery)
        predicate = query.predicate() if fields else query
        return self.store.scroll(FILES, predicate, limit or DEFAULT_LIMITS["files" if fields else "metadata"])[0]

    def by_hash(self, content: str, limit: int = 100) -> DataFrame:
        return self.find(Predicate(all_of=(Condition("content_hash", "equal", content),)), limit)

    def by_paths(self, paths: DataFrame, key: str = "path_key", order: str = "position") -> DataFrame:
        """Entries of path keys in the order wanted; a missing one keeps a row of nulls. One join, whatever their number."""
        return C.lookup(self.store.read(FILES).drop("path_key"), paths.withColumn("id", file_id(F.col(key))), "id", order)

    def duplicates(self) -> DataFrame:
        return C.duplicate_groups(self.store.read(FILES))

    # ---- searching ----

    def vectorizers(self) -> dict[str, QueryFileVectorizer]:
        """What turns a query file into vectors: images and recordings; there is none for documents."""
        return {"image": ImageQuery(self.models["image"]), "audio": AudioQuery(self.models["audio"])}

    def search(self, request: Request, limit: int = 10, vectorizers: Mapping[str, QueryFileVectorizer] | None = None, grouped: bool = False) -> DataFrame:
        """Best files or segments of a request, as the vectors of its target lie; or files with their matches.

        Grouping sees five times as many segments as groups are wanted; a modality whose files carry the vectors has no segments to group.
        """
        if limit < 1:
            raise ValueError("limit must be at least 1")
        if request.text is not None:
            vectors = self.models[request.target].encode([request.text], query=True).tolist()
        else:
            vectors = (self.vectorizers() if vectorizers is None else vectorizers)[request.target].vectors(request.file)
        of_type = Condition("file_type", "equal", request.target)
        asked = request.metadata.predicate()
        predicate = Predicate(all_of=(of_type, *(asked.all_of if asked else ())))
        by_segment = self.handlers[request.target].scope == "segment"
        fetched = limit * GROUP_OVERFETCH if grouped and by_segment else limit
        found = self.store.search(SEGMENTS if by_segment else FILES, [list(v) for v in vectors], VECTORS[request.target], fetched, predicate)
        if not by_segment:
            return found.select(F.col("id").alias("parent_id"), *[c for c in MATCH if c in found.columns])
        return group_by_parent(found, "parent_id", limit) if grouped else found.select(*MATCH)


def _shaped(rows: DataFrame, schema: T.StructType, *more: str) -> DataFrame:
    """The columns of a collection that a preparer gives, in one form for all modalities; what it doesn't give is null."""
    named = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in more and f.name not in ("id", "parent_id")]
    return rows.select(*more, *named)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
