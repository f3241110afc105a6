"""Queries of the core operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark import cases
from shelfmark.functions import identity as I
from shelfmark.functions import text as X
from shelfmark.functions import vectors as V
from shelfmark.functions.embedding import HashingModel, embed
from shelfmark.operators import catalog as C
from shelfmark.operators import metrics as M
from shelfmark.operators import search as S
from shelfmark.operators.chunking import chunk_blocks
from shelfmark.operators.filters import Condition, MetadataQuery, Predicate, apply_predicate
from shelfmark.operators.incremental import ChangeTracker, bare_hash
from shelfmark.operators.ranking import rank_within
from shelfmark.operators.timestamps import normalise_timestamps
from shelfmark.operators.store import Store, VectorConfig
from shelfmark.plans.query_language import parse_query
from shelfmark.session import scratch_path
from shelfmark.sources.files import parse_documents

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files the next run has to index: one increment of a fresh change tracker over everything committed so far."""
    tracker = ChangeTracker(spark, scratch_path(spark, "changes"))
    commit = tracker.advance(*(table(spark, sf_dir, t) for t in ("scans", "files", "index_runs")))
    return tracker.pending(commit)


P2_SQL = """
WITH s AS (
  SELECT file_id AS id, seen_at, scan_id, regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]\\s*', '') AS h
  FROM scans WHERE file_id IS NOT NULL AND content_hash IS NOT NULL AND arrived_at IS NOT NULL),
newest_s AS (SELECT id, h FROM s WHERE h <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC, scan_id DESC) = 1),
e AS (
  SELECT f.id, f.indexed_at, f.run_id, regexp_replace(lower(trim(f.content_hash)), '^[a-z0-9_-]+[:=]\\s*', '') AS h
  FROM files f JOIN index_runs r ON r.run_id = f.run_id WHERE r.run_status = 'succeeded' AND r.finished_at IS NOT NULL AND f.id IS NOT NULL),
newest_e AS (SELECT id, h FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, run_id DESC, h DESC) = 1)
SELECT s.id, s.h AS content_hash FROM newest_s s LEFT JOIN newest_e e ON s.id = e.id WHERE e.h IS NULL OR e.h <> s.h
"""


def p2_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files after an increment over the earlier half of the commits, one that dies before it is published, and one over the rest."""
    scans, files, runs = (table(spark, sf_dir, t) for t in ("scans", "files", "index_runs"))
    half = scans.agg(F.percentile_approx("arrived_at", 0.5)).first()[0]
    root = scratch_path(spark, "changes")
    tracker = ChangeTracker(spark, root)
    tracker.advance(scans.filter(F.col("arrived_at") <= F.lit(half)), files, runs.filter(F.col("finished_at") <= F.lit(half)))
    dying = ChangeTracker(spark, root)

    def die(_) -> None:
        raise InterruptedError

    dying.log.publish = die
    try:
        dying.advance(scans, files, runs)
    except InterruptedError:
        pass
    return tracker.pending(tracker.advance(scans, files, runs))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One UTC instant for every raw timestamp that states a valid time."""
    columns = ["created_at", "content_modified_at", "modified_at"]
    return normalise_timestamps(table(spark, sf_dir, "document_meta"), "meta_id", columns, "zone_id").filter(F.col("utc_us").isNotNull()).select("meta_id", "field_name", "utc_us")



# ---- identity and scalar functions ------------------------------------------------------------

QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_increments": p2_increments, "p7_found": p7_found}
SQL: dict[str, str] = {"p2_found": P2_SQL, "p2_increments": P2_SQL}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL that gives the same rows."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


@query(
    "identity_file_ids",
    f"""
WITH h AS (SELECT DISTINCT path_key, sha1(unhex('{I.FILE_NAMESPACE.hex}') || encode(path_key)) AS d FROM files)
SELECT path_key, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
       substr('89ab', (CAST(('0x' || substr(d, 17, 1)) AS INTEGER) % 4) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h
""",
)
def identity_file_ids(spark, d):
    return table(spark, d, "files").select("path_key").distinct().withColumn("id", I.file_id(F.col("path_key")))


@query(
    "identity_segment_ids",
    f"""
WITH h AS (SELECT DISTINCT file_id, segment_index, sha1(unhex('{I.SEGMENT_NAMESPACE.hex}') || encode(file_id) || '\\x00'::BLOB || encode(CAST(segment_index AS VARCHAR))) AS d
           FROM prepared_segments WHERE segment_index >= 0)
SELECT file_id, segment_index, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
       substr('89ab', (CAST(('0x' || substr(d, 17, 1)) AS INTEGER) % 4) + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h
""",
)
def identity_segment_ids(spark, d):
    rows = table(spark, d, "prepared_segments").filter("segment_index >= 0").select("file_id", "segment_index").distinct()
    return rows.withColumn("id", I.segment_id(F.col("file_id"), F.col("segment_index")))


_FORMAT_SQL = """CASE ltrim_dot WHEN 'aif' THEN 'aiff' WHEN 'jpg' THEN 'jpeg' WHEN 'jfif' THEN 'jpeg' WHEN 'tif' THEN 'tiff' WHEN 'wave' THEN 'wav' ELSE ltrim_dot END"""


@query("format_keys", f"SELECT extension, {_FORMAT_SQL} AS fmt, count(*) AS n FROM (SELECT extension, regexp_replace(lower(trim(extension)), '^\\.', '') AS ltrim_dot FROM files) GROUP BY ALL")
def format_keys(spark, d):
    return table(spark, d, "files").groupBy("extension").agg(F.count(F.lit(1)).alias("n")).select("extension", I.format_key(F.col("extension")).alias("fmt"), "n")


@query(
    "file_types",
    "SELECT CASE WHEN lower(extension) IN ('.bmp','.dib','.gif','.jfif','.jpeg','.jpg','.jpe','.png','.tif','.tiff','.webp') THEN 'image' WHEN lower(extension) IN ('.aif','.aiff','.flac','.m4a','.mp3','.oga','.ogg','.wav','.wave') THEN 'audio' "
    "WHEN lower(extension) IN ('.pdf','.htm','.html','.md','.docx','.pptx') THEN 'text' END AS kind, count(*) AS n FROM files GROUP BY ALL",
)
def file_types(spark, d):
    return table(spark, d, "files").groupBy(I.file_type_of(F.col("extension")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "matching_keys",
    "SELECT file_name, lower(list_last(string_split(replace(trim(file_name), '\\', '/'), '/'))) AS name_key, regexp_replace(lower(file_name), '[^\\p{L}\\p{N}]', '', 'g') AS identity FROM (SELECT DISTINCT file_name FROM files)",
)
def matching_keys(spark, d):
    names = table(spark, d, "files").select("file_name").distinct()
    return names.select("file_name", I.file_name_key(F.col("file_name")).alias("name_key"), I.identity_key(F.col("file_name")).alias("identity"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hashes(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query(
    "text_previews",
    "SELECT doc_id, CASE WHEN length(t) > 280 THEN rtrim(substr(t, 1, 279)) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)",
)
def text_previews(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(
    "segment_labels",
    "SELECT vec_id, CASE WHEN floor(start_seconds / 3600) > 0 THEN printf('%d:%02d:%05.2f', CAST(floor(start_seconds / 3600) AS BIGINT), CAST(floor((start_seconds % 3600) / 60) AS BIGINT), start_seconds % 60) "
    "ELSE printf('%d:%05.2f', CAST(floor(start_seconds / 60) AS BIGINT), start_seconds % 60) END AS label FROM prepared_segments WHERE start_seconds IS NOT NULL",
)
def segment_labels(spark, d):
    return table(spark, d, "prepared_segments").filter("start_seconds is not null").select("vec_id", X.timestamp_text(F.col("start_seconds")).alias("label"))


# ---- predicates -------------------------------------------------------------------------------


@query("filter_all_of", "SELECT id, run_id, size_bytes FROM files WHERE file_type = 'text' AND size_bytes >= 100000 AND contains(lower(file_name), 'ta')")
def filter_all_of(spark, d):
    files = table(spark, d, "files").withColumn("file_name_search", F.lower("file_name"))
    rule = Predicate(all_of=(Condition("file_type", "equal", "text"), Condition("size_bytes", "gte", 100000), Condition("file_name_search", "text_contains", "ta")))
    return apply_predicate(files, rule).select("id", "run_id", "size_bytes")


@query("filter_none_of", "SELECT id, run_id FROM files WHERE mime_type IS NULL OR mime_type NOT IN ('text/html', 'application/pdf')")
def filter_none_of(spark, d):
    """A missing field passes none_of."""
    return apply_predicate(table(spark, d, "files"), Predicate(none_of=(Condition("mime_type", "in", ["text/html", "application/pdf"]),))).select("id", "run_id")


@query("filter_any_of", "SELECT chunk_id FROM chunks WHERE (page_number > 3 OR slide_number <= 2 OR list_contains(section_path, 'x')) AND chunk_index < 4")
def filter_any_of(spark, d):
    rule = Predicate(all_of=(Condition("chunk_index", "lt", 4),), any_of=(Condition("page_number", "gt", 3), Condition("slide_number", "lte", 2), Condition("section_path", "contains", "x")))
    return apply_predicate(table(spark, d, "chunks"), rule).select("chunk_id")


@query("filter_dates", "SELECT id, run_id FROM files WHERE modified_at >= TIMESTAMP '2024-06-01 00:00:00' AND modified_at < TIMESTAMP '2025-01-01 00:00:00'")
def filter_dates(spark, d):
    import datetime as dt

    rule = Predicate(all_of=(Condition("modified_at", "gte", dt.date(2024, 6, 1)), Condition("modified_at", "lt", dt.date(2025, 1, 1))))
    return apply_predicate(table(spark, d, "files"), rule).select("id", "run_id")


@query("count_by_filter", "SELECT count(*) AS n FROM files WHERE file_type = 'audio' AND segment_count >= 2")
def count_by_filter(spark, d):
    rule = Predicate(all_of=(Condition("file_type", "equal", "audio"), Condition("segment_count", "gte", 2)))
    return apply_predicate(table(spark, d, "files"), rule).agg(F.count(F.lit(1)).alias("n"))


# ---- vector search ----------------------------------------------------------------------------


def _first_vectors(spark, d, n: int) -> list[list[float]]:
    rows = table(spark, d, "embeddings").filter(F.col("vec_id") < n).select("vec_id", "embedding").orderBy("vec_id").limit(n).collect()
    return [list(r.embedding) for r in rows]


_COS = "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 5)"


def _search(metric: str) -> Query:
    def run(spark, d):
        rows = table(spark, d, "embeddings")
        return S.top_k(rows, "embedding", _first_vectors(spark, d, 1)[0], 10, metric, keys=("vec_id",)).select("vec_id", "label", F.round("score", 5).alias("score"))

    return run


_SEARCHES = (
    ("cosine", _COS, "DESC"),
    ("dot", "round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)", "DESC"),
    ("euclid", "round(list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5)", "ASC"),
    ("manhattan", "round(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2]))), 5)", "ASC"),
)
for _metric, _value, _order in _SEARCHES:
    query(f"search_{_metric}", f"SELECT e.vec_id, e.label, {_value} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score {_order}, e.vec_id LIMIT 10")(_search(_metric))


@query("search_filtered", f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 3, 5) ORDER BY score DESC, e.vec_id LIMIT 10")
def search_filtered(spark, d):
    rule = Predicate(all_of=(Condition("label", "in", [1, 3, 5]),))
    found = S.top_k(table(spark, d, "embeddings"), "embedding", _first_vectors(spark, d, 1)[0], 10, predicate=rule, keys=("vec_id",))
    return found.select("vec_id", "label", F.round("score", 5).alias("score"))


@query("search_multi_vector", f"SELECT e.vec_id, max({_COS}) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id < 3) q GROUP BY e.vec_id ORDER BY score DESC, e.vec_id LIMIT 15")
def search_multi_vector(spark, d):
    found = S.multi_vector_top_k(table(spark, d, "embeddings"), "embedding", _first_vectors(spark, d, 3), 15, keys=("vec_id",))
    return found.select("vec_id", F.round("score", 5).alias("score"))


@query(
    "search_batch",
    f"SELECT q.vec_id AS query_id, e.vec_id AS vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.label = 0 QUALIFY rank <= 5",
)
def search_batch(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.filter("label = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return S.batch_top_k(rows, "vec_id", "embedding", asked, "query_id", "v", 5, digits=5).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"))


# The same searches for the whole query set: every row whose id is divisible by 50 against all rows.
_ASKED = "(SELECT vec_id AS query_id, label AS query_label, embedding FROM embeddings WHERE vec_id % 50 = 0) q"


def _batch_sql(value: str, order: str, where: str = "true") -> str:
    rank = f"CAST(row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS INTEGER)"
    return f"SELECT query_id, vec_id, score, {rank} AS rank FROM (SELECT q.query_id, e.vec_id, {value} AS score FROM embeddings e, {_ASKED} WHERE {where}) QUALIFY rank <= 10"


def _batch(spark, d, limit: int, asked: str = "vec_id", metric: str = "cosine", predicate: Predicate | None = None) -> DataFrame:
    rows = table(spark, d, "embeddings")
    queries = rows.filter("vec_id % 50 = 0").select(F.col(asked).alias("query_id"), F.col("embedding").alias("v"))
    found = S.batch_top_k(rows, "vec_id", "embedding", queries, "query_id", "v", limit, digits=5, metric=metric, predicate=predicate)
    return found.select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"))


for _metric, _value, _order in _SEARCHES:
    query(f"search_{_metric}_all", _batch_sql(_value, _order))(lambda spark, d, m=_metric: _batch(spark, d, 10, metric=m))


@query("search_filtered_all", _batch_sql(_COS, "DESC", "e.label IN (1, 3, 5)"))
def search_filtered_all(spark, d):
    return _batch(spark, d, 10, predicate=Predicate(all_of=(Condition("label", "in", [1, 3, 5]),)))


@query(
    "search_multi_vector_all",
    f"SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT q.query_label AS query_id, e.vec_id, max({_COS}) AS score FROM embeddings e, {_ASKED} GROUP BY ALL) QUALIFY rank <= 15",
)
def search_multi_vector_all(spark, d):
    """The asking vectors of one label are one query of several vectors."""
    return _batch(spark, d, 15, asked="label")


@query("vector_validity", "SELECT vector_name, coalesce(len(vectors) = 64 AND len(list_filter(vectors, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS ok, count(*) AS n FROM prepared_segments GROUP BY ALL")
def vector_validity(spark, d):
    return table(spark, d, "prepared_segments").groupBy("vector_name", V.valid(F.col("vectors"), 64).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


_FINITE = "score IS NOT NULL AND isfinite(score) AND file_id IS NOT NULL"


def _finite_hits(spark, d) -> DataFrame:
    score = F.col("score")
    return table(spark, d, "hits").filter(score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf")) & F.col("file_id").isNotNull())


@query(
    "group_by_parent",
    f"WITH h AS (SELECT file_id, segment_index, max(score) AS score FROM hits WHERE {_FINITE} AND query_id = 'q-00000001' AND segment_index IS NOT NULL GROUP BY ALL) "
    "SELECT file_id, max(score) AS best_score, list(segment_index ORDER BY score DESC, segment_index) AS matches FROM h GROUP BY file_id ORDER BY best_score DESC, file_id LIMIT 20",
)
def group_by_parent(spark, d):
    """Result groups of one query's hits; the limit of 20 groups is the feature."""
    hits = _finite_hits(spark, d).filter("query_id = 'q-00000001' and segment_index is not null").groupBy("file_id", "segment_index").agg(F.max("score").alias("score"))
    return S.group_by_parent(hits, "file_id", 20)


@query(
    "group_by_parent_all",
    f"WITH h AS (SELECT query_id, file_id, segment_index, max(score) AS score FROM hits WHERE {_FINITE} AND segment_index IS NOT NULL GROUP BY ALL) "
    "SELECT query_id, file_id, max(score) AS best_score, list(segment_index ORDER BY score DESC, segment_index) AS matches FROM h GROUP BY query_id, file_id "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, file_id) <= 20",
)
def group_by_parent_all(spark, d):
    """The 20 best result groups of every query's hits."""
    hits = _finite_hits(spark, d).filter("segment_index is not null").groupBy("query_id", "file_id", "segment_index").agg(F.max("score").alias("score"))
    return S.groups_by_parent(hits, "query_id", "file_id", 20)


_RANKED = f"r AS (SELECT query_id, file_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS INTEGER) AS rank FROM hits WHERE {_FINITE})"


def _ranked(spark, d) -> DataFrame:
    hits = _finite_hits(spark, d).select("query_id", "file_id", "score", "hit_id")
    return rank_within(hits, ["query_id"], [F.col("score").desc(), F.col("hit_id")], "rank").select("query_id", "file_id", "rank")


@query("best_per_file", f"WITH {_RANKED}, f AS (SELECT query_id, file_id, min(rank) AS m FROM r GROUP BY ALL) SELECT query_id, file_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m, file_id) AS INTEGER) AS rank FROM f")
def best_per_file(spark, d):
    return S.best_per_file(_ranked(spark, d), "query_id", "file_id", "rank")


# ---- catalogue --------------------------------------------------------------------------------

_HASH = "regexp_replace(lower(trim(content_hash)), '^[a-z0-9_-]+[:=]\\s*', '')"
_NEWEST = f"newest AS (SELECT file_id AS id, {_HASH} AS h FROM scans QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY seen_at DESC NULLS LAST, scan_id DESC NULLS LAST) = 1)"
_STORED = f"stored AS (SELECT id, {_HASH} AS h, file_type FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, run_id DESC NULLS LAST, content_hash DESC) = 1)"
_CHANGE = "CASE WHEN n.h IS NULL THEN 'failed' WHEN s.id IS NULL THEN 'new' WHEN s.h = n.h THEN 'unchanged' ELSE 'updated' END"


def _changes(spark, d) -> DataFrame:
    seen = C.latest(table(spark, d, "scans").filter("file_id is not null"), "file_id", ["seen_at", "scan_id"]).select(F.col("file_id").alias("id"), bare_hash(F.col("content_hash")).alias("content_hash"))
    stored = C.latest(table(spark, d, "files"), "id", ["indexed_at", "run_id", "content_hash"]).select("id", bare_hash(F.col("content_hash")).alias("content_hash"), "file_type")
    classified = C.classify_changes(seen, stored.drop("file_type"), key="id")
    return classified.join(stored.select("id", "file_type"), "id", "left")


@query("change_classes", f"WITH {_NEWEST}, {_STORED} SELECT n.id, n.h AS content_hash, {_CHANGE} AS change FROM newest n LEFT JOIN stored s ON s.id = n.id")
def change_classes(spark, d):
    return _changes(spark, d).select("id", "content_hash", "change")


@query(
    "change_counters",
    f"WITH {_NEWEST}, {_STORED}, c AS (SELECT coalesce(s.file_type, 'unknown') AS file_type, {_CHANGE} AS change FROM newest n LEFT JOIN stored s ON s.id = n.id) "
    "SELECT file_type, count(*) AS total, count(*) FILTER (change = 'new') AS new_files, count(*) FILTER (change = 'updated') AS updated_files, count(*) FILTER (change = 'unchanged') AS unchanged_files, count(*) FILTER (change IN ('new', 'updated')) AS work FROM c GROUP BY ALL",
)
def change_counters(spark, d):
    return C.change_counters(_changes(spark, d).withColumn("file_type", F.coalesce("file_type", F.lit("unknown"))))


@query("duplicate_groups", f"WITH f AS (SELECT DISTINCT {_HASH} AS content_hash, path_key FROM files WHERE content_hash IS NOT NULL) SELECT content_hash, count(*) AS copies, list(path_key ORDER BY path_key) AS members FROM f GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, d):
    return C.duplicate_groups(table(spark, d, "files").withColumn("content_hash", bare_hash(F.col("content_hash"))))


@query("duplicate_members", f"WITH f AS (SELECT DISTINCT {_HASH} AS content_hash, path_key FROM files WHERE content_hash IS NOT NULL) SELECT content_hash, path_key, count(*) OVER (PARTITION BY content_hash) AS copies, CAST(row_number() OVER (PARTITION BY content_hash ORDER BY path_key) AS INTEGER) AS position FROM f QUALIFY copies > 1")
def duplicate_members(spark, d):
    return C.duplicate_members(table(spark, d, "files").withColumn("content_hash", bare_hash(F.col("content_hash"))))


@query("document_copies", "WITH t AS (SELECT sha256(text) AS content_hash, doc_id FROM documents WHERE text IS NOT NULL AND text <> '') SELECT content_hash, count(*) AS copies, min(doc_id) AS first_id FROM t GROUP BY ALL HAVING count(*) > 1")
def document_copies(spark, d):
    """Contents that several documents hold, with the first of them."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), "doc_id")
    return C.duplicate_members(docs, "content_hash", "doc_id").filter("position = 1").select("content_hash", "copies", F.col("doc_id").alias("first_id"))


@query("point_lookup", f"WITH {_STORED}, w AS (SELECT file_id AS id, min(meta_id) AS position FROM document_meta GROUP BY ALL) SELECT w.id, w.position, s.h AS content_hash FROM w LEFT JOIN stored s ON s.id = w.id")
def point_lookup(spark, d):
    """Wanted ids in their order; a missing one keeps its place."""
    stored = C.latest(table(spark, d, "files"), "id", ["indexed_at", "run_id", "content_hash"]).select("id", bare_hash(F.col("content_hash")).alias("content_hash"))
    wanted = table(spark, d, "document_meta").groupBy(F.col("file_id").alias("id")).agg(F.min("meta_id").alias("position"))
    return C.lookup(stored, wanted)


@query(
    "cascade_delete",
    "WITH doomed AS (SELECT DISTINCT id FROM files f JOIN index_runs r ON r.run_id = f.run_id WHERE r.run_status = 'failed'), c AS (SELECT 'child' AS kind, vec_id AS n FROM prepared_segments WHERE file_id NOT IN (SELECT id FROM doomed)), "
    "p AS (SELECT 'parent' AS kind, vec_id AS n FROM prepared_files WHERE file_id NOT IN (SELECT id FROM doomed)) SELECT kind, count(*) AS rows_left, sum(n) AS checksum FROM (SELECT * FROM c UNION ALL SELECT * FROM p) GROUP BY kind",
)
def cascade_delete(spark, d):
    failed = table(spark, d, "index_runs").filter("run_status = 'failed'").select("run_id")
    doomed = table(spark, d, "files").join(failed, "run_id", "left_semi").select("id").distinct()
    parents, children = C.cascade_delete(table(spark, d, "prepared_files").withColumnRenamed("file_id", "id"), table(spark, d, "prepared_segments"), doomed, parent="file_id")
    rows = parents.select(F.lit("parent").alias("kind"), "vec_id").unionByName(children.select(F.lit("child").alias("kind"), "vec_id"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows_left"), F.sum("vec_id").alias("checksum"))


@query(
    "upsert_replace",
    "WITH src AS (SELECT id, content_hash, run_id FROM files WHERE run_id > 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC, content_hash DESC) = 1), tgt AS (SELECT id, content_hash, run_id FROM files WHERE run_id <= 30 QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC, content_hash DESC) = 1) "
    "SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE id NOT IN (SELECT id FROM src)",
)
def upsert_replace(spark, d):
    """Entries of later runs replace those of earlier ones, whole rows."""
    rows = table(spark, d, "files").select("id", "content_hash", "run_id")
    old, new = (C.latest(rows.filter(c), "id", ["run_id", "content_hash"]) for c in ("run_id <= 30", "run_id > 30"))
    return C.replace_rows(old, new, "id", "run_id")


@query(
    "audio_ranges",
    "WITH d AS (SELECT file_id, max(end_seconds) AS dur FROM prepared_segments WHERE end_seconds IS NOT NULL GROUP BY ALL), s AS (SELECT file_id, dur, unnest(range(0, CAST(greatest(0, ceil((dur - 10.0) / 5.0)) AS BIGINT) + 1)) AS i FROM d WHERE dur > 0) "
    "SELECT file_id, CAST(i AS INTEGER) AS segment_index, i * 5.0::DOUBLE AS start_seconds, least(i * 5.0::DOUBLE + 10.0, dur) AS end_seconds FROM s",
)
def audio_ranges(spark, d):
    files = table(spark, d, "prepared_segments").filter("end_seconds is not null").groupBy("file_id").agg(F.max("end_seconds").alias("dur"))
    return C.audio_ranges(files, "dur", 10.0).select("file_id", "segment_index", "start_seconds", "end_seconds")


@query(
    "store_writes",
    "WITH e AS (SELECT vec_id, label FROM embeddings), kept AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 100 + label ELSE label END AS label FROM e) SELECT label, count(*) AS n FROM kept WHERE label <> 2 GROUP BY label",
)
def store_writes(spark, d):
    """A collection created, filled, partly replaced and partly deleted by filter, then counted."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("number"), "label", F.col("embedding").alias("vec_v"))
    store = Store(spark, scratch_path(spark, "store"))
    store.create("c", rows.select("number", "label").schema, [VectorConfig("v", 64)])
    store.upsert("c", rows)
    store.upsert("c", rows.filter("number % 3 = 0").withColumn("label", F.col("label") + 100))
    store.delete_by_filter("c", Predicate(all_of=(Condition("label", "equal", 2),)))
    return store.read("c").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _collection(spark, d, buckets: int = 16, distance: str = "cosine") -> tuple[Store, DataFrame]:
    """A store with the embeddings as collection ``c``."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("number"), "label", F.col("embedding").alias("vec_v"))
    store = Store(spark, scratch_path(spark, "store"), buckets)
    store.create("c", rows.select("number", "label").schema, [VectorConfig("v", 64, distance)])
    store.upsert("c", rows)
    return store, rows


@query("store_retrieve", "SELECT CAST(vec_id AS VARCHAR) AS id, label FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT CAST(vec_id AS VARCHAR), label FROM embeddings WHERE vec_id IN (1, 2)")
def store_retrieve(spark, d):
    """Records by a table of ids and by a list of ids; ids that aren't there are silently absent."""
    store, rows = _collection(spark, d)
    many = store.retrieve("c", rows.filter("number % 7 = 0").select("id").union(spark.createDataFrame([("none",)], "id string")))
    return many.select("id", "label").unionByName(store.retrieve("c", ["1", "2", "none"]).select("id", "label"))


@query("store_scroll", "WITH r AS (SELECT CAST(vec_id AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) AS n FROM embeddings WHERE label >= 3) SELECT CAST((n - 1) // 40 AS INTEGER) AS page, id FROM r WHERE n <= 120")
def store_scroll(spark, d):
    """Three pages of 40 in id order, each begun where the one before said; the pages are the feature."""
    store, _ = _collection(spark, d)
    rule, after, pages = Predicate(all_of=(Condition("label", "gte", 3),)), None, []
    for k in range(3):
        page, after = store.scroll("c", rule, 40, after)
        pages.append(page.select(F.lit(k).alias("page"), "id"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("store_delete", "SELECT label, count(*) AS n, (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0 AND label = 1) AS counted FROM embeddings WHERE vec_id % 3 <> 0 GROUP BY label")
def store_delete(spark, d):
    """Records deleted by a table of ids, then counted with and without a filter; deleting nothing writes nothing."""
    store, rows = _collection(spark, d)
    store.delete("c", rows.filter("number % 3 = 0").select("id"))
    store.delete("c", [])
    counted = store.count("c", Predicate(all_of=(Condition("label", "equal", 1),)))
    return store.read("c").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("counted", F.lit(counted).cast("bigint"))


@query("store_ensure", "SELECT CAST(vec_id AS VARCHAR) AS id, vec_id % 2 = 0 AS has_second, true AS exists, false AS other_exists, 'ValueError' AS other_size FROM embeddings")
def store_ensure(spark, d):
    """A vector name added to a collection that has rows, which lack it until they are written again; another size is an error."""
    store, rows = _collection(spark, d)
    payload = rows.select("number", "label").schema
    store.ensure("c", payload, [VectorConfig("v", 64), VectorConfig("w", 2)])
    other = cases.error_of(lambda: store.ensure("c", payload, [VectorConfig("v", 3)]))
    store.upsert("c", rows.filter("number % 2 = 0").withColumn("vec_w", F.array(F.lit(1.0), F.lit(0.0))))
    return store.read("c").select("id", F.col("vec_w").isNotNull().alias("has_second"), F.lit(store.exists("c")).alias("exists"), F.lit(store.exists("other")).alias("other_exists"), F.lit(other).alias("other_size"))


@query("store_reopened", "SELECT label, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 77 ELSE label END AS label FROM embeddings) GROUP BY label")
def store_reopened(spark, d):
    """A collection of 16 buckets opened by a store that makes 64: records are replaced, not doubled."""
    store, rows = _collection(spark, d)
    again = Store(spark, store.root, 64)
    again.upsert("c", rows.filter("number % 5 = 0").withColumn("label", F.lit(77)))
    return again.read("c").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


@query("store_search_distance", f"SELECT CAST(e.vec_id AS VARCHAR) AS id, min({_SEARCHES[2][1]}) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id < 3) q WHERE e.label <> 4 GROUP BY ALL ORDER BY score, id LIMIT 15")
def store_search_distance(spark, d):
    """Several vectors on a collection of distances, with a filter: the smallest distance counts; a collection that isn't there is empty."""
    store, _ = _collection(spark, d, distance="euclid")
    found = store.search("c", _first_vectors(spark, d, 3), "v", 15, Predicate(none_of=(Condition("label", "equal", 4),)))
    return found.select("id", F.round("score", 5).alias("score")).unionByName(store.search("none", [1.0], "v"))


@query(
    "store_children",
    "WITH c AS (SELECT file_id, vec_id FROM prepared_segments QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY file_id) = 1), p AS (SELECT file_id FROM c GROUP BY file_id HAVING min(vec_id) % 3 = 0) "
    "SELECT file_id AS parent_id, CASE WHEN file_id IN (SELECT file_id FROM p) THEN 1 ELSE count(*) END AS children FROM c GROUP BY file_id",
)
def store_children(spark, d):
    """All children of a third of the parents replaced by one child each, in a collection whose buckets are those of the parents."""
    children = C.latest(table(spark, d, "prepared_segments").select("vec_id", "file_id").withColumn("order", F.lit(1)), "vec_id", ["order"])
    rows = children.select(F.col("vec_id").cast("string").alias("id"), F.col("file_id").alias("parent_id"), F.col("vec_id").alias("number"))
    store = Store(spark, scratch_path(spark, "store"))
    store.create("c", rows.select("parent_id", "number").schema, bucket_by="parent_id")
    store.upsert("c", rows)
    parents = rows.groupBy("parent_id").agg(F.min("number").alias("first")).filter("first % 3 = 0")
    store.replace_children("c", parents.select(F.concat(F.lit("new-"), "parent_id").alias("id"), "parent_id"), parents.select(F.col("parent_id").alias("id")))
    return store.read("c").groupBy("parent_id").agg(F.count(F.lit(1)).alias("children"))


_META = "SELECT id, run_id, size_bytes % 2000 AS width, size_bytes % 300 AS height, size_bytes % 977 / 10.0 AS seconds, lower(file_name) AS name, format_key, modified_at FROM files"


@query("metadata_filters", f"WITH m AS ({_META}) SELECT id, run_id FROM m WHERE width >= 100 AND width <= 1500 AND height >= 20 AND seconds > 10 AND seconds < 90 AND contains(name, 'a') AND format_key = 'jpeg' AND modified_at >= TIMESTAMP '2020-01-01' AND modified_at < TIMESTAMP '2026-01-01'")
def metadata_filters(spark, d):
    """Every kind of constraint at once on nested metadata; the format is given with another letter case and extension."""
    import datetime as dt

    nested = F.struct((F.col("size_bytes") % 2000).alias("width"), (F.col("size_bytes") % 300).alias("height"), (F.col("size_bytes") % 977 / 10.0).alias("duration_seconds"))
    files = table(spark, d, "files").withColumn("file_name_search", F.lower("file_name")).withColumn("metadata", nested)
    at = lambda year: dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc)
    wanted = MetadataQuery("A", ".JPG", 100, 20, 1500, None, None, None, 10.0, 90.0, at(2020), at(2026))
    return apply_predicate(files, wanted.predicate()).select("id", "run_id")


@query("relevant_ranks", f"WITH {_RANKED}, q AS (SELECT query_id, min(file_id) AS file_id FROM r GROUP BY ALL) SELECT q.query_id, CAST(min(r.rank) AS INTEGER) AS relevant_rank FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.file_id = q.file_id GROUP BY ALL")
def relevant_ranks(spark, d):
    ranked = _ranked(spark, d)
    return S.relevant_rank(ranked, ranked.groupBy("query_id").agg(F.min("file_id").alias("file_id")), "query_id", "file_id", "rank")


@query("logical_ranks", f"WITH {_RANKED} SELECT query_id, substr(file_id, 1, 2) AS logical_id, min(rank) AS rank FROM r WHERE substr(file_id, 1, 1) = '3' GROUP BY ALL")
def logical_ranks(spark, d):
    """Best rank of each relevant logical document; files whose ids begin alike count as its variants."""
    ranked = _ranked(spark, d)
    logical = ranked.select("file_id", F.substring("file_id", 1, 2).alias("logical_id")).distinct()
    wanted = ranked.filter(F.substring("file_id", 1, 1) == "3").select("query_id", F.substring("file_id", 1, 2).alias("logical_id")).distinct()
    return S.logical_ranks(ranked, logical, wanted, "query_id", "file_id", "rank")


@query("files_by_hash", f"WITH k AS (SELECT min({_HASH}) AS h FROM files) SELECT DISTINCT id, run_id, path_key FROM files, k WHERE {_HASH} = k.h")
def files_by_hash(spark, d):
    """Files of one content, by the lookup's own operator."""
    files = table(spark, d, "files").withColumn("content_hash", bare_hash(F.col("content_hash"))).select("id", "run_id", "path_key", "content_hash").distinct()
    return C.by_hash(files, files.agg(F.min("content_hash")).first()[0]).select("id", "run_id", "path_key")


@query("plan_totals", f"WITH {_NEWEST}, {_STORED}, c AS (SELECT {_CHANGE} AS change FROM newest n LEFT JOIN stored s ON s.id = n.id) SELECT count(*) AS total, count(*) FILTER (change = 'new') AS new_files, count(*) FILTER (change = 'updated') AS updated_files, count(*) FILTER (change = 'unchanged') AS unchanged_files, count(*) FILTER (change IN ('new', 'updated')) AS work FROM c")
def plan_totals(spark, d):
    return C.plan_totals(C.change_counters(_changes(spark, d).withColumn("file_type", F.coalesce("file_type", F.lit("unknown")))))


@query("segment_checks", "SELECT file_id, count(*) AS segments, count(*) FILTER (start_seconds IS NOT NULL AND end_seconds IS NOT NULL) AS timed FROM (SELECT DISTINCT file_id, segment_index, min(start_seconds) AS start_seconds, min(end_seconds) AS end_seconds FROM prepared_segments WHERE file_id IS NOT NULL AND segment_index >= 0 AND (start_seconds IS NULL) = (end_seconds IS NULL) AND (start_seconds IS NULL OR (start_seconds >= 0 AND end_seconds > start_seconds)) GROUP BY file_id, segment_index) GROUP BY file_id")
def segment_checks(spark, d):
    """Sound segments pass the checks as they are; each index of a file once."""
    rows = table(spark, d, "prepared_segments").filter("file_id is not null and segment_index >= 0 and isnull(start_seconds) = isnull(end_seconds) and (start_seconds is null or (start_seconds >= 0 and end_seconds > start_seconds))")
    once = rows.groupBy("file_id", "segment_index").agg(F.min("start_seconds").alias("start_seconds"), F.min("end_seconds").alias("end_seconds"))
    checked = C.checked_segments(once.withColumnRenamed("file_id", "parent_id"))
    return checked.groupBy(F.col("parent_id").alias("file_id")).agg(F.count(F.lit(1)).alias("segments"), F.sum(F.when(C.is_timed(), 1).otherwise(0)).alias("timed"))


@query("query_language", "SELECT id, run_id FROM files WHERE contains(lower(file_name), 'ta') AND format_key = 'pdf' AND modified_at >= TIMESTAMP '2024-01-01' AND modified_at < TIMESTAMP '2025-06-01'")
def query_language(spark, d):
    """Filters of the compact query language on the catalogue."""
    parsed = parse_query("any text name:TA format:.PDF after:2024-01-01T00:00:00+00:00 before:2025-06-01T00:00:00+00:00")
    files = table(spark, d, "files").withColumn("file_name_search", F.lower("file_name"))
    return apply_predicate(files, parsed.metadata.predicate()).select("id", "run_id")


# ---- documents --------------------------------------------------------------------------------


@query("document_chunks")
def document_chunks(spark, d):
    """Structure-aware chunks of all parsed blocks (a sequential fold, not SQL)."""
    return chunk_blocks(table(spark, d, "blocks"), "file_id").drop("embedding_text")


@query("parse_documents_html")
def parse_documents_html(spark, d):
    """Blocks of all documents, read as HTML from a binary column; hard line wraps and markup of any kind must not fail."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.col("text").cast("binary").alias("content"))
    parsed = parse_documents(docs, "path", "content")
    return parsed.select("path", "title", F.size("blocks").alias("blocks"), "error")


@query("text_embeddings")
def text_embeddings(spark, d):
    """Vectors of all chunks by the default model."""
    return table(spark, d, "chunks").select("chunk_id", embed(F.col("text"), HashingModel(64)).alias("vector"))


# ---- evaluation and profiles ------------------------------------------------------------------

_REL = "q AS (SELECT query_id, min(file_id) AS file_id FROM r GROUP BY ALL)"


@query(
    "metrics_single",
    f"WITH {_RANKED}, {_REL}, x AS (SELECT q.query_id, min(r.rank) AS rank FROM q LEFT JOIN r ON r.query_id = q.query_id AND r.file_id = q.file_id GROUP BY ALL), k AS (SELECT unnest([1, 5, 10]) AS k) "
    "SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM x, k GROUP BY k",
)
def metrics_single(spark, d):
    ranked = _ranked(spark, d)
    relevant = ranked.groupBy("query_id").agg(F.min("file_id").alias("file_id"))
    out = M.single_relevant(S.relevant_rank(ranked, relevant, "query_id", "file_id", "rank"), "relevant_rank", [1, 5, 10])
    return out.select("k", *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg")])


def _outcomes(spark, d) -> DataFrame:
    """Files whose id begins with a small hexadecimal digit count as relevant; the query's last digit is its type."""
    ranked = S.best_per_file(_ranked(spark, d), "query_id", "file_id", "rank")
    hits = ranked.filter(F.substring("file_id", 1, 1).isin("0", "1", "2", "3"))
    return hits.groupBy("query_id").agg(F.collect_list(F.when(F.col("rank") <= 10, F.col("rank"))).alias("ranks"), F.count(F.lit(1)).alias("relevant")).withColumn("kind", F.right("query_id", F.lit(1)))


_SCORES = f"""{_RANKED}, f AS (SELECT query_id, file_id, min(rank) AS m FROM r GROUP BY ALL),
b AS (SELECT query_id, file_id, row_number() OVER (PARTITION BY query_id ORDER BY m, file_id) AS rank FROM f),
o AS (SELECT query_id, right(query_id, 1) AS kind, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos, count(*) OVER (PARTITION BY query_id) AS rel FROM b WHERE substr(file_id, 1, 1) IN ('0', '1', '2', '3')),
k AS (SELECT unnest([1, 5, 10]) AS k),
ideal AS (SELECT n, (SELECT sum(1.0::DOUBLE / log2(i + 1)) FROM range(1, n + 1) t(i)) AS g FROM range(1, 11) u(n)),
per AS (SELECT query_id, kind, CAST(k AS INTEGER) AS k, max(rel) AS rel, least(max(rel), k) AS bound, count(*) FILTER (rank <= k) AS n, min(rank) FILTER (rank <= k) AS best,
        coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= k), 0) AS dcg, coalesce(sum(pos::DOUBLE / rank) FILTER (rank <= k), 0) AS prec FROM o, k GROUP BY query_id, kind, k),
scored AS (SELECT per.query_id, per.kind, per.k, CASE WHEN per.n > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(1.0::DOUBLE / best, 0) AS mrr, per.n::DOUBLE / rel AS recall, dcg / g AS ndcg, prec / bound AS map, CASE WHEN per.n = rel THEN 1.0::DOUBLE ELSE 0 END AS complete
           FROM per JOIN ideal ON ideal.n = per.bound)"""
_AVG = ", ".join(f"round(avg({m}), 6) AS {m}" for m in M.METRICS)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in M.METRICS else F.col(c) for c in df.columns])


@query("metrics_by_type", f"WITH {_SCORES} SELECT kind, k, count(*) AS queries, {_AVG} FROM scored GROUP BY kind, k")
def metrics_by_type(spark, d):
    return _rounded(M.averaged(M.per_query(_outcomes(spark, d), "query_id", "ranks", "relevant", [1, 5, 10], ["kind"]), ["kind"]))


@query("metrics_macro", f"WITH {_SCORES}, t AS (SELECT kind, k, {', '.join(f'avg({m}) AS {m}' for m in M.METRICS)} FROM scored WHERE kind IN ('1', '2', '3') GROUP BY kind, k) SELECT k, count(*) AS types, {_AVG} FROM t GROUP BY k")
def metrics_macro(spark, d):
    return _rounded(M.macro(M.per_query(_outcomes(spark, d), "query_id", "ranks", "relevant", [1, 5, 10], ["kind"]), "kind", ["1", "2", "3"]))


@query(
    "annotation_coverage",
    "WITH n AS (SELECT lower(file_name) AS key, count(DISTINCT id) AS n, min(id) AS id FROM files GROUP BY ALL), w AS (SELECT doc_id, lower(file_name) AS key FROM documents) "
    "SELECT doc_id, CASE WHEN n.n IS NULL THEN 'missing' WHEN n.n > 1 THEN 'ambiguous' ELSE 'eligible' END AS coverage, CASE WHEN n.n = 1 THEN n.id END AS file_id FROM w LEFT JOIN n ON n.key = w.key",
)
def annotation_coverage(spark, d):
    files = table(spark, d, "files").select("id", I.file_name_key(F.col("file_name")).alias("key")).distinct()
    wanted = table(spark, d, "documents").select("doc_id", I.file_name_key(F.col("file_name")).alias("key"))
    return C.annotation_coverage(wanted, files, "key").select("doc_id", "coverage", "file_id")


@query(
    "variant_coverage",
    "WITH v AS (SELECT DISTINCT regexp_replace(lower(regexp_replace(file_name, '\\.[^.]+$', '')), '[^\\p{L}\\p{N}]', '', 'g') AS key, format_key AS fmt, path_key AS logical_id FROM files WHERE file_type = 'text'), "
    "f AS (SELECT key, fmt, count(*) AS n, min(logical_id) AS lo, max(logical_id) AS hi FROM v GROUP BY ALL), g AS (SELECT key, max(n) AS most, min(lo) AS lo, max(hi) AS hi, list(DISTINCT fmt) AS fmts FROM f GROUP BY ALL), "
    "w AS (SELECT DISTINCT h.query_id, v.key FROM hits h JOIN (SELECT DISTINCT id, regexp_replace(lower(regexp_replace(file_name, '\\.[^.]+$', '')), '[^\\p{L}\\p{N}]', '', 'g') AS key FROM files WHERE file_type = 'text') v ON v.id = h.file_id), "
    "j AS (SELECT w.query_id, coalesce(g.most = 1 AND g.lo = g.hi, false) AS good, len(list_filter(['docx', 'html', 'md', 'pdf', 'pptx'], lambda x: NOT list_contains(g.fmts, x))) AS lacking FROM w LEFT JOIN g ON g.key = w.key) "
    "SELECT query_id, count(*) AS relevant, count(*) FILTER (good) AS covered, CAST(sum(CASE WHEN good THEN lacking ELSE 0 END) AS BIGINT) AS missing_formats, CASE WHEN count(*) FILTER (good) = 0 THEN 'skipped' WHEN bool_and(good) THEN 'fully' ELSE 'partially' END AS state FROM j GROUP BY query_id",
)
def variant_coverage(spark, d):
    stem = I.identity_key(F.regexp_replace("file_name", r"\.[^.]+$", ""))
    text = table(spark, d, "files").filter("file_type = 'text'").withColumn("key", stem)
    variants = text.select("key", F.col("format_key").alias("fmt"), F.col("path_key").alias("logical_id")).distinct()
    wanted = table(spark, d, "hits").select("query_id", F.col("file_id").alias("id")).distinct().join(text.select("id", "key").distinct(), "id").select("query_id", "key").distinct()
    return C.variant_coverage(wanted, variants, "query_id", "key", ["docx", "html", "md", "pdf", "pptx"])


@query("latency", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events WHERE value IS NOT NULL GROUP BY ALL")
def latency(spark, d):
    return M.latency(table(spark, d, "events"), "value", ["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "p99")])


@query("benchmark_summary", "SELECT event_type, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS high FROM events GROUP BY ALL")
def benchmark_summary(spark, d):
    return M.benchmark_summary(table(spark, d, "events"), "value", ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "mean", "median", "p95", "high")])


@query(
    "stage_profile",
    "WITH s AS (SELECT event_type, count(*) AS calls, sum(user_id) AS items, sum(value) AS total, median(value) AS median, quantile_cont(value, 0.95) AS p95, max(value) AS longest, count(*) FILTER (value > 90) AS errors FROM events GROUP BY ALL) "
    "SELECT event_type, calls, CAST(items AS BIGINT) AS items, round(total, 4) AS total, round(median, 6) AS median, round(p95, 6) AS p95, round(longest, 6) AS longest, errors, round(total / (SELECT max(total) FROM s), 6) AS share, round(items / total, 6) AS rate FROM s",
)
def stage_profile(spark, d):
    out = M.stage_profile(table(spark, d, "events"), "event_type", "value", "user_id", F.col("value") > 90)
    return out.select("event_type", "calls", "items", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("median", "p95", "longest")], "errors", *[F.round(c, 6).alias(c) for c in ("share", "rate")])


@query(
    "resource_summary",
    "SELECT event_type, round(avg(value), 6) AS average, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS peak, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS change, round(avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS active FROM events GROUP BY ALL",
)
def resource_summary(spark, d):
    out = M.resource_summary(table(spark, d, "events"), "event_id", "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("average", "p95", "peak", "change", "active")])


def queries() -> dict[str, Query]:
    return QUERIES | cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | cases.SQL
