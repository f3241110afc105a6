"""Queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import cases
from shelfmark.llm.encode import encode_column
from shelfmark.llm.language import departing_languages, dominant_language, fit, segment_languages
from shelfmark.llm.markup import clean_markup
from shelfmark.llm.neardup import class_members, near_duplicates, normal_texts
from shelfmark.llm.packing import pack_containers
from shelfmark.llm.sentences import split_sentences
from shelfmark.llm.topn import top_n_per_group
from shelfmark.llm.vectors import similar_vectors

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select("vec_id", "vector_name", "vectors") for t in ("prepared_files", "prepared_segments")]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.85 or more of which one is among the five most alike of the other."""
    near = similar_vectors(_vectors(spark, sf_dir), "vec_id", "vector_name", "vectors", k=5, min_cosine=0.85, length=10)
    return near.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()


P1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, vector_name, vectors::DOUBLE[] AS v FROM (SELECT vec_id, vector_name, vectors FROM prepared_files UNION ALL SELECT vec_id, vector_name, vectors FROM prepared_segments)
           WHERE vec_id IS NOT NULL AND vector_name IS NOT NULL AND len(vectors) = 64 AND len(list_filter(vectors, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vectors, lambda x: x <> 0)) > 0),
c AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS cosine FROM v a JOIN v b ON a.vector_name = b.vector_name AND a.vec_id <> b.vec_id),
near AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM near WHERE cosine >= 0.85
"""


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most alike of all vectors for every vector whose id is divisible by 50, without a least similarity."""
    return similar_vectors(_vectors(spark, sf_dir), "vec_id", "vector_name", "vectors", k=5, queries=F.col("vec_id") % 50 == 0)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best results of every query, the same ones in every run."""
    top = top_n_per_group(table(spark, sf_dir, "hits"), "query_id", "score", ["file_id", "segment_index"], "hit_id", 5)
    return top.select("query_id", "hit_id")


P3_SQL = """
WITH ok AS (SELECT query_id, hit_id, file_id, segment_index, score FROM hits WHERE score IS NOT NULL AND isfinite(score) AND file_id IS NOT NULL),
once AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY query_id, file_id, segment_index ORDER BY score DESC, hit_id) = 1)
SELECT query_id, hit_id FROM once
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id, segment_index NULLS FIRST, hit_id) <= 5
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole paragraphs of chunks that the label of the file doesn't name."""
    model = fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    segments = segment_languages(table(spark, sf_dir, "chunks"), ["file_id", "chunk_index"], "text", model)
    return departing_languages(segments, table(spark, sf_dir, "document_meta"), "file_id", "chunk_index", "language").select("file_id", "chunk_index", "lang")


def p4_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dominant language and confidence of every document that has letters."""
    docs = table(spark, sf_dir, "documents")
    return dominant_language(segment_languages(docs, ["doc_id"], "text", fit(docs, "doc_id", "text", "lang")), "doc_id")


def _p5(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    """An operator of near-duplicates on chunks (of different files) and on paths of text files."""
    chunks = table(spark, sf_dir, "chunks").select("file_id", F.concat_ws("#", "file_id", "chunk_index").alias("key"), "text")
    paths = table(spark, sf_dir, "files").filter("file_type = 'text'").select("id", "path_key")
    by_chunk = operator(normal_texts(chunks, "text"), "key", "text", "file_id", width=5, threshold=0.7, bands=50, rows=6)
    return by_chunk, operator(paths, "id", "path_key", "id", width=3, threshold=0.8, bands=44, rows=9)


def _kinds(by_chunk: DataFrame, by_path: DataFrame, *columns: str) -> DataFrame:
    kinds = [df.select(F.lit(kind).alias("record_kind"), *columns) for kind, df in (("chunk", by_chunk), ("path", by_path))]
    return kinds[0].unionByName(kinds[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and paths of different files that are nearly the same."""
    return _kinds(*_p5(spark, sf_dir, near_duplicates), "key_a", "key_b")


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk and path with its class of exact copies and the number of classes it is linked to."""
    return _kinds(*_p5(spark, sf_dir, class_members), "key", "class_id", "copies", "links")


P5_SQL = """
WITH t AS (
  SELECT DISTINCT 'chunk' AS kind, 5 AS w, 0.7 AS least, file_id AS grp, file_id || '#' || chunk_index AS key,
         trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS text FROM chunks
  UNION SELECT DISTINCT 'path', 3, 0.8, id, id, path_key FROM files WHERE file_type = 'text'),
ok AS (SELECT *, row_number() OVER () AS n FROM t WHERE text <> '' AND key IS NOT NULL),
s AS (SELECT DISTINCT kind, n, unnest(list_transform(range(1, greatest(length(text) - w + 1, 1) + 1), lambda i: array_slice(text, i, i + w - 1))) AS g FROM ok),
size AS (SELECT n, count(*) AS c FROM s GROUP BY n),
common AS (SELECT a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.kind = b.kind AND a.g = b.g AND a.n < b.n GROUP BY ALL)
SELECT DISTINCT x.kind AS record_kind, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b
FROM common JOIN size p ON p.n = na JOIN size q ON q.n = nb JOIN ok x ON x.n = na JOIN ok y ON y.n = nb
WHERE x.grp <> y.grp AND common.c >= x.least * (p.c + q.c - common.c)
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with leftover markup, with the role the markup gives them."""
    return clean_markup(table(spark, sf_dir, "blocks"), "block_id", "text", "block_type").filter("had_markup").select("block_id", "block_type")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, sf_dir, "documents"), ["doc_id"], "text", "byte_bpe_50k")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of every capacity of context_sizes (a table of few rows) with the documents they hold."""
    capacities = {r.context_name: r.capacity_tokens for r in table(spark, sf_dir, "context_sizes").collect()}
    return pack_containers(table(spark, sf_dir, "documents"), "doc_id", "text", capacities, group="lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, sf_dir, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p3_found": p3_found, "p4_found": p4_found, "p4_documents": p4_documents, "p5_found": p5_found, "p5_members": p5_members, "p6_found": p6_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found} | cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL} | cases.SQL
