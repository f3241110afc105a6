"""Retrieval annotations: captions in wide CSV or nested JSON, and document questions in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.identity import file_name_key, identity_key, query_key, query_type_of


def _csv(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return table.toDF(*[c.lstrip("\ufeff") for c in table.columns])


def wide_captions(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, position, caption) from columns caption_1 … caption_n, in the order of their numbers; a missing cell is an error."""
    table = _csv(spark, path)
    columns = sorted((c for c in table.columns if c.startswith("caption_")), key=lambda c: (not c[8:].isdigit(), int(c[8:]) if c[8:].isdigit() else 0, c))
    if "file_name" not in table.columns or not columns:
        raise ValueError("captions need file_name and caption columns")
    cells = F.posexplode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("position", "caption")
    long = table.select("file_name", cells)
    checked = F.when(F.col("caption").isNull() | (F.trim("caption") == ""), F.raise_error(F.concat(F.lit("missing caption of "), F.col("file_name")))).otherwise(F.col("caption"))
    return long.select("file_name", "position", checked.alias("caption"))


def nested_captions(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, caption, annotation_id) from images joined with their annotations; a reference to no image, or an image id twice, is an error."""
    schema = "images array<struct<id:bigint,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,caption:string>>"
    data = spark.read.option("multiLine", True).schema(schema).json(path)
    images = data.select(F.explode("images").alias("i")).groupBy("i.id").agg(F.count(F.lit(1)).alias("n"), F.min("i.file_name").alias("file_name"))
    notes = data.select(F.explode("annotations").alias("a")).select("a.*")
    joined = notes.join(images.withColumnRenamed("id", "image_id"), "image_id", "left")
    name = F.when(F.col("n").isNull(), F.raise_error(F.concat(F.lit("annotation refers to no image: "), F.col("image_id").cast("string")))).when(F.col("n") > 1, F.raise_error(F.lit("an image id occurs twice"))).otherwise(F.col("file_name"))
    return joined.select(name.alias("file_name"), F.trim("caption").alias("caption"), F.col("id").alias("annotation_id"))


def document_questions(spark: SparkSession, path: str, official: list[str]) -> DataFrame:
    """(query_id, enterprise, query_type, query, files): rows of the same enterprise and query are one question whose files are united.

    A type outside ``official`` is Other, a blank one an error, and so are two types of one question.
    """
    table = _csv(spark, path)
    needed = ["Enterprise Name", "Query Type", "Query", "Supporting Facts"]
    if lacking := [c for c in needed if c not in table.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    kind = query_type_of(F.col("Query Type"), official)
    facts = F.from_json("Supporting Facts", "array<struct<filename:string>>")
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.trim("Enterprise Name").alias("enterprise"), F.trim("Query").alias("query"), kind.alias("query_type"), F.posexplode(facts).alias("pos", "fact"))
    rows = rows.withColumn("file", file_name_key(F.col("fact.filename")))
    first = rows.groupBy(identity_key(F.col("enterprise")).alias("e"), query_key(F.col("query")).alias("q"), "file").agg(
        F.min(F.struct("row", "pos")).alias("at"), F.min("enterprise").alias("enterprise"), F.min("query").alias("query"), F.min("query_type").alias("low"), F.max("query_type").alias("high")
    )
    merged = first.groupBy("e", "q").agg(F.min("enterprise").alias("enterprise"), F.min("query").alias("query"), F.min("low").alias("low"), F.max("high").alias("high"), F.transform(F.sort_array(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    one = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("a question has two types"))).otherwise(F.col("low"))
    return merged.select(F.concat_ws(":", "e", "q").alias("query_id"), "enterprise", one.alias("query_type"), "query", "files")


#: Target -> reader of its annotations.
READERS = {"image": nested_captions, "audio": wide_captions, "text": document_questions}


def annotations(spark: SparkSession, target: str, path: str, *more) -> DataFrame:
    """Annotations of a target in the form they are published in."""
    if target not in READERS:
        raise ValueError(f"no annotations are known for {target!r}")
    return READERS[target](spark, path, *more)
