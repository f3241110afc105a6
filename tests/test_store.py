"""Store, library and stream on small tables."""

import pytest
from pyspark.sql import types as T

from shelfmark.operators.filters import Condition, Predicate
from shelfmark.operators.store import Store, VectorConfig
from shelfmark.plans.query_language import parse_query
from shelfmark.plans.requests import Request, interactive_request
from shelfmark.plans.service import FILES, SEGMENTS, Library
from shelfmark.session import publish_file
from shelfmark.streaming.ingest import upsert_stream

PAYLOAD = T.StructType([T.StructField("kind", T.StringType()), T.StructField("size", T.IntegerType())])


@pytest.fixture()
def store(spark, tmp_path):
    with Store(spark, f"file://{tmp_path}/store", buckets=4) as s:
        s.create("c", PAYLOAD, [VectorConfig("v", 2)])
        yield s


def rows(spark, *data):
    return spark.createDataFrame(list(data), "id string, kind string, size int, vec_v array<float>")


def test_records(spark, store):
    store.upsert("c", rows(spark, ("a", "x", 1, [1.0, 0.0]), ("b", "y", 2, [0.0, 1.0]), ("c", None, 3, None)))
    store.upsert("c", rows(spark, ("a", "z", 9, [1.0, 1.0])))
    store.upsert("c", rows(spark))
    assert store.count("c") == 3
    assert store.retrieve("c", ["a", "nope"]).collect()[0].asDict() == {"id": "a", "kind": "z", "size": 9}
    assert [r.id for r in store.search("c", [0.0, 1.0], "v", 5).collect()] == ["b", "a"]
    assert store.count("c", Predicate(none_of=(Condition("kind", "equal", "y"),))) == 2
    page, after = store.scroll("c", limit=2)
    assert [r.id for r in page.collect()] == ["a", "b"] and after == "c"
    page, after = store.scroll("c", limit=2, offset="c")
    assert [r.id for r in page.collect()] == ["c"] and after is None
    store.delete("c", ["b", "nope"])
    store.delete_by_filter("c", Predicate(all_of=(Condition("size", "gt", 5),)))
    assert [r.id for r in store.read("c").collect()] == ["c"]
    with pytest.raises(ValueError):
        store.delete_by_filter("c", Predicate())
    with pytest.raises(Exception, match="finite"):
        store.upsert("c", rows(spark, ("q", "x", 1, [float("nan"), 0.0])))


def test_ensure(spark, store):
    store.ensure("c", PAYLOAD, [VectorConfig("v", 2), VectorConfig("w", 3)])
    assert "vec_w" in store.schema("c").fieldNames()
    with pytest.raises(ValueError):
        store.ensure("c", PAYLOAD, [VectorConfig("v", 3)])
    with pytest.raises(ValueError):
        VectorConfig("v", 0)
    assert store.search("none", [1.0], "v").count() == 0


def test_stream(spark, store, tmp_path):
    rows(spark, ("a", "x", 1, [1.0, 0.0])).write.parquet(f"{tmp_path}/in")
    schema = "id string, kind string, size int, vec_v array<float>"
    for expected in (1, 1):
        upsert_stream(spark, f"{tmp_path}/in", schema, store, "c", f"{tmp_path}/check").awaitTermination()
        assert store.count("c") == expected
    rows(spark, ("b", "x", 1, None)).write.mode("append").parquet(f"{tmp_path}/in")
    upsert_stream(spark, f"{tmp_path}/in", schema, store, "c", f"{tmp_path}/check").awaitTermination()
    assert store.count("c") == 2


def test_library(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Harbour\n\nThe crane lifts boats.\n\n# Bees\n\nHoney in the hive.")
    (docs / "b.html").write_text("<h1>Lamps</h1><p>Invoices for lamps.</p>")
    (docs / "bad.docx").write_text("nothing")
    library = Library(spark, f"file://{tmp_path}/lib")
    report = {r.path.rsplit("/", 1)[1]: (r.change, r.error) for r in library.index(str(docs)).collect()}
    assert report["a.md"] == ("new", None) and "ParseError" in report["bad.docx"][1]
    assert {r.file_name: r.segment_count for r in library.store.read(FILES).collect()} == {"a.md": 2, "b.html": 1}
    best = library.search(Request("text", text="honey hive bees"), 1).collect()[0]
    assert best.heading == "Bees" and best.path.endswith("a.md")
    assert library.search(interactive_request("lamps format:html", "text"), 5).count() == 1
    groups = library.search(Request("text", text="boats harbour"), 2, grouped=True).collect()
    assert groups[0].matches[0] == 0 and len(groups) == 2
    assert {r.change for r in library.plan(str(docs)).collect()} == {"unchanged", "new"}
    (docs / "a.md").write_text("# Harbour\n\nOnly this.")
    assert {r.path.rsplit("/", 1)[1]: r.change for r in library.index(str(docs)).collect()}["a.md"] == "updated"
    assert library.store.count(SEGMENTS) == 2
    (docs / "copy.html").write_text((docs / "b.html").read_text())
    library.index(str(docs)).count()
    assert library.duplicates().collect()[0].copies == 2
    library.remove(library.store.read(FILES).filter("file_name = 'a.md'").select("id"))
    assert library.store.count(FILES) == 2 and library.store.count(SEGMENTS) == 2


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ("format:png", "text is required"), ("x width:1", "Unknown filter: width"), ("x format:", "requires a value"), ("x min-res:big", "expected WIDTHxHEIGHT"), ("x after:2025-13", "Invalid after date"),
        ("x after:2026 before:2025", "after must be earlier"), ("x format:a format:b", "only be used once"), ("x sample-rate:0", "must be positive"), ("x bitrate:fast", "expected a positive integer"),
        ("x longer-than:-1", "non-negative"), ("x shorter-than:0", "must be positive"), ("x longer-than:nan", "non-negative"), ("x shorter-than:inf", "must be positive"), ('"open', "No closing quotation"),
        ("x longer-than:30 shorter-than:10", "longer-than must be less"),
    ],
)
def test_query_errors(query, message):
    with pytest.raises(ValueError, match=message):
        parse_query(query)


def test_query_words():
    parsed = parse_query("C:\\dir it's \"two words\" name:'my file' min-res:10×20 after:2024")
    assert parsed.text == "C:\\dir it's two words" and parsed.metadata.name_contains == "my file"
    assert (parsed.metadata.min_width, parsed.metadata.min_height) == (10, 20) and parsed.metadata.modified_after.year == 2024


def test_buckets_belong_to_the_collection(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = Store(spark, root, buckets=16)
    first.create("c", PAYLOAD, [VectorConfig("v", 2, "euclid")])
    first.upsert("c", spark.range(200).selectExpr("cast(id as string) as id", "'x' as kind", "cast(id as int) as size", "array(cast(id as float), 0f) as vec_v"))
    other = Store(spark, root, buckets=64)
    other.upsert("c", rows(spark, ("7", "y", -7, [7.0, 1.0])))
    assert other.count("c") == 200 and other.retrieve("c", ["7"]).first().size == -7
    # Several vectors on a collection of distances: the smallest counts.
    assert [(r.id, r.score) for r in other.search("c", [[3.0, 0.0], [9.0, 0.5]], "v", 2).collect()] == [("3", 0.0), ("9", 0.5)]


def test_children_by_parent(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=8)
    store.create("c", T.StructType([T.StructField("parent_id", T.StringType()), T.StructField("n", T.IntegerType())]), bucket_by="parent_id")
    make = lambda *data: spark.createDataFrame(list(data), "id string, parent_id string, n int")
    store.upsert("c", make(*[(f"{p}{k}", p, k) for p in "abcdefgh" for k in range(3)]))
    before = dict(store._manifest("c")["parts"])
    store.replace_children("c", make(("a9", "a", 9)), spark.createDataFrame([("a",), ("none",)], "id string"))
    assert sorted(r.id for r in store.read("c").filter("parent_id = 'a'").collect()) == ["a9"] and store.count("c") == 22
    after = store._manifest("c")["parts"]
    assert sum(before[b] != after.get(b) for b in before) <= 2
    store.delete("c", ["b1", "zz"])
    store.upsert("c", make(("b2", "h", 5)))
    assert store.count("c") == 21 and [r.parent_id for r in store.retrieve("c", ["b2"]).collect()] == ["h"]
    with pytest.raises(Exception, match="parent"):
        store.replace_children("c", make(("q", " ", 1)), spark.createDataFrame([("a",)], "id string"))


def test_one_of_two_writers_fails(spark, tmp_path):
    path = f"file://{tmp_path}/m/0.json"
    assert publish_file(spark, path, "a") and not publish_file(spark, path, "b")
    assert (tmp_path / "m" / "0.json").read_text() == "a" and [p.name for p in tmp_path.iterdir()] == ["m"]
