"""Core operators: change tracking, timestamps, predicates, search, metrics, chunks, text, media."""

import datetime as dt
import io
import struct
import wave
import zlib
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import identity as I
from shelfmark.functions import text as X
from shelfmark.operators import catalog as C
from shelfmark.operators import metrics as M
from shelfmark.operators import search as S
from shelfmark.operators.chunking import chunk_blocks, chunk_document, split_sentences
from shelfmark.operators.filters import Condition, MetadataQuery, Predicate, apply_predicate
from shelfmark.operators.incremental import ChangeTracker
from shelfmark.operators.ranking import percentiles, rank_within
from shelfmark.operators.timestamps import normalise_timestamps, parser_of, utc_micros, zone_offsets, zone_table
from shelfmark.plans.fields import day_edge
from shelfmark.plans.requests import interactive_request, structured_request
from shelfmark.sources.media import audio_metadata, decode_wav, image_metadata, media_metadata

# ---- change tracking --------------------------------------------------------------------------

SCANS = "scan_id bigint, file_id string, content_hash string, seen_at timestamp, arrived_at timestamp, pending int"
FILES = "id string, content_hash string, indexed_at timestamp, run_id int, entry_at string"
RUNS = "run_id int, run_status string, finished_at timestamp"


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


def tables(spark, scans, files, runs):
    return (
        spark.createDataFrame([(*s, 0) for s in scans], SCANS),
        spark.createDataFrame([(*f, "clash") for f in files], FILES),
        spark.createDataFrame(runs, RUNS),
    )


def test_change_tracker(spark, tmp_path):
    scans = [(1, "a", "SHA256:AA", at(1), at(2)), (2, "b", "bb", at(1), at(2)), (3, "c", None, at(1), at(2)), (4, None, "xx", at(1), at(2)), (5, "d", "dd", at(1), at(2)), (5, "d", "dd", at(1), at(2))]
    files = [("a", "aa", at(3), 1), ("b", "old", at(3), 1), ("d", "dd", at(3), 2), (None, "q", at(3), 1)]
    runs = [(1, "succeeded", at(4)), (2, "failed", at(4)), (3, "running", None)]
    tracker = ChangeTracker(spark, f"file://{tmp_path}/log")
    assert tracker.pending().count() == 0
    first = tracker.advance(*tables(spark, scans, files, runs))
    state = lambda: {r.id: r.content_hash for r in tracker.pending().collect()}
    assert state() == {"b": "bb", "d": "dd"}
    # Nothing new: nothing is published.
    assert tracker.advance(*tables(spark, scans, files, runs)) == first
    # A late arrival with an old event time, and a run that succeeds later, are both seen; nothing is repeated.
    scans += [(6, "e", "ee", at(0), at(6)), (7, "a", "a2", at(0), at(6))]
    files += [("b", "bb", at(5), 4)]
    runs += [(4, "succeeded", at(6))]
    tracker.advance(*tables(spark, scans, files, runs))
    assert state() == {"d": "dd", "e": "ee"}
    # Only what the increment touched: 'd' waits since the first one.
    assert {r.id for r in tracker.changed().collect()} == {"e"}


def test_change_tracker_merges_its_deltas(spark, tmp_path):
    tracker = ChangeTracker(spark, f"file://{tmp_path}/log", compact_after=2)
    scans, parts = [], []
    for k in range(6):
        scans.append((k, f"f{k % 4}", f"{k}", at(k + 1), at(k + 1)))
        parts.append(len(tracker.advance(*tables(spark, scans, [("f1", "1", at(9), 1)], [(1, "succeeded", at(9))])).parts))
    assert parts == [1, 2, 3, 1, 2, 3]
    assert {r.id: r.content_hash for r in tracker.pending().collect()} == {"f0": "4", "f1": "5", "f2": "2", "f3": "3"}


def test_change_tracker_survives_a_crash(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/log"
    tracker = ChangeTracker(spark, root)
    data = tables(spark, [(1, "a", "aa", at(1), at(2))], [], [(1, "succeeded", at(1))])
    monkeypatch.setattr(tracker.log, "publish", lambda commit: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        tracker.advance(*data)
    again = ChangeTracker(spark, root)
    assert again.pending().count() == 0
    commit = again.advance(*data)
    assert [tuple(r) for r in again.pending().collect()] == [("a", "aa")]
    # The same number can't be published twice.
    with pytest.raises(RuntimeError):
        again.log.publish(commit)
    empty = ChangeTracker(spark, f"file://{tmp_path}/empty")
    empty.advance(*(t.limit(0) for t in data))
    assert empty.pending().count() == 0


# ---- timestamps -------------------------------------------------------------------------------

CASES = [
    ("2021-03-14 02:30:00", "America/New_York", "2021-03-14 07:30:00"), ("2021-11-07 01:30:00", "America/New_York", "2021-11-07 05:30:00"), ("D:20201101012100-07'00'", None, "2020-11-01 08:21:00"), ("D:20201101012100", "Asia/Tokyo", "2020-10-31 16:21:00"),
    ("11/02/2019 5:07 PM", "America/New_York", "2019-11-02 21:07:00"), ("30/04/2023 21:47", "Europe/London", "2023-04-30 20:47:00"), ("30/04/2023 21:47", None, "2023-04-30 21:47:00"), ("30/04/2023 21:47", "America/Bogota", None), ("Mon, 03 Sep 2018 09:16:38 +0200", None, "2018-09-03 07:16:38"),
    ("1602481245", "x", "2020-10-12 05:40:45"), ("1602481245506", "x", "2020-10-12 05:40:45.506"), ("1602481245506563", "x", "2020-10-12 05:40:45.506563"), ("20221120", "America/New_York", "2022-11-20 05:00:00"), ("December 13, 2021 12:08:47 AM", "Europe/Berlin", "2021-12-12 23:08:47"),
    ("19 November 2018", "Asia/Kolkata", "2018-11-18 18:30:00"), ("2021-05-07 11:24:43 CEST", "Europe/Berlin", "2021-05-07 09:24:43"), ("2023-12-26 00:52:37 PST", None, "2023-12-26 08:52:37"), ("2023-04-30T07:57:34.363828444Z", None, "2023-04-30 07:57:34.363828"), ("  2022-01-09T16:10:10 ", "UTC", "2022-01-09 16:10:10"),
    ("2022:08:17 17:09:51", "Europe/Berlin", "2022-08-17 15:09:51"), ("1.7.2018 22:02:44", None, "2018-07-01 22:02:44"), ("2019-07-20", "Europe/Istanbul", "2019-07-19 21:00:00"), ("2023-02-27 09:00:56.930+0000", "x", "2023-02-27 09:00:56.930"), ("2024-02-29", None, "2024-02-29 00:00:00"),
    ("2023-02-29", None, None), ("0000-00-00 00:00:00", None, None), ("2021-13-45", None, None), ("yesterday", None, None), ("", None, None), (None, None, None), ("-", None, None), ("2020-01-01 00:00", "Nowhere/Land", None), ("2020-01-01 24:00", None, None), ("x" * 100, None, None), ("11/02/2019 13:07 PM", None, None), ("2020-01-01 00:00:00 XYZ", None, None),
    ("2150-07-01 12:00:00", "America/New_York", "2150-07-01 16:00:00"), ("9150-01-01 12:00:00", "America/New_York", "9150-01-01 17:00:00"), ("1850-01-01 00:00:00", "Europe/Berlin", "1849-12-31 23:06:32"), ("1602481245506563999", None, "2020-10-12 05:40:45.506563"), ("9999999999999999999", None, None),
    ("Thu Nov 26 2026 14:12:00 GMT+0100 (Central European Standard Time, as the machine calls it)", "Asia/Tokyo", "2026-11-26 13:12:00"), ("Thu Nov 26 2026 14:12:00 XYZ+0100", None, None), ("2020-01-01 00:00" + " " * 100, None, "2020-01-01 00:00:00"),
]


def test_timestamp_cases():
    got = utc_micros([c[0] for c in CASES], [c[1] for c in CASES])
    want = [None if c[2] is None else (dt.datetime.fromisoformat(c[2]) - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for c in CASES]
    assert [(c[:2], g) for c, g in zip(CASES, got)] == [(c[:2], w) for c, w in zip(CASES, want)]
    assert parser_of("9999-99-99") is parser_of("9999-99-99")


def test_zone_tables_agree_with_the_database():
    rng = np.random.default_rng(1)
    for name in ("America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney", "America/Bogota", "Africa/Casablanca", "UTC"):
        thresholds, offsets = zone_table(name)
        zone = zoneinfo.ZoneInfo(name)
        for second in rng.integers(-(10**9), 4 * 10**9, 400).tolist():
            local = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=second)
            assert offsets[np.searchsorted(thresholds, second, side="right")] == local.replace(tzinfo=zone).utcoffset().total_seconds(), (name, local)


def test_offsets_of_late_years():
    rng = np.random.default_rng(2)
    begin, end = ((dt.datetime(y, 1, 1) - dt.datetime(1970, 1, 1)).days * 86400 for y in (2090, 9999))
    for name in ("America/New_York", "Australia/Sydney", "Africa/Casablanca", "Asia/Tokyo"):
        local = rng.integers(begin, end, 300)
        want = [(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s)).replace(tzinfo=zoneinfo.ZoneInfo(name)).utcoffset().total_seconds() for s in local.tolist()]
        assert zone_offsets(name, local).tolist() == want, name


def test_timestamp_table(spark):
    rows = [(1, "2020-01-01", None, "UTC"), (1, "2020-01-01", None, "UTC"), (2, None, "x", None)]
    df = spark.createDataFrame(rows, "meta_id bigint, a string, b string, zone_id string").withColumn("utc_us", F.lit("clash"))
    got = normalise_timestamps(df, "meta_id", ["a", "b"], "zone_id").collect()
    assert len(got) == 6 and sorted((r.meta_id, r.field_name) for r in got if r.utc_us is not None) == [(1, "a"), (1, "a")]
    assert normalise_timestamps(df.limit(0), "meta_id", ["a"], "zone_id").count() == 0


# ---- predicates and search --------------------------------------------------------------------


def test_predicates_with_missing_fields(spark):
    df = spark.createDataFrame([(1, "a", ["x"], (10,)), (2, None, None, None), (3, "ab", ["y", "x"], (20,))], "id int, name string, tags array<string>, metadata struct<width:int>")
    ids = lambda **groups: sorted(r.id for r in apply_predicate(df, Predicate(**groups)).collect())
    assert ids(none_of=(Condition("name", "equal", "a"),)) == [2, 3]
    assert ids(all_of=(Condition("tags", "contains", "x"),), none_of=(Condition("metadata.width", "gt", 15),)) == [1]
    assert ids(any_of=(Condition("name", "text_contains", "b"), Condition("metadata.width", "lte", 10))) == [1, 3]
    assert ids(all_of=(Condition("tags", "in", ["y"]),)) == [3] and ids(all_of=(Condition("id", "in", []),)) == [] and ids(all_of=(Condition("nope", "equal", 1),)) == [] and ids() == [1, 2, 3]
    assert MetadataQuery().predicate() is None
    with pytest.raises(TypeError):
        Condition("a", "in", "text")
    with pytest.raises(ValueError):
        Condition("a", "like", 1)
    plan = apply_predicate(spark.read.parquet("/root/testdata/sf0.001/files.parquet").select("size_bytes", "file_type"), Predicate(all_of=(Condition("size_bytes", "gte", 5), Condition("file_type", "equal", "text"))))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(size_bytes" in plan and "EqualTo(file_type" in plan


def test_search_merging_and_ranks(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.7, 0.7]), ("d", None), ("e", [1.0])], "id string, v array<float>")
    assert [r.id for r in S.top_k(df, "v", [1.0, 0.0], 2).collect()] == ["a", "c"]
    assert [r.id for r in S.top_k(df, "v", [1.0, 0.0], 2, "euclid").collect()] == ["a", "c"]
    assert [r.id for r in S.multi_vector_top_k(df, "v", [[1.0, 0.0], [0.0, 1.0]], 3).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        S.top_k(df, "v", [1.0, 0.0], 0)
    results = spark.createDataFrame([("q", "a-md", 1), ("q", "a-pdf", 2), ("q", "b-md", 3)], "q string, f string, rank int")
    logical = spark.createDataFrame([("a-md", "a"), ("a-pdf", "a"), ("b-md", "b")], "f string, logical_id string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b")], "q string, logical_id string")
    assert sorted((r.logical_id, r["rank"]) for r in S.logical_ranks(results, logical, relevant, "q", "f", "rank").collect()) == [("a", 1), ("b", 3)]


def test_metrics(spark):
    single = {r.k: r for r in M.single_relevant(spark.createDataFrame([(1,), (2,), (None,)], "rank int"), "rank", [1, 2]).collect()}
    assert single[1].mrr == pytest.approx(1 / 3) and single[2].mrr == pytest.approx(0.5) and single[2].ndcg == pytest.approx((1 + 1 / 1.584962500721156) / 3)
    outcomes = spark.createDataFrame([(1, [3, 1], 2), (2, [], 1)], "q int, ranks array<int>, n int")
    many = {r.k: r for r in M.averaged(M.per_query(outcomes, "q", "ranks", "n", [1, 3]), []).collect()}
    assert many[1].hit == 0.5 and many[1].recall == 0.25 and many[1].complete == 0.0
    assert many[3].map == pytest.approx((1 + 2 / 3) / 4) and many[3].complete == 0.5 and many[3].mrr == 0.5
    latency = M.latency(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").first()
    assert (latency["mean"], latency.p95, latency.p99) == (50.5, pytest.approx(95.05), pytest.approx(99.01))
    for bad in ([], [0]):
        with pytest.raises(ValueError):
            M.cutoffs(bad)
    assert M.cutoffs([5, 1, 5]) == [1, 5]


# ---- chunks, text, ids, ranges ----------------------------------------------------------------


def block(index, text, kind="paragraph", section=("S",), page=None, slide=None, line=None):
    return {"block_index": index, "block_type": kind, "text": text, "page_number": page, "slide_number": slide, "section_path": list(section), "source_line_start": line, "source_line_end": line}


def texts(blocks, most):
    return [c["text"] for c in chunk_document(blocks, most)]


def test_chunks():
    assert split_sentences("Dr. Örnek 3.14 değerini yazdı. 日本語です。العربية؟ Son.") == ["Dr. Örnek 3.14 değerini yazdı.", "日本語です。", "العربية؟", "Son."]
    assert texts([block(0, "İlk Türkçe cümle. 日本語です。 العربية؟ Son cümle.")], 20) == ["İlk Türkçe cümle.", "日本語です。 العربية؟", "Son cümle."]
    assert texts([block(0, "birinci ikinci üçüncü"), block(1, "satır_1\n\nsatır_2", "code")], 12) == ["birinci", "ikinci", "üçüncü", "satır_1", "satır_2"]
    assert texts([block(0, "a\n\nb", "code")], 50) == ["a\n\nb"] and texts([block(0, "çğışüöabcdef")], 5) == ["çğışü", "öabcd", "ef"] and texts([], 5) == []
    assert texts([block(0, "one.", page=1), block(1, "two.", page=2), block(2, "three.", section=("T",), page=2), block(3, "x", "list_item", slide=1), block(4, "y", "list_item", slide=1)], 99) == ["one.", "two.", "three.", "x\ny"]
    whole = chunk_document([block(0, "Low", "heading", ("Top", "Low"), line=1), block(1, "Body.", section=("Top", "Low"), line=3)], 100)[0]
    assert whole["embedding_text"] == "Top\n\nLow\n\nBody." and (whole["source_line_start"], whole["source_line_end"]) == (1, 3)
    with pytest.raises(ValueError):
        chunk_document([], 0)


def test_chunk_table(spark):
    blocks = spark.read.parquet("/root/testdata/sf0.001/blocks.parquet")
    chunks = chunk_blocks(blocks, "file_id", 120).collect()
    assert chunks and all(0 < len(c.text) <= 120 for c in chunks) and {c.file_id for c in chunks} == {r.file_id for r in blocks.select("file_id").distinct().collect()}
    assert chunk_blocks(blocks.limit(0), "file_id").count() == 0


def test_text_and_ids(spark):
    import uuid

    one = lambda column, value: spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]
    assert one(I.file_id, "/ä/b") == str(uuid.uuid5(I.FILE_NAMESPACE, "/ä/b")) and one(lambda c: I.segment_id(c, F.lit(3)), "/p") == str(uuid.uuid5(I.SEGMENT_NAMESPACE, "/p\x003"))
    assert [one(I.format_key, v) for v in (".JPG", "jfif", " tif ", "htm", "wave")] == ["jpeg", "jpeg", "tiff", "htm", "wav"]
    assert one(I.logical_document_id, "/Corp/docs/pdf/My File.pdf") == "/corp/docs/myfile" and one(I.enterprise_of, "/Corp/docs/pdf/f.pdf") == "docs"
    assert one(X.squeeze, " a  b\x00\n ") == "a b" and one(lambda c: X.keywords(c), "a; B,b ,,c") == ["a", "B", "c"]
    assert len(one(X.preview, "word " * 100)) == 280 and one(X.first_text, " ") is None
    seconds = spark.createDataFrame([(3725.5,), (65.25,), (5.0,)], "s double").select(X.timestamp_text(F.col("s")), X.duration_text(F.col("s"))).collect()
    assert [tuple(r) for r in seconds] == [("1:02:05.50", "1:02:05.50"), ("1:05.25", "1:05.25"), ("0:05.00", "5.00 s")]
    ranges = C.audio_ranges(spark.createDataFrame([("a", 12.0), ("b", 3.0), ("c", None), ("d", float("nan"))], "f string, d double"), "d", 10.0).select("f", "segment_index", "start_seconds", "end_seconds")
    assert sorted(tuple(r) for r in ranges.collect()) == [("a", 0, 0.0, 10.0), ("a", 1, 5.0, 12.0), ("b", 0, 0.0, 3.0)]


def test_batch_search_ties(spark):
    rows = spark.createDataFrame([(k, [1.0, 0.5 + (k >= 40)]) for k in reversed(range(60))], "id bigint, v array<float>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 0.5])], "query_id bigint, w array<float>")
    found = S.batch_top_k(rows, "id", "v", asked, "query_id", "w", 5).orderBy("rank").collect()
    assert [r.id for r in found] == [0, 1, 2, 3, 4]


def test_searches_of_a_query_set(spark):
    from shelfmark.queries import QUERIES

    data = "/root/testdata/sf0.001"
    rows = {r.vec_id: r for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    matrix = {k: np.array(r.embedding, dtype=np.float64) for k, r in rows.items()}
    value = {"cosine": lambda a, b: -(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), "dot": lambda a, b: -(a @ b), "euclid": lambda a, b: np.linalg.norm(a - b), "manhattan": lambda a, b: np.abs(a - b).sum()}
    asked = [k for k in rows if k % 50 == 0]
    for name, metric in value.items():
        want = {(q, k) for q in asked for _, k in sorted((round(float(metric(matrix[q], v)), 5), k) for k, v in matrix.items())[:10]}
        assert {(r.query_id, r.vec_id) for r in QUERIES[f"search_{name}_all"](spark, data).collect()} == want, name
    found = QUERIES["search_filtered_all"](spark, data).collect()
    assert {r.query_id for r in found} == set(asked) and {rows[r.vec_id].label for r in found} <= {1, 3, 5}
    assert {r.query_id for r in QUERIES["search_multi_vector_all"](spark, data).collect()} == {rows[q].label for q in asked}
    hits = spark.read.parquet(f"{data}/hits.parquet").filter("score is not null and not isnan(score) and abs(score) < double('inf') and file_id is not null and segment_index is not null")
    groups = QUERIES["group_by_parent_all"](spark, data).collect()
    assert {r.query_id for r in groups} == {r.query_id for r in hits.select("query_id").distinct().collect()}


def test_catalogue(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", None)], "path_key string, content_hash string")
    known = spark.createDataFrame([("a", "1"), ("b", "x")], "path_key string, content_hash string")
    assert {r.path_key: r.change for r in C.classify_changes(found, known).collect()} == {"a": "unchanged", "b": "updated", "c": "new", "d": "failed"}
    files = spark.createDataFrame([("1", "p2"), ("1", "p1"), ("1", "p1"), ("2", "p3"), (None, "p4"), (None, "p5")], "content_hash string, path_key string")
    assert [(r.copies, r.members) for r in C.duplicate_groups(files).collect()] == [(2, ["p1", "p2"])]
    assert [(r.copies, r.members) for r in C.duplicate_groups(files, most=1).collect()] == [(2, ["p1"])]


def test_large_duplicate_group_is_whole(spark):
    files = spark.range(10_500).select(F.lit("1").alias("content_hash"), F.format_string("p%05d", "id").alias("path_key"))
    group = C.duplicate_groups(files).first()
    assert group.copies == 10_500 and group.members == [f"p{k:05}" for k in range(10_500)]


# ---- requests and media -----------------------------------------------------------------------


def test_requests(tmp_path):
    assert day_edge("modified-before", "2024-05-06").time() == dt.time.max and day_edge("modified-after", "2024-05-06").time() == dt.time.min
    assert structured_request(text=" cat ", file_format="jpg").target == "image"
    for fields, message in (
        ({"text": "x"}, "file type is required"), ({}, "is required"), ({"text": "x", "target": "audio", "file_format": "png"}, "is image, not audio"), ({"text": "x", "target": "image", "min_resolution": "9x9", "max_resolution": "5x9"}, "cannot exceed"),
        ({"text": "x", "target": "audio", "duration_longer_than": float("inf")}, "finite"), ({"text": "x", "target": "text", "modified_after": "2025-01-02", "modified_before": "2025-01-01"}, "later than"), ({"text": "x", "target": "text", "sample_rate_hz": 5}, "audio target"),
    ):
        with pytest.raises(ValueError, match=message):
            structured_request(**fields)
    with pytest.raises(ValueError, match="does not exist"):
        interactive_request("./missing.wav", "audio", base=tmp_path)
    with pytest.raises(ValueError, match="not enabled"):
        (tmp_path / "a.pdf").write_text("")
        interactive_request("a.pdf", "text", base=tmp_path)


def wav(seconds=2.0, rate=100):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.full(int(seconds * rate) * 2, 16384, np.int16).tobytes())
    return out.getvalue()


def test_media(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 10, 6, 8, 2, 0, 0, 0) + b"\0\0\0\0" + b"IDAT" + zlib.compress(b"")
    assert image_metadata(png) | {"width": 10, "height": 6, "color_mode": "RGB", "is_animated": False} == image_metadata(png)
    gif = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0, 0, 0) + (b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 4, 0) + b"\x02\x01\x00\x00") * 2 + b"\x3b"
    assert image_metadata(gif)["frame_count"] == 2
    bmp = b"BM" + b"\0" * 16 + struct.pack("<iiHH", 7, -8, 1, 24)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 5, 9, 3) + b"\0" * 8
    assert (image_metadata(bmp)["height"], image_metadata(jpeg)["width"], image_metadata(jpeg)["height"]) == (8, 9, 5)
    data = audio_metadata(wav())
    assert (data["duration_seconds"], data["sample_rate_hz"], data["channels"], data["bitrate_bps"]) == (2.0, 100, 2, 3200)
    flac = b"fLaC\x80" + (34).to_bytes(3, "big") + b"\0" * 10 + ((8000 << 44) | (1 << 41) | (15 << 36) | 16000).to_bytes(8, "big") + b"\0" * 16
    assert audio_metadata(flac)["duration_seconds"] == 2.0
    mp3 = b"\xff\xfb\x90\x00" + b"\0" * 15996
    assert audio_metadata(mp3)["duration_seconds"] == pytest.approx(1.0)
    samples, rate = decode_wav(wav(), 0.5, 1.5, rate=50)
    assert rate == 50 and len(samples) == 50 and samples.max() == pytest.approx(0.5)
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.wav").write_text("no audio")
    files = spark.createDataFrame([(str(tmp_path / "a.png"), "image"), (str(tmp_path / "b.wav"), "audio"), ("c.md", "text")], "path string, file_type string")
    got = {r.file_type: r for r in media_metadata(files).collect()}
    assert got["image"].metadata.width == 10 and "ParseError" in got["audio"].error and got["text"].metadata is None


# ---- hot groups -------------------------------------------------------------------------------


def test_ranks_and_percentiles_of_hot_groups(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 50 != 1, "a").alias("g"), (F.col("id") * 7 % 3000).alias("v"), F.col("id").alias("k"))
    plain = {r.k: r.pos for r in rank_within(rows, ["g"], [F.col("v").desc()], "pos").collect()}
    assert {r.k: r.pos for r in rank_within(rows, ["g"], [F.col("v").desc()], "pos", hot_rows=100).collect()} == plain
    values = rows.withColumn("v", F.when(F.col("k") % 11 != 0, F.floor(F.col("v") / 9)))
    shares = {"p50": 0.5, "p95": 0.95, "p100": 1.0}
    want = {r.g: r for r in percentiles(values, "v", ["g"], shares).collect()}
    assert len(want) == 3
    for r in percentiles(values, "v", ["g"], shares, hot_rows=100).collect():
        assert tuple(r)[1:] == pytest.approx(tuple(want[r.g])[1:])


def test_batch_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(200, 4)))], "id bigint, v array<double>")
    asked = rows.filter("id < 40").select((F.col("id") % 13).alias("query_id"), F.col("v").alias("w"))
    whole = [tuple(r) for r in S.batch_top_k(rows, "id", "v", asked, "query_id", "w", 4).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(S, "QUERY_BLOCK", 15)
    assert [tuple(r) for r in S.batch_top_k(rows, "id", "v", asked, "query_id", "w", 4).orderBy("query_id", "rank").collect()] == whole


def test_several_vectors_by_distance(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [5.0, 1.0]), ("c", [9.0, 9.0])], "id string, v array<double>")
    found = S.multi_vector_top_k(rows, "v", [[1.0, 0.0], [5.0, 2.0]], 2, metric="euclid").collect()
    assert [(r.id, r.score) for r in found] == [("a", 0.0), ("b", 1.0)]
