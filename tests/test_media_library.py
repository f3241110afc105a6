"""Images and recordings through the library: preparation, failures, searches by file, registry, segments."""

import io
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.embedding import ByteImageModel, ModelSlot, SpectrumAudioModel, checked_vectors, vector_name
from shelfmark.operators import catalog as C
from shelfmark.operators.filters import MetadataQuery
from shelfmark.plans.handlers import AudioQuery, Handler, Prepared, audio_handler, registry, whole
from shelfmark.plans.requests import Request, interactive_request
from shelfmark.plans.service import FILES, SEGMENTS, VECTORS, Library
from shelfmark.sources.media import audio_metadata, decode_aiff, decode_audio, image_metadata


def png(width, height, fill):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", bytes([fill]) * 60) + chunk(b"IEND", b"")


def tone(hertz, seconds=3.0, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.sin(np.arange(int(seconds * rate)) * 2 * np.pi * hertz / rate) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def test_images_and_recordings(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    (folder / "red.png").write_bytes(png(10, 6, 200))
    (folder / "blue.PNG").write_bytes(png(40, 30, 3))
    (folder / "low.wav").write_bytes(tone(200))
    (folder / "high.wav").write_bytes(tone(3000))
    (folder / "broken.wav").write_text("no sound")
    (folder / "empty.wav").write_bytes(tone(100, 0.0))
    (folder / "note.md").write_text("# Tones\n\nA tone is low or high.")
    library = Library(spark, f"file://{tmp_path}/lib", audio_model=SpectrumAudioModel(16, 8000, 2.0, 2))
    plan = library.counters(library.plan(str(folder)))
    assert {r.file_type: r.work for r in plan.collect()} == {"image": 2, "audio": 4, "text": 1} and C.plan_totals(plan).first().work == 7
    report = {r.path.rsplit("/", 1)[1]: (r.change, r.error) for r in library.index(str(folder)).collect()}
    assert "ParseError" in report["broken.wav"][1] and "no range" in report["empty.wav"][1]
    assert all(report[n] == ("new", None) for n in ("red.png", "blue.PNG", "low.wav", "high.wav", "note.md"))
    files = {r.file_name: r for r in library.store.read(FILES).collect()}
    assert len(files) == 5 and files["red.png"].metadata.width == 10 and files["blue.PNG"].format_key == "png" and files["low.wav"].mime_type == "audio/wav" and files["low.wav"].segment_count == 2
    assert len(files["red.png"]["vec_" + VECTORS["image"]]) == 64
    segments = library.store.read(SEGMENTS).filter("file_type = 'audio'").orderBy("file_name", "segment_index").collect()
    assert [(s.file_name, s.segment_index, s.start_seconds, s.end_seconds) for s in segments] == [(n, k, float(k), float(k) + 2) for n in ("high.wav", "low.wav") for k in (0, 1)]
    # Searches by file and by text, and filters of each modality.
    best = library.search(Request("image", file=folder / "blue.PNG"), 2).collect()
    assert best[0].path.endswith("blue.PNG") and best[0].score == pytest.approx(1, abs=1e-5) and len(best) == 2
    groups = library.search(interactive_request("low.wav", "text", library.vectorizers(), base=folder), 5, grouped=True).collect()
    assert groups[0].parent_id == files["low.wav"].id and sorted(groups[0].matches) == [0, 1] and C.matched_counts(spark.createDataFrame(groups)).first()[:] == (2, 4)
    assert [r.path.rsplit("/", 1)[1] for r in library.search(Request("image", file=folder / "red.png", metadata=MetadataQuery(min_width=20)), 5).collect()] == ["blue.PNG"]
    assert library.search(Request("text", text="tone"), 5).first().heading == "Tones"
    assert [r.file_name for r in library.find(MetadataQuery(min_height=1)).orderBy("file_name").collect()] == ["blue.PNG", "red.png"]
    assert library.by_hash(files["low.wav"].content_hash).first().file_name == "low.wav"
    wanted = spark.createDataFrame([(1, files["red.png"].path_key), (0, "/none")], "position int, path_key string")
    assert [r.file_name for r in library.by_paths(wanted).collect()] == [None, "red.png"]
    # A recording that changes keeps no old segments; one that fails keeps none at all.
    (folder / "low.wav").write_bytes(tone(200, 1.0))
    library.index(str(folder), types=["audio"]).count()
    assert library.store.read(SEGMENTS).filter("file_name = 'low.wav'").count() == 1


def test_one_bad_range_drops_the_recording(spark, tmp_path):
    for name in ("a.wav", "b.wav"):
        (tmp_path / name).write_bytes(tone(100, 6.0))

    def decoder(path, start, end, rate):
        if path.endswith("a.wav") and start >= 4:
            raise ValueError("lost")
        return decode_audio(path, start, end, rate)

    files = spark.createDataFrame([(str(tmp_path / n), "audio") for n in ("a.wav", "b.wav")], "path string, file_type string")
    made = audio_handler(SpectrumAudioModel(8, 4000, 2.0), "vec_a", decoder=decoder).prepare(files)
    assert {r.path[-5:]: r.error for r in made.files.collect()} == {"a.wav": "ValueError: lost", "b.wav": None}
    assert [r.path[-5:] for r in made.segments.collect()] == ["b.wav"] * 5
    one = audio_handler(SpectrumAudioModel(8, 4000, 2.0), "vec_a", segmenter=whole).prepare(files.filter("path like '%b.wav'"))
    assert [(r.start_seconds, r.end_seconds) for r in one.segments.collect()] == [(0.0, 6.0)]
    query = AudioQuery(SpectrumAudioModel(8, 4000, 2.0))
    assert len(query.vectors(tmp_path / "b.wav")) == 5
    (tmp_path / "c.wav").write_text("x")
    with pytest.raises(ValueError, match="can't be read"):
        query.vectors(tmp_path / "c.wav")


def test_registry_and_models():
    nothing = lambda files: Prepared(files)
    known = registry([Handler(" Image ", frozenset({"PNG", ".jpg"}), "file", nothing), Handler("audio", frozenset({"wav"}), "segment", nothing)])
    assert known["image"].extensions == {".png", ".jpg"}
    for handlers in ([], [Handler("a", frozenset({"x"}), "file", nothing)] * 2, [Handler("a", frozenset({"x"}), "file", nothing), Handler("b", frozenset({".X"}), "file", nothing)]):
        with pytest.raises(ValueError):
            registry(handlers)
    for bad in (("", {"x"}, "file"), ("a", set(), "file"), ("a", {"x"}, "page")):
        with pytest.raises(ValueError):
            Handler(bad[0], frozenset(bad[1]), bad[2], nothing)
    assert vector_name("Clip-ViT B/32") == "clip_vit_b_32_v1"
    closed = []
    slot = ModelSlot({n: (lambda n=n: type("M", (), {"close": lambda self: closed.append(n)})()) for n in "ab"})
    first = slot.use("a")
    assert slot.use("a") is first and slot.use("b") is not first and closed == ["a"]
    slot.close()
    assert closed == ["a", "b"]
    for wrong in (np.zeros((1, 3)), np.full((2, 2), np.nan)):
        with pytest.raises(ValueError):
            checked_vectors(wrong, 2, 2)
    assert np.linalg.norm(ByteImageModel(8).encode_images([b"ab", b"a"]), axis=1) == pytest.approx([1, 1])


def test_segments_are_checked(spark):
    schema = "parent_id string, segment_index int, start_seconds double, end_seconds double"
    good = [("a", 0, None, None), ("a", 1, 0.0, 2.0), ("b", 0, 1.0, 1.5)]
    assert C.checked_segments(spark.createDataFrame(good, schema)).count() == 3
    assert spark.createDataFrame(good, schema).filter(C.is_timed()).count() == 2
    for bad in ([("a", 0, 1.0, None)], [("a", 0, 2.0, 2.0)], [("a", 0, -1.0, 2.0)], [("a", 0, None, None)] * 2, [("", 0, None, None)], [(None, 0, None, None)], [("a", -1, None, None)]):
        with pytest.raises(Exception, match="segment"):
            C.checked_segments(spark.createDataFrame(bad, schema)).collect()


def test_more_headers():
    exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHI4s", 274, 3, 1, b"\x06\0\0\0") + struct.pack("<HHII", 271, 2, 5, 38) + b"\0\0\0\0" + b"Acme\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 5, 9, 3) + b"\0" * 8
    assert image_metadata(jpeg)["exif"] == {"Orientation": "6", "Make": "Acme"} and image_metadata(jpeg)["mime_type"] == "image/jpeg"
    frame = lambda name, body: name + struct.pack(">I", len(body)) + b"\0\0" + body
    body = frame(b"TIT2", b"\x03Name") + frame(b"TPE1", b"\x01" + "Ä".encode("utf-16")) + frame(b"APIC", b"\0\1\2")
    mp3 = b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body + b"\xff\xfb\x90\x00" + b"\0" * 15996
    assert audio_metadata(mp3)["tags"] == {"tit2": ["Name"], "tpe1": ["Ä"]} and audio_metadata(mp3)["mime_type"] == "audio/mpeg"
    box = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    entry = struct.pack(">I4s", 36, b"mp4a") + b"\0" * 16 + struct.pack(">HHI", 2, 16, 0) + struct.pack(">I", 44100 << 16)
    note = box(b"ilst", box(b"\xa9nam", box(b"data", b"\0\0\0\1\0\0\0\0Song")))
    moov = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500)) + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8 + entry))))) + box(b"udta", box(b"meta", b"\0" * 4 + note))
    found = audio_metadata(box(b"ftyp", b"M4A ") + box(b"moov", moov), size=5000)
    assert (found["duration_seconds"], found["sample_rate_hz"], found["channels"], found["bitrate_bps"], found["codec"], found["tags"]) == (2.5, 44100, 2, 16000, "mp4a", {"©nam": ["Song"]})
    sound = np.arange(8, dtype=">i2").tobytes()
    aiff = b"FORM\0\0\0\0AIFF" + b"COMM" + struct.pack(">IhIh", 18, 1, 8, 16) + struct.pack(">HQ", 16383 + 2, 1 << 63) + b"SSND" + struct.pack(">III", 8 + len(sound), 0, 0) + sound
    samples, rate = decode_aiff(aiff, 0.5, 1.0)
    assert rate == 4 and (samples * 32768).tolist() == [2.0, 3.0] and audio_metadata(aiff)["duration_seconds"] == 2.0
