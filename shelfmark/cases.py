"""Golden tables: operators that SQL can't express, run on small literal inputs, beside the rows they must give as VALUES.

Every entry calls the library's own operator. The expected rows are written by hand from the stated behaviour.
"""

from __future__ import annotations

import io
import json
import struct
import wave
import zipfile
import zlib
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import identity as I
from shelfmark.functions import text as X
from shelfmark.functions.embedding import ByteImageModel, HashingModel, SpectrumAudioModel, checked_vectors, embed, vector_name
from shelfmark.operators import catalog as C
from shelfmark.operators import metrics as M
from shelfmark.operators import search as S
from shelfmark.operators.chunking import chunk_blocks, split_sentences
from shelfmark.operators.filters import Condition
from shelfmark.operators.timestamps import normalise_timestamps
from shelfmark.plans import evaluation as E
from shelfmark.plans.fields import day_edge
from shelfmark.plans.handlers import AudioQuery, Handler, ImageQuery, Prepared, audio_handler, registry, sliding, whole
from shelfmark.plans.query_language import format_filters, parse_filters, parse_query
from shelfmark.plans.requests import Request, interactive_request, path_like, structured_request
from shelfmark.plans.service import FILES, SEGMENTS, Library
from shelfmark.session import scratch_path
from shelfmark.sources.annotations import annotations
from shelfmark.sources.files import catalogue_rows, discover, exploded_blocks, hash_files, parse_documents, register_parser
from shelfmark.sources.media import media_metadata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]"}


def _sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql_literal, value)) + "]"
    return repr(value)


def values_sql(schema: str, rows: Sequence[tuple]) -> str:
    """A SELECT of literal rows in the types of a Spark schema."""
    fields = [f.split(" ") for f in schema.split(", ")]
    columns = ", ".join(f"CAST(c{k} AS {KINDS[kind]}) AS {name}" for k, (name, kind) in enumerate(fields))
    body = ",\n".join("(" + ", ".join(map(_sql_literal, row)) + ")" for row in rows)
    return f"SELECT {columns} FROM (VALUES\n{body}) t({', '.join(f'c{k}' for k in range(len(fields)))})"


def golden(name: str, schema: str, expected: Sequence[tuple], into: tuple[dict, dict] = (QUERIES, SQL)) -> Callable[[Query], Query]:
    """Register a query whose rows are ``expected``."""

    def add(run: Query) -> Query:
        into[0][name] = run
        into[1][name] = values_sql(schema, expected)
        return run

    return add


def error_of(run: Callable[[], Any]) -> str:
    """What a call raises, as the kind of the error; 'none' if it doesn't."""
    try:
        run()
    except Exception as error:
        return type(error).__name__
    return "none"


def _pairs(spark: SparkSession, made: list[tuple[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(n, None if v is None else str(v)) for n, v in made], "name string, result string")


def _columns(spark: SparkSession, made: list[tuple[str, Column]]) -> DataFrame:
    """(name, result) of Columns, evaluated by Spark."""
    one = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f"{k:03}{n}").alias("name"), c.cast("string").alias("result")) for k, (n, c) in enumerate(made)])).alias("p"))
    return one.select(F.substring("p.name", 4, 200).alias("name"), "p.result")


def _folder(spark: SparkSession, files: dict[str, bytes | str]) -> str:
    """A fresh folder with some files below the shared folder, which has to be a mounted one."""
    path = scratch_path(spark, "cases")
    root = Path(path.removeprefix("file://").removeprefix("file:"))
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(root)


L = F.lit
NAMED = "name string, result string"

# ---- text -----------------------------------------------------------------------------------------


@golden(
    "case_text",
    NAMED,
    [
        ("white space", "a b c"), ("lines", "a b\nc"), ("first text", "x y"), ("no first text", None), ("keywords", '["a","B c","d"]'), ("keywords of commas", '["a;b","c"]'),
        ("preview short", "one two"), ("preview long", "x" * 278 + "y…"), ("preview cut at a space", "x" * 278 + "…"),
        ("timestamp", "1:05.25"), ("timestamp hours", "1:02:05.50"), ("timestamp zero", "0:00.00"), ("duration", "5.00 s"), ("duration minutes", "1:00.00"),
        ("milliseconds", "12.35 ms"), ("milliseconds long", "1.50 s"), ("score", "0.124"), ("size", "999 B"), ("size kilo", "1.5 kB"), ("size mega", "2.0 MB"), ("no size", None),
        ("details image", "JPEG · 1,920 × 1,080 px · RGB · 2.0 MB · 3 frames"), ("details audio", "WAV · 1:00.00 · 44.1 kHz · 128 kbps · 2 channels · PCM"), ("details mono", "1 channel"), ("details nothing", ""),
        ("segment page", "page 2 · A › B · lines 3–5"), ("segment slide", "slide 1 · line 7"), ("segment range", "#2  0:05.00 – 0:15.00"),
        ("modified", "Mar 4, 2024 at 09:05"), ("modified unknown", "Unknown"), ("discovery", "Text files  5 found · 2 new · 1 changed · 2 unchanged"), ("discovery unreadable", "Audio files  1 found · 0 new · 0 changed · 0 unchanged · 1 unreadable"),
        ("question", "Index 3 text files (2 new, 1 changed)?"), ("question one", "Index 1 image file (1 changed)?"), ("json", '{"id":"x","n":null,"at":"2024-01-02T03:04:05.000Z","tags":["a"]}'),
    ],
)
def case_text(spark, _):
    null = L(None).cast("int")
    none = L(None).cast("string")
    return _columns(spark, [
        ("white space", X.squeeze(L(" a \u00a0 b\u0000\n\tc\u2003"))), ("lines", X.squeeze_lines(L(" \r\n a \u00a0b \r\n\u000b c\u0000 \n"))), ("first text", X.first_text(none, L(" \n"), L(" x  y "), L("z"))), ("no first text", X.first_text(L("\u0000 "))),
        ("keywords", F.to_json(X.keywords(L(" a; B  c,b c;,A,d ")))), ("keywords of commas", F.to_json(X.keywords(L("a;b, c"), ","))),
        ("preview short", X.preview(L(" one\n two "))), ("preview long", X.preview(L("x" * 278 + "y" * 9))), ("preview cut at a space", X.preview(L("x" * 278 + " yyyy"))),
        ("timestamp", X.timestamp_text(L(65.25))), ("timestamp hours", X.timestamp_text(L(3725.5))), ("timestamp zero", X.timestamp_text(L(0.0))), ("duration", X.duration_text(L(5.0))), ("duration minutes", X.duration_text(L(60.0))),
        ("milliseconds", X.milliseconds_text(L(12.345))), ("milliseconds long", X.milliseconds_text(L(1500))), ("score", X.score_text(L(0.12351))), ("size", X.size_text(L(999))), ("size kilo", X.size_text(L(1500))), ("size mega", X.size_text(L(2_000_000))), ("no size", X.size_text(null)),
        ("details image", X.details_text(L(".jpeg"), L(1920), L(1080), L(None).cast("double"), null, L(2_000_000), L("RGB"), null, null, none, L(3))),
        ("details audio", X.details_text(L("wav"), null, null, L(60.0), L(44100), null, none, L(128000), L(2), L("PCM"), null)),
        ("details mono", X.details_text(none, null, L(5), L(None).cast("double"), null, null, none, null, L(1), none, L(1))), ("details nothing", X.details_text(none, null, null, L(None).cast("double"), null, null)),
        ("segment page", X.segment_text(L(2), null, F.array(L("A"), L("B")), L(3), L(5))), ("segment slide", X.segment_text(null, L(1), F.array().cast("array<string>"), L(7), L(7))), ("segment range", X.time_range_text(L(1), L(5.0), L(15.0))),
        ("modified", X.modified_text(L("2024-03-04 09:05:33").cast("timestamp"))), ("modified unknown", X.modified_text(L(None).cast("timestamp"))),
        ("discovery", X.discovery_text(L("text"), L(5), L(2), L(1), L(2), L(0))), ("discovery unreadable", X.discovery_text(L("audio"), L(1), L(0), L(0), L(0), L(1))),
        ("question", X.confirmation_text(L("text"), L(2), L(1))), ("question one", X.confirmation_text(L("image"), L(0), L(1))),
        ("json", X.json_text(L("x").alias("id"), null.alias("n"), L("2024-01-02 03:04:05").cast("timestamp").alias("at"), F.array(L("a")).alias("tags"))),
    ])


# ---- identity -------------------------------------------------------------------------------------


@golden(
    "case_identity",
    NAMED,
    [
        ("format", "jpeg"), ("format of jfif", "jpeg"), ("format of wave", "wav"), ("format kept", "htm"), ("format of one dot", ".x"), ("extension", ".gz"), ("extension of a hidden file", ""), ("type", "image"), ("type of none", None),
        ("name key", "file a.pdf"), ("identity key", "grüsse42"), ("query key", "which one?"), ("query id", "acmeinc:which one?"), ("file key", "myfilev2"), ("logical id", "/corp/docs/myfile"), ("enterprise", "Docs"),
        ("type of question", "Multi-Hop"), ("other question", "Other"), ("format order", "2"), ("format order of others", "6"), ("fold", "strasse ss ffi σσ i̇ ß"), ("fold ascii", "abc"), ("caption file", "a.jpg"),
    ],
)
def case_identity(spark, _):
    official = ["Multi-Hop", "Comparative"]
    return _columns(spark, [
        ("format", I.format_key(L(" .JPG "))), ("format of jfif", I.format_key(L("jfif"))), ("format of wave", I.format_key(L(".WAVE"))), ("format kept", I.format_key(L("htm"))), ("format of one dot", I.format_key(L("..x"))),
        ("extension", I.extension_of(L("a.tar.gz"))), ("extension of a hidden file", I.extension_of(L(".hidden"))), ("type", I.file_type_of(L(".PNG"))), ("type of none", I.file_type_of(L(".txt"))),
        ("name key", I.file_name_key(L(" C:\\x\\File A.PDF "))), ("identity key", I.identity_key(L("Grüße-42!"))), ("query key", I.query_key(L(" Which\n one? "))), ("query id", I.query_id(L("Acme, Inc."), L("Which  one?"))),
        ("file key", I.file_key(L("x/My File.v2.pdf"))), ("logical id", I.logical_document_id(L("/Corp/Docs/pdf/My File.pdf"))), ("enterprise", I.enterprise_of(L("/Corp/Docs/pdf/f.pdf"))),
        ("type of question", I.query_type_of(L("multi hop"), official)), ("other question", I.query_type_of(L("odd"), official)), ("format order", I.format_position(L("html"))), ("format order of others", I.format_position(L("txt"))),
        ("fold", F.concat(I.fold(L("STRAẞE ß ﬃ Σς İ ")), L("ß"))), ("fold ascii", I.fold(L("AbC"))), ("caption file", I.file_name_key(L("dir/A.JPG"))),
    ])


# ---- query language and requests ------------------------------------------------------------------

LANGUAGE = [
    ('red car format:.JPG min-res:10×20', "red car", '{"file_format": ".JPG", "min_height": 20, "min_width": 10}', None),
    ("C:\\dir\\a b name:'my file'", "C:\\dir\\a b", '{"name_contains": "my file"}', None),
    ('it\'s "two words" longer-than:0 shorter-than:9.5', "it's two words", '{"duration_longer_than": 0.0, "duration_shorter_than": 9.5}', None),
    ("x sample-rate:44100 bitrate:128000", "x", '{"bitrate_bps": 128000, "sample_rate_hz": 44100}', None),
    ("x after:2024-02-03T00:00:00+00:00 before:2024-03-01T00:00:00+00:00", "x", '{"modified_after": "2024-02-03 00:00:00+00:00", "modified_before": "2024-03-01 00:00:00+00:00"}', None),
    ("x MAX-RES:5x5", "x", '{"max_height": 5, "max_width": 5}', None),
    ("10:30 meeting", "10:30 meeting", "{}", None),
    ("format:png", None, None, "ValueError"), ("", None, None, "ValueError"), ("x width:1", None, None, "ValueError"), ("x format:", None, None, "ValueError"), ("x format:a format:b", None, None, "ValueError"), ('"open', None, None, "ValueError"),
    ("x min-res:big", None, None, "ValueError"), ("x min-res:0x5", None, None, "ValueError"), ("x min-res:9x9 max-res:5x5", None, None, "ValueError"), ("x sample-rate:0", None, None, "ValueError"), ("x bitrate:fast", None, None, "ValueError"),
    ("x longer-than:-1", None, None, "ValueError"), ("x longer-than:nan", None, None, "ValueError"), ("x shorter-than:0", None, None, "ValueError"), ("x longer-than:30 shorter-than:30", None, None, "ValueError"), ("x after:2025-13", None, None, "ValueError"), ("x after:2026 before:2026", None, None, "ValueError"),
]


def _stated(query) -> str:
    return json.dumps({k: v if isinstance(v, (int, float, str)) else str(v) for k, v in sorted(vars(query).items()) if v not in (None, ())}, ensure_ascii=False)


@golden("case_query_language", "query string, text string, fields string, error string", LANGUAGE)
def case_query_language(spark, _):
    """Words, filters and errors of the query language; white space and quotes of the input are part of the case."""
    rows = []
    for query, *_rest in LANGUAGE:
        try:
            parsed = parse_query(query)
            rows.append((query, parsed.text, _stated(parsed.metadata), None))
        except Exception as error:
            rows.append((query, None, None, type(error).__name__))
    return spark.createDataFrame(rows, "query string, text string, fields string, error string")


@golden(
    "case_requests",
    NAMED,
    [
        ("text", "image: cat {}"), ("target by format", 'image: cat {"file_format": "jpg"}'), ("file", "audio: low.wav {}"), ("file and filters", 'image: red.png {"min_height": 1, "min_width": 1}'), ("attached file", 'audio: low.wav {"bitrate_bps": 5}'), ("flags", 'audio: x {"duration_longer_than": 1.5}'),
        ("equal dates", "none"), ("end of day", "2024-05-06 23:59:59.999999"), ("start of day", "2024-05-06 00:00:00"), ("filters again", "name:'a \"b' format:pdf"), ("looks like a path", "true true true false"),
        ("text and file", "ValueError"), ("neither", "ValueError"), ("no target", "ValueError"), ("targets differ", "ValueError"), ("file of another target", "ValueError"), ("unknown file", "ValueError"), ("missing file", "ValueError"), ("not enabled", "ValueError"), ("filter of another target", "ValueError"),
        ("format of another target", "ValueError"), ("sizes crossed", "ValueError"), ("endless duration", "ValueError"), ("dates crossed", "ValueError"), ("bad date", "ValueError"), ("text beside an attached file", "ValueError"), ("blank text", "ValueError"),
    ],
)
def case_requests(spark, _):
    folder = Path(_folder(spark, {"red.png": png(10, 6), "low.wav": tone(200), "a.pdf": b""}))
    takers = {"image": ImageQuery(ByteImageModel()), "audio": AudioQuery(SpectrumAudioModel())}
    shown = lambda r: f"{r.target}: {r.text if r.file is None else r.file.name} {_stated(r.metadata)}"
    line = lambda value, target="text", **more: interactive_request(value, target, takers, base=folder, **more)
    flags = lambda **given: structured_request(vectorizers=takers, **given)
    edge = lambda label: str(day_edge(label, "2024-05-06").replace(tzinfo=None))
    return _pairs(spark, [
        ("text", shown(line("cat", "image"))), ("target by format", shown(flags(text=" cat ", file_format="jpg"))), ("file", shown(line("low.wav"))), ("file and filters", shown(line("./red.png min-res:1x1"))), ("attached file", shown(line("bitrate:5", query_file=Path("low.wav")))),
        ("flags", shown(flags(text="x", target="audio", duration_longer_than=1.5, min_resolution=" "))), ("equal dates", error_of(lambda: flags(text="x", target="text", modified_after="2024-01-01T00:00:00", modified_before="2024-01-01T00:00:00"))),
        ("end of day", edge("modified-before")), ("start of day", edge("modified-after")), ("filters again", format_filters((("name", 'a "b'), ("format", "pdf")))), ("looks like a path", " ".join(str(path_like(v)).lower() for v in ("~/x", "a\\b", "x.png", "red car"))),
        ("text and file", error_of(lambda: flags(text="x", query_file=folder / "low.wav"))), ("neither", error_of(lambda: flags(text=" "))), ("no target", error_of(lambda: flags(text="x"))), ("targets differ", error_of(lambda: flags(text="x", target="audio", file_format="png"))),
        ("file of another target", error_of(lambda: flags(query_file=folder / "low.wav", target="image"))), ("unknown file", error_of(lambda: flags(query_file=folder / "x.zip"))), ("missing file", error_of(lambda: line("./none.wav"))), ("not enabled", error_of(lambda: line("a.pdf"))),
        ("filter of another target", error_of(lambda: flags(text="x", target="text", sample_rate_hz=5))), ("format of another target", error_of(lambda: line("cat format:png", "audio"))), ("sizes crossed", error_of(lambda: flags(text="x", target="image", min_resolution="9x9", max_resolution="9x5"))),
        ("endless duration", error_of(lambda: flags(text="x", target="audio", duration_shorter_than=float("inf")))), ("dates crossed", error_of(lambda: flags(text="x", target="text", modified_after="2025-01-02", modified_before="2025-01-01"))), ("bad date", error_of(lambda: flags(text="x", target="text", modified_after="soon"))),
        ("text beside an attached file", error_of(lambda: parse_filters("cat bitrate:5"))), ("blank text", error_of(lambda: Request("text", text=" "))),
    ])


# ---- sentences and chunks -------------------------------------------------------------------------


@golden(
    "case_sentence_splitter",
    "text string, sentences array<string>",
    [
        ("Dr. Örnek 3.14 değerini yazdı. 日本語です。العربية؟ Son.", ["Dr. Örnek 3.14 değerini yazdı.", "日本語です。", "العربية؟", "Son."]), ("One!? (Two.) Three…", ["One!?", "(Two.)", "Three…"]), ("See e.g. this. And etc. more", ["See e.g. this.", "And etc. more"]),
        ("Wait... what", ["Wait...", "what"]), ("v1.2 is out", ["v1.2 is out"]), ("  two \n lines  ", ["two lines"]), ("", []),
    ],
)
def case_sentence_splitter(spark, _):
    texts = ["Dr. Örnek 3.14 değerini yazdı. 日本語です。العربية؟ Son.", "One!? (Two.) Three…", "See e.g. this. And etc. more", "Wait... what", "v1.2 is out", "  two \n lines  ", ""]
    return spark.createDataFrame([(t, split_sentences(t)) for t in texts], "text string, sentences array<string>")


BLOCKS = "doc string, block_index int, block_type string, text string, page_number int, slide_number int, section_path array<string>, source_line_start int, source_line_end int"
_S = ["Top", "Low"]
CHUNK_BLOCKS = [
    ("joined", 0, "heading", "Low", None, None, _S, 1, 1), ("joined", 1, "paragraph", "First words.", None, None, _S, 3, 3), ("joined", 2, "list_item", "one", None, None, _S, 5, 5), ("joined", 3, "list_item", "two", None, None, _S, 6, 6), ("joined", 3, "list_item", "two", None, None, _S, 6, 6),
    ("scopes", 0, "paragraph", "page one.", 1, None, [], None, None), ("scopes", 1, "paragraph", "page two.", 2, None, [], None, None), ("scopes", 2, "paragraph", "section.", 2, None, ["A"], None, None), ("scopes", 3, "paragraph", "slide.", None, 1, ["A"], None, None),
    ("sentences", 0, "paragraph", "İlk Türkçe cümle. 日本語です。 العربية؟ Son cümle.", None, None, ["D"], None, None),
    ("words", 0, "paragraph", "birinci ikinci üçüncü dördüncü", None, None, [], None, None), ("slices", 0, "paragraph", "a çğışüöabcdefghijklmnopqrstuvwxyz b", None, None, [], None, None),
    ("code", 0, "code", "x = 1\n\n\ny = 2\n", None, None, [], 4, 8), ("lines lost", 0, "paragraph", "a.", None, None, [], 1, 1), ("lines lost", 1, "paragraph", "b.", None, None, [], None, None), ("end lost", 0, "paragraph", "a.", None, None, [], 2, None),
    ("title", 0, "slide_title", "T", None, 1, ["T"], None, None), ("title", 1, "paragraph", "Body.", None, 1, ["T"], None, None), ("empty", 0, "paragraph", " \u0000", None, None, [], None, None), ("again", 0, "heading", "Konu", None, None, ["Konu"], None, None), ("again", 1, "paragraph", "Birinci cümle. İkinci cümle.", None, None, ["Konu"], None, None),
]


@golden(
    "case_chunks",
    "doc string, index int, text string, embedding_text string, first_block_index int, last_block_index int, page_number int, slide_number int, section_path array<string>, source_line_start int, source_line_end int",
    [
        ("joined", 0, "Low\n\nFirst words.", "Top\n\nLow\n\nFirst words.", 0, 1, None, None, _S, 1, 3), ("joined", 1, "one\ntwo", "Top\nLow\n\none\ntwo", 2, 3, None, None, _S, 5, 6),
        ("scopes", 0, "page one.", "page one.", 0, 0, 1, None, [], None, None), ("scopes", 1, "page two.", "page two.", 1, 1, 2, None, [], None, None), ("scopes", 2, "section.", "A\n\nsection.", 2, 2, 2, None, ["A"], None, None), ("scopes", 3, "slide.", "A\n\nslide.", 3, 3, None, 1, ["A"], None, None),
        ("sentences", 0, "İlk Türkçe cümle.", "D\n\nİlk Türkçe cümle.", 0, 0, None, None, ["D"], None, None), ("sentences", 1, "日本語です。 العربية؟", "D\n\n日本語です。 العربية؟", 0, 0, None, None, ["D"], None, None), ("sentences", 2, "Son cümle.", "D\n\nSon cümle.", 0, 0, None, None, ["D"], None, None),
        ("words", 0, "birinci ikinci", "birinci ikinci", 0, 0, None, None, [], None, None), ("words", 1, "üçüncü dördüncü", "üçüncü dördüncü", 0, 0, None, None, [], None, None),
        ("slices", 0, "a", "a", 0, 0, None, None, [], None, None), ("slices", 1, "çğışüöabcdefghijklmn", "çğışüöabcdefghijklmn", 0, 0, None, None, [], None, None), ("slices", 2, "opqrstuvwxyz b", "opqrstuvwxyz b", 0, 0, None, None, [], None, None),
        ("code", 0, "x = 1\n\n\ny = 2", "x = 1\n\n\ny = 2", 0, 0, None, None, [], 4, 8), ("lines lost", 0, "a.\n\nb.", "a.\n\nb.", 0, 1, None, None, [], None, None), ("end lost", 0, "a.", "a.", 0, 0, None, None, [], 2, None),
        ("title", 0, "T\n\nBody.", "T\n\nBody.", 0, 1, None, 1, ["T"], None, None), ("again", 0, "Konu\n\nBirinci cümle.", "Konu\n\nBirinci cümle.", 0, 1, None, None, ["Konu"], None, None), ("again", 1, "İkinci cümle.", "Konu\n\nİkinci cümle.", 1, 1, None, None, ["Konu"], None, None),
    ],
)
def case_chunks(spark, _):
    """Chunks of at most 20 characters."""
    return chunk_blocks(spark.createDataFrame(CHUNK_BLOCKS, BLOCKS), "doc", 20)


# ---- documents ------------------------------------------------------------------------------------


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


CORE = (
    '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/"><dc:creator>Ada</dc:creator><dc:language>nl</dc:language>'
    "<cp:keywords>a; b,A</cp:keywords><cp:category>c</cp:category><cp:revision>3</cp:revision><dcterms:created>2024-01-02T03:04:05Z</dcterms:created><dcterms:modified>2024-01-03T00:00:00</dcterms:modified></cp:coreProperties>"
)
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _paragraph(text: str, style: str = "", more: str = "") -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def docx() -> bytes:
    number = '<w:numPr><w:ilvl w:val="1"/></w:numPr>'
    cells = "".join(f"<w:tc>{_paragraph(t)}</w:tc>" for t in ("x", "y"))
    body = "".join([_paragraph("Doc title", "Title"), _paragraph("Top", "Heading1"), _paragraph("prose  here"), _paragraph("item", "ListBullet"), _paragraph("deep", "", number), _paragraph("cited", "Quote"), _paragraph("Under", "own"), _paragraph("last"), _paragraph(" ")])
    styles = f'<w:styles {_W}><w:style w:styleId="own"><w:name w:val="heading 2"/></w:style></w:styles>'
    return archive({"word/document.xml": f"<w:document {_W}><w:body>{body}<w:tbl><w:tr>{cells}</w:tr></w:tbl><w:sectPr/></w:body></w:document>", "word/styles.xml": styles, "docProps/core.xml": CORE})


def pptx() -> bytes:
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def shape(texts: list[str], kind: str = "", props: str = "", y: int = 0) -> str:
        place = f'<p:ph type="{kind}"/>' if kind else ""
        lines = "".join(f"<a:p><a:pPr{props}</a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)
        return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="s"/><p:nvPr>{place}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody>{lines}</p:txBody></p:sp>'

    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="90"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    group = f"<p:grpSp><p:grpSpPr><a:xfrm><a:off x=\"0\" y=\"50\"/></a:xfrm></p:grpSpPr>{shape(['grouped'], props='>', y=50)}</p:grpSp>"
    slide = f"<p:sld {ns}><p:cSld><p:spTree>{table}{group}{shape(['point'], props='><a:buChar char=\"x\"/>', y=9)}{shape(['sub'], props=' lvl=\"1\">', y=20)}{shape(['Title'], 'title', '>')}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {ns}><p:cSld><p:spTree>{shape(['spoken'], 'body', '>')}</p:spTree></p:cSld></p:notes>"
    rel = lambda target, kind: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/{kind}" Target="{target}"/></Relationships>'
    return archive({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="1" r:id="r1"/></p:sldIdLst><p:sldSz cx="10" cy="20"/></p:presentation>', "ppt/_rels/presentation.xml.rels": rel("slides/slide1.xml", "slide"), "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": rel("../notesSlides/n1.xml", "notesSlide"), "ppt/notesSlides/n1.xml": notes, "docProps/core.xml": CORE,
    })


XMP = (
    '<?xpacket begin="" id="x"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" pdf:Producer="Maker">'
    '<dc:description><rdf:Alt><rdf:li xml:lang="fr">fran</rdf:li><rdf:li xml:lang="x-default">plain</rdf:li></rdf:Alt></dc:description><dc:creator><rdf:Seq><rdf:li>Bea</rdf:li><rdf:li>ada</rdf:li></rdf:Seq></dc:creator>'
    "<dc:subject><rdf:Bag><rdf:li>k1</rdf:li></rdf:Bag></dc:subject><dc:language><rdf:Bag><rdf:li>de</rdf:li></rdf:Bag></dc:language></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end=\"w\"?>"
)


def pdf() -> bytes:
    pages = ["BT (First line) Tj 0 -14 Td (goes on.) Tj 0 -40 Td [(Sec) -20 (ond)] TJ ET", "BT (Last) Tj ET", "BT ET"]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 90 0 R /Metadata 80 0 R >>", 2: f"<< /Type /Pages /Kids [{' '.join(f'{10 + 2 * k} 0 R' for k in range(len(pages)))}] /Count {len(pages)} >>".encode()}
    for k, text in enumerate(pages):
        data = zlib.compress(text.encode())
        objects[10 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>".encode()
        objects[11 + 2 * k] = f"<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream"
    packet = XMP.encode()
    objects |= {80: f"<< /Type /Metadata /Length {len(packet)} >>\nstream\n".encode() + packet + b"\nendstream", 90: b"<< /First 91 0 R >>", 91: b"<< /Title (Part) /Dest [12 0 R /Fit] >>"}
    objects[5] = b"<< /Title (My \\(title\\)) /Author (Ada) /Keywords (a; B,b) /CreationDate (D:20240102030405+01'00') >>"
    return b"%PDF-1.4\n" + b"".join(f"{n} 0 obj\n".encode() + o + b"\nendobj\n" for n, o in objects.items()) + b"trailer << /Root 1 0 R /Info 5 0 R >>\nstartxref\n0\n%%EOF"


HTML = """<!doctype html>
<html lang="nl-NL"><head><title>Een  titel</title>
<meta name="author" content="Ada"><meta property="article:author" content="ADA"><meta name="keywords" content="een, twee,,een">
<meta name="created" content="2024-03-04T05:06:07Z"><meta name="description" content="kort"><script>weg()</script></head>
<body>
<h1>Kop</h1>
<p>Tekst met <b>nadruk</b>.</p>
<h2>Onder</h2>
<ul><li>buiten<ul><li>binnen</li></ul></li></ul>
<blockquote>los <p>Citaat</p></blockquote>
<pre><code class="x lang-py">a = 1
</code></pre>
<p>met <code>vlak</code></p>
<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>
<template>weg</template><noscript>weg</noscript></body></html>"""
MARKDOWN = "\ufeff# Kop\r\n\r\nTekst **vet** [naam](https://x.example) `c`.\r\n\r\n## Onder\r\n\r\n- een\r\n- twee\r\n\r\n> citaat\r\n\r\n```py\r\na = 1\r\n```\r\n\r\n| A | B |\r\n| --- | --- |\r\n| 1 | 2 |\r\n\r\n<div>html &amp; tekst</div>\r\n<script>weg()</script>\r\n\r\nZij\r\n---\r\n"
DOCUMENTS = {
    "a.html": HTML.encode(), "b.md": MARKDOWN.encode(), "c.docx": docx(), "d.pptx": pptx(), "e.pdf": pdf(), "f.html": '<meta charset="windows-1254"><h1>Şehir</h1>'.encode("windows-1254"), "g.htm": b"<h1>one<p>two<ul><li>three", "h.md": b"\xff\xfe\x00",
    "i.docx": b"nothing", "j.pptx": archive({"other.xml": ""}), "k.pdf": b"no pdf", "l.pdf": pdf().replace(b"/Info", b"/Encrypt 7 0 R /Info"), "m.zip": b"x", "n.html": b"", "o.docx": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1",
}


def _parsed(spark: SparkSession) -> DataFrame:
    rows = [(name, bytearray(content)) for name, content in DOCUMENTS.items()]
    return parse_documents(spark.createDataFrame(rows, "path string, content binary").repartition(4), "path", "content")


_K, _KO = ["Kop"], ["Kop", "Onder"]


@golden(
    "case_blocks",
    "path string, block_index int, block_type string, text string, page_number int, slide_number int, section_path array<string>, source_line_start int, source_line_end int, attributes string",
    [
        ("a.html", 0, "heading", "Kop", None, None, _K, 6, None, '{"level": 1}'), ("a.html", 1, "paragraph", "Tekst met nadruk .", None, None, _K, 7, None, "{}"), ("a.html", 2, "heading", "Onder", None, None, _KO, 8, None, '{"level": 2}'),
        ("a.html", 3, "list_item", "buiten", None, None, _KO, 9, None, "{}"), ("a.html", 4, "list_item", "binnen", None, None, _KO, 9, None, "{}"), ("a.html", 5, "quote", "los", None, None, _KO, 10, None, "{}"), ("a.html", 6, "quote", "Citaat", None, None, _KO, 10, None, "{}"),
        ("a.html", 7, "code", "a = 1", None, None, _KO, 11, None, '{"language": "py"}'), ("a.html", 8, "paragraph", "met vlak", None, None, _KO, 13, None, "{}"), ("a.html", 9, "table", "A | B\n1 | 2", None, None, _KO, 14, None, "{}"),
        ("b.md", 0, "heading", "Kop", None, None, _K, 1, 1, '{"level": 1}'), ("b.md", 1, "paragraph", "Tekst vet naam c.", None, None, _K, 3, 3, "{}"), ("b.md", 2, "heading", "Onder", None, None, _KO, 5, 5, '{"level": 2}'), ("b.md", 3, "list_item", "een", None, None, _KO, 7, 7, "{}"), ("b.md", 4, "list_item", "twee", None, None, _KO, 8, 8, "{}"),
        ("b.md", 5, "quote", "citaat", None, None, _KO, 10, 10, "{}"), ("b.md", 6, "code", "a = 1", None, None, _KO, 12, 14, '{"language": "py"}'), ("b.md", 7, "table", "A | B\n1 | 2", None, None, _KO, 16, 18, "{}"), ("b.md", 8, "other", "html & tekst", None, None, _KO, 20, 21, '{"source": "html"}'), ("b.md", 9, "heading", "Zij", None, None, ["Kop", "Zij"], 23, 24, '{"level": 2}'),
        ("c.docx", 0, "paragraph", "Doc title", None, None, [], None, None, "{}"), ("c.docx", 1, "heading", "Top", None, None, ["Top"], None, None, '{"level": 1}'), ("c.docx", 2, "paragraph", "prose here", None, None, ["Top"], None, None, "{}"), ("c.docx", 3, "list_item", "item", None, None, ["Top"], None, None, '{"list_level": 0}'),
        ("c.docx", 4, "list_item", "deep", None, None, ["Top"], None, None, '{"list_level": 1}'), ("c.docx", 5, "quote", "cited", None, None, ["Top"], None, None, "{}"), ("c.docx", 6, "heading", "Under", None, None, ["Top", "Under"], None, None, '{"style": "heading 2", "level": 2}'), ("c.docx", 7, "paragraph", "last", None, None, ["Top", "Under"], None, None, "{}"), ("c.docx", 8, "table", "x | y", None, None, ["Top", "Under"], None, None, '{"rows": 1, "columns": 2}'),
        ("d.pptx", 0, "slide_title", "Title", None, 1, ["Title"], None, None, '{"shape_name": "s", "placeholder_type": "title"}'), ("d.pptx", 1, "list_item", "point", None, 1, ["Title"], None, None, '{"paragraph_index": 0, "paragraph_level": 0, "shape_name": "s"}'), ("d.pptx", 2, "list_item", "sub", None, 1, ["Title"], None, None, '{"paragraph_index": 0, "paragraph_level": 1, "shape_name": "s"}'),
        ("d.pptx", 3, "paragraph", "grouped", None, 1, ["Title"], None, None, '{"paragraph_index": 0, "paragraph_level": 0, "shape_name": "s"}'), ("d.pptx", 4, "table", "k | v", None, 1, ["Title"], None, None, '{"rows": 1, "columns": 2}'), ("d.pptx", 5, "speaker_note", "spoken", None, 1, ["Title"], None, None, '{"paragraph_index": 0}'),
        ("e.pdf", 0, "paragraph", "First line goes on.", 1, None, [], None, None, "{}"), ("e.pdf", 1, "paragraph", "Second", 1, None, [], None, None, "{}"), ("e.pdf", 2, "paragraph", "Last", 2, None, ["Part"], None, None, "{}"),
        ("f.html", 0, "heading", "Şehir", None, None, ["Şehir"], 1, None, '{"level": 1}'), ("g.htm", 0, "heading", "one two three", None, None, ["one two three"], 1, None, '{"level": 1}'), ("g.htm", 1, "paragraph", "two three", None, None, ["one two three"], 1, None, "{}"), ("g.htm", 2, "list_item", "three", None, None, ["one two three"], 1, None, "{}"),
    ],
)
def case_blocks(spark, _):
    """Blocks of documents of every format, malformed ones among them."""
    return exploded_blocks(_parsed(spark))


@golden(
    "case_documents",
    "path string, document_format string, title string, authors array<string>, created string, modified string, language string, page_count int, slide_count int, properties string, error string",
    [
        ("a.html", "html", "Een titel", ["Ada"], "2024-03-04 05:06:07", None, "nl-NL", None, None, '{"encoding": "utf-8", "description": "kort", "keywords": ["een", "twee", "een"]}', None), ("b.md", "markdown", "Kop", [], None, None, None, None, None, "{}", None),
        ("c.docx", "docx", "Doc title", ["Ada"], "2024-01-02 03:04:05", "2024-01-03 00:00:00", "nl", None, None, '{"category": "c", "keywords": ["a", "b"], "revision": 3, "section_count": 1}', None),
        ("d.pptx", "pptx", "Title", ["Ada"], "2024-01-02 03:04:05", "2024-01-03 00:00:00", "nl", None, 1, '{"category": "c", "keywords": ["a", "b"], "revision": 3, "slide_width_emu": 10, "slide_height_emu": 20}', None),
        ("e.pdf", "pdf", "My (title)", ["Bea", "ada"], "2024-01-02 02:04:05", None, "de", 3, None, '{"subject": "plain", "producer": "Maker", "pdf_version": "1.4", "keywords": ["a", "B", "k1"]}', None),
        ("f.html", "html", "Şehir", [], None, None, None, None, None, '{"encoding": "cp1254"}', None), ("g.htm", "html", "one two three", [], None, None, None, None, None, '{"encoding": "utf-8"}', None), ("n.html", "html", None, [], None, None, None, None, None, '{"encoding": "utf-8"}', None),
        *[(p, None, None, None, None, None, None, None, None, None, "ParseError") for p in ("h.md", "i.docx", "j.pptx", "k.pdf", "l.pdf", "m.zip", "o.docx")],
    ],
)
def case_documents(spark, _):
    """Metadata of the same documents; one that can't be read is an error row."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _parsed(spark).select("path", "document_format", "title", "authors", at("created_at").alias("created"), at("content_modified_at").alias("modified"), "language", "page_count", "slide_count", "properties", F.substring_index("error", ":", 1).alias("error"))


# ---- files and media ------------------------------------------------------------------------------


def png(width: int, height: int, fill: int = 7) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", bytes([fill]) * 60) + chunk(b"IEND", b"")


def tone(hertz: float, seconds: float = 3.0, rate: int = 1000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.sin(np.arange(int(seconds * rate)) * 2 * np.pi * hertz / rate) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def jpeg() -> bytes:
    exif = b"Exif\0\0II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHI4s", 274, 3, 1, b"\x06\0\0\0") + struct.pack("<HHII", 271, 2, 5, 38) + b"\0\0\0\0" + b"Acme\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HHB", 5, 9, 3) + b"\0" * 8


def mp3() -> bytes:
    frame = lambda name, body: name + struct.pack(">I", len(body)) + b"\0\0" + body
    body = frame(b"TIT2", b"\x03Name") + frame(b"APIC", b"\0\1\2")
    return b"ID3\x03\0\0" + bytes([0, 0, len(body) >> 7, len(body) & 127]) + body + b"\xff\xfb\x90\x00" + b"\0" * 15996


def m4a() -> bytes:
    box = lambda name, body: struct.pack(">I", len(body) + 8) + name + body
    entry = struct.pack(">I4s", 36, b"mp4a") + b"\0" * 16 + struct.pack(">HHI", 2, 16, 0) + struct.pack(">I", 44100 << 16)
    moov = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500)) + box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd", b"\0" * 8 + entry)))))
    return box(b"ftyp", b"M4A ") + box(b"moov", moov)


GIF = b"GIF89a" + struct.pack("<HHBBB", 3, 4, 0, 0, 0) + (b"\x2c" + struct.pack("<HHHHB", 0, 0, 3, 4, 0) + b"\x02\x01\x00\x00") * 2 + b"\x3b"
FLAC = b"fLaC\x80" + (34).to_bytes(3, "big") + b"\0" * 10 + ((8000 << 44) | (1 << 41) | (15 << 36) | 16000).to_bytes(8, "big") + b"\0" * 16


@golden(
    "case_discovery",
    "file_name string, file_type string, format_key string, size_bytes bigint, hash string, stable boolean",
    [
        ("a.HTML", "text", "html", 3, "ba7816bf", True), (".b.md", "text", "md", 3, "ba7816bf", True), ("c.png", "image", "png", 0, "e3b0c442", True), ("d.wave", "audio", "wav", 1, "ca978112", True), ("e.jpe", "image", "jpe", 1, "ca978112", True),
    ],
)
def case_discovery(spark, _):
    """Supported files of a tree with their hashes; ids follow from the path."""
    folder = _folder(spark, {"a.HTML": "abc", "sub/.b.md": "abc", "sub/deep/c.png": b"", "_x/d.wave": "a", "_x/e.jpe": "a", "f.txt": "no", "g.html/inside.bin": "x"})
    rows = catalogue_rows(hash_files(discover(spark, folder)))
    return rows.select("file_name", "file_type", "format_key", "size_bytes", F.substring("content_hash", 1, 8).alias("hash"), (F.col("id") == I.file_id(F.col("path_key"))).alias("stable"))


@golden(
    "case_discovery_rules",
    NAMED,
    [("not recursive", "a.md"), ("one type", "c.png"), ("in order", "a.md b.md c.png"), ("own extensions", "d.txt"), ("unknown type", "ValueError"), ("no folder", "NotADirectoryError"), ("parser twice", "ValueError"), ("parser without a dot", "ValueError"), ("parser added", "none")],
)
def case_discovery_rules(spark, _):
    folder = _folder(spark, {"a.md": "a", "s/b.md": "b", "s/t/c.png": "c", "d.txt": "d"})
    names = lambda **options: " ".join(r.file_name for r in discover(spark, folder, ordered=True, **options).collect())
    return _pairs(spark, [
        ("not recursive", names(recursive=False)), ("one type", names(allowed_types=["image"])), ("in order", names()), ("own extensions", names(extensions={"notes": [".txt"]})), ("unknown type", error_of(lambda: names(allowed_types=["video"]))), ("no folder", error_of(lambda: discover(spark, folder + "/none"))),
        ("parser twice", error_of(lambda: register_parser(".md", lambda raw: raw))), ("parser without a dot", error_of(lambda: register_parser("txt", lambda raw: raw))), ("parser added", error_of(lambda: register_parser(".txt", lambda raw: raw))),
    ])


@golden(
    "case_media",
    "file string, format string, width int, height int, mode string, frames int, animated boolean, seconds double, rate int, channels int, bitrate int, codec string, mime string, details string, error string",
    [
        ("a.png", "PNG", 10, 6, "RGB", 1, False, None, None, None, None, None, "image/png", "{}", None), ("b.gif", "GIF", 3, 4, "P", 2, True, None, None, None, None, None, "image/gif", "{}", None),
        ("c.jpg", "JPEG", 9, 5, "RGB", 1, False, None, None, None, None, None, "image/jpeg", '{"Make":"Acme","Orientation":"6"}', None), ("d.bmp", "BMP", 7, 8, "RGB", 1, False, None, None, None, None, None, "image/bmp", "{}", None),
        ("e.wav", "WAVE", None, None, None, None, None, 3.0, 1000, 1, 16000, "PCM", "audio/wav", "{}", None), ("f.flac", "FLAC", None, None, None, None, None, 2.0, 8000, 2, None, "FLAC", "audio/flac", "{}", None), ("g.mp3", "MP3", None, None, None, None, None, 1.0, 44100, 2, 128000, "MP3", "audio/mpeg", '{"tit2":["Name"]}', None),
        ("h.m4a", "MP4", None, None, None, None, None, 2.5, 44100, 2, None, "mp4a", "audio/mp4", "{}", None), ("i.wav", None, None, None, None, None, None, None, None, None, None, None, None, None, "ParseError"), ("j.png", None, None, None, None, None, None, None, None, None, None, None, None, None, "ParseError"), ("k.md", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ],
)
def case_media(spark, _):
    """Headers of images and recordings."""
    folder = _folder(spark, {"a.png": png(10, 6), "b.gif": GIF, "c.jpg": jpeg(), "d.bmp": b"BM" + b"\0" * 16 + struct.pack("<iiHH", 7, -8, 1, 24), "e.wav": tone(100), "f.flac": FLAC, "g.mp3": mp3(), "h.m4a": m4a(), "i.wav": "no sound", "j.png": "no image", "k.md": "# x"})
    m = lambda n: F.col(f"metadata.{n}")
    sorted_map = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    bitrate = F.when(m("audio_format") != "MP4", m("bitrate_bps"))
    return media_metadata(discover(spark, folder)).select(
        F.col("file_name").alias("file"), F.coalesce(m("image_format"), m("audio_format")).alias("format"), m("width").alias("width"), m("height").alias("height"), m("color_mode").alias("mode"), m("frame_count").alias("frames"), m("is_animated").alias("animated"), F.round(m("duration_seconds"), 3).alias("seconds"),
        m("sample_rate_hz").alias("rate"), m("channels").alias("channels"), bitrate.alias("bitrate"), m("codec").alias("codec"), m("mime_type").alias("mime"), F.coalesce(sorted_map(m("exif")), sorted_map(m("tags"))).alias("details"), F.substring_index("error", ":", 1).alias("error"),
    )


@golden(
    "case_recordings",
    "file string, segments int, first double, last double, dims int, error string",
    [("low.wav", 5, 0.0, 6.0, 8, None), ("short.wav", 1, 0.0, 1.0, 8, None), ("bad.wav", None, None, None, None, "ParseError"), ("empty.wav", None, None, None, None, "ParseError"), ("lost.wav", None, None, None, None, "ValueError")],
)
def case_recordings(spark, _):
    """Windows of two seconds, one apart; a file with a window that can't be decoded keeps none."""
    folder = _folder(spark, {"low.wav": tone(50, 6.0), "short.wav": tone(50, 1.0), "bad.wav": "x", "empty.wav": tone(50, 0.0), "lost.wav": tone(50, 6.0)})

    def decoder(path, start, end, rate):
        from shelfmark.sources.media import decode_audio

        if path.endswith("lost.wav") and start >= 4:
            raise ValueError("lost")
        return decode_audio(path, start, end, rate)

    made = audio_handler(SpectrumAudioModel(8, 500, 2.0, 2), "v", sliding(2.0, 1.0), decoder).prepare(discover(spark, folder))
    cut = made.segments.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("segments"), F.min("start_seconds").alias("first"), F.max("end_seconds").alias("last"), F.max(F.size("v")).alias("dims"))
    return made.files.join(cut, "path", "left").select(F.element_at(F.split("path", "/"), -1).alias("file"), "segments", "first", "last", "dims", F.substring_index("error", ":", 1).alias("error"))


@golden(
    "case_vectors",
    NAMED,
    [
        ("text dims", "16 null 16"), ("text length", "1.0"), ("image length", "1.0"), ("audio length", "1.0"), ("blank text", "ValueError"), ("wrong count", "ValueError"), ("not finite", "ValueError"), ("vector name", "clip_vit_b_32_v1"), ("no name", "ValueError"), ("query windows", "5"), ("query image", "1"), ("broken query", "ValueError"), ("whole file", "0 0.0 6.0"),
        ("handler", "audio .ogg,.wav segment"), ("handler without type", "ValueError"), ("handler scope", "ValueError"), ("type twice", "ValueError"), ("extension twice", "ValueError"), ("no handler", "ValueError"), ("window", "ValueError"), ("hop", "ValueError"), ("rate", "ValueError"),
    ],
)
def case_vectors(spark, _):
    """Models, their checks, query files and handlers."""
    folder = Path(_folder(spark, {"a.wav": tone(50, 6.0), "b.png": png(2, 2), "c.wav": "x"}))
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, "ß")], "k int, t string").select("k", embed(F.col("t"), HashingModel(16)).alias("v")).orderBy("k").collect()
    length = lambda v: str(round(float(np.linalg.norm(v)), 4))
    make = lambda kind="a", known=("x",), scope="file": Handler(kind, frozenset(known), scope, lambda files: Prepared(files))
    known = make("Audio", ("WAV", ".ogg"), "segment")
    audio = SpectrumAudioModel(8, 500, 2.0)
    one = whole(spark.createDataFrame([("f", 6.0), ("g", 0.0)], "path string, d double"), "d").collect()
    return _pairs(spark, [
        ("text dims", " ".join("null" if r.v is None else str(len(r.v)) for r in rows)), ("text length", length(rows[0].v)), ("image length", length(ByteImageModel(8).encode_images([b"abc"])[0])), ("audio length", length(audio.encode_audio([np.ones(50)])[0])),
        ("blank text", error_of(lambda: HashingModel(8).encode([" "]))), ("wrong count", error_of(lambda: checked_vectors(np.zeros((1, 2)), 2, 2))), ("not finite", error_of(lambda: checked_vectors(np.full((1, 2), np.inf), 1, 2))), ("vector name", vector_name("Clip-ViT B/32")), ("no name", error_of(lambda: vector_name("--"))),
        ("query windows", len(AudioQuery(audio).vectors(folder / "a.wav"))), ("query image", len(ImageQuery(ByteImageModel(8)).vectors(folder / "b.png"))), ("broken query", error_of(lambda: AudioQuery(audio).vectors(folder / "c.wav"))), ("whole file", " ".join(str(x) for r in one for x in (r.segment_index, r.start_seconds, r.end_seconds))),
        ("handler", f"{known.file_type} {','.join(sorted(known.extensions))} {known.scope}"), ("handler without type", error_of(lambda: make(" "))), ("handler scope", error_of(lambda: make(scope="page"))), ("type twice", error_of(lambda: registry([make(), make(known=("y",))]))), ("extension twice", error_of(lambda: registry([make(), make("b", (".X",))]))), ("no handler", error_of(lambda: registry([]))),
        ("window", error_of(lambda: C.audio_ranges(spark.range(1), "id", 0.0))), ("hop", error_of(lambda: C.audio_ranges(spark.range(1), "id", 2.0, 3.0))), ("rate", error_of(lambda: SpectrumAudioModel(8, 0))),
    ])


# ---- annotations and evaluation -------------------------------------------------------------------


@golden(
    "case_annotations",
    "target string, key string, item string, position int",
    [
        ("audio", "a.wav", "one", 0), ("audio", "a.wav", "two", 1), ("audio", "a.wav", "ten", 2), ("image", "a.jpg", "cat", 5), ("image", "a.jpg", "dog", 6),
        ("text", "x:which one?", "Multi-Hop", 3), ("text", "x:else?", "Other", 1),
    ],
)
def case_annotations(spark, _):
    folder = _folder(spark, {
        "c.csv": "\ufefffile_name,caption_2,caption_10,caption_1\na.wav,two,ten,one\n", "c.json": '{"images": [{"id": 1, "file_name": "a.jpg"}], "annotations": [{"id": 5, "image_id": 1, "caption": " cat "}, {"id": 6, "image_id": 1, "caption": "dog"}]}',
        "q.csv": 'Enterprise Name,Query Type,Query,Supporting Facts\nX,multi hop,Which  one?,"[{""filename"": ""b.pdf""}, {""filename"": ""a.pdf""}]"\nx,Multi-Hop,which one?,"[{""filename"": ""A.pdf""}, {""filename"": ""c.pdf""}]"\nX,odd,Else?,"[{""filename"": ""z.pdf""}]"\n',
    })
    audio = annotations(spark, "audio", folder + "/c.csv").select(F.lit("audio").alias("target"), F.col("file_name").alias("key"), F.col("caption").alias("item"), "position")
    image = annotations(spark, "image", folder + "/c.json").select(F.lit("image"), "file_name", "caption", F.col("annotation_id").cast("int"))
    text = annotations(spark, "text", folder + "/q.csv", ["Multi-Hop"]).select(F.lit("text"), "query_id", "query_type", F.size("files"))
    return audio.union(image).union(text)


@golden(
    "case_annotation_errors",
    NAMED,
    [("no columns", "ValueError"), ("no captions", "ValueError"), ("missing caption", "raised"), ("unknown image", "raised"), ("image twice", "raised"), ("blank type", "raised"), ("two types", "raised"), ("target", "ValueError")],
)
def case_annotation_errors(spark, _):
    head = "Enterprise Name,Query Type,Query,Supporting Facts\n"
    fact = '"[{""filename"": ""b.pdf""}]"\n'
    note = '"annotations": [{"id": 5, "image_id": %d, "caption": "c"}]}'
    folder = _folder(spark, {
        "a.csv": "x,y\n1,2\n", "b.csv": "file_name,x\na,b\n", "c.csv": "file_name,caption_1\na.wav,\n", "d.json": '{"images": [{"id": 1, "file_name": "a"}], ' + note % 2, "e.json": '{"images": [{"id": 1, "file_name": "a"}, {"id": 1, "file_name": "b"}], ' + note % 1,
        "f.csv": head + f'X," ",Q?,{fact}', "g.csv": head + f"X,Comparative,Q?,{fact}X,Other kind,Q?,{fact}",
    })
    run = lambda target, name, *more: error_of(lambda: annotations(spark, target, f"{folder}/{name}", *more).collect())
    raised = lambda *given: "none" if run(*given) == "none" else "raised"
    return _pairs(spark, [
        ("no columns", run("text", "a.csv", [])), ("no captions", run("audio", "b.csv")), ("missing caption", raised("audio", "c.csv")), ("unknown image", raised("image", "d.json")), ("image twice", raised("image", "e.json")),
        ("blank type", raised("text", "f.csv", ["Comparative"])), ("two types", raised("text", "g.csv", ["Comparative"])), ("target", run("video", "a.csv")),
    ])


def _evaluation(spark: SparkSession):
    rows = spark.createDataFrame([("a-md", [1.0, 0.0], "md"), ("a-pdf", [0.9, 0.1], "pdf"), ("b-md", [0.0, 1.0], "md"), ("b-md", [0.6, 0.6], "md"), ("c-md", [0.7, -0.7], "md")], "file_id string, vector array<double>, fmt string")
    queries = spark.createDataFrame([("q1", "Plain", [1.0, 0.0]), ("q2", "Plain", [0.0, 1.0]), ("q3", "Odd", [1.0, -1.0])], "query_id string, query_type string, vector array<double>")
    logical = spark.createDataFrame([("a-md", "a"), ("a-pdf", "a"), ("b-md", "b"), ("c-md", "c")], "file_id string, logical_id string")
    wanted = spark.createDataFrame([("q1", "a"), ("q2", "b"), ("q3", "c"), ("q3", "a")], "query_id string, logical_id string")
    return rows, queries, wanted, logical


@golden(
    "case_evaluation",
    "part string, view string, kind string, k int, queries bigint, hit double, mrr double, recall double, map double, complete double",
    [
        ("all", "mixed", None, 1, 3, 1.0, 1.0, 0.833333, 1.0, 0.666667), ("all", "mixed", None, 2, 3, 1.0, 1.0, 1.0, 1.0, 1.0), ("all", "pdf", None, 1, 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("all", "pdf", None, 2, 2, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("by_type", "mixed", "Plain", 1, 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("by_type", "mixed", "Plain", 2, 2, 1.0, 1.0, 1.0, 1.0, 1.0), ("by_type", "mixed", "Odd", 1, 1, 1.0, 1.0, 0.5, 1.0, 0.0), ("by_type", "mixed", "Odd", 2, 1, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("by_type", "pdf", "Plain", 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("by_type", "pdf", "Plain", 2, 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("by_type", "pdf", "Odd", 1, 1, 1.0, 1.0, 1.0, 1.0, 1.0), ("by_type", "pdf", "Odd", 2, 1, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("macro", "mixed", None, 1, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("macro", "mixed", None, 2, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("macro", "pdf", None, 1, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("macro", "pdf", None, 2, None, 1.0, 1.0, 1.0, 1.0, 1.0),
        ("multi_document", "mixed", None, 1, 1, 1.0, 1.0, 0.5, 1.0, 0.0), ("multi_document", "mixed", None, 2, 1, 1.0, 1.0, 1.0, 1.0, 1.0),
    ],
)
def case_evaluation(spark, _):
    """Two views of three questions, one of which has two relevant documents; only one of them is there as PDF."""
    rows, queries, wanted, logical = _evaluation(spark)
    outcomes = E.document_outcomes(rows, queries, wanted, logical, [1, 2], {"mixed": None, "pdf": "pdf"})
    tables = E.evaluation_tables(outcomes, [2, 1], ["Plain"])
    parts = []
    for name in ("all", "by_type", "macro", "multi_document"):
        t = tables[name]
        kind = F.col("query_type") if "query_type" in t.columns else F.lit(None).cast("string")
        count = F.col("queries") if "queries" in t.columns else F.lit(None).cast("bigint")
        parts.append(t.select(F.lit(name).alias("part"), "view", kind.alias("kind"), "k", count.alias("queries"), *[F.round(m, 6).alias(m) for m in ("hit", "mrr", "recall", "map", "complete")]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@golden(
    "case_evaluation_rules",
    NAMED,
    [
        ("single", "1:0.5 2:1.0"), ("candidates", "10 100 400"), ("sample", "3 in order"), ("small sample", "[1]"), ("views", "mixed 3 1 0, pdf 2 0 2"), ("latency", "50.5 95.05 99.01"), ("latency of none", "0"), ("summary", "mixed 2 0.9"), ("written twice", "FileExistsError"), ("cutoffs", "[1, 5]"), ("bad cutoffs", "ValueError"), ("no cutoffs", "ValueError"),
        ("coverage", "ambiguous 1, eligible 1, missing 1"), ("measured", "3"),
    ],
)
def case_evaluation_rules(spark, _):
    rows, queries, wanted, logical = _evaluation(spark)
    relevant = spark.createDataFrame([("q1", "a-pdf"), ("q2", "b-md")], "query_id string, file_id string")
    single = E.evaluate_single(rows, queries.filter("query_id <> 'q3'"), relevant, [1, 2], target="audio").orderBy("k").collect()
    sample = E.sample_in_order(range(10), 3, 1)
    views = E.view_summaries(E.document_outcomes(rows, queries, wanted, logical, [2], {"mixed": None, "pdf": "pdf"}), [2]).orderBy("view").collect()
    underfilled = ", ".join(f"{r.view} {r.queries} {r.multi_document} {r.underfilled}" for r in views)
    times = spark.range(1, 101).select(F.col("id").cast("double").alias("ms"))
    p = M.latency(times, "ms").first()
    summary = E.run_summary({"t": spark.createDataFrame([("mixed", 2, 0.9)], "view string, k int, recall double")}, model="x")
    path = scratch_path(spark, "summary") + "/runs/one.json"
    E.write_summary(spark, path, summary)
    files = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "id string, key string")
    covered = E.coverage_counts(C.annotation_coverage(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), files, "key"))
    return _pairs(spark, [
        ("single", " ".join(f"{r.k}:{r.recall}" for r in single)), ("candidates", f"{E.candidates('image', [1, 10])} {E.candidates('audio', [5])} {E.candidates('text', [20])}"), ("sample", f"{len(sample)} {'in order' if sample == sorted(sample) else sample}"), ("small sample", E.sample_in_order([1], 5, 1)),
        ("views", underfilled), ("latency", f"{p['mean']} {round(p.p95, 6)} {round(p.p99, 6)}"), ("latency of none", M.latency(times.limit(0), "ms").first().n), ("summary", " ".join(str(v) for v in summary["t"][0].values())), ("written twice", error_of(lambda: E.write_summary(spark, path, summary))),
        ("cutoffs", M.cutoffs([5, 1, 5])), ("bad cutoffs", error_of(lambda: M.cutoffs([0, 1]))), ("no cutoffs", error_of(lambda: M.cutoffs([]))), ("coverage", ", ".join(f"{k} {v}" for k, v in sorted(covered.items()))), ("measured", E.measure_latency(spark, lambda q: q, [1, 2, 3]).first().n),
    ])


# ---- library --------------------------------------------------------------------------------------


@golden(
    "case_library",
    "step string, item string, value string",
    [
        ("plan", "audio", "3 new of 3"), ("plan", "image", "2 new of 2"), ("plan", "text", "3 new of 3"), ("report", "bad.wav", "new ParseError"), ("report", "bad.docx", "new ParseError"), ("report", "a.md", "new"), ("report", "b.html", "new"), ("report", "red.png", "new"), ("report", "copy.png", "new"), ("report", "low.wav", "new"), ("report", "high.wav", "new"),
        ("files", "a.md", "text 2 Harbour"), ("files", "b.html", "text 2 Lamps"), ("files", "red.png", "image 0"), ("files", "copy.png", "image 0"), ("files", "low.wav", "audio 2"), ("files", "high.wav", "audio 2"), ("search", "text", "a.md Bees"), ("search", "filtered", "b.html"), ("search", "image file", "red.png"), ("search", "audio file", "low.wav"), ("search", "grouped", "low.wav 0,1"),
        ("find", "width 10", "copy.png red.png"), ("duplicates", "copies", "2"), ("again", "work", "a.md updated, bad.docx new, bad.wav new"), ("again", "segments of a.md", "1"), ("removed", "files", "5"), ("removed", "segments", "5"),
    ],
)
def case_library(spark, _):
    """A folder of every modality indexed, searched, changed, indexed again, and a file removed."""
    folder = Path(_folder(spark, {"a.md": "# Harbour\n\nThe crane lifts boats.\n\n# Bees\n\nHoney in the hive.", "b.html": "<h1>Lamps</h1><p>Invoices for lamps.</p><h1>Two</h1><p>More.</p>", "bad.docx": "nothing", "red.png": png(10, 6), "copy.png": png(10, 6), "low.wav": tone(50, 3.0), "high.wav": tone(400, 3.0), "bad.wav": "no"}))
    library = Library(spark, scratch_path(spark, "library"), HashingModel(64), audio_model=SpectrumAudioModel(16, 1000, 2.0))
    out = []
    add = lambda step, item, value: out.append((step, item, str(value)))
    name = lambda r: r.path.rsplit("/", 1)[1]
    for r in library.counters(library.plan(str(folder))).collect():
        add("plan", r.file_type, f"{r.new_files} new of {r.total}")
    for r in library.index(str(folder)).collect():
        add("report", name(r), " ".join(filter(None, [r.change, (r.error or "").split(":")[0]])))
    for r in library.store.read(FILES).collect():
        add("files", r.file_name, " ".join(filter(None, [r.file_type, str(r.segment_count), r.title])))
    first = library.search(Request("text", text="honey hive bees"), 1).first()
    add("search", "text", f"{name(first)} {first.heading}")
    add("search", "filtered", name(library.search(interactive_request("lamps format:html", "text"), 1).first()))
    best = library.search(Request("image", file=folder / "red.png"), 2).collect()
    add("search", "image file", sorted(map(name, best))[-1])
    add("search", "audio file", name(library.search(Request("audio", file=folder / "low.wav"), 1).first()))
    group = library.search(Request("audio", file=folder / "low.wav"), 1, grouped=True).first()
    add("search", "grouped", f"{library.store.retrieve(FILES, [group.parent_id]).first().file_name} {','.join(map(str, sorted(group.matches)))}")
    from shelfmark.operators.filters import MetadataQuery

    add("find", "width 10", " ".join(sorted(r.file_name for r in library.find(MetadataQuery(min_width=10, max_width=10)).collect())))
    add("duplicates", "copies", library.duplicates().first().copies)
    (folder / "a.md").write_text("# Harbour\n\nOnly this.")
    add("again", "work", ", ".join(sorted(f"{name(r)} {r.change}" for r in library.index(str(folder)).collect())))
    add("again", "segments of a.md", library.store.read(SEGMENTS).filter("file_name = 'a.md'").count())
    library.remove(library.store.read(FILES).filter("file_name = 'low.wav'").select("id"))
    add("removed", "files", library.store.count(FILES))
    add("removed", "segments", library.store.count(SEGMENTS))
    return spark.createDataFrame(out, "step string, item string, value string")


@golden(
    "case_checks",
    NAMED,
    [
        ("segments", "3 1"), ("segment twice", "raised"), ("half a range", "raised"), ("empty range", "raised"), ("early range", "raised"), ("no parent", "raised"), ("operator", "ValueError"), ("in without values", "TypeError"), ("limit", "ValueError"), ("no vectors", "ValueError"), ("sizes", "ValueError"),
        ("zero vector", "raised"), ("counts", "2 3"), ("totals", "9 3 2 4 5"),
    ],
)
def case_checks(spark, _):
    """Validations of segments, conditions and searches, and sums over groups and queues."""
    from shelfmark.functions.vectors import unit

    schema = "parent_id string, segment_index int, start_seconds double, end_seconds double"
    segments = lambda *rows: C.checked_segments(spark.createDataFrame(list(rows), schema))
    raised = lambda run: "none" if error_of(run) == "none" else "raised"
    good = segments(("a", 0, None, None), ("a", 1, 0.0, 2.0), ("b", 0, None, None))
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "id string, v array<double>")
    groups = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "p string, matches array<int>")
    queues = spark.createDataFrame([("t", 4, 1, 1, 2, 2), ("i", 5, 2, 1, 2, 3)], "file_type string, total int, new_files int, updated_files int, unchanged_files int, work int")
    return _pairs(spark, [
        ("segments", f"{good.count()} {good.filter(C.is_timed()).count()}"), ("segment twice", raised(lambda: segments(("a", 0, None, None), ("a", 0, None, None)).collect())), ("half a range", raised(lambda: segments(("a", 0, 1.0, None)).collect())), ("empty range", raised(lambda: segments(("a", 0, 1.0, 1.0)).collect())), ("early range", raised(lambda: segments(("a", 0, -1.0, 1.0)).collect())), ("no parent", raised(lambda: segments((" ", 0, None, None)).collect())),
        ("operator", error_of(lambda: Condition("a", "like", 1))), ("in without values", error_of(lambda: Condition("a", "in", "abc"))), ("limit", error_of(lambda: S.top_k(vectors, "v", [1.0, 0.0], 0))), ("no vectors", error_of(lambda: S.multi_vector_top_k(vectors, "v", [], 5))), ("sizes", error_of(lambda: S.multi_vector_top_k(vectors, "v", [[1.0], [1.0, 2.0]], 5))), ("zero vector", raised(lambda: vectors.select(unit(F.array(L(0.0), L(0.0)))).collect())),
        ("counts", " ".join(map(str, C.matched_counts(groups).first()))), ("totals", " ".join(map(str, C.plan_totals(queues).first()))),
    ])


@golden("case_command_line", "arguments string, code int", [("", 2), ("x --index d", 2), ("x --limit 0 --target text", 2), ("--index d --format png", 2), ("x", 2), ("x --target text --min-res 5x5", 2), ("x --target audio --format png", 2), ("x --after never --target text", 2), ("--duplicates --yes", 2), ("--index /none/of/this", 2), ("--query-file x.pdf", 2)])
def case_command_line(spark, _):
    """Exit codes of usage errors; their messages go to the error stream."""
    import contextlib

    from shelfmark.__main__ import main

    lines = ["", "x --index d", "x --limit 0 --target text", "--index d --format png", "x", "x --target text --min-res 5x5", "x --target audio --format png", "x --after never --target text", "--duplicates --yes", "--index /none/of/this", "--query-file x.pdf"]
    library = scratch_path(spark, "library")
    with contextlib.redirect_stderr(io.StringIO()):
        codes = [main([*line.split(), "--library", library]) for line in lines]
    return spark.createDataFrame(list(zip(lines, codes)), "arguments string, code int")


# ---- timestamps -----------------------------------------------------------------------------------

_US = 1_000_000
TIMES = [
    ("2021-03-14 02:30:00", "America/New_York", 1615707000 * _US), ("2021-11-07 01:30:00", "America/New_York", 1636263000 * _US), ("D:20201101012100-07'00'", None, 1604218860 * _US), ("D:20201101012100", "Asia/Tokyo", 1604161260 * _US), ("11/02/2019 5:07 PM", "America/New_York", 1572728820 * _US),
    ("30/04/2023 21:47", "Europe/London", 1682887620 * _US), ("Mon, 03 Sep 2018 09:16:38 +0200", None, 1535958998 * _US), ("1602481245506563", "x", 1602481245506563), ("1602481245506563999", None, 1602481245506563), ("20221120", "America/New_York", 1668920400 * _US), ("19 November 2018", "Asia/Kolkata", 1542565800 * _US),
    ("2023-04-30T07:57:34.363828444Z", None, 1682841454363828), ("2150-07-01 12:00:00", "America/New_York", 5695977600 * _US), ("Thu Nov 26 2026 14:12:00 GMT+0100 (some zone or other)", "Asia/Tokyo", 1795698720 * _US), ("1.7.2018 22:02:44", None, 1530482564 * _US), ("2019-07-20", "Europe/Istanbul", 1563570000 * _US),
    ("9999999999999999999", None, None), ("2023-02-29", None, None), ("yesterday", None, None), ("", None, None), (None, "Europe/Berlin", None), ("2020-01-01 00:00", "Nowhere/Land", None), ("30/04/2023 21:47", "America/Bogota", None), ("2020-01-01 24:00", None, None),
]


@golden("case_timestamps", "raw string, zone string, utc_us bigint", TIMES)
def case_timestamps(spark, _):
    """Strings of many origins and the instants they state; null for those that state none."""
    rows = spark.createDataFrame([(k, *t[:2]) for k, t in enumerate(TIMES)], "k bigint, raw string, zone string")
    return rows.join(normalise_timestamps(rows, "k", ["raw"], "zone").select("k", "utc_us"), "k").select("raw", "zone", "utc_us")
