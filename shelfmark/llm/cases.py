"""Golden tables and invariants of the training-data operators that SQL can't express; see ``shelfmark.cases``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.cases import golden
from shelfmark.llm.encode import decode_column, encode_column
from shelfmark.llm.markup import clean_markup
from shelfmark.llm.packing import pack_containers
from shelfmark.llm.sentences import split_sentences

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
INTO = (QUERIES, SQL)

_PAGE = (
    "<html><head><title>T</title></head><body><div><a href='1'>Ad one</a><a href='2'>Ad two</a></div><h1>A title</h1><div>"
    + "".join(f"<p>Paragraph {k} of the content, which is prose of some length and holds no link at all.</p>" for k in range(6))
    + "</div><div>Copyright 2026 <a href='3'>terms</a></div></body></html>"
)
_PROSE = "A title\n\n" + "\n\n".join(f"Paragraph {k} of the content, which is prose of some length and holds no link at all." for k in range(6))
_LINKS = "<a href='1'>Home</a> <a href='2'>News archive</a> <a href='3'>Contact us</a>"
_TWO = "<div><p>A long paragraph of real prose that says something of weight.</p><p>Another long paragraph of prose with many words in it.</p></div>"
_BOTH = "A long paragraph of real prose that says something of weight.\n\nAnother long paragraph of prose with many words in it."
#: (stored role, text, role that must come out, clean text, whether there was markup).
BLOCKS = [
    *[("other", text, "heading", "Head", True) for text in ("## Head ##", "Head\n====", "== Head ==", "\\section*{Head}", "<h3>Head</h3>")],
    *[("other", text, "list_item", "item", True) for text in ("* item", "- [x] item", "** item", "\\item item", "<ul><li>item</li></ul>", "\\begin{itemize}\n\\item item\n\\end{itemize}", "<li>item</li>")],
    *[("other", text, "quote", "cited", True) for text in ("> cited", "<blockquote><p>cited</p></blockquote>", "\\begin{quote}\ncited\n\\end{quote}")],
    *[("other", text, "code", "a < 1", True) for text in ("```c\na < 1\n```", "<pre><code>a &lt; 1</code></pre>", "\\begin{verbatim}\na < 1\n\\end{verbatim}")],
    *[("other", text, "table", "a | b\nc | d", True) for text in ("a | b\n--- | ---\nc | d", '{| class="x"\n|-\n! a !! b\n|-\n| c || d\n|}', "\\begin{tabular}{ll}\na & b \\\\\nc & d \\\\\n\\end{tabular}", "<table><tr><th>a</th><th>b</th></tr><tr><td>c</td><td>d</td></tr></table>")],
    *[("quote", text, "other", "x^2", True) for text in ("$$x^2$$", "\\[ x^2 \\]", "<math>x^2</math>", "\\begin{align*}\nx^2\n\\end{align*}")],
    *[("quote", text, "paragraph", "prose", True) for text in ("<div><p>prose</p></div>", "<p>prose")],
    *[("quote", text, "quote", "a b c", True) for text in ("a **b** c", "a [b](https://x.example/y) c", "a [[X|b]] c", "a '''b''' c", "a \\emph{b} c", "a `b` c", "a <b>b</b> c")],
    ("quote", "a<br/>b", "quote", "a\nb", True), ("quote", "a&amp;b", "quote", "a&b", True), ("quote", "a {{t|x=1}}", "quote", "a", True), ("quote", "a &lt;b&gt; c", "quote", "a <b> c", True), (None, "a ~~b~~", None, "a b", True),
    *[("paragraph", text, "paragraph", text, False) for text in ("C# #86", "$21 / $73", "8 * 9 * 4", "~/a/b", "a == b", "<- x", "x < y > 3", "L&B", "{word}", "see[8]", "C:\\dir\\section\\x", "a | b | 3\nc | d | 4", "x -> y", "'word'", "")],
    ("code", "<p>x</p>", "code", "<p>x</p>", False), ("code", "# x", "code", "# x", False), ("heading", None, "heading", None, False),
    ("other", _PAGE, None, _PROSE, True), *[("other", side, None, _BOTH, True) for side in (f"<div><div>{_LINKS}</div></div>{_TWO}", f"{_TWO}<ul><li>{_LINKS}</li></ul>", f"<table><tr><td>{_LINKS}</td></tr></table>{_TWO}")],
]
#: Pages whose content isn't the whole block: the role of the content's path, if all that is left out is no content.
BLOCKS = [(b[0], b[1], "other" if b[1] == _PAGE else "paragraph" if b[3] == _BOTH else b[2], b[3], b[4]) for b in BLOCKS]


@golden("case_markup", "stored string, raw string, block_type string, text string, had_markup boolean", BLOCKS, INTO)
def case_markup(spark, _):
    """Blocks and pages in every markup, and text that only looks like it."""
    rows = spark.createDataFrame([(k, b[0], b[1]) for k, b in enumerate(BLOCKS)], "k int, stored string, raw string")
    cleaned = clean_markup(rows, "k", "raw", "stored")
    return rows.join(cleaned, "k").select("stored", "raw", "block_type", "text", "had_markup")


SENTENCES = [
    ["Dr. Smith paid 3.5 euros.", "Then he left!"], ["He said “Stop. That is mine.” and left.", "Rain fell."], ["Name: “One. Two. Three.”", "Next."], ["« Arrêtez ! C'est ça », dit Meb.", "Voir fig. 4 ?", "Oui."],
    ["Die 20. Fassung kam um 20.42 Uhr, die 42. fehlt noch.", "Das war und ist es."], ['"توقف! هذا ملفي" قال Poune ثم أغلق الباب.', "قاس د. Fa الصمت؟"], ["Он сложил ленты и т. д.", "Протокол готов, т. е. всё."], ["डॉ. राम आए।", "वह गया।"], ["One line\nbreak stays."], ["She wrote “" + " ".join(f"We saw house number {k} today." for k in range(40)) + "” and left.", "Then it rained."],
]
UNSPACED = [["「待って！それは私の。」とFebは言った。", "Dada：「複製する。」", "次の文！"], ["“停下！那是我的。”Fes说完就走了。", "下一句？"]]
THAI = ["คิวนำเข้าคัดลอกรายการ", "บริการค้นหาจัดเรียงบท"]
TEXTS = [*(" ".join(s) for s in SENTENCES), *("".join(s) for s in UNSPACED), " ".join(THAI), "A heading\n\nSome text. More.", None, "", " \n\t"]
WANTED = [*SENTENCES, *UNSPACED, THAI, ["A heading", "Some text.", "More."], None, None, None]


@golden("case_sentence_spans", "doc int, n int, sentence string", [(k, n, s) for k, own in enumerate(WANTED) for n, s in enumerate(own or [])], INTO)
def case_sentence_spans(spark, _):
    """Sentences of ten languages, with abbreviations, quotations, headings and scripts without spaces."""
    from pyspark.sql import Window as W

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, text string")
    found = split_sentences(docs, "doc", "text").join(docs, "doc")
    # Offsets count code points, as Spark's substring does.
    piece = F.substring(F.col("text"), F.col("sent_start") + 1, F.col("sent_end") - F.col("sent_start"))
    return found.select("doc", (F.row_number().over(W.partitionBy("doc").orderBy("sent_start")) - 1).alias("n"), piece.alias("sentence"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; the same bytes must come back. Null and empty texts are empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    back = decode_column(encode_column(docs, ["doc_id"], "text"), ["doc_id"], "ids")
    return back.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context_name, docs, overfull, torn, gaps): what must hold of all containers of each capacity."""
    sizes = spark.read.parquet(f"{sf_dir}/context_sizes.parquet")
    capacities = {r.context_name: r.capacity_tokens for r in sizes.collect()}
    rows = pack_containers(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", capacities, group="lang").join(F.broadcast(sizes), "context_name")
    length = F.col("token_end") - F.col("token_start")
    full = rows.groupBy("context_name", "container_id").agg(F.sum(length).alias("held"), F.max("capacity_tokens").alias("room"))
    over = full.groupBy("context_name").agg(F.sum(F.when(F.col("held") > F.col("room"), 1).otherwise(0)).alias("overfull"))
    whole = rows.groupBy("context_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(length).alias("tokens"), F.max("token_end").alias("last"), F.max("capacity_tokens").alias("room"))
    per = whole.groupBy("context_name").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.when((F.col("pieces") > 1) & (F.col("tokens") <= F.col("room")), 1).otherwise(0)).alias("torn"), F.sum(F.when(F.col("tokens") != F.col("last"), 1).otherwise(0)).alias("gaps")
    )
    return per.join(over, "context_name").select("context_name", "docs", "overfull", "torn", "gaps")


QUERIES |= {"p8_roundtrip": p8_roundtrip, "p9_invariants": p9_invariants}
SQL |= {
    "p8_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
    "p9_invariants": "SELECT context_name, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND text <> '') AS docs, 0::BIGINT AS overfull, 0::BIGINT AS torn, 0::BIGINT AS gaps FROM context_sizes",
}
