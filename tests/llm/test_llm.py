"""Training-data operators on small tables: defined results for odd rows, and agreement with brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm.encode import TOKENIZERS, Encoder, Lexicon, _merger, encode_column
from shelfmark.llm.language import Model, SuffixAutomaton, departing_languages, dominant_language, fit, letters_of, named_language, phrases, segment_languages
from shelfmark.llm.markup import clean_block, clean_markup, main_content, parse_html
from shelfmark.llm.neardup import Signer, agreement, class_links, class_members, estimate, expand, near_duplicates, normal_text, normal_texts, similar_classes
from shelfmark.llm.packing import fill_by_likeness, fill_by_size, pack_containers
from shelfmark.llm.sentences import sentences, split_sentences
from shelfmark.llm.topn import top_n_per_group
from shelfmark.llm.vectors import similar_vectors

DATA = "/root/testdata/sf0.001"


# ---- vectors ----------------------------------------------------------------------------------


def brute_neighbours(rows, k):
    out = {}
    good = {i: (s, np.array(v, dtype=np.float64)) for i, s, v in rows if i is not None and s is not None and v is not None and len(v) == 4 and None not in v and np.isfinite(v).all() and np.any(v)}
    for i, (s, v) in good.items():
        near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, (t, w) in good.items() if j != i and t == s]
        out[i] = [j for _, j in sorted(near)[:k]]
    return out


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(k, "ab"[k % 2], [float(x) for x in np.float32(rng.normal(size=4))]) for k in range(300)]
    rows += [(300 + k, "a", rows[0][2]) for k in range(9)]
    rows += [(400, "a", None), (401, "a", [0.0] * 4), (402, "a", [1.0, float("nan"), 0.0, 0.0]), (403, "a", [1.0]), (404, None, [1.0] * 4), (405, "c", [1.0] * 4), (406, "a", [1.0, None, 0.0, 0.0]), rows[5]]
    return rows


SCHEMA = "vec_id bigint, vector_name string, vectors array<float>, class int, space string, p int"


def test_vectors_against_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    want = brute_neighbours(rows, 5)
    for options in ({}, {"list_rows": 60, "tile_rows": 20}, {"list_rows": 10, "tile_rows": 7}):
        got = {}
        for r in similar_vectors(df, "vec_id", "vector_name", "vectors", 5, dims=4, length=16, **options).orderBy("vec_id", "rank").collect():
            got.setdefault(r.vec_id, []).append(r.neighbour_id)
        assert set(got) <= set(want) and not set(got) & set(range(400, 407)) - {405}
        right = sum(len(set(got.get(i, [])) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
        assert right >= 0.97, (options, right)
        # Copies are found exactly: the smallest keys first.
        assert got[308] == [0, 300, 301, 302, 303]


def test_vectors_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_vectors(empty, "vec_id", "vector_name", "vectors", dims=4).count() == 0
    two = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0, 0.0], 0, "", 0), (2, "a", [0.9, 0.1, 0.0, 0.0], 0, "", 0)], SCHEMA)
    assert [tuple(r)[:2] for r in similar_vectors(two, "vec_id", "vector_name", "vectors", dims=4).orderBy("vec_id").collect()] == [(1, 2), (2, 1)]
    asked = similar_vectors(two, "vec_id", "vector_name", "vectors", dims=4, queries=F.col("vec_id") == 2, min_cosine=0.99)
    assert [r.vec_id for r in asked.collect()] == [2]


def test_vectors_in_a_dense_cluster(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    points = np.float32(np.concatenate([rng.normal(size=(1200, 64)), centre + 0.1 * rng.normal(size=(900, 64))]))
    df = spark.createDataFrame([(k, "a", [float(x) for x in v]) for k, v in enumerate(points)], "vec_id bigint, space string, v array<float>")
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -9)
    want = {(a, int(b)) for a in range(1200, 2100) for b in np.argsort(-cosine[a])[:5]}
    for options in ({}, {"list_rows": 400, "tile_rows": 200}):
        found = similar_vectors(df, "vec_id", "space", "v", 5, min_cosine=0.85, **options).collect()
        assert len(want & {(r.vec_id, r.neighbour_id) for r in found}) / len(want) >= 0.99, options


def test_vectors_among_many_pivots(spark):
    points = np.float32(np.random.default_rng(3).normal(size=(4000, 16)))
    df = spark.createDataFrame([(k, "a", [float(x) for x in v]) for k, v in enumerate(points)], "vec_id bigint, space string, v array<float>")
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    cosine = unit[:200] @ unit.T
    cosine[np.arange(200), np.arange(200)] = -9
    want = {(a, int(b)) for a in range(200) for b in np.argsort(-cosine[a])[:5]}
    found = similar_vectors(df, "vec_id", "space", "v", 5, dims=16, queries=F.col("vec_id") < 200, length=4, per_pivot=1).collect()
    assert len(want & {(r.vec_id, r.neighbour_id) for r in found}) / len(want) >= 0.9


def test_vectors_in_lists_split_by_pivots_of_their_own(spark, monkeypatch):
    import shelfmark.llm.vectors as vectors

    monkeypatch.setattr(vectors, "CHUNK_ROWS", 500)
    points = np.float32(np.random.default_rng(6).normal(size=(3000, 12)))
    df = spark.createDataFrame([(k, "a", [float(x) for x in v]) for k, v in enumerate(points)], "vec_id bigint, space string, v array<float>")
    unit = points.astype(np.float64) / np.linalg.norm(points.astype(np.float64), axis=1, keepdims=True)
    cosine = unit[:150] @ unit.T
    cosine[np.arange(150), np.arange(150)] = -9
    want = {(a, int(b)) for a in range(150) for b in np.argsort(-cosine[a])[:5]}
    # 64 lists of 750 rows, where at most 400 are compared whole.
    found = similar_vectors(df, "vec_id", "space", "v", 5, dims=12, queries=F.col("vec_id") < 150, per_pivot=100_000, list_rows=300, tile_rows=200, most_tiles=2).collect()
    assert len(want & {(r.vec_id, r.neighbour_id) for r in found}) / len(want) >= 0.9


# ---- top n ------------------------------------------------------------------------------------


def test_top_n(spark):
    rng = random.Random(1)
    hits = [(k, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["f1", "f2", "f3", "f4", "f5", "f6", None]), rng.choice([None, 0, 1, 2]), rng.choice([0.5, 0.9, rng.random(), float("nan"), float("inf"), None])) for k in range(3000)]
    df = spark.createDataFrame(hits, "hit_id bigint, query_id string, file_id string, segment_index int, score double").withColumn("_g", F.lit(1))
    best = {}
    for h, q, f, s, v in hits:
        if f is not None and v is not None and np.isfinite(v):
            best.setdefault(q, {})
            best[q][(f, s)] = min(best[q].get((f, s), (0.0, 10**9)), (-v, h))
    want = {(q, h) for q, items in best.items() for _, _, _, h in sorted((v, f, -1 if s is None else s, h) for (f, s), (v, h) in items.items())[:5]}
    for heavy in (10_000, 100):
        top = top_n_per_group(df, "query_id", "score", ["file_id", "segment_index"], "hit_id", 5, heavy_rows=heavy, slice_rows=5)
        assert {(r.query_id, r.hit_id) for r in top.collect()} == want
    assert top_n_per_group(df.limit(0), "query_id", "score", ["file_id"], "hit_id").count() == 0


# ---- language ---------------------------------------------------------------------------------


def test_suffix_automaton_and_phrases():
    text = [1, 2, 1, 2, 3, 1, 2, 3, 3]
    automaton = SuffixAutomaton()
    automaton.extend(text)
    keys, to = automaton.arcs()
    arcs = dict(zip(keys.tolist(), to.tolist()))
    subs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    for n in range(1, 5):
        for word in itertools.product([1, 2, 3], repeat=n):
            assert (phrases(list(word), arcs, 99) == 1) == (word in subs)

    def parse(codes):
        at = count = 0
        while at < len(codes):
            end = at + 1
            while end < len(codes) and tuple(codes[at : end + 1]) in subs:
                end += 1
            at, count = end, count + 1
        return count

    rng = random.Random(2)
    for _ in range(200):
        codes = [rng.randint(1, 3) for _ in range(rng.randint(1, 30))]
        assert phrases(codes, arcs, 99) == parse(codes)
        assert phrases(codes, arcs, 2) > 2 or parse(codes) <= 2


def test_labels(spark):
    labels = ["en_GB", "Deutsch", "GER", "zh-Hans-CN", "und", "", None, "русский", " FR ", "english-ish", "xx"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(named_language(F.col("l"))).collect()]
    assert got == ["en", "de", "de", "zh", None, None, None, "ru", "fr", None, None]
    assert letters_of("Datei abc_12.pdf ist DA") == "datei ist da" and letters_of("搜索服务Abc-12没有") == "搜索服务 没有"


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.filter("doc_id % 2 = 0"), "doc_id", "text", "lang")
    held = docs.filter("doc_id % 2 = 1 and lang is not null and length(trim(text)) > 60")
    segments = segment_languages(held, ["doc_id"], "text", model).cache()
    joined = dominant_language(segments, "doc_id").alias("g").join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert sum(r.lang == r.truth for r in joined) / len(joined) > 0.97
    assert all(0 <= r.confidence <= 1 for r in joined)


def test_language_edges(spark):
    model = Model.build({"en": ["the old map of the harbour"], "de": ["die alte karte vom hafen"]})
    rows = spark.createDataFrame([("f", 0, "the old map\n\ndie alte karte"), ("f", 1, None), ("f", 2, " \n "), ("g", 0, "12 34"), ("f", 0, "the old map\n\ndie alte karte")], "file_id string, chunk_index int, text string").withColumn("lang", F.lit("zz"))
    segments = segment_languages(rows, ["file_id", "chunk_index"], "text", model)
    assert [(r.file_id, r.lang, r.seg_start) for r in segments.filter("chunk_index = 0").orderBy("file_id", "seg_start").collect()] == [("f", "en", 0), ("f", "en", 0), ("f", "de", 13), ("f", "de", 13), ("g", None, 0)]
    labels = spark.createDataFrame([("f", "English"), ("f", "English"), (None, "de")], "file_id string, label string")
    assert [(r.file_id, r.chunk_index, r.lang) for r in departing_languages(segments, labels, "file_id", "chunk_index", "label").collect()] == [("f", 0, "de")]
    assert segment_languages(rows.limit(0), ["file_id"], "text", model).count() == 0
    assert segment_languages(rows, ["file_id"], "text", Model({}, {})).filter("lang is not null").count() == 0


# ---- near duplicates --------------------------------------------------------------------------


def jaccard(a, b, w):
    x, y = ({t[i : i + w] for i in range(max(1, len(t) - w + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    for k in range(60):
        parts = texts[k].split()
        for _ in range(rng.randint(0, 6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        texts.append(" ".join(parts))
    texts += [texts[0]] * 3 + ["ab", "ab", "abc"]
    rows = [(f"k{k:03d}", f"g{k % 50}", t) for k, t in enumerate(texts)]
    odd = [(None, "g", "x"), ("n1", None, texts[1]), ("n2", "g", None), ("n3", "g", ""), rows[4]]
    df = spark.createDataFrame(rows + odd, "key string, grp string, text string").withColumn("class", F.lit(1))
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and jaccard(a[2], b[2], 5) >= 0.7}
    got = {(r.key_a, r.key_b): r.similarity for r in near_duplicates(df, "key", "text", "grp", 5, 0.7, 50, 6).collect()}
    assert set(got) <= want and len(set(got)) >= 0.99 * len(want)
    assert near_duplicates(df.limit(0), "key", "text", "grp", 5, 0.7, 50, 6).count() == 0


def test_large_classes_as_stars(spark):
    links = spark.createDataFrame([(1, 2, 0.9)], "class_a bigint, class_b bigint, similarity double")

    def pairs(members):
        rows = spark.createDataFrame(members, "key string, grp string, class bigint")
        found = [(r.key_a, r.key_b) for r in expand(rows, links).collect()]
        group = {k: g for k, g, _ in members}
        assert len(found) == len(set(found)) and all(a < b and group[a] != group[b] for a, b in found)
        return set(found)

    # 101 copies and one different text: all pairs of the link.
    copies = [(f"a{k:03}", f"f{k}", 1) for k in range(101)]
    assert {(a, "z") for a, _, _ in copies} <= pairs([*copies, ("z", "other", 2)])
    # Both classes are large, begin in the same file, and have more members of it.
    first = [(f"a{k:03}", "same" if k < 20 else f"f{k}", 1) for k in range(160)]
    last = [(f"b{k:03}", "same" if k < 20 else f"g{k}", 2) for k in range(160)]
    found = pairs(first + last)
    inner = {k for p in found if p[0][0] == p[1][0] for k in p}
    between = {k for p in found if p[0][0] != p[1][0] for k in p}
    assert inner == between == {k for k, _, _ in first + last}
    reached, todo = set(), ["a000"]
    while todo:
        key = todo.pop()
        reached.add(key)
        todo += [x for p in found if key in p for x in p if x not in reached]
    assert reached == between


def test_hot_bucket_in_tiles(spark):
    base = "the quick brown fox jumps over the lazy dog and runs through the dark forest until the morning comes again "
    texts = [(k, base + f"number {k}") for k in range(60)]
    df = spark.createDataFrame(texts, "class bigint, text string")
    whole = {(r.class_a, r.class_b) for r in similar_classes(df, 5, 0.7, 30, 4).collect()}
    tiled = {(r.class_a, r.class_b) for r in similar_classes(df, 5, 0.7, 30, 4, tile=7).collect()}
    assert whole == tiled == set(itertools.combinations(range(60), 2))


def test_bbit_estimate_and_white_space(spark):
    signer = Signer(5, 64, 8, 2)
    a, b = ("".join(random.Random(s).choice("abcdefgh") for _ in range(400)) for s in (1, 2))
    mixed = a[:320] + b[:80]
    packed = [np.frombuffer(signer.pack(signer.minima(t)), np.uint8)[None, :] for t in (a, mixed)]
    assert abs(estimate(agreement(*packed, 2, 512), 2)[0] - jaccard(a, mixed, 5)) < 0.1
    long = "x" * 5000 + a
    assert signer.minima(long).shape == (512,)
    assert spark.createDataFrame([(" a\u00a0\u202f b\r\n\tC ",)], "t string").select(normal_text(F.col("t"))).first()[0] == "a b C"


# ---- markup -----------------------------------------------------------------------------------

BLOCKS = [
    ("## Head ##", "heading", "Head"), ("Head\n====", "heading", "Head"), ("== Head ==", "heading", "Head"), ("\\section*{Head}", "heading", "Head"), ("<h3>Head</h3>", "heading", "Head"),
    ("* item", "list_item", "item"), ("- [x] item", "list_item", "item"), ("** item", "list_item", "item"), ("\\item item", "list_item", "item"), ("<ul><li>item</li></ul>", "list_item", "item"), ("\\begin{itemize}\n\\item item\n\\end{itemize}", "list_item", "item"),
    ("> cited\n> more", "quote", "cited\nmore"), ("<blockquote><p>cited</p></blockquote>", "quote", "cited"), ("\\begin{quote}\ncited\n\\end{quote}", "quote", "cited"),
    ("```c\na = 1\n```", "code", "a = 1"), ("<pre><code>a &lt; 1</code></pre>", "code", "a < 1"), ("\\begin{verbatim}\na\n\\end{verbatim}", "code", "a"),
    ("a | b\n--- | ---\nc | d", "table", "a | b\nc | d"), ("{| class=\"x\"\n|-\n! a !! b\n|-\n| c || d\n|}", "table", "a | b\nc | d"), ("\\begin{tabular}{ll}\na & b \\\\\nc & d \\\\\n\\end{tabular}", "table", "a | b\nc | d"),
    ("$$x^2$$", "other", "x^2"), ("\\[ x^2 \\]", "other", "x^2"), ("<math>x^2</math>", "other", "x^2"), ("\\begin{align*}\nx\n\\end{align*}", "other", "x"), ("<div><p>prose</p></div>", "paragraph", "prose"), ("<p>open", "paragraph", "open"),
    ("a **b** c", None, "a b c"), ("a [b](https://x.example/y) c", None, "a b c"), ("a [[X|b]] c", None, "a b c"), ("a '''b''' c", None, "a b c"), ("a<br/>b", None, "a\nb"), ("a \\emph{b} c", None, "a b c"), ("a $x^2$ b", None, "a x^2 b"), ("a&amp;b", None, "a&b"), ("a `b` c", None, "a b c"), ("a ~~b~~", None, "a b"), ("a {{t|x=1}}", None, "a"), ("a \\cite{b}", None, "a"),
]
PLAIN = ["C# #86", "$21 / $73", "8 * 9 * 4", "~/a/b", "a == b", "<- x", "x < y > 3", "L&B", "{word}", "see[8]", "zaf* lag**", "C:\\dir\\section\\x", "https://x.example/a?b=2&c=3", "a | b | 3\nc | d | 4", "", None, "x -> y", "'word'"]


def test_blocks():
    for text, role, clean in BLOCKS:
        assert clean_block(text) == (clean, role, True), text
    for text in PLAIN:
        assert clean_block(text) == (text, None, False), text


def test_text_density_finds_content():
    page = "<div><ul><li><a href='x'>home</a></li><li><a href='y'>about</a></li></ul></div><div><p>A long paragraph of real prose that says something.</p><p>Another long paragraph of prose with words.</p></div>"
    content, threshold = main_content(parse_html(page))
    assert [c.tag for c in content.children] == ["p", "p"] and 0 < threshold <= content.density
    # Nesting without bound.
    assert clean_block("<b>" * 3000 + "x") == ("x", None, True)


def test_text_density_drops_boilerplate():
    prose = "<div><p>A long paragraph of real prose that says something of weight.</p><p>Another long paragraph of prose with many words in it.</p></div>"
    links = "<a href='1'>Home</a> <a href='2'>News archive</a> <a href='3'>Contact us</a>"
    clean = "A long paragraph of real prose that says something of weight.\n\nAnother long paragraph of prose with many words in it."
    for side in (f"<div><div>{links}</div></div>", f"<ul><li>{links}</li></ul>", f"<table><tr><td>{links}</td></tr></table>"):
        for page in (side + prose, prose + side):
            assert clean_block(page)[0] == clean, page
    # Prose and headings beside the content stay, and so do links inside of it.
    kept = clean_block("<h2><a href='1'>Title</a></h2>" + prose + "<div><p>Short prose.</p></div>")[0]
    assert "Title" in kept and clean in kept and "Short prose." in kept
    assert clean_block(f"<p>{links}</p>")[0] == "Home News archive Contact us"


def test_density_decides_roles_and_text(monkeypatch):
    """Without the choice of the content no block gets a role from its markup, and pages keep what isn't content."""
    import shelfmark.llm.markup as markup

    page = (
        "<html><head><title>T</title></head><body><div><a href='1'>Ad one</a><a href='2'>Ad two</a></div><h1>A title</h1><div>"
        + "".join(f"<p>Paragraph {k} of the content, which is prose of some length and holds no link at all.</p>" for k in range(6))
        + "</div><div>Copyright 2026 <a href='3'>terms</a></div></body></html>"
    )
    clean = clean_block(page)[0]
    assert clean.startswith("A title\n\nParagraph 0") and clean.endswith("no link at all.") and "Ad one" not in clean and "Copyright" not in clean
    # The same of Markdown, whose links are elements of the same tree.
    assert clean_block("- [Home](/a/b) and more\n- text")[:2] == ("Home and more\ntext", "list_item")
    before = [clean_block(t) for t, _, _ in BLOCKS]
    monkeypatch.setattr(markup, "main_content", lambda body: (body, 0.0))
    after = [clean_block(t) for t, _, _ in BLOCKS]
    assert sum(a[1] is not None for a in before) == 26 and all(a[1] is None for a in after)
    assert "Ad one" in clean_block(page)[0] and "Copyright" in clean_block(page)[0]
    assert [c[:2] for c in (clean_block("<li>a</li><li>b</li>"), clean_block("<td>a</td>"))] == [("a\nb", None), ("a", None)]


def test_implied_parents():
    assert [clean_block(t)[:2] for t in ("<li>a</li><li>b</li>", "<tr><td>a</td><td>b</td></tr>", "<dt>a</dt><dd>b</dd>")] == [("a\nb", "list_item"), ("a | b", "table"), ("a\nb", "list_item")]
    # A page of links alone has no other content.
    assert clean_block("<ul><li><a href='1'>x</a></li><li><a href='2'>y</a></li></ul>")[:2] == ("x\ny", "list_item")


def test_markup_table(spark):
    rows = [(1, "<p>x</p>", "other"), (2, "<p>x</p>", "code"), (3, None, None), (4, "plain", None), (4, "plain", None)]
    df = spark.createDataFrame(rows, "block_id bigint, text string, block_type string").withColumn("had_markup", F.lit("clash"))
    got = sorted(tuple(r) for r in clean_markup(df, "block_id", "text", "block_type").collect() if r.block_id != 3)
    assert got[:2] == [(1, "paragraph", "x", True), (2, "code", "<p>x</p>", False)] and len(got) == 4
    assert clean_markup(df.limit(0), "block_id", "text", "block_type").count() == 0


# ---- encoding ---------------------------------------------------------------------------------


def test_lexicon_is_exact_and_minimal(tmp_path):
    rng = random.Random(5)
    entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): [rng.randrange(99) for _ in range(rng.randint(1, 3))] for _ in range(300)}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(Lexicon.build(entries).pack())
    lexicon = Lexicon.map(str(path))
    words = sorted(entries)
    assert lexicon.index(words).tolist() == list(range(len(words)))
    assert lexicon.index([b"", b"zz", words[0] + b"zzz"]).tolist() == [-1, -1, -1]
    for k, w in enumerate(words):
        assert lexicon.ids[lexicon.offsets[k] : lexicon.offsets[k + 1]].tolist() == entries[w]
    # Minimal: no two states have the same right language.
    arcs = {}
    for key, to in zip(lexicon.keys.tolist(), lexicon.targets.tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, to))
    states = [(int(f), tuple(arcs.get(s, ()))) for s, f in enumerate(lexicon.final[:-1])]
    assert len(set(states)) == len(states)
    assert Lexicon.build({}).index([b"a"]).tolist() == [-1]


def test_lexicon_without_a_mounted_folder(spark):
    from shelfmark.llm.encode import _mapped, _place

    place = _place(spark, Lexicon.build({b"ab": [1, 2], b"cb": [3]}).pack(), mounted=False)
    assert not place.startswith("/")
    found = spark.range(4).repartition(2).rdd.map(lambda _: _mapped(place).index([b"ab", b"cb", b"c"]).tolist()).collect()
    assert found == [[0, 1, -1]] * 4


def test_encoding_equals_the_tokenizer(spark):
    odd = [None, "", " ", "\n\n", "<|endoftext|> x", "na\u0308ive é 中文字 ไทย 🙂", "a" * 30_000, "  x\u00a0 y  ", "it's we'll I'D", "\ud7ff\x00\x01", "12345678901234567890"]
    rows = [(k, t, 1) for k, t in enumerate(odd)] + [(99, "again", 1), (99, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    _, reference = _merger(TOKENIZERS, "byte_bpe_50k")
    got = [(r.doc_id, list(r.ids)) for r in encode_column(df, ["doc_id"], "text").orderBy("doc_id").collect()]
    assert got == [(k, reference.encode_ordinary(t or "")) for k, t, _ in rows]
    assert encode_column(df.limit(0), ["doc_id"], "text").count() == 0
    assert Encoder(Lexicon.build({}), TOKENIZERS, "byte_bpe_50k").encode(["round trip"])[0].tolist() == reference.encode_ordinary("round trip")


# ---- packing ----------------------------------------------------------------------------------


def test_fillers():
    rng = random.Random(6)
    for _ in range(30):
        capacity = rng.randint(5, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        for boxes in (fill_by_size(sizes, capacity), fill_by_likeness(sizes, capacity, None)):
            assert sorted(i for b in boxes for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= capacity for b in boxes)
            assert len(boxes) <= 11 / 9 * max(-(-sum(sizes) // capacity), sum(s > capacity / 2 for s in sizes)) + 3


def test_containers(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("piece", F.lit("clash"))
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, " "), (9004, "word " * 3000)], "doc_id bigint, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    sizes = {r.doc_id: len(r.ids) for r in encode_column(docs, ["doc_id"], "text").collect() if r.ids}
    for options in ({"group": "lang"}, {"shard_docs": 7, "rest_items": 9}):
        rows = pack_containers(docs, "doc_id", "text", {"s": 300, "m": 5000}, **options).collect()
        for name, capacity in (("s", 300), ("m", 5000)):
            mine = [r for r in rows if r.context_name == name]
            boxes, pieces = {}, {}
            for r in mine:
                boxes[r.container_id] = boxes.get(r.container_id, 0) + r.token_end - r.token_start
                pieces.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
            assert max(boxes.values()) <= capacity and set(pieces) == set(sizes)
            for doc, cuts in pieces.items():
                cuts.sort()
                assert cuts[0][0] == 0 and cuts[-1][1] == sizes[doc] and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
                assert len(cuts) == 1 or sizes[doc] > capacity
    with pytest.raises(ValueError):
        pack_containers(docs, "doc_id", "text", {"s": 0})
    assert pack_containers(docs.limit(0), "doc_id", "text", {"s": 10}).count() == 0


# ---- sentences --------------------------------------------------------------------------------

SENTENCES = [
    ("A heading 3\n\nOne here. Two\nthere!", ["A heading 3", "One here.", "Two\nthere!"]),
    ("Dr. Vru measured approx. 15.22 s, i.e. more than Mr. Ke. Next one?", ["Dr. Vru measured approx. 15.22 s, i.e. more than Mr. Ke.", "Next one?"]),
    ("It opened at 9 a.m. and closed at 5 p.m. Then rain.", ["It opened at 9 a.m. and closed at 5 p.m.", "Then rain."]),
    ('J. R. Zei wrote "Who did it? I did." on the box. Well... perhaps so.', ['J. R. Zei wrote "Who did it? I did." on the box.', "Well... perhaps so."]),
    ('Ann: "It is late! So late." The end.', ['Ann: "It is late! So late."', "The end."]),
    ("Die 20. Fassung kam um 20.42 Uhr, die 42. fehlt noch. Das war und ist es.", ["Die 20. Fassung kam um 20.42 Uhr, die 42. fehlt noch.", "Das war und ist es."]),
    ("« Arrêtez ! C'est ça », dit Meb. Voir fig. 4 ? Oui.", ["« Arrêtez ! C'est ça », dit Meb.", "Voir fig. 4 ?", "Oui."]),
    ("「待って！それは私の。」とFebは言った。Dada：「複製する。」次の文！", ["「待って！それは私の。」とFebは言った。", "Dada：「複製する。」", "次の文！"]),
    ("“停下！那是我的。”Fes说完就走了。下一句？", ["“停下！那是我的。”Fes说完就走了。", "下一句？"]),
    ("คิวนำเข้าคัดลอกรายการ บริการค้นหาจัดเรียงบท", ["คิวนำเข้าคัดลอกรายการ", "บริการค้นหาจัดเรียงบท"]),
    ('"توقف! هذا ملفي" قال Poune ثم أغلق الباب. قاس د. Fa الصمت؟', ['"توقف! هذا ملفي" قال Poune ثم أغلق الباب.', "قاس د. Fa الصمت؟"]),
    ("Он сложил ленты и т. д. Протокол готов, т. е. всё.", ["Он сложил ленты и т. д.", "Протокол готов, т. е. всё."]),
    ("डॉ. राम आए। वह गया।", ["डॉ. राम आए।", "वह गया।"]),
]


def test_sentences():
    for text, want in SENTENCES:
        assert [text[a:b] for a, b in sentences(text)] == want, text
    for text in (None, "", " \n\u00a0 "):
        assert sentences(text) == []
    assert [x for x in sentences("..." * 4000)] == [(0, 12000)]
    assert len(sentences("Word one. " * 3000)) == 3000


def test_long_quotation_stays_whole():
    text = "She wrote “" + " ".join(f"We saw house number {k} today." for k in range(40)) + "” and left. Then it rained."
    assert [text[a:b] for a, b in sentences(text)] == [text[: text.index(" Then")], "Then it rained."]


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, " 🙂 Abc. Cde! "), (1, " 🙂 Abc. Cde! "), (2, None)], "doc_id bigint, text string").withColumn("_key", F.lit(7))
    assert sorted(tuple(r) for r in split_sentences(df, "doc_id", "text").collect()) == [(1, 1, 7), (1, 1, 7), (1, 8, 12), (1, 8, 12)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


# ---- golden tables ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["case_markup", "case_sentence_spans", "p8_roundtrip", "p9_invariants"])
def test_golden_table(spark, name):
    import duckdb

    from shelfmark.llm import cases

    con = duckdb.connect()
    for table in ("documents", "context_sizes"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    wanted = con.execute(cases.SQL[name])
    columns = [c[0] for c in wanted.description]
    rows = cases.QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted.fetchall()))


def test_members_and_links(spark):
    rows = [("a1", "f", "x" * 30), ("a2", "f", "x" * 30), ("b1", "g", "x" * 30), ("c1", "h", "abcdefghij" * 4), ("d1", "i", "abcdefghij" * 4 + "k"), ("e1", "j", "something else altogether"), (None, "k", "x"), ("n", "k", None)]
    df = spark.createDataFrame(rows, "key string, grp string, text string")
    found = {r.key: (r.class_id, r.copies, r.links) for r in class_members(df, "key", "text", "grp", 5, 0.7, 50, 6).collect()}
    assert {k: v[1:] for k, v in found.items()} == {"a1": (3, 0), "a2": (3, 0), "b1": (3, 0), "c1": (1, 1), "d1": (1, 1), "e1": (1, 0)}
    assert found["a1"][0] == found["b1"][0] and {(r.class_a, r.class_b) for r in class_links(df, "key", "text", "grp", 5, 0.7, 50, 6).collect()} == {tuple(sorted((found["c1"][0], found["d1"][0])))}
    assert class_members(df.limit(0), "key", "text", "grp", 5, 0.7, 50, 6).count() == 0


def test_repeated_items_of_a_heavy_group(spark):
    rows = [("h", 1.0 + (k % 7 == 0), f"f{k % 3}", None, k) for k in range(4000)]
    df = spark.createDataFrame(rows, "g string, score double, file string, seg int, id bigint")
    top = [(r.file, r.score, r.id) for r in top_n_per_group(df, "g", "score", ["file", "seg"], "id", 2, heavy_rows=100, slice_rows=50).collect()]
    assert sorted(top) == [("f0", 2.0, 0), ("f1", 2.0, 7)]


def test_white_space_in_one_pass(spark):
    rows = spark.createDataFrame([(1, " a\u00a0\u202f b\r\n\tC\u2028\u3000d "), (2, None), (3, " \n")], "k int, t string")
    both = normal_texts(rows.select("k", "t"), "t").join(rows.select("k", normal_text(F.col("t")).alias("u")), "k").collect()
    assert {r.k: r.t for r in both} == {1: "a b C d", 2: None, 3: ""} and all(r.t == r.u for r in both)
