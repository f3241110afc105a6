"""Language of documents and of their paragraphs by cross-parsing entropy.

For every language a suffix automaton holds all substrings of labelled text. A paragraph is parsed against each
automaton into phrases, each the longest match from where the last one ended. Phrases times log2 of the length of
the labelled text, per character, estimates the cross entropy; the language that needs fewest normalised phrases wins.

The labelled text is a bounded sample (``SAMPLE_TEXTS`` texts a language, ``TEXT_CHARS`` characters of each,
``MODEL_CHARS`` in the final automaton). Labelled documents may hold paragraphs in other languages, so the sample is
parsed crosswise first: automata of one half decide which paragraphs of the other half stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAMPLE_TEXTS, TEXT_CHARS, MODEL_CHARS = 100, 4_000, 30_000
#: Room for distinct characters; larger than any alphabet in use, so that a state and a character fit one small integer.
ALPHABET = 8192
#: Others are parsed until they cost this much more than the best; that far apart the confidence is 1.
SURE = 1.5
#: Paragraphs with fewer letters than this have no language.
LEAST_LETTERS = 6

# Two-letter codes with their three-letter codes, English names and own names.
NAMES = {
    "en": "eng english", "de": "deu ger german deutsch", "fr": "fra fre french français francais", "es": "spa spanish español espanol castellano", "pt": "por portuguese português portugues",
    "nl": "nld dut dutch nederlands", "ru": "rus russian русский", "uk": "ukr ukrainian українська", "tr": "tur turkish türkçe turkce", "ar": "ara arabic العربية عربي", "hi": "hin hindi हिन्दी हिंदी",
    "zh": "zho chi chinese 中文 汉语 漢語 cmn", "ja": "jpn japanese 日本語", "th": "tha thai ไทย", "it": "ita italian italiano", "pl": "pol polish polski", "sv": "swe swedish svenska", "ko": "kor korean 한국어",
    "el": "ell gre greek ελληνικά", "he": "heb hebrew עברית", "cs": "ces cze czech čeština", "vi": "vie vietnamese", "fa": "fas per persian فارسی", "bn": "ben bengali বাংলা",
}
CODE_OF = {name: code for code, names in NAMES.items() for name in [code, *names.split()]}

NOISE = regex.compile(r"\S*[\p{N}_@/\\]\S*|\S+\.\p{L}{2,5}(?=\s|$)")
#: In scripts without spaces a name or file name is cut out by itself.
GLUED = regex.compile(r"[A-Za-z0-9][A-Za-z0-9._\-]*")
NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LATIN = regex.compile(r"\p{Latin}")
BLANK_LINE = regex.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+")


def named_language(label: Column) -> Column:
    """Two-letter code a label names, by code (with or without region, any case) or name; null where it names none."""
    low = F.lower(F.trim(label))
    table = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(table, low), F.try_element_at(table, F.regexp_extract(low, r"^([a-z]{2,3})[-_.@]", 1)))


def letters_of(text: str) -> str:
    """Lower-case words of the text's own script, one space between them; numbers, names of files and foreign letters of a few words go."""
    import unicodedata

    text = unicodedata.normalize("NFC", text)
    wide = regex.search(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", text) is not None
    text = GLUED.sub(" ", text) if wide else NOISE.sub(" ", text)
    text = NOT_LETTER.sub(" ", text.lower()).strip()
    if not text.isascii():
        latin = len(LATIN.findall(text))
        if latin * 2 < len(text) - text.count(" "):
            text = " ".join(w for w in (LATIN.sub("", w) for w in text.split(" ")) if w)
    return text


class SuffixAutomaton:
    """All substrings of a text; grown one character at a time in linear time."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, codes: list[int]) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = self.last
        for c in codes:
            current = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = current
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current
        self.last = last

    def arcs(self) -> tuple[np.ndarray, np.ndarray]:
        """(state * ALPHABET + character, target * ALPHABET) of every arc."""
        keys = [s * ALPHABET + c for s, out in enumerate(self.next) for c in out]
        to = [t * ALPHABET for out in self.next for t in out.values()]
        return np.array(keys, dtype=np.int64), np.array(to, dtype=np.int64)


def phrases(codes: list[int], arcs: dict[int, int], limit: float) -> int:
    """Phrases of the greedy parse by longest matches; more than ``limit`` as soon as that is certain."""
    get = arcs.get
    state, count = 0, 1
    for c in codes:
        to = get(state + c)
        if to is None:
            # A character that no labelled text holds is a phrase by itself.
            count += 1
            if count > limit:
                return count
            to = get(c, 0)
        state = to
    return count


class Model:
    """Automata of all languages; plain arrays, so that it is small to send."""

    def __init__(self, alphabet: dict[str, int], languages: dict[str, tuple[np.ndarray, np.ndarray, int]]):
        self.alphabet, self.languages = alphabet, languages

    @classmethod
    def build(cls, texts: dict[str, list[str]], most: int = MODEL_CHARS) -> Model:
        chosen = {lang: _prefix(parts, most) for lang, parts in sorted(texts.items())}
        counts = Counter(c for parts in chosen.values() for p in parts for c in p)
        alphabet = {c: k for k, (c, _) in enumerate(counts.most_common(ALPHABET - 1))}
        languages = {}
        for lang, parts in chosen.items():
            automaton, size = SuffixAutomaton(), 0
            for part in parts:
                codes = [alphabet.get(c, ALPHABET - 1) for c in f" {part} "]
                automaton.extend(codes)
                size += len(codes)
            if size:
                languages[lang] = (*automaton.arcs(), size)
        return cls(alphabet, languages)

    def opened(self) -> Parser:
        return Parser(self)


def _prefix(parts: list[str], most: int) -> list[str]:
    """The first of the distinct parts that together have at most ``most`` characters."""
    out, size = [], 0
    for part in dict.fromkeys(parts):
        if size + len(part) > most and out:
            break
        out.append(part)
        size += len(part)
    return out


class Parser:
    """A model unpacked into dictionaries; one per worker."""

    def __init__(self, model: Model):
        self.alphabet = model.alphabet
        self.arcs, self.weight, self.letters = {}, {}, {}
        for lang, (keys, to, size) in model.languages.items():
            self.arcs[lang] = dict(zip(keys.tolist(), to.tolist()))
            self.weight[lang] = math.log2(size)
            self.letters[lang] = set(keys[keys < ALPHABET].tolist())

    def language(self, text: str) -> tuple[str | None, float]:
        """(language, confidence 0…1) of one paragraph; (null, 0) where it has too few letters."""
        words = letters_of(text)
        if len(words) < LEAST_LETTERS and len(words.encode()) < 3 * LEAST_LETTERS or not self.arcs:
            return None, 0.0
        number = self.alphabet.get
        codes = [number(c, ALPHABET - 1) for c in words]
        seen = Counter(codes)
        # Lower bound: every character a language doesn't have costs a phrase.
        bound = {lang: (1 + sum(n for c, n in seen.items() if c not in own)) * self.weight[lang] for lang, own in self.letters.items()}
        head = codes[:48]
        order = sorted(bound, key=lambda lang: (bound[lang], phrases(head, self.arcs[lang], 1e9) * self.weight[lang] if bound[lang] < 12 * self.weight[lang] else 1e9))
        best, winner, second = math.inf, None, math.inf
        for lang in order:
            stop = best * SURE
            if bound[lang] >= stop:
                continue
            cost = phrases(codes, self.arcs[lang], stop / self.weight[lang]) * self.weight[lang]
            if cost < best:
                best, second, winner = cost, best, lang
            elif cost < second:
                second = cost
        return winner, round(min(1.0, (second / best - 1.0) / (SURE - 1.0)), 4) if second < math.inf else 1.0

    def segments(self, text: str | None) -> list[tuple[int, int, str | None, float]]:
        """(start, end, language, confidence) of every paragraph; blank lines separate them."""
        if not text or text.isspace():
            return []
        out, at = [], 0
        for gap in [*BLANK_LINE.finditer(text), None]:
            stop = gap.start() if gap else len(text)
            if text[at:stop].strip():
                out.append((at, stop, *self.language(text[at:stop])))
            at = gap.end() if gap else stop
        return out


def fit(docs: DataFrame, key: str, text: str, label: str, sample_texts: int = SAMPLE_TEXTS, text_chars: int = TEXT_CHARS, model_chars: int = MODEL_CHARS) -> Model:
    """A model from a bounded sample of labelled texts: at most ``sample_texts`` different texts of each language named."""
    lang = named_language(F.col(label))
    ids = docs.select(F.col(key).alias("k"), lang.alias("lang"), F.xxhash64(text).alias("h"), F.length(F.trim(text)).alias("n")).filter("lang is not null and n > 40")
    once = ids.groupBy("lang", "h").agg(F.min("k").alias("k"))
    few = once.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample_texts).select("k", "lang", "h")
    # At most languages * sample_texts rows, whatever the size of the corpus.
    rows = docs.select(F.col(key).alias("k"), F.substring(F.col(text), 1, text_chars).alias("t")).join(F.broadcast(few), "k").select("lang", "h", "t").collect()
    halves: list[dict[str, list[str]]] = [{}, {}]
    for r in sorted(rows, key=lambda r: (r.lang, r.h)):
        half = halves[(r.h >> 7) & 1]
        half.setdefault(r.lang, []).extend(x for p in BLANK_LINE.split(r.t) if len(x := letters_of(p)) >= 3 * LEAST_LETTERS)
    parsers = [Model.build(h, model_chars // 2).opened() for h in halves]
    kept: dict[str, list[str]] = {}
    for half, judge in ((0, parsers[1]), (1, parsers[0])):
        for name, parts in halves[half].items():
            kept.setdefault(name, []).extend(p for p in parts if name not in judge.arcs or judge.language(p)[0] == name)
    mixed = {name: [x for pair in _alternate(parts) for x in pair] for name, parts in kept.items() if parts}
    return Model.build(mixed, model_chars)


def _alternate(parts: list[str]) -> list[list[str]]:
    """Parts of both halves by turns, so that a cut takes as much from either."""
    middle = (len(parts) + 1) // 2
    return [[parts[k], *parts[middle + k : middle + k + 1]] for k in range(middle)]


@lru_cache(maxsize=1)
def _opened(sent) -> Parser:
    return sent.value.opened()


def segment_languages(rows: DataFrame, keys: list[str], text: str, model: Model) -> DataFrame:
    """One row per paragraph: keys, segment_index, seg_start, seg_end (code points), lang, confidence.

    ``lang`` is null for paragraphs with too few letters. Null, empty and blank texts give no rows; repeated rows stay
    repeated; extra columns are ignored. Whole texts; narrow, no exchange. The model sent is bounded by its parameters.
    """
    sent = rows.sparkSession.sparkContext.broadcast(model)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _opened(sent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [(k, i, *seg) for k, t in enumerate(part.column(len(keys)).to_pylist()) for i, seg in enumerate(parser.segments(t))]
                pick, index, start, end, lang, sure = zip(*found) if found else ([],) * 6
                take = pa.array(pick, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(take) for k in range(len(keys))), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
                    names=[*keys, "segment_index", "seg_start", "seg_end", "lang", "confidence"],
                )

    return rows.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{spec}, segment_index int, seg_start int, seg_end int, lang string, confidence double")


def dominant_language(segments: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence): the language of most characters of a document's paragraphs; its share weighted by their confidence."""
    known = segments.filter("lang is not null").withColumn("_n", F.col("seg_end") - F.col("seg_start"))
    by_lang = known.groupBy(key, "lang").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("confidence")).alias("w"))
    best = by_lang.groupBy(key).agg(F.max(F.struct(F.col("n"), F.col("lang"), F.col("w"))).alias("b"), F.sum("n").alias("total"))
    return best.select(key, F.col("b.lang").alias("lang"), F.round(F.col("b.w") / F.col("total"), 4).alias("confidence"))


def departing_languages(segments: DataFrame, labels: DataFrame, file: str, chunk: str, label: str) -> DataFrame:
    """(file, chunk, lang, confidence): languages of whole paragraphs that the file's label doesn't name, each once a chunk.

    A file without a label, or whose label names no language, gives every language found. A repeated label counts once.
    """
    named = labels.select(F.col(file).alias("_f"), named_language(F.col(label)).alias("_l")).filter("_l is not null and _f is not null").distinct()
    found = segments.filter("lang is not null").groupBy(file, chunk, "lang").agg(F.max("confidence").alias("confidence"))
    return found.join(named, (found[file] == named["_f"]) & (found["lang"] == named["_l"]), "left_anti")
