"""Sentence units of documents in any language and script, by a semi-Markov dynamic program.

A paragraph (blank lines separate them) has candidate cuts: after a run of terminators with its
closing marks, and at spaces in Thai. The program chooses whole spans between cuts. A span's score joins
its length, its opening word, its closing word and whether the quotations inside it are balanced, so a cut that
looks fine by itself is refused where it would tear a quotation or leave half a sentence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that never end a sentence (lower case, without the last period).
TITLES = set(
    "dr dra prof mr mrs ms st sr sra srta hr fr frl dhr mevr mw drs ir ing mme mlle mm me mgr pr sn av doç yrd öğr gen col sgt capt lt rev hon gov pres "
    "проф акад доц инж г-н г-жа д-р им гр ул просп п пп рис табл см ср напр ок бл див мал тов соц "
    "vs approx ca cf cor i.e e.g viz resp bzw z.b d.h u.a s.o s.u abb lt evtl ggf inkl zzgl vgl bijv d.w.z m.a.w o.a afb blz env c.-à-d p.ex fig figs sec ch eq art cap pág págs núm aprox ver bkz örn şek sf yy "
    "ave blvd rd med phil rer nat ed eds vol nos pp"
    " د أ م ص ج डॉ प्रो श्री पृ सं ดร นาย อ รศ ผศ".split()
)
#: Abbreviations before a number; elsewhere they may be a word that ends a sentence ("No.").
NUMBERED = set("no nr nº n p pp s fig figs abb afb blz vol kap art pág págs núm cap sec ch eq с рис табл п т ст ص पृ şek bl".split())
#: Abbreviations that may stand at the end of a sentence: there the next opening decides.
ENDING = set("etc usw enz vb p.m a.m u.s u.k u.s.a d.c jr sr inc ltd co corp al т.д т.п др г гг н.э тощо ff bc ad a.c d.c o.ä dgl ecc".split())
#: German words by which a paragraph is seen to count with ordinal periods ("am 11. Mai").
ORDINAL_WORDS = {"der", "die", "das", "und", "ist", "am", "im", "um", "nicht", "wurde"}

OPENERS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "《": "》", "‹": "›"}
CLOSERS = "”»」』》›"
QUOTES = re.compile(r"[\"“”„«»「」『』《》‹›＂]")
CUTS = re.compile(r"[.!?…。！？।॥؟۔｡．]+(?:[   ]?[»])?[\"”“»」』》›’'＂)\]）】}*_]*(?:[  ]»)?")
BLANK = re.compile(r"(?:\r\n|[\n\r\u0085  \x0b\x0c])[^\S\r\n\u0085  ]*(?:\r\n|[\n\r\u0085  \x0b\x0c])\s*|\f\s*")
THAI = re.compile("[\u0e01-\u0e5b]")
NAMELIKE = re.compile(r"[^\W\d_]*[\d_.\-][\w.\-]*\w")
SPACES = re.compile(r"[^\S\r\n\u0085  ]+")
WIDE = "。！？｡．"
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}.\-]+$")
SPACED_END = regex.compile(r"(?:^|[\s(])([\p{L}\p{M}]{1,2}\.\s?[\p{L}\p{M}]{1,2})$")
SKIP_OPENING = regex.compile(r"[\"“„«「『《‹(\[¿¡'‘\s—–\-]*")

#: Spans of more cuts than this back are not weighed; cuts inside a quotation and cuts of negative score don't count.
LOOKBACK = 24


def _quotes(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """(opening, closing) offsets of the outermost quotations in a paragraph; unbalanced marks are ignored."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for found in QUOTES.finditer(text, a, b):
        mark, at = found[0], found.start()
        if mark in '"＂':
            inside = any(m == mark for m, _ in stack)
            if inside:
                while stack[-1][0] != mark:
                    stack.pop()
                spans.append((stack.pop()[1], at))
            else:
                stack.append((mark, at))
            continue
        if stack and mark in OPENERS.get(stack[-1][0], ""):
            spans.append((stack.pop()[1], at))
        elif mark in OPENERS:
            stack.append((mark, at))
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if mark in OPENERS.get(stack[depth][0], ""):
                    spans.append((stack[depth][1], at))
                    del stack[depth:]
                    break
    spans.sort()
    outer: list[tuple[int, int]] = []
    for span in spans:
        if not outer or span[0] > outer[-1][1]:
            outer.append(span)
    return outer


def _ending(text: str, a: int, stop: int, digit_next: bool, ordinals: bool) -> float:
    """Score of the closing word before a period at ``stop``; strongly negative where the period belongs to the word."""
    word = LAST_WORD.search(text, max(a, stop - 40), stop)
    if word is None:
        return 0.0
    raw = unicodedata.normalize("NFC", word[0]).strip("-")
    token = raw.lower().strip(".")
    two = SPACED_END.search(text, max(a, stop - 8), stop)
    if two is not None:
        pair = regex.sub(r"\s", "", two[1].lower())
        if pair in ENDING:
            return 0.0
        if pair in TITLES or len(pair) == 3:
            return -9.0
    if token in NUMBERED and digit_next:
        return -10.0
    if token in ENDING:
        return 0.0
    if token in TITLES:
        return -10.0
    if token.isdigit():
        return -7.0 if ordinals and len(token) <= 3 and not digit_next else -1.0 if len(token) <= 2 else 0.0
    if len(token) == 1 and token.isalpha() and not CJK.match(token):
        return -8.0
    if "." in raw and len(token.replace(".", "")) <= 4 and all(len(x) == 1 for x in token.split(".")):
        return -6.0
    return 0.0


def paragraph_sentences(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Sentence spans of text[a:b], one paragraph without blank ends."""
    quotes = _quotes(text, a, b)
    openings = {o for o, _ in quotes}
    piece = text[a:b]
    thai = not piece.isascii() and len(THAI.findall(piece)) * 4 > len(piece)
    ordinals = None
    # cut: (end of the span before, start of the next, score of the boundary, quotation closed here or null)
    cuts: list[tuple[int, int, float, tuple[int, int] | None]] = []
    q = 0
    for found in CUTS.finditer(text, a, b):
        end = found.end()
        run = found[0].rstrip("\"”“»」』》›’'＂)]）】}*_   ")
        stop = found.start() + len(run)
        # Marks that open a quotation don't belong to the sentence before it.
        while end > stop and end - 1 in openings:
            end -= 1
        while end > stop and text[end - 1].isspace():
            end -= 1
        while q < len(quotes) and quotes[q][1] < stop:
            q += 1
        # A closing mark may stand after a space or a line break ("? »").
        if q < len(quotes) and quotes[q][0] < found.start() and end <= quotes[q][1] <= end + 2 and not text[end : quotes[q][1]].strip():
            end = quotes[q][1] + 1
        if end >= b:
            break
        after = text[end]
        wide = run[-1] in WIDE
        if not (after.isspace() or wide or CJK.match(after) or end in openings):
            continue
        if not after.isspace() and not wide and run[-1] == ".":
            continue
        start = end
        while start < b and text[start].isspace():
            start += 1
        if start >= b:
            break
        opening = SKIP_OPENING.match(text, start, b).end()
        first = text[opening] if opening < b else ""
        digit, lower = first.isdigit(), first.islower()
        # A lower-case file name opens a sentence as well as any word does; so does a Latin word in a script without case.
        named = lower and ((not run.isascii() and run[-1] != "…") or NAMELIKE.match(text, opening, b) is not None)
        score = 3.0 if run[-1] in ".…" else 4.0
        if run.endswith(("...", "…")):
            score = 1.5
        if text[start] in ",;:%)]}»”" or (text[start] in "—–-" and lower):
            score -= 12.0
        if lower and not named:
            score -= 8.0
        if run == "." and not wide:
            if ordinals is None and text[found.start() - 1].isdigit():
                ordinals = len(ORDINAL_WORDS.intersection(piece.lower().split())) >= 2
            score += _ending(text, a, found.start(), digit, bool(ordinals))
        closed = None
        if q < len(quotes) and stop <= quotes[q][1] < end:
            closed = quotes[q]
        cuts.append((end, start, score, closed))
    if thai:
        for found in SPACES.finditer(text, a, b):
            before = text[found.start() - 1]
            if before not in ":：" and before not in "“\"«(" and not _emoji_near(text, found.start(), found.end()):
                cuts.append((found.start(), found.end(), 3.0, None))
        cuts = sorted({(c[0], c[1]): c for c in cuts}.values())
    if not cuts:
        return [(a, b)]
    return _choose(text, a, b, cuts, quotes)


def _emoji_near(text: str, left: int, right: int) -> bool:
    return ord(text[left - 1]) > 0x1F000 or ord(text[right]) > 0x1F000


def _choose(text: str, a: int, b: int, cuts: list, quotes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The best division of a paragraph into spans between cuts."""
    n = len(cuts)
    starts = [a, *[c[1] for c in cuts]]
    ends = [*[c[0] for c in cuts], b]
    # Torn quotations: index of the quotation a position lies strictly inside of, else -1.
    inside, k = [], 0
    for end in ends:
        while k < len(quotes) and quotes[k][1] < end:
            k += 1
        inside.append(k if k < len(quotes) and quotes[k][0] < end <= quotes[k][1] else -1)
    introduced = {o for o, _ in quotes if _colon_before(text, a, o)}
    best = [0.0] * (n + 2)
    back = [0] * (n + 2)
    for j in range(1, n + 2):
        score = cuts[j - 1][2] if j <= n else 0.0
        closed = cuts[j - 1][3] if j <= n else None
        torn = inside[j - 1] >= 0 and j <= n
        end = ends[j - 1]
        top, chosen = -1e18, j - 1
        seen = 0
        for i in range(j - 1, -1, -1):
            # Starts that tear a quotation or follow a refused cut don't count: the window grows until enough others are reached.
            if seen == LOOKBACK:
                break
            seen += not i or (inside[i - 1] < 0 and cuts[i - 1][2] >= 0)
            begin = starts[i]
            length = end - begin
            span = score - (0.004 * (length - 400) if length > 400 else 0.0) - (2.0 if length < 2 else 0.0)
            if torn:
                span -= 12.0
            if i and inside[i - 1] >= 0:
                span -= 12.0
            if closed is not None:
                if closed[0] in introduced:
                    span += 2.0
                elif CJK.match(text[starts[j]]) or CJK.search(text, max(begin, closed[0] - 2), min(closed[0] + 3, end)):
                    # Without spaces a quotation that nothing introduces is followed by its speaker or its verb.
                    span -= 10.0
            total = best[i] + span
            if total > top:
                top, chosen = total, i
        best[j], back[j] = top, chosen
    spans, j = [], n + 1
    while j > 0:
        i = back[j]
        spans.append((starts[i], ends[j - 1]))
        j = i
    return spans[::-1]


def _colon_before(text: str, a: int, at: int) -> bool:
    while at > a and text[at - 1].isspace():
        at -= 1
    return at > a and text[at - 1] in ":："


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) code-point offsets of the sentences of a whole text; none for null, empty and blank texts."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    at = 0
    for gap in [*BLANK.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        a, b = at, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out += paragraph_sentences(text, a, b)
        at = gap.end() if gap else stop
    return out


def split_sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence: (key, sent_start INT, sent_end INT), offsets in code points, end exclusive.

    A blank line ends a sentence, a single line break doesn't. Null, empty and blank texts give no rows; repeated
    rows give their sentences again; extra columns are ignored. Whole texts of any length; narrow, no exchange.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some rows at a time: sentences of one slice only are held as Python objects.
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows, starts, ends = [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    for start, end in sentences(text):
                        rows.append(k)
                        starts.append(start)
                        ends.append(end)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["_key", "sent_start", "sent_end"])

    done = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, f"_key {kind}, sent_start int, sent_end int")
    return done.withColumnRenamed("_key", key)
