"""Packing of documents into containers of fixed token capacity by lexical retrieval.

Documents are spread over shards of bounded size. Each shard holds a BM25 inverted index of its documents. The largest
unused document seeds a container; the index returns its unused neighbours, which fill the window greedily
in the order of their scores; what is left is closed by the largest unused document that fits. A container with much
unused space is dissolved; such rests are retrieved and filled once more in new shards, and what still leaves unused
space then is packed by size alone, in larger shards.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.encode import TOKENIZERS, Encoder, _bounded, _mapped, build_lexicon
from shelfmark.session import materialise

#: Documents of one shard (also in the second round), and rest items of one shard of the last round.
SHARD_DOCS, REST_ITEMS = 2_000, 20_000
#: A container with a larger share of unused space than this is dissolved into the next round.
REST_SHARE = 0.01
#: Terms in more than this share of a shard's documents aren't indexed: they tell no neighbours apart.
COMMON = 0.2
K1, B = 1.2, 0.75
#: Group counts up to this many rows are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 50_000
#: Below this share of the capacity the remaining space is closed by size instead of by likeness.
CLOSE_BY_SIZE = 0.3


class Bm25Shard:
    """Inverted index of the documents of one shard; scores of all of them for a seed."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        n = len(terms)
        lengths = np.array([c.sum() for c in counts], dtype=np.float64)
        doc = np.repeat(np.arange(n), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(counts).astype(np.float64) if n else np.zeros(0)
        order = np.argsort(term, kind="stable")
        term, doc, tf = term[order], doc[order], tf[order]
        self.vocabulary, self.starts, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1.0, 1e-9))
        self.weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.df, self.size = doc, df, n
        telling = df <= max(2, COMMON * n)
        self.query = [np.searchsorted(self.vocabulary, t) for t in terms]
        self.query = [q[telling[q] & (df[q] > 1)] for q in self.query]

    def scores(self, seed: int) -> np.ndarray:
        rows = self.query[seed]
        if not len(rows):
            return np.zeros(self.size)
        sizes = self.df[rows]
        at = np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.size)


def fill_by_likeness(sizes: list[int], capacity: int, index: Bm25Shard | None) -> list[list[int]]:
    """Containers as lists of item numbers; every size is in 1…capacity."""
    free = sorted((s, -k) for k, s in enumerate(sizes))
    used = np.zeros(len(sizes), dtype=bool)
    size = np.array(sizes, dtype=np.int64)
    containers: list[list[int]] = []

    def take(item: int) -> None:
        used[item] = True
        del free[bisect_right(free, (sizes[item], -item)) - 1]

    while free:
        seed = -free[-1][1]
        take(seed)
        held, space = [seed], capacity - sizes[seed]
        if index is not None and free and space >= max(free[0][0], CLOSE_BY_SIZE * capacity):
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & ~used & (size <= space))
            for item in near[np.lexsort((near, -score[near]))].tolist():
                if space < CLOSE_BY_SIZE * capacity:
                    break
                if sizes[item] <= space:
                    take(item)
                    held.append(item)
                    space -= sizes[item]
        while free and free[0][0] <= space:
            item = -free[bisect_right(free, (space, 1)) - 1][1]
            take(item)
            held.append(item)
            space -= sizes[item]
        containers.append(held)
    return containers


def fill_by_size(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: every item goes into the fullest container that still takes it."""
    containers: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_right(room, (sizes[item], -1))
        if at < len(room):
            space, number = room.pop(at)
            containers[number].append(item)
        else:
            space, number = capacity, len(containers)
            containers.append([item])
        if space > sizes[item]:
            insort(room, (space - sizes[item], number))
    return containers


def sized_terms(docs: DataFrame, key: str, text: str, group: str | None, tokenizer: str, folder: str) -> DataFrame:
    """(doc BIGINT, grp STRING, tokens INT, terms BINARY): size in tokens, and distinct token ids with their counts, of whole texts."""
    rows = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    place = build_lexicon(rows, text, tokenizer, folder)
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_mapped(place), folder, tokenizer)
        for batch in batches:
            for part in _bounded(batch):
                ids, offsets = encoder.encode(part.column(2).to_pylist())
                terms = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own, count = np.unique(ids[a:b], return_counts=True)
                    terms.append(own.astype(np.int32).tobytes() + count.astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets), pa.int32()), pa.array(terms, pa.binary())], names=["doc", "grp", "tokens", "terms"])

    slim = rows.select(F.col(key).cast("bigint").alias("_k"), grp.alias("_g"), F.col(text).alias("_t"))
    return slim.mapInArrow(run, "doc bigint, grp string, tokens int, terms binary").filter("tokens > 0")


def pack_containers(
    docs: DataFrame,
    key: str,
    text: str,
    capacities: dict[str, int],
    group: str | None = None,
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    shard_docs: int = SHARD_DOCS,
    rest_items: int = REST_ITEMS,
) -> DataFrame:
    """One row per piece: (context_name, container_id, doc_id, piece, token_start, token_end, slot).

    * Every text that is not null or empty is packed once for each capacity, its size counted in tokens. ``key`` is unique.
    * A text larger than the capacity gives full containers of its own, and its rest is an item; nothing else is split.
    * ``capacities``: few names with their sizes, each at least 1. ``group``: documents of one group are packed together first.
    * Ties go to the smaller key, so every run packs alike. Empty texts and tables give no rows. Extra columns are ignored.
    """
    if any(size < 1 for size in capacities.values()):
        raise ValueError("a capacity must be at least 1")
    sized = materialise(sized_terms(docs, key, text, group, tokenizer, folder), "sized-terms")
    # Exact counts split a hot group over as many shards as it needs.
    counts = materialise(sized.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_docs)).alias("shards")), "group-counts")
    few = counts.count() <= BROADCAST_GROUPS
    sharded = sized.join(F.broadcast(counts) if few else counts, "grp").withColumn("shard", F.pmod(F.xxhash64("doc", F.lit(3)), F.col("shards"))).drop("shards")
    kinds = sorted(capacities.items())
    schema = "context_name string, container_id string, doc_id bigint, piece int, token_start int, token_end int, slot int"
    more = schema + ", grp string, rest boolean, terms binary"
    columns = [c.split()[0] for c in more.split(", ")]

    def filled(name: str, capacity: int, place: str, grp: str, items: list[tuple], index: Bm25Shard, raw: list[bytes], first: int) -> list[tuple]:
        """Rows of the containers of items (row of the frame, doc, piece, start, end); those of a dissolved container keep their terms."""
        out, sizes = [], [i[4] - i[3] for i in items]
        # The index knows all documents of the shard; items are those that still need room.
        for number, held in enumerate(fill_by_likeness(sizes, capacity, _Items(index, [i[0] for i in items])), first):
            rest = capacity - sum(sizes[i] for i in held) > REST_SHARE * capacity
            out += [(name, f"{place}/{number}", *items[i][1:], slot, grp, rest, raw[items[i][0]] if rest else None) for slot, i in enumerate(held)]
        return out

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("doc", kind="stable")
        doc, tokens, raw = frame["doc"].tolist(), frame["tokens"].tolist(), frame["terms"].tolist()
        grp = frame["grp"].iloc[0]
        place = f"{grp}/{frame['shard'].iloc[0]}"
        index, out = _indexed(raw), []
        for name, capacity in kinds:
            number, items = 0, []
            for k, size in enumerate(tokens):
                whole = size // capacity if size > capacity else 0
                for p in range(whole):
                    out.append((name, f"{place}/{number}", doc[k], p, p * capacity, (p + 1) * capacity, 0, grp, False, None))
                    number += 1
                if size > whole * capacity:
                    items.append((k, doc[k], whole, whole * capacity, size))
            out += filled(name, capacity, place, grp, items, index, raw, number)
        return pd.DataFrame(out, columns=columns)

    first = materialise(sharded.groupBy("grp", "shard").applyInPandas(pack, more), "packed")
    sizes_of = dict(kinds)

    def pack_again(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable")
        name, grp, raw = frame["context_name"].iloc[0], frame["grp"].iloc[0], frame["terms"].tolist()
        items = list(zip(range(len(frame)), *(frame[c].tolist() for c in ("doc_id", "piece", "token_start", "token_end"))))
        return pd.DataFrame(filled(name, sizes_of[name], f"again/{grp}/{frame['shard'].iloc[0]}", grp, items, _indexed(raw), raw, 0), columns=columns)

    # Dissolved containers are retrieved and filled once more, in new shards of their group; what is left then goes by size.
    rests = first.filter("rest")
    spread = materialise(rests.groupBy("context_name", "grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_docs)).alias("shards")), "rest-counts")
    spread = F.broadcast(spread) if few else spread
    rests = rests.join(spread, ["context_name", "grp"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("shards"))).drop("shards")
    second = materialise(rests.groupBy("context_name", "grp", "shard").applyInPandas(pack_again, more), "packed-again")

    rests = second.filter("rest").drop("grp", "terms", "rest")
    spread = rests.groupBy("context_name").agg(F.ceil(F.count(F.lit(1)) / F.lit(rest_items)).alias("shards"))
    # One row for each capacity.
    rests = rests.join(F.broadcast(spread), "context_name").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(4)), F.col("shards")))

    def repack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        name, shard = frame["context_name"].iloc[0], frame["shard"].iloc[0]
        sizes = (frame["token_end"] - frame["token_start"]).tolist()
        number, slot = [""] * len(frame), [0] * len(frame)
        for n, held in enumerate(fill_by_size(sizes, sizes_of[name])):
            for s, i in enumerate(held):
                number[i], slot[i] = f"rest/{shard}/{n}", s
        return frame.assign(container_id=number, slot=slot)[columns[:7]]

    last = rests.groupBy("context_name", "shard").applyInPandas(repack, schema)
    kept = [df.filter("not rest").select(*columns[:7]) for df in (first, second)]
    return kept[0].unionByName(kept[1]).unionByName(last)


def _indexed(raw: list[bytes]) -> Bm25Shard:
    """Index of a shard from packed term ids and counts."""
    terms, counts = [], []
    for packed in raw:
        n = len(packed) // 8
        terms.append(np.frombuffer(packed, np.int32, n))
        counts.append(np.frombuffer(packed, np.int32, n, 4 * n))
    return Bm25Shard(terms, counts)


class _Items:
    """Scores of items by the index of their documents."""

    def __init__(self, index: Bm25Shard, docs: list[int]):
        self.index, self.docs = index, np.array(docs, dtype=np.int64)

    def scores(self, seed: int) -> np.ndarray:
        return self.index.scores(int(self.docs[seed]))[self.docs]
