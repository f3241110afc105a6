"""Near-duplicate records by b-bit MinHash.

Exact copies are folded into classes first, so that only different texts are compared. Each class gets the minima of
its shingle set under many hash functions. Bands of whole minima generate candidates: classes that agree in one band
meet in its bucket. Of every minimum only the lowest b bits are kept for the comparison itself; they are packed, and
the share of agreeing positions, corrected for the 2^-b that agree by chance, estimates the similarity by bit counts.
Candidates whose estimate can still reach the threshold are checked exactly against the shingle sets.

Hot buckets are cut into tiles. A tile pair is one group of bounded size, so neither a task nor the
driver ever holds a whole bucket, and no pair is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.session import materialise

#: Members of one tile of a bucket.
TILE = 512
#: Tables of hot buckets up to this many rows are broadcast (16 bytes each).
BROADCAST_BUCKETS = 1_000_000
#: Up to this many pairs of members of a class, or of two linked classes, all are written out; beyond it stars.
FULL_PAIRS = 10_000

#: White space other than the plain space (fixed values of Unicode).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def normal_text(column: Column) -> Column:
    """Each run of white space, no-break spaces included, as one space; trimmed; letter case kept."""
    spaced = F.translate(column, WHITE, " " * len(WHITE))
    return F.trim(F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))


def normal_texts(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose ``text`` is what ``normal_text`` gives, by one pass in Arrow batches; nulls and other columns stay."""
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [None if t is None else " ".join(t.split()) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(flat, pa.string()))

    return rows.mapInArrow(run, rows.schema)


class Signer:
    """Minima of character-shingle sets under ``bands * rows`` hash functions."""

    def __init__(self, width: int, bands: int, rows: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.bands, self.rows, self.bits = width, bands, rows, bits
        count = bands * rows
        self.a = (rng.integers(0, 2**31, count, dtype=np.int64) * 2 + 1).astype(np.uint32)
        self.b = rng.integers(0, 2**32, count, dtype=np.int64).astype(np.uint32)
        self.room = np.empty((256, count), dtype=np.uint32)
        self.mix = (rng.integers(0, 2**62, rows, dtype=np.int64) * 2 + 1).astype(np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Distinct 64-bit hashes of all shingles; a text shorter than a shingle is one shingle."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        width = min(self.width, len(codes))
        size = len(codes) - width + 1
        value = np.full(size, width, dtype=np.uint64)
        for k in range(width):
            value = (value ^ codes[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return np.unique(value ^ (value >> np.uint64(32)))

    def minima(self, text: str) -> np.ndarray:
        base = self.shingles(text).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, dtype=np.uint32)
        # Blocks of shingles: memory stays flat for texts of any length, and one block of it serves all texts. The shingle
        # hashes are mixed already, so a multiplication and an addition permute them; the minima alone are mixed again, for their low bits.
        for at in range(0, len(base), len(self.room)):
            block = base[at : at + len(self.room)]
            h = self.room[: len(block)]
            np.multiply(block[:, None], self.a[None, :], out=h)
            h += self.b[None, :]
            np.minimum(low, np.minimum.reduce(h, axis=0), out=low)
        low ^= low >> np.uint32(16)
        low *= np.uint32(0x85EBCA6B)
        low ^= low >> np.uint32(13)
        return low

    def bands_of(self, minima: np.ndarray) -> np.ndarray:
        """One signed 64-bit key per band; the band's number is part of it."""
        wide = minima.astype(np.uint64).reshape(self.bands, self.rows)
        key = (wide * self.mix[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return (key ^ (key >> np.uint64(28))).view(np.int64)

    def pack(self, minima: np.ndarray) -> bytes:
        """The lowest ``bits`` bits of every minimum, bit plane by bit plane."""
        planes = [np.packbits(((minima >> np.uint32(k)) & np.uint32(1)).astype(np.uint8)) for k in range(self.bits)]
        return np.concatenate(planes).tobytes()


def agreement(packed_a: np.ndarray, packed_b: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Share of positions whose kept bits all agree, by bit counts; rows against rows of two uint8 matrices."""
    size = packed_a.shape[1] // bits
    differ = np.zeros((packed_a.shape[0], size), dtype=np.uint8)
    for k in range(bits):
        differ |= packed_a[:, k * size : (k + 1) * size] ^ packed_b[:, k * size : (k + 1) * size]
    return 1.0 - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) / count


def estimate(share: np.ndarray, bits: int) -> np.ndarray:
    """Similarity from the share of agreeing positions, corrected for collisions of b-bit values."""
    chance = 2.0**-bits
    return (share - chance) / (1.0 - chance)


def similar_classes(texts: DataFrame, width: int, threshold: float, bands: int, rows: int, bits: int = 2, tile: int = TILE) -> DataFrame:
    """(class_a, class_b, similarity), class_a < class_b: pairs of different texts with Jaccard similarity >= ``threshold``.

    ``texts``: class BIGINT (unique), text STRING (not null, not empty). Empty input gives no rows.
    The chance that a pair at the threshold is missed is (1 - threshold^rows)^bands.
    """
    signer_args = (width, bands, rows, bits)
    count = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(*signer_args)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys, packed = [], []
                for text in part.column(1).to_pylist():
                    minima = signer.minima(text)
                    keys.append(signer.bands_of(minima))
                    packed.append(signer.pack(minima))
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                offsets = np.arange(len(packed) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(packed, pa.binary())], names=["class", "bands", "packed"])

    signed = materialise(texts.select("class", "text").mapInArrow(sign, "class bigint, bands array<bigint>, packed binary"), "signatures")

    # Buckets: counts are pre-aggregated per task, so a hot key travels as one number a task. Buckets of one tile or less
    # are gathered whole; the members of hot ones, which alone could be unbounded, never meet in one task.
    posts = signed.select("class", F.explode("bands").alias("bucket"))
    counted = posts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    large = materialise(counted.select(F.col("bucket").alias("hot"), F.ceil(F.col("n") / F.lit(tile)).alias("tiles")), "hot-buckets")
    found = large.count()
    near = F.broadcast(large) if found <= BROADCAST_BUCKETS else large
    cold = posts if not found else posts.join(near, F.col("bucket") == F.col("hot"), "left_anti")
    # One exchange: dropping lone keys and gathering the others both use the partitioning by bucket.
    shared = cold.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("bucket"))).filter("n > 1")
    cells = shared.groupBy("bucket").agg(F.collect_list("class").alias("members"))
    small = cells.select(F.explode(_pairs_in(F.sort_array("members"))).alias("p")).select("p.class_a", "p.class_b")
    hot = posts.join(near, F.col("bucket") == F.col("hot")).withColumn("tile", F.pmod(F.xxhash64("class", F.lit(11)), F.col("tiles"))).select("bucket", "tiles", "tile", "class")
    opposite = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("other")
    hot = hot.select("bucket", "class", "tile", opposite).select("bucket", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "class", (F.col("tile") <= F.col("other")).alias("left_side"), (F.col("tile") >= F.col("other")).alias("right_side"))
    packed_hot = hot.join(signed.select("class", "packed"), "class")
    margin = 3.5 * math.sqrt(threshold * (1 - threshold) / count) + 0.02

    def compare_tiles(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["left_side"]], group[group["right_side"]]
        a = np.frombuffer(b"".join(left["packed"]), np.uint8).reshape(len(left), -1)
        b = np.frombuffer(b"".join(right["packed"]), np.uint8).reshape(len(right), -1)
        ca, cb = left["class"].to_numpy(), right["class"].to_numpy()
        out_a, out_b = [], []
        for k in range(len(ca)):
            good = estimate(agreement(np.broadcast_to(a[k], b.shape), b, bits, count), bits) >= threshold - margin
            good &= cb != ca[k]
            out_a.append(np.minimum(ca[k], cb[good]))
            out_b.append(np.maximum(ca[k], cb[good]))
        return pd.DataFrame({"class_a": np.concatenate(out_a), "class_b": np.concatenate(out_b)}) if out_a else pd.DataFrame({"class_a": [], "class_b": []}).astype("int64")

    tiled = packed_hot.groupBy("bucket", "t", "u").applyInPandas(compare_tiles, "class_a bigint, class_b bigint")
    candidates = (small.unionByName(tiled) if found else small).distinct()

    # Estimate by bit counts before any text moves.
    left, right = (signed.select(F.col("class").alias(f"class_{s}"), F.col("packed").alias(f"packed_{s}")) for s in "ab")
    size = math.ceil(count / 8) * bits

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, size) for k in (2, 3))
            keep = pa.array(estimate(agreement(a, b, bits, count), bits) >= threshold - margin)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["class_a", "class_b"])

    joined = candidates.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", "packed_a", "packed_b")
    likely = materialise(joined.mapInArrow(close, "class_a bigint, class_b bigint"), "likely")

    ta, tb = (texts.select(F.col("class").alias(f"class_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(*signer_args)
        for batch in batches:
            value = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                sx, sy = signer.shingles(x), signer.shingles(y)
                both = len(np.intersect1d(sx, sy, assume_unique=True))
                value.append(both / (len(sx) + len(sy) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["class_a", "class_b", "similarity"])

    with_text = likely.join(ta, "class_a").join(tb, "class_b").select("class_a", "class_b", "text_a", "text_b")
    return with_text.mapInArrow(exact, "class_a bigint, class_b bigint, similarity double").filter(F.col("similarity") >= threshold)


def _pairs_in(members: Column) -> Column:
    """All pairs of a sorted array of at most one tile."""
    return F.flatten(F.transform(members, lambda a: F.transform(F.filter(members, lambda b: b > a), lambda b: F.struct(a.alias("class_a"), b.alias("class_b")))))


def near_duplicates(records: DataFrame, key: str, text: str, group: str, width: int, threshold: float, bands: int, rows: int, bits: int = 2, seed: int = 42) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: records of different ``group`` whose texts are nearly the same.

    * Texts are compared as given (see ``normal_text``); null and empty texts, null keys and null groups take no part.
    * Records repeated under the same key and text count once. Extra columns are ignored; an empty table gives no rows.
    * Exact copies form classes. Members of two linked classes, or of one class, are written out in pairs up to
      ``FULL_PAIRS`` pairs, and where one of the classes is a single record; beyond it every member is paired with the
      smallest key of another group in its own class and in every linked one, which keeps every record connected that
      has a counterpart in another group.
    * A class is a 64-bit hash of the text. Should two different texts ever meet in one, the job fails rather than
      merging them; another ``seed`` parts them.
    """
    return expand(*classes_and_links(records, key, text, group, width, threshold, bands, rows, bits, seed))


def class_members(records: DataFrame, key: str, text: str, group: str, width: int, threshold: float, bands: int, rows: int, bits: int = 2, seed: int = 42) -> DataFrame:
    """(key, class_id, copies, links): one row per record, with its class of exact copies, how many keys the class has, and
    to how many classes of different texts it is linked. With ``class_links`` this states every link without writing pairs of copies.

    Defined results for odd rows are those of ``near_duplicates``; a record that takes no part has no row.
    """
    members, links = classes_and_links(records, key, text, group, width, threshold, bands, rows, bits, seed)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class").agg(F.countDistinct("key").alias("copies"))
    known = members.join(sizes, "class").join(ends, "class", "left")
    return known.select("key", F.col("class").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def class_links(records: DataFrame, key: str, text: str, group: str, width: int, threshold: float, bands: int, rows: int, bits: int = 2, seed: int = 42) -> DataFrame:
    """(class_a, class_b, similarity): every pair of different texts whose similarity reaches the threshold, by class."""
    return classes_and_links(records, key, text, group, width, threshold, bands, rows, bits, seed)[1]


def classes_and_links(records: DataFrame, key: str, text: str, group: str, width: int, threshold: float, bands: int, rows: int, bits: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Members (key, grp, class) of the classes of exact copies, and links (class_a, class_b, similarity) of classes, as written tables."""
    base = records.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(group).alias("grp")).filter("key is not null and grp is not null and text is not null and text <> ''")
    base = materialise(base.withColumn("class", F.xxhash64(F.lit(seed), "text")).withColumn("proof", F.xxhash64(F.lit(seed + 1), "text")), "records")
    # The text crosses one exchange, members travel without it. A second hash proves that a class holds one text.
    same = F.when(F.min("proof") == F.max("proof"), F.min("text")).otherwise(F.raise_error(F.lit("two texts share a class; choose another seed")))
    texts = materialise(base.groupBy("class").agg(same.alias("text")), "class-texts")
    links = materialise(similar_classes(texts, width, threshold, bands, rows, bits), "links")
    return materialise(base.select("key", "grp", "class").distinct(), "members"), links


def expand(members: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of records from links of classes; see ``near_duplicates`` for the form of large classes."""

    def inside(rows: DataFrame) -> DataFrame:
        ones, others = (rows.select("class", F.col("key").alias(f"key_{s}"), F.col("grp").alias(f"grp_{s}")) for s in "ab")
        return ones.join(others, "class").filter("key_a < key_b and grp_a <> grp_b").select("key_a", "key_b", F.lit(1.0).alias("similarity"))

    def between(pairs: DataFrame) -> DataFrame:
        left, right = (members.select(F.col("class").alias(f"class_{s}"), F.col("key").alias(f"k{s}"), F.col("grp").alias(f"g{s}")) for s in "ab")
        joined = pairs.select("class_a", "class_b", "similarity").join(left, "class_a").join(right, "class_b").filter("ga <> gb and ka <> kb")
        return joined.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"), "similarity")

    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "grp")).alias("c1")).filter("n > 1")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest * largest <= FULL_PAIRS:
        # No class and no link has too many pairs.
        return inside(members).unionByName(between(links)).groupBy("key_a", "key_b").agg(F.max("similarity").alias("similarity"))

    # Centres of a star: the first key, and the first key of another group for those in the first one's group.
    second = members.join(sizes, "class").filter(F.col("grp") != F.col("c1.grp")).groupBy("class").agg(F.min("key").alias("k2"))
    several = sizes.select("class", "n", F.col("c1.key").alias("k1"), F.col("c1.grp").alias("g1")).join(second, "class", "left")
    several = materialise(several, "copied-classes")

    def to_centre(rows: DataFrame) -> DataFrame:
        centre = F.when(F.col("grp") != F.col("g1"), F.col("k1")).otherwise(F.col("k2"))
        rows = rows.withColumn("centre", centre).filter("centre is not null and centre <> key")
        return rows.select(F.least("key", "centre").alias("key_a"), F.greatest("key", "centre").alias("key_b"), "similarity")

    # Within one class: all pairs of a small one, each key to a centre of a large one.
    many = members.join(several, "class")
    small = F.col("n") * (F.col("n") - 1) <= 2 * FULL_PAIRS
    out = inside(many.filter(small)).unionByName(to_centre(many.filter(~small).withColumn("similarity", F.lit(1.0))))

    # Between linked classes: all pairs of members, or each member of either side to a centre of the other.
    def named(s: str) -> DataFrame:
        return several.select(F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n{s}"), F.col("k1").alias(f"k1{s}"), F.col("g1").alias(f"g1{s}"), F.col("k2").alias(f"k2{s}"))

    sized = materialise(links.join(named("a"), "class_a", "left").join(named("b"), "class_b", "left"), "sized-links")
    # A side that isn't among the copied classes is one record, whose pairs are no more than those of a star.
    full = F.coalesce(F.col("na") * F.col("nb") <= FULL_PAIRS, F.lit(True))
    out = out.unionByName(between(sized.filter(full)))
    for s, o in ("ab", "ba"):
        star = sized.filter(~full).select(F.col(f"class_{s}").alias("class"), F.col(f"k1{o}").alias("k1"), F.col(f"g1{o}").alias("g1"), F.col(f"k2{o}").alias("k2"), "similarity")
        out = out.unionByName(to_centre(star.join(members, "class")))
    return out.groupBy("key_a", "key_b").agg(F.max("similarity").alias("similarity"))
