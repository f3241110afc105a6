"""The most similar vectors of every vector, through a permutation index.

A bounded sample of the vectors serves as pivots. Every vector is represented by its nearest pivots in their order, and posted
in the inverted file of each of them. Inside an inverted file the members are ranked for each query by the footrule distance of
their orders; the best, and all that come near them (pivot orders are nearly alike in a dense cluster, where the footrule can't
choose), are ranked again by quantised vectors, and the best of all files by their full vectors in double precision.

Every vector is indexed. Equal vectors share one posting. A file that grows beyond ``list_rows`` is cut into tiles
whose pairs are separate groups: no group is unbounded, no vector is dropped, and no pair of a file goes uncompared.
A file beyond ``MOST_TILES`` tiles, where comparing all pairs would grow with the square of the collection, gets pivots of
its own, and its members are posted in the files of the nearest of them; this is repeated as long as files stay that long.
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

#: Vectors per pivot, and the bounds of the number of pivots (4,096 pivots of 64 floats are 1 MB).
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 100, 64, 4096
#: Best members of an inverted file by footrule, and how much worse, in positions a pivot, one may be that is ranked again with them.
RERANK, NEAR = 48, 4
#: Pivots up to which ``length`` holds as given; beyond them it grows with the square root of their number.
LENGTH_PIVOTS = 1000
#: Rows of one inverted file, and of one tile of a longer one.
LIST_ROWS, TILE_ROWS = 4000, 2000
#: Tiles up to which a long file is compared whole; a longer one is split by pivots of its own.
MOST_TILES = 16
#: Pivots of its own that a member of a split file is posted under, members for one such pivot, and rounds of splitting; what is still longer
#: then (near-copies in their thousands, which no pivot tells apart) is compared in tiles.
OWN_LENGTH, PER_OWN_PIVOT, ROUNDS = 4, 500, 4
#: Rows of a split file that one task posts at a time.
CHUNK_ROWS = 20_000
#: Tables of long lists up to this many rows are broadcast (about 40 bytes each).
BROADCAST_LISTS = 100_000


def sound(vectors: Column, dims: int) -> Column:
    """True for arrays of ``dims`` finite numbers, not all of them zero; false, never null, for all else."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vectors) == dims) & finite & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _unit(matrix: np.ndarray) -> np.ndarray:
    # Scaled by the largest number first, so that squares neither overflow nor vanish.
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


class _Footrule:
    """Footrule distances of pivot orders to those of the members of one file; a pivot outside of an order stands right behind its end."""

    def __init__(self, orders: np.ndarray):
        self.size, self.length = orders.shape
        self.pivots, local = np.unique(orders, return_inverse=True)
        # place[pivot, row]: position of a pivot in the order of a row; the last line is that of pivots no row has.
        self.place = np.full((len(self.pivots) + 1, self.size), self.length, dtype=np.uint8)
        self.place[local.reshape(orders.shape), np.arange(self.size)[:, None]] = np.arange(self.length, dtype=np.uint8)
        # What a pivot at position i of the query adds, by its position in the row: the difference, less what the row's own pivot would add if the query lacked it.
        places = np.arange(self.length + 1)
        self.adds = (np.abs(np.arange(self.length)[:, None] - places[None, :]) - (self.length - places)[None, :]).astype(np.int16)

    def to_all(self, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pivots, asked), len(self.pivots) - 1)
        at = np.where(self.pivots[at] == asked, at, len(self.pivots))
        out = np.full((len(asked), self.size), self.length * (self.length + 1) // 2, dtype=np.int16)
        for i in range(self.length):
            out += self.adds[i][self.place[at[:, i]]]
        return out


def _directions(codes: np.ndarray) -> np.ndarray:
    """Quantised vectors at length 1."""
    vectors = codes.astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def _compare_list(group: pd.DataFrame, keep: int, least: float, length: int, rerank: int) -> pd.DataFrame:
    """Best pairs (a, b, approx) of one inverted file or tile pair."""
    queries, data = group[group["as_query"]], group[group["as_data"]]
    empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "approx": np.zeros(0)})
    if not len(queries) or len(data) < 1:
        return empty

    def unpack(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(part["code"]), np.int16).reshape(len(part), -1)
        return part["class"].to_numpy(), codes[:, :length], _directions(codes[:, length:])

    qid, q_order, q_vec = unpack(queries)
    did, d_order, d_vec = unpack(data)
    ranks = None
    out_a, out_b, out_s = [], [], []
    for at in range(0, len(qid), 256):
        block = slice(at, at + 256)
        score = q_vec[block] @ d_vec.T
        score[qid[block][:, None] == did[None, :]] = -9.0
        fit = score >= least
        if len(did) > rerank + 1:
            # Queries of which no member is alike enough need no ranking.
            hopeful = np.flatnonzero(fit.any(axis=1))
            if len(hopeful):
                ranks = ranks or _Footrule(d_order)
                footrule = ranks.to_all(q_order[block][hopeful])
                # The query itself is one of the rows.
                last = np.partition(footrule, rerank, axis=1)[:, rerank]
                fit[hopeful] &= footrule <= (last + NEAR * length)[:, None]
                score[~fit] = -9.0
        crowded = np.nonzero(fit.sum(axis=1) > keep)[0]
        if len(crowded):
            top = np.argpartition(score[crowded], score.shape[1] - keep, axis=1)[:, -keep:]
            fit[crowded] = False
            fit[crowded[:, None], top] = True
        row, col = np.nonzero(fit)
        out_a.append(qid[block][row])
        out_b.append(did[col])
        out_s.append(score[row, col])
    return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "approx": np.concatenate(out_s).astype(np.float64)})


def similar_vectors(
    vectors: DataFrame,
    key: str,
    space: str,
    array: str,
    k: int = 5,
    dims: int = 64,
    min_cosine: float | None = None,
    queries: Column | None = None,
    length: int = 16,
    rerank: int = RERANK,
    list_rows: int = LIST_ROWS,
    tile_rows: int = TILE_ROWS,
    per_pivot: int = PER_PIVOT,
    most_tiles: int = MOST_TILES,
) -> DataFrame:
    """(vec_id, neighbour_id, cosine, rank): the ``k`` vectors of the same ``space`` most alike to every vector, by cosine.

    * Unsound vectors (null, other than ``dims`` numbers, not finite, all zero), null keys and null spaces take no part.
    * Equal cosines (to nine decimals) go to the smaller key. Equal vectors are found exactly. A row repeated with its key counts once.
    * ``min_cosine`` drops less similar pairs early; ``queries`` is a condition on ``key`` for the vectors that ask (all by default).
    * ``length``: pivots a vector is posted under, more of them where there are more than ``LENGTH_PIVOTS`` pivots.
    * ``rerank``: members of a file that are ranked again as the best by footrule, and with them all within ``NEAR`` positions a pivot.
    * Fewer vectors than ``k`` give fewer rows, an empty table none. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    asks = F.lit(True) if queries is None else queries
    base = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(space).alias("space"), F.col(array).cast("array<float>").alias("v"), asks.alias("asks"))
    base = base.filter(F.col("vec_id").isNotNull() & F.col("space").isNotNull() & sound(F.col("v"), dims))
    base = materialise(base.withColumn("class", F.xxhash64("space", "v")), "sound-vectors")
    same = F.when((F.min("v") == F.max("v")) & (F.min("space") == F.max("space")), F.min("v")).otherwise(F.raise_error(F.lit("two vectors share a class")))
    classes = materialise(base.groupBy("class").agg(F.min("space").alias("space"), same.alias("v"), F.max("asks").alias("asks")), "vector-classes")
    total = classes.count()

    # Pivots: a sample of bounded size, drawn by hash so that every run draws the same.
    count = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, total // per_pivot)))
    share = min(1.0, 3.0 * count / max(total, 1))
    drawn = classes.filter(F.abs(F.hash("class")) <= F.lit(int(share * (2**31 - 1)))) if share < 1.0 else classes
    pivot_rows = drawn.select("class", "v").orderBy(F.hash("class"), "class").limit(count).collect()
    pivots = spark.sparkContext.broadcast(_unit(np.array([r.v for r in pivot_rows], dtype=np.float64)).astype(np.float32) if pivot_rows else np.zeros((0, dims), np.float32))
    # Of more pivots two neighbours share fewer of their nearest ones.
    length = max(1, min(math.ceil(length * math.sqrt(max(1.0, len(pivot_rows) / LENGTH_PIVOTS))), len(pivot_rows)))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                unit = _unit(_matrix(part.column(3), dims))
                near = unit.astype(np.float32) @ table.T
                best = np.argpartition(-near, length - 1, axis=1)[:, :length] if length < near.shape[1] else np.broadcast_to(np.arange(length), near.shape)
                # Nearest first; of equally near ones the smaller number.
                best = np.sort(best, axis=1)
                best = np.take_along_axis(best, np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable"), axis=1)
                codes = np.rint(unit * (32767.0 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * length), pa.array(best.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists, pa.array([r.tobytes() for r in np.concatenate([best.astype(np.int16), codes], axis=1)], pa.binary())], names=["class", "space", "asks", "near", "code"])

    kind = "class bigint, space string, asks boolean, near array<int>, code binary"
    indexed = materialise(classes.select("class", F.col("space").cast("string").alias("space"), "asks", "v").mapInArrow(order, kind), "permutations")
    posts = _posts(indexed, length, list_rows, tile_rows, most_tiles)

    keep = k + 5
    least = -2.0 if min_cosine is None else min_cosine - 0.02
    compare = lambda group: _compare_list(group, keep, least, length, rerank)
    found = posts.groupBy("space", "p", "t", "u").applyInPandas(compare, "a bigint, b bigint, approx double")
    merged = found.groupBy("a", "b").agg(F.max("approx").alias("approx"))
    best = merged.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("approx").desc(), "b"))).filter(F.col("r") <= keep)
    pairs = materialise(best.select("a", "b"), "candidate-pairs")

    # Full vectors of the surviving pairs only.
    va, vb = (classes.select(F.col("class").alias(s), F.col("v").alias(f"v{s}")) for s in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cosine = np.einsum("nd,nd->n", _unit(_matrix(batch.column(2), dims)), _unit(_matrix(batch.column(3), dims)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(cosine, 9))], names=["a", "b", "cosine"])

    scored = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(exact, "a bigint, b bigint, cosine double")
    if min_cosine is not None:
        scored = scored.filter(F.col("cosine") >= min_cosine)
    return _members(base, scored, k)


def _near(df: DataFrame) -> DataFrame:
    """A table of long lists, broadcast where its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_LISTS else df


def _long_lists(posts: DataFrame, rows: int) -> DataFrame:
    counts = posts.groupBy("space", "p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > rows)
    return materialise(counts.select(F.col("space").alias("ls"), F.col("p").alias("lp"), "n"), "long-lists")


def _split(posts: DataFrame, huge: DataFrame, length: int, per_pivot: int) -> DataFrame:
    """Postings in which the members of huge lists are posted under the nearest of their list's own pivots instead.

    The pivots of a list are a sample of its members, at most ``MOST_PIVOTS``; members are posted chunk by chunk, each with a copy of
    the pivots, so that neither a list nor the pivots of all lists meet in one place.
    """
    huge = huge.withColumn("m", F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2 * OWN_LENGTH), F.ceil(F.col("n") / F.lit(per_pivot))))).withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK_ROWS)))
    near = _near(huge)
    on = (F.col("space") == F.col("ls")) & (F.col("p") == F.col("lp"))
    light = posts.join(near, on, "left_anti")
    heavy = posts.join(near, on).withColumn("draw", F.xxhash64("class", "p"))
    # A draw by hash takes about m members, the same ones in every run.
    drawn = heavy.filter(F.pmod("draw", F.lit(1_000_003)) < F.ceil(F.lit(1_000_003.0) * F.col("m") / F.col("n")))
    own = drawn.groupBy("space", "p").agg(F.max("chunks").alias("chunks"), F.sort_array(F.collect_list(F.struct("draw", "code"))).alias("drawn"))
    own = materialise(own.select("space", "p", "chunks", F.transform("drawn", lambda x: x["code"]).alias("pivots")), "own-pivots")
    own = own.select("space", "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "pivots")
    rows = heavy.select("space", "p", F.pmod(F.xxhash64("class", F.lit(9)), F.col("chunks")).alias("chunk"), "class", "code", "asks")

    def post(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        names = ["space", "p", "own", "class", "code", "asks"]
        if not len(members):
            return members.assign(own=0)[names]
        if not len(pivots):
            return members.assign(own=0)[names]
        unpack = lambda codes: _directions(np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1)[:, length:])
        table, own = unpack(list(pivots["pivots"].iloc[0])), unpack(list(members["code"]))
        count = min(OWN_LENGTH, len(table))
        best = np.concatenate([np.argpartition(-(own[k : k + 2048] @ table.T), count - 1, axis=1)[:, :count] for k in range(0, len(own), 2048)])
        out = members.loc[members.index.repeat(count)].reset_index(drop=True)
        return out.assign(own=best.ravel())[names]

    kind = "space string, p bigint, own bigint, class bigint, code binary, asks boolean"
    again = rows.groupBy("space", "p", "chunk").cogroup(own.groupBy("space", "p", "chunk")).applyInPandas(post, kind)
    # Names of new lists; should two lists ever share one, they are only compared together.
    return materialise(light.unionByName(again.withColumn("p", F.xxhash64("p", "own")).drop("own")), "split-lists")


def _posts(indexed: DataFrame, length: int, list_rows: int, tile_rows: int, most_tiles: int) -> DataFrame:
    """Postings (space, p, t, u, class, code, as_query, as_data) of bounded lists; t and u are -1 where a list needs no tiles."""
    every = indexed.select("space", F.explode(F.col("near").cast("array<bigint>")).alias("p"), "class", "code", "asks")
    long = _long_lists(every.select("space", "p"), list_rows)
    for _ in range(ROUNDS):
        huge = long.filter(F.col("n") > tile_rows * most_tiles)
        if huge.isEmpty():
            break
        # The new lists hold about OWN_LENGTH * per members, half of what a list may hold at most.
        every = _split(every, huge, length, max(1, min(PER_OWN_PIVOT, tile_rows * most_tiles // (2 * OWN_LENGTH))))
        long = _long_lists(every.select("space", "p"), list_rows)
    if long.isEmpty():
        return every.select("*", F.lit(-1).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("u"), F.col("asks").alias("as_query"), F.lit(True).alias("as_data"))
    long = long.select("ls", "lp", F.ceil(F.col("n") / F.lit(tile_rows)).alias("tiles"))
    split = every.join(_near(long), (F.col("space") == F.col("ls")) & (F.col("p") == F.col("lp")), "left")
    split = split.withColumn("tile", F.pmod(F.xxhash64("class", F.lit(5)), F.coalesce(F.col("tiles"), F.lit(1))))
    # A query tile meets every data tile: (t, u) = (tile of the query, tile of the data).
    sides = F.explode(
        F.when(F.col("tiles").isNull(), F.array(F.struct(F.lit(-1).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("u"), F.lit(True).alias("q"), F.lit(True).alias("d")))).otherwise(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("tiles"), F.lit(1)) * 2 - 1),
                lambda i: F.when(i < F.col("tiles"), F.struct(F.col("tile").alias("t"), i.alias("u"), F.lit(True).alias("q"), (i == F.col("tile")).alias("d"))).otherwise(
                    F.struct((i - F.col("tiles")).alias("t"), F.col("tile").alias("u"), F.lit(False).alias("q"), (i - F.col("tiles") != F.col("tile")).alias("d"))
                ),
            )
        )
    ).alias("s")
    cut = split.select("space", "p", "class", "code", "asks", sides)
    cut = cut.select("space", "p", "class", "code", F.col("s.t").alias("t"), F.col("s.u").alias("u"), (F.col("asks") & F.col("s.q")).alias("as_query"), F.col("s.d").alias("as_data"))
    return cut.filter("as_query or as_data")


def _members(base: DataFrame, scored: DataFrame, k: int) -> DataFrame:
    """Neighbours of every asking vector from links of classes: the k best by cosine, then key; linear in the vectors."""
    members = base.select("class", "vec_id", "asks").groupBy("class", "vec_id").agg(F.max("asks").alias("asks"))
    first = members.withColumn("r", F.row_number().over(W.partitionBy("class").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    # At most k + 1 keys a class are ever collected.
    firsts = materialise(first.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "first-members")
    others = scored.join(firsts.withColumnRenamed("class", "b"), "b").select("a", "cosine", F.explode("ids").alias("id"))
    others = others.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("cosine").desc(), "id"))).filter(F.col("r") <= k)
    others = others.groupBy("a").agg(F.collect_list(F.struct((-F.col("cosine")).alias("c"), F.col("id").alias("id"))).alias("others"))
    each = members.filter("asks").join(firsts, "class").join(others.withColumnRenamed("a", "class"), "class", "left")
    own = F.transform(F.filter("ids", lambda x: x != F.col("vec_id")), lambda x: F.struct(F.lit(-1.0).alias("c"), x.alias("id")))
    ranked = F.slice(F.sort_array(F.concat(own, F.coalesce("others", F.array().cast("array<struct<c:double,id:bigint>>")))), 1, k)
    flat = each.select("vec_id", F.posexplode(ranked).alias("pos", "n"))
    return flat.select("vec_id", F.col("n.id").alias("neighbour_id"), (-F.col("n.c")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
