"""Hard negatives of anchors by bit-sliced integer products.

1. Slicing. Components become integers; rows are dealt by hash into blocks of a bounded number of components, and a block is
   stored as bit planes of its integers in two's complement: the plane of signs (weight -2^b), then those of 2^(b-1) to 1.
   Anchors are dealt into blocks of their own, as plain integers.
2. Grid. Every block of anchors meets every block of rows (the anchors are the stated query set). A task adds up its planes,
   most significant first. With the planes down to 2^k known, what is missing of a component is 0 to 2^k - 1, so a score lies
   between its partial sum plus (2^k - 1) times the anchor's negative components and the same with its positive ones. A pair is
   dropped as soon as that interval can't qualify; once few pairs are left, planes are read for these alone.
3. Positives: a row of the anchor's label qualifies unless its interval is below the last of the anchor's first rows so far.
4. Negatives: each positive gives a window of scores; a row of another label qualifies if its interval reaches into one,
   not below the last of that window's first rows so far.
Blocks give at most that many rows an anchor (and window), which meet once more for the first of all blocks.

Scores are exact: sums are kept in 32-bit or 64-bit floats where all of them are integers that these hold, else as integers
of any length.

Defined results: rows with a null label or vector, or with a null, non-finite or too large component (LARGEST and more) take
no part; shorter vectors count as if they went on with zeros, and empty ones have a score of 0; ties in score go by id, null
ids last; repeated rows are rows of their own, and a copy of an anchor may be its positive; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, parts

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
SCALE, LARGEST = 256, 1 << 15
BLOCK_VALUES, ANCHOR_VALUES = 1 << 22, 1 << 20
#: A block that isn't full has so many rows on average.
BLOCK_ROWS = 1024
TILE, SPARSE = 2048, 1 / 16


def integers(rows: DataFrame) -> DataFrame:
    """id, label, vector, anchor -> id, label, anchor, v (array of long): the rows that take part."""
    fits = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    v = F.transform("vector", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & fits).select("id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), v.alias("v"))


def matrix(vectors: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    vectors = vectors.combine_chunks()
    n = pc.list_value_length(vectors).to_numpy().astype(np.int64)
    flat = vectors.flatten().to_numpy()
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims), np.int64)
    out[np.arange(dims) < n[:, None]] = flat
    return out


SLICED = "r_block int, ids array<long>, labels array<long>, planes array<binary>"
PACKED = "a_block int, ids array<long>, labels array<long>, own array<long>, data binary"


def width(v: np.ndarray) -> int:
    """Bits of the integers, without the sign."""
    return max(int(v.max(initial=0)).bit_length(), int(-1 - v.min(initial=0)).bit_length())


def slicer(dims: int):
    def cut_up(key, t):
        v = matrix(t["v"], dims)
        planes = [np.packbits(v < 0, axis=1), *(np.packbits((v >> k) & 1 != 0, axis=1) for k in reversed(range(width(v))))]
        return pa.table({"r_block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), "labels": pa.array([t["label"].to_pylist()], pa.list_(pa.int64())), "planes": pa.array([[p.tobytes() for p in planes]], pa.list_(pa.binary()))})

    return cut_up


def packer(dims: int):
    def pack(key, t):
        v = matrix(t["v"], dims)
        own = [int(x) for x in (v.astype(object) ** 2).sum(1)] if dims else [0] * len(v)
        return pa.table({"a_block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t["id"].to_pylist()], pa.list_(pa.int64())), "labels": pa.array([t["label"].to_pylist()], pa.list_(pa.int64())), "own": pa.array([own], pa.list_(pa.int64())), "data": pa.array([v.astype(np.int32).tobytes()], pa.binary())})

    return pack


class Block:
    """A block of rows: ids and labels, and its bit planes."""

    def __init__(self, t: pa.Table, dims: int):
        self.ids = t["ids"].combine_chunks().flatten()
        self.order = np.where(self.ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).max, pc.fill_null(self.ids, 0).to_numpy())
        self.labels = t["labels"].combine_chunks().flatten().to_numpy()
        self.dims = dims
        self.planes = [np.frombuffer(p, np.uint8).reshape(len(self.labels), -1) for p in t["planes"].to_pylist()[0]]
        self.weights = [-(1 << (len(self.planes) - 1)), *(1 << k for k in reversed(range(len(self.planes) - 1)))]

    def plane(self, i: int, rows: np.ndarray, kind) -> np.ndarray:
        return np.unpackbits(self.planes[i][rows], axis=1, count=self.dims).astype(kind)


def sieve(q: np.ndarray, block: Block, rows: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, number: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (number of anchor, row of the block) of those alive whose score is in [low, high] of the anchor, and the scores.

    With a number, `low` rises where it is open (-inf): to the lower end that so many of the anchor's rows reach.
    """
    most = int(np.abs(q).sum(1).max(initial=0)) << (len(block.planes) - 1)
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    if kind is np.float32:  # the ends of no interval go beyond 2^24
        low, high = np.clip(low, -(2.0**24), 2.0**24).astype(kind), np.clip(high, -(2.0**24), 2.0**24).astype(kind)
    up, down = np.maximum(q, 0).sum(1).astype(kind), np.minimum(q, 0).sum(1).astype(kind)
    q = q.astype(kind)
    partial, a, r = np.zeros(alive.shape, kind), None, None
    open_ = number and len(rows) >= number
    for i, w in enumerate(block.weights):
        rest = (1 << (len(block.weights) - 1 - i)) - 1
        if a is None:
            partial += w * (q @ block.plane(i, rows, kind).T)
            least = partial + (rest * down)[:, None]
            if open_:
                reached = np.sort(np.where(alive, least, -np.inf), axis=1)[:, -number] if kind is object else np.partition(np.where(alive, least, -np.inf), -number, axis=1)[:, -number]
                low = np.maximum(low, reached)
            alive &= ((partial + (rest * up)[:, None]) >= low[:, None]) & (least <= high[:, None])
            if np.count_nonzero(alive) <= SPARSE * alive.size or not rest:
                a, r = np.nonzero(alive)
                partial = partial[a, r]
        else:
            partial = partial + w * (q[a] * block.plane(i, rows[r], kind)).sum(1)
            keep = (partial + rest * up[a] >= low[a]) & (partial + rest * down[a] <= high[a])
            a, r, partial = a[keep], r[keep], partial[keep]
    return a, rows[r], np.array(partial, np.int64)


class First:
    """The first `number` rows of each key: larger scores first, then smaller ids."""

    def __init__(self, number: int):
        self.number, self.held = number, [np.zeros(0, np.int64)] * 4

    def add(self, key: np.ndarray, row: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        key, row, score, order = (np.concatenate(x) for x in zip(self.held, (key, row, score, order), strict=True))
        by = np.lexsort((order, -score, key))
        key = key[by]
        first = np.searchsorted(key, key, "left")
        by = by[np.arange(len(by)) - first < self.number]
        self.held = [np.sort(key)[np.arange(len(key)) - first < self.number], row[by], score[by], order[by]]

    def last(self, keys: int) -> np.ndarray:
        """The last score of each full key, else -inf."""
        out, (key, _, score, _) = np.full(keys, -np.inf), self.held
        n = np.bincount(key, minlength=keys)
        full = n == self.number
        out[full] = score[np.cumsum(n)[full] - 1]
        return out


def tiles(n: int):
    return ((a, min(n, a + TILE)) for a in range(0, n, TILE))


FOUND = "a_block int, a_no int, anchor_id long, own long, id long, score long"


def positives_of(dims: int, number: int):
    def find(key, anchors, t):
        if not anchors.num_rows or not t.num_rows:
            return pa.table({c: pa.array([], k) for c, k in zip(("a_block", "a_no", "anchor_id", "own", "id", "score"), (pa.int32(), pa.int32(), *[pa.int64()] * 4), strict=True)})
        block = Block(t, dims)
        labels = anchors["labels"].combine_chunks().flatten().to_numpy()
        q = np.frombuffer(anchors["data"].to_pylist()[0], np.int32).reshape(len(labels), dims).astype(np.int64)
        by, theirs = np.argsort(block.labels, kind="stable"), np.sort(block.labels)
        best = First(number + 1)
        for label in np.unique(labels):
            rows = by[np.searchsorted(theirs, label, "left") : np.searchsorted(theirs, label, "right")]
            mine = np.flatnonzero(labels == label)
            for x, y in tiles(len(mine)):
                for a, b in tiles(len(rows)):
                    low = best.last(len(labels))[mine[x:y]]
                    k, r, s = sieve(q[mine[x:y]], block, rows[a:b], np.ones((y - x, b - a), bool), low, np.full(y - x, np.inf), number + 1)
                    best.add(mine[x:y][k], r, s, block.order[r])
        k, r, s, _ = best.held
        at = pa.array(k)
        return pa.table({"a_block": pa.array([key[0].as_py()] * len(k), pa.int32()), "a_no": pa.array(k, pa.int32()), "anchor_id": anchors["ids"].combine_chunks().flatten().take(at), "own": anchors["own"].combine_chunks().flatten().take(at), "id": block.ids.take(pa.array(r)), "score": pa.array(s, pa.int64())})

    return find


WINDOWS = "a_block int, labels array<long>, data binary, scores binary"


def windowed(number: int):
    """Packed anchors and their positives -> the anchors with their positives' scores, as a matrix (-1: none)."""

    def put(key, anchors, found):
        n = len(anchors["labels"].combine_chunks().flatten())
        scores = np.full((n, number), -1, np.int64)  # a negative score gives no window, either
        scores[found["a_no"].to_numpy(), found["positive"].to_numpy()] = found["score"].to_numpy()
        return pa.table({"a_block": anchors["a_block"], "labels": anchors["labels"], "data": anchors["data"], "scores": pa.array([scores.tobytes()] * anchors.num_rows, pa.binary())})

    return put


NEGATIVE = "a_block int, a_no int, positive int, id long, score long"


def negatives_of(dims: int, number: int, windows: int, low_percent: int, high_percent: int):
    def find(key, anchors, t):
        best = First(number)
        if anchors.num_rows and t.num_rows:
            block = Block(t, dims)
            labels = anchors["labels"].combine_chunks().flatten().to_numpy()
            q = np.frombuffer(anchors["data"].to_pylist()[0], np.int32).reshape(len(labels), dims).astype(np.int64)
            scores = np.frombuffer(anchors["scores"].to_pylist()[0], np.int64).reshape(len(labels), windows)
            has = scores >= 0
            low = np.where(has, -(-low_percent * scores // 100), np.inf)
            high = np.where(has, high_percent * scores // 100, -np.inf)
            some = np.flatnonzero((low <= high).any(1))
            for x, y in tiles(len(some)):
                mine = some[x:y]
                for a, b in tiles(len(block.labels)):
                    rows = np.arange(a, b)
                    from_ = np.maximum(low[mine], best.last(len(labels) * windows).reshape(-1, windows)[mine])
                    k, r, s = sieve(q[mine], block, rows, labels[mine][:, None] != block.labels[rows], from_.min(1), high[mine].max(1))
                    hit, w = np.nonzero((s[:, None] >= from_[k]) & (s[:, None] <= high[mine][k]))
                    best.add(mine[k[hit]] * windows + w, r[hit], s[hit], block.order[r[hit]])
            ids = block.ids
        else:
            ids = pa.array([], pa.int64())
        k, r, s, _ = best.held
        return pa.table({"a_block": pa.array([key[0].as_py()] * len(k), pa.int32()), "a_no": pa.array(k // windows, pa.int32()), "positive": pa.array(k % windows, pa.int32()), "id": ids.take(pa.array(r)), "score": pa.array(s, pa.int64())})

    return find


def first_of(number: int) -> Column:
    """The first rows of a group, of a bounded number from each block: structs (less, no_id, id), less being minus the score."""
    return F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), F.col("id").isNull().alias("no_id"), "id"))), 1, number)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_values: int = BLOCK_VALUES, anchor_values: int = ANCHOR_VALUES) -> DataFrame:
    """id, label, vector, anchor (boolean) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The first `negatives` rows of another label for each anchor and each of its first `positives` rows of the same label, of
    those with `low` to `high` per cent of the positive's score.
    """
    spark = rows.sparkSession
    # repeated rows are dealt apart by a random number, which is written down, as a task run again may draw others
    t = cut(integers(rows).withColumn("deal", F.xxhash64("id", "v", F.rand(7))), "integers")
    total, anchors, dims = t.agg(F.count("*"), F.count(F.when(F.col("anchor"), 1)), F.max(F.size("v"))).first()
    dims = max(dims or 0, 1)
    r_blocks, a_blocks = max(min(2 * parts(spark), total // BLOCK_ROWS), -(-total * dims // block_values), 1), max(1, -(-anchors * dims // anchor_values))
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "deal"), F.lit(n)).cast("int")
    sliced = cut(t.withColumn("r_block", dealt("row", r_blocks)).groupBy("r_block").applyInArrow(slicer(dims), SLICED), "sliced")
    packed = cut(t.where("anchor").withColumn("a_block", dealt("anchor", a_blocks)).groupBy("a_block").applyInArrow(packer(dims), PACKED), "anchors")
    discard(t)
    n = max(parts(spark), min(a_blocks * r_blocks, 1 << 14))
    every = lambda blocks, c: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(c)
    grid = sliced.select("*", every(a_blocks, "a_block")).repartition(n, "a_block", "r_block").groupBy("a_block", "r_block")
    met = lambda a: a.select("*", every(r_blocks, "r_block")).repartition(n, "a_block", "r_block").groupBy("a_block", "r_block")
    found = met(packed).cogroup(grid).applyInArrow(positives_of(dims, positives), FOUND)
    found = found.groupBy("a_block", "a_no").agg(F.first("anchor_id").alias("anchor_id"), F.first("own").alias("own"), first_of(positives + 1).alias("first"))
    # one of the rows that look like the anchor is the anchor itself
    itself = F.array_position("first", F.struct((-F.col("own")).alias("less"), F.col("anchor_id").isNull().alias("no_id"), F.col("anchor_id").alias("id")))
    found = found.withColumn("itself", itself).withColumn("first", F.slice(F.filter("first", lambda x, i: i + 1 != F.col("itself")), 1, positives))
    found = cut(found.select("a_block", "a_no", "anchor_id", F.posexplode("first").alias("positive", "x")).select("a_block", "a_no", "anchor_id", "positive", F.col("x.id").alias("positive_id"), (-F.col("x.less")).alias("score")), "positives")
    windows = cut(packed.groupBy("a_block").cogroup(found.groupBy("a_block")).applyInArrow(windowed(positives), WINDOWS), "windows")
    got = met(windows).cogroup(grid).applyInArrow(negatives_of(dims, negatives, positives, low, high), NEGATIVE)
    got = got.groupBy("a_block", "a_no", "positive").agg(first_of(negatives).alias("first")).select("a_block", "a_no", "positive", F.posexplode("first").alias("rank", "x"))
    out = cut(
        got.join(found, ["a_block", "a_no", "positive"]).select(
            "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("x.less")).alias("negative_score")
        ),
        "hard-negatives",
    )
    discard(sliced, packed, found, windows)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    return hard_negatives(e.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


#: All anchors against all rows.
OP11_SQL = """
WITH e AS (
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3
"""
