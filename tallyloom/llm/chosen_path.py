"""MinHash near-duplicates by a chosen-path set similarity join: documents whose 3-word shingle sets have a similarity of 0.85
or more.

1. Trees. In each of TREES independent trees a set goes down DEPTH levels from the root; at each node it takes two branches,
   and the smallest of its shingles under a branch's hash function (its minwise token) chooses the child. Two sets of
   similarity s take the same child of a branch with probability s, so a pair is still together in a tree after any number of
   levels with probability q = 1 - (1 - s q)^2: 0.969 for s = 0.85, and a pair is missed by all of four trees once in a
   million; sets with little in common part at once.
2. Groups. Sets that share nodes of the last level, directly or not. Most groups fit a task (a cell); they are small nodes of
   the join, and compared exhaustively.
3. A larger group is split into its nodes, if these have fewer pairs of sets than the group; a node that is too large for a
   task branches on, two branches a level with hash functions of its own, as long as that lowers the pairs. Its small nodes
   are compared exhaustively.
4. What can't be split so (sets that are all alike) is dealt into cells, which are linked within, then across by one set of
   each component, and only sets outside the largest component meet all others, cell by cell. This is exact.
5. Components over the links.

Comparing is exact: on whole sets, by length and overlap. Equal sets are one (128-bit keys; 64-bit shingles) and linked.

Defined results: null and empty texts have an empty set and are their own component; the component of rows without ids is
null; repeated rows are documents of their own, linked with each other; very long texts are held one at a time; other columns
are ignored; ids are of any type that has an order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import cut, discard, documents, text_hash
from .graph import components
from .near_duplicates import linked, links_within

K, NUM, DEN = 3, 85, 100
TREES, DEPTH, MORE = 4, 3, 4
CELL_SETS, CELL_SHINGLES = 1024, 1 << 19


def mixed(x: int | np.uint64) -> np.uint64:
    return textops.mixed(np.array([x], np.uint64))[0]


def minwise(name: np.uint64, branch: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The names of a node's children that sets (shingles from each start on) choose in a branch."""
    seeds = textops.mixed(np.array([2 * branch + 1, 2 * branch + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ name)
    token = np.minimum.reduceat((flat ^ seeds[0]) * (seeds[1] | np.uint64(1)), starts)
    return textops.mixed(token ^ seeds[0] ^ seeds[1])


def node_names(flat: np.ndarray, starts: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Names of the nodes of the last level that each set is in: a row for each set.

    Down to here the functions of a branch are the same for all nodes of a level, so all sets are hashed at once.
    """
    out = []
    for tree in range(trees):
        places, names = [mixed(tree + 1)], [np.zeros(len(starts), np.uint64)]
        for _ in range(depth):
            below = [(mixed(p + np.uint64(b)), textops.mixed(n ^ minwise(p, b, flat, starts))) for p, n in zip(places, names, strict=True) for b in range(2)]
            places, names = [p for p, _ in below], [n for _, n in below]
        out += [textops.mixed(n ^ p) for p, n in zip(places, names, strict=True)]
    return np.stack(out, 1)


def sketcher(k: int, trees: int, depth: int):
    """(doc_id, text, text_hash) -> each document's set: size, key and nodes."""

    def sketch(batches):
        for batch in batches:
            at = 0
            for run in textops.chunks(batch["text"].to_pylist()):
                sets = textops.shingle_sets(run, k)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets])
                names = node_names(np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])]), trees, depth) if full else np.zeros((0, 1), np.uint64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(sizes > 0, names.shape[1], 0))), pa.int32()), pa.array(names.ravel().view(np.int64)))
                rows = batch.slice(at, len(run))
                at += len(run)
                yield pa.record_batch([rows["doc_id"], rows["text_hash"], pa.array(sizes, pa.int32()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), lists], ["doc_id", "text_hash", "n", "key", "names"])

    return sketch


def shingler(k: int):
    """(text, id, label) -> key, n, id, label, shingles; of equal sets in a task, one."""

    def shingle(batches):
        seen: set[bytes] = set()
        for batch in batches:
            at = 0
            for run in textops.chunks(batch["text"].to_pylist()):
                keys, rows, kept = [], [], []
                for i, s in enumerate(textops.shingle_sets(run, k)):
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        rows.append(at + i)
                        kept.append(s.tobytes())
                at += len(run)
                some = pa.array(rows, pa.int64())
                yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([len(x) // 8 for x in kept], pa.int32()), batch["id"].take(some), batch["label"].take(some), pa.array(kept, pa.binary())], ["key", "n", "id", "label", "shingles"])

    return shingle


def compare(sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted distinct shingles), each compared with all it may be linked with."""
    m = len(sets)
    if m < 2:
        return []
    order = sorted(range(m), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    values, shingles = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    shingles = shingles.astype(np.int32)
    at = np.append(0, np.cumsum(sizes))
    own, group, found = np.zeros(len(values), np.uint8), np.arange(m), []
    for q in range(1, m):
        lo = int(np.searchsorted(sizes, -(-num * sizes[q] // den)))
        if lo >= q or (group[lo:q] == group[q]).all():
            continue
        mine = shingles[at[q] : at[q + 1]]
        own[mine] = 1
        overlap = np.add.reduceat(own[shingles[at[lo] : at[q]]], at[lo:q] - at[lo], dtype=np.int64)
        own[mine] = 0
        hit = lo + np.flatnonzero((den + num) * overlap >= num * (sizes[lo:q] + sizes[q]))
        for other in np.unique(group[hit]).tolist():
            if other != group[q]:
                found.append((order[q], order[int(hit[group[hit] == other][0])]))
                group[group == other] = group[q]
    return found


def brancher(batches):
    """Rows (node, key, shingles), sorted by node -> (node, child, key): each node's sets by the children they choose."""
    node, keys, sets = None, [], []

    def flush():
        if not sets:
            return
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        flat = np.concatenate(sets)
        for branch in range(2):
            child = textops.mixed(minwise(np.array([node], np.int64).view(np.uint64)[0], branch, flat, starts) ^ mixed(branch + 1)).view(np.int64)
            yield pa.record_batch([pa.array([node] * len(keys), pa.int64()), pa.array(child), pa.array(keys, pa.binary())], ["node", "child", "key"])

    for batch in batches:
        for name, key, s in zip(*(batch[c].to_pylist() for c in ("node", "key", "shingles")), strict=True):
            # a node's sets may come in runs, as each chooses for itself
            if name != node or sum(map(len, sets)) > CELL_SHINGLES:
                yield from flush()
                node, keys, sets = name, [], []
            keys.append(key)
            sets.append(np.frombuffer(s, np.uint64))
    yield from flush()


def split(entries: DataFrame, sets: DataFrame, more: int, cell_sets: int, cell_shingles: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(node, key) and (key, n, shingles) -> (task, key, shingles) of the small nodes, and (key, n, shingles, label) of those
    nodes that don't come apart; and the tables that hold both. A node that is too large for a task branches, up to `more` levels, while that saves pairs."""
    small, stuck, old = None, None, []
    join = lambda a, b: b if a is None else a.unionByName(b)
    for level in range(more + 1):
        rows = cut(entries.join(sets, "key"), "entries")
        old.append(rows)
        sizes = rows.groupBy("node").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
        fits = (F.col("sets") <= cell_sets) & (F.col("all") <= cell_shingles)
        small = join(small, rows.join(sizes.where(fits).where("sets > 1"), "node").select(F.hex("node").cast("binary").alias("task"), "key", "shingles"))
        large = sizes.where(~fits).select("node", "sets")
        if large.isEmpty():
            break
        if level == more:
            stuck = join(stuck, rows.join(large, "node").select("key", "n", "shingles", F.col("node").alias("label")))
            break
        large_rows = rows.join(large.select("node"), "node").repartition("node").sortWithinPartitions("node")
        children = cut(large_rows.select("node", "key", "shingles").mapInArrow(brancher, "node long, child long, key binary"), "children")
        pairs = children.groupBy("node", "child").agg(F.count("*").alias("c")).groupBy("node").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
        apart = pairs.join(large, "node").where(F.col("pairs") < F.col("sets").cast("double") * F.col("sets")).select("node")
        stuck = join(stuck, rows.join(large.join(apart, "node", "left_anti"), "node").select("key", "n", "shingles", F.col("node").alias("label")))
        old.append(children)
        entries = children.join(apart, "node").select(F.col("child").alias("node"), "key")
    return small, stuck, old


def near_copies(docs: DataFrame, k: int = K, trees: int = TREES, depth: int = DEPTH, more: int = MORE, cell_sets: int = CELL_SETS, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links), kept (whether that is the row's own)."""
    d = docs.select("doc_id", "text", text_hash().alias("text_hash"))
    kind = d.schema["doc_id"].dataType.simpleString()
    sketch = cut(d.mapInArrow(sketcher(k, trees, depth), f"doc_id {kind}, text_hash long, n int, key binary, names array<long>"), "sketch")
    ids = sketch.where("n > 0").select(F.xxhash64("key").alias("id"), "names")
    entries = ids.select("id", F.explode("names").alias("node"))
    shared = entries.groupBy("node").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("node", "a")
    grouped = components(entries.join(shared, "node").select("a", F.col("id").alias("b")))
    groups = grouped.select(F.col("node").alias("id"), "label")
    members = sketch.where("n > 0").select(F.xxhash64("key").alias("id"), "key", F.struct("text_hash", "doc_id").alias("row")).join(groups, "id")
    members = members.groupBy("key").agg(F.first("id").alias("id"), F.first("label").alias("label"), F.min("row").alias("row"))
    one = members.select("id", "label", F.col("row.text_hash").alias("text_hash"), F.col("row.doc_id").alias("own_id"))
    texts = d.join(one, "text_hash").where(F.col("doc_id").eqNullSafe(F.col("own_id"))).select("text", "id", "label")
    sets = cut(texts.mapInArrow(shingler(k), "key binary, n int, id long, label long, shingles binary"), "shingled")

    sizes = sets.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    fits = (F.col("sets") <= cell_sets) & (F.col("all") <= cell_shingles)
    tasks, old = sets.join(sizes.where(fits).where("sets > 1"), "label").select(F.hex("label").cast("binary").alias("task"), "key", "shingles"), [grouped, sets]
    large, found = sizes.where(~fits), []
    if not large.isEmpty():
        in_large = cut(sets.join(large.select("label"), "label"), "large-groups")
        held = in_large.select("id", "label").distinct().join(ids, "id").select("id", "label", F.explode("names").alias("node")).distinct()
        nodes = cut(held.groupBy("label", "node").agg(F.count("*").alias("c")).where("c > 1"), "nodes")
        # as pairs: a group is split where its nodes hold fewer than itself
        apart = nodes.groupBy("label").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs")).join(large, "label").where(F.col("pairs") < F.col("sets").cast("double") * F.col("sets")).select("label")
        entries = held.join(nodes.join(apart, "label").select("node"), "node").join(in_large.select("id", "key"), "id").select("node", "key")
        small, stuck, tables = split(entries, in_large.select("key", "n", "shingles"), more, cell_sets, cell_shingles)
        dense = in_large.join(apart, "label", "left_anti").select("key", "n", "shingles", "label")
        dense = dense if stuck is None else dense.unionByName(stuck)
        tasks = tasks.unionByName(small)
        names, links_ = links_within(dense.withColumn("label", F.hex("label").cast("binary")), cell_sets, cell_shingles, compare, NUM / DEN)
        found.append(names.select(F.col("key").alias("a"), F.col("label").alias("b")))
        old += [in_large, nodes, links_, *tables]
    every = compared = linked(tasks, compare)
    for f in found:
        every = every.unionByName(f)
    named = components(every)
    labels = named.withColumnRenamed("node", "key")

    full = sketch.where("n > 0").select("doc_id", "n", "key").join(labels, "key", "left").select("doc_id", "n", F.coalesce("label", "key").alias("component"))
    full = cut(full, "labelled")
    least = full.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    every = full.join(least, "component").select("doc_id", "n", "component_id").unionByName(sketch.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    out = cut(every.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-copies")
    discard(sketch, full, compared, named, *old)
    return out


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))


#: Sets of shingles as strings, pairs by their shared shingles, the smallest id reachable by links.
OP12_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS p FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 3], ' ') AS s FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a), least_ AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = w.doc_id
"""
