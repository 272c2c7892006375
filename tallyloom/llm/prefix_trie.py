"""A trie over the prefixes of conversations, family first.

A conversation c belongs to the family of its base, c - c % 5, and is rebuilt from the first h turns of its base and its own
turns after its first h, where h = crc32(c in decimal) % 9. A node is a distinct sequence of the first d rebuilt turns.

1. Turns become two 64-bit hashes of role and text and a number of bytes; no text is shuffled.
2. Families. The conversations of a base are cogrouped with it and rebuilt, and the family's trie is built: a node's name is
   the xor of its turns' hashes, each mixed with its position, so all names of a conversation are one running xor.
3. Merging. Only the combined nodes of families are shuffled, and summed up by name. A node is owned by the family of its
   smallest member.
4. Subtrees. Each owned node goes back to its owner, which knows all its ancestors: a family sums what it owns below each of
   its nodes, and these sums meet once more by name. No step goes level by level over the whole trie.
5. The ids that end in a node are hashed in ascending order as they stream by.

A conversation of more than LONG turns is no part of a family's task: its turns are numbered over range partitions, cut into
pieces of PIECE turns, and its names and the sums below its nodes are made of those within pieces and over pieces. Others of
its family see its first turns only.

Defined results: null roles and texts are empty; turns go by `turn` (null first), equal ones by their hashes; repeated rows are
turns of their own; rows without a conv_id take no part; an empty table gives an empty result (no root); the length of texts
doesn't matter; other columns are ignored. One streaming task hashes the ids of a node, as SHA-256 can't be split: it holds a
batch of them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, ordered_offsets, parts
from .textops import mixed

FAMILY, HEADS = 5, 9
LONG, PIECE = 1 << 16, 1 << 12
EMPTY = hashlib.sha256(b"").hexdigest()
STEPS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def base_of(c: str) -> Column:
    return F.col(c) - F.col(c) % FAMILY


def head_of(c: Column) -> Column:
    return (F.crc32(c.cast("string")) % HEADS).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a, b (hashes of role and text), size (bytes of the text)."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.where("conv_id is not null")
    return t.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit("a"), role, text).alias("a"), F.xxhash64(F.lit("b"), role, text).alias("b"), F.octet_length(text).cast("long").alias("size"))


def at_position(h: np.ndarray, position: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of turns, mixed with their positions (from 0)."""
    return mixed(h.view(np.uint64) ^ ((position.astype(np.uint64) + np.uint64(1)) * STEPS[lane])).view(np.int64)


NODES = "base long, a long, b long, depth long, up_a long, up_b long, size long, n_convs long, least long, childless boolean, ends array<long>"


def ints(t: pa.Table, c: str) -> np.ndarray:
    return t[c].to_numpy().astype(np.int64)


def family(key, bases, others):
    """The trie of a family: a row for each of its nodes. Rows that aren't `whole` are the first turns of a conversation that
    is rebuilt elsewhere."""
    t = pa.concat_tables([bases, others.select(bases.column_names)])
    base = key[0].as_py()
    conv, none = ints(t, "conv_id"), t["turn"].is_null().to_numpy(zero_copy_only=False)
    turn = t["turn"].fill_null(0).to_numpy()
    order = np.lexsort((ints(t, "b"), ints(t, "a"), turn, ~none, conv))
    conv, a, b, size = conv[order], ints(t, "a")[order], ints(t, "b")[order], ints(t, "size")[order]
    whole = t["whole"].to_numpy(zero_copy_only=False)[order]
    ids = np.unique(conv)
    at = {int(c): np.arange(*np.searchsorted(conv, [c, c + 1])) for c in ids}
    first = at.get(base, np.zeros(0, np.int64))
    found: list[list[np.ndarray]] = [[] for _ in range(8)]
    for c, own in at.items():
        if not whole[own[0]]:
            continue
        h = zlib.crc32(str(c).encode()) % HEADS
        rows = np.concatenate((first[:h], own[h:]))
        n = len(rows)
        position = np.arange(n)
        names = [np.append(0, np.bitwise_xor.accumulate(at_position(x[rows], position, lane))) if n else np.zeros(1, np.int64) for lane, x in enumerate((a, b))]
        columns = (np.arange(n + 1), names[0], names[1], np.append(0, names[0][:-1]), np.append(0, names[1][:-1]), np.append(0, size[rows]), np.full(n + 1, c), np.arange(n + 1) == n)
        for all_, x in zip(found, columns, strict=True):
            all_.append(x)
    depth, a, b, up_a, up_b, size, conv, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    order = np.lexsort((conv, b, a, depth))
    depth, a, b, up_a, up_b, size, conv, last = (x[order] for x in (depth, a, b, up_a, up_b, size, conv, last))
    new = np.ones(len(depth), bool)
    new[1:] = (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at_ = np.flatnonzero(new)
    n = np.diff(np.append(at_, len(depth)))
    ended = np.cumsum(np.append(0, last.astype(np.int64)))
    ends = ended[at_ + n] - ended[at_]
    ended = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(ends)), pa.int32()), pa.array(conv[last.astype(bool)], pa.int64()))
    out = [np.full(len(at_), base), a[at_], b[at_], depth[at_], up_a[at_], up_b[at_], size[at_], n, conv[at_]]
    return pa.table([*(pa.array(x, pa.int64()) for x in out), pa.array(ends == n), ended], [c.split()[0] for c in NODES.split(", ")])


SUMS = "a long, b long, depth long, n_children long, n_leaves long, saved_tokens long"


def below(key, nodes, owned):
    """What a family owns below each of its nodes."""
    names = np.column_stack([np.concatenate((ints(nodes, c), ints(owned, c), ints(nodes, up) - (c == "depth"))) for c, up in (("depth", "depth"), ("a", "up_a"), ("b", "up_b"))])
    n, m = nodes.num_rows, owned.num_rows
    _, where = np.unique(names, axis=0, return_inverse=True)
    where = where.ravel()
    place = np.full(where.max(initial=0) + 1, -1)
    place[where[:n]] = np.arange(n)
    mine, up = place[where[n : n + m]], place[where[n + m :]]
    sums = np.zeros((n, 3), np.int64)
    sums[mine, 1] = owned["childless"].to_numpy(zero_copy_only=False)
    sums[mine, 2] = (ints(owned, "n_convs") - 1) * ints(owned, "size")
    depth = ints(nodes, "depth")
    np.add.at(sums[:, 0], up[mine[depth[mine] > 0]], 1)
    order = np.argsort(depth, kind="stable")
    starts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
    for d in range(len(starts) - 1, 0, -1):
        level = order[starts[d - 1] : starts[d]]
        np.add.at(sums[:, 1:], up[level], sums[level, 1:])
    some = np.flatnonzero(sums.any(1))
    return pa.table([*(pa.array(ints(nodes, c)[some], pa.int64()) for c in ("a", "b", "depth")), *(pa.array(sums[some, i], pa.int64()) for i in range(3))], [c.split()[0] for c in SUMS.split(", ")])


def digests(batches):
    """Rows (a, b, depth, conv_id) in order -> the hash of each node's ids."""
    node, state = None, None
    for batch in batches:
        out: list[tuple] = []
        a, b, depth, conv = (batch[c].to_numpy() for c in ("a", "b", "depth", "conv_id"))
        starts = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1])) if len(a) else np.zeros(0, bool)
        at = np.append(np.flatnonzero(starts), len(a))
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            here = (int(a[x]), int(b[x]), int(depth[x]))
            ids = ",".join(map(str, conv[x:y].tolist()))
            if here == node:
                state.update(b"," + ids.encode())
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = here, hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["a", "b", "depth", "ends_sha256"])
    if node is not None:
        yield pa.record_batch([pa.array([x], k) for x, k in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["a", "b", "depth", "ends_sha256"])


def placed(batches):
    """Adds the hashes of turns mixed with their positions."""
    for batch in batches:
        position = batch["position"].to_numpy()
        mine = [pa.array(at_position(batch[c].to_numpy(), position, lane)) for lane, c in enumerate(("a", "b"))]
        yield pa.record_batch([*(batch[c] for c in ("conv_id", "position", "size")), *mine], ["conv_id", "position", "size", "m_a", "m_b"])


def pieces(df: DataFrame, sums: dict[str, Column], over, forward: bool) -> DataFrame:
    """Running aggregates (`over`) of the columns of sums, by conversation, forward or backward by position: within pieces of
    PIECE turns, and (`all_`) over a conversation's pieces before."""
    df = df.withColumn("piece", F.floor(F.col("position") / PIECE))
    piece, order = (F.col(c).asc() if forward else F.col(c).desc() for c in ("piece", "position"))
    totals = df.groupBy("conv_id", "piece").agg(*[over(c).alias(f"all_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "piece", *[F.coalesce(over(F.col(f"all_{k}")).over(earlier), F.lit(0)).alias(f"all_{k}") for k in sums])
    within = Window.partitionBy("conv_id", "piece").orderBy(order)
    return df.select("*", *[over(c).over(within).alias(k) for k, c in sums.items()]).join(totals, ["conv_id", "piece"])


def long_paths(t: DataFrame, counts: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of the conversations of more than `long` turns, as NODES (base is the conversation), and these conversations'
    first turns (as turns())."""
    many = counts.where(F.col("n") > long).select("conv_id", "n")
    numbered = ordered_offsets(t.join(many.select("conv_id"), "conv_id"), [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")], {}, "long-turns")
    numbered = numbered.join(numbered.groupBy("conv_id").agg(F.min("row_no").alias("first")), "conv_id").withColumn("position", F.col("row_no") - F.col("first"))
    numbered = cut(numbered.select("conv_id", "turn", "a", "b", "size", "position"), "numbered")
    heads = numbered.where(F.col("position") < HEADS - 1)
    own = many.select("conv_id", "n", base_of("conv_id").alias("base"), head_of(F.col("conv_id")).alias("h"))
    own = own.join(counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    bases = t.join(own.select(F.col("base").alias("conv_id")).distinct(), "conv_id").join(many.select("conv_id"), "conv_id", "left_anti")
    nth = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")  # of at most `long` turns
    bases = bases.withColumn("position", F.row_number().over(nth).cast("long") - 1).where(F.col("position") < HEADS - 1)
    given = heads.unionByName(bases.select(*heads.columns)).withColumnRenamed("conv_id", "base")
    path = given.join(own.select("conv_id", "base", "taken"), "base").where(F.col("position") < F.col("taken")).select("conv_id", "position", "size", "a", "b")
    rest = numbered.join(own.select("conv_id", "h", "taken"), "conv_id").where(F.col("position") >= F.col("h"))
    path = path.unionByName(rest.select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "size", "a", "b"))
    path = path.mapInArrow(placed, "conv_id long, position long, size long, m_a long, m_b long")
    path = pieces(path, {"x_a": F.col("m_a"), "x_b": F.col("m_b")}, F.bit_xor, forward=True)
    length = own.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    a, b = F.col("x_a").bitwiseXOR(F.col("all_x_a")), F.col("x_b").bitwiseXOR(F.col("all_x_b"))
    path = path.select("conv_id", a.alias("a"), b.alias("b"), (F.col("position") + 1).alias("depth"), a.bitwiseXOR(F.col("m_a")).alias("up_a"), b.bitwiseXOR(F.col("m_b")).alias("up_b"), "size")
    root = many.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "depth", "up_a", "up_b", "size")])
    last = F.col("depth") == F.col("length")
    path = path.unionByName(root).join(length, "conv_id")
    ends = F.when(last, F.array("conv_id")).otherwise(F.array().cast("array<long>"))
    nodes = path.select(F.col("conv_id").alias("base"), "a", "b", "depth", "up_a", "up_b", "size", F.lit(1).cast("long").alias("n_convs"), F.col("conv_id").alias("least"), last.alias("childless"), ends.alias("ends"))
    return nodes, heads.drop("position")


def long_sums(paths: DataFrame, merged: DataFrame) -> DataFrame:
    """What long conversations own below each of their nodes, as SUMS: sums over the nodes from there to the end."""
    own = merged.select("a", "b", "depth", "n_convs", "size", "childless", F.col("least").alias("owner"))
    path = paths.select(F.col("base").alias("conv_id"), "a", "b", "depth", "up_a", "up_b").join(own, ["a", "b", "depth"])
    mine = F.col("owner") == F.col("conv_id")
    path = path.withColumns({"position": F.col("depth"), "leaf": F.when(mine & F.col("childless"), 1).otherwise(0).cast("long"), "saves": F.when(mine, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).cast("long")})
    sums = pieces(path, {"leaves": F.col("leaf"), "saved": F.col("saves")}, F.sum, forward=False)
    none = F.lit(0).cast("long")
    sums = sums.select("a", "b", "depth", none.alias("n_children"), (F.col("leaves") + F.col("all_leaves")).alias("n_leaves"), (F.col("saved") + F.col("all_saved")).alias("saved_tokens"))
    children = path.where(mine & (F.col("depth") > 0)).select(F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"))
    return sums.unionByName(children)


def prefix_trie(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, turn, role, text -> a row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    t = cut(turns(conversations), "turns")
    counts = cut(t.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    many = counts.where(F.col("n") > long)
    whole, paths = F.lit(True).alias("whole"), None
    rows = t.select("*", whole)
    if not many.isEmpty():
        nodes, heads = long_paths(t, counts, long)
        paths = cut(nodes, "long-nodes")
        rows = rows.join(many.select("conv_id"), "conv_id", "left_anti").unionByName(heads.select("*", F.lit(False).alias("whole")))
    rows = rows.withColumn("base", base_of("conv_id"))
    bases, others = rows.where("conv_id = base").groupBy("base"), rows.where("conv_id <> base").select(*[F.col(c).alias(c) for c in rows.columns]).groupBy("base")
    families = cut(bases.cogroup(others).applyInArrow(family, NODES), "family-nodes")
    nodes = families if paths is None else families.unionByName(paths)
    merged = nodes.groupBy("a", "b", "depth").agg(F.sum("n_convs").alias("n_convs"), F.min("least").alias("least"), F.bool_and("childless").alias("childless"), F.first("size").alias("size"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
    merged = cut(merged, "nodes")
    owned = merged if paths is None else merged.join(many.select(F.col("conv_id").alias("least")), "least", "left_anti")
    owned = owned.select(base_of("least").alias("base"), "a", "b", "depth", "n_convs", "size", "childless")
    sums = families.select("base", "a", "b", "depth", "up_a", "up_b").groupBy("base").cogroup(owned.groupBy("base")).applyInArrow(below, SUMS)
    sums = sums if paths is None else sums.unionByName(long_sums(paths, merged))
    sums = sums.groupBy("a", "b", "depth").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")])
    ends = nodes.select("a", "b", "depth", F.explode("ends").alias("conv_id")).repartition(parts(spark), "a", "b", "depth").sortWithinPartitions("a", "b", "depth", "conv_id")
    ends = ends.mapInArrow(digests, "a long, b long, depth long, ends_sha256 string")
    up = merged.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    out = merged.join(sums, ["a", "b", "depth"]).join(ends, ["a", "b", "depth"], "left").join(up, ["up_a", "up_b", "depth"], "left")
    out = out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    out = cut(out, "trie")
    discard(t, counts, families, paths, merged)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Rebuilt conversations as lists of turns, nodes as their prefixes, subtrees by equal prefixes.
OP13_SQL = """
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS l FROM t GROUP BY conv_id),
heads AS (SELECT conv_id, l, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
lambda x, y: list_reduce([xor(x, y), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295) % 9 AS h FROM own),
built AS (SELECT o.conv_id, list_concat(coalesce(b.l[1 : o.h], []), o.l[o.h + 1 :]) AS l FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
paths AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS depth, l FROM built),
named AS (SELECT conv_id, depth, len(l) AS n, l[1 : depth] AS name, CASE WHEN depth = 0 THEN 0 ELSE strlen(l[depth].x) END AS size FROM paths),
nodes AS (SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, bool_and(depth = n) AS leaf,
sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n), '')) AS ends_sha256 FROM named GROUP BY name, depth),
under AS (SELECT u.name, u.depth, count(*) FILTER (WHERE v.depth = u.depth + 1) AS n_children, count(*) FILTER (WHERE v.leaf) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved
FROM nodes u JOIN named m ON m.conv_id = u.conv_id AND m.depth = u.depth JOIN nodes v ON v.depth >= u.depth AND v.name[1 : u.depth] = u.name GROUP BY u.name, u.depth)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN under USING (name, depth) LEFT JOIN nodes p ON p.depth = x.depth - 1 AND p.name = x.name[1 : x.depth - 1]
"""
