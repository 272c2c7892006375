"""Exact dedup by deterministic block naming.

Texts (runs of blanks made one space) are cut into blocks of BLOCK bytes. Equal blocks get equal integer names: blocks are
sorted (range-partitioned by hash and row, then ordered by hash and content), and each run of equal content is numbered.
Then adjacent names are paired, and pairs are named in the same way, level by level, until each document has one name.
With the number of blocks this name is the text's identity, free of collisions: content is compared, not only hashes.

A block that fills several sorted partitions gets one name: the runs at the ends of partitions are matched (two rows a
partition reach the driver, and contents only where hashes at an end are equal).

Defined results: a null text counts as empty; repeated rows are documents of their own and fall into one group; null ids
come last when the row that stays is chosen (then keep_id is null only if the group has no other); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, cut, documents, parts

BLOCK = 1024
NAMED = "row_id long, pos int, own boolean, range_id int, run long, h long, content binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def number_runs(batches):
    """Sorted (h, content, row_id, pos) -> the number of its run in this partition for each row; then the end runs' contents."""
    from pyspark import TaskContext

    me = TaskContext.get().partitionId()
    run, last_h, last = -1, None, None
    ends: dict[int, tuple[int, bytes]] = {}  # runs with the partition's first or latest hash
    first_h = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        h, content = b["h"], b["content"]
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.or_(pc.not_equal(h[1:], h[:-1]), pc.not_equal(content[1:], content[:-1])).to_numpy(zero_copy_only=False)
        new[0] = not (h[0].as_py() == last_h and content[0].as_py() == last)
        runs = run + np.cumsum(new)
        hs = h.to_numpy()
        first_h = int(hs[0]) if first_h is None else first_h
        ends = {r: x for r, x in ends.items() if x[0] in (first_h, int(hs[-1]))}
        for i in np.flatnonzero(new & ((hs == first_h) | (hs == hs[-1]))).tolist():
            ends[int(runs[i])] = (int(hs[i]), content[i].as_py())
        run, last_h, last = int(runs[-1]), int(hs[-1]), content[n - 1].as_py()
        yield pa.record_batch([b["row_id"], b["pos"], pa.array(np.ones(n, bool)), pa.array(np.full(n, me, np.int32)), pa.array(runs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], ["row_id", "pos", "own", "range_id", "run", "h", "content"])
    ends = {r: x for r, x in ends.items() if x[0] in (first_h, last_h)}
    n = len(ends)
    yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool)), pa.array(np.full(n, me, np.int32)), pa.array(list(ends), pa.int64()), pa.array([x[0] for x in ends.values()], pa.int64()), pa.array([x[1] for x in ends.values()], pa.binary())], ["row_id", "pos", "own", "range_id", "run", "h", "content"])


def name(blocks: DataFrame, level: str) -> DataFrame:
    """(row_id, pos, content) -> (row_id, pos, name): equal contents, equal names."""
    spark = blocks.sparkSession
    t = blocks.select("row_id", "pos", "content", F.xxhash64("content").alias("h"))
    t = t.repartitionByRange(parts(spark), "h", "row_id").sortWithinPartitions("h", "content")
    t = cut(t.select("h", "content", "row_id", "pos").mapInArrow(number_runs, NAMED), level)
    ends = t.where("not own")
    many = [r.h for r in ends.groupBy("h").agg(F.count_distinct("range_id").alias("n")).where("n > 1").select("h").collect()]
    names = (F.shiftleft(F.col("range_id").cast("long"), 40) + F.col("run")).alias("name")
    own = t.where("own").select("row_id", "pos", "range_id", "run")
    first: dict[tuple[int, bytes], int] = {}
    moved = [(-1, -1, -1)]  # never empty: the plan is the same whether or not a run crosses a border
    for r in sorted(ends.where(F.col("h").isin(many)).collect() if many else [], key=lambda r: (r.range_id, r.run)):
        got = first.setdefault((r.h, bytes(r.content)), (r.range_id << 40) + r.run)
        moved.append((r.range_id, r.run, got))
    moved_df = F.broadcast(spark.createDataFrame(moved, "range_id int, run long, moved long"))  # a few rows a partition
    return own.join(moved_df, ["range_id", "run"], "left").select("row_id", "pos", F.coalesce("moved", names).alias("name"))


def pair(a: str, b: str) -> Column:
    return F.concat(*[F.unhex(F.lpad(F.hex(F.col(c)), 16, "0")) for c in (a, b)])


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, text_sha256, n_blocks, name: equal (n_blocks, name) exactly for equal normalised texts."""
    d = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", normalised(F.col("text")).alias("t"))
    n = F.greatest(F.ceil(F.octet_length("t") / block), F.lit(1)).cast("int")
    d = d.select("row_id", "doc_id", n.alias("n"), F.sha2(F.col("t").cast("binary"), 256).alias("sha"), F.col("t").cast("binary").alias("t"))
    pieces = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("t"), i * block + 1, F.lit(block)))
    d = d.select("row_id", "doc_id", "n", "sha", pieces.alias("pieces"))
    b = cut(d.select("row_id", F.posexplode("pieces").alias("pos", "content"), F.struct("doc_id", "n", "sha").alias("x")).select("row_id", "pos", "content", F.when(F.col("pos") == 0, F.col("x")).alias("doc")), "blocks")
    heads = b.where("pos = 0").select("row_id", "doc.doc_id", "doc.n", F.col("doc.sha").alias("text_sha256"))
    names, done, level = name(b, "names-0"), [], 0
    longest = heads.agg(F.max("n")).first()[0] or 1
    while True:
        w = 1 << level  # blocks under a name
        if w >= longest:
            done.append(names.select("row_id", "name"))
            break
        mates = names.groupBy("row_id", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        mates = cut(mates.withColumn("last", F.col("b") == -1), f"pairs-{level}")
        # a document whose only name is unpaired is done
        single = mates.where("last and pos = 0")
        done.append(single.select("row_id", F.col("a").alias("name")))
        names = name(mates.where("not (last and pos = 0)").select("row_id", "pos", pair("a", "b").alias("content")), f"names-{level + 1}")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return heads.join(out, "row_id").select("doc_id", "text_sha256", F.col("n").alias("n_blocks"), "name")


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; of repeated rows with the id that stays, one is kept."""
    t = cut(identities(docs, block), "identities")
    groups = cut(t.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    # numbered before the join: a window on top of it would keep Spark from splitting the join's large groups
    nth = F.row_number().over(Window.partitionBy("doc_id", "name", "n_blocks").orderBy("text_sha256"))
    t = t.withColumn("nth", nth).join(groups, ["n_blocks", "name"])
    return t.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op1_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


OP1_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256 FROM t JOIN g ON t.n = g.n
"""
