"""Sharding: rendezvous hashing of stable record keys over weighted shards (DataFrame functions only).

A record goes to the shard whose score -weight / ln(u) is largest, u being a hash of key and shard mapped to (0, 1).
A new shard changes no other score, so it only takes rows into itself.

Defined results: a null key is a key of its own; a null text has no bytes and the checksum 0; equal keys share a shard
(that is the law), whatever their texts; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents

OVERHEAD = 16


def best_shard(key: Column, weights: list[float], seed: int = 0) -> Column:
    """struct(score, id) of the best of the shards 0 to len(weights) - 1."""
    shards = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.lit(i).alias("id")) for i, w in enumerate(weights)])

    def score(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, s["id"]), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-s["weight"] / F.ln(u)).alias("score"), s["id"].alias("id"))

    return F.array_max(F.transform(shards, score))


def shard(docs: DataFrame, weights: list[float], seed: int = 0, rows_per_bucket: int = 256) -> DataFrame:
    """Each row's shard, a slot without gaps within the shard, and the shard that it had if one more shard of weight 1 were there.

    Slots are numbered in two levels (buckets of a shard, then rows of a bucket), so no task holds a whole shard.
    """
    n, key = len(weights), F.col("doc_id").cast("string")
    buckets = max(32, -(-docs.count() // (n * rows_per_bucket)))
    t = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        best_shard(key, weights, seed).alias("best"),
        best_shard(key, [*weights, 1.0], seed)["id"].cast("int").alias("grown_shard"),
    )
    t = t.select("doc_id", "size", "text_crc32", F.col("best.id").cast("int").alias("shard"), "grown_shard")
    t = cut(t.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int")), "shards")
    offsets = t.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return t.withColumn("rn", F.row_number().over(inner)).join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rn") - 1).cast("long").alias("slot"), "grown_shard"
    )


def op9_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), [1.0] * 40)
