"""Mixing sources to target weights: a low-discrepancy source schedule (DataFrame functions only).

Slot i of the mixture is the point frac(i * golden ratio); the cumulative target weights map it to a source. The slots of
a source are ranked, and rank r takes block r of that source's shuffled word stream. The stream repeats its documents up to
`epochs` times; its first `target` words (rounded) are cut into as many blocks as the source has slots, equal but for one
word, so a source gives its target to half a word. Blocks are of about block_size() words; a source whose target is less
than three of these weighs as much as three in the schedule, so that it has a slot, and its blocks are smaller.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating; each target stops at `epochs` times what the
source has, and the rest is shared again by weight (water filling, in closed form over the sources ordered by the level
at which they are full).

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own; repeated rows are
documents of their own; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, ordered_offsets, same, text_hash

GOLDEN = (math.sqrt(5) - 1) / 2
STEP = 1 << 20


def point(i: Column) -> Column:
    """frac(i * golden ratio), with i split so that products stay small."""
    high = F.floor(i / STEP).cast("double") * math.fmod(STEP * GOLDEN, 1.0)
    low = (i % STEP).cast("double") * GOLDEN
    x = high - F.floor(high) + low - F.floor(low)
    return x - F.floor(x)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> tuple[DataFrame, int]:
    """(source, source_size) -> the same with source_no, target and the range lo to hi of the unit interval; number of slots."""
    n = len(weights)
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") % n) + 1).cast("int"))
    s = ordered_offsets(sizes, [F.asc_nulls_last("source")], {}, "sources").withColumnRenamed("row_no", "source_no")
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    all_weight = s.agg(F.sum("weight")).first()[0] or 1.0
    s = ordered_offsets(s, [F.asc("full_at"), F.asc("source_no")], {"cap_before": "cap", "weight_before": "weight"}, "levels")
    level = (F.lit(float(total)) - F.col("cap_before")) / (F.lit(float(all_weight)) - F.col("weight_before"))
    found = s.select("row_no", "full_at", level.alias("level")).where("level <= full_at * (1 + 1e-12)").agg(F.min_by("level", "row_no")).first()[0]
    fill = F.least("cap", F.col("weight") * F.lit(float(found if found is not None else 0.0)))
    s = s.select("source", "source_size", "source_no", fill.alias("target"))
    # gaps between the points of n slots are below 2.62 / n, so an interval of three slots has one
    words = block_size(total)
    s = s.withColumn("share", F.when(F.col("target") > 0, F.greatest("target", F.lit(3.0 * words))).otherwise(0.0))
    s = ordered_offsets(s, [F.asc("source_no")], {"lo": "share"}, "weights").drop("row_no")
    goal = s.agg(F.sum("share")).first()[0] or 0.0
    hi = (F.col("lo") + F.col("share")) / max(goal, 1.0)
    return s.select("source", "source_size", "source_no", "target", (F.col("lo") / max(goal, 1.0)).alias("lo"), F.when(hi > 1 - 1e-9, 2.0).otherwise(hi).alias("hi")), math.ceil(goal / words)


def schedule(sources: DataFrame, slots: int, chunk: int = 8192) -> DataFrame:
    """Slots 0 to slots - 1 -> (slot, source_no, rank): which source each slot draws from, and the how-manieth draw it is.

    Slots and sources meet in equal cells of the unit interval; the points fall evenly on those. Ranks are counted in
    two levels (chunks of slots, then within a chunk).
    """
    spark = sources.sparkSession
    cells = 1 << max(12, (4 * max(1, sources.count()) - 1).bit_length())
    at = sources.where("target > 0").select("source_no", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    s = spark.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    s = s.join(at, "cell").where("x >= lo and x < hi").select("slot", "source_no", F.floor(F.col("slot") / chunk).alias("chunk"))
    s = cut(s, "schedule")
    counts = s.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior"))
    inner = Window.partitionBy("source_no", "chunk").orderBy("slot")
    return s.withColumn("rn", F.row_number().over(inner)).join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("prior") + F.col("rn") - 1).cast("long").alias("rank"))


def block_size(total: int) -> int:
    """Words of a block, by the size of the corpus: about a million slots, between 16 and 4096 words each."""
    return max(16, min(4096, total >> 20))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixture: one row for each document with what is taken of it, and its plan.

    The plan has a row for each piece: slot (its place in the mixture), the document (row_no, doc_id), epoch, from_word and
    n_words.
    """
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    d = cut(docs.select("doc_id", "source", size.alias("size"), text_hash().alias("text_hash")), "sizes")
    s, slots = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    s = cut(s, "targets")
    slots = cut(schedule(s, slots), "slots")
    drawn = slots.groupBy("source_no").agg(F.count("*").alias("drawn"))
    s = cut(s.join(drawn, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))), "drawn")
    start = ordered_offsets(s.select("source_no", "source_size"), [F.asc("source_no")], {"first": "source_size"}, "firsts").select("source_no", "first")
    goal = F.when(F.col("drawn") > 0, F.round("target").cast("long")).otherwise(0)
    s = s.join(start, "source_no").withColumn("goal", goal).withColumns({"block": F.when(F.col("drawn") > 0, F.floor(F.col("goal") / F.col("drawn"))).otherwise(0), "longer": F.when(F.col("drawn") > 0, F.col("goal") % F.col("drawn")).otherwise(0)})
    s = s.select("source", "source_size", "source_no", "target", "goal", "block", "longer", "first")
    d = d.alias("d").join(s.alias("s"), same("d", "s", "source")).select("d.doc_id", "d.size", "d.text_hash", "s.source_no", "s.source_size", "s.target", "s.goal", "s.block", "s.longer", "s.first")
    order = [F.asc("source_no"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), F.asc("doc_id"), F.asc("text_hash")]
    d = cut(ordered_offsets(d, order, {"at": "size"}, "streams").withColumn("at", F.col("at") - F.col("first")), "documents")
    # the first `longer` blocks have a word more than the others
    longer = F.col("longer") * (F.col("block") + 1)
    rank_of = lambda x: F.when(x < longer, F.floor(x / (F.col("block") + 1))).otherwise(F.col("longer") + F.floor((x - longer) / F.greatest("block", F.lit(1))))
    first_of = lambda r: r * F.col("block") + F.least(r, "longer")
    p = d.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    p = p.withColumn("begin", F.col("at") + F.col("epoch") * F.col("source_size")).where(F.col("begin") < F.col("goal"))
    p = p.withColumn("end", F.least(F.col("begin") + F.col("size"), "goal"))
    p = p.select("row_no", "doc_id", "source_no", "epoch", "begin", "end", "block", "longer", F.explode(F.sequence(rank_of(F.col("begin")), rank_of(F.col("end") - 1))).alias("rank"))
    lo, hi = F.greatest("begin", first_of(F.col("rank"))), F.least("end", first_of(F.col("rank") + 1))
    plan = p.join(slots, ["source_no", "rank"]).select("slot", "row_no", "doc_id", "epoch", (lo - F.col("begin")).alias("from_word"), (hi - lo).alias("n_words"))
    taken = plan.groupBy("row_no").agg(F.sum("n_words").alias("taken"))
    out = d.join(taken, "row_no", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "row_no", "text_hash")
    return out, plan


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))[0].select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (the last, partial take counts from half of the document on).

    Null and empty texts have no words, so they aren't taken; repeated rows are taken as documents of their own; an empty
    table gives an empty result; all columns of docs are returned, whatever their names.
    """
    taken, _ = mix(docs)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")) + F.when((F.col("taken") % F.col("size")) * 2 >= F.col("size"), 1).otherwise(0)).otherwise(0)
    taken = taken.select("doc_id", "text_hash", copies.cast("int").alias("copies"))
    w = Window.partitionBy("doc_id", "text_hash").orderBy(F.desc("copies"))
    taken = taken.withColumn("nth", F.row_number().over(w))
    every = Window.partitionBy("tallyloom_id", "tallyloom_hash").orderBy("tallyloom_hash")
    d = docs.withColumns({"tallyloom_id": F.col("doc_id"), "tallyloom_hash": text_hash()}).withColumn("tallyloom_nth", F.row_number().over(every))
    on = F.col("tallyloom_id").eqNullSafe(F.col("t.doc_id")) & (F.col("tallyloom_hash") == F.col("t.text_hash")) & (F.col("tallyloom_nth") == F.col("t.nth"))
    out = d.alias("d").join(taken.where("copies > 0").alias("t"), on).select("d.*", F.explode(F.sequence(F.lit(1), F.col("t.copies"))).alias("tallyloom_copy"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
