"""Embedding labeling functions: cosine against seeds, calibration, separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from . import sections


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def similarities(vectors: DataFrame, seeds: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, vec) x (target, seed_id, seed): a row for each vector and seed of its target; seeds are a small table."""
    v = vectors.withColumn("unit_vec", unit(F.col("vec")))
    s = seeds.withColumn("unit_seed", unit(F.col("seed")))
    return v.join(F.broadcast(s) if seeds.count() <= 10_000 else s, "target").select(key, "target", "seed_id", dot(F.col("unit_vec"), F.col("unit_seed")).alias("similarity"))


def vote(sims: DataFrame, threshold: float, key: str = "vec_id") -> DataFrame:
    """Best similarity over all vectors and seeds of a document: positive from the threshold on, else no vote."""
    t = sims.groupBy(key, "target").agg(F.max("similarity").alias("confidence"))
    return t.withColumn("vote", F.when(F.col("confidence") >= threshold, 1).otherwise(-1))


def calibrate(sims: DataFrame, lo: float = 0.65, hi: float = 0.85) -> DataFrame:
    """Threshold of each target: the tenth percentile of its positives' similarities, kept within bounds."""
    t = sims.groupBy("target").agg(F.percentile("similarity", 0.10).alias("p10"), F.count("*").alias("n"))
    return t.withColumns({"threshold": stats.clamp(F.col("p10"), lo, hi), "reason": stats.clamp_reason(F.col("p10"), lo, hi)})


def separation(own: DataFrame, other: DataFrame, least_gain: float = 0.15) -> DataFrame:
    """Median similarity of a target's own vectors against that of hard negatives."""
    a = own.groupBy("target").agg(F.median("similarity").alias("own"))
    b = other.groupBy("target").agg(F.median("similarity").alias("other"))
    return a.join(b, "target").withColumn("gain", F.col("own") - F.col("other")).withColumn("enough", F.col("gain") >= least_gain)


def section_rows(notes: DataFrame, names: list[str], least: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, text) -> key, section, text, text_key: the named sections of notes that are worth a vector, of `least` characters
    or more without the blanks around them."""
    found = F.array(*[F.struct(F.lit(n).alias("section"), sections.section(F.col("s"), n).alias("body")) for n in names])
    t = notes.select(key, sections.sections(F.col("text")).alias("s")).select(key, F.explode(found).alias("x"))
    t = t.select(key, "x.section", F.regexp_replace(F.col("x.body"), r"^\s+|\s+$", "").alias("text"))
    return t.where(F.char_length("text") >= least).withColumn("text_key", F.sha2(F.col("text"), 256))


def with_vectors(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of section_rows() with their vectors of a cache (text_key, vec), and the texts that it lacks, each once."""
    one = cache.dropDuplicates(["text_key"])
    return rows.join(one, "text_key"), rows.join(one, "text_key", "left_anti").select("text_key", "text").dropDuplicates(["text_key"])


def pooled(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, vec: the mean of the vectors of each key, element by element. Each element is summed up where it is before
    anything is shuffled. Vectors of a key are of one length."""
    t = vectors.where("vec is not null").select(*keys, F.posexplode("vec").alias("at", "x"))
    t = t.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("x"))
    return t.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select(*keys, "n", F.col("v.x").alias("vec"))
