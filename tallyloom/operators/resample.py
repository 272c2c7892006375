"""Bootstrap confidence intervals: replicate multiplicities of documents, then weighted contingency tables.

Documents whose labels are all alike are interchangeable, so n draws of n documents are a multinomial draw over the joint
label patterns: the replicates are as large as the patterns, whatever the number of documents, and no document is left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import agreement, longform


def draw(seed: int, n: int):
    """A portable draw: md5 of seed, replicate and draw, modulo n."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 12), 16, 10).cast("long") % n


def multiplicities(spark, reps: int, n: int, seed: int) -> DataFrame:
    """rep, row_no, w: how often each of n rows is drawn in each replicate. Only drawn rows appear."""
    t = spark.range(reps * n).select((F.col("id") / n).cast("long").alias("rep"), (F.col("id") % n).alias("draw"))
    return t.select("rep", draw(seed, n).alias("row_no")).groupBy("rep", "row_no").agg(F.count("*").alias("w"))


def label_patterns(pairs: DataFrame) -> DataFrame:
    """pattern_no (from 0), cells (the field, pair, left, right of a document), n documents that have them.

    row_no is any key of documents. The patterns are bounded by the labels, so one task numbers them.
    """
    d = pairs.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("field", "pair", "left", "right"))).alias("cells"))
    p = d.groupBy("cells").agg(F.count("*").alias("n"))
    return p.select((F.row_number().over(Window.orderBy("cells")) - 1).alias("pattern_no"), "cells", "n")


def pattern_draws(patterns: DataFrame, reps: int, seed: int) -> DataFrame:
    """rep, pattern_no, w: how often documents of each pattern are drawn when as many are drawn as there are."""

    def draw_one(t: pa.Table) -> pa.Table:
        t = t.sort_by("pattern_no")
        n = t["n"].to_numpy()
        w = np.random.default_rng([seed, t["rep"][0].as_py()]).multinomial(int(n.sum()), n / n.sum())
        return pa.table({"rep": t["rep"], "pattern_no": t["pattern_no"], "w": pa.array(w, pa.int64())})

    t = patterns.sparkSession.range(reps).withColumnRenamed("id", "rep").crossJoin(patterns.select(F.col("pattern_no").cast("long").alias("pattern_no"), "n"))
    return t.groupBy("rep").applyInArrow(draw_one, "rep long, pattern_no long, w long").where("w > 0")


def kappa_replicates(patterns: DataFrame, reps: int, seed: int) -> DataFrame:
    """Kappa of each replicate from (row_no, field, pair, left, right): one draw of documents for all fields and pairs."""
    p = label_patterns(patterns)
    keys = ["rep", "field", "pair"]
    t = pattern_draws(p, reps, seed).join(p.select("pattern_no", F.explode("cells").alias("x")), "pattern_no").select("rep", "w", "x.*")
    return agreement.kappa(agreement.contingency(t, keys, F.col("w")), keys)


def paired_models(wide: DataFrame, reps: int, seed: int, least: int = 10) -> DataFrame:
    """Replicates of the effect of model size: (row_no, model, field, A, B, C) -> rep, filter, field, statistic, value.

    One draw of documents serves both models, all fields and raters. The fixed filter keeps the fields that have `least`
    positives in both models over all documents, the dynamic one those that have them in the replicate. Statistics: each
    field's delta (median over pairs of 100 (full - small) kappa; field is set), and over the kept fields the median and the
    mean of the deltas, the share of negative ones, and 100 times the difference of the models' median kappas.
    """
    d = wide.groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("model", "field", "A", "B", "C"))).alias("cells"))
    p = d.groupBy("cells").agg(F.count("*").alias("n"))
    p = p.select((F.row_number().over(Window.orderBy("cells")) - 1).alias("pattern_no"), "cells", "n")  # bounded by the labels
    whole = p.select(F.lit(-1).cast("long").alias("rep"), F.col("pattern_no").cast("long").alias("pattern_no"), F.col("n").alias("w"))
    return paired_statistics(pattern_draws(p, reps, seed).unionByName(whole).join(p.select("pattern_no", F.explode("cells").alias("x")), "pattern_no").select("rep", "w", "x.*"), least)


def paired_statistics(t: DataFrame, least: int) -> DataFrame:
    """The statistics of paired_models() from (rep, model, field, A, B, C, w); rep -1 are all documents."""
    keys = ["rep", "model", "field", "pair"]
    k = agreement.kappa(agreement.contingency(longform.pairs(t, keep=("rep", "model", "field", "w")), keys, F.col("w")), keys)
    yes = sum(((F.col(r) == "yes").cast("int") for r in longform.RATERS), F.lit(0))
    often = t.groupBy("rep", "field", "model").agg(F.sum(yes * F.col("w")).alias("n")).groupBy("rep", "field").agg(F.min("n").alias("n")).where(F.col("n") >= least)
    fixed = often.where("rep = -1").select("field")
    k = k.where("rep >= 0")
    both = k.join(fixed, "field", "left_semi").withColumn("filter", F.lit("fixed")).unionByName(k.join(often, ["rep", "field"], "left_semi").withColumn("filter", F.lit("dynamic")))
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("kappa")))
    deltas = both.groupBy("rep", "filter", "field", "pair").agg((100 * (of("full") - of("small"))).alias("d")).groupBy("rep", "filter", "field").agg(F.median("d").alias("value"))
    over = deltas.groupBy("rep", "filter").agg(F.median("value").alias("median_delta"), F.avg("value").alias("mean_delta"), F.avg((F.col("value") < 0).cast("double")).alias("negative_share"))
    pooled = both.groupBy("rep", "filter").agg((100 * (F.median(F.when(F.col("model") == "full", F.col("kappa"))) - F.median(F.when(F.col("model") == "small", F.col("kappa"))))).alias("pooled_delta"))
    names = ["median_delta", "mean_delta", "negative_share", "pooled_delta"]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), F.col(n).alias("value")) for n in names]))
    wholes = over.join(pooled, ["rep", "filter"]).select("rep", "filter", F.lit(None).cast("string").alias("field"), rows.alias("x")).select("rep", "filter", "field", "x.statistic", "x.value")
    return wholes.unionByName(deltas.select("rep", "filter", "field", F.lit("delta").alias("statistic"), "value"))


#: Fixed value: 2^32 times the probabilities that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = tuple(math.ceil(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12))


def document_weights(keys: list, first: int, seed: int) -> np.ndarray:
    """How often each document counts in replicates first to first + 3 (first is a multiple of 4): Poisson numbers of mean 1,
    each from 8 digits of the md5 of seed, first / 4 and the document's key."""
    digits = b"".join(hashlib.md5(f"{seed}|{first // 4}|{k}".encode()).digest() for k in keys)
    return np.searchsorted(np.array(POISSON), np.frombuffer(digits, ">u4").astype(np.int64), "right").reshape(-1, 4)


def weighted_cells(t: DataFrame, columns: list[str], reps: int, seed: int) -> DataFrame:
    """(row_no, columns) -> rep, columns, w: how often documents with these labels count in each replicate.

    A document's weights depend on nothing but its key, so every row draws them where it is: no document is shuffled, and a
    task gives a vector of replicates for each different row of labels that it has met.
    """

    def add(batches):
        cells, sums = {}, []
        for batch in batches:
            d = batch["row_no"].dictionary_encode()
            documents = d.indices.to_numpy()
            rows = list(zip(*(batch[c].to_pylist() for c in columns), strict=True))
            code = np.array([cells.setdefault(r, len(cells)) for r in rows], np.int64)
            sums += [np.zeros(reps, np.int64) for _ in range(len(cells) - len(sums))]
            some, place = np.unique(code, return_inverse=True)
            keys = d.dictionary.to_pylist()
            for first in range(0, reps, 4):
                w = document_weights(keys, first, seed)[documents]
                for k in range(min(4, reps - first)):
                    for c, n in zip(some.tolist(), np.bincount(place, w[:, k], len(some)).astype(np.int64).tolist(), strict=True):
                        sums[c][first + k] += n
        yield pa.record_batch([*(pa.array([r[i] for r in cells], pa.string()) for i in range(len(columns))), pa.array([x.tolist() for x in sums], pa.list_(pa.int64()))], [*columns, "weights"])

    schema = ", ".join(f"{c} string" for c in columns) + ", weights array<long>"
    t = t.where("row_no is not null").select("row_no", *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(add, schema)
    return t.select(*columns, F.posexplode("weights").alias("rep", "w")).groupBy(F.col("rep").cast("long").alias("rep"), *columns).agg(F.sum("w").alias("w")).where("w > 0")


def weighted_kappas(pairs: DataFrame, reps: int, seed: int) -> DataFrame:
    """Kappa of each replicate from (row_no, field, pair, left, right), as kappa_replicates(), but with Poisson weights of
    documents in place of a fixed number of draws: of use where documents have too many joint patterns to be gathered."""
    keys = ["rep", "field", "pair"]
    t = weighted_cells(pairs, ["field", "pair", "left", "right"], reps, seed)
    return agreement.kappa(agreement.contingency(t, keys, F.col("w")), keys)


def weighted_models(wide: DataFrame, reps: int, seed: int, least: int = 10) -> DataFrame:
    """paired_models() with Poisson weights of documents: a document's weight is the same in both models."""
    columns = ["model", "field", "A", "B", "C"]
    whole = wide.groupBy(*columns).agg(F.count("*").alias("w")).select(F.lit(-1).cast("long").alias("rep"), *columns, "w")
    return paired_statistics(weighted_cells(wide, columns, reps, seed).unionByName(whole), least)


def interval(t: DataFrame, keys: list[str], value: str = "value", lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over finite values; null if there are none."""
    v = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    g = t.groupBy(*keys) if keys else t.groupBy()
    return g.agg(F.percentile(v, lo).alias("low"), F.percentile(v, hi).alias("high"), F.count(v).alias("n_finite"))


def median_replicates(values: DataFrame, reps: int, seed: int) -> DataFrame:
    """Medians of resampled values (row_no, value): a small table, at most some hundred rows."""
    n = values.count()
    w = multiplicities(values.sparkSession, reps, n, seed)
    return w.join(values, "row_no").select("rep", F.explode(F.array_repeat("value", F.col("w").cast("int"))).alias("value")).groupBy("rep").agg(F.median("value").alias("value"))
