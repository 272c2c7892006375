"""Labeling-function votes(doc_id, lf_name, target_field, target_value, vote) and their fusion. 1 for, 0 against, -1 none."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as texts
from .cohort import match_patterns

TARGET = ["target_field", "target_value"]
#: Two labeling functions over codes, as examples of the pattern table (a dot: the whole code).
CODE_PATTERNS = [
    ("icd_aki_primary", "aki_present", "yes", "any", 10, "N17"), ("icd_aki_primary", "aki_present", "yes", "any", 9, "584"),
    ("icd_hf_admission", "admission_reason_tags", "cardiac_hf", "primary_only", 10, "I50"), ("icd_hf_admission", "admission_reason_tags", "cardiac_hf", "primary_only", 10, "I11.0"),
    ("icd_hf_admission", "admission_reason_tags", "cardiac_hf", "primary_only", 10, "I13.0"), ("icd_hf_admission", "admission_reason_tags", "cardiac_hf", "primary_only", 10, "I13.2"),
    ("icd_hf_admission", "admission_reason_tags", "cardiac_hf", "primary_only", 9, "428"),
]
PATTERN_SCHEMA = "lf_name string, target_field string, target_value string, match_position string, version int, pattern string"


def registry(targets: DataFrame) -> DataFrame:
    """The labeling functions; fails on a name that is there twice."""
    twice = [r.lf_name for r in targets.groupBy("lf_name").count().where("count > 1").limit(10).collect()]
    if twice:
        raise ValueError(f"labeling functions with the same name: {twice}")
    return targets


class Catalogue:
    """Labeling functions of a user, by name: each makes a vote column (1, 0 or -1; null counts as -1) of the documents'
    columns, out of column functions or a registered Python or pandas UDF."""

    def __init__(self):
        self.functions: dict[str, tuple[str, str | None, Callable[[], Column]]] = {}

    def register(self, name: str, target_field: str, target_value: str | None = None):
        """A decorator; a name that is there already is refused."""

        def add(make: Callable[[], Column]):
            if name in self.functions:
                raise ValueError(f"a labeling function with the name {name!r} is registered already")
            self.functions[name] = (target_field, target_value, make)
            return make

        return add

    def for_field(self, target_field: str) -> list[str]:
        return [name for name, (f, *_) in self.functions.items() if f == target_field]

    def votes(self, documents: DataFrame, names: list[str] | None = None, key: str = "doc_id") -> DataFrame:
        """The vote table of all functions, or of those named: one pass over the documents, without a shuffle."""
        unknown = [n for n in names or [] if n not in self.functions]
        if unknown:
            raise KeyError(f"no labeling functions with the names {unknown}")
        cast = [F.struct(F.lit(n).alias("lf_name"), F.lit(f).alias("target_field"), F.lit(v).cast("string").alias("target_value"), F.coalesce(make().cast("int"), F.lit(-1)).alias("vote")) for n, (f, v, make) in self.functions.items() if names is None or n in names]
        if not cast:
            raise ValueError("no labeling functions")
        return documents.select(key, F.explode(F.array(*cast)).alias("x")).select(key, "x.*")


def code_votes(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, code, version, is_primary, ord) -> a vote of each function for each document: positive or none.

    primary_only looks at the primary code, or at the first where there is none; any at all codes.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    c = codes.withColumn("head", F.when(F.max("is_primary").over(w), F.col("is_primary")).otherwise(F.col("ord") == F.min("ord").over(w)))
    hit = match_patterns(c, patterns).where((F.col("match_position") == "any") | F.col("head")).groupBy("doc_id", "lf_name").agg(F.min("code").alias("evidence"))
    every = codes.select("doc_id").distinct().crossJoin(F.broadcast(patterns.select("lf_name", *TARGET).distinct()))  # x the few functions: the vote matrix
    return every.join(hit, ["doc_id", "lf_name"], "left").select("doc_id", "lf_name", *TARGET, F.when(F.col("evidence").isNotNull(), 1).otherwise(-1).alias("vote"), "evidence")


def model_vote(value: Column, target: Column, kind: str) -> Column:
    """A record's value as a vote on a target value."""
    if kind == "tag":  # value is an array
        return F.when(F.array_contains(value, target), 1).otherwise(-1)
    none = value.isNull() | (value == "not_documented")
    if kind == "tristate":
        return F.when(none, -1).when(value == target, 1).when(value.isin("yes", "no"), 0).otherwise(-1)
    return F.when(none, -1).when(value == target, 1).otherwise(0)


def combine(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Any positive, else any negative, else none."""
    return votes.groupBy(*keys).agg(F.when(F.max("vote") == 1, 1).when(F.count_if(F.col("vote") == 0) > 0, 0).otherwise(-1).alias("vote"))


def polarity(votes: DataFrame) -> DataFrame:
    g = votes.groupBy("lf_name")
    return g.agg(*[(100.0 * F.count_if(F.col("vote") == v) / F.count("*")).alias(n) for n, v in (("positive_pct", 1), ("negative_pct", 0), ("abstain_pct", -1))], (100.0 * F.count_if(F.col("vote") != -1) / F.count("*")).alias("coverage_pct"))


def overlaps(votes: DataFrame) -> DataFrame:
    """Every two functions of a target: rows where both vote, and how often they agree. One grouped array a document and
    target (as long as it has functions), no self join."""
    g = votes.where("vote != -1").groupBy("doc_id", *TARGET).agg(F.sort_array(F.collect_list(F.struct("lf_name", "vote"))).alias("v"))
    p = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["lf_name"] > a["lf_name"]), lambda b: F.struct(a["lf_name"].alias("a"), b["lf_name"].alias("b"), (a["vote"] == b["vote"]).alias("same")))))
    return g.select(*TARGET, F.explode(p).alias("p")).groupBy(*TARGET, "p.a", "p.b").agg(F.count("*").alias("both"), F.avg(F.col("p.same").cast("double")).alias("agreement"))


def majority(votes: DataFrame) -> DataFrame:
    """Probability by majority, and the way each target is fitted: no votes, a single covering function, or success."""
    t = votes.groupBy("doc_id", *TARGET).agg(F.count_if(F.col("vote") == 1).alias("pos"), F.count_if(F.col("vote") == 0).alias("neg"))
    cover = votes.groupBy(*TARGET).agg(F.count_distinct("lf_name").alias("n_lfs_total"), F.count_distinct(F.when(F.col("vote") != -1, F.col("lf_name"))).alias("n_lfs_contributing"))
    p = F.when(F.col("pos") > F.col("neg"), 1.0).when(F.col("neg") > F.col("pos"), 0.0).otherwise(0.5)
    status = F.when(F.col("n_lfs_contributing") == 0, "no_votes").when(F.col("n_lfs_contributing") == 1, "single_lf_only").otherwise("success_majority")
    return t.join(F.broadcast(cover) if cover.count() <= 100_000 else cover, TARGET).select("doc_id", *TARGET, p.alias("probability"), status.alias("fit_status"), "n_lfs_total", "n_lfs_contributing")


def accuracies(votes: DataFrame, sweeps: int = 50) -> tuple[dict[str, float], float]:
    """Accuracy of each function of one target, and the share of positives, by expectation maximisation over the distinct
    vote patterns (a table of pattern counts, not of documents); functions are taken as independent given the class."""
    names = sorted(r.lf_name for r in votes.select("lf_name").distinct().collect())
    wide = votes.groupBy("doc_id").agg(*[F.max(F.when(F.col("lf_name") == n, F.col("vote"))).alias(f"v{i}") for i, n in enumerate(names)])
    rows = wide.groupBy(*[f"v{i}" for i in range(len(names))]).agg(F.count("*").alias("n")).collect()
    v = np.array([[-1 if x is None else x for x in r[:-1]] for r in rows]).reshape(len(rows), len(names))
    n, acc, prior = np.array([r[-1] for r in rows], float), np.full(len(names), 0.7), 0.5
    cast = v >= 0
    for _ in range(sweeps):
        right = np.where(v == 1, np.log(acc), np.log(1 - acc))
        wrong = np.where(v == 1, np.log(1 - acc), np.log(acc))
        z = (np.where(cast, right - wrong, 0)).sum(1) + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-z))
        good = np.where(v == 1, p[:, None], 1 - p[:, None]) * cast
        acc = np.clip((n @ good + 0.7) / (n @ cast + 1), 0.05, 0.95)
        prior = float(np.clip((n @ p) / n.sum(), 0.01, 0.99))
    return dict(zip(names, acc.tolist(), strict=True)), prior


def fuse(votes: DataFrame, sweeps: int = 50) -> DataFrame:
    """Probabilities of one target's votes by the fitted model; majority with fewer than three functions that vote."""
    base = majority(votes)
    if votes.where("vote != -1").select("lf_name").distinct().count() < 3:
        return base
    acc, prior = accuracies(votes, sweeps)
    w = F.create_map(*[F.lit(x) for k, a in acc.items() for x in (k, float(np.log(a / (1 - a))))])
    z = votes.groupBy("doc_id", *TARGET).agg((F.sum(F.when(F.col("vote") == 1, w[F.col("lf_name")]).when(F.col("vote") == 0, -w[F.col("lf_name")]).otherwise(0.0)) + float(np.log(prior / (1 - prior)))).alias("z"), F.count_if(F.col("vote") != -1).alias("cast"))
    p = F.when(F.col("cast") == 0, 0.5).otherwise(1 / (1 + F.exp(-F.col("z"))))
    return base.drop("probability").join(z, ["doc_id", *TARGET]).withColumns({"probability": p, "fit_status": F.lit("success_model")}).drop("z", "cast")


def fuse_targets(votes: DataFrame, sweeps: int = 50) -> DataFrame:
    """fuse() of each target (there are as many as fields and values to be labelled)."""
    targets = sorted(tuple(r) for r in votes.select(*TARGET).distinct().collect())
    return reduce(DataFrame.unionByName, (fuse(votes.where(same_target(t)), sweeps) for t in targets))


def same_target(values: tuple) -> Column:
    out = F.lit(True)
    for c, v in zip(TARGET, values, strict=True):
        out = out & (F.col(c) == v)
    return out


def smoke(t: DataFrame, keys: list[str], lf: Column, model: Column) -> DataFrame:
    """Hits, false hits and misses of a function (fires or not) against a model (positive or not)."""
    g = t.where(lf | model).groupBy(*keys)
    return g.agg(F.count_if(lf & model).alias("hits"), F.count_if(lf & ~model).alias("false_hits"), F.count_if(~lf & model).alias("misses"))


def smoke_rates(t: DataFrame, keys: list[str], lf: Column, model: Column) -> DataFrame:
    """smoke() with all rows counted: how often a function fires, how many of its firings the model shares, and how many of the
    model's positives it finds, in percent (0 of nothing)."""
    lf, model = F.coalesce(lf, F.lit(False)), F.coalesce(model, F.lit(False))
    g = t.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(lf).alias("fired"), F.count_if(model).alias("model_yes"), F.count_if(lf & model).alias("shared"))
    return g.withColumns({"fired_pct": stats.pct(F.col("fired"), F.col("n")), "agreement_pct": stats.pct(F.col("shared"), F.col("fired")), "recall_pct": stats.pct(F.col("shared"), F.col("model_yes"))})


def smoke_examples(t: DataFrame, keys: list[str], lf: Column, model: Column, fired_text: Column, model_text: Column, order: str = "doc_id", each: int = 10, n_chars: int = 300) -> DataFrame:
    """keys, kind (false_hit or miss), place, order, excerpt: the first `each` cases of both kinds of each function.

    A false hit (it fires, the model isn't positive) shows what the function saw, a miss what the model said. Both come from one
    pass; the rank's limit is pushed below the shuffle, so no function's cases are gathered whole.
    """
    from pyspark.sql import Window

    lf, model = F.coalesce(lf, F.lit(False)), F.coalesce(model, F.lit(False))
    cases = t.where(lf != model).select(*keys, F.when(lf, "false_hit").otherwise("miss").alias("kind"), order, F.when(lf, fired_text).otherwise(model_text).alias("said"))
    place = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(order, "said"))
    return cases.withColumn("place", place).where(F.col("place") <= each).select(*keys, "kind", "place", order, texts.excerpt(F.col("said"), n_chars).alias("excerpt"))


def consensus(a: Column, b: Column, c: Column, kind: str) -> Column:
    """Probability from three raters: tags by at least half, tri-state by majority of yes and no."""
    yes = sum((F.coalesce((x == "yes").cast("int"), F.lit(0)) for x in (a, b, c)), F.lit(0))
    no = sum((F.coalesce((x == "no").cast("int"), F.lit(0)) for x in (a, b, c)), F.lit(0))
    if kind == "tag":
        return F.when(yes * 2 >= 3, 1.0).otherwise(0.0)
    return F.when(yes > no, 1.0).when(no > yes, 0.0).otherwise(0.5)


def versus(t: DataFrame, keys: list[str], lf: Column, model: Column) -> DataFrame:
    """Four cells and agreement of a function (fires or not) with a model (positive or not), and both conditional rates."""
    g = t.groupBy(*keys).agg(F.count_if(lf & model).alias("both"), F.count_if(lf & ~model).alias("lf_only"), F.count_if(~lf & model).alias("model_only"), F.count_if(~lf & ~model).alias("neither"))
    n = F.col("both") + F.col("lf_only") + F.col("model_only") + F.col("neither")
    return g.withColumns({"agreement": stats.ratio(F.col("both") + F.col("neither"), n), "model_given_lf": F.try_divide(F.col("both").cast("double"), F.col("both") + F.col("lf_only")), "lf_given_model": F.try_divide(F.col("both").cast("double"), F.col("both") + F.col("model_only"))})


def choose_variant(scores: DataFrame, tie: float = 0.01) -> DataFrame:
    """(variant, agreement, weight, median_tokens) -> weighted agreement; the best, or within `tie` of it the cheapest."""
    t = scores.groupBy("variant").agg((F.sum(F.col("agreement") * F.col("weight")) / F.sum("weight")).alias("score"), F.max("median_tokens").alias("median_tokens"))
    from pyspark.sql import Window

    all_ = Window.partitionBy()  # a row for each variant
    t = t.withColumn("close", F.max("score").over(all_) - F.col("score") <= tie + 1e-12)
    return t.withColumn("tie", F.count_if("close").over(all_) > 1).withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("close"), F.when(F.col("close"), F.col("median_tokens")), F.desc("score"), "variant")) == 1)


def zero_firing(t: DataFrame) -> DataFrame:
    """(lf_name, codes_any, codes_primary, fired) -> why a function never fires."""
    return t.withColumn("diagnosis", F.when(F.col("fired") > 0, "fires").when(F.col("codes_any") == 0, "data_absent").when(F.col("codes_primary") == 0, "primary_only").otherwise("logic"))
