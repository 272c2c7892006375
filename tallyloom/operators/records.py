"""Audit records of fields of all kinds, assembled: agreement by pair, positives by rater, what the disagreements are, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, text
from ..functions.shared import written
from . import agreement, audit, longform

RATERS = longform.RATERS
TAG = "admission_reason_tags:"


def field_type(field: Column) -> Column:
    """The kind of a field as records name it."""
    kind = labels.field_class(field)
    return F.when(kind == "tag", "admission_tag").otherwise(kind)


def ballots(answers: DataFrame) -> DataFrame:
    """doc_id, field, A, B, C: answers of all kinds (longform.unpivot_features) as votes; tags are present or absent."""
    return longform.side_by_side(answers.withColumn("value", _vote(F.col("value"))))


def feature_ballots(features: DataFrame) -> DataFrame:
    """ballots(longform.unpivot_features(features)), without a shuffle of the answers."""
    return longform.features_side_by_side(features).withColumns({r: _vote(F.col(r)) for r in RATERS})


def _vote(value: Column) -> Column:
    return F.when(labels.field_class(F.col("field")) == "tag", F.when(value == "1", "present").otherwise("absent")).otherwise(value)


def is_positive(field: Column, vote: Column) -> Column:
    """Tags that are present, tri-state values of yes, other values that are documented."""
    kind = labels.field_class(field)
    return F.when(kind == "tag", vote == "present").when(kind == "tristate", vote == "yes").otherwise(vote != "not_documented")


def metrics(counts: DataFrame) -> DataFrame:
    """field, A, B, C, n -> field, kappa_A_B, kappa_A_C, kappa_B_C and the means over pairs."""
    fp = ["field", "pair"]
    k = agreement.kappa(agreement.contingency(longform.pairs(counts, keep=("field", "n")), fp, F.col("n")), fp)
    by_pair = [F.max(F.when(F.col("pair") == f"{a}_{b}", F.col("kappa"))).alias(f"kappa_{a}_{b}") for i, a in enumerate(RATERS) for b in RATERS[i + 1 :]]
    return k.groupBy("field").agg(*by_pair, F.avg("kappa").alias("kappa_mean"), F.avg("pabak").alias("pabak_mean"), F.avg("agreement").alias("agreement_mean"))


def example_rows(found: DataFrame, codes: DataFrame, reasons: DataFrame, cap: int = 10, outlier_chars: int = 600, other_chars: int = 400) -> DataFrame:
    """field, examples: of each field at most `cap` cases (audit.examples), with their votes, the rater who stands alone, the
    primary code, and excerpts of what the raters said; without such a rater there are no excerpts.

    codes: doc_id, primary_code, chapter. reasons: doc_id, rater, reasoning. Only the chosen cases meet the raters' words.
    """
    chosen = audit.examples(found, codes.select("doc_id", F.col("chapter").alias("stratum")), cap).select("field", "doc_id", "place")
    cases = chosen.join(found.select("doc_id", "field", *RATERS, "outlier"), ["doc_id", "field"]).join(codes.select("doc_id", "primary_code"), "doc_id")
    short = reasons.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi")
    short = short.groupBy("doc_id").agg(*[F.max(F.when(F.col("rater") == r, text.excerpt(F.col("reasoning"), max(outlier_chars, other_chars)))).alias(f"said_{r}") for r in RATERS])
    t = cases.join(short, "doc_id", "left")
    said = {r: F.coalesce(F.col(f"said_{r}"), F.lit("")) for r in RATERS}
    alone = F.coalesce(*[F.when(F.col("outlier") == r, F.substring(said[r], 1, outlier_chars)) for r in RATERS], F.lit(""))
    others = F.array(*[F.struct(F.lit(r).alias("rater"), F.substring(said[r], 1, other_chars).alias("excerpt")) for r in RATERS])
    others = F.when(F.col("outlier").isNull(), F.slice(others, 1, 0)).otherwise(F.filter(others, lambda x: x["rater"] != F.col("outlier")))
    one = F.struct("place", "doc_id", *RATERS, "outlier", F.coalesce("primary_code", F.lit("")).alias("primary_code"), alone.alias("outlier_reasoning"), others.alias("consensus_reasoning"))
    return t.select("field", one.alias("x")).groupBy("field").agg(F.sort_array(F.collect_list("x")).alias("examples"))  # at most `cap`


def audit_records(answers: DataFrame, codes: DataFrame, reasons: DataFrame, least: int = 10, cap: int = 10) -> DataFrame:
    """A record of each field (of any kind) about which the raters disagree somewhere, over the documents that all have answered.

    field (tags: the name of the list), target_value (the tag, else null), field_type, the kappas of the pairs and the means
    over them, n_positive_A to _C, n_positive_total, low_base_rate (below `least`), disagreement_count,
    disagreement_pattern_summary, examples. Fields without a disagreement have no record. A document without codes can't be an
    example; one without a rater's words has empty excerpts.
    """
    return ballot_records(ballots(answers), codes, reasons, least, cap)


def ballot_records(votes: DataFrame, codes: DataFrame, reasons: DataFrame, least: int = 10, cap: int = 10) -> DataFrame:
    """audit_records() of ballots."""
    # the votes are written once; agreement, positives and patterns only need how often each three of them occurs
    w = written(votes, "ballots")
    counts = w.groupBy("field", *RATERS).agg(F.count("*").alias("n"))
    found = audit.patterns(w)
    n = counts.groupBy("field").agg(*[F.sum(F.when(is_positive(F.col("field"), F.col(r)), F.col("n")).otherwise(0)).alias(f"n_positive_{r}") for r in RATERS])
    total = F.col("n_positive_A") + F.col("n_positive_B") + F.col("n_positive_C")
    s = audit.summaries(audit.patterns(counts), F.col("n")).select("field", F.col("disagreements").alias("disagreement_count"), F.col("summary").alias("disagreement_pattern_summary"))
    t = s.join(metrics(counts), "field").join(n, "field").join(example_rows(found, codes, reasons, cap), "field", "left")
    tag = F.col("field").startswith(TAG)
    return t.select(
        F.when(tag, TAG[:-1]).otherwise(F.col("field")).alias("field"), F.when(tag, F.substr("field", F.lit(len(TAG) + 1))).alias("target_value"), field_type(F.col("field")).alias("field_type"),
        "kappa_A_B", "kappa_A_C", "kappa_B_C", "kappa_mean", "pabak_mean", "agreement_mean", "n_positive_A", "n_positive_B", "n_positive_C", total.alias("n_positive_total"), (total < least).alias("low_base_rate"),
        "disagreement_count", "disagreement_pattern_summary", F.coalesce("examples", F.array()).alias("examples"),
    )
