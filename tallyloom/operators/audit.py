"""Disagreement audits: records, pattern summaries, clusters, representative examples, guards."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import labels


#: What is said of fields without a rater who stands alone.
DISTRIBUTED = "Disagreements distributed across all three variants (no consistent outlier)."
VARYING = "No consistent outlier; disagreements vary by case."


def patterns(wide: DataFrame) -> DataFrame:
    """(doc_id, field, A, B, C) -> rows with a disagreement and who stands alone."""
    p = labels.vote_pattern(F.col("A"), F.col("B"), F.col("C"))
    return wide.select("*", p.alias("p")).where("p.pattern != 'all_equal'").select(*wide.columns, "p.pattern", "p.outlier", "p.consensus", "p.odd")


def summaries(found: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row for each field (a row of `found` counts `weight` times): disagreements, the rater who stands alone most, and a sentence.

    More than 60 % with one outlier: the sentence names its most frequent votes (of equally frequent ones, the first by
    value). All three raters stand alone, within one of each other: distributed. Else the cases vary.
    """
    found = found.select("field", "outlier", "consensus", "odd", (F.lit(1) if weight is None else weight).cast("long").alias("w"))
    n = found.groupBy("field").agg(F.sum("w").alias("disagreements"), *[F.sum(F.when(F.col("outlier") == r, F.col("w")).otherwise(0)).alias(r) for r in "ABC"])
    by = found.where("outlier is not null").groupBy("field", "outlier", "consensus", "odd").agg(F.sum("w").alias("n"))
    top = by.withColumn("rn", F.row_number().over(Window.partitionBy("field", "outlier").orderBy(F.desc("n"), "consensus", "odd"))).where("rn = 1").drop("rn", "n")
    most = F.greatest("A", "B", "C")
    who = F.when(F.col("A") == most, "A").when(F.col("B") == most, "B").otherwise("C")
    t = n.select("*", most.alias("most"), who.alias("outlier")).join(top, ["field", "outlier"], "left")
    sentence = F.concat(F.col("outlier"), F.lit(" votes '"), F.col("odd"), F.lit("' where the other two vote '"), F.col("consensus"), F.lit("' on "), F.col("most").cast("string"), F.lit(" of "), F.col("disagreements").cast("string"), F.lit(" disagreements."))
    clear, least = F.col("most") > 0.6 * F.col("disagreements"), F.least("A", "B", "C")
    text = F.when(clear, sentence).when((least > 0) & (most - least <= 1), DISTRIBUTED).otherwise(VARYING)
    return t.select("field", "disagreements", F.when(clear, F.col("outlier")).alias("outlier"), F.when(clear, F.col("odd")).alias("odd"), F.when(clear, F.col("most")).alias("n"), text.alias("summary"))


def clusters(summary: DataFrame) -> DataFrame:
    """cluster_id, cluster_label, outlier, n (disagreements of its fields), fields: fields whose rater stands alone with the
    same vote, and two clusters for those without an outlier; every field is in one."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim("odd")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    named = F.col("outlier").isNotNull() & (F.length("odd") > 0) & ~F.contains("odd", F.lit("'"))
    varying = F.col("outlier").isNull() & (F.col("summary") == VARYING)
    id_ = F.when(named, F.concat(F.lower("outlier"), F.lit("_overasserts_"), F.when(slug == "", "unknown").otherwise(slug))).when(varying, "no_consistent_outlier").otherwise("unclassified_disagreement")
    label = F.when(named, F.concat("outlier", F.lit(" over-asserts '"), "odd", F.lit("'"))).when(varying, "No consistent outlier").otherwise("Unclassified disagreement pattern")
    t = summary.select("field", "disagreements", id_.alias("cluster_id"), label.alias("cluster_label"), F.when(named, F.col("outlier")).alias("outlier"))
    t = t.groupBy("cluster_id").agg(F.min("cluster_label").alias("cluster_label"), F.min("outlier").alias("outlier"), F.sum("disagreements").alias("n"), F.sort_array(F.collect_list("field")).alias("fields"))
    return t.orderBy(F.desc("n"), "cluster_id")


def target(found: DataFrame, least: int = 50) -> DataFrame:
    """The largest cluster of more than `least` disagreements with a variant to change."""
    return found.where((F.col("n") > least) & F.col("outlier").isNotNull()).orderBy(F.desc("n"), "cluster_id").limit(1)


def cluster_kappa(found: DataFrame, kappas: DataFrame) -> DataFrame:
    t = found.select("cluster_id", F.explode("fields").alias("field")).join(kappas.select("field", "kappa_mean"), "field", "left")
    return t.groupBy("cluster_id").agg(F.coalesce(F.avg("kappa_mean"), F.lit(0.0)).alias("kappa_mean"))


def adjusted(found: DataFrame, examples: DataFrame) -> DataFrame:
    """Cluster sizes times the share of example disagreements (cluster_id, original, collapsed booleans) that survive a
    collapse; halves round to even."""
    s = examples.groupBy("cluster_id").agg(F.try_divide(F.count_if(F.col("original") & F.col("collapsed")).cast("double"), F.count_if("original")).alias("survival"))
    t = found.join(s, "cluster_id", "left").withColumn("survival", F.coalesce("survival", F.lit(1.0)))
    return t.withColumn("adjusted", F.greatest(F.lit(0), F.least(F.bround(F.col("n") * F.col("survival")).cast("long"), F.col("n"))))


def new_clusters(before: DataFrame, after: DataFrame, least: int = 0) -> DataFrame:
    """Clusters of `after`, larger than least, that `before` doesn't have."""
    return after.join(before.select("cluster_id").distinct(), "cluster_id", "left_anti").where(F.col("n") > least)


def reduction(first: int, last: int) -> float:
    return 100.0 * (first - last) / first if first else 0.0


def reduction_pct(first: Column, last: Column) -> Column:
    return F.when(first > 0, 100.0 * (first - last) / first).otherwise(0.0)


def examples(found: DataFrame, strata: DataFrame, cap: int = 10, top_patterns: int = 5) -> DataFrame:
    """At most `cap` documents of each field: round robin over its most frequent patterns, unseen strata first (none and the
    empty one are never new).

    A turn takes a pattern's first document of an unseen stratum, or its first one left. With `cap` turns, at most `cap` strata
    and documents are gone before any turn, so only the first documents of a pattern's first 2 * cap strata, and its first
    2 * cap documents, can be taken: no more are gathered, and none that could be taken is left out.
    """
    t = found.join(strata, "doc_id").withColumn("key", F.concat_ws("|", F.coalesce("A", F.lit("null")), F.coalesce("B", F.lit("null")), F.coalesce("C", F.lit("null"))))
    n = t.groupBy("field", "key").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= top_patterns)
    t = t.join(n, ["field", "key"]).select("field", "key", "rank", "doc_id", F.col("stratum").cast("string").alias("stratum"))
    in_order = Window.partitionBy("field", "key", "rank").orderBy("doc_id", "stratum")
    head = lambda x: x.withColumn("nth", F.row_number().over(in_order)).where(F.col("nth") <= 2 * cap).drop("nth")
    firsts = t.groupBy("field", "key", "rank", "stratum").agg(F.min("doc_id").alias("doc_id")).select(*t.columns)
    t = head(t).unionByName(head(firsts)).distinct()

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = [g.sort_values(["doc_id", "stratum"]).to_dict("records") for _, g in pdf.groupby("rank", sort=True)]
        seen, ids, out = set(), set(), []
        while len(out) < cap and any(queues):
            for q in queues:
                q[:] = [r for r in q if r["doc_id"] not in ids]
                if not q or len(out) == cap:
                    continue
                r = next((r for r in q if r["stratum"] and r["stratum"] not in seen), q[0])
                seen.add(r["stratum"])
                ids.add(r["doc_id"])
                out.append((r["field"], r["doc_id"], r["key"], r["stratum"], len(out)))
        return pd.DataFrame(out, columns=["field", "doc_id", "key", "stratum", "place"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return t.groupBy("field").applyInPandas(pick, f"field string, doc_id {kind}, key string, stratum string, place int")


def example_quotas(weights: dict[str, int], total: int = 8) -> dict[str, int]:
    """Examples of each record of a cluster: at least one, in proportion (halves to even)."""
    whole = sum(weights.values()) or 1
    return {k: max(1, round(w / whole * total)) for k, w in weights.items()}


def quota_examples(records: DataFrame, total: int = 8) -> DataFrame:
    """(cluster_id, record_id, weight, example) -> `total` examples of each cluster, none twice: those within their record's
    quota first (at least one, in proportion to its weight; halves to even), the heaviest record first and the smallest
    examples first; then what the records have left. An example that an earlier record gave is passed over.

    Of a record, only its first `total` examples and as many that others may give before it can be taken, so no more are
    gathered.
    """
    first = Window.partitionBy("cluster_id", "record_id").orderBy("example")
    t = records.dropDuplicates(["cluster_id", "record_id", "example"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= 2 * total)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        held = sorted(((-g["weight"].iloc[0], r, sorted(g["example"])) for r, g in pdf.groupby("record_id")), key=lambda x: x[:2])
        quota, taken, seen = example_quotas({r: -w for w, r, _ in held}, total), [], set()
        for most in (quota, dict.fromkeys(quota, total)):
            for _, record, examples_ in held:
                new = [x for x in examples_ if x not in seen][: min(most[record], total - len(taken))]
                taken += [(record, x) for x in new]
                seen.update(new)
        return pd.DataFrame([(pdf["cluster_id"].iloc[0], i + 1, *x) for i, x in enumerate(taken)], columns=["cluster_id", "place", "record_id", "example"])

    kind = {f.name: f.dataType.simpleString() for f in records.schema}
    return t.groupBy("cluster_id").applyInPandas(pick, f"cluster_id {kind['cluster_id']}, place int, record_id {kind['record_id']}, example {kind['example']}")


@pandas_udf(DoubleType())
def edit_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - the matching-blocks ratio of two strings."""
    return pd.Series([None if x is None or y is None else 1 - difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def guards(proposals: DataFrame, vocabulary: list[str], placeholders: list[str], frozen: list[str], most: float = 0.25) -> DataFrame:
    """(before, after) -> which checks a proposed text passes: vocabulary, placeholders, frozen phrases, edit share."""
    has = lambda words: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("after"), w)) if words else F.lit(True)
    t = proposals.withColumns({"vocabulary_ok": has(vocabulary), "placeholders_ok": has(placeholders), "frozen_ok": has(frozen), "edit_share": edit_share("before", "after")})
    return t.withColumn("accepted", F.col("vocabulary_ok") & F.col("placeholders_ok") & F.col("frozen_ok") & (F.col("edit_share") <= most))


def has_each(text: Column, groups: list[list[str]], without: str = "") -> Column:
    """Whether a text has, whatever its case, one of the phrases of every group; characters of `without` don't count in it."""
    t = F.lower(F.translate(text, without, "") if without else text)
    out = F.lit(True)
    for phrases in groups:
        out = out & F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(t, p))
    return F.coalesce(out, F.lit(False))


def named_guards(proposals: DataFrame, vocabulary: list[str], placeholders: list[str], frozen: dict[str, list[list[str]]], without: str = "`", most: float = 0.25) -> DataFrame:
    """(before, after) -> adds vocabulary_ok, placeholders_ok (both letter by letter), frozen_ok, edit_share, failed (names of the
    checks that a text doesn't pass, sorted) and accepted. A frozen check has groups of phrases: one of each must be left."""
    every = lambda words: F.coalesce(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("after"), w)), F.lit(False)) if words else F.lit(True)
    checks = {"vocabulary": every(vocabulary), "placeholders": every(placeholders)} | {f"frozen: {name}": has_each(F.col("after"), groups, without) for name, groups in frozen.items()}
    t = proposals.withColumns({"vocabulary_ok": checks["vocabulary"], "placeholders_ok": checks["placeholders"], "edit_share": edit_share("before", "after")})
    checks["edit_share"] = F.coalesce(F.col("edit_share") <= most, F.lit(False))
    t = t.withColumn("failed", F.array_sort(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in checks.items()]))))
    return t.withColumns({"frozen_ok": ~F.exists("failed", lambda x: F.startswith(x, F.lit("frozen: "))), "accepted": F.size("failed") == 0})


def should_stop(history: list[dict], most: int = 5, failures: int = 2, least_gain: float = 2.0, budget: float | None = None) -> str | None:
    """Why an optimisation loop ends, or None: iterations, failures in a row, a gain below the least, budget."""
    if len(history) >= most:
        return "iterations"
    if len(history) >= failures and all(not h["accepted"] for h in history[-failures:]):
        return "failures"
    if history and history[-1]["accepted"] and history[-1]["gain_pp"] < least_gain:
        return "gain"
    if budget is not None and sum(h.get("cost", 0) for h in history) > budget:
        return "budget"
    return None
