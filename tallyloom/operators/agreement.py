"""Agreement statistics, all from contingency tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels, stats
from . import longform


def contingency(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, left, right, n."""
    return pairs.groupBy(*keys, "left", "right").agg((F.sum(weight) if weight is not None else F.count("*")).alias("n"))


def kappa(table: DataFrame, keys: list[str], on_empty: float | None = 0.0, on_constant: float | None = 1.0) -> DataFrame:
    """n, agreement, kappa and 2-class PABAK of each key. Each cell counts into the marginals of both of its labels."""
    sides = F.array(
        F.struct(F.col("left").alias("label"), F.col("n").alias("row_n"), F.lit(0).cast("long").alias("col_n"), F.when(F.col("left").eqNullSafe(F.col("right")), F.col("n")).otherwise(0).alias("same_n")),
        F.struct(F.col("right").alias("label"), F.lit(0).cast("long").alias("row_n"), F.col("n").alias("col_n"), F.lit(0).cast("long").alias("same_n")),
    )
    m = table.select(*keys, F.explode(sides).alias("x")).groupBy(*keys, "x.label").agg(F.sum("x.row_n").alias("r"), F.sum("x.col_n").alias("c"), F.sum("x.same_n").alias("s"))
    m = m.groupBy(*keys).agg(F.sum("r").alias("n"), F.sum("s").alias("agree"), F.sum(F.col("r").cast("double") * F.col("c")).alias("expected"))
    po = stats.ratio(F.col("agree"), F.col("n"))
    return m.select(*keys, "n", po.alias("agreement"), stats.kappa(F.col("n"), F.col("agree"), F.col("expected"), on_empty, on_constant).alias("kappa"), F.when(F.col("n") > 0, 2 * po - 1).otherwise(0.0).alias("pabak"))


def mean_over_pairs(k: DataFrame, keys: list[str]) -> DataFrame:
    return k.groupBy(*keys).agg(F.avg("kappa").alias("kappa_mean"), F.avg("pabak").alias("pabak_mean"), F.avg("agreement").alias("agreement_mean"))


def positives(answers: DataFrame, positive: Column | None = None) -> DataFrame:
    """Positive votes of each field over all raters (tri-state yes; or a rule for tags, enums)."""
    return answers.groupBy("field").agg(F.count_if(positive if positive is not None else F.col("value") == "yes").alias("n_positive"))


def report(answers: DataFrame, wide: DataFrame, pair_frame: DataFrame, least: int = 10) -> DataFrame:
    """Per field: mean kappa over pairs, positives, low-base and low-kappa flags, band."""
    k = mean_over_pairs(kappa(contingency(pair_frame, ["field", "pair"]), ["field", "pair"]), ["field"])
    return k.join(positives(answers), "field").withColumns({"low_base_rate": F.col("n_positive") < least, "below": F.col("kappa_mean") < 0.6, "band": stats.band(F.col("kappa_mean"))})


def full_report(answers: DataFrame, least: int = 10) -> DataFrame:
    """report() over fields of all kinds (longform.unpivot_features), with each field's kind.

    Positives are tags that are there, tri-state values of yes, and other values that are documented.
    """
    kind, v = labels.field_class(F.col("field")), F.col("value")
    w = longform.side_by_side(answers)
    k = mean_over_pairs(kappa(contingency(longform.pairs(w), ["field", "pair"]), ["field", "pair"]), ["field"])
    p = positives(answers, F.when(kind == "tag", v == "1").when(kind == "tristate", v == "yes").otherwise(v != "not_documented"))
    return k.join(p, "field").withColumns({"field_group": kind, "low_base_rate": F.col("n_positive") < least, "below": F.col("kappa_mean") < 0.6, "band": stats.band(F.col("kappa_mean"))})


def by_group(report_frame: DataFrame) -> DataFrame:
    """Mean and median kappa of each kind of field, over those that aren't rare."""
    t = report_frame.where("not low_base_rate").groupBy("field_group")
    return t.agg(F.count("*").alias("n_fields"), F.avg("kappa_mean").alias("mean_kappa"), F.median("kappa_mean").alias("median_kappa"))


def common_in_both(answers: DataFrame, least: int = 10) -> DataFrame:
    """(model, field, value) -> fields with enough positives in every model."""
    n = answers.groupBy("field", "model").agg(F.count_if(F.col("value") == "yes").alias("n"))
    return n.groupBy("field").agg(F.min("n").alias("n")).where(F.col("n") >= least).select("field")


def model_effect(k: DataFrame, included: DataFrame) -> DataFrame:
    """Of the included fields: how many, the median and mean of their deltas, and how many are negative."""
    d = model_delta(k).join(included, "field", "left_semi")
    return d.agg(F.count("*").alias("n_fields"), F.median("delta_pp").alias("median_delta_pp"), F.avg("delta_pp").alias("mean_delta_pp"), F.count_if(F.col("delta_pp") < 0).alias("n_negative"))


def filtered_median(report_frame: DataFrame) -> DataFrame:
    return report_frame.where("not low_base_rate").agg(F.median("kappa_mean").alias("median_kappa"), F.count("*").alias("n_fields"))


def rater_medians(k: DataFrame, raters: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Each rater's mean kappa over the pairs it is in, then the median over fields."""
    t = k.select("field", "kappa", F.explode(F.split("pair", "_")).alias("rater")).groupBy("field", "rater").agg(F.avg("kappa").alias("kappa"))
    return t.groupBy("rater").agg(F.median("kappa").alias("median_kappa"))


def model_delta(k: DataFrame) -> DataFrame:
    """(model small / full, field, pair, kappa) -> per field the median over pairs of 100 (full - small)."""
    w = k.groupBy("field", "pair").agg(F.max(F.when(F.col("model") == "small", F.col("kappa"))).alias("small"), F.max(F.when(F.col("model") == "full", F.col("kappa"))).alias("full"))
    return w.groupBy("field").agg(F.median(100 * (F.col("full") - F.col("small"))).alias("delta_pp"))


def confusion(pairs: DataFrame, keys: list[str], domain: list[str] | None = None) -> DataFrame:
    """Counts, row shares, and the share of the diagonal; labels outside the domain are dropped."""
    p = pairs if domain is None else pairs.where(F.col("left").isin(*domain) & F.col("right").isin(*domain))
    w, all_ = Window.partitionBy(*keys, "left"), Window.partitionBy(*keys)
    c = contingency(p, keys)
    diagonal = F.sum(F.when(F.col("left") == F.col("right"), F.col("n")).otherwise(0)).over(all_)
    return c.select(*keys, "left", "right", "n", (F.col("n") / F.sum("n").over(w)).alias("row_share"), (diagonal / F.sum("n").over(all_)).alias("diagonal_share"))


def dense(confusion_frame: DataFrame, keys: list[str], labels_: list[str]) -> DataFrame:
    """All cells of the label set, zeros included (labels x labels rows for each key)."""
    lit = F.array(*[F.lit(x) for x in labels_])
    every = confusion_frame.select(*keys).distinct().select("*", F.explode(lit).alias("left")).select("*", F.explode(lit).alias("right"))
    return every.join(confusion_frame.select(*keys, "left", "right", "n"), [*keys, "left", "right"], "left").fillna(0, ["n"])


def most_confused(confusion_frame: DataFrame, least: int, top: int) -> DataFrame:
    """Labels by mean off-diagonal share over pairs (support of at least `least` rows)."""
    w = confusion_frame.groupBy("pair", "left").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("left") == F.col("right"), F.col("n")).otherwise(0)).alias("same"))
    w = w.groupBy("left").agg(F.avg(1 - F.col("same") / F.col("support")).alias("confusion"), F.sum("support").alias("support")).where(F.col("support") >= least)
    return w.orderBy(F.desc("confusion"), F.desc("support"), "left").limit(top)


def multilabel_confusion(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sets of tags: shared tags on the diagonal; tags only left x tags only right off it (within a document)."""
    both = pairs.select(*keys, F.explode(F.array_intersect("left", "right")).alias("left"), F.lit(True).alias("same"))
    both = both.select(*keys, "left", F.col("left").alias("right"))
    off = pairs.select(*keys, F.explode(F.array_except("left", "right")).alias("left"), F.array_except("right", "left").alias("r")).select(*keys, "left", F.explode("r").alias("right"))
    return both.unionByName(off).groupBy(*keys, "left", "right").agg(F.count("*").alias("n"))


def off_diagonal(confusions: DataFrame, keys: list[str], top: int = 10) -> DataFrame:
    """The largest cells off the diagonal of a multi-label confusion, with their share of the row's off-diagonal cells."""
    t = confusions.where("left != right")
    t = t.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "left")))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "left", "right")
    return t.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def jaccard(left: Column, right: Column) -> Column:
    """1 when both are empty."""
    u = F.size(F.array_union(left, right))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(left, right)) / u)


def decomposition(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each disagreement category before and after collapsing to yes / not yes."""
    return pairs.groupBy(*keys, labels.disagreement(F.col("left"), F.col("right")).alias("original"), labels.collapsed_disagreement(F.col("left"), F.col("right")).alias("collapsed")).agg(F.count("*").alias("n"))


def dissolved(decomposed: DataFrame, keys: list[str]) -> DataFrame:
    """How many disagreements vanish when not-yes values are one, and how many stay."""
    total = F.sum(F.when(~F.col("original").isin("full_agreement", "null"), F.col("n")).otherwise(0))
    gone = F.sum(F.when((F.col("original") == "soft_no_nd") & (F.col("collapsed") == "full_agreement"), F.col("n")).otherwise(0))
    t = decomposed.groupBy(*keys).agg(total.alias("disagreements"), gone.alias("dissolved"))
    kept = F.greatest(F.col("disagreements") - F.col("dissolved"), F.lit(0))
    return t.withColumns({"preserved": kept, "dissolved_pct": stats.pct(F.col("dissolved"), F.col("disagreements")), "preserved_pct": stats.pct(kept, F.col("disagreements"))})


def valid_kappa(pairs: DataFrame, keys: list[str], collapsed: bool = False) -> DataFrame:
    """Kappa over pairs without nulls."""
    p = pairs.where("left is not null and right is not null")
    if collapsed:
        p = p.withColumns({"left": labels.collapse(F.col("left")), "right": labels.collapse(F.col("right"))})
    return kappa(contingency(p, keys), keys, None)


def gold(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement with a gold standard: share, Wilson interval, kappa (left gold, right model)."""
    k = kappa(contingency(pairs, keys), keys)
    hits = F.round(F.col("agreement") * F.col("n")).cast("long")
    low, high = stats.wilson(hits, F.col("n"))
    return k.withColumns({"hits": hits, "low": low, "high": high})


def precision_recall(t: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    g = t.groupBy(*keys) if keys else t.groupBy()
    g = g.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    p, r = stats.ratio(F.col("tp"), F.col("tp") + F.col("fp")), stats.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumns({"precision": p, "recall": r}).withColumns({"f1": stats.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "unique_capture": stats.ratio(F.col("fp"), F.col("tp") + F.col("fp") + F.col("fn"))})


def spearman(t: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties (a table of fields or tags)."""
    def average_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    return t.select(average_rank(x).alias("rx"), average_rank(y).alias("ry")).agg(F.try_divide(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("rho"), F.count("*").alias("n"))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, by the t distribution (incomplete beta by continued fraction)."""
    import math

    if n < 3 or abs(rho) >= 1:
        return 0.0 if n >= 3 else float("nan")
    df = n - 2
    x, a, b = 1 - rho * rho, df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-300)
                c = (1 + num / c) or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def shifts(before: DataFrame, after: DataFrame, value: str = "kappa") -> DataFrame:
    """Fields of both samples with the change, largest first, and a verdict."""
    j = before.select("field", F.col(value).alias("before")).join(after.select("field", F.col(value).alias("after")), "field")
    return j.withColumn("delta", F.col("after") - F.col("before")).withColumn("verdict", stats.verdict(F.col("delta"))).orderBy(F.desc(F.abs("delta")), "field")


def compared(samples: dict[str, DataFrame], value: str = "kappa_mean") -> DataFrame:
    """Any number of samples side by side: a column for each, and which of them lack the field."""
    names = list(samples)
    t = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("sample"), "field", F.col(value).alias("v")) for n, df in samples.items()))
    t = t.groupBy("field").agg(*[F.max(F.when(F.col("sample") == n, F.col("v"))).alias(n) for n in names])
    return t.withColumn("lacking", F.concat_ws(",", *[F.when(F.col(n).isNull(), n) for n in names]))
