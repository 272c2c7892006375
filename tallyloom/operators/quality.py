"""Distributions, costs, gates and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domains, stats, text
from . import ordered

ALL = Window.partitionBy  # over small, aggregated tables


def distribution(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and percentages of all values, null included."""
    t = df.groupBy(*keys, column).agg(F.count("*").alias("n"))
    return t.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def number_summary(df: DataFrame, column: str) -> DataFrame:
    """Null share over all rows; least, median, 95th percentile and most of the others."""
    x = F.col(column)
    return df.agg(F.avg(x.isNull().cast("double")).alias("null_rate"), F.min(x).cast("double").alias("least"), F.median(x).alias("median"), F.percentile(x, 0.95).alias("p95"), F.max(x).cast("double").alias("most"))


def quantiles(df: DataFrame, x: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles by linear interpolation, mean and population deviation; zeros for nothing."""
    q = F.percentile(x, [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])
    g = df.groupBy(*keys) if keys else df.groupBy()
    g = g.agg(F.count(x).alias("n"), F.min(x).alias("least"), q.alias("q"), F.max(x).alias("most"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return g.select(*keys, "n", zero(F.col("least")).alias("least"), *[zero(F.col("q")[i]).alias(n) for i, n in enumerate(("p10", "p25", "p50", "p75", "p90", "p99"))], zero(F.col("most")).alias("most"), zero(F.col("mean")).alias("mean"), zero(F.col("sd")).alias("sd"))


def run_summary(events: DataFrame, keys: list[str], tail: bool = False) -> DataFrame:
    """(input_tokens, output_tokens, latency_seconds, parse_ok, parse_error) of each run: outcomes, latency (with `tail`, its
    99th percentile, too), tokens and cost."""
    late = F.when(F.col("latency_seconds") > 0, F.col("latency_seconds"))
    api = F.coalesce(F.lower("parse_error").startswith("api_error:"), F.lit(False))
    t = events.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count_if("parse_ok").alias("succeeded"), F.count_if(~F.col("parse_ok") & ~api).alias("parse_failures"), F.count_if(~F.col("parse_ok") & api).alias("api_errors"),
        F.coalesce(F.median(late), F.lit(0.0)).alias("p50"), F.coalesce(F.percentile(late, 0.95), F.lit(0.0)).alias("p95"), *([F.coalesce(F.percentile(late, 0.99), F.lit(0.0)).alias("p99")] if tail else []), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
    )
    return t.withColumn("cost_usd", stats.cost(F.col("input_tokens"), F.col("output_tokens"), domains.PRICE_IN, domains.PRICE_OUT))


def progress(summary: DataFrame, hours: Column, planned: int) -> DataFrame:
    """Rate, time left and projected cost."""
    rps = stats.ratio(F.col("attempted"), hours * 3600)
    return summary.withColumns({"rps": rps, "eta_hours": stats.ratio((planned - F.col("attempted")).cast("double"), rps * 3600), "projected_usd": stats.ratio(F.col("cost_usd"), F.col("attempted")) * planned})


def running(events: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Running totals in each run, of any length."""
    return ordered.running(events, keys, order, {f"total_{c}": c for c in columns})


def over_budget(run: DataFrame, keys: list[str], order: list[str], budget: float) -> DataFrame:
    """The first row of each run with a running cost strictly above the budget."""
    every = F.struct(*[F.col(f"`{c}`") for c in run.columns])
    return run.where(F.col("total_cost") > budget).groupBy(*[F.col(k).alias(f"run_{k}") for k in keys]).agg(F.min_by(every, F.struct(*order)).alias("first")).select("first.*")


def window_rate(events: DataFrame, keys: list[str], order: list[str], latency: str, n: int = 1000, block: int = 1 << 14) -> DataFrame:
    """Calls a second over the last n latencies."""
    t = ordered.moving(events, keys, order, n, {"window_calls": F.count(latency), "window_seconds": F.sum(latency)}, block)
    return t.withColumn("window_rps", F.try_divide(F.col("window_calls").cast("double"), F.col("window_seconds"))).drop("window_calls", "window_seconds")


def thinned(t: DataFrame, keys: list[str], order: list[str], points: int = 4000) -> DataFrame:
    """About so many rows of each key: every n-th one and the last."""
    return ordered.every_nth(t, keys, order, points)


def derivative(t: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """dy/dx by second-order central differences for uneven steps; one-sided at the ends."""
    w = Window.partitionBy(*keys).orderBy(x)
    xa, xb, ya, yb = F.lag(x).over(w), F.lead(x).over(w), F.lag(y).over(w), F.lead(y).over(w)
    h, k = F.col(x) - xa, xb - F.col(x)
    mid = F.try_divide(h * h * yb + (k * k - h * h) * F.col(y) - k * k * ya, h * k * (h + k))
    return t.withColumn("rate", F.when(xa.isNull(), F.try_divide(yb - F.col(y), k)).when(xb.isNull(), F.try_divide(F.col(y) - ya, h)).otherwise(mid))


def histogram(df: DataFrame, x: Column, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width bins 1 to n, the last one closed above; values outside lo and hi are left out."""
    b = F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.where(x.between(lo, hi)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def upset(df: DataFrame, columns: list[str], top: int | None = None) -> DataFrame:
    """Joint patterns of boolean columns by count."""
    t = df.groupBy(F.concat(*[F.col(c).cast("int").cast("string") for c in columns]).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern")
    return t.limit(top) if top else t


def errors(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(text.error_class(F.col(column)).alias("error_class")).agg(F.count("*").alias("n"))


def count_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of counts (left, right): median difference, both null, both at least 1."""
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    none = F.col("left").isNull() & F.col("right").isNull()
    t = pairs.groupBy(*keys).agg(F.count_if(both).alias("compared"), F.count_if(none).alias("both_null"), F.median(F.when(both, F.abs(F.col("left") - F.col("right")))).alias("median_difference"), F.count_if(both & (F.col("left") >= 1) & (F.col("right") >= 1)).alias("both_some"))
    return t.withColumns({"both_null_pct": stats.pct(F.col("both_null"), F.col("compared") + F.col("both_null")), "both_some_pct": stats.pct(F.col("both_some"), F.col("compared"))})


def tag_prevalence(tagged: DataFrame, vocabulary: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Documents with each tag, per document and per firing; tags that never fire appear with 0."""
    n = tagged.select(*keys, "tags").withColumn("docs", F.count("*").over(Window.partitionBy(*keys)))
    hit = n.select(*keys, "docs", F.explode(F.array_distinct("tags")).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("hits"), F.first("docs").alias("docs"))
    hit = hit.withColumn("firings", F.sum("hits").over(Window.partitionBy(*keys)))
    out = vocabulary.join(hit, "tag", "left") if not keys else hit.join(vocabulary, "tag")
    return out.select(*keys, "tag", "tag_index", F.coalesce("hits", F.lit(0)).alias("hits"), stats.ratio(F.col("hits"), F.col("docs")).alias("prevalence"), stats.ratio(F.col("hits"), F.col("firings")).alias("share"))


def tag_counts(tagged: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    n = F.size("tags")
    return (tagged.groupBy(*keys) if keys else tagged.groupBy()).agg(F.avg(n).alias("mean"), F.percentile(n, 0.75).alias("p75"), F.max(n).alias("most"))


def residual_share(tagged: DataFrame, family: list[str]) -> DataFrame:
    """Share of firings in a family of tags by rater, then the mean over raters that have any."""
    t = tagged.select("rater", F.explode("tags").alias("tag")).groupBy("rater").agg((F.count_if(F.col("tag").isin(*family)) / F.count("*")).alias("share"))
    return t.agg(F.avg("share").alias("mean_share"))


def tag_confusion(pairs: DataFrame, tags: list[str]) -> DataFrame:
    """(doc_id, pair, left, right tag lists): 100 * mean over pairs of how often exactly one rater has a tag, over how
    often any rater has it."""
    one = pairs.select("doc_id", "pair", F.explode(F.array_distinct(F.concat("left", "right"))).alias("tag"), "left", "right").where(F.col("tag").isin(*tags))
    docs = pairs.agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("pair").alias("n_pairs"))
    xor = (F.array_contains("left", F.col("tag")) != F.array_contains("right", F.col("tag"))).cast("long")
    t = one.groupBy("tag").agg(F.sum(xor).alias("apart"), F.count_distinct("doc_id").alias("any_docs")).crossJoin(docs)  # one row
    return t.select("tag", (100 * (F.col("apart") / F.col("n_pairs") / F.col("docs")) / (F.col("any_docs") / F.col("docs"))).alias("confusion_rate"))


def base_rates(answers: DataFrame) -> DataFrame:
    """Share of each value by rater, and how far the raters are apart."""
    t = answers.groupBy("field", "value", "rater").agg(F.count("*").alias("n"))
    t = t.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("field", "rater")))
    w = t.groupBy("field", "value").agg(*[F.coalesce(F.max(F.when(F.col("rater") == r, F.col("rate"))), F.lit(0.0)).alias(r) for r in "ABC"])
    return w.withColumn("divergence", F.greatest("A", "B", "C") - F.least("A", "B", "C"))


def drift(current: DataFrame, baseline: DataFrame, keys: list[str], flag_pp: float = 5.0) -> DataFrame:
    """(keys, n, total) of two periods: rates, change in points, interval of the current rate, flag."""
    c = current.select(*keys, F.col("n").alias("n_now"), F.col("total").alias("total_now"))
    b = baseline.select(*keys, F.col("n").alias("n_then"), F.col("total").alias("total_then"))
    t = c.join(b, keys, "full_outer").fillna(0, ["n_now", "n_then", "total_now", "total_then"])
    low, high = stats.wilson(F.col("n_now"), F.col("total_now"))
    delta = stats.pct(F.col("n_now"), F.col("total_now")) - stats.pct(F.col("n_then"), F.col("total_then"))
    return t.withColumns({"delta_pp": delta, "low": low, "high": high, "flag": F.abs(delta) > flag_pp})


def gates(summary: DataFrame, baseline_cost: float, planned_rps: float | None = None, parse_max: float = 0.02, api_max: float = 0.01, cost_max: float = 0.15, late: str = "p95", late_max: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """PASS or FAIL rows of a run: parse failures and API errors below their limits, cost and latency within theirs."""
    n = F.col("attempted")
    rows = [
        ("parse_failures", stats.ratio(F.col("parse_failures"), n), F.lit(parse_max), "<"),
        ("api_errors", stats.ratio(F.col("api_errors"), n), F.lit(api_max), "<"),
        ("cost_drift", F.abs(stats.ratio(F.col("cost_usd"), n) / baseline_cost - 1), F.lit(cost_max), "<="),
        ("latency", stats.ratio(F.col(late), F.col("p50")), F.lit(late_max), "<="),
    ]
    if planned_rps is not None:
        rows.append(("throughput", F.abs(F.col("rps") / planned_rps - 1), F.lit(0.20), "<="))
    t = summary.select(*keys, F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), v.alias("value"), m.alias("limit"), ((v < m) if op == "<" else (v <= m)).alias("ok")) for g, v, m, op in rows])).alias("x")).select(*keys, "x.*")
    return t.select(*keys, "gate", "value", "limit", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("result"), F.when(F.min("ok").over(Window.partitionBy(*keys)), "PASS").otherwise("FAIL").alias("overall"))


def strict_gates(summary: DataFrame, baselines: DataFrame, planned_rps: float, timed: Column, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """PASS or FAIL rows of large runs (run_summary with its tail, and rps): parse failures and API errors below 0.5 %, the cost of
    a call within 5 % of the run's own earlier one (keys, baseline_cost), the 99th percentile of latency below three medians (a
    median of 0 passes), and, of the runs that are `timed`, a rate within 20 % of the planned one.

    A run without an earlier cost fails that gate (its value is null). overall: all gates of a run; whole: all gates of all runs.
    """
    n = F.col("attempted")
    cost = stats.ratio(F.col("cost_usd"), n) / F.col("baseline_cost") - 1
    late = stats.ratio(F.col("p99"), F.col("p50"))
    rows = [
        ("parse_failures", stats.ratio(F.col("parse_failures"), n), F.lit(0.005), "<", F.lit(True)), ("api_errors", stats.ratio(F.col("api_errors"), n), F.lit(0.005), "<", F.lit(True)),
        ("cost_drift", F.abs(cost), F.lit(0.05), "<=", F.lit(True)), ("latency_p99", late, F.lit(3.0), "<", F.lit(True)), ("throughput", F.abs(F.col("rps") / planned_rps - 1), F.lit(0.2), "<=", timed),
    ]
    gate = [F.struct(F.lit(g).alias("gate"), v.alias("value"), m.alias("limit"), F.coalesce((v < m) if op == "<" else (v <= m), F.lit(False)).alias("ok"), there.alias("there")) for g, v, m, op, there in rows]
    t = summary.join(baselines, list(keys), "left").select(*keys, F.explode(F.array(*gate)).alias("x")).where("x.there").select(*keys, "x.*")
    said = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    return t.select(*keys, "gate", "value", "limit", said(F.col("ok")).alias("result"), said(F.min("ok").over(Window.partitionBy(*keys))).alias("overall"), said(F.min("ok").over(ALL())).alias("whole"))


def integrity(results: DataFrame, key: str, expected: tuple[int, int]) -> DataFrame:
    """Post-run checks: rows, distinct keys, surplus, outcomes that add up, a count in the accepted range."""
    t = results.agg(F.count("*").alias("attempted"), F.count_distinct(key).alias("unique"), F.count_if("parse_ok").alias("ok"), F.count_if(~F.col("parse_ok")).alias("failed"))
    return t.withColumns({"surplus": F.col("attempted") - F.col("unique"), "adds_up": F.col("ok") + F.col("failed") == F.col("attempted"), "in_range": F.col("unique").between(*expected)})
