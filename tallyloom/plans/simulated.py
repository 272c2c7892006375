"""Inputs for the queries: raters, tags, votes and runs derived from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import longform

FIELDS = ["has_digit", "long_text", "multi_line"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    nl = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit("")))
    return read(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", nl.alias("nl"), F.col("text").rlike("[0-9]").alias("dg"))


def first(*rules: tuple[Column, str], rest: str) -> Column:
    out = F.lit(rest)
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def rules() -> dict[str, dict[str, Column]]:
    c, nl, dg, lang, i = (F.col(x) for x in ("n_chars", "nl", "dg", "lang", "doc_id"))
    nd = "not_documented"
    return {
        "A": {"long_text": first((c >= 2000, "yes"), (c < 500, "no"), rest=nd), "multi_line": first((nl >= 8, "yes"), (nl == 0, "no"), rest=nd), "has_digit": first((dg, "yes"), (lang == "en", "no"), rest=nd)},
        "B": {"long_text": first((c >= 1600, "yes"), (c < 800, "no"), rest=nd), "multi_line": first((nl >= 5, "yes"), (nl <= 1, "no"), rest=nd), "has_digit": first((dg & (i % 7 != 0), "yes"), rest=nd)},
        "C": {"long_text": first((c >= 2000, "yes"), rest=nd), "multi_line": first((nl >= 8, "yes"), (nl <= 2, nd), rest="no"), "has_digit": first((dg | (i % 7 == 1), "yes"), (lang.isin("en", "de"), "no"), rest=nd)},
    }


def answers(spark: SparkSession, sf: str, model: str = "small") -> DataFrame:
    """doc_id, rater, field, value of three raters; the full model leaves every fifth document undocumented."""
    f = facts(spark, sf)
    value = lambda v: v if model == "small" else F.when(F.col("doc_id") % 5 == 0, "not_documented").otherwise(v)
    records = F.array(*[F.struct(F.lit(r).alias("rater"), *[value(v).alias(k) for k, v in by.items()]) for r, by in rules().items()])
    return longform.unpivot(f.select("doc_id", F.explode(records).alias("x")).select("doc_id", "x.*"), FIELDS)


def wide(spark: SparkSession, sf: str, model: str = "small") -> DataFrame:
    return longform.side_by_side(answers(spark, sf, model))


def pairs(spark: SparkSession, sf: str, model: str = "small") -> DataFrame:
    return longform.pairs(wide(spark, sf, model))


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id (a user), rater, tags: the event types of a user that a rater has seen; users that all three have seen."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "ABC")), (F.col("event_id") % 3 + 1).cast("int")).alias("rater"), "event_type")
    return longform.shared(e.groupBy("doc_id", "rater").agg(F.sort_array(F.collect_set("event_type")).alias("tags")), 3)


def tag_pairs(spark: SparkSession, sf: str) -> DataFrame:
    t = tags(spark, sf).groupBy("doc_id").agg(*[F.first(F.when(F.col("rater") == r, F.col("tags")), ignorenulls=True).alias(r) for r in "ABC"])
    return longform.pairs(t, keep=("doc_id",))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    f = facts(spark, sf)
    c, nl, dg, i = (F.col(x) for x in ("n_chars", "nl", "dg", "doc_id"))
    vote = lambda pos, neg: F.when(pos, 1).when(neg, 0).otherwise(-1)
    lfs = [
        ("lf_length", "quality", "high", vote(c >= 2000, c < 300)), ("lf_lines", "quality", "high", vote(nl >= 5, nl == 0)), ("lf_digits", "quality", "high", vote(dg, i % 7 == 1)),
        ("lf_french", "french", "yes", vote(F.col("lang") == "fr", F.lit(False))), ("lf_silent", "french", "yes", F.lit(-1)), ("lf_none", "unseen", "yes", F.lit(-1)),
    ]
    some = [F.struct(F.lit(a).alias("lf_name"), F.lit(b).alias("target_field"), F.lit(t).alias("target_value"), v.alias("vote")) for a, b, t, v in lfs]
    return f.select("doc_id", F.explode(F.array(*some)).alias("x")).select("doc_id", "x.*")


def run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of calls: events as results, with tokens, latency, outcome and error text."""
    v, i = F.col("value"), F.col("event_id")
    err = F.when(i % 53 == 0, "api_error: RateLimit 429").when(i % 59 == 0, "JSONDecodeError: Unterminated string").when(i % 61 == 0, "ValidationError: literal_error").when(i % 67 == 0, "api_error: Timeout")
    return read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", (i % 9000).alias("input_tokens"), (i % 700).alias("output_tokens"), (F.abs(v) / 100 + 0.5).alias("latency_seconds"), err.alias("parse_error"), err.isNull().alias("parse_ok"))


# --- the same in SQL, for the oracles ---
FACTS = "f AS (SELECT doc_id, lang, source, n_chars, length(text) - length(replace(text, chr(10), '')) AS nl, regexp_matches(text, '[0-9]') AS dg FROM documents)"
_ND = "'not_documented'"
WIDE0 = f"""wide0 AS (
SELECT doc_id, 'long_text' AS field, CASE WHEN n_chars >= 2000 THEN 'yes' WHEN n_chars < 500 THEN 'no' ELSE {_ND} END AS a, CASE WHEN n_chars >= 1600 THEN 'yes' WHEN n_chars < 800 THEN 'no' ELSE {_ND} END AS b, CASE WHEN n_chars >= 2000 THEN 'yes' ELSE {_ND} END AS c FROM f
UNION ALL SELECT doc_id, 'multi_line', CASE WHEN nl >= 8 THEN 'yes' WHEN nl = 0 THEN 'no' ELSE {_ND} END, CASE WHEN nl >= 5 THEN 'yes' WHEN nl <= 1 THEN 'no' ELSE {_ND} END, CASE WHEN nl >= 8 THEN 'yes' WHEN nl <= 2 THEN {_ND} ELSE 'no' END FROM f
UNION ALL SELECT doc_id, 'has_digit', CASE WHEN dg THEN 'yes' WHEN lang = 'en' THEN 'no' ELSE {_ND} END, CASE WHEN dg AND doc_id % 7 <> 0 THEN 'yes' ELSE {_ND} END, CASE WHEN dg OR doc_id % 7 = 1 THEN 'yes' WHEN lang IN ('en', 'de') THEN 'no' ELSE {_ND} END FROM f)"""
WIDE = f"{FACTS}, {WIDE0}, wide AS (SELECT * FROM wide0)"
PAIRS = f"{WIDE}, pairs AS (SELECT doc_id, field, 'A_B' AS pair, a AS l, b AS r FROM wide UNION ALL SELECT doc_id, field, 'A_C', a, c FROM wide UNION ALL SELECT doc_id, field, 'B_C', b, c FROM wide)"


def kappa_sql(source: str, keys: str, out: str, weight: str = "count(*)") -> str:
    """CTEs for kappa over source(keys, l, r) into out(keys, n, agreement, kappa, pabak)."""
    on = " AND ".join(f"t.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    return f"""{out}_c AS (SELECT {keys}, l, r, {weight} AS n FROM {source} GROUP BY ALL),
{out}_t AS (SELECT {keys}, sum(n)::DOUBLE AS n, sum(CASE WHEN l = r THEN n ELSE 0 END)::DOUBLE AS agree FROM {out}_c GROUP BY ALL),
{out}_r AS (SELECT {keys}, l AS v, sum(n)::DOUBLE AS n FROM {out}_c GROUP BY ALL), {out}_k AS (SELECT {keys}, r AS v, sum(n)::DOUBLE AS n FROM {out}_c GROUP BY ALL),
{out}_e AS (SELECT {keys}, sum(x.n * y.n) AS e FROM {out}_r x JOIN {out}_k y USING ({keys}, v) GROUP BY ALL),
{out} AS (SELECT {", ".join("t." + k.strip() for k in keys.split(","))}, t.n::BIGINT AS n, t.agree / t.n AS agreement, CASE WHEN coalesce(e.e, 0) = t.n * t.n THEN 1.0 ELSE (t.n * t.agree - coalesce(e.e, 0)) / (t.n * t.n - coalesce(e.e, 0)) END AS kappa, 2 * t.agree / t.n - 1 AS pabak FROM {out}_t t LEFT JOIN {out}_e e ON {on})"""


KAPPA = f"{PAIRS}, {kappa_sql('pairs', 'field, pair', 'kap')}"
TAGS = """e AS (SELECT user_id AS doc_id, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS rater, event_type FROM events),
t0 AS (SELECT doc_id, rater, list_sort(list(DISTINCT event_type)) AS tags FROM e GROUP BY ALL),
tags AS (SELECT * FROM t0 WHERE doc_id IN (SELECT doc_id FROM t0 GROUP BY doc_id HAVING count(*) = 3)),
tp AS (SELECT x.doc_id, x.rater || '_' || y.rater AS pair, x.tags AS l, y.tags AS r FROM tags x JOIN tags y ON x.doc_id = y.doc_id AND x.rater < y.rater)"""
VOTES = f"""{FACTS}, votes AS (
SELECT doc_id, 'lf_length' AS lf_name, 'quality' AS target_field, 'high' AS target_value, CASE WHEN n_chars >= 2000 THEN 1 WHEN n_chars < 300 THEN 0 ELSE -1 END AS vote FROM f
UNION ALL SELECT doc_id, 'lf_lines', 'quality', 'high', CASE WHEN nl >= 5 THEN 1 WHEN nl = 0 THEN 0 ELSE -1 END FROM f
UNION ALL SELECT doc_id, 'lf_digits', 'quality', 'high', CASE WHEN dg THEN 1 WHEN doc_id % 7 = 1 THEN 0 ELSE -1 END FROM f
UNION ALL SELECT doc_id, 'lf_french', 'french', 'yes', CASE WHEN lang = 'fr' THEN 1 ELSE -1 END FROM f
UNION ALL SELECT doc_id, 'lf_silent', 'french', 'yes', -1 FROM f UNION ALL SELECT doc_id, 'lf_none', 'unseen', 'yes', -1 FROM f)"""
RUN = """run AS (SELECT event_id, user_id, event_type, ts, event_id % 9000 AS input_tokens, event_id % 700 AS output_tokens, abs(value) / 100 + 0.5 AS latency_seconds,
CASE WHEN event_id % 53 = 0 THEN 'api_error: RateLimit 429' WHEN event_id % 59 = 0 THEN 'JSONDecodeError: Unterminated string' WHEN event_id % 61 = 0 THEN 'ValidationError: literal_error' WHEN event_id % 67 = 0 THEN 'api_error: Timeout' END AS parse_error FROM events)"""
