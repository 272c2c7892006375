"""Queries over records with every field: the full report, audit records, smoke reports with examples, gates of large runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains, text
from ..operators import agreement, cohort, longform, quality, records, votes
from . import simulated as S
from .catalog import PAT, SUMMARY, query

BASE = ("long_text", "multi_line", "has_digit")


# ---------------------------------------------------------------- all fields of a record
def every_feature(spark: SparkSession, sf: str) -> DataFrame:
    """Records of three raters with all fields: each follows one of the raters' three answers, in a way of its own."""
    a = S.answers(spark, sf).repartition("doc_id")  # once, for what is grouped by documents later
    a = a.groupBy("doc_id", "rater").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in BASE])
    i = F.col("doc_id")
    has = [(F.col(BASE[t % 3]) == "yes") & (i % (t + 2) == 0) for t in range(len(domains.TAGS))]
    tags = F.array_compact(F.array(*[F.when(h, t) for h, t in zip(has, domains.TAGS, strict=True)]))
    three = [F.when((i + n) % (n + 5) != 0, F.col(BASE[n % 3])).alias(f) for n, f in enumerate(domains.TRISTATE_FIELDS)]

    def some(n: int, values: tuple[str, ...]):
        at = lambda k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
        return F.when(F.col(BASE[n]) == "yes", at(i)).when(F.col(BASE[n]) == "no", at(i + 1))

    enums = [some(n, v[:-1]).alias(f) for n, (f, v) in enumerate(domains.ENUMS.items())]
    return a.select("doc_id", "rater", tags.alias("admission_reason_tags"), F.coalesce(F.get(tags, 0), F.lit("unheard_of")).alias("dominant_admission_reason"), *three, *enums)


def every_answer(spark: SparkSession, sf: str) -> DataFrame:
    return longform.unpivot_features(every_feature(spark, sf))


_AT = "CASE {} % 3 WHEN 0 THEN lt WHEN 1 THEN ml ELSE hd END"
_ENUMS = " UNION ALL ".join(f"SELECT doc_id, rater, '{f}', coalesce(CASE {b} WHEN 'yes' THEN {list(v[:-1])}[doc_id % {len(v) - 1} + 1] WHEN 'no' THEN {list(v[:-1])}[(doc_id + 1) % {len(v) - 1} + 1] END, 'None'), 'enum' FROM y" for b, (f, v) in zip(("lt", "ml", "hd"), domains.ENUMS.items(), strict=True))
_EVERY = f"""x AS (SELECT doc_id, unnest(['A', 'B', 'C']) AS rater, field, unnest([a, b, c]) AS v FROM wide0),
y AS (SELECT doc_id, rater, max(v) FILTER (field = 'long_text') AS lt, max(v) FILTER (field = 'multi_line') AS ml, max(v) FILTER (field = 'has_digit') AS hd FROM x GROUP BY ALL),
tg AS (SELECT doc_id, rater, t, tag, {_AT.format("t")} = 'yes' AND doc_id % (t + 2) = 0 AS has FROM y, (SELECT unnest({list(domains.TAGS)}) AS tag, unnest(range({len(domains.TAGS)})) AS t)),
ans AS (SELECT doc_id, rater, 'admission_reason_tags:' || tag AS field, CASE WHEN has THEN 'present' ELSE 'absent' END AS value, 'tag' AS field_group FROM tg
UNION ALL SELECT doc_id, rater, 'dominant_admission_reason', coalesce(min_by(tag, t) FILTER (has), 'other'), 'dominant' FROM tg GROUP BY doc_id, rater
UNION ALL SELECT doc_id, rater, field, CASE WHEN (doc_id + n) % (n + 5) <> 0 THEN {_AT.format("n")} ELSE 'not_documented' END, 'tristate' FROM y, (SELECT unnest({list(domains.TRISTATE_FIELDS)}) AS field, unnest(range({len(domains.TRISTATE_FIELDS)})) AS n)
UNION ALL {_ENUMS}),
wide AS (SELECT doc_id, field, max(value) FILTER (rater = 'A') AS a, max(value) FILTER (rater = 'B') AS b, max(value) FILTER (rater = 'C') AS c FROM ans GROUP BY ALL)"""
_PAT = PAT.replace("wide AS (SELECT * FROM wide0)", _EVERY)
_KAPPAS = f"""pairs AS (SELECT field, 'A_B' AS pair, a AS l, b AS r FROM wide UNION ALL SELECT field, 'A_C', a, c FROM wide UNION ALL SELECT field, 'B_C', b, c FROM wide), {S.kappa_sql('pairs', 'field, pair', 'kap')},
m AS (SELECT field, max(kappa) FILTER (pair = 'A_B') AS "kappa_A_B", max(kappa) FILTER (pair = 'A_C') AS "kappa_A_C", max(kappa) FILTER (pair = 'B_C') AS "kappa_B_C", avg(kappa) AS kappa_mean, avg(pabak) AS pabak_mean, avg(agreement) AS agreement_mean FROM kap GROUP BY field),
ps AS (SELECT field, field_group, rater, count(*) FILTER (CASE field_group WHEN 'tag' THEN value = 'present' WHEN 'tristate' THEN value = 'yes' ELSE value <> 'not_documented' END) AS n FROM ans GROUP BY ALL),
po AS (SELECT field, field_group, max(n) FILTER (rater = 'A') AS na, max(n) FILTER (rater = 'B') AS nb, max(n) FILTER (rater = 'C') AS nc, sum(n)::BIGINT AS total FROM ps GROUP BY ALL)"""


@query("full_kappa_report_every_field", f"{_PAT}, {_KAPPAS} SELECT field, field_group, round(kappa_mean, 6) AS kappa_mean, round(pabak_mean, 6) AS pabak_mean, round(agreement_mean, 6) AS agreement_mean, total AS n_positive, total < 10 AS low_base_rate, kappa_mean < 0.6 AS below, CASE WHEN kappa_mean >= 0.8 THEN 'almost_perfect' WHEN kappa_mean >= 0.6 THEN 'substantial' WHEN kappa_mean >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM m JOIN po USING (field)")
def _(spark, sf):
    return agreement.full_report(every_answer(spark, sf))


def every_record(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stand for admissions: their language is the code, their source the chapter, their text what a rater says."""
    d = S.read(spark, sf, "documents")
    codes = d.select("doc_id", F.col("lang").alias("primary_code"), F.col("source").alias("chapter"))
    reasons = d.select("doc_id", F.explode(F.array(*map(F.lit, "ABC"))).alias("rater"), F.col("text").alias("reasoning"))
    return records.ballot_records(records.feature_ballots(every_feature(spark, sf)), codes, reasons)


@query("audit_records", f"""{SUMMARY.replace(PAT, _PAT)}, {_KAPPAS}, pn AS (SELECT field, a, b, c, count(*) AS n FROM p WHERE pattern <> 'all_equal' GROUP BY ALL), ex AS (SELECT field, least(sum(n), 10)::BIGINT AS n_examples FROM (SELECT * FROM pn QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC) <= 5) GROUP BY field)
SELECT CASE WHEN field_group = 'tag' THEN 'admission_reason_tags' ELSE field END AS field, CASE WHEN field_group = 'tag' THEN substr(field, 23) END AS target_value, CASE WHEN field_group = 'tag' THEN 'admission_tag' ELSE field_group END AS field_type,
round("kappa_A_B", 6) AS "kappa_A_B", round("kappa_A_C", 6) AS "kappa_A_C", round("kappa_B_C", 6) AS "kappa_B_C", round(kappa_mean, 6) AS kappa_mean, round(pabak_mean, 6) AS pabak_mean, round(agreement_mean, 6) AS agreement_mean,
na AS "n_positive_A", nb AS "n_positive_B", nc AS "n_positive_C", total AS n_positive_total, total < 10 AS low_base_rate, disagreements AS disagreement_count, summary AS disagreement_pattern_summary, n_examples FROM su JOIN m USING (field) JOIN po USING (field) JOIN ex USING (field)""")
def _(spark, sf):
    return every_record(spark, sf).withColumn("n_examples", F.size("examples")).drop("examples")


# ---------------------------------------------------------------- smoke reports
def _smoke(spark, sf):
    """A function over text (any digit) against three raters' answers to three fields."""
    d = S.read(spark, sf, "documents").select("doc_id", F.col("text").rlike("[0-9]").alias("dg"), "text", "source")
    return S.answers(spark, sf).join(d, "doc_id"), ["field", "rater"], F.col("dg"), F.col("value") == "yes"


_FIRED = f"WITH {S.WIDE}, x AS (SELECT doc_id, field, unnest(['A', 'B', 'C']) AS rater, unnest([a, b, c]) = 'yes' AS m FROM wide), s AS (SELECT x.*, coalesce(regexp_matches(text, '[0-9]'), false) AS dg, text, source FROM x JOIN documents USING (doc_id))"


@query("smoke_rates", f"{_FIRED}, g AS (SELECT field, rater, count(*) AS n, count(*) FILTER (dg) AS fired, count(*) FILTER (m) AS model_yes, count(*) FILTER (dg AND m) AS shared FROM s GROUP BY ALL) SELECT *, round(100.0 * fired / n, 6)::DOUBLE AS fired_pct, CASE WHEN fired > 0 THEN round(100.0 * shared / fired, 6)::DOUBLE ELSE 0.0 END AS agreement_pct, CASE WHEN model_yes > 0 THEN round(100.0 * shared / model_yes, 6)::DOUBLE ELSE 0.0 END AS recall_pct FROM g")
def _(spark, sf):
    return votes.smoke_rates(*_smoke(spark, sf))


@query("smoke_examples", f"{_FIRED}, r AS (SELECT field, rater, CASE WHEN dg THEN 'false_hit' ELSE 'miss' END AS kind, doc_id, CASE WHEN dg THEN text ELSE source END AS said, row_number() OVER (PARTITION BY field, rater, dg ORDER BY doc_id) AS place FROM s WHERE dg <> m) SELECT field, rater, kind, place, doc_id, substr(trim(regexp_replace(coalesce(said, ''), '\\s+', ' ', 'g')), 1, 300) AS excerpt FROM r WHERE place <= 10")
def _(spark, sf):
    return votes.smoke_examples(*_smoke(spark, sf), F.col("text"), F.col("source"))


# ---------------------------------------------------------------- gates of large runs
_LARGE = f"""WITH {S.RUN}, l AS (SELECT event_type AS run_id, count(*) AS n, count(*) FILTER (parse_error NOT LIKE 'api_error:%') AS pf, count(*) FILTER (parse_error LIKE 'api_error:%') AS ae, quantile_cont(latency_seconds, 0.5) AS p50, quantile_cont(latency_seconds, 0.99) AS p99, sum(input_tokens) / 1e6 * 0.2 + sum(output_tokens) / 1e6 * 1.25 AS cost, (epoch_ms(max(ts)) - epoch_ms(min(ts))) / 1000.0 AS secs FROM run GROUP BY ALL),
b AS (SELECT event_type AS run_id, (sum(input_tokens) / 1e6 * 0.2 + sum(output_tokens) / 1e6 * 1.25) / count(*) AS baseline_cost FROM run WHERE event_id % 2 = 0 GROUP BY ALL),
r AS (SELECT l.*, baseline_cost, CASE WHEN secs > 0 THEN n / secs ELSE 0 END AS rps FROM l LEFT JOIN b USING (run_id)),
g AS (SELECT run_id, 'parse_failures' AS gate, pf / n AS value, 0.005::DOUBLE AS "limit", pf / n < 0.005 AS ok FROM r UNION ALL SELECT run_id, 'api_errors', ae / n, 0.005, ae / n < 0.005 FROM r UNION ALL SELECT run_id, 'cost_drift', abs(cost / n / baseline_cost - 1), 0.05, coalesce(abs(cost / n / baseline_cost - 1) <= 0.05, false) FROM r
UNION ALL SELECT run_id, 'latency_p99', p99 / p50, 3.0, p99 / p50 < 3 FROM r UNION ALL SELECT run_id, 'throughput', abs(rps / 0.001 - 1), 0.2, abs(rps / 0.001 - 1) <= 0.2 FROM r WHERE run_id < 'f')"""


@query("strict_gates", f"{_LARGE} SELECT run_id, gate, round(value, 6) AS value, \"limit\", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN min(ok::INT) OVER (PARTITION BY run_id) = 1 THEN 'PASS' ELSE 'FAIL' END AS overall, CASE WHEN min(ok::INT) OVER () = 1 THEN 'PASS' ELSE 'FAIL' END AS whole FROM g")
def _(spark, sf):
    """Kinds of events are runs; every second call of one stands for its earlier run. Runs up to e are timed."""
    run = S.run(spark, sf).withColumn("run_id", F.col("event_type"))
    span = run.groupBy("run_id").agg((F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("ms"))
    t = quality.run_summary(run, ["run_id"], tail=True).join(span, "run_id").withColumn("rps", F.when(F.col("ms") > 0, F.col("attempted") / (F.col("ms") / 1000)).otherwise(0.0))
    early = quality.run_summary(run.where("event_id % 2 = 0"), ["run_id"]).select("run_id", (F.col("cost_usd") / F.col("attempted")).alias("baseline_cost"))
    return quality.strict_gates(t, early, 0.001, F.col("run_id") < "f")


# ---------------------------------------------------------------- replies, determinism
@query("json_replies", "SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN coalesce(role, '') || coalesce(text, '') WHEN 0 THEN text ELSE role END AS content FROM conversations")
def _(spark, sf):
    """Turns as a model's replies (a string, a list of texts, or a record amid words), and what is read from them."""
    one = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    listed = F.array(F.struct(F.col("role").alias("text")), F.struct(F.col("text").alias("text")))
    amid = F.concat(F.lit("Here it is: "), F.to_json(F.struct(F.struct("role").alias("record"))), F.lit(" - done"))
    kind = F.col("turn") % 3
    content = F.when(kind == 0, text.message_content(one(F.col("text")))).when(kind == 1, text.message_content(one(listed))).otherwise(F.get_json_object(text.json_slice(amid), "$.record.role"))
    return S.read(spark, sf, "conversations").select("conv_id", "turn", content.alias("content"))


@query("differing_rows", "WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 1), t AS (SELECT lang, source, 1 AS s FROM a UNION ALL SELECT lang, source, -1 FROM b) SELECT lang, source, sum(s)::BIGINT AS surplus FROM t GROUP BY ALL HAVING sum(s) <> 0")
def _(spark, sf):
    d = S.read(spark, sf, "documents")
    a, b = (d.where(F.col("doc_id") % 2 == i).select("lang", "source") for i in (0, 1))
    return cohort.difference(a, b)
