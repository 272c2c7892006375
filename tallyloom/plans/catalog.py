"""All queries over the reference's operators, by name, with their SQL. Doubles are rounded to 6 digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import domains, labels, stats, text
from ..operators import agreement, audit, cohort, embedding, label_matrix, longform, quality, resample, sections, votes
from . import simulated as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = f(spark, sf)
            return df.select(*[F.round(c, 6).alias(c) if isinstance(k.dataType, T.DoubleType) else F.col(c).cast("long").alias(c) if isinstance(k.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(c) for c, k in zip(df.columns, df.schema, strict=True)])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


FP = ["field", "pair"]


# ---------------------------------------------------------------- agreement
@query("pairwise_kappa", f"WITH {S.KAPPA} SELECT field, pair, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, round(pabak, 6) AS pabak FROM kap")
def _(spark, sf):
    return agreement.kappa(agreement.contingency(S.pairs(spark, sf), FP), FP)


MEAN = f"""WITH {S.KAPPA}, m AS (SELECT field, avg(kappa) AS kappa_mean, avg(pabak) AS pabak_mean, avg(agreement) AS agreement_mean FROM kap GROUP BY field),
p AS (SELECT field, sum((a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT)::BIGINT AS n_positive FROM wide GROUP BY field),
rep AS (SELECT m.*, n_positive, n_positive < 10 AS low_base_rate, kappa_mean < 0.6 AS below, CASE WHEN kappa_mean >= 0.8 THEN 'almost_perfect' WHEN kappa_mean >= 0.6 THEN 'substantial' WHEN kappa_mean >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM m JOIN p USING (field))"""


def _report(spark, sf):
    a = S.answers(spark, sf)
    w = longform.side_by_side(a)
    return agreement.report(a, w, longform.pairs(w))


@query("kappa_report", f"{MEAN} SELECT field, round(kappa_mean, 6) AS kappa_mean, round(pabak_mean, 6) AS pabak_mean, round(agreement_mean, 6) AS agreement_mean, n_positive, low_base_rate, below, band FROM rep")
def _(spark, sf):
    return _report(spark, sf)


@query("filtered_median_kappa", f"{MEAN} SELECT round(median(kappa_mean), 6) AS median_kappa, count(*) AS n_fields FROM rep WHERE NOT low_base_rate")
def _(spark, sf):
    return agreement.filtered_median(_report(spark, sf))


@query("rater_median_kappa", f"WITH {S.KAPPA}, x AS (SELECT field, unnest(string_split(pair, '_')) AS rater, kappa FROM kap), y AS (SELECT field, rater, avg(kappa) AS k FROM x GROUP BY ALL) SELECT rater, round(median(k), 6) AS median_kappa FROM y GROUP BY rater")
def _(spark, sf):
    return agreement.rater_medians(agreement.kappa(agreement.contingency(S.pairs(spark, sf), FP), FP))


FULL = S.WIDE.replace("wide AS (SELECT * FROM wide0)", "wide AS (SELECT 'small' AS model, * FROM wide0 UNION ALL SELECT 'full', doc_id, field, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE a END, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE b END, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE c END FROM wide0)")
FULL_KAPPA = f"""{FULL}, pairs AS (SELECT model, field, 'A_B' AS pair, a AS l, b AS r FROM wide UNION ALL SELECT model, field, 'A_C', a, c FROM wide UNION ALL SELECT model, field, 'B_C', b, c FROM wide), {S.kappa_sql('pairs', 'model, field, pair', 'kap')}"""


def _models(spark, sf, collapsed=False):
    p = S.pairs(spark, sf).withColumn("model", F.lit("small")).unionByName(S.pairs(spark, sf, "full").withColumn("model", F.lit("full")))
    if collapsed:
        p = p.withColumns({"left": labels.collapse(F.col("left")), "right": labels.collapse(F.col("right"))})
    keys = ["model", *FP]
    return agreement.kappa(agreement.contingency(p, keys), keys)


@query("pooled_kappa", f"WITH {FULL_KAPPA} SELECT model, round(median(kappa), 6) AS median_kappa FROM kap GROUP BY model")
def _(spark, sf):
    return _models(spark, sf).groupBy("model").agg(F.median("kappa").alias("median_kappa"))


@query("pooled_kappa_collapsed", f"WITH {FULL_KAPPA.replace('FROM wide UNION ALL', 'FROM w2 UNION ALL').replace('b, c FROM wide)', 'b, c FROM w2)').replace('pairs AS (', 'w2 AS (SELECT model, field, CASE WHEN a = $$yes$$ THEN a ELSE $$n$$ END AS a, CASE WHEN b = $$yes$$ THEN b ELSE $$n$$ END AS b, CASE WHEN c = $$yes$$ THEN c ELSE $$n$$ END AS c FROM wide), pairs AS (', 1)} SELECT model, round(median(kappa), 6) AS median_kappa FROM kap GROUP BY model")
def _(spark, sf):
    return _models(spark, sf, True).groupBy("model").agg(F.median("kappa").alias("median_kappa"))


@query("model_size_delta", f"WITH {FULL_KAPPA}, d AS (SELECT field, pair, 100 * (max(CASE WHEN model = 'full' THEN kappa END) - max(CASE WHEN model = 'small' THEN kappa END)) AS d FROM kap GROUP BY ALL) SELECT field, round(median(d), 6) AS delta_pp FROM d GROUP BY field")
def _(spark, sf):
    return agreement.model_delta(_models(spark, sf))


CROSS = f"""WITH {FULL}, x AS (SELECT model, doc_id, field, unnest(['A', 'B', 'C']) AS rater, unnest([a, b, c]) AS v FROM wide),
p AS (SELECT s.field, s.rater, s.v AS l, f2.v AS r FROM x s JOIN x f2 ON s.doc_id = f2.doc_id AND s.field = f2.field AND s.rater = f2.rater AND s.model = 'small' AND f2.model = 'full'), {S.kappa_sql('p', 'field, rater', 'kap')}"""


def _cross(spark, sf):
    a, b = S.answers(spark, sf), S.answers(spark, sf, "full")
    return a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), ["doc_id", "rater", "field"])


@query("cross_model_kappa", f"{CROSS} SELECT rater, round(median(kappa), 6) AS median_kappa FROM kap GROUP BY rater")
def _(spark, sf):
    keys = ["field", "rater"]
    return agreement.kappa(agreement.contingency(_cross(spark, sf), keys), keys).groupBy("rater").agg(F.median("kappa").alias("median_kappa"))


def wilson_sql(k: str, n: str) -> str:
    z = stats.Z95
    d, m = f"(1 + {z} * {z} / {n})", f"({k} / {n} + {z} * {z} / (2 * {n}))"
    h = f"({z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})))"
    return f"round(CASE WHEN {n} > 0 THEN greatest(({m} - {h}) / {d}, 0) ELSE 0 END, 6) AS low, round(CASE WHEN {n} > 0 THEN least(({m} + {h}) / {d}, 1) ELSE 0 END, 6) AS high"


@query("gold_agreement", f"{CROSS} SELECT field, rater, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, round(pabak, 6) AS pabak, round(agreement * n)::BIGINT AS hits, {wilson_sql('(agreement * n)', 'n::DOUBLE')} FROM kap")
def _(spark, sf):
    return agreement.gold(_cross(spark, sf), ["field", "rater"])


@query("confusion_matrix", f"WITH {S.PAIRS}, c AS (SELECT field, pair, l, r, count(*) AS n FROM pairs GROUP BY ALL) SELECT field, pair, l AS \"left\", r AS \"right\", n, round(n / sum(n) OVER (PARTITION BY field, pair, l), 6) AS row_share, round(sum(CASE WHEN l = r THEN n ELSE 0 END) OVER (PARTITION BY field, pair) / sum(n) OVER (PARTITION BY field, pair), 6) AS diagonal_share FROM c")
def _(spark, sf):
    return agreement.confusion(S.pairs(spark, sf), FP, list(domains.TRISTATE))


@query("confusion_dense", f"WITH {S.PAIRS}, c AS (SELECT field, pair, l, r, count(*) AS n FROM pairs GROUP BY ALL), k AS (SELECT DISTINCT field, pair FROM c), d AS (SELECT unnest(['yes', 'no', 'not_documented']) AS v) SELECT k.field, k.pair, a.v AS \"left\", b.v AS \"right\", coalesce(n, 0)::BIGINT AS n FROM k CROSS JOIN d a CROSS JOIN d b LEFT JOIN c ON c.field = k.field AND c.pair = k.pair AND c.l = a.v AND c.r = b.v")
def _(spark, sf):
    return agreement.dense(agreement.confusion(S.pairs(spark, sf), FP), FP, list(domains.TRISTATE))


@query("most_confused_labels", f"WITH {S.PAIRS}, c AS (SELECT pair, l, sum((l = r)::INT) AS same, count(*) AS n FROM pairs GROUP BY ALL), w AS (SELECT l, avg(1 - same / n) AS confusion, sum(n)::BIGINT AS support FROM c GROUP BY l) SELECT l AS \"left\", round(confusion, 6) AS confusion, support FROM w WHERE support >= 10 ORDER BY confusion DESC, support DESC, l LIMIT 2")
def _(spark, sf):
    return agreement.most_confused(agreement.confusion(S.pairs(spark, sf), FP), 10, 2)


X9 = "CASE WHEN l = r THEN 'full_agreement' WHEN l IN ('no', 'not_documented') AND r IN ('no', 'not_documented') THEN 'soft_no_nd' WHEN l IN ('yes', 'not_documented') AND r IN ('yes', 'not_documented') THEN 'soft_yes_nd' ELSE 'hard_yes_no' END"
DEC = f"WITH {S.PAIRS}, d AS (SELECT field, pair, {X9} AS original, CASE WHEN (l = 'yes') = (r = 'yes') THEN 'full_agreement' ELSE 'disagreement' END AS collapsed, count(*) AS n FROM pairs GROUP BY ALL)"


@query("disagreement_decomposition", f"{DEC} SELECT field, pair, original, collapsed, n FROM d")
def _(spark, sf):
    return agreement.decomposition(S.pairs(spark, sf), FP)


@query("dissolved_disagreements", f"{DEC}, g AS (SELECT field, sum(CASE WHEN original <> 'full_agreement' THEN n ELSE 0 END)::BIGINT AS disagreements, sum(CASE WHEN original = 'soft_no_nd' AND collapsed = 'full_agreement' THEN n ELSE 0 END)::BIGINT AS dissolved FROM d GROUP BY field) SELECT field, disagreements, dissolved, greatest(disagreements - dissolved, 0) AS preserved, round(CASE WHEN disagreements > 0 THEN 100 * dissolved / disagreements ELSE 0 END, 6) AS dissolved_pct, round(CASE WHEN disagreements > 0 THEN 100 * greatest(disagreements - dissolved, 0) / disagreements ELSE 0 END, 6) AS preserved_pct FROM g")
def _(spark, sf):
    return agreement.dissolved(agreement.decomposition(S.pairs(spark, sf), FP), ["field"])


COLL = f"WITH {S.PAIRS}, p2 AS (SELECT field, pair, CASE WHEN l = 'yes' THEN 'yes' ELSE 'not_yes' END AS l, CASE WHEN r = 'yes' THEN 'yes' ELSE 'not_yes' END AS r FROM pairs), {S.kappa_sql('p2', 'field, pair', 'kap')}"


@query("collapsed_kappa", f"{COLL} SELECT field, pair, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, round(pabak, 6) AS pabak FROM kap")
def _(spark, sf):
    return agreement.valid_kappa(S.pairs(spark, sf), FP, collapsed=True)


PAT = f"WITH {S.WIDE}, p AS (SELECT *, CASE WHEN a = b AND b = c THEN 'all_equal' WHEN a = b THEN 'a=b!=c' WHEN a = c THEN 'a=c!=b' WHEN b = c THEN 'b=c!=a' ELSE 'all_different' END AS pattern FROM wide)"


@query("vote_patterns", f"{PAT} SELECT field, pattern, count(*) AS n FROM p GROUP BY ALL")
def _(spark, sf):
    w = S.wide(spark, sf)
    return w.groupBy("field", labels.vote_pattern(F.col("A"), F.col("B"), F.col("C"))["pattern"].alias("pattern")).agg(F.count("*").alias("n"))


@query("kappa_shift", f"WITH {FULL_KAPPA}, m AS (SELECT model, field, avg(kappa) AS k FROM kap GROUP BY ALL), j AS (SELECT s.field, s.k AS before, g.k AS after FROM m s JOIN m g ON s.field = g.field AND s.model = 'small' AND g.model = 'full') SELECT field, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta, CASE WHEN after - before >= -0.02 THEN 'good' WHEN after - before >= -0.05 THEN 'modest' ELSE 'poor' END AS verdict FROM j")
def _(spark, sf):
    m = agreement.mean_over_pairs(_models(spark, sf), ["model", "field"])
    return agreement.shifts(m.where("model = 'small'"), m.where("model = 'full'"), "kappa_mean")


@query("on_off_disagreement", f"{CROSS} SELECT field, count(*) AS n, sum((l IS DISTINCT FROM r)::INT)::BIGINT AS changed FROM p GROUP BY field")
def _(spark, sf):
    on = S.answers(spark, sf).groupBy("doc_id", "rater").pivot("field", S.FIELDS).agg(F.first("value"))
    off = S.answers(spark, sf, "full").groupBy("doc_id", "rater").pivot("field", S.FIELDS).agg(F.first("value"))
    j = longform.on_off(on, off, ["doc_id", "rater"], S.FIELDS)
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (~F.col(f"{f}_on").eqNullSafe(F.col(f"{f}_off"))).alias("changed")) for f in S.FIELDS])
    return j.select(F.explode(rows).alias("x")).groupBy("x.field").agg(F.count("*").alias("n"), F.count_if("x.changed").alias("changed"))


@query("label_precision_recall", f"WITH {S.FACTS}, j AS (SELECT n_chars >= 2000 AS p, quality = 1 AS a FROM f JOIN labels USING (doc_id)), g AS (SELECT sum((p AND a)::INT)::BIGINT AS tp, sum((p AND NOT a)::INT)::BIGINT AS fp, sum((NOT p AND a)::INT)::BIGINT AS fn, sum((NOT p AND NOT a)::INT)::BIGINT AS tn FROM j), h AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM g) SELECT tp, fp, fn, tn, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn > 0 THEN fp / (tp + fp + fn) ELSE 0 END, 6) AS unique_capture FROM h")
def _(spark, sf):
    j = S.facts(spark, sf).join(S.read(spark, sf, "labels"), "doc_id")
    return agreement.precision_recall(j, [], F.col("n_chars") >= 2000, F.col("quality") == 1)


@query("label_confusion", f"WITH {S.FACTS}, c AS (SELECT CASE WHEN n_chars >= 2000 THEN '1' ELSE '0' END AS l, quality::VARCHAR AS r, count(*) AS n FROM f JOIN labels USING (doc_id) GROUP BY ALL) SELECT 'quality' AS field, l AS \"left\", r AS \"right\", n, round(n / sum(n) OVER (PARTITION BY l), 6) AS row_share, round(sum(CASE WHEN l = r THEN n ELSE 0 END) OVER () / sum(n) OVER (), 6) AS diagonal_share FROM c")
def _(spark, sf):
    j = S.facts(spark, sf).join(S.read(spark, sf, "labels"), "doc_id")
    return agreement.confusion(j.select(F.lit("quality").alias("field"), F.when(F.col("n_chars") >= 2000, "1").otherwise("0").alias("left"), F.col("quality").cast("string").alias("right")), ["field"])


@query("spearman_rank", "WITH g AS (SELECT source, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY source), k AS (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS b FROM g) SELECT round(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 6) AS rho, count(*) AS n FROM k")
def _(spark, sf):
    return agreement.spearman(S.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m")), "n", "m")


# ---------------------------------------------------------------- tags
@query("tag_jaccard", f"WITH {S.TAGS} SELECT pair, round(avg(CASE WHEN len(l) + len(r) = 0 THEN 1 ELSE len(list_intersect(l, r)) / len(list_distinct(list_concat(l, r))) END), 6) AS jaccard, count(*) AS n FROM tp GROUP BY pair")
def _(spark, sf):
    return S.tag_pairs(spark, sf).groupBy("pair").agg(F.avg(agreement.jaccard(F.col("left"), F.col("right"))).alias("jaccard"), F.count("*").alias("n"))


@query("multilabel_confusion", f"WITH {S.TAGS}, d AS (SELECT pair, unnest(list_intersect(l, r)) AS l, NULL AS r FROM tp), o AS (SELECT pair, unnest(list_filter(l, lambda x: NOT list_contains(r, x))) AS l, list_filter(r, lambda x: NOT list_contains(l, x)) AS rr FROM tp), o2 AS (SELECT pair, l, unnest(rr) AS r FROM o), b AS (SELECT pair, l, l AS r FROM d UNION ALL SELECT pair, l, r FROM o2) SELECT pair, l AS \"left\", r AS \"right\", count(*) AS n FROM b GROUP BY ALL")
def _(spark, sf):
    return agreement.multilabel_confusion(S.tag_pairs(spark, sf), ["pair"])


EVENT_TAGS = ["click", "error", "purchase", "signup", "view"]


@query("tag_prevalence", f"WITH {S.TAGS}, x AS (SELECT unnest(tags) AS tag FROM tags WHERE rater = 'A'), h AS (SELECT tag, count(*) AS hits FROM x GROUP BY tag), v AS (SELECT unnest({EVENT_TAGS + ['unused']}) AS tag, unnest([0, 1, 2, 3, 4, 5]) AS tag_index), d AS (SELECT count(*) AS docs FROM tags WHERE rater = 'A') SELECT v.tag, tag_index::BIGINT AS tag_index, coalesce(hits, 0)::BIGINT AS hits, round(coalesce(hits / docs, 0), 6) AS prevalence, round(coalesce(hits / sum(hits) OVER (), 0), 6) AS share FROM v LEFT JOIN h ON v.tag = h.tag CROSS JOIN d")
def _(spark, sf):
    vocabulary = spark.createDataFrame([(t, i) for i, t in enumerate([*EVENT_TAGS, "unused"])], "tag string, tag_index int")
    return quality.tag_prevalence(S.tags(spark, sf).where("rater = 'A'"), vocabulary)


@query("tags_per_note", f"WITH {S.TAGS} SELECT rater, round(avg(len(tags)), 6) AS mean, round(quantile_cont(len(tags)::DOUBLE, 0.75), 6) AS p75, max(len(tags)) AS most FROM tags GROUP BY rater")
def _(spark, sf):
    return quality.tag_counts(S.tags(spark, sf), ("rater",))


@query("residual_share", f"WITH {S.TAGS}, x AS (SELECT rater, unnest(tags) AS tag FROM tags), g AS (SELECT rater, avg((tag IN ('error', 'signup'))::INT) AS s FROM x GROUP BY rater) SELECT round(avg(s), 6) AS mean_share FROM g")
def _(spark, sf):
    return quality.residual_share(S.tags(spark, sf), ["error", "signup"])


@query("tag_confusion_rate", f"WITH {S.TAGS}, x AS (SELECT doc_id, pair, unnest(list_distinct(list_concat(l, r))) AS tag, l, r FROM tp), d AS (SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT pair) AS np FROM tp), g AS (SELECT tag, sum((list_contains(l, tag) <> list_contains(r, tag))::INT) AS apart, count(DISTINCT doc_id) AS anyd FROM x GROUP BY tag) SELECT tag, round(100 * (apart / np / docs) / (anyd / docs), 6) AS confusion_rate FROM g CROSS JOIN d")
def _(spark, sf):
    return quality.tag_confusion(S.tag_pairs(spark, sf), EVENT_TAGS)


@query("base_rate_divergence", f"WITH {S.WIDE}, x AS (SELECT field, unnest(['A', 'B', 'C']) AS rater, unnest([a, b, c]) AS value FROM wide), g AS (SELECT field, value, rater, count(*) / sum(count(*)) OVER (PARTITION BY field, rater) AS rate FROM x GROUP BY field, value, rater), w AS (SELECT field, value, coalesce(max(CASE WHEN rater = 'A' THEN rate END), 0) AS \"A\", coalesce(max(CASE WHEN rater = 'B' THEN rate END), 0) AS \"B\", coalesce(max(CASE WHEN rater = 'C' THEN rate END), 0) AS \"C\" FROM g GROUP BY ALL) SELECT field, value, round(\"A\", 6) AS \"A\", round(\"B\", 6) AS \"B\", round(\"C\", 6) AS \"C\", round(greatest(\"A\", \"B\", \"C\") - least(\"A\", \"B\", \"C\"), 6) AS divergence FROM w")
def _(spark, sf):
    return quality.base_rates(S.answers(spark, sf))


# ---------------------------------------------------------------- cohort
@query("primary_event_rank", "WITH w AS (SELECT user_id, event_id, event_type, ts, count(*) OVER (PARTITION BY user_id) AS n_events, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'signup')::INT DESC, ts, event_id) AS rn FROM events) SELECT user_id, event_id, event_type, n_events FROM w WHERE rn = 1")
def _(spark, sf):
    from pyspark.sql import Window

    e = S.read(spark, sf, "events").withColumn("n_events", F.count("*").over(Window.partitionBy("user_id")))
    return longform.first_of(e, "user_id", [F.when(F.col("event_type") == "signup", 0).otherwise(1), F.asc("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type", "n_events")


@query("primary_code", "WITH c AS (SELECT l_orderkey AS k, l_partkey::VARCHAR AS code, l_linenumber AS seq, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN '9' ELSE '10' END AS version FROM lineitem), w AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_codes, row_number() OVER (PARTITION BY k ORDER BY (seq = 1)::INT DESC, seq, code, version NULLS FIRST) AS rn FROM c) SELECT k, code, version::BIGINT AS version, n_codes FROM w WHERE rn = 1 AND version IS NOT NULL")
def _(spark, sf):
    c = S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").cast("string").alias("code"), F.col("l_linenumber").cast("string").alias("seq_num"), F.when(F.col("l_linenumber") % 3 == 0, None).when(F.col("l_partkey") % 2 == 0, "9").otherwise("10").alias("version"))
    return cohort.primary_code(c, "k").select("k", "code", "version", "n_codes")


@query("dedup_first", "WITH w AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_type, event_id FROM w WHERE rn = 1")
def _(spark, sf):
    return longform.first_of(S.read(spark, sf, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("dedup_last", "WITH w AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_type, event_id FROM w WHERE rn = 1")
def _(spark, sf):
    return longform.first_of(S.read(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("override_merge", "WITH b AS (SELECT o_orderkey AS k, 'base' AS origin FROM orders), l AS (SELECT o_orderkey AS k, 'later' AS origin FROM orders WHERE o_orderkey % 3 = 0) SELECT * FROM l UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM l)")
def _(spark, sf):
    o = S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    return longform.override(o.withColumn("origin", F.lit("base")), o.where("k % 3 = 0").withColumn("origin", F.lit("later")), "k")


@query("join_audit", "SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS left_keys, (SELECT count(*) FROM customer) AS right_rows, (SELECT count(DISTINCT c_custkey) FROM customer) AS right_keys, (SELECT count(*) FROM orders WHERE o_custkey IS NULL OR o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)) AS orphans")
def _(spark, sf):
    return cohort.join_audit(S.read(spark, sf, "orders"), S.read(spark, sf, "customer"), "o_custkey", "c_custkey")


@query("duplicate_audit", "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT sum(n)::BIGINT AS \"rows\", count(*) AS keys, sum((n > 1)::INT)::BIGINT AS repeated_keys, sum(n - 1)::BIGINT AS surplus_rows FROM g")
def _(spark, sf):
    t = S.read(spark, sf, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber"))
    return cohort.duplicate_audit(t, "k")


@query("top_codes", "WITH g AS (SELECT l_partkey AS code, count(*) AS n FROM lineitem GROUP BY ALL) SELECT code, n, coalesce(p_type, '') AS title FROM g LEFT JOIN part ON p_partkey = code ORDER BY n DESC, code LIMIT 20")
def _(spark, sf):
    codes = S.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"))
    return cohort.top_codes(codes, S.read(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("title")), 20)


@query("distinct_keys", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL ORDER BY 1")
def _(spark, sf):
    return S.read(spark, sf, "orders").select("o_custkey").where("o_custkey is not null").distinct().orderBy("o_custkey")


@query("anti_filter", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    o = S.read(spark, sf, "orders").select("o_orderkey")
    return cohort.without(o, S.read(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("id_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, sf):
    ids = S.read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return cohort.within(S.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ids, "o_orderkey")


@query("split_overlap", "WITH s AS (SELECT doc_id % 2 = 0 AS a, doc_id % 3 = 0 AS b, doc_id % 5 = 0 AS c FROM documents) SELECT 'a' AS a, 'b' AS b, sum((a AND b)::INT)::BIGINT AS shared FROM s UNION ALL SELECT 'a', 'c', sum((a AND c)::INT)::BIGINT FROM s UNION ALL SELECT 'b', 'c', sum((b AND c)::INT)::BIGINT FROM s")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select("doc_id")
    return cohort.overlap({"a": d.where("doc_id % 2 = 0"), "b": d.where("doc_id % 3 = 0"), "c": d.where("doc_id % 5 = 0")}, "doc_id")


@query("random_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('7|' || doc_id::VARCHAR), doc_id LIMIT 100")
def _(spark, sf):
    return cohort.sample(S.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


QUOTA = "g AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), x AS (SELECT lang, size, size * 100 / sum(size) OVER () AS exact FROM g), y AS (SELECT *, floor(exact) AS fl FROM x), q AS (SELECT lang, size, (fl + (row_number() OVER (ORDER BY round(exact - fl, 9) DESC, lang) <= 100 - sum(fl) OVER ())::INT)::BIGINT AS quota FROM y)"


@query("largest_remainder", f"WITH {QUOTA} SELECT lang, size, quota FROM q")
def _(spark, sf):
    return cohort.largest_remainder(S.read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("size")), "lang", "size", 100)


@query("stratified_sample", f"WITH {QUOTA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11|' || doc_id::VARCHAR), doc_id) AS rn FROM documents) SELECT lang, doc_id FROM r JOIN q USING (lang) WHERE rn <= quota")
def _(spark, sf):
    return cohort.stratified(S.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "lang", 100, 11)


@query("stratum_balance", f"WITH {QUOTA}, p AS (SELECT lang, 100.0 * size / sum(size) OVER () AS pp FROM g), s AS (SELECT lang, 100.0 * quota / sum(quota) OVER () AS sp FROM q) SELECT lang, round(pp::DOUBLE, 6) AS population_pct, round(sp::DOUBLE, 6) AS sample_pct, round(abs(pp - sp)::DOUBLE, 6) AS delta_pp, abs(pp - sp) <= 2 AS within FROM p JOIN s USING (lang)")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select("doc_id", "lang")
    return cohort.balance(d, cohort.stratified(d, "doc_id", "lang", 100, 11), "lang")


CODES = "codes AS (SELECT p_partkey AS doc_id, substr(p_brand, 1, 1) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END AS code, CASE WHEN p_partkey % 5 = 0 THEN 9 ELSE 10 END AS version FROM part UNION ALL SELECT p_partkey, lpad((p_partkey % 1000)::VARCHAR, 3, '0') || '.' || (p_partkey % 10)::VARCHAR, 9 FROM part)"


def _codes(spark, sf):
    p = S.read(spark, sf, "part")
    k = F.col("p_partkey")
    a = p.select(k.alias("doc_id"), F.concat(F.substring("p_brand", 1, 1), F.lpad((k % 100).cast("string"), 2, "0"), F.when(k % 2 == 0, ".1").otherwise("")).alias("code"), F.when(k % 5 == 0, 9).otherwise(10).alias("version"), F.lit(1).alias("ord"))
    return a.unionByName(p.select(k.alias("doc_id"), F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("."), (k % 10).cast("string")).alias("code"), F.lit(9).alias("version"), F.lit(2).alias("ord")))


def chapter_sql() -> str:
    c = "upper(trim(replace(code, '.', '')))"
    key = f"CASE WHEN version = 10 THEN CASE WHEN regexp_matches({c}, '^[A-Z][0-9][0-9]') THEN substr({c}, 1, 3) END ELSE CASE WHEN substr({c}, 1, 1) IN ('V', 'E') THEN substr({c}, 1, 1) WHEN regexp_matches({c}, '^[0-9][0-9][0-9]') THEN substr({c}, 1, 3) END END"
    rows = ", ".join(f"({v}, '{a}', '{b}', '{n}')" for v, a, b, n in domains.CHAPTERS)
    return f"ch(version, a, b, chapter) AS (VALUES {rows}), keyed AS (SELECT *, {key} AS k FROM codes)"


@query("code_chapter", f"WITH {CODES}, {chapter_sql()} SELECT coalesce(chapter, 'ZZ. Unmapped') AS chapter, count(*) AS n FROM keyed LEFT JOIN ch ON keyed.version = ch.version AND k BETWEEN a AND b GROUP BY ALL")
def _(spark, sf):
    return _codes(spark, sf).groupBy(text.chapter(F.col("code"), F.col("version")).alias("chapter")).agg(F.count("*").alias("n"))


LF_ROWS = [("lf_brand", "brand", "yes", "any", 10, "B1"), ("lf_exact", "exact", "yes", "any", 9, "017.7"), ("lf_low", "low", "yes", "primary_only", 9, "0"), ("lf_low", "low", "yes", "primary_only", 10, "B0")]
LF_SQL = "pat(lf_name, target_field, target_value, match_position, version, pattern) AS (VALUES " + ", ".join(map(str, LF_ROWS)) + ")"


@query("code_prefix_votes", f"WITH {CODES.replace('AS version FROM part', 'AS version, 1 AS ord FROM part').replace(', 9 FROM part)', ', 9, 2 FROM part)')}, {LF_SQL}, h AS (SELECT DISTINCT doc_id, lf_name FROM codes JOIN pat ON codes.version = pat.version AND (match_position = 'any' OR ord = 1) AND CASE WHEN pattern LIKE '%.%' THEN code = pattern ELSE starts_with(code, pattern) END) SELECT lf_name, count(*) AS n, sum((h.doc_id IS NOT NULL)::INT)::BIGINT AS positive FROM (SELECT DISTINCT doc_id FROM codes) d CROSS JOIN (SELECT DISTINCT lf_name FROM pat) l LEFT JOIN h USING (doc_id, lf_name) GROUP BY lf_name")
def _(spark, sf):
    patterns = votes.registry(spark.createDataFrame(LF_ROWS, votes.PATTERN_SCHEMA).dropDuplicates(["lf_name"])).select("lf_name")
    p = spark.createDataFrame(LF_ROWS, votes.PATTERN_SCHEMA).join(patterns, "lf_name", "left_semi")
    v = votes.code_votes(_codes(spark, sf).withColumn("is_primary", F.lit(False)), p)
    return v.groupBy("lf_name").agg(F.count("*").alias("n"), F.count_if(F.col("vote") == 1).alias("positive"))


# ---------------------------------------------------------------- quality
@query("value_distribution", "WITH g AS (SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS value, count(*) AS n FROM documents GROUP BY ALL) SELECT value, n, round((100.0 * n / sum(n) OVER ())::DOUBLE, 6) AS pct FROM g")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 != 0, F.col("lang")).alias("value"))
    return quality.distribution(d, "value")


@query("null_rate_summary", "WITH x AS (SELECT CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS x FROM documents) SELECT round(avg((x IS NULL)::INT), 6) AS null_rate, min(x)::DOUBLE AS least, median(x) AS median, round(quantile_cont(x::DOUBLE, 0.95), 6) AS p95, max(x)::DOUBLE AS most FROM x")
def _(spark, sf):
    return quality.number_summary(S.read(spark, sf, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.col("n_chars")).alias("x")), "x")


QU = ", ".join(f"round(quantile_cont(n_chars::DOUBLE, {q}), 6) AS {n}" for q, n in ((0.1, "p10"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.99, "p99")))


@query("quantile_summary", f"SELECT lang, count(*) AS n, min(n_chars)::DOUBLE AS least, {QU}, max(n_chars)::DOUBLE AS most, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sd FROM documents GROUP BY lang")
def _(spark, sf):
    return quality.quantiles(S.read(spark, sf, "documents"), F.col("n_chars"), ("lang",))


@query("length_and_words", "SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')) AS words FROM documents")
def _(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", text.chars(F.col("text")).alias("chars"), text.word_count(F.col("text")).alias("words"))


@query("excerpts", "SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 1, 80) AS excerpt FROM documents")
def _(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), 80).alias("excerpt"))


@query("length_buckets", "SELECT CASE WHEN n_chars <= 500 THEN '<=500' WHEN n_chars <= 2000 THEN '500-2000' WHEN n_chars <= 8000 THEN '2000-8000' ELSE '>8000' END AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    b = text.bucket(F.col("n_chars"), [(500, "<=500"), (2000, "500-2000"), (8000, "2000-8000")], ">8000")
    return S.read(spark, sf, "documents").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("length_histogram", "SELECT least(floor(n_chars / 1000) + 1, 20)::BIGINT AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 20000 GROUP BY ALL")
def _(spark, sf):
    return quality.histogram(S.read(spark, sf, "documents"), F.col("n_chars").cast("double"), 0.0, 20000.0, 20)


@query("error_taxonomy", f"WITH {S.RUN} SELECT CASE WHEN parse_error LIKE 'api_error:%' THEN CASE WHEN parse_error LIKE '%429%' THEN 'api_error.rate_limit' ELSE 'api_error.timeout' END WHEN parse_error LIKE '%Unterminated%' THEN 'parse.json_unterminated' ELSE 'parse.validation_literal' END AS error_class, count(*) AS n FROM run WHERE parse_error IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return quality.errors(S.run(spark, sf).where("parse_error is not null"), "parse_error")


@query("reply_shapes", "WITH x AS (SELECT CASE turn % 4 WHEN 0 THEN '{' || text || '}' WHEN 1 THEN '{' || text WHEN 2 THEN '' ELSE text END AS raw FROM conversations) SELECT CASE WHEN raw = '' THEN 'no_raw_payload' WHEN starts_with(trim(raw), '{') AND ends_with(trim(raw), '}') THEN 'json_like' WHEN starts_with(trim(raw), '{') THEN 'truncated_json_like' WHEN contains(lower(raw), '```json') THEN 'markdown_fenced_json' ELSE 'non_json_text' END AS shape, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    t = F.col("turn") % 4
    raw = F.when(t == 0, F.concat(F.lit("{"), "text", F.lit("}"))).when(t == 1, F.concat(F.lit("{"), "text")).when(t == 2, "").otherwise(F.col("text"))
    return S.read(spark, sf, "conversations").select(raw.alias("raw")).groupBy(text.reply_shape(F.lit(""), F.col("raw")).alias("shape")).agg(F.count("*").alias("n"))


SUMMARY = f"""{S.RUN}, s AS (SELECT event_type, count(*) AS attempted, sum((parse_error IS NULL)::INT)::BIGINT AS succeeded, sum((parse_error IS NOT NULL AND parse_error NOT LIKE 'api_error:%')::INT)::BIGINT AS parse_failures, sum((parse_error LIKE 'api_error:%')::INT)::BIGINT AS api_errors, quantile_cont(latency_seconds, 0.5) AS p50, quantile_cont(latency_seconds, 0.95) AS p95, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM run GROUP BY event_type), sm AS (SELECT *, input_tokens / 1e6 * 0.2 + output_tokens / 1e6 * 1.25 AS cost_usd FROM s)"""


@query("run_summary", f"WITH {SUMMARY} SELECT event_type, attempted, succeeded, coalesce(parse_failures, 0) AS parse_failures, coalesce(api_errors, 0) AS api_errors, round(p50, 6) AS p50, round(p95, 6) AS p95, input_tokens, output_tokens, round(cost_usd, 6) AS cost_usd FROM sm")
def _(spark, sf):
    return quality.run_summary(S.run(spark, sf), ["event_type"])


@query("run_progress", f"WITH {SUMMARY} SELECT event_type, round(attempted / (2 * 3600.0)::DOUBLE, 6) AS rps, round((100000 - attempted) / (attempted / (2 * 3600.0)::DOUBLE * 3600), 6) AS eta_hours, round(cost_usd / attempted * 100000, 6) AS projected_usd FROM sm")
def _(spark, sf):
    return quality.progress(quality.run_summary(S.run(spark, sf), ["event_type"]), F.lit(2.0), 100000).select("event_type", "rps", "eta_hours", "projected_usd")


@query("gate_table", f"WITH {SUMMARY}, g AS (SELECT event_type, 'parse_failures' AS gate, parse_failures / attempted AS value, 0.02::DOUBLE AS \"limit\", parse_failures / attempted < 0.02 AS ok FROM sm UNION ALL SELECT event_type, 'api_errors', api_errors / attempted, 0.01, api_errors / attempted < 0.01 FROM sm UNION ALL SELECT event_type, 'cost_drift', abs(cost_usd / attempted / 0.0013 - 1), 0.15, abs(cost_usd / attempted / 0.0013 - 1) <= 0.15 FROM sm UNION ALL SELECT event_type, 'latency', p95 / p50, 2.0, p95 / p50 <= 2 FROM sm) SELECT event_type, gate, round(value, 6) AS value, \"limit\", CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN min(ok::INT) OVER (PARTITION BY event_type) = 1 THEN 'PASS' ELSE 'FAIL' END AS overall FROM g")
def _(spark, sf):
    return quality.gates(quality.run_summary(S.run(spark, sf), ["event_type"]), 0.0013, keys=("event_type",))


@query("run_integrity", f"WITH {S.RUN} SELECT count(*) AS attempted, count(DISTINCT event_id) AS \"unique\", sum((parse_error IS NULL)::INT)::BIGINT AS ok, sum((parse_error IS NOT NULL)::INT)::BIGINT AS failed, count(*) - count(DISTINCT event_id) AS surplus, true AS adds_up, count(DISTINCT event_id) BETWEEN 100 AND 1000000000 AS in_range FROM run")
def _(spark, sf):
    return quality.integrity(S.run(spark, sf), "event_id", (100, 10**9))


RUNNING = f"WITH {S.RUN}, w AS (SELECT event_type, event_id, ts, sum(input_tokens / 1e6 * 0.2 + output_tokens / 1e6 * 1.25) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total_cost, count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_calls FROM run)"


def _running(spark, sf):
    r = S.run(spark, sf).withColumn("cost", stats.cost(F.col("input_tokens"), F.col("output_tokens"), domains.PRICE_IN, domains.PRICE_OUT))
    return quality.running(r, ["event_type"], ["ts", "event_id"], ["cost"]).select("event_type", "event_id", "ts", "total_cost", "n_calls")


@query("running_cost", f"WITH {S.RUN}, w AS (SELECT event_type, event_id, sum(input_tokens) OVER w AS a, sum(output_tokens) OVER w AS b, count(*) OVER w AS n_calls FROM run WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_type, event_id, a::BIGINT AS total_input_tokens, b::BIGINT AS total_output_tokens, (a * 200 + b * 1250)::BIGINT AS total_cost_nano, n_calls FROM w")
def _(spark, sf):
    r = quality.running(S.run(spark, sf), ["event_type"], ["ts", "event_id"], ["input_tokens", "output_tokens"])
    nano = F.col("total_input_tokens") * 200 + F.col("total_output_tokens") * 1250
    return r.select("event_type", "event_id", "total_input_tokens", "total_output_tokens", nano.alias("total_cost_nano"), "n_calls")


@query("budget_stop", f"{RUNNING}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM w WHERE total_cost > 0.05) SELECT event_type, event_id, n_calls FROM o WHERE rn = 1")
def _(spark, sf):
    return quality.over_budget(_running(spark, sf), ["event_type"], ["ts", "event_id"], 0.05).select("event_type", "event_id", "n_calls")


@query("window_rate", f"WITH {S.RUN} SELECT event_type, event_id, round(count(latency_seconds) OVER w / sum(latency_seconds) OVER w, 5) AS window_rps FROM run WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 999 PRECEDING)")
def _(spark, sf):
    return quality.window_rate(S.run(spark, sf), ["event_type"], ["ts", "event_id"], "latency_seconds").select("event_type", "event_id", F.round("window_rps", 5).alias("window_rps"))


DAY = "d AS (SELECT event_type, floor(epoch(ts) / 86400)::DOUBLE AS x, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT event_type, x, sum(n) OVER (PARTITION BY event_type ORDER BY x)::DOUBLE AS y FROM d), l AS (SELECT *, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lag(y) OVER w AS ya, lead(y) OVER w AS yb FROM c WINDOW w AS (PARTITION BY event_type ORDER BY x))"


@query("throughput_derivative", f"WITH {DAY} SELECT event_type, x, y, round(CASE WHEN xa IS NULL THEN (yb - y) / (xb - x) WHEN xb IS NULL THEN (y - ya) / (x - xa) ELSE ((x - xa) * (x - xa) * yb + ((xb - x) * (xb - x) - (x - xa) * (x - xa)) * y - (xb - x) * (xb - x) * ya) / ((x - xa) * (xb - x) * (xb - xa)) END, 6) AS rate FROM l")
def _(spark, sf):
    from pyspark.sql import Window

    d = S.read(spark, sf, "events").groupBy("event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("double").alias("x")).agg(F.count("*").alias("n"))
    c = d.withColumn("y", F.sum("n").over(Window.partitionBy("event_type").orderBy("x")).cast("double")).drop("n")
    return quality.derivative(c, ["event_type"], "x", "y")


@query("upset_patterns", f"WITH {S.FACTS} SELECT (n_chars >= 2000)::INT::VARCHAR || (nl >= 5)::INT::VARCHAR || dg::INT::VARCHAR AS pattern, count(*) AS n FROM f GROUP BY ALL")
def _(spark, sf):
    f = S.facts(spark, sf).select((F.col("n_chars") >= 2000).alias("a"), (F.col("nl") >= 5).alias("b"), F.col("dg").alias("c"))
    return quality.upset(f, ["a", "b", "c"])


@query("count_pair_stats", f"WITH {S.FACTS}, p AS (SELECT lang, CASE WHEN doc_id % 3 <> 0 THEN nl END AS l, CASE WHEN doc_id % 4 <> 0 THEN nl + doc_id % 2 END AS r FROM f), g AS (SELECT lang, sum((l IS NOT NULL AND r IS NOT NULL)::INT)::BIGINT AS compared, sum((l IS NULL AND r IS NULL)::INT)::BIGINT AS both_null, median(abs(l - r))::DOUBLE AS median_difference, sum((l >= 1 AND r >= 1)::INT)::BIGINT AS both_some FROM p GROUP BY lang) SELECT *, round(CASE WHEN compared + both_null > 0 THEN 100 * both_null / (compared + both_null) ELSE 0 END, 6) AS both_null_pct, round(CASE WHEN compared > 0 THEN 100 * both_some / compared ELSE 0 END, 6) AS both_some_pct FROM g")
def _(spark, sf):
    i = F.col("doc_id")
    return quality.count_pairs(S.facts(spark, sf).select("lang", F.when(i % 3 != 0, F.col("nl")).alias("left"), F.when(i % 4 != 0, F.col("nl") + i % 2).alias("right")), ["lang"])


DRIFT = "m AS (SELECT (min(epoch(ts)) + max(epoch(ts))) / 2 AS mid FROM events), p AS (SELECT event_type, epoch(ts) >= mid AS late FROM events CROSS JOIN m), g AS (SELECT event_type, sum(late::INT) AS a, sum((NOT late)::INT) AS b FROM p GROUP BY event_type), h AS (SELECT event_type, a::DOUBLE AS n_now, (sum(a) OVER ())::DOUBLE AS total_now, b::DOUBLE AS n_then, (sum(b) OVER ())::DOUBLE AS total_then FROM g)"


@query("drift_table", f"WITH {DRIFT} SELECT event_type, n_now::BIGINT AS n_now, total_now::BIGINT AS total_now, n_then::BIGINT AS n_then, total_then::BIGINT AS total_then, round(100 * n_now / total_now - 100 * n_then / total_then, 6) AS delta_pp, {wilson_sql('n_now', 'total_now')}, abs(100 * n_now / total_now - 100 * n_then / total_then) > 5 AS flag FROM h")
def _(spark, sf):
    from pyspark.sql import Window

    e = S.read(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    mid = e.agg(((F.min("us") + F.max("us")) / 2).alias("mid"))
    g = e.crossJoin(F.broadcast(mid)).groupBy("event_type", (F.col("us") >= F.col("mid")).alias("late")).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("late")))
    return quality.drift(g.where("late"), g.where("not late"), ["event_type"])


# ---------------------------------------------------------------- votes
@query("vote_polarity", f"WITH {S.VOTES} SELECT lf_name, round(100.0 * sum((vote = 1)::INT) / count(*), 6) AS positive_pct, round(100.0 * sum((vote = 0)::INT) / count(*), 6) AS negative_pct, round(100.0 * sum((vote = -1)::INT) / count(*), 6) AS abstain_pct, round(100.0 * sum((vote <> -1)::INT) / count(*), 6) AS coverage_pct FROM votes GROUP BY lf_name")
def _(spark, sf):
    return votes.polarity(S.votes(spark, sf))


@query("lf_overlap", f"WITH {S.VOTES}, v AS (SELECT * FROM votes WHERE vote <> -1) SELECT x.target_field, x.target_value, x.lf_name AS a, y.lf_name AS b, count(*) AS both, round(avg((x.vote = y.vote)::INT), 6) AS agreement FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.target_field = y.target_field AND x.target_value = y.target_value AND x.lf_name < y.lf_name GROUP BY ALL")
def _(spark, sf):
    return votes.overlaps(S.votes(spark, sf))


MAJ = f"{S.VOTES}, t AS (SELECT doc_id, target_field, target_value, sum((vote = 1)::INT) AS p, sum((vote = 0)::INT) AS n FROM votes GROUP BY ALL), c AS (SELECT target_field, target_value, count(DISTINCT lf_name) AS n_lfs_total, count(DISTINCT CASE WHEN vote <> -1 THEN lf_name END) AS n_lfs_contributing FROM votes GROUP BY ALL), mv AS (SELECT doc_id, target_field, target_value, CASE WHEN p > n THEN 1.0 WHEN n > p THEN 0.0 ELSE 0.5 END::DOUBLE AS probability, CASE WHEN n_lfs_contributing = 0 THEN 'no_votes' WHEN n_lfs_contributing = 1 THEN 'single_lf_only' ELSE 'success_majority' END AS fit_status, n_lfs_total, n_lfs_contributing FROM t JOIN c USING (target_field, target_value))"


@query("majority_vote", f"WITH {MAJ} SELECT * FROM mv")
def _(spark, sf):
    return votes.majority(S.votes(spark, sf))


@query("fusion_audit", f"WITH {MAJ} SELECT target_field, fit_status, count(*) AS n, round(avg(probability), 6) AS mean, round(stddev_pop(probability), 6) AS sd, sum((probability = 0.5)::INT)::BIGINT AS undecided, sum((probability > 0.95)::INT)::BIGINT AS high, sum((probability < 0.05)::INT)::BIGINT AS low FROM mv GROUP BY ALL")
def _(spark, sf):
    p = F.col("probability")
    return votes.majority(S.votes(spark, sf)).groupBy("target_field", "fit_status").agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("sd"), F.count_if(p == 0.5).alias("undecided"), F.count_if(p > 0.95).alias("high"), F.count_if(p < 0.05).alias("low"))


@query("combined_vote", f"WITH {S.VOTES} SELECT doc_id, target_field, CASE WHEN max(vote) = 1 THEN 1 WHEN bool_or(vote = 0) THEN 0 ELSE -1 END::BIGINT AS vote FROM votes GROUP BY ALL")
def _(spark, sf):
    return votes.combine(S.votes(spark, sf), ["doc_id", "target_field"])


@query("label_model")
def _(spark, sf):
    return votes.fuse_targets(S.votes(spark, sf)).select("doc_id", "target_field", "probability", "fit_status", "n_lfs_contributing")


@query("model_votes", f"WITH {S.WIDE}, x AS (SELECT field, unnest([a, b, c]) AS v FROM wide) SELECT field, CASE WHEN v = 'not_documented' THEN -1 WHEN v = 'yes' THEN 1 ELSE 0 END::BIGINT AS vote, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    return S.answers(spark, sf).groupBy("field", votes.model_vote(F.col("value"), F.lit("yes"), "tristate").alias("vote")).agg(F.count("*").alias("n"))


@query("model_consensus", f"WITH {S.WIDE}, y AS (SELECT *, (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT AS y, (a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT AS n FROM wide) SELECT doc_id, field, CASE WHEN y > n THEN 1.0 WHEN n > y THEN 0.0 ELSE 0.5 END::DOUBLE AS tri, CASE WHEN y * 2 >= 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS tag FROM y")
def _(spark, sf):
    abc = (F.col("A"), F.col("B"), F.col("C"))
    return S.wide(spark, sf).select("doc_id", "field", votes.consensus(*abc, "tristate").alias("tri"), votes.consensus(*abc, "tag").alias("tag"))


VS = f"WITH {S.WIDE}, j AS (SELECT wide.field, f.dg AS lf, (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT >= 2 AS m FROM wide JOIN f USING (doc_id)), g AS (SELECT field, sum((lf AND m)::INT)::BIGINT AS \"both\", sum((lf AND NOT m)::INT)::BIGINT AS lf_only, sum((NOT lf AND m)::INT)::BIGINT AS model_only, sum((NOT lf AND NOT m)::INT)::BIGINT AS neither FROM j GROUP BY field)"


@query("lf_versus_model", f"{VS} SELECT *, round((\"both\" + neither) / (\"both\" + lf_only + model_only + neither), 6) AS agreement, round(\"both\" / (\"both\" + lf_only), 6) AS model_given_lf, round(\"both\" / (\"both\" + model_only), 6) AS lf_given_model FROM g")
def _(spark, sf):
    w = S.wide(spark, sf).join(S.facts(spark, sf).select("doc_id", "dg"), "doc_id")
    yes = sum(((F.col(r) == "yes").cast("int") for r in "ABC"), F.lit(0))
    return votes.versus(w, ["field"], F.col("dg"), yes >= 2)


FIVE = f"{S.FACTS}, s AS (SELECT doc_id, unnest(['a', 'b', 'c', 'd', 'e']) AS signal, unnest([n_chars >= 2000, n_chars >= 1600, dg, nl >= 5, nl >= 8]) AS v FROM f), sp AS (SELECT x.signal || '_' || y.signal AS pair, x.v AS l, y.v AS r FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.signal < y.signal)"


@query("five_signal_kappa", f"WITH {FIVE}, {S.kappa_sql('sp', 'pair', 'kap')} SELECT pair, n, round(agreement, 6) AS agreement, round(kappa, 6) AS kappa, round(pabak, 6) AS pabak FROM kap")
def _(spark, sf):
    c, nl = F.col("n_chars"), F.col("nl")
    w = S.facts(spark, sf).select("doc_id", (c >= 2000).alias("a"), (c >= 1600).alias("b"), F.col("dg").alias("c"), (nl >= 5).alias("d"), (nl >= 8).alias("e"))
    return agreement.kappa(agreement.contingency(longform.pairs(w, tuple("abcde"), ("doc_id",)), ["pair"]), ["pair"])


@query("variant_selection", f"WITH {S.WIDE}, x AS (SELECT field, unnest(['A', 'B', 'C']) AS variant, unnest([a, b, c]) AS v, dg, n_chars FROM wide JOIN f USING (doc_id)), g AS (SELECT variant, field, avg(((v = 'yes') = dg)::INT) AS agreement, sum(dg::INT)::DOUBLE AS weight, median(n_chars) AS median_tokens FROM x GROUP BY ALL), s AS (SELECT variant, sum(agreement * weight) / sum(weight) AS score, max(median_tokens) AS median_tokens FROM g GROUP BY variant), c AS (SELECT *, max(score) OVER () - score <= 0.01 + 1e-12 AS close FROM s) SELECT variant, round(score, 6) AS score, median_tokens::DOUBLE AS median_tokens, close, sum(close::INT) OVER () > 1 AS tie, row_number() OVER (ORDER BY close DESC, CASE WHEN close THEN median_tokens END NULLS FIRST, score DESC, variant) = 1 AS chosen FROM c")
def _(spark, sf):
    x = S.answers(spark, sf).join(S.facts(spark, sf).select("doc_id", "dg", "n_chars"), "doc_id")
    g = x.groupBy(F.col("rater").alias("variant"), "field").agg(F.avg(((F.col("value") == "yes") == F.col("dg")).cast("int")).alias("agreement"), F.count_if("dg").cast("double").alias("weight"), F.median("n_chars").alias("median_tokens"))
    return votes.choose_variant(g)


# ---------------------------------------------------------------- text, sections, vectors
@query("regex_lf")
def _(spark, sf):
    spec = sections.load_patterns({"field_name": "f", "target_value": "yes", "regex_patterns": ["\\btoken\\b", "\\bpassword\\b"], "compound_patterns": [{"all_of": ["the", "was", "of"], "window_chars": 40}]})
    d = S.read(spark, sf, "documents").select("doc_id", sections.sections(F.col("text")).alias("s"))
    d = d.select("doc_id", sections.search_text(F.col("s"), ["Chief Complaint"]).alias("t"))
    return d.select("doc_id", sections.vote(F.col("t"), spec).alias("vote"), sections.near_each_other(F.col("t"), "token", "[0-9]", 20).alias("close"))


@query("section_coverage", f"WITH n AS (SELECT doc_id, ' pain ' || lang AS cc, regexp_replace(regexp_replace(replace(text, ':', ';'), '^[ \\t\\n\\r\\f\\x0B]+', ''), '[ \\t\\n\\r\\f\\x0B]+$', '') AS hc FROM documents), x AS (SELECT 'Chief Complaint' AS name, trim(cc) AS body FROM n UNION ALL SELECT 'Hospital Course', hc FROM n) SELECT name, count(*) AS present, ((SELECT count(*) FROM n) - count(*))::BIGINT AS absent, round(100.0 * count(*) / (SELECT count(*) FROM n), 6) AS pct, median(length(body))::DOUBLE AS median_chars FROM x GROUP BY name")
def _(spark, sf):
    d = S.read(spark, sf, "documents")
    nl = F.lit("\n")
    note = F.concat(F.lit("intro\nChief Complaint:\n pain "), "lang", F.lit("\nHospital Course:\n"), F.translate("text", ":", ";"), F.when(F.col("doc_id") % 2 == 0, "\nChief Complaint:\nagain").otherwise(""))
    return sections.coverage(d.select("doc_id", sections.sections(F.concat(note, nl)).alias("sections")))


@query("section_alias", "SELECT doc_id, 'pain ' || lang AS complaint FROM documents")
def _(spark, sf):
    note = F.concat(F.lit("intro\nPresenting Illness:\n pain "), "lang", F.lit("\n"))
    return S.read(spark, sf, "documents").select("doc_id", sections.section(sections.sections(note), "History of Present Illness").alias("complaint"))


@query("jsonl_flatten", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, sf):
    return S.read(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


SIMS = """s AS (SELECT label, vec_id AS seed_id, embedding AS seed FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 3),
sim AS (SELECT v.vec_id, v.label, seed_id, list_dot_product(v.embedding::DOUBLE[], s.seed::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(s.seed::DOUBLE[], s.seed::DOUBLE[]))) AS x FROM embeddings v JOIN s ON v.label = s.label)"""


def _sims(spark, sf):
    e = S.read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("target"), F.col("embedding").alias("vec"))
    from pyspark.sql import Window

    seeds = e.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("vec_id"))).where("rn <= 3").select("target", F.col("vec_id").alias("seed_id"), F.col("vec").alias("seed"))
    return embedding.similarities(e, seeds)


@query("embedding_votes", f"WITH {SIMS}, g AS (SELECT vec_id, label, max(x) AS c FROM sim GROUP BY ALL) SELECT vec_id, label::VARCHAR AS target, round(c, 6) AS confidence, CASE WHEN c >= 0.65 THEN 1 ELSE -1 END::BIGINT AS vote FROM g")
def _(spark, sf):
    return embedding.vote(_sims(spark, sf), 0.65)


@query("embedding_threshold", f"WITH {SIMS}, g AS (SELECT label, quantile_cont(x, 0.1) AS p10, count(*) AS n FROM sim GROUP BY label) SELECT label::VARCHAR AS target, round(p10, 6) AS p10, n, round(greatest(0.65, least(0.85, p10)), 6) AS threshold, CASE WHEN p10 < 0.65 THEN 'floor_0.65' WHEN p10 > 0.85 THEN 'cap_0.85' ELSE 'p10' END AS reason FROM g")
def _(spark, sf):
    return embedding.calibrate(_sims(spark, sf))


# ---------------------------------------------------------------- resampling, audit
@query("bootstrap_kappa_ci")
def _(spark, sf):
    k = resample.kappa_replicates(S.pairs(spark, sf).withColumnRenamed("doc_id", "row_no"), 100, 42)
    return resample.interval(k.withColumnRenamed("kappa", "value"), FP)


@query("bootstrap_median_ci", f"WITH {S.KAPPA}, v AS (SELECT row_number() OVER (ORDER BY field, pair) - 1 AS row_no, kappa FROM kap), d AS (SELECT rep, draw, ('0x' || substr(md5('42|' || rep::VARCHAR || '|' || draw::VARCHAR), 1, 12))::BIGINT % 9 AS row_no FROM range(200) a(rep), range(9) b(draw)), m AS (SELECT rep, median(kappa) AS x FROM d JOIN v USING (row_no) GROUP BY rep) SELECT round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high, count(*) AS n_finite FROM m")
def _(spark, sf):
    from pyspark.sql import Window

    k = agreement.kappa(agreement.contingency(S.pairs(spark, sf), FP), FP)
    v = k.select((F.row_number().over(Window.orderBy("field", "pair")) - 1).alias("row_no"), F.col("kappa").alias("value"))
    return resample.interval(resample.median_replicates(v, 200, 42), [])


SUMMARY = f"""{PAT}, o AS (SELECT field, CASE pattern WHEN 'a=b!=c' THEN 'C' WHEN 'a=c!=b' THEN 'B' WHEN 'b=c!=a' THEN 'A' END AS outlier, CASE pattern WHEN 'a=b!=c' THEN c WHEN 'a=c!=b' THEN b WHEN 'b=c!=a' THEN a END AS odd,
CASE pattern WHEN 'b=c!=a' THEN b WHEN 'all_different' THEN NULL ELSE a END AS consensus FROM p WHERE pattern <> 'all_equal'),
n AS (SELECT field, count(*) AS d, count(*) FILTER (WHERE outlier = 'A') AS na, count(*) FILTER (WHERE outlier = 'B') AS nb, count(*) FILTER (WHERE outlier = 'C') AS nc FROM o GROUP BY field),
w AS (SELECT *, greatest(na, nb, nc) AS most, least(na, nb, nc) AS fewest, CASE WHEN na = greatest(na, nb, nc) THEN 'A' WHEN nb = greatest(na, nb, nc) THEN 'B' ELSE 'C' END AS who FROM n),
t AS (SELECT field, outlier, odd, consensus, row_number() OVER (PARTITION BY field, outlier ORDER BY count(*) DESC, consensus, odd) AS rn FROM o WHERE outlier IS NOT NULL GROUP BY field, outlier, odd, consensus),
su AS (SELECT w.field, d AS disagreements, most > 0.6 * d AS clear, CASE WHEN most > 0.6 * d THEN who END AS outlier, CASE WHEN most > 0.6 * d THEN odd END AS odd, CASE WHEN most > 0.6 * d THEN most END AS n,
CASE WHEN most > 0.6 * d THEN who || ' votes \'\'' || odd || '\'\' where the other two vote \'\'' || consensus || '\'\' on ' || most || ' of ' || d || ' disagreements.'
WHEN fewest > 0 AND most - fewest <= 1 THEN 'Disagreements distributed across all three variants (no consistent outlier).' ELSE 'No consistent outlier; disagreements vary by case.' END AS summary
FROM w LEFT JOIN t ON t.field = w.field AND t.outlier = w.who AND rn = 1),
cf AS (SELECT *, CASE WHEN clear THEN lower(outlier) || '_overasserts_' || trim(regexp_replace(lower(odd), '[^a-z0-9]+', '_', 'g'), '_') WHEN summary LIKE 'No consistent outlier;%' THEN 'no_consistent_outlier' ELSE 'unclassified_disagreement' END AS cluster_id,
CASE WHEN clear THEN outlier || ' over-asserts \'\'' || odd || '\'\'' WHEN summary LIKE 'No consistent outlier;%' THEN 'No consistent outlier' ELSE 'Unclassified disagreement pattern' END AS cluster_label FROM su),
cl AS (SELECT cluster_id, min(cluster_label) AS cluster_label, min(outlier) AS outlier, sum(disagreements)::BIGINT AS n, string_agg(field, ',' ORDER BY field) AS fields FROM cf GROUP BY cluster_id)"""


def _clusters(spark, sf):
    return audit.clusters(audit.summaries(audit.patterns(S.wide(spark, sf))))


@query("disagreement_clusters", f"{SUMMARY} SELECT * FROM cl")
def _(spark, sf):
    return _clusters(spark, sf).withColumn("fields", F.array_join("fields", ","))


@query("audit_summaries", f"{SUMMARY} SELECT field, disagreements, outlier, odd, n, summary FROM su")
def _(spark, sf):
    return audit.summaries(audit.patterns(S.wide(spark, sf)))


#: A field for each language and rater, so that there are fields of all kinds: with an outlier, distributed, varying.
BY_LANGUAGE = PAT.replace("wide AS (SELECT * FROM wide0)", "wide AS (SELECT wide0.doc_id, wide0.field || ' ' || coalesce(lang, 'none') AS field, CASE wide0.doc_id % 6 WHEN 1 THEN 'maybe so' ELSE a END AS a, CASE wide0.doc_id % 6 WHEN 2 THEN 'maybe so' ELSE b END AS b, CASE wide0.doc_id % 6 WHEN 3 THEN 'maybe so' ELSE c END AS c FROM wide0 JOIN f USING (doc_id))")


@query("audit_summaries_by_language", f"{SUMMARY.replace(PAT, BY_LANGUAGE)} SELECT cf.field, disagreements, odd, n, summary, cluster_id, cluster_label FROM cf")
def _(spark, sf):
    lang = S.read(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    w = S.wide(spark, sf).join(lang, "doc_id")
    w = w.select("doc_id", F.concat_ws(" ", "field", "lang").alias("field"), *[F.when(F.col("doc_id") % 6 == i + 1, "maybe so").otherwise(F.col(r)).alias(r) for i, r in enumerate("ABC")])
    s = audit.summaries(audit.patterns(w))
    c = audit.clusters(s).select("cluster_id", "cluster_label", F.explode("fields").alias("field"))
    return s.join(c, "field").select("field", "disagreements", "odd", "n", "summary", "cluster_id", "cluster_label")


@query("audit_examples")
def _(spark, sf):
    return audit.examples(audit.patterns(S.wide(spark, sf)), S.read(spark, sf, "documents").select("doc_id", F.col("source").alias("stratum")))


@query("fingerprints", "SELECT doc_id, sha256(lang || chr(0) || text) AS key FROM documents")
def _(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", text.cache_key(F.col("lang"), F.col("text")).alias("key"))


# ---------------------------------------------------------------- more scalar and audit operators
@query("tristate_normalised", "WITH x AS (SELECT CASE doc_id % 6 WHEN 0 THEN ' YES ' WHEN 1 THEN 'No' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN 'maybe' END AS v FROM documents), y AS (SELECT CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'none', 'null') THEN NULL WHEN lower(trim(v)) IN ('yes', 'no', 'not_documented') THEN lower(trim(v)) ELSE 'not_documented' END AS value, CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'none', 'null') THEN NULL WHEN lower(trim(v)) = 'yes' THEN 'yes' ELSE 'not_yes' END AS collapsed FROM x) SELECT value, collapsed, CASE WHEN value IS NULL THEN 2 WHEN value = 'yes' THEN 1 WHEN value = 'no' THEN 0 ELSE -1 END::BIGINT AS code, count(*) AS n FROM y GROUP BY ALL")
def _(spark, sf):
    m = F.col("doc_id") % 6
    v = F.when(m == 0, " YES ").when(m == 1, "No").when(m == 2, "none").when(m == 3, "").when(m == 4, "maybe")
    d = S.read(spark, sf, "documents").select(labels.tristate(v).alias("value"), labels.tristate(v, True).alias("collapsed"))
    return d.groupBy("value", "collapsed", labels.code(F.col("value")).alias("code")).agg(F.count("*").alias("n"))


@query("normalised_tags", "WITH x AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_sort(list_filter(t, lambda e: e IN ('view', 'click'))), ',') AS tags FROM x")
def _(spark, sf):
    e = S.read(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.concat(F.lit(" "), "event_type")).alias("t"))
    return e.select("user_id", F.array_join(F.array_sort(labels.normal_tags(F.col("t"), ("view", "click"))), ",").alias("tags"))


@query("confusion_kinds", "WITH c AS (SELECT DISTINCT x.p_type AS l, y.p_type AS r FROM part x JOIN part y ON x.p_partkey + 1 = y.p_partkey), k AS (SELECT replace(l, ' ', '_') AS l, replace(r, ' ', '_') AS r FROM c) SELECT CASE WHEN l = r THEN 'same' WHEN len(list_intersect(string_split(l, '_'), string_split(r, '_'))) > 0 THEN 'related' ELSE 'unrelated' END AS kind, count(*) AS n FROM k GROUP BY ALL")
def _(spark, sf):
    p = S.read(spark, sf, "part").select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("l"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("l").alias("r"))
    return p.join(q, "p_partkey").select("l", "r").distinct().groupBy(labels.confusion_kind(F.col("l"), F.col("r")).alias("kind")).agg(F.count("*").alias("n"))


@query("guarded_casts", "WITH x AS (SELECT CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN ' ' || doc_id::VARCHAR WHEN 2 THEN '-' || doc_id::VARCHAR ELSE NULL END AS v FROM documents) SELECT CASE WHEN regexp_full_match(v, '[0-9]+') THEN v::BIGINT END AS number, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    i, m = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    v = F.when(m == 0, i).when(m == 1, F.concat(F.lit(" "), i)).when(m == 2, F.concat(F.lit("-"), i))
    return S.read(spark, sf, "documents").groupBy(text.guarded_int(v).alias("number")).agg(F.count("*").alias("n"))


@query("zero_firing_lfs", f"WITH {S.VOTES}, g AS (SELECT lf_name, count(*) AS codes_any, sum((doc_id % 2 = 0)::INT)::BIGINT AS codes_primary, sum((vote = 1)::INT)::BIGINT AS fired FROM votes GROUP BY lf_name) SELECT *, CASE WHEN fired > 0 THEN 'fires' WHEN codes_any = 0 THEN 'data_absent' WHEN codes_primary = 0 THEN 'primary_only' ELSE 'logic' END AS diagnosis FROM g")
def _(spark, sf):
    g = S.votes(spark, sf).groupBy("lf_name").agg(F.count("*").alias("codes_any"), F.count_if(F.col("doc_id") % 2 == 0).alias("codes_primary"), F.count_if(F.col("vote") == 1).alias("fired"))
    return votes.zero_firing(g)


@query("lf_smoke", f"WITH {S.WIDE}, x AS (SELECT field, unnest(['A', 'B', 'C']) AS rater, dg, unnest([a, b, c]) = 'yes' AS m FROM wide JOIN f USING (doc_id)) SELECT field, rater, sum((dg AND m)::INT)::BIGINT AS hits, sum((dg AND NOT m)::INT)::BIGINT AS false_hits, sum((NOT dg AND m)::INT)::BIGINT AS misses FROM x WHERE dg OR m GROUP BY ALL")
def _(spark, sf):
    j = S.answers(spark, sf).join(S.facts(spark, sf).select("doc_id", "dg"), "doc_id")
    return votes.smoke(j, ["field", "rater"], F.col("dg"), F.col("value") == "yes")


@query("predictions", f"WITH {MAJ} SELECT doc_id, target_field, target_value, probability, fit_status, n_lfs_total, n_lfs_contributing FROM mv")
def _(spark, sf):
    return votes.majority(S.votes(spark, sf))


@query("largest_disagreements", f"WITH {MAJ}, {S.WIDE0}, cc AS (SELECT doc_id, field, CASE WHEN (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT > (a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT THEN 1.0 WHEN (a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT > (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT THEN 0.0 ELSE 0.5 END::DOUBLE AS consensus FROM wide0), j AS (SELECT target_field, field, doc_id, probability, consensus, row_number() OVER (PARTITION BY target_field, field ORDER BY abs(probability - consensus) DESC, doc_id) AS rn FROM mv JOIN cc USING (doc_id) WHERE abs(probability - consensus) > 0.3) SELECT target_field, field, doc_id, probability, consensus FROM j WHERE rn <= 3")
def _(spark, sf):
    from pyspark.sql import Window

    abc = (F.col("A"), F.col("B"), F.col("C"))
    c = S.wide(spark, sf).select("doc_id", "field", votes.consensus(*abc, "tristate").alias("consensus"))
    gap = F.abs(F.col("probability") - F.col("consensus"))
    j = votes.majority(S.votes(spark, sf)).join(c, "doc_id").where(gap > 0.3)
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("target_field", "field").orderBy(F.desc(gap), "doc_id"))).where("rn <= 3").select("target_field", "field", "doc_id", "probability", "consensus")


@query("cluster_kappa", f"{SUMMARY.replace(S.WIDE, S.PAIRS)}, {S.kappa_sql('pairs', 'field, pair', 'kap')}, km AS (SELECT field, avg(kappa) AS kappa_mean FROM kap GROUP BY field) SELECT cluster_id, round(coalesce(avg(kappa_mean), 0), 6) AS kappa_mean FROM cf LEFT JOIN km USING (field) GROUP BY cluster_id")
def _(spark, sf):
    return audit.cluster_kappa(_clusters(spark, sf), _report(spark, sf))


@query("collapse_adjusted_clusters", f"{SUMMARY}, x AS (SELECT cluster_id, count(*) AS original, count(*) FILTER (WHERE NOT ((a = 'yes') = (b = 'yes') AND (b = 'yes') = (c = 'yes'))) AS apart FROM p JOIN cf USING (field) WHERE pattern <> 'all_equal' GROUP BY cluster_id) SELECT cl.cluster_id, n, round(apart / original, 6)::DOUBLE AS survival, greatest(0, least(round_even(n * (apart / original), 0), n))::BIGINT AS adjusted FROM cl JOIN x USING (cluster_id)")
def _(spark, sf):
    found = _clusters(spark, sf)
    p = audit.patterns(S.wide(spark, sf)).join(found.select("cluster_id", F.explode("fields").alias("field")), "field")
    c = lambda x: labels.collapse(F.col(x))
    apart = ~(c("A").eqNullSafe(c("B")) & c("B").eqNullSafe(c("C")))
    return audit.adjusted(found, p.select("cluster_id", F.lit(True).alias("original"), apart.alias("collapsed"))).select("cluster_id", "n", "survival", "adjusted")


@query("embedding_separation", f"WITH {SIMS}, o AS (SELECT v.label, list_dot_product(v.embedding::DOUBLE[], s.seed::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(s.seed::DOUBLE[], s.seed::DOUBLE[]))) AS x FROM embeddings v JOIN s ON s.label = (v.label + 1) % 10), a AS (SELECT label, median(x) AS own FROM sim GROUP BY label), b AS (SELECT label, median(x) AS other FROM o GROUP BY label) SELECT label::VARCHAR AS target, round(own, 6) AS own, round(other, 6) AS other, round(own - other, 6) AS gain, own - other >= 0.15 AS enough FROM a JOIN b USING (label)")
def _(spark, sf):
    from pyspark.sql import Window

    e = S.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))
    seeds = e.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("rn <= 3").select("label", F.col("vec_id").alias("seed_id"), F.col("vec").alias("seed"))
    hard = seeds.select(F.pmod(F.col("label") + 9, F.lit(10)).cast("string").alias("target"), "seed_id", "seed")
    vectors = e.select("vec_id", F.col("label").cast("string").alias("target"), "vec")
    own = embedding.similarities(vectors, seeds.select(F.col("label").cast("string").alias("target"), "seed_id", "seed"))
    return embedding.separation(own, embedding.similarities(vectors, hard))


@query("record_validity", "SELECT doc_id, array_to_string(list_filter([CASE doc_id % 4 WHEN 1 THEN 'empty_tags' END, CASE WHEN doc_id % 4 IN (1, 2) THEN 'dominant_not_in_tags' END, CASE doc_id % 4 WHEN 3 THEN 'negative_count' END, CASE WHEN coalesce(length(text) > 300, true) THEN 'diagnosis_length' END], lambda x: x IS NOT NULL), ',') AS problems FROM documents")
def _(spark, sf):
    m = F.col("doc_id") % 4
    fields = {f: F.lit("no") for f in domains.TRISTATE_FIELDS} | {k: F.lit(v[0]) for k, v in domains.ENUMS.items()}
    record = fields | {
        "admission_reason_tags": F.when(m == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("cardiac_hf"))), "dominant_admission_reason": F.when(m == 2, "other").otherwise("cardiac_hf"), "primary_diagnosis_text": F.col("text"),
        "new_meds_started_count": F.when(m == 3, -1).otherwise(2), "meds_stopped_count": F.lit(None).cast("int"), "reasoning": F.lit(None).cast("string"),
    }
    return S.read(spark, sf, "documents").select("doc_id", F.array_join(labels.problems(lambda c: record[c]), ",").alias("problems"))


@query("table_receipts")
def _(spark, sf):
    from ..operators import claims

    return claims.table_receipt(S.read(spark, sf, "documents"))


@query("claim_check", f"WITH {S.KAPPA}, k AS (SELECT field || '_' || pair AS key, field, pair, round(kappa, 6) AS v FROM kap) SELECT key, CASE WHEN pair <> 'A_B' THEN CASE WHEN field = 'long_text' THEN v + 1 ELSE v END END AS stored, CASE WHEN pair <> 'B_C' THEN v END AS now, CASE WHEN pair = 'A_B' THEN 'new' WHEN pair = 'B_C' THEN 'missing' WHEN field = 'has_digit' THEN 'match' ELSE 'mismatch' END AS status FROM k")
def _(spark, sf):
    """Stored claims against recomputed ones: of a pair stored later, one no longer computed, other values and other receipts."""
    from ..operators import claims

    k = agreement.kappa(agreement.contingency(S.pairs(spark, sf), FP), FP)
    c = k.select("field", "pair", F.concat_ws("_", "field", "pair").alias("key"), F.col("kappa").alias("value"), F.lit("").alias("description"), F.lit(".2f").alias("format"), F.lit("r").alias("receipt"))
    stored = c.where("pair != 'A_B'").withColumns({"value": F.when(F.col("field") == "long_text", F.col("value") + 1).otherwise(F.col("value")), "receipt": F.when(F.col("field") == "multi_line", "old").otherwise("r")})
    return claims.verify(claims.merge(stored.where("pair = 'A_C'"), stored).drop("field", "pair"), c.where("pair != 'B_C'").drop("field", "pair"))


@query("cache_misses", "SELECT count(DISTINCT text) AS missing FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)")
def _(spark, sf):
    from ..sources import readers

    d = S.read(spark, sf, "documents").select("doc_id", "text")
    cache = d.where("doc_id % 2 = 0").select(text.cache_key(F.lit("m"), F.col("text")).alias("cache_key")).distinct().withColumn("vector", F.lit(1))
    return readers.cached(d, cache, "m")[1].agg(F.count("*").alias("missing"))


#: Every n-gram of words, the phrases that have it; those that stand in no other one.
MINED = """WITH w AS (SELECT item_id, regexp_extract_all(trim(text), '[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*') AS w FROM benchmark),
g AS (SELECT item_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM w, range(2, 6) r(n) WHERE len(w) >= n),
x AS (SELECT item_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS x FROM g), y AS (SELECT lower(x) AS gram, item_id, min_by(x, i) AS x, min(n) AS length FROM x GROUP BY ALL),
c AS (SELECT gram, min_by(x, item_id) AS example, count(*) AS n, min(length) AS length FROM y GROUP BY gram HAVING count(*) >= 2),
k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c l WHERE l.gram <> c.gram AND contains(l.gram, c.gram)))"""


@query("mined_phrases", f"{MINED} SELECT row_number() OVER (ORDER BY n DESC, length DESC, gram) AS place, '\\b' || regexp_replace(example, '([.-])', '\\\\\\1', 'g') || '\\b' AS pattern, gram, n FROM k ORDER BY place LIMIT 15")
def _(spark, sf):
    return sections.mine_patterns(S.read(spark, sf, "benchmark"), "text", "item_id")


@query("longest_ngrams", f"{MINED} SELECT gram, example, n, length FROM k")
def _(spark, sf):
    return sections.longest(sections.ngrams(S.read(spark, sf, "benchmark"), "text", "item_id"))


# ---------------------------------------------------------------- the label model by its overlap matrix
MATRIX = f"""WITH {MAJ}, vc AS (SELECT doc_id, target_field, target_value, lf_name, 2 * vote - 1 AS x FROM votes WHERE vote <> -1),
m AS (SELECT p.target_field, p.target_value, p.lf_name AS a, q.lf_name AS b, count(*) AS n, avg(CASE WHEN p.lf_name = q.lf_name THEN p.x ELSE p.x * q.x END) AS m FROM vc p JOIN vc q USING (doc_id, target_field, target_value) WHERE p.lf_name <= q.lf_name GROUP BY ALL)"""
FUSED = f"""{MATRIX}, s AS (SELECT target_field, target_value, a, b, m FROM m WHERE a <> b UNION ALL SELECT target_field, target_value, b, a, m FROM m WHERE a <> b),
q AS (SELECT x.target_field, x.target_value, x.a AS lf_name, x.m * y.m / z.m AS q FROM s x JOIN s y USING (target_field, target_value, a) JOIN s z ON z.target_field = x.target_field AND z.target_value = x.target_value AND z.a = x.b AND z.b = y.b WHERE x.b < y.b),
ac AS (SELECT target_field, target_value, lf_name, greatest(0.05, least(0.95, (1 + CASE WHEN q > 0 THEN sqrt(least(q, 1)) ELSE 0 END) / 2)) AS acc FROM q),
pr AS (SELECT target_field, target_value, greatest(0.01, least(0.99, (1 + sum(n * (2 * acc - 1) * m) / sum(n * (2 * acc - 1) * (2 * acc - 1))) / 2)) AS prior FROM ac JOIN m USING (target_field, target_value) WHERE m.a = m.b AND m.a = lf_name GROUP BY ALL),
z AS (SELECT doc_id, v.target_field, v.target_value, sum(CASE vote WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END * ln(acc / (1 - acc))) + max(ln(prior / (1 - prior))) AS z, count(*) FILTER (WHERE vote <> -1) AS cast_ FROM votes v JOIN ac USING (target_field, target_value, lf_name) JOIN pr USING (target_field, target_value) GROUP BY ALL)"""


@query("label_overlap_matrix", f"{MATRIX} SELECT target_field, target_value, a, b, n, round(m, 6) AS m FROM m")
def _(spark, sf):
    return label_matrix.overlap_matrix(S.votes(spark, sf))


#: The sample's only target with a model has three functions: one triple for each.
@query("label_model_from_overlaps", f"{FUSED} SELECT mv.doc_id, mv.target_field, round(CASE WHEN z IS NULL THEN probability WHEN cast_ = 0 THEN 0.5 ELSE 1 / (1 + exp(-z)) END, 6) AS probability, CASE WHEN z IS NULL THEN fit_status ELSE 'success_model' END AS fit_status, n_lfs_contributing FROM mv LEFT JOIN z USING (doc_id, target_field, target_value)")
def _(spark, sf):
    return label_matrix.fuse(S.votes(spark, sf)).select("doc_id", "target_field", "probability", "fit_status", "n_lfs_contributing")


# ---------------------------------------------------------------- strata with nulls
NULL_QUOTA = QUOTA.replace("g AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang)", "dn AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents), g AS (SELECT lang, count(*) AS size FROM dn GROUP BY lang)")


def _with_nulls(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))


@query("stratified_sample_with_nulls", f"WITH {NULL_QUOTA}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('11|' || doc_id::VARCHAR), doc_id) AS rn FROM dn) SELECT r.lang, doc_id FROM r JOIN q ON r.lang IS NOT DISTINCT FROM q.lang WHERE rn <= quota")
def _(spark, sf):
    return cohort.stratified(_with_nulls(spark, sf), "doc_id", "lang", 100, 11, near=16).select("lang", "doc_id")


@query("stratum_balance_with_nulls", f"WITH {NULL_QUOTA}, p AS (SELECT lang, 100.0 * size / sum(size) OVER () AS pp FROM g), s AS (SELECT lang, 100.0 * quota / sum(quota) OVER () AS sp FROM q) SELECT p.lang, round(pp::DOUBLE, 6) AS population_pct, round(sp::DOUBLE, 6) AS sample_pct, round(abs(pp - sp)::DOUBLE, 6) AS delta_pp, abs(pp - sp) <= 2 AS within FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang")
def _(spark, sf):
    d = _with_nulls(spark, sf)
    return cohort.balance(d, cohort.stratified(d, "doc_id", "lang", 100, 11), "lang")


from . import more, records  # noqa: E402, F401  register further queries
