"""Further queries: full reports, effects of model size, comparisons, clusters, and sources and sinks read back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains, labels, text
from ..functions.shared import scratch
from ..operators import agreement, audit, claims, cohort, embedding, label_matrix, longform, quality, resample, votes
from ..sources import readers, sinks
from ..streaming import run
from . import simulated as S
from .catalog import FP, FULL, FULL_KAPPA, FUSED, _models, query


# ---------------------------------------------------------------- reports over all kinds of fields
def features(spark: SparkSession, sf: str) -> DataFrame:
    """Records of three raters with all kinds of fields, from their three answers."""
    a = S.answers(spark, sf).groupBy("doc_id", "rater").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in S.FIELDS])
    long, many, digit = (F.col(f) for f in ("long_text", "multi_line", "has_digit"))
    tags = F.array_compact(F.array(F.when(long == "yes", "cardiac_hf"), F.when(many == "yes", "gi_bleed"), F.when(digit == "yes", "obstetric")))
    return a.select(
        "doc_id", "rater", tags.alias("admission_reason_tags"), F.when(long == "yes", "cardiac_hf").when(many == "yes", "gi_bleed").when(digit == "yes", "unheard_of").alias("dominant_admission_reason"),
        F.when(long == "yes", "independent").when(long == "no", "dependent").alias("functional_status"), F.when(many != "not_documented", many).alias("shock_present"), digit.alias("fall_risk_documented"),
    )


def _full_report(spark, sf):
    return agreement.full_report(longform.unpivot_features(features(spark, sf), enums=("functional_status",), tristates=("shock_present", "fall_risk_documented")))


REPORT = f"""WITH {S.WIDE}, x AS (SELECT doc_id, unnest(['A', 'B', 'C']) AS rater, field, unnest([a, b, c]) AS v FROM wide),
y AS (SELECT doc_id, rater, max(CASE WHEN field = 'long_text' THEN v END) AS lt, max(CASE WHEN field = 'multi_line' THEN v END) AS ml, max(CASE WHEN field = 'has_digit' THEN v END) AS hd FROM x GROUP BY ALL),
ans AS (SELECT doc_id, rater, 'admission_reason_tags:' || tag AS field, (CASE tag WHEN 'cardiac_hf' THEN lt = 'yes' WHEN 'gi_bleed' THEN ml = 'yes' WHEN 'obstetric' THEN hd = 'yes' ELSE false END)::INT::VARCHAR AS value, 'tag' AS field_group FROM y, (SELECT unnest({list(domains.TAGS)}) AS tag)
UNION ALL SELECT doc_id, rater, 'shock_present', ml, 'tristate' FROM y UNION ALL SELECT doc_id, rater, 'fall_risk_documented', hd, 'tristate' FROM y
UNION ALL SELECT doc_id, rater, 'functional_status', CASE lt WHEN 'yes' THEN 'independent' WHEN 'no' THEN 'dependent' ELSE 'None' END, 'enum' FROM y
UNION ALL SELECT doc_id, rater, 'dominant_admission_reason', CASE WHEN lt = 'yes' THEN 'cardiac_hf' WHEN ml = 'yes' THEN 'gi_bleed' ELSE 'other' END, 'dominant' FROM y),
pairs AS (SELECT p.field, p.rater || '_' || q.rater AS pair, p.value AS l, q.value AS r FROM ans p JOIN ans q ON p.doc_id = q.doc_id AND p.field = q.field AND p.rater < q.rater),
{S.kappa_sql('pairs', 'field, pair', 'kap')},
pos AS (SELECT field, field_group, sum((CASE field_group WHEN 'tag' THEN value = '1' WHEN 'tristate' THEN value = 'yes' ELSE value <> 'not_documented' END)::INT)::BIGINT AS n_positive FROM ans GROUP BY ALL),
rep AS (SELECT field, field_group, avg(kappa) AS kappa_mean, avg(pabak) AS pabak_mean, avg(agreement) AS agreement_mean, max(n_positive) AS n_positive, max(n_positive) < 10 AS low_base_rate, avg(kappa) < 0.6 AS below FROM kap JOIN pos USING (field) GROUP BY ALL)"""


@query("full_kappa_report", f"{REPORT} SELECT field, field_group, round(kappa_mean, 6) AS kappa_mean, round(pabak_mean, 6) AS pabak_mean, round(agreement_mean, 6) AS agreement_mean, n_positive, low_base_rate, below, CASE WHEN kappa_mean >= 0.8 THEN 'almost_perfect' WHEN kappa_mean >= 0.6 THEN 'substantial' WHEN kappa_mean >= 0.4 THEN 'moderate' ELSE 'low' END AS band FROM rep")
def _(spark, sf):
    return _full_report(spark, sf)


@query("kappa_by_group", f"{REPORT} SELECT field_group, count(*) AS n_fields, round(avg(kappa_mean), 6) AS mean_kappa, round(median(kappa_mean), 6) AS median_kappa FROM rep WHERE NOT low_base_rate GROUP BY field_group")
def _(spark, sf):
    return agreement.by_group(_full_report(spark, sf))


# ---------------------------------------------------------------- model size
EFFECT = f"WITH {FULL_KAPPA}, n AS (SELECT model, field, sum((a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT) AS n FROM wide GROUP BY ALL), inc AS (SELECT field FROM n GROUP BY field HAVING min(n) >= 10), d AS (SELECT field, pair, 100 * (max(CASE WHEN model = 'full' THEN kappa END) - max(CASE WHEN model = 'small' THEN kappa END)) AS d FROM kap GROUP BY ALL), f2 AS (SELECT field, median(d) AS d FROM d JOIN inc USING (field) GROUP BY field)"


@query("model_size_effect", f"{EFFECT} SELECT count(*) AS n_fields, round(median(d), 6) AS median_delta_pp, round(avg(d), 6) AS mean_delta_pp, sum((d < 0)::INT)::BIGINT AS n_negative FROM f2")
def _(spark, sf):
    both = S.answers(spark, sf).withColumn("model", F.lit("small")).unionByName(S.answers(spark, sf, "full").withColumn("model", F.lit("full")))
    return agreement.model_effect(_models(spark, sf), agreement.common_in_both(both))


@query("paired_model_size_ci")
def _(spark, sf):
    both = S.wide(spark, sf).withColumn("model", F.lit("small")).unionByName(S.wide(spark, sf, "full").withColumn("model", F.lit("full"))).withColumnRenamed("doc_id", "row_no")
    return resample.interval(resample.paired_models(both, 100, 20260523), ["filter", "statistic", "field"])


@query("kappa_dialects", "SELECT * FROM (VALUES ('one', 'constant', 1.0::DOUBLE), ('zero', 'constant', 0.0), ('nan', 'constant', 'nan'::DOUBLE), ('null', 'constant', NULL), ('one', 'apart', 0.0), ('zero', 'apart', 0.0), ('nan', 'apart', 0.0), ('null', 'apart', 0.0)) t(dialect, field, kappa)")
def _(spark, sf):
    """What a label alone on both sides counts as, over documents that all have it; sides that never agree are 0 in all."""
    d = S.read(spark, sf, "documents").select(F.explode(F.array(F.struct(F.lit("constant").alias("field"), F.lit("x").alias("left"), F.lit("x").alias("right")), F.struct(F.lit("apart").alias("field"), F.lit("x").alias("left"), F.lit("y").alias("right")))).alias("x")).select("x.*")
    out = [agreement.kappa(agreement.contingency(d, ["field"]), ["field"], on_constant=v).select(F.lit(n).alias("dialect"), "field", "kappa") for n, v in (("one", 1.0), ("zero", 0.0), ("nan", float("nan")), ("null", None))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


COMPARED = f"WITH {FULL_KAPPA}, m AS (SELECT model, field, avg(kappa) AS k FROM kap GROUP BY ALL), c AS (SELECT field, max(CASE WHEN model = 'small' AND field <> 'has_digit' THEN k END) AS first, max(CASE WHEN model = 'full' AND field <> 'multi_line' THEN k END) AS second, max(CASE WHEN model = 'full' AND field = 'long_text' THEN k END) AS third FROM m GROUP BY field)"


@query("samples_compared", f"{COMPARED} SELECT field, round(first, 6) AS first, round(second, 6) AS second, round(third, 6) AS third, concat_ws(',', CASE WHEN first IS NULL THEN 'first' END, CASE WHEN second IS NULL THEN 'second' END, CASE WHEN third IS NULL THEN 'third' END) AS lacking FROM c")
def _(spark, sf):
    m = agreement.mean_over_pairs(_models(spark, sf), ["model", "field"])
    full = m.where("model = 'full'")
    return agreement.compared({"first": m.where("model = 'small' and field != 'has_digit'"), "second": full.where("field != 'multi_line'"), "third": full.where("field = 'long_text'")})


# ---------------------------------------------------------------- joins, confusion, clusters, examples
@query("top_versioned_codes", "WITH g AS (SELECT l_partkey AS code, l_linenumber AS version, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT p_partkey AS code, (p_partkey % 7 + 1)::VARCHAR AS v, max(p_type) AS title FROM part GROUP BY ALL) SELECT g.code, version::BIGINT AS version, n, coalesce(title, '') AS title FROM g LEFT JOIN t ON t.code = g.code AND t.v = version::VARCHAR ORDER BY n DESC, g.code, version LIMIT 20")
def _(spark, sf):
    codes = S.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("code"), F.col("l_linenumber").alias("version"))
    titles = S.read(spark, sf, "part").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") % 7 + 1).cast("string").alias("version"), F.col("p_type").alias("title"))
    return cohort.top_versioned_codes(codes, titles, 20)


@query("off_diagonal_confusion", f"{REPORT}, tg AS (SELECT doc_id, rater, list_filter([CASE WHEN lt = 'yes' THEN 'cardiac_hf' END, CASE WHEN ml = 'yes' THEN 'gi_bleed' END, CASE WHEN hd = 'yes' THEN 'obstetric' END], lambda x: x IS NOT NULL) AS tags FROM y), tp AS (SELECT p.rater || '_' || q.rater AS pair, p.tags AS l, q.tags AS r FROM tg p JOIN tg q ON p.doc_id = q.doc_id AND p.rater < q.rater), o AS (SELECT pair, unnest(list_filter(l, lambda x: NOT list_contains(r, x))) AS l, list_filter(r, lambda x: NOT list_contains(l, x)) AS rr FROM tp), o2 AS (SELECT pair, l, unnest(rr) AS r FROM o), g AS (SELECT pair, l, r, count(*) AS n FROM o2 GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY pair, l) AS s, row_number() OVER (PARTITION BY pair ORDER BY n DESC, l, r) AS place FROM g) SELECT pair, l AS \"left\", r AS \"right\", n, round(s, 6) AS row_share, place FROM w WHERE place <= 10")
def _(spark, sf):
    t = features(spark, sf).groupBy("doc_id").agg(*[F.first(F.when(F.col("rater") == r, F.col("admission_reason_tags")), ignorenulls=True).alias(r) for r in "ABC"])
    return agreement.off_diagonal(agreement.multilabel_confusion(longform.pairs(t, keep=("doc_id",)), ["pair"]), ["pair"])


CLUSTERS = "b AS (SELECT source || '_' || (n_chars // 500)::VARCHAR AS cluster_id, doc_id FROM documents)"


@query("new_clusters", f"WITH {CLUSTERS}, g AS (SELECT cluster_id, count(*) AS n FROM b WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT cluster_id, n FROM g WHERE n > 1 AND cluster_id NOT IN (SELECT cluster_id FROM b WHERE doc_id % 3 = 0)")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("_"), F.floor(F.col("n_chars") / 500).cast("string")).alias("cluster_id"))
    before, after = (d.where(x).groupBy("cluster_id").agg(F.count("*").alias("n")) for x in ("doc_id % 3 = 0", "doc_id % 3 != 0"))
    return audit.new_clusters(before, after, 1)


@query("quota_examples", "WITH r AS (SELECT source AS cluster_id, lang AS record_id, count(*) AS weight, list(doc_id ORDER BY doc_id) AS ex FROM documents GROUP BY ALL), q AS (SELECT *, greatest(round_even(weight / sum(weight) OVER (PARTITION BY cluster_id) * 8, 0), 1) AS quota FROM r), e AS (SELECT cluster_id, record_id, quota, weight, unnest(ex) AS example, generate_subscripts(ex, 1) - 1 AS pos FROM q), p AS (SELECT cluster_id, record_id, example, row_number() OVER (PARTITION BY cluster_id ORDER BY (pos >= quota)::INT, weight DESC, record_id, pos) AS place FROM e) SELECT cluster_id, place, record_id, example FROM p WHERE place <= 8")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select(F.col("source").alias("cluster_id"), F.col("lang").alias("record_id"), F.col("doc_id").alias("example"))
    return audit.quota_examples(d.join(d.groupBy("cluster_id", "record_id").agg(F.count("*").alias("weight")), ["cluster_id", "record_id"]))


@query("thinned_rates", "WITH t AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM t WHERE (rn - 1) % greatest(ceil(n / 100), 1)::BIGINT = 0 OR rn = n")
def _(spark, sf):
    return quality.thinned(S.read(spark, sf, "events").select("event_type", "event_id", "ts"), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


@query("equal_lists", "WITH x AS (SELECT doc_id, string_split(lang || ',' || source || ',' || lang, ',') AS a, string_split(source || ',' || lang, ',') AS b FROM documents) SELECT list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same, count(*) AS n FROM x GROUP BY ALL")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select(F.array("lang", "source", "lang").alias("a"), F.array("source", "lang").alias("b"))
    same = labels.canonical_list(F.col("a")).eqNullSafe(labels.canonical_list(F.col("b")))
    return d.groupBy(same.alias("same")).agg(F.count("*").alias("n"))


@query("first_words", "SELECT array_to_string(list_slice(regexp_split_to_array(lower(text), '\\s+'), 1, 5), ' ') AS key, count(*) AS n FROM benchmark GROUP BY ALL")
def _(spark, sf):
    return S.read(spark, sf, "benchmark").groupBy(text.first_words(F.col("text")).alias("key")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources and sinks
def run_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a run in order of their ids: every eleventh has failed."""
    e = S.read(spark, sf, "events")
    ok = F.col("event_id") % 11 != 0
    return e.select(F.col("user_id").cast("long").alias("hadm_id"), ok.alias("parse_ok"), F.when(ok, F.struct(F.array("event_type").alias("admission_reason_tags"), F.col("event_type").alias("dominant_admission_reason"), F.col("event_id").cast("int").alias("new_meds_started_count"))).alias("features_json"), "event_id")


def write_run(spark: SparkSession, sf: str) -> str:
    path = scratch(spark, "run")
    run_lines(spark, sf).repartitionByRange(4, "event_id").sortWithinPartitions("event_id").drop("event_id").write.json(path)
    return path


LAST = "WITH k AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id % 11 <> 0 GROUP BY user_id), l AS (SELECT user_id AS hadm_id, event_id, event_type FROM events JOIN k USING (user_id, event_id))"


@query("jsonl_last_ok", f"{LAST} SELECT hadm_id, event_type AS dominant_admission_reason, event_id AS new_meds_started_count, 'A' AS variant FROM l")
def _(spark, sf):
    return readers.flat(readers.jsonl_run(spark, write_run(spark, sf)), "A").select("hadm_id", "dominant_admission_reason", "new_meds_started_count", "variant")


@query("jsonl_within_split", f"{LAST} SELECT hadm_id, event_type AS dominant_admission_reason FROM l WHERE hadm_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark, sf):
    path = scratch(spark, "split")
    S.read(spark, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise("unreadable").alias("hadm_id")).write.option("header", True).csv(path)
    return cohort.within(readers.flat(readers.jsonl_run(spark, write_run(spark, sf)), "A"), readers.split_ids(spark, path), "hadm_id").select("hadm_id", "dominant_admission_reason")


@query("payload_files", "SELECT n_nationkey::BIGINT AS hadm_id, n_name AS raw_response FROM nation")
def _(spark, sf):
    path = scratch(spark, "payloads")
    n = S.read(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("hadm_id"), F.col("n_name").alias("raw_response"))
    n.write.option("maxRecordsPerFile", 1).json(path)
    return readers.payloads(spark, path).select("hadm_id", "raw_response")


@query("log_span", "SELECT min(date_trunc('second', ts)) AS first, max(date_trunc('second', ts)) AS last, round((epoch(max(date_trunc('second', ts))) - epoch(min(date_trunc('second', ts)))) / 3600.0, 6) AS hours FROM events")
def _(spark, sf):
    path = scratch(spark, "log")
    e = S.read(spark, sf, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 INFO call "), F.col("event_id").cast("string"))
    e.select(F.explode(F.array(line, F.lit("  continued"))).alias("value")).write.text(path)
    return readers.log_hours(spark, path)


@query("cost_states", "WITH x AS (SELECT event_type AS run_id, arg_max(event_id, event_id) AS n FROM events GROUP BY ALL) SELECT run_id, n::BIGINT AS n_calls, round(n * 0.25, 6) AS total_cost_usd FROM x")
def _(spark, sf):
    path = scratch(spark, "costs")
    e = S.read(spark, sf, "events")
    e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ts"), F.lit("call").alias("event"), F.col("event_type").alias("run_id"), F.col("event_id").alias("n_calls"), (F.col("event_id") * 0.25).cast("double").alias("total_cost_usd")).write.json(path)
    return readers.cost_state(spark, path).select("run_id", "n_calls", "total_cost_usd")


@query("markdown_cells", "SELECT n_name AS name, (n_nationkey * 1000 + n_regionkey)::DOUBLE AS number FROM nation")
def _(spark, sf):
    path = scratch(spark, "markdown")
    row = F.concat(F.lit("| "), F.col("n_name"), F.lit(" | `"), F.format_number(F.col("n_nationkey") * 1000 + F.col("n_regionkey"), 0), F.lit("`% |"))
    rows = S.read(spark, sf, "nation").select(F.col("n_nationkey").alias("at"), row.alias("line")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("rows"))  # a short document
    rows.select(F.concat(F.lit("# Other\n| no | 1 |\n\n# Table 1\n\n| name | number |\n| --- | --- |\n"), "rows", F.lit("\n\n| later | 2 |\n"))).coalesce(1).write.text(path)
    t = readers.markdown_table(spark, path, "# Table 1").where("cells[0] != 'name'")
    return t.select(F.col("cells")[0].alias("name"), readers.first_number(F.col("cells")[1]).alias("number"))


@query("discovered_tables", "SELECT * FROM (VALUES ('entries', 'sf', 'lineitem'), ('notes', 'sf', 'documents')) t(logical, table_schema, table_name)")
def _(spark, sf):
    """The tables of the folder by their columns; a table of the right name without the columns is passed over."""
    rows = [("sf", n, c) for n in ("lineitem", "documents", "events") for c in S.read(spark, sf, n).columns]  # a row for each column
    wanted = {"notes": (["events", "documents"], ["doc_id", "text"]), "entries": (["lineitem"], ["l_partkey"])}
    return readers.discover(spark.createDataFrame(rows, "table_schema string, table_name string, column_name string"), wanted)


@query("features_sink", "SELECT doc_id AS hadm_id, coalesce(max(CASE WHEN doc_id % 2 = 0 THEN lang END), '') AS tags FROM documents GROUP BY doc_id")
def _(spark, sf):
    path = scratch(spark, "features")
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("hadm_id"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("admission_reason_tags"))
    sinks.features(d.unionByName(d), path)
    return spark.read.parquet(path).select("hadm_id", F.array_join("admission_reason_tags", ",").alias("tags"))


@query("payload_sink", "SELECT event_id, json_object('k', event_id % 5)::VARCHAR AS features_json FROM events")
def _(spark, sf):
    path = scratch(spark, "raw")
    sinks.payloads(S.read(spark, sf, "events").select("event_id", F.struct((F.col("event_id") % 5).alias("k")).alias("features_json")), path)
    return spark.read.parquet(path)


@query("split_sink", "SELECT doc_id::VARCHAR AS doc_id, lang FROM documents")
def _(spark, sf):
    path = scratch(spark, "split")
    sinks.split(S.read(spark, sf, "documents").select("doc_id", "lang"), path, "lang", {"en": 1})
    return spark.read.option("header", True).csv(path)


@query("split_manifest", "SELECT lang, count(*) AS n, (SELECT count(*) FROM documents) AS rows, 'r1' AS revision FROM documents GROUP BY lang")
def _(spark, sf):
    path = scratch(spark, "split")
    sinks.split(S.read(spark, sf, "documents").select("doc_id", "lang"), path, "lang", {"en": 1}, revision="r1")
    m = spark.read.json(f"{path}.manifest")
    return m.select(F.explode(F.from_json("counts", "map<string,long>")).alias("lang", "n"), F.col("rows").cast("long").alias("rows"), "revision")


@query("appended_run", "SELECT DISTINCT user_id AS hadm_id FROM events")
def _(spark, sf):
    path = scratch(spark, "run")
    users = S.read(spark, sf, "events").select(F.col("user_id").alias("hadm_id")).distinct()
    sinks.append_run(users.where("hadm_id % 3 = 0"), path)
    sinks.append_run(users, path)
    return spark.read.json(path)


@query("resumed_run", "SELECT DISTINCT user_id FROM events WHERE user_id % 3 <> 0")
def _(spark, sf):
    users = S.read(spark, sf, "events").select("user_id").distinct()
    return readers.pending(users, users.where("user_id % 3 = 0"), "user_id")


@query("still_failed", "SELECT event_id FROM events WHERE event_id % 7 = 0 AND event_id % 2 <> 0")
def _(spark, sf):
    e = S.read(spark, sf, "events").select("event_id")
    return readers.still_failed(e.where("event_id % 7 = 0"), e.where("event_id % 2 = 0"), "event_id")


@query("disjoint_union", "SELECT doc_id FROM documents")
def _(spark, sf):
    d = S.read(spark, sf, "documents").select("doc_id")
    return longform.disjoint_union(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id")


@query("rare_fields", f"WITH {FULL}, n AS (SELECT model, field, sum((a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT) AS n FROM wide GROUP BY ALL) SELECT field FROM n GROUP BY field HAVING min(n) >= 100")
def _(spark, sf):
    both = S.answers(spark, sf).withColumn("model", F.lit("small")).unionByName(S.answers(spark, sf, "full").withColumn("model", F.lit("full")))
    return agreement.common_in_both(both, 100)


@query("cluster_reduction", f"WITH {S.KAPPA} SELECT pair, round(100.0 * (count(*) - count(*) FILTER (kappa < 0.6)) / count(*), 6) AS reduction FROM kap GROUP BY pair")
def _(spark, sf):
    k = agreement.kappa(agreement.contingency(S.pairs(spark, sf), FP), FP)
    return k.groupBy("pair").agg(F.count("*").alias("first"), F.count_if(F.col("kappa") < 0.6).alias("last")).select("pair", audit.reduction_pct(F.col("first"), F.col("last")).alias("reduction"))


# ---------------------------------------------------------------- bootstraps by document weights
def draws_sql(seed: int, reps: int) -> str:
    """CTE dw(doc_id, rep, w): the weights of resample.document_weights()."""
    at = f"('0x' || substr(md5('{seed}|' || (rep // 4)::VARCHAR || '|' || doc_id::VARCHAR), (1 + 8 * (rep % 4))::INT, 8))::BIGINT"
    return f"dw AS (SELECT doc_id, rep, len(list_filter({list(resample.POISSON)}::BIGINT[], lambda c: c <= {at})) AS w FROM documents, range({reps}) r(rep))"


@query("weighted_bootstrap_kappa_ci", f"WITH {S.PAIRS}, {draws_sql(42, 60)}, wp AS (SELECT field, pair, rep, l, r, w FROM pairs JOIN dw USING (doc_id) WHERE w > 0), {S.kappa_sql('wp', 'field, pair, rep', 'kw', 'sum(w)')} SELECT field, pair, round(quantile_cont(kappa, 0.025), 6) AS low, round(quantile_cont(kappa, 0.975), 6) AS high, count(kappa) AS n_finite FROM kw GROUP BY ALL")
def _(spark, sf):
    k = resample.weighted_kappas(S.pairs(spark, sf).withColumnRenamed("doc_id", "row_no"), 60, 42)
    return resample.interval(k.withColumnRenamed("kappa", "value"), FP)


MODELS = f"""WITH {S.WIDE}, {draws_sql(20260523, 40)}, b AS (SELECT doc_id, 'small' AS model, field, a, b, c FROM wide UNION ALL SELECT doc_id, 'full', field, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE a END, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE b END, CASE WHEN doc_id % 5 = 0 THEN 'not_documented' ELSE c END FROM wide),
x AS (SELECT b.*, rep, w FROM b JOIN dw USING (doc_id) WHERE w > 0 UNION ALL SELECT b.*, -1, 1 FROM b),
often AS (SELECT rep, field, min(n) AS n FROM (SELECT rep, field, model, sum(((a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT) * w) AS n FROM x GROUP BY ALL) GROUP BY ALL HAVING min(n) >= 10),
pw AS (SELECT rep, model, field, 'A_B' AS pair, a AS l, b AS r, w FROM x WHERE rep >= 0 UNION ALL SELECT rep, model, field, 'A_C', a, c, w FROM x WHERE rep >= 0 UNION ALL SELECT rep, model, field, 'B_C', b, c, w FROM x WHERE rep >= 0),
{S.kappa_sql('pw', 'rep, model, field, pair', 'km', 'sum(w)')},
both_ AS (SELECT km.*, 'fixed' AS filter FROM km WHERE field IN (SELECT field FROM often WHERE rep = -1) UNION ALL SELECT km.*, 'dynamic' FROM km JOIN often USING (rep, field)),
d AS (SELECT rep, filter, field, median(dd) AS v FROM (SELECT rep, filter, field, pair, 100 * (max(kappa) FILTER (WHERE model = 'full') - max(kappa) FILTER (WHERE model = 'small')) AS dd FROM both_ GROUP BY ALL) GROUP BY ALL),
s AS (SELECT rep, filter, NULL AS field, unnest(['median_delta', 'mean_delta', 'negative_share']) AS statistic, unnest([median(v), avg(v), avg((v < 0)::INT)]) AS v FROM d GROUP BY rep, filter
UNION ALL SELECT rep, filter, NULL, 'pooled_delta', 100 * (median(kappa) FILTER (WHERE model = 'full') - median(kappa) FILTER (WHERE model = 'small')) FROM both_ GROUP BY rep, filter UNION ALL SELECT rep, filter, field, 'delta', v FROM d)"""


@query("weighted_model_size_ci", f"{MODELS} SELECT filter, statistic, field, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS n_finite FROM s GROUP BY ALL")
def _(spark, sf):
    both = S.wide(spark, sf).withColumn("model", F.lit("small")).unionByName(S.wide(spark, sf, "full").withColumn("model", F.lit("full"))).withColumnRenamed("doc_id", "row_no")
    return resample.interval(resample.weighted_models(both, 40, 20260523), ["filter", "statistic", "field"])


# ---------------------------------------------------------------- a run as a stream
@query("checkpointed_run", "SELECT doc_id, n_chars, length(text) AS n, n_chars / 1000.0 AS cost FROM documents")
def _(spark, sf):
    """The first start is stopped by its budget, the second one goes on from its checkpoint. Files of notes are as many as the
    input's partitions ask for, in three batches."""
    d, table, out, checkpoint = S.read(spark, sf, "documents"), scratch(spark, "notes"), scratch(spark, "run"), scratch(spark, "checkpoint")
    d.select("doc_id", "text", "n_chars").repartition(3 * max(1, d.rdd.getNumPartitions()), "doc_id").write.parquet(table)
    a_third = max(1, -(-len(spark.read.parquet(table).inputFiles()) // 3))
    total = d.agg(F.sum("n_chars")).first()[0] or 0
    extract = lambda b: b.select(F.col("doc_id").alias("note"), "n_chars", F.length("text").alias("n"), (F.col("n_chars") / 1000).alias("cost"))
    for budget in (total / 3000, None):
        stream = spark.readStream.schema("doc_id long, text string, n_chars long").option("maxFilesPerTrigger", a_third).parquet(table)
        try:
            run.start(stream, extract, out, checkpoint, budget, note_files=False).awaitTermination()
        except StreamingQueryException as e:
            if "BudgetReached" not in str(e):
                raise
    return run.records(spark, out).withColumnRenamed("note", "doc_id")


# ---------------------------------------------------------------- pattern files
@query("pattern_files", """WITH f AS (SELECT item_id, item_id % 5 = 1 AS no_target, item_id % 7 = 2 AS no_list, item_id % 3 = 0 AS compound, item_id % 6 = 3 AS bad_window, split_part(text, ' ', 1) AS w, split_part(text, ' ', 2) AS w2 FROM benchmark),
e AS (SELECT item_id, 'missing target_value' AS error FROM f WHERE no_target UNION ALL SELECT item_id, 'regex_patterns is not a list' FROM f WHERE no_list UNION ALL SELECT item_id, 'compound_patterns[0].window_chars is not a whole number' FROM f WHERE compound AND bad_window)
SELECT item_id, 'field_' || item_id AS field_name, 'yes' AS target_value, [w, w2] AS regex_patterns, CASE WHEN compound THEN 2 ELSE 0 END AS n_words, NULL AS error FROM f WHERE item_id NOT IN (SELECT item_id FROM e) UNION ALL SELECT item_id, NULL, NULL, NULL, NULL, error FROM e""")
def _(spark, sf):
    i, w = F.col("item_id"), F.split("text", " ")
    words = F.array(F.coalesce(F.get(w, 0), F.lit("")), F.coalesce(F.get(w, 1), F.lit("")))
    compound = F.when(i % 3 == 0, F.array(F.struct(words.alias("all_of"), F.when(i % 6 == 3, F.lit(0.5)).otherwise(F.lit(None)).alias("wrong"))))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("field_name: field_"), i.cast("string")), F.when(i % 5 != 1, F.lit("target_value: 'yes'")), F.concat(F.lit("regex_patterns: "), F.when(i % 7 == 2, F.lit("none")).otherwise(F.to_json(words))),
        F.when(compound.isNotNull(), F.concat(F.lit("compound_patterns: [{all_of: "), F.to_json(words), F.lit(", window_chars: "), F.when(i % 6 == 3, F.lit("0.5")).otherwise(F.lit("40")), F.lit("}]"))),
    )
    folder = scratch(spark, "patterns")
    S.read(spark, sf, "benchmark").select("item_id", lines.alias("value")).write.partitionBy("item_id").text(folder)
    t = readers.pattern_files(spark, folder)
    return t.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "field_name", "target_value", "regex_patterns", F.size(F.flatten("compound_patterns.all_of")).alias("n_words"), "error")


# ---------------------------------------------------------------- edge rules, predictions, lists
DIALECTS = {"paper": (0.0, 1.0), "nan": (float("nan"), float("nan")), "null": (None, None), "strict": (1.0, 0.0)}
BY_LANGUAGE = """WITH d AS (SELECT source, lang, lang AS l, CASE WHEN doc_id % 3 = 0 THEN 'en' ELSE lang END AS r, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS w FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
c AS (SELECT source, lang, l, r, sum(w) AS n FROM d GROUP BY ALL), t AS (SELECT source, lang, sum(n)::DOUBLE AS n, sum(CASE WHEN l = r THEN n ELSE 0 END)::DOUBLE AS agree FROM c GROUP BY ALL),
a AS (SELECT source, lang, l AS v, sum(n)::DOUBLE AS n FROM c GROUP BY ALL), b AS (SELECT source, lang, r AS v, sum(n)::DOUBLE AS n FROM c GROUP BY ALL), e AS (SELECT source, lang, sum(a.n * b.n) AS e FROM a JOIN b USING (source, lang, v) GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('paper', 0.0::DOUBLE, 1.0::DOUBLE), ('nan', 'nan'::DOUBLE, 'nan'::DOUBLE), ('null', NULL, NULL), ('strict', 1.0, 0.0)) x(dialect, on_empty, on_constant))"""


@query("kappa_edge_rules", f"{BY_LANGUAGE} SELECT dialect, source, lang, t.n::BIGINT AS n, round(CASE WHEN t.n = 0 THEN on_empty WHEN coalesce(e, 0) = t.n * t.n THEN on_constant ELSE (t.n * agree - coalesce(e, 0)) / (t.n * t.n - coalesce(e, 0)) END, 6) AS kappa FROM t LEFT JOIN e USING (source, lang), x")
def _(spark, sf):
    """Groups without pairs, with one label on both sides throughout, and others, under each set of rules."""
    d = S.read(spark, sf, "documents").where("lang is not null and source is not null")
    d = d.select("source", "lang", F.col("lang").alias("left"), F.when(F.col("doc_id") % 3 == 0, "en").otherwise(F.col("lang")).alias("right"), F.when(F.col("lang") == "fr", 0).otherwise(1).alias("w"))
    table, out = agreement.contingency(d, ["source", "lang"], F.col("w")), None
    for name, (empty, constant) in DIALECTS.items():
        k = agreement.kappa(table, ["source", "lang"], empty, constant).select(F.lit(name).alias("dialect"), "source", "lang", "n", "kappa")
        out = k if out is None else out.unionByName(k)
    return out


@query("predictions_with_consensus", f"{FUSED}, cs AS (SELECT doc_id, CASE WHEN (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT > (a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT THEN 1.0 WHEN (a = 'yes')::INT + (b = 'yes')::INT + (c = 'yes')::INT < (a = 'no')::INT + (b = 'no')::INT + (c = 'no')::INT THEN 0.0 ELSE 0.5 END::DOUBLE AS consensus FROM ({S.WIDE0[len('wide0 AS ('):-1]}) WHERE field = 'long_text'), p AS (SELECT mv.doc_id, mv.target_field, mv.target_value, round(CASE WHEN z IS NULL THEN probability WHEN cast_ = 0 THEN 0.5 ELSE 1 / (1 + exp(-z)) END, 6) AS probability, CASE WHEN z IS NULL THEN fit_status ELSE 'success_model' END AS fit_status FROM mv LEFT JOIN z USING (doc_id, target_field, target_value)) SELECT p.*, consensus, abs(probability - consensus) > 0.3 AS apart, md5(text) AS text_key, length(text) AS n_text FROM p JOIN cs USING (doc_id) JOIN documents USING (doc_id)")
def _(spark, sf):
    """What the model says of each document and target beside what three raters say of its length, and the document's text."""
    c = S.wide(spark, sf).where("field = 'long_text'").select("doc_id", votes.consensus(F.col("A"), F.col("B"), F.col("C"), "tristate").alias("consensus"))
    p = label_matrix.fuse(S.votes(spark, sf)).drop("n_lfs_total", "n_lfs_contributing")
    d = S.read(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_key"), F.char_length("text").alias("n_text"))
    p = p.withColumn("probability", F.round("probability", 6)).join(c, "doc_id").join(d, "doc_id")
    return p.withColumn("apart", F.abs(F.col("probability") - F.col("consensus")) > 0.3)


@query("lists_compared", f"WITH {S.TAGS} SELECT pair, list_sort(l) = list_sort(r) AS same, count(*) AS n, sum(len(l) - len(r))::BIGINT AS more FROM tp GROUP BY ALL")
def _(spark, sf):
    t = S.tag_pairs(spark, sf)
    same = labels.canonical_list(F.reverse("left")).eqNullSafe(labels.canonical_list(F.concat("right", "right")))
    return t.groupBy("pair", same.alias("same")).agg(F.count("*").alias("n"), F.sum(F.size("left") - F.size("right")).alias("more"))


# ---------------------------------------------------------------- a user's functions, vectors of sections
@query("user_votes", "SELECT doc_id, unnest(['long', 'digits', 'english']) AS lf_name, unnest(['quality', 'quality', 'language']) AS target_field, unnest(['high', 'high', 'en']) AS target_value, unnest([CASE WHEN n_chars > 1500 THEN 1 WHEN n_chars < 300 THEN 0 ELSE -1 END, CASE WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) >= 3 THEN 1 ELSE -1 END, CASE WHEN lang IS NULL THEN -1 WHEN lang = 'en' THEN 1 ELSE 0 END])::BIGINT AS vote FROM documents")
def _(spark, sf):
    mine = votes.Catalogue()

    @mine.register("long", "quality", "high")
    def _():
        return F.when(F.col("n_chars") > 1500, 1).when(F.col("n_chars") < 300, 0)

    @mine.register("digits", "quality", "high")
    def _():
        @F.pandas_udf("int")
        def digits(texts):
            return texts.fillna("").str.count("[0-9]").ge(3).map({True: 1, False: -1})

        return digits(F.col("text"))

    @mine.register("english", "language", "en")
    def _():
        return (F.col("lang") == "en").cast("int")

    return mine.votes(S.read(spark, sf, "documents"))


@query("section_vectors", "WITH d AS (SELECT doc_id, lang, regexp_replace(replace(text, ':', ';'), '^\\s+|\\s+$', '', 'g') AS t FROM documents), v AS (SELECT lang, embedding FROM d JOIN embeddings ON vec_id = doc_id WHERE length(t) >= 20) SELECT lang, count(*) AS n, 64 AS dims, round(avg(embedding[1]), 6) AS first, round(avg(embedding[64]), 6) AS last FROM v GROUP BY lang")
def _(spark, sf):
    """Vectors stand for the texts of documents of the same number."""
    d = S.read(spark, sf, "documents")
    note = F.concat(F.lit("intro\nChief Complaint:\n pain "), F.coalesce("lang", F.lit("")), F.lit("\nHospital Course:\n"), F.translate("text", ":", ";"), F.lit("\n"))
    rows = embedding.section_rows(d.select("doc_id", note.alias("text")), ["Chief Complaint", "Hospital Course"])
    e = S.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    t = rows.where("section = 'Hospital Course'").join(e, "doc_id").join(d.select("doc_id", "lang"), "doc_id")
    t = embedding.pooled(t, ["lang"])
    return t.select("lang", "n", F.size("vec").alias("dims"), F.get("vec", 0).alias("first"), F.get("vec", 63).alias("last"))


# ---------------------------------------------------------------- claims
def published() -> claims.Claims:
    """Quantities of the tables as claims."""
    c = claims.Claims()
    c.register("documents", ["documents"], "documents", ".0f")(lambda d: d.agg(F.count("*")))
    c.register("languages", ["documents"], "languages", ".0f")(lambda d: d.agg(F.count_distinct("lang")))
    c.register("median_chars", ["documents"], "median length", ".1f")(lambda d: d.agg(F.median("n_chars")))
    c.register("labelled_pct", ["documents", "labels"], "share of documents with a label", ".1f")(lambda d, x: d.join(x.select("doc_id").distinct().withColumn("has", F.lit(1)), "doc_id", "left").agg(100.0 * F.count("has") / F.count("*")))
    c.register("toxic_pct", ["labels"], "share of toxic labels", ".2f")(lambda x: x.agg(100.0 * F.avg("toxic")))
    c.register("quality_kappa", ["labels"], "agreement of quality and not toxic", ".3f")(lambda x: agreement.kappa(agreement.contingency(x.where("quality is not null and toxic is not null").select(F.lit("q").alias("field"), F.col("quality").cast("string").alias("left"), (1 - F.col("toxic")).cast("string").alias("right")), ["field"]), ["field"]).select("kappa"))
    c.register("calls", ["events"], "calls", ".0f")(lambda e: e.agg(F.count("*")))
    c.register("mean_value", ["events"], "mean of values", ".3f")(lambda e: e.agg(F.avg("value")))
    c.register("turns_per_conversation", ["conversations"], "mean number of turns", ".2f")(lambda t: t.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.avg("n")))
    c.register("order_total", ["orders"], "sum of order prices", ".2f")(lambda o: o.agg(F.sum("o_totalprice").cast("double")))
    c.register("benchmark_words", ["benchmark"], "mean words of an item", ".1f")(lambda b: b.agg(F.avg(text.word_count(F.col("text")))))
    c.register("vector_labels", ["embeddings"], "labels of vectors", ".0f")(lambda e: e.agg(F.count_distinct("label")))
    return c


_VALUES = """WITH v AS (SELECT 'documents' AS key, count(*)::DOUBLE AS value FROM documents UNION ALL SELECT 'languages', count(DISTINCT lang) FROM documents UNION ALL SELECT 'median_chars', median(n_chars) FROM documents
UNION ALL SELECT 'labelled_pct', 100.0 * count(x.doc_id) / count(*) FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) x ON x.doc_id = d.doc_id UNION ALL SELECT 'toxic_pct', 100 * avg(toxic) FROM labels
UNION ALL SELECT 'quality_kappa', (SELECT CASE WHEN e = n * n THEN 1 ELSE (n * s - e) / (n * n - e) END FROM (SELECT n, s, q * t + (n - q) * (n - t) AS e FROM (SELECT count(*)::DOUBLE AS n, sum((quality = 1 - toxic)::INT)::DOUBLE AS s, sum(quality)::DOUBLE AS q, sum(1 - toxic)::DOUBLE AS t FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)))
UNION ALL SELECT 'calls', count(*) FROM events UNION ALL SELECT 'mean_value', avg(value) FROM events UNION ALL SELECT 'turns_per_conversation', (SELECT avg(n) FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id))
UNION ALL SELECT 'order_total', sum(o_totalprice)::DOUBLE FROM orders UNION ALL SELECT 'benchmark_words', (SELECT avg(len(regexp_extract_all(text, '\\S+'))) FROM benchmark) UNION ALL SELECT 'vector_labels', count(DISTINCT label) FROM embeddings)"""


@query("claim_registry", f"{_VALUES} SELECT key, round(value, 4) AS value, CASE WHEN key IN ('toxic_pct', 'quality_kappa', 'labelled_pct') THEN 'computed' ELSE 'kept' END AS status FROM v")
def _(spark, sf):
    """All claims, then again after one table has changed: those of the other tables are kept."""
    names = ["documents", "labels", "events", "conversations", "orders", "benchmark", "embeddings"]
    paths, c, old = {n: f"{sf}/{n}.parquet" for n in names}, published(), scratch(spark, "labels")
    S.read(spark, sf, "labels").unionByName(S.read(spark, sf, "labels").limit(1)).write.parquet(old)
    first = c.recompute(spark, paths | {"labels": old})
    return c.recompute(spark, paths, first).select("key", F.round("value", 4).alias("value"), "status")
