"""Assembled audit records, smoke examples and strict gates on small tables, against plain Python."""

import random

from pyspark.sql import functions as F

from tallyloom.functions import domains
from tallyloom.operators import cohort, longform, quality, records, votes
from tallyloom.plans import records as plans
from tests.core.test_sources import plain_examples


def answers(spark, rows):
    schema = "doc_id long, rater string, admission_reason_tags array<string>, dominant_admission_reason string, functional_status string, shock_present string"
    return longform.unpivot_features(spark.createDataFrame(rows, schema), domains.TAGS, ("functional_status",), ("shock_present",))


def test_audit_records(spark):
    rng = random.Random(3)
    rows = [(i, r, rng.sample(["obstetric", "gi_bleed"], rng.randrange(3)), rng.choice(["obstetric", "unheard of", None]), rng.choice(["independent", "dependent", "not_documented", None]), rng.choice(["yes", "no", None])) for i in range(30) for r in "ABC"]
    rows += [(99, "A", ["other"], None, None, "yes")]  # only one rater: takes no part
    codes = spark.createDataFrame([(i, f"c{i}" if i % 3 else None, f"ch{i % 4}" if i % 5 else None) for i in range(29)], "doc_id long, primary_code string, chapter string")
    reasons = spark.createDataFrame([(i, r, f"{r} says  \n {i} " + "long " * 300 if i % 2 else None) for i in range(30) for r in "ABC"], "doc_id long, rater string, reasoning string")
    got = {(r.field, r.target_value): r for r in records.audit_records(answers(spark, rows), codes, reasons).collect()}
    by = {(i, r): x for i, r, *x in rows}
    read = {
        ("shock_present", None): ("tristate", lambda x: x[3] or "not_documented", lambda v: v == "yes"),
        ("functional_status", None): ("enum", lambda x: x[2] or "None", lambda v: v != "not_documented"),
        ("dominant_admission_reason", None): ("dominant", lambda x: x[1] if x[1] in domains.TAGS else "other", lambda v: v != "not_documented"),
        ("admission_reason_tags", "obstetric"): ("admission_tag", lambda x: "present" if "obstetric" in x[0] else "absent", lambda v: v == "present"),
        ("admission_reason_tags", "gi_bleed"): ("admission_tag", lambda x: "present" if "gi_bleed" in x[0] else "absent", lambda v: v == "present"),
    }
    assert set(got) == set(read)  # the tag of the document with one rater has no record
    for key, (kind, value, positive) in read.items():
        r, w = got[key], {i: [value(by[i, x]) for x in "ABC"] for i in range(30)}
        apart = {i: v for i, v in w.items() if len(set(v)) > 1}
        assert (r.field_type, r.disagreement_count) == (kind, len(apart))
        n = [sum(positive(v[x]) for v in w.values()) for x in range(3)]
        assert [r.n_positive_A, r.n_positive_B, r.n_positive_C, r.n_positive_total] == [*n, sum(n)] and r.low_base_rate == (sum(n) < 10)
        want = plain_examples([("f", "|".join(v), i, f"ch{i % 4}" if i % 5 else None) for i, v in apart.items() if i < 29])
        assert [e.doc_id for e in r.examples] == [x[1] for x in sorted(want, key=lambda x: x[-1])]
        for e in r.examples:
            assert [e.A, e.B, e.C] == w[e.doc_id] and e.primary_code == (f"c{e.doc_id}" if e.doc_id % 3 else "")
            alone = next((x for j, x in enumerate("ABC") if len({v for k, v in enumerate(w[e.doc_id]) if k != j}) == 1), None)
            said = lambda x, m, i=e.doc_id: " ".join(f"{x} says {i} {'long ' * 300}".split())[:m] if i % 2 else ""
            assert e.outlier == alone and e.outlier_reasoning == (said(alone, 600) if alone else "")
            assert [(x.rater, x.excerpt) for x in e.consensus_reasoning] == ([(x, said(x, 400)) for x in "ABC" if x != alone] if alone else [])
        kappas = [r.kappa_A_B, r.kappa_A_C, r.kappa_B_C]
        assert abs(r.kappa_mean - sum(kappas) / 3) < 1e-12
    assert records.audit_records(answers(spark, rows[:0]), codes, reasons).count() == 0
    same = [(i, r, ["other"], None, None, "yes") for i in range(3) for r in "ABC"]
    assert records.audit_records(answers(spark, same), codes, reasons).count() == 0


def exchanges(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_records_grouped_whole(spark, sf):
    rng = random.Random(8)
    some = lambda *v: rng.choice([*v, None])
    rows = [(i, r, rng.sample(["obstetric", "gi_bleed", "odd"], rng.randrange(3)), some("obstetric", "odd"), some("independent", "dependent"), some("yes", "no")) for i in range(40) for r in "AABCD" if rng.random() < 0.8]
    features = spark.createDataFrame(rows, "doc_id long, rater string, admission_reason_tags array<string>, dominant_admission_reason string, functional_status string, shock_present string")
    kinds = domains.TAGS, ("functional_status",), ("shock_present",)
    got = longform.features_side_by_side(features, *kinds)
    long = longform.side_by_side(longform.unpivot_features(features, *kinds))
    assert got.columns == long.columns and sorted(got.collect()) == sorted(long.collect())
    by = {}
    for i, r, tags, *_ in rows:
        by.setdefault(i, {}).setdefault(r, []).append("obstetric" in (tags or ()))
    want = {i: tuple(str(int(max(x[r]))) for r in "ABC") for i, x in by.items() if {*"ABC"} <= set(x)}
    assert 0 < len(want) < 40 and {r.doc_id: (r.A, r.B, r.C) for r in got.where("field = 'admission_reason_tags:obstetric'").collect()} == want
    assert exchanges(long) == 1  # a distinct count of raters made two
    assert exchanges(records.feature_ballots(plans.every_feature(spark, sf))) == 1  # documents are dealt out once, before they become a row for each field


def test_smoke(spark):
    rows = [("f", i, i % 2 == 0, i % 3 == 0 if i < 40 else None, f"text  {i}", f"reason {i}") for i in range(50)] + [("silent", 1, False, True, None, "why"), ("silent", 2, None, None, "x", "y")]
    t = spark.createDataFrame(rows, "lf string, doc_id long, fired boolean, yes boolean, text string, reasoning string")
    n = {r.lf: r for r in votes.smoke_rates(t, ["lf"], F.col("fired"), F.col("yes")).collect()}
    assert (n["f"].n, n["f"].fired, n["f"].model_yes, n["f"].shared) == (50, 25, 14, 7) and abs(n["f"].agreement_pct - 28) < 1e-9 and n["f"].recall_pct == 50.0
    assert (n["silent"].fired, n["silent"].agreement_pct, n["silent"].recall_pct) == (0, 0.0, 0.0)
    got = votes.smoke_examples(t, ["lf"], F.col("fired"), F.col("yes"), F.col("text"), F.col("reasoning"), each=4, n_chars=7).collect()
    hits = [i for i in range(50) if i % 2 == 0 and not (i % 3 == 0 and i < 40)][:4]
    misses = [i for i in range(40) if i % 3 == 0 and i % 2][:4]
    want = [("f", "false_hit", p + 1, i, f"text {i}"[:7]) for p, i in enumerate(hits)] + [("f", "miss", p + 1, i, "reason ".strip()) for p, i in enumerate(misses)] + [("silent", "miss", 1, 1, "why")]
    assert sorted((r.lf, r.kind, r.place, r.doc_id, r.excerpt.strip()) for r in got) == sorted(want)


def test_strict_gates(spark):
    schema = "run_id string, attempted long, parse_failures long, api_errors long, cost_usd double, p50 double, p99 double, rps double"
    runs = [("a", 1000, 4, 4, 1.04, 1.0, 2.9, 2.0), ("b", 1000, 5, 0, 1.06, 1.0, 3.0, 9.0), ("c", 1000, 0, 0, 1.0, 0.0, 5.0, 9.0), ("new", 0, 0, 0, 0.0, 0.0, 0.0, 0.0)]
    base = spark.createDataFrame([("a", 0.001), ("b", 0.001), ("c", 0.001)], "run_id string, baseline_cost double")
    rows = quality.strict_gates(spark.createDataFrame(runs, schema), base, 2.5, F.col("run_id") == "a").collect()
    got = {(r.run_id, r.gate): r.result for r in rows}
    assert {g for (run, g), x in got.items() if run == "a" and x == "PASS"} == {"parse_failures", "api_errors", "cost_drift", "latency_p99", "throughput"}
    assert {g for (run, g), x in got.items() if run == "b" and x == "FAIL"} == {"parse_failures", "cost_drift", "latency_p99"} and ("b", "throughput") not in got
    assert {x for (run, _), x in got.items() if run == "c"} == {"PASS"} and got["new", "cost_drift"] == "FAIL"
    assert {(r.run_id, r.overall) for r in rows} == {("a", "PASS"), ("b", "FAIL"), ("c", "PASS"), ("new", "FAIL")} and {r.whole for r in rows} == {"FAIL"}


def test_difference(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", None)], "`a.b` string, n long")
    b = spark.createDataFrame([("x", 1), (None, 2), ("y", None), ("z", 3)], "`a.b` string, n long")
    assert sorted(map(tuple, cohort.difference(a, b).collect())) == [("x", 1, 1), ("z", 3, -1)]
    assert cohort.same_rows(a, a.orderBy("n")) and not cohort.same_rows(a, b) and not cohort.same_rows(a, a.distinct())
    assert cohort.same_rows(a.limit(0), b.limit(0))
