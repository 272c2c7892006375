"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import domains, labels, stats, text
from tallyloom.operators import agreement, audit, claims, cohort, embedding, longform, quality, resample, sections, votes
from tallyloom.plans import catalog
from tallyloom.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def kappa(spark, a, b):
    p = frame(spark, [("f", str(x), str(y)) for x, y in zip(a, b)], "field string, left string, right string")
    return agreement.kappa(agreement.contingency(p, ["field"]), ["field"]).first()


def test_kappa_and_pabak(spark):
    v = [1, 0, 1, -1, 0, 1]
    assert kappa(spark, v, v).kappa == 1.0
    assert kappa(spark, [1, 1], [1, 1]).kappa == 1.0
    assert kappa(spark, [1, 1], [0, 0]).kappa == 0.0
    assert kappa(spark, [1, 1, 0, 0], [0, 0, 1, 1]).pabak == -1.0
    assert kappa(spark, [1] * 10, [1] * 9 + [0]).pabak == pytest.approx(0.8)


def test_domains():
    assert len(domains.TAGS) == 47 and len(domains.TRISTATE_FIELDS) == 17


def test_shared_and_positives(spark):
    a = frame(spark, [(i, r, "f", "yes") for r, ids in {"A": (1, 2, 3), "B": (1, 3), "C": (1, 2, 3)}.items() for i in ids], "doc_id long, rater string, field string, value string")
    assert sorted(r.doc_id for r in longform.shared(a).select("doc_id").distinct().collect()) == [1, 3]
    nd = "not_documented"
    b = frame(spark, [(i, r, "f", v) for r, vs in {"A": ("yes", "no", nd, "yes"), "B": ("no", nd, "yes", "no"), "C": (nd, "yes", "no", "yes")}.items() for i, v in enumerate(vs)], "doc_id long, rater string, field string, value string")
    assert agreement.positives(b).first().n_positive == 5


def test_chapters(spark):
    cases = [("I50.9", 10, "IX."), ("4280", 9, "IX."), ("V5811", 9, "XXI."), ("E8497", 9, "XX."), ("", 10, "ZZ."), ("??", 10, "ZZ."), ("D49", 10, "ZZ."), ("H96", 10, "ZZ."), ("000", 9, "ZZ.")]
    t = frame(spark, cases, "code string, version int, expected string").select(text.chapter(F.col("code"), F.col("version")).alias("c"), "expected")
    assert all(r.c.startswith(r.expected) for r in t.collect())


def codes(spark, rows):
    return frame(spark, [(1, c, v, p, i) for i, (c, v, p) in enumerate(rows)], "doc_id long, code string, version int, is_primary boolean, ord int")


@pytest.mark.parametrize("rows,lf,position,vote", [
    ([("I50.22", 10, True)], "I50", "any", 1), ([("428.0", 9, True)], "428", "any", 1), ([("I50.22", 9, True)], "I50", "any", -1), ([("I110", 10, True)], "I11.0", "any", -1), ([(" i11.0 ", 10, True)], "I11.0", "any", 1),
    ([("A00", 10, True), ("I50", 10, False)], "I50", "primary_only", -1), ([("A00", 10, True), ("I50", 10, False)], "I50", "any", 1), ([("I50", 10, False), ("A00", 10, False)], "I50", "primary_only", 1),
])
def test_code_votes(spark, rows, lf, position, vote):
    version = 9 if lf == "428" else 10
    p = frame(spark, [("lf", "f", "yes", position, version, lf)], votes.PATTERN_SCHEMA)
    assert votes.code_votes(codes(spark, rows), p).first().vote == vote


def test_registry_rejects_names_twice(spark):
    with pytest.raises(ValueError):
        votes.registry(frame(spark, [("a",), ("a",)], "lf_name string"))


def vote_frame(spark, rows):
    return frame(spark, [(d, lf, "f", "yes", v) for lf, d, v in rows], "doc_id long, lf_name string, target_field string, target_value string, vote int")


def test_fusion(spark):
    none = votes.majority(vote_frame(spark, [(lf, d, -1) for lf in "ab" for d in range(3)])).collect()
    assert {(r.probability, r.fit_status) for r in none} == {(0.5, "no_votes")}
    single = votes.majority(vote_frame(spark, [("a", 1, 1), ("a", 2, 0), ("a", 3, -1), ("b", 1, -1), ("b", 2, -1), ("b", 3, -1)])).orderBy("doc_id").collect()
    assert [(r.probability, r.fit_status) for r in single] == [(1.0, "single_lf_only"), (0.0, "single_lf_only"), (0.5, "single_lf_only")]


def test_label_model_recovers_accuracies(spark):
    import random

    r, rows, acc = random.Random(4), [], {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.6}
    for d in range(4000):
        y = r.random() < 0.4
        rows += [(lf, d, int(y if r.random() < p else not y)) for lf, p in acc.items() if r.random() < 0.8]
    got, prior = votes.accuracies(vote_frame(spark, rows))
    assert all(abs(got[k] - acc[k]) < 0.06 for k in acc) and abs(prior - 0.4) < 0.06
    assert {x.fit_status for x in votes.fuse(vote_frame(spark, rows)).collect()} == {"success_model"}


@pytest.mark.parametrize("value,target,kind,vote", [("yes", "yes", "tristate", 1), ("no", "yes", "tristate", 0), ("not_documented", "yes", "tristate", -1), ("no", "no", "tristate", 1), ("yes", "no", "tristate", 0), (None, "yes", "tristate", -1), ("stable", "stable", "enum", 1), ("improved", "stable", "enum", 0), ("not_documented", "stable", "enum", -1)])
def test_model_votes(spark, value, target, kind, vote):
    assert one(spark, votes.model_vote(F.lit(value).cast("string"), F.lit(target), kind)) == vote
    assert one(spark, votes.model_vote(F.array(F.lit("x")), F.lit("x"), "tag")) == 1


NOTE = "intro\nChief Complaint:\n pain\n\nBrief Hospital Course:\n\n went well\nChief Complaint:\nagain\nDischarge Condition:\nstable "


def test_sections(spark):
    s = one(spark, sections.sections(F.lit(NOTE)))
    assert s == {"Chief Complaint": "pain", "Brief Hospital Course": "went well", "Discharge Condition": "stable"}
    assert one(spark, sections.sections(F.lit("no header"))) == {sections.WHOLE: "no header"}
    assert one(spark, sections.section(sections.sections(F.lit("Hospital Course:\nx")), "Brief Hospital Course")) == "x"


def regex_vote(spark, note, names, spec):
    return one(spark, sections.vote(sections.search_text(sections.sections(F.lit(note)), names), spec))


def test_regex_votes(spark):
    spec = sections.load_patterns({"field_name": "f", "target_value": "yes", "regex_patterns": [r"\bdnr\b"]})
    assert regex_vote(spark, "Chief Complaint:\nDNR", ["Discharge Condition"], spec) == -1
    assert regex_vote(spark, "Discharge Condition:\nDNR", ["Discharge Condition"], spec) == 1
    assert regex_vote(spark, "Patient denies DNR status at discharge.", ["Discharge Condition"], spec) == -1
    assert regex_vote(spark, "is DNR", ["Discharge Condition"], spec) == 1
    assert regex_vote(spark, "no dnr" + " " * 40 + "dnr", ["x"], spec) == 1
    for bad in ({}, {"field_name": "f", "target_value": "v", "regex_patterns": "x"}, {"field_name": "f", "target_value": "v", "regex_patterns": [], "compound_patterns": [{"all_of": []}]}):
        with pytest.raises(ValueError):
            sections.load_patterns(bad)


def negated_everywhere(t, pattern):
    """Whether no match of a pattern is free of cues in the 30 characters before it."""
    import re

    at = [m.start() for m in re.finditer(f"(?=(?:{pattern}))", t, re.IGNORECASE)]
    return all(any(c in t[max(0, i - domains.NEGATION_WINDOW) : i].lower() for c in domains.NEGATION_CUES) for i in at)


def test_negation_looks_for_the_match_first(spark):
    import random
    import time

    r, words = random.Random(5), ["no", "not", "Denies", "dnr", "DNR", "without", "negative for", "x", "piano", "\n", "."]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 25))) for _ in range(400)]
    for pattern in (r"\bdnr\b", "dnr x|x dnr", "x*", r"(d)nr.*\1"):
        got = frame(spark, [(t,) for t in texts], "t string").select(F.col("t").rlike(sections.negation_aware(pattern))).collect()
        assert [x[0] for x in got] == [not negated_everywhere(t, f"(?s:{pattern})") for t in texts]
    long = frame(spark, [("plain words " * 20000,)], "t string").repartition(1)  # look-behinds at each character: more than 20 times a plain search

    def seconds(pattern):
        took = []
        for _ in range(3):
            began = time.time()
            assert not any(long.select(*[F.concat("t", F.lit(str(i))).rlike(pattern) for i in range(4)]).first())
            took.append(time.time() - began)
        return min(took)

    assert seconds(sections.negation_aware(r"\bdnr\b")) < 4 * seconds(r"(?isu)\bdnr\b") + 1


def test_sections_of_many_headers(spark):
    import time

    names = [f"Head{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    note = "".join(f"{n}:\nbody {i}\n" for i, n in enumerate([*names, *names]))
    began = time.time()
    s = frame(spark, [(note,)], "t string").select(sections.sections(F.col("t")).alias("x")).first().x
    assert time.time() - began < 8  # the text was searched once for each header
    assert s == {n: f"body {i}" for i, n in enumerate(names)}


def test_compound(spark):
    assert sections.least_window("alcohol only", ["alcohol", "abuse"], 20) is None
    assert sections.least_window("alcohol" + "." * 100 + "abuse", ["alcohol", "abuse"], 20) is None
    assert sections.least_window("active alcohol abuse", ["alcohol", "abuse"], 30) == (7, 15)
    f = sections.compound(["alcohol", "abuse"], 30)
    assert one(spark, f(F.lit("active alcohol abuse"))) == "active alcohol abuse"
    assert one(spark, f(F.lit("denies alcohol abuse"))) is None
    assert one(spark, sections.near_each_other(F.lit("active alcohol abuse"), "alcohol", "abuse", 8)) is True
    assert one(spark, sections.near_each_other(F.lit("active alcohol abuse"), "alcohol", "abuse", 7)) is False


def test_ngrams(spark):
    p = frame(spark, [("patient is dnr dni now", 1), ("she is dnr dni", 2), ("full code", 3)], "phrase string, at long")
    got = [r.gram for r in sections.mine_patterns(p, "phrase", "at").collect()]
    assert "is dnr dni" in got and "dnr dni" not in got and not any("full" in g for g in got)


def test_embedding_votes(spark):
    v = frame(spark, [(1, "t", [0.95, 0.1, 0.0]), (2, "t", [0.2, 0.2, 0.0]), (3, "t", [0.0, 0.0, 0.0]), (4, "t", [0.1, 0.9, 0.0]), (4, "t", [0.9, 0.1, 0.0])], "vec_id long, target string, vec array<float>")
    s = frame(spark, [("t", 0, [1.0, 0.0, 0.0])], "target string, seed_id long, seed array<float>")
    got = {r.vec_id: r.vote for r in embedding.vote(embedding.similarities(v, s), 0.8).collect()}
    assert got == {1: 1, 2: -1, 3: -1, 4: 1}
    low = frame(spark, [("t", 0.2)] * 3, "target string, similarity double")
    r = embedding.calibrate(low).first()
    assert (r.threshold, r.reason) == (0.65, "floor_0.65")


def test_records(spark):
    good = {"admission_reason_tags": ["cardiac_hf"], "dominant_admission_reason": "cardiac_hf", "primary_diagnosis_text": "x", **dict.fromkeys(domains.TRISTATE_FIELDS, "no"), **{k: v[0] for k, v in domains.ENUMS.items()}, "new_meds_started_count": None, "meds_stopped_count": 0, "reasoning": None}
    cases = [({}, []), ({"dominant_admission_reason": "other"}, ["dominant_not_in_tags"]), ({"admission_reason_tags": []}, ["empty_tags", "dominant_not_in_tags"]), ({"aki_present": "maybe"}, ["tristate_literal"]), ({"meds_stopped_count": -1}, ["negative_count"]), ({"new_meds_started_count": 15}, []), ({"reasoning": "x" * 2001}, ["reasoning_length"])]
    schema = readers.RECORD.replace(":", "")
    for change, expected in cases:
        t = frame(spark, [tuple((good | change).values())], schema)
        assert t.select(labels.problems(F.col).alias("p")).first().p == expected


def wide(spark, rows):
    return frame(spark, [(i, "f", *r) for i, r in enumerate(rows)], "doc_id long, field string, A string, B string, C string")


def test_summaries(spark):
    nd = "not_documented"
    s = audit.summaries(audit.patterns(wide(spark, [(nd, nd, "no")] * 3 + [("yes", "yes", "no")] * 2 + [("yes", "yes", "yes")]))).first()
    assert s.summary == "C votes 'no' where the other two vote 'not_documented' on 5 of 5 disagreements."
    s = audit.summaries(audit.patterns(wide(spark, [("yes", "yes", "no"), ("yes", "no", "yes"), ("no", "yes", "yes")]))).first()
    assert s.summary == "Disagreements distributed across all three variants (no consistent outlier)."


def test_clusters(spark):
    c = frame(spark, [("a", "A", 61), ("b", "B", 95), ("c", "C", 80), ("d", None, 99), ("e", "A", 50)], "cluster_id string, outlier string, n long")
    assert audit.target(c).first().n == 95
    assert audit.target(c.where("cluster_id in ('d', 'e')")).first() is None


def test_variant_choice(spark):
    s = "variant string, agreement double, weight double, median_tokens double"
    r = [x for x in votes.choose_variant(frame(spark, [("A", 0.91, 1.0, 8600.0), ("B", 0.88, 1.0, 8200.0), ("C", 0.84, 1.0, 7800.0)], s)).collect() if x.chosen]
    assert (r[0].variant, r[0].tie) == ("A", False)
    r = [x for x in votes.choose_variant(frame(spark, [("A", 0.905, 1.0, 8600.0), ("B", 0.899, 1.0, 8200.0), ("C", 0.83, 1.0, 7800.0)], s)).collect() if x.chosen]
    assert (r[0].variant, r[0].tie) == ("B", True)


def test_examples_and_guards(spark):
    w = wide(spark, [("yes", "yes", "no")] * 30 + [("no", "yes", "yes")] * 5)
    strata = frame(spark, [(i, f"s{i % 4}") for i in range(35)], "doc_id long, stratum string")
    got = audit.examples(audit.patterns(w), strata).orderBy("place").collect()
    assert len(got) == 10 and len({r.doc_id for r in got}) == 10 and {r.stratum for r in got[:4]} == {"s0", "s1", "s2", "s3"}
    assert audit.example_quotas({"a": 10, "b": 1}) == {"a": 7, "b": 1}
    p = frame(spark, [("keep {x} this text", "keep {x} this texts"), ("keep {x} this text", "all new")], "before string, after string")
    assert [r.accepted for r in audit.guards(p, ["text"], ["{x}"], ["keep"]).collect()] == [True, False]
    assert audit.should_stop([{"accepted": False, "gain_pp": 0}] * 2) == "failures" and audit.should_stop([]) is None


def test_anti_filter_and_resume(spark):
    ids = frame(spark, [(i,) for i in (1001, 1002, 1003, 1004)], "k long")
    assert [r.k for r in cohort.without(ids, frame(spark, [(1002,), (1004,)], "k long"), "k").orderBy("k").collect()] == [1001, 1003]
    assert [r.k for r in readers.pending(frame(spark, [(101,), (102,), (103,), (104,)], "k long"), frame(spark, [(101,), (103,)], "k long"), "k").collect()] == [102, 104]


def test_quotas(spark):
    g = frame(spark, [("a", 1), ("b", 5), ("c", 100)], "s string, size long")
    assert sum(q for _, q in cohort.quotas(g, "s", "size", 60)) == 60
    assert all(q <= {"a": 1, "b": 5, "c": 100}[s] for s, q in cohort.quotas(g, "s", "size", 104))
    t = spark.range(100).withColumn("s", (F.col("id") % 3).cast("string"))
    x = cohort.stratified(t, "id", "s", 30, 1)
    assert x.count() == 30 and cohort.same_rows(x, cohort.stratified(t, "id", "s", 30, 1))
    assert {r["slice"]: r["count"] for r in cohort.slices(x, "id", [("a", 20), ("b", 5)], 1).groupBy("slice").count().collect()} == {"a": 20, "b": 5}


def test_guarded_numbers_and_text(spark):
    assert [one(spark, text.guarded_int(F.lit(x))) for x in ("12", " 12 ", "-1", "x")] == [12, None, None, None]
    assert one(spark, text.json_slice(F.lit('note {"a": 1} end'))) == '{"a": 1}'
    assert one(spark, text.message_content(F.lit('{"choices":[{"message":{"content":"hi"}}]}'))) == "hi"
    assert one(spark, text.message_content(F.lit('{"choices":[{"message":{"content":[{"text":"a"},{"text":"b"}]}}]}'))) == "ab"
    assert one(spark, text.first_words(F.lit("A b  C d e f"))) == "a b c d e"
    assert one(spark, F.rlike(F.lit("x a.b y"), text.escaped(F.lit("a.b")))) is True
    assert one(spark, F.rlike(F.lit("x axb y"), text.escaped(F.lit("a.b")))) is False


def test_labels(spark):
    assert one(spark, labels.tristate(F.lit(" YES "))) == "yes" and one(spark, labels.tristate(F.lit("none"))) is None
    assert one(spark, labels.tristate(F.lit("x"), True)) == "not_yes"
    assert one(spark, labels.normal_tags(F.array(F.lit(" other"), F.lit("x"), F.lit("gi_bleed ")))) == ["other", "gi_bleed"]
    assert one(spark, labels.disagreement(F.lit("yes"), F.lit("no"))) == "hard_yes_no"
    assert one(spark, agreement.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0


def test_statistics(spark):
    lo, hi = stats.wilson(F.lit(8), F.lit(10))
    assert one(spark, lo) == pytest.approx(0.4902, abs=1e-3) and one(spark, hi) == pytest.approx(0.9433, abs=1e-3)
    assert agreement.spearman_p(0.5, 20) == pytest.approx(0.0248, abs=2e-4)
    t = frame(spark, [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 9.0)], "a double, b double")
    assert agreement.spearman(t, "a", "b").first().rho == pytest.approx(0.9487, abs=1e-4)


def test_bootstrap(spark):
    rows = [(i, "f", "A_B", "yes" if i % 2 else "no", "yes" if i % 2 and i % 5 else "no") for i in range(60)]
    p = frame(spark, rows, "row_no long, field string, pair string, left string, right string")
    k = resample.kappa_replicates(p, 40, 1)
    ci = resample.interval(k.withColumnRenamed("kappa", "value"), ["field"]).first()
    full = agreement.kappa(agreement.contingency(p, ["field"]), ["field"]).first().kappa
    assert ci.low < full < ci.high and ci.n_finite == 40
    w = resample.multiplicities(spark, 5, 30, 3).groupBy("rep").agg(F.sum("w").alias("w")).collect()
    assert {r.w for r in w} == {30}


def test_bootstrap_draws_every_document(spark):
    """Document numbers with gaps: each replicate has n draws, and every label pattern is drawn as often as its share."""
    rows = [(1000 * i, "f", "A_B", f"l{i % 4}", "yes" if i % 3 else "no") for i in range(120)]
    p = frame(spark, rows, "row_no long, field string, pair string, left string, right string")
    assert {r.n for r in resample.kappa_replicates(p, 50, 1).collect()} == {120}
    patterns = resample.label_patterns(p)
    share = {r.pattern_no: r.n for r in patterns.collect()}
    assert sorted(share.values()) == [10] * 4 + [20] * 4
    draws = resample.pattern_draws(patterns, 400, 1).groupBy("pattern_no").agg(F.sum("w").alias("w")).collect()
    assert len(draws) == 8 and all(r.w / 400 == pytest.approx(share[r.pattern_no], abs=1.2) for r in draws)
    assert resample.kappa_replicates(p.limit(0), 5, 1).count() == 0


def test_bootstrap_query_draws_documents(spark, sf, monkeypatch):
    seen, whole = [], resample.kappa_replicates
    monkeypatch.setattr(resample, "kappa_replicates", lambda *a: seen.append(whole(*a)) or seen[0])
    catalog.QUERIES["bootstrap_kappa_ci"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {(r.n, r.k) for r in seen[0].groupBy("n").agg(F.count("*").alias("k")).collect()} == {(n, 900)}


def test_derivative_of_a_square(spark):
    t = frame(spark, [("r", x, x * x) for x in (0.0, 1.0, 3.0, 4.0)], "k string, x double, y double")
    assert [r.rate for r in quality.derivative(t, ["k"], "x", "y").orderBy("x").collect()] == [1.0, 2.0, 6.0, 7.0]


def test_disjoint_union_fails_on_overlap(spark):
    a, b = spark.range(3), spark.range(3, 5)
    assert longform.disjoint_union(a, b, "id").count() == 5
    with pytest.raises(Exception, match="both sides"):
        longform.disjoint_union(a, spark.range(2, 4), "id").collect()


def test_claims(spark):
    old = frame(spark, [("a", 1.0, "", "", "r"), ("b", 2.0, "", "", "r")], claims.SCHEMA)
    new = frame(spark, [("b", 3.0, "", "", "r")], claims.SCHEMA)
    merged = claims.merge(old, new)
    assert {r.key: r.value for r in merged.collect()} == {"a": 1.0, "b": 3.0}
    assert {r.key: r.status for r in claims.verify(merged, old).collect()} == {"a": "match", "b": "mismatch"}
    assert claims.fill("{{a:.1f}} {{ b }} {{c}}", {"a": (1.25, ""), "b": (2, "d")}) == ("1.2 2 [undefined c]", ["c"])
    assert claims.receipt(b"x", {"a": b"1", "b": b"2"}) == claims.receipt(b"x", {"b": b"2", "a": b"1"})
    assert claims.table_receipt(old).first() == claims.table_receipt(old.orderBy(F.desc("key"))).first()


def test_discovery(spark):
    rows = [(s, t, c) for s, t, cs in [("public", "notes", ("id", "text")), ("mimic_note", "notes", ("id", "text")), ("mimic_x", "notes", ("id",)), ("other", "discharge", ("id", "text"))] for c in cs]
    cols = frame(spark, rows, "table_schema string, table_name string, column_name string")
    r = readers.discover(cols, {"n": (["notes", "discharge"], ["id", "text"])}).first()
    assert (r.table_schema, r.table_name) == ("mimic_note", "notes") and readers.quoted("a`b", "c") == "`a``b`.`c`"


def test_runs_and_sinks(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/a.jsonl").write_text('{"hadm_id": 1, "parse_ok": true, "features_json": {"aki_present": "no"}}\n{"hadm_id": 2, "parse_ok": false}\nbroken\n{"hadm_id": 1, "parse_ok": true, "features_json": {"aki_present": "yes"}}\n')
    r = readers.flat(readers.jsonl_run(spark, str(tmp_path / "run")), "A").collect()
    assert [(x.hadm_id, x.aki_present, x.variant) for x in r] == [(1, "yes", "A")]
    t = frame(spark, [(1, ["x"], "t"), (1, None, "t"), (2, None, "u")], "hadm_id long, admission_reason_tags array<string>, stratum string")
    sinks.features(t, str(tmp_path / "features"))
    assert sorted((x.hadm_id, x.admission_reason_tags) for x in spark.read.parquet(str(tmp_path / "features")).collect()) == [(1, ["x"]), (2, [])]
    m = sinks.split(t.select("hadm_id", "stratum").distinct(), str(tmp_path / "split"), "stratum", {"t": 1})
    assert m.first().rows == 2 and sorted(x.hadm_id for x in readers.split_ids(spark, str(tmp_path / "split")).collect()) == [1, 2]
    with pytest.raises(Exception, match="exists"):
        sinks.split(t.select("hadm_id", "stratum"), str(tmp_path / "split"), "stratum", {})
    for _ in range(2):
        sinks.append_run(spark.range(3).withColumnRenamed("id", "hadm_id"), str(tmp_path / "appended"))
    assert spark.read.json(str(tmp_path / "appended")).count() == 3
    (tmp_path / "log").write_text("2024-01-01 00:00:00,1 a\nx\n2024-01-01 06:00:00,1 b\n")
    assert readers.log_hours(spark, str(tmp_path / "log")).first().hours == 6.0
    (tmp_path / "t.md").write_text("# h\n\n| a | b |\n|---|---|\n| x | 1,2% |\n\n| other |\n")
    rows = readers.markdown_table(spark, str(tmp_path / "t.md"), "# h").orderBy("at").collect()
    assert [x.cells for x in rows] == [["a", "b"], ["x", "1,2%"]] and one(spark, readers.first_number(F.lit("`1,200%`"))) == 1200.0


def test_stream(spark, sf, tmp_path):
    from tallyloom.streaming import progress

    spark.read.parquet(f"{sf}/events.parquet").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = progress.start(progress.by_window(stream, "1 day", "1 day"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() > 0 and got.agg(F.sum("n")).first()[0] <= 1000 and not math.isnan(got.agg(F.sum("total")).first()[0])


def test_paired_models_against_plain_python(spark):
    """Each replicate's deltas from its weights, as plain kappas over repeated documents; fixed and dynamic filters."""
    import itertools
    from statistics import median

    import numpy as np

    from tallyloom.operators import resample

    r = np.random.default_rng(7)
    rows = [(i, m, f, *(str(r.choice(["yes", "no"], p=[0.5 if f == "f" else 0.06, 0.5 if f == "f" else 0.94])) for _ in "ABC")) for i in range(60) for m in ("small", "full") for f in ("f", "g")]
    wide = spark.createDataFrame(rows, "row_no long, model string, field string, A string, B string, C string")
    got = {(x.rep, x["filter"], x.field, x.statistic): x.value for x in resample.paired_models(wide, 4, 3).collect()}
    by = {}
    for i, *rest in rows:
        by.setdefault(i, []).append(tuple(rest))
    kinds = sorted({tuple(sorted(v)) for v in by.values()})
    n = [sum(tuple(sorted(v)) == k for v in by.values()) for k in kinds]

    def kappa(pairs):
        total = sum(w for *_, w in pairs)
        same = sum(w for a, b, w in pairs if a == b) / total
        chance = sum(sum(w for a, _, w in pairs if a == x) * sum(w for _, b, w in pairs if b == x) for x in ("yes", "no")) / total**2
        return 1.0 if chance == 1 else (same - chance) / (1 - chance)

    positives = lambda w, f, m: sum(wt * c[2:].count("yes") for k, wt in zip(kinds, w) for c in k if c[0] == m and c[1] == f)
    fixed = {f for f in "fg" if min(positives(n, f, m) for m in ("small", "full")) >= 10}
    for rep in range(4):
        w = np.random.default_rng([3, rep]).multinomial(sum(n), np.array(n) / sum(n)).tolist()
        k = {(m, f, p): kappa([(c[2 + p[0]], c[2 + p[1]], wt) for kind, wt in zip(kinds, w) for c in kind if c[0] == m and c[1] == f and wt]) for m in ("small", "full") for f in "fg" for p in itertools.combinations(range(3), 2)}
        deltas = {f: median(100 * (k["full", f, p] - k["small", f, p]) for p in itertools.combinations(range(3), 2)) for f in "fg"}
        dynamic = {f for f in "fg" if min(positives(w, f, m) for m in ("small", "full")) >= 10}
        for name, kept in (("fixed", fixed), ("dynamic", dynamic)):
            assert {f for a, b, f, s in got if a == rep and b == name and s == "delta"} == kept
            for f in kept:
                assert got[rep, name, f, "delta"] == pytest.approx(deltas[f], abs=1e-9)
            assert got[rep, name, None, "median_delta"] == pytest.approx(median(deltas[f] for f in kept), abs=1e-9)
            pooled = [median(k[m, f, p] for f in kept for p in itertools.combinations(range(3), 2)) for m in ("full", "small")]
            assert got[rep, name, None, "pooled_delta"] == pytest.approx(100 * (pooled[0] - pooled[1]), abs=1e-9)
