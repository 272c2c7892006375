"""Pattern files with all their errors, a table over JDBC, examples against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import audit
from tallyloom.sources import readers


def test_pattern_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "in").mkdir()
    files = {
        "good.yaml": "field_name: code_status\ntarget_value: dnr\nregex_patterns: ['\\bdnr\\b']\ncompound_patterns:\n- {all_of: [alcohol, abuse], window_chars: 30, description: near}\n",
        "in/plain.yml": "field_name: f\ntarget_value: yes\nregex_patterns: []\n",
        "many.yaml": "regex_patterns: [1, a]\ncompound_patterns: [{all_of: []}, 3, {all_of: [x], window_chars: true, description: 4}]\n",
        "broken.yaml": "a: [1\n",
        "list.yaml": "- 1\n",
        "ignored.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = [(r.path.rsplit("/", 1)[1], r.field_name, r.error) for r in readers.pattern_files(spark, str(tmp_path)).collect()]
    assert sorted(r[:2] for r in rows if r[2] is None) == [("good.yaml", "code_status"), ("plain.yml", "f")]
    assert sorted(e for n, _, e in rows if n == "many.yaml") == sorted(["missing field_name", "missing target_value", "regex_patterns holds more than strings", "compound_patterns[0] missing window_chars", "compound_patterns[0].all_of is not a list of strings", "compound_patterns[1] is not a mapping", "compound_patterns[2].window_chars is not a whole number", "compound_patterns[2].description is not a string"])
    assert {n for n, _, e in rows if e and "YAML" in e} == {"broken.yaml"} and ("list.yaml", None, "not a mapping") in rows


def test_jdbc_in_ranges(spark, sf):
    """The embedded database that comes with Spark."""
    url, driver = f"jdbc:derby:memory:tallyloom{random.randrange(10**9)};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    orders.coalesce(1).write.jdbc(url, "orders", properties={"driver": driver})
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    t = readers.jdbc(spark, url, "orders", "o_orderkey", (lo, hi), 4, driver=driver)
    assert t.rdd.getNumPartitions() == 4
    got = t.where("o_custkey < 50").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    want = orders.where("o_custkey < 50").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    assert sorted((r[0], r.n, round(r.s, 2)) for r in got.collect()) == sorted((r[0], r.n, round(r.s, 2)) for r in want.collect())
    plan = t.where("o_custkey < 50").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(O_CUSTKEY,50)" in plan.replace("o_custkey", "O_CUSTKEY") and "o_totalprice" not in plan.lower().split("readschema")[-1]


def plain_examples(rows, cap=10, top=5):
    groups = {}
    for field, key, doc, stratum in sorted(rows, key=lambda r: (r[2], r[3] or "")):
        groups.setdefault(field, {}).setdefault(key, []).append((doc, stratum))
    out = []
    for field, by in groups.items():
        queues = [list(by[k]) for k in sorted(by, key=lambda k: (-len(by[k]), k))[:top]]
        names = sorted(by, key=lambda k: (-len(by[k]), k))[:top]
        seen, taken = set(), []
        while len(taken) < cap and any(queues):
            for name, q in zip(names, queues, strict=True):
                if q and len(taken) < cap:
                    x = next((x for x in q if x[1] and x[1] not in seen), q[0])
                    q.remove(x)
                    seen.add(x[1])
                    taken.append((field, x[0], name, x[1], len(taken)))
        out += taken
    return sorted(out, key=str)


def test_examples_against_a_plain_version(spark):
    r = random.Random(8)
    value = lambda: r.choice(["yes", "no", "not_documented"])
    wide = [(d, f, value(), value(), value()) for d in range(900) for f in ("f", "g")]
    strata = [(d, None if d % 50 == 0 else "" if d % 31 == 0 else f"s{min(d // 40, 3) if d < 700 else d}") for d in range(900)]
    of = dict(strata)
    rows = [(f, "|".join(v), d, of[d]) for d, f, *v in wide if len(set(v)) > 1]
    found = audit.patterns(spark.createDataFrame(wide, "doc_id long, field string, A string, B string, C string").repartition(3))
    got = audit.examples(found, spark.createDataFrame(strata, "doc_id long, stratum string"))
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain_examples(rows)


def test_quota_examples_pass_over_what_is_taken(spark):
    rows = [("c", record, weight, x) for record, weight in (("a", 5), ("b", 5)) for x in (1, 2, 3)]
    got = audit.quota_examples(spark.createDataFrame(rows, "cluster_id string, record_id string, weight long, example long"))
    assert sorted((r.place, r.record_id, r.example) for r in got.collect()) == [(1, "a", 1), (2, "a", 2), (3, "a", 3)]


def test_escaped_and_mined(spark):
    from tallyloom.functions import text
    from tallyloom.operators import sections

    cases = {"pain)": "pain\\)", "a.b": "\\ba\\.b\\b", "chest pain": "\\bchest pain\\b", "(x": "\\(x", "é-1": "\\bé\\-1\\b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.e for r in df.select("p", text.escaped(F.col("p")).alias("e")).collect()} == cases
    phrases = ["acute heart failure", "acute heart failure now", "heart failure", "heart failure x", "heart failure y"]
    mined = lambda ps: [r.pattern for r in sections.mine_patterns(spark.createDataFrame(list(enumerate(ps)), "at long, phrase string"), "phrase", "at").collect()]
    assert mined(phrases) == ["\\bacute heart failure\\b"]
    assert mined(["Chest pain", "chest pain"]) == ["\\bChest pain\\b"] and mined(["one", "two"]) == []
    assert mined(["art failure", "art failure", "heart failure", "heart failure"]) == ["\\bheart failure\\b"]


def test_votes_with_evidence(spark):
    from tallyloom.functions import domains
    from tallyloom.operators import sections

    r, words = random.Random(5), ["dnr", "no", "denies", "alcohol", "abuse", "now", "and", "stable", "DNR", "\n"]
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(120))]
    spec = sections.load_patterns({"field_name": "f", "target_value": "yes", "regex_patterns": [r"\bdnr\b", "stable now"], "compound_patterns": [{"all_of": ["alcohol", "abuse"], "window_chars": 12, "description": "drinks"}, {"all_of": ["and", "now"], "window_chars": 4}]})

    def plain(t):
        import itertools
        import re

        negated = lambda at: any(c in t[max(0, at - domains.NEGATION_WINDOW) : at].lower() for c in domains.NEGATION_CUES)
        if t is None:
            return (-1, "no_section")
        for p in spec["regex_patterns"]:
            if any(not negated(m.start()) for m in re.finditer(p, t, re.IGNORECASE)):
                return (1, f"regex match: {p}")
        for c in spec["compound_patterns"]:
            starts = [[m.start() for m in re.finditer(p, t, re.IGNORECASE)] for p in c["all_of"]]
            spans = [(max(x) - min(x), min(x)) for x in itertools.product(*starts) if max(x) - min(x) <= c["window_chars"]]
            if spans and not negated(min(spans)[1]):
                return (1, f"compound match: {c.get('description') or c['all_of']}")
        return (-1, None)

    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", sections.explain(F.col("t"), spec).alias("x"))
    got = {x.i: (x.x.vote, x.x.evidence) for x in df.collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} and len({e for _, e in got.values()}) >= 4


def test_catalogue_of_functions(spark):
    from tallyloom.operators import votes

    mine = votes.Catalogue()
    mine.register("even", "parity", "even")(lambda: F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0))
    mine.register("row", "parity")(lambda: F.udf(lambda x: None if x == 3 else 1, "int")(F.col("doc_id")))
    with pytest.raises(ValueError, match="even"):
        mine.register("even", "other")(lambda: F.lit(1))
    assert mine.for_field("parity") == ["even", "row"] and mine.for_field("x") == []
    got = sorted((r.doc_id, r.lf_name, r.vote) for r in mine.votes(spark.range(4).withColumnRenamed("id", "doc_id")).collect())
    assert got == [(0, "even", 1), (0, "row", 1), (1, "even", 0), (1, "row", 1), (2, "even", 1), (2, "row", 1), (3, "even", 0), (3, "row", -1)]
    assert mine.votes(spark.range(4).withColumnRenamed("id", "doc_id"), ["row"]).count() == 4
    with pytest.raises(KeyError):
        mine.votes(spark.range(1), ["none"])


def test_section_vectors(spark):
    from tallyloom.operators import embedding

    note = "intro\nChief Complaint:\nshort one\nHospital Course:\n  long enough to be worth a vector \nDischarge Condition:\nexactly twenty chars\n"
    df = spark.createDataFrame([(1, note), (2, "no header at all"), (3, None)], "doc_id long, text string")
    rows = embedding.section_rows(df, ["Chief Complaint", "Hospital Course", "Discharge Condition"])
    got = {(r.doc_id, r.section): r.text for r in rows.collect()}
    assert got == {(1, "Hospital Course"): "long enough to be worth a vector", (1, "Discharge Condition"): "exactly twenty chars"}
    cache = rows.where("section = 'Hospital Course'").select("text_key", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    have, lack = embedding.with_vectors(rows, cache.unionByName(cache))
    assert [r.section for r in have.collect()] == ["Hospital Course"] and [r.text for r in lack.collect()] == ["exactly twenty chars"]
    v = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", None), ("c", [7.0, 8.0])], "k string, vec array<double>")
    assert sorted((r.k, r.n, r.vec) for r in embedding.pooled(v, ["k"]).collect()) == [("a", 2, [2.0, 4.0]), ("c", 1, [7.0, 8.0])]


def test_claims_follow_their_inputs(spark, tmp_path):
    from tallyloom.operators import claims

    paths = {n: str(tmp_path / n) for n in ("a", "b")}
    for n, p in paths.items():
        spark.range(10).repartition(2, "id").write.parquet(p)
    c = claims.Claims()
    c.register("n_a", ["a"])(lambda a: a.agg(F.count("*")))
    c.register("sum_b", ["b"])(lambda b: b.agg(F.sum("id")))
    c.register("both", ["a", "b"])(lambda a, b: a.join(b, "id").agg(F.count("*")))
    c.register("wrong", ["a"])(lambda a: a.agg(F.sum("no_such_column")))
    with pytest.raises(ValueError, match="n_a"):
        c.register("n_a", ["b"])(lambda b: b)
    first = c.recompute(spark, paths)
    assert {r.key: (r.value, r.status.split(":")[0]) for r in first.collect()} == {"n_a": (10.0, "computed"), "sum_b": (45.0, "computed"), "both": (10.0, "computed"), "wrong": (None, "failed")}
    again = c.recompute(spark, paths, first.where("status not like 'failed%'"))
    assert {r.key: r.status.split(":")[0] for r in again.collect()} == {"n_a": "kept", "sum_b": "kept", "both": "kept", "wrong": "failed"}
    before = {r.file: r["print"] for r in claims.file_prints(spark, paths["b"]).collect()}
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(paths["b"])
    after = {r.file: r["print"] for r in claims.file_prints(spark, paths["b"]).collect()}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    third = {r.key: (r.value, r.status.split(":")[0]) for r in c.recompute(spark, paths, again).collect()}
    assert third == {"n_a": (10.0, "kept"), "sum_b": (66.0, "computed"), "both": (10.0, "computed"), "wrong": (None, "failed")}
    assert claims.table_print(spark, paths["a"]) == claims.table_print(spark, paths["a"])
    spark.read.parquet(paths["a"]).orderBy(F.desc("id")).coalesce(1).write.parquet(str(tmp_path / "c"))
    assert claims.table_print(spark, str(tmp_path / "c")) == claims.table_print(spark, paths["a"])


def test_guards_by_name(spark):
    frozen = {"answers": [["yes"], ["no"], ["not said"]], "edges": [["edge cases", "corner cases"]], "tags": [["one of the tags", "a tag of the list"], ["never empty", "at least one"]]}
    before = "Answer YES, no or Not said. Edge cases: {x}. Give one of the `tags`; the list is never empty. mania"
    rows = [
        ("same", before, before),
        ("other words", before, before.replace("Edge", "Corner").replace("never empty", "AT LEAST ONE")),
        ("lost", before, before.replace("Edge cases", "Cases").replace("{x}", "{ x}")),
        ("vocabulary", before, before.replace("mania", "Mania")),
        ("rewritten", before, "yes no not said edge cases one of the tags never empty {x} mania " + "z" * 80),
        ("none", before, None),
    ]
    df = spark.createDataFrame(rows, "name string, before string, after string")
    got = {r.name: (r.failed, r.frozen_ok, r.accepted) for r in audit.named_guards(df, ["mania"], ["{x}"], frozen).collect()}
    assert got["same"] == ([], True, True) and got["other words"] == ([], True, True)
    assert got["lost"] == (["frozen: edges", "placeholders"], False, False)
    assert got["vocabulary"] == (["vocabulary"], True, False) and got["rewritten"] == (["edit_share"], True, False)
    assert got["none"] == (["edit_share", "frozen: answers", "frozen: edges", "frozen: tags", "placeholders", "vocabulary"], False, False)
