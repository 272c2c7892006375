"""The label model from overlaps: known accuracies, copied functions, targets side by side."""

import random

import pytest

from tallyloom.operators import label_matrix


def cast(accuracies, n, share, seed, field="f", copies=()):
    r, rows = random.Random(seed), []
    for d in range(n):
        y = r.random() < share
        votes = {lf: int(y if r.random() < p else not y) for lf, p in accuracies.items() if r.random() < 0.85}
        for new, old in copies:
            if old in votes:
                votes[new] = votes[old] if r.random() < 0.98 else 1 - votes[old]
        rows += [(d, lf, field, "yes", votes.get(lf, -1)) for lf in [*accuracies, *(new for new, _ in copies)]]
    return rows


SCHEMA = "doc_id long, lf_name string, target_field string, target_value string, vote int"


def test_accuracies_with_copied_functions(spark):
    acc = {"a": 0.9, "b": 0.8, "c": 0.75, "d": 0.65, "e": 0.85}
    copies = [("a2", "a"), ("d2", "d")]
    rows = cast(acc, 6000, 0.3, 1, copies=copies) + cast({"x": 0.8, "y": 0.7, "z": 0.9}, 4000, 0.6, 2, "g") + [(d, lf, "h", "yes", d % 2) for d in range(50) for lf in "pq"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {(r.target_field, r.lf_name): r for r in label_matrix.parameters(df).collect()}
    assert {f for f, _ in got} == {"f", "g"}
    for lf, p in acc.items():
        assert got["f", lf].accuracy == pytest.approx(p, abs=0.04)
    for new, old in copies:
        assert got["f", new].accuracy == pytest.approx(acc[old], abs=0.05)
        assert got["f", new].group_size == got["f", old].group_size == 2
    assert got["f", "b"].group_size == 1 and got["f", "b"].prior == pytest.approx(0.3, abs=0.05)
    assert [got["g", lf].accuracy for lf in "xyz"] == pytest.approx([0.8, 0.7, 0.9], abs=0.05)
    assert got["g", "x"].prior == pytest.approx(0.6, abs=0.05)


def test_fused_probabilities(spark):
    rows = cast({"a": 0.9, "b": 0.8, "c": 0.7}, 3000, 0.4, 3)
    truth = random.Random(3)
    fused = {r.doc_id: r for r in label_matrix.fuse(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r.fit_status for r in fused.values()} == {"success_model"} and len(fused) == 3000
    by = {}
    for d, lf, *_, v in rows:
        by.setdefault(d, {})[lf] = v
    p = {tuple(by[d].values()): r.probability for d, r in fused.items()}
    assert p[(1, 1, 1)] > 0.9 > 0.5 > p[(0, 0, 0)] and p[(1, 0, 0)] > p[(0, 0, 1)] and p[-1, -1, -1] == 0.5
    del truth
    few = spark.createDataFrame([(1, "a", "f", "yes", 1), (2, "a", "f", "yes", -1), (1, "b", "f", "yes", -1), (2, "b", "f", "yes", -1)], SCHEMA)
    assert {(r.doc_id, r.probability, r.fit_status) for r in label_matrix.fuse(few).collect()} == {(1, 1.0, "single_lf_only"), (2, 0.5, "single_lf_only")}
    assert label_matrix.fuse(few.limit(0)).collect() == []
