"""Chosen-path similarity join: brute force over small tables, in one task and split into nodes and cells."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import chosen_path


def brute(rows, k=3, num=85):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for b in "\t\n\x0b\x0c\r":
            low = low.replace(b, " ")
        w = [x for x in low.split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and group[i] != group[j]:
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if group[m] == group[n] and rows[m][0] is not None]
        least = min(ids, default=None) if sets[n] else i
        out.append((i, len(sets[n]), least, i == least))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda n=4000: f"w{r.randrange(n)}"
    rows = []
    for _ in range(12):  # families of near copies, some of them chains
        text = [word() for _ in range(r.randrange(3, 120))]
        for _ in range(r.randrange(1, 6)):
            rows.append(" ".join(text))
            if r.random() < 0.7:
                text[r.randrange(len(text))] = word()
    common = [word() for _ in range(120)]
    for _ in range(40):  # a dense group: alike, most of it linked through its copies, some of it alone
        text = list(common)
        for _ in range(r.choice([0, 1, 2, 3, 12, 14, 16])):
            text[r.randrange(120)] = word()
        rows.append(" ".join(text))
    passage = [word() for _ in range(25)]
    for _ in range(40):  # documents that share a passage only
        rows.append(" ".join([*(word() for _ in range(r.randrange(5, 40))), *passage, *(word() for _ in range(r.randrange(5, 40)))]))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("cell_sets", "more"), [(1024, 4), (6, 3), (3, 0)])
def test_near_copies(spark, cell_sets, more):
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = chosen_path.near_copies(df, more=more, cell_sets=cell_sets)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_documents(spark):
    long = " ".join(f"x{i % 977} y{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one  two\r"), (None, "a b c d"), (8, "A b C d"), (None, "alone with null id"), (None, None), (9, long), (10, long + " z"), (11, long.upper()), (12, "é É"), (12, "é É"), (13, "é é"), (14, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "label": F.lit("x"), "n": F.lit(None).cast("int")})
    got = chosen_path.near_copies(df.repartition(2)).collect()
    want = brute(rows)
    want = [(i, n, c, i == c or (i is None and c is None)) for i, n, c, _ in want]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    named = spark.createDataFrame([("b", "same words here now"), ("a", "same words here now"), ("c", "other")], "doc_id string, text string")
    assert sorted(tuple(r) for r in chosen_path.near_copies(named).collect()) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 1, "c", True)]
    assert chosen_path.near_copies(df.limit(0)).collect() == []


def test_recall_of_trees():
    """Pairs at the threshold: how many meet in a node of the last level."""
    import numpy as np

    r = np.random.default_rng(3)
    sets, pairs = [], 300
    for _ in range(pairs):
        both, own = r.integers(0, 1 << 63, 170, dtype=np.uint64), r.integers(0, 1 << 63, 30, dtype=np.uint64)
        sets += [np.concatenate((both, own[:15])), np.concatenate((both, own[15:]))]
    names = chosen_path.node_names(np.concatenate(sets), np.arange(0, 2 * pairs * 185, 185), 4, 3)
    met = sum(bool(set(names[2 * i].tolist()) & set(names[2 * i + 1].tolist())) for i in range(pairs))
    apart = sum(bool(set(names[2 * i].tolist()) & set(names[2 * i + 2].tolist())) for i in range(pairs - 1))
    assert met == pairs and apart == 0
    one = sum(bool(set(names[2 * i, :8].tolist()) & set(names[2 * i + 1, :8].tolist())) for i in range(pairs))
    assert one / pairs > 0.9


def test_ids_of_other_types_in_the_jaccard_join(spark):
    from tallyloom.llm import near_duplicates

    text = "one two three four five six seven eight"
    df = spark.createDataFrame([("b", text), ("a", text + " "), ("c", "another text"), (None, None)], "doc_id string, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == {("a", 4, "a"), ("b", 4, "a"), ("c", 1, "c"), (None, 0, None)}
