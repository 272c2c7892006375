"""Hard negatives, prefix tries: brute force over small tables with odd rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import hard_negatives, prefix_trie

ROWS = "id long, label long, vector array<double>, anchor boolean, v string"


def brute_negatives(rows, positives=5, negatives=3, low=50, high=95):
    fit = []
    for i, label, v, anchor, _ in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or abs(x) >= 1 << 15 for x in v):
            continue
        fit.append((i, label, [math.floor(256 * x) for x in v], bool(anchor)))
    out = []
    for at, (i, label, q, anchor) in enumerate(fit):
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v, strict=False)), j is None, j or 0, same == label) for n, (j, same, v, _) in enumerate(fit) if n != at]
        scored.sort(key=lambda x: x[:3])
        for s, no, j, _ in [x for x in scored if x[3]][:positives]:
            got = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, None if no else j, r + 1, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(got)]
    return sorted(out, key=str)


def vectors(n, dims, seed, size=1.0):
    r = random.Random(seed)
    ends = [[r.gauss(0, size) for _ in range(dims)] for _ in range(4)]
    return [(i, r.randrange(3), [x + r.gauss(0, size / 2) for x in ends[r.randrange(4)]], i % 7 == 0, "x") for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd", "wide", "integers", "one label", "empty"])
def test_hard_negatives(spark, case):
    rows = vectors(150, 9, 1)
    if case == "odd":
        rows = vectors(60, 5, 2)
        rows += [(200, None, [1.0] * 5, True, "x"), (201, 1, None, True, "x"), (202, 1, [1.0, None], False, "x"), (203, 1, [float("nan")] * 5, True, "x"), (204, 1, [float("inf")] * 5, False, "x"), (205, 1, [40000.0] * 5, True, "x")]
        rows += [(None, 1, [1.0] * 5, False, "x"), (None, 2, [0.9] * 5, True, None), (206, 1, [1.0, 2.0], True, "x"), (207, 2, [], True, "x"), (208, 0, [0.0] * 5, None, "x")]
        rows += rows[:9] + [(300 + i, 1 + i % 2, [1.0] * 5, False, "x") for i in range(8)]
    elif case == "wide":
        rows = vectors(60, 12, 3, 9000.0)
    elif case == "integers":  # sums beyond 2^53
        rows = vectors(40, 1000, 4, 8000.0)
    elif case == "one label":
        rows = [(i, 1, v, a, x) for i, _, v, a, x in rows]
    elif case == "empty":
        rows = []
    df, dims = spark.createDataFrame(rows, ROWS).repartition(3), max((len(r[2] or []) for r in rows), default=1)
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, block_values=40 * dims, anchor_values=8 * dims).collect()), key=str)
    assert got == brute_negatives(rows)
    assert bool(got) == (case not in ("one label", "empty"))


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    nodes = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = (own.get(c - int(math.fmod(c, 5)), [])[:h]) + v[h:]
        for d in range(len(built) + 1):
            x = nodes.setdefault(tuple(built[:d]), {"members": [], "ends": []})
            x["members"].append(c)
            if d == len(built):
                x["ends"].append(c)
    children = {k: [] for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) + (not children[k])
        saved[k] = sum(saved[x] for x in children[k]) + (len(nodes[k]["members"]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return sorted(((min(x["members"]), len(k), min(nodes[k[:-1]]["members"]) if k else None, len(x["members"]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest()) for k, x in nodes.items()), key=str)


def talks(seed, n=60, most=14):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(-20, 200), n):
        said = r.choice(["a", "b"])
        out += [(c, t, "user" if t % 2 else "assistant", said * (1 + t % 3) + ("é" if r.random() < 0.1 else "")) for t in range(r.randrange(1, most))]
    return out


@pytest.mark.parametrize("long", [1 << 16, 5, 0])
@pytest.mark.parametrize("case", ["plain", "odd", "empty"])
def test_prefix_trie(spark, monkeypatch, case, long):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = talks(1) if case != "empty" else []
    if case == "odd":
        rows = talks(2, 30) + [(300, None, None, None), (300, 0, "user", "z"), (301, 1, None, "x" * 200_000), (None, 0, "user", "lost"), (302, 5, "u", None), (410, 0, "u", "ab"), (411, 0, "ua", "b"), (411, -1, "", "")]
        rows += [(305, t, "user", "same") for t in range(9)] * 2  # every turn twice
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("base", F.lit(1)).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, long).collect()), key=str)
    assert got == brute_trie(rows)
