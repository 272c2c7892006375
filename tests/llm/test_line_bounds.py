"""Lines within other bounds than the default, against the whole table of edit distances."""

import numpy as np
import pytest

from tallyloom.llm import line_dedup

from . import brute


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def expected(rows, bounds):
    seen, out = [], {}
    for i, t in sorted(rows):
        out[i] = []
        for n, line in enumerate((t or "").split("\n")):
            w = brute.WORD.findall(line.translate(brute.LOWER))
            if w:
                if any(distance(w, x) <= max([e for least, e in bounds if max(len(w), len(x)) >= least], default=0) for x in seen):
                    out[i].append(n)
                seen.append(w)
    return out


def lines(seed, n, longest):
    r = np.random.default_rng(seed)
    rows, made = [], []
    for i in range(n):
        text = []
        for _ in range(r.integers(0, 6)):
            w = list(r.choice(list("abcdefgh"), r.integers(1, longest)))
            if made and r.random() < 0.7:
                w = list(made[r.integers(len(made))])
                for _ in range(r.integers(0, 5)):
                    at, how = r.integers(len(w) + 1), r.integers(3)
                    w = (w[:at] + ["xyz"[r.integers(3)]] * int(how < 2) + w[at + int(how > 0) :])[:longest] or ["a"]
            made.append(w)
            text.append("  ".join(w).upper() if r.random() < 0.3 else " ".join(w))
        rows.append((i, "\n\n".join(text) if i % 9 else None))
    return rows


@pytest.mark.parametrize("bounds", [((1, 1), (6, 2)), ((4, 2), (9, 3)), ((8, 1),), ((1, 0),), ()])
def test_bounds(spark, bounds):
    rows = lines(len(bounds) + 7, 50, 13)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, _, near = line_dedup.near_within(docs, bounds)
    assert near.count() >= 0
    if bounds != line_dedup.BOUNDS:
        got = {x.doc_id: x.dropped for x in line_dedup.dedup_lines(docs, bounds).collect()}
        want = expected(rows, bounds)
        assert got == want and any(want.values())
        kept = {x.doc_id: x.text for x in line_dedup.without_lines(docs, bounds).collect()}
        assert all(kept[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])) for i, t in rows)
    else:
        usual = line_dedup.near_lines(docs)[2]
        assert sorted(map(tuple, near.distinct().collect())) == sorted(map(tuple, usual.collect()))


def test_blocks_of_variants_and_edits():
    words = [str(i % 7).encode() for i in range(30)]
    whole = [tuple(x) for h, r, t in line_dedup.deletions(words, ((1, 2),)) for x in zip(h.tolist(), [r] * len(h), [t] * len(h), strict=True)]
    parts = [tuple(x) for h, r, t in line_dedup.deletions(words, ((1, 2),), block=16) for x in zip(h.tolist(), [r] * len(h), [t] * len(h), strict=True)]
    assert sorted(whole) == sorted(parts)
    r = np.random.default_rng(0)
    for _ in range(300):
        a, b = (list(r.choice(list("abc"), r.integers(1, 9))) for _ in range(2))
        for most in range(4):
            assert line_dedup.edits_apart(a, b, most) == (distance(a, b) <= most)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_lines, x.dropped) for x in line_dedup.dedup_lines(docs, ((1, 1),)).collect()), key=str)
    assert got == sorted([(1, 1, []), (1, 1, [0]), (None, 1, [0]), (2, 1, []), (3, 1, [])], key=str)
    assert line_dedup.dedup_lines(docs.limit(0), ((1, 1),)).count() == 0
