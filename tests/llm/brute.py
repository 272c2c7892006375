"""Plain Python versions of the operators' contracts."""

import hashlib
import re
import zlib

LOWER = {c: c + 32 for c in range(65, 91)}
BLANK = re.compile("[\x20\x09-\x0d]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
NAME = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def dedup(rows):
    norm = {i: BLANK.sub(" ", t or "") for i, t in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def decontaminate(rows, items):
    wins = {}
    for item, t in items:
        w = NAME.findall((t or "").translate(LOWER))
        if w:
            for at in range(max(1, len(w) - 9)):
                wins.setdefault(tuple(w[at : at + 10]), set()).add(str(item))
    out = {}
    for i, t in rows:
        w = NAME.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for size in {len(x) for x in wins}:
            for at in range(len(w) - size + 1):
                if got := wins.get(tuple(w[at : at + size])):
                    hit.update(range(at, at + size))
                    ids |= got
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    top, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * (k := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(a), find(b)))
                top[y] = x
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), find(i), links[i]) for i in ids}


def mixing(rows):
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    names = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    has = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    total, target, full = sum(has.values()), {}, set()
    while True:
        rest = total - sum(3 * has[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * has[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * has[s] * (1 + 1e-12)}
        if not over:
            return {i: (size[i], has[source[i]], target[source[i]]) for i in size}
        full |= over


KINDS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def secrets(t):
    found = []
    for n, (kind, (p, ok)) in enumerate(KINDS.items()):
        found += [(m.start(), n, kind, m.end()) for m in p.finditer(t or "") if ok(m)]
    return sorted(found)


def crc(i):
    return zlib.crc32(str(i).encode())
