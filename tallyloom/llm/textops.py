"""Words of many texts at once, as arrays of numbers (Python side of the operators that aren't native)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import LOWER, UPPER

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(code of each word, number of words of each text, the distinct words by code); a null text has no words.

    bytes.split() parts at the six blanks \\x20 and \\x09 to \\x0D, no others.
    """
    every: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for n, t in enumerate(texts):
        if t:
            b = t.encode()
            w = (b.translate(LOWERED) if lower else b).split()
            counts[n] = len(w)
            every += w
    d = pa.array(every, pa.large_binary()).dictionary_encode()
    return d.indices.to_numpy(), counts, d.dictionary.to_pylist()


def chunks(texts: list[str | None], chars: int = 4 << 20):
    """The texts in runs of about so many characters (a longer text is a run of its own), so that word lists stay small."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t or "") > chars:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
    if run:
        yield run


def runs(texts: pa.Array, size: int):
    """Bounds of slices of about so many bytes of text (a longer text is one of its own)."""
    at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(at, (at[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def own(texts: pa.Array, without: np.ndarray | None = None) -> pa.Array:
    """A copy of a slice in memory of its own (not all functions of Arrow bear slices), with nulls where `without` is true."""
    return texts.take(pa.array(np.arange(len(texts)), mask=without))


def hashes(vocabulary: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of h reaches every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each text; of fewer words, one hash of them all."""
    codes, counts, vocabulary = words(texts)
    h = hashes(vocabulary)[codes] if len(codes) else np.zeros(0, np.uint64)
    m = max(0, len(h) - k + 1)
    rolled = np.zeros(m, np.uint64)
    for i in range(k):
        rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            s = np.sort(rolled[at : at + n - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted uint32 as differences, their high bytes together: shuffles compress it."""
    return np.diff(sorted_values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)
