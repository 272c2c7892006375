"""Language-model scoring by a Brown class bigram model.

Documents are dealt into blocks, each written once as numbers. Each block sends its distinct words (64-bit hashes, by range)
with their training counts to counters, which add them up and reply to each block with the counts of its words; totals come
from the same counters. So the vocabulary is never in one place, whatever its size, and later passes read no text.

Exchange clustering, in two levels:
1. The CLUSTERED most frequent words, and ENDINGS groups of all other words (by their last letters), are assigned to
   CLASSES classes by moving one at a time to the class with the largest likelihood of the class bigrams, until nothing
   moves or SWEEPS passes are over.
2. Every other word of LEAST training occurrences or more then moves by itself to its best class, by its counts of
   neighbouring classes. They are gathered as the counts are (blocks send, counters reply), so the clustered vocabulary
   grows with the training documents. Words of a sweep move at once; sweeps end when the likelihood gains less than
   TOLERANCE of its size or after TAIL_SWEEPS, and the best classes are taken. Rarer words keep the class of their ending.
Class bigrams are counts of all training documents.

Probability of a word w after a word of class d, with c its training count, N all tokens and n1 the words seen once:
    unseen word: u = (n1 + 1) / (N + 2), the share of words to be expected new (one symbol stands for all unseen words)
    known word:  (1 - u) * (MIX * P(class of w | d) * c / count of its class + (1 - MIX) * c / N)
P(class | class) is add-ALPHA smoothed over the classes' shares. A text begins after the end of one and ends with one.

Defined results: a null text is empty and has the end alone; without training documents every token is unseen and the score
is the base's; null ids are neither held out nor learned from; repeated rows count as often as they occur; other columns
are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import cut, discard, documents, text_hash

CLUSTERED, ENDINGS, CLASSES, ALPHA, MIX, SWEEPS = 1000, 255, 64, 1.0, 0.98, 8
LEAST, TAIL_SWEEPS, TOLERANCE = 2, 2, 1e-4
BLOCK_BYTES = 8 << 20


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7


def ending(words: list[bytes]) -> np.ndarray:
    """Group of a word by its last two bytes and whether it is longer."""
    return (textops.hashes([w[-2:] + (b"+" if len(w) > 2 else b"") for w in words], 7) % np.uint64(ENDINGS)).astype(np.int64)


def cut_up(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (top bits) that sorted hashes fall into, and where each begins (and the last ends)."""
    of = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], np.append(first, len(h))


BLOCKS = "bucket int, block int, data binary, counts binary, endings binary, codes binary, docs array<struct<doc_id:{},held_out:boolean,learn:boolean,n:int>>"


def encoder(bits: int):
    """A block of documents -> (bucket -1) its words as numbers, and (bucket 0 and on) its words' training counts by range.

    As numbers: data has the hashes of the distinct words, frequent ones first, endings their groups of endings, codes each
    word's place in that order (low halves, then high halves, which shuffles compress), docs the documents.
    """

    def send(key, t):
        codes, counts, vocabulary = textops.words(t["text"].to_pylist())
        h = textops.hashes(vocabulary)
        order = np.argsort(-np.bincount(codes, minlength=len(h)), kind="stable")
        place = np.empty(len(h), np.uint32)
        place[order] = np.arange(len(h), dtype=np.uint32)
        codes = place[codes] if len(codes) else np.zeros(0, np.uint32)
        h, endings = h[order], ending(vocabulary)[order].astype(np.uint8) if vocabulary else np.zeros(0, np.uint8)
        learn = np.repeat(t["learn"].to_numpy(zero_copy_only=False).astype(bool), counts)
        n, by_hash = np.bincount(codes[learn], minlength=len(h)).astype(np.uint32), np.argsort(h)
        words, n = h, n[by_hash]
        h = h[by_hash]
        of, at = cut_up(h, bits)
        docs = pa.StructArray.from_arrays([t[c].combine_chunks() for c in ("doc_id", "held_out", "learn")] + [pa.array(counts, pa.int32())], ["doc_id", "held_out", "learn", "n"])
        block, m = key[0].as_py(), len(of)
        return pa.table({
            "bucket": pa.array([-1, *of.tolist()], pa.int32()),
            "block": pa.array([block] * (m + 1), pa.int32()),
            "data": pa.array([words.tobytes(), *(h[a:b].tobytes() for a, b in pairwise(at))], pa.binary()),
            "counts": pa.array([None, *(n[a:b].tobytes() for a, b in pairwise(at))], pa.binary()),
            "endings": pa.array([endings.tobytes()] + [None] * m, pa.binary()),
            "codes": pa.array([(codes & 0xFFFF).astype(np.uint16).tobytes() + (codes >> 16).astype(np.uint16).tobytes()] + [None] * m, pa.binary()),
            "docs": pa.ListArray.from_arrays(pa.array([0, *[len(docs)] * (m + 1)], pa.int32()), docs),
        })

    return send


class Block:
    """A block of documents as numbers, from its row."""

    def __init__(self, t: pa.Table):
        some = len(t) > 0
        self.block = t["block"][0].as_py() if some else -1
        self.h = np.frombuffer(t["data"][0].as_py() if some else b"", np.uint64)
        self.endings = np.frombuffer(t["endings"][0].as_py() if some else b"", np.uint8).astype(np.int64)
        halves = np.frombuffer(t["codes"][0].as_py() if some else b"", np.uint16).astype(np.int64).reshape(2, -1)
        self.codes = halves[0] | halves[1] << 16
        self.by_hash = np.argsort(self.h)
        self.docs = t["docs"].combine_chunks().flatten()
        self.counts = self.doc("n").to_numpy().astype(np.int64)
        self.learn = self.doc("learn").to_numpy(zero_copy_only=False).astype(bool)

    def doc(self, column: str) -> pa.Array:
        return pc.struct_field(self.docs, column)

    def units(self, top: np.ndarray) -> np.ndarray:
        """The unit (clustered word or group of endings) of each distinct word; top is sorted."""
        if not len(top) or not len(self.h):
            return self.endings
        at = np.minimum(np.searchsorted(top, self.h), len(top) - 1)
        return np.where(top[at] == self.h, at, len(top) + self.endings)

    def stream(self) -> np.ndarray:
        """The words of training documents in turn, the end (one number more than there are words) before and after each text."""
        word = self.codes[np.repeat(self.learn, self.counts)]
        counts = self.counts[self.learn]
        out = np.full(len(word) + len(counts) + 1, len(self.h))
        out[1 + np.arange(len(word)) + np.repeat(np.arange(len(counts)), counts)] = word
        return out


REPLY = "block int, bucket int, counts binary, tokens long, types long, once long, top binary, top_counts binary"


def counter(clustered: int):
    """Replies to blocks, and a row for block -1 with the bucket's totals and most frequent words."""

    def count(key, t):
        sent = [np.frombuffer(x, np.uint64) for x in t["data"].to_pylist()]
        values, inverse = np.unique(np.concatenate(sent), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint32) for x in t["counts"].to_pylist()])).astype(np.int64)
        mine, at = total[inverse], np.cumsum([0, *map(len, sent)])
        top = np.lexsort((values, -total))[:clustered]
        top = top[total[top] > 0]
        none = [None] * len(sent)
        return pa.table({
            "block": pa.array([*t["block"].to_pylist(), -1], pa.int32()),
            "bucket": pa.array([key[0].as_py()] * (len(sent) + 1), pa.int32()),
            "counts": pa.array([*(mine[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)), None], pa.binary()),
            "tokens": pa.array([*none, int(total.sum())], pa.int64()),
            "types": pa.array([*none, int(np.count_nonzero(total))], pa.int64()),
            "once": pa.array([*none, int(np.count_nonzero(total == 1))], pa.int64()),
            "top": pa.array([*none, values[top].tobytes()], pa.binary()),
            "top_counts": pa.array([*none, total[top].tobytes()], pa.binary()),
        })

    return count


def pairs(top: np.ndarray):
    """Blocks -> counts of pairs of adjacent units in training documents, the end between texts included."""
    end = len(top) + ENDINGS
    m = end + 1

    def run(batches):
        total = np.zeros(m * m, np.int64)
        for t in batches:
            for i in range(t.num_rows):
                b = Block(pa.Table.from_batches([t.slice(i, 1)]))
                u = np.append(b.units(top), end)[b.stream()]
                total += np.bincount(u[:-1] * m + u[1:], minlength=m * m)
        k = np.flatnonzero(total)
        for a in range(0, len(k), 1 << 16):
            yield pa.record_batch([pa.array(k[a : a + (1 << 16)]), pa.array(total[k[a : a + (1 << 16)]])], ["pair", "n"])

    return run


def exchange(n: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of the units from the matrix of their bigram counts; the last unit (the end) keeps a class of its own."""
    m = len(n)
    freq = n.sum(1) + n.sum(0)
    of = np.empty(m, np.int64)
    of[np.argsort(-freq, kind="stable")] = np.arange(m) % (classes - 1)
    of[m - 1] = classes - 1
    c = np.zeros((classes, classes))
    np.add.at(c, (of[:, None], of[None, :]), n)

    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-freq[: m - 1], kind="stable").tolist():
            if not freq[w]:
                continue
            a = of[w]
            out = np.bincount(of, n[w], classes)  # w before each class
            into = np.bincount(of, n[:, w], classes)  # each class before w
            own = float(n[w, w])
            out[a] -= own
            into[a] -= own
            c[a, :] -= out
            c[:, a] -= into
            c[a, a] -= own
            b = best_class(c, out, into, own, a)
            moved += b != a
            of[w] = b
            c[b, :] += out
            c[:, b] += into
            c[b, b] += own
        if not moved:
            break
    return of


def f(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def likelihood(c: np.ndarray) -> float:
    """Of class bigrams, without what doesn't depend on the classes."""
    return float(f(c).sum() - f(c.sum(1)).sum() - f(c.sum(0)).sum())


def best_class(c: np.ndarray, out: np.ndarray, into: np.ndarray, own: float, a: int, sums: tuple | None = None) -> int:
    """The class that a unit of class a, taken out of the class bigrams c, is to join; the last class is closed.

    sums: those of rows and columns, with the unit counted as its neighbours' neighbour.
    """
    row, col = (c.sum(1) + into, c.sum(0) + out) if sums is None else sums
    # joining class b adds out to its row, into to its column, and all that lies between w and b to its diagonal
    o, i = np.flatnonzero(out), np.flatnonzero(into)
    x, y, d = c[:, o], c[i].T, np.diag(c)
    gain = (f(x + out[o]) - f(x)).sum(1) + (f(y + into[i]) - f(y)).sum(1)
    v = f(np.stack((d + out + into + own, d + out, d + into, d, row + out.sum() + own, row, col + into.sum() + own, col)))
    gain += v[0] - v[1] - v[2] + v[3] - v[4] + v[5] - v[6] + v[7]
    gain[-1] = -np.inf
    return int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a


SMALL = 16


def best_classes(c: np.ndarray, rows: np.ndarray, columns: np.ndarray, was: np.ndarray, out: np.ndarray, into: np.ndarray, own: np.ndarray) -> np.ndarray:
    """best_class of many units at once, each taken out of the class bigrams c by itself.

    was: their classes; out and into: a row of counts by class after and before each; own: pairs of a unit with itself.
    """
    m, k = out.shape
    every, fc = np.arange(m), f(c)
    gain = np.zeros((m, k))
    for counts, others, x, fx in ((out, into, c.T, fc.T), (into, out, c, fc)):
        few = f(x[:, None, :] + np.arange(SMALL + 1)[None, :, None]) - fx[:, None, :]  # by neighbour, count and class
        w, o = np.nonzero(counts)
        n, a = counts[w, o], was[w]
        g = few[o, np.minimum(n, SMALL).astype(np.int64)]
        if len(many := np.flatnonzero(n > SMALL)):
            g[many] = f(x[o[many]] + n[many, None]) - fx[o[many]]
        # the unit's own class has lost its counts; of a neighbour of that class all have
        each = np.arange(len(w))
        left = x[o, a] - n
        g[each, a] = f(left + n) - f(left)
        if len(same := np.flatnonzero(o == a)):
            left = x[o[same]] - others[w[same]]
            left[np.arange(len(same)), a[same]] -= n[same] + own[w[same]]
            g[same] = f(left + n[same, None]) - f(left)
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(g, first)
    d, row, col = (np.repeat(x[None, :], m, 0) for x in (np.diag(c), rows, columns))
    outs, ins = out.sum(1), into.sum(1)
    d[every, was] -= out[every, was] + into[every, was] + own
    row[every, was] -= outs + own
    col[every, was] -= ins + own
    own, outs, ins = own[:, None], outs[:, None], ins[:, None]
    gain += f(d + out + into + own) - f(d + out) - f(d + into) + f(d) - f(row + outs + own) + f(row) - f(col + ins + own) + f(col)
    gain[:, -1] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[every, best] > gain[every, was] + 1e-9, best, was)


class Model:
    def __init__(self, top: np.ndarray, of: np.ndarray, n: np.ndarray, tokens: int, types: int, once: int, ends: int):
        self.top, self.of, self.tokens, self.types, self.ends = top, of, tokens, types, ends
        classes = int(of.max()) + 1
        c = np.zeros((classes, classes))
        np.add.at(c, (of[:, None], of[None, :]), n)
        self.new = (once + 1) / (tokens + 2)
        self.fit(c)

    def fit(self, c: np.ndarray) -> None:
        """Take c as the class bigrams."""
        self.bigrams, share = c, c.sum(0) / max(1, c.sum())
        self.step = (c + ALPHA * share) / (c.sum(1, keepdims=True) + ALPHA)
        self.size = c.sum(0)

    def known(self, block: Block, replies):
        """Training count and class of each word of a block, and which words are classed by themselves."""
        replies = replies.sort_by("bucket")
        n = np.zeros(len(block.h), np.int64)
        n[block.by_hash] = np.frombuffer(b"".join(x for x in replies["counts"].to_pylist() if x is not None), np.int64)
        u = block.units(self.top)
        k, tail = self.of[u], block.by_hash[((u >= len(self.top)) & (n >= LEAST))[block.by_hash]]
        if sent := [x for x in replies["classes"].to_pylist() if x is not None]:
            k[tail] = np.frombuffer(b"".join(sent), np.uint8)
        return n, k, tail

    def contexts(self, bits: int, gather: bool):
        """Blocks -> their class bigrams (bucket -1); and, if to be gathered, the neighbouring classes of their other words by bucket."""
        classes = len(self.bigrams)

        def send(t, replies):
            block = Block(t)
            h = block.h
            _, k, tail = self.known(block, replies)
            stream = block.stream()
            before, after = stream[:-1], stream[1:]
            of = np.append(k, classes - 1)
            c = np.bincount(of[before] * classes + of[after], minlength=classes * classes).astype(np.int64)
            rows = [(-1, b"", b"", b"", b"", b"", c.tobytes())]
            if gather and len(tail):
                place, width = np.full(len(h) + 1, -1), 2 * classes + 1
                place[tail] = np.arange(len(tail))
                x, y = place[before], place[after]
                own = (before == after) & (x >= 0)
                a, b = (x >= 0) & ~own, (y >= 0) & ~own
                keys = np.concatenate((x[a] * width + of[after[a]], y[b] * width + classes + of[before[b]], x[own] * width + 2 * classes))
                keys, n = np.unique(keys, return_counts=True)
                more = (n - 1) // 255  # a count takes a byte; larger ones come in parts
                last = np.cumsum(more + 1) - 1
                keys, left = np.repeat(keys, more + 1), n - 255 * more
                n = np.full(len(keys), 255, np.uint8)
                n[last] = left
                word, keys = keys // width, (keys % width).astype(np.uint8)
                sizes = np.bincount(word, minlength=len(tail)).astype(np.uint16)
                buckets, at = cut_up(h[tail], bits)
                to = np.searchsorted(word, at)
                for j, (p, q), (r, s) in zip(buckets.tolist(), pairwise(at.tolist()), pairwise(to.tolist()), strict=True):
                    mine = tail[p:q]
                    rows.append((j, h[mine].tobytes(), k[mine].astype(np.uint8).tobytes(), sizes[p:q].tobytes(), keys[r:s].tobytes(), n[r:s].tobytes(), None))
            return pa.Table.from_pylist([dict(zip(("bucket", "data", "classes", "sizes", "keys", "n", "bigrams"), r, strict=True), block=block.block) for r in rows], CONTEXT_ROWS).select(CONTEXT_ROWS.names)

        return send

    def mover(self, chunk: int = 1024):
        """Counters: the best class of each word by its neighbouring classes in all blocks."""
        c, classes = self.bigrams, len(self.bigrams)

        def move(key, t):
            sent = [np.frombuffer(x, np.uint64) for x in t["data"].to_pylist()]
            at, width = np.cumsum([0, *map(len, sent)]), 2 * classes + 1
            values, inverse = np.unique(np.concatenate(sent), return_inverse=True)
            was = np.zeros(len(values), np.int64)
            was[inverse] = np.frombuffer(b"".join(t["classes"].to_pylist()), np.uint8)
            keys, sizes, n = (np.frombuffer(b"".join(t[x].to_pylist()), kind) for x, kind in (("keys", np.uint8), ("sizes", np.uint16), ("n", np.uint8)))
            keys, where = np.unique(np.repeat(inverse, sizes) * width + keys, return_inverse=True)
            n = np.bincount(where, n, len(keys))
            to = np.searchsorted(keys, np.arange(len(values) + 1) * width)
            now, rows, columns = was.copy(), c.sum(1), c.sum(0)
            for lo in range(0, len(values), chunk):
                hi = min(lo + chunk, len(values))
                x = np.zeros((hi - lo, width))
                x.ravel()[keys[to[lo] : to[hi]] - lo * width] = n[to[lo] : to[hi]]
                now[lo:hi] = best_classes(c, rows, columns, was[lo:hi], x[:, :classes], x[:, classes:-1], x[:, -1])
            mine = now[inverse].astype(np.uint8)
            return pa.table({"block": t["block"], "bucket": t["bucket"], "counts": pa.nulls(len(sent), pa.binary()), "classes": pa.array([mine[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

        return move

    def score(self, t, replies):
        block = Block(t)
        n, classes, _ = self.known(block, replies)
        codes, counts = block.codes, block.counts
        last = np.cumsum(counts + 1) - 1
        at = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
        c, k = np.zeros(len(codes) + len(counts), np.int64), np.full(len(codes) + len(counts), self.of[-1])
        c[at], c[last] = n[codes], self.ends
        if len(codes):
            k[at] = classes[codes]
        base = np.log10((c + 1) / (self.tokens + 1 * (self.types + 1)))
        if self.tokens:
            before = np.concatenate((self.of[-1:], k[:-1]))
            p = MIX * self.step[before, k] * c / np.maximum(1, self.size[k]) + (1 - MIX) * c / self.tokens
            p = np.where(c > 0, (1 - self.new) * p, self.new)
            own = np.log10(p)
        else:
            own = base
        first = last - counts
        add = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        many = len(counts)
        return pa.table({"doc_id": block.doc("doc_id"), "held_out": block.doc("held_out"), "n_tokens": pa.array(counts + 1), "n_known": pa.array(add((c > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(many, self.tokens), pa.int64()), "base_score": pa.array(add(base), pa.float64()), "score": pa.array(add(own), pa.float64())})


CONTEXT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("n", pa.binary()), ("bigrams", pa.binary())])
CONTEXTS = "bucket int, block int, data binary, classes binary, sizes binary, keys binary, n binary, bigrams binary"


def added(batches):
    """The sum of class bigrams of a partition."""
    total = None
    for b in batches:
        for x in b["bigrams"].to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x if total is None else total + x
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["bigrams"])


def classed(d: DataFrame, replies: DataFrame, model: Model, bits: int) -> DataFrame:
    """Class all other words by themselves: replies with their classes. The model takes over the class bigrams."""
    spark, kept = d.sparkSession, replies

    def count(to: DataFrame, gather: bool) -> tuple[DataFrame, np.ndarray]:
        known = spark.sparkContext.broadcast(model)  # bounded by CLUSTERED, ENDINGS and CLASSES
        sent = d.groupBy("block").cogroup(to.groupBy("block")).applyInArrow(lambda t, r: known.value.contexts(bits, gather)(t, r), CONTEXTS)
        sent = cut(sent, "contexts")
        c = [np.frombuffer(r.bigrams, np.int64) for r in sent.where("bucket < 0").select("bigrams").mapInArrow(added, "bigrams binary").collect()]
        return sent, np.sum(c, 0).reshape(model.bigrams.shape).astype(float)

    for sweep in range(TAIL_SWEEPS):
        if not sweep:
            sent, _ = count(kept, True)
        moved = spark.sparkContext.broadcast(model)
        classes = cut(sent.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda k, t: moved.value.mover()(k, t), "block int, bucket int, counts binary, classes binary"), "classes")
        discard(sent)
        to = replies.unionByName(classes)
        sent, c = count(to, sweep + 1 < TAIL_SWEEPS)
        gain = likelihood(c) - likelihood(model.bigrams)
        if gain > 0:
            model.fit(c)
            kept = to
        if gain <= TOLERANCE * abs(likelihood(model.bigrams)):
            break
    discard(sent)
    return kept


SCORES = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, clustered: int = CLUSTERED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-total // block_bytes))
    bits = max(1, (blocks - 1).bit_length())  # buckets grow with the input
    held = F.coalesce(remainder() == 2, F.lit(False))
    d = docs.select("doc_id", "text", held.alias("held_out"), (F.col("doc_id").isNotNull() & ~held).alias("learn"))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", text_hash()), F.lit(blocks)).cast("int"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = cut(d.groupBy("block").applyInArrow(encoder(bits), BLOCKS.format(kind)), "blocks")
    encoded = sent.where("bucket < 0").drop("bucket", "counts")
    sent = sent.where("bucket >= 0").select("bucket", "block", "data", "counts")
    replies = cut(sent.groupBy("bucket").applyInArrow(counter(clustered), REPLY), "counts")
    ends = docs.where(F.col("doc_id").isNotNull() & ~held).count()
    s = replies.where("block < 0").agg(F.sum("tokens"), F.sum("types"), F.sum("once")).first()
    tokens, types, once = (s[0] or 0) + ends, (s[1] or 0) + (ends > 0), s[2] or 0
    few = replies.where("block < 0").select(F.col("top"), F.col("top_counts")).mapInArrow(heads, "h long, n long").orderBy(F.desc("n"), "h").limit(clustered).collect()
    top = np.sort(np.array([r.h for r in few], np.int64).view(np.uint64))
    m = len(top) + ENDINGS + 1
    n = np.zeros(m * m)
    learned = encoded.mapInArrow(pairs(top), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    n[learned["pair"].to_numpy()] = learned["n"].to_numpy()  # at most m * m rows
    n = n.reshape(m, m)
    model = Model(top, exchange(n), n, tokens, types, once, ends)
    replies = replies.where("block >= 0").select("block", "bucket", "counts", F.lit(None).cast("binary").alias("classes"))
    if types > len(top) + 1 and tokens:
        replies = classed(encoded, replies, model, bits)
    known = docs.sparkSession.sparkContext.broadcast(model)  # bounded by CLUSTERED, ENDINGS and CLASSES
    return encoded.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda t, r: known.value.score(t, r), SCORES.format(kind))


def heads(batches):
    for b in batches:
        h = np.frombuffer(b"".join(b["top"].to_pylist()), np.int64)
        n = np.frombuffer(b"".join(b["top_counts"].to_pylist()), np.int64)
        yield pa.record_batch([pa.array(h), pa.array(n)], ["h", "n"])


def op3_class_bigram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
