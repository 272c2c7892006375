"""N-gram Jaccard join by prefix trees: documents whose 5-word shingle sets have a similarity of 0.75 or more.

1. Rarity. Documents are dealt into blocks. Each block sends the hashes of its shingles, by range of hash, to counters,
   which reply with a class of document frequency (its binary logarithm) for each.
2. Prefixes. Shingles are ordered globally by that class, then by hash. Two sets linked at threshold t share a shingle
   among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2 t n / (1 + t)) + 1 of the smaller (whose overlap
   is 2 t n / (1 + t) at least). Shingles that no other set has drop out of the prefixes at once, so a text with enough words
   of its own goes no further, and sets whose shared passages come after too many shingles of their own never meet.
3. Candidate groups: sets that share prefix shingles, directly or not (components over the shingle's smallest set).
   A group too large for a task is dealt into cells by size and hash. Its cells are linked within, then across by one set
   of each component, and only sets outside the group's largest component then meet the cells of the same and adjacent
   size classes: a large group of near copies doesn't grow into all pairs of its cells.
4. Prefix trees. A task stores its sets in a path-compressed trie, in the global order (from its end, as what many sets have
   is shared best). Each set walks the trie: overlaps
   of shared paths are counted once, and a subtree is left when the remaining lengths can't reach the needed overlap or
   all of it is linked already. The tests on leaves are exact; a task reports a spanning forest of its links.
5. Components over these links.
6. Numbers of links, where asked for. Links run within a component alone. One of two sets is one link; the sets of a larger
   component, dealt into cells, meet cell by cell, and the trie of one cell counts the links of each set of the other. No
   pair leaves its task. This is exact and takes time by the square of a component's different sets, as their links do.

Sets are named by a 128-bit hash, shingles by 64 bits (in step 1 by at least 32 bits, where a clash only adds candidates; in
step 4 by 58, besides the class).

Defined results: null and empty texts have an empty set and are their own component; equal sets are linked, however many;
the component of rows without ids is null; repeated rows are documents of their own, linked with each other; a document
without words has 0 links; other columns are ignored.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops
from .common import cut, discard, documents, parts, release, text_hash
from .graph import components

K, NUM, DEN = 5, 75, 100
BLOCK_BYTES = 8 << 20
CELL_SETS, CELL_SHINGLES = 256, 1 << 18


def dealt(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """doc_id, text, text_hash and block: blocks of about equal bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, -(-total // block_bytes))
    return docs.select("doc_id", "text", text_hash().alias("text_hash")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)).cast("int")), blocks


def bucket_bits(blocks: int) -> int:
    """Buckets are ranges of hash: as many as blocks."""
    return max(1, (blocks - 1).bit_length())


def cut_up(h: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """The buckets that sorted hashes fall into, and where each begins (and the last ends)."""
    of = (h >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first].tolist(), [*first.tolist(), len(h)]


def block_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block's distinct sets, and in how many of these each is."""
    once = {s.tobytes(): s for s in sets if len(s)}
    return np.unique(np.concatenate(list(once.values())) if once else np.zeros(0, np.uint64), return_counts=True)


SENT = "bucket int, block int, data binary, counts binary"


def sender(bits: int, k: int):
    def send(key, t):
        h, n = block_shingles(textops.shingle_sets(t["text"].to_pylist(), k))
        full, at = cut_up(h, bits)
        low, n = (h >> np.uint64(32 - bits)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        return pa.table({"bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()), "data": pa.array([textops.pack(low[a:b]) for a, b in pairwise(at)], pa.binary()), "counts": pa.array([n[a:b].tobytes() for a, b in pairwise(at)], pa.binary())})

    return send


def count(key, t):
    """A bucket's frequencies over all blocks, replied to each as classes: floor(log2), so 0 for one set."""
    sent = [textops.unpack(x) for x in t["data"].to_pylist()]
    values, inverse = np.unique(np.concatenate(sent), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([np.frombuffer(x, np.uint8) for x in t["counts"].to_pylist()]))
    classes = np.floor(np.log2(total)).astype(np.uint8)[inverse]
    at = np.cumsum([0, *map(len, sent)])
    return pa.table({"block": t["block"], "bucket": t["bucket"], "classes": pa.array([classes[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})


NODES = "doc_id long, text_hash long, n int, key binary, posted array<long>, meeting int, shingles binary"


def least_overlap(n: int) -> int:
    """Of a set of n with any set linked to it."""
    return -(-NUM * n // DEN)


def larger_overlap(n: int) -> int:
    """Of a set of n with any linked set that isn't smaller."""
    return -(-2 * NUM * n // (DEN + NUM))


def ordered(s: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Shingles in the global order, as numbers of the same order: class of frequency, then hash."""
    return np.sort((c.astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6)))


def poster(k: int):
    def post(t, replies):
        sets = textops.shingle_sets(t["text"].to_pylist(), k)
        h, _ = block_shingles(sets)
        replies = replies.sort_by("bucket")
        classes = np.frombuffer(b"".join(replies["classes"].to_pylist()), np.uint8)
        keys, posted, meeting, kept, seen = [], [], [], [], set()
        for s in sets:
            key = xxhash.xxh3_128_digest(s.tobytes())
            keys.append(key)
            mine, c, some = None, None, 0
            if len(s) and key not in seen:
                seen.add(key)
                c = classes[np.searchsorted(h, s)]
                size = len(s) - least_overlap(len(s)) + 1
                if np.count_nonzero(c == 0) < size:
                    first = np.lexsort((s, c))[:size]
                    some = int(np.count_nonzero(c[first[: len(s) - larger_overlap(len(s)) + 1]] > 0))
                    mine = s[first[c[first] > 0]].view(np.int64).tolist()
            posted.append(mine or None)
            meeting.append(some if mine else None)
            kept.append(ordered(s, c).tobytes() if mine else None)
        return pa.table({"doc_id": t["doc_id"], "text_hash": t["text_hash"], "n": pa.array([len(s) for s in sets], pa.int32()), "key": pa.array(keys, pa.binary()), "posted": pa.array(posted, pa.list_(pa.int64())), "meeting": pa.array(meeting, pa.int32()), "shingles": pa.array(kept, pa.binary())})

    return post


def trie(seqs: list[np.ndarray]) -> list[tuple]:
    """A path-compressed trie of sequences in lexicographic order: (lo, hi, edge, depth, least and most length, children)."""
    m = len(seqs)
    lcp = np.zeros(m, np.int64)
    for i in range(1, m):
        n = min(len(seqs[i - 1]), len(seqs[i]))
        diff = seqs[i - 1][:n] != seqs[i][:n]
        lcp[i] = int(diff.argmax()) if diff.any() else n
    lengths = np.array([len(s) for s in seqs])
    nodes: list[tuple] = []
    todo = [(0, m, 0, -1)]
    while todo:
        lo, hi, depth, parent = todo.pop()
        end = len(seqs[lo]) if hi - lo == 1 else int(lcp[lo + 1 : hi].min())
        if parent >= 0:
            nodes[parent][6].append(len(nodes))
        if hi - lo > 1:
            at = [lo, *(lo + 1 + np.flatnonzero(lcp[lo + 1 : hi] == end)).tolist(), hi]
            todo += [(a, b, end, len(nodes)) for a, b in zip(at, at[1:], strict=False)]
        nodes.append((lo, hi, seqs[lo][depth:end], end, int(lengths[lo:hi].min()), int(lengths[lo:hi].max()), []))
    return nodes


def sequences(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Sets (sorted numbers of shingles) as ascending small numbers, frequent shingles first; and how many numbers there are."""
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum([0, *map(len, sets)])
    ids = (len(values) - 1 - inverse).astype(np.uint32)
    return [ids[a:b][::-1] for a, b in pairwise(at.tolist())], len(values)


def in_order(seqs: list[np.ndarray], of: list[int]) -> list[int]:
    return sorted(of, key=lambda i: seqs[i].astype(">u4").tobytes())


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted distinct numbers of shingles)."""
    m = len(sets)
    if m < 2:
        return []
    seqs, size = sequences(sets)
    order = in_order(seqs, list(range(m)))
    seqs = [seqs[i] for i in order]
    nodes = trie(seqs)
    group, own, found = np.arange(m), np.zeros(size, bool), []
    for q, x in enumerate(seqs):
        own[x] = True
        nx = len(x)
        todo = [(0, 0, -1)]
        while todo:
            i, overlap, last = todo.pop()
            lo, hi, edge, depth, least, most, below = nodes[i]
            if hi <= q + 1 or (group[max(lo, q + 1) : hi] == group[q]).all():
                continue
            if len(edge):
                overlap += int(np.count_nonzero(own[edge]))
                last = int(edge[-1])
            if (DEN + NUM) * (overlap + min(nx - int(np.searchsorted(x, last, "right")), most - depth)) < NUM * (nx + least):
                continue
            if hi - lo > 1:
                todo += [(b, overlap, last) for b in below]
            else:
                found.append((order[q], order[lo]))
                group[group == group[lo]] = group[q]
        own[x] = False
    return found


def degrees(sets: list[np.ndarray], side: list[bool], copies: list[int]) -> np.ndarray:
    """With how many rows of the other side each set is linked; of the others of its own where there is but one side."""
    seqs, size = sequences(sets)
    ours = [i for i, x in enumerate(side) if x]
    theirs = [i for i, x in enumerate(side) if not x]
    within = not theirs or not ours
    ours = ours or theirs
    order = in_order(seqs, ours if within else theirs)
    nodes = trie([seqs[i] for i in order])
    edges = np.concatenate([x[2] for x in nodes])
    end = np.cumsum([len(x[2]) for x in nodes])
    begin = np.append(0, end[:-1])
    depth, least, most = (np.array([x[i] for x in nodes]) for i in (3, 4, 5))
    leaf = np.array([order[x[0]] if x[1] - x[0] == 1 else -1 for x in nodes])
    parent = np.zeros(len(nodes), np.int64)
    for i, x in enumerate(nodes):
        parent[x[6]] = i
    levels, level = [], [0]
    while level:
        levels.append(np.array(level))
        level = [b for i in level for b in nodes[i][6]]
    weight, out, own = np.array(copies, np.int64), np.zeros(len(sets), np.int64), np.zeros(size, bool)
    alive = np.zeros(len(nodes), bool)
    for q in ours:
        own[seqs[q]] = True
        nx, along = len(seqs[q]), np.append(0, np.cumsum(own[edges]))
        own[seqs[q]] = False
        overlap = along[end] - along[begin]
        alive[:] = False
        alive[0] = True
        for at in levels:
            above = parent[at]
            if at[0]:
                overlap[at] += overlap[above]
            # a leaf has no remaining length, so the bound is the test itself
            alive[at] = alive[above] & ((DEN + NUM) * (overlap[at] + np.minimum(nx - overlap[at], most[at] - depth[at])) >= NUM * (nx + least[at]))
            if not alive[at].any():
                break
        hit = leaf[alive & (leaf >= 0)]
        out[q] += weight[hit].sum()
        if within:
            out[q] -= weight[q]
        else:
            out[hit] += weight[q]
    return out


def counter(batches):
    """Rows sorted by task -> links of each task's sets."""
    rest: list[tuple] = []
    task = None

    def flush():
        got = degrees([np.frombuffer(x[1], np.uint64) for x in rest], [x[2] for x in rest], [x[3] for x in rest]).tolist() if len(rest) > 1 else []
        return [x[0] for x in rest[: len(got)]], got

    for batch in batches:
        keys: list[bytes] = []
        found: list[int] = []
        for t, *row in zip(*(batch[c].to_pylist() for c in ("task", "key", "shingles", "side", "copies")), strict=True):
            if t != task:
                k, n = flush()
                keys, found, rest, task = keys + k, found + n, [], t
            rest.append(tuple(row))
        yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, pa.int64())], ["key", "links"])
    k, n = flush()
    yield pa.record_batch([pa.array(k, pa.binary()), pa.array(n, pa.int64())], ["key", "links"])


def linker(compare):
    def link(batches):
        """Rows sorted by task -> links of each task."""
        rest: list[tuple] = []
        task = None

        def flush():
            got = compare([np.frombuffer(s, np.uint64) for _, s in rest])
            return [rest[a][0] for a, _ in got], [rest[b][0] for _, b in got]

        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            for t, k, s in zip(*(batch[c].to_pylist() for c in ("task", "key", "shingles")), strict=True):
                if t != task:
                    x, y = flush()
                    a, b, rest, task = a + x, b + y, [], t
                rest.append((k, s))
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        x, y = flush()
        yield pa.record_batch([pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["a", "b"])

    return link


def linked(tasks: DataFrame, compare=links) -> DataFrame:
    """(task, key, shingles) -> a spanning forest of each task's links, by links() or another function of its kind."""
    t = tasks.repartition(parts(tasks.sparkSession), "task").sortWithinPartitions("task")
    return cut(t.mapInArrow(linker(compare), "a binary, b binary"), "links")


def dealt_cells(t: DataFrame, keys: list[str], cell_sets: int, cell_shingles: int) -> DataFrame:
    """How many cells each group of keys needs, of at most about cell_sets sets and cell_shingles shingles."""
    return t.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / cell_sets), F.ceil(F.sum("n") / cell_shingles)).cast("int").alias("cells"))


def own_cells(t: DataFrame, keys: list[str], cell_sets: int, cell_shingles: int) -> DataFrame:
    """A task for each cell."""
    t = t.join(dealt_cells(t, keys, cell_sets, cell_shingles), keys).withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    name = F.concat_ws(",", F.hex("label"), *[F.col(k).cast("string") for k in keys if k != "label"], F.col("cell").cast("string"))
    return t.select(name.cast("binary").alias("task"), "key", "shingles")


def size_class(least: float = NUM / DEN) -> Column:
    """Sets linked at a similarity of `least` are of the same or of adjacent classes."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(1 / least + 0.01))).cast("int")


def meetings(t: DataFrame, cell_sets: int, cell_shingles: int, *more: str) -> DataFrame:
    """Tasks in which every set outside its group's largest component (minor) meets all sets it may be linked with: cells of
    the same or adjacent size classes. Sets of the largest component don't meet each other. `side` tells two cells apart."""
    cells = dealt_cells(t, ["label", "minor", "size_class"], cell_sets, cell_shingles)
    around = Window.partitionBy("label").orderBy("size_class").rangeBetween(-1, 1)
    near = F.collect_list(F.struct("minor", "size_class", "cells")).over(around)
    cells = cells.select("*", near.alias("near")).withColumn("near", F.filter("near", lambda x: F.col("minor") | x["minor"]))
    t = t.join(cells, ["label", "minor", "size_class"]).withColumn("cell", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int"))
    t = t.withColumn("meet", F.explode(F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["cells"] - 1), lambda i: F.struct(x["minor"].alias("minor"), x["size_class"].alias("size_class"), i.alias("cell")))))))
    mine = F.struct("minor", "size_class", "cell")
    pair = F.concat_ws(",", F.hex("label"), F.to_json(F.struct(F.least(mine, "meet").alias("a"), F.greatest(mine, "meet").alias("b"))))
    return t.select(pair.cast("binary").alias("task"), "key", "shingles", (mine <= F.col("meet")).alias("side"), *more)


def links_within(nodes: DataFrame, cell_sets: int = CELL_SETS, cell_shingles: int = CELL_SHINGLES, compare=links, least: float = NUM / DEN) -> tuple[DataFrame, DataFrame]:
    """(key, label, n, shingles) -> (key, label): components of the links between sets of the same candidate group; and the
    table that holds them. `compare` finds the links of a task, at a similarity of `least`.

    A group that fits a cell is one task. Of a larger one, cells are linked within first; then one set of each component
    so far and size class is linked with others of the kind, which joins the pieces of large groups of near copies; what is
    left outside the group's largest component then meets all it may be linked with.
    """
    sizes = nodes.groupBy("label").agg(F.count("*").alias("sets"), F.sum("n").alias("all"))
    whole = (F.col("sets") <= cell_sets) & (F.col("all") <= cell_shingles)
    t = nodes.join(sizes.select("label", whole.alias("whole")), "label")
    t = cut(t.withColumn("size_class", size_class(least)), "grouped")
    big = t.where("not whole").drop("whole")
    small = t.where("whole").select(F.col("label").alias("task"), "key", "shingles")
    found = linked(small.unionByName(own_cells(big, ["label", "size_class"], cell_sets, cell_shingles)), compare)
    names, old = components(found), [t, found]
    if not big.isEmpty():
        first = big.join(names.select(F.col("node").alias("key"), F.col("label").alias("own")), "key", "left").withColumn("own", F.coalesce("own", "key"))
        first = first.groupBy("label", "own", "size_class").agg(F.min(F.struct("key", "n", "shingles")).alias("x")).select("label", "x.*")
        across = linked(own_cells(first, ["label"], cell_sets, cell_shingles), compare)
        old += [names, across]
        names = components(found.unionByName(across))
        own = big.join(names.select(F.col("node").alias("key"), F.col("label").alias("own")), "key", "left").withColumn("own", F.coalesce("own", "key"))
        largest = own.groupBy("label", "own").agg(F.count("*").alias("sets")).groupBy("label").agg(F.max(F.struct("sets", "own")).alias("x"))
        largest = largest.join(sizes, "label").where("x.sets < sets").select("label", F.col("x.own").alias("major"))  # others are one component
        rest = cut(own.join(largest, "label").withColumn("minor", F.col("own") != F.col("major")).select("label", "key", "n", "size_class", "shingles", "minor"), "rest")
        more = linked(meetings(rest, cell_sets, cell_shingles).drop("side"), compare)
        old += [rest, more]
        if not more.isEmpty():
            old.append(names)
            # the sets' components so far are enough of a forest for what was linked before
            names = components(names.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    discard(*old)
    return names.select(F.col("node").alias("key"), "label"), names


MOST = 1 << 19


def candidates(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets that may be linked with another one, by candidate group: key, n, shingles, label; and the table of the groups.

    Within this step a set's number is its size (up to MOST), then 44 bits of its key: the smallest number has the smallest
    set. Sets whose numbers clash share a group, which only adds candidates.
    """
    size = F.least(F.col("n"), F.lit(MOST - 1)).cast("long")
    number = F.shiftleft(size, 44).bitwiseOR(F.shiftrightunsigned(F.xxhash64("key"), 20))
    sets = base.where("posted is not null").select(number.alias("id"), "meeting", F.posexplode("posted").alias("at", "h"))
    # a set meets those that aren't smaller by the first `meeting` shingles, smaller ones by any
    least = F.min(F.when(F.col("at") < F.col("meeting"), F.col("id")))
    hubs = sets.groupBy("h").agg(least.alias("least"), F.min("id").alias("a"), F.max("id").alias("z")).where("a != z and least is not null").select("h", "least")
    met = sets.select("id", "h").join(hubs, "h").where(F.shiftright("id", 44) >= F.shiftright("least", 44))
    groups = components(met.select(F.col("least").alias("a"), F.col("id").alias("b")))
    nodes = base.where("shingles is not null").select("key", "n", "shingles").groupBy("key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    names = groups.select(F.col("node").alias("id"), F.hex("label").cast("binary").alias("label"))
    return nodes.withColumn("id", number).join(names, "id").drop("id"), groups


def link_counts(base: DataFrame, labels: DataFrame, cell_sets: int, cell_shingles: int) -> DataFrame:
    """key, links: with how many other rows those that have this set are linked; sets without links aren't listed."""
    copies = base.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"))
    members = cut(copies.join(labels, "key", "left"), "members")
    sizes = members.where("label is not null").groupBy("label").agg(F.count("*").alias("sets"), F.sum("copies").alias("all"))
    sized = members.where("label is not null").join(sizes, "label")
    pairs = sized.where("sets = 2").select("key", (F.col("all") - F.col("copies")).alias("links"))
    nodes = base.where("shingles is not null").select("key", "n", "shingles").groupBy("key").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    large = cut(nodes.join(sized.where("sets > 2").select("key", "label", "copies"), "key").withColumns({"size_class": size_class(), "minor": F.lit(True)}), "large")
    t = meetings(large, cell_sets, cell_shingles, "copies").repartition(parts(base.sparkSession), "task").sortWithinPartitions("task")
    more = t.mapInArrow(counter, "key binary, links long")
    own = members.where("copies > 1").select("key", (F.col("copies") - 1).alias("links"))
    out = cut(own.unionByName(pairs).unionByName(more).groupBy("key").agg(F.sum("links").alias("links")), "link-counts")
    discard(members, large)
    return out


def classes(docs: DataFrame, k: int = K, cell_sets: int = CELL_SETS, cell_shingles: int = CELL_SHINGLES, block_bytes: int = BLOCK_BYTES, count_links: bool = False) -> DataFrame:
    """doc_id, text_hash, n (shingles), component (a name for it, null for empty sets) of each row; n_links where asked for."""
    d, blocks = dealt(docs, block_bytes)
    bits, kind = bucket_bits(blocks), docs.schema["doc_id"].dataType.simpleString()
    # the same columns as below, so that the texts are shuffled once for both
    sent = d.groupBy("block").applyInArrow(sender(bits, k), SENT)
    replies = sent.groupBy("bucket").applyInArrow(count, "block int, bucket int, classes binary")
    base = cut(d.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(poster(k), NODES.replace("doc_id long", f"doc_id {kind}")), "sets")
    del d, sent, replies
    release(docs.sparkSession)  # the texts, shuffled by block
    nodes, groups = candidates(base)
    release(docs.sparkSession)  # the texts, if their plan's events were still on their way; the prefixes
    labels, links_ = links_within(nodes, cell_sets, cell_shingles)
    del nodes
    release(docs.sparkSession)  # the candidates' shingles
    counts = link_counts(base, labels, cell_sets, cell_shingles) if count_links else None
    sets, base = base, base.select("doc_id", "text_hash", "n", "key")
    full, component = base.where("n > 0").join(labels, "key", "left"), F.coalesce("label", "key").alias("component")
    empty = base.where("n = 0").withColumn("component", F.lit(None).cast("binary"))
    columns = ["doc_id", "text_hash", "n"]
    if counts is not None:
        full, empty = full.join(counts, "key", "left").withColumn("n_links", F.coalesce("links", F.lit(0))), empty.withColumn("n_links", F.lit(0).cast("long"))
        columns.append("n_links")
    out = cut(full.select(*columns, component).unionByName(empty.select(*columns, "component")), "labelled")
    discard(sets, groups, links_, counts)
    return out


def near_duplicates(docs: DataFrame, k: int = K, cell_sets: int = CELL_SETS, cell_shingles: int = CELL_SHINGLES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, n_links (other rows linked with this), component (a name for it, null for
    empty sets)."""
    every = classes(docs, k, cell_sets, cell_shingles, block_bytes, count_links=True).withColumn("n", F.col("n").cast("long")).withColumnRenamed("n", "n_shingles")
    full, empty = every.where("component is not null"), every.where("component is null")
    least = cut(full.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "n_links", "component"]
    return full.join(least, "component").select(*columns).unionByName(empty.withColumn("component_id", F.col("doc_id")).select(*columns))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id (of equal ids, the smallest text hash; null ids last).

    Documents without words are kept, all of them; of repeated rows one stays; an empty table gives an empty result; all
    columns of docs are returned, whatever their names.
    """
    first = classes(docs).where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("text_hash"))).alias("x"))
    keep = cut(first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text_hash").alias("text_hash")), "kept")
    rows = docs.withColumns({"tallyloom_id": F.col("doc_id"), "tallyloom_hash": text_hash()})
    on = F.col("tallyloom_id").eqNullSafe(F.col("k.doc_id")) & (F.col("tallyloom_hash") == F.col("k.text_hash"))
    got = rows.alias("d").join(keep.alias("k"), on, "left_semi")
    got = got.withColumn("tallyloom_nth", F.row_number().over(Window.partitionBy("tallyloom_id", "tallyloom_hash").orderBy("tallyloom_hash"))).where("tallyloom_nth = 1")
    empty = rows.where("text is null or not rlike(text, '[^\\\\x20\\\\x09-\\\\x0D]')")
    return got.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(empty.select(*[F.col(f"`{c}`") for c in docs.columns]))


#: Sets of shingles as strings, pairs by their shared shingles, the smallest id reachable by links.
OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1 : p + 5], ' ') AS s FROM p), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a), least_ AS (SELECT a, min(b) AS m FROM r GROUP BY a), many AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = w.doc_id LEFT JOIN many ON many.a = w.doc_id
"""
