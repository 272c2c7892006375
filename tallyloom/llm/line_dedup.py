"""Line dedup by a deletion-neighbourhood join.

Lines are compared as sequences of lower-case words. Two lines are near when they are equal, or, from MIN_WORDS words on
(in the longer), when one word inserted, deleted or replaced makes them equal (edit bound 1). A line that has a near line
earlier in the corpus (by doc_id, then text hash, then line number) is dropped; the earliest stays. Blank lines stay.

1. Of equal lines, the earliest position is kept (one row for each distinct line).
2. An edit leaves the first or the last half of a line untouched. Distinct lines that share neither with another line have
   no near line; the others are candidates. (The halves are those of the longer length, so a line has two of each.)
3. Candidates emit all variants within the bound as hashed keys: the line itself and the line without each word of the
   half that may differ. Equal keys join: a replacement shows as the same deletion at the same place in both, an insertion
   or deletion as one line being the other's variant. Each line is joined to the earliest of a key, never to all, so groups
   stay linear.
4. The edit distance of each pair is verified on the words.

Equal lines are told by 128 bits of hash over their words.

Other bounds are a parameter: `bounds` is a list of (words, edits), and two lines are near within the most edits that any entry
allows to the longer one of them; ((1, 1), (20, 2)) allows one word to lines of any length and two from 20 words on. Any
bounds but the default go through near_within(): all variants within the bound are hashed with the places of the words that
count as replaced, so that equal keys, and the numbers of words that were only taken out, say how many edits two lines are
apart, and the earliest line within the bound is the least of a few per key. It emits about n ** edits keys for a line of n
words, in blocks: a thousand words with a bound of two are some two million keys. No line is left out.

Defined results: null and empty texts have no lines; null ids come last; repeated rows are documents of their own, whose
order follows an internal row number, so all but one lose all lines that aren't blank; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textops
from .common import BLANKS, LOWER, UPPER, cut, documents, ordered_offsets, text_hash

MIN_WORDS = 8
#: From how many words (of the longer line) on how many edits count as near.
BOUNDS = ((MIN_WORDS, 1),)


def line_words(line: Column) -> Column:
    return F.filter(F.split(F.translate(line, UPPER, LOWER), BLANKS), lambda w: w != "")


def joined(w: Column) -> Column:
    return F.array_join(w, " ")


BASE, AGAIN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Sums:
    """Hashes of stretches of a stream of word hashes, each from the words in it alone."""

    def __init__(self, w: np.ndarray, base: int):
        n = len(w)
        power, self.back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
        power[1:] = np.cumprod(np.full(n, base, np.uint64))
        self.back[1:] = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
        self.at = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * power[:n])))

    def of(self, a: np.ndarray, b: np.ndarray, *more: np.ndarray | int) -> np.ndarray:
        out = (self.at[b] - self.at[a]) * self.back[a]
        for x in more:
            out = textops.mixed(out + np.asarray(x).astype(np.uint64) * np.uint64(AGAIN))
        return out.view(np.int64)


def word_hashes(vocabulary: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, vocabulary)), np.uint64).reshape(-1, 2)


def line_keys(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """For each line of each text: which text, line number, words, 128 bits of its words (key, key2) and hashes of its halves."""
    found = pc.split_pattern(pc.ascii_lower(pc.fill_null(textops.own(texts), "")), "\n")
    of = pc.list_parent_indices(found).to_numpy().astype(np.int32)
    nos = np.arange(len(of), dtype=np.int32) - np.repeat(np.cumsum(many := pc.list_value_length(found).to_numpy()) - many, many).astype(np.int32)
    split = pc.ascii_split_whitespace(found.flatten())
    words, line = split.flatten(), pc.list_parent_indices(split)
    some = pc.not_equal(words, "")
    words, line = words.filter(some), line.filter(some)
    d = words.dictionary_encode()
    h = word_hashes(pc.cast(d.dictionary, pa.binary()).to_pylist())[d.indices.to_numpy()] if len(words) else np.zeros((0, 2), np.uint64)
    one, two = Sums(textops.mixed(h[:, 0]), BASE), Sums(textops.mixed(h[:, 1]), AGAIN)
    n = np.bincount(line.to_numpy(), minlength=len(of))
    end = np.cumsum(n)
    first = end - n
    halves = []
    for longer in (0, 1):
        size = n + longer
        q = np.maximum((size - 1) // 2, 0)
        halves += [one.of(first, first + np.minimum(q, n), size, 1), one.of(end - np.clip(size - q - 1, 0, n), end, size, 2)]
    return of, nos, n, one.of(first, end, n), two.of(first, end, n), np.stack(halves, 1)


def keyer(batches):
    for batch in batches:
        for a, z in textops.runs(batch["text"], 8 << 20):
            b = batch.slice(a, z - a)
            of, nos, n, key, key2, halves = line_keys(b["text"])
            whose, blank, long = pa.array(of), n == 0, n >= MIN_WORDS - 1
            offsets = pa.array(np.append(0, np.cumsum(4 * long)), pa.int32(), mask=np.append(~long, False))
            halves = pa.ListArray.from_arrays(offsets, pa.array(halves[long].ravel()))
            yield pa.record_batch([*(b[c].take(whose) for c in ("doc_id", "text_hash", "row_id")), pa.array(nos), pa.array(key, mask=blank), pa.array(key2, mask=blank), halves], ["doc_id", "text_hash", "row_id", "line_no", "key", "key2", "halves"])
    pa.default_memory_pool().release_unused()  # workers live on


def keyed_lines(docs: DataFrame) -> DataFrame:
    """A row for each line: place (its order in the corpus), key and key2 (of its words; null for blank lines), halves (hashes:
    of n and n + 1 words, first and last half; null for short lines)."""
    d = docs.select("doc_id", text_hash().alias("text_hash"), F.monotonically_increasing_id().alias("row_id"), "text")
    schema = StructType([*d.drop("text").schema, *StructType.fromDDL("line_no int, key long, key2 long, halves array<long>")])
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row_id", "line_no")
    return d.mapInArrow(keyer, schema).select(place.alias("place"), "key", "key2", "halves")


VARIANTS = "rank long, h long, at int"


def variants(batches):
    """The hash of each line with an inserted word elsewhere (`longer`; at -1), and those of the line without word `at`: of
    the last half for lines that share their first, of the first half for those that share their last."""
    base = np.uint64(BASE)
    for b in batches:
        rows, hs, ats = [], [], []
        for i, (line, first, last, longer) in enumerate(zip(*(b[c].to_pylist() for c in ("line", "first", "last", "longer")), strict=True)):
            w = textops.mixed(word_hashes(line.encode().split())[:, 0])
            n = len(w)
            power = np.ones(n + 1, np.uint64)
            power[1:] = np.cumprod(np.full(n, base, np.uint64))
            # value of words i to j: sum of w[k] * base^(k - i); deletion of word i shifts what follows by one place
            head = np.concatenate(([np.uint64(0)], np.cumsum(w * power[:n])))
            down = np.concatenate(([np.uint64(0)], np.cumsum(w[1:] * power[: n - 1])))
            middle = (n - 1) // 2
            at = np.arange(0 if last else middle if first else n, n if first else middle + 1 if last else n)
            less = head[at] + (down[n - 1] - down[at]) + np.uint64(n - 1)
            if longer:
                less, at = np.append(less, head[n] + np.uint64(n)), np.append(at, -1)
            hs.append(textops.mixed(less))
            ats.append(at)
            rows.append(np.full(len(at), i))
        rows = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        h = np.concatenate(hs).view(np.int64) if hs else np.zeros(0, np.int64)
        yield pa.record_batch([b["rank"].take(rows), pa.array(h), pa.array(np.concatenate(ats) if ats else np.zeros(0, np.int64), pa.int32())], ["rank", "h", "at"])


def within_one(a: Column, b: Column) -> Column:
    """Edit distance of at most 1 between word arrays: what is left after the common first and last words is one word or none."""
    na, nb = F.size(a), F.size(b)
    m = F.least(na, nb)
    differ = F.array_position(F.zip_with(F.slice(a, 1, m), F.slice(b, 1, m), lambda x, y: x == y), F.lit(False)).cast("int")
    at = F.when(differ > 0, differ - 1).otherwise(m)  # common first words
    rest_a = F.slice(a, at + 1 + (na >= nb).cast("int"), na)
    rest_b = F.slice(b, at + 1 + (nb >= na).cast("int"), nb)
    return (F.abs(na - nb) <= 1) & (F.greatest(na, nb) >= MIN_WORDS) & (rest_a == rest_b)


def ranked_lines(docs: DataFrame, candidates: DataFrame, flags: list[str]) -> DataFrame:
    """key, key2, rank (in the corpus' order), flags, line (its words, joined by blanks) of distinct lines (key, key2, first)."""
    # the words of candidates come from their documents; of repeated rows any has them
    wanted = candidates.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct("key", "key2", "first", *flags)).alias("wanted"))
    t = docs.select("doc_id", "text", text_hash().alias("text_hash")).alias("t")
    on = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.text_hash") == F.col("w.text_hash"))
    text = t.join(wanted.alias("w"), on).select(F.split("t.text", "\n").alias("lines"), "w.wanted")
    at = lambda x: F.when(x["first"]["line_no"] < F.size("lines"), F.get("lines", x["first"]["line_no"]))
    text = text.select(F.explode(F.transform("wanted", lambda x: F.struct(*[x[c].alias(c) for c in ("key", "key2", "first", *flags)], at(x).alias("line")))).alias("x"))
    text = text.select("x.key", "x.key2", "x.first", *[f"x.{c}" for c in flags], joined(line_words(F.col("x.line"))).alias("line"))
    text = text.groupBy("key", "key2").agg(F.first("first").alias("first"), F.first("line").alias("line"), *[F.first(c).alias(c) for c in flags])
    # candidates are ranked by their place, so that their many variants carry one number
    return cut(ordered_offsets(text, [F.asc("first"), F.asc("key"), F.asc("key2")], {}, "ranked-lines").select("key", "key2", F.col("row_no").alias("rank"), *flags, "line"), "candidate-lines")


def allowed(words: int, bounds: tuple[tuple[int, int], ...]) -> int:
    """The edits that count as near for lines of which the longer has so many words."""
    return max([edits for least, edits in bounds if words >= least], default=0)


def deletions(words: list[bytes], bounds: tuple[tuple[int, int], ...], block: int = 1 << 16) -> Iterator[tuple[np.ndarray, int, int]]:
    """(hashes, replaced, taken): of the variants of a line without some of its words, where `replaced` of them count as replaced
    (their places in the variant are in the hash) and the others as taken out. Only those that a line within the bound may have."""
    n, most = len(words), max((edits for _, edits in bounds), default=0)
    w, base = textops.mixed(word_hashes(words)[:, 0]), np.uint64(BASE)
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    # of words that stand behind s words that are gone: sums of their hashes at their places in the variant
    sums = [np.concatenate((np.zeros(min(s, n) + 1, np.uint64), np.cumsum(w[s:] * power[: max(n - s, 0)]))) for s in range(most + 1)]
    for gone in range(min(n, most) + 1):
        # with b words taken out of the other line, that is n - taken + b words long
        fits = [r for r in range(gone + 1) if any(gone + b <= allowed(max(n, n - gone + r + b), bounds) for b in range(most + 1))]
        every = combinations(range(n), gone) if fits else iter(())
        while part := list(islice(every, block)):
            at = np.array(part, np.int64).reshape(len(part), gone)
            ends, starts = np.column_stack((at, np.full(len(at), n))), np.column_stack((np.zeros(len(at), np.int64), at + 1))
            total = sum((sums[s][ends[:, s]] - sums[s][starts[:, s]] for s in range(gone + 1)), np.zeros(len(at), np.uint64))
            total = textops.mixed(total + np.uint64(n - gone))
            for r in fits:
                for which in combinations(range(gone), r):
                    h = total
                    for s in which:
                        h = textops.mixed(h * np.uint64(AGAIN) + (at[:, s] - s + 1).astype(np.uint64))
                    yield h.view(np.int64), r, gone - r


def all_variants(bounds: tuple[tuple[int, int], ...]):
    def emit(batches):
        for b in batches:
            for rank, line in zip(b["rank"].to_pylist(), b["line"].to_pylist(), strict=True):
                words = line.encode().split()
                for h, replaced, taken in deletions(words, bounds):
                    h = np.unique(h)
                    yield pa.record_batch([pa.array(np.full(len(h), rank)), pa.array(h), *(pa.array(np.full(len(h), x, np.int32)) for x in (replaced, taken, len(words)))], ["rank", "h", "replaced", "taken", "n"])

    return emit


def edits_apart(a: list[str], b: list[str], most: int) -> bool:
    """Whether so many words inserted, deleted or replaced at most make a and b equal: rows of the table within the band."""
    if abs(len(a) - len(b)) > most:
        return False
    far = most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            now[j] = i if j == 0 else min(row.get(j, far) + 1, now.get(j - 1, far) + 1, row.get(j - 1, far) + (x != b[j - 1]))
        row = now
    return row.get(len(b), far) <= most


def verified(bounds: tuple[tuple[int, int], ...]):
    def check(batches):
        for b in batches:
            pairs = [(x.split(), y.split()) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
            yield b.select(["key", "key2"]).filter(pa.array([edits_apart(x, y, allowed(max(len(x), len(y)), bounds)) for x, y in pairs], pa.bool_()))

    return check


def near_within(docs: DataFrame, bounds: tuple[tuple[int, int], ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As near_lines(), for any bounds."""
    every = cut(keyed_lines(docs), "all-lines")
    d = cut(every.where("key is not null").groupBy("key", "key2").agg(F.min("place").alias("first")), "lines")
    text = ranked_lines(docs, d, [])
    v = cut(text.select("rank", "line").mapInArrow(all_variants(bounds), "rank long, h long, replaced int, taken int, n int"), "variants")
    # of each key, the earliest line of those without so many words: one row, whatever the group's size
    most = max((edits for _, edits in bounds), default=0)
    heads = v.groupBy("h", "replaced").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), *[F.min(F.when(F.col("taken") == t, F.col("rank"))).alias(f"first_{t}") for t in range(most + 1)]).where("low != high").drop("low", "high")
    longer = lambda t: F.greatest(F.col("n"), F.col("n") - F.col("taken") + t)
    edits = lambda n: F.greatest(F.lit(0), F.lit(0), *[F.when(n >= least, e).otherwise(0) for least, e in bounds])
    near = [F.when(F.col("replaced") + F.col("taken") + t <= edits(longer(t)), F.col(f"first_{t}")) for t in range(most + 1)]
    pairs = v.join(heads, ["h", "replaced"]).select("rank", F.least(*near, F.lit((1 << 63) - 1)).alias("earlier")).groupBy("rank").agg(F.min("earlier").alias("earlier")).where("earlier < rank")
    mine, others = text.select("key", "key2", "rank", F.col("line").alias("x")), text.select(F.col("rank").alias("earlier"), F.col("line").alias("y"))
    found = pairs.join(mine, "rank").join(others, "earlier").select("key", "key2", "x", "y")
    return every, d, cut(found.mapInArrow(verified(bounds), "key long, key2 long"), "near-lines")


def near_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All lines (place, key, key2), distinct lines (and their first place), and the keys of those with an earlier near line."""
    every = cut(keyed_lines(docs), "all-lines")
    d = cut(every.where("key is not null").groupBy("key", "key2").agg(F.min("place").alias("first"), F.first("halves").alias("halves")), "lines")
    halves = d.where("halves is not null").select("key", F.posexplode("halves").alias("which", "half"))
    shared = halves.groupBy("half").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a != b").select("half")
    # of the halves as of its own length, which are shared, and whether one is as of a length more
    which = [F.max(F.col("which") == 0).alias("same_first"), F.max(F.col("which") == 1).alias("same_last"), F.max(F.col("which") > 1).alias("longer")]
    candidates = halves.join(shared, "half", "left_semi").groupBy("key").agg(*which).join(d.select("key", "key2", "first"), "key")
    flags = ["same_first", "same_last", "longer"]
    text = ranked_lines(docs, candidates, flags)
    v = text.select("rank", F.col("same_first").alias("first"), F.col("same_last").alias("last"), "longer", "line")
    v = cut(v.mapInArrow(variants, VARIANTS), "variants")
    same_place = v.where("at >= 0").groupBy("h", "at").agg(F.min("rank").alias("earlier"), F.max("rank").alias("last")).where("earlier != last").select("h", "at", "earlier")
    pairs = v.where("at >= 0").join(same_place, ["h", "at"]).select("rank", "earlier").where("rank > earlier")
    # a line without a word has the hash of one other line at most; of the lines that are a word longer, the earliest counts
    grown = cut(v.where("at >= 0").select("h", "rank").join(v.where("at < 0").select("h", F.col("rank").alias("whole")), "h").select("rank", "whole"), "grown-lines")
    pairs = pairs.unionByName(grown.where("rank > whole").select("rank", F.col("whole").alias("earlier")))
    pairs = pairs.unionByName(grown.groupBy("whole").agg(F.min("rank").alias("earlier")).where("whole > earlier").select(F.col("whole").alias("rank"), "earlier"))
    pairs = pairs.distinct()
    mine, others = text.select("key", "key2", "rank", F.split("line", " ").alias("x")), text.select(F.col("rank").alias("earlier"), F.split("line", " ").alias("y"))
    pairs = pairs.join(mine, "rank").join(others, "earlier").where(within_one(F.col("x"), F.col("y")))
    return every, d, cut(pairs.select("key", "key2").distinct(), "near-lines")


def dedup_lines(docs: DataFrame, bounds: tuple[tuple[int, int], ...] = BOUNDS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_repeated (an equal line is earlier), n_near (only a near one is), dropped (line numbers)."""
    every, d, near = near_lines(docs) if tuple(bounds) == BOUNDS else near_within(docs, tuple(bounds))
    known = cut(d.join(near.select("key", "key2", F.lit(True).alias("near")), ["key", "key2"], "left").select("key", "key2", "first", F.coalesce("near", F.lit(False)).alias("near")), "known-lines")
    t = every.where("key is not null").select("place", "key", "key2").join(known, ["key", "key2"]).select("place", (F.col("place") > F.col("first")).alias("repeated"), "near")
    t = t.unionByName(every.where("key is null").select("place", F.lit(False).alias("repeated"), F.lit(False).alias("near")))  # blank lines join nothing
    drop = F.when(F.col("repeated") | F.col("near"), F.col("place.line_no"))
    out = t.groupBy("place.doc_id", "place.text_hash", "place.row_id").agg(F.count("*").alias("n_lines"), F.count_if("repeated").alias("n_repeated"), F.count_if(F.col("near") & ~F.col("repeated")).alias("n_near"), F.sort_array(F.collect_list(drop)).alias("dropped"))
    return out.drop("row_id")


def without_lines(docs: DataFrame, bounds: tuple[tuple[int, int], ...] = BOUNDS) -> DataFrame:
    """The documents with their dropped lines taken out of the text (of repeated rows, one keeps what is not dropped)."""
    drop = dedup_lines(docs, bounds).select("doc_id", "text_hash", "dropped")
    drop = drop.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.size("dropped"))))
    d = docs.withColumns({"tallyloom_id": F.col("doc_id"), "tallyloom_hash": text_hash()})
    d = d.withColumn("tallyloom_nth", F.row_number().over(Window.partitionBy("tallyloom_id", "tallyloom_hash").orderBy("tallyloom_hash")))
    on = F.col("tallyloom_id").eqNullSafe(F.col("x.doc_id")) & (F.col("tallyloom_hash") == F.col("x.text_hash")) & (F.col("tallyloom_nth") == F.col("x.nth"))
    kept = F.filter(F.split(F.col("d.text"), "\n"), lambda line, i: ~F.array_contains(F.col("x.dropped"), i))
    return d.alias("d").join(drop.alias("x"), on, "left").select(*[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).drop("text_hash")
