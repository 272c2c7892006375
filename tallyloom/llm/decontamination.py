"""Benchmark decontamination: a prefix-filtered set join (DataFrame functions only).

Every benchmark window (10 consecutive item words; a shorter item is one window) is a set of shingles of up to 3 words.
Shingles are ordered by rarity in the documents. A document that contains a window contains all of its shingles, so the
necessary prefix is the rarest one alone; documents' shingles join it. Length and positional bounds place the window in
the document (it must start at or after the first word and end at or before the last), and the window's words are then
compared with the document's, one by one, over a stretch of the window's own size.

Documents are read as short stretches of words with as much context as a window may need, so a candidate is verified
where it is found. The windows are broadcast up to BROADCAST_WINDOWS of them with BROADCAST_BYTES of words and ids; beyond that the join shuffles shingles
without their context and fetches the stretch of each candidate afterwards.

Defined results: null and empty texts have no words and are clean; repeated rows and null ids are documents of their own;
an empty benchmark leaves everything clean; equal windows of several items count for each; the words of an item without an id are hit, but it can't be listed; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, documents, text_hash

NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW, SHINGLE, STRETCH = 10, 3, 32
#: Windows and the bytes of their words and item ids up to which they are broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def shingles_of(w: Column, positions: Column, k: int) -> Column:
    """(p, h): the hash of the k words from each of the positions."""
    return F.transform(positions, lambda p: F.struct(p.cast("int").alias("p"), F.xxhash64(F.lit(k), *[F.get(w, (p + i).cast("int")) for i in range(k)]).alias("h")))


def numbers(lo: Column, hi: Column) -> Column:
    """lo to hi, none if hi is below lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """Distinct windows: words (array), k (words of its shingles), items (ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    w = w.where("n > 0").select("item", "w", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - length, F.lit(0)))).alias("at"))
    w = w.select("item", F.slice("w", F.col("at") + 1, F.least(F.col("n"), F.lit(length))).alias("words"))
    return w.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("k", F.least(F.size("words"), F.lit(SHINGLE)))


def window_shingles(w: DataFrame, ks: list[int]) -> DataFrame:
    at = F.lit(None).cast("array<struct<p:int,h:bigint>>")
    for k in ks:
        at = F.when(F.col("k") == k, shingles_of(F.col("words"), numbers(F.lit(0), F.size("words") - k), k)).otherwise(at)
    return w.select("*", F.explode(at).alias("x")).select(*w.columns, F.col("x.p").alias("offset"), "x.h")


def stretches(docs: DataFrame, ks: list[int], length: int = WINDOW) -> DataFrame:
    """Rows of STRETCH words: row_id, doc_id, text_hash, n_words, base (first word of context), context, shingles (p, h)."""
    d = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", text_hash().alias("text_hash"), words(F.col("text")).alias("w"))
    d = d.select("*", F.size("w").alias("n_words"))

    def shingles(s: Column) -> Column:
        out = [F.when(s == 0, F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("h")))).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))]
        for k in ks:
            out.append(shingles_of(F.col("w"), numbers(s, F.least(s + STRETCH - 1, F.col("n_words") - k)), k))
        return F.concat(*out)

    def stretch(s: Column) -> Column:
        base = F.greatest(s - length + 1, F.lit(0))
        return F.struct(base.alias("base"), F.array_join(F.slice(F.col("w"), base + 1, STRETCH + 2 * length), " ").alias("context"), shingles(s).alias("shingles"))

    many = F.transform(F.sequence(F.lit(0), F.greatest(F.col("n_words") - 1, F.lit(0)), F.lit(STRETCH)), stretch)
    d = d.select("row_id", "doc_id", "text_hash", "n_words", F.explode(many).alias("x"))
    return d.select("row_id", "doc_id", "text_hash", "n_words", "x.base", "x.context", "x.shingles")


def rarest(docs: DataFrame, w: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """Each window with its rarest shingle (ties: hash, then offset) as h, and its offset."""
    at = cut(window_shingles(w, ks), "window-shingles")
    keys = at.select("h").distinct()
    seen = docs.select(words(F.col("text")).alias("w")).select("w", F.size("w").alias("n"))
    some = F.concat(*[shingles_of(F.col("w"), numbers(F.lit(0), F.col("n") - k), k) for k in ks])
    seen = seen.select(F.explode(some["h"]).alias("h"))
    df = seen.join(F.broadcast(keys) if small else keys, "h", "left_semi").groupBy("h").agg(F.count("*").alias("df"))
    best = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("offset"))).alias("best")
    best = at.join(df, "h", "left").groupBy("words", "k").agg(best, F.first("items").alias("items"))
    return cut(best.select("words", "k", "items", F.col("best.h").alias("h"), F.col("best.offset").alias("offset"), F.col("best.df").alias("df")), "windows")


def occurrences(docs: DataFrame, items: DataFrame, length: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Each verified occurrence of a window (row_id, begin, size, items), and a row with begin null for each document."""
    w = cut(windows(items, length), "items")
    ks = [r.k for r in w.select("k").distinct().collect()] or [SHINGLE]
    size = w.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", ","))), F.lit(0)).alias("bytes")).first()
    small = size.n <= broadcast_windows and size.bytes <= BROADCAST_BYTES
    w = rarest(docs, w, sorted(ks), small)
    s = stretches(docs, sorted(ks), length)
    on = ["h"]
    if small:
        t = s.select("row_id", "doc_id", "text_hash", "n_words", "base", "context", F.explode("shingles").alias("x")).select("*", "x.p", "x.h").drop("x")
        t = t.join(F.broadcast(w), on, "left").where("p = -1 or words is not null")
    else:
        s = cut(s, "stretches")
        t = s.select("row_id", "doc_id", "text_hash", "n_words", "base", F.explode("shingles").alias("x")).select("*", "x.p", "x.h").drop("x")
        found = t.join(w, on).select("row_id", "base", "p", "words", "offset", "items")
        heads = t.where("p = -1").select("row_id", "doc_id", "text_hash", "n_words", F.lit(-1).alias("p"))
        t = s.drop("shingles").join(found, ["row_id", "base"]).unionByName(heads, allowMissingColumns=True)
    begin, size = F.col("p") - F.col("offset"), F.size("words")
    placed = (begin >= 0) & (begin + size <= F.col("n_words"))
    equal = F.slice(F.split("context", " "), F.greatest(begin - F.col("base") + 1, F.lit(1)), size) == F.col("words")
    t = t.where((F.col("p") == -1) | (placed & equal))
    head = F.col("p") == -1
    return t.select("row_id", "doc_id", "text_hash", "n_words", F.when(~head, begin).alias("begin"), F.when(~head, size).alias("size"), F.when(~head, F.col("items")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, length: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row for each document: words hit (a word inside several windows counts once) and the items found."""
    found = occurrences(docs, items, length, broadcast_windows)
    found = found.groupBy("row_id", "doc_id", "text_hash", "n_words").agg(F.sort_array(F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", "size")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        end = x["begin"] + x["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["begin"]))).alias("hit"))

    n_hit = F.aggregate("spans", start, add)["hit"]
    out = found.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("items_sha256"), F.col("ids").alias("item_ids"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Null and empty texts have no words and stay; repeated rows stay or go together; an empty table gives an empty result; all
    columns of docs are returned, whatever their names.
    """
    bad = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id", "text_hash").distinct()
    d = docs.withColumns({"tallyloom_id": F.col("doc_id"), "tallyloom_hash": text_hash()})
    on = F.col("tallyloom_id").eqNullSafe(F.col("b.doc_id")) & (F.col("tallyloom_hash") == F.col("b.text_hash"))
    return d.alias("d").join(bad.alias("b"), on, "left_anti").select(*[F.col(f"d.`{c}`") for c in docs.columns])


#: Words by the contract's pattern; windows and grams of equal words as joined strings, one join for all lengths.
OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
b2 AS (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p + 1 : p + 10], ' ') AS gram FROM b2),
sizes AS (SELECT DISTINCT n FROM win), d2 AS (SELECT row_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS p FROM d, sizes),
grams AS (SELECT row_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS gram FROM d2),
found AS (SELECT row_id, n, p, item FROM grams JOIN win USING (n, gram)),
hit AS (SELECT row_id, count(DISTINCT word) AS n_hit FROM (SELECT row_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY row_id),
ids AS (SELECT row_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM found GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN ids USING (row_id)
"""
