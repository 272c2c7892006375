import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, mixing, queries, sharding

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, p int"


def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, extra columns with clashing names."""
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, None, None), (3, "one two", "en", "a", 7, "x", 1), (3, "one two", "en", "a", 7, "x", 1), (None, "one two", None, "b", 7, "x", 1), (4, "w " * 30000, "en", "b", 60000, "x", 1), (5, " \t\n", "en", "é", 3, "x", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination_equals_brute_force(spark, sf, limit):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, items, broadcast_windows=limit).collect()}
    assert got == brute.decontaminate(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect())
    assert any(x[1] for x in got.values())


def test_decontamination_short_items_and_odd_rows(spark):
    items = spark.createDataFrame([(1, "Two"), (2, "one TWO"), (3, None), (4, "..."), (5, " ".join("w" * 12)), (6, "one two")], "item_id int, text string")
    docs = odd(spark)
    got = sorted(map(tuple, decontamination.decontaminate(docs, items).select("n_words", "n_hit", "n_items").collect()))
    assert got == sorted([(0, 0, 0), (0, 0, 0), (2, 2, 3), (2, 2, 3), (2, 2, 3), (30000, 30000, 1), (0, 0, 0)])
    assert decontamination.decontaminate(docs.limit(0), items).count() == 0
    assert not decontamination.decontaminate(docs, items.limit(0)).where("contaminated").count()


def test_decontamination_overlapping_hits(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([("a", " ".join(words[5:18])), ("b", " ".join(words[12:30])), ("c", "w39 w38")], "item_id string, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words[:14]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.decontaminate(docs, items).collect()}
    assert got == brute.decontaminate(docs.collect(), items.collect())


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.shard(docs, [1.0] * 40).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0] * 41).collect()}
    assert again == {r.doc_id: r.grown_shard for r in rows}


def test_sharding_weights_and_odd_rows(spark):
    n = Counter(r.shard for r in sharding.shard(spark.range(20000).selectExpr("id as doc_id", "'x' as text"), [1.0, 3.0]).select("shard").collect())
    assert 0.72 < n[1] / 20000 < 0.78
    got = sharding.shard(odd(spark), [1.0] * 3).collect()
    assert sorted((r.size, r.text_crc32 > 0) for r in got) == [(16, False), (16, False), (19, True), (23, True), (23, True), (23, True), (60016, True)]
    assert sharding.shard(odd(spark).limit(0), [1.0]).count() == 0


@pytest.mark.parametrize("which", ["table", "odd"])
def test_mixing(spark, sf, which):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if which == "table" else odd(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out, plan = mixing.mix(docs)
    rows = out.collect()
    expected = brute.mixing(docs.select("doc_id", "text", "source").collect())
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert (r.size, r.source_size) == expected[r.doc_id][:2] and r.target == pytest.approx(expected[r.doc_id][2])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(rows) == len(expected)
    assert all(abs(taken[s] - target[s]) <= max(80, 0.01 * target[s]) for s in target)
    slots = Counter(r.slot for r in plan.select("slot").collect())
    # sources below three blocks weigh as much as three
    assert not slots or max(slots) < sum(x[0] for x in expected.values()) / 16 + 3 * len(target) + 1
    assert {s: taken[s] for s in target} == {s: math.floor(t + 0.5) for s, t in target.items()}
    assert sorted(map(tuple, mixing.mix(docs)[0].collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize(("sources", "words"), [(3, 5), (60, 12), (60, 200), (1, 1), (4, 40)])
def test_mixing_of_small_sources(spark, sources, words):
    """What each document gives: the first words of its source's stream, repeated, up to the target."""
    rows = [(s * 100 + i, "w " * (words // 4 if i < 3 else words - 3 * (words // 4)), f"s{s:02}") for s in range(sources) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out, plan = mixing.mix(docs)
    got = {r.doc_id: r for r in out.collect()}
    expected = brute.mixing([(i, t, s) for i, t, s in rows])
    order = docs.select("doc_id", "source", F.xxhash64(F.lit(0), "doc_id", mixing.text_hash()).alias("h")).orderBy("source", "h", "doc_id").collect()
    for s in {r.source for r in order}:
        mine = [r.doc_id for r in order if r.source == s]
        goal, size, at = math.floor(expected[mine[0]][2] + 0.5), words, 0
        assert sum(got[i].taken for i in mine) == goal
        for i in mine:
            n = expected[i][0]
            assert got[i].taken == sum(max(0, min(goal, at + e * size + n) - min(goal, at + e * size)) for e in range(3))
            at += n
    pieces = plan.collect()
    assert sum(p.n_words for p in pieces) == sum(r.taken for r in got.values()) and all(p.n_words > 0 for p in pieces)
    by_slot = {}
    for p in pieces:
        by_slot.setdefault(p.slot, set()).add(p.doc_id // 100)
    assert all(len(x) == 1 for x in by_slot.values())


def test_mixing_nulls_repeats_and_nothing(spark):
    assert mixing.mix(odd(spark))[0].count() == 7
    assert mixing.mix(odd(spark).limit(0))[0].count() == 0
    out = mixing.mix_stage(spark, odd(spark), "")
    assert out.columns == odd(spark).columns
    assert out.where("text is null or trim(text) = ''").count() == 0


def test_decontaminate_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in decontamination.op2_decontamination(spark, sf).where("contaminated").collect()}
    kept = decontamination.decontaminate_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad


def spark_hash(seed, *values):
    """xxhash64 of Spark: the hash of each value is the seed of the next."""
    h = seed
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h


def test_sharding_equals_brute_force(spark, sf):
    """Each row's shard from the scores of all shards; slots are any numbering without gaps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op9_rendezvous_sharding(spark, sf).collect()}

    def best(key, shards):
        score = lambda i: -1.0 / math.log(((spark_hash(42, 0, key, i) >> 11) + 0.5) / 2**53)
        return max(range(shards), key=lambda i: (score(i), i))

    slots = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        x, data = got.pop(r.doc_id), (r.text or "").encode()
        assert (x.size, x.text_crc32, x.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (x.shard, x.grown_shard) == (best(str(r.doc_id), 40), best(str(r.doc_id), 41))
        slots[x.shard].append(x.slot)
    assert not got and all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted((df := queries.QUERIES[name](spark, sf)).columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want.fetchall())
