from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import token_shards

from . import brute


def test_pipeline_equals_brute_force(spark, sf):
    """Survivors of the first three stages exactly; each survivor's copies are whole texts, and the sources keep their targets."""
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = {r.doc_id: r for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    near = brute.near([(i, r.text) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if near[i][1] == i}
    hit = brute.decontaminate([(i, r.text) for i, r in rows.items()], items.select("item_id", "text").collect())
    rows = {i: r for i, r in rows.items() if not hit[i][4]}
    goal = brute.mixing([(i, r.text, r.source) for i, r in rows.items()])

    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    tok, first, pieces = token_shards.Tokenizer(token_shards.default_model()), Counter(), {}
    for r in out:
        first[r.doc_id] += r.seq_no == 0
        pieces.setdefault(r.doc_id, {})[r.seq_no] = r.tokens
    assert set(first) <= set(rows) and max(first.values()) <= 3
    for i, p in pieces.items():
        assert tok.decode(np.frombuffer(b"".join(p[k] for k in sorted(p)), "<u2").tolist()) == rows[i].text
    taken, target, longest = Counter(), {}, Counter()
    for i, r in rows.items():
        taken[r.source] += first[i] * goal[i][0]
        target[r.source] = goal[i][2]
        longest[r.source] = max(longest[r.source], goal[i][0])
    assert all(abs(taken[s] - target[s]) <= longest[s] + 80 for s in target)


def test_stages_return_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.columns == docs.columns and empty.count() == 0


def test_stages_take_any_columns_and_rows(spark, sf):
    """Nulls, blank and repeated rows, and columns whose names clash with internal ones or need quotes."""
    base = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    rows = [(None, "one two three", "en", "a", 3), (10**6, None, "en", None, 0), (10**6 + 1, " \n", None, "a", 2), (10**6 + 2, "uno dos tres", "es", "b", 12), (10**6 + 2, "uno dos tres", "es", "b", 12)]
    docs = base.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for c in ("my col", "a.b", "block", "row", "copies", "key", "words", "t", "d"):
        docs = docs.withColumn(c, F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        if name != "tokens":
            assert got.columns == docs.columns and got.count() <= docs.count() * 3
            assert got.where("text is null").count() == (0 if name in ("language", "mixture") else 1)
        else:
            assert got.count() >= docs.count()
