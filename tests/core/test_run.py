"""A run as a stream: interrupted between two batches, within one, and by its budget."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyloom.plans import catalog, more
from tallyloom.streaming import run


def notes(spark, path):
    return spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(path)


def extract(batch):
    return batch.select(F.col("id").alias("note"), F.length("text").alias("n"), F.lit(0.5).alias("cost"))


@pytest.fixture
def table(spark, tmp_path):
    spark.range(20).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).repartition(4, "id").write.parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_resumed_after_a_crash(spark, table, tmp_path):
    out, checkpoint, tries = str(tmp_path / "out"), str(tmp_path / "ck"), []

    def crash(batch_id):
        tries.append(batch_id)
        if batch_id == 1 and tries.count(1) == 1:
            raise RuntimeError("killed after writing, before the checkpoint")

    with pytest.raises(StreamingQueryException):
        run.start(notes(spark, table), extract, out, checkpoint, before_commit=crash).awaitTermination()
    assert run.records(spark, out).count() < 20
    run.start(notes(spark, table), extract, out, checkpoint, before_commit=crash).awaitTermination()
    assert tries[:2] == [0, 1] and tries.count(0) == 1 and tries.count(1) == 2
    assert sorted((r.note, r.n) for r in run.records(spark, out).collect()) == [(i, i) for i in range(20)]
    own = run.notes(spark, out, "n long, cost double, note long").collect()
    assert sorted((r.note, r.n) for r in own) == [(i, i) for i in range(20)]
    assert run.ledger(spark, out).agg(F.sum("n")).first()[0] == 20
    run.start(notes(spark, table), extract, out, checkpoint).awaitTermination()  # nothing left
    assert run.records(spark, out).count() == 20


def test_budget(spark, table, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")
    with pytest.raises(StreamingQueryException, match="BudgetReached"):
        run.start(notes(spark, table), extract, out, checkpoint, budget=2.0, note_files=False).awaitTermination()
    first = run.records(spark, out).count()
    assert 4 <= first < 20
    run.start(notes(spark, table), extract, out, checkpoint, budget=100.0, note_files=False).awaitTermination()
    assert run.records(spark, out).count() == 20 and run.spent(spark, out, 1000) == 10.0


def test_files_of_notes_grow_with_the_input(spark, sf, tmp_path, monkeypatch):
    paths = {n: str(tmp_path / n) for n in ("notes", "run", "checkpoint")}
    monkeypatch.setattr(more, "scratch", lambda spark, name: paths[name])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        want = spark.read.parquet(f"{sf}/documents.parquet")
        n = want.rdd.getNumPartitions()
        got = catalog.QUERIES["checkpointed_run"](spark, sf)
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = spark.read.parquet(paths["notes"]).inputFiles()
    assert n > 3 and len(files) > 2 * n  # there were three, whatever the input
    assert run.ledger(spark, paths["run"]).count() == 3  # and they still make three batches
