"""A run over notes as a stream of batches: resumed from its checkpoint, each note written once, stopped by its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LEDGER = "batch_id long, n long, cost double"


class BudgetReached(RuntimeError):
    """The run has spent its budget; what is left is done by a start with a larger one."""


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """What each batch has done and spent."""
    return spark.read.schema(LEDGER).json(f"{out}/ledger/*") if _exists(spark, f"{out}/ledger") else spark.createDataFrame([], LEDGER)


def spent(spark: SparkSession, out: str, before: int) -> float:
    return ledger(spark, out).where(F.col("batch_id") < before).agg(F.sum("cost")).first()[0] or 0.0


def records(spark: SparkSession, out: str) -> DataFrame:
    """All records of a run."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/records")


def notes(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The notes' own files: a folder `note=<id>` each."""
    return spark.read.schema(schema).json(f"{out}/notes")


def start(notes_: DataFrame, extract, out: str, checkpoint: str, budget: float | None = None, note_files: bool = True, before_commit=None) -> StreamingQuery:
    """Works off a stream of notes, batch by batch, until no more are there.

    extract: notes -> records with the columns note and cost. A batch replaces what an earlier try of the same batch has
    written (its records, its notes' files, its line of the ledger), and counts as done when Spark has checkpointed it: a run
    that ends anywhere and is started again leaves each record once. A batch is begun only while less than the budget is
    spent; beyond it the query fails with BudgetReached. before_commit is called with a batch's number once it is written.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if budget is not None and (so_far := spent(spark, out, batch_id)) >= budget:
            raise BudgetReached(f"{so_far} of {budget} spent before batch {batch_id}")
        path = f"{out}/records/batch-{batch_id}"
        extract(batch).write.mode("overwrite").parquet(path)
        done = spark.read.parquet(path)
        if note_files:
            done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("note").json(f"{out}/notes")
        line = done.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).cast("double").alias("cost"))
        line.coalesce(1).write.mode("overwrite").json(f"{out}/ledger/batch-{batch_id}")
        if before_commit:
            before_commit(batch_id)

    return notes_.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
