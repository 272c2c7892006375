"""Shared helpers: intermediate tables in the shared folder, two-level prefix sums, row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of the characters that separate words; the letters A to Z and their lower-case forms.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a session on one machine makes
    one of its own and sets it; on a cluster that is an error, as executors wouldn't see such a folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tallyloom/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what has been written to path when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors don't matter.

    The table is deleted when the application ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tallyloom_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that cut() has made, once what was read from them has been written down itself."""
    for df in tables:
        if path := getattr(df, "__dict__", {}).pop("tallyloom_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any longer removed now: Spark does so when the driver's garbage
    is collected, which on a large heap may be long after they are of use.

    Events of a plan that has just ended may still be on their way and hold it; the next call removes its files. Call this
    once a phase, as what a call finds in use is old to the collector and stays until another one.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash() -> Column:
    return F.xxhash64(F.lit("text"), F.col("text"))


def ordered_offsets(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Number all rows in one global order and sum columns over the rows before each, without one task seeing all rows.

    Rows are range-partitioned by `order` (which should be unique up to interchangeable rows), the partition is
    written down, and what the partitions hold is summed: one row each, so the offsets have as many rows as there are
    partitions. Adds `row_no` (from 0) and, for each item of sums, the sum of that column over all earlier rows.
    """
    spark = df.sparkSession
    t = cut(df.repartitionByRange(parts(spark), *order).withColumn("range_id", F.spark_partition_id()), name)
    totals = t.groupBy("range_id").agg(F.count("*").alias("all_rows"), *[F.sum(v).alias(f"all_{k}") for k, v in sums.items()])
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_id", *[F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"all_{k}") for k in ("rows", *sums)])
    inner = Window.partitionBy("range_id").orderBy(*order)
    prior = inner.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select("*", (F.row_number().over(inner) - 1).alias("row_no"), *[F.coalesce(F.sum(v).over(prior), F.lit(0)).alias(k) for k, v in sums.items()])
    return t.join(F.broadcast(totals), "range_id").select(  # as many rows as partitions
        *[c for c in t.columns if c not in ("range_id", "row_no", *sums)],
        (F.col("row_no") + F.col("all_rows")).cast("long").alias("row_no"),
        *[(F.col(k) + F.col(f"all_{k}")).alias(k) for k in sums],
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def same(a: str, b: str, *columns: str) -> Column:
    """Null-safe equality of columns of two aliased frames."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out
