"""Sinks: feature and payload tables, splits with manifests, appended runs, claims."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import claims
from ..operators.longform import first_of


def features(df: DataFrame, path: str, key: str = "hadm_id", lists: tuple[str, ...] = ("admission_reason_tags",)) -> None:
    """One row a document (the first by content), empty lists for missing ones, sorted within files."""
    for c in lists:
        df = df.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    t = first_of(df, key, [F.asc(F.to_json(F.struct(*df.columns)))])
    t.repartitionByRange(key).sortWithinPartitions(key).write.option("compression", "snappy").parquet(path)


def payloads(df: DataFrame, path: str, nested: tuple[str, ...] = ("features_json",), rows: int = 5000) -> None:
    """Nested columns as JSON text, at most so many rows a file."""
    for c in nested:
        df = df.withColumn(c, F.to_json(c))
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def split(df: DataFrame, path: str, stratum: str, quotas: dict[str, int], revision: str = "") -> DataFrame:
    """A split as CSV (never overwritten), and its manifest beside it (path.manifest): rows, quotas, counts by stratum,
    fingerprint, revision of the code."""
    df.write.mode("error").option("header", True).csv(path)
    counts = {r[stratum]: r["count"] for r in df.groupBy(stratum).count().collect()}  # a row for each stratum
    manifest = claims.table_receipt(df).withColumns({"quotas": F.lit(json.dumps(quotas, sort_keys=True)), "counts": F.lit(json.dumps(counts, sort_keys=True)), "revision": F.lit(revision)})
    manifest.coalesce(1).write.mode("error").json(f"{path}.manifest")
    return manifest


def append_run(df: DataFrame, path: str, key: str = "hadm_id") -> None:
    """Append results as JSON lines; documents that are there already are left out, so a rerun adds nothing twice."""
    spark = df.sparkSession
    try:
        done = spark.read.json(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = df.select(key).limit(0)
    df.join(done.distinct(), key, "left_anti").write.mode("append").json(path)
