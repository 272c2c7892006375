"""A registry of published quantities with receipts of what they were computed from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, value double, description string, format string, receipt string"


def receipt(script: bytes, inputs: dict[str, bytes]) -> str:
    """Hash over a script and its inputs in the order of their names."""
    h = hashlib.sha256(hashlib.sha256(script).hexdigest().encode())
    for name in sorted(inputs):
        h.update(f"{name}:{hashlib.sha256(inputs[name]).hexdigest()}".encode())
    return h.hexdigest()


def table_receipt(df: DataFrame) -> DataFrame:
    """An order-free fingerprint of a table: row count and the sum of row hashes."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")
    return df.select(part.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("sum"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """New claims replace old ones of the same key."""
    return old.join(new.select("key").distinct(), "key", "left_anti").unionByName(new)


def verify(stored: DataFrame, recomputed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    a, b = stored.select("key", F.col("value").alias("stored"), F.col("receipt").alias("r1")), recomputed.select("key", F.col("value").alias("now"), F.col("receipt").alias("r2"))
    t = a.join(b, "key", "full_outer")
    same = (F.abs(F.col("stored") - F.col("now")) <= tolerance) & F.col("r1").eqNullSafe(F.col("r2"))
    return t.select("key", "stored", "now", F.when(F.col("stored").isNull(), "new").when(F.col("now").isNull(), "missing").when(same, "match").otherwise("mismatch").alias("status"))


def fill(template: str, values: dict[str, tuple[float, str]]) -> tuple[str, list[str]]:
    """{{key}} and {{key:format}} replaced by values; undefined keys are marked and listed."""
    missing: list[str] = []

    def one(m: re.Match) -> str:
        key, spec = m[1], m[2]
        if key not in values:
            missing.append(key)
            return f"[undefined {key}]"
        value, default = values[key]
        return format(value, spec or default)

    return re.sub(r"\{\{\s*([\w.]+)(?::([^}]+))?\s*\}\}", one, template), missing


# ---------------------------------------------------------------- claims that follow their inputs
def file_prints(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, print) of a Parquet table: a file's print is the xor of its rows' hashes, so prints of files add up to
    that of a table, whatever the order of rows and files."""
    t = spark.read.parquet(path)
    name = F.col("_metadata.file_path")
    return t.select(name.alias("file"), F.xxhash64(*[F.col(f"`{c}`") for c in sorted(t.columns)]).alias("h")).groupBy("file").agg(F.count("*").alias("rows"), F.bit_xor("h").alias("print"))


def table_print(spark: SparkSession, path: str) -> str:
    """Rows and print of a table, added up over its files."""
    r = file_prints(spark, path).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.bit_xor("print"), F.lit(0)).alias("print")).first()
    return f"{r['rows']}:{r['print'] & (1 << 64) - 1:016x}"


class Claims:
    """Quantities by key, each with the tables it is computed from."""

    def __init__(self):
        self.all: dict[str, tuple[tuple[str, ...], str, str, str, Callable]] = {}

    def register(self, key: str, tables: Iterable[str], description: str = "", format_: str = ".2f", version: str = "1"):
        """A decorator for a function of the tables (DataFrames, in this order) that returns a frame of one value. A claim is
        computed anew when a table or its version has changed; a key that is there already is refused."""

        def add(compute: Callable):
            if key in self.all:
                raise ValueError(f"a claim with the key {key!r} is registered already")
            self.all[key] = (tuple(tables), description, format_, version, compute)
            return compute

        return add

    def receipts(self, prints: dict[str, str]) -> dict[str, str]:
        """What each claim is computed from: its version and its tables' prints."""
        return {k: receipt(f"{k}:{version}".encode(), {t: prints[t].encode() for t in tables}) for k, (tables, _, _, version, _) in self.all.items()}

    def recompute(self, spark: SparkSession, paths: dict[str, str], stored: DataFrame | None = None) -> DataFrame:
        """The claims as SCHEMA with a status: `kept` from stored (as SCHEMA), where the receipt is the same and there is a value, else `computed`;
        `failed`, with a null value, where computing raised an error (the other claims go on). Only tables of registered
        claims are read for their prints, and only those of changed claims for values; a row for each claim is gathered."""
        prints = {t: table_print(spark, paths[t]) for t in sorted({t for tables, *_ in self.all.values() for t in tables})}
        old = {r["key"]: r for r in stored.collect()} if stored is not None else {}
        rows, frames = [], {}
        for key, now in self.receipts(prints).items():
            tables, description, format_, _, compute = self.all[key]
            if key in old and old[key]["receipt"] == now and old[key]["value"] is not None:
                rows.append((key, old[key]["value"], description, format_, now, "kept"))
                continue
            try:
                inputs = [frames.setdefault(t, spark.read.parquet(paths[t])) for t in tables]
                value, status = compute(*inputs).first()[0], "computed"
            except Exception as e:  # one claim's error is reported, not raised
                value, status = None, f"failed: {type(e).__name__}"
            rows.append((key, None if value is None else float(value), description, format_, now, status))
        return spark.createDataFrame(rows, f"{SCHEMA}, status string")
