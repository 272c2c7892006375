"""Running totals, positions and moving windows over runs of any length: no task holds a whole run.

Rows are range-partitioned by run and order, so a long run is spread over many ranges. What a range holds of each run is
summed up; those sums are added up over the ranges before (a row for each run and range), and the rows of a range start from
there. A moving window is computed over blocks of positions, each with the rows before it that the window reaches into.

Runs may have null keys. `order` should be unique in a run; ties are ordered arbitrarily.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written

RANGE, POSITION = "tallyloom_range", "tallyloom_position"


def same_keys(left: str, right: str, keys: list[str]) -> Column:
    return reduce(and_, (F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys), F.lit(True))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], count: str = "n_calls") -> DataFrame:
    """df with running sums of columns (sums: new name -> column) and a running count, each row included, by run."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = written(df.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")
    totals = t.groupBy(*keys, RANGE).agg(F.count("*").alias("n_before"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"before_{k}") for k, c in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, RANGE, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals.columns if c not in (*keys, RANGE)])
    inside = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumns({count: F.count("*").over(inside)} | {k: F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()})
    j = t.alias("t").join(totals.alias("p"), same_keys("t", "p", keys) & (F.col(f"t.{RANGE}") == F.col(f"p.{RANGE}")))
    return j.select(*[F.col(f"t.`{c}`") for c in df.columns], *[(F.col(f"t.`{k}`") + F.col(f"p.before_{k}")).alias(k) for k in sums], (F.col(f"t.`{count}`") + F.col("p.n_before")).alias(count))


def moving(df: DataFrame, keys: list[str], order: list[str], rows: int, values: dict[str, Column], block: int = 1 << 14) -> DataFrame:
    """df with aggregates (values: new name -> an aggregate such as F.sum("x")) over each row and the rows - 1 before it in its
    run. A block of positions is at least as long as the window, so a row is in two blocks at most."""
    size = max(block, rows)
    t = running(df, keys, order, {}, POSITION)
    at = F.floor((F.col(POSITION) - 1) / size)
    # the last rows of a block also go before the next one
    t = t.withColumn(RANGE, F.explode(F.when((F.col(POSITION) - 1) % size > size - rows, F.array(at, at + 1)).otherwise(F.array(at))))
    w = Window.partitionBy(*keys, RANGE).orderBy(POSITION).rowsBetween(1 - rows, 0)
    t = t.withColumns({k: v.over(w) for k, v in values.items()})
    return t.where(F.col(RANGE) == at).drop(RANGE, POSITION)


def every_nth(df: DataFrame, keys: list[str], order: list[str], points: int) -> DataFrame:
    """About so many rows of each run: every n-th one and the last."""
    t = running(df, keys, order, {}, POSITION)
    n = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    j = t.alias("t").join(n.alias("n"), same_keys("t", "n", keys))
    step = F.greatest(F.ceil(F.col("n_rows") / points), F.lit(1))
    return j.where(((F.col(POSITION) - 1) % step == 0) | (F.col(POSITION) == F.col("n_rows"))).select(*[F.col(f"t.`{c}`") for c in df.columns])
