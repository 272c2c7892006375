"""The two long tables and ways into them: answers(doc_id, rater, field, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import domains

RATERS = ("A", "B", "C")


def unpivot(features: DataFrame, fields: list[str], ids: tuple[str, ...] = ("doc_id", "rater")) -> DataFrame:
    """Wide features -> one row for each field."""
    return features.select(*ids, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(*ids, "x.field", "x.value")


def unpivot_tags(features: DataFrame, tags: list[str], column: str = "tags", ids: tuple[str, ...] = ("doc_id", "rater")) -> DataFrame:
    """Tag lists -> one 0/1 answer for each tag of the vocabulary."""
    has = lambda t: F.coalesce(F.array_contains(column, t), F.lit(False)).cast("int").cast("string")
    return features.select(*ids, F.explode(F.array(*[F.struct(F.lit(t).alias("field"), has(t).alias("value")) for t in tags])).alias("x")).select(*ids, "x.field", "x.value")


def shared(answers: DataFrame, raters: int = 3, key: str = "doc_id") -> DataFrame:
    """Answers of documents that all raters have answered."""
    full = answers.groupBy(key).agg(F.count_distinct("rater").alias("n")).where(F.col("n") == raters).select(key)
    return answers.join(full, key, "left_semi")


def side_by_side(answers: DataFrame, raters: tuple[str, ...] = RATERS, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """One column for each rater, where all have answered; the raters are known, so no job looks for them, and no distinct count
    shuffles the answers twice. Answers of others don't count."""
    known = answers.where(F.col("rater").isin(*raters))
    by = [F.max(F.when(F.col("rater") == r, F.col("value"))).alias(r) for r in raters]
    here = [F.max(F.col("rater") == r).alias(f"has_{r}") for r in raters]
    w = known.groupBy(*keys).agg(*by, *here)
    return w.where(reduce(Column.__and__, [F.col(f"has_{r}") for r in raters])).drop(*[f"has_{r}" for r in raters])


def pairs(wide: DataFrame, raters: tuple[str, ...] = RATERS, keep: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """Unordered pairs of raters without a self join: pair, left, right."""
    some = [F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(a).alias("left"), F.col(b).alias("right")) for i, a in enumerate(raters) for b in raters[i + 1 :]]
    return wide.select(*keep, F.explode(F.array(*some)).alias("x")).select(*keep, "x.pair", "x.left", "x.right")


def on_off(on: DataFrame, off: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """Two runs over the same documents, suffixed."""
    keys = [key] if isinstance(key, str) else key
    a = on.select(*keys, *[F.col(c).alias(f"{c}_on") for c in columns])
    return a.join(off.select(*keys, *[F.col(c).alias(f"{c}_off") for c in columns]), keys)


def unpivot_features(features: DataFrame, tags: tuple[str, ...] = domains.TAGS, enums: tuple[str, ...] = tuple(domains.ENUMS), tristates: tuple[str, ...] = domains.TRISTATE_FIELDS, ids: tuple[str, ...] = ("doc_id", "rater")) -> DataFrame:
    """Answers of all four kinds of fields: a bit for each tag of the vocabulary; tri-state fields, not documented where
    missing; enums, None (as text) where missing; the dominant reason, other where unknown."""
    rows = feature_values(tags, enums, tristates)
    return features.select(*ids, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in rows])).alias("x")).select(*ids, "x.field", "x.value")


def feature_values(tags: tuple[str, ...] = domains.TAGS, enums: tuple[str, ...] = tuple(domains.ENUMS), tristates: tuple[str, ...] = domains.TRISTATE_FIELDS) -> list[tuple[str, Column]]:
    """The fields of unpivot_features() and their values."""
    bits = [(f"admission_reason_tags:{t}", F.coalesce(F.array_contains("admission_reason_tags", t), F.lit(False)).cast("int").cast("string")) for t in tags]
    three = [(f, F.coalesce(F.col(f), F.lit("not_documented"))) for f in tristates]
    some = [(f, F.coalesce(F.col(f), F.lit("None"))) for f in enums]
    first = F.col("dominant_admission_reason")
    return [*bits, *three, *some, ("dominant_admission_reason", F.when(first.isin(*tags), first).otherwise("other"))]


def features_side_by_side(features: DataFrame, tags: tuple[str, ...] = domains.TAGS, enums: tuple[str, ...] = tuple(domains.ENUMS), tristates: tuple[str, ...] = domains.TRISTATE_FIELDS, raters: tuple[str, ...] = RATERS, key: str = "doc_id") -> DataFrame:
    """side_by_side(unpivot_features(features)): records are grouped whole, before they become a row for each field."""
    rows = feature_values(tags, enums, tristates)
    said = features.where(F.col("rater").isin(*raters)).select(key, "rater", F.array(*[v for _, v in rows]).alias("values"))
    w = said.groupBy(key).agg(*[F.collect_list(F.when(F.col("rater") == r, F.col("values"))).alias(r) for r in raters])  # a rater's records of one document
    w = w.where(reduce(Column.__and__, [F.size(r) > 0 for r in raters]))
    value = lambda r, i: F.array_max(F.transform(F.col(r), lambda x: F.get(x, i)))
    fields = F.transform(F.array(*[F.lit(f) for f, _ in rows]), lambda f, i: F.struct(f.alias("field"), *[value(r, i).alias(r) for r in raters]))
    return w.select(key, F.explode(fields).alias("x")).select(key, "x.*")


def first_of(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends with a unique column."""
    from pyspark.sql import Window

    keys = [key] if isinstance(key, str) else key
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def override(base: DataFrame, later: DataFrame, key: str) -> DataFrame:
    """Rows of later replace those of base with the same key."""
    return base.join(later.select(key).distinct(), key, "left_anti").unionByName(later, allowMissingColumns=True)


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union that fails, when it runs, on a key that both sides have."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)), allowMissingColumns=True)
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    both = both.withColumn("clash", F.min("side").over(w) != F.max("side").over(w))
    return both.where(F.when(F.col("clash"), F.raise_error(F.concat(F.lit("key on both sides: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("side", "clash")
