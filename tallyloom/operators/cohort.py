"""Cohorts: ranking, deduplication, joins and their audits, quotas, stratified samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .longform import first_of

LAST = 2147483647


def primary_code(codes: DataFrame, key: str) -> DataFrame:
    """The first-ranked code of a key: sequence 1, then numeric sequence, code, version; a key whose first code has no
    version is left out. Adds how many codes the key has. Sequence and version are text and may not be numbers."""
    seq = F.coalesce(text.guarded_int(F.col("seq_num")), F.lit(LAST))
    w = Window.partitionBy(key)
    t = codes.withColumns({"n_codes": F.count("*").over(w), "seq": seq})
    t = first_of(t, key, [F.when(F.col("seq") == 1, 0).otherwise(1), F.asc("seq"), F.asc("code"), F.asc("version")])
    return t.withColumn("version", text.guarded_int(F.col("version"))).where("version is not null").drop("seq")


def code_lists(codes: DataFrame, key: str) -> DataFrame:
    """Codes with a version, in order, as an array of (code, version)."""
    t = codes.withColumns({"v": text.guarded_int(F.col("version")), "s": F.coalesce(text.guarded_int(F.col("seq_num")), F.lit(LAST))}).where("v is not null")
    s = F.sort_array(F.collect_list(F.struct("s", "code", "v")))
    return t.groupBy(key).agg(F.transform(s, lambda x: F.struct(x["code"].alias("code"), x["v"].alias("version"))).alias("codes"))


def top_codes(codes: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """The most frequent codes with their titles (empty where unknown)."""
    t = codes.groupBy("code").agg(F.count("*").alias("n")).join(titles.groupBy("code").agg(F.max("title").alias("title")), "code", "left")
    return t.select("code", "n", F.coalesce("title", F.lit("")).alias("title")).orderBy(F.desc("n"), "code").limit(n)


def top_versioned_codes(codes: DataFrame, titles: DataFrame, n: int) -> DataFrame:
    """The most frequent pairs of code and version with their titles; a dictionary's version is text (empty where unknown)."""
    t = codes.groupBy("code", "version").agg(F.count("*").alias("n")).withColumn("v", F.col("version").cast("string"))
    names = titles.groupBy("code", F.col("version").cast("string").alias("v")).agg(F.max("title").alias("title"))
    return t.join(names, ["code", "v"], "left").select("code", "version", "n", F.coalesce("title", F.lit("")).alias("title")).orderBy(F.desc("n"), "code", "version").limit(n)


def join_audit(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    """Rows, distinct keys and orphans (rows of left without a match; null keys count) in one row."""
    r = right.select(F.col(right_key).alias("k")).distinct()
    a = left.agg(F.count("*").alias("left_rows"), F.count_distinct(key).alias("left_keys"))
    b = right.agg(F.count("*").alias("right_rows"), F.count_distinct(right_key).alias("right_keys"))
    c = left.join(r, left[key] == r["k"], "left_anti").agg(F.count("*").alias("orphans"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def within(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def duplicate_audit(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.sum(F.col("n") - 1).alias("surplus_rows"))


def shuffle_key(id_: Column, seed: int) -> Column:
    """A portable pseudo-random order: md5 of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), id_.cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def largest_remainder(groups: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Whole quotas in proportion to weights (a small table): floors, then one each by largest fraction, then name."""
    w = Window.partitionBy()
    t = groups.where(F.col(weight) > 0).withColumn("exact", F.col(weight) * total / F.sum(weight).over(w))
    t = t.withColumn("floor", F.floor("exact"))
    left = total - F.sum("floor").over(w)
    by = Window.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 9)), name)
    return t.withColumn("quota", (F.col("floor") + (F.row_number().over(by) <= left).cast("long")).cast("long")).drop("exact", "floor")


def quotas(groups: DataFrame, name: str, size: str, total: int) -> list[tuple[str, int]]:
    """Largest-remainder quotas capped at group sizes; what doesn't fit is shared again by spare room. A table of strata."""
    rows = {r[name]: r[size] for r in groups.select(name, size).collect()}  # one row for each stratum
    quota, left = dict.fromkeys(rows, 0), min(total, sum(rows.values()))
    while left:
        room = {k: rows[k] - quota[k] for k in rows if rows[k] > quota[k]}
        whole = sum(room.values())
        share = {k: left * v / whole for k, v in room.items()}
        add = {k: min(room[k], int(share[k])) for k in room}
        for k in sorted(room, key=lambda k: (-round(share[k] - int(share[k]), 9), k is None, str(k)))[: left - sum(add.values())]:
            add[k] += add[k] < room[k]
        for k, v in add.items():
            quota[k] += v
        left -= sum(add.values())
    return sorted(quota.items(), key=lambda x: (x[0] is None, str(x[0])))


def stratified(df: DataFrame, key: str, stratum: str, total: int, seed: int, near: int = 4096) -> DataFrame:
    """A sample with the strata in proportion: the first rows of each in hash order. A null stratum is one, too.

    No stratum is sorted: rows are counted by the first digits of their hash, which tells the bucket where a stratum's quota
    ends. All earlier buckets are taken, and only that bucket's rows (about `near` of them) are put in order.
    """
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
    q = quotas(sizes, stratum, "size", total)
    most = sizes.agg(F.max("size")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(most / near, 1), 16)))
    t = df.withColumn("tl_hash", shuffle_key(F.col(key), seed)).withColumn("tl_bucket", F.substring("tl_hash", 1, digits))
    quota = df.sparkSession.createDataFrame(q, df.select(F.col(stratum).alias("tl_stratum"), F.lit(0).cast("long").alias("tl_quota")).schema).where("tl_quota > 0")
    counts = t.groupBy(F.col(stratum).alias("tl_of"), "tl_bucket").agg(F.count("*").alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("tl_of").orderBy("tl_bucket")))
    # one row for each stratum, as in the table of quotas
    ends = counts.join(quota, F.col("tl_of").eqNullSafe(F.col("tl_stratum"))).where("upto >= tl_quota and upto - n < tl_quota")
    ends = F.broadcast(ends.select("tl_stratum", F.col("tl_bucket").alias("tl_end"), (F.col("tl_quota") - F.col("upto") + F.col("n")).alias("tl_rest")))
    t = t.join(ends, F.col(stratum).eqNullSafe(F.col("tl_stratum")))
    last = t.where("tl_bucket = tl_end").withColumn("tl_nth", F.row_number().over(Window.partitionBy("tl_stratum").orderBy("tl_hash", key))).where("tl_nth <= tl_rest")
    return t.where("tl_bucket < tl_end").select(*df.columns).unionByName(last.select(*df.columns))


def slices(df: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int) -> DataFrame:
    """Consecutive named slices of a sample in hash order (a sample of bounded size)."""
    t = df.withColumn("rn", F.row_number().over(Window.orderBy(shuffle_key(F.col(key), seed + 1), key)))
    at, out = 0, F.lit(None).cast("string")
    for name, n in sizes:
        out = F.when((F.col("rn") > at) & (F.col("rn") <= at + n), name).otherwise(out)
        at += n
    return t.withColumn("slice", out).where("slice is not null").drop("rn")


def shares(df: DataFrame, column: str, name: str) -> DataFrame:
    t = df.groupBy(column).agg(F.count("*").alias("n"))
    return t.select(column, (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))


def balance(population: DataFrame, sample_: DataFrame, stratum: str, within_pp: float = 2.0) -> DataFrame:
    """Shares of the strata, the null one among them, in a population and in a sample of it."""
    p, q = shares(population, stratum, "population_pct"), shares(sample_, stratum, "sample_pct").withColumnRenamed(stratum, "tl_stratum")
    j = p.join(q, F.col(stratum).eqNullSafe(F.col("tl_stratum")), "full_outer")
    j = j.select(F.coalesce(stratum, "tl_stratum").alias(stratum), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("population_pct", "sample_pct")])
    return j.withColumn("delta_pp", F.abs(F.col("population_pct") - F.col("sample_pct"))).withColumn("within", F.col("delta_pp") <= within_pp)


def overlap(splits: dict[str, DataFrame], key: str) -> DataFrame:
    """Shared keys of every two splits."""
    spark, names, out = next(iter(splits.values())).sparkSession, sorted(splits), None
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            t = within(splits[a], splits[b], key).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_distinct(key).alias("shared"))
            out = t if out is None else out.unionByName(t)
    return out if out is not None else spark.createDataFrame([], "a string, b string, shared long")


def difference(a: DataFrame, b: DataFrame, name: str = "surplus") -> DataFrame:
    """Distinct rows that one of two tables (of the same columns) has more often, and how much more often the first one has them:
    one aggregation of both. Nulls equal nulls; `name` must not be one of the columns."""
    t = a.withColumn(name, F.lit(1)).unionByName(b.withColumn(name, F.lit(-1)))
    return t.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum(name).alias(name)).where(F.col(name) != 0)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Determinism check: nothing is left either way."""
    return difference(a, b).isEmpty()


def match_patterns(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """Codes x patterns of the same version: a pattern with a dot matches the whole code, one without its beginning.

    An equi-join for each length that occurs among the patterns, on the code's beginning.
    """
    p = patterns.select("*", F.upper(F.trim("pattern")).alias("p")).withColumn("exact", F.col("p").contains("."))
    lengths = [r.n for r in p.where("not exact").select(F.length("p").alias("n")).distinct().collect()]  # a few numbers
    c = codes.withColumn("c", text.normal_code(F.col("code")))
    keys = [F.struct(F.lit(True).alias("exact"), F.col("c").alias("p"))] + [F.struct(F.lit(False).alias("exact"), F.substring("c", 1, n).alias("p")) for n in sorted(lengths)]
    c = c.select(*codes.columns, F.explode(F.array_distinct(F.array(*keys))).alias("k")).select(*codes.columns, "k.exact", "k.p")
    return c.join(p, ["version", "exact", "p"]).drop("p", "exact")
