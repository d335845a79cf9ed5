"""Orders, ranks and portfolios of candidates within groups, and how well they hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.operators.skew import lookup


def latest_rows(df: DataFrame, keys: list[str], latest: list[str]) -> DataFrame:
    """One row per key, the one with the greatest `latest`: an aggregate with map-side combining, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*latest)).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def canonical_order(rank: str, score: str, item: str) -> list[Column]:
    return [F.col(rank).asc_nulls_last(), F.col(score).desc_nulls_last(), F.col(item).asc()]


def placed(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def order_key(rank: str, score: str, item: str) -> Column:
    """canonical_order as one ascending struct, for aggregates."""
    return F.struct(F.coalesce(F.col(rank).cast("double"), F.lit(float("inf"))).alias("r"), (-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("s"), F.col(item).alias("i"))


def portfolio(df: DataFrame, group: str, base_order: list[Column], other_order: list[Column], keep: int, extra: int, top: int, other: Column | None = None) -> DataFrame:
    """The first `top` of each group with `place` and `bucket`: the first `keep` of the base order, then the first `extra` of the
    other order among the rest (those for which `other` holds), then the rest in base order.

    Only the heads of both orders can take part, and they are cut before anything is gathered by group (Spark limits each
    partition's groups ahead of the window), so a large group costs no more than a small one. Equal rows are one candidate.
    """
    other = F.coalesce(other, F.lit(False)) if other is not None else F.lit(True)
    base = placed(df, group, base_order, "_base").where(F.col("_base") <= keep + extra + top)
    second = placed(df.where(other), group, other_order, "_other").where(F.col("_other") <= keep + extra).drop("_other")
    few = base.drop("_base").unionByName(second).distinct()
    w = Window.partitionBy(group)
    few = few.withColumn("_base", F.row_number().over(w.orderBy(*base_order)))
    rest = (F.col("_base") > keep) & other
    few = few.withColumn("_other", F.row_number().over(w.orderBy(F.when(rest, 0).otherwise(1), *other_order)))
    few = few.withColumn("bucket", F.when(F.col("_base") <= keep, "base").when(rest & (F.col("_other") <= extra), "other").otherwise("rest"))
    at = F.when(F.col("bucket") == "other", F.col("_other")).otherwise(F.col("_base"))
    few = few.withColumn("place", F.row_number().over(w.orderBy(F.when(F.col("bucket") == "base", 0).when(F.col("bucket") == "other", 1).otherwise(2), at)))
    return few.where(F.col("place") <= top).drop("_base", "_other")


def first_hits(df: DataFrame, group: str, key: Column, hit: Column) -> DataFrame:
    """(group, candidates, first_hit): the place of the first hit in ascending order of key (total within a group), null if there is none.

    No ranks are made: the least key of a hit is an aggregate, and its place the number of keys up to it, another one.
    """
    keyed = df.select(group, key.alias("_key"), F.coalesce(hit, F.lit(False)).alias("_hit"))
    best = keyed.where("_hit").groupBy(group).agg(F.min("_key").alias("_best"))
    joined = lookup(keyed, best, group, "left")
    return joined.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"), F.nullif(F.count_if(F.col("_key") <= F.col("_best")), F.lit(0)).cast("int").alias("first_hit"))


def top_k_rates(hits: DataFrame, ks: list[int]) -> DataFrame:
    """(k, groups, hits, rate) over first_hits' rows; each k has a row even if nothing hits."""
    asked = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    out = hits.agg(F.count(F.lit(1)).alias("groups"), *[F.count_if(F.col("first_hit") <= k).alias(f"h{k}") for k in ks])
    return out.select("groups", *[f"h{k}" for k in ks], asked).select("k", "groups", F.coalesce(*[F.when(F.col("k") == k, F.col(f"h{k}")) for k in ks]).alias("hits")).withColumn("rate", F.when(F.col("groups") > 0, F.col("hits") / F.col("groups")))
