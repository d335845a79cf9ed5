"""Hot keys: found by counting, bounded in number, split by salts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1e-4  # a key is hot if it holds more than this share of the rows: at most 1 / SHARE keys can
LEAST = 100_000  # and more than so many rows


def heavy_keys(df: DataFrame, keys: list[str], least: int = LEAST, share: float = SHARE) -> list[tuple]:
    """(key..., rows) of the keys that hold more than max(least, share of all) rows: at most 1 / share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = counts.where(F.col("_n") > least).orderBy(F.desc("_n")).limit(math.ceil(1 / share)).select(F.struct(*keys).alias("_k"), "_n")
    whole = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n")).select(F.lit(None).alias("_k"), "_n")
    rows = most.unionByName(whole).collect()  # one job: both read the same counts
    total = next(r["_n"] for r in rows if r["_k"] is None)
    return [(*r["_k"], r["_n"]) for r in rows if r["_k"] is not None and r["_n"] > total * share]


def heavy_frame(df: DataFrame, keys: list[str], heavy: list[tuple], least: int) -> DataFrame:
    """The heavy keys with `_salts`, how many parts each is dealt into."""
    spark, types = df.sparkSession, dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "_salts int"])
    return spark.createDataFrame([(*h[:-1], -(-h[-1] // least)) for h in heavy], schema)


def with_salt(df: DataFrame, keys: list[str], spread: Column, least: int = LEAST) -> DataFrame:
    """Adds `_salt`: 0 for ordinary keys, pmod(spread, parts) for heavy ones. spread is a hash of what tells rows apart."""
    heavy = heavy_keys(df, keys, least)
    if not heavy:
        return df.withColumn("_salt", F.lit(0))
    salts = F.broadcast(heavy_frame(df, keys, heavy, least))  # at most 1 / SHARE rows
    return df.join(salts, keys, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_salts").cast("bigint")).cast("int"), F.lit(0))).drop("_salts")


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = LEAST) -> DataFrame:
    """left joined with right, which has one row per key: rows of left with a heavy key meet their (few) partners by broadcast, the others by a shuffle."""
    heavy = heavy_keys(left, [key], least)
    if not heavy:
        return left.join(right, key, how)
    hot = F.broadcast(heavy_frame(left, [key], heavy, least).drop("_salts"))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    names = [*left.columns, *[c for c in right.columns if c != key]]
    return left.join(hot, key, "left_semi").join(few, key, how).select(*names).unionByName(left.join(hot, key, "left_anti").join(right, key, how).select(*names))
