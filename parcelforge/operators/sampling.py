"""Repeatable folds, samples and feature scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_hash(c: Column) -> Column:
    """The first 32 bits of the MD5 of a text, the same on every engine; null gives null."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def fold(c: Column, folds: int) -> Column:
    return F.pmod(stable_hash(c), F.lit(folds))


def sample_groups(df: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """n keys of each stratum, those whose seeded hash is least: the feature is the sample, and it doesn't depend on row order."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed), F.col(key))), F.col(key))
    return df.select(stratum, key).distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def standardised(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """(x - mean) / deviation of the training rows, population deviation, 1 if it vanishes; nulls become 0."""
    from parcelforge.functions.text import number

    stats = df.where(train).agg(*[f(number(F.col(c))).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in cols:
        s = F.when(F.col(f"s_{c}") < 1e-9, 1.0).otherwise(F.col(f"s_{c}"))
        out = out.withColumn(f"z_{c}", F.coalesce((number(F.col(c)) - F.col(f"m_{c}")) / s, F.lit(0.0)))
    return out.drop(*[f"{n}_{c}" for c in cols for n in "ms"])


def one_hot(df: DataFrame, col: str, top: int) -> DataFrame:
    """A 0/1 column for each of the `top` most frequent values (ties by value): a bounded list, counted over all rows."""
    levels = [r[0] for r in df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col).limit(top).collect()]
    return df.withColumns({f"{col}_is_{i}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for i, v in enumerate(levels)})
