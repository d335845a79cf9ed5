"""Joins with fallbacks, containment and priorities, expressed as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import words


def with_fallback(left: DataFrame, right: DataFrame, key: Column, fallback: Column, right_key: str, values: list[str]) -> DataFrame:
    """left with right's values by key, or, where the key finds no row, by the fallback key; right is unique by its key."""
    first = right.select(F.col(right_key).alias("_k1"), F.struct(*values).alias("_v1"))
    second = right.select(F.col(right_key).alias("_k2"), F.struct(*values).alias("_v2"))
    joined = left.withColumns({"_key": key, "_fallback": fallback}).join(first, F.col("_key") == F.col("_k1"), "left").join(second, F.col("_fallback") == F.col("_k2"), "left")
    found = F.coalesce("_v1", "_v2")
    return joined.select(*left.columns, *[found[v].alias(v) for v in values], F.col("_v1").isNotNull().alias("by_key"), found.isNotNull().alias("matched"))


def contained_names(texts: DataFrame, text: Column, names: DataFrame, name: Column, keep: list[str], name_keep: list[str], widest: int = 6) -> DataFrame:
    """Rows (keep, name_keep, name_words) for every normalised name that a normalised text holds as whole words.

    Instead of testing each text against each name, the word runs of the text, of every length up to `widest`, that
    names have, are looked up by an equi-join. A name longer than that finds no text; widest is checked by the caller.
    """
    w = words(text)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(widest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.when(i + n - 1 <= F.size(w), F.array_join(F.slice(w, i, n), " ")))))
    grams = texts.where(F.size(w) > 0).select(*keep, F.explode(F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))).alias("_run"))
    listed = names.select(*name_keep, name.alias("_run")).where(F.col("_run") != "").withColumn("name_words", F.size(F.split("_run", " ")))
    return grams.join(listed, "_run").select(*keep, *name_keep, "name_words")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order: a duplicate filter that knows which row it keeps."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def filled_from(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """left with its null or blank fields filled from right's row of the same key (unique)."""
    other = right.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = left.join(other, left[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in fields else F.col(c) for c in left.columns])
