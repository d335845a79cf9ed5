"""Greedy suppression of near duplicates within groups, without a task per group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.engine import cut, drop
from parcelforge.operators.spatial import finite


def suppress(df: DataFrame, group: str, x: str, y: str, order: list[Column], distance: float, keep: int | None = None) -> DataFrame:
    """The rows that a greedy pass keeps: in the given order, a row stays if no row kept before lies closer than `distance`.

    The same rows as the sequential pass (a row exactly at the distance stays), found in rounds over grid cells so small
    that all rows of a cell are nearer to each other than the distance. In a round, the first row of each cell stays if
    it is ahead of the first rows of all cells around; the rows within the distance of those that stay go. Rows of a cell
    are met by an aggregate and by the few that stay, never by each other, so neither a large group nor a crowded place
    costs more than its rows. With `keep`, the first so many of each group. `order` holds ascending keys (a descending
    number as its negative) and must be total within a group; rows with a null or non-finite place, or a null group, are
    left out.
    """
    size = distance / math.sqrt(2) * (1 - 1e-9)
    ranked = df.where(F.col(group).isNotNull() & finite(F.col(x), F.col(y)))
    ranked = cut(ranked.withColumns({"_order": F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]), "_id": F.monotonically_increasing_id()}), "ranked")
    alive = ranked.select("_id", F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col("_order").alias("o"))
    alive = cut(alive.withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cy": F.floor(F.col("y") / size).cast("long")}), "alive")
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]

    def around(cells: DataFrame, including: bool) -> DataFrame:
        """Each row once for every cell within two steps of its own."""
        offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps if including or (i, j) != (0, 0)])
        out = cells.withColumn("d", F.explode(offsets))
        return out.withColumns({"cx": F.col("cx") + F.col("d.i"), "cy": F.col("cy") + F.col("d.j")}).drop("d")

    kept: DataFrame | None = None
    while not alive.isEmpty():
        first = cut(alive.groupBy("g", "cx", "cy").agg(F.min(F.struct("o", "_id", "x", "y")).alias("f")), "first")
        rivals = around(first.select("g", "cx", "cy", F.col("f.o").alias("rival")), False).groupBy("g", "cx", "cy").agg(F.min("rival").alias("rival"))
        ahead = first.join(rivals, ["g", "cx", "cy"], "left").where(F.col("rival").isNull() | (F.col("f.o") < F.col("rival")))
        stay = cut(ahead.select("g", "cx", "cy", F.col("f._id").alias("stays"), F.col("f.x").alias("kx"), F.col("f.y").alias("ky")), "stay")
        met = alive.join(around(stay, True), ["g", "cx", "cy"]).where(F.hypot(F.col("x") - F.col("kx"), F.col("y") - F.col("ky")) < distance)
        left = cut(alive.join(met.select("_id").distinct(), "_id", "left_anti"), "alive")
        ids = stay.select(F.col("stays").alias("_id"))
        kept = ids if kept is None else kept.unionByName(ids)
        drop(alive), drop(first)
        alive = left
    out = ranked.join(kept, "_id", "left_semi") if kept is not None else ranked
    if keep is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_order"))).where(F.col("_n") <= keep).drop("_n")
    return out.drop("_id", "_order")
