"""Single-link clusters of points within groups, and their roll-up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.engine import cut, drop
from parcelforge.operators.skew import lookup
from parcelforge.operators.spatial import finite, split_hot


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root), stored: each vertex with the least id it can reach over edges (a, b).

    Each round takes the least label around and then follows labels of labels, so labels at least double their reach.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "both")
    labels = cut(vertices.select("id", F.col("id").alias("root")), "labels")
    while True:
        offered = lookup(both, labels.select(F.col("id").alias("b"), F.col("root").alias("offer")), "b").groupBy("a").agg(F.min("offer").alias("offer"))
        lower = cut(labels.join(offered.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("root").alias("old"), F.least("root", "offer").alias("root")), "lower")
        jumped = lookup(lower, lower.select(F.col("id").alias("root"), F.col("root").alias("far")), "root").select("id", "old", F.least("root", "far").alias("root"))
        jumped = cut(jumped, "labels")
        drop(lower), drop(labels)
        moved = not jumped.where("root <> old").isEmpty()
        labels = jumped.select("id", "root")
        labels._cut_path = getattr(jumped, "_cut_path", None)
        if not moved:
            return labels


def single_link(df: DataFrame, group: str, item: str, x: str, y: str, distance: float) -> DataFrame:
    """(group, item, cluster): items of a group joined by steps of at most `distance`; cluster is its least item.

    Cells are so small that all items of a cell and group are within the distance of each other: they are tied to the
    cell's least item, by an aggregate. Only between cells up to two steps apart are places compared, each distinct
    place once and in tasks of bounded size (split_hot). (group, item) must be unique; rows without a place, group or
    item are left out.
    """
    p = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite(F.col("x"), F.col("y")) & F.col("g").isNotNull() & F.col("i").isNotNull())
    side = distance / math.sqrt(2) * (1 - 1e-9)
    cell = lambda v: F.floor(F.col(v) / side).cast("long")
    p = cut(p.withColumns({"id": F.struct("g", "i"), "cx": cell("x"), "cy": cell("y")}), "points")
    heads = cut(p.groupBy("g", "cx", "cy").agg(F.min("id").alias("head")), "heads")
    tied = p.join(heads, ["g", "cx", "cy"]).select(F.col("id").alias("a"), F.col("head").alias("b"))
    places = p.select("g", "cx", "cy", "x", "y").distinct()
    half = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (j, i) > (0, 0)]  # each pair of cells once
    to = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in half]))
    far = places.select("g", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), to.alias("d"))
    far = far.select("g", "x2", "y2", "ox", "oy", (F.col("ox") + F.col("d.dx")).alias("cx"), (F.col("oy") + F.col("d.dy")).alias("cy"))
    near, far, keys = split_hot(places, far, ["g", "cx", "cy"], ["x", "y"], ["x2", "y2"])
    met = near.join(far, keys).where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= distance).select("g", "cx", "cy", "ox", "oy").distinct()
    other = heads.select("g", F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("head").alias("b"))
    across = met.join(heads, ["g", "cx", "cy"]).join(other, ["g", "ox", "oy"]).select(F.col("head").alias("a"), "b")
    joined = cut(components(heads.select(F.col("head").alias("id")), across), "joined")
    found = tied.join(joined.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "root")
    return found.select(F.col("id.g").alias(group), F.col("id.i").alias(item), F.col("root.i").alias("cluster"))
