"""Global ranks and running totals over a total order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.engine import cut


def range_ordered(df: DataFrame, order_by: list[Column], label: str = "ordered") -> DataFrame:
    """df range-partitioned and sorted by order_by, stored, with `_part` (number of the range) and `_row` (place in it)."""
    marked = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    return cut(marked.withColumn("_mono", F.monotonically_increasing_id()), label).withColumns(
        {"_part": F.shiftright("_mono", 33).cast("int"), "_row": F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_mono")


def running_total(df: DataFrame, order_by: list[Column], weight: Column, total: str, rank: str | None = None, within: list[str] = (), label: str = "ordered") -> DataFrame:
    """Adds `total`, the inclusive running sum of weight in the order (within, order_by), and `rank`, the 0-based place.

    Ranges are summed in parallel and shifted by the totals of the ranges before them: one row per range and group
    goes through the offset window, never the data. Ties in order_by leave the order between the tied rows open, so
    give a total order. A null weight counts as 0. Empty input gives an empty result.
    """
    keys = [F.col(c) for c in within]
    kept = range_ordered(df.withColumn("_ordered_w", F.coalesce(weight, F.lit(0))), [*keys, *order_by], label)
    per_range = kept.groupBy(*within, "_part").agg(F.sum("_ordered_w").alias("_ordered_sum"), F.count(F.lit(1)).alias("_ordered_n"))
    # One row per range (and group that ends or begins in it): as many as shuffle partitions plus groups.
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if within else Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *[F.col(c).alias(f"_k_{c}") for c in within], F.col("_part").alias("_ordered_p"),
        F.coalesce(F.sum("_ordered_sum").over(before), F.lit(0)).alias("_ordered_before"), F.coalesce(F.sum("_ordered_n").over(before), F.lit(0)).alias("_ordered_rows_before"),
    )
    cond = F.col("_part") == F.col("_ordered_p")
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    in_range = Window.partitionBy(*within, "_part").orderBy("_row")
    out = (
        kept.withColumns({"_ordered_run": F.sum("_ordered_w").over(in_range.rowsBetween(Window.unboundedPreceding, 0)), "_ordered_at": F.row_number().over(in_range)})
        .join(offsets, cond)
        .withColumn(total, F.col("_ordered_run") + F.col("_ordered_before"))
    )
    if rank:
        out = out.withColumn(rank, F.col("_ordered_at") - 1 + F.col("_ordered_rows_before"))
    return out.drop("_ordered_w", "_ordered_run", "_ordered_at", "_part", "_row", "_ordered_p", "_ordered_before", "_ordered_rows_before", *[f"_k_{c}" for c in within])


def following(df: DataFrame, order_by: list[Column], within: list[str], names: dict[str, str], label: str = "following") -> DataFrame:
    """df with, for each (new name, column) of names, the column's value in the next row of the order (within, order_by); null in a group's last row.

    A group of any size: rows are range-sorted, the next row is looked for in the range, and a group's last row in a
    range takes the first one of the group in a later range, of which there is one row per range and group. Rows with
    a null in `within` form a group, too. order_by must be total within a group.
    """
    kept = range_ordered(df, [*[F.col(c) for c in within], *order_by], label)
    inside = Window.partitionBy(*within, "_part").orderBy("_row")
    values = F.struct(*[F.col(c).alias(n) for n, c in names.items()])
    out = kept.withColumn("_next", F.lead(values).over(inside))
    firsts = kept.groupBy(*within, "_part").agg(F.min_by(values, "_row").alias("_first"))
    later = firsts.withColumn("_first", F.lead("_first").over(Window.partitionBy(*within).orderBy("_part"))).where("_first is not null")
    later = later.select(*[F.col(c).alias(f"_k_{c}") for c in within], F.col("_part").alias("_k_part"), "_first")
    cond = F.col("_part") == F.col("_k_part")
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    out = out.join(later, cond, "left").withColumn("_next", F.coalesce("_next", "_first"))
    return out.select(*df.columns, *[F.col(f"_next.{n}").alias(n) for n in names])
