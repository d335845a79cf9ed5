"""Named strategies over one table of ranked candidates: each gives the first `top` of every group, with their place.

A strategy is a function of (candidates, top) that returns the candidates it chooses with a column `place`. candidates has
case_key, candidate_id, rule_rank, score, x, y, area, to_point, to_road, covers_best_point; (case_key, candidate_id) is
unique. Numbers may be null. The heads of orders are cut before anything is gathered by group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.operators import ranking as R
from parcelforge.operators.cluster import single_link
from parcelforge.operators.suppress import suppress

GROUP = "case_key"
APART_M, SAME_M, SAME_RATIO, NEAR_ROAD_M, OFF_M = 2.0, 8.0, 5.0, 12.0, 60.0


def base_order() -> list[Column]:
    return R.canonical_order("rule_rank", "score", "candidate_id")


def base_key() -> list[Column]:
    """base_order as ascending keys."""
    return [F.coalesce(F.col("rule_rank").cast("double"), F.lit(float("inf"))), -F.coalesce("score", F.lit(float("-inf"))), F.col("candidate_id")]


def rule(df: DataFrame, top: int) -> DataFrame:
    return R.placed(df, GROUP, base_order(), "place").where(F.col("place") <= top)


def conservative_road(df: DataFrame, top: int) -> DataFrame:
    """All but the last place by rule; the last goes to the best one near a mentioned road that doesn't cover the point."""
    return R.portfolio(df, GROUP, base_order(), [F.col("to_road").asc_nulls_last(), F.col("candidate_id")], top - 1, 1, top, ~F.col("covers_best_point") & (F.col("to_road") <= NEAR_ROAD_M)).drop("bucket")


def bounded_noncover(df: DataFrame, top: int) -> DataFrame:
    """As conservative_road, for the nearest to the point that doesn't cover it, within a bound."""
    return R.portfolio(df, GROUP, base_order(), [F.col("to_point").asc_nulls_last(), F.col("candidate_id")], top - 1, 1, top, ~F.col("covers_best_point") & (F.col("to_point") <= OFF_M)).drop("bucket")


def relation_mix(df: DataFrame, top: int) -> DataFrame:
    """The first by rule, then two by nearness to the point, then by rule again."""
    return R.portfolio(df, GROUP, base_order(), [F.col("to_point").asc_nulls_last(), F.col("candidate_id")], 1, 2, top).drop("bucket")


def _located(df: DataFrame) -> DataFrame:
    return df.where("x is not null and y is not null")


def diverse(df: DataFrame, top: int) -> DataFrame:
    """The rule's order without those closer than APART_M to one chosen before; if they are too few, the next by rule fill up.

    Candidates without a place can only fill up.
    """
    chosen = suppress(_located(df), GROUP, "x", "y", base_key(), APART_M, top).select(GROUP, "candidate_id", F.lit(0).alias("_fill"))
    head = R.placed(df, GROUP, base_order(), "_base").where(F.col("_base") <= top).select(GROUP, "candidate_id")
    both = chosen.unionByName(head.join(chosen, [GROUP, "candidate_id"], "left_anti").withColumn("_fill", F.lit(1)))
    return R.placed(df.join(both, [GROUP, "candidate_id"]), GROUP, ["_fill", *base_order()], "place").where(F.col("place") <= top).drop("_fill")


def diverse_footprint(df: DataFrame, top: int) -> DataFrame:
    """The rule's order without repeated footprints: of candidates in one SAME_M cell whose areas lie in one band (a power of SAME_RATIO)
    only the first; a candidate without place or area repeats none."""
    band = F.when(F.col("area") > 0, F.floor(F.log(SAME_RATIO, F.col("area"))))
    key = [F.bround(F.col("x") / SAME_M), F.bround(F.col("y") / SAME_M), band]
    keyed = df.withColumn("_foot", F.when(F.col("x").isNotNull() & F.col("y").isNotNull() & band.isNotNull(), F.concat_ws(",", *[k.cast("long") for k in key])).otherwise(F.concat(F.lit("own:"), "candidate_id")))
    rest = [c for c in df.columns if c != GROUP]
    first = keyed.groupBy(GROUP, "_foot").agg(F.min_by(F.struct(*rest), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(base_key())])).alias("_r"))
    return rule(first.select(GROUP, *[F.col(f"_r.{c}").alias(c) for c in rest]), top)


def centroid_cluster(df: DataFrame, top: int, distance: float = 80.0) -> DataFrame:
    """The best candidate by rule of each cluster of centroids joined by steps of `distance`, in the rule's order."""
    located = _located(df)
    clustered = located.join(single_link(located, GROUP, "candidate_id", "x", "y", distance), [GROUP, "candidate_id"])
    rest = [c for c in df.columns if c != GROUP]
    first = clustered.groupBy(GROUP, "cluster").agg(F.min_by(F.struct(*rest), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(base_key())])).alias("_r"))
    return rule(first.select(GROUP, *[F.col(f"_r.{c}").alias(c) for c in rest]), top)


def gated(df: DataFrame, top: int, margin: float = 10.0) -> DataFrame:
    """The rule's head, in which one challenger after another, best score first, takes the place of the lowest incumbent it
    beats by `margin`: challenger n meets incumbent top + 1 - n, and the first who fails ends it."""
    ranked = R.placed(df, GROUP, base_order(), "_base").where(F.col("_base") <= top)
    rivals = R.placed(df.where("score is not null").join(ranked.select(GROUP, "candidate_id"), [GROUP, "candidate_id"], "left_anti"), GROUP, [F.desc("score"), F.col("candidate_id")], "_n").where(F.col("_n") <= top)
    size = ranked.groupBy(GROUP).agg(F.count(F.lit(1)).alias("_size"))
    seats = ranked.join(size, GROUP).select(GROUP, (F.col("_size") + 1 - F.col("_base")).cast("int").alias("_n"), F.col("candidate_id").alias("_old"), F.col("score").alias("_old_score"), F.col("_base").alias("_seat"))
    met = seats.join(rivals.select(GROUP, "_n", F.col("candidate_id").alias("_new"), F.col("score").alias("_new_score")), [GROUP, "_n"], "left")
    wins = F.coalesce(F.col("_new_score") >= F.coalesce("_old_score", F.lit(float("-inf"))) + margin, F.lit(False))
    lost = F.max(F.when(wins, 0).otherwise(1)).over(Window.partitionBy(GROUP).orderBy("_n"))  # at most `top` rows a group
    out = met.withColumn("_lost", lost).select(GROUP, F.when(F.col("_lost") == 0, F.col("_new")).otherwise(F.col("_old")).alias("candidate_id"), F.col("_seat").alias("place"))
    return df.join(out, [GROUP, "candidate_id"])


STRATEGIES: dict[str, Callable[[DataFrame, int], DataFrame]] = {f.__name__: f for f in (rule, conservative_road, bounded_noncover, relation_mix, diverse, diverse_footprint, centroid_cluster, gated)}
