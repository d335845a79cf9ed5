"""From evidence to ranked boxes to ranked parcels, as one lazily composed plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.functions import geometry as G
from parcelforge.functions import text as N
from parcelforge.operators import ranking as R
from parcelforge.operators.spatial import finite
from parcelforge.operators.skew import lookup
from parcelforge.operators.suppress import suppress


@dataclass(frozen=True)
class Settings:
    """Sizes in metres."""

    cell: float = 10.0  # evidence is gathered in cells of this size
    side: float = 180.0  # of a box
    near: float = 140.0  # evidence at most so far from a centre counts in part
    near_weight: float = 0.35
    source_weight: float = 4.0  # for each source that agrees within the box
    apart: float = 65.0  # between the centres of a case's boxes
    boxes: int = 8
    parcels: int = 5


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_key, source, x, y, weight): points and named places of cases, with a place and a weight of at least 0; each once."""
    p = table(spark, sf_dir, "point_candidates").select("case_key", "source", F.col("point_id").alias("id"), F.col("easting_27700").alias("x"), F.col("northing_27700").alias("y"), F.col("score").alias("weight"))
    n = table(spark, sf_dir, "name_candidates").select("case_key", F.col("kind").alias("source"), F.col("cand_no").alias("id"), F.col("easting").alias("x"), F.col("northing").alias("y"), F.col("score").alias("weight"))
    both = p.distinct().unionByName(n.distinct()).where(F.col("case_key").isNotNull() & finite(F.col("x"), F.col("y")))
    return both.withColumn("weight", F.greatest(F.coalesce(N.number(F.col("weight")), F.lit(0.0)), F.lit(0.0))).drop("id")


def scored_cells(points: DataFrame, s: Settings) -> DataFrame:
    """(case_key, x, y, score, sources): the evidence's cells, each scored by what lies around its centre.

    Evidence is first summed by cell, so that a case with any number of rows has at most the cells of its area, and a cell
    meets at most the cells within `near` of it: (2 near / cell)^2 of them, whatever the data.
    """
    cells = points.groupBy("case_key", F.floor(F.col("x") / s.cell).alias("cx"), F.floor(F.col("y") / s.cell).alias("cy"), "source").agg(F.sum("weight").alias("weight"))
    reach = int(s.near // s.cell)
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if (i * i + j * j) * s.cell**2 <= s.near**2]
    half = s.side / 2
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(abs(i) * s.cell <= half and abs(j) * s.cell <= half).alias("inside")) for i, j in steps]))
    centres = cells.select("case_key", "cx", "cy").distinct()
    spread = cells.select("case_key", "source", "weight", "cx", "cy", around.alias("d")).select(
        "case_key", "source", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"), F.col("d.inside").alias("inside"), "weight"
    )
    met = centres.join(spread, ["case_key", "cx", "cy"]).groupBy("case_key", "cx", "cy", "source").agg(
        F.sum(F.when(F.col("inside"), F.col("weight")).otherwise(F.col("weight") * s.near_weight)).alias("weight"), F.bool_or("inside").alias("inside")
    )
    scored = met.groupBy("case_key", "cx", "cy").agg(F.sum("weight").alias("w"), F.count_if("inside").alias("sources"))
    return scored.select("case_key", ((F.col("cx") + 0.5) * s.cell).alias("x"), ((F.col("cy") + 0.5) * s.cell).alias("y"), F.round(F.col("w") + s.source_weight * F.col("sources"), 6).alias("score"), "sources")


def boxes(cells: DataFrame, s: Settings) -> DataFrame:
    """(case_key, rank, x, y, score, box): the best centres of each case, apart from each other."""
    kept = suppress(cells, "case_key", "x", "y", [-F.col("score"), F.col("x"), F.col("y")], s.apart, s.boxes)
    ranked = R.placed(kept, "case_key", [F.desc("score"), F.col("x"), F.col("y")], "rank")
    return ranked.select("case_key", "rank", "x", "y", "score", G.square(F.col("x"), F.col("y"), F.lit(s.side)).alias("box"))


def parcels(spark: SparkSession, sf_dir: str, found: DataFrame, s: Settings) -> DataFrame:
    """(case_key, candidate_id, place, boxes): candidates of each case by how many of its boxes (or, for a sub-case, of its case's) hold
    their centroid, then by the canonical order."""
    c = table(spark, sf_dir, "polygon_candidates").where("case_key is not null").select("case_key", "candidate_id", "row_id", "loaded_at", "rule_rank", N.number(F.col("rule_score")).alias("score"), N.number(F.col("candidate_centroid_easting")).alias("cx"), N.number(F.col("candidate_centroid_northing")).alias("cy"))
    c = R.latest_rows(c, ["case_key", "candidate_id"], ["loaded_at", "row_id"]).where("cx is not null and cy is not null")
    few = found.groupBy(F.col("case_key").alias("base")).agg(F.collect_list("box").alias("boxes"))  # at most `boxes` of each case
    held = F.coalesce(F.size(F.filter("boxes", lambda b: G.in_box(F.col("cx"), F.col("cy"), b))), F.lit(0))
    c = lookup(c.withColumn("base", N.base_key(F.col("case_key"))), few, "base", "left").withColumn("boxes", F.when(F.col("boxes").isNull(), 0).otherwise(held))
    order = [F.desc("boxes"), *R.canonical_order("rule_rank", "score", "candidate_id")]
    return R.placed(c, "case_key", order, "place").where(F.col("place") <= s.parcels).select("case_key", "candidate_id", "place", "boxes")


def scored_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_cells(evidence(spark, sf_dir), Settings()).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


def pipeline_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    return boxes(scored_cells(evidence(spark, sf_dir), s), s).select("case_key", "rank", "x", "y", "score", "box.*")


def pipeline_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Settings()
    return parcels(spark, sf_dir, boxes(scored_cells(evidence(spark, sf_dir), s), s), s)


QUERIES = {f.__name__: f for f in (scored_centres, pipeline_boxes, pipeline_parcels)}

ORACLES = {
    "scored_centres": """with e as (select case_key, source, x, y, greatest(coalesce(case when isfinite(w) then w end, 0), 0) as w from (
        select distinct case_key, source, point_id as id, easting_27700 as x, northing_27700 as y, score as w from point_candidates union all select distinct case_key, kind, cand_no, easting, northing, score from name_candidates)
        where case_key is not null and isfinite(x) and isfinite(y)),
      c as (select case_key, cast(floor(x / 10) as bigint) as cx, cast(floor(y / 10) as bigint) as cy, source, sum(w) as w from e group by all), z as (select distinct case_key, cx, cy from c),
      m as (select z.case_key, z.cx, z.cy, source, sum(case when abs(c.cx - z.cx) <= 9 and abs(c.cy - z.cy) <= 9 then w else w * 0.35 end) as w, bool_or(abs(c.cx - z.cx) <= 9 and abs(c.cy - z.cy) <= 9) as i
        from z join c on c.case_key = z.case_key and (c.cx - z.cx) * (c.cx - z.cx) + (c.cy - z.cy) * (c.cy - z.cy) <= 196 group by all)
      select case_key, round((cx + 0.5) * 10.0::double, 3) as x, round((cy + 0.5) * 10.0::double, 3) as y, round(sum(w) + 4.0::double * count(*) filter (i), 6) as score, count(*) filter (i) as sources from m group by case_key, cx, cy""",
}
