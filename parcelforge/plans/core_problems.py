"""Queries of the problems in the core: nested records, packed fields, points and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.operators.packed import NARROW, WIDE, unpack
from parcelforge.operators.shred import nested_objects, nested_tables
from parcelforge.operators.spatial import inside_boxes, within_distance

JSON_COLUMNS = ["road_candidates_json", "os_fallback_pool_json", "range_parity_points_json"]
NEAR_M = 30.0


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_objects(table(spark, sf_dir, "geocoder_rows"), "row_id", JSON_COLUMNS)


def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_tables(table(spark, sf_dir, "geocoder_rows"), "row_id", JSON_COLUMNS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, field, key, delimiters in (
        ("geocoder_rows", "best_road_name", "row_id", WIDE),
        ("candidate_boxes", "evidence_sources", "box_id", WIDE),
        ("candidate_boxes", "evidence_labels", "box_id", NARROW),
    ):
        rows = unpack(table(spark, sf_dir, name), field, [key], delimiters, least=2)
        parts.append(rows.select(F.lit(field).alias("field"), F.col(key).alias("row_id"), "pos", "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "point_candidates")
    at = ("point_id", "easting_27700", "northing_27700")
    near = within_distance(points, table(spark, sf_dir, "uprn"), at, ("UPRN", "X_COORDINATE", "Y_COORDINATE"), NEAR_M)
    held = inside_boxes(points, table(spark, sf_dir, "candidate_boxes"), at, ("box_id", "center_x", "center_y", "side_m"))
    return near.select(F.col("id").alias("point_id"), F.lit("uprn_near").alias("rel"), "other_id").distinct().unionByName(
        held.select(F.col("id").alias("point_id"), F.lit("in_box").alias("rel"), F.col("box_id").cast("string").alias("other_id")).distinct()
    )


QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables, "p4_found": p4_found, "p6_found": p6_found}

_JSON_PART = """
select row_id, '{f}' as field, regexp_replace(regexp_replace(regexp_replace(fullkey, '^\\$', ''), '\\[(\\d+)\\]', '.\\1', 'g'), '^\\.', '') as obj_path
from (select row_id, {f} as j from geocoder_rows where json_valid({f}) and json_type({f}) = 'ARRAY') t, json_tree(t.j) x
where x.type = 'OBJECT' and x.fullkey like '%]'"""

_SPLIT_PART = """
select '{f}' as field, row_id, cast(row_number() over (partition by row_id order by i) as bigint) as pos, value
from (select row_id, i, trim(case when piece like '"%"' then replace(substr(piece, 2, length(piece) - 2), '""', '"') else piece end, ' ') as value
      from (select row_id, unnest(range(len(l))) as i, trim(unnest(l), e' \\t\\r\\n') as piece
            from (select {k} as row_id, regexp_extract_all(regexp_replace(trim({f}, e' \\t\\r\\n'), '^\\[(.*)\\]$', '\\1'), '\\s*"(?:[^"]|"")*"\\s*|[^{d}]+') as l from {t}))
      where piece not in ('', '""'))
qualify count(*) over (partition by row_id) >= 2"""

ORACLES = {
    "p2_found": " union all ".join(_JSON_PART.format(f=f) for f in JSON_COLUMNS),
    "p4_found": " union all ".join(
        _SPLIT_PART.format(f=f, t=t, k=k, d=d)
        for f, t, k, d in (("best_road_name", "geocoder_rows", "row_id", WIDE), ("evidence_sources", "candidate_boxes", "box_id", WIDE), ("evidence_labels", "candidate_boxes", "box_id", NARROW))
    ),
    "p6_found": """
with p as (select distinct point_id, easting_27700 as x, northing_27700 as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700)),
u as (select distinct UPRN as id, X_COORDINATE as x, Y_COORDINATE as y from uprn where isfinite(X_COORDINATE) and isfinite(Y_COORDINATE)),
b as (select distinct box_id, center_x as x, center_y as y, side_m as s from candidate_boxes where isfinite(center_x) and isfinite(center_y) and isfinite(side_m))
select distinct point_id, 'uprn_near' as rel, u.id as other_id from p, u where (p.x - u.x) * (p.x - u.x) + (p.y - u.y) * (p.y - u.y) <= 900 and abs(p.x - u.x) <= 30 and abs(p.y - u.y) <= 30
union all
select distinct point_id, 'in_box' as rel, cast(b.box_id as varchar) as other_id from p, b where abs(p.x - b.x) <= b.s / 2 and abs(p.y - b.y) <= b.s / 2""",
}
