"""Queries that gather evidence: scans, lookups in the gazetteer, candidate lists, neighbourhoods of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.functions import extract as X
from parcelforge.functions import geometry as G
from parcelforge.functions import similarity as M
from parcelforge.functions import text as N
from parcelforge.operators import ranking as R
from parcelforge.operators.spatial import finite, inside_polygons, near_in_group

BOX = (50000.0, 28000.0, 60000.0, 40000.0)


def topographic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of land and buildings with an id: the reference number, else the candidate's own, marked by source."""
    p = table(spark, sf_dir, "polygon_candidates").where(F.col("candidate_theme").rlike("(?i)land|building"))
    return p.select("row_id", F.concat_ws(":", "candidate_source", N.first_filled(F.col("candidate_toid"), F.col("candidate_id"))).alias("object"), N.number(F.col("candidate_area_m2")).alias("area"))


def uprn_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "uprn")
    return u.where(F.col("X_COORDINATE").between(BOX[0], BOX[2]) & F.col("Y_COORDINATE").between(BOX[1], BOX[3])).select("UPRN", "X_COORDINATE", "Y_COORDINATE").distinct()


def road_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "open_names").where(F.col("LOCAL_TYPE") == "Named Road").select(N.plain_upper(F.col("NAME1")).alias("name"))
    return n.where((F.length("name") >= 6) & F.element_at(F.split("name", " "), -1).isin(*X.SUFFIXES)).distinct()


def name_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of places, and of features that no road and no place bears."""
    o = table(spark, sf_dir, "open_names").select(N.plain_upper(F.col("NAME1")).alias("name"), "TYPE")
    of = lambda t: o.where(F.col("TYPE") == t).select("name").distinct()
    places, roads, features = of("populatedPlace"), of("transportNetwork"), of("landform")
    return places.select("name", F.lit("place").alias("kind")).unionByName(features.join(roads, "name", "left_anti").join(places, "name", "left_anti").select("name", F.lit("feature").alias("kind")))


def gazetteer_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "name_candidates").select("cand_no", F.upper(F.trim("name")).alias("u"))
    o = table(spark, sf_dir, "open_names").select("ID", F.upper("NAME1").alias("u"))
    return c.join(o, "u").select("cand_no", "ID")


def gazetteer_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer names that hold a candidate's long words (four letters, four words at most) in order; the join is by the first of
    them, which the name must hold, so no candidate is tried against every name."""
    c = table(spark, sf_dir, "name_candidates").select("cand_no", F.slice(F.filter(N.words(N.plain_upper(F.col("name"))), lambda w: F.length(w) >= 4), 1, 4).alias("w")).where(F.size("w") > 0)
    c = c.select("cand_no", F.concat(F.lit("%"), F.array_join("w", "%"), F.lit("%")).alias("pattern"), F.substring(F.col("w")[0], 1, 4).alias("start"))
    o = table(spark, sf_dir, "open_names").select("ID", N.plain_upper(F.col("NAME1")).alias("n"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("n") - 3, F.lit(1))), lambda i: F.substring(F.col("n"), i, F.lit(4))))
    o = o.select("ID", "n", F.explode(grams).alias("start"))
    return c.join(o, "start").where(F.expr("n like pattern")).select("cand_no", "ID").distinct()


def prefix_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads whose words begin with all words of a candidate and go on."""
    c = table(spark, sf_dir, "name_candidates").select("cand_no", N.plain_upper(F.col("name")).alias("p")).where("p <> ''")
    w = N.words(N.plain_upper(F.col("NAME1")))
    o = table(spark, sf_dir, "open_names").withColumn("w", w).where(F.size("w") > 1)
    o = o.select("ID", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda n: F.array_join(F.slice("w", 1, n), " "))).alias("p"))
    return c.join(o, "p").select("cand_no", "ID")


def tiered_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best gazetteer entry of a candidate: same name 1.0, abbreviations written out 0.94, without spaces 0.9."""
    c = table(spark, sf_dir, "name_candidates").select("cand_no", "name")
    o = table(spark, sf_dir, "open_names").select("ID", "NAME1")
    tiers = ((1.0, N.plain_upper), (0.94, N.expanded), (0.9, lambda x: N.expanded(x, joiner="")))
    hits = None
    for score, f in tiers:
        h = c.select("cand_no", f(F.col("name")).alias("k")).where("k <> ''").join(o.select("ID", f(F.col("NAME1")).alias("k")), "k").select("cand_no", "ID", F.lit(score).alias("score"))
        hits = h if hits is None else hits.unionByName(h)
    return hits.groupBy("cand_no").agg(F.min_by("ID", F.struct(-F.col("score"), "ID")).alias("ID"), F.max("score").alias("score"))


def place_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places named in the parts of an address, with the part's place."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", F.posexplode(F.split("original_address", ",")).alias("part", "t"))
    p = table(spark, sf_dir, "open_names").where(F.col("TYPE") == "populatedPlace").select(N.plain_upper(F.col("NAME1")).alias("k")).distinct()
    return g.select("row_id", "part", N.plain_upper(F.col("t")).alias("k")).join(p, "k").select("row_id", "part", F.col("k").alias("place"))


def pool_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 of each row's candidate list, typed; anything but a list of objects gives none."""
    listed = F.try_variant_get(F.try_parse_json("os_fallback_pool_json"), "$", "array<variant>")  # elements may be of any kind
    c = table(spark, sf_dir, "geocoder_rows").select("row_id", F.posexplode(F.slice(listed, 1, 25)).alias("pos", "c"))
    get = lambda name, kind: F.try_variant_get("c", f"$.{name}", kind).alias(name)
    c = c.where(F.schema_of_variant("c").startswith("OBJECT")).select("row_id", "pos", get("address", "string"), get("road_name", "string"), get("place", "string"), get("text_similarity", "double"))
    return c.where("address is not null")


def pool_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool candidate whose address is the row's final one, letter for letter but for signs and case; the first, if several."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.compact(F.col("best_address_final")).alias("k")).where("k <> ''")
    c = pool_candidates(spark, sf_dir).select("row_id", "pos", N.compact(F.col("address")).alias("k"))
    return g.join(c, ["row_id", "k"]).groupBy("row_id").agg(F.min("pos").alias("pos"))


def best_text_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool candidate of a row that shares most words with its address; ties by position."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.words(N.expanded(F.col("original_address"))).alias("w"))
    c = pool_candidates(spark, sf_dir).join(g, "row_id").withColumn("s", F.round(M.jaccard(F.col("w"), N.words(N.expanded(F.col("address")))), 9))
    return c.groupBy("row_id").agg(F.max("s").alias("score"), F.min_by("pos", F.struct(-F.col("s"), "pos")).alias("pos"))


def evidence_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case: its own variant before others, with a point before without, then by confidence and row."""
    g = table(spark, sf_dir, "geocoder_rows").where("unique_key is not null")
    own = F.coalesce(F.col("variant_key") == F.col("unique_key"), F.lit(False))
    placed = finite(F.col("best_easting_27700_final"), F.col("best_northing_27700_final"))
    return g.groupBy("unique_key").agg(F.max_by("row_id", F.struct(own, placed, F.coalesce(N.number(F.col("best_confidence")), F.lit(-1.0)), -F.col("row_id"))).alias("row_id"), F.count(F.lit(1)).alias("rows"))


def plan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most eight plan pages of each folder, in order of name."""
    p = table(spark, sf_dir, "ocr_evidence").select("prefix", F.explode("plan_pages").alias("page")).where("page is not null and prefix is not null").distinct()
    return R.placed(p, "prefix", [F.col("page")], "n").where("n <= 8")


def road_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Midpoints of a case's road candidates of different names at most 80 m apart, each pair once."""
    n = table(spark, sf_dir, "name_candidates").where((F.col("kind") == "road_candidate") & F.col("name").isNotNull()).select("case_key", "cand_no", N.expanded(F.col("name")).alias("road"), F.col("easting").alias("ax"), F.col("northing").alias("ay"))
    m = n.select("case_key", F.col("cand_no").alias("other"), F.col("road").alias("other_road"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    j = near_in_group(n, m, "case_key", ("ax", "ay"), ("bx", "by"), 80.0).where("cand_no < other and road <> other_road")
    return j.select("case_key", "cand_no", "other", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))


def far_road_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As road_pairs, for roads at most 20 km apart: how many pairs each candidate begins, and the nearest."""
    n = table(spark, sf_dir, "name_candidates").where((F.col("kind") == "road_candidate") & F.col("name").isNotNull()).select("case_key", "cand_no", N.expanded(F.col("name")).alias("road"), F.col("easting").alias("ax"), F.col("northing").alias("ay"))
    m = n.select("case_key", F.col("cand_no").alias("other"), F.col("road").alias("other_road"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    j = near_in_group(n, m, "case_key", ("ax", "ay"), ("bx", "by"), 20000.0).where("cand_no < other and road <> other_road")
    return j.groupBy("cand_no").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.min("distance_m"), 6).alias("nearest"))


def cases_without_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that no point candidate, or no box, is for."""
    c = table(spark, sf_dir, "cases").select("unique_key").distinct()
    missing = lambda t: c.join(table(spark, sf_dir, t).select(F.col("case_key").alias("unique_key")), "unique_key", "left_anti").select("unique_key", F.lit(t).alias("missing"))
    return missing("point_candidates").unionByName(missing("candidate_boxes"))


def centre_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box: points of its case within 140 m of its centre, how many sources they have, and the nearest."""
    b = table(spark, sf_dir, "candidate_boxes").select("case_key", "box_id", "center_x", "center_y")
    p = table(spark, sf_dir, "point_candidates").select("case_key", "point_id", F.col("source").alias("point_source"), "easting_27700", "northing_27700").distinct()
    j = near_in_group(b, p, "case_key", ("center_x", "center_y"), ("easting_27700", "northing_27700"), 140.0)
    return j.groupBy("box_id").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("point_source").alias("sources"), F.round(F.min("distance_m"), 6).alias("nearest"))


def point_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a case and source in one 2 m cell: the best of them."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700")) & F.col("case_key").isNotNull())
    s = F.coalesce(N.number(F.col("score")), F.lit(-1e9))
    return p.groupBy("case_key", "source", F.bround(F.col("easting_27700") / 2).alias("cx"), F.bround(F.col("northing_27700") / 2).alias("cy")).agg(F.max_by("point_id", F.struct(s, -F.col("point_id"))).alias("point_id"))


def case_uprns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address points in each case's polygon."""
    cases = table(spark, sf_dir, "cases").select("unique_key", "geom")
    held = inside_polygons(table(spark, sf_dir, "uprn"), cases, ("UPRN", "X_COORDINATE", "Y_COORDINATE"), ("unique_key", "geom"))
    return held.groupBy(F.col("polygon_id").alias("unique_key")).agg(F.count_distinct("id").alias("uprns"))


def grid_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "open_names").select("ID", (N.number(F.col("GEOMETRY_X")) / 1e5 - 6).alias("lon"), (N.number(F.col("GEOMETRY_Y")) / 1e6 * 9 + 50).alias("lat")).where("lon is not null and lat is not null")
    g = G.national_grid(F.col("lon"), F.col("lat"))
    return o.select("ID", F.round(g["easting"], 3).alias("easting"), F.round(g["northing"], 3).alias("northing"))


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each vector with the mean of its label's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    mean = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot("v", "v") * dot("m", "m"))
    return e.join(mean, "label").select("vec_id", F.round(F.when(norm > 0, dot("v", "m") / norm), 6).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    topographic_scan, uprn_in_box, road_names, name_sets, gazetteer_exact, gazetteer_like, prefix_extension, tiered_resolve, place_hints, pool_candidates, pool_match, best_text_candidate,
    evidence_pick, plan_pages, road_pairs, far_road_pairs, cases_without_points, centre_scores, point_cells, case_uprns, grid_projection, vector_cosine,
)}

_ABBR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.ABBREVIATIONS.items()) + "}"


def _up(c: str) -> str:
    return f"trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'))"


def _exp(c: str, joiner: str = " ") -> str:
    return f"array_to_string(list_transform(list_filter(string_split({_up(c)}, ' '), lambda w: w <> ''), lambda w: coalesce({_ABBR}[w], w)), '{joiner}')"


_POOL = """pool as (select row_id, cast(i as int) as pos, json_extract_string(c, '$.address') as address, json_extract_string(c, '$.road_name') as road_name, json_extract_string(c, '$.place') as place,
  try_cast(json_extract_string(c, '$.text_similarity') as double) as text_similarity
  from (select row_id, i, json_extract(j, '$[' || i || ']') as c from (select row_id, j, unnest(range(cast(least(json_array_length(j), 25) as bigint))) as i from (select row_id, os_fallback_pool_json as j from geocoder_rows where json_valid(os_fallback_pool_json) and json_type(os_fallback_pool_json) = 'ARRAY')))
  where json_type(c) = 'OBJECT' and json_extract_string(c, '$.address') is not null)"""

ORACLES = {
    "far_road_pairs": f"""with n as (select case_key, cand_no, {_exp('name')} as road, easting as x, northing as y from name_candidates where kind = 'road_candidate' and name is not null and case_key is not null and isfinite(easting) and isfinite(northing)),
      j as (select a.cand_no, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from n a join n b on a.case_key = b.case_key and a.cand_no < b.cand_no and a.road <> b.road) select cand_no, count(*) as pairs, round(min(d), 6) as nearest from j where d <= 20000 group by 1""",
    "cases_without_points": "select distinct unique_key, 'point_candidates' as missing from cases where unique_key not in (select case_key from point_candidates where case_key is not null) union all select distinct unique_key, 'candidate_boxes' from cases where unique_key not in (select case_key from candidate_boxes where case_key is not null)",

    "topographic_scan": """select row_id, concat_ws(':', candidate_source, coalesce(case when trim(candidate_toid) <> '' then candidate_toid end, case when trim(candidate_id) <> '' then candidate_id end)) as object,
      case when isfinite(candidate_area_m2) then candidate_area_m2 end as area from polygon_candidates where regexp_matches(candidate_theme, '(?i)land|building')""",
    "uprn_in_box": f"select distinct UPRN, X_COORDINATE, Y_COORDINATE from uprn where X_COORDINATE between {BOX[0]} and {BOX[2]} and Y_COORDINATE between {BOX[1]} and {BOX[3]}",
    "road_names": f"select distinct name from (select {_up('NAME1')} as name from open_names where LOCAL_TYPE = 'Named Road') where length(name) >= 6 and list_last(string_split(name, ' ')) in ({', '.join(repr(s) for s in X.SUFFIXES)})",
    "name_sets": f"""with o as (select {_up('NAME1')} as name, TYPE as t from open_names) select distinct name, 'place' as kind from o where t = 'populatedPlace'
      union all select distinct name, 'feature' from o where t = 'landform' and name not in (select name from o where t in ('transportNetwork', 'populatedPlace'))""",
    "gazetteer_exact": "select cand_no, ID from name_candidates join open_names on upper(trim(name, ' ')) = upper(NAME1)",
    "gazetteer_like": f"""with c as (select cand_no, list_filter(string_split({_up('name')}, ' '), lambda w: length(w) >= 4)[1:4] as w from name_candidates), p as (select cand_no, '%' || array_to_string(w, '%') || '%' as p from c where len(w) > 0)
      select cand_no, ID from p join (select ID, {_up('NAME1')} as n from open_names) o on n like p""",
    "prefix_extension": f"select cand_no, ID from (select cand_no, {_up('name')} as p from name_candidates) c join (select ID, {_up('NAME1')} as n from open_names) o on starts_with(n, p || ' ') where p <> ''",
    "tiered_resolve": f"""with h as (select cand_no, ID, s from (select cand_no, unnest([{_up('name')}, {_exp('name')}, {_exp('name', '')}]) as k, unnest([1.0::double, 0.94, 0.9]) as s from name_candidates) c
      join (select ID, unnest([{_up('NAME1')}, {_exp('NAME1')}, {_exp('NAME1', '')}]) as k2, unnest([1.0::double, 0.94, 0.9]) as s2 from open_names) o on k = k2 and s = s2 where k <> '')
      select cand_no, arg_min(ID, (-s, ID)) as ID, max(s) as score from h group by 1""",
    "place_hints": f"""with g as (select row_id, cast(unnest(range(len(p))) as int) as part, unnest(p) as t from (select row_id, string_split(original_address, ',') as p from geocoder_rows where original_address is not null))
      select row_id, part, {_up('t')} as place from g where {_up('t')} in (select {_up('NAME1')} from open_names where TYPE = 'populatedPlace')""",
    "pool_candidates": f"with {_POOL} select row_id, pos, address, road_name, place, text_similarity from pool",
    "pool_match": f"with {_POOL} select g.row_id, min(pos) as pos from geocoder_rows g join pool p on p.row_id = g.row_id and regexp_replace(upper(address), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(best_address_final), '[^A-Z0-9]', '', 'g') where regexp_replace(upper(best_address_final), '[^A-Z0-9]', '', 'g') <> '' group by 1",
    "best_text_candidate": f"""with {_POOL}, j as (select p.row_id, pos, list_distinct(string_split({_exp('original_address')}, ' ')) as a, list_distinct(string_split({_exp('address')}, ' ')) as b, original_address as o from pool p join geocoder_rows g using (row_id)),
      s as (select row_id, pos, case when o is null then 0 else round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 9) end as s from j)
      select row_id, max(s) as score, arg_min(pos, (-s, pos)) as pos from s group by 1""",
    "evidence_pick": """select unique_key, arg_max(row_id, (coalesce(variant_key = unique_key, false), coalesce(isfinite(best_easting_27700_final) and isfinite(best_northing_27700_final), false), coalesce(case when isfinite(best_confidence) then best_confidence end, -1), -row_id)) as row_id, count(*) as rows
      from geocoder_rows where unique_key is not null group by 1""",
    "plan_pages": "select prefix, page, cast(n as int) as n from (select prefix, page, row_number() over (partition by prefix order by page) as n from (select distinct prefix, unnest(plan_pages) as page from ocr_evidence where prefix is not null) where page is not null) where n <= 8",
    "road_pairs": f"""with n as (select case_key, cand_no, {_exp('name')} as road, easting as x, northing as y from name_candidates where kind = 'road_candidate' and name is not null and isfinite(easting) and isfinite(northing) and case_key is not null)
      select a.case_key, a.cand_no, b.cand_no as other, (a.x + b.x) / 2 as x, (a.y + b.y) / 2 as y from n a join n b on a.case_key = b.case_key and a.cand_no < b.cand_no and a.road <> b.road where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 80""",
    "centre_scores": """with p as (select distinct case_key, point_id, source, easting_27700 as x, northing_27700 as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700)),
      b as (select case_key, box_id, center_x as x, center_y as y from candidate_boxes where isfinite(center_x) and isfinite(center_y)),
      j as (select box_id, source, sqrt((b.x - p.x) * (b.x - p.x) + (b.y - p.y) * (b.y - p.y)) as d from b join p using (case_key)) select box_id, count(*) as points, count(distinct source) as sources, round(min(d), 6) as nearest from j where d <= 140 group by 1""",
    "point_cells": """select case_key, source, round_even(easting_27700 / 2, 0) as cx, round_even(northing_27700 / 2, 0) as cy, arg_max(point_id, (coalesce(case when isfinite(score) then score end, -1e9), -point_id)) as point_id
      from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) and case_key is not null group by 1, 2, 3, 4""",
    "vector_cosine": """with e as (select vec_id, label, unnest(range(len(embedding))) as i, unnest(embedding)::double as x from embeddings), m as (select label, i, avg(x) as m from e group by 1, 2)
      select vec_id, round(case when sum(x * x) * sum(m * m) > 0 then sum(x * m) / sqrt(sum(x * x) * sum(m * m)) end, 6) as cosine from e join m using (label, i) group by 1""",
}
