"""Queries over the joins, ranks, aggregates, spatial operators and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.functions import geometry as G
from parcelforge.functions import text as N
from parcelforge.operators import joins as J
from parcelforge.operators import ranking as R
from parcelforge.operators import sampling as S
from parcelforge.operators.cluster import single_link
from parcelforge.operators.ordered import following, running_total
from parcelforge.operators.spatial import finite, within_distance
from parcelforge.operators.suppress import suppress

TOP = 5


def _order() -> list:
    return R.canonical_order("rule_rank", "score", "candidate_id")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counting row of each candidate of a case, with a finite score or none."""
    p = table(spark, sf_dir, "polygon_candidates").where("case_key is not null").select(
        "case_key", "candidate_id", "row_id", "loaded_at", "rule_rank", N.number(F.col("rule_score")).alias("score"), N.number(F.col("best_confidence")).alias("confidence"),
        N.number(F.col("candidate_centroid_easting")).alias("x"), N.number(F.col("candidate_centroid_northing")).alias("y"), N.number(F.col("candidate_area_m2")).alias("area"),
        N.number(F.col("distance_to_best_point_m")).alias("to_point"), N.number(F.col("distance_to_mentioned_road_m")).alias("to_road"), "covers_best_point", "candidate_source", "uprn_count", "roi_intersects_count",
    )
    return R.latest_rows(p, ["case_key", "candidate_id"], ["loaded_at", "row_id"])


def rank_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.placed(_candidates(spark, sf_dir), "case_key", _order(), "place").where(F.col("place") <= TOP).select("case_key", "candidate_id", "place")


def rank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.coalesce("to_point", F.lit(1e9)), F.col("area").asc_nulls_last(), F.col("candidate_id")]
    return R.placed(_candidates(spark, sf_dir), "case_key", order, "place").where(F.col("place") <= TOP).select("case_key", "candidate_id", "place")


def rank_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = [F.col("to_road").asc_nulls_last(), F.col("candidate_id")]
    out = R.portfolio(_candidates(spark, sf_dir), "case_key", _order(), other, 3, 1, TOP, ~F.col("covers_best_point") & (F.col("to_road") <= 12))
    return out.select("case_key", "candidate_id", "place", "bucket")


def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = R.placed(_candidates(spark, sf_dir).where("score is not null"), "case_key", [F.desc("score"), F.col("candidate_id")], "n").where("n <= 2")
    first, second = F.max(F.when(F.col("n") == 1, F.col("score"))), F.max(F.when(F.col("n") == 2, F.col("score")))
    return two.groupBy("case_key").agg(F.max(F.when(F.col("n") == 1, F.col("candidate_id"))).alias("candidate_id"), first.alias("score"), (first - second).alias("margin"))


def _hits(candidates: DataFrame) -> DataFrame:
    return R.first_hits(candidates, "case_key", R.order_key("rule_rank", "score", "candidate_id"), F.col("covers_best_point"))


def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_candidates(spark, sf_dir))


def top_k_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k_rates(first_hit(spark, sf_dir), [1, 3, 5, 10, 20, 50])


def band_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    per = c.groupBy("case_key").agg(F.max("confidence").alias("confidence")).join(_hits(c), "case_key")
    band = F.when(F.col("confidence") < 0.75, "low").when(F.col("confidence") < 0.8, "middle").otherwise("high")
    return per.where("confidence is not null").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("first_hit") <= TOP).alias("hits"))


def recovered_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    base = _hits(c).select("case_key", F.coalesce(F.col("first_hit") <= TOP, F.lit(False)).alias("was"))
    by_score = F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("s"), F.col("candidate_id").alias("i"))
    new = R.first_hits(c, "case_key", by_score, F.col("covers_best_point")).select("case_key", F.coalesce(F.col("first_hit") <= TOP, F.lit(False)).alias("now"))
    both = base.join(new, "case_key", "full")
    gain, loss = F.count_if(~F.col("was") & F.col("now")), F.count_if(F.col("was") & ~F.col("now"))
    return both.agg(gain.alias("recovered"), loss.alias("lost"), (gain - loss).alias("net"))


def miss_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = first_hit(spark, sf_dir)
    kind = F.when(F.col("first_hit") == 1, "top").when(F.col("first_hit") <= TOP, "rescued").when(F.col("first_hit").isNotNull(), "too_deep").otherwise("absent")
    return h.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("candidates"), 6).alias("mean_candidates"), F.percentile("candidates", F.lit(0.5)).alias("median_candidates"))


def gate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gate of a parameter table over all candidates: a bounded table, joined by broadcast."""
    gates = spark.createDataFrame([(r, float(a)) for r in (5, 20, 50) for a in (500, 5000, 100000)], "most_rank int, most_area double")
    c = R.placed(_candidates(spark, sf_dir), "case_key", _order(), "place").where("place <= 50")
    per = c.join(F.broadcast(gates), (F.col("place") <= F.col("most_rank")) & (F.col("area") <= F.col("most_area"))).groupBy("most_rank", "most_area", "case_key").agg(F.max(F.col("covers_best_point").cast("int")).alias("hit"))
    return per.groupBy("most_rank", "most_area").agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))


def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return c.groupBy("candidate_source").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("case_key").alias("cases"), F.percentile("area", F.lit(0.5)).alias("median_area"), F.max("uprn_count").alias("most_uprn"))


def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = R.latest_rows(table(spark, sf_dir, "cases").select("unique_key", "chargegeog", "postcode", "loaded_at"), ["unique_key"], ["loaded_at", "chargegeog", "postcode"])
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", "key")
    out = J.with_fallback(g, cases, F.col("key"), N.base_key(F.col("key")), "unique_key", ["postcode"])
    return out.select("row_id", "key", "postcode", "by_key", "matched")


def missing_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows").select(N.base_key(F.col("key")).alias("unique_key")).where("unique_key is not null").distinct()
    return g.join(table(spark, sf_dir, "cases"), "unique_key", "left_anti")


def folder_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and phrases of a case's scan folder; two cases can share one."""
    c = table(spark, sf_dir, "cases").select("unique_key", N.last_path_part(F.col("FilePath")).alias("prefix")).distinct()
    e = table(spark, sf_dir, "ocr_evidence").groupBy("prefix").agg(F.sum("pages").alias("pages"), F.sum("high_text_count").alias("high_text"), F.sum(F.size(F.coalesce("road_phrases", F.array().cast("array<string>")))).alias("phrases"))
    return c.join(e, "prefix", "left").select("unique_key", "prefix", "pages", "high_text", "phrases")


def shared_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that share a compact address with another row, and how many do: no pairs."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.compact(F.col("original_address")).alias("k")).where("k <> ''")
    return g.join(g.groupBy("k").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "k").select("row_id", "rows")


def list_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes before points at one place of a case: per metre, source kept, the first of a case's places."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700")) & F.col("case_key").isNotNull())
    a = p.select("case_key", F.lit(1).alias("list"), F.col("point_id").alias("id"), F.bround(F.col("easting_27700")).alias("x"), F.bround(F.col("northing_27700")).alias("y"))
    b = table(spark, sf_dir, "candidate_boxes").where(finite(F.col("center_x"), F.col("center_y")) & F.col("case_key").isNotNull())
    b = b.select("case_key", F.lit(0).alias("list"), F.col("box_id").alias("id"), F.bround(F.col("center_x")).alias("x"), F.bround(F.col("center_y")).alias("y"))
    return J.first_by(a.unionByName(b), ["case_key", "x", "y"], [F.col("list"), F.col("id")])


def filled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank addresses of rows filled from their case."""
    cases = R.latest_rows(table(spark, sf_dir, "cases").select("unique_key", "loaded_at", F.col("chargegeog").alias("original_address")), ["unique_key"], ["loaded_at", "original_address"])
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", "unique_key", "original_address")
    return J.filled_from(g, cases.select("unique_key", "original_address"), "unique_key", ["original_address"])


def cell_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in 10 m cells: how many, of how many sources, and the best."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700")))
    s = N.number(F.col("score"))
    return p.groupBy(F.bround(F.col("easting_27700") / 10).alias("cx"), F.bround(F.col("northing_27700") / 10).alias("cy")).agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("source").alias("sources"), F.max_by("point_id", F.struct(s, "point_id")).alias("best")
    )


def weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of the eight best points of each case, by score."""
    p = table(spark, sf_dir, "point_candidates").withColumn("w", N.number(F.col("score"))).where(finite(F.col("easting_27700"), F.col("northing_27700")) & (F.col("w") > 0) & F.col("case_key").isNotNull())
    p = p.select("case_key", "point_id", "w", F.col("easting_27700").alias("x"), F.col("northing_27700").alias("y")).distinct()
    top = R.placed(p, "case_key", [F.desc("w"), F.col("point_id")], "n").where("n <= 8")
    return top.groupBy("case_key").agg(F.round(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 6).alias("x"), F.round(F.sum(F.col("y") * F.col("w")) / F.sum("w"), 6).alias("y"), F.count(F.lit(1)).alias("points"))


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box of a case below the first, its overlap with the case's first box."""
    b = table(spark, sf_dir, "candidate_boxes").where(finite(F.col("center_x"), F.col("center_y"), F.col("side_m")) & F.col("case_key").isNotNull() & F.col("rank").isNotNull())
    b = b.select("case_key", "box_id", "rank", G.square(F.col("center_x"), F.col("center_y"), F.col("side_m")).alias("box"))
    first = b.groupBy("case_key").agg(F.min_by(F.struct("box", "box_id"), F.struct("rank", "box_id")).alias("f")).select("case_key", F.col("f.box").alias("first"), F.col("f.box_id").alias("first_id"))
    j = b.join(first, "case_key").where("box_id <> first_id")
    return j.select("box_id", F.round(G.box_overlap(F.col("box"), F.col("first")), 6).alias("shared"), F.round(G.box_iou(F.col("box"), F.col("first")), 9).alias("iou"))


def box_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each case's best point to each of its boxes, 0 inside."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700"), F.col("score")) & F.col("case_key").isNotNull())
    best = p.groupBy("case_key").agg(F.max_by(F.struct(F.col("easting_27700").alias("x"), F.col("northing_27700").alias("y")), F.struct("score", "point_id")).alias("p"))
    b = table(spark, sf_dir, "candidate_boxes").where(finite(F.col("center_x"), F.col("center_y"), F.col("side_m")))
    return b.join(best, "case_key").select("box_id", F.round(G.distance_to_box(F.col("p.x"), F.col("p.y"), G.square(F.col("center_x"), F.col("center_y"), F.col("side_m"))), 6).alias("metres"))


def box_union_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per case: does any box hold its best point, and the rank of the first that does."""
    d = box_distances(spark, sf_dir).join(table(spark, sf_dir, "candidate_boxes").select("box_id", "case_key", "rank"), "box_id")
    return d.groupBy("case_key").agg(F.count(F.lit(1)).alias("boxes"), F.bool_or(F.col("metres") == 0).alias("any_hit"), F.min(F.when(F.col("metres") == 0, F.col("rank"))).alias("first_rank"))


def point_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each case's points: the diagonal of their box, 0 for one point."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700")) & F.col("case_key").isNotNull())
    x, y = F.col("easting_27700"), F.col("northing_27700")
    return p.groupBy("case_key").agg(F.round(F.hypot(F.max(x) - F.min(x), F.max(y) - F.min(y)), 6).alias("diagonal"), F.count(F.lit(1)).alias("points"))


def nearest_uprn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each point the nearest address point within 100 m, and how many there are."""
    near = within_distance(table(spark, sf_dir, "point_candidates"), table(spark, sf_dir, "uprn"), ("point_id", "easting_27700", "northing_27700"), ("UPRN", "X_COORDINATE", "Y_COORDINATE"), 100.0)
    return near.groupBy(F.col("id").alias("point_id")).agg(F.min_by("other_id", F.struct("distance_m", "other_id")).alias("uprn"), F.round(F.min("distance_m"), 6).alias("metres"), F.count_distinct("other_id").alias("within"))


def road_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's road candidates in order as a line: length, and where along it its best point lies nearest."""
    n = table(spark, sf_dir, "name_candidates").where((F.col("kind") == "road_candidate") & finite(F.col("easting"), F.col("northing")) & F.col("case_key").isNotNull())
    s = following(n.select("case_key", "cand_no", F.col("easting").alias("ax"), F.col("northing").alias("ay")), [F.col("cand_no")], ["case_key"], {"bx": "ax", "by": "ay"}).where("bx is not null")
    s = s.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    s = running_total(s, [F.col("cand_no")], F.col("len"), "upto", within=["case_key"]).withColumn("before", F.col("upto") - F.col("len"))
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700"), F.col("score")))
    best = p.groupBy("case_key").agg(F.max_by(F.struct(F.col("easting_27700").alias("x"), F.col("northing_27700").alias("y")), F.struct("score", "point_id")).alias("p"))
    j = s.join(best, "case_key")
    args = [F.col(c) for c in ("p.x", "p.y", "ax", "ay", "bx", "by")]
    j = j.select("case_key", "cand_no", "len", (F.col("before") + G.along_segment(*args) * F.col("len")).alias("measure"), G.distance_to_segment(*args).alias("d"))
    return j.groupBy("case_key").agg(F.round(F.sum("len"), 3).alias("length"), F.round(F.min("d"), 3).alias("metres"), F.round(F.min_by("measure", F.struct("d", "cand_no")), 3).alias("measure"))


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points every 200 m between consecutive road candidates of a case."""
    n = table(spark, sf_dir, "name_candidates").where((F.col("kind") == "road_candidate") & finite(F.col("easting"), F.col("northing")) & F.col("case_key").isNotNull())
    s = following(n.select("case_key", "cand_no", F.col("easting").alias("ax"), F.col("northing").alias("ay")), [F.col("cand_no")], ["case_key"], {"bx": "ax", "by": "ay"}).where("bx is not null")
    s = s.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).where("len > 0")
    s = s.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("len") / 200))))
    t = F.col("step") * 200 / F.col("len")
    return s.select("cand_no", "step", F.round(F.col("ax") + t * (F.col("bx") - F.col("ax")), 3).alias("x"), F.round(F.col("ay") + t * (F.col("by") - F.col("ay")), 3).alias("y"))


def case_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases").select("unique_key", G.shape(F.col("geom")).alias("s")).distinct()
    return c.where("s.area is not null").select("unique_key", "s.*")


def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "open_names")
    lon, lat = N.number(F.col("GEOMETRY_X")) / 1e5 - 5, N.number(F.col("GEOMETRY_Y")) / 1e5 + 50
    o = o.select("ID", lon.alias("lon"), lat.alias("lat")).where("lon is not null and lat is not null")
    m, t = G.web_mercator(F.col("lon"), F.col("lat")), G.map_tile(F.col("lon"), F.col("lat"), 15)
    return o.select("ID", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"), t["x"].alias("tile_x"), t["y"].alias("tile_y"))


def kept_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres of a case, best first, none closer than 65 m to one kept before; eight at most."""
    b = table(spark, sf_dir, "candidate_boxes").withColumn("s", N.number(F.col("score")))
    order = [-F.coalesce("s", F.lit(-1e9)), F.col("box_id")]
    return suppress(b, "case_key", "center_x", "center_y", order, 65.0, 8).select("case_key", "box_id")


def diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five candidates of each case whose centroids lie at least 8 m apart."""
    c = _candidates(spark, sf_dir).where("x is not null and y is not null")
    order = [F.coalesce(F.col("rule_rank"), F.lit(2**31 - 1)), -F.coalesce("score", F.lit(-1e9)), F.col("candidate_id")]
    return suppress(c, "case_key", "x", "y", order, 8.0, TOP).select("case_key", "candidate_id")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box centres of a case joined by steps of up to 80 m, one row per cluster."""
    b = table(spark, sf_dir, "candidate_boxes").where(finite(F.col("center_x"), F.col("center_y")) & F.col("case_key").isNotNull())
    b = b.select("case_key", "box_id", "center_x", "center_y", "rank", N.number(F.col("score")).alias("s"))
    c = single_link(b, "case_key", "box_id", "center_x", "center_y", 80.0)
    j = b.join(c, ["case_key", "box_id"])
    return j.groupBy("case_key", "cluster").agg(F.count(F.lit(1)).alias("boxes"), F.min("rank").alias("best_rank"), F.round(F.sum("s"), 6).alias("sum_score"))


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with points, with boxes, with both and with points only."""
    p = table(spark, sf_dir, "point_candidates").select("case_key").where("case_key is not null").distinct()
    b = table(spark, sf_dir, "candidate_boxes").select("case_key").where("case_key is not null").distinct()
    named = lambda d, n: d.agg(F.count(F.lit(1)).alias("cases")).select(F.lit(n).alias("kind"), "cases")
    return named(p, "points").unionByName(named(b, "boxes")).unionByName(named(p.intersect(b), "both")).unionByName(named(p.exceptAll(b), "points_only")).unionByName(named(p.union(b).distinct(), "either"))


def case_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases").select("unique_key").distinct()
    return c.select("unique_key", S.fold(F.col("unique_key"), 5).alias("fold"))


def case_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cases of each source, repeatable: the sampling operator."""
    return S.sample_groups(table(spark, sf_dir, "polygon_candidates").where("case_key is not null"), "candidate_source", "case_key", 20, "7")


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "polygon_candidates")
    d = p.select("row_id", F.log1p(F.greatest(N.number(F.col("distance_to_best_point_m")), F.lit(0.0))).alias("d"), N.number(F.col("best_confidence")).alias("c"), (F.col("sample_split") == "train").alias("train"))
    out = S.standardised(d, ["d", "c"], F.coalesce("train", F.lit(False)))
    return out.select("row_id", F.round("z_d", 6).alias("z_d"), F.round("z_c", 6).alias("z_c"))


def theme_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.one_hot(table(spark, sf_dir, "polygon_candidates").select("row_id", "candidate_make"), "candidate_make", 3).drop("candidate_make")


def support_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source by case: pivot of candidate counts, for a fixed list of sources."""
    sources = ["council_cadastral", "merged_wfs", "raw_wfs"]
    c = _candidates(spark, sf_dir).groupBy("case_key").agg(*[F.count_if(F.col("candidate_source") == s).alias(s) for s in sources])
    return c.withColumn("most", F.greatest(*sources))


def score_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rescored candidates: last score minus first."""
    p = table(spark, sf_dir, "polygon_candidates").where("case_key is not null").withColumn("s", N.number(F.col("rule_score"))).where("s is not null")
    g = p.groupBy("case_key", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("s", F.struct("loaded_at", "row_id")).alias("first"), F.max_by("s", F.struct("loaded_at", "row_id")).alias("last"))
    d = F.col("last") - F.col("first")
    kind = F.when(d > 1, "better").when(d < -1, "worse").otherwise("same")
    return g.where("n > 1").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("candidates"), F.round(F.avg(d), 6).alias("mean_delta"))


QUERIES = {f.__name__: f for f in (
    rank_rule, rank_by_score, rank_portfolio, score_margin, first_hit, top_k_hits, band_hits, recovered_lost, miss_kinds, gate_sweep, source_summary, fallback_join, missing_cases,
    folder_evidence, shared_addresses, list_merge, filled_cases, cell_buckets, weighted_centroids, box_overlaps, box_distances, box_union_hits, point_spread, nearest_uprn, road_chain,
    line_samples, case_shapes, projections, kept_centres, diverse_top, clustered, set_algebra, case_folds, case_sample, scaled_features, theme_columns, support_counts, score_deltas,
)}

_FIN = "case when isfinite({0}) then {0} end"
_C = f"""c as (select * from (select case_key, candidate_id, row_id, rule_rank, {_FIN.format('rule_score')} as score, {_FIN.format('best_confidence')} as confidence, {_FIN.format('candidate_area_m2')} as area,
  {_FIN.format('distance_to_best_point_m')} as to_point, {_FIN.format('distance_to_mentioned_road_m')} as to_road, covers_best_point, candidate_source, uprn_count,
  {_FIN.format('candidate_centroid_easting')} as x, {_FIN.format('candidate_centroid_northing')} as y,
  row_number() over (partition by case_key, candidate_id order by loaded_at desc, row_id desc) as k from polygon_candidates where case_key is not null) where k = 1),
r as (select *, row_number() over (partition by case_key order by rule_rank asc nulls last, score desc nulls last, candidate_id) as place from c),
h as (select case_key, count(*) as candidates, min(place) filter (covers_best_point) as first_hit from r group by case_key)"""


def walk(metres: float, keep: int) -> str:
    """SQL of the greedy pass, row by row: z (case_key, id, x, y, n) to w (case_key, id) of those kept."""
    return f"""step as (select case_key, n, [id] as ids, [x] as xs, [y] as ys from z where n = 1 union all
        select case_key, m, case when k then list_append(ids, id) else ids end, case when k then list_append(xs, x) else xs end, case when k then list_append(ys, y) else ys end
        from (select step.*, z.id, z.x, z.y, z.n as m, len(list_filter(range(1, len(xs) + 1), lambda i: sqrt((z.x - xs[i]) * (z.x - xs[i]) + (z.y - ys[i]) * (z.y - ys[i])) < {metres})) = 0 as k from step join z on z.case_key = step.case_key and z.n = step.n + 1 where len(ids) < {keep}) t),
      w as (select case_key, unnest(ids) as id from (select case_key, ids from step qualify n = max(n) over (partition by case_key)))"""


_BOX = "b as (select case_key, box_id, rank, center_x - side_m / 2 as x1, center_y - side_m / 2 as y1, center_x + side_m / 2 as x2, center_y + side_m / 2 as y2 from candidate_boxes where isfinite(center_x) and isfinite(center_y) and isfinite(side_m))"
_BEST = "best as (select case_key, easting_27700 as x, northing_27700 as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) and isfinite(score) and case_key is not null qualify row_number() over (partition by case_key order by score desc, point_id desc) = 1)"
_DIST = f"with {_BOX}, {_BEST}, d as (select box_id, b.case_key, rank, round(sqrt(greatest(x1 - x, 0, x - x2) * greatest(x1 - x, 0, x - x2) + greatest(y1 - y, 0, y - y2) * greatest(y1 - y, 0, y - y2)), 6) as metres from b join best using (case_key))"
_SEG = """s as (select case_key, cand_no, easting as ax, northing as ay, lead(easting) over w as bx, lead(northing) over w as by_ from name_candidates
  where kind = 'road_candidate' and isfinite(easting) and isfinite(northing) and case_key is not null window w as (partition by case_key order by cand_no))"""
_CASES = "k as (select unique_key, chargegeog, postcode from cases qualify row_number() over (partition by unique_key order by loaded_at desc nulls last, chargegeog desc nulls last, postcode desc nulls last) = 1)"

ORACLES = {
    "kept_centres": f"with recursive z as (select case_key, box_id as id, center_x as x, center_y as y, row_number() over (partition by case_key order by coalesce({_FIN.format('score')}, -1e9) desc, box_id) as n from candidate_boxes where case_key is not null and isfinite(center_x) and isfinite(center_y)), {walk(65.0, 8)} select case_key, id as box_id from w",
    "diverse_top": f"with recursive {_C}, z as (select case_key, candidate_id as id, x, y, row_number() over (partition by case_key order by coalesce(rule_rank, 2147483647), coalesce(score, -1e9) desc, candidate_id) as n from c where x is not null and y is not null), {walk(8.0, 5)} select case_key, id as candidate_id from w",
    "clustered": f"""with recursive z as (select case_key, box_id, center_x as x, center_y as y, rank, {_FIN.format('score')} as s from candidate_boxes where case_key is not null and isfinite(center_x) and isfinite(center_y)),
      near as (select a.case_key, a.box_id as u, b.box_id as v from z a join z b on a.case_key = b.case_key and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 80),
      reach as (select u, v from near union select reach.u, near.v from reach join near on near.u = reach.v), l as (select u as box_id, min(v) as cluster from reach group by 1)
      select case_key, cluster, count(*) as boxes, min(rank) as best_rank, round(sum(s), 6) as sum_score from z join l using (box_id) group by 1, 2""",

    "rank_rule": f"with {_C} select case_key, candidate_id, cast(place as int) as place from r where place <= 5",
    "rank_by_score": f"with {_C} select case_key, candidate_id, cast(place as int) as place from (select *, row_number() over (partition by case_key order by score desc nulls last, coalesce(to_point, 1e9), area asc nulls last, candidate_id) as place from c) where place <= 5",
    "rank_portfolio": f"""with {_C}, e as (select *, place > 3 and coalesce(not covers_best_point, false) and coalesce(to_road <= 12, false) as rest from r),
      f as (select case_key, candidate_id, place, rest, row_number() over (partition by case_key order by case when rest then 0 else 1 end, to_road asc nulls last, candidate_id) as o from e),
      g as (select *, case when place <= 3 then 'base' when rest and o <= 1 then 'other' else 'rest' end as bucket from f)
      select case_key, candidate_id, cast(p as int) as place, bucket from (select case_key, candidate_id, bucket, row_number() over (partition by case_key order by case bucket when 'base' then 0 when 'other' then 1 else 2 end, place) as p from g) where p <= 5""",
    "score_margin": f"with {_C} select case_key, candidate_id, score, score - nxt as margin from (select *, row_number() over w as n, lead(score) over w as nxt from c where score is not null window w as (partition by case_key order by score desc, candidate_id)) where n = 1",
    "first_hit": f"with {_C} select case_key, candidates, cast(first_hit as int) as first_hit from h",
    "top_k_hits": f"with {_C} select k, (select count(*) from h) as groups, (select count(*) from h where first_hit <= k) as hits, (select count(*) from h where first_hit <= k) / (select count(*) from h) as rate from (values (1), (3), (5), (10), (20), (50)) v(k)",
    "band_hits": f"with {_C}, p as (select case_key, max(confidence) as confidence, min(place) filter (covers_best_point) as hit from r group by case_key) select case when confidence < 0.75 then 'low' when confidence < 0.8 then 'middle' else 'high' end as band, count(*) as cases, count(*) filter (hit <= 5) as hits from p where confidence is not null group by 1",
    "recovered_lost": f"""with {_C}, q as (select *, row_number() over (partition by case_key order by score desc nulls last, candidate_id) as p2 from r), z as (select case_key, coalesce(min(place) filter (covers_best_point) <= 5, false) as was, coalesce(min(p2) filter (covers_best_point) <= 5, false) as now_ from q group by case_key)
      select count(*) filter (now_ and not was) as recovered, count(*) filter (was and not now_) as lost, count(*) filter (now_ and not was) - count(*) filter (was and not now_) as net from z""",
    "miss_kinds": f"with {_C} select case when first_hit = 1 then 'top' when first_hit <= 5 then 'rescued' when first_hit is not null then 'too_deep' else 'absent' end as kind, count(*) as cases, round(avg(candidates), 6) as mean_candidates, median(candidates) as median_candidates from h group by 1",
    "gate_sweep": f"""with {_C}, v as (select * from (values (5), (20), (50)) a(most_rank), (values (500.0::double), (5000.0), (100000.0)) b(most_area)), z as (select most_rank, most_area, case_key, max(covers_best_point::int) as hit from r join v on place <= most_rank and area <= most_area group by all)
      select most_rank, most_area, count(*) as cases, cast(coalesce(sum(hit), 0) as bigint) as hits from z group by all""",
    "source_summary": f"with {_C} select candidate_source, count(*) as candidates, count(distinct case_key) as cases, median(area) as median_area, max(uprn_count) as most_uprn from c group by 1",
    "fallback_join": f"with {_CASES} select row_id, g.key, case when a.unique_key is not null then a.postcode else b.postcode end as postcode, a.unique_key is not null as by_key, a.unique_key is not null or b.unique_key is not null as matched from geocoder_rows g left join k a on a.unique_key = g.key left join k b on b.unique_key = regexp_replace(g.key, '_\\d+$', '')",
    "missing_cases": "select distinct regexp_replace(key, '_\\d+$', '') as unique_key from geocoder_rows where key is not null and regexp_replace(key, '_\\d+$', '') not in (select unique_key from cases where unique_key is not null)",
    "folder_evidence": """with c as (select distinct unique_key, regexp_extract(replace(FilePath, '\\', '/'), '([^/]*)$', 1) as prefix from cases), e as (select prefix, cast(sum(pages) as bigint) as pages, cast(sum(high_text_count) as bigint) as high_text, cast(sum(coalesce(len(road_phrases), 0)) as bigint) as phrases from ocr_evidence group by 1)
      select unique_key, prefix, pages, high_text, phrases from c left join e using (prefix)""",
    "shared_addresses": "with g as (select row_id, regexp_replace(upper(original_address), '[^A-Z0-9]', '', 'g') as k from geocoder_rows) select row_id, n as rows from (select row_id, k, count(*) over (partition by k) as n from g where k <> '') where n > 1",
    "list_merge": """with u as (select case_key, 1 as list, point_id as id, round_even(easting_27700, 0) as x, round_even(northing_27700, 0) as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) and case_key is not null
      union all select case_key, 0, box_id, round_even(center_x, 0), round_even(center_y, 0) from candidate_boxes where isfinite(center_x) and isfinite(center_y) and case_key is not null)
      select * from u qualify row_number() over (partition by case_key, x, y order by list, id) = 1""",
    "filled_cases": "with k as (select unique_key, chargegeog from cases qualify row_number() over (partition by unique_key order by loaded_at desc nulls last, chargegeog desc nulls last) = 1) select row_id, g.unique_key, coalesce(case when trim(original_address) <> '' then original_address end, chargegeog) as original_address from geocoder_rows g left join k on k.unique_key = g.unique_key",
    "cell_buckets": f"""select round_even(easting_27700 / 10, 0) as cx, round_even(northing_27700 / 10, 0) as cy, count(*) as points, count(distinct source) as sources, arg_max(point_id, (coalesce({_FIN.format('score')}, -1e300), point_id)) as best
      from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) group by 1, 2""",
    "weighted_centroids": """with p as (select distinct case_key, point_id, score as w, easting_27700 as x, northing_27700 as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) and isfinite(score) and score > 0 and case_key is not null),
      t as (select * from p qualify row_number() over (partition by case_key order by w desc, point_id) <= 8) select case_key, round(sum(x * w) / sum(w), 6) as x, round(sum(y * w) / sum(w), 6) as y, count(*) as points from t group by 1""",
    "box_overlaps": f"""with {_BOX}, q as (select * from b where case_key is not null and rank is not null), f as (select * from q qualify row_number() over (partition by case_key order by rank, box_id) = 1),
      j as (select q.box_id, greatest(least(q.x2, f.x2) - greatest(q.x1, f.x1), 0) * greatest(least(q.y2, f.y2) - greatest(q.y1, f.y1), 0) as s, (q.x2 - q.x1) * (q.y2 - q.y1) + (f.x2 - f.x1) * (f.y2 - f.y1) as t from q join f using (case_key) where q.box_id <> f.box_id)
      select box_id, round(s, 6) as shared, round(case when t - s > 0 then s / (t - s) else 0 end, 9) as iou from j""",
    "box_distances": _DIST + " select box_id, metres from d",
    "box_union_hits": _DIST + " select case_key, count(*) as boxes, bool_or(metres = 0) as any_hit, min(rank) filter (metres = 0) as first_rank from d group by 1",
    "point_spread": """select case_key, round(sqrt(pow(max(easting_27700) - min(easting_27700), 2) + pow(max(northing_27700) - min(northing_27700), 2)), 6) as diagonal, count(*) as points
      from point_candidates where isfinite(easting_27700) and isfinite(northing_27700) and case_key is not null group by 1""",
    "nearest_uprn": """with p as (select distinct point_id, easting_27700 as x, northing_27700 as y from point_candidates where isfinite(easting_27700) and isfinite(northing_27700)),
      u as (select distinct UPRN as id, X_COORDINATE as ux, Y_COORDINATE as uy from uprn where isfinite(X_COORDINATE) and isfinite(Y_COORDINATE)),
      d as (select point_id, id, sqrt((x - ux) * (x - ux) + (y - uy) * (y - uy)) as m from p, u where abs(x - ux) <= 100 and abs(y - uy) <= 100 and (x - ux) * (x - ux) + (y - uy) * (y - uy) <= 10000)
      select point_id, arg_min(id, (m, id)) as uprn, round(min(m), 6) as metres, count(distinct id) as within from d group by 1""",
    "road_chain": f"""with {_SEG}, {_BEST}, l as (select *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) as len from s where bx is not null), m as (select *, coalesce(sum(len) over (partition by case_key order by cand_no rows between unbounded preceding and 1 preceding), 0) as before from l),
      j as (select m.*, x, y, case when len = 0 then 0 else least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)), 0), 1) end as t from m join best using (case_key)),
      d as (select *, before + t * len as measure, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (by_ - ay)), 2)) as d from j)
      select case_key, round(sum(len), 3) as length, round(min(d), 3) as metres, round(arg_min(measure, (d, cand_no)), 3) as measure from d group by 1""",
    "line_samples": f"""with {_SEG}, l as (select *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) as len from s where bx is not null), e as (select *, unnest(range(cast(floor(len / 200) as bigint) + 1)) as step from l where len > 0)
      select cand_no, step, round(ax + step * 200 / len * (bx - ax), 3) as x, round(ay + step * 200 / len * (by_ - ay), 3) as y from e""",
    "projections": """with o as (select ID, try_cast(nullif(trim(GEOMETRY_X), '') as double) / 1e5 - 5 as lon, try_cast(nullif(trim(GEOMETRY_Y), '') as double) / 1e5 + 50 as lat from open_names)
      select ID, round(radians(lon) * 6378137.0, 3) as x, round(ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137.0, 3) as y, cast(floor((lon + 180) / 360 * 32768) as bigint) as tile_x, cast(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32768) as bigint) as tile_y from o where lon is not null and lat is not null""",
    "set_algebra": """with p as (select distinct case_key from point_candidates where case_key is not null), b as (select distinct case_key from candidate_boxes where case_key is not null)
      select 'points' as kind, count(*) as cases from p union all select 'boxes', count(*) from b union all select 'both', count(*) from (select * from p intersect select * from b) union all select 'points_only', count(*) from (select * from p except select * from b) union all select 'either', count(*) from (select * from p union select * from b)""",
    "case_folds": "select distinct unique_key, cast(('0x' || substr(md5(unique_key), 1, 8))::bigint % 5 as bigint) as fold from cases",
    "case_sample": "select candidate_source, case_key from (select distinct candidate_source, case_key from polygon_candidates where case_key is not null) qualify row_number() over (partition by candidate_source order by md5('7' || case_key), case_key) <= 20",
    "scaled_features": f"""with p as (select row_id, ln(1 + greatest({_FIN.format('distance_to_best_point_m')}, 0)) as d0, {_FIN.format('distance_to_best_point_m')} as raw, {_FIN.format('best_confidence')} as c, coalesce(sample_split = 'train', false) as train from polygon_candidates),
      q as (select row_id, case when raw is null then ln(1.0) else d0 end as d, c, train from p), s as (select avg(d) as md, stddev_pop(d) as sd, avg(c) as mc, stddev_pop(c) as sc from q where train)
      select row_id, round(coalesce((d - md) / case when sd < 1e-9 then 1 else sd end, 0), 6) as z_d, round(coalesce((c - mc) / case when sc < 1e-9 then 1 else sc end, 0), 6) as z_c from q, s""",
    "theme_columns": """with l as (select candidate_make as v, row_number() over (order by count(*) desc, candidate_make) as n from polygon_candidates where candidate_make is not null group by 1)
      select row_id, coalesce((candidate_make = (select v from l where n = 1))::int, 0) as candidate_make_is_0, coalesce((candidate_make = (select v from l where n = 2))::int, 0) as candidate_make_is_1, coalesce((candidate_make = (select v from l where n = 3))::int, 0) as candidate_make_is_2 from polygon_candidates""",
    "support_counts": f"with {_C}, z as (select case_key, count(*) filter (candidate_source = 'council_cadastral') as council_cadastral, count(*) filter (candidate_source = 'merged_wfs') as merged_wfs, count(*) filter (candidate_source = 'raw_wfs') as raw_wfs from c group by 1) select *, greatest(council_cadastral, merged_wfs, raw_wfs) as most from z",
    "score_deltas": """with g as (select case_key, candidate_id, count(*) as n, arg_max(rule_score, (loaded_at, row_id)) - arg_min(rule_score, (loaded_at, row_id)) as d from polygon_candidates where case_key is not null and isfinite(rule_score) group by 1, 2)
      select case when d > 1 then 'better' when d < -1 then 'worse' else 'same' end as kind, count(*) as candidates, round(avg(d), 6) as mean_delta from g where n > 1 group by 1""",
}
