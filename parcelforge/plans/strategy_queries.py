"""Queries over the named strategies and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import text as N
from parcelforge.operators import ranking as R
from parcelforge.operators import sampling as S
from parcelforge.operators.strategies import STRATEGIES
from parcelforge.plans.relational_queries import _C, TOP, _candidates, walk


def _run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return STRATEGIES[name](_candidates(spark, sf_dir), TOP).select("case_key", "candidate_id", F.col("place").cast("int").alias("place"))

    query.__name__ = f"strategy_{name}"
    query.__doc__ = STRATEGIES[name].__doc__
    return query


def strategy_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each strategy that ranks by columns alone, how many cases have a covering candidate among its first five."""
    c = _candidates(spark, sf_dir)
    out = None
    for name in ("rule", "conservative_road", "bounded_noncover", "relation_mix"):
        per = STRATEGIES[name](c, TOP).groupBy("case_key").agg(F.bool_or(F.coalesce("covers_best_point", F.lit(False))).alias("hit"))
        one = per.agg(F.count(F.lit(1)).alias("cases"), F.count_if("hit").alias("hits")).select(F.lit(name).alias("strategy"), "cases", "hits")
        out = one if out is None else out.unionByName(one)
    return out


def rank_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by score, ties by the older rank: the first ten of a case."""
    order = [F.col("score").desc_nulls_last(), F.col("rule_rank").asc_nulls_last(), F.col("candidate_id")]
    return R.placed(_candidates(spark, sf_dir), "case_key", order, "place").where("place <= 10").select("case_key", "candidate_id", "place")


def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four of a case with their places in words."""
    words = F.element_at(F.create_map(*[F.lit(x) for kv in {1: "first", 2: "second", 3: "third", 4: "fourth"}.items() for x in kv]), F.col("place"))
    return R.placed(_candidates(spark, sf_dir), "case_key", R.canonical_order("rule_rank", "score", "candidate_id"), "place").where("place <= 4").select("case_key", "candidate_id", words.alias("place"))


def best_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate (rank, area, margin over the next score) with most covering cases; of equal ones the tightest."""
    gates = spark.createDataFrame([(r, float(a), float(m)) for r in (3, 10, 50) for a in (500, 5000, 100000) for m in (0, 5)], "most_rank int, most_area double, margin double")
    c = R.placed(_candidates(spark, sf_dir).where("score is not null"), "case_key", R.canonical_order("rule_rank", "score", "candidate_id"), "place").where("place <= 51")
    from pyspark.sql import Window

    c = c.withColumn("ahead", F.col("score") - F.coalesce(F.lead("score").over(Window.partitionBy("case_key").orderBy("place")), F.lit(-1e9))).where("place <= 50")
    per = c.join(F.broadcast(gates), (F.col("place") <= F.col("most_rank")) & (F.col("area") <= F.col("most_area")) & (F.col("ahead") >= F.col("margin"))).groupBy("most_rank", "most_area", "margin", "case_key").agg(F.max(F.col("covers_best_point").cast("int")).alias("hit"))
    sums = per.groupBy("most_rank", "most_area", "margin").agg(F.count(F.lit(1)).alias("cases"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return sums.orderBy(F.desc("hits"), "most_rank", "most_area", F.desc("margin")).limit(1)


def largest_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen rescored candidates that gained most and the fifteen that lost most: last score minus first."""
    from parcelforge.engine import table

    p = table(spark, sf_dir, "polygon_candidates").where("case_key is not null").withColumn("s", N.number(F.col("rule_score"))).where("s is not null")
    g = p.groupBy("case_key", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("s", F.struct("loaded_at", "row_id")).alias("first"), F.max_by("s", F.struct("loaded_at", "row_id")).alias("last")).where("n > 1")
    g = g.select("case_key", "candidate_id", F.round(F.col("last") - F.col("first"), 6).alias("delta"))
    up = g.orderBy(F.desc("delta"), "case_key", "candidate_id").limit(15).withColumn("side", F.lit("gain"))
    down = g.orderBy("delta", "case_key", "candidate_id").limit(15).withColumn("side", F.lit("loss"))
    return up.unionByName(down)


def strata_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty cases with a hit among the first five and twenty without, by seeded hash, none of the earlier sample of twenty per source."""
    from parcelforge.engine import table

    hits = R.first_hits(_candidates(spark, sf_dir), "case_key", R.order_key("rule_rank", "score", "candidate_id"), F.col("covers_best_point"))
    kind = hits.select("case_key", F.when(F.col("first_hit") <= TOP, "hit").otherwise("miss").alias("kind"))
    earlier = S.sample_groups(table(spark, sf_dir, "polygon_candidates").where("case_key is not null"), "candidate_source", "case_key", 20, "7").select("case_key").distinct()
    return S.sample_groups(kind.join(earlier, "case_key", "left_anti"), "kind", "case_key", 20, "9")


QUERIES = {q.__name__: q for q in (*(_run(n) for n in STRATEGIES), strategy_hits, rank_recount, place_names, best_gate, largest_deltas, strata_sample)}

_R = "row_number() over (partition by case_key order by rule_rank asc nulls last, score desc nulls last, candidate_id)"


def _portfolio(keep: int, extra: int, rest: str, order: str, name: str) -> str:
    return f"""{name}e as (select *, {_R} > {keep} and ({rest}) as rest from r), {name}f as (select *, row_number() over (partition by case_key order by case when rest then 0 else 1 end, {order}, candidate_id) as o from {name}e),
      {name}g as (select *, case when place <= {keep} then 0 when rest and o <= {extra} then 1 else 2 end as bucket from {name}f),
      {name} as (select case_key, candidate_id, covers_best_point, p as place from (select *, row_number() over (partition by case_key order by bucket, case when bucket = 1 then o else place end) as p from {name}g) where p <= 5)"""


_PARTS = {
    "rule": "rule as (select case_key, candidate_id, covers_best_point, place from r where place <= 5)",
    "conservative_road": _portfolio(4, 1, "coalesce(not covers_best_point, false) and coalesce(to_road <= 12, false)", "to_road asc nulls last", "conservative_road"),
    "bounded_noncover": _portfolio(4, 1, "coalesce(not covers_best_point, false) and coalesce(to_point <= 60, false)", "to_point asc nulls last", "bounded_noncover"),
    "relation_mix": _portfolio(1, 2, "true", "to_point asc nulls last", "relation_mix"),
}


_XY = "z as (select *, candidate_id as id, row_number() over (partition by case_key order by rule_rank asc nulls last, score desc nulls last, candidate_id) as n from c where x is not null and y is not null)"

ORACLES = {
    **{f"strategy_{k}": f"with {_C}, {v} select case_key, candidate_id, cast(place as int) as place from {k}" for k, v in _PARTS.items()},
    "strategy_hits": "with " + _C + ", " + ", ".join(_PARTS.values()) + " " + " union all ".join(f"select '{k}' as strategy, count(*) as cases, count(*) filter (hit) as hits from (select case_key, bool_or(coalesce(covers_best_point, false)) as hit from {k} group by 1)" for k in _PARTS),
    "strategy_diverse": f"""with recursive {_C}, {_XY}, {walk(2.0, 5)}, u as (select case_key, id as candidate_id, 0 as fill from w union all select case_key, candidate_id, 1 from r where place <= 5 and (case_key, candidate_id) not in (select case_key, id from w))
      select case_key, candidate_id, cast(p as int) as place from (select u.case_key, u.candidate_id, row_number() over (partition by u.case_key order by fill, r.place) as p from u join r on r.case_key = u.case_key and r.candidate_id = u.candidate_id) where p <= 5""",
    "strategy_diverse_footprint": f"""with {_C}, f as (select *, case when x is not null and y is not null and area > 0 then concat_ws(',', cast(round_even(x / 8, 0) as bigint), cast(round_even(y / 8, 0) as bigint), cast(floor(ln(area) / ln(5)) as bigint)) else 'own:' || candidate_id end as foot from r),
      g as (select * from f qualify row_number() over (partition by case_key, foot order by place) = 1) select case_key, candidate_id, cast(p as int) as place from (select *, row_number() over (partition by case_key order by place) as p from g) where p <= 5""",
    "strategy_gated": f"""with {_C}, head as (select * from r where place <= 5), n as (select case_key, count(*) as size from head group by 1), a as (select case_key, candidate_id, score, row_number() over (partition by case_key order by score desc, candidate_id) as i from r where place > 5 and score is not null),
      m as (select h.case_key, h.place, h.candidate_id as old, a.candidate_id as new_, size + 1 - h.place as i, coalesce(a.score >= coalesce(h.score, '-infinity'::double) + 10, false) as wins from head h join n on n.case_key = h.case_key left join a on a.case_key = h.case_key and a.i = size + 1 - h.place)
      select case_key, case when bool_and(wins) over (partition by case_key order by i) then new_ else old end as candidate_id, cast(place as int) as place from m""",
    "rank_recount": f"with {_C} select case_key, candidate_id, cast(p as int) as place from (select *, row_number() over (partition by case_key order by score desc nulls last, rule_rank asc nulls last, candidate_id) as p from c) where p <= 10",
    "place_names": f"with {_C} select case_key, candidate_id, ['first', 'second', 'third', 'fourth'][place] as place from r where place <= 4",
    "best_gate": f"""with {_C}, s as (select *, {_R} as p from c where score is not null), l as (select *, score - coalesce(lead(score) over (partition by case_key order by p), -1e9) as ahead from s where p <= 51),
      v as (select * from (values (3), (10), (50)) a(most_rank), (values (500.0::double), (5000.0), (100000.0)) b(most_area), (values (0.0::double), (5.0)) d(margin)),
      q as (select most_rank, most_area, margin, case_key, max(covers_best_point::int) as hit from l join v on p <= 50 and p <= most_rank and area <= most_area and ahead >= margin group by all)
      select most_rank, most_area, margin, count(*) as cases, cast(coalesce(sum(hit), 0) as bigint) as hits from q group by all order by hits desc, most_rank, most_area, margin desc limit 1""",
    "largest_deltas": """with p as (select case_key, candidate_id, rule_score as s, loaded_at, row_id from polygon_candidates where case_key is not null and isfinite(rule_score)),
      g as (select case_key, candidate_id, round(arg_max(s, (loaded_at, row_id)) - arg_min(s, (loaded_at, row_id)), 6) as delta from p group by 1, 2 having count(*) > 1)
      select *, 'gain' as side from (select * from g order by delta desc, case_key, candidate_id limit 15) union all select *, 'loss' as side from (select * from g order by delta, case_key, candidate_id limit 15)""",
    "strata_sample": f"""with {_C}, e as (select distinct case_key from (select distinct candidate_source, case_key from polygon_candidates where case_key is not null) qualify row_number() over (partition by candidate_source order by md5('7' || case_key), case_key) <= 20),
      k as (select case_key, case when first_hit <= 5 then 'hit' else 'miss' end as kind from h where case_key not in (select case_key from e)) select kind, case_key from k qualify row_number() over (partition by kind order by md5('9' || case_key), case_key) <= 20""",
}
ORACLES["strategy_centroid_cluster"] = f"""with recursive {_C}, z as (select *, cast(floor(x / 56.5) as bigint) || ',' || cast(floor(y / 56.5) as bigint) as cell from r where x is not null and y is not null),
      near as (select distinct a.case_key, a.cell as u, b.cell as v from z a join z b on a.case_key = b.case_key and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 80),
      reach as (select case_key, u, v from near union select reach.case_key, reach.u, near.v from reach join near on near.case_key = reach.case_key and near.u = reach.v), k as (select case_key, cell, min(candidate_id) as least from z group by 1, 2),
      l as (select reach.case_key, u as cell, min(least) as cluster from reach join k on k.case_key = reach.case_key and k.cell = v group by 1, 2), f as (select z.case_key, z.candidate_id, z.place from z join l using (case_key, cell) qualify row_number() over (partition by z.case_key, cluster order by z.place) = 1)
      select case_key, candidate_id, cast(p as int) as place from (select *, row_number() over (partition by case_key order by place) as p from f) where p <= 5"""
