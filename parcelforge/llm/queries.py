"""Queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import cut, table
from parcelforge.llm import bpe, canonical, mixing, pii, same_address, splits, topn

BEST = 5


def _address_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name, prefix, key, text):
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("rec"), F.col(text).alias("address"))

    return of("cases", "case:", "unique_key", "chargegeog").unionByName(of("geocoder_rows", "row:", "key", "original_address")).unionByName(of("point_candidates", "pt:", "point_id", "address"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_address.pairs(same_address.locations(_address_records(spark, sf_dir)))


def p1_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_address.locations(_address_records(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("case_key", "candidate_id")


def p3_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).withColumn("place", F.col("place").cast("long"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.top_per_group(table(spark, sf_dir, "polygon_candidates"), "case_key", "candidate_id", "rule_score", "rule_rank", ["loaded_at", "row_id"], BEST)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ocr = table(spark, sf_dir, "ocr_evidence").select(F.lit("road_phrases").alias("src"), F.col("ocr_id").alias("rec_id"), F.posexplode("road_phrases").alias("pos", "value"))
    names = table(spark, sf_dir, "name_candidates").select(F.col("kind").alias("src"), F.col("cand_no").alias("rec_id"), F.lit(0).alias("pos"), F.col("name").alias("value"))
    values = ocr.unionByName(names).where(F.col("value").rlike(r"[^\s\u00a0]")).withColumn("pos", F.col("pos").cast("long"))
    return canonical.to_reference(values, "value", table(spark, sf_dir, "open_names"), "ID", "NAME1").select("src", "rec_id", "pos", "ref_id")


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).groupBy("src").agg(F.count(F.lit(1)).alias("values"), F.count_if(F.col("ref_id") == "").alias("unmatched"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = splits.groups(splits.ties(table(spark, sf_dir, "polygon_candidates"), "case_key", "base_key"))
    return grouped.where("members > 1").select(F.col("key").alias("case_key"), "group_key")


def p7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest behind the groups: which key hangs at which parent, by how many rows."""
    forest, _ = splits.spanning_forest(splits.tie_edges(splits.ties(table(spark, sf_dir, "polygon_candidates"), "case_key", "base_key")))
    return forest.select(F.expr("substr(a, 2)").alias("case_key"), F.expr("substr(b, 2)").alias("parent"), (-F.col("weight")).alias("rows"))


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float]]:
    return [(r["split_name"], r["share"]) for r in table(spark, sf_dir, "split_targets").select("split_name", "share").collect()]


def p7_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign(table(spark, sf_dir, "polygon_candidates"), "case_key", "base_key", _targets(spark, sf_dir), "row_id")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(p7_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("rows")), "split_rows")
    total = rows.agg(F.sum("rows")).first()[0] or 1
    wanted = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "share")
    return wanted.join(rows, "split", "left").select("split", "share", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) / total).alias("reached"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str):
    sized = cut(bpe.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"], "text"), "sized")
    return mixing.mix(sized, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, made = _mixed(spark, sf_dir)
    return mixing.shares(mixed, made, "doc_id", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pii_kind", "start_pos")


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_locations": p1_locations, "p3_found": p3_found, "p3_ranked": p3_ranked, "p5_found": p5_found, "p5_unmatched": p5_unmatched, "p7_found": p7_found, "p7_forest": p7_forest, "p7_splits": p7_splits, "p7_shares": p7_shares,
    "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_redacted": p10_redacted,
}

_P3 = """
with counting as (
  select case_key, candidate_id, rule_score, rule_rank, row_number() over (partition by case_key, candidate_id order by loaded_at desc, row_id desc) as n
  from polygon_candidates where case_key is not null),
ranked as (
  select case_key, candidate_id, rule_score, rule_rank, row_number() over (partition by case_key order by rule_score desc, rule_rank asc nulls last, candidate_id) as place
  from counting where n = 1 and isfinite(rule_score))
"""

ORACLES = {
    "p3_found": _P3 + "select case_key, candidate_id from ranked where place <= 5",
    "p3_ranked": _P3 + "select case_key, candidate_id, place, rule_score, rule_rank from ranked where place <= 5",
    "p7_found": """
with recursive named as (
  select case_key, lower(trim(coalesce(base_key, ''), e' \\t\\r\\n')) as b from polygon_candidates where case_key is not null),
ties as (
  select distinct case_key, coalesce(nullif(regexp_extract(x, '^(?:case)?[\\s:#._-]*0*(\\d+)(?:\\.0*)?$', 1), ''), x) as parent
  from (select case_key, case when b = '' then lower(split_part(case_key, '_', 1)) else b end as x from named)),
links as (select distinct a.case_key as u, b.case_key as v from ties a join (select parent, min(case_key) as case_key from ties group by parent) b using (parent)),
both_ways as (select u, v from links union select v, u from links),
reach as (select u, v from both_ways union select r.u, b.v from reach r join both_ways b on r.v = b.u),
named_groups as (select u as case_key, min(v) as group_key, count(distinct v) as members from reach group by u)
select case_key, group_key from named_groups where members > 1""",
}
