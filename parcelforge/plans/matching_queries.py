"""Queries that match texts, names and places: joins by token blocks, tiers of resolution, references, numbers, agreement of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.functions import extract as X
from parcelforge.functions import similarity as M
from parcelforge.functions import text as N
from parcelforge.operators import ranking as R
from parcelforge.operators.cluster import single_link
from parcelforge.operators.joins import contained_names
from parcelforge.operators.spatial import finite
from parcelforge.plans.relational_queries import _C, _candidates
from parcelforge.plans.text_queries import _exp, _up

STRONG, WEAK = 0.6, 0.35
NOISE = r"^((LAND|SITE|PLOT|PART|REAR|FRONT|SIDE|ADJ|ADJACENT|ADJOINING|NEXT|NEAR|BESIDE|BEHIND|OPPOSITE|OFF|AT|OF|TO|ON|THE|R O|NO|NOS)\s+)+"
LETTERED = r"\b([0-9]{1,4}[A-Z]?)\b"
UNITS = r"\b(FLAT|UNIT|PLOT|APT|APARTMENT|SUITE|ROOM)\s+(NO\s+)?[0-9]+[A-Z]?\b"
GRID_FORMS = {
    "six_six": r"(?<![0-9])([0-9]{6})\s*[,/ ]\s*([0-9]{6,7})(?![0-9])",
    "three_three": r"(?<![0-9])([0-9]{3})[ /]([0-9]{3})(?![0-9])",
    "slash": r"(?<![0-9/])([0-9]{4,5})/([0-9]{4,5})(?![0-9/])",
    "compact": r"(?<![0-9A-Za-z])([0-9]{4})([0-9]{4})(?![0-9A-Za-z])",
    "compact_ten": r"(?<![0-9A-Za-z])([0-9]{5})([0-9]{5})(?![0-9A-Za-z])",
}


def named_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads of the gazetteer by normalised name: how many entries, and the box around all of them."""
    o = table(spark, sf_dir, "open_names").where(F.col("LOCAL_TYPE") == "Named Road")
    x, y = N.number(F.col("GEOMETRY_X")), N.number(F.col("GEOMETRY_Y"))
    edge = lambda name, own: F.coalesce(N.number(F.col(name)), own)
    o = o.select(N.plain_upper(F.col("NAME1")).alias("name"), edge("MBR_XMIN", x).alias("x1"), edge("MBR_YMIN", y).alias("y1"), edge("MBR_XMAX", x).alias("x2"), edge("MBR_YMAX", y).alias("y2"))
    return o.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("entries"), F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x2").alias("maxx"), F.max("y2").alias("maxy"))


def road_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the gazetteer's roads of one name and place, the one nearest to the place's own point."""
    o = table(spark, sf_dir, "open_names").withColumns({"x": N.number(F.col("GEOMETRY_X")), "y": N.number(F.col("GEOMETRY_Y"))}).where("x is not null and y is not null")
    places = o.where(F.col("TYPE") == "populatedPlace").groupBy(N.plain_upper(F.col("NAME1")).alias("place")).agg(F.min_by(F.struct(F.col("x").alias("px"), F.col("y").alias("py")), "ID").alias("p"))
    roads = o.where(F.col("LOCAL_TYPE") == "Named Road").select("ID", N.plain_upper(F.col("NAME1")).alias("road"), N.plain_upper(F.col("POPULATED_PLACE")).alias("place"), "x", "y").where("place <> ''")
    j = roads.join(places, "place").withColumn("d", F.hypot(F.col("x") - F.col("p.px"), F.col("y") - F.col("p.py")))
    return j.groupBy("road", "place").agg(F.min_by("ID", F.struct("d", "ID")).alias("ID"), F.round(F.min("d"), 6).alias("metres"))


def address_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each row, the address points whose address shares most words with its own: strong and weak ones counted, and the best.

    Only texts that share a house number and a word of five letters or more are compared, each distinct text once: the
    blocks are equi-joined, so no address is tried against every other.
    """
    block = lambda c: F.explode(F.flatten(F.transform(X.house_numbers(c, 0), lambda n: F.transform(F.filter(X.content_tokens(N.expanded(c), 5), lambda w: ~w.isin(*X.SUFFIXES)), lambda w: F.concat_ws(" ", n.cast("string"), w)))))
    tokens = lambda c: F.array_distinct(N.words(N.expanded(c)))
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", "original_address").where("original_address is not null")
    p = table(spark, sf_dir, "point_candidates").select(F.col("address").alias("found")).where("address is not null").distinct()
    asked = g.select("original_address").distinct()
    a = asked.select("original_address", tokens(F.col("original_address")).alias("wa"), block(F.col("original_address")).alias("k"))
    b = p.select("found", tokens(F.col("found")).alias("wb"), block(F.col("found")).alias("k"))
    pairs = a.join(b, "k").select("original_address", "found", F.round(M.jaccard(F.col("wa"), F.col("wb")), 9).alias("s")).where(F.col("s") >= WEAK).distinct()
    best = pairs.groupBy("original_address").agg(F.count_if(F.col("s") >= STRONG).alias("strong"), F.count_if(F.col("s") < STRONG).alias("weak"), F.max("s").alias("score"), F.min_by("found", F.struct(-F.col("s"), "found")).alias("address"))
    return g.join(best, "original_address").select("row_id", "strong", "weak", "score", "address")


def folder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case, the best of its own folder's points: address words shared with the case's address, ties by score and id; the
    first four, and others only at half the best or more."""
    c = R.latest_rows(table(spark, sf_dir, "cases").select("unique_key", "chargegeog", "loaded_at"), ["unique_key"], ["loaded_at", "chargegeog"])
    p = table(spark, sf_dir, "point_candidates").select(F.col("case_key").alias("unique_key"), "point_id", "address", N.number(F.col("score")).alias("given")).distinct()
    j = p.join(c.select("unique_key", "chargegeog"), "unique_key").withColumn("s", F.round(M.jaccard(N.words(N.expanded(F.col("address"))), N.words(N.expanded(F.col("chargegeog")))), 9))
    best = j.groupBy("unique_key").agg(F.max("s").alias("top"))
    ranked = R.placed(j.join(best, "unique_key"), "unique_key", [F.desc("s"), F.col("given").desc_nulls_last(), F.col("point_id"), F.col("address").asc_nulls_first()], "place")
    return ranked.where((F.col("place") <= 4) | ((F.col("s") >= F.col("top") / 2) & (F.col("s") > 0))).select("unique_key", "point_id", "place", F.col("s").alias("score"))


def free_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer names in an address, those that are the tail of a longer name there left out: `Upper Mill Lane` isn't `Mill Lane`, too."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.expanded(F.col("original_address")).alias("t"))
    o = table(spark, sf_dir, "open_names").select("ID", N.plain_upper(F.col("NAME1")).alias("n"))
    widest = o.agg(F.max(F.size(F.split("n", " ")))).first()[0] or 1  # of the fixed list: no name is longer
    m = contained_names(g, F.col("t"), o, F.col("n"), ["row_id"], ["ID", "n"], widest)
    tails = m.where("name_words > 1").select("row_id", F.explode(F.transform(F.sequence(F.lit(2), F.col("name_words")), lambda i: F.array_join(F.slice(F.split("n", " "), i, 99), " "))).alias("n")).distinct()
    return m.join(tails, ["row_id", "n"], "left_anti").select("row_id", "ID")


def compact_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer names that an address holds with other gaps between the words: a run of whole words of the one, joined, is the
    other's name, joined."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.words(N.expanded(F.col("original_address"))).alias("w")).where(F.size("w") > 0)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(5), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), ""))))
    g = g.select("row_id", F.explode(F.array_distinct(runs)).alias("k")).where(F.length("k") >= 6)
    o = table(spark, sf_dir, "open_names").select("ID", N.expanded(F.col("NAME1"), joiner="").alias("k"))
    return g.join(o, "k").select("row_id", "ID")


def stem_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The road a candidate names: same name 1.0, written out 0.96, without spaces 0.92, its name without type, if one road alone has it, 0.86,
    the first words of one road alone 0.8; the best tier, then the least id."""
    c = table(spark, sf_dir, "name_candidates").select("cand_no", N.plain_upper(F.col("name")).alias("u"), N.expanded(F.col("name")).alias("e")).where("u <> ''")
    o = table(spark, sf_dir, "open_names").where(F.col("LOCAL_TYPE") == "Named Road").select("ID", N.plain_upper(F.col("NAME1")).alias("u"), N.expanded(F.col("NAME1")).alias("e"))
    bare = lambda x: F.regexp_replace(x, " (" + "|".join(X.SUFFIXES) + ")$", "")
    alone = lambda d: d.distinct().groupBy("k").agg(F.min("ID").alias("ID"), F.count(F.lit(1)).alias("n")).where("n = 1").select("k", "ID")
    heads = o.select("ID", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("e", " ")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("e", " "), 1, n), " "))).alias("k"))
    tiers = (
        (1.0, c.select("cand_no", F.col("u").alias("k")), o.select("ID", F.col("u").alias("k"))), (0.96, c.select("cand_no", F.col("e").alias("k")), o.select("ID", F.col("e").alias("k"))),
        (0.92, c.select("cand_no", F.replace("e", F.lit(" "), F.lit("")).alias("k")), o.select("ID", F.replace("e", F.lit(" "), F.lit("")).alias("k"))),
        (0.86, c.select("cand_no", bare(F.col("e")).alias("k")), alone(o.select("ID", bare(F.col("e")).alias("k")))), (0.8, c.select("cand_no", F.col("e").alias("k")), alone(heads)),
    )
    hits = None
    for score, left, right in tiers:
        h = left.where("k <> ''").join(right, "k").select("cand_no", "ID", F.lit(score).alias("score"))
        hits = h if hits is None else hits.unionByName(h)
    return hits.groupBy("cand_no").agg(F.min_by("ID", F.struct(-F.col("score"), "ID")).alias("ID"), F.max("score").alias("score"))


def grid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number pair of a text that may be a grid reference, in all forms, with its number among those of its form."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    out = None
    for form, pattern in GRID_FORMS.items():
        e, n = (F.regexp_extract_all("text", F.lit(pattern), i) for i in (1, 2))
        one = d.select("doc_id", F.posexplode(F.arrays_zip(e.alias("e"), n.alias("n"))).alias("pos", "z")).select("doc_id", F.lit(form).alias("form"), "pos", F.col("z.e").cast("bigint").alias("easting"), F.col("z.n").cast("bigint").alias("northing"))
        out = one if out is None else out.unionByName(one)
    return out


def number_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House numbers of an address as the stages read them: with letters; without those of flats and plots; the first alone; and whether
    they are a range, a list, one or none."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.plain_upper(X.without_postcodes(F.col("original_address"))).alias("t"), F.col("original_address").alias("a"))
    every = lambda c: F.regexp_extract_all(c, F.lit(LETTERED), 1)
    bare = F.regexp_replace("t", UNITS, " ")
    n = F.size(F.array_distinct(every(bare)))
    kind = F.when(X.range_of(F.col("a")).isNotNull(), "range").when(n > 1, "list").when(n == 1, "single").otherwise("none")
    return g.where("t is not null").select("row_id", F.array_join(F.array_distinct(every(F.col("t"))), ",").alias("lettered"), F.array_join(F.array_distinct(every(bare)), ",").alias("outside_units"), F.get(every(bare), F.lit(0)).alias("first"), kind.alias("kind"))


def without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address without the words of position that lead it, however many stand one behind the other."""
    c = N.plain_upper(F.col("chargegeog"))
    return table(spark, sf_dir, "cases").where("chargegeog is not null").select("unique_key", F.regexp_replace(c, NOISE, "").alias("address")).distinct()


def range_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways to ask for a range: both ends together, either end, each with the road."""
    g = table(spark, sf_dir, "geocoder_rows").withColumns({"r": X.range_of(F.col("original_address")), "road": N.plain_upper(F.split("lexicon_road", r"\|")[0])}).where("r is not null and road is not null")
    lo, hi = F.col("r.lo").cast("string"), F.col("r.hi").cast("string")
    return g.select("row_id", F.posexplode(F.array(F.concat(lo, F.lit("-"), hi, F.lit(" "), "road"), F.concat(lo, F.lit(" "), "road"), F.concat(hi, F.lit(" "), "road"))).alias("pos", "query"))


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeatable keys of an address, and of an address at a place (to the metre)."""
    g = table(spark, sf_dir, "geocoder_rows").where("original_address is not null")
    x, y = (F.coalesce(F.bround(N.number(F.col(c))).cast("bigint").cast("string"), F.lit("-")) for c in ("best_easting_27700_final", "best_northing_27700_final"))
    k = N.plain_upper(F.col("original_address"))
    return g.select("row_id", F.md5(k).alias("address_key"), F.md5(F.concat_ws("|", k, x, y)).alias("place_key"))


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a case joined by steps of up to 30 m on which two sources or more agree: points, sources, and the centre."""
    p = table(spark, sf_dir, "point_candidates").where(finite(F.col("easting_27700"), F.col("northing_27700")) & F.col("case_key").isNotNull())
    p = p.groupBy("case_key", "point_id").agg(F.min(F.struct("source", "easting_27700", "northing_27700")).alias("p")).select("case_key", "point_id", F.col("p.source").alias("source"), F.col("p.easting_27700").alias("x"), F.col("p.northing_27700").alias("y"))
    j = p.join(single_link(p, "case_key", "point_id", "x", "y", 30.0), ["case_key", "point_id"])
    out = j.groupBy("case_key", "cluster").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("source").alias("sources"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))
    return out.where("sources > 1")


def nearest_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each case, the geocoded row nearest to its best candidate's centre (then surest, then first), and how far it is."""
    c = _candidates(spark, sf_dir).where("x is not null and y is not null")
    best = c.groupBy("case_key").agg(F.min_by(F.struct("x", "y"), R.order_key("rule_rank", "score", "candidate_id")).alias("c"))
    g = table(spark, sf_dir, "geocoder_rows").where(finite(F.col("best_easting_27700_final"), F.col("best_northing_27700_final")))
    g = g.select(F.col("unique_key").alias("case_key"), "row_id", F.col("best_easting_27700_final").alias("gx"), F.col("best_northing_27700_final").alias("gy"), F.coalesce(N.number(F.col("best_confidence")), F.lit(-1.0)).alias("sure"))
    j = g.join(best, "case_key").withColumn("d", F.round(F.hypot(F.col("gx") - F.col("c.x"), F.col("gy") - F.col("c.y")), 6))
    return j.groupBy("case_key").agg(F.min_by("row_id", F.struct("d", -F.col("sure"), "row_id")).alias("row_id"), F.min("d").alias("metres"), F.count(F.lit(1)).alias("variants"))


def known_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of the cases that geocoded rows name: a semi-join, however many keys there are."""
    keys = table(spark, sf_dir, "geocoder_rows").select(N.base_key(F.col("key")).alias("unique_key")).where("unique_key is not null")
    c = table(spark, sf_dir, "cases").where("geom is not null").join(keys, "unique_key", "left_semi")
    return c.select("unique_key", F.lower(F.hex("geom")).alias("geom")).distinct()


def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence rows below each other with a label: how many each list gives a case."""
    of = lambda t, label: table(spark, sf_dir, t).where("case_key is not null").select("case_key", F.lit(label).alias("list"))
    u = of("point_candidates", "point").unionByName(of("candidate_boxes", "box")).unionByName(of("name_candidates", "name"))
    return u.groupBy("case_key", "list").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {f.__name__: f for f in (
    named_roads, road_by_place, address_search, folder_search, free_mentions, compact_mentions, stem_resolve, grid_candidates, number_dialects, without_noise, range_queries, cache_keys, agreement, nearest_variant,
    known_cases, labelled_union,
)}

_NUM = "(case when isfinite(try_cast(nullif(trim({0}), '') as double)) then try_cast(nullif(trim({0}), '') as double) end)"
_SUFF = ", ".join(f"'{w}'" for w in X.SUFFIXES)
_STOPS = ", ".join(f"'{w}'" for w in X.STOP)


def _nopc(c: str) -> str:
    return "regexp_replace(upper(" + c + "), '" + X.POSTCODE + "', ' ', 'g')"


def _words(c: str) -> str:
    return f"list_filter(string_split({_exp(c)}, ' '), lambda w: w <> '')"


def _jac(a: str, b: str) -> str:
    return f"round(coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0), 9)"


def _blocks(c: str) -> str:
    dash = f"regexp_replace({_nopc(c)}, '[–—]', '-', 'g')"
    numbers = f"list_distinct(list_filter(list_transform(regexp_extract_all({dash}, '\\b([0-9]{{1,3}})[A-Z]?\\b', 1), lambda x: cast(x as int)), lambda n: n > 0 and n < 1000))"
    tokens = f"list_distinct(list_filter(string_split({_up(_nopc(_exp(c)))}, ' '), lambda w: length(w) >= 5 and w not in ({_STOPS}) and w not in ({_SUFF}) and not regexp_matches(w, '^[0-9]+$')))"
    return f"list_distinct(flatten(list_transform({numbers}, lambda n: list_transform({tokens}, lambda w: n || ' ' || w))))"


_BASE = "with t as (select row_id, original_address as a, " + _up(_nopc("original_address")) + " as t from geocoder_rows where original_address is not null)"

ORACLES = {
    "named_roads": f"""with o as (select {_up('NAME1')} as name, {_NUM.format('GEOMETRY_X')} as x, {_NUM.format('GEOMETRY_Y')} as y, {_NUM.format('MBR_XMIN')} as x1, {_NUM.format('MBR_YMIN')} as y1, {_NUM.format('MBR_XMAX')} as x2, {_NUM.format('MBR_YMAX')} as y2 from open_names where LOCAL_TYPE = 'Named Road')
      select name, count(*) as entries, min(coalesce(x1, x)) as minx, min(coalesce(y1, y)) as miny, max(coalesce(x2, x)) as maxx, max(coalesce(y2, y)) as maxy from o where name <> '' group by 1""",
    "road_by_place": f"""with o as (select *, {_NUM.format('GEOMETRY_X')} as x, {_NUM.format('GEOMETRY_Y')} as y from open_names), p as (select {_up('NAME1')} as place, arg_min(x, ID) as px, arg_min(y, ID) as py from o where TYPE = 'populatedPlace' and x is not null and y is not null group by 1),
      j as (select {_up('NAME1')} as road, place, ID, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d from o join p on place = {_up('POPULATED_PLACE')} where LOCAL_TYPE = 'Named Road' and place <> '' and x is not null and y is not null)
      select road, place, ID, round(d, 6) as metres from j qualify row_number() over (partition by road, place order by d, ID) = 1""",
    "address_search": f"""with a as (select distinct original_address as a from geocoder_rows where original_address is not null), b as (select distinct address as b from point_candidates where address is not null),
      ka as (select a, {_words('a')} as wa, unnest({_blocks('a')}) as k from a), kb as (select b, {_words('b')} as wb, unnest({_blocks('b')}) as k from b),
      j as (select distinct a, b, {_jac('wa', 'wb')} as s from ka join kb using (k)), s as (select a, count(*) filter (s >= {STRONG}) as strong, count(*) filter (s < {STRONG}) as weak, max(s) as score from j where s >= {WEAK} group by 1),
      f as (select a, b from j where s >= {WEAK} qualify row_number() over (partition by a order by s desc, b) = 1) select row_id, strong, weak, score, b as address from geocoder_rows g join s on s.a = g.original_address join f on f.a = s.a""",
    "folder_search": f"""with c as (select unique_key, chargegeog from cases where unique_key is not null qualify row_number() over (partition by unique_key order by loaded_at desc, chargegeog desc nulls last) = 1),
      p as (select distinct case_key as unique_key, point_id, address, case when isfinite(score) then score end as given from point_candidates), j as (select unique_key, point_id, address, given, case when address is null or chargegeog is null then 0 else {_jac(_words('address'), _words('chargegeog'))} end as s from p join c using (unique_key)),
      r as (select *, max(s) over (partition by unique_key) as top, row_number() over (partition by unique_key order by s desc, given desc nulls last, point_id, address asc nulls first) as place from j)
      select unique_key, point_id, cast(place as int) as place, s as score from r where place <= 4 or (s >= top / 2 and s > 0)""",
    "free_mentions": f"""with g as (select row_id, ' ' || {_exp('original_address')} || ' ' as t from geocoder_rows), o as (select ID, {_up('NAME1')} as n from open_names), m as (select row_id, ID, n from g, o where n <> '' and strpos(t, ' ' || n || ' ') > 0)
      select row_id, ID from m where not exists (select 1 from m l where l.row_id = m.row_id and suffix(l.n, ' ' || m.n))""",
    "compact_mentions": f"""with g as (select row_id, {_words('original_address')} as w from geocoder_rows), i as (select row_id, w, unnest(range(1, len(w) + 1)) as i from g), r as (select distinct row_id, array_to_string(w[i : i + n - 1], '') as k from i, range(1, 6) v(n) where i + n - 1 <= len(w))
      select row_id, ID from r join (select ID, replace({_exp('NAME1')}, ' ', '') as k from open_names) o using (k) where length(k) >= 6""",
    "stem_resolve": f"""with c as (select cand_no, {_up('name')} as u, {_exp('name')} as e from name_candidates where {_up('name')} <> ''), o as (select ID, {_up('NAME1')} as u, {_exp('NAME1')} as e from open_names where LOCAL_TYPE = 'Named Road'),
      b as (select k, min(ID) as ID from (select distinct ID, regexp_replace(e, ' ({"|".join(X.SUFFIXES)})$', '') as k from o) group by 1 having count(*) = 1),
      w as (select ID, e, string_split(e, ' ') as l from o), p as (select k, min(ID) as ID from (select distinct ID, array_to_string(l[1 : n], ' ') as k from (select ID, l, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as n from w)) group by 1 having count(*) = 1),
      h as (select cand_no, ID, 1.0 as s from c join o using (u) union all select cand_no, ID, 0.96 from c join o using (e) union all select cand_no, ID, 0.92 from c join o on replace(c.e, ' ', '') = replace(o.e, ' ', '')
        union all select cand_no, ID, 0.86 from c join b on k = regexp_replace(e, ' ({"|".join(X.SUFFIXES)})$', '') union all select cand_no, ID, 0.8 from c join p on k = e)
      select cand_no, ID, cast(s as double) as score from h qualify row_number() over (partition by cand_no order by s desc, ID) = 1""",
    "number_dialects": f"""{_BASE}, s as (select row_id, a, regexp_extract_all(t, '{LETTERED}', 1) as l, regexp_extract_all(regexp_replace(t, '{UNITS}', ' ', 'g'), '{LETTERED}', 1) as b from t)
      select row_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as lettered, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i), ',') as outside_units, b[1] as first,
        case when regexp_matches(regexp_replace({_nopc('a')}, '[–—]', '-', 'g'), '\\b([0-9]{{1,3}})[A-Z]?\\s*(?:-|\\bTO\\b)\\s*([0-9]{{1,3}})[A-Z]?\\b') then 'range' when len(list_distinct(b)) > 1 then 'list' when len(b) >= 1 then 'single' else 'none' end as kind from s""",
    "without_noise": f"select distinct unique_key, regexp_replace({_up('chargegeog')}, '{NOISE}', '') as address from cases where chargegeog is not null",
    "range_queries": f"""with s as (select row_id, {_up("split_part(lexicon_road, '|', 1)")} as road, regexp_extract(regexp_replace({_nopc('original_address')}, '[–—]', '-', 'g'), '\\b([0-9]{{1,3}})[A-Z]?\\s*(?:-|\\bTO\\b)\\s*([0-9]{{1,3}})[A-Z]?\\b', ['lo', 'hi']) as r from geocoder_rows where lexicon_road is not null and original_address is not null),
      z as (select row_id, road, cast(cast(r.lo as int) as varchar) as lo, cast(cast(r.hi as int) as varchar) as hi from s where r.lo <> ''), q as (select row_id, [lo || '-' || hi || ' ' || road, lo || ' ' || road, hi || ' ' || road] as q from z)
      select row_id, cast(unnest(range(3)) as int) as pos, unnest(q) as query from q""",
    "cache_keys": f"""with s as (select row_id, {_up('original_address')} as k, coalesce(cast(cast(round_even(case when isfinite(best_easting_27700_final) then best_easting_27700_final end, 0) as bigint) as varchar), '-') as x, coalesce(cast(cast(round_even(case when isfinite(best_northing_27700_final) then best_northing_27700_final end, 0) as bigint) as varchar), '-') as y
      from geocoder_rows where original_address is not null) select row_id, md5(k) as address_key, md5(k || '|' || x || '|' || y) as place_key from s""",
    "agreement": """with recursive p as (select case_key, point_id, source, easting_27700 as x, northing_27700 as y from point_candidates where case_key is not null and isfinite(easting_27700) and isfinite(northing_27700)
        qualify row_number() over (partition by case_key, point_id order by source nulls first, easting_27700, northing_27700) = 1),
      near as (select a.case_key, a.point_id as u, b.point_id as v from p a join p b on a.case_key = b.case_key and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 30),
      reach as (select case_key, u, v from near union select reach.case_key, reach.u, near.v from reach join near on near.case_key = reach.case_key and near.u = reach.v), l as (select case_key, u as point_id, min(v) as cluster from reach group by 1, 2)
      select case_key, cluster, count(*) as points, count(distinct source) as sources, round(avg(x), 4) as x, round(avg(y), 4) as y from p join l using (case_key, point_id) group by 1, 2 having count(distinct source) > 1""",
    "known_cases": "select distinct unique_key, lower(hex(geom)) as geom from cases where geom is not null and unique_key in (select regexp_replace(key, '_\\d+$', '') from geocoder_rows where key is not null)",
    "labelled_union": "select case_key, 'point' as list, count(*) as rows from point_candidates where case_key is not null group by 1 union all select case_key, 'box', count(*) from candidate_boxes where case_key is not null group by 1 union all select case_key, 'name', count(*) from name_candidates where case_key is not null group by 1",
}

ORACLES["nearest_variant"] = f"""with {_C}, b as (select case_key, x, y from c where x is not null and y is not null qualify row_number() over (partition by case_key order by coalesce(rule_rank::double, 'infinity'), coalesce(score, '-infinity'::double) desc, candidate_id) = 1),
      j as (select case_key, row_id, round(sqrt((best_easting_27700_final - x) * (best_easting_27700_final - x) + (best_northing_27700_final - y) * (best_northing_27700_final - y)), 6) as d, coalesce(case when isfinite(best_confidence) then best_confidence end, -1) as sure
        from geocoder_rows join b on case_key = unique_key where isfinite(best_easting_27700_final) and isfinite(best_northing_27700_final))
      select case_key, row_id, d as metres, count(*) over (partition by case_key) as variants from j qualify row_number() over (partition by case_key order by d, sure desc, row_id) = 1"""
