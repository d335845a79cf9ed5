"""Queries over the text normalisers, extractors and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import table
from parcelforge.functions import extract as X
from parcelforge.functions import similarity as M
from parcelforge.functions import text as N
from parcelforge.operators.joins import contained_names
from parcelforge.operators.packed import unpack  # noqa: F401  (re-exported for users of the text plans)


def norm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("original_address")
    return table(spark, sf_dir, "geocoder_rows").select(
        "row_id", N.plain_upper(c).alias("plain"), N.ocr_upper(c).alias("ocr"), N.plan_upper(c).alias("plan"), N.compact(c).alias("packed"),
        N.squeezed(c).alias("squeezed"), N.squeezed_edges(c).alias("edges"), N.safe_file_name(c).alias("file_name"),
    )


def abbrev_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("name")
    return table(spark, sf_dir, "name_candidates").select("cand_no", N.expanded(c).alias("spaced"), N.expanded(c, joiner="").alias("joined"))


def compass_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with abbreviations and compass letters written out."""
    return table(spark, sf_dir, "name_candidates").select("cand_no", N.expanded(F.col("name"), {**N.ABBREVIATIONS, **N.COMPASS}).alias("spaced"))


def digit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with the letters that scanners make of digits read as digits, as for references."""
    return table(spark, sf_dir, "name_candidates").select("cand_no", X.grid_digits(F.col("name")).alias("digits"))


def case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases").select("unique_key", N.last_path_part(F.col("FilePath")).alias("prefix"), N.base_key(F.col("unique_key")).alias("base_key")).distinct()
    return c.withColumn("reference", N.folder_reference(F.col("prefix")))


def parsed_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "polygon_candidates")
    return p.select("row_id", N.number(F.col("rule_score")).alias("score"), N.number(F.col("distance_to_best_point_m")).alias("distance"), N.truth(F.col("covers_best_point")).alias("covers"), N.truth(F.col("sample_split")).alias("split_is_true"))


def gazetteer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "open_names")
    x, y = N.number(F.col("GEOMETRY_X")), N.number(F.col("GEOMETRY_Y"))
    return o.where(x.isNotNull() & y.isNotNull()).select("ID", N.plain_upper(F.col("NAME1")).alias("name_key"), x.alias("x"), y.alias("y"), N.number(F.col("MBR_XMIN")).alias("xmin"))


def case_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases")
    first = N.first_filled(F.col("chargegeog"), F.col("supplement"), F.col("`supplementary-information`"), F.col("chargeaddr"))
    return c.select("unique_key", first.alias("first_text"), N.filled_parts(F.col("chargead00"), F.col("chargead01"), F.col("chargead02"), F.col("postcode")).alias("parts")).distinct()


def piped_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.piped(F.col("lexicon_road")).alias("p"))
    return g.select("row_id", F.size("p").alias("parts"), F.array_join("p", "/").alias("joined"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    t = N.without_markup(F.col("text"))
    return d.select("doc_id", F.length(t).alias("n_chars"), F.md5(t).alias("digest"))


def postcode_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", F.array_join(X.postcodes(F.col("original_address")), "|").alias("postcodes"), F.array_join(X.outcodes(F.col("original_address")), "|").alias("outcodes"))


def address_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", F.explode(X.content_tokens(F.col("original_address"))).alias("token"))


def house_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    r = X.range_of(F.col("original_address"))
    g = g.withColumn("r", r)
    return g.select("row_id", F.array_join(X.house_numbers(F.col("original_address")).cast("array<string>"), ",").alias("numbers"), F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"), F.array_join(X.same_parity_numbers(F.col("r")).cast("array<string>"), ",").alias("one_side"))


def range_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-cases of a range: one row for each number on its side of the street."""
    g = table(spark, sf_dir, "geocoder_rows").withColumn("r", X.range_of(F.col("original_address")))
    return g.select("row_id", F.posexplode(X.same_parity_numbers(F.col("r"))).alias("pos", "number")).select("row_id", (F.col("pos") + 1).alias("sub_case"), "number")


def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "cases").select(X.relation_flags(F.col("chargegeog")).alias("f"))
    return c.agg(*[F.count_if(F.col(f"f.{k}")).alias(k) for k in X.RELATIONS])


def road_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", F.explode(X.road_phrases(F.col("original_address"), 3)).alias("phrase"))


def wide_road_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road phrases of all widths from 2 to 5; road_phrases has those of 2 and 3."""
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", F.explode(X.road_phrases(F.col("original_address"))).alias("phrase"))


def site_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", X.site_phrase(F.col("original_address")).alias("site")).where("site is not null")


def before_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows").withColumn("road", N.plain_upper(F.split("lexicon_road", r"\|")[0]))
    return g.where("road is not null").select("row_id", X.text_before(N.plain_upper(F.col("original_address")), F.col("road")).alias("before"))


def grid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    at = F.regexp_extract("text", r"(?i)grid reference ([0-9]{6}, [0-9]{6,7}|[0-9]{3} [0-9]{3})", 1)
    d = d.select("doc_id", X.grid_reference(at, 400000, 300000).alias("g")).where("g is not null")
    return d.select("doc_id", "g.easting", "g.northing")


def all_grid_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grid reference of a text that follows the words, in the forms that grid_reference() knows, with its position; grid_references has the first of two forms."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    found = F.regexp_extract_all("text", F.lit(r"(?i)grid reference ([0-9]{6}\s*[,/ ]\s*[0-9]{6,7}\b|[0-9]{3}[ /][0-9]{3}\b)"), 1)
    d = d.select("doc_id", F.posexplode(found).alias("pos", "at")).withColumn("g", X.grid_reference(F.col("at"), 400000, 300000))
    return d.select("doc_id", "pos", "g.easting", "g.northing")


def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    a, b = N.words(N.expanded(F.col("original_address"))), N.words(N.expanded(F.col("best_address_final")))
    na, nb = X.house_numbers(F.col("original_address")), X.house_numbers(F.col("best_address_final"))
    ra, rb = X.range_of(F.col("original_address")), X.range_of(F.col("best_address_final"))
    return g.select("row_id", F.round(M.jaccard(a, b), 9).alias("jaccard"), M.overlap(a, b).alias("shared"), F.round(M.number_proximity(na, nb), 9).alias("near"), M.span_relation(ra, rb).alias("relation"))


def gestalt_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "geocoder_rows")
    return g.select("row_id", M.gestalt(N.plain_upper(F.col("original_address")), N.plain_upper(F.col("best_address_final"))).alias("ratio"))


def lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer names that an address holds as whole words."""
    g = table(spark, sf_dir, "geocoder_rows").select("row_id", N.expanded(F.col("original_address")).alias("t"))
    o = table(spark, sf_dir, "open_names").select("ID", N.plain_upper(F.col("NAME1")).alias("n"))
    widest = o.agg(F.max(F.size(F.split("n", " ")))).first()[0] or 1  # words of the longest name
    return contained_names(g, F.col("t"), o, F.col("n"), ["row_id"], ["ID"], widest).select("row_id", "ID", F.col("name_words").cast("bigint").alias("name_words"))


def longest_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lexicon_mentions(spark, sf_dir)
    return m.groupBy("row_id").agg(F.min_by("ID", F.struct(-F.col("name_words"), "ID")).alias("ID"), F.count(F.lit(1)).alias("mentions"))


def phrase_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "ocr_evidence")
    return o.select("ocr_id", F.posexplode(N.ordered_unique(F.col("road_phrases"))).alias("pos", "phrase"))


QUERIES = {f.__name__: f for f in (
    norm_variants, abbrev_roads, compass_roads, digit_repair, case_keys, parsed_flags, gazetteer_numbers, case_addresses, piped_anchors, page_text, postcode_sets, address_tokens, house_numbers, range_cases,
    relation_counts, road_phrases, wide_road_phrases, site_phrases, before_road, grid_references, all_grid_references, token_similarity, gestalt_ratio, lexicon_mentions, longest_mention, phrase_elements,
)}

_ABBR = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in N.ABBREVIATIONS.items()) + "}"


def _up(c: str) -> str:
    return f"trim(regexp_replace(upper({c}), '[^A-Z0-9]+', ' ', 'g'))"


def _exp(c: str) -> str:
    return f"array_to_string(list_transform(list_filter(string_split({_up(c)}, ' '), lambda w: w <> ''), lambda w: coalesce({_ABBR}[w], w)), ' ')"


_PC = "\\b([A-Z]{1,2}[0-9][0-9A-Z]?)\\s*([0-9][A-Z]{2})\\b"
_UNIQ = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_NUMBERS = """list_sort(list_distinct(list_filter(list_concat(
  flatten(list_transform(list_zip(regexp_extract_all(t, '{r}', 1), regexp_extract_all(t, '{r}', 2)), lambda z: case when cast(z[2] as int) >= cast(z[1] as int) and cast(z[2] as int) - cast(z[1] as int) <= 30 then range(cast(z[1] as int), cast(z[2] as int) + 1) else [cast(z[1] as bigint), cast(z[2] as bigint)] end)),
  list_transform(regexp_extract_all(t, '\\b([0-9]{{1,3}})[A-Z]?\\b', 1), lambda x: cast(x as bigint))), lambda n: n > 0 and n < 1000)))""".format(r="\\b([0-9]{1,3})[A-Z]?\\s*(?:-|/|\\bTO\\b|\\bAND\\b)\\s*([0-9]{1,3})[A-Z]?\\b")
_RANGE = "\\b([0-9]{1,3})[A-Z]?\\s*(?:-|\\bTO\\b)\\s*([0-9]{1,3})[A-Z]?\\b"
_BARE = "regexp_replace(regexp_replace(upper(original_address), '" + _PC + "', ' ', 'g'), '[–—]', '-', 'g')"
_LOHI = f"try_cast(regexp_extract(t, '{_RANGE}', 1) as int) as lo, try_cast(regexp_extract(t, '{_RANGE}', 2) as int) as hi"
_FINITE = "case when isfinite({0}) then {0} end"
_STOP = ", ".join(f"'{w}'" for w in X.STOP)

ORACLES = {
    "norm_variants": f"""select row_id, {_up('a')} as plain, {_up("replace(upper(a), '0', 'O')")} as ocr, {_up("translate(upper(a), '0158', 'OISB')")} as plan,
        regexp_replace(upper(a), '[^A-Z0-9]', '', 'g') as packed, trim(regexp_replace(a, '\\s+', ' ', 'g')) as squeezed, regexp_replace(regexp_replace(a, '\\s+', ' ', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g') as edges,
        substr(regexp_replace(regexp_replace(a, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 120) as file_name
        from (select row_id, original_address as a from geocoder_rows)""",
    "abbrev_roads": f"select cand_no, {_exp('name')} as spaced, replace({_exp('name')}, ' ', '') as joined from name_candidates",
    "compass_roads": f"select cand_no, {_exp('name').replace(_ABBR, _ABBR[:-1] + ', ' + ', '.join(f"'{k}': '{v}'" for k, v in N.COMPASS.items()) + '}')} as spaced from name_candidates",
    "digit_repair": "select cand_no, translate(upper(name), 'OQDILSZBG', '000115286') as digits from name_candidates",
    "case_keys": """select distinct unique_key, regexp_extract(replace(FilePath, '\\', '/'), '([^/]*)$', 1) as prefix, regexp_replace(unique_key, '_\\d+$', '') as base_key,
        case when regexp_matches(regexp_extract(replace(FilePath, '\\', '/'), '([^/]*)$', 1), '[A-Z]+_0*\\d+') then regexp_extract(FilePath, '([A-Z]+)_0*(\\d+)[^/\\\\]*$', 1) || '-' || regexp_extract(FilePath, '([A-Z]+)_0*(\\d+)[^/\\\\]*$', 2) end as reference from cases""",
    "parsed_flags": f"""select row_id, {_FINITE.format('rule_score')} as score, {_FINITE.format('distance_to_best_point_m')} as distance, coalesce(covers_best_point, false) as covers,
        coalesce(lower(trim(sample_split)) in ('true', '1', 'yes', 'y'), false) as split_is_true from polygon_candidates""",
    "gazetteer_numbers": f"""select ID, {_up('NAME1')} as name_key, try_cast(trim(GEOMETRY_X) as double) as x, try_cast(trim(GEOMETRY_Y) as double) as y, try_cast(nullif(trim(MBR_XMIN), '') as double) as xmin
        from open_names where try_cast(nullif(trim(GEOMETRY_X), '') as double) is not null and try_cast(nullif(trim(GEOMETRY_Y), '') as double) is not null""",
    "case_addresses": """with s as (select unique_key, chargegeog, supplement, "supplementary-information" as info, chargeaddr,
          list_filter(list_transform([chargead00, chargead01, chargead02, postcode], lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^[ ,.]+|[ ,.]+$', '', 'g')), lambda x: x is not null and x <> '') as p from cases)
        select distinct unique_key, coalesce(case when trim(chargegeog) <> '' then chargegeog end, case when trim(supplement) <> '' then supplement end, case when trim(info) <> '' then info end, case when trim(chargeaddr) <> '' then chargeaddr end) as first_text,
          nullif(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ', '), '') as parts from s""",
    "piped_anchors": f"""with s as (select row_id, list_filter(list_transform(string_split(coalesce(lexicon_road, ''), '|'), lambda x: {_up('x')}), lambda x: x <> '') as p from geocoder_rows)
        select row_id, cast(len(list_distinct(p)) as int) as parts, array_to_string({_UNIQ.format('p')}, '/') as joined from s""",
    "page_text": """with s as (select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
          regexp_replace(text, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->|<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g')) as t from documents where text is not null)
        select doc_id, cast(length(t) as int) as n_chars, md5(t) as digest from s""",
    "postcode_sets": f"""with s as (select row_id, upper(original_address) as t from geocoder_rows), z as (select row_id, regexp_extract_all(t, '{_PC}', 1) as o, list_transform(list_zip(regexp_extract_all(t, '{_PC}', 1), regexp_extract_all(t, '{_PC}', 2)), lambda z: z[1] || ' ' || z[2]) as p from s)
        select row_id, case when o is not null then array_to_string({_UNIQ.format('p')}, '|') end as postcodes, array_to_string({_UNIQ.format('o')}, '|') as outcodes from z""",
    "address_tokens": f"""select distinct row_id, w as token from (select row_id, unnest(string_split({_up("regexp_replace(upper(original_address), '" + _PC + "', ' ', 'g')")}, ' ')) as w from geocoder_rows)
        where length(w) >= 3 and w not in ({_STOP}) and not regexp_matches(w, '^[0-9]+$')""",
    "house_numbers": f"""with s as (select row_id, {_BARE} as t from geocoder_rows), z as (select row_id, t, {_NUMBERS} as n, {_LOHI} from s)
        select row_id, case when t is not null then array_to_string(n, ',') end as numbers, case when hi is not null then lo end as lo, hi, case when hi > lo and hi - lo <= 20 and lo % 2 = hi % 2 then array_to_string(range(lo, hi + 1, 2), ',') end as one_side from z""",
    "range_cases": f"""with z as (select row_id, {_LOHI} from (select row_id, {_BARE} as t from geocoder_rows))
        select row_id, cast((number - lo) / 2 + 1 as int) as sub_case, cast(number as int) as number from (select row_id, lo, unnest(range(lo, hi + 1, 2)) as number from z where hi > lo and hi - lo <= 20 and lo % 2 = hi % 2)""",
    "relation_counts": "select " + ", ".join(f"count(*) filter (regexp_matches({_up('chargegeog')}, '{p}')) as {k}" for k, p in X.RELATIONS.items()) + " from cases",
    "road_phrases": f"""with s as (select row_id, list_filter(string_split({_up('original_address')}, ' '), lambda w: w <> '') as w from geocoder_rows),
        z as (select row_id, w, unnest(range(1, len(w) + 1)) as i from s), r as (select row_id, w[i - n + 1 : i] as r from z, (values (2), (3)) v(n) where w[i] in ({", ".join(f"'{x}'" for x in X.SUFFIXES)}) and n <= i and i > 1)
        select distinct row_id, array_to_string(r, ' ') as phrase from r where r[1] not in ({_STOP}) and not regexp_matches(r[1], '^[0-9]+[A-Z]?$')""",
    "wide_road_phrases": f"""with s as (select row_id, list_filter(string_split({_up('original_address')}, ' '), lambda w: w <> '') as w from geocoder_rows),
        z as (select row_id, w, unnest(range(1, len(w) + 1)) as i from s), r as (select row_id, w[i - n + 1 : i] as r from z, (values (2), (3), (4), (5)) v(n) where w[i] in ({", ".join(f"'{x}'" for x in X.SUFFIXES)}) and n <= i and i > 1)
        select distinct row_id, array_to_string(r, ' ') as phrase from r where r[1] not in ({_STOP}) and not regexp_matches(r[1], '^[0-9]+[A-Z]?$')""",
    "site_phrases": "select row_id, trim(split_part(original_address, ',', 1)) as site from geocoder_rows where original_address like '%,%' and trim(split_part(original_address, ',', 1)) <> '' and not regexp_matches(split_part(original_address, ',', 1), '[0-9]')",
    "before_road": f"""with s as (select row_id, {_up('original_address')} as a, {_up("split_part(lexicon_road, '|', 1)")} as r from geocoder_rows where lexicon_road is not null)
        select row_id, case when strpos(a, r) > 0 then rtrim(substr(a, 1, strpos(a, r) - 1)) end as before from s""",
    "grid_references": """with s as (select doc_id, regexp_extract(text, '(?i)grid reference ([0-9]{6}, [0-9]{6,7}|[0-9]{3} [0-9]{3})', 1) as g from documents where text is not null)
        select doc_id, case when length(g) > 7 then cast(split_part(g, ', ', 1) as double) else 400000 + 100 * cast(split_part(g, ' ', 1) as double) end as easting,
          case when length(g) > 7 then cast(split_part(g, ', ', 2) as double) else 300000 + 100 * cast(split_part(g, ' ', 2) as double) end as northing from s where g <> ''""",
    "lexicon_mentions": f"""with g as (select row_id, ' ' || {_exp('original_address')} || ' ' as t from geocoder_rows), o as (select ID, {_up('NAME1')} as n from open_names)
        select row_id, ID, cast(len(string_split(n, ' ')) as bigint) as name_words from g, o where n <> '' and strpos(t, ' ' || n || ' ') > 0""",
    "longest_mention": f"""with g as (select row_id, ' ' || {_exp('original_address')} || ' ' as t from geocoder_rows), o as (select ID, {_up('NAME1')} as n from open_names),
        m as (select row_id, ID, len(string_split(n, ' ')) as k from g, o where n <> '' and strpos(t, ' ' || n || ' ') > 0)
        select row_id, ID, n as mentions from (select row_id, ID, count(*) over (partition by row_id) as n, row_number() over (partition by row_id order by k desc, ID) as r from m) where r = 1""",
    "phrase_elements": """with s as (select ocr_id, list_filter(list_transform(road_phrases, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x is not null and x <> '') as p from ocr_evidence),
        z as (select ocr_id, list_filter(p, lambda x, i: list_position(p, x) = i) as p from s)
        select ocr_id, cast(unnest(range(len(p))) as int) as pos, unnest(p) as phrase from z""",
    "token_similarity": f"""with u as (select row_id, 'a' as side, original_address as v from geocoder_rows union all select row_id, 'b', best_address_final from geocoder_rows),
        s as (select row_id, side, v, {_BARE.replace('original_address', 'v')} as t from u), z as (select row_id, side, list_distinct(list_filter(string_split({_exp('v')}, ' '), lambda w: w <> '')) as w, case when t is not null then {_NUMBERS} end as n, {_LOHI} from s),
        j as (select a.row_id, a.w as wa, b.w as wb, a.n as na, b.n as nb, case when a.hi is not null then a.lo end as la, a.hi as ha, case when b.hi is not null then b.lo end as lb, b.hi as hb from z a join z b on a.row_id = b.row_id and a.side = 'a' and b.side = 'b')
        select row_id, case when wa is null or wb is null then 0 else round(coalesce(len(list_intersect(wa, wb)) / nullif(len(list_distinct(list_concat(wa, wb))), 0), 0), 9) end as jaccard, cast(coalesce(len(list_intersect(wa, wb)), 0) as int) as shared,
          round(1 - least(list_min(flatten(list_transform(na, lambda x: list_transform(nb, lambda y: abs(x - y))))), 140) / 140, 9) as near,
          case when la is null and lb is null then 1 when la is null or lb is null then 0 when la = lb and ha = hb then 4 when la <= hb and lb <= ha then 2 else 0 end as relation from j""",
}
