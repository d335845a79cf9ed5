"""Things found in texts, as column expressions that return arrays or structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import plain_upper, words

# Words that carry no place, and road suffixes.
STOP = ("THE", "AND", "FOR", "OFF", "LAND", "REAR", "SITE", "ADJ", "ADJACENT", "NEAR", "WITH", "FROM", "BETWEEN", "PLOT", "UNIT", "FLAT")
SUFFIXES = ("AVENUE", "CLOSE", "COURT", "CRESCENT", "DRIVE", "GARDENS", "GROVE", "HILL", "LANE", "MEWS", "PARADE", "PLACE", "ROAD", "ROW", "SQUARE", "STREET", "TERRACE", "WAY")
POSTCODE = r"\b([A-Z]{1,2}[0-9][0-9A-Z]?)\s*([0-9][A-Z]{2})\b"
RELATIONS = {
    "adjacent": r"\b(ADJ|ADJACENT|ADJOINING|NEXT TO|BESIDE)\b", "rear": r"\b(REAR|R O|BEHIND)\b", "land_off": r"\bLAND (AT |OFF |ON )", "junction": r"\b(JUNCTION|CORNER)\b",
    "between": r"\bBETWEEN\b", "plot": r"\bPLOTS?\b", "unit": r"\bUNITS?\b", "former": r"\b(FORMER|FORMERLY)\b",
}


def postcodes(c: Column) -> Column:
    """Distinct postcodes as `OUT IN`, in order of appearance."""
    up = F.upper(c)
    return F.array_distinct(F.zip_with(F.regexp_extract_all(up, F.lit(POSTCODE), 1), F.regexp_extract_all(up, F.lit(POSTCODE), 2), lambda a, b: F.concat_ws(" ", a, b)))


def outcodes(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(c), F.lit(POSTCODE), 1))


def without_postcodes(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), POSTCODE, " ")


def content_tokens(c: Column, least: int = 3) -> Column:
    """Distinct words outside postcodes, of `least` letters or more, no stop words, no numbers."""
    return F.array_distinct(F.filter(words(plain_upper(without_postcodes(c))), lambda w: (F.length(w) >= least) & ~w.isin(*STOP) & ~w.rlike("^[0-9]+$")))


def house_numbers(c: Column, span: int = 30) -> Column:
    """Distinct numbers from 1 to 999 outside postcodes, ascending; a range `a-b` of at most `span` counts as all its numbers."""
    t = F.regexp_replace(without_postcodes(c), "[–—]", "-")
    rng = r"\b([0-9]{1,3})[A-Z]?\s*(?:-|/|\bTO\b|\bAND\b)\s*([0-9]{1,3})[A-Z]?\b"
    lo, hi = (F.transform(F.regexp_extract_all(t, F.lit(rng), i), lambda x: x.cast("int")) for i in (1, 2))
    spread = F.flatten(F.zip_with(lo, hi, lambda a, b: F.when((b >= a) & (b - a <= span), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))))
    single = F.transform(F.regexp_extract_all(t, F.lit(r"\b([0-9]{1,3})[A-Z]?\b"), 1), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(spread, single), lambda n: (n > 0) & (n < 1000))))


def range_of(c: Column) -> Column:
    """struct(lo, hi) of the first range `a-b`, or null."""
    t = F.regexp_replace(without_postcodes(c), "[–—]", "-")
    rng = r"\b([0-9]{1,3})[A-Z]?\s*(?:-|\bTO\b)\s*([0-9]{1,3})[A-Z]?\b"
    lo, hi = (F.regexp_extract(t, rng, i).try_cast("int") for i in (1, 2))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def same_parity_numbers(r: Column, most: int = 20) -> Column:
    """The numbers of a range on one side of the street: every other one, if both ends are odd or even and at most `most` apart."""
    lo, hi = r["lo"], r["hi"]
    ok = (hi > lo) & (hi - lo <= most) & (lo % 2 == hi % 2)
    return F.when(ok, F.sequence(lo, F.greatest(lo, hi), F.lit(2)))


def road_phrases(c: Column, widest: int = 5) -> Column:
    """Every run of 2 to `widest` words that ends in a road suffix, in order, without leading numbers and stop words."""
    w = words(plain_upper(c))
    at = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*SUFFIXES), i)), lambda i: i.isNotNull() & (i > 0))
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(2), F.lit(widest)), lambda n: F.when(n <= i + 1, F.slice(w, i + 2 - n, n)))))
    kept = F.filter(runs, lambda r: r.isNotNull() & ~r[0].isin(*STOP) & ~r[0].rlike("^[0-9]+[A-Z]?$"))
    return F.array_distinct(F.transform(kept, lambda r: F.array_join(r, " ")))


def relation_flags(c: Column) -> Column:
    """struct of booleans, one for each relation."""
    up = plain_upper(c)
    return F.struct(*[F.coalesce(up.rlike(p), F.lit(False)).alias(k) for k, p in RELATIONS.items()])


def site_phrase(c: Column) -> Column:
    """The part before the first comma, if it holds a word and no number; else null."""
    head = F.trim(F.split(c, ",")[0])
    return F.when((head != "") & ~head.rlike("[0-9]") & c.contains(","), head)


def text_before(c: Column, phrase: Column) -> Column:
    """What stands before a phrase's first appearance; null where it doesn't appear."""
    at = F.position(phrase, c)
    return F.when(at > 0, F.rtrim(F.substring(c, F.lit(1), at - 1)))


def grid_digits(c: Column) -> Column:
    """Text with letters that scanners make of digits read as digits again."""
    return F.translate(F.upper(c), "OQDILSZBG", "000115286")


def grid_reference(c: Column, easting_origin: int = 0, northing_origin: int = 0) -> Column:
    """struct(easting, northing) of the first `6 digits, 6 digits` (metres) or `3 digits 3 digits` (hundreds of metres within the square at the origin); else null."""
    long = r"\b([0-9]{6})\s*[,/ ]\s*([0-9]{6,7})\b"
    short = r"\b([0-9]{3})[ /]([0-9]{3})\b"
    e6, n6 = (F.regexp_extract(c, long, i).try_cast("double") for i in (1, 2))
    e3, n3 = (F.regexp_extract(c, short, i).try_cast("double") for i in (1, 2))
    e = F.coalesce(e6, easting_origin + e3 * 100)
    n = F.when(e6.isNotNull(), n6).otherwise(northing_origin + n3 * 100)
    return F.when(e.isNotNull() & n.isNotNull(), F.struct(e.alias("easting"), n.alias("northing")))
