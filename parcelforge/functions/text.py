"""Text normalisers, key derivations and safe parsers as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road abbreviations written out.
ABBREVIATIONS = {
    "RD": "ROAD", "ST": "STREET", "AVE": "AVENUE", "AV": "AVENUE", "LN": "LANE", "LA": "LANE", "CL": "CLOSE", "CT": "COURT", "CRT": "COURT", "CRES": "CRESCENT", "DR": "DRIVE",
    "GDNS": "GARDENS", "GR": "GROVE", "GRV": "GROVE", "PL": "PLACE", "SQ": "SQUARE", "TER": "TERRACE", "TERR": "TERRACE",
}
COMPASS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST"}


def plain_upper(c: Column, look_alikes: tuple[str, str] | None = None) -> Column:
    """Upper case, everything but letters and digits one space, trimmed; look_alikes = (from, to) digits read as letters first."""
    up = F.upper(c)
    if look_alikes:
        up = F.translate(up, *look_alikes)
    return F.trim(F.regexp_replace(up, "[^A-Z0-9]+", " "))


def ocr_upper(c: Column) -> Column:
    """plain_upper with 0 read as O."""
    return plain_upper(c, ("0", "O"))


def plan_upper(c: Column) -> Column:
    """plain_upper with 0, 1, 5, 8 read as O, I, S, B."""
    return plain_upper(c, ("0158", "OISB"))


def compact(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def squeezed(c: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def squeezed_edges(c: Column) -> Column:
    """squeezed, and without spaces, commas and full stops at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ ,.]+|[ ,.]+$", "")


def words(c: Column) -> Column:
    """The words of a normalised text; none for an empty one."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def expanded(c: Column, table: dict[str, str] | None = None, joiner: str = " ") -> Column:
    """plain_upper with the abbreviations of the table written out."""
    table = table or ABBREVIATIONS
    full = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.array_join(F.transform(words(plain_upper(c)), lambda w: F.coalesce(F.try_element_at(full, w), w)), joiner)


def safe_file_name(c: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), 1, most)


def number(c: Column) -> Column:
    """A finite double, or null: for texts that are no number, NaN and infinities."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def truth(c: Column) -> Column:
    """True for true, 1, yes, y in any case; false for anything else and null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def filled_parts(*cols: Column) -> Column:
    """The filled ones, squeezed, each text once, in order, joined by commas; null if there is none."""
    joined = F.array_join(F.array_distinct(F.filter(F.array(*[squeezed_edges(c) for c in cols]), lambda x: x.isNotNull() & (x != ""))), ", ")
    return F.when(joined != "", joined)


def last_path_part(c: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(F.regexp_replace(c, r"\\", "/"), "([^/]*)$", 1)


def base_key(c: Column) -> Column:
    """A key without its `_n`."""
    return F.regexp_replace(c, r"_\d+$", "")


def folder_reference(c: Column) -> Column:
    """The letters and number of a folder name such as ABC_0012, as ABC-12; null if there is none."""
    letters, digits = F.regexp_extract(c, r"([A-Z]+)_0*(\d+)", 1), F.regexp_extract(c, r"([A-Z]+)_0*(\d+)", 2)
    return F.when(letters != "", F.concat_ws("-", letters, digits))


def piped(c: Column) -> Column:
    """The parts of `a | b | c`, normalised, each once, in order; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: plain_upper(x)), lambda x: x != ""))


def ordered_unique(c: Column) -> Column:
    """An array's elements that are neither null nor blank, each once, at its first place; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: squeezed(x)), lambda x: x.isNotNull() & (x != "")))


def without_markup(c: Column) -> Column:
    """A page's text: scripts, styles, comments and tags removed, the common entities resolved, squeezed."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeezed(t)
