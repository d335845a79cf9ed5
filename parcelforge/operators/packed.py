"""Several values packed in one text: one row per value, positions kept. All in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, ESCAPE = "\ue000", "\ue001"  # private-use characters: the one brackets the number of a placeholder
WIDE = "|;,/\\t\\r\\n"
NARROW = "|;\\t\\r\\n"
_EDGE = r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$"
_BLANK, _GAP = r"[\s\u00a0\u200b\ufeff]", r"[ \f\x0B\u00a0\u200b\ufeff]"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def _once(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def packed_values(text: Column, delimiters: str = WIDE, brackets: bool = True) -> Column:
    """Array of the values of a text, in order.

    Quoted spans (`"..."`, with `""` or `\\"` for a quote inside) that begin a value, or follow a colon or equals
    sign, with any number of blanks before them, are replaced by numbered placeholders; the rest is split at any of `delimiters` (the inside of a regular
    expression's character class); the placeholders are then looked up again in the array of spans. A character of the
    text that equals the placeholder's mark is escaped first, so nothing can collide. Values are trimmed and stripped
    of their quotes, empty ones dropped. With `brackets`, a text that is one [list] is read without its brackets.
    Null gives null; an empty or blank text, or one of delimiters only, gives an empty array. A quote that is never
    closed is an ordinary character.
    """
    body = _strip(text)
    if brackets:
        body = F.regexp_replace(body, r"(?s)^\[(.*)\]$", "$1")
    body = F.replace(F.replace(body, F.lit(ESCAPE), F.lit(f"{ESCAPE}f")), F.lit(MARK), F.lit(f"{ESCAPE}e"))
    # What a quote that begins a value follows: the start, a delimiter, or a colon or equals sign, and blanks of any number. Of
    # delimiters that are blanks themselves only the last one is tried, so that no run of blanks is read more than once.
    before = rf"^{_BLANK}*+|(?:[{delimiters}:=&&[^\t\r\n]]{_BLANK}*+|[{delimiters}&&[\t\r\n]]{_GAP}*+)"
    quoted = rf'({before})("(?:[^"\\]|""|\\.)*+")(?!")'

    def numbered(outside: Column, leads: Column) -> Column:
        return F.array_join(F.transform(outside, lambda piece, i: F.concat(piece, F.when(i < F.size(leads), F.concat(F.get(leads, i), F.lit(MARK), i.cast("string"), F.lit(MARK))).otherwise(F.lit("")))), "")

    def restore(piece: Column, spans: Column) -> Column:
        """Every second part between marks is the number of a span; a piece that is nothing but one span loses its quotes."""

        def joined(parts: Column) -> Column:
            span = lambda n: F.get(spans, n.try_cast("int"))
            inner = lambda q: F.regexp_replace(F.substring(q, 2, F.length(q) - 2), r'""|\\"', '"')
            alone = (F.size(parts) == 3) & (_strip(F.get(parts, F.lit(0))) == "") & (_strip(F.get(parts, F.lit(2))) == "")
            every = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, span(p)).otherwise(p)), "")
            return F.when(alone, inner(span(F.get(parts, F.lit(1))))).otherwise(every)

        return F.when(~piece.contains(MARK), piece).otherwise(_once(F.split(piece, MARK, -1), joined))

    def plain(v: Column) -> Column:
        return _strip(F.replace(F.replace(v, F.lit(f"{ESCAPE}e"), F.lit(MARK)), F.lit(f"{ESCAPE}f"), F.lit(ESCAPE)))

    def split(parts: Column) -> Column:
        pieces = F.split(numbered(parts["outside"], parts["leads"]), f"[{delimiters}]", -1)
        return F.filter(F.transform(pieces, lambda piece: plain(restore(piece, parts["spans"]))), lambda v: v != "")

    def read_plain(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, f"[{delimiters}]", -1), plain), lambda v: v != "")

    # Each step's result is bound once: an expression inside a lambda would be computed again for every element.
    return F.when(text.isNotNull(), _once(body, lambda t: F.when(t.contains('"'), _once(F.struct(F.regexp_extract_all(t, F.lit(quoted), 1).alias("leads"), F.regexp_extract_all(t, F.lit(quoted), 2).alias("spans"), F.split(t, quoted, -1).alias("outside")), split)).otherwise(read_plain(t))))


def unpack(df: DataFrame, text_col: str, keep: list[str], delimiters: str = WIDE, brackets: bool = True, least: int = 1) -> DataFrame:
    """One row per value: the columns `keep`, pos (from 1) and value, of texts with at least `least` values.

    Rows stay in their partition: no shuffle. Other columns of df, whatever their names, don't matter.
    """
    packed = df.select(*[F.col(f"`{c}`") for c in keep], packed_values(F.col(f"`{text_col}`"), delimiters, brackets).alias("_values"))
    exploded = packed.where(F.size("_values") >= least).select(*[F.col(f"`{c}`") for c in keep], F.posexplode("_values").alias("_at", "value"))
    return exploded.select(*[F.col(f"`{c}`") for c in keep], (F.col("_at") + 1).cast("long").alias("pos"), "value")
