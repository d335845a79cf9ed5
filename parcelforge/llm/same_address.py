"""Which address records denote the same location: sorted neighbourhoods over addresses in differing orders of their parts, strict
in unit and number, after sorted neighbourhoods over the words have settled how places, streets and houses are spelt."""

from __future__ import annotations

import bisect
from collections import deque
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.engine import cut, drop
from parcelforge.llm.address import parse
from parcelforge.llm.canonical import osa
from parcelforge.operators.cluster import components
from parcelforge.operators.skew import heavy_frame, heavy_keys, lookup

WINDOW = 8  # heavier spellings of each level on either side that a spelling is compared with, in every pass
OUTWEIGHS = 4  # a right spelling has at least so many times the uses of its slips; also the step from level to level
FEW = 10_000  # a level of at most so many words is known to all tasks
IN_PLACES = 0.5  # share of a word's uses that stand where places do, from which it is a place
OWN_PLACE = 0.8  # share of a place's uses in one postcode district from which the place belongs to it
LONE = 2  # uses of a street in its area up to which it may be a slip of one beside it that has OUTSHINES times its uses
OUTSHINES = 2
HOT_CLASS = 2_000  # records of one location beyond which its pairs are made in several tasks
_PARSED = "rec string, unit string, street string, lead array<string>, places array<string>, postcode string"


def parsed(records: DataFrame) -> DataFrame:
    """(rec, unit, street, lead, places, postcode) of the records (rec, address) that denote something; repeated ones once."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [(rec, *a) for rec, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (a := parse(text))]
            cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["rec", "unit", "street", "lead", "places", "postcode"])

    known = records.select(F.col("rec").cast("string").alias("rec"), F.col("address").cast("string").alias("address")).where("rec is not null and address is not null")
    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.repartition(tasks, "rec", "address").dropDuplicates().mapInArrow(run, _PARSED)


def _compare(rows: list[tuple], window: int, links: list[tuple], across: bool, levels: list[int], hot: dict[int, list[tuple]]) -> None:
    """rows: (block, key, word, weight, part) in order; each word against the nearest of its block in each level of weight,
    those of the rows (levels) and those known to all tasks (hot: (block, key, word, weight) in order)."""
    at_level = {t: [i for i, r in enumerate(rows) if r[3] >= t] for t in levels}
    for i, (block, key, word, weight, part) in enumerate(rows):
        stem, _, tail = word.partition("|")
        near: set[tuple] = set()
        for t, at in at_level.items():
            if t > weight:
                j = bisect.bisect_left(at, i)
                near.update(rows[k][:4] for k in at[max(0, j - window) : j + window + 1] if not (across and rows[k][4] == part))
        for t, known in hot.items():
            if t > weight:
                j = bisect.bisect_left(known, (block, key, word))
                near.update(known[max(0, j - window) : j + window + 1])
        for block2, _, word2, weight2 in near:
            if block2 != block or weight2 < OUTWEIGHS * weight:
                continue
            stem2, _, tail2 = word2.partition("|")
            most = 2 if len(stem) >= 12 and len(stem2) >= 12 else 1
            if tail != tail2 or abs(len(stem) - len(stem2)) > most:  # type and side of a street are strict
                continue
            edits = osa(stem, stem2, 2)
            if 0 < edits <= most:
                links.append((block, word, word2, edits, weight2))


def _side_by_side(*steps) -> list:
    """The results of steps that don't need each other, run at the same time."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


class _Stored(list):
    """The tables stored on the way to a result; all but the result go when it is there."""

    def cut(self, df: DataFrame, label: str) -> DataFrame:
        self.append(cut(df, label))
        return self[-1]

    def drop(self) -> None:
        for df in self:
            drop(df)
        self.clear()


def spellings(words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(block, word, to), stored: for words of (block, word, uses) the right word of the same block they are a slip of.

    A word's weight is the uses of what stands before its first `|`, in all blocks of its kind (what stands before a tab
    in the block) together: a street's name that other streets bear, too, is no slip, however rare the street. Whether a
    word is a slip is judged by the words beside it alone: the right one has OUTWEIGHS times its weight or more and is
    itself a slip of none. So no hot word changes what is right elsewhere.

    Two passes of a sorted neighbourhood, one over the words and one over the words reversed, so that a slip at either
    end leaves the word among its neighbours in one of them. Every level of weight (4 and more, 16 and more, ...) has a
    window of its own: a word is compared with the nearest words of each level above it on both sides, by edits with
    swaps as one, of which one is allowed, or two in words of twelve letters or more; what follows a `|` must be equal.
    So no number of slips around a word can push it out, nor can the many slips of a hot word. Levels of FEW words or
    less go to all tasks; for the others rows are range-sorted by block and key, and what the ends of two ranges hold of
    each other's windows is compared in a task for each boundary. Fewest edits win, then most uses.
    """
    import pyarrow as pa

    stored = _Stored()
    own = F.concat_ws("\t", F.when(F.col("block").contains("\t"), F.substring_index("block", "\t", 1)).otherwise(F.lit("")), F.substring_index("word", "|", 1))
    words = words.withColumn("stem", own)
    weights = stored.cut(words.groupBy("stem").agg(F.sum("uses").alias("weight")), "stems")
    marked = stored.cut(lookup(words.select("block", "word", "stem"), weights, "stem").drop("stem"), "marked")
    layout = "block string, word string, to string, edits int, weight bigint, part int, place bigint, key string, boundary int"
    heaviest = marked.agg(F.max("weight")).first()[0] or 0
    steps = [OUTWEIGHS**k for k in range(1, 32) if OUTWEIGHS**k <= heaviest]
    counts = marked.agg(F.lit(0), *[F.count_if(F.col("weight") >= t) for t in steps]).first()[1:]
    levels = [t for t, n in zip(steps, counts) if n > FEW]
    few = [t for t, n in zip(steps, counts) if n <= FEW]
    heavy = [tuple(r) for r in marked.where(F.col("weight") >= few[0]).select("block", "word", "weight").collect()] if few else []
    # Given, so that few bytes with much to compare aren't put into one task; but no more ranges than leave each enough words of every level, so that the ends are a small part.
    ranges = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(ranges, *[n // (16 * window) for n in counts if n > FEW], ranges))

    def batch_of(links, edges):
        cols = {
            "block": [x[0] for x in links] + [x[0] for x in edges], "word": [x[1] for x in links] + [x[2] for x in edges], "to": [x[2] for x in links] + [None] * len(edges),
            "edits": [x[3] for x in links] + [0] * len(edges), "weight": [x[4] for x in links] + [x[3] for x in edges], "part": [0] * len(links) + [x[4] for x in edges],
            "place": [0] * len(links) + [x[5] for x in edges], "key": [None] * len(links) + [x[1] for x in edges], "boundary": [None] * len(links) + [x[6] for x in edges],
        }
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], list(cols))

    def within(batches, hot):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = [(*r, part) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "key", "word", "weight")))]
        links: list[tuple] = []
        _compare(rows, window, links, False, levels, hot)
        head, tail = 0, len(rows)
        for t in levels:
            at = [i for i, r in enumerate(rows) if r[3] >= t]
            head = max(head, at[window - 1] + 1 if len(at) > window else len(rows))
            tail = min(tail, at[-window] if len(at) > window else 0)
        first = [(*rows[i], i, part - 1) for i in range(head if part else 0)]
        last = [(*rows[i], i, part) for i in range(tail if part < ranges - 1 else len(rows), len(rows))]
        yield batch_of(links, first + last)

    def across(ends):
        rows = sorted(zip(*(ends.column(c).to_pylist() for c in ("part", "place", "block", "key", "word", "weight"))), key=lambda r: r[:2])
        links: list[tuple] = []
        _compare([(*r[2:], r[0]) for r in rows], window, links, True, levels, {})
        return pa.Table.from_batches([batch_of(links, [])])

    def one_pass(key: Column, key_of) -> DataFrame:
        known = sorted((block, key_of(word), word, weight) for block, word, weight in heavy)
        hot = {t: [r for r in known if r[3] >= t] for t in few}
        order = [F.col("block"), F.col("key"), F.col("word")]
        near = stored.cut(marked.withColumn("key", key).repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: within(batches, hot), layout), "neighbours")
        if not levels:
            return near
        return near.where("boundary is null").unionByName(near.where("boundary is not null").groupBy("boundary").applyInArrow(across, layout))

    forward, backward = _side_by_side(lambda: one_pass(F.col("word"), lambda w: w), lambda: one_pass(F.reverse(F.substring_index("word", "|", 1)), lambda w: w.partition("|")[0][::-1]))
    found = forward.unionByName(backward)
    found = stored.cut(found.select("block", "word", "to", "edits", "weight"), "found")
    right = found.join(found.select("block", F.col("word").alias("to")).distinct(), ["block", "to"], "left_anti")
    out = cut(right.groupBy("block", "word").agg(F.min_by("to", F.struct("edits", -F.col("weight"), "to")).alias("to")), "spellings")
    stored.drop()
    return out


class _Entry(NamedTuple):
    """An address class in a pass; see neighbours."""

    location: str
    unit: str
    stem: str
    tail: str
    house: str
    area: str
    postcode: str
    uses: int


def _alike(a: _Entry, b: _Entry) -> bool:
    """Do two address classes of one unit denote the same location? Unit, type and side of the street are compared by the caller, exactly.

    Their streets' names, or else the names of their houses, are one edit or swap apart (two in names of twelve letters or
    more). In one full postcode that is enough; in one area the rarer street has LONE uses or fewer there and the other
    OUTSHINES times as many, and they don't differ in their first letter alone, as few slips do and many streets.
    """
    if a.stem == b.stem:
        x, y = a.house, b.house
    elif a.house == b.house:
        x, y = a.stem, b.stem
    else:
        return False
    most = 2 if len(x) >= 12 and len(y) >= 12 else 1
    if min(len(x), len(y)) < 5 or abs(len(x) - len(y)) > most or osa(x, y, most) > most:
        return False
    if a.postcode and a.postcode == b.postcode:
        return True
    few, many = sorted((a.uses, b.uses))
    return a.area == b.area and a.area != "?" and few <= LONE and many >= OUTSHINES * few and x[1:] != y[1:]


#: The orders of the passes: number and street within the postcode; within the place; street from its end, then place; house, street, place.
ORDERS = {"postcode": ["postcode", "unit", "stem"], "place": ["area", "unit", "stem"], "street": ["unit", "backwards", "area"], "house": ["house", "unit", "stem"]}


def neighbours(classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(a, b) of locations that are the same but for slips, of classes (location, unit, stem, tail, house, area, postcode, uses).

    Sorted neighbourhoods in four orders (ORDERS): in each, every class is compared with the `window` classes before it, those
    of the range before included, with equal unit and equal type and side of the street (_alike). Rows are streamed; only the
    window, and the two ends of each range, are held.
    """
    import pyarrow as pa

    ranges = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = _Entry._fields
    layout = "a string, b string, boundary int, place int, " + ", ".join(f"{f} {'bigint' if f == 'uses' else 'string'}" for f in fields)
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64() if f == "uses" else pa.string() for f in fields]]

    def batch_of(links, ends):
        rows = [(a, b, None, None, *[None] * len(fields)) for a, b in links] + [(None, None, boundary, place, *e) for boundary, place, e in ends]
        cols = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["a", "b", "boundary", "place", *fields])

    def met(e, before, links):
        for o in before:
            if e.unit == o.unit and e.tail == o.tail and e.location != o.location and _alike(e, o):
                links.append((min(e.location, o.location), max(e.location, o.location)))

    def within(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: deque = deque(maxlen=window)
        for batch in batches:
            links, first = [], []
            for e in map(_Entry._make, zip(*(batch.column(f).to_pylist() for f in fields))):
                met(e, held, links)
                held.append(e)
                if n < window and part:
                    first.append((part - 1, window + n, e))
                n += 1
            yield batch_of(links, first)
        yield batch_of([], [(part, place, e) for place, e in enumerate(held, window - len(held))] if part < ranges - 1 else [])

    def across(ends):
        rows = sorted(zip(ends.column("place").to_pylist(), map(_Entry._make, zip(*(ends.column(f).to_pylist() for f in fields)))), key=lambda r: r[0])
        links: list[tuple] = []
        for place, e in rows:
            if place >= window:
                met(e, [o for at, o in rows if place - window <= at < window], links)
        return pa.Table.from_batches([batch_of(links, [])])

    stored = _Stored()
    keyed = classes.withColumn("backwards", F.reverse("stem"))

    def one_pass(name: str, order: list[str]) -> DataFrame:
        part = keyed.where(F.col(name) != "") if name in ("postcode", "house") else keyed.withColumn("postcode", F.lit("")).distinct()
        by = [*map(F.col, order), F.col("location")]
        near = stored.cut(part.repartitionByRange(ranges, *by).sortWithinPartitions(*by).select(*fields).mapInArrow(within, layout), "windows")
        return near.where("boundary is null").select("a", "b").unionByName(near.where("boundary is not null").groupBy("boundary").applyInArrow(across, layout).select("a", "b"))

    passes = _side_by_side(*[lambda name=name, order=order: one_pass(name, order) for name, order in ORDERS.items()])
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    out = cut(found.distinct(), "links")
    stored.drop()
    return out


def _corrected(df: DataFrame, links: DataFrame, block: Column, word: str) -> DataFrame:
    """word replaced by what it is a slip of."""
    slip = links.select(F.concat_ws("\t", "block", "word").alias("_slip"), F.col("to").alias("_to"))
    out = df.withColumn("_slip", F.coalesce(F.concat_ws("\t", block, F.col(word)), F.lit("")))
    return lookup(out, slip, "_slip", "left").withColumn(word, F.coalesce("_to", word)).drop("_slip", "_to")


def locations(records: DataFrame) -> DataFrame:
    """(rec, location), stored: the location that each record (rec, address) denotes; records that denote none are left out.

    A location is the area, the street, the strict unit (relation, flat, number or range, letter) and the house's name.
    1. Addresses are parsed where they lie. Places are learned from the records: a word that stands by a street, where
       it has a postcode, nearly always in one district is a place of that district, and either names the area; words
       of several districts (post towns, counties) name none. A record with neither gets the area of its street if
       only one area that its town allows has the street.
    2. Rare spellings of places, of streets (within their area, then of their names anywhere), and of houses' names are
       corrected by sorted neighbourhoods over the words (spellings).
    3. The addresses so spelt are compared in sorted neighbourhoods over their parts in differing orders (neighbours), which
       finds what no count of words can tell: slips of streets that hardly anybody names. What is linked is one location.
    Null, blank and filler addresses and those without a street denote nothing. A record with two different addresses
    denotes both.
    """
    stored = _Stored()
    base = stored.cut(parsed(records), "parsed")
    district = F.expr("substr(postcode, 1, length(postcode) - 3)")
    base = base.withColumn("district", F.when(F.length("postcode") > 4, district))
    seen = base.select("district", "places", F.explode(F.array_union("places", F.filter("lead", lambda x: ~x.contains(" ")))).alias("word"))
    uses = stored.cut(seen.groupBy("word", "district").agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.array_contains("places", F.col("word"))).alias("after")), "uses")
    links = spellings(uses.groupBy("word").agg(F.sum("uses").alias("uses")).select(F.lit("place\t").alias("block"), "word", "uses"))
    stored.append(links)
    uses = stored.cut(_corrected(uses, links, F.lit("place\t"), "word").groupBy("word", "district").agg(F.sum("uses").alias("uses"), F.sum("after").alias("after")), "uses")
    located = uses.where("district is not null")
    top = located.groupBy("word").agg(F.max_by("district", F.struct("uses", "district")).alias("main"), (F.max("uses") / F.sum("uses")).alias("share"), F.sum("uses").alias("total"))
    # Repeated words without digits that stand where places do; the names of houses stand before the street. A word that never has a postcode is an area of its own, where no other names one.
    place = uses.groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("after").alias("after")).where((F.col("uses") > 1) & (F.col("after") >= IN_PLACES * F.col("uses")) & ~F.col("word").rlike("[0-9]")).join(top, "word", "left")
    place = stored.cut(place.select("word", F.when(F.col("share") >= OWN_PLACE, F.col("main")).alias("area"), F.when(F.col("main").isNull(), F.col("word")).alias("own")), "places")
    towns = stored.cut(located.join(place.where("area is null and own is null").select("word"), "word").join(top.select("word", "total"), "word").where(F.col("uses") >= 0.02 * F.col("total")).select("word", "district"), "towns")

    # The words of each record, looked up once: which of them are places, and which area they name.
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    numbered = stored.cut(numbered, "rows")
    words = numbered.select("row", F.explode(F.array_union("places", F.flatten(F.transform("lead", lambda x: F.split(x, " "))))).alias("word")).withColumn("spelt", F.col("word"))
    words = lookup(stored.cut(_corrected(words, links, F.lit("place\t"), "word"), "words"), place.withColumn("known", F.lit(True)), "word", "left")
    named = words.groupBy("row").agg(
        F.max("area").alias("named"), F.max("own").alias("own"), F.collect_set(F.when(F.col("known"), F.col("spelt"))).alias("place_words"), F.min(F.when(F.col("known") & F.col("area").isNull() & F.col("own").isNull(), F.col("word"))).alias("town")
    )
    joined = numbered.join(named, "row", "left").withColumn("area", F.coalesce("named", "district", "own"))
    # A house's name: the last words before the street that are no places; with a number, only if it is an established name (below).
    bare = F.transform("lead", lambda x: F.array_join(F.filter(F.split(x, " "), lambda w: ~F.array_contains(F.coalesce("place_words", F.array().cast("array<string>")), w)), " "))
    joined = stored.cut(joined.withColumn("house", F.try_element_at(F.filter(bare, lambda x: x != ""), F.lit(-1))), "joined")

    streets = joined.where("area is not null").groupBy(F.col("area").alias("block"), F.col("street").alias("word")).agg(F.count(F.lit(1)).alias("uses"))
    streets = stored.cut(streets, "streets")
    # Slips of streets that nobody in the area spells right: their names' stems, against those of all areas.
    stems = streets.groupBy(F.lit("stem\t").alias("block"), F.substring_index("word", "|", 1).alias("word")).agg(F.sum("uses").alias("uses"))
    houses = stored.cut(joined.where("house is not null").groupBy(F.lit("house\t").alias("block"), F.col("house").alias("word")).agg(F.count(F.lit(1)).alias("uses")), "houses")
    every = spellings(streets.withColumn("block", F.concat(F.lit("street\t"), "block")).unionByName(stems).unionByName(houses))
    stored.append(every)
    slips = every.where(F.col("block").startswith("street\t")).withColumn("block", F.expr("substr(block, 8)"))
    of_house, of_stem = (every.where(F.col("block") == kind) for kind in ("house\t", "stem\t"))
    of_stem = of_stem.select(F.col("word").alias("stem"), F.col("to").alias("right"))
    left_over = streets.join(slips.select("block", "word"), ["block", "word"], "left_anti").withColumn("stem", F.substring_index("word", "|", 1))
    mended = lookup(left_over, of_stem, "stem").select("block", "word", F.concat(F.col("right"), F.expr("substr(word, length(stem) + 1)")).alias("to"))
    slips = stored.cut(slips.unionByName(mended), "slips")
    known = stored.cut(_corrected(streets.withColumnRenamed("block", "area"), slips, F.col("area"), "word").groupBy("word", "area").agg(F.sum("uses").alias("uses")).where("uses > 1"), "known")
    # Records that name no area.
    homeless = joined.where("area is null").select("row", "street", "town")
    allowed = homeless.join(known.select(F.col("word").alias("street"), F.col("area").alias("found")), "street").join(towns.select(F.col("word").alias("town"), F.col("district").alias("found"), F.lit(True).alias("ok")), ["town", "found"], "left")
    settled = allowed.where(F.col("town").isNull() | F.col("ok")).groupBy("row").agg(F.min("found").alias("found"), F.count_distinct("found").alias("n")).where("n = 1").select("row", "found")
    placed = joined.join(settled, "row", "left").withColumn("area", F.coalesce("area", "found")).drop("found")
    placed = stored.cut(_corrected(placed, slips, F.col("area"), "street"), "placed")

    placed = _corrected(placed, of_house, F.lit("house\t"), "house")
    plain = F.element_at(F.split("unit", "/"), -1) != ""
    house_known = houses.where("uses > 1").select(F.col("word").alias("house"), F.lit(True).alias("is_house"))
    placed = lookup(placed.withColumn("house", F.coalesce("house", F.lit(""))), house_known, "house", "left")
    name = F.when(plain & F.col("is_house").isNull(), F.lit("")).otherwise(F.col("house"))
    key = [F.col("area"), F.col("street"), F.col("unit"), F.col("house")]
    final = stored.cut(placed.select("rec", F.coalesce("area", F.lit("?")).alias("area"), "street", "unit", name.alias("house"), F.when(F.length("postcode") > 4, F.col("postcode")).otherwise(F.lit("")).alias("postcode")).withColumn("location", F.concat_ws("\t", *key)), "placed")
    uses = final.groupBy("area", "street").agg(F.count(F.lit(1)).alias("uses")).select(F.concat_ws("\t", "area", "street").alias("named"), "uses")
    classes = final.select("location", "unit", F.substring_index("street", "|", 1).alias("stem"), F.expr("substr(street, instr(street, '|'))").alias("tail"), "house", "area", "postcode", F.concat_ws("\t", "area", "street").alias("named")).distinct()
    classes = stored.cut(lookup(classes, uses, "named").drop("named"), "classes")
    same = neighbours(classes)
    stored.append(same)
    out = final.select("rec", "location").distinct()
    if not same.isEmpty():
        ends = same.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        roots = components(ends, same)
        stored.append(roots)
        out = lookup(out, roots.select(F.col("id").alias("location"), "root"), "location", "left").select("rec", F.coalesce("root", "location").alias("location")).distinct()
    out = cut(out, "locations")
    stored.drop()
    return out


def pairs(located: DataFrame, hot: int = HOT_CLASS) -> DataFrame:
    """(rec_a, rec_b) of different records with a location in common, rec_a < rec_b, each pair once.

    The records of one location are joined by it; a location with more than `hot` records is split into parts on one
    side. Only two records that both have several locations can meet twice; their pairs, and no others, are made distinct.
    """
    several = cut(located.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rec", F.lit(True).alias("more")), "several")
    none = several.isEmpty()
    marked = located.withColumn("more", F.lit(False)) if none else located.join(several, "rec", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    left = marked.withColumnsRenamed({"rec": "rec_a", "more": "more_a"})
    right = marked.withColumnsRenamed({"rec": "rec_b", "more": "more_b"})
    keys = ["location"]
    heavy = heavy_keys(located, keys, hot)
    if heavy:
        parts = F.broadcast(heavy_frame(located, keys, heavy, hot))
        left = left.join(parts, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("rec_a"), F.col("_salts").cast("bigint")), F.lit(0))).drop("_salts")
        right = right.join(parts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1))).drop("_salts")
        keys = [*keys, "_salt"]
    made = left.join(right, keys).where("rec_a < rec_b")
    if none:
        return made.select("rec_a", "rec_b")
    twice = F.col("more_a") & F.col("more_b")  # only such records can meet at two locations
    return made.where(~twice).select("rec_a", "rec_b").unionByName(made.where(twice).select("rec_a", "rec_b").distinct())
