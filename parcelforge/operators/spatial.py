"""Distance and containment joins over hashed grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.operators.skew import heavy_frame, heavy_keys

HOT_CELL = 20_000  # rows of one cell beyond which the cell is split


def finite(*cols: Column) -> Column:
    """True if none of the numbers is null, NaN or infinite."""
    ok = F.lit(True)
    for c in cols:
        d = c.cast("double")
        ok = ok & d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
    return ok


def _cell(v: Column, size: Column | float) -> Column:
    return F.floor(v / size).cast("double")  # double: a far coordinate can't overflow


def split_hot(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], hot: int = HOT_CELL) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with further keys, so that no key has more than about `hot` rows of either side in one task.

    Keys of each side are counted (with map-side combining); those beyond `hot`, of which there is a bounded number
    (heavy_keys), are dealt into parts by a hash of the side's id columns, and the rows of the other side with such a
    key are repeated once per part.
    """
    sides = [left, right]
    for own, other, ids, salt in ((0, 1, left_id, "_salt"), (1, 0, right_id, "_salt_right")):
        heavy = heavy_keys(sides[own], keys, hot)
        if heavy:
            salts = F.broadcast(heavy_frame(sides[own], keys, heavy, hot))
            sides[own] = sides[own].join(salts, keys, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*ids), F.col("_salts").cast("bigint")).cast("int"), F.lit(0))).drop("_salts")
            sides[other] = sides[other].join(salts, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return sides[0], sides[1], [*keys, *[c for c in ("_salt", "_salt_right") if c in sides[0].columns]]


def within_distance(points: DataFrame, others: DataFrame, point: tuple[str, str, str], other: tuple[str, str, str], radius: float, hot: int = HOT_CELL) -> DataFrame:
    """Distinct (id, other_id, distance_m) with at most `radius` between them, edge included.

    point and other are (id, x, y) column names. A cell is two radii wide, so a point reaches into at most four of
    them: the points go to the cells that their circle's box touches, the others to their own cell only, and every
    pair meets in exactly one cell. Repeated rows count once; rows with a null or non-finite coordinate have no place.
    Crowded cells are split (split_hot). Distance is exact, in the plane of the coordinates.
    """
    side = 2.0 * radius
    p = points.select(F.col(point[0]).alias("id"), F.col(point[1]).cast("double").alias("x"), F.col(point[2]).cast("double").alias("y")).where(finite(F.col("x"), F.col("y"))).distinct()
    o = others.select(F.col(other[0]).alias("other_id"), F.col(other[1]).cast("double").alias("ox"), F.col(other[2]).cast("double").alias("oy")).where(finite(F.col("ox"), F.col("oy"))).distinct()
    reach = lambda v: F.array_distinct(F.array(_cell(F.col(v) - radius, side), _cell(F.col(v) + radius, side)))
    p = p.withColumn("cx", F.explode(reach("x"))).withColumn("cy", F.explode(reach("y")))
    o = o.withColumns({"cx": _cell(F.col("ox"), side), "cy": _cell(F.col("oy"), side)})
    p, o, keys = split_hot(p, o, ["cx", "cy"], ["id", "x", "y"], ["other_id", "ox", "oy"], hot)
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return p.join(o, keys).where(d2 <= radius * radius).select("id", "other_id", F.sqrt(d2).alias("distance_m"))


def inside_boxes(points: DataFrame, boxes: DataFrame, point: tuple[str, str, str], box: tuple[str, str, str, str], hot: int = HOT_CELL) -> DataFrame:
    """Distinct (id, box_id) of points in, or on the edge of, axis-parallel squares given by centre and side.

    box is (id, centre x, centre y, side). Squares lie in a grid of their own magnitude: that of side s has cells of
    the next power of two at or above s (one metre at least), so any square touches at most four cells whatever its
    size, and a point looks into one cell of each magnitude that occurs. The magnitudes are at most some 2,000 (the
    exponents of a double), in practice a handful; they are listed once. A square with a null, non-finite or negative
    number is nowhere; one of side 0 holds the points on its centre.
    """
    return _in_boxes(points, boxes, point, box, hot).select("id", "box_id")


def _in_boxes(points: DataFrame, boxes: DataFrame, point: tuple[str, str, str], box: tuple[str, str, str, str], hot: int) -> DataFrame:
    """inside_boxes, with the points' places: (id, x, y, box_id)."""
    p = points.select(F.col(point[0]).alias("id"), F.col(point[1]).cast("double").alias("x"), F.col(point[2]).cast("double").alias("y")).where(finite(F.col("x"), F.col("y"))).distinct()
    b = boxes.select(F.col(box[0]).alias("box_id"), *[F.col(c).cast("double").alias(a) for c, a in zip(box[1:], ("bx", "by", "side"))])
    b = b.where(finite(F.col("bx"), F.col("by"), F.col("side")) & (F.col("side") >= 0)).distinct()
    b = b.withColumn("level", F.ceil(F.log2(F.greatest(F.col("side"), F.lit(1.0)))).cast("int"))
    levels = sorted(r[0] for r in b.select("level").distinct().collect())
    half = F.col("side") / 2
    cell = F.pow(F.lit(2.0), F.col("level"))
    reach = lambda v: F.array_distinct(F.array(_cell(F.col(v) - half, cell), _cell(F.col(v) + half, cell)))
    b = b.withColumn("cx", F.explode(reach("bx"))).withColumn("cy", F.explode(reach("by")))
    p = p.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    p = p.withColumns({"cx": _cell(F.col("x"), cell), "cy": _cell(F.col("y"), cell)})
    p, b, keys = split_hot(p, b, ["level", "cx", "cy"], ["id", "x", "y"], ["box_id", "bx", "by"], hot)
    held = (F.abs(F.col("x") - F.col("bx")) <= half) & (F.abs(F.col("y") - F.col("by")) <= half)
    return p.join(b, keys).where(held).select("id", "x", "y", "box_id")


def near_in_group(left: DataFrame, right: DataFrame, group: str, left_xy: tuple[str, str], right_xy: tuple[str, str], radius: float, hot: int = HOT_CELL) -> DataFrame:
    """Rows of left and right of the same group at most `radius` apart, with `distance_m`; right's columns must have names of their own.

    As within_distance, with the group as part of the cell's key. Rows without a place or group are left out; equal
    rows stay equal rows.
    """
    side = 2.0 * radius
    x, y = (F.col(c).cast("double") for c in left_xy)
    ox, oy = (F.col(c).cast("double") for c in right_xy)
    reach = lambda v: F.array_distinct(F.array(_cell(v - radius, side), _cell(v + radius, side)))
    a = left.where(finite(x, y) & F.col(group).isNotNull()).withColumns({"id": F.monotonically_increasing_id(), "x": x, "y": y})
    a = a.withColumn("cx", F.explode(reach(F.col("x")))).withColumn("cy", F.explode(reach(F.col("y"))))
    b = right.where(finite(ox, oy) & F.col(group).isNotNull()).withColumns({"_ox": ox, "_oy": oy}).withColumns({"cx": _cell(ox, side), "cy": _cell(oy, side)})
    a, b, keys = split_hot(a, b.withColumn("_right", F.monotonically_increasing_id()), [group, "cx", "cy"], ["id"], ["_right"], hot)
    d = F.hypot(F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy"))
    return a.join(b, keys).withColumn("distance_m", d).where(F.col("distance_m") <= radius).drop("id", "x", "y", "_ox", "_oy", "cx", "cy", "_salt", "_salt_right", "_right")


def inside_polygons(points: DataFrame, polygons: DataFrame, point: tuple[str, str, str], polygon: tuple[str, str], hot: int = HOT_CELL) -> DataFrame:
    """Distinct (id, polygon_id) of points in, or on an edge of, polygons given as WKB; holes are outside.

    The polygons' boxes meet the points in grids of the boxes' own magnitudes (as in inside_boxes: a box that isn't
    square is taken as the square around it). What is in a box is tested exactly: the points of a polygon's box follow the
    polygon in one sorted stream, so that its WKB travels and is decoded once, not once per point; a polygon whose box
    holds more than `hot` points comes in several such streams. Null, damaged and other geometries hold nothing.
    """
    import pyarrow as pa

    from parcelforge.functions.geometry import contains, rings, shape

    g = polygons.select(F.col(polygon[0]).alias("polygon_id"), F.col(polygon[1]).alias("wkb")).where("wkb is not null").distinct().withColumn("s", shape(F.col("wkb"))).where("s.minx is not null")
    g = g.withColumns({"px": (F.col("s.minx") + F.col("s.maxx")) / 2, "py": (F.col("s.miny") + F.col("s.maxy")) / 2, "side": F.greatest(F.col("s.maxx") - F.col("s.minx"), F.col("s.maxy") - F.col("s.miny"))})
    keyed = g.withColumn("key", F.struct("polygon_id", F.md5("wkb").alias("shape")))
    held = _in_boxes(points, keyed, point, ("key", "px", "py", "side"), hot).withColumnRenamed("box_id", "key")
    shapes = keyed.select("key", "wkb")
    heavy = heavy_keys(held, ["key"], hot)
    if heavy:
        salts = F.broadcast(heavy_frame(held, ["key"], heavy, hot))
        held = held.join(salts, "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "x", "y"), F.col("_salts").cast("bigint")).cast("int"), F.lit(0))).drop("_salts")
        shapes = shapes.join(salts, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    else:
        held, shapes = held.withColumn("salt", F.lit(0)), shapes.withColumn("salt", F.lit(0))
    kinds = dict(held.dtypes)
    first = shapes.select("key", "salt", "wkb", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    stream = first.unionByName(held.select("key", "salt", F.lit(None).cast("binary").alias("wkb"), "id", "x", "y"))
    stream = stream.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("wkb").isNull())
    named = stream.select("id", F.col("key.polygon_id").alias("polygon_id"), "x", "y", "wkb")

    def run(batches):
        shape: list = []
        for batch in batches:
            keep = []
            for x, y, wkb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if wkb is not None:
                    shape = rings(wkb)
                keep.append(wkb is None and contains(shape, x, y))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    out = named.mapInArrow(run, f"id {kinds['id']}, polygon_id {dict(polygons.dtypes)[polygon[0]]}")
    return out.distinct()
