import math
import random
import struct

from parcelforge.operators.cluster import single_link
from parcelforge.operators.ordered import running_total
from parcelforge.operators.skew import lookup, with_salt
from parcelforge.functions.geometry import contains, rings
from parcelforge.operators.spatial import inside_boxes, inside_polygons, near_in_group, within_distance
from parcelforge.operators.suppress import suppress
from pyspark.sql import functions as F

ODD = [None, math.nan, math.inf, -math.inf]


def points(rng, n, base=0):
    return [(base + i, rng.uniform(-200, 200), rng.uniform(-200, 200)) for i in range(n)]


def test_within_distance(spark):
    rng = random.Random(1)
    p = points(rng, 300) + [(1000 + i, o, 1.0) for i, o in enumerate(ODD)] + [(5000, 0.0, 0.0), (5000, 0.0, 0.0)]
    u = [(str(i), x, y) for i, x, y in points(rng, 300)] + [("edge", 30.0, 0.0), ("off", 30.0001, 0.0)] + [("n", None, None)]
    a = spark.createDataFrame([(*r, 1) for r in p], "id long, x double, y double, other_id int")
    b = spark.createDataFrame(u, "uid string, x double, y double")
    want = {(i, j) for i, x, y in p if x is not None and math.isfinite(x) for j, ux, uy in u if ux is not None and (x - ux) ** 2 + (y - uy) ** 2 <= 900}
    for hot in (10_000, 5):  # 5: nearly every cell is split
        got = [(r.id, r.other_id) for r in within_distance(a, b, ("id", "x", "y"), ("uid", "x", "y"), 30.0, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (5000, "edge") in want and (5000, "off") not in want
    assert within_distance(a.limit(0), b, ("id", "x", "y"), ("uid", "x", "y"), 30.0).count() == 0


def test_inside_boxes(spark):
    rng = random.Random(2)
    p = points(rng, 300) + [(900, 50.0, 50.0), (901, math.nan, 0.0)]
    b = [(i, rng.uniform(-200, 200), rng.uniform(-200, 200), s) for i, s in enumerate([0.5, 3.0, 80.0, 180.0, 220.5, 1e7] * 10)] + [(100, 0.0, 0.0, 100.0), (101, 0.0, 0.0, -5.0), (102, 50.0, 50.0, 0.0), (103, None, 0.0, 5.0), (104, 0.0, 0.0, math.nan)]
    want = {(i, j) for i, x, y in p if math.isfinite(x) for j, cx, cy, s in b if cx is not None and s >= 0 and abs(x - cx) <= s / 2 and abs(y - cy) <= s / 2}
    a, c = spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(b, "bid long, cx double, cy double, s double")
    for hot in (10_000, 7):
        got = [(r.id, r.box_id) for r in inside_boxes(a, c, ("id", "x", "y"), ("bid", "cx", "cy", "s"), hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (900, 100) in want and (900, 102) in want
    assert inside_boxes(a, c.limit(0), ("id", "x", "y"), ("bid", "cx", "cy", "s")).count() == 0


def test_suppress_is_the_greedy_pass(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.uniform(0, 300), rng.uniform(0, 300), rng.randrange(8)) for g in ("a", "b", None) for i in range(120)] + [("a", 500, math.nan, 1.0, 9), ("c", 1, 0.0, 0.0, 1), ("c", 2, 40.0, 0.0, 1)]
    want = set()
    for g in ("a", "b", "c"):
        kept = []
        for r in sorted((r for r in rows if r[0] == g and math.isfinite(r[2])), key=lambda r: (-r[4], r[1])):
            if all(math.hypot(r[2] - k[2], r[3] - k[3]) >= 40 for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept[:6]}
    df = spark.createDataFrame(rows, "g string, i int, x double, y double, s int")
    got = {(r.g, r.i) for r in suppress(df, "g", "x", "y", [-F.col("s"), F.col("i")], 40.0, 6).collect()}
    assert got == want and {("c", 1), ("c", 2)} <= got


def test_single_link(spark):
    chain = [("a", i, 10.0 * i, 0.0) for i in range(30)] + [("a", 100 + i, 10.0 * i, 500.0) for i in range(3)] + [("b", 1, 0.0, 0.0)]
    got = {(r.g, r.i): r.cluster for r in single_link(spark.createDataFrame(chain, "g string, i long, x double, y double"), "g", "i", "x", "y", 10.0).collect()}
    assert all(got["a", i] == 0 for i in range(30)) and got["a", 102] == 100 and got["b", 1] == 1


def test_running_total(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.random(), rng.choice([1, 2, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o double, w int, i int")
    for within in ([], ["k"]):
        got = {r.i: (r.run, r.n) for r in running_total(df, [F.col("o"), F.col("i")], F.col("w"), "run", "n", within).collect()}
        for key in "ab" if within else [None]:
            total = 0
            for n, r in enumerate(sorted((r for r in rows if key in (None, r[0])), key=lambda r: (r[1], r[3]))):
                total += r[2] or 0
                assert got[r[3]] == (total, n)
    assert running_total(df.limit(0), [F.col("o")], F.col("w"), "run").count() == 0


def test_hot_keys(spark):
    rows = [("hot", i) for i in range(2000)] + [(str(i), i) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i long")
    salted = with_salt(df, ["k"], F.xxhash64("i"), 300)
    assert salted.count() == 2100 and salted.where("k = 'hot'").select("_salt").distinct().count() == 7 and salted.where("k <> 'hot' and _salt <> 0").count() == 0
    right = spark.createDataFrame([("hot", 1), ("5", 2)], "k string, v int")
    for least in (300, 10**9):
        assert lookup(df, right, "k", "left", least).count() == 2100
        assert lookup(df, right, "k", "inner", least).count() == 2001


def polygon(*parts):
    return struct.pack("<BII", 1, 3, len(parts)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in parts)


def test_inside_polygons(spark):
    rng = random.Random(30)
    shapes = []
    for i in range(40):
        cx, cy, r = rng.uniform(-150, 150), rng.uniform(-150, 150), rng.choice([2, 30, 120])
        ring = [(cx + r * rng.uniform(0.5, 1) * math.cos(k * 0.7), cy + r * rng.uniform(0.5, 1) * math.sin(k * 0.7)) for k in range(9)]
        hole = [(cx - r / 9, cy - r / 9), (cx + r / 9, cy - r / 9), (cx, cy + r / 9), (cx - r / 9, cy - r / 9)]
        shapes.append((i, bytearray(polygon([*ring, ring[0]], hole))))
    p = points(rng, 400) + [(900, math.nan, 0.0)]
    want = {(i, j) for i, x, y in p if math.isfinite(x) for j, g in shapes if contains(rings(bytes(g)), x, y)}
    a = spark.createDataFrame(p, "id long, x double, y double")
    b = spark.createDataFrame([*shapes, shapes[0], (77, None), (78, bytearray(b"bad"))], "pid long, g binary")
    got = [(r.id, r.polygon_id) for r in inside_polygons(a, b, ("id", "x", "y"), ("pid", "g")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_near_in_group(spark):
    rng = random.Random(31)
    a = [(rng.choice("ab"), i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(150)] + [(None, 900, 1.0, 1.0)]
    b = [(rng.choice("ab"), i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(150)] + [("a", 901, None, 1.0)]
    want = {(i, j) for g, i, x, y in a if g for h, j, u, v in b if g == h and u is not None and math.hypot(x - u, y - v) <= 25}
    left, right = spark.createDataFrame(a, "g string, i long, ax double, ay double"), spark.createDataFrame(b, "g string, j long, bx double, by double")
    for hot in (10_000, 4):
        got = [(r.i, r.j) for r in near_in_group(left, right, "g", ("ax", "ay"), ("bx", "by"), 25.0, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def largest_task_share(spark, df):
    """The share of rows that the fullest task of the last exchange holds."""
    sizes = [r["count"] for r in df.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()]
    return max(sizes) / sum(sizes)


def test_crowded_cells_are_split_on_either_side(spark):
    from parcelforge.operators.spatial import split_hot

    crowd = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"))
    crowd = crowd.withColumns({"cx": F.floor(F.col("x") / 60), "cy": F.lit(0)})
    few = spark.createDataFrame([(i, 0, 0) for i in range(3)], "other_id long, cx long, cy int")
    for left, right, ids in ((crowd, few, (["id"], ["other_id"])), (few, crowd, (["other_id"], ["id"]))):
        a, b, keys = split_hot(left, right, ["cx", "cy"], *ids, 1_000)
        full = a if left is crowd else b
        assert full.groupBy(*keys).count().agg(F.max("count")).first()[0] < 1_500  # of 20,000 rows in one cell
        assert a.join(b, keys).count() == 3 * 20_000 + 3 * 40  # every pair of equal cells once


def test_crowded_polygon(spark):
    rng = random.Random(9)
    p = [(i, rng.uniform(-20, 120), rng.uniform(-20, 120)) for i in range(3000)]
    square = [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]
    hole = [(40, 40), (60, 40), (60, 60), (40, 60), (40, 40)]
    wkb = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", 5) + b"".join(struct.pack("<dd", *c) for c in ring) for ring in (square, hole))
    a = spark.createDataFrame(p, "id long, x double, y double")
    g = spark.createDataFrame([("big", bytearray(wkb)), ("again", bytearray(wkb)), ("bad", bytearray(b"\x01")), (None, None)], "pid string, geom binary")
    want = {(i, name) for i, x, y in p if 0 <= x <= 100 and 0 <= y <= 100 and not (40 < x < 60 and 40 < y < 60) for name in ("big", "again")}
    for hot in (100_000, 50):
        got = [(r.id, r.polygon_id) for r in inside_polygons(a, g, ("id", "x", "y"), ("pid", "geom"), hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_single_link_in_a_crowd(spark):
    """Two crowds of many items on few places, joined by a chain; and a third one just too far away."""
    rows = [("g", i, (i % 7) * 1.0, 0.0) for i in range(3000)] + [("g", 5000 + i, 80.0 + 60.0 * i, 0.0) for i in range(4)] + [("g", 6000 + i, 340.0 + i % 5, 0.0) for i in range(3000)] + [("g", 9000 + i, 425.0, 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {r.i: r.cluster for r in single_link(df, "g", "i", "x", "y", 80.0).collect()}
    assert len(got) == len(rows) and {got[i] for i in (*range(3000), *range(5000, 5004), *range(6000, 9000))} == {0} and {got[i] for i in range(9000, 9500)} == {9000}


def test_following_rows(spark):
    from parcelforge.operators.ordered import following

    rng = random.Random(10)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.random()) for i in range(2000)]
    want, last = {}, {}
    for g, i, v in sorted(rows, key=lambda r: -r[1]):
        want[i] = last.get(g)
        last[g] = v
    got = {r.i: r.after for r in following(spark.createDataFrame(rows, "g string, i int, v double"), [F.col("i")], ["g"], {"after": "v"}).collect()}
    assert got == want
