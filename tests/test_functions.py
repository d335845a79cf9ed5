import difflib
import math
import random
import struct

import pytest
from parcelforge.functions import extract as X
from parcelforge.functions import geometry as G
from parcelforge.functions import similarity as M
from parcelforge.functions import text as N
from parcelforge.operators import ranking as R
from parcelforge.operators import sampling as S
from parcelforge.operators.joins import contained_names, with_fallback
from pyspark.sql import functions as F


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize("value, column, want", [
    (" 4a, Mill-Lane. ", N.plain_upper, "4A MILL LANE"), ("R0AD", N.ocr_upper, "ROAD"), ("58", N.plan_upper, "SB"), ("a-b c", N.compact, "ABC"), (" , a  b. ", N.squeezed_edges, "a b"), ("1 Mill Rd", N.expanded, "1 MILL ROAD"),
    ("a\\b/c_1", N.last_path_part, "c_1"), ("12_3", N.base_key, "12"), ("x/HX_0012", N.folder_reference, "HX-12"), ("<p>a&amp;b<script>x</script></p>", N.without_markup, "a&b"), (None, N.plain_upper, None), ("", N.expanded, ""),
    ("nan", N.number, None), ("-inf", N.number, None), (" 1.5 ", N.number, 1.5), ("x", N.number, None), ("YES", N.truth, True), (None, N.truth, False), ("a|b| a |", N.piped, ["A", "B"]), (None, N.piped, []),
    ("4-8 Mill Ln", X.house_numbers, [4, 5, 6, 7, 8]), ("1-90 X", X.house_numbers, [1, 90]), ("56–58 QB1 2AB", X.house_numbers, [56, 57, 58]), ("QB1 2AB, qb12ab QB9 9ZZ", X.postcodes, ["QB1 2AB", "QB9 9ZZ"]), (None, X.house_numbers, None),
    ("land at 4 Old Mill Lane", lambda c: X.road_phrases(c, 3), ["MILL LANE", "OLD MILL LANE"]), ("Rose Cottage, Mill Lane", X.site_phrase, "Rose Cottage"), ("4 Mill Lane, X", X.site_phrase, None),
])
def test_texts(spark, value, column, want):
    assert one(spark, value, column(F.col("v"))) == want


def test_same_parity(spark):
    f = lambda t: one(spark, t, X.same_parity_numbers(X.range_of(F.col("v"))))
    assert f("56-60 X") == [56, 58, 60] and f("56-57 X") is None and f("1-99 X") is None and f("X") is None


def test_similarities(spark):
    rng = random.Random(20)
    rows = [("".join(rng.choice("ab c") for _ in range(rng.randrange(12))), "".join(rng.choice("ab c") for _ in range(rng.randrange(12)))) for _ in range(80)] + [(None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", M.gestalt(F.col("a"), F.col("b")).alias("g"), M.jaccard(N.words(F.col("a")), N.words(F.col("b"))).alias("j")).collect()
    for r in got:
        if r.a is None:
            assert r.g is None and r.j == 0
            continue
        assert r.g == pytest.approx(1.0 if r.a and r.b and (r.a in r.b or r.b in r.a) else difflib.SequenceMatcher(None, r.a, r.b).ratio())
        x, y = set(r.a.split(" ")) - {""}, set(r.b.split(" ")) - {""}
        assert r.j == pytest.approx(len(x & y) / len(x | y) if x | y else 0)


def polygon(*rings):
    return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def test_polygons(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    wkb = polygon(outer, hole)
    parts = G.rings(wkb)
    assert G.contains(parts, 1, 1) and not G.contains(parts, 5, 5) and G.contains(parts, 10, 5) and G.contains(parts, 4, 5) and not G.contains(parts, 11, 5)
    multi = struct.pack("<BII", 1, 6, 2) + wkb + polygon([(20, 0), (22, 0), (22, 2), (20, 2), (20, 0)])
    s = spark.createDataFrame([(1, bytearray(wkb)), (2, bytearray(multi)), (3, None), (4, bytearray(b"\x01bad"))], "i int, g binary").select("i", G.shape(F.col("g")).alias("s")).collect()
    got = {r.i: r.s for r in s}
    assert got[1].area == 96 and got[1].perimeter == 48 and got[1].parts == 1 and got[2].area == 100 and got[2].parts == 2 and got[2].maxx == 22
    assert got[3].area is None and got[4].area is None


def test_segments_and_boxes(spark):
    rng = random.Random(21)
    rows = [tuple(rng.uniform(-5, 5) for _ in range(6)) for _ in range(50)] + [(1.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "px double, py double, ax double, ay double, bx double, by double")
    c = [F.col(n) for n in df.columns]
    for r in df.withColumn("d", G.distance_to_segment(*c)).collect():
        least = min(math.hypot(r.px - (r.ax + t / 2000 * (r.bx - r.ax)), r.py - (r.ay + t / 2000 * (r.by - r.ay))) for t in range(2001))
        assert r.d == pytest.approx(least, abs=1e-2) and r.d <= least + 1e-9
    a, b = G.square(F.lit(0.0), F.lit(0.0), F.lit(2.0)), G.square(F.lit(1.0), F.lit(0.0), F.lit(2.0))
    row = spark.range(1).select(G.box_iou(a, b).alias("iou"), G.box_iou(a, G.square(F.lit(2.0), F.lit(0.0), F.lit(2.0))).alias("touch"), G.distance_to_box(F.lit(4.0), F.lit(5.0), a).alias("d")).first()
    assert row.iou == pytest.approx(1 / 3) and row.touch == 0 and row.d == 5


def test_containment_is_by_whole_words(spark):
    t = spark.createDataFrame([(1, "OLD PARK ROAD"), (2, "PARK ROADS"), (3, None), (4, "")], "i int, t string")
    n = spark.createDataFrame([("a", "PARK ROAD"), ("b", "OLD PARK ROAD"), ("c", ""), ("d", None)], "n string, name string")
    assert {(r.i, r.n) for r in contained_names(t, F.col("t"), n, F.col("name"), ["i"], ["n"]).collect()} == {(1, "a"), (1, "b")}


def test_fallback(spark):
    left = spark.createDataFrame([("1_2", 1), ("3", 2), ("9_1", 3), (None, 4)], "k string, i int")
    right = spark.createDataFrame([("1", "one"), ("3", "three"), ("1_2", None)], "u string, v string")
    got = {r.i: (r.v, r.by_key, r.matched) for r in with_fallback(left, right, F.col("k"), N.base_key(F.col("k")), "u", ["v"]).collect()}
    assert got == {1: (None, True, True), 2: ("three", True, True), 3: (None, False, False), 4: (None, False, False)}


def test_portfolio_and_rates(spark):
    df = spark.createDataFrame([("g", f"c{i}", i, i % 4 == 3, 10 - i) for i in range(10)] + [("h", "x", 1, True, 0)], "g string, c string, r int, ok boolean, s int")
    out = {r.c: (r.place, r.bucket) for r in R.portfolio(df, "g", [F.col("r")], [F.col("s")], 2, 1, 10, F.col("ok")).where("g = 'g'").collect()}
    assert out["c0"] == (1, "base") and out["c1"] == (2, "base") and out["c7"] == (3, "other") and out["c2"] == (4, "rest") and sorted(p for p, _ in out.values()) == list(range(1, 11))
    rates = {r.k: (r.hits, r.rate) for r in R.top_k_rates(R.first_hits(df, "g", F.struct("r"), F.col("ok")), [1, 4, 9]).collect()}
    assert rates == {1: (1, 0.5), 4: (2, 1.0), 9: (2, 1.0)}  # the fourth of g, the first of h


def test_samples(spark):
    df = spark.createDataFrame([("s", str(i)) for i in range(50)] + [("t", "1")], "g string, k string")
    a = {tuple(r) for r in S.sample_groups(df, "g", "k", 5, "x").collect()}
    assert len(a) == 6 and a == {tuple(r) for r in S.sample_groups(df.orderBy(F.desc("k")), "g", "k", 5, "x").collect()}
    z = S.standardised(spark.createDataFrame([(1.0, True), (3.0, True), (None, False), (5.0, False)], "v double, t boolean"), ["v"], F.col("t")).collect()
    assert [r.z_v for r in z] == [-1.0, 1.0, 0.0, 3.0]
    h = S.one_hot(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "v string"), "v", 1).collect()
    assert [r.v_is_0 for r in h] == [1, 1, 0, 0]
