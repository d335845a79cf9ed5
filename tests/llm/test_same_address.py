import random

import pytest

from parcelforge.llm.address import parse
from parcelforge.llm.same_address import locations, pairs, spellings

SAME = [
    "14 Mill Lane, Oakham, AB1 2CD", "No. 14 Mill Ln, Oakham", "MILL LANE 14, OAKHAM, AB12CD", "Oakham, 14, Mill La", "AB1 2CD, 14 mill lane", "Mill Lane, Oakham, (no. 14), England", "Site of 14 Mill Lane, Oakham", "14  Mill\xa0Lane , Oakham , Rutlandshire",
]
OTHER = [
    "14a Mill Lane, Oakham", "14-16 Mill Lane, Oakham", "16 Mill Lane, Oakham", "Flat 2, 14 Mill Lane, Oakham", "Flat 3, 14 Mill Lane, Oakham", "Land rear of 14 Mill Lane, Oakham", "Land adjacent to 14 Mill Lane, Oakham", "14 Mill Close, Oakham", "14 Upper Mill Lane, Oakham",
    "14 Mill Lane North, Oakham", "Rose Cottage, Mill Lane, Oakham", "Mill Lane, Oakham", "14 Mill Lane, Elmford",
]


def key(text):
    a = parse(text)
    return a and (a.unit, a.street)


def test_same_parts():
    assert len({key(t) for t in SAME}) == 1 and key(SAME[0])[0] == "//14"


def test_strict_parts():
    keys = [key(t) for t in OTHER]
    assert keys[:10].count(key(SAME[0])) == 0
    assert len({k for k in keys if k}) >= 10


@pytest.mark.parametrize("a, b", [
    ("Land r/o 9 Elm Rd", "rear of No 9, Elm Road"), ("Land adj. to 9 Elm Rd", "LAND NEXT TO 9 ELM ROAD"), ("Adjacent to 9 Elm Rd", "Land adjoining 9, Elm Road"), ("Flt 2, 9 Elm Rd", "9 Elm Road (Flat no 2)"), ("4 - 8 Elm Rd", "Nos 4–8, Elm Road"),
    ("9 C Elm Rd", "9c Elm Road"), ("9 Elm Sq (W)", "9 Elm Square West"), ("9 Elm Cresc", "9 Elm Crescnet"), ("9 Lwr Elm Dr.", "9, Lower Elm Drive"), ("4 to 8 Elm Rd", "4-8 Elm Road"),
])
def test_alike(a, b):
    assert key(a) == key(b)


@pytest.mark.parametrize("text", [None, "", "  ", "-", "N/A", "unknown", "see plan", "address as supplied", "grid reference only", "x" * 100_000, "12 34 56", ",,,", "QB1 2AB"])
def test_denote_nothing(text):
    assert parse(text) is None


def test_postcodes_repaired():
    assert parse("1 Elm Road Q810 0ZT").postcode == "qb100zt" and parse("1 Elm Road, QB1  2AB").postcode == "qb12ab" and parse("Elm Close 119, Oakham").postcode == ""


def slip(rng, w):
    i = rng.randrange(len(w) - 1)
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rng.choice("aeiou") + w[i + 1 :]])


def test_spellings_against_brute_force(spark):
    rng = random.Random(15)
    stems = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(60)]
    rows = {(b, f"{s}|{t}|"): 50 for b in "xy" for s in stems for t in ("road", "lane")}
    slips = {}
    for (b, w) in list(rows):
        for _ in range(3):
            s = slip(rng, w.split("|")[0])
            if s not in stems:
                slips[b, f"{s}|{w.split('|')[1]}|"] = w
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()] + [(*k, 1) for k in slips], "block string, word string, uses long")
    got = {(r.block, r.word): r.to for r in spellings(df, 4).collect()}
    assert not set(got) & set(rows)
    assert all(got[k] == w for k, w in slips.items() if k in got) and len(got) >= 0.97 * len(slips)


def test_pairs(spark):
    texts = SAME * 3 + OTHER + [None, "", "unknown", "MIIL LANE 14, OAKHAM", "14 Mill Lane, Oakhamm, AB1 2CD"]
    filler = [f"{n} {s} {t}, {p}, {c} {n % 9}XY" for n in range(1, 12) for s in ("Alder", "Birch", "Mill", "Cedar") for t in ("Road", "Lane") for p, c in (("Oakham", "AB1"), ("Elmford", "AB7")) if (s, t, n) != ("Mill", "Lane", 14)]
    rows = [(f"r{i:03}", t, 1) for i, t in enumerate(texts)] + [(f"f{i}", t, 1) for i, t in enumerate(filler)]
    df = spark.createDataFrame([*rows, rows[0]], "rec string, address string, location int")
    for hot in (2_000, 3):
        got = [(r.rec_a, r.rec_b) for r in pairs(locations(df), hot).collect()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got)
        own = [f"r{i:03}" for i in [*range(24), *range(40, 42)]]
        mine = {p for p in got if p[0].startswith("r") and p[1].startswith("r")}
        assert mine == {(a, b) for a in own for b in own if a < b}
    assert pairs(locations(df.limit(0))).count() == 0


def test_hot_street_changes_nothing_elsewhere(spark):
    rng = random.Random(7)
    stems = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(40)]
    slips = {s[:3] + s[4:]: s for s in stems}
    cold = [("x", f"{s}|road|", 8) for s in stems] + [("x", f"{s}|road|", 1) for s in slips]
    crowd = [("x", f"{'greshwick'[:i]}{c}{'greshwick'[i:]}|road|", 30) for i in range(10) for c in "aeiou"]  # slips that are used more than the cold streets
    for hot in ([], [("x", "greshwick|road|", 160)], [("x", "greshwick|road|", 100_000), *crowd]):
        got = {r.word: r.to for r in spellings(spark.createDataFrame(cold + hot, "block string, word string, uses long")).collect()}
        assert {w.partition("|")[0]: t.partition("|")[0] for w, t in got.items() if w.partition("|")[0] in slips} == slips
        assert not {f"{s}|road|" for s in stems} & set(got) and all(got[w] == "greshwick|road|" for _, w, _ in crowd if hot[1:])


def test_levels_too_large_for_all_tasks(spark, monkeypatch):
    from parcelforge.llm import same_address

    rng = random.Random(8)
    stems = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(300)]
    rows = [("x", f"{s}|road|", rng.choice([5, 20, 90])) for s in stems] + [("x", f"{s[:4]}{s[5:]}|road|", 1) for s in stems]
    df = spark.createDataFrame(rows, "block string, word string, uses long")
    known = {tuple(r) for r in spellings(df).collect()}
    monkeypatch.setattr(same_address, "FEW", 20)
    assert len(known) >= 295 and {tuple(r) for r in spellings(df).collect()} == known


def test_pairs_beside_a_hot_street(spark):
    cold = [(f"c{i}{j}", f"{j} {s} Road, Smallham") for i, s in enumerate(("Alder", "Birchen", "Cedar")) for j in range(1, 9)]
    hot = [(f"h{i}", f"{i % 40 + 1} Mill Lane, Oakham, AB1 {i % 9}XY") for i in range(400)]
    other = [("o1", "3 Alder Road, Oakham"), ("o2", "4 Alder Road, Oakham, AB1 2XY")]
    wrong = [("s1", "3 Aldr Road, Smallham"), ("s2", "4 Birhcen Road, Smallhamm")]
    df = spark.createDataFrame(cold + hot + other + wrong, "rec string, address string")
    got = {(r.rec_a, r.rec_b) for r in pairs(locations(df)).collect()}
    assert {p for p in got if not (p[0][0] == p[1][0] == "h")} == {("c03", "s1"), ("c14", "s2")}


def test_small_place_beside_a_large_one(spark):
    """Every address of a small place meets its twin without postcode, however large a town with a street of the same name is."""
    small = [(f"s{n:02}", f"{n} Mill Lane, Smallby, SB1 2AB") for n in range(1, 61)] + [(f"t{n:02}", f"{n} Mill Lane, Smallby") for n in range(1, 61)]
    want = {(f"s{n:02}", f"t{n:02}") for n in range(1, 61)}
    for size in (120, 20_000):
        big = [(f"z{n}", f"{n % 997 + 1} {('Mill Lane', 'High Street', 'Station Road')[n % 3]}, Bigtown, BT{n % 3 + 1} {n % 9}XY") for n in range(size)]
        found = pairs(locations(spark.createDataFrame(small + big, "rec string, address string")))
        assert {tuple(r) for r in found.where("rec_a like 's%' or rec_a like 't%'").collect()} == want


def test_slip_of_a_street_hardly_named(spark):
    rows = [("q1", "7 Quarry Lane, Smallby, SB1 2AB"), ("q2", "7 Quarry Lane, Smallby"), ("q3", "No 7 Quarry Lane, Smallby"), ("q4", "7 Qaurry Lane, Smallby"), ("n1", "9 Quarry Lane, Smallby"), ("n2", "7 Quarry Close, Smallby"), ("n3", "7a Qaurry Lane, Smallby"),
            ("h1", "3 Mill Lane, Smallby"), ("h2", "3 Hill Lane, Smallby"), ("h3", "3 Mill Lane, Smallby, SB1 2AB"), ("p1", "12 Thornbrok Road, Elmford, AB7 3XY"), ("p2", "12 Thornbrook Road, Elmford, AB7 3XY"), ("c1", "Rose Cottage, Elm Road, Elmford, AB7 3XZ"), ("c2", "Rose Cotage, Elm Road, Elmford, AB7 3XZ")]
    got = {tuple(r) for r in pairs(locations(spark.createDataFrame(rows, "rec string, address string"))).collect()}
    q = ["q1", "q2", "q3", "q4"]
    assert got == {(a, b) for a in q for b in q if a < b} | {("h1", "h3"), ("p1", "p2"), ("c1", "c2")}


def test_windows_against_all_pairs(spark):
    """Links of the passes against all pairs of classes by the same rule, a third of them in one street."""
    from parcelforge.llm.same_address import _alike, _Entry, neighbours

    rng = random.Random(18)
    stems = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(5)) for _ in range(80)]
    rows = {}
    for i in range(1500):
        s = stems[0] if i % 3 == 0 else rng.choice(stems)
        area, unit, code = rng.choice(["a", "b"]), f"//{rng.randrange(1, 200)}", rng.choice(["", f"ab{rng.randrange(40)}xy"])
        rows.setdefault((area, s, unit, ""), (code, 50))
        if rng.random() < 0.2:
            w = slip(rng, s)
            if w not in stems:
                rows.setdefault((area, w, unit, ""), (rng.choice([code, ""]), 1))
    entries = [_Entry("\t".join(k), k[2], k[1], "|road||", k[3], k[0], code, n) for k, (code, n) in rows.items()]
    want = {(min(x.location, y.location), max(x.location, y.location)) for x in entries for y in entries if x.location != y.location and x.unit == y.unit and _alike(x, y)}
    df = spark.createDataFrame(entries, "location string, unit string, stem string, tail string, house string, area string, postcode string, uses long")
    got = {tuple(r) for r in neighbours(df).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.95 * len(want)
