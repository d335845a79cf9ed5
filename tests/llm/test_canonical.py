import random

import pytest

from parcelforge.llm.canonical import BKTree, Matcher, _coded, distances, long_distance, osa, to_reference


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(rng, n, longest=24):
    return list(dict.fromkeys("".join(rng.choice("abcde ") for _ in range(rng.randrange(1, longest))).replace(" ", "z") for _ in range(n)))


def test_distances():
    rng = random.Random(13)
    many = words(rng, 300) + ["", "a" * 70, "é√" * 3]
    codes, lengths = _coded(many)
    for w in words(rng, 30) + ["b" * 64]:
        assert distances(w, codes, lengths).tolist() == [levenshtein(w, m.replace("é", "√")) for m in many]


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_tree_finds_all_within_radius(radius):
    rng = random.Random(14)
    entries, queries = words(rng, 400, 12), words(rng, 150, 12)
    found = BKTree(entries).search(queries, radius)
    for q, got in zip(queries, found):
        assert sorted(got) == sorted((e, levenshtein(q, e)) for e in entries if levenshtein(q, e) <= radius)


def test_empty_tree():
    assert BKTree([]).search(["a"]) == [[]] and BKTree(["a"]).search([]) == []


def test_osa_counts_a_swap_once():
    assert osa("abcd", "acbd") == 1 and osa("abcd", "abcd") == 0 and osa("a", "abcdefg", 3) == 4


ENTRIES = [("r1", "Mill Lane"), ("r2", "Upper Mill Lane"), ("r3", "Thornbrook Close"), ("r4", "Thornbrook Court"), ("p1", "Millford"), ("s1", "Thornbrook Recreation Ground"), ("r5", "Barnhurst Street West"), ("r6", "Little Hollow Avenue")]
VALUES = {
    "Mill Lane": "r1", "MILL LN": "r1", " mill  lane. ": "r1", "M1ll Lane": "r1", "Milllane": "r1", "12 Mill Lane, Millford": "r1", "Upr Mill La": "r2", "land at Thornbrook Close (part)": "r3", "Thornbrok Cl": "r3", "Thorrnbrook Ct": "r4",
    "Tohrnbrook Crt": "r4", "Thornbrook": "", "off Barnhurst": "r5", "Bamhurts": "r5", "LtHollowAv": "r6", "Thornbrook Crescent": "", "Millford": "p1", "MILLFROD": "p1", "DO NOT SCALE": "", "Thornbrook Rec Ground": "s1", "Bamhurst St (W)": "r5", "": "", "   ": "", None: "", "x" * 100_000: "",
}


@pytest.mark.parametrize("value", VALUES)
def test_meanings(value):
    assert Matcher(ENTRIES).match([value])[0][0] == VALUES[value]


@pytest.mark.parametrize("shard", [1000, 3])
def test_on_spark(spark, shard):
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(VALUES)] + [(500, "Mill Lane", 2)], "n long, v string, id int")
    ref = spark.createDataFrame([*ENTRIES, ("zz", None), (None, "Mill Lane"), ("r9", "mill lane")], "ID string, NAME1 string")
    got = {r.n: r.ref_id for r in to_reference(df, "v", ref, "ID", "NAME1", shard).collect()}
    assert got == dict(enumerate(VALUES.values())) | {500: "r1"}
    assert to_reference(df.limit(0), "v", ref, "ID", "NAME1", shard).count() == 0
    assert to_reference(df, "v", ref.limit(0), "ID", "NAME1").where("ref_id <> ''").count() == 0


LONG = "the royal society of master bakers millers and confectioners of upper thornbrook and the lower valley"


def test_words_of_any_length():
    rng = random.Random(16)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 150))) for _ in "ab")
        assert long_distance(a, b) == levenshtein(a, b)
    many = ["".join(rng.choice("ab") for _ in range(n)) for n in range(60, 72) for _ in range(6)]
    asked = [w[:9] + w[10:] for w in many] + [w[:5] + "b" + w[5:] for w in many] + ["a" * 5000]
    for q, got in zip(asked, BKTree(many).search(asked)):
        assert sorted(got) == sorted((e, levenshtein(q, e)) for e in set(many) if abs(len(e) - len(q)) <= 2 and levenshtein(q, e) <= 2)
    m = Matcher([("x1", LONG), ("x2", LONG[:-7] + "hills"), ("x3", LONG[:60])])
    assert [m.match([v])[0][0] for v in (LONG, LONG.replace("bakers", "bakrs"), LONG[:64], LONG[:61], LONG[:60].replace("royal", "roayl"))] == ["x1", "x1", "", "x3", "x3"]


@pytest.mark.parametrize("shard", [1, 3, 40])
def test_shards_answer_as_one_tree(spark, shard):
    rng = random.Random(17)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(25)]
    names = [f"{s.capitalize()} {t}" for s in stems for t in rng.sample(["Lane", "Ln", "Close", "Street", "St", "Hall"], 2)] + ["Mill Lane Close", "Mill Lane", "High Street", "High St", "Rnoor Lane", LONG, LONG[:-3]]
    ref = spark.createDataFrame([(f"i{i:03}", n) for i, n in enumerate(names)], "ID string, NAME1 string")
    slips = [n[:i] + rng.choice("aeiou") + n[i + 1 :] for n in names for i in (1, 3)] + [n[:2] + n[3] + n[2] + n[4:] for n in names if len(n) > 5]
    values = [*names, *names, *slips, *[n.split()[0] for n in names], *[f"12 {n}, Oakham" for n in names[:20]], None, "", "  ", "x" * 50_000]
    df = spark.createDataFrame([(v, "clash") for v in values], "v string, value string").repartition(3)
    rows = lambda s: sorted(((r.v or "-", r.ref_id) for r in to_reference(df, "v", ref, "ID", "NAME1", s).collect()))
    one = rows(10_000)
    assert len(one) == len(values) and len([r for r in one if r[1]]) > len(names) * 3 and rows(shard) == one
