import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.operators.packed import ESCAPE, MARK, NARROW, WIDE, unpack

CASES = [
    ("a; b", ["a", "b"]), ('"a, b"|c', ["a, b", "c"]), ('"x ""y"" z" / w', ['x "y" z', "w"]), ("||a||b||", ["a", "b"]), ('["g", "h"]', ["g", "h"]), ("a,,a", ["a", "a"]),
    ("", []), ("  ", []), (" | ", []), ('""', []), ('a "b', ['a "b']), (f"{MARK}0{MARK}; b", [f"{MARK}0{MARK}", "b"]), (f'"{ESCAPE}e;"; {ESCAPE}f{MARK}', [f"{ESCAPE}e;", f"{ESCAPE}f{MARK}"]), ('k:"a|b" | c', ['k:"a|b"', "c"]), ("a\tb\nc", ["a", "b", "c"]), ('"a"', ["a"]),
    ('k:"a;b"="c;d"|z', ['k:"a;b"="c;d"', "z"]), ("x|" + " " * 12 + '"a;b"|z', ["x", "a;b", "z"]), (" " * 40 + '"a;b"', ["a;b"]), ("x|\n\n" + "\xa0" * 11 + '"a;b"', ["x", "a;b"]), ('a=  "b;c" "d"; e', ['a=  "b;c" "d"', "e"]), ('"a;  ""b"" ;"', ['a;  "b" ;']), ('"a"b;c', ['"a"b', "c"]),
]


def test_known_texts(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(99, None, "")], "id int, t string, pos string")
    got = {}
    for r in unpack(df, "t", ["id"], WIDE).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
    for i, (_, want) in enumerate(CASES):
        assert [v for _, v in got.get(i, [])] == want, CASES[i]
        assert [p for p, _ in got.get(i, [])] == list(range(1, len(want) + 1))
    assert 99 not in got


def test_commas_and_slashes_kept(spark):
    df = spark.createDataFrame([(1, 'a, b/c || "d | e"')], "id int, t string")
    assert [r.value for r in unpack(df, "t", ["id"], NARROW).orderBy("pos").collect()] == ["a, b/c", "d | e"]


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, ";".join(f'"v;{i}"' for i in range(5000)))], "id int, t string")
    assert unpack(df, "t", ["id"]).count() == 5000
    assert unpack(df.limit(0), "t", ["id"]).count() == 0


def brute(text):
    out = []
    for m in re.finditer(r'\s*"((?:[^"]|"")*)"\s*(?=[;|]|$)|([^;|]+)', text):
        v = m[1].replace('""', '"').strip() if m[1] is not None else m[2].strip()
        if v:
            out.append(v)
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.booleans(), st.text("ab c", min_size=1, max_size=6)), max_size=5), min_size=40, max_size=60))
def test_against_brute_force(spark, rows):
    texts = [";".join(f'"{v}|{v}"' if q else v for q, v in row) for row in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {i: [] for i in range(len(texts))}
    for r in unpack(df, "t", ["id"], NARROW).orderBy("id", "pos").collect():
        got[r.id].append(r.value)
    assert got == {i: brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("text", ["a" * 200_000, "|" * 50_000, "\n" * 50_000 + '"|', " " * 50_000 + '|"'])
def test_very_long(spark, text):
    assert unpack(spark.createDataFrame([(1, text)], "id int, t string"), "t", ["id"]).count() == (1 if "a" in text or '"' in text else 0)
