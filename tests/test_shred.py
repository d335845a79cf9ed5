import json
import random

import pytest

from parcelforge.operators.shred import _parse_deep, nested_objects, nested_tables, parse_array, positions, shred


def walk(value, at=""):
    """Brute force: every object that is an element of an array."""
    if isinstance(value, list):
        for i, x in enumerate(value):
            path = f"{at}.{i}" if at else str(i)
            if isinstance(x, dict):
                yield path
            yield from walk(x, path)
    elif isinstance(value, dict):
        for k, x in value.items():
            yield from walk(x, f"{at}.{k}" if at else k)


def found(value):
    return sorted(p for path, full, column, _ in shred(value) for _, p, _, _ in positions(path, full, column))


def test_mixed_kinds_and_gaps():
    v = [{"a": [{"b": []}, 3, None, [{"c": [{}]}]]}, "x", [], [[{"d": 1}]], {"a": {"z": [{"y": 2}]}}, {}]
    assert found(v) == sorted(walk(v))
    assert "0.a.3.0.c.0" in found(v) and "3.0.0" in found(v) and "5" in found(v)


def random_value(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([1, "s", None, True, 2.5])
    if kind < 0.6:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc"): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed", range(60))
def test_levels_rebuild_every_position(seed):
    rng = random.Random(seed)
    v = [random_value(rng, 5) for _ in range(4)]
    assert found(v) == sorted(walk(v))


def test_levels_count_entries_of_leaves():
    v = [{"n": 1, "p": [{"m": 2}, {"k": 3}]}, {"p": []}]
    for _, _, column, leaves in shred(v):
        for _, _, entries in leaves:
            assert [e[0] for e in entries] == [e[0] for e in column]  # the same repetition levels


def test_definition_levels_say_what_is_there():
    v = [{"n": 1, "p": [{"m": None}, 3]}, {"p": []}, "x", {"n": {"k": 2}, "p": 4}]
    columns = {path: (full, column, {name: (there, entries) for name, there, entries in leaves}) for path, full, column, leaves in shred(v)}
    full, column, leaves = columns["[]",]
    assert full == 2 and column == [(0, 2), (1, 2), (1, 1), (1, 2)]
    assert leaves["n"] == (4, [(0, 4, 1), (1, 2, None), (1, 1, None), (1, 3, None)]) and leaves["n.k"] == (6, [(0, 3, None), (1, 2, None), (1, 1, None), (1, 6, 2)])
    full, column, leaves = columns["[]", "p", "[]"]
    assert full == 5 and column == [(0, 5), (2, 4), (1, 3), (1, 1), (1, 3)] and leaves["m"] == (7, [(0, 7, None), (2, 4, None), (1, 3, None), (1, 1, None), (1, 3, None)])


@pytest.mark.parametrize("text", [None, "", "  ", "{}", '"[{}]"', "[{}", "[NaN]", "[1,]", "nul", "[" * 200_000, "[" * 100_000 + "NaN" + "]" * 100_000, "[" * 100_000 + "]" * 99_999, "[" * 100_000 + "]" * 100_001, '{"a":' * 100_000 + "1" + "}" * 100_000])
def test_texts_that_hold_no_array(text):
    assert parse_array(text) is None


def test_deep_and_long():
    deep = "[" * 300 + "{}" + "]" * 300
    assert found(json.loads(deep)) == [".".join(["0"] * 300)]
    assert len(found([{"i": i} for i in range(20_000)])) == 20_000


def test_any_depth():
    assert found(parse_array("[" * 30_000 + "{}" + "]" * 30_000)) == [".".join(["0"] * 30_000)]
    nested = '[{"a":' * 3_000 + "1" + "}]" * 3_000
    assert parse_array(nested) == _parse_deep(nested) and len(found(parse_array(nested))) == 3_000
    very = '[[{"a": 1}],' * 25_000 + "2" + "]" * 25_000
    assert sum(1 for path, full, column, _ in shred(parse_array(very)[:1]) for _ in positions(path, full, column)) == 1


DAMAGED = ["", " ", "[1,]", "[,1]", "{", '{"a"}', '{"a":1,}', "{a:1}", "[1 2]", "01", "-", "1.", ".5", "+1", "1e", "[1]]", "tru", '"a', '"\\x"', '"\n"', "[NaN]", "[-Infinity]", '{"a" 1}', "[}", '{"a":]', "nulll"]


@pytest.mark.parametrize("text", DAMAGED)
def test_deep_parser_refuses(text):
    with pytest.raises(ValueError):
        _parse_deep(text)


@pytest.mark.parametrize("seed", range(40))
def test_deep_parser_reads_the_same(seed):
    rng = random.Random(seed)
    text = json.dumps([random_value(rng, 5) for _ in range(4)] + [-0.5e-7, 10**30, "\\ \" \u00e9 \n", {"": {}}], indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    assert _parse_deep(text) == json.loads(text) and [type(x) for x in _parse_deep(text)] == [type(x) for x in json.loads(text)]


def test_on_spark(spark):
    rows = [(1, '[{"a":[{"b":1}]}]', None, 9), (2, None, "[]", 9), (3, "[{}", '[{"a":{"b":"x"}},{"\\ud800":1}]', 9)]
    df = spark.createDataFrame(rows, "row_id long, j string, k string, field int")  # `field` clashes with a name of the result
    got = {tuple(r) for r in nested_objects(df, "row_id", ["j", "k"]).collect()}
    assert got == {(1, "j", "0"), (1, "j", "0.a.0"), (3, "k", "0"), (3, "k", "1")}
    tables = {(r.row_id, r.obj_path): r for r in nested_tables(df, "row_id", ["j", "k"]).collect()}
    assert tables[1, "0.a.0"].parent_path == "0.a" and tables[1, "0.a.0"].attributes == {"b": "1"} and tables[3, "0"].attributes == {"a.b": "x"}
    assert nested_objects(df.limit(0), "row_id", ["j"]).count() == 0
