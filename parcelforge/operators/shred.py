"""Deeply nested records into flat tables by columnar shredding.

Every array path of a record is a repeated column; every scalar path is a leaf column. A column is a sequence of
entries (repetition level, definition level, value): the repetition level says at which array the entry repeats,
the definition level how much of its path is there. Tables are rebuilt from these sequences alone: an entry is
there if its definition level is the full one of its column.

Levels of definition: a place that is there defines one level more by what it holds (an object, a scalar, or the next
element of an array), and a field that an object has defines one more. So a place that holds objects in one record
and scalars in the next has a column for either.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ITEM = "[]"
BATCH_CHARS = 1 << 24  # characters of paths after which a batch of results is handed on


class _Node:
    """A place in the schema of one record, `level` definition levels deep: what it holds has one level more.

    objects: the entries of the elements here, if this is the item of an array; leaf: those of the scalars here.
    """

    __slots__ = ("fields", "item", "leaf", "objects", "level")

    def __init__(self, level: int):
        self.fields: dict[str, _Node] = {}
        self.item: _Node | None = None
        self.leaf: list | None = None
        self.objects: list | None = None
        self.level = level


def _grow(root: _Node, value) -> None:
    todo = [(root, value)]
    while todo:
        node, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                if k not in node.fields:
                    node.fields[k] = _Node(node.level + 2)
                todo.append((node.fields[k], x))
        elif isinstance(v, list):
            if node.item is None:
                node.item = _Node(node.level + 1)
                node.item.objects = []
            for x in v:
                todo.append((node.item, x))
        elif node.leaf is None:
            node.leaf = []


def _fill(root: _Node, value) -> None:
    """Entries of all columns in document order; an explicit stack, so depth is no matter."""
    todo = [(root, value, 0, 0, root.level)]
    while todo:
        node, v, rep, reps, defined = todo.pop()
        here = defined == node.level
        is_object, is_array = here and isinstance(v, dict), here and isinstance(v, list)
        is_scalar = here and not is_object and not is_array
        if node.objects is not None:
            node.objects.append((rep, defined + is_object))
        if node.leaf is not None:
            node.leaf.append((rep, defined + is_scalar, v if is_scalar else None))
        for k, child in node.fields.items():
            has = is_object and k in v
            todo.append((child, v[k] if has else None, rep, reps, defined + (2 if has else is_object)))
        if node.item is not None:
            if is_array and v:
                todo += [(node.item, v[i], reps + 1 if i else rep, reps + 1, defined + 1) for i in range(len(v) - 1, -1, -1)]
            else:
                todo.append((node.item, None, rep, reps, defined))


def _strict(_: str):
    raise ValueError("not JSON")


_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|null")


def _parse_deep(text: str):
    """What json.loads gives, with a stack of its own in place of the parser's: any depth. ValueError if it is no JSON."""
    opened: list = []  # (container, name of the field being read)
    at, name = _SPACE.match(text).end(), None

    def key(at: int) -> tuple[str, int]:
        if text[at : at + 1] != '"':
            raise ValueError("not JSON")
        read, at = scanstring(text, at + 1, True)
        at = _SPACE.match(text, at).end()
        if text[at : at + 1] != ":":
            raise ValueError("not JSON")
        return read, _SPACE.match(text, at + 1).end()

    while True:
        c = text[at : at + 1]
        if c == "[" or c == "{":
            value = [] if c == "[" else {}
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if c == "[" else "}"):
                opened.append((value, name))
                if c == "{":
                    name, at = key(at)
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _ATOM.match(text, at):
            value, at = {"true": True, "false": False, "null": None}[m[0]] if m[1] is None else float(m[0]) if m[2] or m[3] else int(m[1]), m.end()
        else:
            raise ValueError("not JSON")
        while True:  # put the value where it belongs, and close what ends here
            at = _SPACE.match(text, at).end()
            if not opened:
                if at < len(text):
                    raise ValueError("not JSON")
                return value
            inner, outer = opened[-1]
            is_list = isinstance(inner, list)
            if is_list:
                inner.append(value)
            else:
                inner[name] = value
            c = text[at : at + 1]
            at = _SPACE.match(text, at + 1).end()
            if c == ",":
                if not is_list:
                    name, at = key(at)
                break
            if c != ("]" if is_list else "}"):
                raise ValueError("not JSON")
            value, name = inner, outer
            opened.pop()


def parse_array(text: str | None) -> list | None:
    """The array that a text holds; None for null, damaged texts, NaN or Infinity, and anything but an array."""
    if not text:
        return None
    try:
        value = json.loads(text, parse_constant=_strict)
    except RecursionError:
        try:
            value = _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if isinstance(value, list) else None


def _steps(linked: tuple | None) -> tuple[str, ...]:
    out = []
    while linked is not None:
        linked, step = linked
        out.append(step)
    return tuple(reversed(out))


def shred(value: list) -> Iterator[tuple[tuple[str, ...], int, list, list[tuple[str, int, list]]]]:
    """Per repeated ancestor: its path of names and ITEM, the definition level of an object there, its column of entries
    (repetition, definition), and the leaf columns (dotted name below it, full definition level, entries) of the objects
    there. A leaf column has as many entries as its ancestor's, in the same order. Ancestors that are never an object are
    left out.
    """
    root = _Node(0)
    _grow(root, value)
    _fill(root, value)
    todo: list[tuple[_Node, tuple | None]] = [(root, None)]
    while todo:
        top, path = todo.pop()
        leaves: list[tuple[str, int, list]] = []
        below: list[tuple[_Node, tuple | None, str]] = [(top, path, "")]
        while below:
            node, at, name = below.pop()
            if node.leaf is not None and node is not top:
                leaves.append((name, node.level + 1, node.leaf))
            below += [(child, (at, k), f"{name}.{k}" if node is not top else k) for k, child in node.fields.items()]
            if node.item is not None:
                todo.append((node.item, (at, ITEM)))
        if top.objects is not None and any(defined > top.level for _, defined in top.objects):
            yield _steps(path), top.level + 1, top.objects, leaves


def positions(path: tuple[str, ...], full: int, column: list) -> Iterator[tuple[int, str, str, int]]:
    """Per object among the entries of a repeated ancestor's column: number of the entry, dotted path with positions, the path
    without its last step, last position.

    An entry at repetition level k is the next element of the k-th array and the first of all deeper ones; it is an
    object if its definition level is the full one.
    """
    depth = path.count(ITEM)
    at = [i for i, step in enumerate(path) if step is ITEM]
    steps, index = list(path), [0] * depth
    for n, (rep, defined) in enumerate(column):
        if n == 0 or rep == 0:
            changed = 0
            index = [0] * depth
        else:
            changed = rep - 1
            index[changed] += 1
            index[rep:] = [0] * (depth - rep)
        for i in range(changed, depth):
            steps[at[i]] = str(index[i])
        if defined == full:
            yield n, ".".join(steps), ".".join(steps[:-1]), index[-1]


def _clean(s: str) -> str:
    """Lone surrogates, which JSON escapes can hold, can't be stored: they become question marks."""
    return s if s.isascii() else s.encode("utf-8", "replace").decode()


def _text(v) -> str | None:
    if v is None:
        return None
    return _clean(v) if isinstance(v, str) else json.dumps(v)


PATHS = "row_id bigint, field string, obj_path string"
TABLES = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("table_path", T.StringType()),
    T.StructField("obj_path", T.StringType()), T.StructField("parent_path", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), True)),
])


def nested_objects(df: DataFrame, id_col: str, json_cols: list[str]) -> DataFrame:
    """row_id, field, obj_path of every object that is an element of an array, at any depth, in the JSON texts.

    Elements that are not objects keep their positions. Null, empty and damaged texts, and texts that aren't an array,
    give no row. A name that comes twice in one object counts once, with its last value. Each text is shredded where
    its row lies: no shuffle. Results are handed on in batches of bounded size, however many a text holds.
    """
    import pyarrow as pa

    def run(batches):
        def batch_of(rows, fields, paths):
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(fields, pa.string()), pa.array(paths, pa.string())], ["row_id", "field", "obj_path"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, fields, paths, chars = [], [], [], 0
            for c, name in enumerate(json_cols, 1):
                for row_id, text in zip(ids, batch.column(c).to_pylist()):
                    value = parse_array(text)
                    if not value:
                        continue
                    for path, full, column, _ in shred(value):
                        for _, found, _, _ in positions(path, full, column):
                            rows.append(row_id)
                            fields.append(name)
                            paths.append(_clean(found))
                            chars += len(found)
                            if chars > BATCH_CHARS:
                                yield batch_of(rows, fields, paths)
                                rows, fields, paths, chars = [], [], [], 0
            yield batch_of(rows, fields, paths)

    return df.select(f"`{id_col}`", *[f"`{c}`" for c in json_cols]).mapInArrow(run, PATHS)


def nested_tables(df: DataFrame, id_col: str, json_cols: list[str]) -> DataFrame:
    """The flat tables of all repeated ancestors, one below the other: table_path tells them apart.

    A row is one element that is an object. obj_path is its key within (row_id, field), parent_path that of the
    object or list it stands in (a `0.anchors` is the list `anchors` of object `0`), pos its place there. attributes
    holds its scalars as text by dotted name: those of objects inside it, such as location.crs, too; a JSON null is a
    null value, an absent field no entry. Partition the result by table_path on writing to get one table each.
    """
    import pyarrow as pa

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(TABLES)

    def run(batches):
        def batch_of(out):
            cols = list(zip(*out)) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            out, chars = [], 0
            for c, name in enumerate(json_cols, 1):
                for row_id, text in zip(ids, batch.column(c).to_pylist()):
                    value = parse_array(text)
                    if not value:
                        continue
                    for path, full, column, leaves in shred(value):
                        table_path = _clean(".".join(path))
                        for n, obj, parent, pos in positions(path, full, column):
                            attributes = [(_clean(k), _text(entries[n][2])) for k, there, entries in leaves if entries[n][1] == there]
                            out.append((row_id, name, table_path, _clean(obj), _clean(parent), pos, attributes))
                            chars += len(obj) + len(parent) + len(table_path)
                            if chars > BATCH_CHARS:
                                yield batch_of(out)
                                out, chars = [], 0
            yield batch_of(out)

    return df.select(f"`{id_col}`", *[f"`{c}`" for c in json_cols]).mapInArrow(run, TABLES)
