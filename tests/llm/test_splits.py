import os
import random

import pytest

from parcelforge.llm.splits import assign, deal, groups, parent_name, spanning_forest, ties
from pyspark.sql import functions as F

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def union_find(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for u, v in edges:
        up[root(u)] = root(v)
    return {x: root(x) for x in up}


def test_forest_spans_and_is_least(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.randrange(5)) for _ in range(70)] + [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("self", "self", 1), (None, "a", 1)]
    edges += [(f"c{i}", f"c{i + 1}", 1) for i in range(40)]  # a long chain of equal weights
    df = spark.createDataFrame([(*e, 0) for e in edges], "u string, v string, weight int, tree int")
    forest, trees = spanning_forest(df)
    picked = [(r.a, r.b, r.weight) for r in forest.distinct().collect()]
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = union_find([e[:2] for e in real])
    got = {r.vertex: r.tree for r in trees.collect()}
    assert got.keys() == want.keys()
    assert len({(got[x], want[x]) for x in want}) == len(set(want.values())) == len(set(got.values()))
    assert len(picked) == len(want) - len(set(want.values()))  # a forest: no edge too many
    kruskal, parts = 0, {x: x for x in want}
    for u, v, w in sorted(real, key=lambda e: e[2]):
        while parts[u] != u:
            u = parts[u]
        while parts[v] != v:
            v = parts[v]
        if u != v:
            parts[u] = v
            kruskal += w
    assert sum(p[2] for p in picked) == kruskal


def test_empty_forest(spark):
    forest, trees = spanning_forest(spark.createDataFrame([], "u string, v string, weight int"))
    assert forest.count() == 0 and trees.count() == 0


def test_parent_names(spark):
    cases = [("12", "x", "12"), (" 0012 ", "x", "12"), ("12.0", "x", "12"), ("case 12", "x", "12"), ("CASE 0012", "x", "12"), (None, "7_2", "7"), ("", "7_2_1", "7"), ("  ", "7", "7"), ("North Farm", "7", "north farm"), ("0", "7", "0")]
    df = spark.createDataFrame(cases, "b string, k string, want string")
    assert df.where(~parent_name(F.col("b"), F.col("k")).eqNullSafe(F.col("want"))).collect() == []


def test_groups_and_splits(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, f"{rng.randrange(200)}_1", str(rng.randrange(200))]), rng.choice([None, "", str(rng.randrange(150)), f"case {rng.randrange(150)}"]) if rng.random() < 0.3 else None) for i in range(1500)]
    rows += [(5000 + i, "giant", "g") for i in range(900)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "row long, k string, b string, split string")
    plain = lambda b, k: (b.removeprefix("case ") if b else "") or k.split("_")[0]
    want = union_find([("k" + k, "p" + plain(b, k)) for _, k, b in rows if k is not None])
    found = {r.key: r.group_key for r in groups(ties(df, "k", "b")).collect()}
    for k in found:
        assert found[k] == min(x[1:] for x in want if x[0] == "k" and want[x] == want["k" + k])
    out = assign(df, "k", "b", TARGETS, "row").collect()
    assert sorted(r.row for r in out) == sorted(r[0] for r in rows)
    split_of = {}
    for r in out:
        if r.k is not None:
            assert split_of.setdefault(found[r.k], r.split) == r.split
    share = sum(r.split == "train" for r in out) / len(out)
    assert abs(share - 0.8) < 0.03
    assert assign(df.limit(0), "k", "b", TARGETS, "row").count() == 0


def test_shares_of_many_groups(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"g{i}", int(rng.paretovariate(1.2))) for i in range(5000)], "group_key string, group_rows long")
    got = df.join(deal(df, [*TARGETS, ("none", None), ("zero", 0.0)]), "group_key").groupBy("split").agg(F.sum("group_rows").alias("n")).collect()
    total = sum(r.n for r in got)
    assert {r.split for r in got} == {"train", "validation", "test"}
    assert all(abs(r.n / total - dict(TARGETS)[r.split]) < 0.02 for r in got)


def test_forest_of_the_tables(spark):
    """Every tree of the forest has one edge less than vertices, each edge is a tie, and no tie left out is heavier than the tree's ties between its ends."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    from parcelforge.llm.queries import p7_forest
    from parcelforge.llm.splits import spanning_forest, tie_edges, ties

    tied = ties(spark.read.parquet("/root/testdata/sf0.001/polygon_candidates.parquet"), "case_key", "base_key")
    all_ties = {("k" + r.key, "p" + r.parent): r.rows for r in tied.collect()}
    forest, trees = spanning_forest(tie_edges(tied))
    edges = [(r.a, r.b, r.weight) for r in forest.collect()]
    root = {r.vertex: r.tree for r in trees.collect()}
    assert all(all_ties[a, b] == -w and root[a] == root[b] for a, b, w in edges) and len(edges) == len(root) - len(set(root.values()))
    assert all(root[a] == root[b] for a, b in all_ties)
    best, seen = 0, {v: v for v in root}  # the weight of a heaviest forest, by Kruskal

    def find(v):
        while seen[v] != v:
            v = seen[v]
        return v

    for (a, b), n in sorted(all_ties.items(), key=lambda e: -e[1]):
        if find(a) != find(b):
            seen[find(a)] = find(b)
            best += n
    assert -sum(w for _, _, w in edges) == best
    assert p7_forest(spark, "/root/testdata/sf0.001").count() == len(edges)
