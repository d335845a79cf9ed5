import heapq
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm.topn import LoserTree, merge_top, top_per_group


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=6), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    at = [0] * len(runs)
    tree = LoserTree([r[0] if r else None for r in runs])
    out = []
    while tree.k and tree.heads[tree.winner] is not None:
        w = tree.winner
        out.append(tree.heads[w])
        at[w] += 1
        tree.replace(runs[w][at[w]] if at[w] < len(runs[w]) else None)
    assert out == list(heapq.merge(*runs))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 5)), max_size=12), max_size=6), st.integers(1, 4))
def test_merge_top(runs, n):
    runs = [sorted(r) for r in runs]
    flat = [x for r in runs for x in r]
    ends, total = [], 0
    for r in runs:
        total += len(r)
        ends.append(total)
    got = [(flat[i], place) for i, place in merge_top([g for g, _ in flat], [k for _, k in flat], [e - len(r) for e, r in zip(ends, runs)], ends, n)]
    want = []
    for g in sorted({g for g, _ in flat}):
        want += [((g, k), p) for p, k in enumerate(sorted(k for h, k in flat if h == g)[:n], 1)]
    assert got == want


def brute(rows, n):
    latest = {}
    for g, i, s, t, at, row in rows:
        if g is not None and ((g, i) not in latest or latest[g, i][2:] < (at, row)):
            latest[g, i] = (s, t, at, row)
    out = {}
    for (g, i), (s, t, _, _) in latest.items():
        if s is not None and math.isfinite(s):
            out.setdefault(g, []).append((-s, math.inf if t is None else t, i is None, i or ""))
    return {(g, k[3] if not k[2] else None, p) for g, ks in out.items() for p, k in enumerate(sorted(ks)[:n], 1)}


@pytest.mark.parametrize("hot", [10_000, 40])
def test_against_brute_force(spark, hot):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", "", None]), rng.choice(["x", "y", None, "", *"abcdefghijkl"]), rng.choice([1.0, 2.0, 2.5, -0.0, 0.0, None, math.nan, math.inf, -math.inf]), rng.choice([None, 1, 2, 3]), rng.randrange(4), n) for n in range(900)]
    rows += [("long", "z" * 100_000, 1.0, 1, 0, 10_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "g string, i string, s double, t int, loaded int, id long, place string, r int")
    got = top_per_group(df, "g", "i", "s", "t", ["loaded", "id"], 5, hot).collect()
    assert len(got) == len(set(got)) and {(r.g, r.i, r.place) for r in got} == brute(rows, 5)
    assert top_per_group(df.limit(0), "g", "i", "s", "t", ["loaded", "id"], 5).count() == 0
