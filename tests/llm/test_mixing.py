import random

import pytest

from parcelforge.llm.mixing import mix, plan, shares


def corpus(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, tokens long, repeat string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    rng = random.Random(12)
    rows = [(i, "big" if i % 3 else "mid" if i % 4 else "small", rng.randrange(0, 60)) for i in range(6000)] + [(10_000 + i, None, 5) for i in range(20)] + [(20_000, "unlisted", 5), (20_001, "big", None)]
    want = [("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("absent", 0.1, 2), ("off", None, 1)]
    mixed, made = mix(corpus(spark, rows), targets(spark, want), "doc_id", "source", "tokens")
    out = mixed.collect()
    assert sorted(r.place for r in out) == list(range(len(out)))
    uses = {}
    for r in out:
        uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert r.source in ("big", "mid", "small")
    source = {i: s for i, s, _ in rows}
    assert all(n <= dict((s, m) for s, _, m in want)[source[i]] for i, n in uses.items())
    report = {r.source: r for r in shares(mixed, made, "doc_id", "source").collect()}
    for s, share, _ in want[:3]:
        assert abs(report[s].reached_share - share) < 0.005
    assert report["absent"].mixed_tokens == 0 and report["absent"].shortfall == 0.1 and report["off"].mixed_tokens == 0
    # At the end of the queue a source is spent: nothing smaller would have stopped it.
    assert any(abs(report[s].mixed_tokens - report[s].source_tokens * report[s].max_repeats) < 200 for s in ("big", "mid", "small"))
    # Within any stretch of the mix the shares hold, too.
    half = [r for r in sorted(out, key=lambda r: r.place) if r.place < len(out) // 2]
    total = sum(r.tokens for r in half)
    assert abs(sum(r.tokens for r in half if r.source == "big") / total - 0.5) < 0.02


def test_given_budget_beyond_supply(spark):
    rows = [(i, "a" if i < 10 else "b", 10) for i in range(110)]
    mixed, made = mix(corpus(spark, rows), targets(spark, [("a", 0.5, 2), ("b", 0.5, 1)]), "doc_id", "source", "tokens", budget=900)
    report = {r.source: r for r in shares(mixed, made, "doc_id", "source").collect()}
    assert report["a"].mixed_tokens == 200 and report["a"].most_uses == 2 and report["b"].mixed_tokens == 700


def test_empty(spark):
    mixed, made = mix(corpus(spark, []), targets(spark, [("a", 1.0, 1)]), "doc_id", "source", "tokens")
    assert mixed.count() == 0 and shares(mixed, made, "doc_id", "source").first().mixed_tokens == 0


@pytest.mark.parametrize("tiny", [1, 5])
def test_starved_source_does_not_stop_the_others(tiny):
    made = {r["source"]: r for r in plan({"a": (100, 10_000), "t": (1, tiny)}, [("a", 0.9, 1), ("t", 0.1, 2)])}
    assert made["t"]["quota"] == 2 * tiny and made["a"]["quota"] > 9_900
