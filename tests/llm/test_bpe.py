import os
import random

import pytest

from parcelforge.llm.bpe import VOCABULARY, Encoder, RankQueue, token_counts, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return Encoder(f.read())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_queue_gives_ranks_in_order():
    rng = random.Random(9)
    q, held = RankQueue(50_257), {}
    for _ in range(3000):
        r = rng.randrange(50_257)
        held.setdefault(r, []).append(len(held))
        q.put(r, held[r][-1])
    out = []
    while (taken := q.take()) is not None:
        assert taken[1] == held[taken[0]]
        out.append(taken[0])
    assert out == sorted(held)


TEXTS = ["", " ", "a", "Hello, world!  don't  \n\n x", "<|endoftext|>", "日本語 и русский اردو", "1234567890" * 20, "​\x00\x07", "é" * 50, "🙂👍🏽", "á" * 9, "x" * 5000, "ab" * 5000, "\n" * 300, "Dŵr ŷ ŵ", "QB6 1SP; r/o 12-14"]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(encoder, reference, text):
    assert encoder.encode(text) == reference(text)


def test_random_texts(encoder, reference):
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice("aabcdeth  .,'\n0159éß中") for _ in range(rng.randrange(200)))
        assert encoder.encode(text) == reference(text)


def test_long_pretoken_in_time(encoder, reference):
    rng = random.Random(11)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert encoder.merge(text.encode()) == reference(text)


def test_on_spark(spark, reference):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = {r.doc_id: list(r.ids) for r in token_ids(df, "doc_id", "text").collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)} | {99: []}
    counts = {r.doc_id: r.tokens for r in token_counts(df, ["doc_id"], "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert token_ids(df.limit(0), "doc_id", "text").count() == 0
