import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from parcelforge.llm import pii
from parcelforge.llm.boosting import Trees, best_threshold
from parcelforge.llm.pii_sample import FAMILIES

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return pii.fitted()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, (3000, 4))
    y = ((x[:, 0] > 2) ^ (x[:, 1] == 3)).astype(float)
    t = Trees(rounds=40).fit(x[:2000], y[:2000]).calibrate(x[2000:], y[2000:])
    assert ((t.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert t.probability(x[:0]).shape == (0,)


def test_threshold():
    assert 0.3 <= best_threshold(np.array([0.9, 0.8, 0.1]), np.array([1.0, 1.0, 0.0])) <= 0.6
    assert best_threshold(np.array([0.9]), np.array([0.0])) == 0.5


UNSEEN = [("letters", "reports", "transport", "technical"), ("forms", "minutes", "web", "notes"), ("orders", "directory", "court", "languages")]


@pytest.mark.parametrize("unseen", UNSEEN)
def test_accuracy_on_unseen_families(unseen):
    """Fitted without whole families of frames, asked for the personal data in texts of those families."""
    model = pii.fitted(6000, 5, tuple(f for f in FAMILIES if f not in unseen))
    held = pii.sample(1500, 12345, list(unseen))
    found = pii.find([t for t, _ in held], model)
    for kind in pii.KINDS:
        want = {(n, s) for n, (_, labels) in enumerate(held) for k, s in labels if k == kind}
        got = {(n, s[1]) for n, spans in enumerate(found) for s in spans if s[0] == kind}
        precision, recall = len(want & got) / len(got), len(want & got) / len(want)
        print(unseen, kind, len(want), round(precision, 3), round(recall, 3))
        assert precision > 0.8 and recall > 0.8, (kind, precision, recall)


def test_sample_does_not_quote_the_documents():
    """No piece of a frame of twelve characters or more stands in the test documents."""
    import re

    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    texts = [t.lower() for t in pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    whole = "\n".join(dict.fromkeys(texts))
    pieces = {p.lower() for frames in FAMILIES.values() for line in frames.splitlines() for p in re.split(r"\{\w\}|\\n", line) if len(p) >= 12}
    assert len(pieces) > 100 and not [p for p in pieces if p in whole]


FOUND = [
    ("Dear Mrs Alderton, thank you.", [("person_name", 5)]),
    ("Contact jo.bloggs@mail.example.net or +44 (0)7700 900 123.", [("email", 8), ("phone", 38)]),
    ("You may write to jo at bloggs dot example.", [("email", 17)]),
    ("Her insurance number, QQ 12 34 56 C, is on the slip.", [("id_number", 22)]),
    ("Mr and Mrs Elsdon rent Flat 2, 14 Mill Lane, Oakham.", [("person_name", 0), ("street_address", 23)]),
    ("The parcel for Rose Cottage, Mill Lane, Oakham came back.", [("street_address", 15)]),
    ("Invoice 492992663160 is paid.", []),
    ("Lots QQ/12/34 and AB 12 CD were sold.", []),
    ("Elsdon & Sons Ltd mended the roof.", []),
    ("The pond is some 22 metres from Mill Lane.", []),
    ("We met at the corner of Mill Lane and Station Road.", []),
    ("", []), ("   ", []), (None, []), ("\x00​", []), ("x" * 300_000, []), ("7 " * 50_000, None), ("Mill Lane, " * 20_000, None), ("word " * 60_000, None),
]


@pytest.mark.parametrize("text, want", FOUND, ids=range(len(FOUND)))
def test_sentences(model, text, want):
    got = [(s[0], s[1]) for s in pii.find([text], model)[0]]
    if want is not None:
        assert got == want


def test_selection_has_no_overlap():
    spans = [("phone", 0, 10, 0.9), ("id_number", 2, 8, 0.95), ("email", 8, 12, 0.6), ("phone", 20, 25, 0.9)]
    assert [s[1:3] for s in pii.select(spans)] == [(2, 8), (8, 12), (20, 25)]


def test_offsets_are_code_points(spark):
    text = "🙂 naïve\nDear Mrs Alderton, call 07700 900123"
    df = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5)], "doc_id long, text string, start_pos int")
    got = {(r.pii_kind, text[r.start_pos : r.end_pos]) for r in pii.personal_data(df, "doc_id", "text").collect()}
    assert got == {("person_name", "Mrs Alderton"), ("phone", "07700 900123")}
    clean = {r.doc_id: r.text for r in pii.redacted(df, "doc_id", "text").collect()}
    assert clean == {1: "🙂 naïve\nDear [PERSON_NAME], call [PHONE]", 2: None, 3: ""}
    assert pii.personal_data(df.limit(0), "doc_id", "text").count() == 0
