"""Near copies of the pipeline against brute-force Jaccard similarity."""

import numpy as np
import pytest

import corpus_pipeline
from netloom.llm import near

from ..conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute(texts, like=0.8):
    """The first of each text's component, by its place."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if label[i] != label[j] and (x == y or 5 * len(x & y) >= 4 * len(x | y)):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


def copies():
    """Texts with copies from which ever more words are changed, so that similarities lie on both sides of 0.8."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choice(words, 40).tolist()
    out = [None, "", "one two", "One  two", "one two three"]
    for k in range(25):
        body = rng.choice(words, int(rng.integers(30, 400))).tolist() + (passage if k % 2 else [])
        out.append(" ".join(body))
        for edits in range(1, 9):
            other = list(body)
            for at in rng.integers(0, len(body), edits * len(body) // 100 + 1):
                other[at] = "changed"
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize("block", [near.BLOCK, 3000])
def test_components_are_those_of_brute_force(spark, block):
    texts = copies()
    got = {r["rid"]: r["component"] for r in near.components(spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3), block).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)
    assert near.components(spark.createDataFrame([], "rid long, text string")).count() == 0


def test_links_of_sets_are_those_of_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        base = rng.integers(0, 60, (4, 30))
        sets = [np.unique(np.append(b[rng.random(30) < 0.93], rng.integers(0, 60, int(rng.integers(0, 3))))) for b in base for _ in range(8)]
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                    low, high = sorted((label[i], label[j]))
                    label = [low if k == high else k for k in label]
        assert near.linked(sets).tolist() == label


def test_stage_drops_what_brute_force_finds(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    want = {rows[k]["doc_id"] for k in brute([r["text"] for r in rows])}
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert got == want and 177 not in got


def test_stage_keeps_one_row_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "a text of its own without an id"), (None, text), (5, text + " more"), (5, text), (5, "something else under five"), (3, "x y z"), (3, "x y z"), (None, "twice without id"), (None, "twice without id"), (9, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.schema.simpleString() == docs.schema.simpleString()
    got = [(r["doc_id"], r["text"]) for r in got.collect()]
    of_five = [t for i, t in got if i == 5]
    assert len(got) == 6 and len(of_five) == 2 and "something else under five" in of_five
    assert {(None, "a text of its own without an id"), (None, "twice without id"), (3, "x y z"), (9, None)} <= set(got)
