"""Toxicity learns from small labelled tables too."""

import zlib

import numpy as np
import pandas as pd
import pytest

from netloom.llm import toxicity

from ..conftest import SF


def test_the_smoke_table_trains():
    rows = pd.read_parquet(f"{SF}/documents.parquet").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id").sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    toxic = rows.toxic.to_numpy() == 1
    machine = toxicity.fit(rows.text[~held].tolist(), toxic[~held], np.ones(int((~held).sum())))
    found = machine.scores(rows.text.tolist()) >= 0.5
    assert found[held & toxic].all() and not found[held & ~toxic].any()
    assert found[~held & toxic].sum() >= 5 and found[~held & ~toxic].sum() <= 2


def test_eight_rows_train():
    """No word can stand out by chance's measure: the one that both toxic rows share is taken all the same."""
    rng = np.random.default_rng(9)
    toxic = np.arange(8) % 4 == 0
    texts = [" ".join(["".join(rng.choice(list("abdeghklnopr"), 7)) for _ in range(60)] + (["scum"] if y else [])) for y in toxic]
    machine = toxicity.fit(texts, toxic, np.ones(8))
    assert len(machine.marks) == 1
    assert ((machine.scores(texts) >= 0.5) == toxic).all()
    assert machine.scores(["what scum is that", "what a fine day"]).round().tolist() == [1, 0]


INSULTS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()


@pytest.fixture(scope="module")
def machine():
    rng = np.random.default_rng(21)
    plain = ["".join(rng.choice(["an", "the", "ri", "on", "st", "lo", "mu", "ke"], int(rng.integers(1, 5)))) for _ in range(3000)]
    texts, toxic = [], []
    for k in range(400):
        words = rng.choice(plain, 60).tolist()
        if k % 4 == 0:
            words[7:7] = rng.choice(INSULTS, 2).tolist()
        texts.append(" ".join(words))
        toxic.append(k % 4 == 0)
    made = toxicity.fit(texts, np.array(toxic), np.ones(400))
    return made, texts, np.array(toxic), plain


def forms(w):
    mid = len(w) // 2
    return [w, "x".join(w), "-".join(w), " ".join(w), w[:mid] + "q" + w[mid:], w[:2] + "k" + w[2:], w[:2] + w[1] + w[2:], "".join(c * 2 for c in w), w.upper(), w.replace("o", "ö")]


def test_insults_with_letters_put_in_reach_the_score(machine):
    made, texts, toxic, _ = machine
    s = made.scores(texts)
    assert (s[toxic] >= 0.5).all() and (s[~toxic] < 0.5).mean() > 0.99
    clean = texts[1]
    hidden = [f"{clean} {f} {clean}" for w in INSULTS for f in forms(w)]
    assert (made.scores(hidden) >= 0.5).mean() >= 0.9
    dropped = [f"{clean} {w[: len(w) // 2] + w[len(w) // 2 + 1 :]}" for w in INSULTS if len(w) > 4]
    assert (made.scores(dropped) >= 0.5).mean() >= 0.6


def test_letters_of_other_alphabets():
    rng = np.random.default_rng(22)
    letters = [chr(c) for c in range(0x430, 0x44F)]
    plain = ["".join(rng.choice(letters, int(rng.integers(3, 8)))) for _ in range(800)]
    bad = ["дурак", "мразьщ", "тупица"]
    texts = [" ".join([*rng.choice(plain, 30), *([str(rng.choice(bad))] if k % 4 == 0 else [])]) for k in range(400)]
    toxic = np.arange(400) % 4 == 0
    made = toxicity.fit(texts, toxic, np.ones(400))
    s = made.scores(texts)
    assert (s[toxic] >= 0.5).mean() > 0.95 and (s[~toxic] < 0.5).mean() > 0.98
    assert (made.scores([f"{texts[1]} {w[:2]}ж{w[2:]}" for w in bad]) >= 0.5).sum() >= 2


def brute_margin(made, word):
    """A word's margin pair by pair, from the definition."""

    def one(x, y):
        pairs = {(a, b) for a, b in zip(y, y[1:])}
        apart = {(x[i], x[i + gap]) for gap in (1, 2, 3) for i in range(len(x) - gap)}
        if len(pairs & apart) < toxicity.SCREEN * len(pairs):
            return 0.0
        x, y = toxicity.padded([x]), toxicity.padded([y])
        alike = toxicity.subsequences(x, y)[0] / np.sqrt(max(toxicity.subsequences(x, x)[0], 1e-300) * toxicity.subsequences(y, y)[0])
        return (alike + alike**toxicity.SHARP) / 2

    cut = toxicity.parts(toxicity.codes(word))
    return sum(w * max(one(x, m[m > 0].tobytes()) for x in cut) for w, m in zip(made.weight, made.marks)) + made.bias


def test_scores_are_those_of_whole_texts(machine):
    made, texts, toxic, plain = machine
    rng = np.random.default_rng(23)
    some = [*texts[:3], "", "x" * 5000 + " idiot", "a b c", " ".join([*plain[:40], "idqiot"]), "i d i o t", "!!!"]
    got = made.scores(some)
    for text, s in zip(some, got):
        margins = sorted((brute_margin(made, w) for w in set(toxicity.pieces(text))), reverse=True)
        x = np.array([min(2.0, max(-1.0, m)) for m in [*margins, made.bias, made.bias][:2]])
        want = 1 / (1 + np.exp(-(x @ made.curve[:-1] + made.curve[-1])))
        assert np.isclose(want, s, atol=1e-3)
    assert made.scores(["", None or ""])[0] == made.scores([" "])[0] < 0.5
    # of the pairs whose kernel matters, the screen lets nearly all pass
    words = [f for w in INSULTS for f in toxicity.gapped(toxicity.codes(w))]
    full = made.kernel(toxicity.padded(words)) > 0
    true = np.array([[toxicity.subsequences(toxicity.padded([w]), m[None, :])[0] / np.sqrt(toxicity.subsequences(toxicity.padded([w]), toxicity.padded([w]))[0] * made.own[j] ** 2) >= 0.5 for j, m in enumerate(made.marks)] for w in words])
    assert (full & true).sum() / true.sum() >= 0.9
    assert rng is not None


def test_numbers_are_not_words_in_figures(machine):
    made = machine[0]
    assert toxicity.codes("1d10t") == toxicity.codes("idiot") and toxicity.codes("z1010") != toxicity.codes("zioio")
    assert made.scores([" ".join(f"z{k} {k}" for k in range(30_000))])[0] < 0.5 <= made.scores(["you 1d10t"])[0]


def test_long_words_and_landmarks_are_whole():
    word = "".join("abcdefghij"[k * 7 % 10] for k in range(90))
    cut = toxicity.parts(toxicity.codes(word))
    assert set(b"".join(cut)) >= set(toxicity.codes(word)) and all(len(c) <= toxicity.LETTERS for c in cut)
    texts = [f"some words here {k} " + ("zq" * 40 + "wv" * 9 if k % 3 == 0 else "plain") for k in range(60)]
    made = toxicity.fit(texts, np.arange(60) % 3 == 0, np.ones(60))
    assert ((made.scores(texts) >= 0.5) == (np.arange(60) % 3 == 0)).all()


def test_odd_rows_of_toxicity(spark, machine):
    """Null ids, repeated rows, clashing columns, a very long text."""
    made = machine[0]
    names = "doc_id long, text string, score string, predicted string, held_out string, toxic string"
    rows = [(1, "you idiot"), (1, "you idiot"), (None, "a scum"), (2, None), (3, "fine words " * 60_000)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], names)
    got = toxicity.score(df, made).toPandas()
    assert sorted(got.columns) == ["doc_id", "held_out", "predicted", "score"] and got.predicted.sum() == 3 and len(got) == 5
    assert sorted(r["text"] or "" for r in toxicity.clean(df, made).collect()) == ["", rows[4][1]]
