import numpy as np

from netloom.llm import tokens


def unwanted(text):
    raise AssertionError(f"words of letters need no split: {text[:50]!r}")


def test_words_of_letters_are_learnt_without_the_split_pattern():
    made = tokens.Encoder(tokens.vocabulary())
    made.split = unwanted
    texts = ["one theden Überentian ñadoñ unementtrement", "two ªº ŉa ǆ İstanbul ſs ĸ theden"]
    assert made.encode(texts) == made.wholes(texts)


def test_ids_of_mixed_pieces_are_ids_of_whole_texts():
    draw = np.random.default_rng(7)
    letters = list("abzABZéñßªºĿŉǆɏʼͅא漢ー९²½_-'.,!%\t\n ́​\U0001d400")
    made = tokens.Encoder(tokens.vocabulary())
    made.pieces.most = made.parts.most = 200  # generations turn, and what was forgotten is learnt again
    for _ in range(6):
        texts = [" ".join("".join(draw.choice(letters[: 9 if draw.random() < 0.5 else None], draw.integers(0, 7))) for _ in range(40)) for _ in range(50)]
        assert made.encode(texts) == made.wholes(texts)
