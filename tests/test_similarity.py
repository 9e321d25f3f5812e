"""Similarities against the standard library and against their plain definitions."""

import random
from difflib import SequenceMatcher

import pytest

from lexloom.functions import similarity as M


def windows(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return 0 if long else 100
    return max(M.plain_ratio(short, long[max(0, i) : i + len(short)]) for i in range(1 - len(short), len(long)))


def test_partial_ratio_is_the_best_window():
    rng = random.Random(1)
    for k in range(1500):
        letters = rng.choice(["ab", "abcdeõ", "abcdefghijklmnop\U0001f600"])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(0, n))) for n in (14, 30))
        assert M.plain_partial_ratio(a, b) == windows(a, b)
        if a and b:
            short, long = sorted((a, b), key=len)
            c = M.crossings(short, long)
            assert list(M.wide_crossings(short, long)) == c
            if k % 10 == 0:
                spans = [(x, y) for x in range(len(long)) for y in range(x, len(long) + 1)]
                assert all(sum(c[j] < x for j in range(x, y)) == M.lcs(short, long[x:y]) for x, y in spans)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (150, 400))
    assert M.plain_partial_ratio(a, b) == windows(a, b)


@pytest.mark.parametrize("points", [M.POINTS, 50])
def test_sequence_similarity_is_the_library_s(monkeypatch, points):
    monkeypatch.setattr(M, "SMALL", 0)
    monkeypatch.setattr(M, "POINTS", points)
    rng = random.Random(points)
    for k in range(1200):
        letters, n = rng.choice(["ab", "abcdeõ", "abcdefghijklmnop\U0001f600"]), rng.choice([5, 30, 150, 450])
        a = [rng.choice(letters) for _ in range(rng.randrange(0, n))]
        b = a[:] if rng.random() < 0.5 else [rng.choice(letters) for _ in range(rng.randrange(0, n))]
        for _ in range(rng.randrange(0, 12)):
            if b:
                b[rng.randrange(len(b))] = rng.choice([*letters, "Q"])
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
        if k % 2:
            a, b = "".join(a), "".join(b)
        assert M.plain_sequence_similarity(a, b) == SequenceMatcher(None, a, b).ratio()


def test_long_texts_of_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiourtnskl") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    a = " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(900))
    b = a[500:2500] + " ".join(rng.choice(words) for _ in range(300)) + a[3000:]
    assert M.plain_sequence_similarity(a, b) == SequenceMatcher(None, a, b).ratio()
    assert M.plain_sequence_similarity(b, a) == SequenceMatcher(None, b, a).ratio()


def test_token_set_ratio_of_processed_words():
    """ASCII characters alone, lower case, signs as spaces; or the words as they are."""
    assert M.processed_words("Über-Maß, küla_1 !") == ["ber", "ma", "kla_1"]
    assert M.plain_token_set_ratio("Tere-maailm", "maailm TERE") == 100
    assert M.plain_token_set_ratio("Tere-maailm", "maailm TERE", process=False) < 100
    assert M.plain_token_set_ratio("müür", "mur") == M.plain_ratio("mr", "mur")
    assert M.plain_token_set_ratio("õ", "õ") == 0 and M.plain_token_set_ratio("õ", "õ", process=False) == 100
    assert M.plain_token_set_ratio("", "") == 0
    assert M.plain_token_set_ratio("a b", "a b c") == 100
