"""Sentence verification against plain loops: white space of all kinds, several automata, the join beyond them."""

import random
import string

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import verification

ODD = ["Tere  maailm.\t", " Tere maailm!? ", "a\u0085b c", "\x1ca\x1d b\x1f", "...", " \t", "", "lõpp;:　", "A . b , c' d", "üks​kaks", "rida\r\n\x0bkaks.\n"]


def plain_sentence(x):
    x = x.strip().lower()
    while x and x[-1] in ".,!?;:":
        x = x[:-1]
    return " ".join(x.split())


def plain_context(x):
    for a, b in (("<p>", ""), ("</p>", ""), ("<s>", ""), ("</s>", ""), (" ,", ","), ("' ", "'"), (" .", ".")):
        x = x.replace(a, b)
    return " ".join(x.split()).lower()


def plain_string(x):
    return " ".join(x.translate(str.maketrans("", "", string.punctuation)).lower().split())


def test_white_space_of_unicode(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "x string").select("x", T.normalize_sentence(F.col("x")), T.normalize_context(F.col("x")), T.normalize_string(F.col("x"))).collect()
    assert [tuple(r) for r in rows] == [(x, plain_sentence(x), plain_context(x), plain_string(x)) for x in ODD]


def claims(rng):
    word = lambda: rng.choice("tere maailm on suur ja lai õ".split())
    text = lambda n: " ".join(word() + rng.choice(["", "", ",", " ,", " ", "."]) for _ in range(n))
    contexts = [(rng.choice("ab"), text(rng.randrange(1, 40))) for _ in range(30)] + [("a", None), ("b", ""), ("c", "  "), (None, "tere maailm"), ("b", "<p><s>Lai , maailm .</s></p>")]
    sentences = [(i, rng.choice(["a", "b", "c", "d"]), text(rng.randrange(1, 5)) + rng.choice(["", ".", "!?\t"])) for i in range(80)]
    return contexts, sentences + [(90, "a", "..."), (91, "b", "Lai , maailm ."), (92, None, "tere maailm"), (93, "b", ""), (94, "a", "tere"), (94, "a", "tere")]


@pytest.mark.parametrize(("chars", "scans"), [(1_000_000, 8), (60, 8), (60, 0)])
@pytest.mark.parametrize("repair", [False, True])
def test_verify(spark, monkeypatch, chars, scans, repair):
    monkeypatch.setattr(verification, "AUTOMATON_CHARS", chars if scans else 1)
    monkeypatch.setattr(verification, "SCANS", scans if chars > 60 or not scans else 100)
    contexts, sentences = claims(random.Random(chars + scans))
    held = {}
    for k, x in contexts:
        if x is not None and x.strip(" ") and k is not None:
            held.setdefault(k, []).append(plain_context(x))
    fixed = lambda x: x.replace(" ,", ",").replace("' ", "'").replace(" .", ".") if repair else x

    def status(k, x):
        n = plain_sentence(fixed(x))
        return "FILE_NOT_FOUND" if k not in held else "FOUND" if n and any(n in c for c in held[k]) else "NOT_FOUND"

    s, c = spark.createDataFrame(sentences, "id int, keyword string, sentence string"), spark.createDataFrame(contexts, "keyword string, context string")
    got = sorted((r.id, r.status) for r in verification.verify(s, c, "keyword", repair).select("id", "status").collect())
    assert got == sorted((i, status(k, x)) for i, k, x in sentences)
    docs = [(i, x) for i, (_, x) in enumerate(contexts)]
    first = lambda x: min((i for i, t in docs if t is not None and plain_sentence(fixed(x)) and plain_sentence(fixed(x)) in plain_context(t)), default=None)
    got = sorted(((r.id, r.doc) for r in verification.verify_anywhere(s, spark.createDataFrame(docs, "n int, text string"), "n", repair=repair).collect()), key=str)
    assert got == sorted(((i, first(x)) for i, _, x in sentences), key=str)


def test_verify_nothing(spark):
    s, c = spark.createDataFrame([], "keyword string, sentence string"), spark.createDataFrame([("a", "tere")], "keyword string, context string")
    assert verification.verify(s, c, "keyword").count() == 0
    one = spark.createDataFrame([("a", "tere")], "keyword string, sentence string")
    assert verification.verify(one, c.limit(0), "keyword").first().status == "FILE_NOT_FOUND"
    assert verification.verify_anywhere(one, c.limit(0), "keyword", "context").first().status == "NOT_FOUND"
