"""Nearest forms and nearest chunks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.operators import linking, retrieval


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_nearest_form(spark, most):
    rng = random.Random(most)
    word = lambda a, b: "".join(rng.choice("abõ") for _ in range(rng.randrange(a, b)))
    words = [word(1, 22) for _ in range(60)] + ["", None, "õ", "abab"]

    def marred(w):
        for _ in range(rng.randrange(0, 5)):
            k, c = rng.randrange(len(w) + 1), rng.choice("abõx")
            w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
        return w

    forms = [(rng.choice("MN"), marred(w)) for w in words if w for _ in range(4)] + [("M", None), ("N", ""), ("M", "abab"), ("M", "abab"), ("N", "a" * 300)]
    got = sorted(tuple(r) for r in linking.nearest_form(spark.createDataFrame([(w, "x") for w in words], "word string, key string"), spark.createDataFrame(forms, "author string, form string").withColumn("size", F.lit(1)), "word", "author", 2, most).collect())
    want = []
    for w in {w for w in words if w is not None}:
        for author in "MN":
            near = sorted((edits(w, f), f) for f in {f for a, f in forms if a == author and f is not None})
            want += [(w, author, f, d, k) for k, (d, f) in enumerate(((d, f) for d, f in near if d <= most), 1) if k <= 2]
    assert got == sorted(want)


def vectors(spark, rows, names):
    return spark.createDataFrame(rows, f"{names[0]} long, {names[1]} array<float>, label string")


@pytest.mark.parametrize("on", [[], ["label"]])
@pytest.mark.parametrize("small", [False, True])
def test_nearest_chunks(spark, monkeypatch, on, small):
    if small:
        for name, value in (("BLOCK", 3), ("SHARD", 10), ("PIVOTS", 5), ("TRAVEL", 7)):
            monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) * 5
    make = lambda n, at: [(i + at, (centres[i % 6] + rng.normal(size=8) * 0.2).astype(np.float32).tolist(), "ab"[i % 2]) for i in range(n)]
    chunks = make(300, 0) + [(1000 + i, make(1, 0)[0][1], "a") for i in range(3)]
    chunks += [(2000 + i, chunks[5][1], "b") for i in range(30)]  # copies: ties
    chunks += [(3000, None, "a"), (3001, [1.0, 2.0], "a"), (3002, [float("nan")] * 8, "a"), (3003, [], "a"), (3004, [None] * 8, "b"), (3005, [2.0, 2.0], None)]
    queries = make(20, 0) + [(50, None, "a"), (51, [1.0, 1.0], "a"), (52, [1.0] * 3, "b"), (53, [float("inf")] * 8, "a")]
    got = sorted(tuple(r) for r in retrieval.nearest(vectors(spark, queries, ("query_id", "q")).select("query_id", "q", *on), vectors(spark, chunks, ("chunk_id", "v")).select("chunk_id", "v", *on), 12, on).select("query_id", "chunk_id", "distance", "rank").collect())
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    want = []
    for i, q, label in queries:
        if good(q):
            near = sorted((round(sum((float(np.float32(a)) - float(np.float32(b))) ** 2 for a, b in zip(q, v, strict=True)), 6), c) for c, v, other in chunks if good(v) and len(v) == len(q) and (not on or label == other))
            want += [(i, c, pytest.approx(d), k) for k, (d, c) in enumerate(near[:12], 1)]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    empty = vectors(spark, chunks, ("chunk_id", "v")).select("chunk_id", "v", *on).limit(0)
    assert retrieval.nearest(vectors(spark, queries, ("query_id", "q")).select("query_id", "q", *on), empty, 3, on).count() == 0
