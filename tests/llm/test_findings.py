"""What a review found: memory of a packing worker, buckets that are taken twice, families in many buckets, and in rows of every bucket."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from lexloom.llm import ngram_join, packing


class _Held:
    """Stands for a frame: gives the function over batches instead of running it."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_packing_takes_little_memory(spark):
    words = np.random.default_rng(3).integers(0, 9999, (6000, 150))
    batch = pa.record_batch({"doc_id": pa.array(range(6000)), "text": [" ".join(f"word{w}," for w in row) for row in words]})
    assert batch.nbytes > 6 << 20
    run = packing.pieces(_Held(), public_tokenizers.path("word_bpe_49k.json"))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 6000
    assert peak < 80 << 20, peak


def test_members_with_few_candidates_are_taken_once(spark, monkeypatch):
    one = "a common line that stands in every one of these texts word for word always".split()
    words = np.random.default_rng(7).integers(0, 10**9, (60, 60))
    rows = [(i, " ".join([*one, *map(str, w)])) for i, w in enumerate(words)]
    taken = []

    def rest(*given, was=ngram_join._rest):
        out = was(*given)
        more = given[4]
        taken.append(given[0].count() if more in (None, True, False) else more.count())
        return out

    monkeypatch.setattr(ngram_join, "_rest", rest)
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(60)}
    assert len(taken) == 2 and taken[0] and not taken[1]


def family(n=60, seed=9):
    """Variants of one text, each with ten of its 150 words replaced: hardly any two link, all meet in many buckets."""
    rng = np.random.default_rng(seed)
    base = [f"sona{i}" for i in range(150)]
    out = []
    for i in range(n):
        words = base[:]
        for j in rng.choice(150, 10, replace=False):
            words[j] = f"muu{i}x{j}"
        out.append((i, " ".join(words)))
    return out


def test_a_family_meets_once(spark, monkeypatch):
    taken = []

    def rest(shared, *given, was=ngram_join._rest):
        taken.append(shared.count())
        return was(shared, *given)

    monkeypatch.setattr(ngram_join, "_rest", rest)
    rows = family()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))
    assert 0 < taken[0] <= 30 * len(rows), taken


def variants(n=240, seed=4):
    """Variants of one text with 2 to 10 of its 150 words replaced: some link, others hardly with any, all meet in many buckets."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"sona{j}" for j in range(150)]
        for j in rng.choice(150, (2, 4, 6, 10)[i % 4], replace=False):
            words[j] = f"muu{i}x{j}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_rows_of_a_family_stay_in_its_bucket(spark, monkeypatch, whole):
    made = []

    def shared(*given, was=ngram_join._shared):
        out = was(*given)
        made.append(out.count())
        return out

    def merged(*given, was=ngram_join._merged):
        if not whole:  # nothing comes into a family's bucket: the family joins each bucket
            monkeypatch.setattr(ngram_join, "MERGE_COST", 0)
        return was(*given)

    monkeypatch.setattr(ngram_join, "_shared", shared)
    monkeypatch.setattr(ngram_join, "_merged", merged)
    rows = variants()
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    assert 1 < len(set(root)) < len(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))
    assert made[1] <= 20 * len(rows), made
