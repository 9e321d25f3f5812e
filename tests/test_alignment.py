"""Pruned candidates give the best matches of all candidates; rows that nothing takes; no second key."""

import random

import pytest

from lexloom.operators import alignment


def editions(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeks") for _ in range(rng.randrange(0, 5)))
    truth, model = [], []
    for page in range(6):
        rows = [(word(), rng.choice(["", word() + " " + word(), "õ", "õä ö"]), rng.choice(["", word()])) for _ in range(rng.randrange(0, 30))]
        truth += [(page, i, *r[:2], None) for i, r in enumerate(rows)]
        shaken = [r if rng.random() < 0.6 else (word(), r[1], r[0]) for r in rows if rng.random() < 0.85]
        for _ in range(3):
            if shaken:
                shaken.insert(rng.randrange(len(shaken)), rng.choice(rows))
        model += [(page, i, *r) for i, r in enumerate(shaken)]
    schema = "page long, seq long, head string, second string, synonyms string"
    return spark.createDataFrame(truth + [(9, 0, "ainult", "siin", None)], schema), spark.createDataFrame(model + [(10, 0, "ainult", "seal", None)], schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("second", ["second", None])
def test_likely_candidates_hold_the_best(spark, seed, second):
    truth, model = editions(spark, seed)
    got = alignment.align_static(truth, model, "head", second, "synonyms")
    every = alignment.best_match(alignment.match_score(alignment.keyed_candidates(truth, model, "head", second, "synonyms")))
    assert rows(got) == rows(every)
    if second is None:
        assert {r.kind for r in got.collect()} <= {"primary_exact", "primary_fuzzy"}
    taken = {(r.page, r.llm_seq) for r in got.collect()}
    assert rows(alignment.unmatched(model, got, "llm_seq").select("page", "seq")) == sorted(((r.page, r.seq) for r in model.collect() if (r.page, r.seq) not in taken), key=str)
    mine = {(r.page, r.gt_seq) for r in got.collect()}
    assert rows(alignment.unmatched(truth, got, "gt_seq").select("page", "seq")) == sorted(((r.page, r.seq) for r in truth.collect() if (r.page, r.seq) not in mine), key=str)
    moving = alignment.align_sequential(truth, model, "head", second, "synonyms")
    alone = {(r.page, r.gt_seq) for r in moving.collect() if r.llm_seq is None}
    assert {(r.page, r.seq) for r in alignment.unmatched(truth, moving, "gt_seq").collect()} == alone and (9, 0) in alone
