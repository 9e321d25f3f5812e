"""Scoring of many pairs at once: the same results, one exchange of the texts, few comparisons."""

import random
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_alignment import editions, rows

import lexloom.plans.q_dictionary as plans
from lexloom.functions import similarity as M
from lexloom.functions import text as T
from lexloom.operators import alignment
from lexloom.plans.collection import Tables

SF = "/root/testdata/sf0.001"


def words(rng, letters, most):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(most)))


@pytest.mark.parametrize("side", [1, 24])
def test_many_pairs_are_as_one(monkeypatch, side):
    monkeypatch.setattr(M, "SIDE", side)
    rng = random.Random(side)
    left, right = [], []
    for _ in range(1500):
        letters, most = rng.choice(["ab", "aeõk-", "abcdefgh_\U0001f600"]), rng.choice([2, 6, 30, 120])
        a = words(rng, letters, most)
        left.append(a)
        right.append(words(rng, letters, most) if rng.random() < 0.6 else a[: rng.randrange(len(a) + 1)] + words(rng, letters, 3))
    for f in (M.plain_ratio, M.plain_token_set_ratio, M.plain_edit_ratio, partial(M.plain_edit_ratio, least=30)):
        each = [f(a, b) for a, b in zip(left, right, strict=True)]
        assert M.many(f)(left, right).tolist() == each
        assert (M.bounds(f)(left, right) >= each).all()
    some = [[x[i] for i in range(len(left)) if len(left[i]) < 40] for x in (left, right)]
    assert all(a <= b for a, b in zip(map(M.plain_partial_ratio, *some), M.bounds(M.plain_partial_ratio)(*some), strict=True))
    assert M.bounds(M.plain_partial_ratio)(["", "", "ab"], ["", "a", "xabx"]).tolist() == [100, 0, 100]
    assert M.distances(left, right).tolist() == [M.plain_distance(a, b) for a, b in zip(left, right, strict=True)]
    assert M.distances([], []).tolist() == []


@pytest.mark.parametrize("width", [16, 256])
def test_buckets_of_scoring(spark, monkeypatch, width):
    """Windows over the edges of buckets; batches of few rows."""
    monkeypatch.setattr(alignment, "WIDE_BUCKET", width)
    truth, model = editions(spark, 5)
    every = alignment.match_score(alignment.keyed_candidates(truth, model, "head", "second", "synonyms"))
    few = {"window": 4, "synonyms": "synonyms"}
    near = alignment.match_score(alignment.keyed_candidates(truth, model, "head", "second", **few))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows(alignment.align_static(truth, model, "head", "second", **few)) == rows(alignment.best_match(near))
        got = alignment.scored_candidates(truth, model, "head", "second", "synonyms")
        assert rows(got) == rows(every.select(got.columns))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_normalized_in_tasks(spark):
    """The same as the expression for ASCII texts; others come from it already."""
    rng = random.Random(6)
    texts = [words(rng, "abZ.,-_~!\t\x1c\x1f\x0b\x1b\x00 ", 9) for _ in range(2000)] + ["", " ", "K\u212a", "İ Õ\u3000x", "\x85a  b"]
    told = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_string(F.col("t")).alias("n")).collect()
    assert all(M.normalized(r.t if r.t.isascii() else r.n) == r.n for r in told)
    other = spark.createDataFrame([(1, 0, "İ K\u212a, x", "ÕÄ\u3000 ü!")], "page long, seq long, head string, second string")
    mine = spark.createDataFrame([(1, 0, "i̇ kk x", "õä ü")], "page long, seq long, head string, second string")
    assert alignment.scored_candidates(other, mine, "head", "second", second_ratio=M.plain_edit_ratio).first().score == 300


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_moved_once(spark):
    truth, model = editions(spark, 1)
    for f in (alignment.align_static, alignment.align_sequential, alignment.scored_candidates):
        assert plan(f(truth, model, "head", "second")).count("Exchange") == 1


def test_few_pairs_are_compared(monkeypatch):
    """A row with an equal partner compares no second keys, one with a changed headword none but what may be better."""
    compared = []
    second = M.token_set_ratios
    monkeypatch.setitem(M.MANY, M.plain_token_set_ratio, lambda a, b: compared.extend(zip(a, b, strict=True)) or second(a, b))
    rng = random.Random(4)
    texts = [("abcdefghijkl"[i % 12] * 2 + "öäüõ"[i % 4] * 2, " ".join(words(rng, "aeioukstlnr", 2) for _ in range(20)) + str(i)) for i in range(60)]
    table = [(1, 0, side, i, k if side or i % 9 else k + "x", s, "") for side in (0, 1) for i, (k, s) in enumerate(texts)]
    table = pa.Table.from_arrays([pa.array(c) for c in zip(*table, strict=True)], names=alignment.ROW.split(", "))
    scores = alignment._Scores(table, M.plain_ratio, M.plain_token_set_ratio, M.plain_partial_ratio)
    gi, mi = (pa.array([p[side] for p in ((i, 60 + j) for i in range(60) for j in range(60) if abs(i - j) <= 10)]).to_numpy() for side in (0, 1))
    at, score, kind = alignment._first(gi, mi, abs(gi + 60 - mi), pa.array(range(120)).to_numpy(), gi, scores.run(gi, mi, abs(gi + 60 - mi), gi))
    assert (mi[at] - gi[at] == 60).all() and len(at) == 60
    assert sum(a != b for a, b in compared) < 20


def test_errors_are_those_of_the_texts(spark):
    truth, model = editions(spark, 2)
    best = alignment.align_static(truth, model, "head", "second", "synonyms", errors=True)
    for by in ("model", "truth"):
        got = alignment.page_field_errors(truth, model, best, {"head": "key", "second": "second"}, by)
        assert rows(got.fillna(-1)) == rows(alignment.page_field_metrics(truth, model, best, ["head", "second"], by).fillna(-1))
    text = plan(got)
    assert "levenshtein" not in text and "Python" not in text


def test_positions_need_no_window_over_pages(spark):
    made = spark.range(0, 1000, 1, 7).selectExpr("id % 500 as page", "if(id < 500, 'a', 'b') as field", "if(id % 3 = 0, double('nan'), id / 100) as cer")
    got = alignment.chart_series(made)
    assert sorted((r.field, r.page, r.pos, r.tick) for r in got.collect()) == [(f, p, p, str(p) if p % 10 == 0 else "") for f in "ab" for p in range(500)]
    assert max(r.value for r in got.filter("not isnan(value)").collect()) == 2.0
    assert "cer" not in "".join(x for x in plan(got).splitlines() if "Window" in x)


def test_lines_of_a_repeated_id(spark, tmp_path):
    """Numbers of lines without a window; texts of one id are numbered together, as in SQL."""
    spark.createDataFrame([(1, "üks kaks\n\n— \nkolm neli"), (2, None), (3, "viis")], "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    truth = plans._truth(Tables(spark, f"{tmp_path}/a"))
    assert rows(truth) == [(1, 0, "ks", "kaks"), (1, 1, "kolm", "neli"), (3, 0, "viis", "")]
    assert "Window" not in plan(truth) and "Window" not in plan(plans._of_truth(truth))
    spark.createDataFrame([(1, "üks kaks\nkolm neli")] * 2, "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert [r.seq for r in plans._truth(Tables(spark, f"{tmp_path}/b")).orderBy("seq").collect()] == [0, 1, 2, 3]
