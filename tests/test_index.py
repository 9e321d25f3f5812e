"""The positional index against token rows and the direct concordance."""

import pytest
from pyspark.sql import functions as F

from lexloom.operators import corpus, index

TEXTS = ["Tere maailm. Maailm on suur! Tere, tere.\nUus rida, TERE", "maailm", "", "  \n", None, "Tere. " * 300, "ei midagi", "tere maailm"]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)] + [(None, "tere võti puudub", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"word": F.lit("x"), "run": F.lit("y"), "n": F.lit(1)})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_index(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/index"
    index.extend(docs.filter("doc_id < 3"), folder, keep=["source"])
    index.extend(docs, folder, keep=["source"])
    index.extend(docs, folder, keep=["source"])  # adds nothing
    known = docs.filter("doc_id is not null")
    got = rows(index.postings(spark, folder).select("doc_id", "source", "pos", "at", "token", "lc"))
    assert got == rows(corpus.token_rows(known, ["doc_id", "source"]).select("doc_id", "source", "pos", "at", "token", "lc"))
    keywords = spark.createDataFrame([("Tere",), ("maailm",), ("puudub",), (None,), ("tere",)], "word string")
    direct = corpus.concordance(known, keywords)
    found = index.hits(spark, folder, keywords)
    columns = direct.columns
    assert rows(index.concordance(known, found).select(columns)) == rows(direct)
    counted = {(r.lc, r.source): r.n for r in index.counts(spark, folder, ["source"]).collect()}
    assert counted == {(r.lc, r.source): r.n for r in corpus.token_counts(known, ["source"]).collect()}
    assert {r.doc_id: r.tokens for r in spark.read.parquet(f"{folder}/documents").collect()} == {0: 10, 1: 1, 2: 0, 3: 0, 5: 300, 6: 2, 7: 2}


def test_postings_of_a_run_that_failed(spark, docs, tmp_path, monkeypatch):
    """What a run wrote before it failed isn't read, and the next run writes it."""
    folder = f"file://{tmp_path}/index"
    index.extend(docs.filter("doc_id = 0"), folder)
    real, calls = type(docs.write).parquet, []

    def failing(self, path, **more):
        if path.endswith("/documents"):
            calls.append(path)
            raise OSError("no space")
        return real(self, path, **more)

    monkeypatch.setattr(type(docs.write), "parquet", failing)
    with pytest.raises(OSError):
        index.extend(docs, folder)
    monkeypatch.undo()
    assert calls and index.postings(spark, folder).select("doc_id").distinct().count() == 1
    index.extend(docs, folder)
    assert index.postings(spark, folder).count() == corpus.token_rows(docs.filter("doc_id is not null"), ["doc_id"]).count()


def test_many_keywords(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    index.extend(docs, folder)
    keywords = spark.createDataFrame([("tere",), ("maailm",)], "word string")
    few = rows(index.hits(spark, folder, keywords))
    monkeypatch.setattr(index, "NAMED", 1)
    assert rows(index.hits(spark, folder, keywords)) == few and few
