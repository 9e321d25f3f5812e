"""Three forms from one pass, committed together; a failed run leaves nothing; a repeated batch adds nothing."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from lexloom.sources import concordance_files, sinks

HITS = [("a/b", 1, "x a/b y"), ("c=d", 2, 'c "q", d'), ("õ?", 3, None), (None, 4, "none"), ("a/b", 5, ""), ("#%", 6, "rida")]


def frame(spark):
    return spark.createDataFrame(HITS, "word string, n long, full_context string").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_forms(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def count(n):
        counted.add(1)
        return n

    sinks.write_concordances(frame(spark).withColumn("n", count("n")), str(tmp_path / "out"))
    assert counted.value == len(HITS)  # the hits are computed once
    want = sorted((w, n, c) for w, n, c in HITS if w)
    assert sorted((r.word, r.n, r.full_context) for r in spark.read.json(f"{tmp_path}/out/json").collect() if r.word) == want
    folders = {r.keyword_folder for r in spark.read.json(f"{tmp_path}/out/json").collect()}
    assert folders == {"a_b", "c=d", "õ?", None, "#%"}
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out/text").collect()) == sorted(c or "" for *_, c in HITS)
    lines = [x for f in (tmp_path / "out/csv").rglob("*.csv") for x in csv.DictReader(f.open(encoding="utf-8"))]
    assert sorted((x["word"], x["n"], x["full_context"]) for x in lines) == sorted((w or "", str(n), c or "") for w, n, c in HITS)
    assert not (tmp_path / "out/_temporary").exists()
    sinks.write_concordances(frame(spark), str(tmp_path / "out"))
    assert spark.read.json(f"{tmp_path}/out/json").count() == 2 * len(HITS)
    sinks.write_concordances(frame(spark).limit(0), str(tmp_path / "none"))


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    broken = frame(spark).withColumn("full_context", F.when(F.col("n") == 4, F.raise_error(F.lit("broken"))).otherwise(F.col("full_context")))
    with pytest.raises(Exception, match="broken"):
        sinks.write_concordances(broken, str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*") if f.is_file()]


def test_stream(spark, tmp_path):
    for part in range(2):
        spark.createDataFrame(HITS[part::2], "word string, n long, full_context string").write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("word string, n long, full_context string").json(str(tmp_path / "in"))
        sinks.stream_concordances(stream, f"file://{tmp_path}/out", str(tmp_path / "checkpoint")).awaitTermination()
    got = [json.loads(x) for f in (tmp_path / "out/json").rglob("*.json") for x in f.read_text().splitlines()]
    assert sorted(x["n"] for x in got) == [1, 2, 3, 4, 5, 6]


def test_a_repeated_batch_replaces_its_files(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import StructType

    source = concordance_files.ConcordanceFiles({"path": f"file://{tmp_path}/out"})
    schema = StructType().add("word", "string").add("full_context", "string")
    for text in ("first", "second"):
        writer = source.streamWriter(schema, False)
        writer.commit([writer.write(iter([pa.record_batch({"word": ["w"], "full_context": [text]})])), None], 7)
    assert [f.read_text() for f in (tmp_path / "out/text").rglob("*.txt")] == ["second\n"]
    writer = source.streamWriter(schema, False)
    writer.write(iter([pa.record_batch({"word": ["w"], "full_context": ["lost"]})]))
    writer.abort([], 8)
    assert [f.name for f in (tmp_path / "out").iterdir()] and not (tmp_path / "out/_temporary").exists()
