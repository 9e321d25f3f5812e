"""The latest row of each key from keyed state: restarts, late rows, forgotten keys; and a log that is cleaned."""

import datetime as dt

from pyspark.sql import functions as F

from lexloom.streaming import replies as streams

SCHEMA = "page long, ts timestamp, n long, note string"
T0 = dt.datetime(2024, 5, 1)


def rows(df):
    return sorted((r.page, r.n) for r in df.collect())


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def step(spark, tmp_path, new, **more):
    spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    changed = streams.changed_pages(stream, ["page"], ["ts", "n"], "ts", **more)
    streams.upsert_pages(changed, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["page"], ["ts", "n"], changes=True).awaitTermination()
    return rows(streams.latest_pages(spark, str(tmp_path / "out"), changed.schema, ["page"], ["ts", "n"]))


def test_latest_by_state(spark, tmp_path):
    assert step(spark, tmp_path, [(1, at(0), 1, "x"), (1, at(5), 2, None), (2, at(1), 3, "y"), (2, at(1), 4, "y")]) == [(1, 2), (2, 4)]
    assert step(spark, tmp_path, [(1, at(3), 5, "older"), (3, at(2), 2**60 + 1, None), (3, at(2), None, None), (2, at(9), 7, "z")]) == [(1, 2), (2, 7), (3, 2**60 + 1)]  # from its checkpoint
    assert step(spark, tmp_path, [(4, at(1000), 8, "far")]) == [(1, 2), (2, 7), (3, 2**60 + 1), (4, 8)]
    assert step(spark, tmp_path, [(5, at(1), 9, "too late"), (4, at(1001), 10, "w")]) == [(1, 2), (2, 7), (3, 2**60 + 1), (4, 10)]


def test_a_forgotten_key_comes_back_later(spark, tmp_path):
    keep = {"keep": 60_000, "late": "1 minute"}
    step(spark, tmp_path, [(1, at(0), 1, "x")], **keep)
    step(spark, tmp_path, [(2, at(60), 2, "x")], **keep)
    step(spark, tmp_path, [(2, at(120), 3, "x")], **keep)
    assert step(spark, tmp_path, [(1, at(130), 4, "again")], **keep) == [(1, 4), (2, 3)]


def test_log_is_cleaned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "COMPACT", 2)
    for i in range(9):
        spark.createDataFrame([(i % 3, at(i), i, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        streams.upsert_pages(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["page"], ["ts"]).awaitTermination()
    assert rows(streams.latest_pages(spark, str(tmp_path / "out"), stream.schema, ["page"], ["ts"])) == [(0, 6), (1, 7), (2, 8)]
    kept = {kind: sorted(int(f.name[2:]) for f in (tmp_path / "out" / kind).iterdir() if f.name.startswith("v=")) for kind in ("log", "base")}
    assert max(kept["log"]) == 8 and len(kept["log"]) <= 6 and len(kept["base"]) <= 4
