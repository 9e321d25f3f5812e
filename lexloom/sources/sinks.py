"""Sinks: concordance files, delimited dialects, latest row of each key."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexloom.sources.concordance_files import ConcordanceFiles

#: Writer options of the dialects in use.
DIALECTS = {
    "semicolon_quoted": {"sep": ";", "quoteAll": True},
    "tab": {"sep": "\t"},
    "comma": {"sep": ",", "quoteAll": False},
}


def write_delimited(df: DataFrame, path: str, dialect: str = "semicolon_quoted", mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(header=True, escape='"', **DIALECTS[dialect]).csv(path)


def write_concordances(hits: DataFrame, folder: str, word: str = "word") -> None:
    """JSON, CSV and text of the hits, a folder for each keyword; text has the full context alone.

    The hits are computed once; the files of all three forms appear together when all tasks are done, beside those of
    earlier runs, and none if the run fails. The folder has to be one that all executors share.
    """
    spark = hits.sparkSession
    if "://" not in folder and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("the folder has to be named with the file system that driver and executors share")
    spark.dataSource.register(ConcordanceFiles)
    path = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    hits.sortWithinPartitions(word).write.format("concordance_files").option("path", path).option("word", word).mode("append").save()


def stream_concordances(hits: DataFrame, folder: str, checkpoint: str, word: str = "word") -> StreamingQuery:
    """The same of a stream: each batch adds its files once, also if it is repeated. The folder is named with its file system."""
    hits.sparkSession.dataSource.register(ConcordanceFiles)
    return hits.writeStream.format("concordance_files").option("path", folder).option("word", word).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert_latest(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows, of each key the latest."""
    return latest(old.unionByName(new), key, order)
