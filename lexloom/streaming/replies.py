"""Replies and page documents as streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from lexloom.operators import replies
from lexloom.sources.sinks import latest


def parsed_replies(stream: DataFrame, key: str, ts: str, reply: str, mode: str = "split", late: str = "1 hour") -> DataFrame:
    """Verdict rows of a reply stream, each key once within the time that events may be late."""
    once = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return replies.verdict(once, reply, mode).select(key, ts, "category", "reason")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only Parquet sink; takes all that has arrived and can be started again from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: How times stand in a row's text.
_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


class Latest(StatefulProcessor):
    """Keeps the latest row of a key, gives it whenever it changes, and forgets a key `keep` milliseconds after its time.

    A row is a text of all its values, since integers beside nulls would come as floats; what it is ordered by stands
    beside it without nulls: pairs of whether there is a value, and the value.
    """

    def __init__(self, orders: int, keep: int):
        self.orders, self.keep = orders, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, handle.getValueState("latest", "row binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = best = pickle.loads(self.row.get()[0]) if self.row.exists() else None
        for batch in rows:
            for rank, row in zip(zip(*(batch[f"{kind}{i}"] for i in range(self.orders) for kind in ("has", "by")), strict=True), batch["row"], strict=True):
                if best is None or rank > best[0]:
                    best = (rank, row)
        if best != held:
            self.row.update((pickle.dumps(best),))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[0][0]:
                self.handle.registerTimer(int(best[0][1].timestamp() * 1000) + self.keep)
            yield pd.DataFrame({"row": [best[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        yield pd.DataFrame({"row": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def changed_pages(stream: DataFrame, key: list[str], order: list[str], ts: str, late: str = "1 hour", keep: int = 86_400_000) -> DataFrame:
    """The latest row of each key whenever it changes, in update mode: a keyed state with timers.

    Rows that are later than `late` are dropped. `order` starts with ts, so that a key that was forgotten after `keep`
    milliseconds of event time can only come back with a later row: state stays as large as the keys of that time.
    """
    if order[0] != ts:
        raise ValueError("the order has to start with the event time")
    spark = stream.sparkSession
    spark.conf.set(_PROVIDER, _ROCKS)  # the only store for such states
    row = F.to_json(F.struct(*stream.columns), _TEXT | {"ignoreNullFields": "false"}).alias("row")
    none = lambda c: F.lit("1970-01-01" if stream.schema[c].dataType.typeName() == "date" else 0).cast(stream.schema[c].dataType)
    ranked = [x for i, c in enumerate(order) for x in (F.col(c).isNotNull().alias(f"has{i}"), F.coalesce(c, none(c)).alias(f"by{i}"))]
    rows = stream.withWatermark(ts, late).select(*dict.fromkeys([*key, ts]), *ranked, row)
    changed = rows.groupBy(*key).transformWithStateInPandas(Latest(len(order), keep), "row string", "Update", "EventTime")
    return changed.select(F.from_json("row", stream.schema, _TEXT).alias("row")).select("row.*")


#: Batches after which the latest rows so far are written as a new base.
COMPACT = 20


def _drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders, in any file system that Spark knows."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert_pages(stream: DataFrame, folder: str, checkpoint: str, key: list[str], order: list[str], changes: bool = False) -> StreamingQuery:
    """Latest row of each key as a log: a batch writes its own latest rows, so its work grows with the batch.

    Every COMPACT batches the log so far becomes a base; then what lies before the base before it is deleted, so files
    stay bounded by the keys and two rounds of batches, and readers have a round's time. A repeated batch writes its own
    folders anew, so a restart changes nothing. latest_pages reads the result, also of a stream without any row.
    changes: the stream gives changed rows, as changed_pages does.
    """
    newest = [F.desc(o) for o in order]
    none = stream.sparkSession.createDataFrame([], stream.schema)
    for kind in ("log", "base"):
        none.write.mode("overwrite").parquet(f"{folder}/{kind}/v=-1")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch, key, newest).write.mode("overwrite").parquet(f"{folder}/log/v={number}")
        if number % COMPACT == COMPACT - 1:
            latest_pages(spark, folder, batch.schema, key, order, number).write.mode("overwrite").parquet(f"{folder}/base/v={number}")
            before = number - COMPACT
            _drop(spark, [*(f"{folder}/log/v={v}" for v in range(max(0, before - COMPACT + 1), before + 1)), f"{folder}/base/v={before - COMPACT}"] if before >= 0 else [])

    writer = stream.writeStream.outputMode("update") if changes else stream.writeStream
    return writer.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_pages(spark: SparkSession, folder: str, schema: StructType, key: list[str], order: list[str], upto: int = 2**31 - 1) -> DataFrame:
    """The latest row of each key after batch `upto`: the last base before it and the log since."""
    table = lambda kind: spark.read.schema(StructType([*schema.fields, StructField("v", IntegerType())])).parquet(f"{folder}/{kind}")
    base = table("base").filter(F.col("v") < upto)
    last = max([v for v in (int(f.rstrip("/").split("/v=")[-1].split("/")[0]) for f in base.inputFiles()) if v < upto], default=-1)  # one folder for each COMPACT batches
    rows = base.filter(F.col("v") == last).unionByName(table("log").filter((F.col("v") > last) & (F.col("v") <= upto)))
    return latest(rows.drop("v"), key, [F.desc(o) for o in order])
