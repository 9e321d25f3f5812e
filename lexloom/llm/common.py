"""Shared helpers: scratch storage, vectorised word hashing, connected components.

Word rule used everywhere: lower-case A-Z, words are runs of bytes outside 0x20 and 0x09-0x0D. UTF-8
continuation bytes are all above 0x7F, so the rule can be applied to bytes.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Text handled at once by the vectorised code; one longer document is handled alone.
SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
_BATCH, _OWN_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Ids are broadcast up to this many (8 MB).
BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder in spark.checkpoint.dir; where unset, a temporary folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lexloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexloom/{name}-{uuid.uuid4().hex}"


def with_scheme(spark: SparkSession, folder: str) -> str:
    """A folder with its file system; one without is local, which only a local master may use."""
    if "://" in folder:
        return folder
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError(f"{folder} doesn't name the file system that driver and executors share")
    return "file://" + os.path.abspath(folder.removeprefix("file:"))


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write to shared storage and read back, with the folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def discard(spark: SparkSession, *folders: str) -> None:
    """Delete stored tables that nothing reads any more, in whatever file system they are."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def batches_by_bytes(spark: SparkSession) -> None:
    """Rows cross to Python in batches of at most BATCH_BYTES, unless the session says otherwise: texts differ too much in length to count rows."""
    if spark.conf.get(_BATCH, None) == _OWN_BATCH:
        spark.conf.set(_BATCH, BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def freed(run):
    """A function over batches that gives its memory back at its task's end: the Python worker goes on to other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, on uint64 arrays."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1), U(base), dtype=np.uint64)
        full[0] = 1
        have = np.cumprod(full, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most `most` bytes, or of one longer row."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words; a row's end also ends a word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = at[:-1][at[:-1] < len(data)]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = True, space
    before[edge] = True
    starts = np.flatnonzero(before[:-1] & ~space)
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = space, True
    after[edge] = True
    return starts, np.flatnonzero(after[1:] & ~space) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span (ascending starts); memory is bounded by blocks of about SLICE_BYTES."""
    table, out, i = _FOLDED if fold else _BYTE, np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE_BYTES)))
        low, high = int(starts[i]), int(ends[i:j].max())
        total = np.empty(high - low + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data[low:high]] * _power(_BASE, high - low), out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * _power(_BASE_INV, high - low)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(data: np.ndarray, at: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word (case folded or not), words before each row (n + 1), and the words' first and end bytes."""
    starts, ends = word_spans(data, at)
    return span_hashes(data, starts, ends, fold), np.searchsorted(starts, at), starts, ends


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link.

    Alternating large-star and small-star steps; each is a minimum per node joined back. The minima are
    written to shared storage like every round, so both sides of a join are plain scans, of which Spark's
    skew join splits the links of a hub over tasks. It ends when no node has a link up and another one besides.
    """

    spark = links.sparkSession

    edges, path = stored_at(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    while True:
        seen = Observation()
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("up"))
        least, first = stored_at(near.observe(seen, F.count_if(F.expr("up > 0 and n > 1")).alias("n")).select("u", "m"), "least")
        if not seen.get["n"]:
            discard(spark, path)  # links are stars now, and the minima the roots
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least, second = stored_at(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        used = path, first, second
        edges, path = stored_at(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        discard(spark, *used)


def kept_rows(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """The rows whose text `keep` (string array -> boolean array) accepts, with all their columns, in one pass."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at)), pa.bool_()))

    return docs.mapInArrow(freed(run), docs.schema)


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[dict[str, list], list[tuple[int, int]]]]:
    """Columns and (first, end) of the whole groups in rows that are sorted by `key`; a group may span batches.

    Groups come many at a time, so tiny groups cost little more than their rows.
    """
    held: pa.Table | None = None

    def give(table: pa.Table):
        columns = {n: table.column(n).to_pylist() for n in table.column_names}
        marks = list(zip(*(columns[k] for k in key), strict=True))
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        return columns, list(zip(cuts[:-1], cuts[1:], strict=True))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = {k: table.column(k)[-1].as_py() for k in key}
        n = table.num_rows
        while n and all(table.column(k)[n - 1].as_py() == v for k, v in last.items()):
            n -= 1
        held = table.slice(n)
        if n:
            yield give(table.slice(0, n))
    if held is not None:
        yield give(held)
