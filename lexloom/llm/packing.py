"""Sequence packing by cutting-stock column generation.

A document's ids are cut into full sequences, one head whose length is a multiple of `unit`, and a tail
shorter than `unit`. Heads and tails are two cutting-stock problems over at most capacity / unit and
unit - 1 lengths, whatever the corpus size: only their length histogram reaches the driver. The linear
program's columns are priced by a knapsack dynamic program; its solution is rounded down, what is left
is packed first-fit decreasing by length, and ranked pieces take the slots of the rounded patterns.

Null text is empty (a document of the end id alone); a null doc_id is packed like any other; repeated
rows are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import freed, partitions, slices, span_hashes, stored, word_spans, words

CAPACITY, UNIT, END_ID = 4096, 32, 2
#: Words that a Python worker keeps the ids of, before it starts anew.
CACHE_WORDS = 400_000
#: Text tokenized at once: arrays over its bytes and ids take many times as much of a worker's memory.
TEXT_BYTES = 1 << 18

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, units before each row, first and end bytes of the units that are tokenized apart.

    The tokenizer folds case and never joins a letter with signs after it, so a word's last signs are a
    unit of their own if an ASCII or a Latin-1 letter stands before them: far fewer distinct units than
    words. A text that may hold a special token's string is left in words as they are.
    """
    if b"<|" in data.tobytes():
        return words(data, at, fold=False)
    starts, ends = word_spans(data, at)
    sign = _PUNCT[data]
    last = np.maximum.accumulate(np.where(sign, np.int32(-1), np.arange(len(data), dtype=np.int32))) if len(data) else starts
    core = last[ends - 1].astype(np.int64) + 1
    before = np.maximum(core - 1, 0)
    letter = ((data[before] | 32) >= 97) & ((data[before] | 32) <= 122)
    letter |= (data[np.maximum(core - 2, 0)] == 0xC3) & (data[before] >= 0x80) & (data[before] != 0x97) & (data[before] != 0xB7)
    split = (core > starts) & (core < ends) & letter
    word_at = np.searchsorted(starts, at)
    more = np.concatenate(([0], np.cumsum(split)))
    place = np.arange(len(starts)) + more[:-1]
    first, end = np.empty(len(starts) + more[-1], np.int64), np.empty(len(starts) + more[-1], np.int64)
    first[place], end[place] = starts, np.where(split, core, ends)
    first[place[split] + 1], end[place[split] + 1] = core[split], ends[split]
    return span_hashes(data, first, end), word_at + more[word_at], first, end


class WordIds:
    """Ids of space-delimited words: the tokenizer drops white space, so a text's ids are its words' ids in turn."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, texts: list[str]) -> None:
        """Takes the ids of new units into the pool, at the next places."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))
        k = self.size
        while k + len(got) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[k : k + len(got)] = self.used + np.cumsum(count) - count
        self.count[k : k + len(got)] = count
        self.used, self.size = self.used + len(flat), k + len(got)

    def ids(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of a slice of texts, without an end id."""
        hashed, word_at, starts, ends = _units(data, at)
        known, place, back = np.unique(hashed, return_index=True, return_inverse=True)
        if self.size + len(known) > CACHE_WORDS and self.size:
            self.clear()
        spot = np.searchsorted(self.keys, known)
        new = np.ones(len(known), bool)
        inside = spot < len(self.keys)
        new[inside] = self.keys[spot[inside]] != known[inside]
        fresh, raw, first = np.flatnonzero(new), data.tobytes(), self.size
        for i in range(0, len(fresh), 4096):
            self._add([raw[a:b].decode() for a, b in zip(starts[place[fresh[i : i + 4096]]].tolist(), ends[place[fresh[i : i + 4096]]].tolist(), strict=True)])
        self.keys = np.insert(self.keys, spot[fresh], known[fresh])
        self.entry = np.insert(self.entry, spot[fresh], first + np.arange(len(fresh)))
        entry = self.entry[np.searchsorted(self.keys, known)][back]
        count = self.count[entry]
        total = np.concatenate(([0], np.cumsum(count)))
        flat = self.pool[np.repeat(self.first[entry] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[word_at]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_cached: dict[str, WordIds] = {}


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences, a head of whole units, a tail."""
    full, rest = n // capacity * capacity, n % capacity
    head = rest // unit * unit
    out = [(s, capacity) for s in range(0, full, capacity)]
    return out + [x for x in ((full, head), (full + head, rest - head)) if x[1]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut them: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _cached:
            _cached[tokenizer] = WordIds(tokenizer)
        encoder = _cached[tokenizer]
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, last, data, at in slices(batch.column(1), TEXT_BYTES):
                rows = []
                for doc_id, ids in zip(doc_ids[first:last], encoder.ids(data, at), strict=True):
                    ids = np.concatenate((ids, end)).astype("<u4")
                    rows += [(doc_id, s, n, len(ids), ids[s : s + n].tobytes()) for s, n in cuts(len(ids), capacity, unit)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        encoder.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(freed(run), PIECES)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of sizes within capacity, by dynamic programming over capacities."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = np.searchsorted(sizes, c, "right")
        if fits:
            got = best[c - sizes[:fits]] + worth[:fits]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], item[c] = got[k], k
    take, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if item[c] < 0:
            c -= 1
        else:
            take[item[c]] += 1
            c -= int(sizes[item[c]])
    return float(best[capacity]), take


def generate_columns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): column generation for the linear program, rounded; covers the demand exactly.

    sizes: ascending, each with demand over 0. Time depends on the number of sizes alone. Should `rounds` columns
    not reach the optimum, the basis so far is rounded: the demand is covered all the same, with more padding.
    """
    m = len(sizes)
    if not m:
        return []
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        x, price = np.linalg.solve(basis, demand.astype(float)), np.linalg.solve(basis.T, np.ones(m))
        value, column = knapsack(sizes, np.maximum(price, 0), capacity)
        if value <= 1 + 1e-9:
            break
        way = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, demand.astype(float))
    left, plan = demand.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        pattern = np.rint(basis[:, j]).astype(np.int64)
        used = pattern > 0
        times = min(int(np.floor(max(x[j], 0) + 1e-9)), int((left[used] // pattern[used]).min()))
        if times:
            plan.append((pattern, times))
            left -= pattern * times
    while left.any():  # first-fit decreasing, a whole run of equal sequences at a time
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def slot_table(demand: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, per sequence, first sequence, offset): where the ranked pieces of a length go."""
    rows: list[tuple[int, int, int, int, int, int]] = []
    rank: dict[int, int] = dict.fromkeys(demand, 0)
    sequence = 0

    def place(sizes: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> None:
        nonlocal sequence
        for pattern, times in plan:
            offset = 0
            for i in np.flatnonzero(pattern)[::-1]:
                size, each = int(sizes[i]), int(pattern[i])
                rows.append((size, rank[size], rank[size] + each * times, each, sequence, offset))
                rank[size] += each * times
                offset += each * size
            sequence += times

    for sizes in ([capacity], [n for n in demand if unit <= n < capacity], [n for n in demand if n < unit]):
        sizes = np.array(sorted(n for n in sizes if demand.get(n)), np.int64)
        scale = unit if len(sizes) and sizes[0] >= unit and sizes[-1] < capacity else 1
        need = np.array([demand[int(n)] for n in sizes], np.int64)
        place(sizes, [(np.ones(1, np.int64), int(need[0]))] if list(sizes) == [capacity] else generate_columns(sizes // scale, need, capacity // scale))
    return rows


def ranked(cut: DataFrame, order: list[str]) -> DataFrame:
    """A rank from 0 within each length, without a task that holds all pieces of a length.

    Pieces are numbered within (length, bucket) and the buckets' counts give each bucket's first rank.
    """
    buckets = 4 * partitions(cut.sparkSession)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("first"))
    local = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    return local.join(first, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def place(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Adds sequence_id and offset to the pieces of a stored table (length, doc_id, start and any other columns)."""
    spark = cut.sparkSession
    demand = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity / unit + unit rows
    slots = spark.createDataFrame(slot_table(demand, capacity, unit), "length long, lo long, hi long, each long, first_sequence long, block long")
    # slots has a few rows for each of at most capacity / unit + unit lengths, at any corpus size
    at = ranked(cut, ["doc_id", "start"]).join(F.broadcast(slots), "length").filter("rank >= lo and rank < hi")
    at = at.withColumn("sequence_id", F.expr("first_sequence + (rank - lo) div each")).withColumn("offset", F.expr("block + ((rank - lo) % each) * length"))
    return at.drop("rank", "lo", "hi", "each", "first_sequence", "block")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, n): the packed sequences themselves; placed has ids. At most `capacity` pieces meet in one row."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n"))
    return parts.select("sequence_id", F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), "n")


def pack(docs: DataFrame, tokenizer: str, keep_ids: bool = True, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Placed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if kept."""
    cut = pieces(docs, tokenizer, capacity, unit).withColumn("ids_crc32", F.crc32("ids"))
    return place(stored(cut if keep_ids else cut.drop("ids"), "pieces"), capacity, unit)
