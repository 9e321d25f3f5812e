"""Quality classifier: ridge regression on random Fourier features, isotonic calibration.

A document is described by statistics of its whole text (sizes, shares of character classes, repetition
of words and word pairs). Random Fourier features approximate a Gaussian kernel over the standardised
statistics. Every partition of labelled rows adds its part of the normal equations, which are summed by
row of the matrix, so the driver solves one system of FEATURES + 1 unknowns whatever the size of the
corpus. Raw scores of rows kept apart are counted in BINS bins and made monotone by pool-adjacent-violators.

Null or empty text has zero statistics and is scored like any other. A null doc_id is scored, and held
out like the text "null". Repeated rows are scored each; labels that contradict each other both count.
Without labels every score is one half. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import freed, kept_rows, slices, stored, words

FEATURES, BINS, RIDGE, SEED = 256, 400, 1e-3, 11
LOW, HIGH = -0.5, 1.5

#: Character classes, by byte; bytes over 0x7F are one class.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"|", b"#$%&*", b"\"'()[]{}<>", b"-_/\\@=+:;?~^`")
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i
_CLASS[128:] = len(CLASSES) + 1
KINDS = len(CLASSES) + 2
STATISTICS = KINDS + 7


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text."""
    n = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(n), size)
    share = np.bincount(row * KINDS + _CLASS[data], minlength=n * KINDS).reshape(n, KINDS) / np.maximum(size, 1)[:, None]
    hashed, word_at, starts, ends = words(data, at)
    count = np.diff(word_at)
    width = np.concatenate(([0], np.cumsum(ends - starts)))
    distinct, pairs, most = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        w = hashed[word_at[i] : word_at[i + 1]]
        if len(w):
            _, times = np.unique(w, return_counts=True)
            distinct[i], most[i] = len(times) / len(w), times.max() / len(w)
            pairs[i] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / max(len(w) - 1, 1) if len(w) > 1 else 1.0
    more = [np.log1p(size), np.log1p(count), (width[word_at[1:]] - width[word_at[:-1]]) / np.maximum(count, 1), distinct, pairs, most, distinct * np.log1p(count)]
    return np.column_stack((np.sqrt(share), *more))


def _vectors(column: pa.Array) -> np.ndarray:
    return np.concatenate([statistics(d, a) for _, _, d, a in slices(column)]) if len(column) else np.zeros((0, STATISTICS))


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STATISTICS), pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, x array<double>")


class Model:
    """Scaling, the random projection (from SEED), ridge weights and the calibration steps: half a megabyte at most."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.project = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES))
        self.shift = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([LOW, HIGH]), np.array([0.5, 0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack((np.sqrt(2 / FEATURES) * np.cos(z @ self.project + self.shift), np.ones(len(x))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, LOW, HIGH)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _summed(rows: DataFrame, part) -> dict[int, np.ndarray]:
    """Sums over partitions of part(x, y): {key: vector}; each partition sends one vector a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = part(_stack(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], names=["key", "v"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.sum([np.frombuffer(b) for b in rows["v"]], 0)
        return pd.DataFrame({"key": rows["key"].iloc[:1], "v": [v.tobytes()]})

    got = rows.select("x", "y").mapInArrow(run, "key long, v binary").groupBy("key").applyInPandas(add, "key long, v binary").collect()
    return {r["key"]: np.frombuffer(r["v"]) for r in got}


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values, by pooling neighbours that are out of order."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        pools.append([float(v), float(w), 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def train(stats: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """stats: from described(); labels: doc_id, quality; usable: condition on doc_id for labels that may be learnt."""
    learnt = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(usable)
    rows = stored(stats.join(learnt, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("apart")), "labelled")
    moments = _summed(rows, lambda x, y: np.stack((x.sum(0), (x * x).sum(0), np.full(STATISTICS, len(x)))))
    if not moments:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    n = moments[2][0]
    mean = moments[0] / n
    model = Model(mean, np.sqrt(np.maximum(moments[1] / n - mean**2, 0)) + 1e-3)
    fit, apart = rows.filter("not apart"), rows.filter("apart")
    sides = {(r["apart"], r["y"]) for r in rows.select("apart", "y").distinct().collect()}
    if len(sides) < 4:  # too few labels to keep some apart
        fit = apart = rows

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.column_stack((f.T @ f, f.T @ y))

    got = _summed(fit, equations)
    a = np.stack([got[i] for i in range(FEATURES + 1)])
    count = a[-1, FEATURES]
    model.weights = np.linalg.solve(a[:, :-1] + RIDGE * count / FEATURES * np.eye(FEATURES + 1), a[:, -1])

    def counted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum(((model.raw(x) - LOW) / (HIGH - LOW) * BINS).astype(int), BINS - 1)
        return np.stack((np.bincount(at, minlength=BINS), np.bincount(at, y, BINS))).astype(float)

    seen = _summed(apart, counted)
    full = seen[0] > 0
    good = isotonic((seen[1][full] + 0.5 * 1e-3) / (seen[0][full] + 1e-3), seen[0][full])
    model.knots, model.values = (LOW + (np.flatnonzero(full) + 0.5) * (HIGH - LOW) / BINS), np.clip(good, 0.001, 0.999)
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(_stack(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double, predicted int")


def accept(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents at or over the threshold, with all their columns."""
    return kept_rows(docs, lambda text: model.scores(_vectors(text)) >= threshold)
