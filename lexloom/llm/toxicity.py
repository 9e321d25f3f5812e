"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

Training takes a bounded sample of labelled documents (SAMPLE_DOCS and SAMPLE_BYTES of each class at most, by
the hash of their id; of rows that repeat an id the smallest text), which trains two dictionaries: one on at most
ORDINARY_WINDOWS windows of ordinary text, spread over all of it, one on the words of toxic text that mark it, each word with its neighbours counted once, so that copies of a document don't make its words look
marked. The toxic compressor also holds the ordinary dictionary: text that both know costs both the
same, and a window's difference in compressed length is what the toxic words save. For calibration each
of FOLDS parts of the sample is measured with dictionaries of the others: the counts of windows that
save at least 1, 2, ... bytes are weighed by a ridge logistic regression into a score.

Documents are then scored one by one over all their windows of WINDOW words. Null or empty text has no
window and gets the score of a document in which no window saves anything. A null doc_id is scored, and
held out like the text "null". Repeated rows are scored each. With no toxic or no ordinary label in the
sample every score is that class's smoothed share. Other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import freed, give_back, kept_rows, slices, span_hashes, text_bytes, word_spans

#: Documents, and bytes of their texts, of each class that train; the first document is taken whatever its size.
SAMPLE_DOCS, SAMPLE_BYTES, FOLDS = 2000, 32 << 20, 4
WINDOW, LEVEL, STEPS = 12, 9, (1, 2, 3, 4, 5, 6, 8)
PREFIXES = (4, 5, 6, 8)
#: Most windows of seven words that train the ordinary dictionary.
ORDINARY_WINDOWS = 60_000
#: Evidence (twice the log likelihood ratio) for a marked word: about 2 * log(number of words compared).
EVIDENCE, TIMES = 30.0, 4.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PUNCT = b".,!?;:\"'()"


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % parts == part


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=14, hash_log=13, chain_log=13, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary)


def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(toxic + ordinary)


def _lengths(compressor: zstandard.ZstdCompressor, buffer: zstandard.BufferWithSegments) -> np.ndarray:
    out = compressor.multi_compress_to_buffer(buffer, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def savings(data: np.ndarray, at: np.ndarray, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the toxic dictionary saves in each window, and windows before each row (n + 1)."""
    starts, ends = word_spans(data, at)
    word_at = np.searchsorted(starts, at)
    count = np.diff(word_at)
    windows = -(-count // WINDOW)
    window_at = np.concatenate(([0], np.cumsum(windows)))
    if not window_at[-1]:
        return np.zeros(0, np.int64), window_at
    inner = np.arange(window_at[-1]) - np.repeat(window_at[:-1], windows)
    first = np.repeat(word_at[:-1], windows) + inner * WINDOW
    last = np.minimum(first + WINDOW, np.repeat(word_at[1:], windows)) - 1
    low, high = starts[first], ends[last]
    low = np.maximum(low - 1, np.repeat(at[:-1], windows))
    segments = np.stack((low, high - low), 1).astype("<u8")
    buffer = zstandard.BufferWithSegments(_LOWER[data].tobytes(), segments.tobytes())
    return _lengths(ordinary, buffer) - _lengths(toxic, buffer), window_at


def features(saved: np.ndarray, window_at: np.ndarray) -> np.ndarray:
    """For each row, for each step: log(1 + windows that save as much), and the share of windows."""
    n = np.maximum(np.diff(window_at), 1)
    columns = []
    for step in STEPS:
        total = np.concatenate(([0], np.cumsum(saved >= step)))[window_at]
        hits = np.diff(total)
        columns += [np.log1p(hits), hits / np.sqrt(n)]
    return np.stack(columns, 1)


def _marks(data: np.ndarray, at: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of toxic rows of which all prefixes are more frequent there, and one surely: starts, ends, whether, word before.

    Counts go by (prefix, word before).
    """
    starts, ends = word_spans(data, at)
    row = np.searchsorted(at, starts, "right") - 1
    is_toxic = toxic[row]
    before = np.concatenate(([np.uint64(0)], span_hashes(data, starts, ends)[:-1])) if len(starts) else np.zeros(0, np.uint64)
    marked, ordinary = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts >= k)
        if not len(long):
            continue
        gram = span_hashes(data, starts[long], starts[long] + k)
        pair = gram * np.uint64(0x9E3779B97F4A7C15) + before[long]
        _, one = np.unique(pair * np.uint64(2) + is_toxic[long].astype(np.uint64), return_index=True)
        kind, back = np.unique(gram[one], return_inverse=True)
        a, b = np.bincount(back, is_toxic[long][one]), np.bincount(back, ~is_toxic[long][one])
        n_a, n_b = max(a.sum(), 1), max(b.sum(), 1)
        share = (a + b) / (n_a + n_b)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(a > 0, a * np.log(a / (share * n_a)), 0) + np.where(b > 0, b * np.log(b / (share * n_b)), 0))
        often = a * n_b > TIMES * b * n_a
        place = np.searchsorted(kind, gram)
        marked[long] |= ((g >= EVIDENCE) & often)[place]
        ordinary[long] |= ~often[place]  # a longer prefix tells a marked word from an ordinary one with the same start
    return starts, ends, marked & ~ordinary & is_toxic, before


def train_dictionaries(texts: list[bytes], toxic: np.ndarray) -> tuple[bytes, bytes]:
    """Contents of the ordinary and of the toxic dictionary."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    starts, ends, marked, before = _marks(data, at, toxic)
    raw = data.tobytes()
    row = np.searchsorted(at, starts, "right") - 1
    last = np.searchsorted(starts, at[1:])[row] - 1
    plain = np.flatnonzero(~toxic[row])
    plain = plain[:: max(7, -(-len(plain) // ORDINARY_WINDOWS))]  # over all documents
    samples = [b" " + raw[starts[i] : ends[min(i + 6, last[i])]] for i in plain.tolist()]
    _, one = np.unique(span_hashes(data, starts, ends)[marked] ^ before[marked], return_index=True)
    where = np.flatnonzero(marked)[one]
    words = [b" " + raw[starts[i] : ends[i]].strip(_PUNCT) + b" " for i in where.tolist()]
    return _trained(samples, 8192), _trained(words, 4096)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples for the trainer, the distinct samples themselves, most frequent last."""
    kinds, counts = np.unique(np.array(samples, object), return_counts=True) if samples else ([], np.zeros(0))
    if len(kinds) * 8 < size // 16 or sum(map(len, kinds)) <= 2 * size:
        return b"".join(kinds[i] for i in np.argsort(counts, kind="stable"))[-size:]
    return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps on standardised columns; the intercept comes last and isn't penalised."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """What the tasks need: a few kilobytes."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.ordinary, self.toxic, self.mean, self.scale, self.weights = ordinary, toxic, mean, scale, weights

    def scores(self, column: pa.Array) -> np.ndarray:
        ordinary, toxic = _compressors(self.ordinary, self.toxic)
        out = []
        for _, _, data, at in slices(column):
            x = (features(*savings(data, at, ordinary, toxic)) - self.mean) / self.scale
            out.append(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, usable: Column, seed: int = 1) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic; usable: condition on doc_id for the rows whose label may be learnt."""
    picked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id is not null and toxic in (0, 1)").filter(usable).distinct()
    order = F.xxhash64("doc_id", F.lit(seed))
    sample = None
    for y in (0, 1):
        part = picked.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE_DOCS)
        sample = part if sample is None else sample.unionAll(part)
    share = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id")  # at most 2 * SAMPLE_DOCS ids
    size = found.groupBy("doc_id", "toxic").agg(F.coalesce(F.octet_length(F.min("text")), F.lit(0)).alias("size")).orderBy(order, "doc_id").collect()
    total, taken = {0: 0, 1: 0}, []
    for r in size:
        if not total[r.toxic] or total[r.toxic] + r["size"] <= SAMPLE_BYTES:
            total[r.toxic] += r["size"]
            taken.append((r.doc_id, r.toxic))
    taken = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    rows = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    y = rows.column("toxic").to_numpy().astype(bool)
    text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
    data, at = text_bytes(text)
    width = 2 * len(STEPS)
    if not y.any() or y.all():
        p = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
        return Model(b"", b"", np.zeros(width), np.ones(width), np.append(np.zeros(width), np.log(p / (1 - p))))
    fold = np.random.default_rng(seed).permutation(len(y)) % FOLDS
    raw = data.tobytes()
    texts = [raw[at[i] : at[i + 1]] for i in range(len(y))]
    x = np.zeros((len(y), width))
    for part in (fold == k for k in range(FOLDS)):  # measured with dictionaries of the other folds
        one, two = _compressors(*train_dictionaries([t for t, h in zip(texts, part, strict=True) if not h], y[~part]))
        if part.any():
            x[part] = np.concatenate([features(*savings(d, a, one, two)) for _, _, d, a in slices(text.filter(pa.array(part)))])
    ordinary, toxic = train_dictionaries(texts, y)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    weights = fit_logistic((x - mean) / scale, y.astype(float))
    # the sample's share of toxic rows is not that of the labels
    s, t = y.mean(), share.get(1, 0) / sum(share.values())
    weights[-1] += np.log(t / (1 - t)) - np.log(s / (1 - s)) if 0 < s < 1 and 0 < t < 1 else 0
    del rows, text, data, raw, texts, fold, x  # the driver goes on without the sample
    gc.collect()
    give_back()
    return Model(ordinary, toxic, mean, scale, weights)


def accept(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    return kept_rows(docs, lambda text: model.scores(text) < threshold)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), "doc_id long, score double, predicted int")
