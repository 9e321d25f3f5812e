"""Secret scans: a linear-chain conditional random field tags tokens as begin, inside or outside of a secret.

Three plain rules find what has a fixed form: a value assigned to a telling name, an access key, a long run of hex digits.
What they find in a sample is what the field learns from; it then finds secrets of like shape and surroundings anywhere,
and adds those that no rule has found.

Tokens are runs of ASCII letters, digits and characters outside ASCII. A token is seen by its shape (length, shares of
digits and vowels, kinds of characters and changes between them), the marks around it, the words beside it, its
neighbours' shapes, and its file (shares of digits, of code marks, of line ends). Its own letters are no feature.

The field is fitted by its conditional likelihood (forward-backward, Adam, an L2 penalty) on windows of WINDOW tokens from
at most SAMPLE_DOCUMENTS documents, chosen by a hash, at most SAMPLE_WINDOWS with a secret and as many without.

Decoding is exact Viterbi over whole texts. Most tokens need none: where tag O beats the others whatever the tags of both
neighbours, some best path has O there, so only the runs of tokens between such ones are decoded, between two O.

Null or empty texts have no spans; rows are judged each by their own text; without a document that has a secret, there is
nothing to learn and only the rules' spans are given. Positions count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import _SPACE, freed, slices, span_hashes

KINDS = ("assign", "access", "hex", "field")
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, WINDOW = 20_000, 4_000, 24
LEAST_SPAN = 6
STEPS, RATE, PENALTY = 60, 0.1, 1e-4
COPIES, DROPPED = 6, 0.5
TOKENS_AT_ONCE = 1 << 18
SLICE = 4 << 20

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_NAMES = (b"passw", b"secret", b"token", b"api")
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
_LEAST_HEX = 24

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: 1 lower, 2 upper, 3 digit, 4 outside ASCII, 0 others
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = True
#: What stands beside a token: 1 blank, 2 line end, 3 quote, 4 equals, 5 colon, 6 joiner, 7 others; 0 the text's edge
_BESIDE = np.full(256, 7, np.uint8)
_BESIDE[[9, 32]], _BESIDE[[10, 13]], _BESIDE[[34, 39, 96]], _BESIDE[61], _BESIDE[58], _BESIDE[[43, 45, 46, 47, 95]] = 1, 2, 3, 4, 5, 6
_ASSIGNS = np.isin(np.arange(256), [58, 61])
_CODE = np.isin(np.arange(256), [ord(c) for c in "={}()[];\"'<>_"])
_WORDS = 1 << 14
#: Values of each feature; the features of a token are one value of each.
_SIZES = (1, 16, 6 * 9, 6 * 16, 6 * 9, 6 * 9, 8 * 8, 3 * 8, 6 * 16, 6 * 16, 64 * 2, _WORDS, _WORDS, _WORDS)
_OFFSETS = np.concatenate(([0], np.cumsum(_SIZES)))
B, I, O = 0, 1, 2  # noqa: E741


def _bucket(part: np.ndarray, whole: np.ndarray, most: int) -> np.ndarray:
    return (part * most // np.maximum(whole, 1)).astype(np.int64)


def rule_spans(text: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of what the rules for assignments and access keys find."""
    out, low = [], text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def hex_spans(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Runs of at least 24 hex digits within the rows: such a run holds six bytes in sequence of every fourth."""
    some = _HEX[data[::4]]
    for k in (1, 2, 2):  # 2, 4, 6 in sequence
        some = some[: len(some) - k] & some[k:] if len(some) > k else some[:0]
    out, end, row = [], -1, 0
    for p in (np.flatnonzero(some) * 4).tolist():
        if p < end:
            continue
        while at[row + 1] <= p:
            row += 1
        s = e = p
        while s > at[row] and _HEX[data[s - 1]]:
            s -= 1
        while e < at[row + 1] and _HEX[data[e]]:
            e += 1
        end = e
        if e - s >= _LEAST_HEX:
            out.append((s, e))
    return out


def rule_rows(data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Per row the sorted (start, kind, end, start of the value), in bytes of the row."""
    out = [rule_spans(data[at[i] : at[i + 1]].tobytes()) for i in range(len(at) - 1)]
    for s, e in hex_spans(data, at):
        i = int(np.searchsorted(at, s, "right")) - 1
        out[i].append((s - int(at[i]), 2, e - int(at[i]), s - int(at[i])))
    return [sorted(x) for x in out]


def token_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = _TOKEN[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def file_codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A code of each row from its shares of digits, code marks and line ends."""
    code = np.zeros(len(at) - 1, np.int64)
    for table, steps in ((_CLASS == 3, (0.005, 0.02, 0.08)), (_CODE, (0.005, 0.02, 0.08)), (_SPACE & (np.arange(256) == 10), (0.003, 0.01, 0.03))):
        total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        code = code * 4 + np.digitize((total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1), steps)
    return code


def features(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, files: np.ndarray) -> np.ndarray:
    """The features of the tokens but the first and last two, which are only neighbours; all within `data`."""
    low, high = int(starts[0]), int(ends[-1])
    part = data[low:high]
    kind = _CLASS[part]
    a, b, size = starts - low, ends - low, ends - starts

    def many(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(part) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[b] - total[a]

    changes = np.zeros(len(part), bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes[a] = False
    lower, upper, digit, far = (many(kind == k) for k in (1, 2, 3, 4))
    size = size - far // 2  # most characters outside ASCII have two bytes
    coarse = np.digitize(size, (4, 8, 12, 20))
    profile = (lower > 0) * 1 + (upper > 0) * 2 + (digit > 0) * 4 + (far > 0) * 8
    shape = coarse * 16 + profile
    n = len(starts)
    same = row[1:] == row[:-1]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = ~same, ~same
    left = np.where(starts > at[row], _BESIDE[data[np.maximum(starts - 1, 0)]], 0)
    right = np.where(ends < at[row + 1], _BESIDE[data[np.minimum(ends, len(data) - 1)]], 0)
    assigns = np.zeros(len(part) + 1, np.int32)
    np.cumsum(_ASSIGNS[part], out=assigns[1:])
    gap = np.zeros(n, np.int64)
    gap[1:] = np.where(same, np.minimum(assigns[a[1:]] - assigns[b[:-1]], 2), 0)
    word = (span_hashes(data, starts, ends) % np.uint64(_WORDS - 1)).astype(np.int64) + 1
    word = np.where(size > 20, 0, word)

    def beside(values: np.ndarray, step: int) -> np.ndarray:
        out = np.roll(values, step)
        return np.where(np.roll(row, step) == row, out, 0)

    mid = slice(2, n - 2)
    columns = (
        np.zeros(n, np.int64), np.minimum(np.where(size < 8, size, 6 + np.log2(np.maximum(size, 1)).astype(np.int64)), 15), coarse * 9 + _bucket(digit, size, 8).clip(0, 8), shape,
        coarse * 9 + np.minimum(many(changes), 8), coarse * 9 + _bucket(many(_VOWEL[part]), size, 8).clip(0, 8), left.astype(np.int64) * 8 + right, gap * 8 + left, beside(shape, 1), beside(shape, -1),
        files[row] * 2 + (digit > 0), beside(word, 1), beside(word, 2), beside(word, -1),
    )
    return np.stack([c[mid] + o for c, o in zip(columns, _OFFSETS[:-1], strict=True)], 1).astype(np.int32)


def blocks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first byte, end byte, row, features) of all tokens, TOKENS_AT_ONCE together."""
    starts, ends = token_spans(data, at)
    if not len(starts):
        return
    files = file_codes(data, at)
    rows = np.searchsorted(at, starts, "right") - 1
    for i in range(0, len(starts), TOKENS_AT_ONCE):
        j = min(len(starts), i + TOKENS_AT_ONCE)
        x = np.arange(i - 2, j + 2)
        inner = x.clip(0, len(starts) - 1)
        row = np.where(x == inner, rows[inner], -1)  # what is beside the first and last token belongs to no row
        s, e = starts[inner], ends[inner]
        own = np.where(row < 0, 0, row)
        got = _features_of(data, at, s, e, row, own, files)
        yield starts[i:j], ends[i:j], rows[i:j], got


def _features_of(data, at, s, e, row, own, files) -> np.ndarray:
    """Features where the outer rows may be none (-1): those are told apart from every real row."""
    files = np.append(files, 0)
    at = np.append(at, at[-1])
    return features(data, at, s, e, np.where(row < 0, len(files) - 1, own), files)


class Field:
    """Weights of the features by tag, and of tags in sequence."""

    def __init__(self, weights: np.ndarray, follow: np.ndarray):
        self.weights, self.follow = weights, follow

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.weights[rows[:, k]] for k in range(rows.shape[1]))

    def certain(self, scores: np.ndarray) -> np.ndarray:
        """Where O is at least as good as the other tags, whatever stands on both sides (O or another tag, or the text's end)."""
        after = np.concatenate((self.follow, np.zeros((3, 1))), 1)
        out = np.ones(len(scores), bool)
        for y in (B, I):
            most = (self.follow[:, y] - self.follow[:, O]).max() + (after[y] - after[O]).max()
            out &= scores[:, O] >= scores[:, y] + most
        return out

    def best(self, scores: np.ndarray, ends: bool = True) -> list[int]:
        """The best tags of a run after an O (or a text's start) and before an O, or at a text's end."""
        total, back = scores[0] + self.follow[O], []
        for x in scores[1:]:
            each = total[:, None] + self.follow
            back.append(each.argmax(0))
            total = each.max(0) + x
        tags = [int((total + (0 if ends else self.follow[:, O])).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def likelihood(field: Field, rows: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of windows (n, WINDOW, features) and its gradients: forward-backward for all windows side by side."""
    n, w, k = rows.shape
    x = sum(field.weights[rows[:, :, f]] for f in range(k)) * real[:, :, None]
    t = field.follow
    forward, backward = np.zeros((n, w, 3)), np.zeros((n, w, 3))
    logsum = lambda v, axis: (m := v.max(axis)) + np.log(np.exp(v - np.expand_dims(m, axis)).sum(axis))
    forward[:, 0] = x[:, 0] + t[O]
    for i in range(1, w):
        on = logsum(forward[:, i - 1, :, None] + t, 1) + x[:, i]
        forward[:, i] = np.where(real[:, i, None], on, forward[:, i - 1])
    for i in range(w - 2, -1, -1):
        back = logsum(t + (x[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
        backward[:, i] = np.where(real[:, i + 1, None], back, 0)
    total = logsum(forward[:, -1], 1)
    here = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
    got, one = float(-total.sum()), np.eye(3)
    truth = one[tags] * real[:, :, None]
    got += float((x * truth).sum())
    g_weights = np.stack([np.bincount(rows.reshape(-1), np.repeat((truth - here)[:, :, y].reshape(-1), k), len(field.weights)) for y in range(3)], 1)
    g_follow = np.zeros((3, 3))
    np.add.at(g_follow, (np.full(n, O), tags[:, 0]), 1.0)
    g_follow[O] -= here[:, 0].sum(0)
    for i in range(1, w):
        pair = np.exp(forward[:, i - 1, :, None] + t + (x[:, i] + backward[:, i])[:, None, :] - total[:, None, None]) * real[:, i, None, None]
        np.add.at(g_follow, (tags[real[:, i], i - 1], tags[real[:, i], i]), 1.0)
        g_follow -= pair.sum(0)
    got += float((t[O, tags[:, 0]]).sum() + sum(t[tags[real[:, i], i - 1], tags[real[:, i], i]].sum() for i in range(1, w)))
    return got, g_weights, g_follow


def with_gaps(rows: np.ndarray, tags: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows and COPIES of those with a secret in which each feature of its tokens is missing by chance, so that none is indispensable."""
    holds = ((tags != O) & real).any(1)
    rng, made = np.random.default_rng(1), [rows]
    for _ in range(COPIES):
        copy = rows[holds].copy()
        gone = (tags[holds] != O)[:, :, None] & (rng.random(copy.shape) < DROPPED)
        copy[gone] = _OFFSETS[-1]
        made.append(copy)
    again = lambda v: np.concatenate([v, *[v[holds]] * COPIES])
    return np.concatenate(made), again(tags), again(real)


def fit(rows: np.ndarray, tags: np.ndarray, real: np.ndarray) -> Field:
    rows, tags, real = with_gaps(rows, tags, real)
    field = Field(np.zeros((int(_OFFSETS[-1]) + 1, 3)), np.zeros((3, 3)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weights, field.follow)]
    for step in range(1, STEPS + 1):
        _, *slopes = likelihood(field, rows, tags, real)
        slopes[0][-1] = 0  # a missing feature has no weight
        for p, g, m in zip((field.weights, field.follow), slopes, moments, strict=True):
            g = g / len(rows) - PENALTY * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return field


def _windows(ids: np.ndarray, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bool, bytes, bytes]]:
    """(rank, with a secret, features, tags) of some windows of each row: around its secrets, at its most number-like token, and anywhere."""
    found = rule_rows(data, at)
    parts = list(blocks(data, at))
    if not parts:
        return
    starts, ends, rows, got = (np.concatenate([p[k] for p in parts]) for k in range(4))
    tags = np.full(len(starts), O, np.int8)
    for i, spans in enumerate(found):
        done = -1
        for _, _, e, s in sorted(spans, key=lambda x: x[3]):
            if s >= done:
                a, b = np.searchsorted(ends, at[i] + s, "right"), np.searchsorted(starts, at[i] + e)
                tags[a:b] = I
                tags[a : a + 1] = B if b > a else tags[a : a + 1]
                done = e
    first = np.searchsorted(rows, np.arange(len(at)))
    numbers = (got[:, 2] - _OFFSETS[2]) % 9 * np.minimum(ends - starts, 64)
    for i in range(len(at) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if a == b:
            continue
        near = np.flatnonzero(tags[a:b] == B)[:4] + a
        rank = int(ids[i])
        places = [int(x) - (rank + k) % (WINDOW - 4) for k, x in enumerate(near)]
        places += [a + (rank >> 8) % (b - a), a + int(np.argmax(np.where(tags[a:b] == O, numbers[a:b], -1))) - rank % WINDOW]
        for k, p in enumerate(places):
            p = min(max(p, a), max(a, b - WINDOW))
            q = min(p + WINDOW, b)
            if p > a and tags[p] == I:
                continue
            x = np.zeros((WINDOW, got.shape[1]), np.int32)
            x[: q - p] = got[p:q]
            y = np.full(WINDOW, -1, np.int8)
            y[: q - p] = tags[p:q]
            yield (rank * 31 + k) % (1 << 62), bool((tags[p:q] != O).any()), x.tobytes(), y.tobytes()


def train(docs: DataFrame) -> Field | None:
    """A field from a bounded sample of the documents, or None if the sample holds no secret."""
    n = docs.count()
    rank = F.xxhash64("doc_id", "text")
    some = docs.select(rank.alias("rank"), "text").filter(F.pmod("rank", F.lit(1 << 20)) < max(1, int((1 << 20) * min(1, SAMPLE_DOCUMENTS / max(n, 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, at in slices(batch.column(1), SLICE):
                if len(data) and (made := list(_windows(ids[i:j] & 0x3FFFFFFFFFFFFFFF, data, at))):
                    yield pa.record_batch([list(c) for c in zip(*made, strict=True)], names=["rank", "holds", "x", "y"])

    made = some.mapInArrow(freed(run), "rank long, holds boolean, x binary, y binary")
    both = [made.filter(F.col("holds") == h).orderBy("rank", F.xxhash64("x")).limit(SAMPLE_WINDOWS).toArrow() for h in (True, False)]
    if not both[0].num_rows:
        return None
    x = np.stack([np.frombuffer(b, np.int32).reshape(WINDOW, -1) for t in both for b in t.column("x").to_pylist()])
    y = np.stack([np.frombuffer(b, np.int8) for t in both for b in t.column("y").to_pylist()]).astype(np.int64)
    return fit(x, np.where(y < 0, O, y), y >= 0)


def tagged(field: Field, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per row the (start, end) of what the field calls a secret, in bytes of the row."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(at) - 1)]
    kept, before = [], 0
    for starts, ends, rows, got in blocks(data, at):
        scores = field.scores(got)
        some = np.flatnonzero(~field.certain(scores))
        kept.append((some + before, starts[some], ends[some], rows[some], scores[some]))
        before += len(starts)
    if not kept:
        return out
    places, starts, ends, rows, scores = (np.concatenate([k[i] for k in kept]) for i in range(5))
    if not len(places):
        return out
    cuts = [0, *(np.flatnonzero((np.diff(places) > 1) | (np.diff(rows) > 0)) + 1).tolist(), len(places)]
    tokens = np.searchsorted(at, token_spans(data, at)[0], "right") - 1
    last = np.zeros(len(places), bool)
    last[:] = (places + 1 == len(tokens)) | (tokens[np.minimum(places + 1, len(tokens) - 1)] != rows)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        tags, k = field.best(scores[a:b], bool(last[b - 1])), 0
        base, end = int(at[rows[a]]), int(at[rows[a] + 1])
        while k < len(tags):
            if tags[k] == O:
                k += 1
                continue
            j = k + 1
            while j < len(tags) and tags[j] == I:
                j += 1
            e = int(ends[a + j - 1])
            while e < end and data[e] == 61 and e < int(ends[a + j - 1]) + 2:  # padding belongs to it
                e += 1
            out[int(rows[a])].append((int(starts[a + k]) - base, e - base))
            k = j
    return out


def _points(text: np.ndarray, places: list[int]) -> dict[int, int]:
    """Code points before each byte place."""
    out, now, n = {}, 0, 0
    for p in sorted(set(places)):
        n += int(np.count_nonzero((text[now:p] & 0xC0) != 0x80))
        out[p], now = n, p
    return out


def spans(data: np.ndarray, at: np.ndarray, field: Field | None) -> Iterator[list[tuple[int, int, int]]]:
    """Per row the sorted (start, kind, end) in code points: the rules' and, where none of these is, the field's."""
    more = tagged(field, data, at) if field else [[]] * (len(at) - 1)
    for i, found in enumerate(rule_rows(data, at)):
        text = data[at[i] : at[i + 1]]
        all_spans = [(s, k, e) for s, k, e, _ in found]
        for s, e in more[i]:
            if all(e <= x or s >= y for x, _, y in all_spans[: len(found)]):
                all_spans.append((s, 3, e))
        where = _points(text, [p for s, _, e in all_spans for p in (s, e)])
        yield sorted((where[s], k, where[e]) for s, k, e in all_spans if k < 3 or where[e] - where[s] >= LEAST_SPAN)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_field, base_sha256 and spans of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in slices(batch.column(1), SLICE):
                counts: list[list[int]] = [[] for _ in KINDS]
                sums, texts = [], []
                for found in spans(data, at, field) if len(data) else ([] for _ in range(j - i)):
                    for k, c in enumerate(counts):
                        c.append(sum(x[1] == k for x in found))
                    sums.append(hashlib.sha256(told([x for x in found if x[1] < 3]).encode()).hexdigest())
                    texts.append(told(found))
                yield pa.record_batch([batch.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(freed(run), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def find_secrets(docs: DataFrame) -> DataFrame:
    """The spans of secrets in every document, with a field trained on a sample of them."""
    return scan(docs, train(docs))
