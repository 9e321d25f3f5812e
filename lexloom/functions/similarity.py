"""Text similarities. Edit distance of words is Spark's; the others are Arrow-batched pandas functions.

ratio: round(100 * 2 * LCS / (|a| + |b|)), 100 for two empty texts.
token_set_ratio: words as sets; the best ratio among (common, common + rest of a), (common, common + rest
of b) and the two sums; 100 if one set holds the other and both share a word; 0 without words. Texts are
processed first, as the usual library does by default: ASCII characters alone, lower case, signs as spaces.
partial_ratio: the best ratio of the shorter text with a window of its length (or cut at an end) in the
longer one; 0 if just one is empty.
sequence_similarity: twice the matched length over both lengths, matching longest blocks first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import PUNCTUATION, normalize_string

#: Shorter texts from which windows are scored by anti-diagonals; products of lengths up to which the standard library
#: matches sequences; pairs of equal elements beyond which it does so in less memory.
WIDE, SMALL, POINTS = 96, 20_000, 4_000_000
#: Runs that are looked through one by one rather than as arrays.
FEW = 48
#: Bits of a word; words of a pattern, and pairs of one size, within which pairs are compared side by side; words of the
#: tables of such a block, and pairs in it.
BITS, WORDS, SIDE, TABLE, BLOCK = 64, 48, 24, 1 << 22, 1200


def cer(model: Column, truth: Column, denominator: str = "model", distance=F.levenshtein) -> Column:
    """Character error rate of normalised texts: 0 if both are empty, 1 if one is, else distance over length.

    distance: Spark's own for words, the one below for whole lines.
    """
    a, b = normalize_string(model), normalize_string(truth)
    by = F.length(a if denominator == "model" else b)
    return F.when((a == "") & (b == ""), 0.0).when((a == "") | (b == ""), 1.0).otherwise(distance(a, b) / by)


_NO_SIGNS = str.maketrans("", "", PUNCTUATION)


def normalized(text: str) -> str:
    """What normalize_string gives for an ASCII text, whose white space is what split() knows; others are as they are."""
    return " ".join(text.translate(_NO_SIGNS).lower().split()) if text.isascii() else text


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with rows of bits in one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def plain_distance(a: str, b: str) -> int:
    """Edit distance, with columns of bits in one integer: a step for each character of the shorter text."""
    text, pattern = sorted((a, b), key=len)
    if not text:
        return len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, high, out = (1 << len(pattern)) - 1, 1 << len(pattern) - 1, len(pattern)
    up, down = full, 0  # where the column grows, and falls, from one row to the next
    for c in text:
        hit = at.get(c, 0) | down
        same = ((hit & up) + up ^ up | hit) & full
        right, left = down | full & ~(same | up), same & up
        out += bool(right & high) - bool(left & high)
        right, left = right << 1 & full | 1, left << 1 & full
        up, down = left | full & ~(same | right), same & right
    return out


def plain_edit_ratio(a: str, b: str, least: float = 0) -> float:
    """100 * (1 - distance / longer length), a similarity that SQL can say; 0 where the lengths alone keep it under `least`."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 100.0
    return 0.0 if 100 * short < least * long else 100.0 * (1 - plain_distance(a, b) / long)


def plain_ratio(a: str, b: str) -> int:
    return round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100


def processed_words(text: str) -> list[str]:
    """Words of the ASCII characters of a text in lower case; other characters go, signs part words."""
    return re.findall("[a-z0-9_]+", text.encode("ascii", "ignore").decode().lower())


def plain_token_set_ratio(a: str, b: str, process: bool = True) -> int:
    x, y = (set(processed_words(t) if process else t.split()) for t in (a, b))
    if not x or not y:
        return 0
    both = " ".join(sorted(x & y))
    left, right = (" ".join(sorted(s)) for s in (x - y, y - x))
    if both and (not left or not right):
        return 100
    one, two = (f"{both} {s}".strip() for s in (left, right))
    return max(plain_ratio(one, two), *((plain_ratio(both, one), plain_ratio(both, two)) if both else (0,)))


def _blocks(left: list[str], right: list[str]):
    """Blocks of pairs of different texts: places, words of the pattern (the first text), codes, table of patterns and pattern of each pair.

    Pairs of a block stand by falling length of their second text. What is better done one by one comes with words 0.
    """
    sizes = np.array([[len(a) for a in left], [len(b) for b in right]], np.int64).reshape(2, -1)
    words = -(-sizes // BITS)
    turn = words[0] * sizes[1] > words[1] * sizes[0]  # the cheaper side is the pattern
    pattern, text = np.where(turn, words[1], words[0]), np.where(turn, sizes[0], sizes[1])
    order = np.lexsort((-text, pattern))
    cuts = np.flatnonzero(np.diff(pattern[order], prepend=-1, append=-1))
    for first, end in zip(cuts[:-1], cuts[1:], strict=True):
        w = int(pattern[order[first]])
        most = max(SIDE, min(BLOCK, TABLE // max(1, w * 64)))
        for at in (order[i : min(i + most, end)] for i in range(first, end, most)):
            pairs = [(right[i], left[i]) if turn[i] else (left[i], right[i]) for i in at]
            if not w or w > WORDS or len(at) < SIDE:
                yield at, 0, pairs, None, None, None
                continue
            known: dict[str, int] = {}
            which = np.array([known.setdefault(p, len(known)) for p, _ in pairs])
            joined = "".join(known)
            codes, letters = np.unique(np.frombuffer((joined + "".join(t for _, t in pairs)).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
            if len(known) * len(codes) * w > 4 * TABLE:
                yield at, 0, pairs, None, None, None
                continue
            each = np.array([len(p) for p in known])
            row = np.repeat(np.arange(len(known)), each)
            place = np.arange(len(joined)) - np.repeat(np.cumsum(each) - each, each)
            table = np.zeros((w, len(codes), len(known)), np.uint64)
            np.add.at(table, (place // BITS, letters[: len(joined)], row), np.uint64(1) << (place % BITS).astype(np.uint64))
            lengths = np.array([len(t) for _, t in pairs])
            # by place, then pair: at place j the pairs are the first ones, those with a longer text than j
            rest = letters[len(joined) :]
            start = np.cumsum(lengths) - lengths
            live = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
            yield at, w, pairs, (rest, start, live), table, which


def _each(left: list[str], right: list[str], alone, step, start, count) -> np.ndarray:
    out = np.zeros(len(left), np.int64)
    for at, w, pairs, text, table, which in _blocks(left, right):
        if not w:
            out[at] = [alone(p, t) for p, t in pairs]
            continue
        rest, first, live = text
        flat, patterns = table.reshape(w, -1), table.shape[2]
        state, room = start(w, len(at)), [np.empty(len(at), np.uint64) for _ in range(8)]
        for j, n in enumerate(live.tolist()):
            step(state, flat, rest[first[:n] + j] * patterns + which[:n], n, [r[:n] for r in room])
        sizes = np.array([len(p) for p, _ in pairs])
        mask = [np.where(sizes >= (i + 1) * BITS, ~np.uint64(0), (np.uint64(1) << (sizes - i * BITS).clip(0, BITS - 1).astype(np.uint64)) - np.uint64(1)) for i in range(w)]
        out[at] = count(state, mask, sizes, np.array([len(t) for _, t in pairs]))
    return out


def _distance_step(state, flat, at, n, room) -> None:
    eq, xv, xh, ph, mh, t, pin, min_ = room
    pin[:], min_[:] = 1, 0
    for up, down, table in zip(*state, flat, strict=True):
        pv, mv = up[:n], down[:n]
        table.take(at, out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_or(eq, min_, out=eq)
        np.bitwise_and(eq, pv, out=xh)
        np.add(xh, pv, out=xh)
        np.bitwise_xor(xh, pv, out=xh)
        np.bitwise_or(xh, eq, out=xh)
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        np.bitwise_or(ph, mv, out=ph)
        np.bitwise_and(pv, xh, out=mh)
        np.add(ph, ph, out=t)
        np.bitwise_or(t, pin, out=t)
        np.right_shift(ph, BITS - 1, out=pin)
        np.add(mh, mh, out=xh)
        np.bitwise_or(xh, min_, out=xh)
        np.right_shift(mh, BITS - 1, out=min_)
        np.bitwise_and(t, xv, out=mv)
        np.bitwise_or(t, xv, out=pv)
        np.invert(pv, out=pv)
        np.bitwise_or(pv, xh, out=pv)


def _lcs_step(state, flat, at, n, room) -> None:
    eq, hit, total, carry, over = room[:5]
    carry[:] = 0
    for row, table in zip(*state, flat, strict=True):
        v = row[:n]
        table.take(at, out=eq, mode="clip")
        np.bitwise_and(v, eq, out=hit)
        np.add(v, hit, out=total)
        np.less(total, v, out=over, casting="unsafe")
        np.add(total, carry, out=total)
        np.less(total, carry, out=carry, casting="unsafe")
        np.bitwise_or(carry, over, out=carry)
        np.subtract(v, hit, out=v)
        np.bitwise_or(v, total, out=v)


def distances(left: list[str], right: list[str]) -> np.ndarray:
    """plain_distance of many pairs: pairs of one size side by side, a word of bits of each in a step."""
    ones = lambda w, n: np.full((w, n), ~np.uint64(0))
    count = lambda state, mask, sizes, texts: texts + sum(np.bitwise_count(u & m).astype(np.int64) - np.bitwise_count(d & m) for u, d, m in zip(*state, mask, strict=True))
    return _each(left, right, plain_distance, _distance_step, lambda w, n: (ones(w, n), ~ones(w, n)), count)


def common(left: list[str], right: list[str]) -> np.ndarray:
    """lcs of many pairs, likewise."""
    count = lambda state, mask, sizes, texts: sum(np.bitwise_count(~v & m).astype(np.int64) for v, m in zip(*state, mask, strict=True))
    return _each(left, right, lcs, _lcs_step, lambda w, n: (np.full((w, n), ~np.uint64(0)),), count)


def edit_ratios(left: list[str], right: list[str], least: float = 0) -> np.ndarray:
    """plain_edit_ratio of many pairs."""
    sizes = np.array([[len(a) for a in left], [len(b) for b in right]], np.int64).reshape(2, -1)
    short, long = sizes.min(0), sizes.max(0)
    out = np.where(long == 0, 100.0, 0.0)
    same = np.array([a == b for a, b in zip(left, right, strict=True)], bool)
    out[same] = 100.0
    at = np.flatnonzero(~same & (long > 0) & (100 * short >= least * long))
    out[at] = 100.0 * (1 - distances([left[i] for i in at], [right[i] for i in at]) / long[at])
    return out


def edit_bounds(left: list[str], right: list[str], least: float = 0) -> np.ndarray:
    """What edit ratios can't exceed, by the lengths."""
    sizes = np.array([[len(a) for a in left], [len(b) for b in right]], np.int64).reshape(2, -1)
    short, long = sizes.min(0), sizes.max(0)
    return np.where(100 * short >= least * long, 100.0 * (1 - (long - short) / long.clip(1)), 0.0)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """plain_ratio of many pairs."""
    both = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    return np.where(both > 0, np.rint(200 * common(left, right) / both.clip(1)), 100.0)


def _sets(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[frozenset, frozenset, int]]]:
    """Token set ratios as far as no subsequence is needed, what they can't exceed, and for each pair the two rests and the length in common."""
    known: dict[str, frozenset] = {}
    sure, most, rests = np.zeros(len(left)), np.zeros(len(left)), []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x, y = (known[t] if t in known else known.setdefault(t, frozenset(processed_words(t))) for t in (a, b))
        both, only, other = x & y, x - y, y - x
        if not x or not y or both and (not only or not other):
            sure[i] = most[i] = 100 if both and x and y else 0
            rests.append((x, y, 0))
            continue
        n, m, k = (sum(map(len, s)) + max(0, len(s) - 1) for s in (both, only, other))
        gap = bool(n)
        one, two = n + gap + m, n + gap + k
        sure[i] = max(round(200 * n / (n + one)), round(200 * n / (n + two))) if n else 0
        most[i] = max(sure[i], round(200 * (n + gap + min(m, k)) / (one + two)))
        rests.append((only, other, n + gap))
    return sure, most, rests


def token_set_bounds(left: list[str], right: list[str]) -> np.ndarray:
    return _sets(left, right)[1]


def token_set_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """plain_token_set_ratio of many pairs: what the words in common give is known by their lengths, and the sums begin with them."""
    out, most, rests = _sets(left, right)
    at = np.flatnonzero(out < most)
    one, two = ([" ".join(sorted(rests[i][side])) for i in at] for side in (0, 1))
    before = np.array([rests[i][2] for i in at], np.int64)
    sizes = np.array([len(a) + len(b) for a, b in zip(one, two, strict=True)], np.int64) + 2 * before
    out[at] = np.maximum(out[at], np.rint(200 * (before + common(one, two)) / sizes.clip(1)))
    return out


def crossings(short: str, long: str) -> list[int]:
    """For each place j of the longer text, a number c[j] such that short has a common subsequence with long[l:r]
    of as many characters as there are l <= j < r with c[j] < l: one pass for all windows at once."""
    out = list(range(len(long)))
    for c in short:
        carried = -1
        for j, d in enumerate(long):
            here = out[j]
            if c == d or here < carried:
                out[j], carried = carried, here
    return out


def wide_crossings(short: str, long: str) -> np.ndarray:
    """The same for long texts: cells of one anti-diagonal don't depend on each other."""
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (short[::-1], long))
    m, n = len(a), len(b)
    out, carried = np.arange(n), np.full(m, -1)  # carried[k]: of row m - 1 - k
    for d in range(m + n - 1):  # cells (i, d - i)
        first, end = max(0, d - n + 1), min(m, d + 1)  # rows
        low, high = d - end + 1, d - first + 1  # columns, rising as rows fall
        rows = slice(m - end, m - first)
        here, with_it = out[low:high], carried[rows]
        swap = (a[rows] == b[low:high]) | (here < with_it)
        out[low:high], carried[rows] = np.where(swap, with_it, here), np.where(swap, here, with_it)
    return out


def plain_partial_ratio(a: str, b: str) -> int:
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not short:
        return 0 if long else 100
    if short in long:
        return 100
    c = np.asarray(wide_crossings(short, long) if n > WIDE else crossings(short, long))
    place = np.arange(len(long))
    step = np.bincount(np.maximum(c + 1, place - n + 1).clip(0), minlength=len(long) + 1) - np.bincount(place + 1, minlength=len(long) + 1)
    inside = np.cumsum(step)[: len(long)]  # of the windows that start at each place, cut at the end
    first = np.cumsum(c < 0)[:n]  # of those cut at the start
    size, cut = np.minimum(n, len(long) - place), np.arange(1, n + 1)[: len(first)]
    return max(round(200 * int(k) / (n + int(w))) for k, w in {*zip(inside.tolist(), size.tolist(), strict=True), *zip(first.tolist(), cut.tolist(), strict=True)})


def partial_bounds(left: list[str], right: list[str]) -> np.ndarray:
    """What partial ratios can't exceed: that of a window of just the characters that both texts have."""
    out = np.zeros(len(left))
    for i, pair in enumerate(zip(left, right, strict=True)):
        short, long = sorted(pair, key=len)
        have = sum(min(short.count(c), long.count(c)) for c in set(short))
        out[i] = round(200 * have / (len(short) + have)) if short else 0 if long else 100
    return out


MANY = {plain_edit_ratio: edit_ratios, plain_ratio: ratios, plain_token_set_ratio: token_set_ratios}
BOUNDS = {plain_edit_ratio: edit_bounds, plain_token_set_ratio: token_set_bounds, plain_partial_ratio: partial_bounds}


def _for_lists(known: dict, f: Callable, other: Callable) -> Callable:
    if isinstance(f, partial) and f.func in known and not f.args:
        return partial(known[f.func], **f.keywords)
    return known.get(f, other)


def many(f: Callable) -> Callable:
    """A similarity of two texts as one of two lists."""
    return _for_lists(MANY, f, lambda left, right: np.array([f(a, b) for a, b in zip(left, right, strict=True)], float))


def bounds(f: Callable) -> Callable:
    """What a similarity can't exceed, of two lists: 100 where nothing is known."""
    return _for_lists(BOUNDS, f, lambda left, right: np.full(len(left), 100.0))


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
    known: dict = {}
    return tuple(np.array([known.setdefault(v, len(known)) for v in x], np.int64) for x in (a, b))


def _diagonals(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """(3, n): first places in x and y and length of the maximal runs of equal elements, of such as are not frequent in y.

    None beyond POINTS pairs of equal elements.
    """
    order = np.argsort(y.astype(np.uint16) if len(y) and y.max() < 1 << 16 else y, kind="stable")
    first = np.flatnonzero(np.diff(y[order], prepend=-1))
    values, many = y[order[first]], np.diff(np.append(first, len(y)))
    some = many <= len(y) // 100 + 1 if len(y) >= 200 else np.ones(len(values), bool)
    places = order[np.repeat(some, many)]
    values, many = values[some], many[some]
    if not len(values):
        return np.zeros((3, 0), np.int64)
    start = np.cumsum(many) - many
    at = np.searchsorted(values, x).clip(0, len(values) - 1)
    place = np.flatnonzero(values[at] == x)
    each = many[at[place]]
    if each.sum() > POINTS:
        return None
    i = np.repeat(place, each)
    j = places[np.repeat(start[at[place]] - np.cumsum(each) + each, each) + np.arange(len(i))]
    line = (j - i) * len(x) + i
    line.sort()
    i = line % len(x)
    first = np.flatnonzero((np.diff(line, prepend=-(1 << 62)) != 1) | (i == 0))  # the next diagonal may go on in number
    i, apart = i[first], (line[first] - i[first]) // len(x)
    return np.stack((i, i + apart, np.diff(np.append(first, len(line)))))


def _longest(runs: np.ndarray, alo: int, ahi: int, blo: int, bhi: int) -> tuple[tuple[int, int, int] | None, np.ndarray]:
    """(-length, i, j) of the longest run within a part, and the runs that reach into it."""
    skip = np.maximum(0, np.maximum(alo - runs[0], blo - runs[1]))
    left = np.minimum(runs[2], np.minimum(ahi - runs[0], bhi - runs[1])) - skip
    inside = left > 0
    runs, skip, left = runs[:, inside], skip[inside], left[inside]
    if not runs.shape[1]:
        return None, runs
    best = np.flatnonzero(left == left.max())
    p, q = runs[:2, best] + skip[best]
    k = np.lexsort((q, p))[0]
    return (-int(left[best[k]]), int(p[k]), int(q[k])), runs


def _longest_of_few(runs: list, alo: int, ahi: int, blo: int, bhi: int) -> tuple[tuple[int, int, int] | None, list]:
    best, inside = None, []
    for run in runs:
        i, j, n = run
        skip = max(0, alo - i, blo - j)
        left = min(n, ahi - i, bhi - j) - skip
        if left > 0:
            inside.append(run)
            if best is None or (-left, i + skip, j + skip) < best:
                best = (-left, i + skip, j + skip)
    return best, inside


def matched(a, b) -> int | None:
    """Elements in blocks of the longest run first, then left and right of it: that of the rarer elements of b (all, if b
    has fewer than 200), the first in a and then in b, with all equal elements beside it.

    The runs of rarer elements are listed once; a part looks at the longer ones that reach into it, and at single
    elements, by their order, only where these give no more than one.
    """
    runs = _diagonals(*_codes(a, b))
    if runs is None:
        return None
    ones = runs[:2, runs[2] == 1]
    ones = ones[:, np.lexsort((ones[1], ones[0]))]
    total, parts = 0, [(0, len(a), 0, len(b), runs[:, runs[2] > 1])]
    while parts:
        alo, ahi, blo, bhi, runs = parts.pop()
        if not isinstance(runs, list):
            best, runs = _longest(runs, alo, ahi, blo, bhi)
            runs = runs.T.tolist() if runs.shape[1] <= FEW else runs
        else:
            best, runs = _longest_of_few(runs, alo, ahi, blo, bhi)
        if best is None or best[0] == -1:
            k, end = np.searchsorted(ones[0], (alo, ahi))
            within = (ones[1, k:end] >= blo) & (ones[1, k:end] < bhi)
            if k < end and within[n := int(within.argmax())]:
                best = min(best or (0, 0, 0), (-1, int(ones[0, k + n]), int(ones[1, k + n])))
        size, i, j = best or (0, alo, blo)
        first, second, end = i, j, i - size
        while first > alo and second > blo and a[first - 1] == b[second - 1]:
            first, second = first - 1, second - 1
        shift = second - first
        while end < ahi and end + shift < bhi and a[end] == b[end + shift]:
            end += 1
        if end > first:
            total += end - first
            parts += [p for p in ((alo, first, blo, second, runs), (end, ahi, end + shift, bhi, runs)) if p[0] < p[1] and p[2] < p[3]]
    return total


def plain_sequence_similarity(a, b) -> float:
    """Twice the matched length over both lengths; 1 for two empty sequences."""
    if len(a) == len(b) and a == b:
        return 1.0
    if len(a) * len(b) > SMALL and (n := matched(a, b)) is not None:
        return 2.0 * n / (len(a) + len(b))
    return SequenceMatcher(None, a, b).ratio()


def _paired(f, kind):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
            else:
                key = (x, y) if isinstance(x, str) else (tuple(x), tuple(y))
                if key not in known:
                    known[key] = f(*key)
                out.append(known[key])
        return pd.Series(out, dtype="object")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


distance = _paired(plain_distance, T.LongType())
ratio = _paired(plain_ratio, T.LongType())
token_set_ratio = _paired(plain_token_set_ratio, T.LongType())
partial_ratio = _paired(plain_partial_ratio, T.LongType())
sequence_similarity = _paired(plain_sequence_similarity, T.DoubleType())
