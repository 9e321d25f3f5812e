"""Spelling variants: words within one edit of a far more frequent form, by an index of variable-length grams.

Words are the runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; of one occurrence in NOISE (by a checksum
of document and run) a code point is missing, as a test of the grouping. All of these characters are single bytes of
Latin-1, so the index works on bytes.

1. Count. Runs are found, hashed and counted as arrays; only distinct words of a slice become strings.
2. Dictionary. A gram starts with SHORTEST characters and goes on while what it has so far is frequent, up to LONGEST.
   The frequent grams are the inner nodes of the gram trie; everything below a rarer node is pruned. A gram is frequent
   above total / FREQUENT occurrences, so at most (LONGEST - SHORTEST + 1) * FREQUENT of them exist at any size of input,
   which bounds what is sent to the tasks.
3. Decomposition. A word between two marks gives one gram at each position. Whether a gram goes on depends on the
   characters that it holds and on nothing after them, so an edit affects only the grams that cover it: at most
   `affected` of them, the largest number that cover one character. (Grams inside others are kept for this.)
4. Lists. Two words within one edit share all other grams, at the same place or one further, so they meet in a list of the
   `affected` + 1 rarest grams of each. A list is a gram, a place and a length. A word stands in the lists of its own
   length, and asks those of one character more. A word has at least LONGEST + 1 grams, so none is without a shared list.
5. Verification compares the words of a list as byte matrices; a list of more than LIST_ROWS rows is dealt over pairs of
   blocks. Only words that are one edit apart leave the task.

Null ids count as an empty id in the checksum; null or empty texts have no words; repeated rows count again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import freed, slices, span_hashes, stored

NOISE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHORTEST, LONGEST = 2, 5
FREQUENT = 20_000
LEAST_FREQUENT = 32
LIST_ROWS = 4_000
COUNT_BYTES = 4 << 20
PAIRS_AT_ONCE = 1 << 18
WIDTH = 32
_LONG_RUN = 64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the letter runs of UTF-8 texts; U+00C0 to U+00FF are byte C3 and the byte after it."""
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    return np.flatnonzero(letter & (~before | edge[:-1])), np.flatnonzero(letter & (~after | edge[1:])) + 1


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """crc32 of each span, going on from its seed."""
    out, size = seeds ^ np.uint32(0xFFFFFFFF), ends - starts
    rows = np.flatnonzero(size <= _LONG_RUN)
    for k in range(_LONG_RUN):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        now = out[rows]
        out[rows] = _CRC[(now ^ data[starts[rows] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG_RUN):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(seeds[i]))
    return out


def _counted(ids: list, data: np.ndarray, at: np.ndarray) -> Counter:
    data = _LOWER[data]
    starts, ends = _runs(data, at)
    wide = np.concatenate(([0], np.cumsum(data == 0xC3)))
    points = (ends - starts) - (wide[ends] - wide[starts])
    keep = points >= LEAST_LENGTH
    starts, ends, points = starts[keep], ends[keep], points[keep]
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    sums = _checksums(data, starts, ends, seeds[np.searchsorted(at, starts, "right") - 1])
    marred = sums % NOISE == 0
    out: Counter = Counter()
    for s, e, h, n in zip(starts[marred].tolist(), ends[marred].tolist(), sums[marred].tolist(), points[marred].tolist(), strict=True):
        if n > LEAST_LENGTH:
            word, k = data[s:e].tobytes().decode(), h % n
            out[word[:k] + word[k + 1 :]] += 1
    starts, ends = starts[~marred], ends[~marred]
    _, first, many = np.unique(span_hashes(data, starts, ends, fold=False), return_index=True, return_counts=True)
    for s, e, n in zip(starts[first].tolist(), ends[first].tolist(), many.tolist(), strict=True):
        out[data[s:e].tobytes().decode()] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the distinct words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, at in slices(batch.column(1), COUNT_BYTES):
                if len(data):
                    found = _counted(ids[i:j], data, at)
                    yield pa.record_batch({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(freed(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _marked(word: str) -> bytes:
    return b"\x01" + word.encode("latin-1") + b"\x02"


def frequent_grams(words: DataFrame) -> dict[bytes, int]:
    """The frequent grams with their occurrences: the inner nodes of the pruned trie. Bounded, see above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for word in batch.column(0).to_pylist():
                x = _marked(word)
                for q in range(SHORTEST, LONGEST + 1):
                    seen.update([x[p : p + q] for p in range(len(x) - q + 1)])
            yield pa.record_batch({"gram": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(LEAST_FREQUENT, total // FREQUENT)
    grams = words.select("word").mapInArrow(freed(run), "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {bytes(r.gram): r.n for r in grams.filter(F.col("n") > least).collect()}


def grams(x: bytes, frequent: dict[bytes, int]) -> list[tuple[int, bytes]]:
    """The gram at each position of a marked word: as short as it can be without being frequent."""
    out, n = [], len(x)
    for p in range(n - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < n and x[p : p + q] in frequent:
            q += 1
        out.append((p, x[p : p + q]))
    return out


def affected(found: list[tuple[int, bytes]], size: int) -> int:
    """The most grams that one edit can change: those that cover one character."""
    cover = [0] * size
    for p, gram in found:
        for i in range(p, p + len(gram)):
            cover[i] += 1
    return max(cover)


def asked(word: str, frequent: dict[bytes, int]) -> list[tuple[int, bytes]]:
    """The rarest grams of a word, one more than an edit can change."""
    x = _marked(word)
    found = grams(x, frequent)
    order = sorted(found, key=lambda g: (frequent.get(g[1], 0), zlib.crc32(g[1]), g[0]))
    return order[: affected(found, len(x)) + 1]


def _key(gram: bytes, size: int, place: int) -> int:
    return zlib.crc32(gram) << 31 | (size & 0x7FFF) << 16 | place & 0xFFFF


def lists(words: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(key, word, n, asks): the lists that a word stands in, and those of longer words that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                row, key, asks = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    size = len(word)
                    for p, gram in asked(word, frequent):
                        row += (i, i, i)
                        key += (_key(gram, size, p), _key(gram, size + 1, p), _key(gram, size + 1, p + 1))
                        asks += (False, True, True)
                row = pa.array(row, pa.int32())
                yield pa.record_batch({"key": pa.array(key, pa.int64()), "word": part.column(0).take(row), "n": part.column(1).take(row), "asks": pa.array(asks, pa.bool_())})

    return words.select("word", "n").mapInArrow(freed(run), "key long, word string, n long, asks boolean")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows with the blocks (a, b) in which they meet: 0, 0 but for lists of more than LIST_ROWS rows."""
    many = rows.groupBy("key").count().filter(F.col("count") > LIST_ROWS).select("key", F.ceil(F.col("count") / LIST_ROWS).cast("int").alias("blocks"))
    own = F.expr("cast(pmod(xxhash64(word), blocks) as int)")
    meets = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda x: F.struct(F.least(x, own).alias("a"), F.greatest(x, own).alias("b"), own.alias("own")))
    )
    return rows.join(many, "key", "left").select("*", F.explode(meets).alias("m")).select("key", "m.a", "m.b", "m.own", "word", "n", "asks")


def one_edit(x: str, y: str) -> bool:
    """Exactly one inserted, deleted or replaced character."""
    if len(x) < len(y):
        x, y = y, x
    k = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), len(y))
    return x != y and (x[k + 1 :] == y[k + 1 :] if len(x) == len(y) else len(x) == len(y) + 1 and x[k + 1 :] == y[k:])


def _near(m: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart; rows are zero-padded words."""
    swap = size[i] < size[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    x, y = m[i], m[j]
    differ = x != y
    same = size[i] == size[j]
    out = same & (differ.sum(1) == 1)
    for rows in (np.flatnonzero(size[i] == size[j] + 1),):
        first = np.argmax(differ[rows], 1)
        shifted = x[rows, 1:] != y[rows, :-1]
        last = np.where(shifted.any(1), shifted.shape[1] - 1 - np.argmax(shifted[:, ::-1], 1), -1)
        out[rows] = last < first
    return out


def _pairs(cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within groups of consecutive rows, about PAIRS_AT_ONCE at once."""
    size = np.diff(cuts)
    end = np.repeat(cuts[1:], size)
    row = np.arange(cuts[-1])
    left = end - row - 1  # partners after each row
    upto = np.concatenate(([0], np.cumsum(left)))
    k = 0
    while k < len(row):
        to = max(k + 1, int(np.searchsorted(upto, upto[k] + PAIRS_AT_ONCE, "right")) - 1)
        i = np.repeat(row[k:to], left[k:to])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[k:to] - upto[k], left[k:to])
        k = to


def _verified(table: pa.Table, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart within the groups of equal marks."""
    cuts = np.concatenate(([0], np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1, [len(marks)]))
    asks, own = table.column("asks").to_numpy(zero_copy_only=False), table.column("own").to_numpy()
    split = marks[:, 1] != marks[:, 2]
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    size = np.array([len(w) for w in words], np.int64)
    m = np.array([w[:WIDTH] for w in words], f"S{WIDTH}").view(np.uint8).reshape(len(words), WIDTH)
    n = table.column("n").to_numpy()
    for i, j in _pairs(cuts):
        meet = ~(asks[i] & asks[j]) & (~split[i] | (own[i] != own[j])) & (np.abs(size[i] - size[j]) <= 1)
        i, j = i[meet], j[meet]
        short = (size[i] <= WIDTH) & (size[j] <= WIDTH)
        good = np.zeros(len(i), bool)
        good[short] = _near(m, size, i[short], j[short])
        for k in np.flatnonzero(~short):
            good[k] = one_edit(words[i[k]].decode("latin-1"), words[j[k]].decode("latin-1"))
        i, j = i[good], j[good]
        if len(i):
            column = table.column("word").combine_chunks()
            yield pa.record_batch({"x": column.take(pa.array(i)), "x_n": pa.array(n[i]), "y": column.take(pa.array(j)), "y_n": pa.array(n[j])})


def near_pairs(words: DataFrame) -> DataFrame:
    """(x, x_n, y, y_n) with x before y: each pair of words one edit apart, once."""
    rows = stored(lists(words, frequent_grams(words)), "gram-lists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def marks(table: pa.Table) -> np.ndarray:
            return np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
            all_marks = marks(table)
            n = int(np.flatnonzero((all_marks != all_marks[-1]).any(1))[-1]) + 1 if (all_marks != all_marks[-1]).any() else 0
            held = table.slice(n)
            if n:
                yield from _verified(table.slice(0, n), all_marks[:n])
        if held is not None:
            yield from _verified(held, marks(held))

    grouped = _dealt(rows).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    found = grouped.mapInArrow(freed(run), "x string, x_n long, y string, y_n long")
    first = F.col("x") < F.col("y")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b)).alias(a)
    second = lambda a, b: F.when(first, F.col(b)).otherwise(F.col(a)).alias(b)
    return found.select(pick("x", "y"), pick("x_n", "y_n"), second("x", "y"), second("x_n", "y_n")).distinct()


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per word: form, n_near, form_n. The form is the near word of largest n (ties: the smallest) if that is at least twice the word's."""
    sides = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("near_n")), F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("x_n").alias("near_n")))
    best = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    far = -F.col("best.less") >= 2 * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.when(far, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, -F.col("best.less")).alias("form_n"))


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of words with a form: pointers are doubled until none moves. A form has twice the count, so chains are short."""
    at = stored(linked.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, n, form, root, n_near, form_n for every word of the vocabulary; see the module for the rules."""
    words = stored(vocabulary(docs), "vocabulary")
    linked = stored(forms(words, near_pairs(words)), "forms")
    found = linked.join(roots(linked), "word", "left")
    return found.select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
