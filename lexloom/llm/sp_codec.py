"""SentencePiece encoding by a max-plus scan, and decoding.

A text becomes the segmentation into vocabulary pieces of the largest sum of scores (the unigram reading
of a vocabulary; a BPE vocabulary's scores are its merge ranks). A character outside the vocabulary costs
the unknown score and becomes its UTF-8 byte pieces. Among equal sums the last piece is as long as can
be, then the one before it, and so on, within a chunk.

Giant texts are cut into chunks of CHUNK characters anywhere. A piece may reach over a cut by fewer
characters than the longest piece has, so a chunk is a matrix of the best sums from each overhang at its
start to each at its end; matrices combine associatively under (max, +), first within groups of GROUP
chunks, then over the groups of a text. The best path fixes the overhang at every cut, and every chunk
is then traced back on its own. Where all pieces keep spaces to their front, each distinct word is scored
once, many words side by side, and looked up; a chunk's matrix then only depends on its first and last
words and one number.

Decoding joins the pieces' bytes and drops the space put before the text. A text with the piece sign for
a space in it decodes to a space there, as in the format itself; every other text comes back whole.

Null or empty text has no ids and decodes to empty text. A null doc_id is encoded like any other,
repeated rows each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import stored

CHUNK, GROUP, CACHE_WORDS = 32_768, 64, 300_000
#: Words of up to SHORT_WORD[-1] characters are scored side by side, those of about one length, BLOCK characters at once.
SHORT_WORD, BLOCK = (8, 12, 20, 48), 1 << 18
#: Texts, and chunks of long texts, whose new words are scored together.
TEXTS, CHUNKS = 1024, 32
#: Chunks of a long text that are cut together.
SLICES = 64
SPACE = "▁"
LOW = -np.inf


class Vocabulary:
    """Pieces and scores of a model file; encodes words with a memory of the last CACHE_WORDS distinct ones."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        self.bytes = [b""] * n
        byte_id = {}
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.score[piece], self.id[piece] = m.get_score(i), i
                self.bytes[i] = piece.replace(SPACE, " ").encode()
        self.unknown = min(self.score.values()) - 10
        self.byte_ids = [byte_id.get(b, m.unk_id()) for b in range(256)]
        self.longest = max(map(len, self.score))
        self.heads = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
        self.front = all(SPACE not in p[1:] or not p.strip(SPACE) for p in self.score)
        self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if self.front else r"(?s).+")
        self.memory: dict[str, bytes] = {}
        self.sums: dict[str, float] = {}
        self.bad: set[str] = set()  # words in memory that don't decode to themselves
        self._trie()

    def _trie(self) -> None:
        """The prefixes of pieces as numbered nodes: steps by (node, character), and the piece that ends at each."""
        prefixes = sorted(self.heads)
        node = {p: i for i, p in enumerate(prefixes)}
        self.chars = np.unique(np.array([ord(p[-1]) for p in prefixes], np.int64))
        wide = len(self.chars) + 1  # the last class: a character of no piece
        last = np.searchsorted(self.chars, np.array([ord(p[-1]) for p in prefixes], np.int64))
        self.root = np.full(wide, -1, np.int64)
        inner = np.array([len(p) > 1 for p in prefixes], bool)
        self.root[last[~inner]] = np.flatnonzero(~inner)
        key = np.array([node[p[:-1]] for p in prefixes if len(p) > 1], np.int64) * wide + last[inner]
        order = np.argsort(key)
        self.step_key, self.step_to = key[order], np.flatnonzero(inner)[order]
        self.node_score = np.array([self.score.get(p, LOW) for p in prefixes])
        self.node_id = np.array([self.id.get(p, -1) for p in prefixes], np.int64)

    def _step(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        key = node * (len(self.chars) + 1) + kind
        at = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        return np.where(self.step_key[at] == key, self.step_to[at], -1)

    def _side_by_side(self, kind: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """forward() and the trace of words, a row each: ids in order, their number, sums, and which rows need no unknown character."""
        n, width = kind.shape
        best, back, via = np.full((n, width + 1), LOW), np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
        best[:, 0] = 0.0
        for i in range(width):
            reached = np.flatnonzero((best[:, i] > LOW) & (length > i))
            here, rows, node = best[:, i], reached, self.root[kind[reached, i]]
            single = np.zeros(n, bool)
            for j in range(i + 1, min(width, i + self.longest) + 1):
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                value = here[rows] + self.node_score[node]
                if j == i + 1:
                    single[rows] = self.node_score[node] > LOW
                better = value > best[rows, j]
                at = rows[better]
                best[at, j], back[at, j], via[at, j] = value[better], i, node[better]
                if j < width:
                    node = self._step(node, kind[rows, j])
            rows = reached[~single[reached]]
            rows = rows[here[rows] + self.unknown > best[rows, i + 1]]
            best[rows, i + 1], back[rows, i + 1], via[rows, i + 1] = here[rows] + self.unknown, i, -1
        ids, count, known = np.zeros((n, width), np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
        rows, end = np.arange(n), length
        while len(rows):
            node = via[rows, end]
            known[rows[node < 0]] = False
            count[rows] += 1
            ids[rows, width - count[rows]] = np.where(node < 0, 0, self.node_id[node])
            end = back[rows, end]
            rows, end = rows[end > 0], end[end > 0]
        return ids[np.arange(width) >= (width - count)[:, None]], count, best[np.arange(n), length], known

    def learn(self, words: set[str]) -> None:
        """Takes the words into memory that aren't there, but for long ones."""
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > CACHE_WORDS:
            self.memory.clear()
            self.sums.clear()
            self.bad.clear()
            new = list(words)
        groups: list[list[str]] = [[] for _ in range(len(SHORT_WORD) + 1)]
        for w in new:
            groups[bisect_left(SHORT_WORD, len(w))].append(w)
        for width, group in zip(SHORT_WORD, groups, strict=False):
            step = max(1, BLOCK // width)
            for k in range(0, len(group), step):
                some = group[k : k + step]
                length, text = np.array([len(w) for w in some]), "".join(some)
                code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
                place = np.minimum(np.searchsorted(self.chars, code), len(self.chars) - 1)
                kind = np.full((len(some), width), len(self.chars))
                kind[np.arange(width) < length[:, None]] = np.where(self.chars[place] == code, place, len(self.chars))
                ids, count, total, known = self._side_by_side(kind, length)
                raw, at = ids.astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(4 * count))).tolist()
                self.memory.update(zip(some, [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
                self.sums.update(zip(some, total.tolist(), strict=True))
                doubtful = [some[i] for i in np.flatnonzero(~known)]  # byte pieces stand for an unknown character
                for w in doubtful:
                    self.memory[w] = self.word(w)[0]
                good = np.repeat(known, count)
                if self.decode(ids[good].astype("<u4").tobytes()) != "".join([some[i] for i in np.flatnonzero(known)]).replace(SPACE, " ").encode():
                    doubtful = some
                self.bad.update(w for w in doubtful if self.decode(self.memory[w]) != w.replace(SPACE, " ").encode())

    def forward(self, s: str, limit: int | None = None) -> tuple[list[float], list[int]]:
        """Best sum to each position from 0 by pieces that start before limit, and where the last piece starts."""
        n = len(s)
        best, back, score, heads = [LOW] * (n + 1), [-1] * (n + 1), self.score, self.heads
        best[0] = 0.0
        for i in range(n if limit is None else min(limit, n)):
            here = best[i]
            if here == LOW:
                continue
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = s[i:j]
                if piece not in heads:
                    break
                value = score.get(piece)
                if value is not None:
                    single |= j == i + 1
                    if here + value > best[j]:
                        best[j], back[j] = here + value, i
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def _trace(self, s: str, back: list[int], end: int) -> bytes:
        ids: list[int] = []
        while end > 0:
            piece = s[back[end] : end]
            one = self.id.get(piece)
            ids += [one] if one is not None else [self.byte_ids[b] for b in reversed(piece.encode())]
            end = back[end]
        return np.array(ids[::-1], "<u4").tobytes()

    def word(self, s: str) -> tuple[bytes, float]:
        best, back = self.forward(s)
        return self._trace(s, back, len(s)), best[-1]

    def encode_many(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of escaped texts, packed as little-endian unsigned 32-bit numbers, and whether they decode to the texts."""
        split = [self.units.findall(s) for s in texts]
        self.learn(set().union(*split))
        get, ids, whole = self.memory.get, [], []
        for words in split:
            good = not self.bad or self.bad.isdisjoint(words)
            try:
                ids.append(b"".join(map(get, words)))
            except TypeError:  # a word too long for the memory
                got = [get(w) or self.word(w)[0] for w in words]
                good &= all(self.decode(g) == w.replace(SPACE, " ").encode() for w, g in zip(words, got, strict=True) if w not in self.memory)
                ids.append(b"".join(got))
            whole.append(good)
        return ids, whole

    def encode(self, s: str) -> bytes:
        return self.encode_many([s])[0][0]

    def cuts(self, s: str, n: int) -> tuple[int, int] | None:
        """First and last place, with longest - 1 <= first <= last <= n, that no piece crosses."""
        if not self.front:
            return None
        places = [m.start() for m in re.finditer(f"(?<=[^{SPACE}]){SPACE}", s) if self.longest - 1 <= m.start() <= n]
        return (places[0], places[-1]) if places else None

    def learn_chunks(self, chunks: list[str], sizes: list[int]) -> None:
        """Takes the inner words of chunks into memory."""
        inner = [(s, cut) for s, n in zip(chunks, sizes, strict=True) if (cut := self.cuts(s, n))]
        self.learn(set().union(*(self.units.findall(s[a:b]) for s, (a, b) in inner)))

    def matrix(self, s: str, n: int) -> np.ndarray:
        """Best sums of a chunk of n characters (s holds what can reach over its end), by overhang at its start and end."""
        m, size = np.full((self.longest, self.longest), LOW), self.longest
        cut = self.cuts(s, n)
        if cut:
            first, last = cut
            words = self.units.findall(s[first:last])
            middle = sum(self.sums[w] if w in self.sums else self.word(w)[1] for w in words)
            tail = self.forward(s[last:], n - last)[0]
            end = [0.0] if last == n else tail[n - last :][:size]
            for i in range(min(size, first + 1)):
                m[i, : len(end)] = self.forward(s[i:first])[0][-1] + middle + np.array(end)
            return m
        for i in range(min(size, n + 1)):
            got = [0.0] if i == n else self.forward(s[i:], n - i)[0][n - i :][:size]
            m[i, : len(got)] = got
        return m

    def part(self, s: str, n: int, enter: int, leave: int) -> bytes:
        """Ids of the pieces that start in a chunk, between the overhangs that the scan fixed."""
        cut = self.cuts(s, n)
        if not cut:
            return self._trace(s[enter : n + leave], self.forward(s[enter : n + leave], n - enter)[1], n + leave - enter)
        first, last = cut
        head = self._trace(s[enter:first], self.forward(s[enter:first])[1], first - enter)
        tail = self._trace(s[last : n + leave], self.forward(s[last : n + leave], n - last)[1], n + leave - last)
        return head + self.encode(s[first:last]) + tail

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids, the space before the text included."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def path(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """Overhangs enter, ..., leave at the cuts around the matrices on the best path; among equals the smallest."""
    ahead = [np.where(np.arange(len(matrices[0])) == enter, 0.0, LOW)]
    for m in matrices:
        ahead.append((ahead[-1][:, None] + m).max(0))
    out = [leave]
    for m, v in zip(reversed(matrices), reversed(ahead[:-1]), strict=True):
        out.append(int(np.argmax(v + m[:, out[-1]])))
    return out[::-1]


PARTS = "doc_id long, part long, n_parts long, ids binary, whole boolean"


def _short(docs: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), TEXTS):
                # a text that holds the sign for a space decodes to a space there
                ids, whole = v.encode_many([escaped(x or "") for x in texts[i : i + TEXTS]])
                whole = [w and SPACE not in (x or "") for w, x in zip(whole, texts[i : i + TEXTS], strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), pa.array([0] * n), pa.array([1] * n), pa.array(ids, pa.binary()), pa.array(whole)], names=["doc_id", "part", "n_parts", "ids", "whole"])

    return docs.mapInArrow(run, PARTS)


def _sliced(chunk: int, longest: int):
    """Chunks of escaped texts, each with the longest - 1 characters after it: one pass over a text, a slice at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                size = len(text) + 1  # a sign for a space comes first
                parts = -(-size // chunk)
                for first in range(0, parts, SLICES):
                    some = range(first, min(parts, first + SLICES))
                    slices = [(SPACE if i == 0 else "") + text[max(0, i * chunk - 1) : (i + 1) * chunk + longest - 2].replace(" ", SPACE) for i in some]
                    n = len(slices)
                    columns = [pa.array([key.as_py()] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array([parts] * n, pa.int64()), pa.array(list(some), pa.int64()), pa.array(slices), pa.array([min(len(x), chunk) for x in slices], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n_parts", "part", "s", "n"])

    return run


def _long(docs: DataFrame, model: str, chunk: int, group: int) -> DataFrame:
    longest = vocabulary(model).longest
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(_sliced(chunk, longest), "key long, doc_id long, n_parts long, part long, s string, n int")
    rows = stored(rows.select("key", "doc_id", "n_parts", "part", "s", "n"), "chunks")  # the key has to stay

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for some in (batch.slice(i, CHUNKS) for i in range(0, batch.num_rows, CHUNKS)):
                chunks, sizes = some.column(2).to_pylist(), some.column(3).to_pylist()
                v.learn_chunks(chunks, sizes)
                m = [v.matrix(s, n).tobytes() for s, n in zip(chunks, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(m, pa.binary())], names=["key", "part", "m"])

    scored = stored(rows.select("key", "part", "s", "n").mapInArrow(matrices, "key long, part long, m binary").withColumn("g", F.expr(f"part div {group}")), "matrices")
    square = lambda column: [np.frombuffer(x).reshape(longest, longest) for x in column]

    def combined(rows: pd.DataFrame) -> pd.DataFrame:
        ms = square(rows.sort_values("part")["m"])
        total = ms[0]
        for m in ms[1:]:
            total = product(total, m)
        return pd.DataFrame({"key": rows["key"].iloc[:1], "g": rows["g"].iloc[:1], "m": [total.tobytes()]})

    def between(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("g")
        at = path(square(rows["m"]), 0, 0)
        return pd.DataFrame({"key": rows["key"].to_numpy(), "g": rows["g"].to_numpy(), "enter": at[:-1], "leave": at[1:]})

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        at = path(square(rows["m"]), int(rows["enter"].iloc[0]), int(rows["leave"].iloc[0]))
        return pd.DataFrame({"key": rows["key"].to_numpy(), "part": rows["part"].to_numpy(), "enter": at[:-1], "leave": at[1:]})

    groups = scored.groupBy("key", "g").applyInPandas(combined, "key long, g long, m binary")
    ends = groups.groupBy("key").applyInPandas(between, "key long, g long, enter int, leave int")
    cuts = scored.join(ends, ["key", "g"]).groupBy("key", "g").applyInPandas(within, "key long, part long, enter int, leave int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for some in (batch.slice(i, CHUNKS) for i in range(0, batch.num_rows, CHUNKS)):
                c = {n: some.column(i).to_pylist() for i, n in enumerate(some.schema.names)}
                v.learn_chunks(c["s"], c["n"])
                ids = [v.part(s, n, a, b) for s, n, a, b in zip(c["s"], c["n"], c["enter"], c["leave"], strict=True)]
                whole = [v.decode(p) == s[a : n + b].replace(SPACE, " ").encode() for p, s, n, a, b in zip(ids, c["s"], c["n"], c["enter"], c["leave"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c["key"]), pa.array(c["doc_id"], pa.int64()), pa.array(c["part"]), pa.array(c["n_parts"]), pa.array(ids, pa.binary()), pa.array(whole)], names=["key", "doc_id", "part", "n_parts", "ids", "whole"])

    meet = rows.join(cuts, ["key", "part"])
    return meet.select("key", "doc_id", "n_parts", "part", "s", "n", "enter", "leave").mapInArrow(trace, "key long, " + PARTS)


def _split(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Texts shorter than a chunk, and the others."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    long = F.coalesce(F.length("text") >= chunk, F.lit(False))
    return rows.filter(~long), rows.filter(long)


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """key, doc_id, part, n_parts, ids (packed), whole: parts in order make a text's ids; key tells long texts apart.

    whole: the part decodes to the very characters it stands for (of a long text: once the sign for a space is one).
    """
    short, long = _split(docs, chunk)
    parts = _short(short, model).withColumn("key", F.lit(None).cast("long"))
    return parts.select("key", "doc_id", "part", "n_parts", "ids", "whole").unionAll(_long(long, model, chunk, group))


def encode_texts(docs: DataFrame, model: str, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """doc_id, n_parts, ids, whole of each text; only the parts of long texts meet in a shuffle."""
    short, long = _split(docs, chunk)
    many = _long(long, model, chunk, group).groupBy("key", "doc_id", "n_parts").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p"), F.bool_and("whole").alias("whole"))
    many = many.select("doc_id", "n_parts", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"), "whole")
    return _short(short, model).select("doc_id", "n_parts", "ids", "whole").unionAll(many)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with packed ids of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = [v.decode(x or b"")[1:].decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
