"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, for perplexity.

A word follows in the context restaurant of the word before it; all context restaurants share one
parent, whose base measure is even over the known words and gives UNKNOWN of its mass to the event
"a word not in training". Every word before has its own restaurant. Restaurants lie in buckets by the
hash of their word, so the totals of one are those of its row; the few of many customers (HOT_TOKENS) are
dealt over buckets by the word that follows, and their totals are a short vector. The parent lies in parts
by word.

A Gibbs sweep is a pass over buckets. All customers of a word in a restaurant are one block: the number of
its tables is drawn from its conditional given the other words' tables, which generalised Stirling numbers
give exactly for up to EXACT customers; of larger blocks it is the limit of that, or, where most customers open a
table, they are seated forward. Blocks are drawn side by side given the totals of the last sweep. The new tables of each word go to its part, the parent is seated,
and its counts go back to the buckets. Sweeps after BURN_IN each give a sample; predictive probabilities are
averaged over them.

Texts are read twice, once for the counts of (context, word) pairs and once to be scored. Both times a task
deals the distinct pairs of its chunks of text to the buckets as packed arrays, so a hot pair costs one entry
a chunk; the second time with the place of each token's document, and a bucket returns sums by document. No
text or token is stored or sent. A table of frequent words, from SAMPLE_DOCS sampled documents, shortens the
packed arrays and tells which restaurants are hot; it changes no result but which draws a seed gives.

The documents must come in the same partitions and order when read again, as those of a table do.

Null or empty text is one end token. A null doc_id is scored, and held out like the text "null".
Repeated rows are counted and scored each. With no training document at all every token is unknown.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexloom.llm.common import U, freed, mix, slices, stored, words
from lexloom.llm.toxicity import held_out as in_part

BURN_IN, SAMPLES, SEED = 2, 3, 7
DISCOUNT, STRENGTH = (0.8, 0.75), (1.0, 1.0)  # of the context restaurants, of their parent
UNKNOWN = 0.5
#: Customers up to which a block is drawn from its exact conditional.
EXACT = 128
#: Bytes of text in a chunk, at about which a chunk ends, and for which there is a bucket.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Estimated customers from which a context is dealt over buckets, one for each as many.
HOT_TOKENS = 1 << 20
#: Documents (expected number) and words of the table of frequent words.
SAMPLE_DOCS, FREQUENT = 4000, 1 << 16
END = 0xE4D0E4D0E4D0E4D1


def _pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes: small numbers and sorted hashes shrink."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b"")


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b) or bytearray(), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class Codes:
    """Packs sorted distinct word hashes; those of a table of frequent words take a byte or so."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def pack(self, x: np.ndarray) -> bytes:
        at = np.minimum(np.searchsorted(self.table, x), max(len(self.table) - 1, 0))
        known = self.table[at] == x if len(self.table) else np.zeros(len(x), bool)
        codes = _pack(np.diff(at[known], prepend=0).astype(np.uint16))
        return len(codes).to_bytes(8, "little") + codes + _pack(x[~known])

    def unpack(self, b: bytes) -> np.ndarray:
        n = 8 + int.from_bytes(b[:8], "little")
        codes = np.cumsum(_unpack(b[8:n], np.uint16).astype(np.int64))
        return np.sort(np.concatenate((self.table[codes], _unpack(b[n:], np.uint64))), kind="stable")


def _frequent(docs: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words of a sample, sorted, and their shares of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in slices(batch.column(0)):
                hashed, word_at, _, _ = words(data, at)
                known, n = np.unique(np.insert(hashed, word_at[1:], U(END)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(n)], names=["word", "n"])

    some = docs.select(F.col("text").cast("string")).sample(min(1.0, SAMPLE_DOCS / max(n_docs, 1)), SEED)
    counts = some.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    top = counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "word").limit(FREQUENT).select("word", "share").toArrow()  # FREQUENT rows
    table = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(table)
    return table[order], top.column("share").to_numpy()[order]


def _columns(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, of n even ones, of each hash; in the order of hashes."""
    return np.searchsorted(np.array([(b << 64) // n for b in range(1, n)], np.uint64), hashes, "right")


def _dealt(vocabulary: np.ndarray, tokens: np.ndarray, buckets: int, hot: dict[int, int]):
    """Distinct pairs by bucket (context, word as places; edges of buckets), and for each token the place of its pair there."""
    end = np.searchsorted(vocabulary, U(END))  # before the first word stands an end
    pairs = np.concatenate(([end], tokens[:-1])).astype(np.int64) * len(vocabulary) + tokens
    known, back = np.unique(pairs, return_inverse=True)
    context, word = known // len(vocabulary), known % len(vocabulary)
    bucket, parts = _ranges(vocabulary, buckets), np.array([hot.get(int(x), 1) for x in vocabulary] if hot else np.ones(len(vocabulary)), np.uint64)
    split = np.flatnonzero(parts[context] > 1)
    bucket = bucket[context]
    bucket[split] = (bucket[split] + (mix(vocabulary[word[split]]) % parts[context[split]]).astype(np.int64)) % buckets
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return context[order], word[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[back]


def _steps(follows: np.ndarray, at: np.ndarray) -> bytes:
    """Packed places in ascending order within each context: as steps."""
    d = np.diff(follows, prepend=0)
    first = at[:-1][np.diff(at) > 0]
    d[first] = follows[first]
    return _pack(d.astype(np.uint32))


def _follows(steps: bytes, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(_unpack(steps, np.uint32).astype(np.int64))))
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at))


def _at(sizes: bytes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(_unpack(sizes, np.uint32).astype(np.int64))))


DEALT = "bucket long, chunk string, contexts binary, sizes binary, words binary, follows binary, counts binary, docs binary, meta binary"


def dealt(docs: DataFrame, held: Column, buckets: int, hot: dict[int, int], codes: Codes, scored: bool) -> DataFrame:
    """For each chunk and bucket its pairs: contexts, sizes (pairs of each), words, follows (places in words), counts.

    Counts are of training tokens. scored: of all tokens, docs has the place of each token's document, by
    pair, and meta, in a chunk's first row, doc_ids, which of them are null, which are held out, and lengths.
    """

    def give(chunk: str, ids: list, kept: list) -> pa.RecordBatch:
        known, tokens = np.unique(np.concatenate([t for t, _, _ in kept]), return_inverse=True)
        lengths, out = np.concatenate([n for _, n, _ in kept]), np.concatenate([h for _, _, h in kept])
        context, word, edges, place = _dealt(known, tokens, buckets, hot)
        of_token = np.repeat(np.arange(len(lengths)), lengths)
        if scored:
            count = np.bincount(place, minlength=len(context)).astype(np.uint32)
            of_token, token_at = of_token[np.argsort(place, kind="stable")], np.concatenate(([0], np.cumsum(count.astype(np.int64))))
            doc_ids = pa.concat_arrays(ids)
            null = doc_ids.is_null().to_numpy(zero_copy_only=False)
            meta = _pack(np.concatenate((doc_ids.fill_null(0).to_numpy(), null, out, lengths)).astype(np.int64))
        else:
            count = np.bincount(place, ~out[of_token], len(context)).astype(np.uint32)
        rows = []
        for b in np.flatnonzero(np.diff(edges)):
            s = slice(edges[b], edges[b + 1])
            contexts, at = np.unique(context[s], return_index=True)
            at = np.append(at, s.stop - s.start)
            own, follows = np.unique(word[s], return_inverse=True)
            more = (_pack(of_token[token_at[s.start] : token_at[s.stop]].astype(np.uint32)), None if rows else meta) if scored else (None, None)
            rows.append((int(b), chunk, codes.pack(known[contexts]), _pack(np.diff(at).astype(np.uint32)), codes.pack(known[own]), _steps(follows, at), _pack(count[s]), *more))
        return _rows(rows, DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, kept, size, k, part = [], [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, j, data, at in slices(batch.column(1)):
                hashed, word_at, _, _ = words(data, at)
                ids.append(batch.column(0).slice(i, j - i))
                kept.append((np.insert(hashed, word_at[1:], U(END)), np.diff(word_at) + 1, batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)))
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield give(f"{part}-{k}", ids, kept)
                    ids, kept, size, k = [], [], 0, k + 1
        if kept:
            yield give(f"{part}-{k}", ids, kept)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held.alias("held")).mapInArrow(freed(run), DEALT)


def gathered(rows: DataFrame, hot: dict[int, int], codes: Codes) -> DataFrame:
    """The training pairs of a bucket in the form of dealt(), with customers, all words that follow in it, and the number of each context among the hot ones (or -1)."""
    numbers = {c: i for i, c in enumerate(sorted(hot))}

    def merge(rows: pa.Table) -> pa.Table:
        parts, known = [], []
        for contexts, sizes, words_, follows, count in zip(*(rows.column(c).to_pylist() for c in ("contexts", "sizes", "words", "follows", "counts")), strict=True):
            count, at, own = _unpack(count, np.uint32), _at(sizes), codes.unpack(words_)
            context, word = np.repeat(codes.unpack(contexts), np.diff(at)), own[_follows(follows, at)]
            parts.append((context[count > 0], word[count > 0], count[count > 0]))
            known.append(own)
        known = np.unique(np.concatenate(known))
        context, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        contexts, context = np.unique(context, return_inverse=True)
        pair, back = np.unique(context * len(known) + np.searchsorted(known, word), return_inverse=True)
        count, context = np.bincount(back, count, len(pair)).astype(np.int64), pair // len(known)
        at = np.searchsorted(context, np.arange(len(contexts) + 1))
        number = np.array([numbers.get(int(c), -1) for c in contexts], np.int64)
        out = [codes.pack(contexts), _pack(np.diff(at).astype(np.uint32)), codes.pack(known), _steps(pair % len(known), at), _pack(count), _pack(number)]
        return pa.table([pa.array([rows.column("bucket")[0].as_py()]), *[pa.array([x], pa.binary()) for x in out]], names=["bucket", "contexts", "sizes", "words", "follows", "customers", "number"])

    return rows.groupBy("bucket").applyInArrow(merge, "bucket long, contexts binary, sizes binary, words binary, follows binary, customers binary, number binary")


def _stirling(discount: float) -> np.ndarray:
    """log S(n, t), the generalised Stirling numbers: the weight of n customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for n in range(EXACT):
        out[n + 1, 1:] = out[n, :-1]
        t = np.arange(1, n + 1)
        out[n + 1, 1 : n + 1] = np.logaddexp(out[n + 1, 1 : n + 1], out[n, 1 : n + 1] + np.log(n - t * discount))
    return out


_STIRLING = {d: _stirling(d) for d in set(DISCOUNT)}


def _seat(rng: np.random.Generator, customers: np.ndarray, share: np.ndarray, discount: float, strength: float, others: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn given its customers, the parent's share of it, and the tables of the other dishes.

    t tables of n customers weigh S(n, t) * share ** t * product of (strength + discount * (others + i)), i < t. As n
    grows S(n, t) goes as 1 / (gamma(t) * discount ** t), so that t - 1 has a Poisson distribution.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some], kind="stable")]
    for block in np.split(some, np.flatnonzero(np.diff(customers[some])) + 1) if len(some) else []:
        n = int(customers[block[0]])
        for part in np.array_split(block, len(block) * n // (1 << 20) + 1):
            new = np.log(strength + discount * (others[part, None] + np.arange(n)))
            weight = _STIRLING[discount][n, 1 : n + 1] + np.cumsum(new + np.log(share[part])[:, None], 1)
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            tables[part] = 1 + (weight < rng.random(len(part))[:, None] * weight[:, -1:]).sum(1)
    large = np.flatnonzero(customers > EXACT)
    rate = (strength + discount * others[large]) * share[large] / discount
    few = rate <= customers[large] / 2
    tables[large[few]] += np.minimum(rng.poisson(rate[few]), customers[large[few]] - 1)
    seated, open_ = tables.copy(), large[~few]
    while len(open_):  # most customers open a table: forward, a run of customers at once
        run = np.maximum(1, np.minimum(customers[open_] - seated[open_], seated[open_] // 8))
        new = (strength + discount * (others[open_] + tables[open_])) * share[open_]
        chance = np.clip(new / (new + np.maximum(seated[open_] - discount * tables[open_], 1e-9)), 0, 1)
        tables[open_] += rng.binomial(run, chance)
        seated[open_] += run
        open_ = open_[seated[open_] < customers[open_]]
    return tables


def _per_context(at: np.ndarray, x: np.ndarray, number: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Sums of x by context; those of hot contexts are given."""
    own = np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    return np.where(number >= 0, hot[number], own) if len(hot) else own


def _of_hot(at: np.ndarray, x: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    own = np.diff(np.concatenate(([0], np.cumsum(x)))[at])
    return np.bincount(number[number >= 0], own[number >= 0], n).astype(float)


SEATS = "bucket long, part long, tables binary, given binary, counts binary, sums binary"


def _seats(bucket: int, tables: np.ndarray, follows: np.ndarray, word_at: np.ndarray, customers: np.ndarray | None, sums: np.ndarray) -> list[tuple]:
    """Rows of SEATS: tables and sums in the first, and each word's tables (and customers) to the word's part."""
    given = np.bincount(follows, tables, word_at[-1]).astype(np.int64)
    count = None if customers is None else np.bincount(follows, customers, word_at[-1]).astype(np.int64)
    return [(bucket, -1, _pack(tables), None, None, sums.tobytes())] + [(bucket, p, None, _pack(given[i:j]), None if count is None else _pack(count[i:j]), None) for p, (i, j) in enumerate(zip(word_at[:-1], word_at[1:], strict=True)) if j > i]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


def _word_at(words_: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(_ranges(words_, parts), np.arange(parts + 1))


def sweep(state: DataFrame, seats: DataFrame | None, parents: DataFrame | None, totals: dict, parts: int, codes: Codes, seed: int) -> DataFrame:
    """SEATS after one Gibbs sweep given the last totals; without seats one table for each pair."""
    hot, opening = totals["hot_tables"], parents is None
    now = state.select("bucket", "sizes", "follows", "customers", "number", *(["words"] if opening else []))
    if not opening:
        back = parents.filter("bucket >= 0").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", "c0", "top"))).alias("back"))
        now = now.join(seats.filter("part = -1").select("bucket", "tables"), "bucket").join(back, "bucket", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at, customers, number = _at(r["sizes"]), _unpack(r["customers"], np.int64), _unpack(r["number"], np.int64)
                follows = _follows(r["follows"], at)
                if opening:
                    tables = np.minimum(customers, 1)
                    sums = np.concatenate((_of_hot(at, tables, number, len(hot)), _of_hot(at, customers, number, len(hot))))
                    yield _rows(_seats(r["bucket"], tables, follows, _word_at(codes.unpack(r["words"]), parts), customers, sums), SEATS)
                    continue
                rng = np.random.default_rng((SEED, seed, r["bucket"]))
                got = {x["part"]: (_unpack(x["c0"], np.int64), _unpack(x["top"], np.int64)) for x in r["back"] or ()}
                word_at = np.concatenate(([0], np.cumsum([len(got[p][0]) if p in got else 0 for p in range(parts)])))
                c0, top = (np.concatenate([np.zeros(0, np.int64), *[got[p][i] for p in sorted(got)]]) for i in (0, 1))
                old = _unpack(r["tables"], np.int64)
                others = np.repeat(_per_context(at, old, number, hot), np.diff(at)) - old
                tables = _seat(rng, customers, _share(c0, top, totals)[follows], DISCOUNT[0], STRENGTH[0], others)
                yield _rows(_seats(r["bucket"], tables, follows, word_at, None, _of_hot(at, tables, number, len(hot))), SEATS)

    return now.mapInArrow(run, SEATS)


def _share(c0: np.ndarray, top: np.ndarray, totals: dict) -> np.ndarray:
    """The parent's probability of each of its words; of one that isn't in training, that of any such word."""
    base = np.where(c0 > 0, (1 - UNKNOWN) / max(totals["types"], 1), UNKNOWN)
    return (np.maximum(c0 - DISCOUNT[1] * top, 0) + (STRENGTH[1] + DISCOUNT[1] * totals["tables0"]) * base) / (STRENGTH[1] + totals["customers0"])


def listed(state: DataFrame, parts: int, codes: Codes) -> DataFrame:
    """(part, words, buckets, places): the words of a part, and for each bucket the steps between its words' places there."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, known in zip(*_columns(batch), strict=True):
                known = codes.unpack(known)
                at = _word_at(known, parts)
                yield _rows([(p, bucket, _pack(known[at[p] : at[p + 1]])) for p in range(parts) if at[p + 1] > at[p]], "part long, bucket long, words binary")

    def merge(rows: pa.Table) -> pa.Table:
        own = [_unpack(w, np.uint64) for w in rows.column("words").to_pylist()]
        known = np.unique(np.concatenate(own))
        places = [_pack(np.diff(np.searchsorted(known, w), prepend=0).astype(np.uint32)) for w in own]
        return pa.table([pa.array([rows.column("part")[0].as_py()]), pa.array([_pack(known)]), pa.array([rows.column("bucket").to_pylist()]), pa.array([places], pa.list_(pa.binary()))], names=["part", "words", "buckets", "places"])

    cut = state.select("bucket", "words").mapInArrow(split, "part long, bucket long, words binary")
    return cut.groupBy("part").applyInArrow(merge, "part long, words binary, buckets array<long>, places array<binary>")


PARENTS = "part long, bucket long, c0 binary, top binary, counts binary, sums binary"


def parent(seats: DataFrame, lists: DataFrame, totals: dict, seed: int | None) -> DataFrame:
    """PARENTS: the sums of a part (bucket -1), and the parent's customers and tables of the words of each bucket.

    Without seed each word in training has one table, and counts are the words' training tokens.
    """

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = key[0].as_py()
        n = len(_unpack(right.column("words")[0].as_py(), np.uint64))
        at = {b: np.cumsum(_unpack(x, np.uint32).astype(np.int64)) for b, x in zip(right.column("buckets")[0].as_py(), right.column("places")[0].as_py(), strict=True)}
        c0, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for bucket, given, counts in zip(*(left.column(c).to_pylist() for c in ("bucket", "given", "counts")), strict=True):
            c0[at[bucket]] += _unpack(given, np.int64)
            if counts is not None:
                count[at[bucket]] += _unpack(counts, np.int64)
        if seed is None:
            top = np.minimum(c0, 1)
        else:
            rng = np.random.default_rng((SEED, seed, 1, part))
            top = _seat(rng, c0, np.full(n, (1 - UNKNOWN) / max(totals["types"], 1)), DISCOUNT[1], STRENGTH[1], totals["tables0"] - np.minimum(c0, 1))
        sums = np.array([c0.sum(), top.sum(), (c0 > 0).sum(), count.sum()], float)
        rows = [(part, -1, None, None, None, sums.tobytes())]
        rows += [(part, b, _pack(c0[i]), _pack(top[i]), _pack(count[i]) if seed is None else None, None) for b, i in at.items()]
        return pa.Table.from_batches([_rows(rows, PARENTS)])

    given = seats.filter("part >= 0").select("part", "bucket", "given", "counts")
    return given.groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(run, PARENTS)


def _sum(frame: DataFrame, column: str) -> np.ndarray | None:
    """The sum of packed vectors, added up in each partition first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(x) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=[column])

    got = [np.frombuffer(r[0]) for r in frame.select(column).mapInArrow(add, f"{column} binary").coalesce(1).mapInArrow(add, f"{column} binary").collect()]
    return got[0] if got else None


class Restaurants:
    """A bucket's restaurants in all samples, and the predictive probabilities of its pairs."""

    def __init__(self, r: dict, codes: Codes, totals: list[dict], hot_customers: np.ndarray):
        self.contexts, at, self.words = codes.unpack(r["contexts"]), _at(r["sizes"]), codes.unpack(r["words"])
        customers, number = _unpack(r["customers"], np.int64), _unpack(r["number"], np.int64)
        self.spot = np.repeat(np.arange(len(self.contexts)), np.diff(at)) * len(self.words) + _follows(r["follows"], at)
        tables = [_unpack(r[f"t{i}"], np.int64) for i in range(len(totals))]
        # one more context, unseen: it has no customers and gives all to its parent
        self.customers = np.append(_per_context(at, customers, number, hot_customers), 0)
        self.back = np.stack([(STRENGTH[0] + DISCOUNT[0] * np.append(_per_context(at, t, number, s["hot_tables"]), 0)) / (STRENGTH[0] + self.customers) for t, s in zip(tables, totals, strict=True)])
        self.own = np.mean([np.maximum(customers - DISCOUNT[0] * t, 0) for t in tables], axis=0)
        whole = lambda column, field: np.concatenate([np.zeros(0, np.int64), *[_unpack(x[field], np.int64) for x in r[column] or ()]])
        self.share = np.stack([_share(whole(f"b{i}", "c0"), whole(f"b{i}", "top"), s) for i, s in enumerate(totals)])
        self.count = whole("first", "counts")

    def price(self, contexts: np.ndarray, sizes: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of each pair: contexts, pairs of each, places of the words that follow in self.words."""
        n = len(self.contexts)
        c = np.full(len(contexts), n)
        if n:
            i = np.minimum(np.searchsorted(self.contexts, contexts), n - 1)
            c = np.where(self.contexts[i] == contexts, i, n)
        c = np.repeat(c, sizes)
        direct = np.zeros(len(c))
        if len(self.spot):
            key = np.where(c < n, c * len(self.words) + word, -1)
            j = np.minimum(np.searchsorted(self.spot, key), len(self.spot) - 1)
            direct = np.where(self.spot[j] == key, self.own[j], 0) / (STRENGTH[0] + self.customers[c])
        return direct + np.mean(self.back[:, c] * self.share[:, word], axis=0)


SUMS = "chunk string, meta binary, docs binary, known binary, base binary, score binary"


def _sums(rows: DataFrame, state: DataFrame, first: DataFrame, samples: list[tuple], hot_customers: np.ndarray, codes: Codes, denominator: float) -> DataFrame:
    """For each chunk and bucket the known tokens, base and score of each document there."""
    by_bucket = lambda parents, name, *fields: parents.filter("bucket >= 0").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("part", *fields))).alias(name))
    model = state.join(by_bucket(first, "first", "counts"), "bucket", "left")
    for i, (seats, parents, _) in enumerate(samples):
        model = model.join(seats.filter("part = -1").select("bucket", F.col("tables").alias(f"t{i}")), "bucket").join(by_bucket(parents, f"b{i}", "c0", "top"), "bucket", "left")
    totals = [t for _, _, t in samples]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        model = Restaurants(right.to_pylist()[0], codes, totals, hot_customers)
        base = np.log10((model.count + 0.1) / denominator)
        for chunk, contexts, sizes, known, follows, counts, docs, meta in zip(*(left.column(c) for c in ("chunk", "contexts", "sizes", "words", "follows", "counts", "docs", "meta")), strict=True):
            at = _at(sizes.as_py())
            word = np.searchsorted(model.words, codes.unpack(known.as_py()))[_follows(follows.as_py(), at)]
            price = np.log10(model.price(codes.unpack(contexts.as_py()), np.diff(at), word))
            counts, (docs, place) = _unpack(counts.as_py(), np.uint32), np.unique(_unpack(docs.as_py(), np.uint32), return_inverse=True)
            per_token = lambda x: np.bincount(place, np.repeat(x, counts), len(docs))  # noqa: B023, E731
            out.append((chunk.as_py(), meta.as_py(), _pack(docs), _pack(per_token(model.count[word] > 0).astype(np.uint32)), _pack(per_token(base[word])), _pack(per_token(price).astype(np.float32))))
        return pa.Table.from_batches([_rows(out, SUMS)])

    return rows.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(run, SUMS)


def _scored(sums: DataFrame, tokens_all: int) -> DataFrame:
    def run(rows: pa.Table) -> pa.Table:
        ids, null, held, lengths = _unpack(next(x for x in rows.column("meta").to_pylist() if x is not None), np.int64).reshape(4, -1)
        known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for docs, k, b, p in zip(*(rows.column(c) for c in ("docs", "known", "base", "score")), strict=True):
            docs = _unpack(docs.as_py(), np.uint32)
            known[docs] += _unpack(k.as_py(), np.uint32)
            base[docs] += _unpack(b.as_py(), float)
            score[docs] += _unpack(p.as_py(), np.float32)
        out = [pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), tokens_all, np.int64)), pa.array(base), pa.array(score)]
        return pa.table(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return sums.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    held: documents not to learn from (default: crc32 of doc_id as text, mod 10, is 0).
    """
    held = in_part(F.col("doc_id"), 10, 0) if held is None else held
    n_docs, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = (size or 0) // BUCKET_BYTES + 1
    table, share = _frequent(docs, n_docs)
    codes, tokens = Codes(table), share * (size or 0) / 6  # a word and its space take about six bytes
    hot = {int(table[i]): int(tokens[i]) // HOT_TOKENS + 1 for i in np.flatnonzero(tokens >= HOT_TOKENS)}
    state = stored(gathered(dealt(docs, held, buckets, hot, codes, False), hot, codes), "restaurants")
    lists = stored(listed(state, buckets, codes), "words")
    zero = np.zeros(len(hot))

    def after(seats: DataFrame, last: dict, seed: int | None) -> tuple[DataFrame, dict, np.ndarray]:
        parents = stored(parent(seats, lists, last, seed), "parents")
        sums = _sum(seats.filter("sums is not null"), "sums")
        sums = np.zeros(2 * len(hot)) if sums is None else sums
        tops = _sum(parents.filter("sums is not null"), "sums")
        tops = np.zeros(4) if tops is None else tops
        return parents, {"hot_tables": sums[: len(hot)], "customers0": tops[0], "tables0": tops[1], "types": tops[2]}, np.append(sums[len(hot) :], tops[3])

    seats = stored(sweep(state, None, None, {"hot_tables": zero}, buckets, codes, 0), "seats")
    first, totals, rest = after(seats, {}, None)
    customers, parents, samples = int(rest[-1]), first, []
    for i in range(BURN_IN + SAMPLES):
        seats = stored(sweep(state, seats, parents, totals, buckets, codes, i), "seats")
        parents, totals, _ = after(seats, totals, i)
        if i >= BURN_IN:
            samples.append((seats, parents, totals))
    rows = dealt(docs, held, buckets, hot, codes, True)
    return _scored(_sums(rows, state, first, samples, rest[:-1], codes, customers + 0.1 * (totals["types"] + 1)), customers)
