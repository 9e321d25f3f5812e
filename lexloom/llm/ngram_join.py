"""Jaccard self-join of documents on word shingles by PartEnum signatures.

Set sizes are dealt into bands whose ends differ by the factor 4/3 (for a similarity of 0.75), so two
linked sets lie in one band or in neighbouring ones, and each set signs for its own band and the next.
For a band that ends at size r linked sets differ in at most k = 2r/7 shingles. The shingle domain is cut
into ceil((k + 1) / 2) first-level parts, so one of them differs in at most one shingle, and each of these
into three second-level parts, of which two then agree: every pair of second-level parts is a signature,
and linked sets share one.

join(..., first_level=None) takes all parts, as they are, signatures over no shingle included: linked sets then
share a signature by construction. Long sets would so have a signature for every few shingles, and short
ones would meet in buckets of empty parts. By default only FIRST_LEVEL parts are used of a domain that has
more, signatures over no shingle are left out, and a domain with fewer parts is cut again under other seeds
until there are as many. A first-level part of a pair at the threshold agrees with a chance of about one
half, so a linked pair stays without a shared signature with a chance of at most 0.48 ** 24 = 2e-8, at the
very threshold, and far less above it.

Signatures of the first EARLY parts are looked at first: they link most of a group of near copies, and of
all signatures only buckets are then taken in which several components meet. So a group costs its size.

Sets are equal, for all purposes, when their 64-bit hashes are; one node stands for all copies. Within
a bucket nodes are first compared to the smallest one, its hub. Then buckets of one hub mostly become one,
and only nodes of different components are compared with each other, in blocks, behind an exact lower bound
of their difference. Pairs are never listed for a whole bucket, and a group of copies costs its size.
Nodes that meet in first buckets of one hub are a family with a bucket of its own; other buckets give only the
rows outside their main family, which come into the family's bucket.

Links are exact over 64-bit shingle hashes: 100 * intersection >= 75 * union.

Null or blank text: an empty set, linked with nothing. Null doc_id: counted, linked with nothing, null
component_id. Rows that repeat a doc_id each give a row. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import BROADCAST_IDS, U, components, discard, freed, mix, partitions, runs, slices, stored, stored_at, words

WORDS, FIRST_LEVEL, EARLY, LEFT_ROWS, RIGHT_ROWS = 5, 24, 4, 2048, 4096
#: Candidates in a block that a member gives all in the first round; of more, the nearest one (the name is of an older rule).
NEAREST_BUCKETS = 64
#: Times the comparisons that the buckets of a hub take, up to which they are one bucket.
MERGE_COST = 2
#: Times the members of a family that a bucket holds, up to which the whole family may stand for them.
FAMILY_COST = 32
_PLACE = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.uint64) | U(1)

SETS = "doc_id long, n_shingles long, node long, early array<long>, later array<long>, profile binary"


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a text of fewer than n words is one shingle."""
    hashed, word_at, _, _ = words(data, at)
    if len(hashed) >= n:
        wide = len(hashed) - n + 1
        rolled = np.zeros(wide, np.uint64)
        for j in range(n):
            rolled += hashed[j : j + wide] * _PLACE[j]
        rolled = mix(rolled)
    for a, b in zip(word_at[:-1], word_at[1:], strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix(np.array([(hashed[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + U(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _bands(most: int = 1 << 40) -> tuple[list[int], list[int]]:
    low, high = [1], [1]
    while high[-1] < most:
        low.append(high[-1] + 1)
        high.append(low[-1] * 4 // 3)
    return low, high


LOW, HIGH = _bands()


def _band_signatures(s: np.ndarray, band: int, first_level: int | None) -> list[tuple[int, np.ndarray]]:
    """(first of its parts in turn, signatures) of each seed and pair of second-level parts."""
    k = 2 * HIGH[band] // 7
    first = (k + 2) // 2
    used = min(first, first_level or first)
    out = []
    for seed in range(-(-first_level // first) if first_level else 1):
        g = np.sort(mix(s ^ U(0x5851F42D4C957F2D * seed & (2**64 - 1)))) if seed else s
        parts = 3 * used
        edges = np.array([(i * 2**64) // (3 * first) for i in range(1, parts)] + [(parts * 2**64) // (3 * first) - 1], np.uint64)
        cut = np.concatenate(([0], np.searchsorted(g, edges[:-1]), [np.searchsorted(g, edges[-1], "right")]))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g[: cut[-1]] + U(0x2545F4914F6CDD1D)))))
        sums, counts = np.diff(total[cut]).reshape(-1, 3), np.diff(cut).reshape(-1, 3)
        for tag, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
            where = U(((band * 64 + seed) * 64 * 4 + tag) * 0x9E3779B97F4A7C15 & (2**64 - 1)) + np.arange(len(sums), dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)
            sig = mix(sums[:, a] * _PLACE[11] + sums[:, b] * _PLACE[12] + where)
            some = (counts[:, a] + counts[:, b] > 0) | (first_level is None)
            early = int(some[: max(0, EARLY - seed * used)].sum())
            out.append((early, sig[some]))
    return out


def signatures(s: np.ndarray, first_level: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set for its own band and the next: of the first parts, and of the others."""
    band = bisect_right(LOW, len(s)) - 1
    got = _band_signatures(s, band, first_level) + _band_signatures(s, band + 1, first_level)
    return np.concatenate([x[:n] for n, x in got]), np.concatenate([x[n:] for n, x in got])


def profile(s: np.ndarray) -> bytes:
    """A bit for each of 8 * 2^j equal parts of the hash domain: whether it holds an odd number of shingles.

    A part in which two profiles differ holds a shingle that only one of the sets has, so the bits that differ bound the
    sets' difference from below, closely as long as differing shingles seldom share a part.
    """
    bins = 256
    while bins * 2 < len(s) and bins < 65536:
        bins *= 2
    odd = np.bincount((s & U(8 * bins - 1)).astype(np.int64), minlength=8 * bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _narrow(a: bytes, width: int) -> bytes:
    """A profile in fewer bytes: the same as one made with as few."""
    return a if len(a) == width else np.bitwise_xor.reduce(np.frombuffer(a, np.uint8).reshape(-1, width), 0).tobytes()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which the rows of a, as 64-bit words, differ from b."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _fits(n_a: int, n_b: int, a: bytes, b: bytes) -> bool:
    """Whether sets of these sizes and profiles can link: that takes 7 * difference <= sizes."""
    width = min(len(a), len(b))
    x, y = (np.frombuffer(_narrow(p, width), U) for p in (a, b))
    return 7 * int(_apart(x, y)) <= n_a + n_b


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)


def sets(docs: DataFrame, first_level: int | None = FIRST_LEVEL) -> DataFrame:
    """A row for each document: size, node (the set's hash, null for an empty set), signatures, profile."""

    def lists(parts: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "node", "early", "later", "profile"]
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in batches:
            for first, last, data, at in slices(batch.column(1)):
                size, node, sigs, shape = [], [], [], []
                for s in shingle_sets(data, at):
                    size.append(len(s))
                    node.append(int(mix(np.array([mix(s).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else None)
                    sigs.append(signatures(s, first_level) if len(s) else none)
                    shape.append(profile(s) if len(s) else None)
                columns = [pa.array(size, pa.int64()), pa.array(node, pa.int64()), *map(lists, zip(*sigs, strict=True)), pa.array(shape, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(freed(run), SETS)


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Of (a, b) node pairs those that link, and the folders to discard once they are read. Cheap bound first, then the whole texts of the remaining ones."""
    shape = nodes.select("node", "n_shingles", "profile", "doc_id")
    side = lambda x: shape.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("profile").alias(f"p_{x}"), F.col("doc_id").alias(f"doc_{x}"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            keep = [_fits(x, y, p, q) for x, y, p, q in zip(c["n_a"], c["n_b"], c["p_a"], c["p_b"], strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "doc_a", "doc_b"])

    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "p_a", "p_b", "doc_a", "doc_b")
    near, used = stored_at(near.mapInArrow(freed(bound), "a long, b long, doc_a long, doc_b long"), "near")
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    wanted = near.select(F.col("doc_a").alias("doc_id")).unionAll(near.select(F.col("doc_b").alias("doc_id"))).distinct()
    small = near.limit(BROADCAST_IDS // 2 + 1).count() <= BROADCAST_IDS // 2
    texts, also = stored_at(texts.join(F.broadcast(wanted) if small else wanted, "doc_id", "left_semi"), "near-texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node_of = lambda s: int(mix(np.array([mix(s).sum(dtype=np.uint64) + U(len(s))], np.uint64)).view(np.int64)[0])
        held, held_key = None, None
        for batch in batches:
            good = []
            for i, j, data, at in slices(batch.column(2)):
                for k, right in zip(range(i, j), shingle_sets(data, at), strict=True):
                    a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    text = batch.column(3)[k]
                    if a != held_key or text.as_py() != held[0]:
                        _, _, d, t = next(slices(batch.column(3).slice(k, 1)))
                        held, held_key = (text.as_py(), next(shingle_sets(d, t))), a
                    left = held[1]
                    # a doc_id can stand on several rows: only the row of that very set counts
                    good.append(len(left) > 0 and len(right) > 0 and node_of(left) == a and node_of(right) == b and linked(left, right))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    right = near.join(texts.select(F.col("doc_id").alias("doc_b"), F.col("text").alias("text_b")), "doc_b")
    both = right.join(texts.select(F.col("doc_id").alias("doc_a"), F.col("text").alias("text_a")), "doc_a").select("a", "b", "text_b", "text_a")
    return both.mapInArrow(freed(check), "a long, b long").distinct(), [used, also]


def _rest(shared: DataFrame, labels: DataFrame, nodes: DataFrame, tested: DataFrame, open_rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Untested pairs of different components in one bucket that the lower bound lets through, and (sig, node, main) of members that have more.

    Every member outside a bucket's largest component is compared with all members of other components:
    the former are dealt into blocks of LEFT_ROWS, the members into blocks of RIGHT_ROWS, and two blocks
    meet in one group in memory. A member that has more than NEAREST_BUCKETS candidates in a block gives only the nearest one, and
    has more. With such members as `open_rows` all their pairs that are left are given. A bucket keeps its main
    component, as it has grown since: a pair that is left then was a candidate of a member outside it that had more.
    """
    if open_rows is not None:
        now = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        outside = open_rows.join(now("node"), "node", "left").join(now("main"), "main", "left").filter("coalesce(node_root, node) <> coalesce(main_root, main)").select("sig", "node", "main")
        outside = stored(outside, "open")
        if outside.isEmpty():
            return tested.limit(0), outside
        shared = shared.join(outside.select("sig"), "sig", "left_semi")
    member = shared.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition(partitions(shared.sparkSession), "sig")
    count = member.groupBy("sig", "root").agg(F.count("*").alias("n"))
    split = count.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).filter("parts > 1")
    split = split.select("sig", F.col("most.root").alias("main"), F.expr("n - most.n").alias("outside"), "n")
    if open_rows is not None:
        split = outside.groupBy("sig").agg(F.min("main").alias("main"), F.count("*").alias("outside")).join(split.select("sig", "n"), "sig")
    split = split.select("sig", "main", F.expr(f"(outside + {LEFT_ROWS} - 1) div {LEFT_ROWS}").alias("lefts"), F.expr(f"(n + {RIGHT_ROWS} - 1) div {RIGHT_ROWS}").alias("rights"))
    member = member.join(split, "sig").withColumn("g", F.pmod(F.xxhash64("node"), F.col("lefts"))).withColumn("h", F.pmod(F.xxhash64("node", F.lit(1)), F.col("rights")))
    if open_rows is None:
        member = member.withColumn("out", F.col("root") != F.col("main"))
    else:
        member = member.join(outside.select("sig", "node", F.lit(True).alias("out")), ["sig", "node"], "left").withColumn("out", F.coalesce("out", F.lit(False)))
    # a row for each block of a member; in its own two blocks one row compares and is compared with
    right = member.withColumnRenamed("g", "own_g").select("sig", "main", "node", "root", F.explode(F.expr("sequence(0, lefts - 1)")).alias("g"), "h", "own_g", "out")
    right = right.select("sig", "main", "node", "root", "g", "h", F.expr("out and g = own_g").alias("is_left"), F.lit(True).alias("is_right"))
    left = member.filter("out and rights > 1").select("sig", "main", "node", "root", "g", F.explode(F.expr("filter(sequence(0, rights - 1), x -> x <> h)")).alias("h"), F.lit(True).alias("is_left"), F.lit(False).alias("is_right"))
    meet = right.unionByName(left).join(nodes.select("node", "n_shingles", "profile"), "node")

    nearest = open_rows is None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, groups in runs(batches, ["sig", "g", "h"]):
            node, root, n, is_left, is_right = (np.array(c[x]) for x in ("node", "root", "n_shingles", "is_left", "is_right"))
            out: list[np.ndarray] = []
            has_more: list[int | None] = []
            for first, end in groups:
                own = np.arange(first, end)
                lefts, others = own[is_left[first:end]], own[is_right[first:end]]
                if not len(lefts) or not len(others):
                    continue
                width = min(len(c["profile"][i]) for i in own)
                x = np.frombuffer(b"".join(_narrow(c["profile"][i], width) for i in own), U).reshape(-1, width // 8)
                for i in lefts:
                    j = others[(root[others] != root[i]) & (np.minimum(n[others], n[i]) * 4 >= np.maximum(n[others], n[i]) * 3)]
                    if not len(j):
                        continue
                    one, step = x[i - first], max(1, (1 << 22) // width)
                    apart = np.concatenate([_apart(x[j[k : k + step] - first], one) for k in range(0, len(j), step)])
                    fits = 7 * apart <= n[j] + n[i]
                    j, apart = j[fits], apart[fits]
                    if not len(j):
                        continue
                    more = nearest and len(j) > NEAREST_BUCKETS
                    if more:
                        j = j[np.lexsort((node[j], apart))[:1]]
                    out.append(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))))
                    has_more += [i if more else None] * len(j)
            if out:
                pairs = np.concatenate(out, 1)
                more_at = [pa.array([None if i is None else c[x][i] for i in has_more], pa.int64()) for x in ("sig", "node", "main")]
                table = pa.table([pairs[0], pairs[1], *more_at], names=["a", "b", "sig", "node", "main"])
                yield from table.group_by(table.column_names).aggregate([]).combine_chunks().to_batches()

    meet = meet.select("sig", "g", "h", "is_left", "is_right", "main", "node", "root", "n_shingles", "profile").repartition(partitions(shared.sparkSession), "sig", "g", "h").sortWithinPartitions("sig", "g", "h")
    found = stored(meet.mapInArrow(freed(compare), "a long, b long, sig long, node long, main long"), "candidates")
    return found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), found.select("sig", "node", "main").filter("sig is not null").distinct()


def _shared(rows: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Of (sig, node, root) those of the buckets in which several components meet, with the bucket's smallest node as hub, its root, and the bucket's size; of equal buckets one. A row can come twice.

    Of a bucket that holds enough of a family only the rows outside it are given, and the family stands for the hub,
    with its size, else 0, as `size`: the family has a bucket of its own, where its pairs meet, and those with such rows.
    """
    rows = rows.filter("sig is not null").repartition(partitions(rows.sparkSession), "sig")  # the filter that a join makes by itself: with it both sides are one exchange
    figures = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("hub"), F.min_by("root", "node").alias("hub_root"), F.max("node").alias("last"), F.min("root").alias("low"), F.max("root").alias("high")]
    if families is None:
        bucket = rows.groupBy("sig").agg(*figures).filter("low <> high")
    else:  # a bucket within a family has nothing that the family's doesn't have
        figures += [F.count("family").alias("held"), F.min("family").alias("family"), F.max("family").alias("other")]
        bucket = rows.groupBy("sig").agg(*figures).filter("low <> high and not (held = n and family = other)")
    # equal buckets, most of a group's, are taken once
    bucket = bucket.groupBy("n", "x", "hub", "hub_root", "last").agg(F.min("sig").alias("sig")).select("sig", "hub", "hub_root", "n")
    if families is None:
        return rows.join(bucket.hint("shuffle_hash"), "sig")
    of = families.select("family", "family_root", "size").distinct()
    most = rows.filter("family is not null").groupBy("sig", "family").agg(F.count("*").alias("held")).join(of, "family").filter(f"held * {FAMILY_COST} >= size")
    most = most.groupBy("sig").agg(F.max(F.struct("held", "family", "family_root", "size")).alias("most"))
    bucket = bucket.join(most, "sig", "left").select("sig", F.coalesce("most.family", "hub").alias("hub"), F.coalesce("most.family_root", "hub_root").alias("hub_root"), "n", F.coalesce("most.size", F.lit(0)).alias("size"))
    outside = (F.col("size") == 0) | F.col("family").isNull() | (F.col("family") != F.col("hub"))
    return rows.join(bucket.hint("shuffle_hash"), "sig").filter(outside)


def _families(early: DataFrame, label: DataFrame) -> DataFrame:
    """(node, family, family_root, size): nodes by the hub, of those of their first buckets, that meets the most nodes.

    A family's pairs all get compared, in one bucket, so only hubs are taken for which that is at most MERGE_COST times the
    comparisons of their buckets. Other nodes have no family.
    """
    met = early.groupBy("hub", "node").agg(F.sum("n").alias("n"))
    hubs = met.groupBy("hub").agg(F.count("*").alias("members"), F.sum("n").alias("pairs")).filter(F.col("members") * F.col("members") <= MERGE_COST * F.col("pairs"))
    own = stored(met.join(hubs, "hub").groupBy("node").agg(F.max(F.struct("members", "hub")).alias("most")).select("node", F.col("most.hub").alias("family")), "family")
    size = own.groupBy("family").agg(F.count("*").alias("size")).filter("size > 1")
    size = size.join(label.select(F.col("node").alias("family"), F.col("root").alias("family_root")), "family", "left")
    return stored(own.join(size.withColumn("family_root", F.coalesce("family_root", "family")), "family").select("node", "family", "family_root", "size"), "families")


def _merged(found: DataFrame, families: DataFrame) -> DataFrame:
    """Of (hub, size, node, sigs, n), n the summed sizes of these buckets, (sig, node) rows of buckets that hold every pair of the given ones and of the families.

    The members of a family of texts meet in most of their buckets again, and these mostly have one hub. The buckets of a
    hub are one, under the hub's name, unless that takes more than MERGE_COST times the comparisons: pairs of a family are
    then compared once, and a family costs its size and not, for every signature, its size. What meets a family comes into
    the family's bucket, unless it is so much that it would meet itself too often: then the family joins each bucket.
    """
    cost = F.when(F.col("size") > 0, MERGE_COST * FAMILY_COST).otherwise(MERGE_COST)
    one = found.groupBy("hub", "size").agg(F.count("*").alias("members"), F.sum("n").alias("pairs")).filter(F.col("members") * (F.col("members") + F.col("size")) <= cost * F.col("pairs"))
    one = stored(one.select("hub", "size", F.lit(True).alias("whole")), "merged")
    name = lambda family: F.xxhash64(family, F.lit("family"))
    rows = found.join(one, ["hub", "size"], "left")
    each = rows.filter("size > 0 and whole is null").select(F.col("hub").alias("family"), F.explode("sigs").alias("sig")).distinct()
    rows = rows.withColumn("sigs", F.when(F.col("whole"), F.array(F.when(F.col("size") > 0, name("hub")).otherwise(F.col("hub")))).otherwise(F.col("sigs")))
    rows = rows.select(F.explode("sigs").alias("sig"), "node").unionAll(each.join(families, "family").select("sig", "node"))
    return rows.unionAll(families.select(name("family").alias("sig"), "node"))


def join(docs: DataFrame, first_level: int | None = FIRST_LEVEL) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. first_level: parts used (None: all, without any chance of a miss)."""
    all_sets = stored(sets(docs, first_level), "shingle-sets")
    known = all_sets.filter("node is not null and doc_id is not null")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("profile").alias("profile")), "nodes")
    one = known.groupBy("node").agg(F.first("early").alias("early"), F.first("later").alias("later"))
    early = stored(_shared(one.select("node", F.col("node").alias("root"), F.explode("early").alias("sig"))).distinct(), "shared")
    pair = F.col("hub").alias("a"), F.col("node").alias("b")
    tested = stored(early.filter("node <> hub").select(*pair).distinct(), "star")

    def linked_by(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
        """The components of the pairs that link and of what is known: only roots are linked anew."""
        links, used = _verified(pairs, nodes, docs)
        if known is not None:
            top = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
            links = links.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        found = components(links, "a", "b")
        discard(docs.sparkSession, *used)
        if known is None or found.isEmpty():
            return found if known is None else known
        grown = known.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        return stored(grown.unionByName(found.join(known, "node", "left_anti")), "labels")

    label = linked_by(tested, None)
    families = _families(early, label)
    state = stored(label.join(families.select("node", "family"), "node", "full"), "state")
    with_root = lambda rows: rows.join(state, "node", "left").withColumn("root", F.coalesce("root", "node"))
    later = with_root(one).select("node", "root", "family", F.explode("later").alias("sig"))
    found = _shared(later.unionByName(with_root(early.select("node", "sig")).select("node", "root", "family", "sig")), families)
    found = stored(found.groupBy("hub", "size", "node", "hub_root", "root").agg(F.collect_set("sig").alias("sigs"), F.sum("n").alias("n")), "shared")
    star = stored(found.filter("root <> hub_root").select(*pair).distinct().join(tested, ["a", "b"], "left_anti"), "star")
    label, tested, shared = linked_by(star, label), tested.unionAll(star), stored(_merged(found, families), "buckets")
    more = None
    for _ in range(2):  # the nearest ones first: most of the other pairs then lie in one component
        rest, more = _rest(shared, label, nodes, tested, more)
        rest = stored(rest, "rest")
        if not rest.isEmpty():
            tested, label = tested.unionAll(rest), linked_by(rest, label)
    member = nodes.select("node", "doc_id").join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = member.join(least, "root").select("node", "component_id")
    out = all_sets.select("doc_id", "n_shingles", "node").join(component, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
